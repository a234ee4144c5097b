"""What the operators share: scratch tables, shipping code, connected components."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``, as the session states it.

    Unset, a local session gets one temporary folder; on a cluster that is an
    error, because executors would each write to a disk of their own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="scorelake-llm-"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, so
    that a lost executor repeats one step and no step runs twice."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Let executors import this package, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    staging = tempfile.mkdtemp(prefix="scorelake-zip-")
    copy = shutil.copytree(package, os.path.join(staging, "src", "scorelake"), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(staging, "scorelake"), "zip", root_dir=os.path.dirname(copy), base_dir="scorelake"))
    _SHIPPED.add(sc.applicationId)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` lacks, in any case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def slices(column: pa.Array, rows: int = 500) -> Iterator[list]:
    """A column's values as Python objects, some rows at a time, so that a batch
    of long texts is not held twice."""
    for at in range(0, len(column), rows):
        yield column.slice(at, rows).to_pylist()


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def connected_components(edges: DataFrame, name: str = "links") -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; a component is
    named by its smallest node. Nulls and self-links are ignored.

    Alternating stars: each round hangs the larger neighbours of every node on
    its smallest neighbour, then the smaller ones, until every component is one
    star. Each round is a grouped minimum (combined before the shuffle) and a
    join, which AQE splits when a node is hot; rounds grow with the logarithm
    of the longest chain. Each round is written to the shared folder.
    """
    up, down = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    links = stored(edges.where("a <> b").select(up, down).distinct(), name)
    before = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Every link now points from the larger to the smaller node.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        links = stored(small.where("u <> v").distinct(), name)
