"""Readers for the input tables, with a stable 0-based source row index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The error of a limit below one.
LIMIT_ERROR = "--limit must be >= 1"
# The offset table has 16 bytes a file; up to this many files it is broadcast,
# beyond it the join on the file is left to the optimiser.
MAX_BROADCAST_FILES = 2_000_000


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def file_count(df: DataFrame) -> int:
    """Files that ``df`` scans; the list itself stays in the JVM."""
    return len(df._jdf.inputFiles())


def split_count(df: DataFrame) -> int:
    """Splits that a scan of ``df``'s files has, about: one for each file, and for
    each ``spark.sql.files.maxPartitionBytes`` of them. No job runs."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    tables = [leaf for leaf in (leaves.apply(i) for i in range(leaves.size())) if leaf.nodeName() == "LogicalRelation"]
    size = max((int(str(leaf.stats().sizeInBytes())) for leaf in tables), default=0)
    most = df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return max(file_count(df), -(-size // most))


def file_hash(path: Column) -> Column:
    return F.xxhash64(path)


def file_offsets(df: DataFrame) -> DataFrame:
    """``(_file, _offset)``: rows in all files whose path sorts before, by path hash.

    One row per file; the counts read no column. Two paths with one hash end
    the job instead of mixing their rows up.
    """
    counts = df.select(F.col("_metadata.file_path").alias("_path")).groupBy("_path").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.select(file_hash(F.col("_path")).alias("_file"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    unique = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_paths"), F.min("_offset").alias("_offset"))
    clash = F.raise_error(F.lit("two input paths have the same hash"))
    offsets = unique.select("_file", F.when(F.col("_paths") == 1, F.col("_offset")).otherwise(clash.cast("bigint")).alias("_offset"))
    return F.broadcast(offsets) if file_count(df) <= MAX_BROADCAST_FILES else offsets


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """0-based position of each row in source order, without a global sort.

    ``df`` must come straight from a file scan. The position is the file's
    own ``_metadata.row_index`` plus the number of rows in all files whose
    path sorts before it.
    """
    scanned = df.select(*df.columns, file_hash(F.col("_metadata.file_path")).alias("_file"),
                        F.col("_metadata.row_index").alias("_row_in_file"))
    return scanned.join(file_offsets(df), "_file").select(
        *df.columns, (F.col("_offset") + F.col("_row_in_file")).alias(name))


def resolve_row_index(records: DataFrame, source: DataFrame, file_col: str = "source_file",
                      row_col: str = "row_in_file", name: str = "row_index") -> DataFrame:
    """``row_index`` of records that carry their source file and the row in it
    (a stream's records: a file's place is known only once the files before it are)."""
    rest = [c for c in records.columns if c not in (file_col, row_col, name)]
    return records.withColumn("_file", file_hash(F.col(file_col))).join(file_offsets(source), "_file").select(
        *rest, (F.col("_offset") + F.col(row_col)).alias(name))


def first_n_rows(df_with_index: DataFrame, limit: int | None, index: str = "row_index") -> DataFrame:
    """The first ``limit`` rows in source order, of rows that have their index."""
    if limit is None:
        return df_with_index
    if limit < 1:
        raise ValueError(LIMIT_ERROR)
    return df_with_index.where(F.col(index) < F.lit(limit))


def read_first_rows(spark: SparkSession, path: str, limit: int, columns: list[str]) -> DataFrame:
    """A7 from storage: ``columns`` and ``row_index`` of the first ``limit`` rows.

    Parquet footers say how many rows each file holds; files are taken in path
    order until there are enough, and no other file is opened. No job runs.
    """
    if limit < 1:
        raise ValueError(LIMIT_ERROR)
    source = spark.read.parquet(path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs.Path
    files = sorted(source.inputFiles())
    picked, rows = [], 0
    for name in files:
        place = hadoop(jvm.java.net.URI(name))
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(
            jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(place, conf))
        try:
            rows += reader.getRecordCount()
        finally:
            reader.close()
        picked.append(place.toString())
        if rows >= limit:
            break
    head = spark.read.schema(source.schema).option("basePath", path).parquet(*picked) if len(picked) < len(files) else source
    return first_n_rows(with_row_index(head.select(*columns)), limit)


def source_row_count(df: DataFrame, limit: int | None = None) -> int:
    """A5: row count (parquet footers answer it), capped by ``limit``."""
    total = df.count()
    return min(total, limit) if limit is not None else total


def read_split(spark: SparkSession, root: str, spec, columns: list[str] | None = None) -> DataFrame:
    """A3: one split of a dataset stored as ``<root>/<name>/config=<config>/split=<split>/*.parquet``.

    The split and config are partition columns, so the filter prunes whole
    directories before any file is opened; only ``columns`` (plus the audio
    and reference columns of ``spec``) are read.
    """
    df = spark.read.parquet(f"{root.rstrip('/')}/{spec.name}")
    df = df.where((F.col("config") == spec.config) & (F.col("split") == spec.split))
    keep = columns or [c for c in df.columns if c not in ("config", "split")]
    return df.select(*keep)
