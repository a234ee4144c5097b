"""Session helpers: local sessions for tests/bench and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings of sessions that this package starts; queries never change a session.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Scoring is CPU-heavy (~1 ms per record and alignment): smaller scan
    # splits bound the work a lost executor takes with it, without a shuffle.
    # (Splits follow parquet row groups, so inputs should be written with
    # row groups of this size or smaller.)
    "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
    # Inference batches carry audio arrays (10 s at 16 kHz is ~640 KB a row):
    # 256 rows keep one Arrow batch near 160 MB in the Python worker.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
}


def local_session(cores: int = 8, app: str = "scorelake", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench (UI off, no servers)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.driver.memory", os.environ.get("SCORELAKE_DRIVER_MEMORY", "16g"))
        .config("spark.python.worker.reuse", "true")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, as the session states it.

    Only a local session may leave it unset; it gets one temporary folder. On a
    cluster that would be a disk of each executor's own, so it is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _LOCAL.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="scorelake-"))


_LOCAL: dict[str, str] = {}
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``scorelake`` importable in executor Python workers (once per app).

    Only code that runs in Python on executors needs it. The archive leaves the
    driver through Spark's own file distribution; no data goes this way.
    """
    import shutil

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    staging = tempfile.mkdtemp(prefix="scorelake-pkg-")
    sc.addPyFile(shutil.make_archive(os.path.join(staging, "scorelake"), "zip", root_dir=os.path.dirname(pkg), base_dir="scorelake"))
    _SHIPPED.add(sc.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint root."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
