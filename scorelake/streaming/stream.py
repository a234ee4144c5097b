"""Structured Streaming: incremental scoring and a running per-run summary (H1, H2).

The same column expressions as the batch path run on a stream. Records go
to an append-only file sink (exactly-once with the checkpoint), so a crash
keeps every finished micro-batch. The running summary keeps one small state
row per run (counters and integer sums only), so it needs no watermark; each
micro-batch commits the runs that it changed to a summary store, which is
written anew from time to time, so its files stay few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.operators.score import COUNT_COLUMNS, score_records
from scorelake.operators.summary import summary_aggregates, with_summary_rates
from scorelake.plans.parallel import task_count
from scorelake.session import scratch_path
from scorelake.sources.commits import GRACE_SECONDS, batch_path, commit, new_batch, remove_old_files, state
from scorelake.sources.records import read_summaries, write_summaries, write_summary_lines
from scorelake.sources.tables import resolve_row_index

# Bytes of new files in one micro-batch, for each core.
BATCH_BYTES_PER_CORE = 512 * 1024 * 1024


def read_utterance_stream(spark: SparkSession, path: str, columns: list[str] | None = None,
                          max_files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the rows of a parquet table: a folder that files arrive in, or one file.

    Rows carry ``source_file`` and ``row_in_file``, which together are unique;
    :func:`scorelake.sources.tables.resolve_row_index` turns them into the
    batch ``row_index`` once the files are known. A micro-batch is bounded by
    bytes, in proportion to the cluster.
    """
    source = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(source.schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    else:
        reader = reader.option("maxBytesPerTrigger", BATCH_BYTES_PER_CORE * cores)
    if not fs.getFileStatus(hadoop).isDirectory():
        reader, path = reader.option("pathGlobFilter", hadoop.getName()), hadoop.getParent().toString()
    rows = reader.parquet(path).select(
        *(columns or source.columns), F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.row_index").alias("row_in_file"))
    # Splits may be few, or hold many rows or none; quadratic scoring work is dealt out evenly.
    return rows.repartition(task_count(source))


def write_record_stream(records: DataFrame, sink: str, checkpoint: str, available_now: bool = True):
    """H1: append scored records to a parquet sink; returns the started query."""
    writer = (records.writeStream.format("parquet").option("path", sink)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


# Micro-batches after which the summary store is written anew.
COMPACT_EVERY = 50


def write_running_summary(records: DataFrame, table: str, checkpoint: str, available_now: bool = True,
                          compact_every: int = COMPACT_EVERY, grace_seconds: float = GRACE_SECONDS):
    """H2: stateful per-run counters and sums, kept in the summary store ``table``.

    ``update`` mode emits the runs that a micro-batch changed, with their whole
    sums; they replace what the store has of these runs, in one commit, so a
    repeated epoch changes nothing. Every ``compact_every`` epochs the store
    becomes one batch again, and files that nobody has needed for
    ``grace_seconds`` go. The state is one row per run, dealt to as many
    partitions as the session's ``spark.sql.shuffle.partitions`` says when the
    query first starts; the aggregate is partial before the shuffle, so a hot
    run is one row per task.
    """
    sums = records.groupBy("run_name").agg(*summary_aggregates())

    def put(batch: DataFrame, epoch: int) -> None:
        write_summaries(batch, table)
        if (epoch + 1) % compact_every == 0:
            compact_summaries(batch.sparkSession, table, grace_seconds)

    writer = sums.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def compact_summaries(spark: SparkSession, table: str, grace_seconds: float = GRACE_SECONDS) -> None:
    """One batch with every run's summary in place of those before, and no files older than the grace time."""
    read, batch = state(spark, table), new_batch()
    write_summary_lines(read_summaries(spark, table, read), batch_path(table, batch))
    commit(spark, table, "rewrite", batch, drop=read.batches, read=read)
    remove_old_files(spark, table, grace_seconds)


def read_running_summary(spark: SparkSession, table: str) -> DataFrame:
    stored = read_summaries(spark, table)
    return with_summary_rates(stored.select("run_name", "rows", "scored_rows", "error_rows", *COUNT_COLUMNS))


def backfill_records(spark: SparkSession, path: str, to_records, keys: list[str], columns: list[str] | None = None,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """H1 over files that may have been delivered more than once: of the records
    that agree in ``keys`` the first is scored, over all micro-batches.

    The keys are state, so this is for a backfill, which ends and whose state
    goes with its checkpoint; they are dealt to the session's shuffle partitions.
    """
    sink = scratch_path(spark, "backfill-records")
    stream = read_utterance_stream(spark, path, columns, max_files_per_trigger)
    once = to_records(stream).dropDuplicates(keys)
    write_record_stream(score_records(once), sink, sink + "-checkpoint").awaitTermination()
    return spark.read.parquet(sink)


def run_scored_stream(spark: SparkSession, path: str, to_records, columns: list[str] | None = None,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Drive H1 to completion over the table at ``path`` and read the sink, with ``row_index``."""
    sink = scratch_path(spark, "stream-records")
    stream = read_utterance_stream(spark, path, columns, max_files_per_trigger)
    query = write_record_stream(score_records(to_records(stream)), sink, sink + "-checkpoint")
    query.awaitTermination()
    return resolve_row_index(spark.read.parquet(sink), spark.read.parquet(path))


def run_summary_stream(spark: SparkSession, path: str, to_records, columns: list[str] | None = None,
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """Drive H2 to completion over the table at ``path`` and read the summary."""
    table = scratch_path(spark, "stream-summary")
    stream = read_utterance_stream(spark, path, columns, max_files_per_trigger)
    query = write_running_summary(score_records(to_records(stream)), table, table + "-checkpoint")
    query.awaitTermination()
    return read_running_summary(spark, table)
