"""Record and summary storage.

A store is a folder of JSON lines, NULL fields omitted (the reference's
"absent key" rule). Its state is what the commit log says
(:mod:`scorelake.sources.commits`): a job writes its lines beside what is there,
as ``kind=<kind>/run_name=<run>/part-*`` of a new batch, and one commit makes
them part of the store, whether it appends, replaces runs or rewrites. Readers
take committed batches only, so they see the old state or the new one and
nothing between. Files of either layout that lie in a folder without a log
(``run_name=<run>/part-*.json``, or one ``<run>.jsonl`` per run) are read too,
until a rewrite takes their place. Reading goes through the text source, never
straight through the JSON reader: a NUL-padded line must be repaired before it
is parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.functions.text import WHITESPACE_CLASS
from scorelake.sources import commits
from scorelake.sources.commits import FOUND, State, batch_of, batch_path, children, commit, hadoop, new_batch

CORRUPT = "_corrupt_record"
EXTRA = "extra_fields"

RECORD_FIELDS = [
    ("engine", T.StringType()),
    ("model", T.StringType()),
    ("dataset", T.StringType()),
    ("hf_dataset", T.StringType()),
    ("dataset_config", T.StringType()),
    ("split", T.StringType()),
    ("audio_column", T.StringType()),
    ("reference_column", T.StringType()),
    ("row_index", T.LongType()),
    ("prediction", T.StringType()),
    ("reference", T.StringType()),
    ("wer", T.DoubleType()),
    ("cer", T.DoubleType()),
    ("whisper_wer", T.DoubleType()),
    ("whisper_cer", T.DoubleType()),
    ("error", T.StringType()),
    ("elapsed_seconds", T.DoubleType()),
    ("word_errors", T.LongType()),
    ("reference_words", T.LongType()),
    ("char_errors", T.LongType()),
    ("reference_chars", T.LongType()),
    ("whisper_word_errors", T.LongType()),
    ("whisper_reference_words", T.LongType()),
    ("whisper_char_errors", T.LongType()),
    ("whisper_reference_chars", T.LongType()),
]
RECORD_SCHEMA = T.StructType([T.StructField(n, t) for n, t in RECORD_FIELDS])
# Every field is read as text and cast afterwards: a field of the wrong type
# costs that field, not the record.
_LENIENT = T.StructType([T.StructField(n, T.StringType()) for n, _ in RECORD_FIELDS] + [T.StructField(CORRUPT, T.StringType())])
# Rows of one run that go to one file.
ROWS_PER_FILE = 250_000


def record_columns(df: DataFrame) -> list[str]:
    return [n for n, _ in RECORD_FIELDS if n in df.columns]


def to_json_lines(records: DataFrame, keep: tuple[str, ...] = ("run_name",)) -> DataFrame:
    """One JSON object per record (``value``), NULL fields omitted, fields that
    the schema does not know (``extra_fields``, a JSON object) kept."""
    known = F.to_json(F.struct(*record_columns(records)))
    if EXTRA in records.columns:
        joined = F.concat(F.substring(known, F.lit(1), F.length(known) - 1), F.when(known == "{}", "").otherwise(","), F.expr(f"substring({EXTRA}, 2)"))
        known = F.when(F.col(EXTRA).isNull(), known).otherwise(joined)
    return records.select(*keep, known.alias("value"))


def dealt_lines(lines: DataFrame, rows_per_file: int = ROWS_PER_FILE, by: tuple[str, ...] = ("run_name",)) -> DataFrame:
    """Lines ``(*by, _row, value)`` dealt out by blocks of row indexes (``_row``),
    so a hot run is many files of a sane size and a small one is one file,
    however many tasks scored it."""
    block = F.expr(f"_row div {rows_per_file}")
    return lines.repartition(*by, block).sortWithinPartitions(*by, "_row").select(*by, "value")


def _write_lines(lines: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE, by: tuple[str, ...] = ("run_name",)) -> None:
    lines.write.option("maxRecordsPerFile", rows_per_file).partitionBy(*by).text(path)


def write_batch(records: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> str:
    """Scored records as a batch that no commit names yet; returns its id.

    Rows with a ``run_failure`` are no records: they become lines of the kind
    ``failures``, in the same job.
    """
    batch = new_batch()
    row = F.col("row_index") if "row_index" in records.columns else F.lit(0).cast("long")
    if "run_failure" in records.columns:
        failure = F.col("run_failure").isNotNull()
        lines = to_json_lines(records, ("run_name", row.alias("_row"), F.when(failure, "failures").otherwise("records").alias("kind"), "run_failure"))
        value = F.when(F.col("kind") == "failures", F.to_json(F.struct(F.col("run_failure").alias("error")))).otherwise(F.col("value"))
        _write_lines(dealt_lines(lines.select("kind", "run_name", "_row", value.alias("value")), rows_per_file, ("kind", "run_name")), batch_path(path, batch), rows_per_file, ("kind", "run_name"))
    else:
        _write_lines(dealt_lines(to_json_lines(records, ("run_name", row.alias("_row"))), rows_per_file), f"{batch_path(path, batch)}/kind=records", rows_per_file)
    return batch


SUM_FIELDS = ("rows", "scored_rows", "error_rows", "word_errors", "reference_words", "char_errors", "reference_chars",
              "whisper_word_errors", "whisper_reference_words", "whisper_char_errors", "whisper_reference_chars")


def write_sums(sums: DataFrame, path: str, batch: str) -> None:
    """What a batch adds to each run's counters and sums (``run_name, *SUM_FIELDS``)."""
    lines = sums.select("run_name", F.to_json(F.struct(*SUM_FIELDS)).alias("value"))
    _write_lines(lines.repartition("run_name"), f"{batch_path(path, batch)}/kind=sums")


def read_sums(spark: SparkSession, path: str, now: State | None = None) -> DataFrame:
    """Each run's counters and sums, from what its batches added; no record is read."""
    fields = ", ".join(f"{name} bigint" for name in SUM_FIELDS)
    added = _lines(spark, path, "sums", now).select("run_name", F.from_json("value", fields).alias("s")).select("run_name", "s.*")
    sums = added.groupBy("run_name").agg(*[F.sum(name).alias(name) for name in SUM_FIELDS])
    counters = SUM_FIELDS[:3]
    return sums.select("run_name", *counters, *[F.when(F.col("scored_rows") > 0, F.col(c)).alias(c) for c in SUM_FIELDS[3:]])


def runs_without_sums(spark: SparkSession, path: str, now: State | None = None) -> set[str]:
    """Runs with records in a batch that did not say what it adds; lists files, reads none."""
    now = now or commits.state(spark, path)
    plain = {b for b in now.holding("records") if "sums" not in now.kinds[b]}
    if not plain:
        return set()
    own = State(now.version, {b: n for b, n in now.batches.items() if b in plain}, {b: now.kinds[b] for b in plain}, now.hidden)
    return {r["run_name"] for r in _listed(spark, path, "records", own).select("run_name").distinct().collect()}


def runs_of_batch(spark: SparkSession, path: str, batch: str, kind: str = "records") -> list[str]:
    """The runs that a batch holds, from its folders."""
    names = [n[len("run_name="):] for n in children(spark, f"{batch_path(path, batch)}/kind={kind}") if n.startswith("run_name=")]
    unescape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    return [unescape(n) for n in names]


def write_records(records: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> int:
    """The runs that are written replace what they had, in one commit; returns its number."""
    spark = records.sparkSession
    batch = write_batch(records, path, rows_per_file)
    return commit(spark, path, "replace", batch, hide=runs_of_batch(spark, path, batch))


def append_records(records: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE, info: dict[str, str] | None = None) -> int:
    """A8 without replacing what the runs have stored."""
    return commit(records.sparkSession, path, "append", write_batch(records, path, rows_per_file), info=info)


def write_summaries(summaries: DataFrame, path: str) -> int:
    """One JSON object per run (undefined rates are NULL, hence omitted); a
    run's summary replaces the one before."""
    spark, batch = summaries.sparkSession, new_batch()
    write_summary_lines(summaries, batch_path(path, batch))
    return commit(spark, path, "replace", batch, hide=runs_of_batch(spark, path, batch, "summaries"))


def write_summary_lines(summaries: DataFrame, batch: str) -> None:
    """The summaries' lines as part of the batch in this folder."""
    rest = [c for c in summaries.columns if c != "run_name"]
    _write_lines(summaries.select("run_name", F.to_json(F.struct(*rest)).alias("value")).repartition("run_name"), f"{batch}/kind=summaries")


def run_of(path: Column) -> Column:
    """The run that a stored file belongs to, as a string: its partition folder's
    value, else its stem; NULL for other files."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))  # paths are written as URIs
    folder = F.regexp_extract(decoded, r"/run_name=([^/]*)/[^/]*$", 1)
    stem = F.regexp_extract(decoded, r"/([^/]+)\.jsonl$", 1)
    unescaped = F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))  # Spark escapes folder names itself
    return F.when(folder != "", unescaped).when(stem != "", stem)


def store_exists(spark: SparkSession, path: str) -> bool:
    place, fs = hadoop(spark, path)
    return fs.exists(place(path))


def _folders(now: State, path: str, kind: str) -> list[str]:
    """Where the state's lines of a kind lie."""
    return [path if b == FOUND else f"{batch_path(path, b)}/kind={kind}" for b in now.holding(kind)
            if b != FOUND or kind == "records" or not now.version or not any("records" in k for c, k in now.kinds.items() if c != FOUND)]


def _files(spark: SparkSession, path: str, kind: str, read, columns: list[Column], now: State | None = None) -> DataFrame:
    """``(run_name, batch, file_path, *columns)`` of the committed files of a kind."""
    now = now or commits.state(spark, path)
    folders = _folders(now, path.rstrip("/"), kind)
    # Folders are searched for files: reading them as partitions would turn a run called 007 into 7.
    if folders:
        rows = read.option("recursiveFileLookup", "true").load(folders)
    else:
        rows = spark.createDataFrame([], "value string, length long").withColumn("_metadata", F.struct(F.lit("").alias("file_path")))
    uri = F.col("_metadata.file_path")
    named = rows.select(run_of(uri).alias("run_name"), batch_of(uri).alias("batch"), uri.alias("file_path"), *columns)
    return named.where(F.col("run_name").isNotNull() & commits.visible(now, F.col("run_name"), F.col("batch")))


def _lines(spark: SparkSession, path: str, kind: str, now: State | None = None) -> DataFrame:
    return _files(spark, path, kind, spark.read.format("text"), [F.col("value")], now)


def read_record_lines(spark: SparkSession, path: str, now: State | None = None) -> DataFrame:
    """A10: every stored line with its run, batch and file, in either layout."""
    return _lines(spark, path, "records", now).select("run_name", "value", "batch", "file_path")


def read_quarantine(spark: SparkSession, path: str, now: State | None = None) -> DataFrame:
    """``(run_name, value)``: lines that rewrites could not parse."""
    return _lines(spark, path, "quarantine", now).select("run_name", "value")


def read_failures(spark: SparkSession, path: str) -> DataFrame:
    """``(run_name, batch, error)``: models that could not be loaded, as tasks reported them."""
    return _lines(spark, path, "failures").select("run_name", "batch", F.get_json_object("value", "$.error").alias("error"))


def read_records(spark: SparkSession, path: str, now: State | None = None) -> DataFrame:
    """The stored records, parsed, with the ``batch`` that holds them."""
    return parsed_records(recover_records(read_record_lines(spark, path, now).drop("file_path")))


def recover_records(lines: DataFrame) -> DataFrame:
    """Strip leading NULs, drop blank lines, parse.

    Fields are cast leniently; fields that the schema lacks are kept as a JSON
    object in ``extra_fields``. Lines that are no JSON object are kept with
    their text in ``_corrupt_record`` (quarantine) instead of ending the job.
    """
    keep = [c for c in lines.columns if c != "value"]
    # Most lines begin with their object's brace, and no pattern needs to look at them.
    sound = F.col("value").startswith("{")
    repaired = lines.select(*keep, F.when(sound, F.col("value")).otherwise(F.regexp_replace("value", r"^\x{0}+", "")).alias("_line"))
    sound = F.col("_line").startswith("{")
    repaired = repaired.where(sound | ~F.col("_line").rlike(f"^[{WHITESPACE_CLASS}]*$"))
    is_object = sound | F.col("_line").rlike(rf"^[{WHITESPACE_CLASS}]*\{{")
    # Through a one-row ``inline``: a predicate on what was parsed stays above it, and a line is parsed once.
    parsed = repaired.select(*keep, F.inline(F.array(F.struct(
        "_line", is_object.alias("_object"),
        F.from_json(F.when(is_object, F.col("_line")), _LENIENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("_r")))))
    good = F.col("_object") & F.col(f"_r.{CORRUPT}").isNull() & F.col("_r").isNotNull()
    known = F.array(*[F.lit(n) for n, _ in RECORD_FIELDS])
    others = F.map_filter(F.from_json(F.when(good, F.col("_line")), "map<string,variant>"), lambda k, v: ~F.array_contains(known, k))
    return parsed.select(
        *keep, *[F.col(f"_r.{n}").try_cast(t).alias(n) for n, t in RECORD_FIELDS],
        F.when(F.size(others) > 0, F.to_json(others)).alias(EXTRA),
        F.when(~good, F.col("_line")).alias(CORRUPT))


def quarantined(recovered: DataFrame) -> DataFrame:
    return recovered.where(F.col(CORRUPT).isNotNull())


def parsed_records(recovered: DataFrame) -> DataFrame:
    return recovered.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def rewrite_store(path: str, records: DataFrame, quarantine: DataFrame, summary, read: State) -> int:
    """New records, quarantined lines and summaries in place of the state
    that was ``read``, in one commit; returns its number.

    ``records`` and ``quarantine`` (``run_name, value``) may still read that
    state. ``summary`` builds the summaries from the written records, so that
    what was computed for the records is not computed again. Records that were
    appended meanwhile stay; if a run was replaced meanwhile, this fails.
    """
    spark = records.sparkSession
    batch = write_batch(records, path)
    folder = batch_path(path, batch)
    _write_lines(quarantine.select("run_name", "value").repartition("run_name"), f"{folder}/kind=quarantine")
    own = State(1, {batch: 1}, {batch: ["records", "quarantine"]})
    write_summary_lines(summary(read_records(spark, path, own).drop("batch"), read_quarantine(spark, path, own)), folder)
    return commit(spark, path, "rewrite", batch, drop=read.batches, read=read)


SUMMARY_FIELDS = (
    "rows bigint, scored_rows bigint, error_rows bigint, quarantined bigint, word_errors bigint, reference_words bigint, char_errors bigint, "
    "reference_chars bigint, whisper_word_errors bigint, whisper_reference_words bigint, whisper_char_errors bigint, "
    "whisper_reference_chars bigint, mean_wer double, mean_cer double, mean_whisper_wer double, mean_whisper_cer double")


def read_summaries(spark: SparkSession, path: str, now: State | None = None) -> DataFrame:
    """A9 read back: one row per run, from a summary folder or a rescored store."""
    return _lines(spark, path, "summaries", now).select("run_name", F.from_json("value", SUMMARY_FIELDS).alias("s")).select("run_name", "s.*")


def _listed(spark: SparkSession, path: str, kind: str, now: State | None = None) -> DataFrame:
    return _files(spark, path, kind, spark.read.format("binaryFile"), [F.col("length")], now)


def stored_runs(spark: SparkSession, path: str) -> DataFrame:
    """the runs in a store with their files, in path order; lists files, reads none."""
    files = _listed(spark, path, "records")
    # Batches are folders of their own: within them, files are ordered by their run's folder.
    inner = F.when(F.col("batch") != "", F.regexp_extract("file_path", r"/kind=[^/]+/(.*)$", 1)).otherwise(F.col("file_path"))
    return (files.groupBy("run_name").agg(F.min(F.struct(inner.alias("p"), "file_path")).alias("first"), F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
            .orderBy("first.p").select("run_name", F.col("first.file_path").alias("first_file"), "files", "bytes"))


def finished_runs(spark: SparkSession, path: str) -> DataFrame:
    """F2's done marker: ``name`` of each run with a stored summary; lists files, reads none."""
    return _listed(spark, path, "summaries").select(F.col("run_name").alias("name")).distinct()
