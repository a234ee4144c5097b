"""Evaluate one run, or all pending runs, end to end.

spec (A2) -> column check before any job (A4) -> source rows with their
index (A6) and optional limit (A7) -> run-constant columns (B1) ->
transcription with row-level errors (I1-I4) -> reference text (B6) ->
scoring (D5-D8) -> records sink (A8) and summary sink (A9).

Pending runs are worked off in units: some runs' files of the source, one
Spark job and one commit each, so that a killed job keeps every finished unit
(F2, H1). Within a unit each run scans the rows that it lacks with its own
model; audio goes from the scan to the transcriber and through no exchange.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.operators.inference import TRANSCRIBERS, Registry, transcribe_batch
from scorelake.operators.score import score_records
from scorelake.operators.summary import summarize, summary_aggregates, with_summary_rates
from scorelake.plans.matrix import OUTSIDE_RUN_NAME, PYTHON_RUN_TIME, pending_utterances
from scorelake.session import scratch_path
from scorelake.sources.catalog import DatasetSpec, language_hint, parse_dataset_spec
from scorelake.sources.commits import State, commit
from scorelake.sources.records import (
    SUM_FIELDS,
    finished_runs,
    read_failures,
    read_records,
    read_summaries,
    read_sums,
    runs_of_batch,
    runs_without_sums,
    write_batch,
    write_records,
    write_summaries,
    write_sums,
)
from scorelake.sources.tables import LIMIT_ERROR, first_n_rows
from scorelake.sources.utterances import FileUtterances, TableUtterances


# The error of a missing column.
MISSING_COLUMN = "{label} column '{column}' was not found. Available columns: {names}"


def check_columns(df: DataFrame, spec: DatasetSpec) -> None:
    """A4: fail on the driver, before any job, if a needed column is missing."""
    names = df.columns
    if not names:
        return
    for label, col in (("Audio", spec.audio_column), ("Reference", spec.reference_column)):
        if col not in names:
            raise ValueError(MISSING_COLUMN.format(label=label, column=col, names=", ".join(names)))


def with_run_columns(df: DataFrame, engine: str, model: str, spec: DatasetSpec, run_name: str) -> DataFrame:
    """B1: the eight run-constant record columns (plus ``run_name``)."""
    return df.select(
        F.lit(run_name).alias("run_name"),
        F.lit(engine).alias("engine"), F.lit(model).alias("model"),
        F.lit(spec.name).alias("dataset"), F.lit(spec.hf_name).alias("hf_dataset"),
        F.lit(spec.config).alias("dataset_config"), F.lit(spec.split).alias("split"),
        F.lit(spec.audio_column).alias("audio_column"), F.lit(spec.reference_column).alias("reference_column"),
        "*",
    )


# The error of a row whose reference is missing.
MISSING_REFERENCE = "ValueError: the reference is missing"


def with_reference(df: DataFrame, reference: str) -> DataFrame:
    """``reference`` as text. Where it is missing, the row becomes an error
    row with its prediction, instead of being scored against the word ``None``."""
    text = F.col(reference).cast("string")
    return df.select(
        *[c for c in df.columns if c not in (reference, "error")],
        F.when(F.col("error").isNull(), text).alias("reference"),
        F.coalesce("error", F.when(text.isNull(), F.lit(MISSING_REFERENCE))).alias("error"))


RUN_RECORD = ("run_name", "engine", "model", "dataset", "hf_dataset", "dataset_config", "split", "audio_column",
              "reference_column", "row_index", "prediction", "reference", "error", "elapsed_seconds")


def run_name_now(engine: str, model: str, spec: DatasetSpec) -> str:
    """A13 for one run on the driver, no job: same rule as :func:`make_run_name`."""
    stamp = datetime.now(timezone.utc).strftime(PYTHON_RUN_TIME)
    return re.sub(OUTSIDE_RUN_NAME, "-", "-".join((engine, model, spec.name, spec.split, stamp))).strip("-")


def evaluate_run(source: DataFrame, engine: str, model: str, dataset: str, output_root: str, name: str | None = None,
                 limit: int | None = None, options: dict[str, str] | None = None,
                 empty_reference: str = "error") -> tuple[DataFrame, DataFrame]:
    """Records and summary of one run over ``source`` (which must carry a
    ``row_index`` column, e.g. from :func:`scorelake.sources.tables.with_row_index`).

    The records go to ``<output_root>/records``, the summary, made from the
    written records (inference runs once), to ``<output_root>/summaries``; both
    are read back.
    """
    if limit is not None and limit < 1:
        raise ValueError(LIMIT_ERROR)
    spec = parse_dataset_spec(dataset)
    check_columns(source, spec)
    name = name or run_name_now(engine, model, spec)
    rows = first_n_rows(source, limit).select(
        "row_index", F.col(spec.audio_column).alias("_audio"), F.col(spec.reference_column).alias("_reference"))
    hint = language_hint(F.lit(engine), F.lit(model))
    out = with_reference(transcribe_batch(rows, engine, model, audio_col="_audio", options=options, language=hint), "_reference")
    records = score_records(with_run_columns(out, engine, model, spec, name).select(*RUN_RECORD), empty_reference=empty_reference)
    write_records(records, f"{output_root.rstrip('/')}/records")
    return _stored(source.sparkSession, output_root, [name])


def _stored(spark: SparkSession, output_root: str, names: list[str]) -> tuple[DataFrame, DataFrame]:
    root = output_root.rstrip("/")
    stored = read_records(spark, f"{root}/records").drop("batch").where(F.col("run_name").isin(names))
    write_summaries(summarize(stored), f"{root}/summaries")
    return stored, read_summaries(spark, f"{root}/summaries").where(F.col("run_name").isin(names))


# ---- all pending runs ------------------------------------------------------------

# Rows of a unit: enough to keep a cluster busy for minutes, few enough to do again.
ROWS_PER_UNIT = 1_000_000
# Runs of one unit (branches of one plan).
RUNS_PER_UNIT = 32


@dataclass(frozen=True)
class Run:
    """A job of the matrix; there are as many as models times datasets."""

    name: str
    dataset: str
    engine: str
    model: str
    options: tuple[tuple[str, str], ...]
    limit: int | None


def planned_runs(jobs: DataFrame, limit: int | None = None) -> list[Run]:
    """The jobs in their order, with what their arguments say: ``--limit`` bounds
    the rows, any other argument becomes an option of the transcriber."""
    order = [c for c in ("ordinal", "dataset", "model_ordinal", "name") if c in jobs.columns]
    out = []
    for job in jobs.orderBy(*order).collect():
        given = dict(job["options"] or {}) if "options" in jobs.columns else {}
        words = list(job["extra_args"] or []) if "extra_args" in jobs.columns else []
        own = dict(zip(words[::2], words[1::2]))
        limits = [int(x) for x in (own.pop("--limit", None), limit) if x is not None]
        if any(x < 1 for x in limits):
            raise ValueError(LIMIT_ERROR)
        given.update({k.lstrip("-").replace("-", "_"): v for k, v in own.items()})
        out.append(Run(job["name"], job["dataset"], job["engine"], job["model"], tuple(sorted(given.items())), min(limits, default=None)))
    return out


def units(pending: list[tuple[Run, int, int]], rows_per_unit: int, one_run: bool) -> Iterator[list[tuple[Run, list[int]]]]:
    """Deal ``(run, part, rows)``, in order, to units of about ``rows_per_unit``
    rows (with ``one_run``, of one run)."""
    unit: dict[Run, list[int]] = {}
    size = 0
    for run, part, rows in pending:
        if unit and (size + rows > rows_per_unit or (run not in unit and (one_run or len(unit) == RUNS_PER_UNIT))):
            yield list(unit.items())
            unit, size = {}, 0
        unit.setdefault(run, []).append(part)
        size += rows
    if unit:
        yield list(unit.items())


def unit_records(unit: list[tuple[Run, list[int]]], source, done: DataFrame, registry: Registry, empty_reference: str = "error") -> DataFrame:
    """Scored records of a unit, and rows with a ``run_failure`` for models that do not load.

    Every run is a branch of its own: a scan of its parts, minus the rows that
    it has (``done``; no more than a unit's, hence broadcast), to the
    transcriber. No row, and so no audio, is shuffled or copied.
    """
    branches = []
    for run, parts in unit:
        spec = source.spec(run.dataset)
        wanted = F.col("row_index") < run.limit if run.limit is not None else F.lit(True)
        had = done.where((F.col("run_name") == run.name) & F.col("part").isin(parts)).select("row_index")
        constants = {"run_name": run.name, "engine": run.engine, "model": run.model, "dataset": spec.name, "hf_dataset": spec.hf_name, "dataset_config": spec.config,
                     "split": spec.split, "audio_column": spec.audio_column, "reference_column": spec.reference_column}
        options = F.create_map(*[F.lit(x) for pair in run.options for x in pair]).cast("map<string,string>")
        branches.append(source.rows(run.dataset, parts).where(wanted).join(F.broadcast(had), "row_index", "left_anti").select(
            *[F.lit(v).cast("string").alias(k) for k, v in constants.items()], "row_index", "_audio", "_reference", options.alias("_run_options")))
    # A task's rows come from one branch, so it loads one model.
    heard = transcribe_batch(reduce(DataFrame.unionByName, branches), F.col("engine"), F.col("model"), audio_col="_audio", options=F.col("_run_options"),
                             language=language_hint(F.col("engine"), F.col("model")), registry=registry, many_models=False, load_failures="run_failure")
    return score_records(with_reference(heard, "_reference").select(*RUN_RECORD, "run_failure"), empty_reference=empty_reference)


def run_pending(jobs: DataFrame, utterances: DataFrame | FileUtterances | TableUtterances, output_root: str, registry: Registry = TRANSCRIBERS,
                reference_col: str = "transcription", force: bool = False, limit: int | None = None, stop_on_error: bool = False,
                rows_per_unit: int = ROWS_PER_UNIT, most_units: int | None = None, empty_reference: str = "error") -> tuple[DataFrame, DataFrame]:
    """F1 -> F2 -> I3 -> D8 -> A8 -> A9: every utterance that a run of ``jobs`` has not stored yet.

    ``utterances`` are file scans by dataset (:class:`FileUtterances`) or a table
    ``(dataset, row_index, audio, <reference_col>)``. A run with a stored summary
    is finished and skipped. Of the others, stored records are the resume mark:
    only what is missing, or failed, is transcribed again, in units that each
    commit alone (``info['unit']`` in the store's ledger). With ``force`` all
    runs start over, and a run's first unit replaces what it had. Jobs may carry
    ``options`` and ``extra_args``; ``limit`` bounds each run to the first rows.

    A model that does not load fails its run only: later units leave that run
    out, it gets no summary, and :func:`run_failures` reports it. With
    ``stop_on_error`` units hold one run, in job order, and the first failed run
    ends the work. ``most_units`` ends it early, to be gone on with by another call.

    Returns the settled records and the summaries of all runs in the store.
    """
    spark = jobs.sparkSession
    root = output_root.rstrip("/")
    source = TableUtterances(utterances, reference_col=reference_col) if isinstance(utterances, DataFrame) else utterances
    if isinstance(source, FileUtterances):
        for name, scan in source.scans.items():
            check_columns(scan, source.spec(name))
    runs = planned_runs(jobs, limit)
    finished = set() if force else {r["name"] for r in finished_runs(spark, f"{root}/summaries").collect()}
    runs = [r for r in runs if r.name not in finished]
    pending, stored = pending_parts(spark, runs, source, f"{root}/records", force)
    done, failed_before = stored.where("NOT failed"), stored.where("failed")
    failed: set[str] = set()
    begun: set[str] = set()
    unfinished = {run.name for run, *_ in pending}
    rows_left = Counter(run.name for run, *_ in pending)
    for number, unit in enumerate(units(pending, rows_per_unit, stop_on_error)):
        if (stop_on_error and failed) or number == most_units:
            break
        unit = [(run, parts) for run, parts in unit if run.name not in failed]
        if not unit:
            continue
        batch = write_batch(unit_records(unit, source, done, registry, empty_reference), f"{root}/records")
        if runs_of_batch(spark, f"{root}/records", batch):  # not only failures
            write_sums(added_sums(spark, f"{root}/records", batch, unit, failed_before), f"{root}/records", batch)
        names = {run.name for run, _ in unit}
        fresh = names - begun if force else set()
        commit(spark, f"{root}/records", "replace" if fresh else "append", batch, hide=fresh, info={"unit": str(number), "runs": ",".join(sorted(names))})
        begun |= names
        failed |= set(runs_of_batch(spark, f"{root}/records", batch, "failures"))
        for run, parts in unit:
            rows_left[run.name] -= len(parts)
        unfinished = {name for name, n in rows_left.items() if n > 0} | failed
    ended = [r.name for r in runs if r.name not in unfinished]
    final = settled(read_records(spark, f"{root}/records"))
    if ended:
        whole = runs_without_sums(spark, f"{root}/records")
        sums = with_summary_rates(read_sums(spark, f"{root}/records").where(F.col("run_name").isin(sorted(set(ended) - whole))))
        old = sorted(set(ended) & whole)  # batches that other writers added: their runs' records are gone over
        write_summaries(sums.unionByName(summarize(final.where(F.col("run_name").isin(old)))) if old else sums, f"{root}/summaries")
    return final, read_summaries(spark, f"{root}/summaries")


def added_sums(spark: SparkSession, path: str, batch: str, unit: list[tuple[Run, list[int]]], failed_before: DataFrame) -> DataFrame:
    """What a unit's batch adds to its runs' sums: its records, less the failed
    rows that they take the place of. Only the batch itself is read."""
    own = State(1, {batch: 1}, {batch: ["records"]})
    new = read_records(spark, path, own).groupBy("run_name").agg(*summary_aggregates())
    mine = [(F.col("run_name") == run.name) & F.col("part").isin(parts) for run, parts in unit]
    gone = failed_before.where(reduce(lambda a, b: a | b, mine)).groupBy("run_name").agg(F.count("*").alias("gone"))
    both = new.join(F.broadcast(gone), "run_name", "left")
    less = F.coalesce("gone", F.lit(0))
    return both.select("run_name", *[(F.col(c) - less if c in ("rows", "error_rows") else F.coalesce(c, F.lit(0))).alias(c) for c in SUM_FIELDS])


def pending_parts(spark: SparkSession, runs: list[Run], source, path: str, force: bool) -> tuple[list[tuple[Run, int, int]], DataFrame]:
    """``(run, part, rows)`` with rows still to transcribe, in job order, and what
    the runs have: ``(run_name, part, row_index, failed)`` of stored rows, as a
    table of its own, which units read their part of. A row is ``failed`` if all
    its records have an error.

    Only keys are read. The list has an entry for each run and part of the
    source that has work left.
    """
    nothing = spark.createDataFrame([], "run_name string, part long, row_index long, failed boolean")
    keys = source.keys({r.dataset for r in runs})
    if not runs or keys is None:
        return [], nothing
    table = spark.createDataFrame([(i, r.name, r.dataset, r.limit) for i, r in enumerate(runs)], "place int, name string, dataset string, most long")
    known = nothing
    if not force:
        where = scratch_path(spark, "stored-keys")
        stored = read_records(spark, path).where(F.col("run_name").isin([r.name for r in runs])).groupBy("run_name", "row_index").agg(F.every(F.col("error").isNotNull()).alias("failed"))
        of_run = stored.join(F.broadcast(table.select(F.col("name").alias("run_name"), "dataset")), "run_name")
        of_run.join(keys, ["dataset", "row_index"]).select("run_name", F.col("part").cast("long").alias("part"), "row_index", "failed").write.parquet(where)
        known = spark.read.schema(nothing.schema).parquet(where)
    work = pending_utterances(table, keys, known.where("NOT failed").select("run_name", "row_index", F.lit(None).cast("string").alias("error")))
    counts = work.where(F.col("most").isNull() | (F.col("row_index") < F.col("most"))).groupBy("place", "part").agg(F.count("*").alias("n"), F.min("row_index").alias("first"))
    return [(runs[r["place"]], r["part"], r["n"]) for r in counts.orderBy("place", "first").collect()], known


def settled(records: DataFrame) -> DataFrame:
    """One record per run and utterance: of those without an error, if there are
    any, the one that was stored last."""
    fields = [c for c in records.columns if c not in ("run_name", "row_index", "batch")]
    best = F.max_by(F.struct(*fields), F.struct(F.col("error").isNull(), "batch", "prediction"))
    return records.groupBy("run_name", "row_index").agg(best.alias("r")).select("run_name", "row_index", "r.*")


def run_failures(spark: SparkSession, output_root: str) -> DataFrame:
    """``(run_name, error)`` of runs whose model did not load and that have not
    been finished since; of several messages the first in order."""
    root = output_root.rstrip("/")
    finished = finished_runs(spark, f"{root}/summaries").withColumnRenamed("name", "run_name")
    failures = read_failures(spark, f"{root}/records").groupBy("run_name").agg(F.min("error").alias("error"))
    return failures.join(finished, "run_name", "left_anti")
