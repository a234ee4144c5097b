"""Bulk rescoring of stored runs in one job (E5).

Every stored run is read, repaired and rescored together, then grouped by
run. A row that is rescorable (reference and prediction present, no error)
gets fresh counts and rates; any other row keeps its stored fields. Lines that
cannot be parsed are carried along and counted, never dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.operators.score import COUNT_COLUMNS, RATE_COLUMNS, is_rescorable, score_records
from scorelake.operators.summary import summarize
from scorelake.plans.parallel import spread
from scorelake.sources.commits import state
from scorelake.sources.records import (
    CORRUPT,
    parsed_records,
    quarantined,
    read_quarantine,
    read_record_lines,
    read_records,
    read_summaries,
    recover_records,
    rewrite_store,
)


def rescore_records(records: DataFrame) -> DataFrame:
    """Fresh counts/rates for rescorable rows, stored values for the rest."""
    stored = records.select(
        "*", *[F.col(c).alias(f"_old_{c}") for c in COUNT_COLUMNS + RATE_COLUMNS if c in records.columns],
        is_rescorable().alias("_rescorable"),
    )
    scored = score_records(stored)
    keep = [c for c in records.columns if c not in COUNT_COLUMNS + RATE_COLUMNS]
    fresh = [
        F.when(F.col("_rescorable"), F.col(c)).otherwise(
            F.col(f"_old_{c}") if f"_old_{c}" in scored.columns else F.lit(None)).alias(c)
        for c in COUNT_COLUMNS + RATE_COLUMNS
    ]
    return scored.select(*keep, *fresh)


def summarize_rescored(records: DataFrame, quarantine: DataFrame) -> DataFrame:
    """One row per run: only rescorable rows count as scored (a kept row's old
    rates do not), and ``quarantined`` lines are counted."""
    lost = quarantine.groupBy("run_name").agg(F.count(F.lit(1)).alias("quarantined"))
    counts = ("rows", "scored_rows", "error_rows", "quarantined")
    return summarize(records, scored=is_rescorable()).join(lost, "run_name", "full_outer").fillna(0, list(counts))


def rescore_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored lines -> (rescored records, per-run summary). Both are lazy; to use
    both, rescore a store, which computes the records once."""
    recovered = recover_records(lines)
    records = rescore_records(parsed_records(recovered))
    return records, summarize_rescored(records, quarantined(recovered))


def rescore_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """E5 over a whole records store, on storage: records, quarantined lines and
    summaries take the place of what was read, in one commit, and are read back.
    A store of few files is spread over the cores: its files are as uneven as its runs."""
    now = state(spark, path)
    recovered = recover_records(spread(read_record_lines(spark, path, now)).drop("file_path", "batch"))
    bad = quarantined(recovered).select("run_name", F.col(CORRUPT).alias("value"))
    rewrite_store(path, rescore_records(parsed_records(recovered)), bad.unionByName(read_quarantine(spark, path, now)), summarize_rescored, now)
    return read_records(spark, path).drop("batch"), read_summaries(spark, path)
