"""Corpus-level summaries per run.

Counters and integer sums are plain ``count``/``sum`` aggregates, so Spark
runs them as a partial (map-side) aggregate followed by a small final one:
only one row per run and partition crosses the shuffle, however hot a run
is. Rates are micro-averages: sum(errors) / sum(reference length) * 100,
NULL when the denominator is 0 (the reference omits the key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.metrics import rate
from scorelake.operators.score import COUNT_COLUMNS, is_error, is_scored

SUMMARY_RATES = {
    "mean_wer": ("word_errors", "reference_words"),
    "mean_cer": ("char_errors", "reference_chars"),
    "mean_whisper_wer": ("whisper_word_errors", "whisper_reference_words"),
    "mean_whisper_cer": ("whisper_char_errors", "whisper_reference_chars"),
}


def summary_aggregates(scored: Column | None = None) -> list[Column]:
    """E1 + E2 as aggregate expressions (usable in batch and streaming).

    ``scored`` says which rows count as scored (default: both primary rates present)."""
    scored = is_scored() if scored is None else scored
    return [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(scored).alias("scored_rows"),
        F.count_if(is_error()).alias("error_rows"),
        *[F.sum(F.when(scored, F.col(c))).alias(c) for c in COUNT_COLUMNS],
    ]


def with_summary_rates(sums: DataFrame) -> DataFrame:
    """E3 + E4 over a frame of per-group sums."""
    return sums.select(
        "*", *[rate(num, den).alias(name) for name, (num, den) in SUMMARY_RATES.items()]
    )


def summarize(records: DataFrame, by: tuple[str, ...] = ("run_name",), include_counts: bool = True,
              scored: Column | None = None) -> DataFrame:
    """One row per group: rows, scored_rows, error_rows, mean_* (and the sums)."""
    out = with_summary_rates(records.groupBy(*by).agg(*summary_aggregates(scored)))
    if not include_counts:
        out = out.drop(*COUNT_COLUMNS)
    return out
