"""Deterministic (run, utterance, reference, prediction) records from ``conversations``.

Stands in for model output so the whole scoring path can be checked
against an SQL oracle. The reference is the whole raw turn text; each run's
prediction is derived from the whole normalised word list:

* a word at 1-based position ``p`` is dropped when ``(p + conv_id) % drop_mod = 0``;
* a kept word with ``p % sub_mod = 0`` becomes ``x``;
* a turn with ``(conv_id * 31 + turn) % 17 = 3`` is a failed transcription:
  ``prediction = ''``, no reference, ``error = 'RuntimeError: decode failed'``.

Runs are a fixed three-row model table exploded onto every turn (no join).
``dataset`` is the turn's ``role`` read as the dataset spec ``<role>:test``,
and ``run_name`` follows the benchmark matrix's job-name rule, so stored
records, the run matrix and skip-if-done planning line up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.functions import text
from scorelake.plans.matrix import job_name
from scorelake.plans.parallel import spread
from scorelake.sources.tables import read_first_rows, read_table, table_path, with_row_index

# Fixed values: (engine, model, drop_mod, sub_mod) of the three synthetic runs.
PAIR_RUNS = (
    ("faster_whisper", "tiny", 7, 11),
    ("omnilingual", "omniASR_CTC_300M_v2", 5, 9),
    ("qwen3_asr_vllm", "Qwen/Qwen3-ASR-0.6B", 13, 17),
)
PAIR_SPLIT = "test"
DECODE_FAILURE = "RuntimeError: decode failed"


def _runs_array():
    return F.array(*[
        F.struct(F.lit(e).alias("engine"), F.lit(m).alias("model"),
                 F.lit(d).alias("drop_mod"), F.lit(s).alias("sub_mod"))
        for e, m, d, s in PAIR_RUNS
    ])


def conversation_pairs(spark: SparkSession, sf_dir: str, limit: int | None = None) -> DataFrame:
    """Records ``(run_name, engine, model, dataset, split, conv_id, turn, row_index,
    reference, prediction, error)``; with ``limit``, only the first source rows
    (applied right after the scan, before any text work)."""
    columns = ["conv_id", "turn", "role", "text"]
    if limit is not None:
        conv = read_first_rows(spark, table_path(sf_dir, "conversations"), limit, columns)
        return pairs_from(conv.repartition(spark.sparkContext.defaultParallelism))
    table = read_table(spark, sf_dir, "conversations").select(*columns)
    return pairs_from(spread(with_row_index(table), even=True))


def pairs_from(conv: DataFrame, place: tuple[str, ...] = ("row_index",)) -> DataFrame:
    """The pair records for turns ``(conv_id, turn, role, text, *place)``;
    batch or streaming."""
    base = conv.select("conv_id", "turn", "role", "text", *place,
                       text.normalize_text("text").alias("_norm"))
    base = base.select("conv_id", "turn", "role", "text", *place, text.words("_norm").alias("_words"))
    runs = base.select("*", F.explode(_runs_array()).alias("_run"))
    p = lambda i: i + 1  # noqa: E731  1-based word position
    hyp = F.array_join(
        F.transform(
            "_words",
            lambda w, i: F.when((p(i) + F.col("conv_id")) % F.col("_run.drop_mod") == 0, F.lit(None))
            .when(p(i) % F.col("_run.sub_mod") == 0, F.lit("x"))
            .otherwise(w),
        ),
        " ",
    )
    failed = (F.col("conv_id") * 31 + F.col("turn")) % 17 == 3
    spec = F.concat_ws(":", F.col("role"), F.lit(PAIR_SPLIT))
    return runs.select(
        job_name(F.col("_run.engine"), F.col("_run.model"), spec).alias("run_name"),
        F.col("_run.engine").alias("engine"),
        F.col("_run.model").alias("model"),
        F.col("role").alias("dataset"),
        F.lit(PAIR_SPLIT).alias("split"),
        "conv_id", "turn", *place,
        F.when(~failed, F.col("text")).alias("reference"),
        F.when(failed, F.lit("")).otherwise(hyp).alias("prediction"),
        F.when(failed, F.lit(DECODE_FAILURE)).alias("error"),
    )
