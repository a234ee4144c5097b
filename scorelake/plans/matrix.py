"""Run planning: job matrix, skip-if-done, resume work list, failures, model aliases.

(F1, F2, F4, F5, F6, A13, A14.) The model catalog is a fixed literal array
exploded onto each dataset row, so the matrix needs no join; other joins are
left to the optimiser, which knows the sizes at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.operators.score import is_error
from scorelake.sources.catalog import MATRIX_MODELS, OMNILINGUAL_MODELS, QWEN3_ASR_MODELS
from scorelake.sources.tables import LIMIT_ERROR


# What a run's name may hold, and the time in it (for Spark, for Python).
OUTSIDE_RUN_NAME = "[^A-Za-z0-9_.-]+"
RUN_TIME, PYTHON_RUN_TIME = "yyyyMMdd-HHmmss", "%Y%m%d-%H%M%S"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slug(value: Column | str) -> Column:
    """Drop ``https://`` / ``http://``, then ``/`` and ``:`` -> ``-``."""
    v = F.replace(_col(value), F.lit("https://"), F.lit(""))
    v = F.replace(v, F.lit("http://"), F.lit(""))
    return F.translate(v, "/:", "--")


def make_run_name(engine: Column | str, model: Column | str, dataset: Column | str,
                  split: Column | str, at: Column | str) -> Column:
    """``engine-model-dataset-split-yyyyMMdd-HHmmss`` with every run of
    characters outside ``[A-Za-z0-9_.-]`` -> ``-``, and ``-`` stripped at both ends."""
    raw = F.concat_ws("-", _col(engine), _col(model), _col(dataset), _col(split),
                      F.date_format(_col(at), RUN_TIME))
    return F.btrim(F.regexp_replace(raw, OUTSIDE_RUN_NAME, "-"), F.lit("-"))


def job_name(engine: Column | str, model: Column | str, dataset_spec: Column | str,
             limit: int | None = None) -> Column:
    """F1 name rule per backend (plus ``-limit-N`` when a limit is set). The names' parts."""
    engine, model = _col(engine), _col(model)
    ds = slug(dataset_spec)
    tail = F.substring_index(model, "/", -1)
    name = (
        F.when(engine == "omnilingual", F.concat_ws("-", model, ds))
        .when(engine == "faster_whisper", F.concat_ws("-", F.lit("faster_whisper"), model, ds))
        .when(engine == "qwen3_asr_vllm", F.concat_ws("-", tail, F.lit("vllm"), ds))
        .otherwise(F.concat_ws("-", tail, ds))
    )
    return F.concat(name, F.lit(f"-limit-{limit}")) if limit is not None else name


def job_args(engine: Column | str, limit: int | None, faster_device: str, faster_compute_type: str) -> Column:
    """F1 arguments per backend. Their names."""
    engine = _col(engine)
    limit_args = [F.lit("--limit"), F.lit(str(limit))] if limit is not None else []
    return (
        F.when(engine == "faster_whisper", F.array(
            F.lit("--device"), F.lit(faster_device), F.lit("--compute-type"), F.lit(faster_compute_type), *limit_args))
        .when(engine.startswith("qwen3_asr"), F.array(F.lit("--device"), F.lit("cuda"), *limit_args))
        .otherwise(F.array(*limit_args).cast("array<string>"))
    )


def _models_array(models=MATRIX_MODELS) -> Column:
    return F.array(*[
        F.struct(F.lit(e).alias("engine"), F.lit(m).alias("model"), F.lit(i).alias("model_ordinal"))
        for i, (e, m) in enumerate(models)
    ])


def run_matrix(datasets: DataFrame, spec_col: str = "dataset", limit: int | None = None,
               faster_device: str = "cuda", faster_compute_type: str = "float16",
               order_col: str | None = None) -> DataFrame:
    """one job per (dataset spec, catalog model), reference name rule and args."""
    if limit is not None and limit < 1:
        raise ValueError(LIMIT_ERROR)
    cols = [spec_col] + ([order_col] if order_col else [])
    jobs = datasets.select(*cols, F.inline(_models_array()))
    return jobs.select(
        F.col(spec_col).alias("dataset"),
        *([order_col] if order_col else []),
        "model_ordinal", "engine", "model",
        job_name("engine", "model", spec_col, limit).alias("name"),
        job_args("engine", limit, faster_device, faster_compute_type).alias("extra_args"),
    )


def pending_runs(matrix: DataFrame, completed_names: DataFrame, force: bool = False) -> DataFrame:
    """F2 at run grain: jobs without a completed summary (all jobs with ``force``)."""
    if force:
        return matrix
    return matrix.join(completed_names.select("name").distinct(), "name", "left_anti")


def pending_utterances(runs: DataFrame, utterances: DataFrame, stored: DataFrame,
                       retry_errors: bool = True) -> DataFrame:
    """F2 at row grain: (run, utterance) pairs still to transcribe.

    ``runs(name, dataset, ...)`` for each of ``utterances(dataset, row_index,
    ...)``, minus ``stored(run_name, row_index, error)`` already written. With
    ``retry_errors`` a stored error row is queued again. One row per utterance
    is joined, with the runs of its dataset and the runs that have it already
    as arrays; it becomes one row per pending run only afterwards.
    """
    keep = stored.where(~is_error()) if retry_errors else stored
    done = keep.groupBy("row_index").agg(F.collect_set("run_name").alias("_done"))
    fields = [c for c in runs.columns if c != "dataset"]
    per_dataset = runs.groupBy("dataset").agg(F.collect_list(F.struct(*fields)).alias("_runs"))
    work = utterances.join(per_dataset, "dataset").join(done, "row_index", "left")
    left = F.filter("_runs", lambda run: ~F.coalesce(F.array_contains("_done", run["name"]), F.lit(False)))
    return work.select(*utterances.columns, F.inline(left))


def failed_runs(records: DataFrame) -> DataFrame:
    """F4 from the records table: per run with errors, the count, the first
    failing row and its message (partial aggregates; no group is collected)."""
    errs = records.where(is_error())
    return errs.groupBy("run_name").agg(
        F.count(F.lit(1)).alias("error_rows"),
        F.min("row_index").alias("first_error_row"),
        F.min_by("error", "row_index").alias("first_error"),
    )


def first_failure(failures: DataFrame, order_col: str) -> DataFrame:
    """With ``--stop-on-error``: the failing job that comes first in job order."""
    return failures.agg(F.min_by(F.struct(*failures.columns), F.col(order_col)).alias("first")).select("first.*")


def resolve_models(requests: DataFrame, engine_col: str = "engine", model_col: str = "model") -> DataFrame:
    """exact name, alias or checkpoint URL; else a ``.pt`` path ending in a
    known checkpoint file name; else an error that lists the names.

    The names are fixed, so they are branches of one expression and nothing is
    joined. The first branch in catalog order wins. Engines without names of
    their own pass the model through unchanged.
    """
    engine, model = F.col(engine_col), F.col(model_col)
    omni, qwen = engine == "omnilingual", engine.isin("qwen3_asr_transformers", "qwen3_asr_vllm")
    cases = [(omni & model.isin(name, url), name) for name, url, *_ in OMNILINGUAL_MODELS]
    cases += [(qwen & model.isin(short, full), full) for short, full in QWEN3_ASR_MODELS]
    cases += [(omni & model.endswith(url.rsplit("/", 1)[-1]), name) for name, url, *_ in OMNILINGUAL_MODELS]
    resolved = F.when(~(omni | qwen), model)
    for condition, name in cases:
        resolved = resolved.when(condition, F.lit(name))

    def unknown(kind: str, names: list[str]) -> Column:
        return F.concat(F.lit(f"Unsupported {kind} model '"), model, F.lit(f"'. Supported models: {', '.join(names)}"))

    error = (F.when(omni & resolved.isNull(), unknown("omnilingual", [name for name, *_ in OMNILINGUAL_MODELS]))
             .when(qwen & resolved.isNull(), unknown("Qwen3-ASR", [short for short, _ in QWEN3_ASR_MODELS])))
    return requests.select("*", resolved.alias("resolved_model"), error.alias("resolution_error"))


def rank_runs(summary: DataFrame, by: str = "dataset", metric: str = "mean_wer") -> DataFrame:
    """Optional: rank runs within each dataset by a corpus rate (the summary
    has one row per run, so the window partitions are tiny)."""
    w = Window.partitionBy(by).orderBy(F.col(metric).asc_nulls_last())
    return summary.select("*", F.rank().over(w).alias("rank"))
