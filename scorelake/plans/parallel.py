"""Spreading CPU-heavy per-row work over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame

from scorelake.sources.tables import split_count

# Tasks per core for CPU-bound row work (edit distances are quadratic in
# text length, so more, smaller tasks even out long rows).
TASKS_PER_CORE = 4


def spread(df: DataFrame, tasks_per_core: int = TASKS_PER_CORE, even: bool = False) -> DataFrame:
    """Round-robin repartition when the scan has fewer splits than ``tasks_per_core`` for each core.

    A large input already arrives in many splits and is left as it is (no
    shuffle). A small file gives a single split; then an even spread across
    ``defaultParallelism * tasks_per_core`` tasks is far cheaper than running
    every quadratic distance in one task. ``even``: large inputs are dealt out as well,
    for work next to which a shuffle of the rows is little; a split may hold many
    rows or none, because it gets the row groups that begin in it. Round-robin repartition
    sorts locally first, so a retried task sees the same rows. The result's rows are
    the same either way, and nothing runs here.
    """
    tasks, splits = task_count(df, tasks_per_core), split_count(df)
    return df.repartition(tasks) if even or splits < tasks else df


def task_count(df: DataFrame, tasks_per_core: int = TASKS_PER_CORE) -> int:
    """Tasks that :func:`spread` deals rows out to: some for each core, or as many as there are splits."""
    return max(df.sparkSession.sparkContext.defaultParallelism * tasks_per_core, split_count(df))
