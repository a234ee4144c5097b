"""From raw documents to packed training windows, in five stages.

``STAGES`` are ``(name, function)``; a function takes ``(spark, docs, sf_dir)``
and works on all that the stage before it kept. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm import decontamination, language, packing, secrets, simhash
from scorelake.llm.common import documents, fresh, stored

#: Calibrated probability below which a document has no language that the model is sure enough of.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a predicted language go, and those whose prediction is
    less sure than ``LEAST_SCORE``.

    Null and empty texts, and texts without a letter, have no language; without
    any labelled document there is nothing to predict from, and all go. Repeated
    rows fare alike; ids and labels may be null; an empty table stays empty.
    """
    found = fresh(docs, "found_language")
    told = language.identify(docs, into=found)
    return told.where((F.col(f"{found}.lang_pred") != language.UNKNOWN) & (F.col(f"{found}.score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest id
    (null last), then of the smallest text hash.

    Null, empty and wordless texts are one group; of repeated rows one stays; an
    empty table stays empty.
    """
    return simhash.one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts hold none and stay; repeated rows fare alike; with an
    empty benchmark all stay; an empty table stays empty.
    """
    hits = fresh(docs, "benchmark_hits")
    found = decontamination.find(docs, documents(spark, sf_dir, "benchmark"), into=hits)
    return found.where(F.size(f"{hits}.spans") == 0).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by a mark, and
    ``n_chars``, if there is such a column, follows.

    Null texts stay null; repeated rows fare alike; an empty table stays empty.
    """
    clean = fresh(docs, "clean_text")
    told = docs.withColumn(clean, secrets.redacted(F.col("text")))
    columns = {"text": F.col(clean)}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col(clean).eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length(clean).cast("long"))
    return told.select(*(columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in training windows.

    Null and empty texts are an end id alone; repeated rows are packed each; an
    empty table gives no piece.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("secret_scan", secret_scan),
    ("packing", packed),
]

#: No stage but the counts of one can be written in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
