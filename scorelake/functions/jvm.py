"""Static JVM helpers that ship with Spark itself, called through ``reflect``.

* ICU4J (bundled since Spark 4 for collations): ``Normalizer.compose(String,
  boolean)`` gives NFC (``false``) and NFKC (``true``).
* commons-lang3: ``StringUtils.getLevenshteinDistance(CharSequence,
  CharSequence)``, a two-row dynamic program over UTF-16 code units that runs
  about 3x faster than the built-in ``levenshtein`` (measured: 1.2 s vs 3.6 s
  for 2.6e9 cells on 8 cores). Callers only use it for text without
  supplementary code points, where code units and code points coincide.

``reflect`` is marked non-deterministic by Spark (the functions themselves are
pure), so these expressions must be computed in a projection below any
aggregate. If a class is missing from a deployment, ``available()`` is false
and callers fall back to built-ins / a pandas UDF.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

ICU_NORMALIZER = "com.ibm.icu.text.Normalizer"
COMMONS_STRING_UTILS = "org.apache.commons.lang3.StringUtils"


@lru_cache(maxsize=None)
def _probe(app_id: str) -> bool:
    spark = SparkSession.getActiveSession()
    try:
        spark.range(1).select(
            F.call_function("reflect", F.lit(ICU_NORMALIZER), F.lit("compose"), F.lit("a"), F.lit(False)),
            F.call_function("reflect", F.lit(COMMONS_STRING_UTILS), F.lit("getLevenshteinDistance"),
                            F.lit("a"), F.lit("b")),
        ).schema
        return True
    except Exception:
        return False


def available() -> bool:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return False
    return _probe(spark.sparkContext.applicationId)


def compose(c: Column, compatibility: bool, when: Column | None = None) -> Column:
    """NFC (``compatibility=False``) or NFKC of ``c``; NULL where ``when`` is false.

    ``reflect`` hands NULL arguments to Java, so the call sits inside CASE.
    """
    guard = c.isNotNull() if when is None else (c.isNotNull() & when)
    return F.when(guard, F.call_function(
        "reflect", F.lit(ICU_NORMALIZER), F.lit("compose"), c, F.lit(compatibility)))


def utf16_levenshtein(a: Column, b: Column) -> Column:
    """Edit distance over UTF-16 code units (int); NULL if an input is NULL."""
    return F.when(a.isNotNull() & b.isNotNull(), F.call_function(
        "reflect", F.lit(COMMONS_STRING_UTILS), F.lit("getLevenshteinDistance"), a, b
    ).cast("int"))
