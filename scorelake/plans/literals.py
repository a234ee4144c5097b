"""Edge-case rows appended to table-driven queries.

The driver's text tables hold no Turkish, no decomposed or compatibility
characters and no Unicode spaces, so these rows carry those cases. They are always unioned
with whole table scans, never used alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Edge-case texts (id, text). Ids are negative so they never
# collide with table keys.
EDGE_TEXTS = (
    (-1, "i\u0307stanbul <tr-TR>"),
    (-2, "  İSTANBUL, IĞDIR!\n"),
    (-3, "İstanbul, güzel!"),
    (-4, "Merhaba, Dünya!"),
    (-5, "I\u0307STANBUL ve Iğdır"),
    (-6, "cafe\u0301 <unk> <not a token> a-b"),
    (-7, "bir\u00a0iki\u2028üç\u3000dört\u2003beş\x1fon"),
    (-8, "(parantez içi) [köşeli] <etiket> kalır"),
    (-9, ""),
    (-10, "ŞEKER ĞÜÇÖ ıi İI"),
    (-11, "merhaba dunya"),
    (-12, "...!?"),
    (-13, "oﬃce ﬁn ² x³ ① ＡＢＣ１２ ㎏ ½ ﾊﾝ"),
)

# Edge-case scoring records (id, reference, prediction).
EDGE_PAIRS = (
    (-1, "merhaba dunya", "merhaba"),
    (-2, "İstanbul, güzel!", "istanbul güzel"),
    (-3, "istanbul", "i\u0307stanbul <tr-TR>"),
    (-4, "Merhaba, Dünya!", "merhaba dünya"),
    (-5, "bir", "yanlış"),
    (-6, "iki üç dört beş altı yedi sekiz dokuz on", "iki üç dört beş altı yedi sekiz dokuz on"),
    (-7, "...!?", "bir şey"),
    (-8, "(sadece parantez)", "sadece parantez"),
    (-9, "ŞEKER ĞÜÇÖ", ""),
    (-10, "bir iki üç", "bir iki üç"),
)

TEXT_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])
PAIR_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("reference", T.StringType()),
    T.StructField("prediction", T.StringType()),
])


def edge_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EDGE_TEXTS), TEXT_SCHEMA)


def edge_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EDGE_PAIRS), PAIR_SCHEMA)


def sql_string(s: str) -> str:
    """A DuckDB expression for ``s``: quoted runs, control/space/mark code points via chr()."""
    import unicodedata

    parts, run = [], []
    for ch in s:
        cat = unicodedata.category(ch)
        if ch != " " and (cat[0] in "CZM"):
            if run:
                parts.append("'" + "".join(run).replace("'", "''") + "'")
                run = []
            parts.append(f"chr({ord(ch)})")
        else:
            run.append(ch)
    if run or not parts:
        parts.append("'" + "".join(run).replace("'", "''") + "'")
    return " || ".join(parts)


def values_sql(rows, columns: tuple[str, ...]) -> str:
    """``(VALUES ...) AS t(columns)`` for rows of ints/strings."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, int):
            return f"CAST({v} AS BIGINT)"
        return sql_string(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS t({', '.join(columns)})"
