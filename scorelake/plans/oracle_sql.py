"""DuckDB SQL that recomputes each registered query independently.

Used only as the correctness oracle: the driver runs these strings against
the same parquet tables (registered as views) and compares results with the
Spark queries. The SQL deliberately shares nothing with the Spark plans:
word distance is a plain dynamic program (anti-diagonals in a recursive
CTE), character distance is DuckDB's own ``levenshtein``.
"""

from __future__ import annotations

# Python's whitespace set in RE2 syntax (RE2's \s is ASCII).
WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# DuckDB's levenshtein counts bytes, so every non-ASCII letter
# that can survive normalisation is folded one-to-one onto ASCII punctuation
# (normalised text has none left).
FOLD_FROM = "ßäçèéêíñóöüığşâîû"
FOLD_TO = "!#$%&()*+,-./:;<="
# NFKC of the compatibility characters that the oracle's inputs
# hold, in lower case (DuckDB has no such function).
NFKC = (("ﬃ", "ffi"), ("ﬁ", "fi"), ("²", "2"), ("³", "3"), ("①", "1"), ("ａ", "a"), ("ｂ", "b"), ("ｃ", "c"), ("１", "1"), ("２", "2"),
        ("㎏", "kg"), ("½", "1⁄2"), ("ﾊ", "ハ"), ("ﾝ", "ン"))
BIG = 1000000000


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean_sql(x: str) -> str:
    """C4: NFC, control tokens -> space, i + U+0307 -> i."""
    return (
        f"replace(regexp_replace(nfc_normalize({x}), {q('<[^<>' + WS + ']+>')}, ' ', 'g'), "
        f"'i' || chr(775), 'i')"
    )


def normalize_cleaned_sql(c: str) -> str:
    s = f"lower(translate({c}, 'Iİ', 'ıi'))"
    s = f"regexp_replace({s}, {q(r'[\p{P}\p{S}]')}, '', 'g')"
    return f"trim(regexp_replace({s}, {q('[' + WS + ']+')}, ' ', 'g'))"


def normalize_sql(x: str) -> str:
    return normalize_cleaned_sql(clean_sql(x))


def whisper_cleaned_sql(c: str) -> str:
    # DuckDB lowers İ to i; Python/Java give i + U+0307, so spell that out first.
    s = f"lower(replace({c}, 'İ', 'i' || chr(775)))"
    s = f"regexp_replace({s}, {q(r'[<\[][^>\]]*[>\]]')}, '', 'g')"
    s = f"regexp_replace({s}, {q(r'\(([^)]+?)\)')}, '', 'g')"
    for before, after in NFKC:
        s = f"replace({s}, {q(before)}, {q(after)})"
    s = f"lower(regexp_replace({s}, {q(r'[\p{M}\p{S}\p{P}]')}, ' ', 'g'))"
    return f"trim(regexp_replace({s}, {q('[' + WS + ']+')}, ' ', 'g'))"


def whisper_sql(x: str) -> str:
    return whisper_cleaned_sql(clean_sql(x))


def words_sql(n: str) -> str:
    return f"(CASE WHEN {n} = '' THEN []::VARCHAR[] ELSE string_split({n}, ' ') END)"


def fold_sql(n: str) -> str:
    return f"translate({n}, {q(FOLD_FROM)}, {q(FOLD_TO)})"


def char_distance_sql(a: str, b: str) -> str:
    return f"levenshtein({fold_sql(a)}, {fold_sql(b)})"


def word_distance_cte(source: str, key: str, r: str, h: str, name: str = "wd") -> str:
    """CTEs computing ``{name}(k, dist)`` for word lists ``r``, ``h`` of ``source``.

    Anti-diagonal dynamic program: diagonal d holds D[i][d-i] at list index
    i+1; each recursion step builds one diagonal from the previous two.
    """
    return f"""
{name}_in AS (SELECT {key} AS k, {r} AS r, {h} AS h, len({r}) AS n, len({h}) AS m FROM {source}),
{name}_dp(k, d, p2, p1) AS (
  SELECT k, 1,
         list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 THEN 0 ELSE {BIG} END),
         list_transform(range(0, n + 1), lambda i: CASE WHEN i <= 1 THEN 1 ELSE {BIG} END)
  FROM {name}_in WHERE n > 0 AND m > 0
  UNION ALL
  SELECT s.k, s.d + 1, s.p1,
         list_transform(range(0, t.n + 1), lambda i:
           CASE WHEN s.d + 1 - i < 0 OR s.d + 1 - i > t.m THEN {BIG}
                WHEN i = 0 OR s.d + 1 - i = 0 THEN s.d + 1
                ELSE least(s.p1[i] + 1, s.p1[i + 1] + 1,
                           s.p2[i] + CASE WHEN t.r[i] = t.h[s.d + 1 - i] THEN 0 ELSE 1 END)
           END)
  FROM {name}_dp s JOIN {name}_in t ON s.k = t.k
  WHERE s.d < t.n + t.m
),
{name} AS (
  SELECT t.k, CASE WHEN t.n = 0 THEN t.m WHEN t.m = 0 THEN t.n ELSE s.p1[t.n + 1] END AS dist
  FROM {name}_in t LEFT JOIN {name}_dp s ON s.k = t.k AND s.d = t.n + t.m
)"""
