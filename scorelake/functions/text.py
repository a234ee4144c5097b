"""Transcript normalisation as native Spark column expressions.

Everything here is a JVM-side ``regexp_replace`` / ``translate`` / ``lower``
chain. Unicode composition (NFC, NFKC) has no Spark built-in; it calls the
ICU4J normaliser that ships with Spark (see :mod:`scorelake.functions.jvm`),
or, where that is unavailable, one Arrow-batched pandas UDF. Either way the
argument is gated to NULL for text that is already normalised, so only the
rare rows that need composition pay for it.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.functions import jvm

# Fixed values. Python's ``\s`` (``str.isspace``) as an explicit class, so
# java.util.regex and RE2 (the DuckDB oracle) match exactly the same code
# points: TAB..CR, FS..SPACE, NEL, NBSP, OGHAM SPACE, EN QUAD..HAIR SPACE,
# LINE SEPARATOR, PARAGRAPH SEPARATOR, NNBSP, MMSP, IDEOGRAPHIC SPACE.
WHITESPACE_CLASS = (
    r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# The same code points as a class that the JVM matches quickly: single Latin-1
# characters are looked up in one table, and one comparison rules out most others.
_WHITESPACE = (
    r"[\t\n\x{b}\f\r\x{1c}\x{1d}\x{1e}\x{1f}\x{20}\x{85}\x{a0}[\x{1680}-\x{3000}&&"
    r"[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]"
)
# Non-spoken ASR control tokens such as <tr-TR>; a token that
# contains whitespace is not a control token.
CONTROL_TOKEN = rf"<[^<>{WHITESPACE_CLASS}]+>"
# LATIN SMALL LETTER I + COMBINING DOT ABOVE -> i.
DECOMPOSED_DOTTED_I = "i\u0307"
# Turkish casing before the ordinary lowercase.
TURKISH_UPPER = "Iİ"
TURKISH_LOWER = "ıi"
# The primary normaliser drops punctuation and symbols.
PUNCT_OR_SYMBOL = r"[\p{P}\p{S}]"
# The Whisper basic normaliser's patterns.
WHISPER_BRACKETED = r"[<\[][^>\]]*[>\]]"
WHISPER_PARENTHESISED = r"\(([^)]+?)\)"
WHISPER_MARK_SYMBOL_PUNCT = r"[\p{M}\p{S}\p{P}]"
# That or whitespace, with the commonest letters ruled out by a table first.
_MARK_SYMBOL_PUNCT_OR_SPACE = rf"[[^abcdefghijklmnopqrstuvwxyz]&&[{WHISPER_MARK_SYMBOL_PUNCT}{_WHITESPACE}]]"

# Text made only of code points below U+0300 is already NFC (no combining
# marks, no composable pair of starters in that block).
_NEEDS_NFC = r"[^\x{0}-\x{2ff}]"


def _class_of_ranges(codepoints: list[int]) -> str:
    parts, start, prev = [], None, None
    for cp in codepoints + [None]:
        if start is not None and (cp is None or cp != prev + 1):
            parts.append(f"\\x{{{start:x}}}" if start == prev else f"\\x{{{start:x}}}-\\x{{{prev:x}}}")
            start = None
        if cp is not None and start is None:
            start = cp
        prev = cp
    return "".join(parts)


def _nfkc_gate() -> str:
    # Rule-built: below U+0300, the code points NFKC leaves unchanged. Any
    # other code point sends the text through the NFKC UDF.
    stable = [cp for cp in range(0x300) if unicodedata.normalize("NFKC", chr(cp)) == chr(cp)]
    return f"[^{_class_of_ranges(stable)}]"


_NEEDS_NFKC = _nfkc_gate()


def _normalizer(form: str):
    @F.pandas_udf(T.StringType())
    def _udf(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else unicodedata.normalize(form, t))

    return _udf


_nfc_udf = _normalizer("NFC")
_nfkc_udf = _normalizer("NFKC")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _python_fallback(udf, c: Column) -> Column:
    """The pandas UDF path: executors must be able to import this package."""
    from pyspark.sql import SparkSession

    from scorelake.session import ship_package

    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship_package(spark)
    return udf(c)


def nfc(c: Column | str) -> Column:
    """Canonical composition; only rows with code points >= U+0300 are touched."""
    c = _col(c)
    needs = c.rlike(_NEEDS_NFC)
    composed = jvm.compose(c, False, needs) if jvm.available() else _python_fallback(_nfc_udf, F.when(needs, c))
    return F.coalesce(composed, c)


def nfkc(c: Column | str) -> Column:
    """Compatibility composition.

    On the JVM path ICU's own quick check is cheaper than any regex gate (the
    set of NFKC-stable code points is a long class), so every row goes to
    ICU; only the Python fallback is gated.
    """
    c = _col(c)
    if jvm.available():
        return jvm.compose(c, True)
    return F.coalesce(_python_fallback(_nfkc_udf, F.when(c.rlike(_NEEDS_NFKC), c)), c)


def remove_control_tokens(c: Column | str) -> Column:
    """Each ``<token>`` without whitespace becomes one space."""
    return F.regexp_replace(_col(c), CONTROL_TOKEN, " ")


def repair_dotted_i(c: Column | str) -> Column:
    """``i`` + U+0307 -> ``i`` (before any lowercasing)."""
    return F.replace(_col(c), F.lit(DECOMPOSED_DOTTED_I), F.lit("i"))


def clean_transcript_artifacts(c: Column | str) -> Column:
    """C4 = C1, C2, C3. Does not trim or collapse whitespace."""
    return repair_dotted_i(remove_control_tokens(nfc(c)))


def root_lower(c: Column | str) -> Column:
    """Lowercase of every locale but the Turkic ones: ``I`` -> ``i`` and ``İ`` -> ``i``
    + U+0307 are spelled out, because the JVM's own lowercase follows its locale there."""
    return F.lower(F.replace(F.replace(_col(c), F.lit("I"), F.lit("i")), F.lit("İ"), F.lit(DECOMPOSED_DOTTED_I)))


def turkish_lower(c: Column | str) -> Column:
    """``I`` -> ``ı``, ``İ`` -> ``i``, then the ordinary lowercase."""
    c = _col(c)
    for upper, lower in zip(TURKISH_UPPER, TURKISH_LOWER):
        c = F.replace(c, F.lit(upper), F.lit(lower))
    return F.lower(c)


def drop_punctuation_and_symbols(c: Column | str) -> Column:
    """Remove every character of category P* or S*; marks stay."""
    return F.regexp_replace(_col(c), PUNCT_OR_SYMBOL, "")


def collapse_whitespace(c: Column | str) -> Column:
    """Runs of (Python) whitespace -> one space, then strip."""
    return F.trim(F.regexp_replace(_col(c), f"{_WHITESPACE}+", " "))


def normalize_cleaned(clean: Column | str) -> Column:
    """C5..C7 over text that already went through C4."""
    return collapse_whitespace(drop_punctuation_and_symbols(turkish_lower(clean)))


def normalize_text(c: Column | str) -> Column:
    """The primary scoring normaliser."""
    return normalize_cleaned(clean_transcript_artifacts(c))


def whisper_prepare(clean: Column | str) -> Column:
    """C9, first half: lowercase, delete bracketed then parenthesised spans."""
    s = F.regexp_replace(root_lower(clean), WHISPER_BRACKETED, "")
    return F.regexp_replace(s, WHISPER_PARENTHESISED, "")


def whisper_finish(composed: Column | str) -> Column:
    """C9, second half (after NFKC): marks/symbols/punctuation -> space,
    lowercase, collapse whitespace, strip. Both replacements are one pass, and no
    letter is whitespace in either case, so the lowercase comes last."""
    return root_lower(F.trim(F.regexp_replace(_col(composed), f"{_MARK_SYMBOL_PUNCT_OR_SPACE}+", " ")))


def whisper_normalize_cleaned(clean: Column | str) -> Column:
    """C9 over text that already went through C4.

    Whisper's multilingual basic normaliser: lowercase, delete bracketed and
    parenthesised spans, NFKC, every mark/symbol/punctuation -> space,
    lowercase again, collapse whitespace; then strip. (Batch jobs should
    materialise :func:`whisper_prepare` as a column before :func:`nfkc`, as
    :func:`scorelake.operators.score.score_records` does, so the regex chain
    is evaluated once.)
    """
    return whisper_finish(nfkc(whisper_prepare(clean)))


def normalize_text_whisper(c: Column | str) -> Column:
    """The auxiliary (Whisper) normaliser."""
    return whisper_normalize_cleaned(clean_transcript_artifacts(c))


def words(normalized: Column | str) -> Column:
    """Words of normalised text (single spaces, stripped); '' -> []."""
    n = _col(normalized)
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.split(n, " "))


def word_count(normalized: Column | str) -> Column:
    """How many :func:`words` there are, without making them."""
    n = _col(normalized)
    return F.when(n == "", F.lit(0)).otherwise(F.octet_length(n) - F.octet_length(F.replace(n, F.lit(" "), F.lit(""))) + 1)
