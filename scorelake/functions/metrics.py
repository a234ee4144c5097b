"""Edit distances and error rates as native Spark expressions.

Character distance counts code points. Text without supplementary code
points goes to the bundled commons-lang3 dynamic program (UTF-16 units equal
code points there, and it is ~3x faster); anything else to the built-in
``levenshtein``. Word distance has no built-in: each distinct word of one
(reference, hypothesis) pair is mapped to one code point, both word lists
become strings of those code points, and the same character distance runs
on them. The vocabulary is per pair, so nothing global is built or
shuffled, and the mapping is exact (distinct words <-> distinct code points).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelake.functions import jvm

# Word ids become code points 0x100 + id while they stay below the surrogate
# block (U+D800): up to 55,039 distinct words per pair stay in the BMP; larger
# vocabularies use the supplementary planes (up to 1,048,575 words; pairs of that
# many words are long ones, which are not coded).
_WORD_CODE_BASE = 0x100
_BMP_WORD_LIMIT = 0xD800 - _WORD_CODE_BASE - 1
_SUPPLEMENTARY_BASE = 0x10000
_HAS_SUPPLEMENTARY = r"[\x{10000}-\x{10ffff}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def encode_words(tokens: Column | str, vocabulary: Column, base: Column | int = _WORD_CODE_BASE) -> Column:
    """Word list -> string with one code point per word (``base`` + its id in ``vocabulary``)."""
    hex_ids = F.transform(
        _col(tokens),
        lambda w: F.lpad(F.hex(F.array_position(vocabulary, w) + base), 8, "0"),
    )
    return F.decode(F.unhex(F.array_join(hex_ids, "")), "UTF-32")


def pair_vocabulary(ref_tokens: Column | str, hyp_tokens: Column | str) -> Column:
    """Distinct words of one pair, in first-seen order."""
    return F.array_distinct(F.concat(_col(ref_tokens), _col(hyp_tokens)))


def word_codes(tokens: Column | str, vocabulary: Column | str) -> Column:
    """Tokens -> one code point per word; BMP codes while the vocabulary fits."""
    v = _col(vocabulary)
    if not jvm.available():
        return encode_words(tokens, v, _SUPPLEMENTARY_BASE)
    base = F.when(F.size(v) <= _BMP_WORD_LIMIT, F.lit(_WORD_CODE_BASE)).otherwise(F.lit(_SUPPLEMENTARY_BASE))
    return encode_words(tokens, v, base)


def coded_word_distance(ref_codes: Column | str, hyp_codes: Column | str, vocabulary: Column | str) -> Column:
    """Word distance from strings built by :func:`word_codes` (materialise
    them as columns first: each is then computed once)."""
    er, eh = _col(ref_codes), _col(hyp_codes)
    if not jvm.available():
        return F.levenshtein(er, eh)
    in_bmp = F.size(_col(vocabulary)) <= _BMP_WORD_LIMIT
    return F.when(in_bmp, jvm.utf16_levenshtein(er, eh)).otherwise(F.levenshtein(er, eh))


def word_edit_distance(ref_tokens: Column | str, hyp_tokens: Column | str, vocabulary: Column | str | None = None) -> Column:
    """Minimal substitutions + deletions + insertions over words.

    Pass ``vocabulary`` as a column computed in an earlier projection: an
    expression inside the ``transform`` lambda would be re-evaluated per word.
    """
    r, h = _col(ref_tokens), _col(hyp_tokens)
    v = pair_vocabulary(r, h) if vocabulary is None else _col(vocabulary)
    if not jvm.available():
        return F.levenshtein(encode_words(r, v, _SUPPLEMENTARY_BASE), encode_words(h, v, _SUPPLEMENTARY_BASE))
    in_bmp = F.size(v) <= _BMP_WORD_LIMIT
    base = F.when(in_bmp, F.lit(_WORD_CODE_BASE)).otherwise(F.lit(_SUPPLEMENTARY_BASE))
    er, eh = encode_words(r, v, base), encode_words(h, v, base)
    return F.when(in_bmp, jvm.utf16_levenshtein(er, eh)).otherwise(F.levenshtein(er, eh))


def char_edit_distance(ref: Column | str, hyp: Column | str) -> Column:
    """Minimal substitutions + deletions + insertions over code points."""
    a, b = _col(ref), _col(hyp)
    if not jvm.available():
        return F.levenshtein(a, b)
    bmp_only = ~(a.rlike(_HAS_SUPPLEMENTARY) | b.rlike(_HAS_SUPPLEMENTARY))
    return F.when(bmp_only, jvm.utf16_levenshtein(a, b)).otherwise(F.levenshtein(a, b))


def rate(errors: Column | str, reference_length: Column | str) -> Column:
    """Errors / reference length * 100 (divide, then multiply, as the reference)."""
    return F.try_divide(_col(errors), _col(reference_length)) * F.lit(100)


def convention_rate(errors: Column | str, reference_length: Column | str, hyp_length: Column | str) -> Column:
    """D7 convention for an empty reference: 0 if the hypothesis is empty too, else 100."""
    ref_len, hyp_len = _col(reference_length), _col(hyp_length)
    return (
        F.when(ref_len > 0, rate(errors, ref_len))
        .when(hyp_len == 0, F.lit(0.0))
        .otherwise(F.lit(100.0))
    )
