"""Per-record scoring with the four-rates-or-none error rule.

One pass per record: both normalisations of both sides, then four integer
distances and four lengths. Row rates and every later summary are derived
from those integers, so no text is aligned twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions import long_pairs, metrics, text
from scorelake.session import ship_package

# The error text a scoring failure leaves on an empty reference.
EMPTY_REFERENCE_ERROR = "ValueError: one or more references are empty strings"

COUNT_COLUMNS = (
    "word_errors",
    "reference_words",
    "char_errors",
    "reference_chars",
    "whisper_word_errors",
    "whisper_reference_words",
    "whisper_char_errors",
    "whisper_reference_chars",
)
RATE_COLUMNS = ("wer", "cer", "whisper_wer", "whisper_cer")
# Distances that score_records can compute, in the order of RATE_COLUMNS.
METRICS = ("word", "char", "whisper_word", "whisper_char")
# Characters of one side times those of the other from which on a pair is normalised and aligned with others of its batch.
LONG_PAIR = 1_000


def is_scored() -> Column:
    """Both rates present."""
    return F.col("wer").isNotNull() & F.col("cer").isNotNull()


def is_error() -> Column:
    """An error was recorded."""
    return F.col("error").isNotNull()


def is_rescorable() -> Column:
    """Reference and prediction present and no error."""
    return F.col("reference").isNotNull() & F.col("prediction").isNotNull() & F.col("error").isNull()


def score_records(records: DataFrame, empty_reference: str = "error", metrics_wanted: tuple[str, ...] = METRICS) -> DataFrame:
    """Add the eight count columns and the four rates to a records table.

    ``records`` needs ``reference``, ``prediction`` and ``error`` (string,
    nullable). Rows that are not rescorable keep their error and get NULL
    counts and rates. ``empty_reference``: ``'error'`` (a reference that
    normalises to nothing under either normaliser turns the row into an
    error row) or ``'convention'`` (0 if the hypothesis is empty too, else
    100).

    ``metrics_wanted`` names the distances to compute; the counts and rates of
    the others are NULL, and their alignments are not in the plan. Pairs of more
    than a few words (``LONG_PAIR``) go to :mod:`scorelake.functions.long_pairs`
    as they are, to be normalised and aligned in Arrow batches with the others'
    places empty; both ways give the same numbers.
    """
    if empty_reference not in ("error", "convention"):
        raise ValueError("empty_reference must be 'error' or 'convention'")
    if not set(metrics_wanted) <= set(METRICS):
        raise ValueError(f"metrics_wanted must be among {', '.join(METRICS)}")
    words = {"word": "word" in metrics_wanted, "whisper_word": "whisper_word" in metrics_wanted}
    out_cols = [c for c in records.columns if c not in COUNT_COLUMNS + RATE_COLUMNS]
    live = is_rescorable()

    # Stage 1: long pairs as a whole; C4 once per side of the others, kept in its own projection.
    ship_package(records.sparkSession)
    kinds = [k for k in METRICS if k in metrics_wanted]
    is_long = live & (F.char_length("reference").cast("long") * F.char_length("prediction") >= LONG_PAIR)
    stage = records.select(*out_cols, live.alias("_live"), F.coalesce(is_long, F.lit(False)).alias("_long"))
    stage = stage.select("*", long_pairs.pair_scores(*[F.when(F.col("_long"), F.col(side)) for side in ("reference", "prediction")], kinds).alias("_found"))
    short = F.col("_live") & ~F.col("_long")
    stage = stage.select(
        *out_cols, "_live", "_long", "_found",
        F.when(short, text.clean_transcript_artifacts("reference")).alias("_ref_clean"),
        F.when(short, text.clean_transcript_artifacts("prediction")).alias("_hyp_clean"),
    )
    # Stage 2: the primary normalisation and the Whisper normaliser's first
    # half; then NFKC; then its second half. Each intermediate string is its
    # own column, so no regex chain is evaluated twice.
    kept = (*out_cols, "_live", "_long", "_found")
    stage = stage.select(
        *kept,
        text.normalize_cleaned("_ref_clean").alias("_ref"),
        text.normalize_cleaned("_hyp_clean").alias("_hyp"),
        text.whisper_prepare("_ref_clean").alias("_wref"),
        text.whisper_prepare("_hyp_clean").alias("_whyp"),
    )
    stage = stage.select(*kept, "_ref", "_hyp",
                         text.nfkc("_wref").alias("_wref"), text.nfkc("_whyp").alias("_whyp"))
    stage = stage.select(*kept, "_ref", "_hyp",
                         text.whisper_finish("_wref").alias("_wref"), text.whisper_finish("_whyp").alias("_whyp"))
    # Stage 3: words and characters of all, then the short pairs' tokens and word vocabulary.
    named = {"_ref": "reference", "_hyp": "prediction", "_wref": "whisper_reference", "_whyp": "whisper_prediction"}
    counted = [F.when(F.col("_long"), F.col(f"_found.{name}_{unit}")).otherwise(own(side)).cast("long").alias(f"{side}_{unit[0]}")
               for side, name in named.items() for unit, own in (("words", text.word_count), ("chars", F.char_length))]
    stage = stage.select("*", *counted)
    word_sides = {"word": ("_ref", "_hyp"), "whisper_word": ("_wref", "_whyp")}
    vocabularies = {"word": "_voc", "whisper_word": "_wvoc"}
    asked = [k for k in word_sides if k in kinds]
    stage = stage.select("*", *[text.words(side).alias(f"{side}_words") for k in asked for side in word_sides[k]])
    stage = stage.select("*", *[metrics.pair_vocabulary(*[f"{side}_words" for side in word_sides[k]]).alias(vocabularies[k]) for k in asked])
    stage = stage.select("*", *[metrics.word_codes(f"{side}_words", vocabularies[k]).alias(f"{side}_code") for k in asked for side in word_sides[k]])
    present = F.col("_live")
    empty_ref = (F.col("_ref_c") == 0) | (F.col("_wref_c") == 0)
    valid = present
    if empty_reference == "error":
        valid = valid & ~empty_ref

    def distance(kind: str, ref: str, hyp: str) -> Column:
        if kind not in kinds:
            return F.lit(None).cast("bigint")
        own = metrics.coded_word_distance(f"{ref}_code", f"{hyp}_code", vocabularies[kind]) if kind in word_sides else metrics.char_edit_distance(ref, hyp)
        return F.when(F.col("_long"), F.col(f"_found.{kind}")).when(F.col(ref) == F.col(hyp), F.lit(0).cast("bigint")).otherwise(own.cast("bigint"))

    # Primary distances first, in their own projection. Where the Whisper
    # normaliser gives the same two strings (common: both drop punctuation),
    # its distances are the same numbers and the alignment is not redone.
    stage = stage.select(F.when(valid, distance("word", "_ref", "_hyp")).alias("_we"), F.when(valid, distance("char", "_ref", "_hyp")).alias("_ce"), "*")
    mirror = (F.col("_wref") == F.col("_ref")) & (F.col("_whyp") == F.col("_hyp"))
    wwe, wce = distance("whisper_word", "_wref", "_whyp"), distance("whisper_char", "_wref", "_whyp")
    if {"word", "whisper_word"} <= set(metrics_wanted):
        wwe = F.when(mirror, F.col("_we")).otherwise(wwe)
    if {"char", "whisper_char"} <= set(metrics_wanted):
        wce = F.when(mirror, F.col("_ce")).otherwise(wce)
    lengths = {"reference_words": F.col("_ref_w"), "reference_chars": F.col("_ref_c"),
               "whisper_reference_words": F.col("_wref_w"), "whisper_reference_chars": F.col("_wref_c")}
    wanted = {"reference_words": "word", "reference_chars": "char", "whisper_reference_words": "whisper_word", "whisper_reference_chars": "whisper_char"}
    counts = {
        "word_errors": F.col("_we"), "char_errors": F.col("_ce"), "whisper_word_errors": wwe, "whisper_char_errors": wce,
        **{name: expr if wanted[name] in metrics_wanted else F.lit(None).cast("bigint") for name, expr in lengths.items()},
    }
    # Stage 4: integers (all four distances or none). They leave through a
    # one-row ``inline`` (a Generate): predicates on its output columns are
    # not pushed below it, so a later ``where(wer IS NOT NULL)`` cannot
    # inline and re-run the normalisation UDFs and distances in a Filter.
    outcome = F.struct(
        F.when(present & empty_ref & F.lit(empty_reference == "error"), F.lit(EMPTY_REFERENCE_ERROR))
        .otherwise(F.col("error")).alias("error"),
        "_hyp_w", "_hyp_c", "_whyp_w", "_whyp_c",
        *[F.when(valid, counts[name]).alias(name) for name in COUNT_COLUMNS],
    )
    stage = stage.select(
        *[c for c in out_cols if c != "error"], F.inline(F.array(outcome))
    )
    if empty_reference == "error":
        rates = {
            "wer": metrics.rate("word_errors", "reference_words"),
            "cer": metrics.rate("char_errors", "reference_chars"),
            "whisper_wer": metrics.rate("whisper_word_errors", "whisper_reference_words"),
            "whisper_cer": metrics.rate("whisper_char_errors", "whisper_reference_chars"),
        }
    else:
        rates = {
            "wer": metrics.convention_rate("word_errors", "reference_words", "_hyp_w"),
            "cer": metrics.convention_rate("char_errors", "reference_chars", "_hyp_c"),
            "whisper_wer": metrics.convention_rate("whisper_word_errors", "whisper_reference_words", "_whyp_w"),
            "whisper_cer": metrics.convention_rate("whisper_char_errors", "whisper_reference_chars", "_whyp_c"),
        }
    errors = dict(zip(RATE_COLUMNS, ("word_errors", "char_errors", "whisper_word_errors", "whisper_char_errors")))
    return stage.select(
        *out_cols,
        *COUNT_COLUMNS,
        *[F.when(F.col(errors[name]).isNotNull(), expr).alias(name) for name, expr in rates.items()],
    )
