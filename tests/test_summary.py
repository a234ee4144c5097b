"""Corpus summaries: micro-average, undefined rates, counters."""

from scorelake.operators.score import score_records
from scorelake.operators.summary import summarize


def test_corpus_rate_is_micro_average(spark):
    df = spark.createDataFrame([
        ("r", "bir", "yanlış", None),
        ("r", "iki üç dört beş altı yedi sekiz dokuz on", "iki üç dört beş altı yedi sekiz dokuz on", None),
    ], "run_name string, reference string, prediction string, error string")
    out = summarize(score_records(df)).first()
    assert out["mean_wer"] == 10.0
    assert out["mean_whisper_wer"] is not None and out["mean_whisper_cer"] is not None
    assert (out["rows"], out["scored_rows"], out["error_rows"]) == (2, 2, 0)


def test_undefined_rates_are_null(spark):
    df = spark.createDataFrame([
        ("r", None, "", "RuntimeError: boom"),
        ("r", "...", "x", None),
    ], "run_name string, reference string, prediction string, error string")
    out = summarize(score_records(df)).first()
    assert (out["rows"], out["scored_rows"], out["error_rows"]) == (2, 0, 2)
    assert out["mean_wer"] is None and out["mean_cer"] is None
