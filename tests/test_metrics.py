"""Edit distances and rates: reference expectations + brute-force DP properties."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorelake.functions import metrics, text
from scorelake.functions.long_pairs import distance
from scorelake.operators.score import EMPTY_REFERENCE_ERROR, score_records


def dp(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def score(spark, pairs):
    df = spark.createDataFrame(
        [(i, r, h, None) for i, (r, h) in enumerate(pairs)], "id int, reference string, prediction string, error string")
    return {r["id"]: r for r in score_records(df).collect()}


def test_reference_examples(spark):
    out = score(spark, [
        ("merhaba dunya", "merhaba"),
        ("İstanbul, güzel!", "istanbul güzel"),
        ("istanbul", "i\u0307stanbul <tr-TR>"),
        ("Merhaba, Dünya!", "merhaba dünya"),
        ("merhaba", "merhaba"),
    ])
    assert out[0]["wer"] == 50.0 and out[0]["cer"] > 0
    for i in (1, 2, 3, 4):
        assert (out[i]["wer"], out[i]["cer"]) == (0.0, 0.0)
    assert (out[3]["whisper_wer"], out[3]["whisper_cer"]) == (0.0, 0.0)
    assert out[4]["whisper_wer"] == 0 and out[4]["whisper_cer"] == 0


def test_empty_reference_is_error_row(spark):
    out = score(spark, [("...!?", "bir şey"), ("(sadece)", "sadece")])
    for r in out.values():
        assert r["error"] == EMPTY_REFERENCE_ERROR
        assert r["wer"] is None and r["cer"] is None and r["whisper_wer"] is None and r["word_errors"] is None


def test_empty_prediction_is_all_deletions(spark):
    out = score(spark, [("bir iki üç", "")])
    assert out[0]["wer"] == 100.0 and out[0]["word_errors"] == 3


words = st.lists(st.sampled_from(["a", "b", "c", "ç", "ğ", "x", "😀", "ab"]), max_size=25)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(words, words), min_size=1, max_size=8))
def test_word_and_char_distance_match_dp(spark, pairs):
    rows = [(" ".join(r), " ".join(h)) for r, h in pairs]
    df = spark.createDataFrame(rows, "r string, h string").select(
        "r", "h",
        metrics.word_edit_distance(text.words("r"), text.words("h")).alias("wd"),
        metrics.char_edit_distance("r", "h").alias("cd"),
    )
    for row in df.collect():
        assert row["wd"] == dp(row["r"].split(), row["h"].split())
        assert row["cd"] == dp(list(row["r"]), list(row["h"]))


def test_supplementary_word_codes_match_bmp_codes(spark):
    # Vocabularies above the BMP limit use supplementary code points and the
    # built-in levenshtein; both encodings give the same distances.
    rows = [("a b c d e", "a x c e f"), ("", "a"), ("a a a", "a")]
    df = spark.createDataFrame(rows, "r string, h string").select(
        text.words("r").alias("r"), text.words("h").alias("h"))
    df = df.select("r", "h", metrics.pair_vocabulary("r", "h").alias("v"))
    out = df.select(
        F.levenshtein(metrics.encode_words("r", F.col("v"), 0x10000),
                      metrics.encode_words("h", F.col("v"), 0x10000)).alias("supp"),
        metrics.word_edit_distance("r", "h", "v").alias("bmp"),
    ).collect()
    assert [(r["supp"], r["bmp"]) for r in out] == [(3, 3), (1, 1), (2, 2)]


def test_empty_reference_convention(spark):
    df = spark.createDataFrame(
        [(0, "...", "", None), (1, "!!", "bir", None), (2, "bir", "bir iki", None)],
        "id int, reference string, prediction string, error string")
    out = {r["id"]: r for r in score_records(df, empty_reference="convention").collect()}
    assert (out[0]["wer"], out[0]["cer"]) == (0.0, 0.0) and out[0]["error"] is None
    assert (out[1]["wer"], out[1]["cer"]) == (100.0, 100.0)
    assert out[2]["wer"] == 100.0


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=70), st.lists(st.sampled_from("abcde"), max_size=70))
def test_bit_parallel_distance_is_that_of_thedp(a, b):
    assert distance(a, b) == dp(a, b) == distance("".join(a), "".join(b))


def test_bit_parallel_distance_of_long_and_odd_sequences():
    import random

    rng = random.Random(5)
    for n in (63, 64, 65, 300):
        a = [rng.choice(["x", "yy", "zzz", str(rng.randrange(40))]) for _ in range(n)]
        b = [w for w in a if rng.random() < 0.8] + ["end"]
        rng.shuffle(b) if n == 300 else None
        assert distance(a, b) == dp(a, b)
    many = [f"w{i}" for i in range(1_200_000)]  # more words than there are code points
    other = many[:600_000] + ["new"] + many[600_001:-3]
    assert distance(many, other) == 4
    assert distance("a𝄞b" * 50, "ab" * 50) == 50 and distance("", "") == 0 and distance("abc", "") == 3


def test_long_and_short_pairs_give_the_same_records(spark, monkeypatch):
    from scorelake.operators import score

    rows = spark.createDataFrame([(i, r, h, e) for i, (r, h, e) in enumerate([
        ("bir iki üç dört", "bir üç dörd", None), ("I <x> İSTANBUL", "ı istanbul", None), ("aynı", "aynı", None), ("", "x", None), ("(a)", "b", None),
        (None, "x", None), ("a b", "", "E: x"), ("😀 a 𝄞 b", "a 𝄞𝄞", None), ("uzun " * 300, "kısa " * 280, None)])], "i int, reference string, prediction string, error string")
    want = [tuple(r) for r in score.score_records(rows).orderBy("i").collect()]
    monkeypatch.setattr(score, "LONG_PAIR", 0)
    assert [tuple(r) for r in score.score_records(rows).orderBy("i").collect()] == want
    monkeypatch.setattr(score, "LONG_PAIR", 10)
    assert [tuple(r) for r in score.score_records(rows).orderBy("i").collect()] == want


def noisy(rng, symbols, share, alphabet):
    out = []
    for x in symbols:
        kind = rng.random() / share if share else 9
        out += [] if kind < 0.3 else [rng.choice(alphabet)] if kind < 0.7 else [x, rng.choice(alphabet)] if kind < 1 else [x]
    return out


def test_pairs_of_a_batch_are_aligned_together(monkeypatch):
    """Any mixture of lengths, alphabets and errors: the distances are those of the program cell by cell."""
    import random

    from scorelake.functions import long_pairs

    rng = random.Random(11)
    many = [chr(0x4E00 + i) for i in range(300)] + ["😀", " ", " "]
    for alphabet in (list("ab "), list("abcdefghijkl  "), many):
        refs, hyps = [], []
        for n in (0, 1, 5, 63, 64, 65, 127, 128, 129, 190) * 3:
            ref = [rng.choice(alphabet) for _ in range(n)]
            refs.append("".join(ref))
            hyps.append("".join(noisy(rng, ref, rng.choice([0.05, 0.3, 0.9]), alphabet)))
        refs += ["a b", None, "", None, "same text"]
        hyps += [None, "a b", "a", None, "same text"]
        whole = [None if r is None or h is None else dp(r, h) for r, h in zip(refs, hyps)]
        parts = [None if r is None or h is None else dp(r.split(" "), h.split(" ")) for r, h in zip(refs, hyps)]
        parts = [dp([w for w in r.split(" ") if w], [w for w in h.split(" ") if w]) if d is not None else None for d, r, h in zip(parts, refs, hyps)]
        for name, value in (("GROUP_WORDS", 5), ("CHUNK_CHARS", 100), ("GROUPED", 100), ("TABLE_WORDS", 900)):
            assert long_pairs.text_distances(refs, hyps, False) == whole
            assert long_pairs.text_distances(refs, hyps, True) == parts
            monkeypatch.setattr(long_pairs, name, value)
        assert long_pairs.text_distances(refs, hyps, False) == whole
        monkeypatch.undo()


def test_long_alike_pairs_use_a_band_of_rows(monkeypatch):
    """A band that is too small is found out and widened; a good one is a small part of the rows."""
    import random

    from scorelake.functions import long_pairs

    rng = random.Random(12)
    letters = list("abcdef ")
    a = [rng.choice(letters) for _ in range(3000)]
    cases = [(a, noisy(rng, a, share, letters)) for share in (0.01, 0.2, 0.6)]
    cases += [(a, a[900:] + a[:900]), (a, a[:700] + a[2300:]), (a, [rng.choice(letters) for _ in range(1500)]), (a, ["x"] * 3000)]
    bounds = []
    banded = long_pairs._banded
    monkeypatch.setattr(long_pairs, "_banded", lambda *args: bounds.append(args[-1]) or banded(*args))
    for x, y in cases:
        assert distance(x, y) == distance(y, x) == dp(x, y)
        monkeypatch.setattr(long_pairs, "PROBE", 100)
        assert distance(x, y) == distance(y, x) == dp(x, y)
        monkeypatch.setattr(long_pairs, "PROBE", 1_500)
    bounds.clear()
    b = noisy(rng, a, 0.05, letters)
    assert distance(a, b) <= bounds[0] < 600 and len(bounds) == 1


def test_alike_pairs_share_a_group_by_their_band(monkeypatch):
    """Only the words that the band crosses count for a group; a cost that the band does not prove gets a wider one."""
    import random

    from scorelake.functions import long_pairs

    rng = random.Random(13)
    letters = list("abcdef ")
    groups = []
    aligned = long_pairs._aligned
    monkeypatch.setattr(long_pairs, "_aligned", lambda rows, *rest: groups.append(len(rows)) or aligned(rows, *rest))
    refs = ["".join(rng.choice(letters) for _ in range(1_900)) for _ in range(200)]
    hyps = [r[:500] + "xx" + r[520:1_400] + "y" + r[1_401:] for r in refs]
    hyps = ["q" + h + "q" for h in hyps]
    assert long_pairs.text_distances(refs, hyps, False) == [dp(r, h) if i < 2 else distance(r, h) for i, (r, h) in enumerate(zip(refs, hyps))]
    assert groups == [200]  # 30 words a pair, of which the band crosses two
    groups.clear()
    a = "".join(rng.choice(letters) for _ in range(600))
    turned = a[300:] + a[:300]
    assert long_pairs.text_distances([a, a], [turned, a[:580] + "x"], False) == [dp(a, turned), 20]
    assert groups == [2, 1]


def test_arrow_batches_taken_together_keep_their_rows(spark):
    import random

    rng = random.Random(14)
    pairs = []
    for i in range(120):
        ref = ["bir", *(rng.choice(["bir", "iki", "üç", "😀"]) for _ in range(rng.randrange(40)))]
        pairs.append((" ".join(ref), None if i % 9 == 4 else " ".join(noisy(rng, ref, 0.3, ["x", "iki"]))))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = score(spark, pairs)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    for i, (ref, hyp) in enumerate(pairs):
        want = (None, None) if hyp is None else (dp(ref.replace("😀", "").split(), hyp.replace("😀", "").split()), dp(" ".join(ref.replace("😀", "").split()), " ".join(hyp.replace("😀", "").split())))
        assert (out[i]["word_errors"], out[i]["char_errors"]) == want
