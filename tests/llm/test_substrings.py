"""Substring dedup against all strings of the corpus, counted in a dictionary."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from conftest import SF_SMALL
from scorelake.llm import substring_dedup as S
from scorelake.llm.queries import op2_substrings


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + S.LENGTH] for d in data for i in range(len(d) - S.LENGTH + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - S.LENGTH + 1):
            if seen[d[i:i + S.LENGTH]] > 1:
                gone[i:i + S.LENGTH] = b"\1" * S.LENGTH
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def result(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()), key=repr)


def expected(rows):
    return sorted(((i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows]))), key=repr)


def test_edge_rows(edge_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert result(S.remove_repeats(edge_docs)) == expected(rows)


def test_hot_parts_are_counted_alike(edge_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert result(S.remove_repeats(edge_docs, hot=1)) == expected(rows)


def test_empty(no_docs):
    assert S.remove_repeats(no_docs).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed, monkeypatch):
    """Shared passages with edits, runs of one letter, short periods."""
    rng = random.Random(seed)
    letters = "ab" if seed == 1 else "abcdefgh \n"
    shared = ["".join(rng.choice(letters) for _ in range(rng.randint(150, 600))) for _ in range(6)]
    rows = []
    for i in range(60):
        text = ""
        for _ in range(rng.randint(0, 5)):
            kind = rng.random()
            part = rng.choice(shared)
            if kind < 0.5:
                at = rng.randrange(len(part))
                part = part[:at] + rng.choice(["", "X", "é"]) + part[at + rng.randint(0, 1):]
            elif kind < 0.7:
                part = "".join(rng.choice(letters) for _ in range(rng.randint(0, 300)))
            elif kind < 0.8:
                part = rng.choice(["a", "ab", "abc\0"]) * rng.randint(1, 250)
            text += part
        rows.append((i, text))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(S.remove_repeats(df)) == expected(rows)


@pytest.mark.parametrize("seed", range(3))
def test_periodic_stretches(spark, seed, monkeypatch):
    """Stretches of every phase and length, alone, cut off, and inside other text."""
    rng = random.Random(seed)
    rows = []
    for i in range(70):
        unit = rng.choice([" the", "a", "abcdefg", "0123456789abcdefghijklmnopqrstu"[:rng.choice([29, 31])], "x" * 20 + "y" * 20])
        stretch = (unit * 900)[rng.randrange(len(unit)):][:rng.choice([150, 199, 200, 201, 203, 208, 230, 263, 400, 900])]
        ends = ["", "q", "".join(rng.choice("uvwxyz") for _ in range(rng.randint(0, 300)))]
        rows.append((i, rng.choice(ends) + stretch + rng.choice(ends) + rng.choice(["", stretch[:rng.randint(0, 300)]])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(S.remove_repeats(df)) == expected(rows)
    for _, text in rows[::9]:  # a stretch alone: what the scan knows is right
        data = np.frombuffer((text * 4).encode(), np.uint8)
        for start, end in S.anchors(data)[2]:
            assert end - start >= S.LENGTH and all(data.tobytes().find(data[i:i + S.LENGTH].tobytes()) != i or data.tobytes().find(data[i:i + S.LENGTH].tobytes(), i + 1) > 0
                                                   for i in (start, end - S.LENGTH))


def test_a_long_stretch_has_few_anchors():
    for unit in ("a", " the", "abcdefghijk"):
        at, _, ranges = S.anchors(np.frombuffer(("head. " + unit * 5000 + " tail").encode(), np.uint8))
        assert len(at) < 60 and (ranges[:, 1] - ranges[:, 0]).max() > 4000


def test_levels_meet_each_other_in_small_batches(monkeypatch):
    """Three batches in one family find what one batch finds."""
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdef") for _ in range(500))
    sides = []
    for i in range(300):
        cut = rng.randint(0, 200)
        text = "".join(rng.choice("xyz") for _ in range(cut)) + passage[cut:] if i % 2 else passage[:500 - cut] + "".join(rng.choice("uvw") for _ in range(cut))
        data = text.encode()
        sides.append((data[:250][::-1][:S.BEFORE], data[250:250 + S.LENGTH]))
    gram = np.array([hash(r[:S.GRAM]) for _, r in sides])
    whole, parts = S.IndexFamily(), S.IndexFamily()
    whole.add(gram, *map(list, zip(*sides)))
    for i in range(0, 300, 70):
        parts.add(gram[i:i + 70], *map(list, zip(*sides[i:i + 70])))
    assert np.array_equal(whole.found, parts.found) and whole.found.any()
    assert len(parts.levels) < 5


def test_query_on_the_small_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert result(op2_substrings(spark, SF_SMALL)) == expected(rows)
