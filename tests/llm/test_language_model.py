"""Counts and base scores by brute force, the model by its definition."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from conftest import SF_SMALL
from scorelake.llm import language_model as lm
from scorelake.llm.queries import op13_language_model


def tokens(text):
    return [w.lower() if w.isascii() else w.translate(lm._LOWER) for w in (text or "").encode().split()] + [b""]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def slow_base(rows):
    counts = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    return [(i, held(i), len(own := tokens(text)), sum(counts[t] > 0 for t in own) if n else 0, n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own)) for i, text in rows]


def slow_score(text, vocabulary, counts, model):
    """Each token's probability from a full softmax over the units."""
    place = {w: i for i, w in enumerate(vocabulary.names)}
    unit_of = lambda t: int(vocabulary.units[place[t]]) if t in place else lm.ending(t)
    before, total = [lm.UNITS, lm.UNITS], 0.0
    for t in tokens(text):
        unit = unit_of(t)
        h = sum(model.context[u] * p for u, p in zip(before, model.places))
        s = (model.target @ h + model.bias).astype(np.float64)
        total += (s[unit] - s.max() - math.log(np.exp(s - s.max()).sum())) / math.log(10) + math.log10((counts.get(t, 0) + 1) / vocabulary.mass[unit])
        before = [unit, before[0]]
    return total


def close(a, b):
    return all(x == y if not isinstance(x, float) else math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6) for x, y in zip(a, b))


def check(df, rows, fitted):
    counts, shared, model = fitted
    every = {bytes(r["word"]): r["c"] for r in counts.collect()}
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    want = sorted(((*base, slow_score(text, shared.value, every, model) if every else 0.0) for base, (_, text) in zip(slow_base(rows), rows)), key=repr)
    assert len(got) == len(want)
    left = list(want)
    for row in got:  # rows of one id may differ in their last digits, hence in order
        at = next(i for i, w in enumerate(left) if w[:5] == row[:5] and close(row, w))
        left.pop(at)


@pytest.mark.parametrize("frequent", [lm.FREQUENT, 30])
def test_edge_docs(spark, edge_docs, monkeypatch, frequent):
    """Also with most words outside the table of frequent ones."""
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "PARCEL", 3000)
    docs = edge_docs.selectExpr("doc_id", "text", "n_words AS score", "hits AS word", "component_id AS row").repartition(3)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    fitted = lm.fit(docs)
    assert fitted[1].value.total == slow_base(rows)[0][4]
    check(lm.score(docs, fitted), rows, fitted)


def test_nothing_to_learn_from(spark, edge_docs, no_docs):
    assert lm.score(no_docs).collect() == []
    docs = edge_docs.where("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")
    fitted = lm.fit(docs)
    got = lm.score(docs, fitted).collect()
    assert len(got) == docs.count() > 0 and all(r["held_out"] and (r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (0, 0, 0.0, 0.0) for r in got)
    check(lm.score(docs.where("doc_id IS NULL"), fitted), [], fitted)


def test_whole_table_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: tuple(r) for r in op13_language_model(spark, SF_SMALL).collect()}
    assert len(got) == len(rows)
    for row in slow_base(rows):
        assert close(got[row[0]][:6], row)
    for out in (True, False):
        assert sum(r[6] for r in got.values() if r[1] == out) > sum(r[5] for r in got.values() if r[1] == out)


def small_model(seed=4):
    rng = np.random.default_rng(seed)
    noise = rng.random(lm.UNITS) + 0.01
    model = lm.Bilinear.start(noise / noise.sum())
    return model.filled(model.flat() + rng.normal(size=model.flat().size) * 0.3), noise / noise.sum()


def test_probabilities_add_up_to_one():
    """Over all seen tokens and one unseen per class, after any two units."""
    model, _ = small_model()
    parts, log_z = model.tables()
    for one, two in [(0, 0), (lm.UNITS, lm.UNITS), (5, 400), (400, 5)]:
        s = parts[0][one] + parts[1][two] + model.bias
        assert math.isclose(np.exp(s.astype(np.float64) - log_z[one, two]).sum(), 1, rel_tol=1e-5)
        h = model.context[one] * model.places[0] + model.context[two] * model.places[1]
        assert np.allclose(model.target @ h + model.bias, s, atol=1e-4)


def test_masses_cover_every_count(spark):
    """A unit's tokens share its whole mass, but for one unseen word of a class."""
    rows = [(i, " ".join(f"w{(i * j) % 700}" for j in range(60))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts, shared, _ = lm.fit(docs)
    v = shared.value
    sums = np.zeros(lm.UNITS)
    place = {w: i for i, w in enumerate(v.names)}
    for r in counts.collect():
        sums[v.units[place[bytes(r["word"])]]] += r["c"] + 1
    assert np.allclose(sums[1 + lm.OWN:] + 1, v.mass[1 + lm.OWN:]) and np.allclose(sums[:1 + lm.OWN], v.mass[:1 + lm.OWN])
    assert v.units[place[b""]] == 0 and len(set(v.units[v.units <= lm.OWN])) == 1 + lm.OWN


def test_gradients_are_those_of_the_contrast(monkeypatch):
    model, noise = small_model()
    trainer = lm.Trainer(model, noise, 1)
    rng = np.random.default_rng(9)
    unit, one, two = (rng.integers(0, lm.UNITS, 40) for _ in range(3))
    sample = rng.integers(0, lm.UNITS, lm.NOISE)
    sample[1] = sample[0]
    log_noise = np.log(noise * lm.NOISE)

    def value(m):
        c, t, b, p = (x.astype(np.float64) for x in m.parameters())
        h = c[one] * p[0] + c[two] * p[1]
        real = (h * t[unit]).sum(axis=1) + b[unit] - log_noise[unit]
        fake = h @ t[sample].T + b[sample] - log_noise[sample]
        return (-np.log1p(np.exp(-real)).sum() - np.log1p(np.exp(fake)).sum()) / len(unit)

    flat = np.concatenate([g.ravel() for g in trainer.gradients(unit, one, two, sample)])
    at = np.flatnonzero(flat)
    for i in rng.permutation(at)[:60]:
        step = np.zeros(len(flat))
        step[i] = 1e-2
        numeric = (value(model.filled(model.flat() + step)) - value(model.filled(model.flat() - step))) / 2e-2
        assert math.isclose(numeric, flat[i], rel_tol=2e-2, abs_tol=2e-5)


def test_training_learns_an_order():
    """Units that always follow each other become likely after each other."""
    noise = np.full(lm.UNITS, 1 / lm.UNITS)
    trainer = lm.Trainer(lm.Bilinear.start(noise), noise, 2)
    unit = np.tile(np.arange(1, 9), 4000)
    trainer.learn(unit, *lm.contexts(unit, np.array([len(unit)])))
    parts, log_z = trainer.model.tables()
    after = parts[0][3] + parts[1][2] + trainer.model.bias - log_z[3, 2]
    assert after.argmax() == 4
