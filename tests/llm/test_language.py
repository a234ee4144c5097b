"""Language ID part by part: counts, IDF, the leader's weights and the temperature by plain loops; calibration on held-out rows."""

import math
import zlib

import numpy as np

from conftest import SF_SMALL
from scorelake.llm import language
from scorelake.llm.queries import op1_language


def slow_train(rows, n_labels):
    """Follow the regularised leader, one coordinate at a time, in plain Python."""
    z, n = {}, {}

    def weight(key):
        if abs(z.get(key, 0.0)) <= language.L1:
            return 0.0
        sign = 1.0 if z[key] > 0 else -1.0
        return -(z[key] - sign * language.L1) / ((language.BETA + math.sqrt(n[key])) / language.ALPHA + language.L2)

    for _ in range(language.EPOCHS):
        for label, at, values in rows:
            w = {(k, i): weight((k, i)) for k in range(n_labels) for i in at.tolist()}
            logits = [sum(w[k, i] * x for i, x in zip(at.tolist(), values.tolist())) for k in range(n_labels)]
            top = max(logits)
            e = [math.exp(x - top) for x in logits]
            for k in range(n_labels):
                for i, x in zip(at.tolist(), values.tolist()):
                    g = (e[k] / sum(e) - (k == label)) * x
                    before = n.get((k, i), 0.0)
                    n[k, i] = before + g * g
                    z[k, i] = z.get((k, i), 0.0) + g - (math.sqrt(n[k, i]) - math.sqrt(before)) / language.ALPHA * w[k, i]
    return {key: weight(key) for key in z}


def test_the_leader_is_followed_as_by_a_plain_loop():
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(30):
        at = np.sort(rng.choice(40, 6, replace=False)) * 977
        rows.append((int(rng.integers(0, 3)), at, rng.random(6).astype(np.float32)))
    weights, slow = language.train(rows, 3), slow_train(rows, 3)
    assert all(math.isclose(weights[key], w, rel_tol=1e-4, abs_tol=1e-5) for key, w in slow.items())
    assert np.count_nonzero(weights) == sum(w != 0 for w in slow.values())  # L1 leaves the others at zero
    assert any(w == 0 for w in slow.values()) or len(slow) == np.count_nonzero(weights)


def test_idf_counts_every_training_text(spark, edge_docs):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in edge_docs.collect()]
    learned = [t for i, t, lang in rows if t is not None and lang is not None and zlib.crc32(str("" if i is None else i).encode()) % 5]
    seen, total = np.zeros(1 << language.BITS), 0
    for text in learned:
        at, _ = language.ngram_counts(text)
        total += len(at) > 0
        for i in set(at.tolist()):
            seen[i] += 1
    want = [math.log((1 + total) / (1 + n)) + 1 for n in seen.tolist()]
    assert np.allclose(language.fit(edge_docs).idf, want)


def test_the_temperature_is_the_best_of_a_grid():
    rng = np.random.default_rng(3)
    for sharpness in (0.3, 1.0, 6.0):
        truth = rng.normal(size=(400, 4))
        labels = np.array([rng.choice(4, p=language.softmax(row)) for row in truth])
        logits = truth * sharpness  # too flat, right, too sharp

        def loss(t):
            return -sum(math.log(language.softmax(row / t)[k]) for row, k in zip(logits, labels)) / len(labels)

        grid = np.exp(np.linspace(math.log(0.05), math.log(20), 120))
        best = min(grid, key=loss)
        found = language.best_temperature(logits, labels)
        assert loss(found) <= loss(best) + 1e-6 and abs(math.log(found / best)) < 0.15
    assert language.best_temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_scores_are_calibrated_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = [(r["score"], r["lang_pred"] == labels[r["doc_id"]]) for r in op1_language(spark, SF_SMALL).collect() if r["held_out"] and labels[r["doc_id"]] and r["lang_pred"] != "und"]
    bins = {}
    for score, right in rows:
        bins.setdefault(min(9, int(score * 10)), []).append((score, right))
    error = sum(abs(sum(s for s, _ in b) - sum(r for _, r in b)) for b in bins.values()) / len(rows)
    assert error < 0.1 and sum(right for _, right in rows) / len(rows) > 0.9
