"""Mined negatives against all scores in plain integers, and against SQL."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from scorelake.llm import hard_negatives as hn
from scorelake.llm.queries import ORACLES, op12_hard_negatives

NO_ID = float("inf")


def slow(rows, scale=256, n_positives=5, n_negatives=3, least=50, most=95):
    """``rows``: (id, vector, label, asks). Repeated rows are rows of their own."""
    kept = []
    for i, v, label, asks in rows:
        if v is None or label is None or any(x is None or not math.isfinite(x) or abs(math.floor(scale * x)) >= 1 << 25 for x in v):
            continue
        kept.append((i, [math.floor(scale * x) for x in v], label, asks))
    out = []
    for a, (anchor, u, label, asks) in enumerate(kept):
        if not asks:
            continue
        scored = [(-sum(x * y for x, y in zip(u, w)), NO_ID if i is None else i, other == label) for b, (i, w, other, _) in enumerate(kept) if b != a and len(w) == len(u)]
        for minus, i, _ in sorted(s for s in scored if s[2])[:n_positives]:
            fits = sorted(s for s in scored if not s[2] and least * -minus <= 100 * -s[0] <= most * -minus)[:n_negatives]
            out += [(anchor, i, rank, j, -minus, -m) for rank, (m, j, _) in enumerate(fits, 1)]
    return sorted(tuple(None if x == NO_ID else x for x in r) for r in out) if all(NO_ID not in r for r in out) else sorted((tuple(None if x == NO_ID else x for x in r) for r in out), key=repr)


def mined(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def rows_with_edges():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 8))
    rows = [(int(i), [float(x) for x in np.round(base[i % 6] + rng.normal(size=8) * 0.4, 2).astype(np.float32)], int(i % 4)) for i in range(260)]
    rows += rows[:40] + [rows[50]] * 30  # repeated rows, ties
    rows += [(None, [1.0] * 8, 1), (None, [1.0] * 8, 2), (300, None, 1), (301, [0.5] * 8, None), (302, [float("nan")] + [1.0] * 7, 1), (303, [None] + [1.0] * 7, 1),
             (350, [float("inf")] + [1.0] * 7, 1), (400, [1e30] * 8, 0), (450, [], 1), (451, [], 2), (452, [], 1), (500, [0.0] * 8, 3), (550, [1.0, 2.0], 1), (551, [1.5, 2.0], 1),
             (552, [1.0, 1.5], 2), (600, [130000.0] * 8, 0), (601, [130000.0] * 8, 0), (602, [120000.0] * 8, 1), (-50, [-0.3] * 8, -3)]
    return rows


@pytest.mark.parametrize("settings", [{}, {"block_bytes": 700, "step": 3}])
def test_edge_rows(spark, monkeypatch, settings):
    monkeypatch.setattr(hn, "CHUNK", 16)
    rows = rows_with_edges()
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, embedding array<float>, label int, score int, row string").repartition(4)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    asks = [(i, v, label, i is not None and i % 50 == 0) for i, v, label in rows]
    got = hn.mine(df, F.col("vec_id") % 50 == 0, **settings)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert mined(got) == sorted(slow(asks), key=repr)
    assert hn.mine(df.where("false"), F.col("vec_id") % 50 == 0).collect() == []
    assert hn.mine(df.where("label = 1"), F.col("vec_id") % 50 == 0).collect() == []


def test_other_settings(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=3)], int(rng.integers(0, 3))) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = hn.mine(df, F.col("vec_id") < 9, positives=40, negatives=7, least=-20, most=130, scale=10)
    assert mined(got) == sorted(slow([(*r, r[0] < 9) for r in rows], 10, 40, 7, -20, 130), key=repr)


def test_whole_table_and_sql(spark):
    got = mined(op12_hard_negatives(spark, SF_SMALL))
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    rows = [(i, v, None if label is None else (label + 1) % 10 if i % 7 == 0 else label, i % 50 == 0) for i, v, label in rows]
    assert got and got == sorted(slow(rows), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF_SMALL}/embeddings.parquet')")
    assert got == sorted(con.execute(ORACLES["op12_hard_negatives"]).fetchall(), key=repr)


def test_slots_answer_every_window():
    """Any best entries per slot give each window its best, for overlapping and equal limits."""
    rng = np.random.default_rng(2)
    for _ in range(300):
        positives = sorted(((int(p), i, i) for i, p in enumerate(rng.integers(-20, 200, rng.integers(1, 6)))), key=lambda e: (-e[0], e[1]))
        entries = [(int(s), i, i) for i, s in enumerate(rng.integers(-30, 200, 60))]
        limits = hn.slots_of([95 * p // 100 for p, *_ in positives])
        kept = []
        for i, high in enumerate(limits):
            low = limits[i + 1] if i + 1 < len(limits) else -10**9
            kept += sorted((e for e in entries if low < e[0] <= high), key=lambda e: (-e[0], e[1]))[:3]
        for (p, *_), (q, _, _, got) in zip(positives, hn.answer(positives, kept)):
            assert p == q and got == sorted((e for e in entries if 50 * p <= 100 * e[0] <= 95 * p), key=lambda e: (-e[0], e[1]))[:3]
