"""Cuts, forms and restored texts against a plain version and SQL."""

import hashlib
import re

import duckdb
import numpy as np
import pytest

from conftest import SF_SMALL
from scorelake.llm import fill_in_middle as fim
from scorelake.llm.queries import ORACLES, op11_fill_in_middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [None, "", " ", "a", " a", "a ", "é ü　x", "one two  three\n\nfour ", "has <P> mark", "has <S>", "<M>", "<P", "\x00 a\x00b", "x" * 5000, "🙂 🙂\t🙂 ", "w " * 3001, "a<\nP> <\tM>"]


def slow(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (doc_id, n, "plain", None, None, text, text)
    form = "spm" if h[3] % 100 < 80 else "psm"
    output = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return (doc_id, n, form, len(prefix), len(middle), output, text)


def digest(rows):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return sorted(((*r[:5], sha(r[5]), sha(r[6])) for r in rows), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_edge_texts(spark):
    rows = [(i, t) for i in (*range(40), None) for t in TEXTS] * 2
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, fim string").repartition(3)
    done = fim.transform(docs, into="made")
    assert done.columns == [*docs.columns, "made"]
    want = [slow(*r) for r in rows]
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert sorted((r["made"]["output"] for r in done.collect())) == sorted(w[5] for w in want)
    assert rows_of(fim.digests(done, into="made")) == digest(want)
    assert rows_of(fim.digests(fim.transform(docs))) == digest(want)  # a column of that name is replaced
    assert fim.digests(fim.transform(docs.where("false"))).collect() == []


def test_whole_table_and_sql(spark):
    got = rows_of(op11_fill_in_middle(spark, SF_SMALL))
    assert got == digest(slow(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    assert got == sorted(con.execute(ORACLES["op11_fill_in_middle"]).fetchall(), key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 64, 1000, 70_000])
def test_skip_list_reaches_every_rank(n):
    widths = np.random.default_rng(n).integers(1, 12, n)
    points = np.cumsum(widths)
    units = fim.SkipList(points)
    most = 0
    for rank in {0, n, *np.random.default_rng(1).integers(0, n + 1, 200).tolist()}:
        at, steps = units.reach(rank)
        assert at == (points[rank - 1] if rank else 0)
        most = max(most, steps)
    assert most <= 12 * (1 + np.log2(n + 1))  # not a walk along the lowest lane
    assert [int(u.sum()) for u, _, _ in units.lanes] == sorted((int(u.sum()) for u, _, _ in units.lanes), reverse=True)
    with pytest.raises(IndexError):
        units.reach(n + 1)
