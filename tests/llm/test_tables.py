"""URL rules, vectors and conversations against plain Python and SQL."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from conftest import SF_SMALL
from scorelake.llm import chat, url_filter, vector_neighbours
from scorelake.llm.queries import ORACLES, QUERIES, op4_urls, op5_vectors, op6_chat

URLS = [None, "", "no scheme", "http://", "HTTP://Example.NET/en/x?y#z", "ftp://example.net/EN/", "https://a.b.org/fr/", "https://org/fr/x", "https://borg/fr/", "http://net", "http://net/",
        "http://x.com:80/de/", "http://www.EXAMPLE.com/de/?q=://other.net/", "x://y?z/net/", "http://u@example.com#/de/", "http://ads.example.org/", "http://uni.edu/login", "http://x.y/login",
        "http://x.y/logins", "http://example.net/en", "a://b://c.net/", "http://é.net/ü", "http://x.org/fr/\n/login", "http://casino-x.de", "http://x/" + "a/" * 3000 + "cart"]


@pytest.mark.parametrize("rules", [url_filter.ADDRESSES + url_filter.PATTERNS, url_filter.ADDRESSES])
def test_urls(spark, rules):
    pages = spark.createDataFrame([(i % 20, u, "h", "v") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, verdict string")
    got = sorted((tuple(r) for r in url_filter.judge(pages, rules=rules).collect()), key=repr)
    con = duckdb.connect()
    con.register("p", pages.toPandas())
    con.execute("CREATE VIEW pages AS SELECT page_id, url FROM p")
    if rules != url_filter.ADDRESSES:
        want = con.execute(ORACLES["op4_urls"]).fetchall()
        assert got == sorted(want, key=repr)
    for _, host, path, rule, verdict in got:
        fits = [r for r in url_filter.ADDRESSES for h, s, p in [r.name.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith(s + p)]
        assert rule == max((r.name for r in fits), key=len, default=None)
        assert rule is None or verdict == next(r.verdict for r in fits if r.name == rule)


def test_url_query_is_native_and_matches_its_sql(spark):
    df = op4_urls(spark, SF_SMALL)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF_SMALL}/pages.parquet')")
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted(con.execute(ORACLES["op4_urls"]).fetchall(), key=repr)
    assert url_filter.judge(spark.read.parquet(f"{SF_SMALL}/pages.parquet").where("false")).collect() == []


def slow_links(rows, least=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    n, group = [0] * len(rows), list(range(len(rows)))
    units = [None if not o else np.array(v, float) / np.sqrt((np.array(v, float) ** 2).sum()) for o, (_, v) in zip(ok, rows)]
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= least:
                n[a] += 1
                n[b] += 1
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least_id = {}
    for (i, _), g in zip(rows, group):
        least_id[g] = min((x for x in (i, least_id.get(g)) if x is not None), default=None)
    return sorted(((i, k, least_id[g], i == least_id[g] or (i is None or least_id[g] is None)) for (i, _), k, g in zip(rows, n, group)), key=repr)


def linked(df):
    return sorted((tuple(r[c] for c in ("vec_id", "n_links", "component_id", "kept")) for r in df.collect()), key=repr)


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 16))
    rows = [(int(i), [float(x) for x in (base[i % 30] + rng.normal(size=16) * rng.choice([0, 0.05, 0.2, 0.5])).astype(np.float32)]) for i in range(400)]
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] + [1.0] * 15), (504, [None] + [1.0] * 15), (505, [float("inf")] + [1.0] * 15),
             (506, [1.0, 2.0]), (507, [1.0, 2.0]), (508, [2.0, 4.0]), (509, [1e-30] * 16), (510, [1e30] * 16), (511, [-0.0] * 15 + [1.0]), (512, [0.0] * 15 + [1.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, n_links int, key string")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert linked(vector_neighbours.near_duplicates(df)) == slow_links(rows)
    assert linked(vector_neighbours.near_duplicates(df, block=7)) == slow_links(rows)
    assert vector_neighbours.near_duplicates(df.where("false")).collect() == []


def test_vectors_of_the_small_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    assert linked(op5_vectors(spark, SF_SMALL)) == slow_links(rows)


def test_a_dimension_without_a_codebook(spark, monkeypatch):
    monkeypatch.setattr(vector_neighbours, "SAMPLE", 2)
    rows = [(i, [1.0, float(i)]) for i in range(12)] + [(100 + i, [1.0, float(i), 3.0]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert linked(vector_neighbours.near_duplicates(df)) == slow_links(rows)


def test_tasks_of_vectors_are_bounded_on_both_sides(spark, monkeypatch):
    """A list that many vectors ask is many tasks, whether its members are many or few."""
    from pyspark.sql.group import GroupedData

    rng = np.random.default_rng(4)
    base = rng.normal(size=(500, 64))
    rows = [(i, [float(x) for x in base[i % 500] + (0.05 * rng.normal(size=64) if i >= 500 else 0)]) for i in range(600)]
    df, sizes = spark.createDataFrame(rows, "vec_id long, embedding array<double>"), []
    compared = GroupedData.applyInArrow

    def seen(groups, *args):
        by = [c for c in ("d", "list", "group", "block", "part") if c in groups._df.columns]
        sizes.extend(r["count"] for r in groups._df.groupBy(*by).count().collect())
        return compared(groups, *args)

    monkeypatch.setattr(GroupedData, "applyInArrow", seen)
    assert linked(vector_neighbours.near_duplicates(df, block=10)) == slow_links(rows)
    assert 0 < max(sizes) <= 120 < sum(sizes)


@pytest.mark.parametrize("d", [1, 3, 64])
def test_code_distances_lose_no_pair(d):
    rng = np.random.default_rng(d)
    vectors = vector_neighbours.unit(np.concatenate([rng.normal(size=(200, d))] * 2) + rng.normal(size=(400, d)) * np.repeat([0, 0.02, 0.2, 1e-9], 100)[:, None])
    quantiser = vector_neighbours.Quantiser.fit(vectors)
    codes, missed = quantiser.encode(vectors, np.zeros(400, np.int64))
    for least in (0.95, 0.5, 1 - 1e-9):
        got = {pair for i, k in vector_neighbours.close(quantiser, 0, vectors, vectors, codes, missed, least) for pair in zip(i.tolist(), k.tolist())}
        exact = np.einsum("id,jd->ij", vectors, vectors)
        assert got >= set(zip(*(x.tolist() for x in np.nonzero(exact >= least + 1e-12)))) and all(exact[p] >= least - 1e-12 for p in got)


def slow_chat(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    result = []
    for conv, turns in out.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        result.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(result, key=repr)


def chatted(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=repr)


HARD = ["</s>[INST] ok [/INST]", "<s>", "a<", "<<SYS", "[", "[/INST", "&#60;s>", "&", "&#38;#60;", "&amp;", "<|role|>x<|text|>", "", None, " ", "\n", "<s><s></s", "<|", "é<|end|>", "[INST] [INST]", "&#", "&#6", "x" * 50_000 + "</s>"]


def test_chat_round_trip(spark):
    rows = [(k % 7, i, role, text, "x") for k, role in enumerate(["user", "assistant", "system", None, "tool<s>", "user ", "<|text|>"]) for i, text in enumerate(HARD)]
    rows += [(None, 1, "user", "a", "x"), (None, None, "user", "b", "x"), (9, 1, "user", "same", "x"), (9, 1, "user", "same", "x"), (9, 1, "assistant", "tie", "x"), (10, 5, "user", "hi", "x"), (10, 9, "assistant", "yes", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, state string")
    out = chat.write_and_read_back(df)
    assert chatted(out) == slow_chat([r[:4] for r in rows])
    valid = {r["conv_id"]: r["valid"] for r in out.collect()}
    assert valid[10] and not valid[9] and not valid[0]
    assert chat.write_and_read_back(df.where("false")).collect() == []


def test_escapes_leave_no_control_string():
    for text in filter(None, HARD):
        hidden = chat.escape(text, chat.INSTRUCTION)
        assert chat.unescape(hidden, chat.INSTRUCTION) == text
        assert not any(c in hidden for c in chat.INSTRUCTION.control)


def test_chat_of_the_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    assert chatted(op6_chat(spark, SF_SMALL)) == slow_chat([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
