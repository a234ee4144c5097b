"""SimHash against plain Python and all pairs."""

import random

import numpy as np
import pytest
import xxhash

from conftest import SF_SMALL
from scorelake.llm import simhash as S
from scorelake.llm.queries import op8_simhash


def slow_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(rows, radius=4):
    prints = [(i, slow_print(t)) for i, t in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= radius:
                group[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        r = root(k)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return sorted(((i, f"{p:016x}", least[root(k)]) for k, (i, p) in enumerate(prints)), key=repr)


def got(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()), key=repr)


def test_edge_rows(edge_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert got(S.near_duplicates(edge_docs)) == slow_groups(rows)


def test_empty(no_docs):
    assert S.near_duplicates(no_docs).collect() == []
    assert S.one_of_each(no_docs).collect() == []


def test_query_on_the_small_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert got(op8_simhash(spark, SF_SMALL)) == slow_groups(rows)


def test_links_join_what_all_pairs_join(spark):
    """Chains and tight groups, with tiles split into small blocks."""
    rng = random.Random(2)
    prints = set()
    for _ in range(40):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            prints.add(p)
            for _ in range(rng.randint(1, 5)):
                p ^= 1 << rng.randrange(64)
    prints |= {0, 2**64 - 1, 2**63}
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(sorted(prints))]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    found = {r["doc_id"]: r["component_id"] for r in S.components(df, block=3).collect()}
    group = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, p in rows:
            for j, q in rows:
                if ((p ^ q) & (2**64 - 1)).bit_count() <= 4 and group[i] > group[j]:
                    group[i], changed = group[j], True
    assert found == group


def test_ordered_blocks_skip_only_far_ones():
    rng = np.random.default_rng(1)
    left = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    right = np.concatenate([left[::7] ^ np.uint64(0b10110), rng.integers(0, 1 << 63, 3000).astype(np.uint64)])
    pairs = {(int(i), int(j)) for a, b in S.near_pairs(left, right, 4) for i, j in zip(a, b)}
    slow = {(int(i), int(j)) for i in range(0, 5000, 7) for j in np.flatnonzero(np.bitwise_count(left[i] ^ right) <= 4)}
    assert slow <= pairs and all(int(left[i] ^ right[j]).bit_count() <= 4 for i, j in pairs)


def test_no_task_holds_more_than_a_block_of_either_side(spark):
    """All fingerprints in one tile, and every one of them near another."""
    rng = random.Random(7)
    base = [sum(1 << b for b in rng.sample(range(32), 16)) | sum(1 << b for b in rng.sample(range(32, 64), 16)) for _ in range(300)]
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(sorted(set(base)))]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    plan = S.links(df, block=20)
    grouped = {}
    # The same rows as the tasks get them: the plan below the comparison.
    below = plan._jdf.queryExecution().analyzed().children().apply(0)
    from pyspark.sql import DataFrame

    rows_below = DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, below), spark).collect()
    for r in rows_below:
        key = (r["x"], r["y"], r["block"], r["ask_block"])
        grouped.setdefault(key, [0, 0])[0 if r["own"] else 1] += 1
    assert max(a for a, _ in grouped.values()) <= 3 * 20 and max(b for _, b in grouped.values()) <= 3 * 20
    assert len(grouped) >= (300 // 20) ** 2 / 4


@pytest.mark.parametrize("slots", [S.SLOTS, 64])
def test_one_of_each_keeps_one_row_per_group(edge_docs, slots):
    kept = [(r["doc_id"], r["text"]) for r in S.one_of_each(edge_docs, slots=slots).collect()]
    groups = slow_groups([(r["doc_id"], r["text"]) for r in edge_docs.collect()])
    # Two groups share the id 10, and one has no id.
    assert sorted((i for i, _ in kept), key=repr) == sorted([*{c for *_, c in groups}, 10], key=repr)
    assert S.one_of_each(edge_docs).columns == edge_docs.columns
