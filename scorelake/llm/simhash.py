"""SimHash near-duplicates: tiled exact comparison of 64-bit fingerprints.

Fingerprints: the majority bit over the XXH64 (seed 42) of every shingle of
``width`` words. Two documents link when their fingerprints differ in at most
``radius`` bits. Equal fingerprints are joined into one first (a grouped
minimum, so a group of copies is one row, whatever its size). The rest meet in
tiles: a tile holds the fingerprints whose two halves have certain population
counts. Two fingerprints differ by at least the sum of their halves'
differences in population count, so tiles further apart than the radius are
never paired. Within a task each pair of tiles is an exclusive-or and a bit
count in numpy, again skipping sub-tiles by the counts of quarters; links leave
a task as a spanning forest, never as all pairs.

Cases: null, empty and wordless texts have fingerprint zero and link like any
other; fewer words than ``width`` are one shingle; repeated rows share a
fingerprint; null ids count as no id (a group of only such rows has a null
component); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import connected_components, fresh, ship, slices, stored

WIDTH, RADIUS, SEED = 4, 4, 42
#: Fingerprints of a tile, and of those compared with it, that one task holds; more are dealt to a grid of blocks.
BLOCK = 50_000
#: Slots of the filter that tells rows that surely stay; a 64th as many rows are broadcast at most.
SLOTS = 1 << 27
_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """The signed 64-bit fingerprint of one text (UTF-8)."""
    from xxhash import xxh64_intdigest

    words = text.translate(_UPPER).translate(_SPACES).split(b" ") if text else []
    words = [w for w in words if w]
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > width:
        starts, ends = starts[: 1 - width], ends[width - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())), "<u8", len(starts))
    ones = np.concatenate([_bit_sums(column) for column in hashes.view(np.uint8).reshape(-1, 8).T])
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _bit_sums(column: np.ndarray) -> np.ndarray:
    """How often each of a byte's bits is set, lowest first."""
    return np.bincount(column, minlength=256) @ _BITS


def fingerprints(text: Column, width: int = WIDTH) -> Column:
    @F.arrow_udf("long")
    def udf(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t, width) for part in slices(texts) for t in part], pa.int64())

    return udf.asNondeterministic()(text.cast("binary"))


class Forest:
    """Smallest linked member of each of a task's fingerprints."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := root[root], root):
                root[:] = up


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of ``left`` and ``right`` within ``radius``, in blocks.

    Large inputs are ordered by their quarters' population counts, and blocks
    whose ranges of these differ by more than the radius in sum are skipped.
    """
    step = 1024
    if len(left) * len(right) < 1 << 22:
        orders = [np.arange(len(left)), np.arange(len(right))]
    else:
        orders = [np.lexsort(_quarters(x)) for x in (left, right)]
    blocks = []
    for values, order in zip((left, right), orders):
        quarters = _quarters(values[order])
        at = range(0, len(values), step)
        blocks.append([(order[i:i + step], values[order[i:i + step]], quarters[:, i:i + step].min(axis=1), quarters[:, i:i + step].max(axis=1)) for i in at])
    if not blocks[1]:
        return
    low, high = np.array([b[2] for b in blocks[1]]), np.array([b[3] for b in blocks[1]])
    for order, values, least, most in blocks[0]:
        apart = np.maximum(0, np.maximum(low - most, least - high)).sum(axis=1)
        for k in np.flatnonzero(apart <= radius):
            order2, values2, *_ = blocks[1][k]
            i, j = np.nonzero(np.bitwise_count(values[:, None] ^ values2[None, :]) <= radius)
            if len(i):
                yield order[i], order2[j]


def _quarters(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values.view("<u2").reshape(-1, 4)).T.astype(np.int64)


def links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints, enough to join all that are
    within ``radius`` of each other, in steps. ``prints`` has the column ``fp``."""
    high, low = F.bit_count(F.shiftrightunsigned("fp", 32)), F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    tiled = prints.select("fp", high.cast("int").alias("x"), low.cast("int").alias("y"))
    steps = [(dx, dy) for dx in range(radius + 1) for dy in range(-radius, radius + 1) if dx + abs(dy) <= radius and (dx, dy) >= (0, 0)]
    # A tile asks itself and the tiles on one side of it; every pair of near tiles meets once.
    near = F.explode(F.array([F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in steps])).alias("t")
    # One row per tile, of which there are 33 * 33 at most: blocks of its members, and of those that ask it.
    counts = tiled.groupBy("x", "y").count()
    asking = counts.select("count", near).groupBy("t").agg(F.sum("count").alias("asking")).select("t.*", "asking")
    sizes = F.broadcast(counts.join(asking, ["x", "y"]).select("x", "y", F.ceil(F.col("count") / block).cast("int").alias("blocks"), F.ceil(F.col("asking") / block).cast("int").alias("ask_blocks")))
    # A task holds one block of either side, whatever the size of a tile.
    member = tiled.join(sizes, ["x", "y"]).select(
        "x", "y", F.pmod(F.xxhash64("fp"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("ask_blocks") - 1)).alias("ask_block"), F.lit(True).alias("own"), "fp")
    asked = tiled.select("fp", near).select("fp", "t.*").join(sizes, ["x", "y"]).select(
        "x", "y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("fp", "x", "y"), "ask_blocks").cast("int").alias("ask_block"), F.lit(False).alias("own"), "fp")

    def compare(tile: pa.Table) -> pa.Table:
        own, values = tile.column("own").to_numpy(), tile.column("fp").to_numpy()
        members, queries = values[own], values[~own]
        # A query of this very tile is a member too, of this block or of another.
        nodes, place = np.unique(np.concatenate([members, queries]), return_inverse=True)
        forest = Forest(len(nodes))
        for i, j in near_pairs(members.view(np.uint64), queries.view(np.uint64), radius):
            forest.link(place[i], place[len(members) + j])
        linked = np.flatnonzero(forest.root != np.arange(len(nodes)))
        return pa.table({"a": nodes[linked], "b": nodes[forest.root[linked]]})

    return member.unionByName(asked).groupBy("x", "y", "block", "ask_block").applyInArrow(compare, "a long, b long")


def components(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK, name: str = "simhash") -> DataFrame:
    """``prints`` (``doc_id``, ``fp`` and any more) with ``component``, the smallest
    fingerprint of a group, and ``component_id``, its smallest ``doc_id``."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), f"{name}_distinct")
    joined = connected_components(links(distinct, radius, block), f"{name}_links")
    named = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(named.select("fp", "component").join(smallest, "component"), "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS, name: str = "simhash") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``."""
    ship(docs.sparkSession)
    prints = stored(docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col), width).alias("fp")), f"{name}_prints")
    return components(prints, radius, name=name).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS, slots: int = SLOTS, name: str = "simhash_kept") -> DataFrame:
    """One row of ``docs`` per group: that of the smallest id (null last), then of
    the smallest text hash; of rows that agree in both, any one.

    Most rows stay, and their texts are not shuffled: a broadcast filter of the
    keys of rows that do not, and of repeated ones, passes every other row; only
    rows that it can't tell meet the exact list.
    """
    ship(docs.sparkSession)
    text_hash = F.xxhash64(F.col(text_col))
    prints = stored(docs.select(F.col(id_col).alias("doc_id"), text_hash.alias("hash"), fingerprints(F.col(text_col), width).alias("fp")), f"{name}_prints")
    same = stored(components(prints, radius, name=name).groupBy("component", "doc_id", "hash").agg(F.count("*").alias("rows")), f"{name}_keys")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash"))
    chosen = same.groupBy("component").agg(first.alias("c"))
    stays = F.col("doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("hash") == F.col("c.hash"))
    key, held, keep, slot, word, bits = (fresh(docs, f"simhash_{n}") for n in ("id", "hash", "keep", "slot", "word", "bits"))
    listed = stored(same.join(chosen, "component").where(~stays | (F.col("rows") > 1)).select(
        F.col("doc_id").alias(key), F.col("hash").alias(held), stays.alias(keep)), f"{name}_listed")
    slot_of = lambda i, h: F.pmod(F.xxhash64(i, h), F.lit(slots))
    words = listed.select(slot_of(F.col(key), F.col(held)).alias(slot)).groupBy(F.expr(f"shiftright({slot}, 6)").alias(word)).agg(
        F.expr(f"bit_or(shiftleft(1L, cast({slot} & 63 AS INT)))").alias(bits))
    own = fresh(docs, "simhash_own")
    told = docs.withColumn(own, text_hash).withColumn(slot, slot_of(F.col(id_col), F.col(own)))
    told = told.join(F.broadcast(words), F.expr(f"shiftright({slot}, 6)") == F.col(word), "left")
    unsure = F.coalesce(F.expr(f"shiftright({bits}, cast({slot} & 63 AS INT)) & 1") == 1, F.lit(False))
    passed = told.where(~unsure).select(*docs.columns)
    doubtful = stored(told.where(unsure).select(*docs.columns, own), f"{name}_doubtful")
    met = doubtful.join(listed, F.col(own).eqNullSafe(F.col(held)) & F.col(id_col).eqNullSafe(F.col(key)), "left")
    others = met.where(F.col(keep).isNull()).select(*docs.columns)
    repeated = met.where(F.col(keep)).dropDuplicates([key, held]).select(*docs.columns)
    return passed.unionByName(others).unionByName(repeated)
