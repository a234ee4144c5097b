"""Embedding near-duplicates: product quantisation over coarse inverted lists.

Each vector lies in the list of its nearest coarse centroid and keeps codes of
its residual, one per subspace, and the length of what the codes miss. A query
probes every list that can hold a vector within reach: for unit vectors, a
cosine of at least ``least`` is a distance of at most ``reach``, and a list is
out of reach when the plane between its centroid and the query's own is further
than that. Within a list, code distances (the query exact, the others by their
codes) come from one matrix product with the decoded codes, which is the sum
over the subspaces' lookup tables for many queries and members at a time; a
vector stays when its code distance is at most ``reach`` plus what its codes
miss. Both bounds hold always, so no pair is lost; the rest get their exact
cosine in double precision.

Equal vectors are one row with a number of copies. Of two lists one asks the
other, each half of the others, so that all are asked alike. A task holds the
members of some lists (at most about ``BLOCK``) and a block of at most about
``ASKS`` times as many vectors that ask one of them; both sides are split, and
a vector goes to a task once for all lists there. Links leave a task as counts
and a spanning forest, never as all pairs. Centroids and codes are fitted on at
most ``SAMPLE`` distinct vectors, chosen by hash; every vector is indexed.

Cases: vectors that are null, empty, zero, or hold a null or non-finite
component link with nothing, not even each other; only vectors of equal
dimension are compared; a repeated row counts as another vector; null ids are
never the smallest; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import connected_components, ship, stored
from scorelake.llm.simhash import Forest

LEAST = 0.95
SAMPLE, LISTS, SUBSPACES, CODES, ROUNDS = 16_000, 256, 8, 256, 8
#: Members of a task, and how many times as many vectors ask them there.
BLOCK, ASKS = 16_000, 4
#: Cells of a matrix of code distances, pairs whose exact cosines are taken at a time, and links that are held before they are joined.
CELLS, PAIRS, HELD = 1 << 20, 1 << 15, 1 << 20
#: Slack for rounding in the bounds; exact cosines decide.
SLACK = 1e-4


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def k_means(points: np.ndarray, k: int) -> np.ndarray:
    rng = np.random.default_rng(7)
    centres = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(ROUNDS):
        near = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        sizes = np.bincount(near, minlength=len(centres))
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


def squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, one row per point."""
    return np.maximum(0, (points * points).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres * centres).sum(axis=1)[None, :])


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([squares(points[i:i + 2048], centres).argmin(axis=1) for i in range(0, len(points), 2048)])


@dataclass
class Quantiser:
    coarse: np.ndarray
    parts: list[np.ndarray]
    codebooks: list[np.ndarray]

    @classmethod
    def fit(cls, sample: np.ndarray) -> Quantiser:
        coarse = k_means(sample, max(1, min(LISTS, len(sample) // 16)))
        residuals = sample - coarse[nearest(sample, coarse)]
        parts = [p for p in np.array_split(np.arange(sample.shape[1]), SUBSPACES) if len(p)]
        return cls(coarse, parts, [k_means(residuals[:, p], min(CODES, len(sample))) for p in parts])

    def encode(self, vectors: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the length of what they miss."""
        residuals = vectors - self.coarse[lists]
        codes = np.stack([nearest(residuals[:, p], book) for p, book in zip(self.parts, self.codebooks)], axis=1).astype(np.uint8)
        missed = sum(((residuals[:, p] - book[codes[:, j]]) ** 2).sum(axis=1) for j, (p, book) in enumerate(zip(self.parts, self.codebooks)))
        return codes, np.sqrt(missed)

    def probes(self, vectors: np.ndarray, reach: float, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Own list of each vector, and a mask of the other lists that it asks."""
        far = squares(vectors, self.coarse)
        own = far.argmin(axis=1) if own is None else own
        between = np.sqrt(squares(self.coarse, self.coarse))[own]
        within = far - far[np.arange(len(own)), own][:, None] <= 2 * between * (reach + SLACK)
        return own, within & self.asked()[own]

    def asked(self) -> np.ndarray:
        """Of two lists the one that is asked by the other: ``[asks, is asked]``; a list is asked by half of the others."""
        n, number = len(self.coarse), np.arange(len(self.coarse))
        ahead = (number[None, :] - number[:, None]) % n
        return (ahead > 0) & ((2 * ahead < n) | ((2 * ahead == n) & (number[:, None] < number[None, :])))

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The residuals that the codes stand for."""
        return np.concatenate([book[codes[:, j]] for j, book in enumerate(self.codebooks)], axis=1) if self.codebooks else np.zeros((len(codes), self.coarse.shape[1]))


def close(quantiser: Quantiser, number: int, queries: np.ndarray, members: np.ndarray, codes: np.ndarray, missed: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of (query, member) pairs of cosine ``least`` or more, in blocks.

    For a query's residual q and a member's decoded codes x, the code distance is
    |q|^2 - 2 qx + |x|^2, so it is within a member's bound b where
    qx - |q|^2 / 2 - (|x|^2 - b^2) / 2 is not negative: the product of both with
    two more columns each, in single precision. What rounding can take from a sum
    of so many terms is left to the bound.
    """
    decoded = quantiser.decode(codes)
    bound = np.sqrt(2 - 2 * least) + missed + SLACK
    rest = ((decoded * decoded).sum(axis=1) - bound * bound) / 2
    known = np.concatenate([decoded, -rest[:, None], np.full((len(decoded), 1), -1.0)], axis=1).astype(np.float32).T.copy()
    longest, most = np.sqrt((decoded * decoded).sum(axis=1).max(initial=0)), np.abs(rest).max(initial=0)
    step = max(1, min(1024, CELLS // max(1, len(members))))
    for start in range(0, len(queries), step):
        part = queries[start:start + step]
        residuals = part - quantiser.coarse[number]
        half = (residuals * residuals).sum(axis=1) / 2
        asked = np.concatenate([residuals, np.ones((len(part), 1)), half[:, None]], axis=1).astype(np.float32)
        rounding = 2.0**-23 * (part.shape[1] + 8) * (np.sqrt(2 * half.max()) * longest + most + half.max())
        pairs = np.flatnonzero(asked @ known >= -np.float32(rounding))
        for at in range(0, len(pairs), PAIRS):
            i, k = np.divmod(pairs[at:at + PAIRS], len(members))
            exact = np.einsum("ij,ij->i", part[i], members[k]) >= least
            if exact.any():
                yield start + i[exact], k[exact]


def packed(vectors: np.ndarray) -> pa.Array:
    """Each row as its bytes, which cross an exchange quicker than arrays."""
    width = vectors.shape[1] * vectors.itemsize
    return pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(np.arange(0, (len(vectors) + 1) * width, width, np.int32)[:len(vectors) + 1]), pa.py_buffer(np.ascontiguousarray(vectors))])


def unpacked(column: pa.ChunkedArray, d: int, kind: str) -> np.ndarray:
    return np.concatenate([np.zeros((0, d)), *[np.frombuffer(b"".join(chunk.to_pylist()), kind).reshape(-1, d) for chunk in column.chunks]])


def vectors_of(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def valid(vector):
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST, block: int = BLOCK, name: str = "vectors") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``rows``."""
    spark = rows.sparkSession
    ship(spark)
    vector = F.col(vector_col).cast("array<double>")
    # Equal keys are equal vectors: 128 bits of hash, over zeros of one sign.
    signless = F.transform(vector, lambda x: x + F.lit(0.0))
    key = F.when(valid(vector), F.concat(F.hex(F.xxhash64(signless)), F.lit("-"), F.hex(F.xxhash64(F.lit("second"), signless))))
    kind = "<f4" if rows.schema[vector_col].dataType.elementType.typeName() == "float" else "<f8"
    rows = rows.select(F.col(id_col).alias("vec_id"), signless.alias("v"), key.alias("key"))
    distinct = rows.where("key IS NOT NULL").groupBy("key").agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
    distinct = stored(distinct.withColumn("id", F.monotonically_increasing_id()), f"{name}_distinct")
    sample = distinct.select("v", F.size("v").alias("d"), "key").orderBy("key").limit(SAMPLE).collect()
    tasks = max(2 * spark.sparkContext.defaultParallelism, 1 + distinct.count() // block)
    quantisers = spark.sparkContext.broadcast({d: Quantiser.fit(unit(np.array([r["v"] for r in sample if r["d"] == d]))) for d in {r["d"] for r in sample}})
    reach = float(np.sqrt(2 - 2 * least))

    def groups_of(quantiser: Quantiser) -> np.ndarray:
        """The group of each list; a task holds a group's members, or a block of them."""
        lists = len(quantiser.coarse)
        return np.arange(lists) * min(lists, tasks) // lists

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A vector's own list, whether it asks another one of that list's group, and the groups: its own, then those that it asks besides."""
        for batch in batches:
            sizes = batch.column("d").to_numpy()
            for d in np.unique(sizes):
                part = batch.filter(pa.array(sizes == d))
                vectors = vectors_of(part.column("v"))
                own, inner, asked = np.zeros(len(part), np.int64), np.zeros(len(part), bool), [[0]] * len(part)
                if int(d) in quantisers.value:
                    group = groups_of(quantisers.value[int(d)])
                    own, reached = quantisers.value[int(d)].probes(unit(vectors), reach)
                    some = np.logical_or.reduceat(reached, np.searchsorted(group, np.arange(group[-1] + 1)), axis=1)
                    inner = some[np.arange(len(own)), group[own]]
                    some[np.arange(len(own)), group[own]] = False
                    asked = [[g, *np.flatnonzero(row).tolist()] for g, row in zip(group[own].tolist(), some)]
                yield pa.RecordBatch.from_arrays([part.column("id"), packed(vectors.astype(kind)), part.column("copies"), part.column("d"), pa.array(own, pa.int32()), pa.array(inner), pa.array(asked, pa.list_(pa.int32()))],
                                                 names=["id", "v", "copies", "d", "own", "inner", "groups"])

    probed = stored(distinct.select("id", "v", "copies", F.size("v").alias("d")).mapInArrow(listed, "id long, v binary, copies long, d int, own int, inner boolean, groups array<int>"), f"{name}_lists")
    # One row per group of lists and dimension.
    sizes = F.broadcast(probed.select("d", F.posexplode("groups").alias("at", "group")).groupBy("d", "group").agg(
        F.greatest(F.lit(1), F.ceil(F.count_if(F.col("at") == 0) / block)).cast("int").alias("blocks"), F.ceil(F.count("*") / (ASKS * block)).cast("int").alias("parts")))
    placed = probed.select("*", F.posexplode("groups").alias("at", "group")).drop("groups").join(sizes, ["d", "group"])
    own_block = F.pmod(F.xxhash64("id"), "blocks").cast("int")
    part = F.pmod(F.xxhash64("id", F.lit("part")), "parts").cast("int")
    members = placed.where("at = 0").select("d", "group", own_block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("member"), F.lit(False).alias("beside"), "id", "v", "copies", "own")
    # In its own group, a vector asks its own list's members in the blocks after its own, and other lists in every block.
    asking = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), own_block.alias("own_block")).withColumn("beside", (F.col("at") == 0) & (F.col("block") > F.col("own_block")))
    asked = asking.where("at > 0 OR inner OR beside").select("d", "group", "block", part.alias("part"), F.lit(False).alias("member"), "beside", "id", "v", "copies", "own")

    def compare(group: tuple, table: pa.Table) -> pa.Table:
        """Counts ``(id, null, n)`` and links ``(id, other, 0)``."""
        d, number, first_part = group[0].as_py(), group[1].as_py(), group[3].as_py() == 0
        member, beside, copies, ids, own = (table.column(c).to_numpy() for c in ("member", "beside", "copies", "id", "own"))
        vectors = unit(unpacked(table.column("v"), d, kind))
        names, place = np.unique(ids, return_inverse=True)
        m, q = np.flatnonzero(member), np.flatnonzero(~member)
        quantiser, lists = quantisers.value.get(d), [0]
        if quantiser is None:  # a dimension that the sample lacks: every pair gets its exact cosine
            quantiser = Quantiser(np.zeros((1, d)), [], [])
            reached = np.zeros((len(q), 1), bool)
        else:
            lists = np.flatnonzero(groups_of(quantiser) == number).tolist()
            reached = np.concatenate([np.zeros((0, len(lists)), bool), *[quantiser.probes(vectors[p], reach, own[p])[1][:, lists] for p in np.array_split(q, 1 + len(q) // 2048)]])
        n, forest = np.zeros(len(names), np.int64), Forest(len(names))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for column, wanted in enumerate(lists):
            own_members = m[own[m] == wanted]
            if not len(own_members):
                continue
            if quantiser.codebooks:
                codes, missed = quantiser.encode(vectors[own_members], np.full(len(own_members), wanted))
            else:
                codes, missed = np.zeros((len(own_members), 0), np.uint8), np.full(len(own_members), 2.0)
            asking = q[reached[:, column] | (beside[q] & (own[q] == wanted))]
            for rows_asking, either in ((own_members if first_part else m[:0], False), (asking, True)):  # members meet each other from either side
                for i, k in close(quantiser, wanted, vectors[rows_asking], vectors[own_members], codes, missed, least):
                    a, b = rows_asking[i], own_members[k]
                    other = place[a] != place[b]
                    a, b = a[other], b[other]
                    np.add.at(n, place[b], copies[a])
                    if either:
                        np.add.at(n, place[a], copies[b])
                    held.append((place[a], place[b]))
                    if sum(len(x) for x, _ in held) > HELD:
                        forest.link(*map(np.concatenate, zip(*held)))
                        held = []
        if held:
            forest.link(*map(np.concatenate, zip(*held)))
        counted, linked = np.flatnonzero(n), np.flatnonzero(forest.root != np.arange(len(names)))
        none = np.concatenate([np.ones(len(counted), bool), np.zeros(len(linked), bool)])
        return pa.table({
            "a": pa.array(np.concatenate([names[counted], names[linked]]), pa.int64()),
            "b": pa.array(np.concatenate([np.zeros(len(counted), np.int64), names[forest.root[linked]]]), pa.int64(), mask=none),
            "n": pa.array(np.concatenate([n[counted], np.zeros(len(linked), np.int64)]), pa.int64())})

    found = stored(members.unionByName(asked).groupBy("d", "group", "block", "part").applyInArrow(compare, "a long, b long, n long"), f"{name}_links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    joined = connected_components(found.where("b IS NOT NULL").select("a", "b"), name).withColumnRenamed("node", "id")
    per_key = distinct.select("id", "key", "copies", "least_id").join(counts, "id", "left").join(joined, "id", "left").select(
        "key", "least_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    smallest = per_key.groupBy("component").agg(F.min("least_id").alias("component_id"))
    per_key = per_key.join(smallest, "component").select("key", "n_links", "component_id")
    out = rows.select("vec_id", "key").join(per_key, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
