"""Hard negatives: per anchor and positive, the best rows of other labels below it.

Scores are inner products of integer vectors. An anchor's positives are its
best rows of the same label. A positive of score ``p`` takes the best negatives
with a score between ``least`` and ``most`` hundredths of ``p``; these windows
overlap. Their upper limits split the scores into disjoint slots, from each
limit down to the next. A task keeps an anchor's best negatives slot by slot,
which partial results merge into as they meet; going up from the lowest slot,
the best of a slot and those below it answer the window that starts there, so
one pass over the rows answers all windows.

Rows are written once with a number of their own and dealt by it into blocks of
about ``BLOCK_BYTES`` at most, so no id, label or group of copies makes a block
large. A task holds one block and streams the anchors past it. Anchors
are the stated query set; each meets every block, and what leaves a block is a
few numbers per anchor.

Cases: rows with a null label, a null vector, or a null or non-finite component
take no part, and neither do rows with a component of ``LARGEST`` or more, whose
scores could leave 64 bits; rows meet only rows of equal dimension; null ids
are no anchors and come last in ties; of repeated rows each is another row
(a row is not its own positive, its copies are); a non-positive positive has
the window that the arithmetic gives it; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.common import ship, stored

POSITIVES, NEGATIVES = 5, 3
LEAST, MOST = 50, 95
SCALE = 256
#: Bytes of rows that a task holds.
BLOCK_BYTES = 64 << 20
#: Anchors, and members of the block, that are compared at once.
STEP, CHUNK = 256, 16_384
#: Integer components from here on are taken like non-finite ones.
LARGEST = 1 << 25
_NO_ID, _WORST = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of every component; null where the row takes no part."""
    wide = vector.cast("array<double>")
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(F.floor(x * scale).cast("double")) >= LARGEST) | (F.abs(x) >= LARGEST))
    return F.when(~bad, F.transform(wide, lambda x: F.floor(x * scale).cast("int")))


def scores(anchors: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Exact inner products, by the narrowest arithmetic that holds their sums."""
    if not anchors.size or not members.size:
        return np.zeros((len(anchors), len(members)), np.int64)
    bound = float(np.abs(anchors).max()) * float(np.abs(members).max()) * anchors.shape[1]
    kind = np.float32 if bound < 2 ** 24 else np.float64 if bound < 2 ** 53 else np.int64
    return (anchors.astype(kind) @ members.astype(kind).T).astype(np.int64)


def best(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines and places of the best ``k`` allowed members per line, and of all that tie with the last of them."""
    masked = np.where(allowed, score, _WORST)
    if masked.shape[1] > k:
        edge = np.partition(masked, masked.shape[1] - k, axis=1)[:, masked.shape[1] - k]
        allowed = allowed & (masked >= edge[:, None])
    return np.nonzero(allowed)


def combined(parts: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The best ``k`` entries ``(line, slot, score, id, row)`` of each line and
    slot: higher scores first, then smaller ids, then smaller row numbers."""
    line, slot, score, ids, rows = (np.concatenate(column) for column in zip(*parts))
    order = np.lexsort((rows, ids, -score, slot, line))
    line, slot = line[order], slot[order]
    new = np.r_[True, (line[1:] != line[:-1]) | (slot[1:] != slot[:-1])][: len(line)]
    starts = np.flatnonzero(new)
    keep = np.arange(len(line)) - np.repeat(starts, np.diff(np.append(starts, len(line)))) < k
    return line[keep], slot[keep], score[order][keep], ids[order][keep], rows[order][keep]


def slots_of(limits: list[int]) -> list[int]:
    """Distinct upper limits, highest first: slot ``i`` is from ``limits[i]`` down to ``limits[i + 1]``."""
    return sorted(set(limits), reverse=True)


def answer(positives: list[tuple[int, int, int]], found: list[tuple[int, int, int]], k: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> list[tuple[int, int, int, list]]:
    """``(positive score, id, row, its negatives)`` of an anchor, from the best
    ``(score, id, row)`` of each slot: suffixes of slots are merged from the lowest up."""
    limits = slots_of([most * p // 100 for p, *_ in positives])
    held: list[list[tuple[int, int, int]]] = [[] for _ in limits]
    for entry in found:
        held[max(i for i, limit in enumerate(limits) if entry[0] <= limit)].append(entry)
    suffix: list[tuple[int, int, int]] = []
    windows = {}
    for limit, slot in zip(reversed(limits), reversed(held)):
        suffix = (sorted(slot, key=lambda e: (-e[0], e[1], e[2])) + suffix)[:k]
        windows[limit] = suffix
    return [(p, i, r, [e for e in windows[most * p // 100] if least * p <= 100 * e[0]]) for p, i, r in positives]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), d)


def _blocks(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[tuple[pa.Table, pa.RecordBatch]]:
    """Each member block with the anchors that meet it, a few at a time. Rows come
    sorted by dimension and block, members first; only members are held."""
    key, held, members = None, [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("d", "block", "anchor")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if a == b:
                continue
            part, (d, block, anchor) = batch.slice(a, b - a), keys[:, a].tolist()
            if (d, block) != key:
                key, held, members = (d, block), [], None
            if not anchor:
                held.append(part)
                continue
            if members is None and held:
                members, held = pa.Table.from_batches(held).combine_chunks(), []
            if members is not None:
                for at in range(0, part.num_rows, step):
                    yield members, part.slice(at, step)


FOUND = "anchor_row long, anchor_id long, slot long, score long, id long, row long"


def _search(batches: Iterator[pa.RecordBatch], k: int, same: bool, step: int) -> Iterator[pa.RecordBatch]:
    """An anchor's best ``k`` rows of a block: of its label (slot 0), or of other labels, slot by slot."""
    before, q = None, None
    for members, anchors in _blocks(batches, step):
        d = members.column("d")[0].as_py()
        if members is not before:
            before, q = members, _matrix(members.column("q").combine_chunks(), d)
            ids, rows, labels = (members.column(c).to_numpy() for c in ("id", "row", "label"))
        own, own_rows, own_ids, own_labels = _matrix(anchors.column("q"), d), *(anchors.column(c).to_numpy() for c in ("row", "id", "label"))
        limits = [[]] if same else [slots_of(x) for x in anchors.column("limits").to_pylist()]
        found = []
        for at in range(0, len(ids), CHUNK):
            chunk = slice(at, at + CHUNK)
            score = scores(own, q[chunk])
            alike = own_labels[:, None] == labels[None, chunk]
            if same:
                wanted = [(0, np.arange(len(own)), alike & (own_rows[:, None] != rows[None, chunk]))]
            else:
                wanted = []
                for slot in range(max(map(len, limits))):
                    lines = np.array([i for i, x in enumerate(limits) if len(x) > slot])
                    high = np.array([limits[i][slot] for i in lines])
                    low = np.array([limits[i][slot + 1] if len(limits[i]) > slot + 1 else _WORST for i in lines])
                    wanted.append((slot, lines, ~alike[lines] & (score[lines] <= high[:, None]) & (score[lines] > low[:, None])))
            for slot, lines, allowed in wanted:
                i, j = best(score[lines], allowed, k)
                found.append((lines[i], np.full(len(i), slot), score[lines[i], j], ids[chunk][j], rows[chunk][j]))
        line, slots, kept, ids_, rows_ = combined(found, k)
        if len(line):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (own_rows[line], own_ids[line], slots, kept, ids_, rows_)],
                                             names=["anchor_row", "anchor_id", "slot", "score", "id", "row"])


def _meet(members: DataFrame, anchors: DataFrame, k: int, same: bool, step: int) -> DataFrame:
    """The best ``k`` per anchor and slot over all blocks. Each block gives at most
    ``k``, and a window with a row limit drops the rest before and after the shuffle."""
    blocks = members.groupBy("d").agg((F.max("block") + 1).alias("blocks"))  # one row per dimension
    asked = anchors.join(blocks, "d").select("d", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("anchor"), "row", "id", "label", "q", "limits")
    rows = members.select("d", "block", F.lit(0).alias("anchor"), "row", "id", "label", "q", F.lit(None).cast("array<long>").alias("limits")).unionByName(asked)
    met = rows.repartition("d", "block").sortWithinPartitions("d", "block", "anchor").mapInArrow(lambda batches: _search(batches, k, same, step), FOUND)
    order = Window.partitionBy("anchor_row", "slot").orderBy(F.desc("score"), "id", "row")
    return met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def mine(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None,
         positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, scale: int = SCALE,
         block_bytes: int = BLOCK_BYTES, step: int = STEP, name: str = "negatives") -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``is_anchor`` and ``label`` (default: the column ``label``) are expressions over ``rows``.
    """
    spark = rows.sparkSession
    ship(spark)
    label = F.col("label") if label is None else label
    # Written once: a row's number is then fixed, whatever is computed again.
    kept = stored(rows.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), label.cast("long").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"), quantised(F.col(vector_col), scale).alias("q")).where("q IS NOT NULL AND label IS NOT NULL"), f"{name}_rows")
    sized = kept.withColumn("d", F.size("q"))
    # Blocks by bytes; small tables have blocks enough for every core.
    n, cores = F.count("*"), spark.sparkContext.defaultParallelism
    by_bytes, by_rows = F.ceil(n * (4 * F.col("d") + 64) / block_bytes), F.least(F.lit(cores), F.ceil(n / 1024))
    shares = sized.groupBy("d").agg(F.greatest(by_bytes, by_rows).cast("int").alias("shares"))  # one row per dimension
    members = sized.join(shares, "d").withColumn("block", F.pmod(F.xxhash64("row"), "shares").cast("int"))
    anchors = sized.where("asks")

    first = stored(_meet(members, anchors.withColumn("limits", F.lit(None).cast("array<long>")), positives, True, step), f"{name}_positives")
    # At most `positives` rows per anchor.
    own = first.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id", "row"))).alias("positives"))
    limits = F.transform("positives", lambda p: F.floor((-p["minus"]).cast("decimal(20,0)") * F.lit(most).cast("decimal(5,0)") / F.lit(100).cast("decimal(5,0)")).cast("long"))
    limited = anchors.join(own.select(F.col("anchor_row").alias("row"), limits.alias("limits")), "row")
    second = _meet(members, limited, negatives, False, step)
    # At most `positives` slots of `negatives` rows per anchor.
    found = second.groupBy("anchor_row").agg(F.collect_list(F.struct("score", "id", "row")).alias("found"))
    asked = anchors.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id")).join(own, "anchor_row").join(found, "anchor_row")

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                own_positives = [(-p["minus"], p["id"], p["row"]) for p in r["positives"]]
                for p, i, row, kept_ in answer(own_positives, [(e["score"], e["id"], e["row"]) for e in r["found"]], negatives, least, most):
                    out += [(r["anchor_id"], i, rank, e[1], p, e[0], r["anchor_row"], row, e[2]) for rank, e in enumerate(kept_, 1)]
            ids = lambda j: pa.array([None if o[j] == _NO_ID else o[j] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays([ids(0), ids(1), pa.array([o[2] for o in out], pa.int32()), ids(3), pa.array([o[4] for o in out], pa.int64()), pa.array([o[5] for o in out], pa.int64())],
                                             names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return asked.mapInArrow(answers, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


ORACLE_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM e AS a JOIN e AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id, score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
w AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS place
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM w WHERE place <= 3"""
