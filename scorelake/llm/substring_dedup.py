"""Exact substring dedup: a logarithmic family of sparse suffix arrays.

A byte goes when a string of ``LENGTH`` bytes that covers it starts anywhere
else too, in the same text or another. Suffixes are taken at anchors: of every
``LENGTH``-byte string, the place of the least hash of its ``GRAM``-byte parts,
which is the same place wherever the string occurs, so equal strings meet at
equal anchors, and one byte in some ninety starts a suffix.

1. A scan of each text finds its anchors. Anchors whose part occurs once in the
   corpus can't lie in a repeat and go no further (counted before the shuffle).
2. The rest are dealt out by their part with the bytes around them. In each
   task they arrive in batches; a batch gets its suffix array, is merge-scanned
   against the existing levels for matches of ``LENGTH`` bytes, and joins them;
   levels of equal size merge into one of twice the size. The longest common
   extensions to the right and to the left of neighbours in order say, for each
   offset of a string around its anchor, which anchors have equal strings there:
   exact on bytes, without comparing pairs.
3. The repeats found are joined per text and cut from it.

Equal texts are one text with a number of copies, and equal surroundings within
one text are one suffix. Parts with more than ``HOT`` anchors can't meet in one
task; their strings are counted by 128-bit hashes instead, in a grouped count.

Cases: null is the empty text; texts shorter than ``LENGTH`` lose nothing;
repeats are judged on the input, so all occurrences go; repeated rows are
copies of each other and go whole from ``LENGTH`` bytes on; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import ship, stored

LENGTH, GRAM = 200, 32
#: Places of a part within a string, and bytes that may lie before an anchor.
PLACES = LENGTH - GRAM + 1
BEFORE = PLACES - 1
ENTRIES_PER_TASK, BATCH = 60_000, 16_384
#: A part with more anchors than a task's share can't meet in one task.
HOT = ENTRIES_PER_TASK
#: Bytes of a text that are scanned at once.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(max(n, 1 << 16), base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[:] = out
    return _POWERS[0][:n], _POWERS[1][:n]


class Hashes:
    """Hashes of all parts of a text from one running sum."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * power[:-1], out=self.sums[1:])

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        return _mixed((self.sums[starts + length] - self.sums[starts]) * self.inverse[starts])

    def all(self, length: int) -> np.ndarray:
        return _mixed((self.sums[length:] - self.sums[:-length]) * self.inverse[:len(self.sums) - length])


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def sliding(values: np.ndarray, width: int, ufunc: np.ufunc, rest: int) -> np.ndarray:
    """``ufunc`` (minimum or maximum) over every ``width`` neighbours, in two running passes."""
    n = len(values)
    rows = np.full(-(-n // width) * width, rest, values.dtype)
    rows[:n] = values
    rows = rows.reshape(-1, width)
    ahead = ufunc.accumulate(rows, axis=1).ravel()
    back = ufunc.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return ufunc(back[:n - width + 1], ahead[width - 1:n])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and part hashes of the anchors of one chunk, and the ranges that are
    known to occur again in the chunk: periods, and anchors with the same
    surroundings, of which the first stays an anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none.reshape(0, 2)
    hashes = Hashes(data)
    parts = hashes.all(GRAM)
    least = sliding(parts, PLACES, np.minimum, 2**64 - 1)
    edges = np.zeros(len(least) + 2 * BEFORE, np.uint64)
    edges[BEFORE:BEFORE + len(least)] = least
    at = np.flatnonzero(parts == sliding(edges, PLACES, np.maximum, 0))
    at, periods = without_periods(data, at, parts)
    whole = at[(at >= BEFORE) & (at + LENGTH <= len(data))]
    around = hashes.at(whole - BEFORE, BEFORE + LENGTH)
    _, first, group, count = np.unique(around, return_index=True, return_inverse=True, return_counts=True)
    again = np.flatnonzero((count > 1)[group])
    views = np.lib.stride_tricks.sliding_window_view(data, BEFORE + LENGTH) if len(again) else None
    same = np.zeros(len(again), bool)
    for i in range(0, len(again), 4096):
        part = again[i:i + 4096]
        same[i:i + 4096] = (views[whole[part] - BEFORE] == views[whole[first[group[part]]] - BEFORE]).all(axis=1)
    again = again[same]
    repeated = whole[again]
    gone = whole[again[first[group[again]] != again]]
    at = at[~np.isin(at, gone)] if len(gone) else at
    return at, parts[at].view(np.int64), joined(np.concatenate([periods, np.stack([repeated - BEFORE, repeated + LENGTH], axis=1)]))


def without_periods(data: np.ndarray, at: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors without most of those in long periodic stretches, and the stretches.

    In a stretch every period has an anchor with the same part. A string inside
    it, short of its first and last anchor, stands a period further on too, so
    it is known to repeat. Every other string that has an equal one shares with
    it one of the anchors that stay: the first three (strings of each phase
    start there), the last two (strings that show the stretch's end) and those
    that are leftmost in strings that reach just to its end.
    """
    chained = (parts[at[1:]] == parts[at[:-1]]) & (np.diff(at) <= GRAM)
    edges = np.diff(np.r_[False, chained, False].astype(np.int8))
    keep, stretches = np.ones(len(at), bool), []
    for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
        places = at[a:b + 1]
        period, last = int(places[1] - places[0]), int(places[-1])
        text = data[places[0]:last + GRAM]
        if len(text) < LENGTH + 2 * period or (np.diff(places) != period).any() or (text[period:] != text[:-period]).any():
            continue
        keep[a + 3:b - 1] = False
        keep[a:b + 1] |= (places >= last - PLACES - period) & (places <= last - PLACES + 2 * period)
        stretches.append((int(places[0]) + 1, last + GRAM - 1))
    return at[keep], np.array(stretches, np.int64).reshape(-1, 2)


def joined(ranges: np.ndarray) -> np.ndarray:
    """Ranges ``[start, end)`` in order, those that touch or overlap as one."""
    if not len(ranges):
        return ranges.reshape(0, 2)
    ranges = ranges[np.lexsort((ranges[:, 1], ranges[:, 0]))]
    ends = np.maximum.accumulate(ranges[:, 1])
    new = np.flatnonzero(np.r_[True, ranges[1:, 0] > ends[:-1]])
    return np.stack([ranges[new, 0], ends[np.r_[new[1:] - 1, len(ends) - 1]]], axis=1)


_SCAN = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("gram", pa.int64()), ("pos", pa.int32()), ("until", pa.int32())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors ``(k1, k2, gram, pos, null)`` and known repeats ``(k1, k2, null, start, end)``."""
    for batch in batches:
        for k1, k2, text in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("b")):
            data = np.frombuffer(text.as_buffer(), np.uint8)
            for start in range(0, max(1, len(data) - LENGTH + 1), CHUNK):
                at, grams, ranges = anchors(data[start:start + CHUNK + LENGTH - 1])
                ranges = ranges + start
                n, m = len(at), len(ranges)
                if n + m:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(n + m, k1)), pa.array(np.full(n + m, k2)),
                        pa.array(np.concatenate([grams, np.zeros(m, np.int64)]), mask=np.arange(n + m) >= n),
                        pa.array(np.concatenate([at + start, ranges[:, 0]]).astype(np.int32)),
                        pa.array(np.concatenate([np.zeros(n, np.int64), ranges[:, 1]]).astype(np.int32), mask=np.arange(n + m) < n)], schema=_SCAN)


class Level:
    """Suffixes in order of the bytes from their anchor on.

    ``right`` holds the bytes from the anchor on and ``left`` those before it,
    nearest first, both filled up with zeros (a zero byte of a text is written
    as 255, which UTF-8 never uses); ``number`` is the suffix's own.
    """

    NAMES = ("gram", "number", "right", "left", "n_right", "n_left")

    def __init__(self, **columns: np.ndarray):
        order = np.argsort(columns["right"].view(f"S{LENGTH}").ravel(), kind="stable")
        for name in self.NAMES:
            setattr(self, name, columns[name][order])

    def __len__(self) -> int:
        return len(self.gram)

    @classmethod
    def of(cls, levels: list[Level]) -> Level:
        return cls(**{name: np.concatenate([getattr(x, name) for x in levels]) for name in cls.NAMES})

    def pick(self, where: np.ndarray) -> Level:
        return Level(**{name: getattr(self, name)[where] for name in self.NAMES})

    def mark(self, found: np.ndarray) -> None:
        """Set ``found[number, o]`` where the string that starts ``o`` bytes before
        an anchor also stands at another anchor of this level."""
        n = len(self)
        if n < 2:
            return
        right = common(self.right, self.n_right)
        order = np.argsort(self.left.view(f"S{BEFORE}").ravel(), kind="stable")
        left, rank = common(self.left[order], self.n_left[order]), np.empty(n, np.int64)
        rank[order] = np.arange(n)
        most_right, most_left = np.maximum(right, np.r_[right[1:], 0]), np.maximum(left, np.r_[left[1:], 0])[rank]
        able = most_right + most_left >= LENGTH
        for o in range(PLACES):
            rows = np.flatnonzero(able & (most_left >= o) & (most_right >= LENGTH - o))
            if len(rows) < 2:
                continue
            # Suffixes with the same bytes on one side are neighbours in that side's order.
            equal = np.cumsum(right < LENGTH - o)[rows] * np.int64(n + 1) + np.cumsum(left < o)[rank[rows]]
            turn = np.argsort(equal, kind="stable")
            same = equal[turn][1:] == equal[turn][:-1]
            found[self.number[rows[turn[1:][same]]], o] = True
            found[self.number[rows[turn[:-1][same]]], o] = True


def common(sides: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Bytes that each side shares with the one before it in order."""
    out = np.zeros(len(sides), np.int64)
    for i in range(1, len(sides), 8192):
        part = sides[i:i + 8192]
        equal = part == sides[i - 1:i - 1 + len(part)]
        first = np.where(equal.all(axis=1), equal.shape[1], equal.argmin(axis=1))
        out[i:i + 8192] = np.minimum(first, np.minimum(lengths[i:i + 8192], lengths[i - 1:i - 1 + len(part)]))
    return out


class IndexFamily:
    """Levels of geometrically growing size; each batch meets all that came before."""

    def __init__(self):
        self.levels: list[Level] = []
        self.found = np.zeros((0, PLACES), bool)

    def add(self, gram: np.ndarray, left: list[bytes], right: list[bytes]) -> None:
        """``left`` are the bytes before each anchor, nearest first."""
        n, known = len(gram), len(self.found)
        self.found = np.concatenate([self.found, np.zeros((n, PLACES), bool)])
        batch = Level(gram=gram, number=np.arange(known, known + n), right=filled(right, LENGTH), left=filled(left, BEFORE),
                      n_right=np.fromiter(map(len, right), np.int64, n), n_left=np.fromiter(map(len, left), np.int64, n))
        # What a level shares with the batch lies under the parts that both hold.
        shared = [level.pick(np.flatnonzero(np.isin(level.gram, gram))) for level in self.levels]
        Level.of([batch, *shared]).mark(self.found)
        self.levels.append(batch)
        while len(self.levels) > 1 and 2 * len(self.levels[-1]) > len(self.levels[-2]):
            self.levels[-2:] = [Level.of(self.levels[-2:])]

    def ranges(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, first byte and end of each run of repeated strings."""
        edges = np.diff(np.pad(self.found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (row, first), (_, last) = np.nonzero(edges == 1), np.nonzero(edges == -1)
        return row, pos[row] - last + 1, pos[row] - first + LENGTH


_VISIBLE = bytes([255, *range(1, 256)])


def filled(sides: list[bytes], width: int) -> np.ndarray:
    rows = b"".join([s.ljust(width, b"\0") for s in sides])
    return np.frombuffer(rows, np.uint8).reshape(len(sides), width)


_AROUND = pa.schema([("gram", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("pos", pa.int32()), ("left", pa.binary()), ("right", pa.binary())])


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes before (nearest first) and from each anchor on."""
    for batch in batches:
        for row in range(len(batch)):
            text = batch.column("b")[row].as_py().translate(_VISIBLE)
            flat = batch.column("places")[row].values
            pos, gram = flat.field("pos"), flat.field("gram")
            back, at = text[::-1], pos.to_numpy().tolist()
            n = len(text)
            yield pa.RecordBatch.from_arrays([
                gram, pa.array(np.full(len(at), batch.column("k1")[row].as_py())), pa.array(np.full(len(at), batch.column("k2")[row].as_py())), pos,
                pa.array([back[n - p:n - p + BEFORE] for p in at], pa.binary()), pa.array([text[p:p + LENGTH] for p in at], pa.binary())], schema=_AROUND)


_RANGES = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("pos", pa.int32()), ("until", pa.int32())])


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's index family over its share of anchors; repeats per text."""
    family, held, ids, size = IndexFamily(), [], [], 0

    def add() -> None:
        table = pa.Table.from_batches(held)
        family.add(table.column("gram").to_numpy(), table.column("left").to_pylist(), table.column("right").to_pylist())
        ids.append(np.stack([table.column(c).to_numpy() for c in ("k1", "k2", "pos")]))

    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= BATCH:
            add()
            held, size = [], 0
    if size:
        add()
    if ids:
        k1, k2, pos = np.concatenate(ids, axis=1)
        row, start, end = family.ranges(pos)
        yield pa.RecordBatch.from_arrays([pa.array(k1[row]), pa.array(k2[row]), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], schema=_RANGES)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each string of ``LENGTH`` bytes around each anchor, as a 128-bit hash."""
    for batch in batches:
        for row in range(len(batch)):
            text = batch.column("b")[row].as_py()
            starts = {s for p in batch.column("places")[row].values.field("pos").to_pylist() for s in range(max(0, p - BEFORE), min(p, len(text) - LENGTH) + 1)}
            at = sorted(starts)
            digests = np.frombuffer(b"".join(hashlib.blake2b(text[s:s + LENGTH], digest_size=16).digest() for s in at), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(at), batch.column("k1")[row].as_py())), pa.array(np.full(len(at), batch.column("k2")[row].as_py())),
                pa.array(at, pa.int32()), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy())], names=["k1", "k2", "pos", "h1", "h2"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
    for batch in batches:
        for k1, k2, copies, text, found in zip(*(batch.column(c) for c in ("k1", "k2", "copies", "b", "found"))):
            data = text.as_py()
            ranges = np.zeros((0, 2), np.int64)
            if len(data) >= LENGTH and copies.as_py() > 1:
                ranges = np.array([[0, len(data)]])
            elif found.is_valid:
                flat = found.values
                ranges = joined(np.stack([flat.field("pos").to_numpy(), flat.field("until").to_numpy()], axis=1))
            at, parts = 0, []
            for start, end in ranges.tolist():
                parts.append(data[at:start])
                at = end
            kept = b"".join([*parts, data[at:]])
            values = (k1.as_py(), k2.as_py(), len(data), len(data) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest(), kept)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, name: str = "repeats") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)``, one row per row
    of ``docs``; ``kept`` is what is left of the text, as UTF-8 bytes."""
    spark = docs.sparkSession
    ship(spark)
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    docs = docs.select(F.col(id_col).alias("doc_id"), data.alias("b")).withColumns({"k1": F.xxhash64("b"), "k2": F.xxhash64(F.lit("second"), "b")})
    scanned = stored(docs.where(F.length("b") >= LENGTH).select("k1", "k2", "b").mapInArrow(_scan, "k1 long, k2 long, gram long, pos int, until int"), f"{name}_anchors")
    places, itself = scanned.where("gram IS NOT NULL"), F.xxhash64("k1", "k2", "pos")
    # A part counts when it stands at two places of different texts, or of one.
    grams = stored(places.groupBy("gram").agg(F.count("*").alias("n"), F.min(itself).alias("x"), F.max(itself).alias("y")).where("x <> y").select("gram", "n"), f"{name}_parts")
    total, hottest = grams.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    wanted = places.join(grams, "gram").groupBy("k1", "k2").agg(F.collect_set(F.struct("pos", "gram", (F.col("n") > hot).alias("hot"))).alias("places"))
    texts = docs.groupBy("k1", "k2").agg(F.first("b").alias("b"), F.count("*").alias("copies"))
    around = texts.join(wanted, ["k1", "k2"])

    def chosen(is_hot: bool) -> DataFrame:
        own = F.filter("places", lambda p: p["hot"] == F.lit(is_hot))
        # With all columns of ``texts``, so that both its uses share one shuffle of the texts.
        return around.select("k1", "k2", "b", "copies", own.alias("places")).where(F.size("places") > 0)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + total // ENTRIES_PER_TASK)
    found = (chosen(False).mapInArrow(_surroundings, "gram long, k1 long, k2 long, pos int, left binary, right binary")
             .repartition(tasks, "gram").mapInArrow(_indexed, "k1 long, k2 long, pos int, until int"))
    if hottest > hot:
        strings = stored(chosen(True).mapInArrow(_strings, "k1 long, k2 long, pos int, h1 long, h2 long"), f"{name}_strings")
        repeated = strings.groupBy("h1", "h2").agg(F.min(itself).alias("x"), F.max(itself).alias("y")).where("x <> y").select("h1", "h2")
        found = found.unionByName(strings.join(repeated, ["h1", "h2"]).select("k1", "k2", "pos", (F.col("pos") + LENGTH).alias("until")))
    found = found.unionByName(scanned.where("gram IS NULL").select("k1", "k2", "pos", "until"))
    per_text = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("pos", "until")).alias("found"))
    fields = "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    cut = texts.join(per_text, ["k1", "k2"], "left").mapInArrow(_cut, fields)
    return docs.select("doc_id", "k1", "k2").join(cut, ["k1", "k2"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
