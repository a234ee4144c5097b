"""Packing into training windows: best-fit decreasing on a segment tree.

A document's ids (plus an end id) are first cut into full windows, which need
no partner; the rest of each document goes, longest first, into the open
window with the least room that still holds it. The tree is indexed by
remaining capacity, so it has as many leaves as a window has ids, and finds
the tightest window in steps of the logarithm of that. Pieces are dealt evenly
to tasks of a bounded number of pieces, so no task grows with the corpus; only
pieces' places and lengths are shuffled, never ids.

Cases: null and empty texts are the end id alone; a document of exactly a
window is one full window; null document ids are packed like others; repeated
rows are packed each; an empty table gives no piece; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import ship, slices, stored
from scorelake.llm.tokens import default_vocabulary, encoder

WINDOW = 2048
END_ID = 1
#: Pieces that one task packs; more tasks, not larger ones, as the corpus grows.
PIECES_PER_TASK = 200_000


class OpenWindows:
    """Open windows by remaining capacity: a segment tree of their numbers."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, number: int) -> None:
        self.open[capacity].append(number)
        self._change(capacity, 1)

    def tightest(self, least: int) -> tuple[int, int] | None:
        """Take the open window with the least capacity of at least ``least``."""
        count, node = self.count, least + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):  # up, until a right neighbour has some
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._change(capacity, -1)
        return capacity, self.open[capacity].pop()

    def _change(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; equal lengths keep their order."""
    numbers, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    windows, used = OpenWindows(window), 0
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = sizes[i]
        found = windows.tightest(size) if size < window else None
        if found is None:
            found, used = (window, used), used + 1
        room, numbers[i] = found
        offsets[i] = window - room
        if room > size:
            windows.add(room - size, int(numbers[i]))
    return numbers, offsets


def cut_documents(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int, window: int) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens)``: full windows, then the rest."""

    piece = pa.struct([(name, pa.int64()) for name in ("start", "length", "ids_crc32", "doc_tokens")])

    @F.arrow_udf("array<struct<start:long,length:long,ids_crc32:long,doc_tokens:long>>")
    def pieces(texts: pa.Array) -> pa.Array:
        enc, end, out = encoder(vocabulary), np.array([end_id], np.uint32), []
        for part in slices(texts):
            for own in enc.encode_all(part):
                ids = np.append(own, end).astype("<u4")
                out.append([{"start": at, "length": min(window, len(ids) - at), "ids_crc32": zlib.crc32(ids[at:at + window]), "doc_tokens": len(ids)} for at in range(0, len(ids), window)])
        return pa.array(out, pa.list_(piece))

    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"), pieces.asNondeterministic()(F.col(text_col)).alias("cut"))
    return cut.select("doc_id", F.inline("cut"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID,
         window: int = WINDOW, pieces_per_task: int = PIECES_PER_TASK, name: str = "pieces") -> DataFrame:
    """One row per piece: its document, place there, sequence and place there."""
    spark = docs.sparkSession
    ship(spark)
    pieces = stored(cut_documents(docs, id_col, text_col, vocabulary or default_vocabulary(), end_id, window), name)
    tasks = 1 + pieces.count() // pieces_per_task
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # at most a task's share of pieces: numbers only
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        numbers, offsets = best_fit_decreasing(table.column("length").to_numpy(), window)
        numbers += TaskContext.get().partitionId() << 32
        table = table.append_column("sequence_id", pa.array(numbers)).append_column("offset", pa.array(offsets))
        yield from table.combine_chunks().to_batches(max_chunksize=50_000)

    # Dealt in turn, not by a key: no key, however frequent, makes a task larger.
    return pieces.repartition(tasks).mapInArrow(place, f"{fields}, sequence_id long, offset long")
