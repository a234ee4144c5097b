"""Token-ID output: canonical length-limited Huffman blocks, written and read back.

``encode_documents`` turns texts into ids (plus one end id), counts ids over
the whole corpus, builds one canonical code of at most 16 bits (more only if there are
more ids) and writes one row per block: whole documents in ascending id order,
their code bits, and the bit offset of every 512th id. The code lengths lie next
to the blocks, so any session can read the store. ``decode_blocks`` needs a
block and the code lengths; all of a block's checkpoints are decoded in step
from one table of an entry for each value of the longest code.

Cases: null and empty texts hold the end id alone; null document ids come
first; repeated rows are all kept, next to each other; an empty table gives a
store without blocks; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelake.llm.common import scratch_dir, ship, stored
from scorelake.llm.tokens import default_vocabulary, encoder, id_type

END_ID = 0
#: Bits of a code; the limit that decoding has.
LONGEST, MOST_BITS = 16, 25
BLOCK_IDS = 1 << 18
#: Ids that one task puts in order and codes, about.
TASK_IDS = 8 << 20
CHECKPOINT = 512
BLOCK_SCHEMA = "part int, block int, first long, n_ids long, bits binary, checkpoints binary, doc_ids array<long>, lengths array<long>"


def code_lengths(counts: dict[int, int], longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits, by package-merge; 0: no code.

    Works on counts of distinct ids alone, which the vocabulary bounds.
    """
    ids = sorted(counts, key=lambda i: (counts[i], i))
    lengths = np.zeros(max(ids, default=-1) + 1, np.uint8)
    longest = max(longest, (len(ids) - 1).bit_length())
    if longest > MOST_BITS:
        raise ValueError(f"{len(ids)} ids need codes of more than {MOST_BITS} bits")
    if len(ids) == 1:
        lengths[ids[0]] = 1
    if len(ids) < 2:
        return lengths
    weights = np.array([counts[i] for i in ids], np.float64)
    rows, sizes = [weights], []
    for _ in range(longest - 1):
        row = rows[-1]
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([weights, pairs])
        order = np.argsort(merged, kind="stable")
        sizes.append(order < len(weights))  # which of the row's items are ids, not packages
        rows.append(merged[order])
    take, depth = 2 * len(ids) - 2, np.zeros(len(ids) + 1, np.int64)
    for leaf in reversed(sizes):
        own = int(leaf[:take].sum())
        depth[0] += 1
        depth[own] -= 1
        take = 2 * (take - own)
    depth[0] += 1
    depth[take] -= 1
    lengths[ids] = np.cumsum(depth)[:-1]
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes, code, before = np.zeros(len(lengths), np.uint32), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[np.searchsorted(lengths[order], 1):]:
        code <<= int(lengths[i]) - before
        codes[i], before = code, int(lengths[i])
        code += 1
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value of as many next bits as the longest code has: the id and its code's length."""
    longest = max(LONGEST, int(lengths.max(initial=0)))
    ids, used = np.zeros(1 << longest, np.uint32), np.ones(1 << longest, np.uint8)
    coded = np.flatnonzero(lengths)
    order = coded[np.lexsort((coded, lengths[coded]))]
    spans = 1 << (longest - lengths[order].astype(np.int64))
    filled = int(spans.sum())
    ids[:filled], used[:filled] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return ids, used


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Code bits of ``ids``, first bit highest, and the bit offset of each checkpoint."""
    if not len(ids):
        return b"", np.zeros(0, np.uint64)
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    word, room = starts >> 5, 64 - (starts & 31) - n  # a code of 25 bits lies in 64 bits from its word on
    value = codes[ids].astype(np.uint64) << room.astype(np.uint64)
    firsts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    joined, at = np.bitwise_or.reduceat(value, firsts), word[firsts]
    out = np.zeros(int(ends[-1] >> 5) + 3, np.uint32)
    out[at] |= (joined >> np.uint64(32)).astype(np.uint32)
    out[at + 1] |= (joined & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8], starts[::CHECKPOINT].astype(np.uint64)


def unpack_bits(bits: bytes, checkpoints: np.ndarray, n_ids: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of one block: every checkpoint's next id at each step."""
    ids, used = table
    longest = len(ids).bit_length() - 1
    raw = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
    ahead = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]  # 32 bits from each byte on
    at, out = checkpoints.astype(np.int64), np.empty((CHECKPOINT, len(checkpoints)), np.uint32)
    last = len(ahead) - 1
    for step in range(min(CHECKPOINT, n_ids)):
        key = (ahead[np.minimum(at >> 3, last)] >> (32 - longest - (at & 7)).astype(np.uint32)) & np.uint32(len(ids) - 1)
        out[step] = ids[key]
        at += used[key]
    return out.T.reshape(-1)[:n_ids]


ENCODED = "row long, doc_id long, tie long, ids binary, counts binary"


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, dtype: str) -> Iterator[pa.RecordBatch]:
    """Ids of each text; and, in a last row of a task, how often it saw each id."""
    enc, end = encoder(vocabulary), np.array([end_id], dtype)
    total = np.zeros(end_id + 1, np.int64)
    none = pa.nulls(1, pa.int64())
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            found = [np.append(ids.astype(dtype), end) for ids in enc.encode_all(part.column("text").to_pylist())]
            counts = np.bincount(np.concatenate(found), minlength=len(total))
            counts[: len(total)] += total
            total = counts
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "doc_id", "tie")), pa.array([x.tobytes() for x in found], pa.binary()), pa.nulls(len(found), pa.binary())], names=["row", "doc_id", "tie", "ids", "counts"])
    yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["row", "doc_id", "tie", "ids", "counts"])


def _id_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column("counts"):
            total = np.frombuffer(raw.as_buffer(), np.int64)
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])


def write_store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID,
                path: str | None = None, name: str = "token_store") -> str:
    """Write the store to ``path`` (default: a new folder of the shared scratch one); returns it."""
    spark = docs.sparkSession
    ship(spark)
    path = path or f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    vocabulary = vocabulary or default_vocabulary()
    dtype = id_type(vocabulary)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tie"), F.col(text_col).cast("string").alias("text"))
    ids = stored(texts.mapInArrow(lambda batches: _encoded(batches, vocabulary, end_id, dtype), ENCODED), f"{name}_ids")
    counts = ids.where("counts IS NOT NULL").select("counts").mapInArrow(_id_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counted = {r["id"]: r["n"] for r in counts.collect()}  # as many rows as the vocabulary has ids, at most
    lengths = code_lengths(counted)
    codes = canonical_codes(lengths)
    coded = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(coded, "id long, length int").coalesce(1).write.parquet(f"{path}/code")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, first, held, docs_, sizes, n = TaskContext.get().partitionId(), 0, 0, [], [], [], 0

        def row() -> pa.RecordBatch:
            bits, checkpoints = pack_bits(np.concatenate(held), codes, lengths)
            return pa.RecordBatch.from_pylist([{"part": part, "block": block, "first": first, "n_ids": n, "bits": bits, "checkpoints": checkpoints.tobytes(), "doc_ids": docs_, "lengths": sizes}], schema=schema)

        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.binary()), ("checkpoints", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                own = np.frombuffer(raw.as_buffer(), dtype)
                held.append(own)
                docs_.append(doc)
                sizes.append(len(own))
                n += len(own)
                if n >= BLOCK_IDS:
                    yield row()
                    block, first, held, docs_, sizes, n = block + 1, first + n, [], [], [], 0
        if held:
            yield row()

    # Tasks by the number of ids; the row parts equal documents too.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + sum(counted.values()) // TASK_IDS)
    ordered = ids.where("counts IS NULL").select("doc_id", "tie", "row", "ids").repartitionByRange(tasks, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")
    ordered.select("doc_id", "ids").mapInArrow(blocks, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(f"{path}/blocks")
    return path


def open_store(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    """A store's blocks and code lengths, both from its files."""
    ship(spark)
    code = spark.read.schema("id long, length int").parquet(f"{path}/code").collect()  # one row per id of the vocabulary, at most
    lengths = np.zeros(max((r["id"] for r in code), default=-1) + 1, np.uint8)
    for r in code:
        lengths[r["id"]] = r["length"]
    return spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks"), lengths


def read_store(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    return decode_blocks(*open_store(spark, path), with_ids)


def encode_documents(docs: DataFrame, **settings) -> tuple[DataFrame, np.ndarray]:
    """Write the store; returns its blocks and code lengths, as read back."""
    return open_store(docs.sparkSession, write_store(docs, **settings))


def decode_blocks(blocks: DataFrame, lengths: np.ndarray, with_ids: bool = True) -> DataFrame:
    """Read the store: ``(doc_id, start, n_tokens, ids_crc32[, ids])``.

    ``start`` counts the ids of all documents before; ``ids`` are little-endian
    32-bit bytes. A part holds its blocks' places within it, so only one row
    per part, of some million ids, is summed up and broadcast.
    """
    schema = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
                       + [("ids", pa.binary())] * with_ids)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_bits(row["bits"], np.frombuffer(row["checkpoints"], np.uint64), row["n_ids"], table).astype("<u4")
                ends = np.cumsum(row["lengths"])
                texts = [ids[e - n:e].tobytes() for e, n in zip(ends.tolist(), row["lengths"])]
                columns = [np.full(len(ends), row["part"], np.int32), row["first"] + ends - row["lengths"], row["doc_ids"], row["lengths"], [zlib.crc32(t) for t in texts]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, *[texts] * with_ids], schema)], schema=schema)

    fields = "part int, start long, doc_id long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    total = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = total.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    out = blocks.mapInArrow(decoded, fields).join(F.broadcast(before), "part")
    return out.select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
