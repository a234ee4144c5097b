"""LM scoring: a log-bilinear neural model, trained with noise-contrastive estimation.

Every token belongs to an output unit: the end, each of the ``OWN`` most
frequent words, or one of ``ENDINGS`` classes of words by their last two bytes.
Given the two units before, the model predicts a vector, the sum of their
context vectors, each scaled per dimension by its place; a unit's score is the
product of that vector with its own, plus a bias. A token's probability is that
of its unit, normalised over all units, times the token's share of the unit's
counts, (c + 1) / (sum of (c + 1) over the unit's words, plus one for all words
never seen). So the probabilities of all seen tokens and one unseen per class
add up to one after any context.

*Counts* cover every training text, grouped after each task has added up its
own. *Training* reads every training text once, in two rounds: each task trains
a copy of the parameters on its own texts, and a grouped sum averages the
copies by their number of tokens, so what is gathered grows with the corpus and
what reaches the driver is one set of parameters. The noise is the units'
distribution. *Normalisers* of all pairs of units come from one batched matrix
product per block of contexts. *Scoring* is map-only for the ``FREQUENT`` words
of at most ``LONGEST`` bytes, whose counts are broadcast; the rest meet their
counts in a join, once per text and word.

Cases: null and empty texts are the end alone; a null id is never held out;
with nothing to learn from every token has probability one in both scores;
repeated rows are learned from and scored each; texts of any length are read
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import ship, stored

FOLDS, HELD_OUT = 7, 2
#: Units: words of their own, and classes of the others.
OWN, ENDINGS = 383, 128
UNITS = 1 + OWN + ENDINGS
#: Words whose counts are broadcast, each of at most LONGEST bytes (the end among them): 15 MB at most.
FREQUENT, LONGEST = 200_000, 64
#: Size of a vector, noise samples and tokens of a step, rate, share of the texts in the first round (one of).
DIM, NOISE, STEP, RATE, FIRST = 16, 16, 4096, 0.05, 8
#: Bytes of texts that a task takes in at once (a longer text alone).
PARCEL = 1 << 20
#: Words that a counting task holds before it passes them on.
HELD = 1_000_000
END = b""
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_LOG10 = float(np.log(10))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_LOWER).split() if text else []


def ending(word: bytes) -> int:
    """The class of a word that has no unit of its own."""
    return 1 + OWN + zlib.crc32(word[-2:]) % ENDINGS


def held_out(id_col: str) -> Column:
    """By the CRC-32 of the id; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


# ---- the model ---------------------------------------------------------------


@dataclass
class Bilinear:
    """``context`` has a row per unit and a last one for what is before a text."""

    context: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    places: np.ndarray

    @classmethod
    def start(cls, noise: np.ndarray) -> Bilinear:
        rng = np.random.default_rng(3)
        small = lambda n: (rng.normal(size=(n, DIM)) * 0.1).astype(np.float32)
        return cls(small(UNITS + 1), small(UNITS), np.log(noise).astype(np.float32), np.ones((2, DIM), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.context, self.target, self.bias, self.places]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parameters()]).astype(np.float64)

    def filled(self, flat: np.ndarray) -> Bilinear:
        at, out = 0, []
        for p in self.parameters():
            out.append(flat[at:at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Bilinear(*out)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Scores ``(place, context unit, unit)`` without biases, and the log of the normaliser of each pair of contexts."""
        parts = np.stack([(self.context * place) @ self.target.T for place in self.places])
        log_z = np.empty((UNITS + 1, UNITS + 1), np.float32)
        for first in range(UNITS + 1):  # one batch of contexts: this unit, then every unit before it
            s = parts[1] + (parts[0][first] + self.bias)
            top = s.max(axis=1, keepdims=True)
            log_z[first] = top[:, 0] + np.log(np.exp(s - top).sum(axis=1))
        return parts, log_z


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def added(ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``rows`` by ``ids``."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    order = np.argsort(ids, kind="stable")
    sorted_ids = ids[order]
    starts = np.flatnonzero(np.r_[True, sorted_ids[1:] != sorted_ids[:-1]])
    out[sorted_ids[starts]] = np.add.reduceat(rows[order], starts, axis=0)
    return out


class Trainer:
    """Noise-contrastive estimation: tells a text's units from samples of the noise."""

    def __init__(self, model: Bilinear, noise: np.ndarray, seed: int):
        self.model, self.seen = model.filled(model.flat()), 0
        self.squares = [np.full(p.shape, 1e-6, np.float32) for p in self.model.parameters()]
        self.rng, self.sums, self.log_noise = np.random.default_rng(seed), np.cumsum(noise), np.log(noise * NOISE).astype(np.float32)

    def gradients(self, unit: np.ndarray, one: np.ndarray, two: np.ndarray, sample: np.ndarray) -> list[np.ndarray]:
        """Of the mean log-likelihood of telling ``unit`` from ``sample`` after ``one`` (the unit before) and ``two``."""
        m, n = self.model, len(unit)
        c1, c2 = m.context[one], m.context[two]
        h = c1 * m.places[0] + c2 * m.places[1]
        t, noise = m.target[unit], m.target[sample]
        real = (1 - sigmoid(np.einsum("ij,ij->i", h, t) + m.bias[unit] - self.log_noise[unit])) / n
        fake = -sigmoid(h @ noise.T + m.bias[sample] - self.log_noise[sample]) / n
        dh = real[:, None] * t + fake @ noise
        target, bias = added(unit, real[:, None] * h, UNITS), np.bincount(unit, real, UNITS).astype(np.float32)
        np.add.at(target, sample, fake.T @ h)
        np.add.at(bias, sample, fake.sum(axis=0))
        context = added(one, dh * m.places[0], UNITS + 1) + added(two, dh * m.places[1], UNITS + 1)
        return [context, target, bias, np.stack([(dh * c1).sum(axis=0), (dh * c2).sum(axis=0)])]

    def learn(self, unit: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        for at in range(0, len(unit), STEP):
            part = slice(at, at + STEP)
            sample = np.minimum(np.searchsorted(self.sums, self.rng.random(NOISE) * self.sums[-1]), UNITS - 1)
            for p, g, squares in zip(self.model.parameters(), self.gradients(unit[part], one[part], two[part], sample), self.squares):
                squares += g * g
                p += RATE * g / np.sqrt(squares)
        self.seen += len(unit)


@dataclass
class Vocabulary:
    """Counts of the frequent words; ``total`` tokens and ``distinct`` ones of the
    whole training corpus; ``mass`` is each unit's sum of (c + 1), plus one."""

    names: list[bytes]
    counts: np.ndarray
    units: np.ndarray
    mass: np.ndarray
    total: int
    distinct: int

    def noise(self) -> np.ndarray:
        return self.mass / self.mass.sum()


def streams(texts: list[bytes | None], place: dict[bytes, int], units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
    """Tokens of some texts in a row: place in the table (-1: not there), unit,
    and number of tokens per text; and each text's words that are not in the table."""
    ids, sizes, others, ends = [], [], [], place.get(END, -1)
    for text in texts:
        own = words(text)
        found = list(map(place.get, own, repeat(-1)))
        others.append([w for w, i in zip(own, found) if i < 0] if -1 in found else [])
        ids += found
        ids.append(ends)
        sizes.append(len(own) + 1)
    table = np.array(ids, np.int64)
    unit = np.where(table >= 0, units[table] if len(units) else 0, 0)
    missing = np.fromiter((ending(w) for own in others for w in own), np.int64)
    sizes = np.array(sizes, np.int64)
    is_end = np.zeros(len(table), bool)
    is_end[np.cumsum(sizes) - 1] = True
    unit[(table < 0) & ~is_end] = missing
    return table, unit, sizes, others


def contexts(unit: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The unit before each token, and the one before that."""
    place = np.arange(len(unit)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    one, two = np.roll(unit, 1), np.roll(unit, 2)
    one[place < 1], two[place < 2] = UNITS, UNITS
    return one, two


# ---- on the cluster ----------------------------------------------------------


def parcels(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows, a bounded number of bytes of text at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        share = np.cumsum(sizes, dtype=np.int64) // PARCEL
        cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for rows in parcels(batches):
        texts = rows.column(0).to_pylist()
        held[END] += len(texts)
        for text in texts:
            held.update(words(text))
            if len(held) > HELD:
                yield batch()
                held.clear()
    yield batch()


def fit_vocabulary(counts: DataFrame) -> Vocabulary:
    """From ``counts(word binary, c)`` of the training corpus: sums per class and
    size of count, and the most frequent words, at most ``FREQUENT``, reach the driver."""
    tail = F.crc32(F.expr("substring(word, greatest(1, length(word) - 1), 2)")) % ENDINGS
    # Words by their class, and by the size of their count, in sixteenths of a power of two: as many rows as there are classes and sizes.
    size = F.when(F.length("word") <= LONGEST, F.floor(F.log2("c") * 16)).otherwise(-1).cast("int")
    sums = counts.groupBy(tail.cast("int").alias("tail"), size.alias("size")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    least, listed = None, 0
    for s in sorted({r["size"] for r in sums if r["size"] >= 0}, reverse=True):
        listed += sum(r["n"] for r in sums if r["size"] == s)
        if listed > FREQUENT:
            break
        least = s
    # Whole sizes only, so that no sort over all words has to find the last one.
    top = counts.where(F.lit(False) if least is None else size >= least).toArrow()
    pairs = sorted(zip((-int(c) for c in top.column("c").to_pylist()), (bytes(w) for w in top.column("word").to_pylist())))
    names, c = [w for _, w in pairs], np.array([-minus for minus, _ in pairs], np.int64)
    if END not in names and sums:  # the end is counted once a text, so some words may be more frequent
        names.append(END)
        c = np.append(c, counts.where(F.length("word") == 0).first()["c"])
    units = np.array([ending(w) for w in names], np.int64)
    mass = np.ones(UNITS)
    mass[:1 + OWN] = 1e-9  # units without a word; only classes keep room for unseen ones
    for r in sums:
        mass[1 + OWN + r["tail"]] += r["c"] + r["n"]
    free = 1
    for i, w in enumerate(names):
        if w == END or free <= OWN:
            mass[units[i]] -= c[i] + 1
            units[i], free = (0, free) if w == END else (free, free + 1)
            mass[units[i]] = c[i] + 1
    return Vocabulary(names, c, units, mass, sum(r["c"] for r in sums), sum(r["n"] for r in sums))


def train(texts: DataFrame, vocabulary, model: Bilinear, seed: int) -> Bilinear:
    """One round over ``texts`` (``text binary``): a copy per task, averaged by tokens."""

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        place = {w: i for i, w in enumerate(v.names)}
        trainer = Trainer(model, v.noise(), seed)
        for rows in parcels(batches):
            _, unit, sizes, _ = streams(rows.column(0).to_pylist(), place, v.units)
            trainer.learn(unit, *contexts(unit, sizes))
        if trainer.seen:
            flat = trainer.model.flat() * trainer.seen
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(flat)), pa.int64()), pa.array(np.append(float(trainer.seen), flat), pa.float64())], names=["place", "value"])

    averaged = texts.mapInArrow(copies, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow().sort_by("place")
    values = averaged.column("value").to_numpy()
    return model.filled(values[1:] / values[0]) if len(values) else model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "lm"):
    """``(counts, vocabulary, model)`` of the documents that are not held out;
    ``counts`` is a table, the vocabulary is broadcast."""
    spark = docs.sparkSession
    ship(spark)
    learned = docs.where(~held_out(id_col)).select(F.col(text_col).cast("binary").alias("text"), (F.xxhash64(F.lit("round"), F.col(id_col), F.length(text_col)) % FIRST == 0).alias("first"))
    counts = stored(learned.select("text").mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), f"{name}_counts")
    vocabulary = fit_vocabulary(counts)
    shared = spark.sparkContext.broadcast(vocabulary)
    model = Bilinear.start(vocabulary.noise())
    for seed, turn in enumerate((F.col("first"), ~F.col("first"))):
        model = train(learned.where(turn).select("text"), shared, model, seed)
    return counts, shared, model


SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, others array<struct<word:binary,n:long>>"


def score(docs: DataFrame, fitted=None, id_col: str = "doc_id", text_col: str = "text", name: str = "lm") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``
    by a model that :func:`fit` made (default: from ``docs`` itself)."""
    spark = docs.sparkSession
    counts, shared, model = fitted or fit(docs, id_col, text_col, name)
    v = shared.value
    tables = spark.sparkContext.broadcast((*model.tables(), model.bias))
    base_log = float(np.log10(v.total + v.distinct + 1))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        place = {w: i for i, w in enumerate(own.names)}
        (parts, log_z, bias), log_mass = tables.value, np.log10(own.mass)
        log_counts = np.append(np.log10(own.counts + 1.0), 0.0)  # the last for words that the table lacks
        for rows in parcels(batches):
            texts = rows.column("text").to_pylist()
            table, unit, sizes, others = streams(texts, place, own.units)
            starts = np.cumsum(sizes) - sizes
            if len(own.names) and len(table):
                one, two = contexts(unit, sizes)
                c = log_counts[table]
                chance = (parts[0][one, unit] + parts[1][two, unit] + bias[unit] - log_z[one, two]) / _LOG10 + c - log_mass[unit]
                base, total, known = (np.add.reduceat(x, starts) for x in (c - base_log, chance.astype(np.float64), (table >= 0).astype(np.int64)))
            else:
                base, total, known = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
                others = [[] for _ in texts]
            rest = [[{"word": w, "n": n} for w, n in Counter(o).items()] for o in others]
            yield pa.RecordBatch.from_arrays(
                [rows.column("row"), rows.column("doc_id"), rows.column("held_out"), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(total, pa.float64()),
                 pa.array(rest, pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))],
                names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "others"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    texts = stored(numbered.mapInArrow(scored, SCORED), f"{name}_scored")
    asked = texts.select("row", F.inline("others")).join(counts, "word", "left")
    more = asked.groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("seen"), F.sum(F.col("n") * F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(1.0))).alias("more"))
    extra = F.coalesce("more", F.lit(0.0))
    return texts.drop("others").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(int(v.total)).cast("long").alias("train_tokens"),
        (F.col("base") + extra).alias("base_score"), (F.col("score") + extra).alias("score"))
