"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to three characters of the lower-cased text,
everything but letters being one space. Document frequencies come from every
training document. The weights are trained with follow-the-regularised-leader
(per-coordinate rates, L1 and L2), on at most ``SAMPLE`` labelled rows, spread
evenly over the labels; every fifth of them is kept back to fit one
temperature, so that a score is a calibrated probability.

Cases: a null text, or one without a letter, is ``und`` with score 0, and so is
every text when there is nothing to learn from; rows with a null label teach
nothing but are predicted; texts of any length are read whole; equal scores go
to the label that sorts first; repeated rows are predicted each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import ship, slices

UNKNOWN = "und"
BITS = 16
#: Labelled rows that weights and temperature are fitted on, at most (twice that for a lucky hash).
SAMPLE = 4000
#: Labels whose counts are broadcast; more of them are joined by a shuffle.
MOST_LABELS = 50_000
FOLDS = 5
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 1e-3, 1e-3
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a text, ascending, and how often each occurs; none without a letter."""
    none = np.zeros(0, np.int64)
    if not text:
        return none, none
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return none, none
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of each run of other characters
    c = np.where(letter, codes, 32)[keep].astype(np.uint32)
    if letter[0]:
        c = np.concatenate([np.array([32], np.uint32), c])
    a = c * np.uint32(0x9E3779B1)
    b = c[:-1] * np.uint32(0x85EBCA6B) + c[1:] * np.uint32(0xC2B2AE35)
    d = c[:-2] * np.uint32(0x27D4EB2F) + c[1:-1] * np.uint32(0x165667B1) + c[2:] * np.uint32(0xD3A2646D)
    grams = np.concatenate([a, b, d])
    grams ^= grams >> np.uint32(15)
    grams *= np.uint32(0x2C1B3C6D)
    counts = np.bincount(grams >> np.uint32(32 - BITS), minlength=1 << BITS)
    seen = np.flatnonzero(counts)
    return seen, counts[seen]


@dataclass
class Model:
    """``weights`` is (labels, features); everything a prediction needs."""

    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        return weighted(*ngram_counts(text), self.idf)

    def predict(self, text: str | None) -> tuple[str, float]:
        at, x = self.features(text)
        if not len(at) or not self.labels:
            return UNKNOWN, 0.0
        p = softmax((self.weights[:, at] @ x) / self.temperature)
        best = int(np.argmax(p))
        return self.labels[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF, of length one."""
    x = (1 + np.log(np.maximum(counts, 1))) * idf[at]
    length = np.sqrt(x @ x)
    return at, (x / length if length else x).astype(np.float32)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], n_labels: int) -> np.ndarray:
    """Follow the regularised leader over ``(label, features, values)``, in the order given."""
    z, n = np.zeros((n_labels, 1 << BITS)), np.zeros((n_labels, 1 << BITS))

    def active(zs, ns):
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for label, at, x in rows:
            zs, ns = z[:, at], n[:, at]
            w = active(zs, ns)
            p = softmax(w @ x)
            p[label] -= 1
            g = p[:, None] * x[None, :]
            more = ns + g * g
            z[:, at] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / ALPHA * w
            n[:, at] = more
    return active(z, n).astype(np.float32)


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least cross-entropy, by golden section over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    low, high, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(id_col: str) -> Column:
    """Every fifth document by the CRC-32 of its id; rows without an id are never learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, docs = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for part in slices(batch.column(0)):
            for text in part:
                at, _ = ngram_counts(text)
                seen[at] += 1
                docs += len(at) > 0
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(seen[at], docs), pa.int64())], names=["gram", "n"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [ngram_counts(text) for part in slices(batch.column("text")) for text in part]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("h"), pa.array([a.astype("<u2").tobytes() for a, _ in found], pa.binary()), pa.array([c.astype("<u4").tobytes() for _, c in found], pa.binary())], names=["lang", "h", "at", "counts"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Learn from the text and label of labelled rows that are not held out."""
    ship(docs.sparkSession)
    rows = docs.where(~held_out(id_col) & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.xxhash64(id_col, F.lit("sample")).alias("h"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("lang"))
    # At most 2^BITS + 1 sums.
    counted = {r["gram"]: r["n"] for r in rows.select("text").mapInArrow(_frequencies, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    total = counted.pop(-1, 0)
    frequency = np.zeros(1 << BITS)
    frequency[list(counted)] = list(counted.values())
    idf = np.log((1 + total) / (1 + frequency)) + 1
    # One row per label; the sample is dealt evenly over the labels. The counts
    # go to the texts, whose labels are too uneven to be shuffled by them.
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    labels = sizes.count()
    share = F.lit(float(sample) * (1 << 30) / max(1, labels)) / F.col("n")
    joined = rows.join(F.broadcast(sizes) if labels <= MOST_LABELS else sizes, "lang")
    chosen = joined.where(F.pmod("h", F.lit(1 << 30)) < share).select("text", "lang", "h")
    found = chosen.mapInArrow(_sampled, "lang string, h long, at binary, counts binary").orderBy("h", "lang", "at").limit(2 * sample).collect()
    data = [(r["lang"], *weighted(np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["counts"], "<u4"), idf)) for r in found if r["at"]]
    names = sorted({lang for lang, *_ in data})
    coded = [(names.index(lang), at, x) for lang, at, x in data]
    kept_back = coded[::FOLDS] if len(coded) >= 50 else []
    weights = train([c for i, c in enumerate(coded) if not kept_back or i % FOLDS], len(names)) if names else np.zeros((0, 1 << BITS), np.float32)
    logits = np.array([weights[:, at] @ x for _, at, x in kept_back])
    return Model(names, idf, weights, best_temperature(logits, np.array([c[0] for c in kept_back])))


def predictions(text: Column, model) -> Column:
    """``struct<lang_pred, score>`` from a broadcast ``Model``."""

    @F.arrow_udf("lang_pred string, score double")
    def udf(texts: pa.Array) -> pa.Array:
        found = [model.value.predict(t) for part in slices(texts) for t in part]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["lang_pred", "score"])

    return udf.asNondeterministic()(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", into: str = "language") -> DataFrame:
    """``docs`` with a column ``into`` of predictions by a model fitted on ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, label_col))
    return docs.withColumn(into, predictions(F.col(text_col), model))
