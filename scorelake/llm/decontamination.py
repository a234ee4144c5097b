"""Benchmark decontamination: one Aho-Corasick automaton, each text read once.

Texts and items are normalised alike (A-Z lower-cased, then words of letters,
digits and everything outside ASCII). The automaton holds every window of ten
consecutive item words (a shorter item is one window), each with a space on
either side, so a match always covers whole words. Matches in the normalised
text are mapped to word numbers, and those to places in the original.

The items are read by the driver in blocks of at most ``BLOCK_BYTES`` of text,
one automaton a block and usually one in all; a text is scanned once per block.

Cases: null, empty and wordless texts have no words and no hits; items without
words, or null, match nothing; items that share an id count as one; windows of
an item with a null id count as hits but name no item; a word covered by
several windows is one hit; repeated rows are judged each; without items or
documents the result is empty of hits or rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import ship

WINDOW = 10
#: Item text in one automaton, which takes some 400 bytes of memory for each byte of it.
BLOCK_BYTES = 500_000
#: Bytes of words as they are (A-Z lower-cased); all others become spaces.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: The same words, in a text that isn't normalised.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_AUTOMATA: dict[str, Automaton] = {}


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


class Automaton:
    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int):
        import ahocorasick

        patterns: dict[str, tuple[int, set[str]]] = {}
        for item, text in items:
            own = words(text)
            for i in range(max(1, len(own) - window + 1) if own else 0):
                part = own[i:i + window]
                length, names = patterns.setdefault(f" {b' '.join(part).decode('latin-1')} ", (len(part), set()))
                if item is not None:
                    names.add(item)
        self.machine = ahocorasick.Automaton()
        for pattern, (length, names) in patterns.items():
            self.machine.add_word(pattern, (length, names))
        if patterns:
            self.machine.make_automaton()
        self.empty = not patterns

    def scan(self, own: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges that windows cover, joined and in order, and the items they are of."""
        if self.empty or not own:
            return [], set()
        text = f" {b' '.join(own).decode('latin-1')} "
        ends, found, names = None, [], set()
        for end, (length, of) in self.machine.iter(text):
            if ends is None:  # place of the space after each word
                ends = np.cumsum([len(w) + 1 for w in own])
            last = int(np.searchsorted(ends, end)) + 1
            names |= of
            found.append((last - length, last))
        return joined(found), names


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str | None, bytes | None]]]:
    """The items, each whole, in blocks that one automaton can hold."""
    block, size = [], 0
    for row in items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t")).toLocalIterator():
        if block and size + len(row["t"] or b"") > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row["i"], bytes(row["t"]) if row["t"] is not None else None))
        size += len(row["t"] or b"")
    yield block


HITS = "n_words long, spans array<struct<first:long,last:long,start:long,end:long>>, items array<string>"


def hits(text: Column, block: list[tuple[str | None, bytes | None]], window: int = WINDOW) -> Column:
    """Words, hit ranges (word numbers and code points, ends exclusive) and item ids of a text."""
    key = hashlib.sha256(repr((block, window)).encode()).hexdigest()

    @F.pandas_udf(HITS)
    def udf(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if key not in _AUTOMATA:
            _AUTOMATA.clear()
            _AUTOMATA[key] = Automaton(block, window)
        automaton = _AUTOMATA[key]
        for part in texts:
            out = []
            for raw in part:
                own = words(raw)
                ranges, names = automaton.scan(own)
                spans = []
                if ranges:
                    places = [m.span() for m in WORD.finditer(raw.decode())]
                    spans = [{"first": a, "last": b, "start": places[a][0], "end": places[b - 1][1]} for a, b in ranges]
                out.append((len(own), spans, sorted(names)))
            yield pd.DataFrame(out, columns=["n_words", "spans", "items"])

    return udf.asNondeterministic()(text.cast("binary"))


def find(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
         window: int = WINDOW, into: str = "hits") -> DataFrame:
    """``docs`` with a column ``into``: ``n_words``, ``spans`` (joined, first to last) and ``items`` (sorted)."""
    ship(docs.sparkSession)
    blocks = list(item_blocks(items, item_id, item_text))
    found = [hits(F.col(text_col), block, window) for block in blocks]
    if len(found) == 1:
        return docs.withColumn(into, found[0])
    out = docs.withColumn(into, F.array(*found))
    spans = F.array_sort(F.flatten(F.col(f"{into}.spans")))
    empty = F.slice(spans, 1, 0)
    merged = F.aggregate(spans, empty, lambda done, s: F.when(
        (F.size(done) > 0) & (s["first"] <= F.element_at(done, -1)["last"]),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            F.element_at(done, -1)["first"].alias("first"), F.greatest(s["last"], F.element_at(done, -1)["last"]).alias("last"),
            F.element_at(done, -1)["start"].alias("start"), F.greatest(s["end"], F.element_at(done, -1)["end"]).alias("end")))),
    ).otherwise(F.concat(done, F.array(s))))
    return out.withColumn(into, F.struct(
        F.col(into)[0]["n_words"].alias("n_words"),
        F.when(F.size(spans) > 0, merged).otherwise(spans).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.col(f"{into}.items")))).alias("items")))


def report(found: DataFrame, id_col: str = "doc_id", into: str = "hits") -> DataFrame:
    """Counts per document, from the column that ``find`` adds."""
    n_hit = F.aggregate(F.col(f"{into}.spans"), F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select(
        F.col(id_col).alias("doc_id"), F.col(f"{into}.n_words").alias("n_words"), n_hit.alias("n_hit"),
        F.size(f"{into}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{into}.items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
