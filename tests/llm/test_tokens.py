"""Token store and packing: ids against the library, exact round trips, full windows."""

import os
import random
import subprocess
import sys
import zlib
from collections import defaultdict

import numpy as np
import pytest

from conftest import SF_SMALL
from scorelake.llm import packing, token_store, tokens
from scorelake.llm.queries import op9_token_store, op10_packing
from scorelake.llm.tokens import default_vocabulary


class Untouched:
    """The library as it comes."""

    def __init__(self, path):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)

    def ids(self, text):
        return self.library.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def library():
    return Untouched(default_vocabulary())


def ids_of(library, text, end):
    return [*library.ids(text), end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


PARTS = ["a", "b", " ", "  ", "\n", "\n\n", " \n", "é", "Ω", "1", "23", ".", "'s", "'", "\t", "\x1c", "\xa0", "　", "😀", "<|endoftext|>", "<|end", "oftext|>", "word", "中", "\x00", "ﬁ", "ª", "²", "\r\n", "!!", "it's", " the", "the."]


def test_words_give_the_ids_of_the_whole_text(library, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    texts += [None, "", "<|endoftext|>", " <|endoftext|> ", "a<|endoftext|>", "<|endoftext|>a", "x <|endoftext|> y", "word<|endoftext|>word", "the " * 50_000]
    for forget in (tokens.MOST_WORDS, 50):
        monkeypatch.setattr(tokens, "MOST_WORDS", forget)
        monkeypatch.setattr(tokens, "PARCEL", 3000)
        own = tokens.Encoder(default_vocabulary())
        for _ in range(2):  # the second time by what it remembers
            for text, ids in zip(texts, own.encode_all(texts)):
                assert ids.tolist() == library.ids(text), text
    assert own.encode("x <|endoftext|> y") == np.array(library.ids("x <|endoftext|> y"), "<u4").tobytes()
    assert 50256 in library.ids("x <|endoftext|> y")


@pytest.mark.parametrize("change", [{"add_prefix_space": True}, {"normalizer": {"type": "Lowercase"}}, {"dropout": None, "end_of_word_suffix": "</w>"}, {"truncation": {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}}])
def test_other_settings_go_to_the_library_whole(change, tmp_path):
    import json

    with open(default_vocabulary(), encoding="utf-8") as f:
        settings = json.load(f)
    for key, value in change.items():
        place = settings["pre_tokenizer"] if key == "add_prefix_space" else settings["model"] if key in ("dropout", "end_of_word_suffix") else settings
        place[key] = value
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(settings, f)
    own, library_ = tokens.Encoder(path), Untouched(path)
    assert not own.safe
    texts = ["The Word IS here", "two  spaces", "line\nend", "", "A <|endoftext|> b"]
    assert [x.tolist() for x in own.encode_all(texts)] == [library_.ids(t) for t in texts]


def test_code_lengths_are_optimal_and_bounded():
    rng = random.Random(1)
    for n in (1, 2, 3, 5, 30):
        counts = {i * 3: rng.choice([1, 2, 50, 1000, 10**6]) for i in range(n)}
        lengths = token_store.code_lengths(counts)
        assert sum(2.0 ** -int(x) for x in lengths if x) <= 1
        if n > 2:  # as short as Huffman's, which needs no more than 16 bits here
            heap = sorted(counts.values())
            cost = 0
            while len(heap) > 1:
                heap.sort()
                cost += heap[0] + heap[1]
                heap[:2] = [heap[0] + heap[1]]
            assert sum(counts[i] * int(lengths[i]) for i in counts) == cost
    many = token_store.code_lengths({i: 1 + i % 3 for i in range(70_000)})  # more ids than 16 bits have codes for
    assert many.max() == 17 and sum(2.0 ** -int(x) for x in many) <= 1
    steep = token_store.code_lengths({i: 2**i for i in range(40)})
    assert steep.max() == 16 and sum(2.0 ** -int(x) for x in steep if x) <= 1


@pytest.mark.parametrize("n", [1, 5, 511, 512, 513, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 50_257).astype(np.uint32)
    lengths = token_store.code_lengths(dict(zip(*(x.tolist() for x in np.unique(ids, return_counts=True)))))
    bits, checkpoints = token_store.pack_bits(ids, token_store.canonical_codes(lengths), lengths)
    assert np.array_equal(token_store.unpack_bits(bits, checkpoints, n, token_store.decoding_table(lengths)), ids)


def test_more_than_65536_ids_round_trip():
    ids = np.random.default_rng(1).permutation(70_000).astype(np.uint32)
    lengths = token_store.code_lengths(dict.fromkeys(ids.tolist(), 1))
    bits, checkpoints = token_store.pack_bits(ids, token_store.canonical_codes(lengths), lengths)
    assert np.array_equal(token_store.unpack_bits(bits, checkpoints, len(ids), token_store.decoding_table(lengths)), ids)


READER = """
import sys
sys.path.insert(0, {repo!r})
from scorelake.llm import token_store
from scorelake.session import local_session
spark = local_session(1, "reader", 2)
for r in token_store.read_store(spark, {path!r}).orderBy("start").collect():
    print("ROW", r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], len(r["ids"]))
"""


def test_a_store_is_read_by_another_process(spark, edge_docs):
    path = token_store.write_store(edge_docs)
    here = token_store.read_store(spark, path).orderBy("start").collect()
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    said = subprocess.run([sys.executable, "-c", READER.format(repo=repo, path=path)], capture_output=True, text=True, timeout=300, env={**os.environ, "SCORELAKE_DRIVER_MEMORY": "1g"}).stdout
    rows = [line.split()[1:] for line in said.splitlines() if line.startswith("ROW")]
    assert rows == [[str(x) for x in (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], len(r["ids"]))] for r in here] and rows


def test_equal_rows_are_dealt_to_several_tasks(spark, library, monkeypatch):
    monkeypatch.setattr(token_store, "TASK_IDS", 100)
    rows = [(5, "the same text again and again")] * 400 + [(1, "x"), (9, None)]
    path = token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert token_store.open_store(spark, path)[0].select("part").distinct().count() > 6
    check_store(library, rows, store_rows(token_store.read_store(spark, path)))


def store_rows(df):
    return sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in df.collect()), key=lambda r: r[1])


def check_store(library, rows, found):
    assert sorted((i, len(ids), crc(ids)) for i, t in rows for ids in [ids_of(library, t, 0)] if i is not None) == sorted((i, n, c) for i, _, n, c in found if i is not None)
    assert len(found) == len(rows)
    at = 0
    for _, start, n, _ in found:
        assert start == at
        at += n
    order = [(-1 if i is None else i) for i, *_ in found]
    assert order == sorted(order)


def test_store_of_edge_rows(edge_docs, library, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    monkeypatch.setattr(token_store, "BLOCK_IDS", 300)
    blocks, lengths = token_store.encode_documents(edge_docs)
    out = token_store.decode_blocks(blocks, lengths).cache()
    check_store(library, rows, store_rows(out))
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["n_tokens"] for r in out.collect())


def test_empty_store(no_docs):
    blocks, lengths = token_store.encode_documents(no_docs)
    assert token_store.decode_blocks(blocks, lengths).collect() == []


def test_store_of_the_small_table(spark, library):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    check_store(library, rows, store_rows(op9_token_store(spark, SF_SMALL)))


def check_pieces(library, rows, pieces, window=2048):
    windows, total = defaultdict(list), 0
    for r in pieces:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        total += r["length"]
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= window
    cut = defaultdict(list)
    for i, text in rows:
        ids = ids_of(library, text, 1)
        for start in range(0, len(ids), window):
            part = ids[start:start + window]
            cut[i].append((start, len(part), crc(part), len(ids)))
    found = defaultdict(list)
    for r in pieces:
        found[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    assert {k: sorted(v) for k, v in cut.items()} == {k: sorted(v) for k, v in found.items()}
    return total / (len(windows) * window) if windows else 1.0


def test_pieces_of_edge_rows(edge_docs, library):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    check_pieces(library, rows, packing.pack(edge_docs).collect())
    check_pieces(library, rows, packing.pack(edge_docs, pieces_per_task=4).collect())


def test_no_pieces(no_docs):
    assert packing.pack(no_docs).collect() == []


def test_pieces_of_the_small_table(spark, library):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert check_pieces(library, rows, op10_packing(spark, SF_SMALL).collect()) > 0.97


def test_best_fit_matches_a_search_of_all_windows():
    rng = random.Random(4)
    for _ in range(30):
        lengths = np.array([rng.randint(1, 64) for _ in range(rng.randint(0, 80))], np.int64)
        numbers, offsets = packing.best_fit_decreasing(lengths, 64)
        rooms = []
        for size in sorted(lengths.tolist(), reverse=True):
            fits = [r for r in rooms if r >= size]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - size)
            else:
                rooms.append(64 - size)
        used = np.bincount(numbers, lengths, minlength=len(rooms)) if len(lengths) else np.zeros(0)
        assert sorted(64 - used) == sorted(rooms)
