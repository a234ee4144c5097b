"""Token ids of whole texts by the tokenizers library, one call per new word.

A text is cut only before white space that follows a character that is not
white space: the byte-level pre-tokenizer always ends a piece there, so the ids
of the parts, joined, are the ids of the whole text. The words of many texts are
numbered by a dictionary encoding, each new one is encoded once per worker, and
the ids of the texts are gathered by number. A text that holds one of the
library's added tokens (``<|endoftext|>``) goes to the library whole, and so does
every text if the vocabulary file's settings are not those that make the cuts safe.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space as the pre-tokenizer's pattern sees it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Letters below U+0100, then signs that are neither letters, digits nor white space.
WORD_AND_SIGNS = re.compile("([A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-/:-@\\[-`{-~]*)")
LETTERS = "^[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+"
ONLY_LETTERS = f"{LETTERS}$"
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: Words that a worker keeps; with more, it starts anew.
MOST_WORDS = 500_000
#: Characters of texts that are taken together (a longer text alone).
PARCEL = 2 << 20
# The settings under which a text may be cut as above.
SAFE_SETTINGS = {
    "normalizer": None, "truncation": None, "padding": None,
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "ignore_merges": False},
}
_ENCODERS: dict[str, Encoder] = {}


def safe_settings(settings: dict) -> bool:
    """Whether a vocabulary file is byte-level BPE without anything that changes or looks across texts."""
    same = lambda wanted, given: all((given or {}).get(k) == v for k, v in wanted.items()) if isinstance(wanted, dict) else given == wanted
    return all(same(wanted, settings.get(key)) for key, wanted in SAFE_SETTINGS.items())


class Encoder:
    """Ids of the pieces seen so far lie in ``flat``, those of piece ``k`` from ``starts[k]`` to ``starts[k + 1]``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        self.safe = safe_settings(settings)
        added = [re.escape(t["content"]) for t in settings.get("added_tokens") or []]
        self.added = re.compile("|".join(added)) if added else None
        if self.safe:
            self.letters = {c: self.library.pre_tokenizer.pre_tokenize_str(chr(c))[0][0] for c in range(256) if chr(c).isalpha()}
            self.space = self.library.pre_tokenizer.pre_tokenize_str(" a")[0][0][:-1]
        self._forget()

    def _forget(self) -> None:
        #: Words after a space (those that begin with a line end: after nothing) and their numbers; pieces after nothing.
        self.spaced, self.spaced_numbers = pa.array([], pa.string()), np.zeros(0, np.int64)
        self.bare: dict[str, int] = {}
        self.flat, self.starts = array("I"), array("q", [0])
        self.open_ended = bytearray()  # 1: white space after the piece is no safe cut

    def plain(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _add(self, ids, open_ended: bool = False) -> int:
        self.flat.extend(ids)
        self.starts.append(len(self.flat))
        self.open_ended.append(open_ended)
        return len(self.starts) - 2

    def _ids(self, k: int) -> array:
        return self.flat[self.starts[k]:self.starts[k + 1]]

    def _letters(self, word: str, before: str) -> list[int]:
        """Ids of letters, which are one piece of the pre-tokenizer, by the model alone."""
        mapped = word if word.isascii() else word.translate(self.letters)
        return [t.id for t in self.model.tokenize(self.space + mapped if before else mapped)]

    def _bare(self, piece: str) -> int:
        k = self.bare.get(piece)
        if k is None:
            k = self.bare[piece] = self._new(piece, "")
        return k

    def _new(self, word: str, before: str) -> int:
        """A piece of any form. Letters and signs after them are two pieces of the
        pre-tokenizer; line ends but the last, that one, and what follows, three."""
        if not before:
            line = word.lstrip("\n")
            if line and len(line) < len(word) and not line[0].isspace():
                parts = [self._ids(self._bare(piece)) for piece in (word[:-len(line) - 1], "\n", line) if piece]
                return self._add(sum(parts, array("I")), line[-1].isspace())
            if found := WORD_AND_SIGNS.fullmatch(word):
                letters, signs = found.groups()
                return self._add(self._ids(self._bare(letters)) + self._ids(self._bare(signs)) if signs else self._letters(letters, ""))
        return self._add(self.plain(before + word), not word or word[-1].isspace())

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """Numbers of words after a space, looked up together; new ones are learned first."""
        at = pc.index_in(words, value_set=self.spaced)
        out = np.asarray(at.fill_null(0)).astype(np.int64)
        if at.null_count:
            missing = at.is_null()
            new, before = words.filter(missing), len(self.spaced)
            distinct = new.unique()
            self._learn(distinct)
            out[np.asarray(missing)] = np.asarray(pc.index_in(new, value_set=distinct)) + before
        return self.spaced_numbers[out]

    def _learn(self, distinct: pa.Array) -> None:
        """Add new words. Letters are encoded once; letters with signs are put together from the ids of both."""
        letters = pc.utf8_rtrim(distinct, characters=SIGNS)
        plain = pc.match_substring_regex(letters, ONLY_LETTERS)
        numbers = np.empty(len(distinct), np.int64)
        others = np.flatnonzero(~np.asarray(plain))
        numbers[others] = [self._new(w, "" if w[:1] == "\n" else " ") for w in distinct.take(pa.array(others)).to_pylist()]
        own, words = letters.filter(plain), distinct.filter(plain)
        every = own.unique()
        at = pc.index_in(every, value_set=self.spaced)
        unknown = at.is_null()
        first = len(self.starts) - 1
        encoded = every.filter(unknown)
        ids = [self._letters(word, " ") for word in encoded.to_pylist()]
        self.starts.frombytes((np.cumsum(list(map(len, ids)), dtype=np.int64) + len(self.flat)).tobytes())
        self.flat.extend(chain.from_iterable(ids))
        self.open_ended.extend(bytes(len(ids)))
        known = np.concatenate([self.spaced_numbers, np.arange(first, len(self.starts) - 1)])
        place = np.asarray(at.fill_null(0)).astype(np.int64)
        place[np.asarray(unknown)] = len(self.spaced) + np.arange(len(encoded))
        part = known[place][np.asarray(pc.index_in(own, value_set=every))]
        signed = np.asarray(pc.not_equal(own, words))
        if signed.any():
            signs = pc.replace_substring_regex(words.filter(pa.array(signed)), LETTERS, "").dictionary_encode()
            second = np.array([self._bare(x) for x in signs.dictionary.to_pylist()], np.int64)[np.asarray(signs.indices)]
            ids, ends = self._gathered(np.stack([part[signed], second], axis=1).ravel())
            part[signed] = len(self.starts) - 1 + np.arange(len(second))
            self.starts.frombytes((ends[1::2] + len(self.flat)).tobytes())
            self.flat.frombytes(ids.tobytes())
            self.open_ended.extend(bytes(len(second)))
        numbers[np.asarray(plain)] = part
        more = pc.index_in(encoded, value_set=distinct).is_null()
        self.spaced = pa.concat_arrays([self.spaced, distinct, encoded.filter(more)])
        self.spaced_numbers = np.concatenate([self.spaced_numbers, numbers, np.arange(first, first + len(encoded))[np.asarray(more)]])

    def _gathered(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces in a row, and the place after each."""
        starts = np.frombuffer(self.starts, np.int64)
        first = starts[numbers]
        sizes = starts[numbers + 1] - first
        ends = np.cumsum(sizes)
        at = np.repeat(first - (ends - sizes), sizes)
        at += np.arange(len(at))
        return (np.frombuffer(self.flat, np.uint32)[at] if len(at) else np.zeros(0, np.uint32)), ends

    def _by_units(self, text: str) -> np.ndarray:
        return self._gathered(np.array([self._bare(unit) for unit in UNIT.findall(text)], np.int64))[0]

    def encode(self, text: str | None) -> bytes:
        """Ids of one text, as little-endian 32-bit bytes."""
        return self.encode_all([text])[0].astype("<u4").tobytes()

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; none for a null."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= PARCEL):
                size += len(texts[end] or "")
                end += 1
            out += self._parcel(texts[at:end])
            at = end
        return out

    def _parcel(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.starts) > MOST_WORDS:
            self._forget()
        apart = {i for i, t in enumerate(texts) if t and (not self.safe or (self.added and self.added.search(t)))}
        if not self.safe:
            return [np.array(self.plain(t) if t else [], np.uint32) for t in texts]
        # A word after line ends keeps them; the space that is put before them parts it from the line before.
        split = pc.replace_substring_regex(pa.array(["" if t is None or i in apart else t for i, t in enumerate(texts)], pa.string()), "(\n+)", " \\1")
        parts = pc.split_pattern(split, " ")
        words, offsets = parts.values, np.asarray(parts.offsets)
        firsts, lasts = offsets[:-1], offsets[1:] - 1
        numbers = self._numbers(words)
        # A space is a safe cut if the word before it ends with something else.
        open_ended = np.frombuffer(bytes(self.open_ended), np.uint8)[numbers]
        open_ended[lasts] = 0
        unsafe = np.maximum.reduceat(open_ended, firsts)
        numbers[firsts] = [self._bare(word) for word in words.take(pa.array(firsts)).to_pylist()]
        ids, ends = self._gathered(numbers)
        before = np.where(firsts > 0, ends[firsts - 1], 0)
        out = [ids[a:b] for a, b in zip(before.tolist(), ends[lasts].tolist())]
        for i, text in enumerate(texts):
            if not text:
                out[i] = ids[:0]
            elif i in apart:
                out[i] = np.array(self.plain(text), np.uint32)
            elif unsafe[i]:
                out[i] = self._by_units(text)
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder for the vocabulary file at ``path``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def id_type(vocabulary: str) -> str:
    """The narrowest little-endian type that holds every id of the vocabulary."""
    return "<u2" if encoder(vocabulary).library.get_vocab_size() <= 1 << 16 else "<u4"
