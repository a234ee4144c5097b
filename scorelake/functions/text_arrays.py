"""Both normalisers over the characters of many texts at a time.

The same steps as :mod:`scorelake.functions.text`, for texts that go on to the
alignment in Arrow batches: the characters of a batch lie in one array, a table
says of each what it is (whitespace, punctuation or symbol, mark) and what its
lowercase is, and words and letters are counted and joined by array operations.
Steps that look at neighbouring characters (composition, control tokens,
brackets, lowercase that depends on its place) are Python's string functions,
and run only for texts with a character that such a step could change.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from scorelake.functions.text import DECOMPOSED_DOTTED_I, TURKISH_LOWER, TURKISH_UPPER, WHISPER_BRACKETED, WHISPER_PARENTHESISED

# What a character is: known to the table, and whitespace, punctuation or symbol, mark, or one that some step could take with its neighbours.
KNOWN, SPACE, PUNCTUATION, MARK, SPECIAL = 1, 2, 4, 8, 16
#: Below this code point, texts are composed already.
COMPOSED = 0x300
_CONTROL_TOKEN, _BRACKETED, _PARENTHESISED = re.compile(r"<[^<>\s]+>"), re.compile(WHISPER_BRACKETED), re.compile(WHISPER_PARENTHESISED)
_KIND = np.zeros(0x110000, np.uint8)
_TURKISH, _ROOT = np.arange(0x110000, dtype=np.uint32), np.arange(0x110000, dtype=np.uint32)


def _learn(points: np.ndarray) -> None:
    """Enter characters in the tables. Every character from ``COMPOSED`` on is special, as are those that have
    more than one lowercase character or another compatibility form, and opening brackets."""
    for point in points.tolist():
        c = chr(point)
        category = unicodedata.category(c)[0] if not 0xD800 <= point < 0xE000 else "C"
        special = point >= COMPOSED or c in "<[(" or len(root_lower(c)) > 1 or unicodedata.normalize("NFKC", root_lower(c)) != root_lower(c)
        _KIND[point] = KNOWN | SPACE * c.isspace() | PUNCTUATION * (category in "PS") | MARK * (category == "M") | SPECIAL * special
        for table, lower in ((_TURKISH, turkish_lower(c)), (_ROOT, root_lower(c))):
            table[point] = ord(lower) if len(lower) == 1 else point


def kinds(points: np.ndarray) -> np.ndarray:
    found = _KIND[points]
    if not found.all():
        _learn(np.unique(points[found == 0]))
        found = _KIND[points]
    return found


def turkish_lower(text: str) -> str:
    for upper, lower in zip(TURKISH_UPPER, TURKISH_LOWER):
        text = text.replace(upper, lower)
    return text.lower()


def root_lower(text: str) -> str:
    return text.lower()


def cleaned(text: str) -> str:
    """C4 of one text."""
    text = unicodedata.normalize("NFC", text)
    return (_CONTROL_TOKEN.sub(" ", text) if "<" in text else text).replace(DECOMPOSED_DOTTED_I, "i")


def whisper_prepared(clean: str) -> str:
    """C9 of one text, up to its compatibility form."""
    text = root_lower(clean)
    if "<" in text or "[" in text:
        text = _BRACKETED.sub("", text)
    return unicodedata.normalize("NFKC", _PARENTHESISED.sub("", text) if "(" in text else text)


def points_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters in one array, and how many each text has."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, texts), np.int64, len(texts))


def decoded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """:func:`points_of` of an Arrow array without nulls; bytes that are no UTF-8 become U+FFFD."""
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    try:
        points = np.frombuffer(str(memoryview(texts.buffers()[2] or b"")[bounds[0]:bounds[-1]], "utf-8").encode("utf-32-le"), np.uint32)
        return points, pc.utf8_length(texts.cast(pa.large_string())).to_numpy().astype(np.int64)
    except (UnicodeDecodeError, pa.ArrowInvalid):
        return points_of([t.decode("utf-8", "replace") for t in texts.to_pylist()])


@dataclass
class Normalised:
    """Texts of words with single spaces between: all characters in one array, and the texts' and words' bounds."""

    points: np.ndarray
    chars: np.ndarray
    letters: np.ndarray
    word_bounds: np.ndarray
    words: np.ndarray

    @classmethod
    def of(cls, letters: np.ndarray, ends: np.ndarray, start: np.ndarray) -> Normalised:
        """Texts of these letters, each up to its end; a word begins where ``start`` says so, and with a text."""
        first = np.append(0, ends[:-1])
        start[first[first < ends]] = True
        begun = np.cumsum(start, dtype=np.int32)
        word_starts = np.flatnonzero(start)
        words = np.diff(np.append(0, begun)[ends], prepend=0).astype(np.int64)
        spaces = np.maximum(words - 1, 0)
        # A letter moves by the spaces before it: a word's own, but for the words that begin a text.
        place = np.arange(len(letters), dtype=np.int32) + begun
        place -= np.repeat(np.cumsum(words > 0, dtype=np.int32), ends - first)
        out = np.full(len(letters) + int(spaces.sum()), 32, np.uint32)
        out[place] = letters
        return cls(out, ends - first + spaces, letters, np.append(word_starts, len(letters)), words)

    @classmethod
    def joined(cls, parts: list[Normalised], order: np.ndarray) -> Normalised:
        """The texts of all parts; text i of the result is text ``order[i]`` of them in turn."""
        if len(parts) == 1:
            return parts[0]
        letters = np.concatenate([p.letters for p in parts])
        bounds = np.concatenate([parts[0].word_bounds[:-1], *[p.word_bounds[:-1] + sum(len(q.letters) for q in parts[:i]) for i, p in enumerate(parts) if i], [len(letters)]])
        points, chars, words = (np.concatenate([getattr(p, name) for p in parts]) for name in ("points", "chars", "words"))
        word_order = _ranges(np.cumsum(words) - words, words, order)
        sizes = np.diff(bounds)
        return cls(points[_ranges(np.cumsum(chars) - chars, chars, order)], chars[order], letters[_ranges(bounds[:-1], sizes, word_order)],
                   np.append(0, np.cumsum(sizes[word_order])), words[order])

    def strings(self) -> pa.Array:
        """The texts as bytes, four for each character."""
        return _binary(self.points, np.append(0, np.cumsum(self.chars)))

    def word_strings(self, kind: type) -> pa.Array:
        """The words as bytes, as many for each character as ``kind`` has."""
        return _binary(self.letters.astype(kind), self.word_bounds)


def _ranges(starts: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The places of ranges, one after the other in this order."""
    starts, sizes = starts[order], sizes[order]
    return np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _binary(points: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds * points.itemsize, np.int64)), pa.py_buffer(np.ascontiguousarray(points))])


def normalised(texts: pa.Array) -> tuple[Normalised, Normalised]:
    """C8 and C9 of texts (an Arrow array without nulls)."""
    points, sizes = decoded(texts)
    kind = kinds(points)
    ends = np.cumsum(sizes)
    special = np.flatnonzero(kind & SPECIAL)
    odd = np.zeros(len(sizes), bool)
    odd[np.searchsorted(ends, special, side="right")] = True
    if not odd.any():
        return _both(points, sizes, kind)
    plain, places = np.flatnonzero(~odd), np.flatnonzero(odd)
    order = np.empty(len(sizes), np.int64)
    order[plain], order[places] = np.arange(len(plain)), len(plain) + np.arange(len(places))
    own = [cleaned(points[e - n:e].tobytes().decode("utf-32-le", "surrogatepass")) for e, n in zip(ends[odd].tolist(), sizes[odd].tolist())]
    rest = _ranges(ends - sizes, sizes, plain)
    primary, whisper = _both(points[rest], sizes[plain], kind[rest])
    return (Normalised.joined([primary, _primary(*points_of([turkish_lower(t) for t in own]))], order),
            Normalised.joined([whisper, _whisper([whisper_prepared(t) for t in own])], order))


def _letters(points: np.ndarray, sizes: np.ndarray, kind: np.ndarray, left_out: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of the characters that are not ``left_out``, these characters, and how many there are up to each text's end."""
    kept = np.flatnonzero((kind & left_out) == 0)
    return kept, points[kept].astype(np.intp), np.searchsorted(kept, np.cumsum(sizes))


def _spaced(kept: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where whitespace was between a letter and the one before."""
    before = np.cumsum((kind & SPACE) != 0, dtype=np.int32)[kept]
    return np.append(True, before[1:] != before[:-1])[:len(kept)]


def _apart(kept: np.ndarray) -> np.ndarray:
    """Where anything was between a letter and the one before."""
    return np.append(True, np.diff(kept) > 1)[:len(kept)]


def _both(points: np.ndarray, sizes: np.ndarray, kind: np.ndarray) -> tuple[Normalised, Normalised]:
    """Texts without special characters, so without marks: both normalisers keep the same letters, but part words differently."""
    kept, letters, ends = _letters(points, sizes, kind, SPACE | PUNCTUATION)
    return Normalised.of(_TURKISH.take(letters), ends, _spaced(kept, kind)), Normalised.of(_ROOT.take(letters), ends, _apart(kept))


def _primary(points: np.ndarray, sizes: np.ndarray) -> Normalised:
    """Texts in lowercase: only their punctuation and whitespace are left to see to."""
    kind = kinds(points)
    kept, letters, ends = _letters(points, sizes, kind, SPACE | PUNCTUATION)
    return Normalised.of(letters.astype(np.uint32), ends, _spaced(kept, kind))


def _whisper(prepared: list[str]) -> Normalised:
    """Prepared texts. The compatibility form may bring capitals back, whose lowercase may depend on what stands beside
    them after the marks have gone; there, the last steps are done on the string, and no mark of its lowercase is seen to."""
    done = [t.lower() != t for t in prepared]
    texts = [_finished(t) if d else t for t, d in zip(prepared, done)]
    points, sizes = points_of(texts)
    kind = kinds(points)
    if any(done):
        kind = np.where(np.repeat(done, sizes), kind & (KNOWN | SPACE), kind)
    kept, letters, ends = _letters(points, sizes, kind, SPACE | PUNCTUATION | MARK)
    return Normalised.of(letters.astype(np.uint32), ends, _apart(kept))


def _finished(text: str) -> str:
    return root_lower(" ".join("".join(" " if unicodedata.category(c)[0] in "MSP" else c for c in text).split()))
