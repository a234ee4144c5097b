"""Exact edit distances, bit-parallel, in linear space.

A column of the dynamic program is two bits per row (whether a cell is one more,
or one less, than the cell above), and a column follows from the one before in
some additions and bit operations on many rows at once. Symbols may be words as
well as characters, so there is no limit to a pair's vocabulary.

:func:`distances` takes many pairs at a time: rows lie in 64-bit words, and one
numpy operation serves a word of every pair. Only the words that a band about the
diagonals crosses are worked on; a pair whose cost the band does not prove gets a
second one that does. Pairs beyond ``GROUPED`` rows go to :func:`distance` one by
one, whose columns are Python integers that hold only such a band.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.functions.text_arrays import Normalised, normalised

#: Symbols with at least this many places keep their bit mask; others set their bits when they are met.
KEPT_MASK = 8
#: Rows up to which pairs are aligned together.
GROUPED = 6_000
#: Symbols from the front of a long pair that say how unlike it is.
PROBE = 1_500
#: Rows that the first band has beside the diagonals of start and end, and one more for each 64 columns.
BAND = 16
#: 64-bit words of one group's column in the band, and of its table of symbols.
GROUP_WORDS, TABLE_WORDS = 2_048, 1 << 20
#: The values of 32 bits.
BITS = np.ldexp(1.0, np.arange(32))
#: Characters (in Arrow batches, bytes) that are turned to numbers at a time, and rows for which Arrow batches are taken together.
CHUNK_CHARS, CHUNK_ROWS = 3_000_000, 4_000
#: An alphabet of up to so many symbols is a group's own; of a larger one, each pair numbers its part.
SMALL_ALPHABET = 96


def distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Minimal substitutions, deletions and insertions that make ``a`` of ``b``."""
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    end = 0
    while end < len(a) and end < len(b) and a[len(a) - 1 - end] == b[len(b) - 1 - end]:
        end += 1
    a, b = a[:len(a) - end], b[:len(b) - end]
    if len(a) < len(b):  # the longer one is the bits, the shorter one the steps
        a, b = b, a
    if not b:
        return len(a)
    places: dict[Hashable, list[int]] = {}
    for i, symbol in enumerate(a):
        places.setdefault(symbol, []).append(i)
    masks = {symbol: _mask(own, len(a)) for symbol, own in places.items() if len(own) >= KEPT_MASK}
    # A band gives the cost of a real alignment, hence a bound: within the band of that bound lies a best one.
    bound = len(a) - len(b) + max(128, len(b) // 10)
    if len(b) > 8 * PROBE:  # how unlike they are in front says how wide a band to try
        front = a[:PROBE * len(a) // len(b)]
        bound = len(a) - len(b) + 128 + max(0, distance(front, b[:PROBE]) - (len(front) - PROBE)) * len(b) * 5 // (PROBE * 4)
    found = _banded(a, b, places, masks, bound)
    return found if found <= bound else _banded(a, b, places, masks, found)


def _banded(a: Sequence[Hashable], b: Sequence[Hashable], places: dict, masks: dict, bound: int) -> int:
    """The least cost of alignments that stay where one of cost ``bound`` can be.

    Such an alignment passes a cell (i, j) only if |i - j| and the same distance
    from the end make no more than ``bound``. The rows in use move down by steps
    of some columns; above and below them, cells grow by one.
    """
    more_rows = len(a) - len(b)
    half = (bound - more_rows) // 2
    step = max(512, half // 2)
    low, high, top, more, less = 0, 0, 0, 0, 0
    for begin in range(0, len(b), step):
        until = min(len(b), begin + step)
        drop = max(0, begin - half) - low
        if drop > 0:
            gone = (1 << drop) - 1
            top += (more & gone).bit_count() - (less & gone).bit_count()
            more, less, low = more >> drop, less >> drop, low + drop
        grown = min(len(a), until + more_rows + half)
        if grown > high:
            more |= ((1 << (grown - high)) - 1) << (high - low)
            high = grown
        full = (1 << (high - low)) - 1
        here: dict[Hashable, int] = {}
        for symbol in b[begin:until]:
            same = here.get(symbol)
            if same is None:
                if symbol in masks:
                    same = (masks[symbol] >> low) & full
                else:
                    same = 0
                    for i in places.get(symbol, ()):
                        if low <= i < high:
                            same |= 1 << (i - low)
                if symbol in masks or not same:
                    here[symbol] = same
            zero = ((((same & more) + more) ^ more) | same | less) & full
            up, down = less | (full ^ (zero | more)), more & zero
            up, down = ((up << 1) | 1) & full, (down << 1) & full
            more, less = down | (full ^ (zero | up)), up & zero
        top += until - begin
    return top + more.bit_count() - less.bit_count()


def _mask(places: list[int], size: int) -> int:
    bits = bytearray(size // 8 + 1)
    for i in places:
        bits[i >> 3] |= 1 << (i & 7)
    return int.from_bytes(bits, "little")


def distances(pairs: Sequence[tuple[np.ndarray, np.ndarray]], symbols: int) -> np.ndarray:
    """:func:`distance` of each pair of arrays of numbers below ``symbols``."""
    out = np.zeros(len(pairs), np.int64)
    todo = []
    for place, (a, b) in enumerate(pairs):
        a, b = _trimmed(a, b)
        if not len(b):
            out[place] = len(a)
        elif len(a) > GROUPED:
            out[place] = distance(a.tolist(), b.tolist())
        else:
            todo.append((place, a, b, BAND + len(b) // 64))
    used = np.full(len(pairs), symbols)
    if symbols > SMALL_ALPHABET and todo:
        rows, columns, own = _numbered([a for _, a, *_ in todo], [b for *_, b, _ in todo], symbols)
        todo = [(place, a, b, half) for (place, *_, half), a, b in zip(todo, rows, columns)]
        used[[place for place, *_ in todo]] = own
    while todo:
        todo.sort(key=lambda p: (_band_words(len(p[1]) - len(p[2]), p[3]), len(p[2])))
        wider = []
        while todo:
            group, columns, more_rows, half, alphabet = [], 0, 0, 0, 0
            while todo:
                place, a, b, own = todo[-1]
                columns, more_rows, half, alphabet = (max(columns, len(b)), max(more_rows, len(a) - len(b)), max(half, own), max(alphabet, int(used[place])))
                words = -(-(columns + more_rows + half) // 64)
                if group and ((len(group) + 1) * min(words, _band_words(more_rows, half)) > GROUP_WORDS
                              or (len(group) + 1) * words * (alphabet + 2) > TABLE_WORDS):
                    break
                group.append(todo.pop())
            half = max(own for *_, own in group)
            alphabet = max(int(used[place]) for place, *_ in group)
            found = _aligned([a for _, a, *_ in group], [b for *_, b, _ in group], half, alphabet).tolist()
            for (place, a, b, _), cost in zip(group, found):
                # Within the band of a cost that a real alignment has lies a best one.
                if cost <= len(a) - len(b) + 2 * half + 1:
                    out[place] = cost
                else:
                    wider.append((place, a, b, -(-(cost - len(a) + len(b)) // 2)))
        todo = wider
    return out


def _band_words(more_rows: int, half: int) -> int:
    """64-bit words that hold a column's rows from ``half`` above its diagonal to ``half`` below the last one's."""
    return -(-(more_rows + 2 * half) // 64) + 1


def _trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longer one first, without what they begin and end with alike."""
    if len(a) < len(b):
        a, b = b, a
    for _ in range(2):  # from the start, then from the end
        unlike = a[:len(b)] != b
        first = int(unlike.argmax()) if len(b) else 0
        if len(b) and not unlike[first]:
            first = len(b)
        a, b = a[first:][::-1], b[first:][::-1]
    return a, b


def _numbered(rows: list[np.ndarray], columns: list[np.ndarray], symbols: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Each pair's rows by numbers of its own from 0, its columns likewise, -1 for what the rows lack; how many numbers."""
    size, length = np.array([len(r) for r in rows]), np.array([len(c) for c in columns])
    pair = np.arange(len(rows))
    known, row_number = np.unique(np.concatenate(rows) + np.repeat(pair * symbols, size), return_inverse=True)
    first = np.searchsorted(known, pair * symbols)
    asked = np.concatenate(columns) + np.repeat(pair * symbols, length)
    place = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    column_number = np.where(known[place] == asked, place - np.repeat(first, length), -1)
    return (_parts(row_number - np.repeat(first, size), size), _parts(column_number, length), np.diff(np.append(first, len(known))))


def _parts(flat: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum(sizes)
    return [flat[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]


def _aligned(rows: list[np.ndarray], columns: list[np.ndarray], half: int, symbols: int) -> np.ndarray:
    """The least cost, for each pair, of alignments that stay in the band of ``half``.

    All pairs get as many columns as the longest has, by symbols set in front of
    both sides, which changes no distance. ``half`` rows in front are even with
    the top, so the band of 64 columns begins where a word does. In step t, a
    pair's word w is at column t - w, so what leaves a word enters the next one
    in the next step and words do not wait for another; a word is at work while
    the band crosses it. Above the band cells grow by one with each column, below
    it by one with each row.
    """
    pairs = len(rows)
    size, length = np.array([len(r) for r in rows]), np.array([len(c) for c in columns])
    steps, more_rows = int(length.max()), int((size - length).max())
    ends = half + steps + size - length
    words = -(-int(ends.max()) // 64)
    wide = _band_words(more_rows, half)
    before = steps - length
    everyone = np.arange(pairs)
    # Bit masks: table[w, s + 1, k] has a bit for each row of pair k's word w with symbol s; number 0 is no symbol, the last one is set in front.
    own = np.concatenate(rows).astype(np.int64) + 1
    row = np.arange(len(own)) + np.repeat(half + before - np.cumsum(size) + size, size)
    front = np.arange(int(before.sum())) + np.repeat(half - np.cumsum(before) + before, before)
    pair = np.concatenate([np.repeat(everyone, size), np.repeat(everyone, before)])
    own, row = np.concatenate([own, np.full(len(front), symbols + 1)]), np.concatenate([row, front])
    cell = (((row >> 6) * (symbols + 2) + own) * pairs + pair) * 2 + ((row >> 5) & 1)
    halves = np.bincount(cell, weights=BITS[row & 31], minlength=words * (symbols + 2) * pairs * 2)
    table = halves.astype(np.uint32).view(np.uint64)
    heard = np.full((steps, pairs), (symbols + 1) * pairs)
    column = np.arange(int(length.sum())) + np.repeat(before - np.cumsum(length) + length, length)
    heard[column, np.repeat(everyone, length)] = (np.concatenate(columns).astype(np.int64) + 1) * pairs
    base = (np.arange(words) * ((symbols + 2) * pairs))[:, None] + everyone

    full, one, top_bit = np.uint64(2**64 - 1), np.uint64(1), np.uint64(63)
    all_more, all_less = np.full((words, pairs), full), np.zeros((words, pairs), np.uint64)
    all_more[:half // 64] = 0
    all_more[half // 64] = (2**64 - 1) << (half % 64) & (2**64 - 1)
    rise, fall = np.zeros((words + 1, pairs), np.uint64), np.zeros((words + 1, pairs), np.uint64)
    rise[0] = one
    start = [max(0, 64 * (w - wide + 1)) + w for w in range(words)]
    stop = [min(steps, 64 * (w + 1)) + w for w in range(words)]
    work = np.empty((5, min(words, wide + 1), pairs), np.uint64)
    places = np.empty((min(words, wide + 1), pairs), np.int64)
    turns = sorted({0, *start, *stop, *(s + 1 for s in stop)})
    low = high = 0
    for begin, until in zip(turns, turns[1:]):
        while high < words and start[high] <= begin:
            high += 1
        while low < high and stop[low] <= begin:
            low += 1
        if low == high:
            break
        if low and stop[low - 1] < begin:  # the word above has left, and its last column has been passed on
            rise[low], fall[low] = one, 0
        more, less, place = all_more[low:high], all_less[low:high], places[:high - low]
        same, zero, up, down, hold = work[:, :high - low]
        rise_in, fall_in, rise_out, fall_out = rise[low:high], fall[low:high], rise[low + 1:high + 1], fall[low + 1:high + 1]
        offset = base[low:high]
        for t in range(begin, until):
            np.add(heard[t - high + 1:t - low + 1][::-1], offset, out=place)
            table.take(place, out=same, mode="clip")
            np.bitwise_or(same, less, out=hold)
            np.bitwise_or(same, fall_in, out=same)
            np.bitwise_and(same, more, out=zero)
            np.add(zero, more, out=zero)
            np.bitwise_xor(zero, more, out=zero)
            np.bitwise_or(zero, same, out=zero)
            np.bitwise_and(more, zero, out=down)
            np.bitwise_or(zero, more, out=up)
            np.invert(up, out=up)
            np.bitwise_or(up, less, out=up)
            np.left_shift(up, one, out=same)
            np.bitwise_or(same, rise_in, out=same)
            np.left_shift(down, one, out=zero)
            np.bitwise_or(zero, fall_in, out=zero)
            np.right_shift(up, top_bit, out=rise_out)
            np.right_shift(down, top_bit, out=fall_out)
            np.bitwise_and(same, hold, out=less)
            np.bitwise_or(same, hold, out=more)
            np.invert(more, out=more)
            np.bitwise_or(more, zero, out=more)
    # Down the band's upper edge, one for each column, then down the rows that each word had at its last column.
    left = np.clip(ends - 64 * np.arange(words)[:, None], 0, 64)
    valid = np.where(left == 64, full, np.left_shift(one, np.minimum(left, 63).astype(np.uint64)) - one)
    climbed = np.bitwise_count(all_more & valid).astype(np.int64) - np.bitwise_count(all_less & valid)
    return steps + climbed.sum(axis=0)


def text_distances(refs: Sequence[str | None], hyps: Sequence[str | None], words: bool) -> list[int | None]:
    """Distances of normalised texts over their words or their characters; None where a text is."""
    out: list[int | None] = [None if r is None or h is None else 0 for r, h in zip(refs, hyps)]
    unlike = [i for i, d in enumerate(out) if d is not None and refs[i] != hyps[i]]
    begin = 0
    while begin < len(unlike):
        end, chars = begin, 0
        while end < len(unlike) and (end == begin or chars < CHUNK_CHARS):
            chars += len(refs[unlike[end]]) + len(hyps[unlike[end]])
            end += 1
        some = unlike[begin:end]
        texts = [t for i in some for t in (refs[i], hyps[i])]
        flat, sizes, symbols = (_word_numbers if words else _char_numbers)(texts)
        parts = np.split(flat, np.cumsum(sizes)[:-1])
        for i, d in zip(some, distances(list(zip(parts[::2], parts[1::2])), symbols).tolist()):
            out[i] = d
        begin = end
    return out


def _char_numbers(texts: list[str]) -> tuple[np.ndarray, list[int], int]:
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    seen = np.zeros(int(points.max(initial=0)) + 1, bool)
    seen[points] = True
    number = np.cumsum(seen, dtype=np.int32) - 1
    return number[points], [len(t) for t in texts], int(seen.sum())


def _word_numbers(texts: list[str]) -> tuple[np.ndarray, list[int], int]:
    parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    words, sizes = parts.flatten(), parts.value_lengths().to_numpy()
    kept = pc.binary_length(words).to_numpy() > 0
    coded = words.dictionary_encode()
    left = np.add.reduceat(kept, np.cumsum(sizes) - sizes, dtype=np.int64)
    return coded.indices.to_numpy()[kept], left.tolist(), max(1, len(coded.dictionary))


#: Which distances :func:`text_scores` can take, and what it counts besides.
DISTANCES = ("word", "char", "whisper_word", "whisper_char")
COUNTS = tuple(f"{normal}{side}_{unit}" for normal in ("", "whisper_") for side in ("reference", "prediction") for unit in ("words", "chars"))


def text_scores(refs: pa.Array, hyps: pa.Array, wanted: Sequence[str]) -> dict[str, np.ndarray]:
    """The words and characters of both normalised sides of each pair of texts (``COUNTS``), and the ``wanted`` of ``DISTANCES``.

    Where both normalisers give the same two texts, the distance is the same and is not taken twice.
    """
    n = len(refs)
    sides = normalised(pa.concat_arrays([refs, hyps]))
    out = {f"{normal}{side}_{unit}": getattr(texts, unit)[place]
           for normal, texts in zip(("", "whisper_"), sides) for side, place in (("reference", slice(0, n)), ("prediction", slice(n, None))) for unit in ("words", "chars")}
    strings = [texts.strings() for texts in sides]
    unlike = [pc.not_equal(own[:n], own[n:]).to_numpy(zero_copy_only=False) for own in strings]
    twice = pc.equal(*strings).to_numpy(zero_copy_only=False)
    twice = twice[:n] & twice[n:]
    for unit in ("word", "char"):
        kinds = [k for k in ("", "whisper_") if k + unit in wanted]
        rows = [np.flatnonzero(unlike[k != ""] & ~(twice if k and "" in kinds else np.zeros(n, bool))) for k in kinds]
        flat, bounds, symbols = _numbers([sides[k != ""] for k in kinds], unit == "word")
        pairs = [(flat[a:b], flat[c:d]) for own, some in zip(bounds, rows) for a, b, c, d in zip(*(x.tolist() for x in (own[some], own[some + 1], own[n + some], own[n + some + 1])))]
        found = np.split(distances(pairs, symbols), np.cumsum([len(some) for some in rows])[:-1])
        for k, some, cost in zip(kinds, rows, found):
            own = np.zeros(n, np.int64)
            own[some] = cost
            if k and "" in kinds:
                own = np.where(twice, out[unit], own)
            out[k + unit] = own
    return out


def _numbers(sides: list[Normalised], words: bool) -> tuple[np.ndarray, list[np.ndarray], int]:
    """The words or characters of all texts as numbers in one array, the texts' bounds there for each of ``sides``, and how many numbers there are."""
    sizes = [s.words if words else s.chars for s in sides]
    before = np.cumsum([0, *[int(own.sum()) for own in sizes]])
    bounds = [first + np.append(0, np.cumsum(own)) for first, own in zip(before, sizes)]
    if words:
        narrow = np.uint16 if all(s.letters.max(initial=0) < 1 << 16 for s in sides) else np.uint32
        coded = pa.concat_arrays([pa.array([], pa.large_binary()), *[s.word_strings(narrow) for s in sides]]).dictionary_encode()
        return coded.indices.to_numpy(), bounds, max(1, len(coded.dictionary))
    points = np.concatenate([np.zeros(0, np.uint32), *[s.points for s in sides]]).astype(np.intp)
    seen = np.zeros(int(points.max(initial=0)) + 1, bool)
    seen[points] = True
    return (np.cumsum(seen, dtype=np.int32) - 1).take(points), bounds, int(seen.sum())


def pair_scores(ref: Column, hyp: Column, wanted: Sequence[str]) -> Column:
    """:func:`text_scores` as a struct of longs, NULL where a text is; Arrow batches
    are taken together up to ``CHUNK_ROWS`` rows or ``CHUNK_CHARS`` bytes."""
    names = (*COUNTS, *wanted)

    def scored(batches: list[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        refs, hyps = (pa.concat_arrays([b[i] for b in batches]) for i in range(2))
        asked = pc.and_(refs.is_valid(), hyps.is_valid())
        absent = pc.invert(asked).to_numpy(zero_copy_only=False)
        found = text_scores(refs.filter(asked), hyps.filter(asked), wanted)
        fields = []
        for name in names:
            own = np.zeros(len(refs), np.int64)
            own[~absent] = found[name]
            fields.append(pa.array(own))
        whole, begin = pa.StructArray.from_arrays(fields, names, mask=pa.array(absent)), 0
        for batch in batches:
            yield whole.slice(begin, len(batch[0]))
            begin += len(batch[0])

    @F.arrow_udf(T.StructType([T.StructField(name, T.LongType()) for name in names]))
    def udf(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        some, rows, size = [], 0, 0
        for batch in batches:
            some.append(batch)
            rows += len(batch[0])
            size += sum(pc.sum(pc.binary_length(side)).as_py() or 0 for side in batch)
            if rows >= CHUNK_ROWS or size >= CHUNK_CHARS:
                yield from scored(some)
                some, rows, size = [], 0, 0
        if some:
            yield from scored(some)

    return udf(ref, hyp)
