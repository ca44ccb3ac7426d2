"""Pre-tokens of the byte-level vocabularies, by array operations.

The pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` cuts a
text at every change between letters, numbers, spaces and the rest, with three exceptions: one
plain space joins the run that follows it, the last space of a longer run is cut from the others,
and an apostrophe that begins a match takes one of seven endings with it. Which code points are
letters, numbers and spaces depends on the Unicode tables of the library that is to be matched, so
the classes are asked from that library once and sent along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tomewright.llm import arrays as A

OTHER, LETTER, NUMBER, SPACE = range(4)

_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def every_code_point() -> str:
    return "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


def classes(find) -> np.ndarray:
    """The class of every code point; ``find(pattern, text)`` gives the text of all matches."""
    table, text = np.zeros(0x110000, np.uint8), every_code_point()
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        found = np.frombuffer("".join(find(pattern, text)).encode("utf-32-le"), np.uint32)
        table[found] = kind
    return table


@dataclass
class PreTokens:
    """Pre-tokens of the rows of a block as ranges of bytes, in order."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # number of the first pre-token of each row, one more than rows
    hash: np.ndarray

    def text(self, k: int) -> bytes:
        return self.data[self.start[k]:self.end[k]].tobytes()

    def texts(self, places: np.ndarray) -> list[bytes]:
        blob = self.data.tobytes()
        return [blob[a:b] for a, b in zip(self.start[places].tolist(), self.end[places].tolist(),
                                          strict=True)]


def cut(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> PreTokens:
    """Pre-tokens of the rows of one block."""
    data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    where = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of code points
    rows = np.searchsorted(where, offsets)
    n = len(points)
    if not n:
        empty = np.zeros(0, np.int64)
        return PreTokens(data, empty, empty, rows, np.zeros(0, np.uint64))
    kind = table[points]
    border = np.zeros(n + 1, dtype=bool)
    border[rows] = True  # empty rows and the end included
    start = border[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # The last space of a run belongs to what follows, or stands alone if it is not a plain one.
    last = np.zeros(n, dtype=bool)
    last[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~border[1:n]
    start |= last
    joins = last & (points == 0x20)
    after = np.flatnonzero(joins) + 1
    start[after] = False
    # An apostrophe that begins a match, with one of the endings after it.
    quote = np.flatnonzero(start & (points == 0x27))
    if len(quote):
        padded = np.concatenate([points, np.zeros(2, np.uint32)])
        one, two = padded[quote + 1], padded[quote + 2]
        gap = border[np.minimum(quote + 1, n)]
        gap2 = gap | border[np.minimum(quote + 2, n)]
        length = np.zeros(len(quote), np.int64)
        for ending in _ENDINGS:
            hit = one == ord(ending[0])
            hit = hit & ~gap if len(ending) == 1 else hit & (two == ord(ending[1])) & ~gap2
            length[hit] = len(ending)
        quote, length = quote[length > 0], length[length > 0]
        start[quote + 1] = False
        to = quote + 1 + length
        start[to[to < n]] = True
        # A space right after an ending still joins what follows it: its start is already there.
    at = np.flatnonzero(start)
    begin = where[at]
    end = np.append(begin[1:], len(data))
    return PreTokens(data, begin, end, np.searchsorted(at, rows), A.ByteRuns(data)(begin, end))


def blocks(column: pa.Array, table: np.ndarray,
           limit: int = A.BLOCK_BYTES) -> Iterator[tuple[int, int, PreTokens]]:
    data, offsets = A.text_buffer(column)
    for at, to in A.row_blocks(offsets, limit):
        yield at, to, cut(data, offsets[at:to + 1], table)


class Ids:
    """Ids of pre-tokens met so far, as one array; forgotten when there are ``limit`` of them.

    A pre-token is looked up by its hash and size, then its bytes are compared.
    """

    def __init__(self, limit: int = 400_000, limit_bytes: int = 16 << 20):
        self.limit, self.limit_bytes = limit, limit_bytes
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.blob = np.zeros(0, np.uint8)
        self.ids = np.zeros(0, np.int32)
        # Of each key, where its bytes and its ids begin, and how many ids it has.
        self.place, self.first, self.count = (np.zeros(0, np.int64) for _ in range(3))

    def look_up(self, tokens: PreTokens, encode) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens of a block, and the number of ids of each.

        ``encode(places)`` gives the ids of the pre-tokens at some places, and their numbers.
        """
        size = tokens.end - tokens.start
        keys, places, inverse = np.unique(tokens.hash ^ A.mix(size.astype(np.uint64)),
                                          return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.limit or len(self.blob) > self.limit_bytes:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            self._add(tokens, keys[new], places[new], size[places[new]], encode)
            at = np.searchsorted(self.keys, keys)
        at = at[inverse]
        first, count, ids = self.first[at], self.count[at], self.ids
        strangers = np.flatnonzero(unlike(tokens.data, tokens.start, self.blob, self.place[at], size))
        if len(strangers):  # other pre-tokens of the same hash and size
            more, counts = encode(strangers)
            first[strangers] = len(ids) + np.cumsum(counts) - counts
            count[strangers] = counts
            ids = np.concatenate([ids, np.asarray(more, np.int32)])
        return gather(ids, first, count), count

    def _add(self, tokens: PreTokens, keys: np.ndarray, places: np.ndarray, size: np.ndarray,
             encode) -> None:
        ids, count = encode(places)
        begins = (len(self.blob) + np.cumsum(size) - size, len(self.ids) + np.cumsum(count) - count)
        self.blob = np.concatenate([self.blob, gather(tokens.data, tokens.start[places], size)])
        self.ids = np.concatenate([self.ids, np.asarray(ids, np.int32)])
        merged = np.concatenate([self.keys, keys])
        order = np.argsort(merged, kind="stable")
        self.keys = merged[order]
        self.place, self.first, self.count = (
            np.concatenate([old, now])[order] for old, now in zip(
                (self.place, self.first, self.count), (*begins, count), strict=True))


_FIRST_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_BY_WORDS = 64


def unlike(one: np.ndarray, at: np.ndarray, two: np.ndarray, place: np.ndarray,
           size: np.ndarray) -> np.ndarray:
    """Whether the bytes of two runs of one size differ, for many runs: eight bytes at a time."""
    def eights(data: np.ndarray) -> np.ndarray:
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))

    ones, twos = eights(one), eights(two)
    out = np.zeros(len(size), dtype=bool)
    left = np.arange(len(size))
    for skip in range(0, _BY_WORDS, 8):
        first = _FIRST_BYTES[np.minimum(size[left] - skip, 8)]
        out[left] = (ones[at[left] + skip] ^ twos[place[left] + skip]) & first != 0
        left = left[(size[left] > skip + 8) & ~out[left]]
        if not len(left):
            return out
    for k in left.tolist():  # long runs are few
        out[k] = not np.array_equal(one[at[k]:at[k] + size[k]], two[place[k]:place[k] + size[k]])
    return out


def gather(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``values[first:first + count]`` for all ranges, one after another."""
    total = int(count.sum())
    shift = np.repeat(first - (np.cumsum(count) - count), count)
    return values[shift + np.arange(total)]
