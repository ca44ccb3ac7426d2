"""Words of Arrow text columns as numpy arrays.

A text is looked at as its UTF-8 bytes: in both word rules used here a byte of 0x80 and above is
part of a word, so bytes and code points give the same words. Work goes in blocks of whole rows of
about ``BLOCK_BYTES``; only a longer single text makes a block larger, so memory is bounded by the
longest text and not by the size of a batch.

Words and runs of words are named by 64-bit hashes: a polynomial over bytes (over words) modulo
2^64, taken from running sums, followed by a mixing step. Such a polynomial can be made to give one
value for two long runs of bytes, so runs of ``LONG`` bytes and more are named by BLAKE2b.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
#: Bytes from which a run is named by a cryptographic hash.
LONG = 48

_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD6E8FEB86659FD93


def _table(keep) -> np.ndarray:
    return np.array([keep(b) for b in range(256)], dtype=bool)


#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` once A-Z are lower case: digits, letters, non-ASCII.
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
#: ``[^\x20\x09-\x0D]``
NOT_SPACE = _table(lambda b: b != 0x20 and not 9 <= b <= 13)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """1, b, b^2, ... modulo 2^64, and of the inverse of b, kept at the largest usual length."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.kept: tuple[np.ndarray, np.ndarray] | None = None

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.kept is None or len(self.kept[0]) < n:
            made = tuple(self._row(b, max(n, 1 << 16)) for b in (self.base, self.inverse))
            if n > 2 * BLOCK_BYTES:
                return made
            self.kept = made
        return self.kept[0][:n], self.kept[1][:n]

    @staticmethod
    def _row(base: int, n: int) -> np.ndarray:
        row = np.full(n, base, dtype=np.uint64)
        row[0] = 1
        return np.multiply.accumulate(row)


_BYTE_POWERS, _WORD_POWERS = _Powers(_BASE), _Powers(_STEP)


class RunHash:
    """Hashes of any runs ``[first, last)`` of a sequence, from its running sums."""

    def __init__(self, values: np.ndarray, powers: _Powers = _WORD_POWERS):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        run = (self.sums[last] - self.sums[first]) * self.down[first]
        return mix(run + (last - first).astype(np.uint64) * np.uint64(_BASE))


class ByteRuns(RunHash):
    """Hashes of runs of bytes."""

    def __init__(self, data: np.ndarray):
        super().__init__(data, _BYTE_POWERS)
        self.data = data

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        out = super().__call__(first, last)
        for k in np.flatnonzero(last - first >= LONG).tolist():
            run = self.data[first[k]:last[k]].tobytes()
            out[k] = int.from_bytes(blake2b(run, digest_size=8).digest(), "little")
        return out


@dataclass
class Words:
    """The words of the rows of one block; positions are bytes of ``data``."""

    data: np.ndarray    # lower-cased bytes of all rows
    offsets: np.ndarray  # of the rows in data, one more than rows
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray   # number of the first word of each row, one more than rows
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def text(self, k: int) -> bytes:
        return self.data[self.start[k]:self.end[k]].tobytes()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows in them; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def row_blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, or of one longer row."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def split(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts and ends of the runs of ``keep`` bytes that do not cross a row's border."""
    inside = keep[data]
    starts, ends = inside.copy(), np.zeros(len(data) + 1, dtype=bool)
    starts[1:] &= ~inside[:-1]
    ends[1:] = inside
    ends[1:-1] &= ~inside[1:]
    borders = offsets[:-1][np.diff(offsets) > 0]
    starts[borders] = inside[borders]
    closed = borders[borders > 0]
    ends[closed] = inside[closed - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends)


def words_of(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> Words:
    """Words of the rows of one block, with A-Z lower-cased."""
    data, offsets = LOWER[data[offsets[0]:offsets[-1]]], offsets - offsets[0]
    start, end = split(data, offsets, keep)
    first = np.searchsorted(start, offsets)
    return Words(data, offsets, start, end, first, ByteRuns(data)(start, end))


def windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of all runs of ``k`` words within a row."""
    n = words.first[-1] - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row = words.row
    at = np.flatnonzero(row[:n] == row[k - 1:])
    return at, RunHash(words.hash)(at, at + k)


def block_words(column: pa.Array, keep: np.ndarray) -> Iterator[tuple[int, int, Words]]:
    """``(from row, to row, words)`` of a text column, block by block."""
    data, offsets = text_buffer(column)
    for at, to in row_blocks(offsets):
        yield at, to, words_of(data, offsets[at:to + 1], keep)
