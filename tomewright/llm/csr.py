"""Sparse matrices by compressed rows, with row-by-row products."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from tomewright.llm.pretokens import gather

#: Products of two entries that are worked out at once.
PRODUCTS = 1 << 20


@dataclass
class Csr:
    """Row ``r`` has ``values`` at ``columns``, both from ``first[r]`` to ``first[r + 1]``."""

    first: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @property
    def height(self) -> int:
        return len(self.first) - 1

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.height), np.diff(self.first))

    @classmethod
    def of(cls, rows: np.ndarray, columns: np.ndarray, height: int, width: int) -> Csr:
        """Counts of (row, column) places, which may be given in any order and repeatedly."""
        key, values = np.unique(rows * np.int64(width) + columns, return_counts=True)
        rows, columns = np.divmod(key, max(width, 1))
        return cls(np.searchsorted(rows, np.arange(height + 1)), columns, values, width)

    def transposed(self) -> Csr:
        order = np.argsort(self.columns, kind="stable")
        first = np.searchsorted(self.columns[order], np.arange(self.width + 1))
        return Csr(first, self.rows[order], self.values[order], self.height)

    def times(self, other: Csr) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The product with ``other``, as ``(rows, columns, values)`` of ranges of its rows.

        Gustavson's rule: row r of the product is the sum of the rows of ``other`` that the entries
        of row r name, each times its entry. A range of rows is as long as its products of entries
        fit ``PRODUCTS``; a single row may take more.
        """
        size = np.diff(other.first)[self.columns]
        done = np.concatenate([[0], np.cumsum(size)])[self.first]  # products before each row
        at = 0
        while at < self.height:
            to = int(np.searchsorted(done, done[at] + PRODUCTS, side="right")) - 1
            to = min(max(to, at + 1), self.height)
            part = slice(self.first[at], self.first[to])
            count, begin = size[part], other.first[self.columns[part]]
            rows = np.repeat(self.rows_of(at, to), count)
            values = np.repeat(self.values[part], count) * gather(other.values, begin, count)
            yield _summed(rows, gather(other.columns, begin, count), values, other.width)
            at = to

    def rows_of(self, at: int, to: int) -> np.ndarray:
        return np.repeat(np.arange(at, to), np.diff(self.first[at:to + 1]))


def _summed(rows: np.ndarray, columns: np.ndarray, values: np.ndarray,
            width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places with the sums of their values, in order."""
    key = rows * np.int64(width) + columns
    if len(key) > 1 and (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        key, values = key[order], values[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
    summed = np.add.reduceat(values, begin) if len(key) else values
    rows, columns = np.divmod(key[begin], max(width, 1))
    return rows, columns, summed
