"""Embedding whitening by mixed-precision refinement of eigenvectors.

An entry c of a vector becomes the whole number ``floor(64 * c) + 1000000``. Sums and products of
these are exact: a first pass adds up the entries, a second one the products of entries that were
centred at the whole number next to their mean; what is left of the mean, half a unit at most, is
taken out of the summed products as a fraction of whole numbers. Tasks send their sums in digits of
21 bits, so no sum of them can overflow.

The eigenvectors start as those of the covariance in float32. Iterations of Ogita and Aishima, all
matrix products in extended precision (``numpy.longdouble``), correct them; the error is squared by
each. Where eigenvalues lie too close together to be told apart by these products, the directions of
that cluster are found by a solve of the covariance within it, shifted and scaled so that its own
differences count, by the same method.

What reaches the driver is one number per pair of dimensions.

Cases: rows whose vector is null, or holds a null or an entry that is not finite, go. Vectors of
another length than the most frequent (of equally frequent ones the longest) go as well; empty vectors
count as a length. Entries beyond 2^56 in size count as that. Repeated rows and null ids count row by
row. A component without variance, as there are if vectors are few or depend on each other, gives 0
for all rows and is left out of ``identity_error``. ``deviation`` is null where it does not fit a long.
An empty table gives an empty table. Columns with the names of added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomewright.llm.bpe import list_array
from tomewright.llm.frames import BATCH_ROWS, map_arrow, sum_vectors, vector_rows

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32

_DIGIT, _DIGITS = 21, 6
_LARGEST = 2.0 ** 62
_ROUNDS = 40
_WIDE = np.longdouble


@dataclass
class Whitening:
    """``n`` vectors with whole centres and, by component, direction, variance and share of all."""

    n: int
    centre: np.ndarray  # whole numbers next to the means
    rest: list[int]     # n times (mean - centre)
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def offset(self) -> np.ndarray:
        return np.array([r / self.n for r in self.rest])

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of whole numbers."""
        z = (x - self.centre).astype(np.float64) - self.offset
        scale = np.sqrt(np.maximum(self.values, 0))
        return (z @ self.vectors) * np.divide(1, scale, out=np.zeros_like(scale), where=scale > 0)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of ``(n * x - S)^2`` of each row, in whole numbers."""
        y = x - self.centre
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.rest), default=0)
        if most ** 2 * max(y.shape[1], 1) < 2 ** 63:
            return ((self.n * y - np.array(self.rest, np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * v - r) ** 2 for v, r in zip(row, self.rest, strict=True))
                 for row in y.tolist()]
        return [v if v < 2 ** 63 else None for v in exact]


def matrix(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of usable vectors (-1 for others), and the whole numbers of those of length ``dim``."""
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(length)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    usable = column.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - length])
    usable = np.where(usable, length, -1)
    if dim is None:
        return usable, np.zeros((0, 0), np.int64)
    values = flat[np.repeat(usable == dim, length)].reshape(int((usable == dim).sum()), dim)
    whole = np.clip(np.floor(SCALE * values), -_LARGEST, _LARGEST).astype(np.int64)
    return usable, whole + SHIFT


def _per_task(df: DataFrame, vector: str, dim: int,
              work: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The summed ``work`` of all blocks of a task's rows, as ``sum_vectors`` takes it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                _, x = matrix(batch.column(vector).slice(at, BATCH_ROWS), dim)
                if len(x):
                    made = work(x)
                    total = made if total is None else total + made
        if total is not None:
            yield vector_rows(_carried(total) if total.dtype == np.int64 else total)

    return df.select(vector).mapInArrow(run, "block int, values binary")


def _carried(planes: np.ndarray) -> np.ndarray:
    """Digits in range, all but the last; ``planes`` holds the first digits of all, the second ..."""
    planes = planes.reshape(_DIGITS, -1).copy()
    for k in range(_DIGITS - 1):
        planes[k + 1] += planes[k] >> _DIGIT
        planes[k] &= (1 << _DIGIT) - 1
    return planes.ravel()


def _whole(planes: np.ndarray) -> list[int]:
    """The numbers that digits stand for."""
    return [sum(int(v) << (_DIGIT * k) for k, v in enumerate(digits))
            for digits in planes.reshape(_DIGITS, -1).T]


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    low = (1 << _DIGIT) - 1
    return [y & low, (y >> _DIGIT) & low, y >> (2 * _DIGIT)]


def _sums(x: np.ndarray) -> np.ndarray:
    planes = np.zeros((_DIGITS, x.shape[1]), np.int64)
    for k, limb in enumerate(_limbs(x - SHIFT)):
        planes[k] = limb.sum(axis=0)
    return _carried(planes)


def _products(y: np.ndarray) -> np.ndarray:
    """Products of the columns, exact: float64 holds each sum of a block."""
    planes = np.zeros((_DIGITS, y.shape[1] ** 2), np.int64)
    if float(np.abs(y).max(initial=0)) ** 2 * len(y) < 2.0 ** 53:
        f = y.astype(np.float64)
        planes[0] = (f.T @ f).astype(np.int64).ravel()
    else:
        limbs = [limb.astype(np.float64) for limb in _limbs(y)]
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                planes[i + j] += (a.T @ b).astype(np.int64).ravel()
    return _carried(planes)


def common_length(df: DataFrame, vector: str) -> tuple[int, int] | None:
    """Length of the vectors that are fitted, and their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, _ = matrix(batch.column(vector))
            size, count = np.unique(usable[usable >= 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(size, pa.int64()),
                                              pa.array(count, pa.int64())], names=["size", "n"])

    row = (df.select(vector).mapInArrow(run, "size long, n long").groupBy("size")
           .agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).first())
    return (row["size"], row["n"]) if row else None


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all usable vectors of ``df``; None if there are none."""
    found = common_length(df, vector)
    if found is None:
        return None
    dim, n = found
    sums = _whole(sum_vectors(_per_task(df, vector, dim, _sums), _DIGITS * dim, np.int64))
    near = [(2 * s + n) // (2 * n) for s in sums]  # of x - SHIFT
    rest = [s - n * c for s, c in zip(sums, near, strict=True)]
    centre = np.array([c + SHIFT for c in near], np.int64)
    products = sum_vectors(_per_task(df, vector, dim, lambda x: _products(x - centre)),
                           _DIGITS * dim * dim, np.int64)
    model = solve(n, centre, rest, _whole(products), components)
    model.identity_error = _identity_error(df, vector, model)
    return model


def solve(n: int, centre: np.ndarray, rest: list[int], products: list[int],
          components: int) -> Whitening:
    """Components of the covariance ``(n * products - rest * rest) / n^2``."""
    dim = len(rest)
    exact = [n * products[i * dim + j] - rest[i] * rest[j] for i in range(dim) for j in range(dim)]
    cov = np.array([wide(v) for v in exact], _WIDE).reshape(dim, dim) / _WIDE(n) / _WIDE(n)
    values, vectors = eigenvectors(cov)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    largest = np.abs(vectors).argmax(axis=0)  # either sign: the largest entry is positive
    vectors = vectors * np.sign(vectors[largest, np.arange(len(order))])
    trace = np.trace(cov)
    # Sums of whole numbers are exact, so a direction without variance shows as rounding alone.
    values = np.where(values > trace * dim * _WIDE(2) ** -56, values, 0)
    share = values / trace if trace > 0 else values
    return Whitening(n, centre, rest, vectors.astype(np.float64), values.astype(np.float64),
                     share.astype(np.float64))


def wide(value: int) -> np.longdouble:
    """A whole number of any size, to extended precision."""
    high = float(value)
    return _WIDE(high) + _WIDE(float(value - int(high)))


def eigenvectors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of a symmetric matrix, in extended precision."""
    # The best vectors so far are those that are nearest to orthonormal and diagonal.
    n, scale = len(a), np.abs(a).max(initial=0)
    if not n or scale == 0:
        return np.zeros(n, _WIDE), np.eye(n, dtype=_WIDE)
    a = a / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(_WIDE)
    small = _WIDE(n) * np.finfo(_WIDE).eps
    best, least, late = x, np.inf, 0
    for _ in range(_ROUNDS):
        r = np.eye(n, dtype=_WIDE) - x.T @ x
        s = x.T @ (a @ x)
        r, s = (r + r.T) / 2, (s + s.T) / 2
        values = s.diagonal() / (1 - r.diagonal())
        off = s - np.diag(values)
        error = max(np.abs(r).max(), np.abs(off).max())
        if error < least:
            best, least, late = x, error, 0
        late += 1
        if error <= small or late > 4:  # at rounding, or no longer smaller
            break
        # Norms of the largest row sums bound those of the method.
        doubt = 2 * (np.abs(off).sum(axis=1).max()
                     + np.abs(a).sum(axis=1).max() * np.abs(r).sum(axis=1).max())
        gap = values[None, :] - values[:, None]
        apart = np.abs(gap) > doubt
        x = x + x @ np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
        for group in _clusters(values, doubt):
            x[:, group] = _turned(a, x[:, group], small)
    r = np.eye(n, dtype=_WIDE) - best.T @ best
    values = (best * (a @ best)).sum(axis=0) / (1 - r.diagonal())
    return values * scale, best


def _clusters(values: np.ndarray, doubt: np.longdouble) -> list[np.ndarray]:
    """Places of eigenvalues that follow each other at ``doubt`` or less; single ones are left out."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > doubt) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def _turned(a: np.ndarray, part: np.ndarray, small: np.longdouble) -> np.ndarray:
    """The vectors of a cluster turned to the eigenvectors of what ``a`` is between them."""
    inner = part.T @ (a @ part)
    inner = (inner + inner.T) / 2
    shift = inner.diagonal().mean()
    inner = inner - shift * np.eye(len(inner), dtype=_WIDE)
    if np.abs(inner - np.diag(inner.diagonal())).max() <= small * np.abs(a).max():
        return part
    if len(inner) == len(a) and abs(shift) <= np.abs(inner).max():
        # The cluster is the whole and the shift does not spread it: no smaller problem.
        return part @ np.linalg.eigh(inner.astype(np.float64))[1].astype(_WIDE)
    return part @ eigenvectors(inner)[1]


def _identity_error(df: DataFrame, vector: str, model: Whitening) -> float:
    """Largest entry of the covariance of all whitened rows minus the identity."""
    k = len(model.values)

    def work(x: np.ndarray) -> np.ndarray:
        w = model.project(x)
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    total = sum_vectors(_per_task(df, vector, len(model.centre), work), k + k * k, np.float64)
    mean = total[:k] / model.n  # zero but for rounding, as rows are centred before
    found = total[k:].reshape(k, k) / model.n - np.outer(mean, mean)
    have = model.values > 0
    return float(np.abs(found - np.eye(k))[np.ix_(have, have)].max(initial=0))


OUT = T.StructType([T.StructField("deviation", T.LongType()),
                    T.StructField("whitened", T.ArrayType(T.DoubleType()))])


def whiten(df: DataFrame, model: Whitening | None, vector: str = "embedding") -> DataFrame:
    """The usable rows of ``df`` with ``deviation`` and ``whitened``, a number per component."""
    if model is None:
        return df.limit(0).withColumns({f.name: F.lit(None).cast(f.dataType) for f in OUT})
    known = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        m = known.value
        usable, x = matrix(batch.column(vector), len(m.centre))
        keep = usable == len(m.centre)
        deviation, whitened = np.full(len(keep), None, object), m.project(x)
        deviation[keep] = m.deviations(x)
        counts = np.where(keep, whitened.shape[1], 0)
        rows = list_array([whitened.ravel()], [counts], pa.float64())
        return {"deviation": pa.array(deviation.tolist(), pa.int64()),
                "whitened": pc.if_else(pa.array(keep), rows, pa.scalar(None, rows.type))}

    return map_arrow(df, run, OUT).where("whitened IS NOT NULL")


def components(df: DataFrame, model: Whitening | None, vector: str = "embedding") -> DataFrame:
    """One row for each usable row of ``df`` and component, with the figures of the fit."""
    done = whiten(df, model, vector)
    kept = [c for c in done.columns if c not in ("whitened", "component", "n", "explained",
                                                 "identity_error", vector)]
    shares = [float(v) for v in model.explained] if model else []
    rows = done.select(*kept, F.posexplode("whitened").alias("__k", "whitened"))
    return rows.select(
        *kept, (F.col("__k") + 1).alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"), "whitened",
        F.element_at(F.array(*[F.lit(v) for v in shares]).cast("array<double>"),
                     F.col("__k") + 1).alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"))
