"""Quality of documents: random Fourier features, ridge by summed normal equations, isotonic scores.

Of each text some statistics are taken (``NAMES``): shares of kinds of characters, lengths of words and
lines, and how much of it repeats. Cosines of random projections of the standardised statistics
approximate a Gaussian kernel. Each task adds up the normal equations of its labelled rows, apart for
``FOLDS`` folds; the driver receives the sums, whose size does not depend on the rows. The
penalty is the one with the least error over the folds, which follows from the sums alone. Scores of
labelled rows by the fit without their fold are counted by label in ``BINS`` steps, and a monotone
(isotonic) fit of these counts turns ridge scores into the chance of label 1.

All labelled rows are used. Folds go by a hash of the statistics, so copies share a fold.

Cases: a null text is the empty one; it and texts without words have statistics like any other.
Very long texts are read as one block. Of several labels of one id the highest counts, rows with a
null id or label teach nothing, and equal rows of one id are one row with a weight. If one class is
missing, every score is the share of the label that is there; without labelled rows it is 0.5.
Equal texts get equal scores. An empty table gives an empty table. Columns with the names of added
ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomewright.llm import arrays as A
from tomewright.llm.bpe import list_array
from tomewright.llm.frames import map_arrow, sum_vectors, vector_rows, written

#: Random features, folds, steps of the calibration, and the score that predicts label 1.
FEATURES = 192
FOLDS = 4
BINS = 2048
THRESHOLD = 0.5

_UPPER, _LOWER, _DIGIT, _SPACE, _LINE, _STOP, _SIGN, _HIGH = range(8)
NAMES = ["log_bytes", "log_words", "log_lines", "upper", "lower", "digit", "space", "line_ends",
         "stops", "signs", "high", "word_mean", "word_spread", "word_most", "capital_words",
         "shouted_words", "bare_words", "sign_ended", "distinct_words", "top_word",
         "doubled_words", "repeated_runs", "repeated_lines", "line_mean"]
_RUN = 5
#: Penalties tried, for each labelled row.
_PENALTIES = [10.0 ** -k for k in range(1, 8)]


def _kind(b: int) -> int:
    if b >= 0x80:
        return _HIGH
    c = chr(b)
    if c.isalpha():
        return _UPPER if c.isupper() else _LOWER
    if c.isdigit():
        return _DIGIT
    if c == "\n":
        return _LINE
    if c in " \t\r\x0b\x0c":
        return _SPACE
    return _STOP if c in ".,;:?'\"()-" else _SIGN


_KINDS = np.array([_kind(b) for b in range(256)], np.uint8)
_NOT_LINE = np.array([b != 10 for b in range(256)], bool)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``NAMES`` for each row of a block."""
    data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
    rows, size = len(offsets) - 1, np.diff(offsets)
    kind = _KINDS[data]
    owner = np.repeat(np.arange(rows), size)
    kinds = np.bincount(owner * 8 + kind, minlength=8 * rows).reshape(rows, 8)
    words = A.words_of(data, offsets, A.NOT_SPACE)
    lines = A.words_of(data, offsets, _NOT_LINE)
    length = (words.end - words.start).astype(np.float64)
    first, last = kind[words.start], kind[words.end - 1]
    inner = np.concatenate([[0], np.cumsum((kind == _LOWER) | (kind == _HIGH))])
    capitals = np.concatenate([[0], np.cumsum(kind == _UPPER)])
    letters = np.concatenate([[0], np.cumsum(kind <= _DIGIT) + np.cumsum(kind == _HIGH)])

    def inside(sums: np.ndarray) -> np.ndarray:
        return sums[words.end] - sums[words.start]

    n = words.counts
    word_row = words.row
    sums = {
        "length": length, "square": length ** 2, "capital": first == _UPPER,
        "shouted": (inside(capitals) > 1) & (inside(inner) == 0),
        "bare": inside(letters) == 0, "ended": last == _SIGN,
        "doubled": np.concatenate([[False], (words.hash[1:] == words.hash[:-1])
                                   & (word_row[1:] == word_row[:-1])])[:len(word_row)],
    }
    by_row = {k: np.bincount(word_row, v, minlength=rows) for k, v in sums.items()}
    distinct, top = _repeats(word_row, words.hash, rows)
    at, runs = A.windows(words, _RUN)
    run_rows = word_row[at]
    distinct_runs, _ = _repeats(run_rows, runs, rows)
    n_runs = np.bincount(run_rows, minlength=rows)
    distinct_lines, _ = _repeats(lines.row, lines.hash, rows)
    n_lines = lines.counts
    most = np.zeros(rows)
    np.maximum.at(most, word_row, length)

    def share(part, whole):
        return part / np.maximum(whole, 1)

    mean = share(by_row["length"], n)
    spread = np.sqrt(np.maximum(share(by_row["square"], n) - mean ** 2, 0))
    return np.stack([
        np.log1p(size), np.log1p(n), np.log1p(n_lines),
        *(share(kinds[:, k], size) for k in range(8)),
        np.log1p(mean), np.log1p(spread), np.log1p(most), share(by_row["capital"], n),
        share(by_row["shouted"], n), share(by_row["bare"], n), share(by_row["ended"], n),
        share(distinct, n), share(top, n), share(by_row["doubled"], n),
        1 - share(distinct_runs, n_runs) * (n_runs > 0) - (n_runs == 0),
        1 - share(distinct_lines, n_lines) * (n_lines > 0) - (n_lines == 0),
        np.log1p(share(size, n_lines))], axis=1)


def _repeats(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct values of each row, and how often its most frequent one occurs."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(row)))
    top = np.zeros(rows)
    np.maximum.at(top, row[begin], count)
    return np.bincount(row[begin], minlength=rows), top


def measure(docs: DataFrame, text: str = "text", stats: str = "stats") -> DataFrame:
    """``docs`` with the statistics of ``text``."""
    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        data, offsets = A.text_buffer(batch.column(text))
        parts = [statistics(data, offsets[at:to + 1]) for at, to in A.row_blocks(offsets)]
        counts = [np.full(len(p), len(NAMES)) for p in parts]
        return {stats: list_array([p.ravel() for p in parts], counts, pa.float64())}

    return map_arrow(docs, run, T.StructType([T.StructField(stats, T.ArrayType(T.DoubleType()))]))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, len(NAMES))


@dataclass
class Features:
    """Cosines of random projections of standardised statistics, and a constant."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: np.ndarray

    @classmethod
    def draw(cls, mean: np.ndarray, scale: np.ndarray, size: int, seed: int = 17) -> Features:
        rng = np.random.default_rng(seed)
        d = len(mean)
        # A kernel as wide as the usual distance of two rows: variances add up to d.
        return cls(mean, scale, rng.normal(0, 1 / np.sqrt(d), (d, size)),
                   rng.uniform(0, 2 * np.pi, size))

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.weights + self.shift) * np.sqrt(2 / len(self.shift))
        return np.concatenate([z, np.ones((len(x), 1))], axis=1)


@dataclass
class QualityModel:
    features: Features | None
    weights: np.ndarray
    steps: np.ndarray    # ridge scores, rising
    chances: np.ndarray  # of label 1 at these
    constant: float | None = None

    def predict(self, stats: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(stats), self.constant)
        return np.interp(self.features(stats) @ self.weights, self.steps, self.chances)


def isotonic(total: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pools of bins, in order, whose shares of ones rise: first bins, last bins and shares."""
    pools: list[list[float]] = []
    for k in np.flatnonzero(total):
        pools.append([k, k, total[k], ones[k]])
        while len(pools) > 1 and (pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]):
            _, last, n, y = pools.pop()
            pools[-1][1], pools[-1][2], pools[-1][3] = last, pools[-1][2] + n, pools[-1][3] + y
    first, last, n, y = (np.array(c) for c in zip(*pools, strict=True))
    return first.astype(int), last.astype(int), y / n


def _sums(labelled: DataFrame, size: int, work) -> np.ndarray:
    """Sum of ``work(stats, labels, folds, weights)`` over all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                made = work(_matrix(batch.column(0)), *(np.asarray(batch.column(k), np.float64)
                                                        for k in (1, 2, 3)))
                total = made if total is None else total + made
        if total is not None:
            yield vector_rows(total)

    rows = labelled.select("stats", "label", "fold", "weight")
    return sum_vectors(rows.mapInArrow(run, "block int, values binary"), size, np.float64)


def train(measured: DataFrame, labels: DataFrame) -> QualityModel:
    """A model from ``measured`` (doc_id and stats) and ``labels`` (doc_id, quality)."""
    label = (labels.select("doc_id", F.col("quality").cast("double").alias("label"))
             .where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id")
             .agg(F.max("label").alias("label")))
    labelled = written(
        measured.select("doc_id", "stats").where("doc_id IS NOT NULL")
        .groupBy("doc_id", "stats").agg(F.count("*").alias("weight")).join(label, "doc_id")
        .select("stats", "label", F.pmod(F.xxhash64("stats"), F.lit(FOLDS)).alias("fold"),
                "weight"), "labelled")
    d, width = len(NAMES), FEATURES + 1
    moments = _sums(labelled, 2 * d + 2, lambda x, y, _, w: np.concatenate(
        [w @ x, w @ x ** 2, [w.sum(), w @ y]]))
    n, ones = moments[-2:]
    if n == 0 or ones in (0, n):
        return QualityModel(None, *(np.zeros(1),) * 3, float(ones / n) if n else 0.5)
    mean = moments[:d] / n
    scale = np.sqrt(np.maximum(moments[d:2 * d] / n - mean ** 2, 0))
    features = Features.draw(mean, np.where(scale > 1e-9, scale, 1.0), FEATURES)

    def equations(x, y, fold, w):
        z, out = features(x), []
        for k in range(FOLDS):
            some = fold == k
            part, weight = z[some], w[some]
            out += [(part.T * weight) @ part, (weight * y[some]) @ part,
                    [weight.sum(), weight @ y[some]]]
        return np.concatenate([np.ravel(o) for o in out])

    size = width * width + width + 2
    folds = _sums(labelled, FOLDS * size, equations).reshape(FOLDS, size)
    gram = folds[:, :width * width].reshape(FOLDS, width, width)
    moment, count = folds[:, width * width:-2], folds[:, -2:]
    weights, held = _ridge(gram, moment, count)

    low, high = -0.5, 1.5

    def histogram(x, y, fold, w):
        score = (features(x) * held[fold.astype(int)]).sum(axis=1)
        bins = np.clip((score - low) / (high - low) * BINS, 0, BINS - 1).astype(int)
        return np.concatenate([np.bincount(bins, w, BINS), np.bincount(bins, w * y, BINS)])

    counted = _sums(labelled, 2 * BINS, histogram)
    first, last, chances = isotonic(counted[:BINS], counted[BINS:])
    # Each pool keeps its share from its first bin to its last; between pools it rises evenly.
    steps = low + (np.stack([first, last + 1], axis=1).ravel()) * (high - low) / BINS
    doubt = 1 / (n + 2)  # no sample proves certainty
    chances = np.clip(np.repeat(chances, 2), doubt, 1 - doubt)
    return QualityModel(features, weights, steps, chances)


def _ridge(gram: np.ndarray, moment: np.ndarray,
           count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of all folds together, and those without each fold, at the best penalty."""
    width = gram.shape[1]
    free = np.eye(width)
    free[-1, -1] = 0  # the constant is not held back

    def fit(g, m, n, penalty):
        return np.linalg.solve(g + penalty * n * free + 1e-9 * np.eye(width), m)

    def without(penalty):
        return np.stack([fit(gram.sum(0) - gram[k], moment.sum(0) - moment[k],
                             count[:, 0].sum() - count[k, 0], penalty) for k in range(len(gram))])

    def error(w):
        # Labels are 0 or 1, so the sum of their squares is their sum.
        return sum(count[k, 1] - 2 * w[k] @ moment[k] + w[k] @ gram[k] @ w[k]
                   for k in range(len(gram)))

    tried = [(error(w := without(p)), p, w) for p in _PENALTIES]
    _, penalty, held = min(tried, key=lambda t: t[0])
    return fit(gram.sum(0), moment.sum(0), count[:, 0].sum(), penalty), held


def score(measured: DataFrame, model: QualityModel, stats: str = "stats") -> DataFrame:
    """``measured`` with ``score`` and ``predicted``."""
    known = measured.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        chances = known.value.predict(_matrix(batch.column(stats)))
        return {"score": pa.array(chances),
                "predicted": pa.array((chances >= THRESHOLD).astype(np.int32))}

    return map_arrow(measured, run, T.StructType([T.StructField("score", T.DoubleType()),
                                                  T.StructField("predicted", T.IntegerType())]))
