"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A toxic text is mostly harmless words, so averages are taken over windows of ``WINDOW`` words and a
text counts as its worst window. Which windows of a toxic training text are the toxic ones is not
labelled: training starts from all of them and goes on with those that the model finds worst, while
all windows of other texts stay harmless. Words are bags of character n-grams whose vectors are
trained jointly with the softmax, so a misspelling shares most of its vector with the word.

The model is fitted on a bounded sample (``SAMPLE_ROWS`` and ``SAMPLE_CHARS`` a class); a fifth of
it is held back to turn the worst window's margin into a chance.

Cases: null and empty texts, and texts without words, get the score of a margin without words. Of
several labels of one id the highest counts. If one class is missing, every score is the share of
the label that is there (0 without any). Equal texts get equal scores. Columns with the names of
added ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomewright.llm import arrays as A
from tomewright.llm.frames import give_back, map_arrow
from tomewright.llm.samples import labelled_sample
from tomewright.llm.subwords import (Corpus, Model, Shape, batch_size, min_texts,
                                      word_scores)

#: Labelled texts and characters used, for each class.
SAMPLE_ROWS = 1500
SAMPLE_CHARS = 3_000_000
#: Words of a window.
WINDOW = 3
#: Score from which a text is taken as toxic.
THRESHOLD = 0.3

SHAPE = Shape(grams=(3, 4, 5), bits=17, dim=8)
_EPOCHS, _BATCH, _RATE = 6, 1024, 1.0


@dataclass
class ToxicityModel:
    scores: np.ndarray  # margin of each bucket, one column
    bias: float
    slope: float
    shift: float
    constant: float | None = None

    def margins(self, column: pa.Array) -> np.ndarray:
        """Margin of the worst window of each text."""
        out = [worst_window(words, self.scores) for _, _, words in A.block_words(column, A.ALNUM)]
        return (np.concatenate(out) if out else np.zeros(0)) + self.bias

    def predict(self, column: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(column), self.constant)
        z = np.clip(self.slope * self.margins(column) + self.shift, -500, 500)
        return 1 / (1 + np.exp(-z))


def worst_window(words: A.Words, scores: np.ndarray) -> np.ndarray:
    """Highest mean over the windows of each row; a shorter row is one window, an empty one 0."""
    by_word = word_scores(words, scores, SHAPE)[:, 0].astype(np.float64)
    sums = np.concatenate([[0.0], np.cumsum(by_word)])
    out, counts = np.zeros(len(words.first) - 1), words.counts
    short = np.flatnonzero((counts > 0) & (counts <= WINDOW))
    out[short] = (sums[words.first[short + 1]] - sums[words.first[short]]) / counts[short]
    long = np.flatnonzero(counts > WINDOW)
    if len(long):
        at = np.arange(len(by_word) - WINDOW + 1)
        mean = (sums[at + WINDOW] - sums[at]) / WINDOW
        # Windows that leave their row are passed over by the limits of the segments.
        limits = np.stack([words.first[long], words.first[long + 1] - WINDOW + 1], axis=1).ravel()
        mean = np.append(mean, -np.inf)
        out[long] = np.maximum.reduceat(mean, limits)[::2]
    return out


def fit(sample: list[tuple[str, int]]) -> ToxicityModel:
    labels = np.array([int(y) for _, y in sample])
    if len(set(labels.tolist())) < 2:
        return ToxicityModel(np.zeros((1, 1), np.float32), 0, 0, 0,
                             float(labels[0]) if len(labels) else 0.0)
    rng = np.random.default_rng(13)
    held = rng.random(len(sample)) < 0.2
    corpus = Corpus([t for (t, _), h in zip(sample, held, strict=True) if not h], SHAPE)
    y = labels[~held]
    model = Model(corpus, SHAPE, 2, min_texts(len(y)))
    for epoch in range(_EPOCHS):
        spans = corpus.spans(rng, WINDOW, 1)
        label = y[spans[:, 0]]
        if epoch:
            spans, label = _worst_spans(model, corpus, spans, label)
        order = rng.permutation(len(spans))
        spans, label = spans[order], label[order]
        weight = 1 / np.maximum(np.bincount(label, minlength=2), 1)[label]
        size = batch_size(len(spans), _BATCH)
        for at in range(0, len(spans), size):
            part = slice(at, at + size)
            model.step(corpus, spans[part], label[part], weight[part], _RATE / (1 + epoch) ** 0.5)
    table = model.bucket_scores()
    fitted = ToxicityModel((table[:, 1] - table[:, 0])[:, None],
                           float(model.bias[1] - model.bias[0]), 1.0, 0.0)
    texts = [t for (t, _), h in zip(sample, held, strict=True) if h]
    if texts and len(set(labels[held].tolist())) == 2:
        fitted.slope, fitted.shift = _logistic(
            fitted.margins(pa.array(texts, pa.large_string())), labels[held])
    return fitted


def _worst_spans(model: Model, corpus: Corpus, spans: np.ndarray,
                 label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Harmless spans, and of each toxic text the worst span and those the model calls toxic."""
    table = model.bucket_scores()
    margin = (table[:, 1] - table[:, 0])[corpus.buckets]
    by_word = np.add.reduceat(margin, corpus.first[:-1]) / np.diff(corpus.first)
    sums = np.concatenate([[0.0], np.cumsum(by_word[corpus.word].astype(np.float64))])
    mean = (sums[spans[:, 2]] - sums[spans[:, 1]]) / (spans[:, 2] - spans[:, 1])
    mean += float(model.bias[1] - model.bias[0])
    worst = np.full(spans[:, 0].max() + 1, -np.inf)
    np.maximum.at(worst, spans[:, 0], mean)
    keep = (label == 0) | (mean >= worst[spans[:, 0]]) | (mean > 0)
    return spans[keep], label[keep]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the chance of label 1, by Newton steps, a little held towards zero."""
    center, scale = x.mean(), max(x.std(), 1e-9)
    z = np.stack([(x - center) / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2)
        w -= np.linalg.solve(hess, z.T @ (p - y) + 0.1 * w)
    slope = max(w[0], 1e-6) / scale
    return float(slope), float(w[1] - slope * center)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = SAMPLE_ROWS,
          max_chars: int = SAMPLE_CHARS) -> ToxicityModel:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    model = fit(labelled_sample(docs, labels.select("doc_id", F.col("toxic").alias("label")),
                                max_rows, max_chars))
    give_back()  # what the driver needed for the sample
    return model


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([T.StructField("score", T.DoubleType()),
                        T.StructField("predicted", T.IntegerType())])

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        chances = known.value.predict(batch.column(text))
        return {"score": pa.array(chances), "predicted": pa.array(
            (chances >= THRESHOLD).astype(np.int32))}

    return map_arrow(docs, run, out)
