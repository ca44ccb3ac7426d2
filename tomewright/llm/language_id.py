"""Language identification by averaged hashed subword embeddings, with calibrated rejection.

The model is fitted on a bounded sample of labelled texts (``SAMPLE_ROWS`` and ``SAMPLE_CHARS`` a
language) cut into spans of 1 to 30 words, so that it also knows short texts. A fifth of the sample
is held back: on it a temperature is fitted, so that the score is the chance to be right, and the
lowest score at which predictions are right often enough. Below that a prediction is marked as
rejected.

Cases: a text that is null or has no letter is ``und`` with score 0 and rejected. A text with
letters but no words cannot occur, as letters make words. With nothing to learn from, all is
``und``. Equal texts get equal results. Columns with the names of added ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomewright.llm import arrays as A
from tomewright.llm.frames import give_back, internal, map_arrow
from tomewright.llm.samples import labelled_sample
from tomewright.llm.subwords import (Corpus, Model, Shape, batch_size, min_texts,
                                      softmax, word_scores)

#: Labelled texts and characters used, for each language.
SAMPLE_ROWS = 1000
SAMPLE_CHARS = 600_000
#: Share of accepted predictions that shall be right.
PRECISION = 0.99

SHAPE = Shape(grams=(1, 2, 3, 4), bits=15, dim=12)
_EPOCHS, _BATCH, _RATE = 4, 512, 0.5


@dataclass
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # class scores of each bucket
    bias: np.ndarray
    temperature: float
    reject_below: float

    def predict(self, column: pa.Array) -> np.ndarray:
        """Chances of the languages for each text."""
        out = []
        for _, _, words in A.block_words(column, A.ALNUM):
            out.append(softmax((_mean_scores(words, self.scores) + self.bias)
                               / self.temperature))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)))


def _mean_scores(words: A.Words, scores: np.ndarray) -> np.ndarray:
    by_word = word_scores(words, scores, SHAPE).astype(np.float64)
    sums = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(by_word, axis=0)])
    return (sums[words.first[1:]] - sums[words.first[:-1]]) / np.maximum(words.counts, 1)[:, None]


def fit(sample: list[tuple[str, str]]) -> LanguageModel | None:
    languages = sorted({lang for _, lang in sample})
    if not languages:
        return None
    labels = np.array([languages.index(lang) for _, lang in sample])
    held = np.arange(len(sample)) % 5 == 4
    rng = np.random.default_rng(11)
    corpus = Corpus([t for (t, _), h in zip(sample, held, strict=True) if not h], SHAPE)
    train = labels[~held]
    share = np.maximum(np.bincount(train, minlength=len(languages)), 1)
    model = Model(corpus, SHAPE, len(languages), min_texts(len(train)))
    for epoch in range(_EPOCHS):
        spans = corpus.spans(rng, 30, 1)
        rng.shuffle(spans)
        size = batch_size(len(spans), _BATCH)
        for at in range(0, len(spans), size):
            some = spans[at:at + size]
            y = train[some[:, 0]]
            model.step(corpus, some, y, 1 / share[y], _RATE / (1 + epoch))
    fitted = LanguageModel(languages, model.bucket_scores(), model.bias, 1.0, 0.0)
    if held.any():
        _calibrate(fitted, [t for (t, _), h in zip(sample, held, strict=True) if h], labels[held])
    return fitted


def _calibrate(fitted: LanguageModel, texts: list[str], labels: np.ndarray) -> None:
    logits = np.log(np.maximum(fitted.predict(pa.array(texts, pa.large_string())), 1e-300))
    rows = np.arange(len(labels))

    # As if one text more had been read wrongly: a faultless sample proves no certainty.
    doubt = 1 / (len(labels) + 2)

    def loss(t: float) -> float:
        chances = np.log(np.maximum(softmax(logits / t), 1e-12))
        return -((1 - doubt) * chances[rows, labels] + doubt * chances.mean(axis=1)).mean()

    fitted.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    chances = softmax(logits / fitted.temperature)
    best = chances.max(axis=1)
    order = np.argsort(-best, kind="stable")
    right = np.cumsum((chances.argmax(axis=1) == labels)[order]) / np.arange(1, len(labels) + 1)
    enough = np.flatnonzero(right >= PRECISION)
    fitted.reject_below = float(best[order][enough[-1]]) if len(enough) else 1.0


def train(docs: DataFrame, lang: str = "lang", max_rows: int = SAMPLE_ROWS,
          max_chars: int = SAMPLE_CHARS) -> LanguageModel | None:
    """A model from the labelled rows of ``docs`` (doc_id, text and ``lang``)."""
    sample = labelled_sample(docs.select("doc_id", "text", F.col(lang).alias("label")), None,
                             max_rows, max_chars)
    model = fit(sample)
    give_back()  # what the driver needed for the sample
    return model


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``."""
    out = T.StructType([T.StructField("lang_pred", T.StringType()),
                        T.StructField("score", T.DoubleType()),
                        T.StructField("rejected", T.BooleanType())])
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0),
                                 "rejected": F.lit(True)})
    known = docs.sparkSession.sparkContext.broadcast(model)
    flag = internal(docs, "has_letter")

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        m = known.value
        chances = m.predict(batch.column(text))
        letter = np.asarray(batch.column(flag).to_pylist(), dtype=bool)
        best, score = chances.argmax(axis=1), np.where(letter, chances.max(axis=1), 0.0)
        return {"lang_pred": pa.array([m.languages[k] if h else "und"
                                       for k, h in zip(best, letter, strict=True)], pa.string()),
                "score": pa.array(np.clip(score, 0, 1)),
                "rejected": pa.array(~letter | (score < m.reject_below))}

    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return map_arrow(docs.withColumn(flag, letters), run, out).drop(flag)
