"""Averaged hashed subword embeddings with a linear softmax, trained by gradient descent in numpy.

A word ``w`` is the bag of the byte n-grams of ``<w>`` and of itself whole, each hashed to a row of
the embedding table; its vector is their mean. A span's vector is the mean of its words, and its
class scores are linear in that. As means and scores are linear, a trained model is applied as one
table: the class scores of every bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tomewright.llm import arrays as A


@dataclass(frozen=True)
class Shape:
    grams: tuple[int, ...] = (2, 3, 4)
    bits: int = 16
    dim: int = 16


def min_texts(texts: int) -> int:
    """Texts of a sample that a bucket must occur in: a two-hundredth of them, 2 to 10."""
    return min(10, max(2, texts // 200))


def batch_size(spans: int, most: int) -> int:
    """Spans of a step: such that an epoch has 64 steps, 32 to ``most``."""
    return min(most, max(32, spans // 64))


def subwords(words: A.Words, places: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words at ``places``, word after word, and where each word's buckets start."""
    start, size = words.start[places], words.end[places] - words.start[places]
    # "<" + word + ">" for all words in a row.
    begin = np.concatenate([[0], np.cumsum(size + 2)])
    data = np.full(begin[-1], ord("<"), dtype=np.uint8)
    data[begin[1:] - 1] = ord(">")
    inner = np.arange(begin[-1])
    owner = np.repeat(np.arange(len(places)), size + 2)
    offset = inner - begin[owner]
    inside = (offset > 0) & (offset <= size[owner])
    data[inside] = words.data[start[owner[inside]] + offset[inside] - 1]
    runs = A.ByteRuns(data)
    found, owners = [runs(begin[:-1], begin[1:])], [np.arange(len(places))]
    for n in shape.grams:
        at = np.flatnonzero(offset + n <= size[owner] + 2)
        found.append(runs(at, at + n))
        owners.append(owner[at])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    buckets = (np.concatenate(found) >> np.uint64(64 - shape.bits)).astype(np.int32)[order]
    return buckets, np.searchsorted(owners[order], np.arange(len(places) + 1))


def distinct(words: A.Words) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct word, and the number of the distinct word at each place."""
    _, places, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
    return places, inverse


def word_means(table: np.ndarray, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean rows of ``table`` by word; each word has one bucket at least."""
    if len(first) < 2:
        return np.zeros((0, table.shape[1]), table.dtype)
    return np.add.reduceat(table[buckets], first[:-1], axis=0) / np.diff(first)[:, None].astype(
        table.dtype)


def word_scores(words: A.Words, scores: np.ndarray, shape: Shape) -> np.ndarray:
    """Class scores of every word of a block; distinct words are worked out once."""
    places, inverse = distinct(words)
    out = np.empty((len(places), scores.shape[1]), np.float32)
    for at in range(0, len(places), 1 << 13):  # bounds the memory of a block of odd words
        some = places[at:at + (1 << 13)]
        out[at:at + len(some)] = word_means(scores, *subwords(words, some, shape))
    return out[inverse]


class Corpus:
    """Training texts as words, with the subwords of each distinct word.

    Texts are read block by block, so memory is that of a block and of what is kept: a number for
    each word, and the buckets of each distinct word.
    """

    def __init__(self, texts: list[str], shape: Shape):
        hashes, counts, seen = [], [], np.zeros(0, np.uint64)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # hashes, buckets, sizes
        for _, _, words in A.block_words(pa.array(texts, pa.large_string()), A.ALNUM):
            hashes.append(words.hash)
            counts.append(words.counts)
            places, _ = distinct(words)
            places = places[~np.isin(words.hash[places], seen)]
            if len(places):
                buckets, first = subwords(words, places, shape)
                kept.append((words.hash[places], buckets, np.diff(first)))
                seen = np.concatenate([seen, words.hash[places]])
        none = np.zeros(0, np.int64)
        self.row = np.concatenate([[0], np.cumsum(np.concatenate([none, *counts]))]).astype(int)
        known, self.word = np.unique(np.concatenate([seen[:0], *hashes]), return_inverse=True)
        order = np.argsort(seen)  # of the same words, so their n-th is the n-th known
        sizes = np.concatenate([none, *(k[2] for k in kept)])
        starts = np.cumsum(sizes) - sizes
        buckets = np.concatenate([np.zeros(0, np.int32), *(k[1] for k in kept)])
        sizes, starts = sizes[order], starts[order]
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.buckets = buckets[np.repeat(starts - self.first[:-1], sizes)
                               + np.arange(self.first[-1])]
        assert len(known) == len(sizes)

    def spans(self, rng: np.random.Generator, longest: int, shortest: int) -> np.ndarray:
        """Each text cut into spans of random lengths: rows of (text, first word, end)."""
        total = int(self.row[-1])
        cuts = np.cumsum(rng.integers(shortest, longest + 1, total // shortest + 1))
        borders = np.unique(np.concatenate([cuts[cuts < total], self.row]))
        text = np.searchsorted(self.row, borders[:-1], side="right") - 1
        return np.stack([text, borders[:-1], borders[1:]], axis=1)

    def text_counts(self, bits: int) -> np.ndarray:
        """Number of texts that each bucket occurs in."""
        counts = np.zeros(1 << bits, np.int64)
        for text in range(len(self.row) - 1):
            used = np.unique(self.word[self.row[text]:self.row[text + 1]])
            counts[np.unique(self.buckets[self.places(used)[0]])] += 1
        return counts

    def places(self, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the buckets of some distinct words are, and how many each word has."""
        count = self.first[used + 1] - self.first[used]
        before = np.cumsum(count) - count
        return np.repeat(self.first[used] - before, count) + np.arange(count.sum()), count


class Model:
    """Embeddings and a linear softmax, with AdaGrad steps.

    Buckets that occur in fewer than ``min_texts`` texts keep a vector of zeros: what is seen once
    or twice tells texts apart that the classes do not.
    """

    def __init__(self, corpus: Corpus, shape: Shape, classes: int, min_texts: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.shape, self.classes = shape, classes
        self.rare = corpus.text_counts(shape.bits) < min_texts
        self.table = rng.uniform(-0.1, 0.1, (1 << shape.bits, shape.dim)).astype(np.float32)
        self.table[self.rare] = 0
        self.linear = rng.normal(0, 0.5, (shape.dim, classes)).astype(np.float32)
        self.bias = np.zeros(classes, np.float32)
        self._seen = [np.full(x.shape, 1e-6, np.float32) for x in (
            self.table, self.linear, self.bias)]

    def bucket_scores(self) -> np.ndarray:
        return self.table @ self.linear

    def step(self, corpus: Corpus, spans: np.ndarray, labels: np.ndarray, weights: np.ndarray,
             rate: float) -> None:
        """One step on some spans."""
        size = spans[:, 2] - spans[:, 1]
        at = np.repeat(spans[:, 1] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        at = at + np.arange(len(at))
        used, word = np.unique(corpus.word[at], return_inverse=True)
        place, count = corpus.places(used)
        first = np.concatenate([[0], np.cumsum(count)])
        buckets = corpus.buckets[place]
        vectors = word_means(self.table, buckets, first)
        borders = np.concatenate([[0], np.cumsum(size)])
        share = (1 / size).astype(np.float32)[:, None]
        span = np.add.reduceat(vectors[word], borders[:-1], axis=0) * share
        error = softmax(span @ self.linear + self.bias)
        error[np.arange(len(labels)), labels] -= 1
        error *= (weights / weights.sum())[:, None].astype(np.float32) * len(labels)

        to_span = (error @ self.linear.T) * share
        order = np.argsort(word, kind="stable")
        starts = np.searchsorted(word[order], np.arange(len(used)))
        to_word = np.add.reduceat(np.repeat(to_span, size, axis=0)[order], starts, axis=0)
        to_word /= count[:, None].astype(np.float32)
        order = np.argsort(buckets, kind="stable")
        rows, starts = np.unique(buckets[order], return_index=True)
        to_row = np.add.reduceat(to_word[np.repeat(np.arange(len(used)), count)[order]], starts,
                                 axis=0)
        n = len(labels)
        for seen, target, index, grad in (
                (self._seen[0], self.table, rows, to_row / n),
                (self._seen[1], self.linear, slice(None), span.T @ error / n),
                (self._seen[2], self.bias, slice(None), error.mean(axis=0))):
            seen[index] += grad * grad
            target[index] -= rate * grad / np.sqrt(seen[index])
        self.table[self.rare] = 0


def softmax(scores: np.ndarray) -> np.ndarray:
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    return scores / scores.sum(axis=1, keepdims=True)
