"""Benchmark decontamination.

The word windows of the benchmark are normalised, hashed and broadcast as a set: a bit filter in
front of a sorted table. Training texts are scanned window by window with array operations; what
hits the set is compared word for word; then the words covered, or the document, can be removed.

The broadcast is bounded: items are dealt into blocks of at most about ``max_windows`` windows,
and a larger benchmark is scanned for block after block, each adding to what was found before.

Cases: null and empty texts have no words and are clean. Items without words, or null, occur
nowhere. An item of fewer than ``n`` words is one window. Items with one id are one item; equal
rows give equal results. An empty benchmark leaves everything clean. Columns of the documents are
kept; those with the name of an added one are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomewright.llm import arrays as A
from tomewright.llm.frames import map_arrow

#: Words of a window.
WINDOW = 10
#: Windows that one broadcast set may hold; a window takes about 100 bytes.
MAX_WINDOWS = 1_000_000

_FILTER_BITS = 22

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_from", T.ArrayType(T.IntegerType())),
    T.StructField("hit_to", T.ArrayType(T.IntegerType())),
    T.StructField("item_ids", T.ArrayType(T.LongType()))])


@dataclass
class WindowSet:
    """Windows by hash. ``texts[k]`` are the words of window k, ``items[k]`` where it is from."""

    filter: np.ndarray
    hashes: np.ndarray  # sorted
    texts: list[bytes]
    items: list[tuple[int, ...]]
    lengths: list[int]

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Places of ``hashes`` that are in the set."""
        maybe = np.flatnonzero(self.filter[hashes >> np.uint64(64 - _FILTER_BITS)])
        at = np.searchsorted(self.hashes, hashes[maybe])
        at[at == len(self.hashes)] = 0
        return maybe[self.hashes[at] == hashes[maybe]]


def build(items: list[tuple[int, str]], n: int = WINDOW) -> WindowSet:
    """The windows of a block of the benchmark."""
    found: dict[tuple[int, bytes], set[int]] = {}
    lengths: set[int] = set()
    rows = [(i, t) for i, t in items if i is not None]
    for at, to, words in A.block_words(pa.array([t for _, t in rows], pa.string()), A.ALNUM):
        for r in range(to - at):
            lo, hi = words.first[r], words.first[r + 1]
            size = min(n, hi - lo)
            if not size:
                continue
            lengths.add(int(size))
            for k in range(lo, hi - size + 1):
                text = b" ".join(words.text(j) for j in range(k, k + size))
                run = A.RunHash(words.hash[k:k + size])(np.array([0]), np.array([size]))
                found.setdefault((int(run[0]), text), set()).add(rows[at + r][0])
    keys = sorted(found)
    hashes = np.array([h for h, _ in keys], dtype=np.uint64)
    bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
    bits[hashes >> np.uint64(64 - _FILTER_BITS)] = True
    return WindowSet(bits, hashes, [t for _, t in keys], [tuple(sorted(found[k])) for k in keys],
                     sorted(lengths))


def _merge(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of some spans of words."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if starts and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _scan_block(words: A.Words, known: WindowSet) -> dict[int, tuple[list, set]]:
    """Hit spans and items by row of a block."""
    hits: dict[int, tuple[list, set]] = {}
    for size in known.lengths:
        at, hashes = A.windows(words, size)
        if not len(at):
            continue
        for p in known.probe(hashes):
            k = int(at[p])
            text = b" ".join(words.text(j) for j in range(k, k + size))
            w = int(np.searchsorted(known.hashes, hashes[p]))
            while w < len(known.hashes) and known.hashes[w] == hashes[p]:
                if known.texts[w] == text:
                    row = int(np.searchsorted(words.first, k, side="right")) - 1
                    spans, items = hits.setdefault(row, ([], set()))
                    begin = k - int(words.first[row])
                    spans.append((begin, begin + size))
                    items.update(known.items[w])
                    break
                w += 1
    return hits


def _scan(docs: DataFrame, text: str, known, first_block: bool) -> DataFrame:
    def find(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        rows = batch.num_rows
        counts = np.zeros(rows, dtype=np.int64)
        if first_block:
            starts, ends, items = ([[] for _ in range(rows)] for _ in range(3))
        else:
            starts, ends, items = (batch.column(f.name).to_pylist() for f in list(FOUND)[1:])
        for at, to, words in A.block_words(batch.column(text), A.ALNUM):
            counts[at:to] = words.counts
            for r, (spans, got) in _scan_block(words, known.value).items():
                spans += zip(starts[at + r], ends[at + r])
                starts[at + r], ends[at + r] = _merge(spans)
                items[at + r] = sorted(got.union(items[at + r]))
        return {"n_words": pa.array(counts, pa.int64()),
                "hit_from": pa.array(starts, pa.list_(pa.int32())),
                "hit_to": pa.array(ends, pa.list_(pa.int32())),
                "item_ids": pa.array(items, pa.list_(pa.int64()))}

    return map_arrow(docs, find, FOUND)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text: str = "text",
                   item: str = "item_id", item_text: str = "text",
                   max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` with ``n_words``, the spans of words hit (``hit_from``, ``hit_to``) and ``item_ids``."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).cast("long").alias("id"), F.col(item_text).alias("t"))
    # A word takes two characters at least, but for the last.
    most = items.agg(F.sum(F.length("t") / 2 + 1)).first()[0] or 0
    blocks = int(most // max_windows) + 1
    for block in range(blocks):
        part = items if blocks == 1 else items.where(
            F.pmod(F.xxhash64("t"), F.lit(blocks)) == block)
        known = spark.sparkContext.broadcast(build([tuple(r) for r in part.collect()], n))
        docs = _scan(docs, text, known, block == 0)
    return docs


def n_hit() -> F.Column:
    return F.coalesce(F.aggregate(F.zip_with("hit_to", "hit_from", lambda b, a: b - a),
                                  F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long")


def remove_documents(found: DataFrame) -> DataFrame:
    """Documents without a hit, without the columns of ``find_benchmark``."""
    return found.where(F.size("item_ids") == 0).drop(*FOUND.names)


def remove_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """All documents; a hit span, with what stands between its words, becomes one space."""
    def cut(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = batch.column(text).to_pylist()
        starts, ends = (batch.column(c).to_pylist() for c in ("hit_from", "hit_to"))
        for at, to, words in A.block_words(batch.column(text), A.ALNUM):
            for r in range(at, to):
                if not starts[r]:
                    continue
                raw, first = texts[r].encode(), int(words.first[r - at])
                origin, kept, done = int(words.offsets[r - at]), [], 0
                for a, b in zip(starts[r], ends[r], strict=True):
                    kept.append(raw[done:int(words.start[first + a]) - origin])
                    done = int(words.end[first + b - 1]) - origin
                texts[r] = b" ".join([*kept, raw[done:]]).decode()
        return {text: pa.array(texts, pa.string())}

    order = found.columns
    return (map_arrow(found, cut, T.StructType([found.schema[text]]))
            .select(*[c for c in order if c not in FOUND.names]))
