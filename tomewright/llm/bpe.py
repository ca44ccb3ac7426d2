"""Byte-level BPE encoding and decoding.

A text is cut into pre-tokens. Each distinct one is looked up in two tiers. First, a minimal perfect
hash over the vocabulary, which resolves all pre-tokens that are vocabulary entries as a whole, for
a block at once; the entry's bytes are compared, as such a hash says nothing about strangers.
Second, for the misses, merges by rank: the bytes are a linked list, a heap holds the pairs that
could be merged, and the pair of the lowest rank, leftmost first, is merged until none is left.

What is broadcast is the vocabulary, whose size the rank file gives. Distinct pre-tokens are kept
for later blocks up to a bound.

Cases: null is the empty text, which has no ids. Rows are encoded by themselves. Very long
pre-tokens cost n log n. Special tokens are ordinary text. Columns with the names of added ones are
replaced.
"""

from __future__ import annotations

import base64
import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tomewright.llm import arrays as A
from tomewright.llm import pretokens as P
from tomewright.llm.frames import map_arrow


def read_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary entries and their ranks, which are also their ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def tiktoken_classes() -> np.ndarray:
    """Classes of code points as the patterns of the tiktoken library see them."""
    import tiktoken

    def find(pattern: str, text: str):
        probe = tiktoken.Encoding("probe", pat_str=pattern, special_tokens={},
                                  mergeable_ranks={bytes([b]): b for b in range(256)})
        yield bytes(probe.encode_ordinary(text)).decode()

    return P.classes(find)


class PerfectHash:
    """Minimal perfect hash by displacement: n keys to n slots, no two alike.

    Keys are dealt into n buckets. Buckets of several keys, largest first, get the first
    displacement that puts all their keys on free slots; single keys then take the free slots.
    """

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        self.size = n
        self.shift = np.zeros(n, np.int64)
        bucket = (keys % np.uint64(n)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(n + 1))
        taken = np.zeros(n, dtype=bool)
        sizes = np.diff(starts)
        for b in np.argsort(-sizes, kind="stable"):
            members = keys[order[starts[b]:starts[b + 1]]]
            if len(members) < 2:
                break
            d = 1
            while True:
                slots = self._slots(members, np.array([d], np.uint64))
                if not taken[slots].any() and len(set(slots.tolist())) == len(slots):
                    break
                d += 1
            taken[slots] = True
            self.shift[b] = d
        single = np.flatnonzero(sizes == 1)
        free = np.flatnonzero(~taken)[:len(single)]
        self.shift[single] = -free - 1

    def _slots(self, keys: np.ndarray, shift) -> np.ndarray:
        mixed = A.mix(keys + shift * np.uint64(0x9E3779B97F4A7C15))
        return (mixed % np.uint64(self.size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        shift = self.shift[(keys % np.uint64(self.size)).astype(np.int64)]
        return np.where(shift < 0, -shift - 1,
                        self._slots(keys, np.maximum(shift, 0).astype(np.uint64)))


@dataclass
class Vocabulary:
    ranks: dict[bytes, int]
    classes: np.ndarray
    slots: PerfectHash
    slot_start: np.ndarray  # place of the entry of each slot in the blob
    slot_size: np.ndarray
    slot_id: np.ndarray
    id_start: np.ndarray
    id_size: np.ndarray
    blob: np.ndarray

    @classmethod
    def build(cls, ranks: dict[bytes, int], classes: np.ndarray) -> Vocabulary:
        entries = sorted(ranks, key=ranks.get)
        ids = np.array([ranks[e] for e in entries], np.int64)
        size = np.array([len(e) for e in entries], np.int64)
        start = np.cumsum(size) - size
        blob = np.frombuffer(b"".join(entries), np.uint8)
        slots = PerfectHash(A.ByteRuns(blob)(start, start + size))
        slot = slots(A.ByteRuns(blob)(start, start + size))
        by_slot = np.empty(len(entries), np.int64)
        by_slot[slot] = np.arange(len(entries))
        id_start, id_size = (np.zeros(int(ids.max()) + 1, np.int64) for _ in range(2))
        id_start[ids], id_size[ids] = start, size
        return cls(ranks, classes, slots, start[by_slot], size[by_slot], ids[by_slot], id_start,
                   id_size, blob)

    def whole(self, tokens: P.PreTokens, places: np.ndarray) -> np.ndarray:
        """Ids of the pre-tokens that are vocabulary entries, -1 for the others."""
        slot = self.slots(tokens.hash[places])
        size = tokens.end[places] - tokens.start[places]
        same = np.flatnonzero(self.slot_size[slot] == size)
        n = size[same]
        ours = P.gather(tokens.data, tokens.start[places[same]], n)
        theirs = P.gather(self.blob, self.slot_start[slot[same]], n)
        if len(same):
            equal = np.logical_and.reduceat(ours == theirs, np.cumsum(n) - n)
            same = same[equal]
        ids = np.full(len(places), -1, np.int64)
        ids[same] = self.slot_id[slot[same]]
        return ids

    def decode_rows(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of the ids between each two bounds."""
        size = self.id_size[ids]
        text = P.gather(self.blob, self.id_start[ids], size).tobytes()
        cuts = np.concatenate([[0], np.cumsum(size)])[bounds].tolist()
        return [text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece by merging its bytes, lowest rank first and leftmost of equals."""
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # links between parts
    get = ranks.get
    heap = []
    for k in range(n - 1):
        rank = get(piece[k:k + 2])
        if rank is not None:
            heap.append((rank, k, k + 2))
    heapq.heapify(heap)
    while heap:
        _, k, end = heapq.heappop(heap)
        # A pair is out of date if its left part is gone or one of its parts has grown.
        middle = after[k]
        if middle < 0 or middle >= n or after[middle] != end:
            continue
        after[k] = end
        after[middle] = -1
        if end < n:
            before[end] = k
            far = after[end]
            rank = get(piece[k:far])
            if rank is not None:
                heapq.heappush(heap, (rank, k, far))
        left = before[k]
        if left >= 0:
            rank = get(piece[left:end])
            if rank is not None:
                heapq.heappush(heap, (rank, left, end))
    out, k = [], 0
    while k < n:
        out.append(ranks[piece[k:after[k]]])
        k = after[k]
    return out


#: Bytes of texts that are encoded at once; a block takes some eighty times that meanwhile.
BLOCK_BYTES = 1 << 18


class Encoder:
    """Encodes the texts of a task."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, P.Ids()

    def column(self, column: pa.Array):
        """``(from row, to row, ids, where the ids of each row begin)``, block by block."""
        for at, to, tokens in P.blocks(column, self.vocabulary.classes, BLOCK_BYTES):
            ids, count = self.known.look_up(tokens, lambda places, t=tokens: self._new(t, places))
            ends = np.concatenate([[0], np.cumsum(count)])
            yield at, to, ids, ends[tokens.first]

    def _new(self, tokens: P.PreTokens, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = self.vocabulary.whole(tokens, places)
        count = np.ones(len(places), np.int64)
        misses = np.flatnonzero(whole < 0)
        merged = [merge(t, self.vocabulary.ranks) for t in tokens.texts(places[misses])]
        count[misses] = [len(m) for m in merged]
        ids = np.empty(int(count.sum()), np.int32)
        hit = np.repeat(whole >= 0, count)
        ids[hit] = whole[whole >= 0]
        ids[~hit] = [i for m in merged for i in m]
        return ids, count


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids",
           decoded: str | None = None) -> DataFrame:
    """``docs`` with the ids of ``text`` and, if it has a name, with the bytes they decode to."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kept: list[Encoder] = []
    added = [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    if decoded:
        added.append(T.StructField(decoded, T.BinaryType()))

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        if not kept:
            kept.append(Encoder(known.value))
        parts, counts, back = [], [], []
        for _, _, got, first in kept[0].column(batch.column(text)):
            parts.append(got)
            counts.append(np.diff(first))
            if decoded:
                back += known.value.decode_rows(got, first)
        made = {ids: list_array(parts, counts)}
        if decoded:
            made[decoded] = pa.array(back, pa.binary())
        return made

    return map_arrow(docs, run, T.StructType(added))


def list_array(parts: list[np.ndarray], counts: list[np.ndarray],
               kind: pa.DataType = pa.int32()) -> pa.Array:
    values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    lengths = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets),
                                    pa.array(values.astype(kind.to_pandas_dtype())))


def decode(docs: DataFrame, vocabulary: Vocabulary, ids: str = "ids",
           text: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that ``ids`` stand for; null ids stand for none."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        column = batch.column(ids)
        values = np.asarray(column.flatten())
        lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        return {text: pa.array(known.value.decode_rows(values, bounds), pa.binary())}

    return map_arrow(docs, run, T.StructType([T.StructField(text, T.BinaryType())]))
