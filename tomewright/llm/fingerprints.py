"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of seven bytes ends a chunk wherever it meets a pattern that the block size sets, so
chunks stand where the text says and an edit changes the chunks around it only. A signature has a
character per chunk. A fingerprint is ``block size:signature:signature at twice that size``; the
block size follows the length of the text, halved while the signature would be short.

Two fingerprints are compared where they have signatures at one block size: 1 less the edit
distance (insertions and deletions) over both lengths, and 0 where no run of seven characters (or
the shorter signature, if it is shorter) is shared.

Cases: null is the empty text; empty texts have the fingerprint ``3::`` and are alike. Equal texts
have equal fingerprints. Nothing is cut: a long text has a larger block size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomewright.llm import arrays as A
from tomewright.llm.frames import map_arrow
from tomewright.llm.ordered import range_bounds, range_number

#: Bytes that the rolling hash sees.
ROLL = 7
#: The smallest block size; others are this times a power of two.
SMALLEST = 3
#: Chunks that the block size aims at, and half of it the fewest.
CHUNKS = 64
#: Characters that two signatures must share in a row.
SHARED = 7

_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
                          np.uint8)
_LEVELS = 40


def _block(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    """Fingerprints of the rows of one block."""
    n, sizes = len(offsets) - 1, np.diff(offsets)
    runs = A.ByteRuns(data)
    ends = np.arange(ROLL, len(data) + 1)
    roll = runs(ends - ROLL, ends) >> np.uint64(8)
    # A chunk ends at block size 3 * 2^k where 3 divides the hash and it has k zeros at its end.
    at = np.flatnonzero(roll % np.uint64(SMALLEST) == 0)
    low = roll[at] & (~roll[at] + np.uint64(1))
    level = np.minimum(np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)), _LEVELS - 1)
    level, end = level.astype(np.int64), at + ROLL
    row = np.searchsorted(offsets, end - 1, side="right") - 1
    own = (end - ROLL >= offsets[row]) & (end < offsets[row + 1])  # the last chunk ends anyway
    level, end, row = level[own], end[own], row[own]

    # Chunk ends of each row from each level up.
    ends_at = np.bincount(row * _LEVELS + level, minlength=n * _LEVELS).reshape(n, _LEVELS)
    ends_from = ends_at[:, ::-1].cumsum(axis=1)[:, ::-1]
    chosen = np.ceil(np.log2(np.maximum(1, sizes / (SMALLEST * CHUNKS)))).astype(np.int64)
    chosen = np.minimum(chosen, _LEVELS - 2)
    while True:
        short = (chosen > 0) & (ends_from[np.arange(n), chosen] + 1 < CHUNKS // 2)
        if not short.any():
            break
        chosen[short] -= 1

    def signatures(levels: np.ndarray) -> list[str]:
        kept = level >= levels[row]
        stops = np.sort(np.concatenate([end[kept], offsets[1:][sizes > 0]]))
        starts = np.concatenate([[0], stops[:-1]]).astype(np.int64)
        chars = _ALPHABET[(runs(starts, stops) >> np.uint64(58)).astype(np.int64)].tobytes()
        cuts = np.searchsorted(stops, offsets, side="right")
        return [chars[a:b].decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    one, two = signatures(chosen), signatures(chosen + 1)
    return [f"{SMALLEST << int(k)}:{a}:{b}" for k, a, b in zip(chosen, one, two, strict=True)]


def fingerprint_column(column: pa.Array) -> list[str]:
    data, offsets = A.text_buffer(column)
    out: list[str] = []
    for at, to in A.row_blocks(offsets):
        out += _block(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at])
    return out


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a word of bits at a time."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    run = min(SHARED, len(a), len(b))
    if not run:
        return 0.0
    grams = {a[k:k + run] for k in range(len(a) - run + 1)}
    if not any(b[k:k + run] in grams for k in range(len(b) - run + 1)):
        return 0.0
    return 2 * _common(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """How alike two fingerprints are, 0 to 1; 0 where no block size is shared."""
    if a == b:
        return 1.0
    size_a, a1, a2 = a.split(":")
    size_b, b1, b2 = b.split(":")
    size_a, size_b = int(size_a), int(size_b)
    if size_a == size_b:
        return max(_alike(a1, b1), _alike(a2, b2))
    if size_a == 2 * size_b:
        return _alike(a1, b2)
    if size_b == 2 * size_a:
        return _alike(a2, b1)
    return 0.0


def with_fingerprint(docs: DataFrame, text: str = "text",
                     name: str = "fingerprint") -> DataFrame:
    return map_arrow(docs, lambda batch: {name: pa.array(fingerprint_column(batch.column(text)),
                                                         pa.string())},
                     T.StructType([T.StructField(name, T.StringType())]))


EDITS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_chars", T.LongType()),
    T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()),
    T.StructField("near_next", T.DoubleType())])


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``EDITS`` of the rows of a range, each of which is followed by the next one.

    The last row is a guest: the first of the next range, or its own copy where there is none.
    """
    kept: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([kept, rows]) if kept is not None else rows
        at = 0
        # Rows overlap by one from block to block; each is fingerprinted as a row and as a next.
        offsets = A.text_buffer(rows.column("text"))[1]
        for begin, to in A.row_blocks(offsets):
            to = min(to, rows.num_rows - 1)
            if begin < to:
                yield _edits(rows.slice(begin, to + 1 - begin))
                at = to
        kept = rows.slice(at)


def _edits(rows: pa.Table) -> pa.RecordBatch:
    texts = [t or "" for t in rows.column("text").to_pylist()]
    own, ids = rows.column("own").to_pylist(), rows.column("doc_id").to_pylist()
    prints = fingerprint_column(pa.array(texts, pa.large_string()))
    edited = []
    for text, after in zip(texts, texts[1:], strict=False):
        k = len(text) // 3
        edited.append(text[:len(text) - k] + after[:k])
    changed = fingerprint_column(pa.array(edited, pa.large_string()))
    out = {f.name: [] for f in EDITS}
    for k, now in enumerate(changed):
        if not own[k]:
            continue
        for name, value in (("doc_id", ids[k]), ("n_chars", len(texts[k])),
                            ("edited_sha256", hashlib.sha256(edited[k].encode()).hexdigest()),
                            ("fingerprint", prints[k]), ("edited_fingerprint", now),
                            ("near_edited", likeness(prints[k], now)),
                            ("near_next", likeness(prints[k], prints[k + 1]))):
            out[name].append(value)
    kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.DoubleType(): pa.float64()}
    return pa.RecordBatch.from_arrays(
        [pa.array(out[f.name], kinds[f.dataType]) for f in EDITS], names=EDITS.names)


def compare_with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each document with its edited text and the next document, in descending order of ids.

    Ties and null ids (which come last) go by a hash of the text. Texts are dealt once, by ranges
    of ids; the first row of each range also goes to the range before it. What the driver learns
    is one id per range.
    """
    n = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(docs, "doc_id", n)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"),
                       F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"))
    number = range_number("doc_id", bounds)
    place = F.struct(F.col("doc_id").alias("doc_id"), F.col("h").alias("h"))
    heads = {r["number"]: r["head"] for r in rows.groupBy(number.alias("number")).agg(
        F.max(place).alias("head")).collect()}
    if not heads:
        return docs.sparkSession.createDataFrame([], EDITS)
    full = sorted(heads)
    # The rows above a range, which have greater ids, are followed by its head; the very first
    # head follows the lowest range.
    above = dict(zip(full, [*full[1:], full[0]], strict=True))

    def by_range(values: dict, kind: str) -> Column:
        return F.element_at(F.array(*[F.lit(values.get(k)).cast(kind)
                                      for k in range(len(bounds) + 1)]), number + 1)

    is_head = (F.col("doc_id").eqNullSafe(by_range({k: h[0] for k, h in heads.items()}, "long"))
               & (F.col("h") == by_range({k: h[1] for k, h in heads.items()}, "long")))
    stays = F.struct(number.alias("to"), F.lit(True).alias("own"))
    goes = F.struct(by_range(above, "int").alias("to"), F.lit(False).alias("own"))
    dealt = rows.withColumn("copy", F.explode(
        F.when(is_head, F.array(stays, goes)).otherwise(F.array(stays))))
    return (dealt.select("doc_id", "text", "h", "copy.to", "copy.own")
            .repartitionById(len(bounds) + 1, F.col("to"))
            .sortWithinPartitions(F.col("own").desc(), F.col("doc_id").desc(), F.col("h").desc())
            .select("doc_id", "text", "own").mapInArrow(_followed, EDITS))
