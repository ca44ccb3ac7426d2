"""Which texts could hold which strings, by the runs of one to three characters that both have.

A run is known by a cell of a fixed number of cells; two runs may share a cell, so what is found is
checked afterwards. A string is looked for by one run only: the longest it has, and of these one that
the fewest texts hold. Neither strings nor texts are ever compared all with all, and nothing is
broadcast but one bit for each cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 20
LONGEST = 3
_CHUNK_CHARS = 1 << 18
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def cells(texts: list[str], longest_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """``(number of a text, cell)`` of all runs of some texts, each pair once.

    With ``longest_only`` only those of the longest length that a text has.
    """
    size = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(
        np.uint64)
    row = np.repeat(np.arange(len(texts)), size)
    found = []
    for n in range(1, LONGEST + 1):
        at = len(points) - n + 1
        if at <= 0:
            break
        inside = row[:at] == row[n - 1:]
        if longest_only and n < LONGEST:
            inside &= size[row[:at]] == n
        run = np.full(at, n, np.uint64)
        for k in range(n):
            run = (run ^ points[k:k + at]) * _FACTORS[k]
            run ^= run >> np.uint64(29)
        cell = (run * _FACTORS[0]) >> np.uint64(64 - BITS)
        found.append((row[:at][inside].astype(np.uint64) << np.uint64(BITS)) | cell[inside])
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
    return (both >> np.uint64(BITS)).astype(np.int64), (both & np.uint64((1 << BITS) - 1)).astype(
        np.int32)


def _chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Numbers of texts and the texts, some at a time; a long one comes in pieces that overlap.

    Only what is given out leaves Arrow's memory, and no more than twice ``_CHUNK_CHARS`` bytes of it.
    """
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + _CHUNK_CHARS, "right")))
        some = [t or "" for t in texts.slice(at, to - at).to_pylist()]
        if len(some) > 1 or len(some[0]) <= _CHUNK_CHARS:
            yield np.arange(at, to), some
        else:
            for begin in range(0, len(some[0]), _CHUNK_CHARS):
                yield np.array([at]), [some[0][begin:begin + _CHUNK_CHARS + LONGEST - 1]]
        at = to


def _held(bits: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (bits[cell >> 6] >> (cell & 63).astype(np.uint64)) & np.uint64(1) != 0


def _bits(df: DataFrame) -> np.ndarray:
    """One bit for each cell that ``df`` has."""
    words = df.groupBy(F.shiftright("cell", 6).alias("word")).agg(F.bit_or(
        F.expr("shiftleft(1L, cell & 63)")).alias("bits")).collect()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    for r in words:
        out[r["word"]] = r["bits"] & 0xFFFFFFFFFFFFFFFF
    return out


def candidates(strings: DataFrame, texts: DataFrame) -> DataFrame:
    """``string, id``: texts that could hold a string, and all that do.

    ``strings`` has ``string``, distinct and not empty; ``texts`` has ``id`` and an array ``texts``.
    """
    spark = strings.sparkSession

    def of_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, cell = cells(batch.column(0).to_pylist(), longest_only=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(cell)],
                                             names=["string", "cell"])

    def of_texts(batch: pa.RecordBatch, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of rows and their cells that are asked for, each pair once."""
        column = batch.column("texts")
        owner = np.repeat(np.arange(batch.num_rows), column.value_lengths().to_numpy(
            zero_copy_only=False))
        both, pairs, held = np.zeros(0, np.int64), [], 0
        for numbers, some in _chunks(column.flatten()):
            row, cell = cells(some)
            keep = _held(bits, cell)
            pairs.append(np.unique((owner[numbers[row[keep]]].astype(np.int64) << BITS)
                                   | cell[keep]))
            held += len(pairs[-1])
            if held > max(_CHUNK_CHARS, len(both)):  # rows have the same runs in many chunks
                both, pairs, held = np.unique(np.concatenate([both, *pairs])), [], 0
        both = np.unique(np.concatenate([both, *pairs]))
        return both >> BITS, (both & ((1 << BITS) - 1)).astype(np.int32)

    asked = strings.mapInArrow(of_strings, "string string, cell int")
    wanted = spark.sparkContext.broadcast(_bits(asked))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            total += np.bincount(of_texts(batch, wanted.value)[1], minlength=1 << BITS)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])],
                                         names=["cell", "n"])

    counts = (texts.select("texts").mapInArrow(count, "cell int, n long").groupBy("cell")
              .agg(F.sum("n").alias("n")))
    # A string with a run that no text holds is in none.
    rarest = (asked.join(counts, "cell", "left").groupBy("string")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "cell")).alias("least"))
              .where("least.n > 0").select("string", "least.cell"))
    looked_for = spark.sparkContext.broadcast(_bits(rarest))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, cell = of_texts(batch, looked_for.value)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)),
                                              pa.array(cell)], names=["id", "cell"])

    where = texts.select("id", "texts").mapInArrow(places, "id long, cell int")
    return where.join(rarest, "cell").select("string", "id")
