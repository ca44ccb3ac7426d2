"""Small things that the operators share on the side of DataFrames."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomewright.operators.ordering import use_checkpoint_dir


#: Rows that are worked on at once.
BATCH_ROWS = 1000
#: Numbers in one block of a summed vector.
VECTOR_BLOCK = 1 << 16
#: Rows behind a shuffle that are worth a task of their own.
TASK_ROWS = 1 << 16


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``)."""
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: later reads need no executor that made it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few_tasks(df: DataFrame, rows: int, row_size: int = 1) -> DataFrame:
    """``df`` of about ``rows`` rows in no more tasks than these are worth, but one for each core.

    A small table behind a shuffle would else be as many tasks and files as there are shuffle
    partitions. With many rows nothing changes. ``row_size`` is how many narrow rows a row counts for.
    """
    worth = -(-rows * row_size // TASK_ROWS)
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, worth))


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.pmod(F.crc32(F.coalesce(text, F.lit("")).cast("binary")), F.lit(modulus))


def internal(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``BATCH_ROWS`` rows at a time; behind each batch, workers give back the memory they hold free."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)
        del batch
        give_back()


def give_back() -> None:
    """Free memory of this process to the system: workers are kept, and others need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, pa.Array]],
              added: T.StructType) -> DataFrame:
    """``df`` and the columns that ``fn`` makes of each ``BATCH_ROWS`` of its rows.

    Columns of ``df`` with a name of an added one are replaced. Results leave the task as they are
    made, so it never holds those of a whole batch of Spark's.
    """
    names = {f.name.lower() for f in added}
    kept = [f for f in df.schema if f.name.lower() not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = fn(batch)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in kept), *(made[f.name] for f in added)],
                names=[*(f.name for f in kept), *(f.name for f in added)])

    return df.mapInArrow(run, T.StructType([*kept, *added]))


def sum_vectors(parts: DataFrame, size: int, dtype=np.float32, put=np.add) -> np.ndarray:
    """Sum, over all tasks, of vectors that each task gives in blocks ``(block, values)``.

    Instead of the sum another function of two vectors may ``put`` them together.

    ``values`` is the binary form of a slice. Blocks of one number meet in one task, which adds
    them up as they come; the driver receives one row per block, ``size`` numbers in all.
    """
    kind = np.dtype(dtype).str

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.frombuffer(values.as_buffer(), kind)
                sums[block] = put(sums[block], got) if block in sums else got
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()),
                 pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                names=["block", "values"])

    total = np.zeros(size, dtype=dtype)
    cores = parts.sparkSession.sparkContext.defaultParallelism
    blocks = parts.repartition("block").coalesce(min(2 * cores, max(1, -(-size // VECTOR_BLOCK))))
    for row in blocks.mapInArrow(add, "block int, values binary").collect():
        got = np.frombuffer(row["values"], kind)
        total[row["block"] * VECTOR_BLOCK:][:len(got)] = got
    return total


def vector_rows(vector: np.ndarray) -> pa.RecordBatch:
    """The blocks of one task's vector, as ``sum_vectors`` takes them; blocks of zeros are left out."""
    slices = [(k, vector[at:at + VECTOR_BLOCK])
              for k, at in enumerate(range(0, len(vector), VECTOR_BLOCK))]
    slices = [(k, s) for k, s in slices if s.any()]
    return pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in slices], pa.int32()),
         pa.array([s.tobytes() for _, s in slices], pa.binary())], names=["block", "values"])
