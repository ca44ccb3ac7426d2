"""Exact global order without a single-task sort."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# ``monotonically_increasing_id`` keeps the partition above, and the row below, this bit.
_PARTITION_SHIFT = 33


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Make sure checkpoints go where every executor can read them.

    The cluster names that folder in ``spark.checkpoint.dir``. Without the setting a folder of
    this machine is used, which is only right where driver and executors share the machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = tempfile.mkdtemp(prefix="tomewright-checkpoint-")
    sc.setCheckpointDir(shared)


def freeze(df: DataFrame) -> DataFrame:
    """Write ``df`` out once and go on from what was written."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def with_ordinal(df: DataFrame, *keys: str | Column, name: str = "ordinal") -> DataFrame:
    """Number rows 0, 1, 2 ... in the order of ``keys``, which must tell all rows apart.

    Rows are range-partitioned and sorted in parallel; a row's number is the size of the
    partitions before its own plus its place in it. The only thing gathered is one count per
    partition.
    """
    placed = freeze(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                    .withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", _PARTITION_SHIFT)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0))
                          .alias("__start"))
    place = F.col("__at").bitwiseAND(F.lit((1 << _PARTITION_SHIFT) - 1))
    return (placed.withColumn("__part", part)
            .join(F.broadcast(starts), "__part")  # one row per partition
            .withColumn(name, F.col("__start") + place)
            .drop("__at", "__part", "__start"))
