"""Rows in the order of an integer id, one range of ids per partition."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.llm.frames import internal


def range_bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most ``n - 1`` ids that cut the rows into about equal ranges; nulls come below all."""
    if n < 2:
        return []
    cuts = df.select(F.percentile_approx(key, [k / n for k in range(1, n)], 10 * n)
                     .alias("cuts")).first()["cuts"] or []
    return sorted(set(cuts))


def range_number(key: str | Column, bounds: list[int]) -> Column:
    """How many bounds are not above the id: the number of its range. Null gives 0.

    Bounds are looked up in two steps, so the work for a row is the square root of their number.
    """
    key = F.col(key) if isinstance(key, str) else key
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds) - 1) + 1
    parts = [bounds[k:k + width] for k in range(0, len(bounds), width)]

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b <= key))

    coarse = below(F.array(*[F.lit(p[0]).cast("long") for p in parts]))
    fine = F.array(*[F.array(*[F.lit(b).cast("long") for b in p]) for p in parts])
    number = (coarse - 1) * width + below(F.element_at(fine, coarse))
    return F.when(key.isNull() | (coarse == 0), 0).otherwise(number).cast("int")


def in_ranges(df: DataFrame, key: str, bounds: list[int], *order: Column) -> DataFrame:
    """``df`` with one range of ids per partition, in order of their number, sorted by ``order``."""
    number = internal(df, "range_number")
    return (df.withColumn(number, range_number(key, bounds))
            .repartitionById(len(bounds) + 1, F.col(number)).drop(number)
            .sortWithinPartitions(*order))
