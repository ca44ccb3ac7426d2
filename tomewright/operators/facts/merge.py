"""Facts of many files as facts of the entry that covers them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomewright import constants as K
from tomewright.functions.text import cut, replace_all


def merge_facts(facts: DataFrame, members: DataFrame) -> DataFrame:
    """``group_id, kind, rank, value`` for ``members(group_id, path)``.

    Each value once, in the order of files and of places in them, and only so many of a kind; the
    purpose is the first there is. Repeats are removed first, wherever the rows are, and the cap
    is applied before the rows of a group meet, so a large group costs no task more than its cap
    per partition.
    """
    first = (facts.join(members, "path").where("value IS NOT NULL")
             .groupBy("group_id", "kind", "value")
             .agg(F.min(F.struct("path", "ord")).alias("at")))
    rank = F.row_number().over(Window.partitionBy("group_id", "kind").orderBy("at", "value"))
    caps = F.create_map(*[F.lit(x) for kv in {"purpose": 1, **K.FACT_CAPS}.items() for x in kv])
    most = max(K.FACT_CAPS.values())
    return (first.withColumn("rank", rank).where(F.col("rank") <= most)
            .where(F.col("rank") <= F.element_at(caps, F.col("kind")))
            .select("group_id", "kind", "rank", "value"))


def describe(merged: DataFrame, groups: DataFrame) -> DataFrame:
    """``group_id, description`` for ``groups(group_id, category)``."""
    def pick(kind: str, rank: int):
        return F.max(F.when((F.col("kind") == kind) & (F.col("rank") == rank), F.col("value")))

    best = merged.groupBy("group_id").agg(
        pick("purpose", 1).alias("purpose"), pick("responsibilities", 1).alias("duty"),
        *[pick("apiSurface", n).alias(f"api{n}") for n in (1, 2, 3)])
    limit = K.DESCRIPTION_CHARS
    duty = replace_all(F.col("duty"), r"\s*\(via.*\)$", "")
    apis = F.when(F.col("api1").isNotNull(), F.concat(
        F.lit("Exposes: "), F.concat_ws(", ", "api1", "api2", "api3")))
    return groups.join(best, "group_id", "left").select("group_id", F.coalesce(
        cut(F.col("purpose"), limit), cut(duty, limit), apis,
        F.concat("category", F.lit(" module"))).alias("description"))
