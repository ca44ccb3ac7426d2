"""Connected components of a table of links, by alternating stars.

A round hangs every node's larger neighbours, then its smaller ones, on the smallest it knows. When a
round changes nothing, every node hangs on the smallest node of its component. Neighbours are never
gathered: they pass in order, the smallest first, so each half of a round is one shuffle. Rounds are
written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomewright.llm.frames import few_tasks, written


def _hang(links: DataFrame) -> DataFrame:
    """Each different link ``(u, v)`` once as ``(u, v, m)``, m the smallest v of u."""
    order = Window.partitionBy("u").orderBy("v")
    return (links.select("u", "v", F.min("v").over(order).alias("m"),
                         F.lag("v").over(order).alias("before"))
            .where("before IS NULL OR before <> v").drop("before"))


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links`` (columns u, v of one ordered type).

    Links of a node with itself, and with null, are passed over.
    """
    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
                     .first())

    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"),
                                                 F.least("u", "v").alias("v")), "links")
    before = state(edges)
    while True:
        # The larger neighbours of a node move on to the smallest it knows, itself included.
        large = (_hang(edges.union(edges.select("v", "u")))
                 .withColumn("m", F.least("u", "m")).where("v > u AND v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        # Links now lead from a node to a smaller one; the node itself and the others move on.
        small = _hang(few_tasks(large, 2 * before[0])).select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
            F.col("m").alias("v"))
        edges = written(few_tasks(small, 2 * before[0]), "links-small")
        now = state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(few_tasks(roots.select("root", "root").distinct(), now[0]))
