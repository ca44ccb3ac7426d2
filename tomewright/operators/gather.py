"""Joining the ordered pieces of many texts, however long each is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright.operators import segments
from tomewright.operators.ordering import freeze

MAX_CHARS = 16_000_000


def gather_text(pieces: DataFrame, key: str, order: list[str], text: str = "text",
                max_chars: int = MAX_CHARS) -> DataFrame:
    """``key, block, text``: the pieces of each key, joined in order.

    A text of up to ``max_chars`` is one row, block 0. A longer one is several rows whose
    concatenation by ``block`` is the text, so no task holds it whole. Where each text is a single
    piece there is nothing to join, and no text is moved.
    """
    def joined(rows: DataFrame, *by: str) -> DataFrame:
        ordered = F.sort_array(F.collect_list(F.struct(*order, text)))
        return rows.groupBy(*by).agg(F.array_join(F.transform(
            ordered, lambda x: x[text]), "").alias(text))

    sizes = pieces.groupBy(key).agg(F.sum(F.length(text)).alias("__chars"),
                                    F.count("*").alias("__pieces"))
    many = freeze(sizes.where((F.col("__chars") > max_chars) | (F.col("__pieces") > 1)))
    if many.isEmpty():
        return pieces.select(key, F.lit(0).cast("long").alias("block"),
                             F.coalesce(text, F.lit("")).alias(text))
    large = many.where(F.col("__chars") > max_chars).select(key)
    if large.isEmpty():
        return joined(pieces, key).select(key, F.lit(0).cast("long").alias("block"), text)
    # Each large text has more than max_chars of all characters, so they are few.
    few = F.broadcast(large)
    small = joined(pieces.join(few, key, "left_anti"), key).withColumn("block", F.lit(0).cast("long"))
    blocks = segments.blocks(pieces.join(few, key, "left_semi"), key, order, text)
    return small.select(key, "block", text).unionByName(
        blocks.select(key, "block", F.col("text").alias(text)))
