"""Event logs of language-model runs: one JSON event per line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright.operators.gather import MAX_CHARS, gather_text

EVENT = ("type string, message struct<role:string, content:array<struct<type:string,text:string>>, "
         "usage:struct<input:double,output:double,cost:struct<total:double>>>")


def assistant_messages(lines: DataFrame) -> DataFrame:
    """``run_id, ord, message`` of finished assistant messages in ``lines(run_id, ord, line)``.

    Lines that are blank, no JSON, or of another kind are skipped.
    """
    event = F.from_json("line", EVENT)
    return (lines.select("run_id", "ord", event.alias("e"))
            .where((F.col("e.type") == "message_end") & (F.col("e.message.role") == "assistant"))
            .select("run_id", "ord", F.col("e.message").alias("message")))


def reply_pieces(lines: DataFrame) -> DataFrame:
    parts = assistant_messages(lines).select(
        "run_id", "ord", F.posexplode("message.content").alias("pos", "part"))
    return parts.where((F.col("part.type") == "text") & (F.col("part.text") != "")).select(
        "run_id", "ord", "pos", F.col("part.text").alias("text"))


def reply_text(lines: DataFrame, max_chars: int = MAX_CHARS) -> DataFrame:
    """``run_id, block, text``: all a run replied, see ``gather_text`` for ``block``."""
    return gather_text(reply_pieces(lines), "run_id", ["ord", "pos"], max_chars=max_chars)


def usage_rollup(lines: DataFrame) -> DataFrame:
    """Tokens and cost of each run; null for a run that reported none."""
    usage = F.col("message.usage")

    def total(c):
        return F.sum(F.when(usage.isNotNull(), F.coalesce(c, F.lit(0.0))))

    return assistant_messages(lines).groupBy("run_id").agg(
        total(usage.input).cast("long").alias("input"),
        total(usage.output).cast("long").alias("output"),
        total(usage.cost.total).alias("cost"))
