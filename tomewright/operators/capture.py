"""Taking what an assistant said into the knowledge base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.functions import secrets
from tomewright.operators.tables import AT, KnowledgeBase

# --- Fixed values ----------------------------------------------------------------------------
CAPTURE_TAGS = ["assistant-output", "manually-added"]
DEFAULT_TITLE = "Assistant Output"
DEFAULT_DESCRIPTION = "Knowledge captured from assistant output"


def first_text_block(content: Column) -> Column:
    """First non-empty text of an array of ``struct<type, text>`` blocks, or null."""
    return F.get(F.filter(content, lambda b: (b.type == "text") & (b.text != "")), 0).text


def latest_assistant(turns: DataFrame, key: str = "conv_id", order: str = "turn",
                     text: str = "text") -> DataFrame:
    """``key, text``: what the assistant last said in each conversation, if anything."""
    said = turns.where((F.col("role") == "assistant") & (F.col(text) != ""))
    return said.groupBy(key).agg(F.max_by(text, order).alias("text"))


def capture_filename(title: Column) -> Column:
    slug = F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-")
    return F.concat(F.lit("assistant-"), F.regexp_replace(slug, "^-|-$", ""), F.lit(".md"))


def capture_entries(messages: DataFrame, as_of: str) -> KnowledgeBase:
    """New entries from ``messages(text, title, category, description)``.

    The text is redacted here, and once more when the entry is written.
    """
    clean = secrets.redact(messages, "text").select(
        capture_filename(F.col("title")).alias("filename"), "title", "category", "description",
        "text")
    # Titles that lead to one file name: the last by title wins.
    clean = clean.groupBy("filename").agg(F.max_by(
        F.struct("title", "category", "description", "text"),
        F.struct("title", "text")).alias("m")).select("filename", "m.*")
    entries = clean.withColumn("updated_at", F.lit(as_of)).withColumn(
        "n_sources", F.lit(0).cast("long"))
    body = clean.select(
        "filename", F.lit(0).alias("part"), F.lit(0).cast("long").alias("pos"),
        F.lit("").alias("key"),
        F.concat(F.lit(f"## Assistant Output\n\nCaptured from assistant session on {as_of}.\n\n"),
                 "text").alias("text"))
    tags = clean.select("filename", F.posexplode(F.array(*[F.lit(t) for t in CAPTURE_TAGS]))
                        .alias("pos", "value")).select(
        "filename", F.struct(F.lit(0).cast("long").alias("part"),
                             F.col("pos").cast("long").alias("pos"),
                             F.lit("").alias("key")).alias("at"), "value")
    return KnowledgeBase.of(entries, body=body, tags=tags)


def merge_capture(kb: KnowledgeBase, messages: DataFrame, as_of: str, *,
                  redact_once: bool = False) -> KnowledgeBase:
    """Append ``messages(filename, seq, text)`` to entries that exist, in the order of ``seq``.

    Messages become pieces of the body, so any number may go to one entry. They are redacted
    here and again when written, which by design adds a ``]`` behind some markers; pass
    ``redact_once`` to leave it to the writing.
    """
    known = messages.join(kb.entries.select("filename"), "filename", "left_semi")
    clean = known if redact_once else secrets.redact(known, "text")
    last = kb.body.groupBy("filename").agg(F.max("part").alias("__last"))
    added = clean.join(last, "filename", "left").select(
        "filename", (F.coalesce("__last", F.lit(0)) + 1).alias("part"),
        F.col("seq").cast("long").alias("pos"), F.lit("").alias("key"),
        F.concat(F.lit(f"\n\n---\n\n## Assistant Output ({as_of})\n\n"), "text").alias("text"))
    named = known.select("filename").distinct()
    tag = CAPTURE_TAGS[0]
    lacking = named.join(kb.tags.where(F.col("value") == tag), "filename", "left_anti")
    new_tags = lacking.select(
        "filename", F.struct(F.lit(2**31).cast("long").alias("part"),
                             F.lit(0).cast("long").alias("pos"),
                             F.lit("").alias("key")).cast(AT).alias("at"),
        F.lit(tag).alias("value"))
    entries = (kb.entries.join(named.withColumn("__hit", F.lit(True)), "filename", "left")
               .withColumn("updated_at", F.when(F.col("__hit"), F.lit(as_of))
                           .otherwise(F.col("updated_at"))))
    return KnowledgeBase.of(entries, body=kb.body.unionByName(added),
                            tags=kb.tags.unionByName(new_tags), related=kb.related,
                            sources=kb.sources)


def state_after_capture(summary: DataFrame, kb: KnowledgeBase, as_of: str) -> DataFrame:
    """The state row after a capture: only its time and its number of entries move."""
    total = F.lit(kb.entries.count()).cast("long")
    return summary.withColumns({"updated_at": F.lit(as_of), "total_entries": total})
