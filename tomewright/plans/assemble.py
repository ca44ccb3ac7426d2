"""From plans to the tables of a knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright.functions import paths
from tomewright.operators.tables import KnowledgeBase
from tomewright.plans.model import Plans


def resolve_collisions(plans: Plans, on_collision: str = "last") -> Plans:
    """One plan per file name.

    Two directories can map to one file name; the plan that comes last wins and the others'
    sources go with them. ``on_collision="suffix"`` keeps them all, under numbered names.
    """
    rows = plans.plans
    if on_collision == "suffix":
        last = rows.groupBy("filename").agg(F.max("plan_order").alias("__last"))
        renamed = F.concat(F.regexp_replace("filename", r"\.md$", ""), F.lit("~"),
                           F.substring(F.sha2(F.col("plan_id"), 256), 1, 8), F.lit(".md"))
        kept = rows.join(last, "filename").withColumn("filename", F.when(
            F.col("plan_order") == F.col("__last"), F.col("filename")).otherwise(renamed))
        kept = kept.select(rows.columns)
        named = plans.sources.drop("filename").join(kept.select("plan_id", "filename"), "plan_id")
        return Plans(kept, named.select(plans.sources.columns))
    kept = (rows.groupBy("filename")
            .agg(F.max_by(F.struct(*rows.columns), "plan_order").alias("p")).select("p.*"))
    # Losing plans are few, so the sources, by far the larger table, need not be shuffled.
    lost = rows.select("plan_id").join(kept.select("plan_id"), "plan_id", "left_anti")
    return Plans(kept, plans.sources.join(lost, "plan_id", "left_anti"))


def count_collisions(plans: Plans) -> DataFrame:
    """File names that more than one plan claims."""
    return (plans.plans.groupBy("filename").agg(F.count("*").alias("n_plans"),
                                                F.max_by("plan_id", "plan_order").alias("kept"))
            .where("n_plans > 1"))


def body_pieces(plans: DataFrame, sources: DataFrame) -> DataFrame:
    """Default body of each entry, as ordered pieces ``filename, part, pos, key, text``.

    The body is the concatenation of an entry's pieces by ``part, pos, key``. Every piece ends
    its line, and each source file has its own, so an entry with many files is many rows.
    """
    zero, none = F.lit(0).cast("long"), F.lit("")
    brief = F.coalesce(F.nullif("brief", F.lit("")),
                       F.concat("category", F.lit(" module.")))
    head = F.concat(F.lit("## Purpose\n\n"), brief, F.lit("\n\n## Files ("),
                    F.col("n_sources").cast("string"), F.lit(")\n\n"))
    tail = F.concat(
        F.lit("\n## When to Reference\n\n> Consult this entry when you need to understand "),
        F.lower("title"), F.lit(".\n"))
    ends = plans.select("filename", F.explode(F.array(
        F.struct(F.lit(0).alias("part"), head.alias("text")),
        F.struct(F.lit(2).alias("part"), tail.alias("text")))).alias("p")).select(
            "filename", "p.part", zero.alias("pos"), none.alias("key"), "p.text")
    files = sources.select(
        "filename", F.lit(1).alias("part"), "pos", F.col("path").alias("key"),
        F.concat(F.lit("- `"), F.col("path"), F.lit("` ("),
                 F.coalesce(F.col("lines").cast("string"), F.lit("?")),
                 F.lit(" lines)\n")).alias("text"))
    return ends.unionByName(files)


def _tags(plans: DataFrame, sources: DataFrame) -> DataFrame:
    """Category first, then each suffix of the sources where it first occurs, no repeats."""
    ext = F.regexp_replace(paths.extension(F.col("path"), lower=False), r"^\.", "")
    from_sources = sources.select(
        "filename", ext.alias("tag"),
        F.struct(F.lit(1).cast("long").alias("part"), "pos", F.col("path").alias("key"))
        .alias("at")).where("tag <> ''")
    from_category = plans.select(
        "filename", F.col("category").alias("tag"),
        F.struct(F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("pos"),
                 F.lit("").alias("key")).alias("at"))
    return (from_category.unionByName(from_sources)
            .groupBy("filename", "tag").agg(F.min("at").alias("at")))


def assemble_entries(plans: Plans, as_of: str, contents: DataFrame | None = None) -> KnowledgeBase:
    """Entries of resolved plans, written at ``as_of`` (an ISO-8601 string).

    ``contents(filename, content)`` holds texts written elsewhere, by a model for example;
    entries without one get the default body.
    """
    rows = plans.plans
    entries = rows.select(
        "filename", "title",
        F.coalesce(F.nullif("brief", F.lit("")),
                   F.concat("category", F.lit(" — "), F.col("n_sources").cast("string"),
                            F.lit(" files"))).alias("description"),
        F.coalesce(F.nullif("category", F.lit("")), F.lit("general")).alias("category"),
        F.lit(as_of).alias("updated_at"), "n_sources")
    sources = plans.sources.select("filename", "pos", F.col("path").alias("value"))
    tags = _tags(rows, plans.sources).select("filename", "at", F.col("tag").alias("value"))
    body = body_pieces(rows, plans.sources)
    if contents is not None:
        written = (contents.join(rows.select("filename"), "filename", "left_semi")
                   .where("content <> ''"))
        body = body.join(written.select("filename"), "filename", "left_anti").unionByName(
            written.select("filename", F.lit(0).alias("part"), F.lit(0).cast("long").alias("pos"),
                           F.lit("").alias("key"), F.col("content").alias("text")))
    return KnowledgeBase.of(entries, tags=tags, sources=sources, body=body)
