"""Keyword queries: weighted substring matches, best five.

A query is one string, looked for without regard to letter case. The weights are title 10,
description 6, category 5, each source 4, each tag 3, each related entry 2, and body 2. Naming a
category adds 20 to its entries and drops entries that score nothing; without one every entry is
in the running. Ties go to the file name that sorts first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomewright import constants as K
from tomewright.functions.text import utf16_length, utf16_prefix
from tomewright.operators.documents import StoredKb
from tomewright.operators.ordering import with_ordinal
from tomewright.operators.tables import AT, KnowledgeBase

# --- Fixed values: what a match in each field is worth ---------------------------------------
WEIGHTS = {"title": 10, "category": 5, "tags": 3, "sources": 4, "description": 6, "body": 2,
           "related": 2}
CATEGORY_BONUS = 20

DETAILS = ["filename", "title", "category", "description", "n_sources"]


def _hit(c: Column, query: str) -> Column:
    return F.contains(F.lower(c), F.lit(query))


def _points(hit: Column, weight: int) -> Column:
    return F.when(hit, F.lit(weight)).otherwise(F.lit(0)).cast("long")


def _bonus(category: str | None) -> Column:
    if not category:
        return F.lit(0).cast("long")
    return _points(F.col("category") == category.lower(), CATEGORY_BONUS)


def score_rows(rows: DataFrame, query: str, category: str | None = None) -> DataFrame:
    """Adds ``score`` to entries that hold their lists as arrays."""
    q = query.lower()

    def each(name: str, weight: int) -> Column:
        return (F.size(F.filter(name, lambda x: _hit(x, q))) * weight).cast("long")

    score = reduce(lambda a, b: a + b, [
        *[_points(_hit(F.col(c), q), WEIGHTS[c]) for c in ("title", "category", "description")],
        _points(_hit(F.col("content"), q), WEIGHTS["body"]),
        each("tags", WEIGHTS["tags"]), each("source_files", WEIGHTS["sources"]),
        each("related", WEIGHTS["related"]), _bonus(category)])
    return rows.withColumn("score", score)


def score_tables(kb: KnowledgeBase, query: str, category: str | None = None) -> DataFrame:
    """``filename, title, category, description, n_sources, score`` of entries kept as tables.

    Matches are counted where the rows are and only the counts of an entry meet, so an entry with
    very many sources costs no more per task than any other.
    """
    q = query.lower()
    # Every piece ends its line, so only a query of several lines can reach over pieces.
    body = joined_pieces(kb.body, query.count("\n") + 1) if "\n" in query else kb.body
    body_hits = body.where(_hit(F.col("text"), q)).select("filename")
    flag = F.lit(0).alias("body_hit")
    parts = [kb.entries.select("filename", reduce(lambda a, b: a + b, [
        *[_points(_hit(F.col(c), q), WEIGHTS[c]) for c in ("title", "category", "description")],
        _bonus(category)]).alias("points"), flag)]
    for name in ("tags", "sources", "related"):
        parts.append(getattr(kb, name).where(_hit(F.col("value"), q)).select(
            "filename", F.lit(WEIGHTS[name]).cast("long").alias("points"), flag))
    parts.append(body_hits.select("filename", F.lit(0).cast("long").alias("points"),
                                  F.lit(1).alias("body_hit")))
    total = (reduce(DataFrame.unionByName, parts).groupBy("filename")
             .agg((F.sum("points") + F.max("body_hit") * WEIGHTS["body"]).alias("score")))
    return kb.entries.join(total, "filename").select(*DETAILS, "score")


def joined_pieces(body: DataFrame, lines: int) -> DataFrame:
    """``filename, text``: stretches of bodies such that any ``lines`` lines are within one.

    Pieces are numbered, then gathered into blocks; those that begin a block are also added to
    the one before, as many as a match can reach over.
    """
    block = 4096
    numbered = with_ordinal(body, "filename", "part", "pos", "key")
    home = F.floor(F.col("ordinal") / block)
    reach = F.sequence(F.floor(F.greatest(F.col("ordinal") - lines, F.lit(0)) / block), home)
    blocks = numbered.withColumn("__block", F.explode(reach)).groupBy("filename", "__block").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", "text"))).alias("p"))
    return blocks.select("filename", F.array_join(F.transform("p", lambda x: x.text), "")
                         .alias("text"))


def gate(scored: DataFrame, category: str | None) -> DataFrame:
    return scored.where(F.col("score") > 0) if category else scored


def top_hits(scored: DataFrame, limit: int = K.QUERY_HITS) -> DataFrame:
    return scored.orderBy(F.col("score").desc(), F.col("filename").asc()).limit(limit)


def kb_query(kb: StoredKb, query: str, category: str | None = None) -> DataFrame:
    """The five best entries: ``filename, title, category, description, n_sources, score``."""
    rows = score_rows(kb.rows.withColumn("n_sources", F.size("source_files").cast("long")),
                      query, category).select(*DETAILS, "score")
    if kb.large is not None:
        rows = rows.unionByName(score_tables(kb.large, query, category))
    return top_hits(gate(rows, category))


def _opening(kb: StoredKb, hits: DataFrame, chars: int) -> DataFrame:
    """``filename, content``: at least the first ``chars`` of the bodies of the hits."""
    named = F.broadcast(hits.select("filename"))  # five at most
    rows = kb.rows.select("filename", "content").join(named, "filename", "left_semi")
    if kb.large is None:
        return rows
    # Every piece holds at least one character, so the first chars + 1 pieces are enough.
    first = Window.partitionBy("filename").orderBy("part", "pos", "key")
    body = kb.large.body.join(named, "filename", "left_semi")
    head = (body.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= chars + 1)
            .groupBy("filename").agg(F.sort_array(F.collect_list(F.struct("__n", "text")))
                                     .alias("p")))
    return rows.unionByName(head.select("filename", F.array_join(
        F.transform("p", lambda x: x.text), "").alias("content")))


def render_hits(kb: StoredKb, hits: DataFrame) -> DataFrame:
    """Adds ``rendered``, the text shown for a hit; its body is cut at 2,000 characters."""
    limit = K.HIT_BODY_CHARS
    body = _opening(kb, hits, limit)
    shown = F.concat(utf16_prefix(F.col("content"), limit), F.when(
        utf16_length(F.col("content")) > limit, F.lit("\n...(truncated)")).otherwise(F.lit("")))
    text = F.concat(
        F.lit("### "), F.col("title"), F.lit("\nCategory: "), F.col("category"),
        F.lit(" | Files: "), F.col("n_sources").cast("string"), F.lit(" | Score: "),
        F.col("score").cast("string"), F.lit("\n"), F.col("description"), F.lit("\n\n"), shown)
    return (hits.join(body, "filename").select(*hits.columns, text.alias("rendered")))


def query_suggestions(kb: KnowledgeBase) -> DataFrame:
    """What to try when nothing matched: ``kind, first, value``, to be read in order of ``first``.

    All categories, by the first entry that has them, the first 20 tags, the first 15 titles.
    """
    none = F.lit(None).cast(AT)

    def named(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), "first", "value")

    categories = kb.entries.groupBy(F.col("category").alias("value")).agg(
        F.min(F.struct("filename", none.alias("at"))).alias("first"))
    tags = kb.tags.groupBy("value").agg(F.min(F.struct("filename", "at")).alias("first"))
    titles = kb.entries.select(F.col("title").alias("value"),
                               F.struct("filename", none.alias("at")).alias("first"))
    return (named(categories, "category")
            .unionByName(named(tags.orderBy("first").limit(K.SUGGESTED_TAGS), "tag"))
            .unionByName(named(titles.orderBy("first").limit(K.SUGGESTED_TITLES), "title")))


def query_status(kb: KnowledgeBase | None, hits: DataFrame | None = None) -> str:
    """``missing``, ``empty`` or ``matched n of m``."""
    if kb is None:
        return "missing"
    total = kb.entries.count()
    if total == 0:
        return "empty"
    return f"matched {hits.count() if hits is not None else 0} of {total}"
