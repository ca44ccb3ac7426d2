"""Many keyword queries at once.

Comparing every query with every entry would cost their product. Instead each query is looked for by
one run of up to three characters, the rarest it has (``grams``): entries that hold it are its
candidates, and only those are compared with it. There is one plan, however many queries there are.
A query that matches fewer than five entries is filled up with the entries that sort first, and of
those only five are needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomewright import constants as K
from tomewright.operators import grams
from tomewright.operators.documents import StoredKb
from tomewright.operators.ordering import freeze
from tomewright.operators.query import CATEGORY_BONUS, WEIGHTS, joined_pieces
from tomewright.operators.tables import KnowledgeBase


def searched_rows(kb: StoredKb) -> DataFrame:
    """``filename, category, texts, points``: what queries are compared with, in lower case."""
    single = ["title", "category", "description"]
    lists = {"tags": "tags", "sources": "source_files", "related": "related"}
    texts = [F.array(*[F.lower(c) for c in single], F.lower("content"))]
    points = [F.array(*[F.lit(WEIGHTS[c]) for c in single], F.lit(WEIGHTS["body"]))]
    for field, column in lists.items():
        texts.append(F.transform(column, F.lower))
        points.append(F.array_repeat(F.lit(WEIGHTS[field]), F.size(column)))
    return kb.rows.select("filename", "category", F.concat(*texts).alias("texts"),
                          F.concat(*points).alias("points"))


def searched_pieces(kb: KnowledgeBase, lines: int) -> DataFrame:
    """``filename, points, body, text`` of entries kept as tables, a row for each text."""
    def texts(df: DataFrame, name: str, column: str, body: int = 0) -> DataFrame:
        return df.select("filename", F.lit(0 if body else WEIGHTS[name]).alias("points"),
                         F.lit(body).alias("body"), F.lower(column).alias("text"))

    parts = [texts(kb.entries, c, c) for c in ("title", "category", "description")]
    parts += [texts(getattr(kb, n), n, "value") for n in ("tags", "sources", "related")]
    body = joined_pieces(kb.body, lines) if lines > 1 else kb.body
    parts.append(texts(body, "body", "text", 1))
    return reduce(DataFrame.unionByName, parts)


def _scored(kb: StoredKb, queries: DataFrame) -> DataFrame:
    """``query, filename, category, score`` of all entries with a text that holds a query."""
    rows = searched_rows(kb).withColumn("body", F.lit(0))
    entries = kb.rows.select("filename", "category")
    if kb.large is not None:
        breaks = F.length("query") - F.length(F.replace("query", F.lit("\n"), F.lit("")))
        lines = queries.agg(F.coalesce(F.max(breaks), F.lit(0)) + 1).first()[0]
        large = kb.large.entries.select("filename", "category")
        pieces = searched_pieces(kb.large, lines).select(
            "filename", F.lit(None).cast("string").alias("category"), F.array("text").alias("texts"),
            F.array("points").alias("points"), "body")
        rows, entries = rows.unionByName(pieces), entries.unionByName(large)
    rows = freeze(rows.withColumn("id", F.monotonically_increasing_id()))
    named = queries.where("query <> ''").select(F.col("query").alias("string"))
    found = grams.candidates(named, rows).join(rows, "id")
    held = F.transform("texts", lambda t: F.contains(t, F.col("string")))
    hits = found.where(F.exists(held, lambda h: h)).select(
        F.col("string").alias("query"), "filename", F.aggregate(
            F.arrays_zip(held.alias("held"), F.col("points")), F.lit(0).cast("long"),
            lambda sum_, x: sum_ + F.when(x["held"], x["points"]).otherwise(0)).alias("points"),
        "body")
    # The empty query is in every text.
    asked_all = F.broadcast(queries.where("query = ''").select("query"))  # one row
    everything = rows.select("filename", F.aggregate(
        "points", F.lit(0).cast("long"), lambda sum_, p: sum_ + p).alias("points"), "body")
    everything = everything.withColumn("query", F.lit("")).join(asked_all, "query", "left_semi")
    total = hits.unionByName(everything.select(*hits.columns)).groupBy("query", "filename").agg(
        (F.sum("points") + F.max("body") * WEIGHTS["body"]).cast("long").alias("score"))
    return total.join(entries, "filename").select("query", "filename", "category", "score")


def _first(df: DataFrame, n: int, keys: list[str], *order) -> DataFrame:
    """The first ``n`` rows of each group; tasks pass on no more than that of theirs."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", place.cast("long")).where(F.col("rank") <= n)


def kb_query_batch(kb: StoredKb, queries: DataFrame) -> DataFrame:
    """``query_id, rank, filename, score``: the five best entries for each query.

    ``queries`` has ``query_id, query, category``; a null or blank category counts as none, and a
    null query asks for nothing. Scores and ties are those of ``kb_query``. Equal questions are answered once.
    """
    best = [F.col("score").desc(), F.col("filename")]
    asked = queries.select("query_id", F.lower("query").alias("query"), F.coalesce(
        F.lower("category"), F.lit("")).alias("wanted"))
    pairs = freeze(asked.select("query", "wanted").distinct())
    found = _first(_scored(kb, pairs.select("query").distinct()), K.QUERY_HITS,
                   ["query", "category"], *best).drop("rank")
    bonus = F.when(F.col("category") == F.col("wanted"), CATEGORY_BONUS).otherwise(0)
    hits = pairs.join(found, "query").select(
        "query", "wanted", "filename", (F.col("score") + bonus).cast("long").alias("score"))

    # Entries without a text match: with the right category they score the bonus, and without a
    # category asked for they score nothing but still count. The first five of each are enough.
    entries = kb.rows.select("filename", "category")
    if kb.large is not None:
        entries = entries.unionByName(kb.large.entries.select("filename", "category"))
    first_five = _first(entries, K.QUERY_HITS, ["category"], "filename").drop("rank")
    in_category = pairs.join(first_five.withColumnRenamed("category", "wanted"), "wanted").select(
        "query", "wanted", "filename", F.lit(CATEGORY_BONUS).cast("long").alias("score"))
    names = [r[0] for r in entries.select("filename").orderBy("filename")
             .limit(K.QUERY_HITS).collect()]
    anywhere = pairs.where("wanted = ''").select(
        "query", "wanted", F.explode(F.array(*[F.lit(n) for n in names]).cast("array<string>"))
        .alias("filename"), F.lit(0).cast("long").alias("score"))
    # A match scores at least as much as its filler, so the larger score is the right one.
    every = (hits.unionByName(in_category).unionByName(anywhere)
             .groupBy("query", "wanted", "filename").agg(F.max("score").alias("score")))
    answers = _first(every, K.QUERY_HITS, ["query", "wanted"], *best)
    return asked.join(answers, ["query", "wanted"]).select("query_id", "rank", "filename", "score")
