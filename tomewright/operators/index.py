"""The index of a knowledge base: categories, tags, and an overview of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomewright import constants as K
from tomewright.functions.text import capitalised, cut, utf16_length
from tomewright.operators.changes import category_totals, one_row
from tomewright.operators.tables import KnowledgeBase


def _meta(category: Column, field: int) -> Column:
    pairs = [F.lit(v) for row in K.CATEGORY_META for v in (row[0], row[field])]
    return F.element_at(F.create_map(*pairs), category)


def category_label(category: Column) -> Column:
    return F.coalesce(_meta(category, 1), category)


def category_description(category: Column) -> Column:
    return F.coalesce(_meta(category, 2), F.lit(""))


def category_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("category").agg(F.count("*").alias("n_entries"))


def category_index(entries: DataFrame) -> DataFrame:
    """``category, label, about, filename, line``: what the index lists under each category."""
    category = F.col("category")
    line = F.concat(F.lit("- ["), F.col("title"), F.lit("](./"), F.col("filename"),
                    F.lit(") — "), cut(F.col("description"), K.INDEX_DESCRIPTION_CHARS),
                    F.lit(" ("), F.col("n_sources").cast("string"), F.lit(" files)"))
    return entries.select("category", category_label(category).alias("label"),
                          category_description(category).alias("about"), "filename",
                          line.alias("line"))


def tag_index(kb: KnowledgeBase) -> DataFrame:
    """``tag, filename``, one row per use of a tag."""
    return kb.tags.select(F.col("value").alias("tag"), "filename")


def overview_totals(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("n_entries"),
                       F.coalesce(F.sum("n_sources"), F.lit(0)).alias("n_files"),
                       F.count_distinct("category").alias("n_categories"))


def overview_languages(kb: KnowledgeBase) -> DataFrame:
    """Tags that are names of languages, by first use: ``language, first``."""
    return (kb.tags.where(F.col("value").isin(K.OVERVIEW_LANGUAGES))
            .groupBy(capitalised(F.col("value")).alias("language"))
            .agg(F.min(F.struct("filename", "at")).alias("first")))


def overview_modules(entries: DataFrame) -> DataFrame:
    """``filename, line`` of the first eight modules."""
    about = F.when(utf16_length(F.col("description")) > 5, F.col("description")).otherwise(
        F.concat(F.col("n_sources").cast("string"), F.lit(" file(s)")))
    return (entries.where(F.col("category") == "module").orderBy("filename")
            .limit(K.OVERVIEW_MODULES)
            .select("filename", F.concat(F.lit("- **"), F.col("title"), F.lit("**: "), about)
                    .alias("line")))


def overview_areas(entries: DataFrame) -> DataFrame:
    """``category, first_filename, line`` for every category but modules."""
    others = entries.where(F.col("category") != "module")
    totals = others.groupBy("category").agg(
        F.sum("n_sources").cast("string").alias("files"),
        F.count("*").cast("string").alias("n"), F.min("filename").alias("first_filename"))
    telling = others.where((utf16_length(F.col("description")) > 10) & ~F.startswith(
        F.col("description"), F.concat(F.col("category"), F.lit(" —"))))
    # The limit is applied before rows meet: no category brings more than three to a task.
    place = F.row_number().over(Window.partitionBy("category").orderBy("filename"))
    told = (telling.select("category", "description", place.alias("n"))
            .where(F.col("n") <= K.OVERVIEW_DESCRIPTIONS).groupBy("category")
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(
                "n", "description"))), lambda x: x.description), "; ").alias("told")))
    label = category_label(F.col("category"))
    line = F.when(F.col("told").isNotNull(), F.concat(
        F.lit("- **"), label, F.lit("** ("), F.col("files"), F.lit(" files): "), F.col("told"))
    ).otherwise(F.concat(F.lit("- **"), label, F.lit("**: "), F.col("files"),
                         F.lit(" file(s) in "), F.col("n"), F.lit(" entry(ies)")))
    return totals.join(told, "category", "left").select(
        "category", "first_filename", line.alias("line"))


def init_report(entries: DataFrame, files: DataFrame) -> DataFrame:
    """One row about a first run, with the entries of each category."""
    return one_row({"entries_created": entries, "files_scanned": files,
                    "n_categories": entries.select("category").distinct()}).crossJoin(
        category_totals(entries))  # one row each


def kb_hint(entries: DataFrame, as_of: str) -> DataFrame:
    """One row ``hint`` that tells an agent there is a knowledge base."""
    first = entries.select("filename").orderBy("filename").limit(K.HINT_FILENAMES).select(
        F.lit(0).cast("long").alias("n"), "filename")
    count = entries.agg(F.count("*").alias("n")).select("n", F.lit(None).cast("string")
                                                        .alias("filename"))
    both = first.unionByName(count).agg(
        F.sum("n").cast("string").alias("n"),
        F.array_join(F.sort_array(F.collect_list("filename")), ", ").alias("names"))
    return both.select(F.concat(
        F.lit("This project has a markdown knowledge base at .kb/ ("), F.col("n"),
        F.lit(f" entries, last updated {as_of}). Use the kb_query tool to search it for project "
              "information. Top entries: "), F.col("names")).alias("hint"))


# Sections of the rendered index, in order.
_TITLE, _OVERVIEW, _LANGUAGES, _MODULES, _AREAS, _NAVIGATION, _CATEGORY, _TAGS = range(8)


def index_pieces(kb: KnowledgeBase, as_of: str) -> DataFrame:
    """The index as pieces, in the order of ``INDEX_ORDER``; their concatenation is the document.

    An index names every entry, and a tag may be on most of them, so it is never one row.
    """
    def piece(df: DataFrame, section: int, text: Column, k1=None, k2=None, n: int = 0) -> DataFrame:
        # Tags are in dictionary order, those that compare equal in order of their characters.
        by_word = k1 if section == _TAGS and k1 is not None else lit("")
        return df.select(F.lit(section).alias("section"),
                         F.collate(by_word, "UNICODE").alias("word"),
                         (F.lit("") if k1 is None else k1).alias("k1"),
                         (F.lit("") if k2 is None else k2).alias("k2"),
                         F.lit(n).alias("n"), text.alias("text"))

    lit, col = F.lit, F.col
    line = F.concat(col("line"), lit("\n"))
    totals = overview_totals(kb.entries)
    head = F.concat(
        lit(f"# Knowledge Base Index\n\n> Auto-generated by **tomewright** — {as_of}\n\n"
            "## Project Overview\n\nThis project has **"), col("n_entries").cast("string"),
        lit(" knowledge base entries** covering **"), col("n_files").cast("string"),
        lit(" files** across "), col("n_categories").cast("string"), lit(" categories.\n\n"))
    languages = overview_languages(kb).agg(  # at most twelve
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "language"))),
                                 lambda x: x.language), ", ").alias("names"))
    modules, areas = overview_modules(kb.entries), overview_areas(kb.entries)
    nav = category_index(kb.entries)
    first_in_category = kb.entries.groupBy("category").agg(F.min("filename").alias("first"))
    nav = nav.join(first_in_category, "category")
    tags = tag_index(kb)
    first_use = tags.groupBy("tag").agg(F.min("filename").alias("first"))
    uses = tags.join(first_use, "tag")
    link = F.concat(lit("["), col("filename"), lit("](./"), col("filename"), lit(")"))
    opening = F.when(col("filename") == col("first"),
                     F.concat(lit("- `"), col("tag"), lit("`: "))).otherwise(lit(", "))
    any_tags = first_use.limit(1)
    closing = lit("> 💡 Use `kb_query` to search entries by keyword, category, or tag. Each entry "
                  "contains extracted knowledge about purpose, responsibilities, API surface, and "
                  "more.\n\n## Quick Navigation\n\n")
    pieces = [
        piece(totals, _TITLE, head),
        piece(languages.where("names <> ''"), _LANGUAGES,
              F.concat(lit("**Languages**: "), col("names"), lit("\n"))),
        piece(modules.limit(1), _MODULES, lit("\n**Modules**:\n")),
        piece(modules, _MODULES, line, col("filename"), n=1),
        piece(areas.limit(1), _AREAS, lit("\n**Other areas**:\n")),
        piece(areas, _AREAS, line, col("first_filename"), n=1),
        piece(totals, _NAVIGATION, F.concat(lit("\n"), closing)),
        piece(nav.where(col("filename") == col("first")), _CATEGORY,
              F.concat(lit("### "), col("label"), lit("\n\n> "), col("about"), lit("\n\n")),
              col("first")),
        piece(nav, _CATEGORY, line, col("first"), col("filename"), n=1),
        piece(first_in_category, _CATEGORY, lit("\n"), col("first"), lit("\U0010ffff"), n=2),
        piece(any_tags, _TAGS, lit("## Tags\n\n")),
        piece(uses, _TAGS, F.concat(opening, link), col("tag"), col("filename"), n=1),
        piece(first_use, _TAGS, lit("\n"), col("tag"), lit("\U0010ffff"), n=2),
    ]
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out


INDEX_ORDER = ["section", "word", "k1", "k2", "n"]


def write_index(kb: KnowledgeBase, as_of: str, path: str) -> None:
    """The index as text files that, read in name order, are one document."""
    lines = index_pieces(kb, as_of)
    (lines.repartitionByRange(*INDEX_ORDER).sortWithinPartitions(*INDEX_ORDER)
     .select("text").write.option("lineSep", "").text(path))
