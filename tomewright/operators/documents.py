"""Entry documents: markdown with a header, written from and read into tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tomewright import constants as K
from tomewright.functions import frontmatter as fm
from tomewright.functions import secrets, text
from tomewright.functions.regex import WS
from tomewright.operators import segments
from tomewright.operators.gather import gather_text
from tomewright.operators.ordering import freeze
from tomewright.operators.tables import AT, KnowledgeBase, read_kb, write_kb

# An entry is put together as one document up to this many characters.
MAX_DOCUMENT_CHARS = 16_000_000
BODY = 7  # section that holds the body; all before it are the header


def _at_start():
    return F.struct(F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("pos"),
                    F.lit("").alias("key"))


def document_pieces(kb: KnowledgeBase) -> DataFrame:
    """Documents as ordered pieces ``filename, section, at, text``; sections below 7 are header."""
    def piece(section: int, *parts):
        return F.struct(F.lit(section).alias("section"), F.concat(*parts).alias("text"))

    lit = F.lit
    fixed = kb.entries.select("filename", F.explode(F.array(
        piece(0, lit("---\ntitle: "), fm.quoted(F.col("title")), lit("\ndescription: "),
              fm.quoted(F.col("description")), lit("\ncategory: "), F.col("category"),
              lit("\ntags:\n")),
        piece(2, lit("related:\n")),
        piece(4, lit('updatedAt: "'), F.col("updated_at"), lit('"\nsourceFiles:\n')),
        piece(6, lit("---")))).alias("p")).select(
            "filename", "p.section", _at_start().alias("at"), "p.text")
    first = Window.partitionBy("filename").orderBy("at")
    related = (kb.related.withColumn("__n", F.row_number().over(first))
               .where(F.col("__n") <= K.RELATED_IN_FRONTMATTER))
    lists = [t.select("filename", F.lit(section).alias("section"), F.col("at"),
                      fm.list_item(F.col("value")).alias("text"))
             for section, t in ((1, kb.tags), (3, related), (5, kb.sources))]
    body = kb.body.select(
        "filename", F.lit(BODY).alias("section"),
        F.struct(F.col("part").cast("long").alias("part"), "pos", "key").alias("at"), "text")
    pieces = fixed
    for more in (*lists, body):
        pieces = pieces.unionByName(more)
    return pieces


def large_entries(pieces: DataFrame, max_chars: int = MAX_DOCUMENT_CHARS) -> DataFrame:
    """Names of entries whose document is longer than ``max_chars``."""
    return (pieces.groupBy("filename").agg(F.sum(F.length("text")).alias("__chars"))
            .where(F.col("__chars") > max_chars).select("filename"))


def _put_together(pieces: DataFrame, large: DataFrame) -> DataFrame:
    # Every large entry has more than max_chars of the pieces' characters, so there are at most
    # total / max_chars of them. Dropping them here, before the shuffle, keeps each group below
    # max_chars.
    pieces = pieces.join(F.broadcast(large), "filename", "left_anti")
    ordered = F.sort_array(F.collect_list(F.struct("section", "at", "text")))
    grouped = pieces.groupBy("filename").agg(ordered.alias("p"))

    def joined(test):
        return F.array_join(F.transform(F.filter("p", test), lambda x: x.text), "")

    return grouped.select("filename", joined(lambda x: x.section < BODY).alias("header"),
                          joined(lambda x: x.section == BODY).alias("body"))


def render_documents(kb: KnowledgeBase, large: DataFrame | None = None) -> DataFrame:
    """``filename, document`` of all entries but the large ones; the body is redacted again.

    Without ``large`` the sizes are looked up here.
    """
    pieces = document_pieces(kb)
    if large is None:
        large = large_entries(pieces)
    parts = secrets.redact(_put_together(pieces, large), "body")
    return parts.select("filename", F.concat("header", F.lit("\n\n"), "body", F.lit("\n"))
                        .alias("document"))


def list_entries(docs: DataFrame) -> DataFrame:
    return docs.where(F.endswith("filename", F.lit(".md")) & (F.col("filename") != "index.md"))


def load_entries(docs: DataFrame, as_of: str, document: str = "document") -> DataFrame:
    """Documents as entries, one row each with lists as arrays; rows without a header go.

    The lists of a row come from that row's own text, so no group is gathered here.
    """
    raw = F.col(document)
    cut = docs.select("filename", fm.header_end(raw).alias("__end"), raw.alias("__raw"))
    parts = cut.where("__end > 0").select(
        "filename",
        text.trim(F.substring("__raw", F.lit(4), F.col("__end") - 4)).alias("yaml"),
        text.trim(F.substring("__raw", F.col("__end") + 3, F.lit(fm.END))).alias("content"))
    yaml = F.col("yaml")
    return parts.select(
        "filename",
        F.coalesce(fm.yaml_string(yaml, "title"), "filename").alias("title"),
        F.coalesce(fm.yaml_string(yaml, "description"), F.lit("")).alias("description"),
        F.coalesce(fm.yaml_string(yaml, "category"), F.lit("general")).alias("category"),
        fm.yaml_list(yaml, "tags").alias("tags"),
        fm.yaml_list(yaml, "related").alias("related"),
        F.coalesce(fm.yaml_string(yaml, "updatedAt"), F.lit(as_of)).alias("updated_at"),
        fm.yaml_list(yaml, "sourceFiles").alias("source_files"),
        "content")


def to_tables(rows: DataFrame) -> KnowledgeBase:
    """Entries with array columns as the tables of a knowledge base."""
    def exploded(name):
        return rows.select("filename", F.posexplode(name).alias("pos", "value")).select(
            "filename",
            F.struct(F.lit(0).cast("long").alias("part"), F.col("pos").cast("long").alias("pos"),
                     F.lit("").alias("key")).cast(AT).alias("at"), "value")

    body = rows.select("filename", F.lit(0).alias("part"), F.lit(0).cast("long").alias("pos"),
                       F.lit("").alias("key"), F.col("content").alias("text"))
    return KnowledgeBase.of(
        rows.withColumn("n_sources", F.size("source_files").cast("long")), body=body,
        tags=exploded("tags"), related=exploded("related"), sources=exploded("source_files"))


@dataclass(frozen=True)
class StoredKb:
    """What queries see: entries as they read back, and those too large to be one document.

    ``rows`` holds one row per entry, lists as arrays. ``large`` is None where there are none.
    """

    rows: DataFrame
    large: KnowledgeBase | None = None


def read_back(kb: KnowledgeBase, as_of: str, *, max_chars: int = MAX_DOCUMENT_CHARS) -> StoredKb:
    """The knowledge base after it was written as documents and read again.

    Sizes are checked first, by one job over the pieces. Entries above ``max_chars`` stay tables,
    of what their documents would read back as: which rows are held as one document decides where
    the work is done, not what comes out.
    """
    large = freeze(large_entries(document_pieces(kb), max_chars))
    rows = load_entries(list_entries(render_documents(kb, large)), as_of)
    if large.isEmpty():
        return StoredKb(rows)
    pieces = list_entries(written_pieces(kb.only(F.broadcast(large))))
    return StoredKb(rows, load_blocks(_blocks(pieces), as_of))


def _blocks(pieces: DataFrame) -> DataFrame:
    return segments.blocks(pieces, "filename", ["section", "at"]).withColumnRenamed(
        "text", "document")


# A line of a list that decides nothing but its own value: a value, no quote, no line end of another
# kind, and no place that reads like the name of a list.
_ITEM = (rf'[ \t]*+- (?=[^\n]*[^{WS}])(?:(?!tags:|related:|sourceFiles:)[^"\n\r\x{{2028}}\x{{2029}}])*+\n')
# Such lines between two others of their kind. The first of a run may be read as the value of the
# line before it, so it stays.
_RUN = rf"(?<![^\n])({_ITEM})((?:{_ITEM}(?={_ITEM}))++)"


def load_blocks(docs: DataFrame, as_of: str) -> KnowledgeBase:
    """Documents given as ordered blocks (``filename, block, document``), read like whole ones.

    Nothing of an entry is gathered but a short header, in which one line stands for each run of
    plain list lines within a block. It is read by the rules for whole documents; a line that stands
    for a run is then replaced by the run's rows. Text behind the header stays in blocks.
    """
    lines = freeze(segments.recut(docs.select("filename", "block", F.col("document").alias("text")),
                                  "filename", segments.LINES))
    placed = lines.withColumn("opens", F.col("block") == segments.FIRST)
    raw, here = F.col("text"), F.col("block")
    end = F.when(~F.col("opens"), F.locate("---", raw)).otherwise(fm.header_end(raw))
    cuts = freeze(
        placed.withColumn("end", end).groupBy("filename").agg(
            F.min(F.when(F.col("end") > 0, F.struct("block", "end"))).alias("cut"),
            F.max(F.col("opens") & F.startswith(raw, F.lit("---"))).alias("has"))
        .where("has AND cut IS NOT NULL").select("filename", "cut.*")
        .withColumnRenamed("block", "at"))
    parts = freeze(placed.join(cuts, "filename").where(F.col("filename").isNotNull()))

    mark = f"\u0001{uuid.uuid4().hex}:"  # of this call, so no text holds it
    begin = F.when(F.col("opens"), 4).otherwise(1)
    stop = F.when(here == F.col("at"), F.col("end") - begin).otherwise(F.lit(fm.END))
    header = parts.where(here <= F.col("at")).select(
        "filename", "block", F.substring("text", begin, stop).alias("text"))
    marked = F.split(F.regexp_replace("text", _RUN, f"$1  - {mark}\n"), mark)
    numbered = F.array_join(F.transform(marked, lambda p, k: F.when(k > 0, F.concat(
        F.lit(mark), F.col("block"), F.lit(":"), k - 1, p)).otherwise(p)), "")
    short = header.groupBy("filename").agg(F.sort_array(F.collect_list(F.struct(
        "block", numbered.alias("text")))).alias("lines"))
    read = freeze(load_entries(short.select("filename", F.concat(
        F.lit("---"), F.array_join(F.transform("lines", lambda x: x.text), ""), F.lit("---\n"))
        .alias("document")), as_of))

    runs = header.select("filename", F.col("block").cast("string").alias("of"), F.posexplode(
        F.regexp_extract_all("text", F.lit(_RUN), F.lit(2))).alias("nth", "run"))
    values = F.transform(F.filter(F.split("run", "\n"), lambda line: line != ""),
                         lambda line: text.trim(F.substring(text.trim(line), F.lit(3), F.lit(fm.END))))
    tables = {}
    for name, column in (("tags", "tags"), ("related", "related"), ("sources", "source_files")):
        items = read.select("filename", F.posexplode(column).alias("pos", "value"))
        stands = F.startswith("value", F.lit(mark))
        named = F.split(F.substring("value", len(mark) + 1, fm.END), ":")
        of_runs = (items.where(stands).select("filename", "pos", named[0].alias("of"),
                                              named[1].cast("int").alias("nth"))
                   .join(runs, ["filename", "of", "nth"])
                   .select("filename", "pos", F.posexplode(values).alias("line", "value")))
        rows = items.where(~stands).withColumn("line", F.lit(0)).unionByName(of_runs)
        tables[name] = rows.select(
            "filename", F.struct(F.col("pos").cast("long").alias("part"), F.col("line").cast("long")
                                 .alias("pos"), F.lit("").alias("key")).cast(AT).alias("at"), "value")
    counts = tables["sources"].groupBy("filename").agg(F.count("*").alias("n_sources"))
    entries = _with_runs(read, runs, mark).join(counts, "filename", "left").withColumn(
        "n_sources", F.coalesce("n_sources", F.lit(0)))
    rest = parts.where(here >= F.col("at")).select("filename", "block", F.when(
        here == F.col("at"), F.substring("text", F.col("end") + 3, F.lit(fm.END)))
        .otherwise(raw).alias("text"))
    body = _trimmed(rest).select("filename", F.lit(0).alias("part"), F.col("block").alias("pos"),
                                 F.lit("").alias("key"), "text")
    return KnowledgeBase.of(entries, body=body, **tables)


def _with_runs(read: DataFrame, runs: DataFrame, mark: str) -> DataFrame:
    """Entries whose quoted values go over lines that stand for runs, with the runs' lines."""
    fields = ["title", "description", "category", "updated_at"]
    values = read.select("filename", F.explode(F.array(*[F.struct(
        F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("f")).select(
            "filename", "f.*").where(F.contains("value", F.lit(mark)))
    part = F.col("part")
    parts = values.select("filename", "field", F.posexplode(F.split("value", f"  - {mark}"))
                          .alias("n", "part"))
    named = F.split(F.substring_index(part, "\n", 1), ":")
    behind = F.substring(part, F.locate("\n", part) + 1, F.lit(fm.END))
    filled = (parts.withColumn("of", F.when(F.col("n") > 0, named[0]))
              .withColumn("nth", F.when(F.col("n") > 0, F.try_element_at(named, F.lit(2))
                                        .try_cast("int")))
              .join(runs, ["filename", "of", "nth"], "left")
              .withColumn("part", F.when(F.col("n") > 0, F.concat("run", behind)).otherwise(part))
              .groupBy("filename").pivot("field", fields)
              .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "part"))),
                                            lambda x: x.part), "")))
    filled = filled.withColumnsRenamed({f: f"__{f}" for f in fields})
    return read.join(filled, "filename", "left").withColumns(
        {f: F.coalesce(F.nullif(f"__{f}", F.lit("")), f) for f in fields}).drop(*[f"__{f}" for f in fields])


def _trimmed(rows: DataFrame) -> DataFrame:
    """Blocks without the white space around the whole text of each file."""
    seen = F.when(text.trim(F.col("text")) != "", F.col("block"))
    bounds = rows.groupBy("filename").agg(F.min(seen).alias("from"), F.max(seen).alias("to"))
    kept = rows.join(bounds, "filename").where(F.col("block").between(F.col("from"), F.col("to")))
    left = F.when(F.col("block") == F.col("from"), F.regexp_replace(
        "text", rf"\A[{WS}]++", "")).otherwise(F.col("text"))
    return kept.withColumn("text", left).withColumn("text", F.when(
        F.col("block") == F.col("to"), F.regexp_replace("text", rf"(?<![{WS}])[{WS}]++\z", ""))
        .otherwise(F.col("text"))).select("filename", "block", "text")


def redact_pieces(body: DataFrame, max_pieces: int | None = None, max_chars: int | None = None, *,
                  max_text: int = segments.TEXT_CHARS) -> DataFrame:
    """Redacted bodies in pieces: those of the whole redacted body, whatever is over their borders.

    A body of up to ``max_text`` characters holds its blocks in one row and comes out as one piece.
    They are written once: what reads them would otherwise redact again.
    """
    order = ["part", "pos", "key"]
    most = {"max_pieces": max_pieces, "max_chars": max_chars}
    large = segments.long_texts(body, "filename", max_chars=max_text)
    if large.isEmpty():
        done = segments.redact_texts(body, "filename", order, **most)
    else:
        few = F.broadcast(large)  # each has more than max_text of all characters, or as many pieces
        joined = segments.blocks(body.join(few, "filename", "left_semi"), "filename", order, **most)
        done = segments.redact_texts(body.join(few, "filename", "left_anti"), "filename", order,
                                     **most).unionByName(segments.redact_blocks(joined, "filename"))
    return freeze(done).where("text <> ''").select(
        "filename", F.lit(0).alias("part"), F.col("block").alias("pos"), F.lit("").alias("key"),
        "text")


def write_stored(kb: StoredKb, path: str) -> None:
    """Write what queries read, so that they need not put documents together again.

    The list of parts is written last: without it nothing is read.
    """
    kb.rows.write.parquet(f"{path}/rows")
    if kb.large is not None:
        write_kb(kb.large, f"{path}/large")
    (kb.rows.sparkSession.range(1).select(F.lit(kb.large is not None).alias("has_large"))
     .coalesce(1).write.parquet(f"{path}/parts"))


def read_stored(spark: SparkSession, path: str) -> StoredKb:
    """What ``write_stored`` wrote; a part that is missing is an error."""
    parts = spark.read.schema("has_large boolean").parquet(f"{path}/parts").first()
    rows = spark.read.parquet(f"{path}/rows")
    return StoredKb(rows, read_kb(spark, f"{path}/large") if parts["has_large"] else None)


def written_pieces(kb: KnowledgeBase) -> DataFrame:
    """Documents as they are written: ordered pieces, with redacted bodies."""
    header = document_pieces(kb).where(F.col("section") < BODY)
    body = redact_pieces(kb.body).select(
        "filename", F.lit(BODY).alias("section"),
        F.struct(F.col("part").cast("long").alias("part"), "pos", "key").alias("at"), "text")

    def at(part: int):
        return F.struct(F.lit(part).cast("long").alias("part"),
                        F.lit(0).cast("long").alias("pos"), F.lit("").alias("key"))

    around = kb.entries.select("filename", F.lit(BODY).alias("section"), F.explode(F.array(
        F.struct(at(-1).alias("at"), F.lit("\n\n").alias("text")),
        F.struct(at(2**62).alias("at"), F.lit("\n").alias("text")))).alias("p")).select(
            "filename", "section", "p.at", "p.text")
    return header.unionByName(body).unionByName(around)


def write_documents(kb: KnowledgeBase, path: str) -> None:
    """Documents as a table of ordered pieces below ``path``, which ``load_written`` reads.

    Rows are spread by range and sorted, so an entry with many lines is written in parallel and a
    reader of some entries opens few files.
    """
    order = ["filename", "section", "at"]
    (written_pieces(kb).repartitionByRange(*order).sortWithinPartitions(*order)
     .write.parquet(path))


def load_written(spark: SparkSession, path: str, as_of: str,
                 max_chars: int = MAX_DOCUMENT_CHARS) -> StoredKb:
    """Entries of what ``write_documents`` wrote, of any size.

    Those of more than ``max_chars`` are read block by block, to the same result.
    """
    pieces = list_entries(spark.read.parquet(path))
    large = freeze(large_entries(pieces, max_chars))
    few = F.broadcast(large)  # each has more than max_chars of all characters
    small = gather_text(pieces.join(few, "filename", "left_anti"), "filename", ["section", "at"],
                        max_chars=max_chars)
    rows = load_entries(small.select("filename", F.col("text").alias("document")), as_of)
    if large.isEmpty():
        return StoredKb(rows)
    return StoredKb(rows, load_blocks(_blocks(pieces.join(few, "filename", "left_semi")), as_of))


def read_written(spark: SparkSession, path: str,
                 max_chars: int = MAX_DOCUMENT_CHARS) -> DataFrame:
    """``filename, block, document``: the texts that ``write_documents`` wrote.

    A document of more than ``max_chars`` is several rows, told apart and ordered by ``block``;
    ``load_written`` reads entries of any size.
    """
    pieces = list_entries(spark.read.parquet(path))
    return gather_text(pieces, "filename", ["section", "at"], max_chars=max_chars).select(
        "filename", "block", F.col("text").alias("document"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A folder of markdown files, one document each: ``filename, document``."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.md")
    name = F.substring_index(F.col("_metadata.file_path"), "/", -1)
    return list_entries(files.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
                                     .alias("filename"), F.col("value").alias("document")))
