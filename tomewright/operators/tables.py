"""The tables of a knowledge base.

An entry may cover a large share of the corpus. Nothing about an entry that grows with the
corpus is therefore kept in one row: its files, tags and body are rows of their own, told apart
by an order key, and an entry is put together only where it is known to be small.

    entries  filename, title, description, category, updated_at, n_sources
    tags     filename, at, value
    related  filename, at, value
    sources  filename, at, value
    body     filename, part, pos, key, text     (concatenated in the order of part, pos, key)

``at`` is ``struct<part bigint, pos bigint, key string>``; lists are read in its order.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ENTRY_COLUMNS = ["filename", "title", "description", "category", "updated_at", "n_sources"]
AT = "struct<part:bigint,pos:bigint,key:string>"
LIST_SCHEMA = f"filename string, at {AT}, value string"
BODY_SCHEMA = "filename string, part int, pos bigint, key string, text string"


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, known to the optimizer to be none."""
    columns = StructType.fromDDL(schema)
    return spark.range(0).where("false").select(
        *[F.lit(None).cast(c.dataType).alias(c.name) for c in columns])


def _listed(df: DataFrame) -> DataFrame:
    if "at" not in df.columns:
        df = df.withColumn("at", F.struct(F.lit(0).cast("long").alias("part"), "pos",
                                          F.col("value").alias("key")))
    return df.select("filename", F.col("at").cast(AT).alias("at"), "value")


@dataclass(frozen=True)
class KnowledgeBase:
    entries: DataFrame
    tags: DataFrame
    related: DataFrame
    sources: DataFrame
    body: DataFrame

    @classmethod
    def of(cls, entries: DataFrame, *, body: DataFrame, tags: DataFrame | None = None,
           related: DataFrame | None = None, sources: DataFrame | None = None) -> KnowledgeBase:
        none = empty(entries.sparkSession, LIST_SCHEMA)
        lists = [none if t is None else _listed(t) for t in (tags, related, sources)]
        return cls(entries.select(ENTRY_COLUMNS), *lists,
                   body.select("filename", F.col("part").cast("int").alias("part"), "pos", "key",
                               "text"))

    def map(self, change) -> KnowledgeBase:
        """The same change made to every table."""
        return replace(self, **{f.name: change(getattr(self, f.name)) for f in fields(self)})

    def without(self, filenames: DataFrame) -> KnowledgeBase:
        """All but the named entries; naming an entry that is not there is fine."""
        gone = filenames.select("filename").distinct()
        return self.map(lambda t: t.join(gone, "filename", "left_anti"))

    def only(self, filenames: DataFrame) -> KnowledgeBase:
        kept = filenames.select("filename").distinct()
        return self.map(lambda t: t.join(kept, "filename", "left_semi"))

    def plus(self, other: KnowledgeBase) -> KnowledgeBase:
        return KnowledgeBase(*[getattr(self, f.name).unionByName(getattr(other, f.name))
                               for f in fields(self)])


def write_kb(kb: KnowledgeBase, path: str, mode: str = "errorifexists") -> None:
    """Write the tables below ``path``; entries are laid out by category for pruning."""
    for f in fields(kb):
        table = getattr(kb, f.name)
        writer = table.write.mode(mode)
        if f.name == "entries":
            # Spread a category over tasks; a category alone may be most of the table.
            writer = (table.withColumn("__category", F.col("category"))
                      .write.mode(mode).partitionBy("__category"))
        writer.parquet(f"{path}/{f.name}")


def read_kb(spark: SparkSession, path: str) -> KnowledgeBase:
    tables = {f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(KnowledgeBase)}
    tables["entries"] = tables["entries"].select(ENTRY_COLUMNS)
    return KnowledgeBase(**tables)
