"""A cleaning pipeline over ``documents``: five stages, each a table that the next one reads.

Every stage takes ``(spark, docs, sf_dir)`` and works on all documents that the one before kept. All
but the last return the columns of ``documents``, whatever they are; a column whose name an operator
uses for its own keeps its values.

Cases: null and empty texts pass every stage; they are toxic only if the model says so of a text
without words, which it does not on labelled data. Repeated rows and other copies become one row at
the second stage, whatever their ids; a text that is no copy stays, also if its id repeats or is null.
An empty table passes through. Very long texts are read whole by every stage.

Stages with Python tasks lower the session's rows of an Arrow batch to ``BATCH_ROWS``, and leave it so,
since their results are worked out later: by Spark's default of 10,000 texts both the JVM and the
worker hold tens of MB for each task beside what they work on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.llm import bpe, decontaminate, jaccard, pii, toxicity
from tomewright.llm.frames import BATCH_ROWS, remainder, written
from tomewright.llm.queries import table, tokenizer_path

#: Secret of the surrogates; a user sets an own one.
PII_KEY = "corpus pipeline"

_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """Python tasks of this session get ``BATCH_ROWS`` rows at once, or fewer if that is set."""
    if not 0 < int(spark.conf.get(_ARROW_ROWS)) <= BATCH_ROWS:
        spark.conf.set(_ARROW_ROWS, BATCH_ROWS)


def _beside(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on ``docs`` while columns other than the id and the text have neutral names."""
    names = {c: f"other_{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    done = work(docs.withColumnsRenamed(names))
    return done.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from three in four labels."""
    _small_batches(spark)
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2)
    model = toxicity.train(docs, labels)
    return _beside(docs, lambda d: toxicity.score(d, model).where("predicted = 0"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id; documents without words stay.

    Rows are told apart by their id and text together, so ids may repeat or be missing.
    """
    _small_batches(spark)
    def first(d: DataFrame) -> DataFrame:
        d = d.withColumn("row_key", F.xxhash64("doc_id", "text"))
        found = jaccard.jaccard_components(d.select(F.col("row_key").alias("doc_id"), "text"))
        names = d.select("row_key", "doc_id").distinct()
        least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("least")
        kept = (found.where("n_shingles > 0").select(F.col("doc_id").alias("row_key"), "component_id")
                .distinct().join(names, "row_key").groupBy("component_id").agg(least)
                .select("least.row_key"))
        words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        stays = d.where(words).join(kept, "row_key", "left_semi").dropDuplicates(["row_key"])
        return stays.unionByName(d.where(~words)).drop("row_key")

    return _beside(docs, first)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    _small_batches(spark)
    benchmark = table(spark, sf_dir, "benchmark")
    return _beside(docs, lambda d: decontaminate.remove_documents(
        decontaminate.find_benchmark(d, benchmark)))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; ``n_chars`` follows the text."""
    done = _beside(docs, lambda d: pii.replace_entities(d, PII_KEY))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars"))
                               .cast(docs.schema["n_chars"].dataType))
    return done


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token ids, with the text that the ids decode to."""
    _small_batches(spark)
    vocabulary = bpe.Vocabulary.build(bpe.read_ranks(tokenizer_path("byte_bpe_50k.tiktoken")),
                                      bpe.tiktoken_classes())
    others = [c for c in docs.columns if c not in ("text", "ids", "n_tokens", "decoded")]
    coded = bpe.encode(docs.select(*others, "text"), vocabulary, decoded="decoded")
    return coded.select(*others, F.col("decoded").cast("string").alias("text"), "ids",
                        F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("byte_level_bpe", encode_tokens),
]

#: SQL expresses neither the toxicity model nor the merges; see tests/llm/test_llm_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
