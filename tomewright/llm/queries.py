"""Registered queries of the operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.llm import (alignment, bpe, decontaminate, fingerprints, jaccard, language_id,
                            licenses, maxent, pii, quality, token_files, toxicity, whitening)
from tomewright.llm.frames import remainder, scratch, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *columns)


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SPACED = r"'[^\x20\x09-\x0D]+'"


def _words_sql(column: str, pattern: str) -> str:
    return f"regexp_extract_all({_LOWER.format(f'coalesce({column}, {chr(39) * 2})')}, {pattern})"


@register(f"""
WITH d AS (SELECT doc_id, {_words_sql('text', _ALNUM)} AS w FROM documents),
b AS (SELECT item_id, {_words_sql('text', _ALNUM)} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
  SELECT item_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM (
    SELECT item_id, w, least(len(w), 10) AS n FROM b) WHERE n > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dwin AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
  SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
  FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, dwin.n, i, item_id FROM dwin JOIN win USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
  SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items,
  string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""")
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_benchmark(documents(spark, sf_dir, "text"),
                                         table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", decontaminate.n_hit().alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        (F.size("item_ids") > 0).alias("contaminated"))


@register()
def op8_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    def line(labels: F.Column) -> F.Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    found = licenses.scan_licenses(documents(spark, sf_dir, "text"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        line(F.col("base_labels")).alias("base_labels"),
        line(F.concat("base_labels", "template_labels")).alias("labels"), "score")


@register()
def op9_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(documents(spark, sf_dir, "text"))


@register()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "text", "lang")
    held_out = remainder("doc_id", 5) == 0
    model = language_id.train(docs.where(~held_out))
    return language_id.identify(docs.select("doc_id", "text", held_out.alias("held_out")),
                                model).drop("text")


@register()
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "text")
    held_out = remainder("doc_id", 4) == 2
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score(docs.withColumn("held_out", held_out), model).drop("text")


@register()
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.Vocabulary.build(bpe.read_ranks(tokenizer_path("byte_bpe_50k.tiktoken")),
                                      bpe.tiktoken_classes())
    coded = bpe.encode(documents(spark, sf_dir, "text"), vocabulary, decoded="decoded")
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@register()
def op7_token_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_files.write_tokens(documents(spark, sf_dir, "text"),
                             tokenizer_path("byte_bpe_50k.json"), path)
    return token_files.with_crc32(token_files.read_tokens(spark, path)).drop("ids")


@register()
def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(documents(spark, sf_dir, "text"), key="registered query")


@register(f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words_sql('text', _SPACED)} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g FROM (
  SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i
  FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c
  FROM sh a JOIN sh b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT u, v FROM common JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v
  WHERE 100 * c >= 75 * (x.n + y.n - c)),
reach AS (SELECT u, v FROM link UNION SELECT reach.u, link.v FROM reach JOIN link
  ON reach.v = link.u)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles,
  least(doc_id, coalesce(m, doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id)
LEFT JOIN (SELECT u AS doc_id, min(v) AS m FROM reach GROUP BY u) USING (doc_id)""")
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir, "text"))


@register()
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "text")
    held_out = remainder("doc_id", 7) == 2
    model, counts = maxent.train(docs.where(~held_out))
    return maxent.score(docs.withColumn("held_out", held_out), model, counts)


@register()
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.components(vectors, whitening.fit(vectors)).select(
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


@register()
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    def keep(aligned: DataFrame) -> DataFrame:
        lines = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
        return aligned.withColumn("groups_sha256", lines).drop("text", "groups")

    aligned, _ = alignment.align_corpus(
        documents(spark, sf_dir, "text"), tokenizer_path("byte_bpe_50k.json"),
        tokenizer_path("piece_bpe_32k.model"), keep=keep)
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                          "groups_sha256", "n_overlaps")


@register()
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder("doc_id", 3) == 1
    measured = written(quality.measure(documents(spark, sf_dir, "text")).drop("text"), "measured")
    model = quality.train(measured, table(spark, sf_dir, "labels").where(~held_out))
    return quality.score(measured.withColumn("held_out", held_out), model).drop("stats")
