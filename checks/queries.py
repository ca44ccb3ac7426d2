"""Registered queries and the SQL each is compared with, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import sqltext as S
from checks.views import AS_OF, VIEWS, table, view, view_sql, written
from tomewright import constants as K
from tomewright.config import KbConfig
from tomewright.functions import paths, secrets, structured, text
from tomewright.operators import (batches, capture, changes, documents, gather, index, query,
                                  query_batch)
from tomewright.operators import facts
from tomewright.operators.facts import javascript as js
from tomewright.operators.facts import markdown as md
from tomewright.operators.facts import merge
from tomewright.operators.facts import python as py
from tomewright.operators.tables import KnowledgeBase, read_kb, write_kb
from tomewright.plans import assemble, directory, model
from tomewright.sources import event_log
from tomewright.sources import files as sources
from tomewright.streaming import refresh

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None, *ctes: str):
    """Register the function below under its name; ``sql`` reads the named CTEs."""
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = S.sql(sql, *ctes)
        return fn
    return wrap


def raw_files(spark: SparkSession, sf: str, name: str = "files_raw") -> DataFrame:
    return sources.files_from_table(view(spark, sf, name))


def prepared(spark: SparkSession, sf: str) -> DataFrame:
    return sources.prepare_files(raw_files(spark, sf))


def files(spark: SparkSession, sf: str) -> DataFrame:
    """What is known of each file, written once: redacted and hashed a single time, no text."""
    return spark.read.parquet(written(spark, sf, "files", lambda p: prepared(spark, sf).drop(
        "content").write.parquet(p)))


def plans(spark: SparkSession, sf: str):
    return assemble.resolve_collisions(directory.plan_by_directory(files(spark, sf)))


def kb_tables(spark: SparkSession, sf: str) -> KnowledgeBase:
    return assemble.assemble_entries(plans(spark, sf), AS_OF)


def kb(spark: SparkSession, sf: str) -> KnowledgeBase:
    """The knowledge base of the corpus, built and written once, as ``init`` does."""
    return read_kb(spark, written(spark, sf, "kb", lambda p: write_kb(kb_tables(spark, sf), p)))


def stored_kb(spark: SparkSession, sf: str) -> documents.StoredKb:
    """What queries read: the entries as their documents read back, written once."""
    return documents.read_stored(spark, written(
        spark, sf, "stored", lambda p: documents.write_stored(
            documents.read_back(kb(spark, sf), AS_OF), p)))


# --- sources ---------------------------------------------------------------------------------

@register(f"SELECT path, {S.ignored('path')} AS ignored FROM files_raw", "files_raw")
def ignored_paths(spark, sf):
    return raw_files(spark, sf).select(
        "path", paths.is_ignored(F.col("path"), K.DEFAULT_IGNORE_PATTERNS).alias("ignored"))


@register(f"SELECT path FROM files_raw WHERE {S.extension('path')} IN ('.ts', '.py', '.txt')",
          "files_raw")
def extension_filter(spark, sf):
    return sources.filter_extensions(raw_files(spark, sf), [".ts", ".py", ".txt"]).select("path")


@register(f"SELECT path, {S.extension('path')} AS extension FROM files_raw", "files_raw")
def file_extension(spark, sf):
    return raw_files(spark, sf).select("path", paths.extension(F.col("path")).alias("extension"))


@register(f"SELECT path, strlen(content) AS size FROM files_raw "
          f"WHERE strlen(content) <= {K.MAX_FILE_BYTES}", "files_raw")
def size_filter(spark, sf):
    return sources.filter_size(raw_files(spark, sf)).select("path", "size")


@register(f"""SELECT reason, count(*) AS n_files, CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM (
  SELECT content, CASE WHEN {S.ignored('path')} THEN 'ignored'
    WHEN {S.extension('path')} NOT IN ('.ts', '.py', '.md', '.local', '') THEN 'extension'
    WHEN {S.sensitive('path')} THEN 'sensitive' WHEN strlen(content) > 2000 THEN 'too large' END
    AS reason FROM files_raw) WHERE reason IS NOT NULL GROUP BY reason""", "files_raw")
def dropped_files(spark, sf):
    cfg = KbConfig(include_extensions=(".ts", ".py", ".md", ".local", ""), max_file_bytes=2000)
    return sources.dropped_files(raw_files(spark, sf), cfg)


@register(f"SELECT path, {S.sensitive('path')} AS sensitive FROM files_raw", "files_raw")
def sensitive_paths(spark, sf):
    return raw_files(spark, sf).select(
        "path", secrets.is_sensitive_path(F.col("path")).alias("sensitive"))


@register("SELECT path, size, lines, tokens, hash, extension FROM files", "files")
def prepare_files(spark, sf):
    return prepared(spark, sf).select("path", "size", "lines", "tokens", "hash", "extension")


@register(f"SELECT page_id, substr(sha256(html), 1, 16) AS hash, {S.line_count('html')} AS lines "
          "FROM pages")
def content_hash(spark, sf):
    html = F.col("html")
    return table(spark, sf, "pages").select(
        "page_id", text.content_hash(html).alias("hash"), text.count_lines(html).alias("lines"))


_CLASS_PATH = ("CASE doc_id % 9 WHEN 0 THEN concat('Dockerfile.', doc_id) WHEN 1 THEN 'README.md' "
               "WHEN 2 THEN concat(source, '/package.json') WHEN 3 THEN 'vite.config.ts' "
               "WHEN 4 THEN concat('a', doc_id, '.SCSS') WHEN 5 THEN 'docker-compose.yml' "
               "WHEN 6 THEN concat('user', doc_id, '.model') WHEN 7 THEN '.eslintrc' "
               "ELSE concat(source, '/x', doc_id, '.rs') END")


def _category_sql() -> str:
    base = f"lower({S.basename('path')})"
    stem = f"substr({base}, 1, length({base}) - length({S.extension('path')}))"
    by_name = {n.lower(): c for n, c in K.FILENAME_CATEGORIES.items()}

    def case(of: str, values: dict[str, str]) -> str:
        return f"CASE {of} " + " ".join(f"WHEN {S.lit(k)} THEN {S.lit(v)}"
                                        for k, v in values.items()) + " END"

    return (f"coalesce({case(base, by_name)}, {case(stem, by_name)}, "
            f"{case(S.extension('path'), K.EXTENSION_CATEGORIES)}, 'general')")


@register(f"SELECT doc_id, path, {_category_sql()} AS category "
          f"FROM (SELECT doc_id, {_CLASS_PATH} AS path FROM documents)")
def classify_files(spark, sf):
    return table(spark, sf, "documents").selectExpr("doc_id", f"{_CLASS_PATH} AS path").withColumn(
        "category", paths.classify(F.col("path")))


@register("SELECT path, CASE extension " + " ".join(
    f"WHEN {S.lit(e)} THEN {S.lit(lang)}" for e, lang in K.LANGUAGE_EXTENSIONS.items())
    + " ELSE 'unknown' END AS language "
    f"FROM (SELECT path, {S.extension('path')} AS extension FROM files_raw)", "files_raw")
def detect_language(spark, sf):
    return raw_files(spark, sf).select(
        "path", paths.detect_language(paths.extension(F.col("path"))).alias("language"))


# --- redaction -------------------------------------------------------------------------------

S.CTES["raw_docs"] = ([], f"raw_docs AS ({view_sql('raw_docs')})")
S.CTES["redacted_docs"] = (["raw_docs"], S.redacted("raw_docs", "redacted_docs", extras=True))


def raw_docs(spark, sf):
    return view(spark, sf, "raw_docs")


@register("SELECT doc_id, length(content) AS chars, md5(content) AS digest FROM redacted_docs",
          "redacted_docs")
def redact_text(spark, sf):
    return secrets.redact(raw_docs(spark, sf), "content").select(
        "doc_id", F.length("content").cast("long").alias("chars"), F.md5("content").alias("digest"))


@register("SELECT doc_id, length(content) AS chars, md5(content) AS digest FROM redacted_docs",
          "redacted_docs")
def redact_borders(spark, sf):
    """Whole texts cut into pieces of 48 characters, joined by three: secrets lie over all borders."""
    body = raw_docs(spark, sf).select(
        F.col("doc_id").cast("string").alias("filename"), F.lit(0).alias("part"),
        F.posexplode(F.regexp_extract_all("content", F.lit("(?s).{1,48}"), F.lit(0)))
        .alias("pos", "text")).select("filename", "part", F.col("pos").cast("long").alias("pos"),
                                      F.lit("").alias("key"), "text")
    done = gather.gather_text(documents.redact_pieces(body, max_pieces=3), "filename",
                              ["part", "pos", "key"])
    return done.select(F.col("filename").cast("long").alias("doc_id"),
                       F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@register("SELECT doc_id, redactions FROM redacted_docs", "redacted_docs")
def redact_counts(spark, sf):
    return secrets.redact(raw_docs(spark, sf), "content", count="redactions").select(
        "doc_id", F.col("redactions").cast("long").alias("redactions"))


@register("SELECT doc_id, triggered FROM redacted_docs", "redacted_docs")
def redact_triggered(spark, sf):
    return secrets.redact(raw_docs(spark, sf), "content", triggered="t").select(
        "doc_id", F.array_join("t", " ").alias("triggered"))


@register("SELECT pattern, count(*) AS rows_hit, CAST(sum(redactions) AS BIGINT) AS secrets_in_rows "
          "FROM (SELECT redactions, unnest(string_split(triggered, ' ')) AS pattern "
          "FROM redacted_docs) WHERE pattern <> '' GROUP BY pattern", "redacted_docs")
def redaction_report(spark, sf):
    return secrets.redaction_report(raw_docs(spark, sf), "content")


S.CTES["pages_red"] = ([], S.redacted("(SELECT page_id, html AS content FROM pages)", "pages_red"))


@register("SELECT page_id, md5(content) AS digest FROM pages_red", "pages_red")
def redact_pages(spark, sf):
    return secrets.redact(table(spark, sf, "pages"), "html").select(
        "page_id", F.md5("html").alias("digest"))


def _score_sql(c: str) -> str:
    parts = [f"CASE WHEN regexp_matches({c}, {S.lit(S.re2(p, 'i'))}) THEN {s} ELSE 0 END"
             for p, s in K.SCORE_PATTERNS]
    parts += [f"CASE WHEN contains(lower({c}), {S.lit(w)}) THEN {s} ELSE 0 END"
              for w, s in K.SCORE_WORDS]
    return "CAST(" + " + ".join(parts) + " AS DOUBLE)"


@register(f"SELECT doc_id, {_score_sql('content')} AS score, "
          f"{_score_sql('content')} >= {K.SECRET_SCORE_THRESHOLD} AS likely FROM raw_docs",
          "raw_docs")
def sensitivity_score(spark, sf):
    c = F.col("content")
    return raw_docs(spark, sf).select("doc_id", secrets.sensitivity_score(c).alias("score"),
                                      secrets.likely_contains_secrets(c).alias("likely"))


# --- plans and entries -----------------------------------------------------------------------

@register("SELECT dir AS plan_id, filename, title, category, brief, n_sources FROM all_plans",
          "all_plans")
def plan_by_directory(spark, sf):
    return directory.plan_by_directory(files(spark, sf)).plans.select(
        "plan_id", "filename", "title", "category", "brief", "n_sources")


@register("SELECT filename, count(*) AS n_plans, arg_max(dir, first_path) AS kept FROM all_plans "
          "GROUP BY filename HAVING count(*) > 1", "all_plans")
def resolve_collisions(spark, sf):
    return assemble.count_collisions(directory.plan_by_directory(files(spark, sf)))


@register("SELECT filename, CAST(0 AS BIGINT) AS block, content AS text FROM entries", "entries")
def fallback_content(spark, sf):
    return gather.gather_text(kb_tables(spark, sf).body, "filename", ["part", "pos", "key"])


@register("SELECT e.filename, title, description, category, n_sources, tag, pos AS first_path "
          "FROM entries e JOIN entry_tags t ON e.filename = t.filename", "entries")
def assemble_entries(spark, sf):
    kb = kb_tables(spark, sf)
    tags = kb.tags.select("filename", F.col("value").alias("tag"),
                          F.col("at.key").alias("first_path"))
    return kb.entries.join(tags, "filename").drop("updated_at")


@register("SELECT filename, document FROM docs", "docs")
def render_frontmatter(spark, sf):
    return documents.render_documents(kb_tables(spark, sf))


@register("SELECT filename, document FROM docs", "docs")
def written_documents(spark, sf):
    """The same documents, written as tables of pieces and read again."""
    path = written(spark, sf, "written_documents", lambda p: documents.write_documents(
        kb_tables(spark, sf), p))
    return documents.read_written(spark, path).select("filename", "document")


# --- query -----------------------------------------------------------------------------------

def _score(q: str, category: str | None = None) -> str:
    def hit(c):
        return f"contains(lower({c}), {S.lit(q.lower())})"

    def each(c, w):
        return f"{w} * len(list_filter({c}, lambda x: {hit('x')}))"

    parts = [f"CASE WHEN {hit(c)} THEN {w} ELSE 0 END" for c, w in (
        ("title", 10), ("category", 5), ("description", 6), ("content", 2))]
    parts += [each("tags", 3), each("source_files", 4), each("related", 2)]
    if category:
        parts.append(f"CASE WHEN category = {S.lit(category.lower())} THEN 20 ELSE 0 END")
    return " + ".join(parts)


def _top(q: str, category: str | None = None) -> str:
    gate = "WHERE score > 0 " if category else ""
    return (f"SELECT * FROM (SELECT filename, title, category, description, "
            f"CAST(len(source_files) AS BIGINT) AS n_sources, CAST({_score(q, category)} AS BIGINT) "
            f"AS score FROM kb) {gate}ORDER BY score DESC, filename LIMIT 5")


@register(_top("src1"), "kb")
def kb_query(spark, sf):
    return query.kb_query(stored_kb(spark, sf), "src1")


@register(_top("DOC_7", "Module"), "kb")
def kb_query_category(spark, sf):
    return query.kb_query(stored_kb(spark, sf), "DOC_7", "Module")


@register(_top("no such words", "config"), "kb")
def kb_query_no_match(spark, sf):
    return query.kb_query(stored_kb(spark, sf), "no such words", "config")


# --- change detection ------------------------------------------------------------------------

def snapshot(spark, sf, name):
    return raw_files(spark, sf, f"snapshot_{name}")


def files_before(spark, sf) -> DataFrame:
    """What the previous run knew of each file, written once: redacted a single time, no text."""
    return spark.read.parquet(written(spark, sf, "files_before", lambda p: sources.prepare_files(
        snapshot(spark, sf, "prev")).drop("content").write.parquet(p)))


def prior_state(spark, sf) -> DataFrame:
    """The stored state of the previous run."""
    return changes.file_state(files_before(spark, sf))


def detected(spark, sf) -> DataFrame:
    return changes.detect_changes(sources.fingerprints(snapshot(spark, sf, "now")),
                                  prior_state(spark, sf))


def current_changes(spark, sf) -> DataFrame:
    """The changes as a written table, which several steps of an update read."""
    return spark.read.parquet(written(spark, sf, "changes", lambda p: detected(
        spark, sf).write.parquet(p)))


def kb_before(spark, sf) -> KnowledgeBase:
    """The stored knowledge base of the previous run, with one entry added by hand."""
    def write(path: str) -> None:
        planned = assemble.resolve_collisions(directory.plan_by_directory(
            files_before(spark, sf)))
        note = spark.range(1).select(
            F.lit("note").alias("title"), F.lit("general").alias("category"),
            F.lit("by hand").alias("description"), F.lit("remember this").alias("text"))
        write_kb(assemble.assemble_entries(planned, "2024-12-31T00:00:00.000Z").plus(
            capture.capture_entries(note, "2024-12-31T00:00:00.000Z")), path)

    return read_kb(spark, written(spark, sf, "kb_before", write))


def kb_now(spark, sf) -> KnowledgeBase:
    return assemble.assemble_entries(assemble.resolve_collisions(directory.plan_by_directory(
        sources.prepare_files(snapshot(spark, sf, "now")))), AS_OF)


@register("SELECT path, status FROM changes", "changes")
def detect_changes(spark, sf):
    return detected(spark, sf)


@register("SELECT DISTINCT path FROM (SELECT path FROM changes WHERE status <> 'removed' UNION ALL "
          "SELECT url FROM pages WHERE page_id % 9 = 0)", "changes")
def changed_paths(spark, sf):
    vcs = table(spark, sf, "pages").where("page_id % 9 = 0").select(F.col("url").alias("path"))
    return changes.changed_paths(current_changes(spark, sf), vcs)


@register("SELECT filename FROM stale", "stale")
def stale_entries(spark, sf):
    return changes.stale_entries(kb_before(spark, sf), current_changes(spark, sf))


@register(f"""SELECT filename, n_sources, updated_at FROM (
  SELECT filename, n_sources, '2024-12-31T00:00:00.000Z' AS updated_at FROM prev_plan
  WHERE filename NOT IN (SELECT filename FROM stale)
  AND filename NOT IN (SELECT filename FROM now_plan)
  UNION ALL SELECT filename, n_sources, '{AS_OF}' FROM now_plan)""", "stale", "now_plan")
def upsert_entries(spark, sf):
    before = kb_before(spark, sf)
    stale = changes.stale_entries(before, current_changes(spark, sf))
    return changes.upsert_entries(before, stale, kb_now(spark, sf)).entries.select(
        "filename", "n_sources", "updated_at")


@register("""SELECT (SELECT count(*) FROM now_plan) AS entries_updated,
  (SELECT count(*) FROM stale) AS entries_removed, (SELECT count(*) FROM stale) AS entries_created_ref,
  (SELECT count(*) FROM now_plan WHERE filename NOT IN (SELECT filename FROM prev_plan)) AS entries_created,
  (SELECT count(*) FROM now) AS files_scanned""", "stale", "now_plan")
def refresh_report(spark, sf):
    before = kb_before(spark, sf)
    stale = changes.stale_entries(before, current_changes(spark, sf))
    files_now = sources.prepare_files(snapshot(spark, sf, "now"))
    return changes.refresh_report(before, stale, kb_now(spark, sf), files_now)


@register(f"SELECT 1 AS version, '{AS_OF}' AS created_at, '{AS_OF}' AS updated_at, 'abc' AS last_commit, "
          "(SELECT count(*) FROM files) AS total_files, (SELECT count(*) FROM plans) AS total_entries, "
          """(SELECT '{"module":' || count(*) || '}' FROM plans) AS categories""", "plans")
def build_state(spark, sf):
    return changes.state_summary(files(spark, sf), kb(spark, sf).entries, AS_OF, "abc")


# --- batches ---------------------------------------------------------------------------------

_BUDGET = 3000  # small enough for many batches and some files larger than one

S.CTES["packed"] = (["files"], f"""RECURSIVE seq AS (
  SELECT path, tokens, row_number() OVER (ORDER BY path) AS n FROM files),
fold AS (SELECT n, path, tokens, 0::BIGINT AS batch_id,
    CASE WHEN tokens > {_BUDGET} THEN -1 ELSE tokens END AS cur FROM seq WHERE n = 1
  UNION ALL SELECT s.n, s.path, s.tokens,
    CASE WHEN s.tokens > {_BUDGET} OR f.cur < 0 OR f.cur + s.tokens > {_BUDGET}
      THEN f.batch_id + 1 ELSE f.batch_id END,
    CASE WHEN s.tokens > {_BUDGET} THEN -1
      WHEN f.cur < 0 OR f.cur + s.tokens > {_BUDGET} THEN s.tokens ELSE f.cur + s.tokens END
  FROM fold f JOIN seq s ON s.n = f.n + 1)""")


def _recursive(sql: str) -> str:
    return sql.replace("RECURSIVE seq", "seq").replace("WITH ", "WITH RECURSIVE ", 1)


@register(f"SELECT doc_id, {S.tokens('text')} AS tokens FROM documents")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@register("SELECT batch_id, count(*) AS n_files, least(CAST(sum(tokens) AS BIGINT), "
          f"{_BUDGET}) AS est_tokens, min(path) AS first_path, max(path) AS last_path FROM fold "
          "GROUP BY batch_id", "packed")
def pack_batches(spark, sf):
    assigned = batches.assign_batches(files(spark, sf), _BUDGET)
    return batches.pack_batches(assigned, _BUDGET).drop("shard")


@register("SELECT batch_id, f.path, md5('=== ' || f.path || ' ===' || chr(10) || CASE WHEN "
          f"f.tokens > {_BUDGET} THEN substr(content, 1, {_BUDGET * 4}) || chr(10) || "
          "'... (truncated)' ELSE content || chr(10) || chr(10) END) AS digest "
          "FROM fold JOIN files f USING (path)", "packed")
def batch_text(spark, sf):
    assigned = batches.assign_batches(files(spark, sf), _BUDGET)
    return batches.batch_text(assigned, prepared(spark, sf), _BUDGET).select(
        "batch_id", "path", F.md5("text").alias("digest"))


for _name in ("pack_batches", "batch_text"):
    SQL[_name] = _recursive(SQL[_name])


# --- entry documents -------------------------------------------------------------------------

_FLAT = ("filename, title, description, category, array_to_string(tags, '|') AS tags, "
         "array_to_string(related, '|') AS related, array_to_string(source_files, '|') AS "
         "source_files, updated_at, content")


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select("filename", "title", "description", "category",
                       *[F.array_join(c, "|").alias(c) for c in ("tags", "related", "source_files")],
                       "updated_at", "content")


@register(f"SELECT {_FLAT} FROM kb", "kb")
def load_entries(spark, sf):
    return _flat(stored_kb(spark, sf).rows)


_DOCS = {  # documents that test the grammar, made from the given texts
    "filename": "CASE WHEN doc_id % 12 = 11 THEN concat('e', doc_id, '.txt') "
                "ELSE concat('e', doc_id, '.md') END",
    "document": "CASE doc_id % 10 "
    "WHEN 0 THEN text "
    "WHEN 1 THEN concat('---', chr(10), 'title: open', chr(10), text) "
    "WHEN 2 THEN concat('---', chr(10), 'title: \"a \\\"q\\\" b\"', chr(10), 'tags:', chr(10), '  - x', chr(10), '---', chr(10), text) "
    "WHEN 3 THEN concat('---', chr(10), 'title: a: b', chr(10), 'category:  api  ', chr(10), 'tags:', chr(10), 'related:', chr(10), '- r1', chr(10), '- r2', chr(10), '---', text) "
    "WHEN 4 THEN concat('---', chr(10), 'title: \"x --- y\"', chr(10), 'tags:', chr(10), ' - t', chr(10), '---', chr(10), text) "
    "WHEN 5 THEN concat('---', chr(10), 'description: \"tags: none\"', chr(10), 'title: T', doc_id, chr(10), 'tags:', chr(10), chr(10), '  - a', chr(10), chr(10), '  - b', chr(10), '---', chr(10), text, chr(10)) "
    "WHEN 6 THEN concat('---', chr(10), 'sourceFiles: []', chr(10), 'updatedAt: \"2020\"', chr(10), '---', text) "
    "WHEN 7 THEN concat('---title: near', chr(10), 'category: \"module\"', chr(13), chr(10), 'related:', chr(10), 'x', chr(10), '-', chr(10), '- ', chr(160), 'k', chr(10), '---', chr(10), text) "
    "WHEN 8 THEN concat('---', chr(10), 'title: \"\"', chr(10), 'category:', chr(10), 'description: \"two', chr(10), 'lines\"', chr(10), '---', chr(10), text) "
    "ELSE concat(' ---', chr(10), text) END".replace('\\"', "', chr(92), '\""),
}
VIEWS["entry_docs"] = ("documents", _DOCS, "true")
S.CTES["odd"] = ([], f"odd_docs AS (SELECT * FROM ({view_sql('entry_docs')}) WHERE "
                 "ends_with(filename, '.md') AND filename <> 'index.md'),\n"
                 + S.loaded("odd_docs", "odd", AS_OF))


@register(f"SELECT {_FLAT} FROM odd", "odd")
def parse_documents(spark, sf):
    docs = documents.list_entries(view(spark, sf, "entry_docs"))
    return _flat(documents.load_entries(docs, AS_OF))


def _rows_of(kb: KnowledgeBase) -> DataFrame:
    """Entries kept as tables, as rows."""
    def listed(table, name):
        items = F.sort_array(F.collect_list(F.struct("at", "value")))
        return table.groupBy("filename").agg(F.transform(items, lambda x: x.value).alias(name))

    rows = kb.entries
    for table, name in ((kb.tags, "tags"), (kb.related, "related"), (kb.sources, "source_files")):
        rows = rows.join(listed(table, name), "filename", "left").withColumn(
            name, F.coalesce(name, F.array().cast("array<string>")))
    body = gather.gather_text(kb.body, "filename", ["part", "pos", "key"])
    return rows.join(body.withColumnRenamed("text", "content"), "filename", "left").fillna(
        "", ["content"])


@register(f"SELECT {_FLAT} FROM kb", "kb")
def load_large_entries(spark, sf):
    """Written documents, each read as one that is too large for a row."""
    path = written(spark, sf, "written_documents", lambda p: documents.write_documents(
        kb_tables(spark, sf), p))
    return _flat(_rows_of(documents.load_written(spark, path, AS_OF, max_chars=1).large))


@register(f"SELECT {_FLAT} FROM odd", "odd")
def parse_blocks(spark, sf):
    """The documents that test the grammar, cut into blocks of 40 characters."""
    docs = documents.list_entries(view(spark, sf, "entry_docs"))
    blocks = docs.select("filename", F.posexplode(F.regexp_extract_all(
        "document", F.lit("(?s).{1,40}"), F.lit(0))).alias("block", "document"))
    return _flat(_rows_of(documents.load_blocks(blocks, AS_OF)))


@register("SELECT filename, array_to_string(related, '|') AS related, "
          "related = source_files AS same FROM kb", "kb")
def roundtrip_related(spark, sf):
    return stored_kb(spark, sf).rows.select(
        "filename", F.array_join("related", "|").alias("related"),
        (F.col("related") == F.col("source_files")).alias("same"))


# --- index -----------------------------------------------------------------------------------
# Entries of all categories: one per document, as if a model had planned them.

_CATS = [c for c, _, _ in K.CATEGORY_META] + ["made-up"]
_CAT = "CASE doc_id % 26 " + " ".join(
    f"WHEN {i} THEN '{_CATS[i % 13]}'" for i in range(26)) + " END"
_ENTRIES = {
    "filename": "concat('e_', doc_id, '.md')", "title": "concat(source, ' #', doc_id)",
    "description": f"CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN concat({_CAT}, ' — 3 files') "
                   "WHEN 2 THEN 'tiny' ELSE substr(text, 1, 60) END",
    "category": _CAT, "updated_at": f"'{AS_OF}'", "n_sources": "doc_id % 9",
    "tag": "CASE doc_id % 7 WHEN 0 THEN 'go' WHEN 1 THEN 'java' WHEN 2 THEN 'ts' WHEN 3 THEN 'c' "
           "WHEN 4 THEN 'Zeta' WHEN 5 THEN lang ELSE source END",
}
VIEWS["planned_entries"] = ("documents", _ENTRIES, "true")
S.CTES["ent"] = ([], f"ent AS ({view_sql('planned_entries')})")
S.CTES["ent_tags"] = (["ent"], "ent_tags AS (SELECT filename, category AS tag, 0 AS pos FROM ent "
                      "UNION ALL SELECT filename, tag, 1 FROM ent WHERE tag <> category)")


def planned_kb(spark, sf) -> KnowledgeBase:
    rows = view(spark, sf, "planned_entries")
    tags = rows.select("filename", F.posexplode(F.array_distinct(F.array("category", "tag")))
                       .alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))
    body = rows.select("filename", F.lit(0).alias("part"), F.lit(0).cast("long").alias("pos"),
                       F.lit("").alias("key"), F.col("description").alias("text"))
    return KnowledgeBase.of(rows, body=body, tags=tags)


_LABEL = "CASE category " + " ".join(
    f"WHEN {S.lit(c)} THEN {S.lit(label)}" for c, label, _ in K.CATEGORY_META) + " ELSE category END"
_ABOUT = "CASE category " + " ".join(
    f"WHEN {S.lit(c)} THEN {S.lit(about)}" for c, _, about in K.CATEGORY_META) + " ELSE '' END"


@register("SELECT category, count(*) AS n_entries FROM ent GROUP BY category", "ent")
def category_counts(spark, sf):
    return index.category_counts(planned_kb(spark, sf).entries)


@register(f"SELECT category, {_LABEL} AS label, {_ABOUT} AS about, filename, '- [' || title || "
          "'](./' || filename || ') — ' || CASE WHEN length(description) > 120 THEN "
          "substr(description, 1, 117) || '...' ELSE description END || ' (' || n_sources || "
          "' files)' AS line FROM ent", "ent")
def category_index(spark, sf):
    return index.category_index(planned_kb(spark, sf).entries)


@register("SELECT tag, filename FROM ent_tags", "ent_tags")
def tag_index(spark, sf):
    return index.tag_index(planned_kb(spark, sf))


@register("SELECT count(*) AS n_entries, CAST(sum(n_sources) AS BIGINT) AS n_files, "
          "count(DISTINCT category) AS n_categories FROM ent", "ent")
def overview_totals(spark, sf):
    return index.overview_totals(planned_kb(spark, sf).entries)


@register("SELECT upper(substr(tag, 1, 1)) || substr(tag, 2) AS language, min(filename) AS first "
          f"FROM ent_tags WHERE tag IN ({', '.join(map(S.lit, K.OVERVIEW_LANGUAGES))}) GROUP BY tag",
          "ent_tags")
def overview_languages(spark, sf):
    return index.overview_languages(planned_kb(spark, sf)).select(
        "language", F.col("first.filename").alias("first"))


@register("SELECT filename, '- **' || title || '**: ' || CASE WHEN length(description) > 5 THEN "
          "description ELSE n_sources || ' file(s)' END AS line FROM ent "
          "WHERE category = 'module' ORDER BY filename LIMIT 8", "ent")
def overview_modules(spark, sf):
    return index.overview_modules(planned_kb(spark, sf).entries)


@register(f"""SELECT t.category, first_filename, '- **' || {_LABEL.replace('category', 't.category')} || '**' ||
  CASE WHEN told IS NOT NULL THEN ' (' || files || ' files): ' || told
  ELSE ': ' || files || ' file(s) in ' || n || ' entry(ies)' END AS line
FROM (SELECT category, CAST(sum(n_sources) AS BIGINT) AS files, count(*) AS n, min(filename) AS first_filename
  FROM ent WHERE category <> 'module' GROUP BY category) t
LEFT JOIN (SELECT category, string_agg(description, '; ' ORDER BY filename) AS told FROM (
    SELECT * FROM ent WHERE length(description) > 10
    AND NOT starts_with(description, category || ' —')
    QUALIFY row_number() OVER (PARTITION BY category ORDER BY filename) <= 3)
  GROUP BY category) d ON d.category = t.category""", "ent")
def overview_areas(spark, sf):
    return index.overview_areas(planned_kb(spark, sf).entries)


@register("SELECT (SELECT count(*) FROM plans) AS entries_created, (SELECT count(*) FROM files) AS "
          "files_scanned, CAST(1 AS BIGINT) AS n_categories, "
          """(SELECT '{"module":' || count(*) || '}' FROM plans) AS categories""", "plans")
def init_report(spark, sf):
    return index.init_report(kb(spark, sf).entries, files(spark, sf))


@register("SELECT 'This project has a markdown knowledge base at .kb/ (' || (SELECT count(*) FROM ent) "
          f"|| ' entries, last updated {AS_OF}). Use the kb_query tool to search it for project "
          "information. Top entries: ' || (SELECT string_agg(filename, ', ' ORDER BY filename) FROM "
          "(SELECT filename FROM ent ORDER BY filename LIMIT 10)) AS hint", "ent")
def kb_hint(spark, sf):
    return index.kb_hint(planned_kb(spark, sf).entries, AS_OF)


_END = S.lit("\U0010ffff")
_LINKS = "'[' || filename || '](./' || filename || ')'"


@register(f"""SELECT 0 AS section, '' AS k1, '' AS k2, 0 AS n, '# Knowledge Base Index' || chr(10) || chr(10)
  || '> Auto-generated by **tomewright** — {AS_OF}' || chr(10) || chr(10) || '## Project Overview' || chr(10) || chr(10)
  || 'This project has **' || n_entries || ' knowledge base entries** covering **' || n_files || ' files** across '
  || n_categories || ' categories.' || chr(10) || chr(10) AS text FROM ({SQL['overview_totals']})
UNION ALL SELECT 2, '', '', 0, '**Languages**: ' || string_agg(upper(substr(tag, 1, 1)) || substr(tag, 2), ', ' ORDER BY f) || chr(10)
  FROM (SELECT tag, min(filename || pos) AS f FROM ent_tags
    WHERE tag IN ({', '.join(map(S.lit, K.OVERVIEW_LANGUAGES))}) GROUP BY tag)
UNION ALL SELECT 3, '', '', 0, chr(10) || '**Modules**:' || chr(10)
UNION ALL SELECT 3, filename, '', 1, line || chr(10) FROM ({SQL['overview_modules']})
UNION ALL SELECT 4, '', '', 0, chr(10) || '**Other areas**:' || chr(10)
UNION ALL SELECT 4, first_filename, '', 1, line || chr(10) FROM ({SQL['overview_areas']})
UNION ALL SELECT 5, '', '', 0, chr(10) || '> 💡 Use `kb_query` to search entries by keyword, category, or tag. Each entry contains extracted knowledge about purpose, responsibilities, API surface, and more.'
  || chr(10) || chr(10) || '## Quick Navigation' || chr(10) || chr(10)
UNION ALL SELECT 6, min(filename), '', 0, '### ' || label || chr(10) || chr(10) || '> ' || about || chr(10) || chr(10)
  FROM ({SQL['category_index']}) GROUP BY category, label, about
UNION ALL SELECT 6, min(filename) OVER (PARTITION BY category), filename, 1, line || chr(10) FROM ({SQL['category_index']})
UNION ALL SELECT 6, min(filename), {_END}, 2, chr(10) FROM ent GROUP BY category
UNION ALL SELECT 7, '', '', 0, '## Tags' || chr(10) || chr(10)
UNION ALL SELECT 7, tag, filename, 1, CASE WHEN filename = min(filename) OVER (PARTITION BY tag)
  THEN '- `' || tag || '`: ' ELSE ', ' END || {_LINKS} FROM ent_tags
UNION ALL SELECT 7, tag, {_END}, 2, chr(10) FROM ent_tags GROUP BY tag""", "ent_tags")
def render_index(spark, sf):
    return index.index_pieces(planned_kb(spark, sf), AS_OF).drop("word")


# --- more on queries -------------------------------------------------------------------------

@register("SELECT h.filename, '### ' || title || chr(10) || 'Category: ' || category || "
          "' | Files: ' || n_sources || ' | Score: ' || score || chr(10) || description || chr(10) "
          "|| chr(10) || substr(content, 1, 2000) || CASE WHEN length(content) > 2000 THEN chr(10) "
          f"|| '...(truncated)' ELSE '' END AS rendered FROM ({_top('src')}) h "
          "JOIN (SELECT filename, content FROM kb) c USING (filename)", "kb")
def render_hits(spark, sf):
    stored = stored_kb(spark, sf)
    return query.render_hits(stored, query.kb_query(stored, "src")).select("filename", "rendered")


@register("""SELECT 'category' AS kind, min(filename) AS first, category AS value FROM ent GROUP BY category
UNION ALL SELECT * FROM (SELECT 'tag', min(filename) AS f, tag FROM ent_tags GROUP BY tag
  ORDER BY f, min(filename || pos) LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'title', filename, title FROM ent ORDER BY filename LIMIT 15)""",
          "ent_tags")
def query_suggestions(spark, sf):
    return query.query_suggestions(planned_kb(spark, sf)).select(
        "kind", F.col("first.filename").alias("first"), "value")


_Q = "lower(q.query)"
S.CTES["asked"] = ([], f"asked AS ({view_sql('queries')})")


# Every word of the benchmark as a query.
S.CTES["words"] = ([], "words AS (SELECT DISTINCT w AS query_id, w AS query, NULL AS category FROM "
                   "(SELECT unnest(regexp_extract_all(lower(text), '[^ ]+')) AS w FROM benchmark))")
_BATCH = f"""SELECT query_id, rank, filename, score FROM (SELECT *, row_number() OVER (
    PARTITION BY query_id ORDER BY score DESC, filename) AS rank FROM (
  SELECT q.query_id, e.filename, nullif(q.category, '') AS asked_for, CAST(
    CASE WHEN contains(lower(title), {_Q}) THEN 10 ELSE 0 END
    + CASE WHEN contains(lower(e.category), {_Q}) THEN 5 ELSE 0 END
    + CASE WHEN contains(lower(description), {_Q}) THEN 6 ELSE 0 END
    + CASE WHEN contains(lower(content), {_Q}) THEN 2 ELSE 0 END
    + 3 * len(list_filter(tags, lambda x: contains(lower(x), {_Q})))
    + 4 * len(list_filter(source_files, lambda x: contains(lower(x), {_Q})))
    + 2 * len(list_filter(related, lambda x: contains(lower(x), {_Q})))
    + CASE WHEN q.category <> '' AND e.category = lower(q.category) THEN 20 ELSE 0 END
    AS BIGINT) AS score FROM asked q, kb e) WHERE score > 0 OR asked_for IS NULL) WHERE rank <= 5"""


@register(_BATCH.replace("FROM asked", "FROM words"), "words", "kb")
def kb_query_words(spark, sf):
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[^ ]+"), F.lit(0)))
    words = table(spark, sf, "benchmark").select(word.alias("query")).distinct()
    return query_batch.kb_query_batch(stored_kb(spark, sf), words.select(
        F.col("query").alias("query_id"), "query", F.lit(None).cast("string").alias("category")))


@register(_BATCH, "asked", "kb")
def kb_query_batch(spark, sf):
    return query_batch.kb_query_batch(stored_kb(spark, sf), view(spark, sf, "queries"))


# --- capture ---------------------------------------------------------------------------------

S.CTES["latest"] = ([], "latest AS (SELECT conv_id, arg_max(text, turn) AS text FROM conversations "
                    "WHERE role = 'assistant' AND text <> '' GROUP BY conv_id)")


@register("SELECT conv_id, text FROM latest", "latest")
def latest_assistant(spark, sf):
    return capture.latest_assistant(table(spark, sf, "conversations"))


_SECRET_TEXT = "concat('pwd = x', conv_id, chr(10), text)"
S.CTES["captured"] = (["latest"], f"to_capture AS (SELECT conv_id, {_SECRET_TEXT} AS content FROM latest),\n"
                      + S.redacted("to_capture", "captured"))


def _captures(spark, sf) -> DataFrame:
    said = capture.latest_assistant(table(spark, sf, "conversations"))
    return said.selectExpr("conv_id", f"{_SECRET_TEXT} AS text")


@register(f"""SELECT 'assistant-the-talk-no-' || conv_id || '.md' AS filename, 'The "Talk" no. ' || conv_id || '!' AS title,
  'assistant-output|manually-added' AS tags, '## Assistant Output' || chr(10) || chr(10) ||
  'Captured from assistant session on {AS_OF}.' || chr(10) || chr(10) || content AS content FROM captured""",
          "captured")
def capture_entries(spark, sf):
    messages = _captures(spark, sf).select(
        "text", F.concat(F.lit('The "Talk" no. '), "conv_id", F.lit("!")).alias("title"),
        F.lit("general").alias("category"), F.lit(capture.DEFAULT_DESCRIPTION).alias("description"))
    made = capture.capture_entries(messages, AS_OF)
    tags = made.tags.groupBy("filename").agg(F.array_join(F.transform(F.sort_array(
        F.collect_list(F.struct("at", "value"))), lambda t: t.value), "|").alias("tags"))  # two
    return made.entries.join(tags, "filename").join(made.body, "filename").select(
        "filename", "title", "tags", F.col("text").alias("content"))


# Conversations go to entry files by number, several to some; the entries then read back.
S.CTES["twice"] = (["captured"], S.redacted(
    f"""(SELECT filename, '---' || chr(10) || chr(10) || string_agg(chr(10) || chr(10) || '---' || chr(10) || chr(10)
  || '## Assistant Output ({AS_OF})' || chr(10) || chr(10) || content, '' ORDER BY conv_id) AS content
  FROM (SELECT 'e_' || (conv_id % 50) || '.md' AS filename, conv_id, content FROM captured) GROUP BY filename)""",
    "twice"))


@register("SELECT filename, md5(substr(content, 6)) AS digest, length(content) - 5 AS chars FROM twice "
          "WHERE filename IN (SELECT filename FROM ent)", "twice", "ent")
def merge_capture(spark, sf):
    messages = _captures(spark, sf).select(
        F.concat(F.lit("e_"), F.col("conv_id") % 50, F.lit(".md")).alias("filename"),
        F.col("conv_id").alias("seq"), "text")
    base = planned_kb(spark, sf)
    merged = capture.merge_capture(base, messages, AS_OF)
    added = merged.body.where("part > 0")
    whole = gather.gather_text(added, "filename", ["part", "pos", "key"])
    return secrets.redact(whole, "text").select(
        "filename", F.md5("text").alias("digest"), F.length("text").cast("long").alias("chars"))


# --- model event log -------------------------------------------------------------------------

def event_lines(spark, sf) -> DataFrame:
    """Conversations as event logs, with lines of other kinds, blank ones and broken ones."""
    usage = F.when(F.col("conv_id") % 3 != 0, F.struct(
        F.length("text").alias("input"), F.col("turn").alias("output"),
        F.struct((F.col("turn") * 0.5).alias("total")).alias("cost")))
    event = F.to_json(F.struct(
        F.when(F.col("turn") % 5 == 4, "message_update").otherwise("message_end").alias("type"),
        F.struct("role", F.array(F.struct(F.lit("thinking").alias("type"), F.lit("no").alias("text")),
                                 F.struct(F.lit("text").alias("type"), "text")).alias("content"),
                 usage.alias("usage")).alias("message")))
    line = (F.when(F.col("turn") % 7 == 6, F.lit("  ")).when(F.col("turn") % 11 == 10, F.lit("{oops"))
            .otherwise(event))
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("run_id"), F.col("turn").alias("ord"), line.alias("line"))


S.CTES["ended"] = ([], "ended AS (SELECT * FROM conversations WHERE role = 'assistant' AND turn % 5 <> 4 "
                   "AND turn % 7 <> 6 AND turn % 11 <> 10)")


@register("SELECT conv_id AS run_id, CAST(0 AS BIGINT) AS block, string_agg(text, '' ORDER BY turn) AS text "
          "FROM ended GROUP BY conv_id", "ended")
def reply_text(spark, sf):
    return event_log.reply_text(event_lines(spark, sf))


@register("SELECT conv_id AS run_id, CASE WHEN conv_id % 3 <> 0 THEN CAST(sum(length(text)) AS BIGINT) END AS input, "
          "CASE WHEN conv_id % 3 <> 0 THEN CAST(sum(turn) AS BIGINT) END AS output, "
          "CASE WHEN conv_id % 3 <> 0 THEN CAST(sum(turn * 0.5) AS DOUBLE) END AS cost "
          "FROM ended GROUP BY conv_id", "ended")
def usage_rollup(spark, sf):
    return event_log.usage_rollup(event_lines(spark, sf))


# --- structured data -------------------------------------------------------------------------

@register("SELECT event_id, CASE WHEN event_type = 'click' THEN '' ELSE '[REDACTED]' END AS password, "
          "'[REDACTED]' AS api_key, event_type AS name, '[REDACTED]' AS inner_token, "
          "CAST(user_id AS VARCHAR) AS inner_safe FROM events")
def redact_structured(spark, sf):
    record = F.struct(
        F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type")).alias("password"),
        F.concat(F.lit("k"), "event_id").alias("API_KEY"), F.col("event_type").alias("name"),
        F.struct(F.col("props").alias("token"), F.col("user_id").cast("string").alias("safe"))
        .alias("nested"))
    rows = table(spark, sf, "events").select("event_id", record.alias("r"))
    clean = rows.select("event_id", structured.redact_typed(
        F.col("r"), rows.schema["r"].dataType).alias("r"))
    return clean.select(
        "event_id", "r.password", F.col("r.API_KEY").alias("api_key"), "r.name",
        F.col("r.nested.token").alias("inner_token"), F.col("r.nested.safe").alias("inner_safe"))


@register("SELECT event_id, '[REDACTED]' AS token, event_type AS kind, '' AS passwd FROM events")
def redact_map(spark, sf):
    props = F.create_map(F.lit("Token"), "props", F.lit("kind"), "event_type", F.lit("passwd"), F.lit(""))
    m = structured.redact_map(F.col("m"))
    return table(spark, sf, "events").select("event_id", props.alias("m")).select(
        "event_id", m.alias("m")).select("event_id", F.col("m")["Token"].alias("token"),
                                         F.col("m")["kind"].alias("kind"),
                                         F.col("m")["passwd"].alias("passwd"))


@register("SELECT event_id, '{\"password\":\"[REDACTED]\",\"list\":[{\"key\":\"x\"}],\"deep\":"
          "{\"Secret\":\"[REDACTED]\",\"n\":' || user_id || '}}' AS record FROM events")
def redact_json(spark, sf):
    record = F.concat(F.lit('{"password": "'), "event_type", F.lit('", "list": [{"key": "x"}], "deep": '
                      '{"Secret": "s", "n": '), "user_id", F.lit("}}"))
    return table(spark, sf, "events").select(
        "event_id", structured.redact_json(record).alias("record"))


# --- facts -----------------------------------------------------------------------------------

S.CTES["code"] = ([], f"code AS (SELECT *, {S.extension('path')} AS ext FROM ({view_sql('code_files')}))")
_SCRIPTS, _PYTHON = "ext IN ('.ts', '.js')", "ext = '.py'"


def code_files(spark, sf) -> DataFrame:
    return view(spark, sf, "code_files").select("path", "content")


def all_facts(spark, sf) -> DataFrame:
    """Facts of the code files as a written table: one extraction, then queries on its rows."""
    return spark.read.parquet(written(spark, sf, "facts", lambda p: facts.extract_facts(
        code_files(spark, sf)).write.parquet(p)))


def _x(pattern: str, group: int = 0, flags: str = "") -> str:
    """All matches of a pattern that may be bound to line starts and ends."""
    return f"regexp_extract_all(content, {S.lit(S.re2_lines(pattern, flags))}, {group})"


def _long(kind: str, values: str, where: str) -> str:
    return (f"SELECT path, '{kind}' AS kind, v AS value FROM (SELECT path, unnest({values}) AS v "
            f"FROM code WHERE {where})")


def _fact(spark, sf, kind: str, languages: list[str], like: str | None = None) -> DataFrame:
    rows = all_facts(spark, sf).where((F.col("kind") == kind) & F.col("language").isin(languages))
    if like:
        rows = rows.where(F.col("value").rlike(like))
    return rows.select("path", "kind", "value")


_JS = ["typescript", "javascript"]


@register(_long("keyConcepts", f"CASE WHEN len({_x(js.TYPE)}) > 0 THEN ['Types: ' || array_to_string(list_transform("
                f"list_zip({_x(js.TYPE, 1)}, {_x(js.TYPE, 2)})[:8], lambda t: '`' || t[1] || '`' || "
                "CASE WHEN coalesce(t[2], '') <> '' THEN ' extends `' || t[2] || '`' ELSE '' END), ', ')] ELSE [] END",
                _SCRIPTS), "code")
def fact_types(spark, sf):
    return _fact(spark, sf, "keyConcepts", _JS, "^Types: ")


@register(_long("keyConcepts", f"list_transform(list_zip({_x(js.ENUM, 1)}, {_x(js.ENUM, 2)}), lambda e: '`' || e[1] "
                "|| '` enum: ' || array_to_string(list_filter(list_transform(string_split(e[2], ','), "
                f"lambda v: {S.trim('split_part(' + S.trim('v') + chr(44) + chr(39) + '=' + chr(39) + ', 1)')}), "
                "lambda v: v <> '')[:10], ', '))", _SCRIPTS), "code")
def fact_enums(spark, sf):
    return _fact(spark, sf, "keyConcepts", _JS, "` enum: ")


@register(_long("errorHandling", f"CASE WHEN len({_x(chr(92) + '?' + chr(92) + '.')}) > 3 THEN "
                "['Uses optional chaining for null safety'] ELSE [] END || "
                f"list_transform({_x(js.CUSTOM_ERROR, 1)}, lambda n: 'Defines custom error: `' || n || '`')",
                _SCRIPTS), "code")
def fact_errors(spark, sf):
    return _fact(spark, sf, "errorHandling", _JS, "^(Uses|Defines) ")


def _design_sql() -> str:
    cases = []
    for name, tests in js.DESIGN_PATTERNS:
        cond = " AND ".join(f"regexp_matches(content, {S.lit(S.re2(p, f))})" for p, f in tests)
        cases.append(f"CASE WHEN {cond} THEN {S.lit(name)} END")
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


@register(_long("patterns", _design_sql(), _SCRIPTS), "code")
def fact_patterns(spark, sf):
    return _fact(spark, sf, "patterns", _JS)


@register(_long("constraints", f"""CASE WHEN len({_x(js.ASSERTION)}) > 0 THEN
  ['Contains ' || len({_x(js.ASSERTION)}) || ' assertion(s) for validation'] ELSE [] END
  || list_transform({_x(js.TYPE_GUARD)}, lambda g: 'Type guard: ' || regexp_replace(g, '[{S.WS}]+', ' ', 'g'))
  || CASE WHEN regexp_matches(content, {S.lit(S.re2(js.VALIDATION))}) AND len({_x(js.TYPEOF)}) > 0 THEN
  ['Runtime type validation: ' || array_to_string({_x(js.TYPEOF)}[:5], ', ')] ELSE [] END""", _SCRIPTS), "code")
def fact_constraints(spark, sf):
    return _fact(spark, sf, "constraints", _JS)


@register(_long("keyConcepts", f"list_transform(list_zip({_x(py.CLASS, 1)}, {_x(py.CLASS, 2)}), lambda c: '`' || c[1] "
                "|| '`' || CASE WHEN coalesce(c[2], '') <> '' THEN ' inherits from `' || c[2] || '`' ELSE '' END)",
                _PYTHON)
          + " UNION ALL " + _long("dependencyPurposes", f"list_transform({_x(py.IMPORT, 2, 'm')}, "
                                  "lambda m: '`' || m || '`')", _PYTHON)
          + " UNION ALL " + _long("patterns", "list_filter([" + ", ".join(
              f"CASE WHEN list_has_any({_x(py.DECORATOR, 1)}, [{', '.join(map(S.lit, ns))}]) THEN {S.lit(label)} END"
              for label, ns in py.DECORATOR_PATTERNS) + "], lambda x: x IS NOT NULL)", _PYTHON), "code")
def fact_python(spark, sf):
    rows = all_facts(spark, sf).where("language = 'python'")
    return rows.where(F.col("kind").isin("keyConcepts", "dependencyPurposes", "patterns")).select(
        "path", "kind", "value")


@register(f"""SELECT path, purpose, configuration FROM (SELECT path, k, 'YAML configuration covering: '
    || array_to_string(k[:10], ', ') || '.' AS purpose,
    array_to_string(list_transform(k[:15], lambda x: '`' || x || '`'), ', ') AS configuration
  FROM (SELECT path, {_x('^(' + chr(92) + 'w[' + chr(92) + 'w-]*):', 2, 'm')} AS k FROM code WHERE ext IN ('.yaml', '.yml')))
  WHERE len(k) > 0""", "code")
def fact_yaml(spark, sf):
    return _purpose_and_configuration(spark, sf, "yaml")


@register(f"""SELECT path, purpose, configuration FROM (SELECT path, k, 'TOML configuration with sections: '
    || array_to_string(k, ', ') || '.' AS purpose,
    array_to_string(list_transform(k, lambda x: '`' || x || '`'), ', ') AS configuration
  FROM (SELECT path, list_transform({_x('^' + chr(92) + '[([^' + chr(92) + ']]+)' + chr(92) + ']', 2, 'm')},
    lambda s: '[' || s || ']') AS k FROM code WHERE ext = '.toml')) WHERE len(k) > 0""", "code")
def fact_toml(spark, sf):
    return _purpose_and_configuration(spark, sf, "toml")


def _purpose_and_configuration(spark, sf, language):
    rows = all_facts(spark, sf).where(F.col("language") == language)
    configuration = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(
        F.col("kind") == "configuration", F.struct("ord", "value")))), lambda x: x.value), ", ")
    return rows.groupBy("path").agg(  # a file's own facts
        F.max(F.when(F.col("kind") == "purpose", F.col("value"))).alias("purpose"),
        configuration.alias("configuration"))


_MD_HEADS = _x(md.HEADING.replace("$", ""), 2, "m")


@register(f"""SELECT path, array_to_string(list_filter(list_transform({_MD_HEADS}, lambda h: {S.trim('h')}),
    lambda h: length(h) > 2)[:15], '|') AS headings, split_part({S.trim("regexp_extract(" + S.trim("substr(content, strpos(content, t) + length(t))") + ", '^((?s:.*?))(?:" + chr(92) + "n[" + S.WS + "]*" + chr(92) + "n|$)', 1)")}, '.', 1) || '.' AS purpose
  FROM (SELECT *, regexp_extract(content, '# [^{S.EOL}]+') AS t FROM code WHERE ext = '.md')""", "code")
def fact_markdown(spark, sf):
    rows = all_facts(spark, sf).where("language = 'markdown'")
    headings = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(
        F.col("kind") == "keyConcepts", F.struct("ord", "value")))), lambda x: x.value), "|")
    return rows.groupBy("path").agg(  # a file's own facts
        headings.alias("headings"),
        F.max(F.when(F.col("kind") == "purpose", F.col("value"))).alias("purpose"))


def _each(of: dict[str, str], rest: str) -> str:
    """Rows ``path, language, kind, ord, value`` of one list of values for each kind."""
    return " UNION ALL ".join(
        f"SELECT path, language, kind, ord, value FROM (SELECT path, language, '{kind}' AS kind, "
        f"unnest(v) AS value, CAST(generate_subscripts(v, 1) - 1 AS INT) AS ord "
        f"FROM (SELECT *, {values} AS v FROM {rest}))" for kind, values in of.items())


# What the planted scripts hold; the prose around them must add nothing to it.
@register(_each({
    "keyConcepts": "['Types: `Item' || doc_id || '` extends `Base`, `Pair`', '`Item' || doc_id || "
                   "'` defines: id, size?', '`Pair` defines: a', '`Kind` enum: One, Two, Three', "
                   "'`Store' || doc_id || '` extends `Base` implements `I`']",
    "apiSurface": "['`run' || doc_id || '(x, y, z, ...)` → the result', '`f(p, q)`', "
                  "'`Store' || doc_id || '.load(id)`', '`Store' || doc_id || '.if(id)`']",
    "errorHandling": "['logs errors, re-throws', 'Uses optional chaining for null safety', "
                     "'Defines custom error: `Bad' || doc_id || '`']",
    "configuration": "['`APP_CONFIG`: depth, name, list']",
}, "(SELECT *, 'typescript' AS language FROM code WHERE ext = '.ts')"), "code")
def fact_braces(spark, sf):
    return all_facts(spark, sf).where(F.col("language").isin(_JS) & F.col("kind").isin(
        "apiSurface", "configuration", "errorHandling", "keyConcepts"))


_DEEP = ["repeat('{', 1 + doc_id % 300)", "repeat('}', 1 + doc_id % 300)"]
VIEWS["deep_files"] = ("documents", {
    "doc_id": "doc_id", "path": "concat(source, '/deep', doc_id, '.ts')",
    "content": "concat('/** Doc. */', chr(10), 'class Store', doc_id, ' {', chr(10), 'first(a) ', "
    "{0}, ' deep(z) {{ }} ', {1}, chr(10), 'second(b) {{ }}', chr(10), '}}', chr(10), "
    "'interface Item', doc_id, ' {{ id: string; nested ', {0}, {1}, ' size?: number }}', chr(10), "
    "'try {{ }} catch (e) {{ if (x) ', {0}, {1}, ' console.log(e); throw e }}', chr(10), "
    "'const APP_CONFIG = {{ one: 1, two ', {0}, {1}, ', three: 3 }}', chr(10), text)"
    .replace("' {',", "' {{',").format(*_DEEP)}, "true")
S.CTES["deep"] = ([], f"deep AS ({view_sql('deep_files')})")


# Blocks nested 1 to 300 deep in all that braces enclose.
@register(_each({
    "keyConcepts": "['Types: `Item' || doc_id || '`', '`Item' || doc_id || '` defines: id, size?', "
                   "'`Store' || doc_id || '`']",
    "apiSurface": "['`Store' || doc_id || '.first(a)`', '`Store' || doc_id || '.deep(z)`', "
                  "'`Store' || doc_id || '.second(b)`']",
    "errorHandling": "['logs errors, re-throws']", "configuration": "['`APP_CONFIG`: one, three']",
}, "(SELECT *, 'typescript' AS language FROM deep)"), "deep")
def fact_deep_braces(spark, sf):
    found = facts.extract_facts(view(spark, sf, "deep_files").select("path", "content"))
    return found.where(F.col("kind").isin("apiSurface", "configuration", "errorHandling",
                                          "keyConcepts"))


def _rows(language: str, ext: str, of: dict[str, str]) -> str:
    return _each(of, f"(SELECT *, '{language}' AS language FROM code WHERE ext = '{ext}')")


# All other facts of the planted files, stated as they must come out.
@register(" UNION ALL ".join([
    _rows("typescript", ".ts", {
        "purpose": "['Store of things.']",
        "responsibilities": "['Service ' || doc_id || ' does its work (via `run' || doc_id || '`)', "
                            "'Store of things']",
        "dataFlow": "['input value']",
        "dependencyPurposes": "['`lib' || doc_id || '` → a, c', '`other` → def']"}),
    _rows("javascript", ".js", {
        "purpose": "['Script ' || doc_id || ' reads input and writes output']",
        "patterns": "['Generator/Iterator pattern']"}),
    _rows("python", ".py", {
        "purpose": "['Module ' || doc_id || ' loads things.']",
        "responsibilities": "['Run it now. (via `run`)']", "apiSurface": "['`run(self, a, b)`']",
        "dependencyPurposes": "['`os.path`', '`sys`']",
        "errorHandling": "['Handles/raises: `ValueError`, `KeyError`']",
        "keyConcepts": "['`Foo' || doc_id || '` inherits from `Bar, Baz`']",
        "patterns": "['Data classes', 'Class/static methods']"}),
    _rows("markdown", ".md", {
        "purpose": "['Opening paragraph of the guide.']",
        "keyConcepts": "['Guide ' || doc_id, 'Use of it']",
        "patterns": "['Code examples in: python, sh']"}),
    _rows("go", ".go", {"purpose": "['Package f' || doc_id || ' does things.']"}),
]), "code")
def fact_stated(spark, sf):
    rows = all_facts(spark, sf)
    kind, lang = F.col("kind"), F.col("language")
    return rows.where(
        lang.isin("python", "markdown", "go")
        | ((lang == "typescript") & kind.isin("purpose", "responsibilities", "dataFlow",
                                              "dependencyPurposes"))
        | ((lang == "javascript") & kind.isin("purpose", "patterns")))


S.CTES["json_files"] = ([], """json_files AS (SELECT doc_id % 3 AS f, source, lang, quality, 'json' AS language,
  source || '/' || doc_id || '/' || ['package.json', 'tsconfig.json', 'data.json'][doc_id % 3 + 1] AS path
  FROM documents LEFT JOIN labels USING (doc_id))""")


@register(_each({
    "purpose": "[CASE f WHEN 0 THEN 'Node.js package manifest for `' || source || '` (v1.2.0).' "
               "WHEN 1 THEN 'TypeScript compiler configuration.' ELSE 'Configuration file with keys: "
               "name, version, scripts, compilerOptions, include, text, n_chars' || "
               "CASE WHEN quality IS NULL THEN '.' ELSE ', quality.' END END]",
    "configuration": "CASE f WHEN 0 THEN ['Scripts: `build`: ' || lang || ', `a1`: b'] "
                     "WHEN 1 THEN ['Compiler options: strict: true', 'Includes: ' || lang] "
                     "ELSE ['`name`: string', '`version`: string', '`scripts`: object', "
                     "'`compilerOptions`: object', '`include`: array (1 items)', '`text`: string', "
                     "'`n_chars`: number'] || CASE WHEN quality IS NULL THEN [] ELSE "
                     "['`quality`: number'] END END",
}, "json_files"), "json_files")
def fact_json(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    name = F.element_at(F.array(F.lit("package.json"), F.lit("tsconfig.json"), F.lit("data.json")),
                        (F.col("doc_id") % 3 + 1).cast("int"))
    body = F.to_json(F.struct(
        F.col("source").alias("name"), F.lit("1.2.0").alias("version"),
        F.struct(F.col("lang").alias("build"), F.lit("b").alias("a1")).alias("scripts"),
        F.struct(F.lit(True).alias("strict")).alias("compilerOptions"),
        F.array("lang").alias("include"), "text", "n_chars", "quality"))
    files_ = docs.select(F.concat_ws("/", "source", F.col("doc_id").cast("string"), name)
                         .alias("path"), body.alias("content"))
    return facts.extract_facts(files_)


# Merging is checked on facts that both engines derive from the given texts: words as values.
_MEMBERS = {"group_id": "source", "path": "concat(lang, '/', lpad(CAST(doc_id AS STRING), 9, '0'))",
            "kind": _CAT.replace("'architecture'", "'purpose'").replace("'module'", "'apiSurface'")
            .replace("'api'", "'responsibilities'").replace("'config'", "'keyConcepts'")
            .replace("'data-model'", "'dataFlow'").replace("'testing'", "'patterns'")
            .replace("'build'", "'errorHandling'").replace("'documentation'", "'dependencyPurposes'")
            .replace("'scripts'", "'configuration'").replace("'styles'", "'constraints'")
            .replace("'infrastructure'", "'responsibilities'").replace("'general'", "'apiSurface'")
            .replace("'made-up'", "'responsibilities'"),
            "text": "text"}
VIEWS["word_facts"] = ("documents", _MEMBERS, "true")
_CAPS = "CASE kind WHEN 'purpose' THEN 1 " + " ".join(
    f"WHEN '{k}' THEN {n}" for k, n in K.FACT_CAPS.items()) + " END"
S.CTES["merged"] = ([], f"""words AS (SELECT group_id, path, kind, unnest(w) AS value, generate_subscripts(w, 1) - 1 AS ord
  FROM (SELECT * EXCLUDE (text), string_split(text, ' ') AS w FROM ({view_sql('word_facts')}))),
firsts AS (SELECT group_id, kind, value, min(path || ' ' || lpad(CAST(ord AS VARCHAR), 9, '0')) AS pos
  FROM words GROUP BY group_id, kind, value),
merged AS (SELECT group_id, kind, value, row_number() OVER (PARTITION BY group_id, kind ORDER BY pos) AS rank
  FROM firsts QUALIFY rank <= {_CAPS})""")


def merged(spark, sf) -> DataFrame:
    rows = view(spark, sf, "word_facts")
    found = rows.select("path", "kind", F.posexplode(F.split("text", " ")).alias("ord", "value"))
    return merge.merge_facts(found, rows.select("group_id", "path"))


@register("SELECT group_id, kind, rank, value FROM merged", "merged")
def merge_facts(spark, sf):
    return merged(spark, sf).withColumn("rank", F.col("rank").cast("long"))


@register("""SELECT g.group_id, coalesce(
    CASE WHEN length(p) > 150 THEN substr(p, 1, 147) || '...' ELSE p END,
    CASE WHEN length(r) > 150 THEN substr(r, 1, 147) || '...' ELSE r END,
    'Exposes: ' || apis, 'general module') AS description
  FROM (SELECT DISTINCT source AS group_id FROM documents) g LEFT JOIN (SELECT group_id,
    max(value) FILTER (kind = 'purpose' AND rank = 1) AS p,
    max(value) FILTER (kind = 'responsibilities' AND rank = 1) AS r,
    string_agg(value, ', ' ORDER BY rank) FILTER (kind = 'apiSurface' AND rank <= 3) AS apis
    FROM merged GROUP BY group_id) m ON m.group_id = g.group_id""", "merged")
def describe(spark, sf):
    groups = table(spark, sf, "documents").select(
        F.col("source").alias("group_id"), F.lit("general").alias("category")).distinct()
    return merge.describe(merged(spark, sf), groups)


# --- plans of a model ------------------------------------------------------------------------

def model_replies(spark, sf) -> DataFrame:
    """Documents as replies of a model that planned one entry for each."""
    plan = F.to_json(F.struct(
        F.concat(F.lit("plan_"), "doc_id", F.lit(".md")).alias("filename"),
        F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("title"),
        F.array(F.concat("source", F.lit("/"), "lang"), F.lit("b.ts")).alias("sourceFiles"),
        F.col("text").alias("brief")))
    array = F.concat(F.lit("["), plan, F.lit("]"))
    reply = (F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("```json\n"), array, F.lit("\n```")))
             .when(F.col("doc_id") % 5 == 1, F.concat("lang", F.lit(": "), array, F.lit(" done")))
             .when(F.col("doc_id") % 5 == 2, F.col("text"))
             .when(F.col("doc_id") % 5 == 3, plan).otherwise(array))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("response_id"),
                                                reply.alias("text"))


S.CTES["replied"] = ([], """replied AS (SELECT doc_id AS response_id, CAST(0 AS INT) AS pos,
  'plan_' || doc_id || '.md' AS filename, CASE WHEN doc_id % 3 > 0 THEN source
  ELSE 'plan_' || doc_id || '.md' END AS title, 'general' AS category,
  source || '/' || lang || '|b.ts' AS source_files, text AS brief
  FROM documents WHERE doc_id % 5 IN (0, 1, 4))""")


@register("SELECT * FROM replied", "replied")
def parse_plans(spark, sf):
    return model.parse_plans(model_replies(spark, sf)).withColumn(
        "source_files", F.array_join("source_files", "|"))


@register(f"SELECT filename, title, CASE WHEN brief = '' THEN 'general — 2 files' ELSE brief END AS "
          f"description, category, '{AS_OF}' AS updated_at, CAST(2 AS BIGINT) AS n_sources FROM replied",
          "replied")
def choose_plans(spark, sf):
    planned = model.plans_from_rows(model.parse_plans(model_replies(spark, sf)))
    chosen = model.choose_plans(planned, directory.plan_by_directory(files(spark, sf)))
    return assemble.assemble_entries(assemble.resolve_collisions(chosen), AS_OF).entries


# --- streaming -------------------------------------------------------------------------------

S.CTES["next_plan"] = (["prev", "now"], """next_files AS (SELECT path FROM now UNION ALL
  SELECT path FROM prev WHERE path NOT IN (SELECT path FROM now_walked)),
""" + S.planned("next_files", "next_plan"))


@register(f"SELECT filename, CASE WHEN dir = '.' THEN 'root' ELSE dir END AS title, 'Files in ' || dir AS "
          f"description, 'module' AS category, '{AS_OF}' AS updated_at, n_sources FROM next_plan",
          "next_plan")
def stream_refresh(spark, sf):
    """The two snapshots arrive one after the other; the entries after the second."""
    import time

    def write(path: str) -> None:
        for name in ("prev", "now"):
            arrived = snapshot(spark, sf, name).withColumn(
                "modified", F.timestamp_seconds(F.lit(time.time())))
            arrived.write.mode("append").parquet(f"{path}/in")
            stream = spark.readStream.schema(arrived.schema).parquet(f"{path}/in")
            refresh.stream_refresh(stream, f"{path}/kb", f"{path}/checkpoint",
                                   lambda batch: AS_OF).awaitTermination()

    store = refresh.KbStore(spark, written(spark, sf, "stream", write) + "/kb")
    return store.kb(store.latest()).entries
