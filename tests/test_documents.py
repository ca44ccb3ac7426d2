import random
import shutil

import pytest
from pyspark.sql import functions as F

from tomewright.config import KbConfig
from tomewright.operators import (changes, documents, gather, index, ordering, query, query_batch,
                                   segments)
from tomewright.operators.tables import KnowledgeBase, read_kb, write_kb
from tomewright.plans import assemble, directory, model
from tomewright.sources import files as sources

AS_OF = "2025-01-01T00:00:00.000Z"
VALID = "\n".join([
    "---", 'title: "My Module"', 'description: "A test module"', "category: module", "tags:",
    "  - typescript", "  - module", "related:", "  - ./src/utils.md",
    'updatedAt: "2025-01-01T00:00:00.000Z"', "sourceFiles:", "  - src/index.ts", "---", "",
    "## Overview", "", "This is the content."])


def small_kb(spark, n=40):
    rows = [(f"{'src/api' if i % 3 else 'src'}/f{i:03}.{'ts' if i % 2 else 'py'}", f"line\n{i}")
            for i in range(n)] + [("top.md", "# hi"), ("src_api/x.go", ""), ("src/a---b/y.c", "1")]
    files = sources.prepare_files(sources.files_from_table(
        spark.createDataFrame(rows, "path string, content string")))
    plans = assemble.resolve_collisions(directory.plan_by_directory(files))
    return assemble.assemble_entries(plans, AS_OF)


@pytest.fixture(scope="module")
def kb(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("kb"))
    write_kb(small_kb(spark), path + "/kb")
    return read_kb(spark, path + "/kb")


def stored(spark, kb, path, **options):
    documents.write_stored(documents.read_back(kb, AS_OF, **options), path)
    return documents.read_stored(spark, path)


def test_parse(spark):
    docs = spark.createDataFrame([
        ("test.md", VALID), ("plain.md", "Just text."), ("broken.md", "---\ntitle: test\nNo closing"),
        ("index.md", VALID)], "filename string, document string")
    rows = documents.load_entries(documents.list_entries(docs), AS_OF).collect()
    assert [r.filename for r in rows] == ["test.md"]
    r = rows[0]
    assert (r.title, r.category, r.tags) == ("My Module", "module", ["typescript", "module"])
    assert (r.related, r.source_files) == (["./src/utils.md"], ["src/index.ts"])
    assert "This is the content." in r.content


def test_round_trip(spark, kb):
    rows = {r.filename: r for r in documents.read_back(kb, AS_OF).rows.collect()}
    # The directory whose plan comes last took the name both wanted.
    assert rows["src_api.md"].source_files == ["src_api/x.go"]
    assert "`src_api/x.go` (? lines)" in rows["src_api.md"].content
    assert rows["src.md"].tags == ["module", "py", "ts"]
    assert rows["src.md"].related == rows["src.md"].source_files  # an empty list reads on
    assert rows["..md"].title == "root"
    # A header ends at the first "---", even inside a title.
    cut = rows["src_a---b.md"]
    assert cut.title == '"src/a' and cut.source_files == []


def test_large_entries_give_the_same_answers(spark, kb, tmp_path):
    whole = stored(spark, kb, str(tmp_path / "whole"))
    split = stored(spark, kb, str(tmp_path / "split"), max_chars=400)
    assert split.large is not None and split.rows.count() < whole.rows.count()
    asked = [("src", None), ("TS", "module"), ("", None), ("zzz", "api"),
             ("lines)\n- `src/f003", None)]
    single = []
    for i, (q, c) in enumerate(asked):
        a, b = (query.kb_query(k, q, c).collect() for k in (whole, split))
        assert a == b, (q, c)
        single += [(i, n + 1, r.filename, r.score) for n, r in enumerate(a)]
    table = spark.createDataFrame([(i, q, c) for i, (q, c) in enumerate(asked)],
                                  "query_id int, query string, category string")
    for k in (whole, split):
        got = query_batch.kb_query_batch(k, table)
        assert sorted(map(tuple, got.collect())) == sorted(single)
    hits = query.kb_query(split, "src")
    shown = {r.filename: r.rendered for r in query.render_hits(split, hits).collect()}
    want = {r.filename: r.rendered for r in
            query.render_hits(whole, query.kb_query(whole, "src")).collect()}
    assert {k: v.strip() for k, v in shown.items()} == {k: v.strip() for k, v in want.items()}


def test_written_documents_read_back(spark, kb, tmp_path):
    documents.write_documents(kb, str(tmp_path / "docs"))
    got = documents.read_written(spark, str(tmp_path / "docs"))
    want = {r.filename: r.document for r in documents.render_documents(kb).collect()}
    assert {r.filename: r.document for r in got.collect()} == want
    back = documents.load_written(spark, str(tmp_path / "docs"), AS_OF)
    assert back.large is None
    assert sorted(back.rows.collect()) == sorted(documents.read_back(kb, AS_OF).rows.collect())


def same_entries(whole, split):
    """Entries as rows, and as tables, hold the same."""
    held = {r.filename: r for r in whole.collect()}
    entries = split.entries.collect()
    assert {r.filename for r in entries} == set(held)
    for r in entries:
        want = held[r.filename]
        assert (r.title, r.description, r.category, r.updated_at, r.n_sources) == (
            want.title, want.description, want.category, want.updated_at,
            len(want.source_files)), r.filename
        for name, column in (("tags", "tags"), ("related", "related"),
                             ("sources", "source_files")):
            rows = getattr(split, name).where(F.col("filename") == r.filename)
            assert [x.value for x in rows.orderBy("at").collect()] == want[column], (
                r.filename, name)
        body = split.body.where(F.col("filename") == r.filename).orderBy("part", "pos", "key")
        assert "".join(x.text for x in body.collect()) == want.content, r.filename


@pytest.mark.parametrize("max_pieces", [1, 2, 5, 4096])
def test_odd_documents_in_blocks(spark, monkeypatch, max_pieces):
    """Headers with all that the grammar trips over, cut anywhere."""
    items = "".join(f"  - v{k}\n" for k in range(12))
    docs = {
        "valid.md": VALID, "none.md": "no header\n" + items, "open.md": "---\ntitle: x\n" + items,
        "runs.md": f"---\ntitle: \"a\"\ntags:\n{items}related:\nsourceFiles:\n{items}---\n\n body \n",
        "next.md": f"---\ntags:\nrelated:\nsourceFiles:\n{items}---x",
        "value.md": f"---\ndescription:\n{items}title:\n{items}tags: z\n{items}---\n\n\n",
        "names.md": f"---\n{items}  - has tags: in it\n{items}related:\n{items}---\nb",
        "quotes.md": f'---\ntitle: "opens\n{items}  - closes"\n{items}tags:\n{items}---\nb',
        "dashes.md": f"---\ntags:\n{items}  - a---b\n{items}---\nb",
        "tight.md": f"---tags:\n{items}---", "blank.md": f"---\n\n\n  title: t\n\n{items}\n---\n \n",
        "mixed.md": f"---\ntags:\n{items}\n{items}x\n\t- tab\n- bare\n -no\n{items}---\n" + "b\n" * 50,
        "cr.md": "---\r\ntags:\r\n" + items.replace("\n", "\r\n") + "---\r\nb\r\n",
        "lone-cr.md": f"---\ntags:\n{items}  - q\rtitle: x\n{items}---\nb"}
    rng = random.Random(max_pieces)
    rows = []
    for name, doc in docs.items():
        at = 0
        while at < len(doc):
            n = rng.randint(1, 9)
            rows.append((name, len(rows), doc[at:at + n]))
            at += n
    monkeypatch.setattr(segments, "BLOCK_PIECES", max_pieces)
    pieces = spark.createDataFrame(rows, "filename string, at int, text string")
    blocks = segments.blocks(pieces, "filename", ["at"]).withColumnRenamed("text", "document")
    whole = documents.load_entries(spark.createDataFrame(
        list(docs.items()), "filename string, document string"), AS_OF)
    same_entries(whole, documents.load_blocks(blocks, AS_OF))


def test_an_entry_of_many_sources_reads_back(spark, tmp_path):
    n = 300_000
    names = spark.range(n).select(F.lit("big.md").alias("filename"), F.struct(
        F.lit(0).cast("long").alias("part"), F.col("id").alias("pos"), F.lit("").alias("key"))
        .alias("at"), F.concat(F.lit("src/dir/file"), F.col("id"), F.lit(".ts")).alias("value"))
    entry = spark.range(1).select(
        F.lit("big.md").alias("filename"), F.lit("t").alias("title"), F.lit("d").alias("description"),
        F.lit("module").alias("category"), F.lit(AS_OF).alias("updated_at"),
        F.lit(n).cast("long").alias("n_sources"))
    body = names.select("filename", F.lit(0).alias("part"), F.col("at.pos").alias("pos"),
                        F.lit("").alias("key"), F.concat("value", F.lit("\n")).alias("text"))
    kb = KnowledgeBase.of(entry, tags=names.where("at.pos < 3"), sources=names, body=body)
    documents.write_documents(kb, str(tmp_path / "docs"))
    for max_chars in (1_000, 3_000_000):
        back = documents.load_written(spark, str(tmp_path / "docs"), AS_OF, max_chars)
        assert back.rows.count() == 0
        row = back.large.entries.collect()[0]
        assert (row.filename, row.title, row.n_sources) == ("big.md", "t", n)
        for table in (back.large.sources, back.large.related):  # an empty list reads on
            got = [r.value for r in table.orderBy("at").collect()]
            assert got == [f"src/dir/file{k}.ts" for k in range(n)]
        assert [r.value for r in back.large.tags.orderBy("at").collect()] == [
            f"src/dir/file{k}.ts" for k in range(3)]
        text = "".join(r.text for r in back.large.body.orderBy("pos").collect())
        assert text == "\n".join(f"src/dir/file{k}.ts" for k in range(n))


def test_stored_parts_must_be_there(spark, kb, tmp_path):
    from pyspark.errors import AnalysisException

    stored(spark, kb, str(tmp_path / "split"), max_chars=400)
    shutil.rmtree(tmp_path / "split/large/tags")
    with pytest.raises(AnalysisException):
        documents.read_stored(spark, str(tmp_path / "split")).large.tags.collect()


KEY = ["-----BEGIN RSA PRIVATE KEY-----\n", "MIIEsecretsecret\n", "moresecret\n",
       "-----END RSA PRIVATE KEY-----\n"]


def odd_kb(spark):
    """Entries with all that reads back differently from how it was written."""
    rows = [("quotes.md", 'say "hi"', "plain", ["a", "b"], [], ["s/1.ts", "s/2.ts"], ["text\n"]),
            ("dashes.md", "src/a---b", "one", ["t"], ["r"], ["x.c"], ["body line\n"]),
            ("source.md", "title", "two", ["t1", "t2"], [], ["a.c", "src/p---q/y.c", "z.c"],
             ["end\n"]),
            ("empty.md", "nothing", "three", [], [], ["only.ts"], ["x\n", "password = hunter2\n"]),
            ("bare.md", "bare", "", [], [], [], ["y\n"]),
            ("tagged.md", "t", "tags: in here", ["u"], ["v"], ["w.py"], ["z\n"]),
            ("key.md", "holds a key", "four", ["k"], [], ["k.pem"],
             ["before\n", *KEY[:1], *["MIIEfiller\n"] * 9, *KEY[1:], "after\n", *KEY, "token\n"])]
    at = "struct<part:bigint,pos:bigint,key:string>"
    frame_ = spark.createDataFrame(
        rows, "filename string, title string, description string, tags array<string>, "
              "related array<string>, sources array<string>, body array<string>")

    def listed(name):
        return frame_.select("filename", F.posexplode(name).alias("pos", "value")).select(
            "filename", F.struct(F.lit(0).alias("part"), "pos", F.lit("").alias("key"))
            .cast(at).alias("at"), "value")

    body = frame_.select("filename", F.posexplode("body").alias("pos", "text")).select(
        "filename", F.lit(0).alias("part"), F.col("pos").cast("long").alias("pos"),
        F.lit("").alias("key"), "text")
    entries = frame_.select("filename", "title", "description", F.lit("module").alias("category"),
                            F.lit(AS_OF).alias("updated_at"),
                            F.size("sources").cast("long").alias("n_sources"))
    return KnowledgeBase.of(entries, tags=listed("tags"), related=listed("related"),
                            sources=listed("sources"), body=body)


def test_entries_of_every_size_read_back_alike(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK_PIECES", 3)
    write_kb(odd_kb(spark), str(tmp_path / "kb"))
    kb = read_kb(spark, str(tmp_path / "kb"))
    whole, split = stored(spark, kb, str(tmp_path / "whole")), stored(
        spark, kb, str(tmp_path / "split"), max_chars=1)
    assert split.rows.count() == 0 and whole.large is None
    same_entries(whole.rows, split.large)
    held = {r.filename: r for r in whole.rows.collect()}
    text = "".join(r.content for r in held.values())
    assert "secret" not in text and "filler" not in text and "hunter2" not in text
    assert held["key.md"].content.count("[REDACTED]") == 2
    for q, c in (("hi", None), ("src", "module"), ("k.pem", None), ("p---q", None), ("tags", None)):
        assert query.kb_query(whole, q, c).collect() == query.kb_query(split, q, c).collect(), q


def test_update_counts_manual_entries_as_stale(spark, kb):
    note = spark.createDataFrame([("note.md",)], "filename string").select(
        "filename", F.lit("n").alias("title"), F.lit("d").alias("description"),
        F.lit("general").alias("category"), F.lit(AS_OF).alias("updated_at"),
        F.lit(0).cast("long").alias("n_sources"))
    body = note.select("filename", F.lit(0).alias("part"), F.lit(0).cast("long").alias("pos"),
                       F.lit("").alias("key"), F.lit("text").alias("text"))
    kb = kb.plus(KnowledgeBase.of(note, body=body))
    found = spark.createDataFrame([("src/f003.ts", "changed")], "path string, status string")
    names = lambda **k: {r[0] for r in changes.stale_entries(kb, found, **k).collect()}
    assert names() == {"src.md", "note.md"}
    assert names(keep_manual=True) == {"src.md"}


def test_changes_of_a_corpus_with_itself(spark):
    files = sources.files_from_table(spark.createDataFrame(
        [("a.ts", "1"), ("b.py", "password=1"), (".env", "x"), ("node_modules/x.js", "y"),
         ("big.txt", "z" * 500_001)], "path string, content string"))
    seen = sources.fingerprints(files)
    prior = changes.file_state(sources.prepare_files(files))
    got = {tuple(r) for r in changes.detect_changes(seen, prior).collect()}
    assert got == {(".env", "added"), ("big.txt", "added")}
    assert changes.is_up_to_date(changes.detect_changes(seen, prior, exclude_dropped=True))
    rotated = sources.fingerprints(files.withColumn(
        "content", F.replace("content", F.lit("=1"), F.lit("=2"))))
    assert changes.is_up_to_date(changes.detect_changes(rotated, prior, exclude_dropped=True))


def test_folder_scan(spark, tmp_path):
    for name, data in {"a/x.ts": b"one\ntwo", "a b/y+z.py": b"\xff\xfe ok", ".env": b"S=1",
                       "node_modules/p/i.js": b"no", "x.min.js": b"no", "big.md": b"z" * 500_001,
                       "c/d.TXT": b""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path: r.content for r in sources.scan_corpus(spark, str(tmp_path)).collect()}
    assert got == {"a/x.ts": "one\ntwo", "a b/y+z.py": "�� ok", "big.md": None}
    got = {r.path: r.content for r in sources.walk_corpus(spark, str(tmp_path)).collect()}
    assert got == {"a/x.ts": "one\ntwo", "a b/y+z.py": "�� ok", ".env": None,
                   "big.md": None, "c/d.TXT": ""}
    only = sources.scan_corpus(spark, str(tmp_path), KbConfig(include_extensions=(".md",)))
    assert [r.path for r in only.collect()] == ["big.md"]


def test_plans_of_replies(spark):
    item = '{"filename":"a.md","sourceFiles":["x","y"],"description":"d"}'
    replies = [f"[{item}]", f"```json\n[{item}]\n```", f"Here: [{item}] ok", item, "none",
               '[{"filename":"","sourceFiles":[]},{"title":"t"},{"filename":"b.md","sourceFiles":"x"}]',
               f'so [{item},{{"filename":"b.md","sourceFiles":"x"}}]', f"[{item},null]",
               '[{"filename":"../up.md","sourceFiles":[],"title":"T","category":"api","brief":"b"}]']
    rows = model.parse_plans(spark.createDataFrame(list(enumerate(replies)),
                                                   "response_id int, text string"))
    got = {}
    for r in rows.collect():
        got.setdefault(r.response_id, []).append(
            (r.filename, r.title, r.category, r.source_files, r.brief))
    want = [("a.md", "a.md", "general", ["x", "y"], "d")]
    assert got == {0: want, 1: want, 2: want, 8: [("../up.md", "T", "api", [], "b")]}
    plans = model.plans_from_rows(rows)
    assert {r.filename for r in plans.plans.collect()} == {"a.md"}
    assert plans.sources.count() == 6


def test_index_document(spark):
    kb = small_kb(spark, 3)
    rows = index.index_pieces(kb, AS_OF).orderBy(*index.INDEX_ORDER).collect()
    assert "".join(r.text for r in rows) == f"""# Knowledge Base Index

> Auto-generated by **tomewright** — {AS_OF}

## Project Overview

This project has **4 knowledge base entries** covering **4 files** across 1 categories.

**Languages**: Go, C

**Modules**:
- **root**: Files in .
- **src**: Files in src
- **src/a---b**: Files in src/a---b
- **src_api**: Files in src_api

> 💡 Use `kb_query` to search entries by keyword, category, or tag. Each entry contains extracted knowledge about purpose, responsibilities, API surface, and more.

## Quick Navigation

### Modules

> Source code modules and their responsibilities

- [root](./..md) — Files in . (1 files)
- [src](./src.md) — Files in src (1 files)
- [src/a---b](./src_a---b.md) — Files in src/a---b (1 files)
- [src_api](./src_api.md) — Files in src_api (1 files)

## Tags

- `c`: [src_a---b.md](./src_a---b.md)
- `go`: [src_api.md](./src_api.md)
- `md`: [..md](./..md)
- `module`: [..md](./..md), [src.md](./src.md), [src_a---b.md](./src_a---b.md), [src_api.md](./src_api.md)
- `py`: [src.md](./src.md)
""".replace("Go, C", "C, Go")


def test_ordinals(spark):
    values = random.Random(1).sample(range(10_000), 3_000)
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    got = ordering.with_ordinal(df, "v").orderBy("ordinal").collect()
    assert [r.ordinal for r in got] == list(range(3_000))
    assert [r.v for r in got] == sorted(values)


def test_gather_splits_what_is_long(spark):
    rows = [("long", i, f"{i};") for i in range(9_000)] + [("short", i, f"{i},") for i in range(3)]
    df = spark.createDataFrame(rows, "k string, n int, text string").repartition(5)
    got = gather.gather_text(df, "k", ["n"], max_chars=1_000).orderBy("k", "block").collect()
    assert "".join(r.text for r in got if r.k == "long") == "".join(f"{i};" for i in range(9_000))
    assert len(got) > 2 and [r.text for r in got if r.k == "short"] == ["0,1,2,"]


def test_query_status(spark, kb):
    assert query.query_status(None) == "missing"
    assert query.query_status(kb, kb.entries.limit(2)) == "matched 2 of 4"
    none = kb.only(spark.createDataFrame([], "filename string"))
    assert query.query_status(none) == "empty"


def test_replies_with_odd_members(spark):
    replies = [
        ("u-2", '[{"filename": "b.md", "sourceFiles": ["x", null, {"a": 1}, 2, true, ["p", "q"]]}]'),
        ("u-1", '[{"filename": "a.md", "title": false, "category": 0, "brief": "", '
                '"description": "d", "sourceFiles": []}, {"filename": 7, "sourceFiles": ["y"]}]'),
        ("u-10", 'see [{"filename": "c.md", "sourceFiles": "s"}]'), ("u-3", "[null]"),
        ("u-4", '[{"filename": "", "sourceFiles": ["z"]}, {"filename": "d.md", '
                '"title": "false", "sourceFiles": ["{}"]}]')]
    parsed = model.parse_plans(spark.createDataFrame(replies, "response_id string, text string"))
    got = {(r.response_id, r.pos): (r.filename, r.title, r.category, r.source_files, r.brief)
           for r in parsed.collect()}
    assert got == {
        ("u-2", 0): ("b.md", "b.md", "general",
                     ["x", "null", "[object Object]", "2", "true", "p,q"], ""),
        ("u-1", 0): ("a.md", "a.md", "general", [], "d"), ("u-1", 1): ("7", "7", "general", ["y"], ""),
        ("u-4", 1): ("d.md", "false", "general", ["{}"], "")}
    plans = model.plans_from_rows(parsed).plans.orderBy("plan_order").collect()
    assert [p.plan_id for p in plans] == ["u-1#0", "u-1#1", "u-2#0", "u-4#1"]


def test_state_is_stored(spark, kb, tmp_path):
    files = spark.createDataFrame([("a", "h1"), ("b", "h2")], "path string, hash string")
    assert changes.read_state(spark, str(tmp_path / "none")) is None
    changes.write_state(files, kb.entries, AS_OF, str(tmp_path / "s"), "abc")
    state = changes.read_state(spark, str(tmp_path / "s"))
    assert sorted(map(tuple, state.files.collect())) == [("a", "h1"), ("b", "h2")]
    row = state.summary.first()
    assert (row.total_files, row.last_commit) == (2, "abc")
    assert row.categories == f'{{"module":{kb.entries.count()}}}'
