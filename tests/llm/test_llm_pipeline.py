"""The pipeline on planted documents: each stage's decisions take effect, clean documents stay."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tomewright.llm import bpe, jaccard
from tests.llm.helpers import alnum, odd_documents


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(6)
    stems = "ba ke li mo nu ra se ti vo zu".split()

    def words(n):
        return ["".join(rng.choice(stems) for _ in range(rng.randint(2, 4))) for _ in range(n)]

    items = [(i, " ".join(words(30))) for i in range(5)]
    docs, labels, kind = [], [], {}
    for i in range(320):
        text = words(rng.randint(40, 80))
        if i % 4 == 1:
            text.insert(rng.randrange(len(text)), "scumbagger" + rng.choice(["", "s", "ing"]))
            kind[i] = "toxic"
        elif i % 16 == 0:
            a = rng.randint(0, 10)
            text[10:10] = items[i % 5][1].split()[a:a + 15]
            kind[i] = "leak"
        elif i % 16 == 2:
            text[5:5] = ["mail", f"person{i}@mail.example.com", "or", f"10.20.30.{i % 250}"]
            kind[i] = "private"
        docs.append((i, " ".join(text)))
        labels.append((i, int(kind.get(i) == "toxic")))
        if i % 16 in (3, 10):
            text[rng.randrange(len(text))] = "changed"
            docs.append((10_000 + i, " ".join(text)))
            kind[10_000 + i] = "copy"
    docs += [(20_000 + (i or 99), t) for i, t in odd_documents()[:5]] + [(None, "no id at all")]
    path = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame(
        [(i, t, "en", "s", len(t or ""), 1.5) for i, t in docs],
        "doc_id long, text string, lang string, source string, n_chars long, score double"
    ).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(
        f"{path}/benchmark.parquet")
    return path, dict(docs), kind


def test_pipeline(spark, planted, monkeypatch):
    monkeypatch.setattr(jaccard, "CELLS", 1 << 12)
    monkeypatch.setattr(jaccard, "FILTER_BITS", 1 << 16)
    path, docs, kind = planted
    rows = corpus_pipeline.run(spark, path).collect()
    got = {r.doc_id: r for r in rows}
    assert len(got) == len(rows)
    gone = {k for k in docs if k not in got}
    expected = {k for k, v in kind.items() if v in ("toxic", "copy", "leak")}
    assert {k for k in expected if kind[k] != "toxic"} <= gone
    assert len({k for k in expected if kind[k] == "toxic"} - gone) <= 4
    # Of the odd documents equal ones are copies; an empty text is none.
    wrong = {k for k in gone - expected if k is not None and k < 10_000}
    assert len(wrong) <= 6 and None in got
    for k, r in got.items():
        assert r.score == 1.5 and r.n_tokens == len(r.ids)
        if kind.get(k) == "private":
            assert alnum(docs[k])[0] == alnum(r.text)[0] and f"person{k}@" not in r.text
            assert r.text.count("@") == 1 and r.n_chars == len(r.text)
        elif docs[k] is not None:
            assert r.text == docs[k]


def test_stage_columns(spark, planted):
    """Columns with names that operators use come through; an empty table passes."""
    path, _, _ = planted
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name in ("predicted", "row_key", "ids", "hits", "component_id", "label"):
        docs = docs.selectExpr("*", f"'kept' AS {name}")
    for name, stage in corpus_pipeline.STAGES[:4]:
        done = stage(spark, docs, path)
        assert done.columns == docs.columns, name
        assert {r.row_key for r in done.collect()} == {"kept"}, name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), path).collect() == [], name
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "ngram_jaccard_join", "benchmark_decontamination", "pii", "byte_level_bpe"]


def test_unique_texts_stay_whatever_their_ids(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CELLS", 1 << 12)
    monkeypatch.setattr(jaccard, "FILTER_BITS", 1 << 16)
    a, b, c, d = (" ".join(f"{w}{k}" for k in range(30)) for w in "abcd")
    rows = [(1, a), (1, b), (2, a), (None, c), (None, c), (None, d), (3, d), (4, ""), (4, ""),
            (5, None), (None, None), (6, b + " more"), (7, "lone"), (7, "lone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    done = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(map(tuple, done), key=str) == sorted(
        [(1, a), (1, b), (None, c), (3, d), (4, ""), (4, ""), (5, None), (None, None), (7, "lone")],
        key=str)


@pytest.mark.parametrize("before, after", [("10000", 1000), ("0", 1000), ("300", 300)])
def test_stages_hand_python_few_rows_at_once(spark, planted, before, after):
    path, _, _ = planted
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    try:
        for stage in ("encode_tokens", "drop_contaminated"):
            spark.conf.set(name, before)
            docs = spark.read.parquet(f"{path}/documents.parquet")
            getattr(corpus_pipeline, stage)(spark, docs, path)
            assert int(spark.conf.get(name)) == after
    finally:
        spark.conf.set(name, old)


def test_texts_are_encoded_in_small_blocks():
    vocabulary = bpe.Vocabulary.build({bytes([b]): b for b in range(256)}, bpe.tiktoken_classes())
    texts = ["word " * 20_000] * 6
    found = list(bpe.Encoder(vocabulary).column(pa.array(texts)))
    assert [(at, to) for at, to, *_ in found] == [(0, 2), (2, 4), (4, 6)]
    for _, _, ids, first in found:
        assert first.tolist() == [0, 100_000, 200_000] and bytes(ids.astype(np.uint8)) == (
            "".join(texts[:2]).encode())
