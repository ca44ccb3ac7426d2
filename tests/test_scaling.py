"""Work that must not be repeated or land in one place as tables grow."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from checks import queries, views
from tomewright.operators import grams
from tomewright.operators.facts import braces, config


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _rise(text: str) -> int:
    now = least = rise = 0
    for sign in text:
        now += (sign == "{") - (sign == "}")
        least = min(least, now)
        rise = max(rise, now - least)
    return rise


def test_depth_of_braces_is_tested_once_and_by_a_pattern(spark):
    """the test was a fold in each header's expression."""
    rows = spark.createDataFrame([("class A {}",)], "content string")
    plan = _plan(braces.with_brace_facts(rows, F.col("content"), "found"))
    assert "aggregate(" not in plan and plan.count(f"{braces._RISE})") == 1


def test_depth_of_braces_is_that_of_a_count(spark):
    dealt = random.Random(3)
    texts = ["".join("{x" if dealt.random() < p else "}" for _ in range(400))
             for p in (0.45, 0.52, 0.55, 0.6) for _ in range(50)]
    for n in (59, 60, 61, 62, 300):
        texts += ["{" * n + "}" * n, "}" * 9 + "{" * n, "{" * n + "}" * 30 + "{" * 31,
                  "{a{}}" * 50 + "{" * n]
    rows = spark.createDataFrame([*enumerate(["", *texts])], "n int, t string")
    for n, deep in rows.select("n", braces.is_deep(F.col("t"))).collect():
        assert deep == (_rise(["", *texts][n]) > braces.LEVELS), n


def test_pieces_keep_near_braces_and_write_far_ones_as_signs():
    far = braces._KEPT_LEVELS + 1
    text = "}{é" + "{" * far + "}" * far + "}\U0001f600"
    marked = braces._BEGIN + text[:1] + braces._END + text[1:]
    found = braces._taken_apart({"properties": marked, "methods": text})
    assert found["methods"] == []
    assert found["properties"] == [
        "}{é" + "{" * (far - 1) + braces._OPEN + braces._CLOSE + "}" * (far - 1) + "}"]


def test_views_are_dealt_without_a_sort(spark, tmp_path, monkeypatch):
    """dealt in turn, all texts were sorted and spilled before each write."""
    seen = []
    monkeypatch.setattr(views, "written", lambda spark, sf, name, write: seen.append(write) or str(
        tmp_path / "view"))
    spark.createDataFrame([(n, "t", "en", "src") for n in [1, 2, 2, None, None]],
                          "doc_id long, text string, lang string, source string").write.parquet(
        str(tmp_path / "documents.parquet"))
    plans = []
    monkeypatch.setattr(type(spark.range(1).write), "parquet", lambda self, path: plans.append(
        self._df._jdf.queryExecution().executedPlan().toString()))
    try:
        views.view(spark, str(tmp_path), "raw_docs")
    except Exception:  # nothing was written, so nothing can be read
        pass
    seen[0](str(tmp_path / "view"))
    assert "RoundRobin" not in plans[0] and "hashpartitioning(doc_id" in plans[0]


def test_files_of_the_run_before_are_read_back_without_their_text(spark, tmp_path):
    """each table of the stored knowledge base redacted all texts again."""
    spark.createDataFrame([(n, f"text {n}", "en", "src") for n in range(1, 30)],
                          "doc_id long, text string, lang string, source string").write.parquet(
        str(tmp_path / "documents.parquet"))
    sf = str(tmp_path)
    assert "content" not in queries.files_before(spark, sf).columns
    for df in (queries.prior_state(spark, sf), queries.files_before(spark, sf)):
        assert "regexp" not in _plan(df) and "sha2" not in _plan(df)


def test_streamed_snapshots_arrive_as_many_files(spark, tmp_path):
    """each snapshot was one file, which one task read."""
    spark.createDataFrame([(n, f"text {n}", "en", "src") for n in range(1, 60)],
                          "doc_id long, text string, lang string, source string").write.parquet(
        str(tmp_path / "documents.parquet"))
    queries.stream_refresh(spark, str(tmp_path))
    path = views._WRITTEN[(spark.sparkContext.applicationId, str(tmp_path), "stream")]
    assert len(spark.read.parquet(f"{path}/in").inputFiles()) > 4


def test_json_files_leave_arrow_a_few_at_a_time(monkeypatch):
    """a batch became Python values whole, however many files it held."""
    taken = []
    read = config._json_file
    monkeypatch.setattr(config, "_json_file", lambda *a: taken.append(a) or read(*a))
    files = [{"name": "a.json", "content": f'{{"k{n}": 1}}'} for n in range(150)]
    files[3] = None
    files[4] = {"name": "a.json", "content": None}

    class Counted:
        def __init__(self, of):
            self.of = of

        def __len__(self):
            return len(self.of)

        def slice(self, at, n):
            assert n <= 64
            return self.of.slice(at, n)

    out = config.json_facts.func(Counted(pa.array(files))).to_pylist()
    assert len(out) == 150 and len(taken) == 148
    assert out[3] == out[4] == {k: [] for k in config.KINDS}
    assert out[149]["configuration"] == ["`k149`: number"]


def test_chunks_of_texts_are_bounded_and_lose_no_run():
    """all texts of a batch became Python values at once; a long one was a chunk by itself."""
    size = grams._CHUNK_CHARS
    texts = ["ab", None, "x" * (size - 1) + "yzé" + "x" * size, "", "é\U0001f600c", "w" * size]
    chunks = list(grams._chunks(pa.array(texts)))
    assert max(sum(map(len, some)) for _, some in chunks) <= size + grams.LONGEST - 1
    pairs = set()
    for numbers, some in chunks:
        row, cell = grams.cells(some)
        pairs |= set(zip(numbers[row].tolist(), cell.tolist()))
    row, cell = grams.cells([t or "" for t in texts])
    assert pairs == set(zip(row.tolist(), cell.tolist()))
