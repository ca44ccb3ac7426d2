"""Blocks of long texts against the whole text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tomewright.functions import secrets
from tomewright.functions.regex import EOL
from tomewright.operators import documents, gather, segments

BODY = "filename string, part int, pos bigint, key string, text string"
LINES = [
    "password:\n", "hunter2secretvalue\n", "api_key =\n", "ABCDEFGH12345678\n", "plain words here\n",
    "Authorization: Bearer\n", "tok.en.value, and more\n", "\n", "  \n", "DB_PASSWORD=x y z\n",
    "  JWT_SECRET =\n", "secret", "=", "'quoted value'\n", "https://me:pass", "word@host/x\n",
    "-----BEGIN RSA PRIVATE KEY-----\n", "MIIEfiller\n", "-----END RSA PRIVATE KEY-----\n",
    "-----BEGIN\n", "PRIVATE\n", "KEY-----", "-----END PRIVATE KEY-----", "-----END\n",
    "-----BEGIN OPENSSH PRIVATE KEY-----\n", "-----END OPENSSH PRIVATE KEY-----\n",
    "AKIA", "ABCDEFGHIJKLMNOP", " ", "x" * 40, "\r\n", "redis://a", "b c\n", "ghp_" + "a" * 20,
    "b" * 20 + "\n", " ", "BEGIN OPENSSH PRIVATE KEY-----\n", "the end\n", "token\n",
    "A line of some length without anything in it.\n", "Another line, just as harmless as that.\n"]


def texts():
    rng = random.Random(12)
    out = [[rng.choice(LINES) for _ in range(rng.randint(1, 40))] for _ in range(120)]
    key = ["-----BEGIN RSA PRIVATE KEY-----\n", *["MIIE\n"] * 9, "-----END RSA PRIVATE KEY-----\n"]
    out += [["a line in front of it\n", *key, *key, "after\n"], [*key[:4], "never ended\n"],
            [*key[5:], "an end alone\n", *key[:2], "\n", *key[9:]],
            ["-----END PRIVATE KEY-----", "BEGIN OPENSSH PRIVATE KEY-----\n", "z\n",
             "-----END OPENSSH PRIVATE KEY-----\n", "DB_PASSWORD=1\n"],
            ["password: ", *["\n"] * 50, "far.away\n"], ["https://user:", "p" * 3000, "@host\n"]]
    return out


@pytest.fixture(scope="module")
def pieces(spark):
    rows = [(f"f{k:03}.md", 0, i, "", t) for k, ts in enumerate(texts()) for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, BODY).repartition(3)


@pytest.fixture(scope="module")
def want(spark):
    rows = [(f"f{k:03}.md", "".join(ts)) for k, ts in enumerate(texts())]
    whole = secrets.redact(spark.createDataFrame(rows, "filename string, text string"), "text")
    return {r.filename: r.text for r in whole.collect()}


@pytest.mark.parametrize("max_pieces,max_chars", [(1, None), (2, None), (3, None), (4096, None),
                                                  (4096, 30), (7, 100)])
def test_redacted_pieces_are_those_of_the_whole_text(pieces, want, max_pieces, max_chars):
    done = documents.redact_pieces(pieces, max_pieces, max_chars)
    got = {}
    for r in sorted(done.collect(), key=lambda r: (r.filename, r.pos)):
        got[r.filename] = got.get(r.filename, "") + r.text
    for name, text in want.items():
        assert got.get(name, "") == text, name


def test_blocks_are_bounded_and_complete(pieces):
    got = segments.blocks(pieces, "filename", ["part", "pos", "key"], max_pieces=5, max_chars=60)
    rows = got.collect()
    assert max(len(r.text) for r in rows) <= 60 + 3000
    whole = {}
    for r in sorted(rows, key=lambda r: (r.filename, r.block)):
        whole[r.filename] = whole.get(r.filename, "") + r.text
    assert list(whole.values()) == ["".join(t) for t in texts()]


def test_recut_at_lines(pieces):
    cut = segments.recut(segments.blocks(pieces, "filename", ["part", "pos", "key"], max_pieces=2),
                         "filename", segments.LINES)
    whole = {}
    for r in sorted(cut.collect(), key=lambda r: (r.filename, r.block)):
        before = whole.get(r.filename, "")
        assert before == "" or before.endswith("\n")
        whole[r.filename] = before + r.text
    assert list(whole.values()) == ["".join(t) for t in texts()]


def test_long_lines_of_secrets(spark):
    """A value over thousands of pieces is one secret."""
    rows = [("a.md", 0, i, "", t) for i, t in enumerate(
        ["some text in front\n", "password="] + ["q" * 50] * 5000 + ["\n", "text behind it\n"])]
    done = documents.redact_pieces(spark.createDataFrame(rows, BODY), 64)
    text = "".join(r.text for r in sorted(done.collect(), key=lambda r: r.pos))
    assert text == "some text in front\npassword=[REDACTED]\ntext behind it\n"


def test_drop_between(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for k in range(150):
        parts = ["".join(rng.choice("<>ab") for _ in range(rng.randint(1, 5)))
                 for _ in range(rng.randint(1, 12))]
        rows += [(f"t{k}", i, p) for i, p in enumerate(parts)]
        want[f"t{k}"] = re.sub(r"<.*?>", "#", "".join(parts))
    df = spark.createDataFrame(rows, "k string, block long, text string")
    got = segments.drop_between(df, "k", "<", ">", "#", ">").orderBy("k", "block").collect()
    done = {}
    for r in got:
        done[r.k] = done.get(r.k, "") + r.text
    assert done == want


def test_first_block_with_text_has_the_first_number(spark):
    """``load_blocks`` knows a document's beginning by it, without a join."""
    rows = [("a", 4, ""), ("a", 7, "one\ntwo"), ("a", 9, " more\nend"), ("b", 0, "no line end"),
            ("c", 3, "x\n"), ("c", 5, "y\n"), ("d", 1, None), ("d", 2, "z\nz")]
    got = segments.recut(spark.createDataFrame(rows, "filename string, block long, text string"),
                         "filename", segments.LINES).groupBy("filename").agg(
        F.min("block").alias("first"), F.min_by("text", "block").alias("text")).collect()
    assert {r["filename"]: (r["first"], r["text"]) for r in got} == {
        "a": (segments.FIRST, "one\n"), "b": (segments.FIRST, "no line end"),
        "c": (segments.FIRST, "x\ny\n"), "d": (segments.FIRST, "z\n")}


def test_border_pattern_looks_for_the_line_end_first():
    """Looking back for words at every character was the dear part."""
    pattern = segments._NO_SECRET
    assert pattern.index("(?=[") < pattern.index("(?<!")


@pytest.mark.parametrize("max_pieces,max_chars,max_text", [
    (1, None, 0), (3, None, 0), (4096, 30, 0), (3, None, 300), (7, 100, 600)])
def test_long_texts_are_redacted_as_short_ones(pieces, want, max_pieces, max_chars, max_text):
    """All texts as rows of blocks, or only those above a size: the same texts come out."""
    done = documents.redact_pieces(pieces, max_pieces, max_chars, max_text=max_text)
    got = {}
    for r in sorted(done.collect(), key=lambda r: (r.filename, r.pos)):
        got[r.filename] = got.get(r.filename, "") + r.text
    assert {k: v for k, v in want.items() if v} == got


def test_blocks_of_a_short_text_move_once(spark, pieces):
    """One shuffle of its pieces, whatever is in it; and what reads the result redacts nothing."""
    rows = segments.redact_texts(pieces, "filename", ["part", "pos", "key"], max_pieces=3)
    plan = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "simple")
    assert len(re.findall(r"Exchange \w*partitioning", plan)) == 1, plan
    done = documents.redact_pieces(pieces, 3)
    plan = spark._jvm.PythonSQLUtils.explainString(done._jdf.queryExecution(), "simple")
    assert "Exchange" not in plan and "regexp" not in plan, plan
    assert done.groupBy("filename").count().where("count > 1").isEmpty()


def test_odd_pieces(spark):
    """Null and empty texts count for nothing, rows without a key are left out, equal rows stay."""
    rows = [("a.md", 0, 0, "", "pass"), ("a.md", 0, 1, "", None), ("a.md", 0, 2, "", "word: x1"),
            ("b.md", 0, 0, "", ""), ("c.md", 0, 0, "", None), (None, 0, 0, "", "text"),
            ("d.md", 0, 0, "", "pwd=a"), ("d.md", 0, 0, "", "pwd=a"), ("e.md", 1, 0, "", "end"),
            ("e.md", 0, None, "", "first "), ("e.md", 0, 9, "", "then ")]
    df = spark.createDataFrame(rows, BODY)
    for max_text in (0, 4, 1 << 20):
        done = documents.redact_pieces(df, 1, max_text=max_text).orderBy("filename", "pos").collect()
        got = {}
        for r in done:
            got[r.filename] = got.get(r.filename, "") + r.text
        assert got == {"a.md": "password=[REDACTED]", "d.md": "pwd=[REDACTED]",
                       "e.md": "first then end"}, max_text


def test_texts_in_very_many_pieces_are_long(spark, monkeypatch):
    monkeypatch.setattr(segments, "TEXT_PIECES", 3)
    rows = [("a", 0, i, "", "") for i in range(4)] + [("b", 0, i, "", "xy") for i in range(3)]
    df = spark.createDataFrame(rows + [("c", 0, 0, "", "0123456789")], BODY)
    long = segments.long_texts(df, "filename", max_chars=9)
    assert sorted(r.filename for r in long.collect()) == ["a", "c"]


def test_border_pattern_finds_the_same_places(spark, pieces):
    """With and without the cheap test in front."""
    cheap = "(?!(?s:.)[!-~])"
    assert segments._NO_SECRET.count(cheap) == 1
    odd = [("x" * 11 + c + a + "y" * 25,) for c in "ab:= !~\u00e9\U0001f600-" for a in (
        "\n", " \n", "\r\n", "\u2028", "\ufeff\n", "\u3000", "\n  DB_PASSWORD", " x\n", "!\n", "\n:")]
    texts = spark.createDataFrame(odd, "text string").union(
        segments.blocks(pieces, "filename", ["part", "pos", "key"], max_pieces=8).select("text"))
    n = texts.select(*[F.regexp_extract("text", p, 0).alias(a) for a, p in (
        ("new", segments._NO_SECRET), ("old", segments._NO_SECRET.replace(cheap, "")))])
    assert n.where("new <> old").isEmpty() and n.where("new <> ''").count() > 20


def test_line_ends_are_seen_before_the_border_pattern(spark):
    """Blocks without a line end are not searched: every line end of the pattern must count."""
    ends = spark.sql(f"SELECT explode(regexp_extract_all(concat_ws('', transform(sequence(1, 65535), "
                     f"n -> IF(n BETWEEN 55296 AND 57343, '', decode(unhex(lpad(hex(n), 4, '0')), "
                     f"'UTF-16BE')))), r'[{EOL}]', 0)) AS text")
    assert ends.count() == 4
    assert ends.where(~segments._has_line_end(F.col("text"))).isEmpty()


def test_single_pieces_are_not_moved(spark):
    """Where nothing is to be joined, ``gather_text`` gives the pieces; else it joins them as before."""
    rows = [("a", 0, "one"), ("b", 3, None), (None, 1, "two")]
    single = spark.createDataFrame(rows, "k string, n int, text string")
    got = gather.gather_text(single, "k", ["n"])
    plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert "Exchange" not in plan and "collect_list" not in plan, plan
    assert {tuple(r) for r in got.collect()} == {("a", 0, "one"), ("b", 0, ""), (None, 0, "two")}
    more = single.union(spark.createDataFrame([("b", 4, "three")], single.schema))
    assert {tuple(r) for r in gather.gather_text(more, "k", ["n"]).collect()} == {
        ("a", 0, "one"), ("b", 0, "three"), (None, 0, "two")}
