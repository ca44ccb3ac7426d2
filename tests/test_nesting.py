"""Facts of scripts that nest at any depth."""

import random

import pytest
from pyspark.sql import functions as F

from tomewright.operators.facts import braces, extract_facts


def script(depth):
    inside = "{" * depth + " deep(z) { } " + "}" * depth
    return (f"/** Doc. */\nclass Store extends Base {{\n  first(a) {inside}\n  second(b) {{ }}\n}}\n"
            f"interface Item {{ id: string; nested {inside} size?: number }}\n"
            f"try {{ }} catch (e) {{ if (x) {inside} console.log(e); throw e }}\n"
            f"const APP_CONFIG = {{ one: 1, two {inside}, three: 3 }}\n"
            "enum Kind { A, B }\n")


def facts_of(spark, texts):
    df = spark.createDataFrame([(f"a/f{i:04}.ts", t) for i, t in enumerate(texts)],
                               "path string, content string")
    out = {}
    for r in extract_facts(df).orderBy("path", "kind", "ord").collect():
        out.setdefault((int(r.path[3:7]), r.kind), []).append(r.value)
    return out


DEPTHS = [1, 10, 58, 59, 60, 61, 200, 1000, 20_000]


def test_depths(spark):
    got = facts_of(spark, [script(d) for d in DEPTHS])
    for k, depth in enumerate(DEPTHS):
        assert got[k, "apiSurface"] == [
            "`Store.first(a)`", "`Store.deep(z)`", "`Store.second(b)`"], depth
        assert "`Item` defines: id, size?" in got[k, "keyConcepts"], depth
        assert "logs errors, re-throws" in got[k, "errorHandling"], depth
        assert got[k, "configuration"] == ["`APP_CONFIG`: one, three"], depth


def test_is_deep(spark):
    rows = [("{" * 60 + "}" * 60, False), ("{" * 61 + "}" * 61, True), ("{}" * 500, False),
            ("}" * 99, False), ("}" * 99 + "{" * 61, True), ("{" * 40 + "}" * 30 + "{" * 50, False),
            ("{" * 40 + "}" * 20 + "{" * 41, True), ("x{" * 61, True), ("", False)]
    df = spark.createDataFrame(rows, "t string, deep boolean")
    assert df.where(braces.is_deep(F.col("t")) != F.col("deep")).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_both_ways_agree(spark, monkeypatch, seed):
    """What the patterns read in one go, and header by header."""
    rng = random.Random(seed)
    parts = ["{", "}", "{", "}", " type A = ", "interface B extends C ", "interface D {", "name: ",
             "opt?: {", "; ", "catch (e) {", "console", " throw ", "/** doc {x} */ class K {",
             "/** d */ class L extends M ", "run(a, b) {", "_no() {", "constructor(x) {", "\n",
             "const MY_OPTIONS = {", "export const x_settings: T = Readonly(", "'key': ", "k: {",
             "return: ", "static async go(): P {", "return", ", "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(250)]
    flat = facts_of(spark, texts)
    monkeypatch.setattr(braces, "is_deep", lambda content: content.isNotNull())
    assert facts_of(spark, texts) == flat
