"""Many queries at once against one at a time."""

import random

import numpy as np
from pyspark.sql import functions as F

from tomewright.operators import grams, query, query_batch
from tests.test_documents import AS_OF, small_kb, stored


def test_cells():
    texts = ["", "a", "ab", "abc", "abcd", "ab", "éa\U0001F600x", "aaaa"]
    row, cell = grams.cells(texts)
    sets = [set(cell[row == k].tolist()) for k in range(len(texts))]
    assert [len(s) for s in sets] == [0, 1, 3, 6, 9, 3, 9, 3]
    assert sets[2] == sets[5] and sets[3] < sets[4] and sets[1] < sets[2]
    row, cell = grams.cells(texts, longest_only=True)
    longest = [set(cell[row == k].tolist()) for k in range(len(texts))]
    assert [len(s) for s in longest] == [0, 1, 1, 1, 2, 1, 2, 1]
    assert all(a <= b for a, b in zip(longest, sets)) and longest[3] <= sets[4]


def test_all_that_hold_a_string_are_candidates(spark):
    rng = random.Random(6)
    texts = [["".join(rng.choice("abc é") for _ in range(rng.randint(0, 12)))
              for _ in range(rng.randint(0, 3))] for _ in range(200)] + [["x" * 2_000_000 + "end"], [None]]
    strings = sorted({"".join(rng.choice("abc é") for _ in range(rng.randint(1, 5)))
                      for _ in range(150)} | {"zzz", "xend", "x"})
    got = set(map(tuple, grams.candidates(
        spark.createDataFrame([(s,) for s in strings], "string string"),
        spark.createDataFrame(list(enumerate(texts)), "id long, texts array<string>")).collect()))
    want = {(s, i) for s in strings for i, ts in enumerate(texts) if any(s in (t or "") for t in ts)}
    assert want <= got
    # Strings of up to three characters are one run: only a shared cell could add to them.
    assert len([p for p in got - want if len(p[0]) <= 3]) < 5
    none = grams.candidates(spark.createDataFrame([], "string string"),
                            spark.createDataFrame([(1, ["a"])], "id long, texts array<string>"))
    assert none.collect() == []


def test_queries_one_at_a_time(spark, tmp_path):
    kb = small_kb(spark, 30)
    rng = random.Random(9)
    words = ["src", "TS", "api", "f003", "lines", "module", "o", "in", "", "Files in", "zzz", "`src/a",
             ".py", "line", "s", "ro", "README", "()", " — "]
    asked = [(i, rng.choice(words) + rng.choice(["", "", "c", "s/"]),
              rng.choice([None, "", "module", "Module", "nope"])) for i in range(60)]
    asked += [(60 + i, "src", None) for i in range(40)] + [(100, None, None)]
    table = spark.createDataFrame(asked, "query_id int, query string, category string")
    for path, options in (("whole", {}), ("split", {"max_chars": 300})):
        held = stored(spark, kb, str(tmp_path / path), **options)
        got = {}
        for r in query_batch.kb_query_batch(held, table).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.filename, r.score))
        answers = {}
        for i, q, c in asked[:-1]:
            if (q, c) not in answers:
                answers[q, c] = [(r.filename, r.score) for r in query.kb_query(held, q, c).collect()]
            assert got.get(i, []) == answers[q, c], (q, c)
        assert 100 not in got  # a null query asks for nothing
