"""Models by held-out accuracy, and the language model against plain counts."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tomewright.llm import language_id, maxent, subwords, toxicity
from tomewright.llm import arrays as A
from tests.llm.helpers import frame, odd_documents, spaced

STEMS = {"en": "the ing tion ly was and".split(), "de": "der ung keit ä schen und".split(),
         "fr": "les eau eux ç ment ou".split()}


def texts_in(lang, n, seed):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randint(1, 3)))
                     for _ in range(rng.randint(3, 60))) for _ in range(n)]


def test_language(spark):
    train = [(i, t, lang) for lang in STEMS for i, t in enumerate(texts_in(lang, 120, lang))]
    rows = [(k, t, lang) for k, (_, t, lang) in enumerate(train)]
    schema = "doc_id long, text string, lang string"
    model = language_id.train(spark.createDataFrame(rows + [(None, "x", "en"), (5000, None, "de"),
                                                            (5001, "lost", None)], schema))
    assert model.languages == ["de", "en", "fr"] and 0 < model.reject_below < 1
    held = [(k, t, lang) for lang in STEMS for k, t in enumerate(texts_in(lang, 40, lang + "x"))]
    found = language_id.identify(spark.createDataFrame(held, schema), model).collect()
    assert np.mean([r.lang_pred == r.lang for r in found]) > 0.97
    sure = [r for r in found if not r.rejected]
    assert len(sure) > 60 and np.mean([r.lang_pred == r.lang for r in sure]) > 0.98
    odd = language_id.identify(frame(spark, odd_documents()), model).collect()
    assert [(r.lang_pred == "und") for r in odd] == [
        not any(c.isalpha() for c in t or "") for _, t in odd_documents()]
    assert all(0 <= r.score <= 1 for r in odd) and odd[5].score == odd[6].score
    assert [r.ids for r in odd] == ["kept"] * len(odd)
    nothing = language_id.train(spark.createDataFrame([], schema))
    assert {r.lang_pred for r in language_id.identify(frame(spark, odd_documents()),
                                                      nothing).collect()} == {"und"}


def test_toxicity_and_unseen_misspellings(spark):
    rng = random.Random(4)
    bad, plain = ["grumblex", "snarkful"], texts_in("en", 400, "tox")
    docs, labels = [], []
    for i, text in enumerate(plain):
        words, toxic = text.split(), i % 3 == 0
        if toxic:
            words.insert(rng.randrange(len(words) + 1),
                         rng.choice(bad) + rng.choice(["", "s", "est", "ing"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    train = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(0, 1), (None, 1), (7777, 0)],
                                  "doc_id long, toxic int")
    model = toxicity.train(train, marks)
    clean = texts_in("en", 60, "other")
    spelled = [t.replace(" ", " snarkfull ", 1) if k % 2 else t + " GRUMBLEXX"
               for k, t in enumerate(clean)]
    rows = toxicity.score(frame(spark, list(enumerate(clean + spelled))), model).collect()
    assert np.mean([r.predicted for r in rows[:60]]) < 0.1
    assert np.mean([r.predicted for r in rows[60:]]) > 0.8
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    odd = toxicity.score(frame(spark, odd_documents()), model).collect()
    assert all(0 <= r.score <= 1 for r in odd) and len(odd) == len(odd_documents())
    one_class = toxicity.train(train, marks.where("toxic = 0"))
    assert {r.score for r in toxicity.score(train, one_class).collect()} == {0.0}
    assert toxicity.score(frame(spark, []), model).collect() == []


def test_worst_window():
    words = A.words_of(*A.text_buffer(pa.array(["a b c d e f", "", "a", "f f"])), A.ALNUM)
    shape = toxicity.SHAPE
    table = np.random.default_rng(0).normal(size=(1 << shape.bits, 1)).astype(np.float32)
    each = subwords.word_scores(words, table, shape)[:, 0].astype(float)
    n = toxicity.WINDOW
    want = [max(each[k:k + n].mean() for k in range(6 - n + 1)), 0.0, each[6], each[7:9].mean()]
    assert np.allclose(toxicity.worst_window(words, table), want, atol=1e-5)


def test_word_scores_are_means_of_ngrams():
    words = A.words_of(*A.text_buffer(pa.array(["über ab über"])), A.ALNUM)
    shape = subwords.Shape(grams=(2, 3), bits=12, dim=1)
    places, inverse = subwords.distinct(words)
    buckets, first = subwords.subwords(words, places, shape)
    assert inverse[0] == inverse[2] != inverse[1]
    sizes = dict(zip([words.text(int(p)).decode() for p in places], np.diff(first), strict=True))
    assert sizes == {"über": 1 + 6 + 5, "ab": 1 + 3 + 2}  # of "<" + bytes + ">"
    table = np.arange(1 << 12, dtype=np.float32)[:, None]
    assert np.isclose(subwords.word_scores(words, table, shape)[1, 0],
                      table[buckets[first[inverse[1]]:first[inverse[1] + 1]]].mean())


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(50)] + ["Über", "THE", "the"]
    docs = []
    for i in range(150):
        at, text = rng.randrange(50), []
        for _ in range(rng.randint(0, 60)):
            at = (at + rng.choice([1, 1, 1, 2])) % 50  # a word is foretold by the one before
            text.append(words[at] if rng.random() < 0.9 else rng.choice(words))
        docs.append((i, " ".join(text)))
    docs += [(1000 + k, t) for k, (_, t) in enumerate(odd_documents()) if k not in (3, 4)]
    frame_ = frame(spark, docs).selectExpr("doc_id", "text", "doc_id % 7 = 2 AS held_out")
    model, counts = maxent.train(frame_.where("NOT held_out"))
    return docs, model, maxent.score(frame_, model, counts).collect()


def test_counts_and_base(scored):
    docs, model, rows = scored
    tokens = {i: [*spaced(t), "\n"] for i, t in docs}
    counts = Counter(w for i, _ in docs if i % 7 != 2 for w in tokens[i])
    total, distinct = sum(counts.values()), len(counts)
    assert len(rows) == len(docs)
    for r in rows:
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens[r.doc_id])
        assert (r.n_tokens, r.train_tokens) == (len(tokens[r.doc_id]), total)
        assert r.n_known == sum(counts[w] > 0 for w in tokens[r.doc_id])
        assert math.isclose(r.base_score, base, rel_tol=1e-9)


def test_model_beats_counts_on_held_out_texts(scored):
    _, _, rows = scored
    held = [r for r in rows if r.held_out and r.doc_id < 1000]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + len(held)


def test_joined_words_give_the_same(spark, scored, monkeypatch):
    docs, _, rows = scored
    monkeypatch.setattr(maxent, "KNOWN", 4)  # nearly all counts come by the join
    frame_ = frame(spark, docs).selectExpr("doc_id", "text", "doc_id % 7 = 2 AS held_out")
    model, counts = maxent.train(frame_.where("NOT held_out"))
    got = {r.doc_id: r for r in maxent.score(frame_, model, counts).collect()}
    for r in rows:
        assert math.isclose(got[r.doc_id].base_score, r.base_score, rel_tol=1e-9)
        assert got[r.doc_id].n_known == r.n_known


def test_chances_add_up(scored):
    _, model, _ = scored
    rows = np.random.default_rng(1).integers(0, maxent.ROWS, (3, 5))
    for table, bias in ((model.class_rows, model.class_bias),
                        (model.word_rows, model.word_bias[np.arange(5)])):
        logs = [maxent._log_chances(rows, table, bias, np.full(5, k)) for k in range(table.shape[1])]
        assert np.allclose(np.exp(logs).sum(axis=0), 1, atol=1e-4)


@pytest.mark.parametrize("far", [0, 100, 5000, -5000])
def test_chances_of_scores_far_from_zero(far):
    rng = np.random.default_rng(3)
    table, bias = np.full((2, 8, 6), far / 3, np.float32), rng.normal(size=(4, 6))
    rows, target = rng.integers(0, 8, (3, 4)), np.array([0, 3, 5, 5])
    want = bias[np.arange(4), target] - np.log(np.exp(bias).sum(axis=1))
    got = maxent._log_chances(rows, table[0], bias.astype(np.float32), target)
    assert np.allclose(got, want, atol=2e-3)
    maxent._factor_step(table[1], np.zeros(8, np.float32), bias.astype(np.float32), rows, target)
    assert np.isfinite(table[1]).all()
    assert (maxent._log_chances(rows, table[1], bias.astype(np.float32), target) > got).mean() > 0.5


def test_step_is_the_sum_of_all_gradients():
    """Rows that occur once, twice and often in a batch, of one feature or of several."""
    rng = np.random.default_rng(5)
    rows, target = rng.integers(0, 40, (3, 30)), rng.integers(0, 6, 30)
    rows[0, :12], rows[2] = 50, np.arange(100, 130)
    table, bias = rng.normal(size=(130, 6)).astype(np.float32), rng.normal(size=(30, 6))
    share = np.exp(table[rows].sum(axis=0) + bias)
    share /= share.sum(axis=1, keepdims=True)
    share[np.arange(30), target] -= 1
    grad = np.zeros((130, 6))
    np.add.at(grad, rows, share)
    past = maxent._SHARE * (grad ** 2).sum(axis=1)
    want = table - maxent._RATE * grad / np.sqrt(past + maxent._DELAY)[:, None]
    seen = np.zeros(130, np.float32)
    maxent._factor_step(table, seen, bias.astype(np.float32), rows.astype(np.uint16), target)
    assert np.allclose(table, want, atol=1e-5) and np.allclose(seen, past, atol=1e-5)


def test_features_mix_a_word_once_for_all_its_places(monkeypatch):
    """Only the two words together are mixed place by place."""
    texts = pa.array(["a b c " * 400, "", None, "b", "c a"])
    (_, _, t), = maxent.blocks(texts)
    words, mixed, mix = len(t.hash), [], maxent.A.mix
    begin = np.array([maxent._BEGIN], np.uint64)

    def counted(h):
        mixed.append(h.size)
        return mix(h)

    monkeypatch.setattr(maxent.A, "mix", counted)
    got = maxent.Model.features(t, t.spelling)
    assert sum(mixed) <= len(t.token) + 3 * (words + 1)
    for first, last in zip(t.first[:-1], t.first[1:], strict=True):
        for at in range(first, last):
            one, two = ([ids[t.token[at - k]:][:1] if at - k >= first else begin
                         for ids in (t.hash, t.spelling)] for k in (1, 2))
            want = np.stack([mix(one[0] + np.uint64(1 << 40)), mix(two[0] + np.uint64(2 << 40)),
                             mix(mix(one[1] + np.uint64(3 << 40)) + two[1])])
            assert np.array_equal(got[:, at], want[:, 0])


def test_nothing_learned(spark):
    docs = frame(spark, [(1, "a b"), (2, None)]).selectExpr("doc_id", "text", "true AS held_out")
    model, counts = maxent.train(docs.where("false"))
    rows = maxent.score(docs, model, counts).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows] == [
        (3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert maxent.score(docs.where("false"), model, counts).collect() == []


def test_rare_words_depend_on_the_words_before(spark):
    """Thousands of words with one spelling class: each foretells another."""
    pairs = [(f"a{k}qx", f"b{k}qx") for k in range(3000)]
    docs = spark.createDataFrame([(i, " ".join(pairs[i % 3000])) for i in range(24_000)],
                                 "doc_id long, text string")
    model, counts = maxent.train(docs)
    asked = spark.createDataFrame(
        [(i, f"{a} {b}", False) for i, (a, b) in enumerate(pairs)]
        + [(3000 + i, f"{a} {pairs[i - 1][1]}", False) for i, (a, _) in enumerate(pairs)],
        "doc_id long, text string, held_out boolean")
    scores = {r.doc_id: r.score for r in maxent.score(asked, model, counts).collect()}
    better = [scores[i] - scores[3000 + i] for i in range(3000)]
    assert np.mean(better) > 0.1 and np.mean(np.array(better) > 0.01) > 0.9


def test_words_share_places_beyond_the_known(spark, monkeypatch):
    monkeypatch.setattr(maxent, "KNOWN", 10)
    docs = spark.createDataFrame([(i, f"u{i % 40}z v{i % 40}z") for i in range(4000)],
                                 "doc_id long, text string")
    model, counts = maxent.train(docs)
    assert len(model.words) <= 10
    got = {w: n for w, n in zip(model.words.tolist(), model.counts.tolist(), strict=True)}
    others = [r for r in counts.collect() if r.word % 2 ** 64 not in got]
    assert model.shared_total.sum() == sum(r.n + 1 for r in others) + len(model.shared_total)
    where = maxent.shared_place(np.array([r.word for r in others]).astype(np.uint64),
                                np.array([r.tail for r in others]), model.width)
    assert np.array_equal(np.bincount(where, [r.n + 1 for r in others], len(
        model.shared_total)) + 1, model.shared_total)


def test_words_without_a_place_have_their_share_of_it(spark, monkeypatch):
    monkeypatch.setattr(maxent, "WIDTH", 2)
    monkeypatch.setattr(maxent, "ROUNDS", 0)  # the counts alone
    docs = spark.createDataFrame([(i, f"u{i % 40}z v{i % 7}z") for i in range(280)],
                                 "doc_id long, text string")
    model, counts = maxent.train(docs)
    assert model.own < len(model.words) == 48
    asked = docs.limit(40).selectExpr("doc_id", "text", "false AS held_out")
    for r in maxent.score(asked, model, counts).collect():
        want = sum(math.log10((c + 1) / (3 * 280 + 48 + len(model.shared_total)
                                         + max(model.own - 48, 0))) for c in (7, 40, 280))
        assert math.isclose(r.score, want, abs_tol=1e-3)


def test_model_sizes_follow_the_words():
    def sized(n):
        known = min(n, maxent.KNOWN)
        return maxent.Model(np.arange(known, dtype=np.uint64), np.ones(known, np.int64), *np.zeros(
            (2, maxent.TAIL * maxent.width_of(n))), n, n)

    small, large, huge = sized(1000), sized(4_000_000), sized(100_000_000)
    assert small.width == maxent.WIDTH and len(small.class_rows) == maxent.ROWS
    assert large.own >= 3900 and len(large.word_rows) == maxent.MAX_ROWS
    assert huge.own >= 19_000 and len(huge.class_bias) == huge.width + maxent.TAIL


@pytest.mark.parametrize("size", [1, 3, 64])
def test_steps_of_a_few_rows_at_a_time_are_the_same(monkeypatch, size):
    rng = np.random.default_rng(4)
    rows, target = rng.integers(0, 30, (3, 40)).astype(np.uint16), rng.integers(0, 5, 40)
    start = rng.normal(size=(30, 5)).astype(np.float32)
    bias = rng.normal(size=5).astype(np.float32)
    results = []
    for at_once in (512, size):
        monkeypatch.setattr(maxent, "_STEP_ROWS", at_once)
        table, seen = start.copy(), np.zeros(30, np.float32)
        maxent._factor_step(table, seen, bias, rows, target)
        results.append((table, seen))
    assert all(np.array_equal(a, b) for a, b in zip(*results, strict=True))
