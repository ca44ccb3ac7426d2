"""Components of near copies against all pairs."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from tomewright.llm import arrays as A
from tomewright.llm import components, jaccard
from tests.llm.helpers import frame, odd_documents, spaced


def plain_components(texts, n=5, percent=75):
    sets = []
    for _, text in texts:
        w = spaced(text)
        sets.append({tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(texts)), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(texts):
        if sets[k] and i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least.get(find(k)) if sets[k] else i)
                   for k, (i, _) in enumerate(texts)), key=str)


def near_copies(seed, groups=12, lengths=(3, 60)):
    """Texts with copies edited to just around the threshold, chains of copies, shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    out = []
    for _ in range(groups):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(*lengths))]
        if rng.random() < 0.4:
            words[rng.randint(0, len(words)):0] = passage
        for _ in range(rng.randint(1, 8)):
            out.append(" ".join(words))
            words = list(words)  # the next one is a copy of this copy
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(words))
                words[k:k + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
            words = words or ["x"]
    rng.shuffle(out)
    return list(enumerate(out, 100))


def run(spark, texts):
    rows = jaccard.jaccard_components(frame(spark, texts)).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)


@pytest.mark.parametrize("seed,lengths", [(1, (3, 60)), (2, (1, 14))])
def test_equal_to_all_pairs(spark, monkeypatch, seed, lengths):
    monkeypatch.setattr(jaccard, "CELLS", 1 << 12)
    monkeypatch.setattr(jaccard, "FILTER_BITS", 1 << 16)
    monkeypatch.setattr(jaccard, "LIST_SETS", 4)  # lists are dealt over several
    texts = near_copies(seed, lengths=lengths) + odd_documents()
    assert run(spark, texts) == plain_components(texts)


def test_boundary_does_not_change_links(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CELLS", 1 << 12)
    monkeypatch.setattr(jaccard, "FILTER_BITS", 1 << 16)
    monkeypatch.setattr(jaccard, "choose_boundary", lambda *_: 9)
    texts = near_copies(4, groups=20, lengths=(1, 20))
    assert run(spark, texts) == plain_components(texts)


def test_empty_table(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CELLS", 1 << 10)
    monkeypatch.setattr(jaccard, "FILTER_BITS", 1 << 12)
    assert run(spark, []) == []


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(3)
    for _ in range(400):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 300)).astype(np.uint64))
        keep = a[rng.random(len(a)) < rng.uniform(0.6, 1)]
        b = np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, rng.integers(0, 80)).astype(
            np.uint64)]))
        if not len(b):
            continue
        shared = len(np.intersect1d(a, b))
        if 100 * shared >= 75 * (len(a) + len(b) - shared):
            assert jaccard.could_link(len(a), jaccard.sketch(a), len(b), jaccard.sketch(b), 75)


def test_bounds():
    for a, b in itertools.product(range(1, 40), repeat=2):
        for shared in range(min(a, b) + 1):
            links = 100 * shared >= 75 * (a + b - shared)
            assert links == (shared >= jaccard.needed(a, b, 75)) or shared > min(a, b)
            if links:
                low, high = jaccard.partners(a, 75)
                assert low <= b <= high
                assert shared > a - jaccard.prefix(a, 75)  # one is in the prefix
    assert jaccard.subset_sizes(8, 14, 75) == {6, 7, 8}


def test_boundary_follows_cost():
    many_short = {size: 10**6 for size in range(3, 7)}
    assert jaccard.choose_boundary(many_short, sharing=1000.0, percent=75) >= 6
    assert jaccard.choose_boundary(many_short, sharing=1.0, percent=75) <= 3


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(k, k + 1) for k in range(40)] + [(500, 600 + k) for k in range(30)]
    links += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    links += [(7, 7), (3000, 3000)]
    root = {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    rng.shuffle(links)
    got = components.components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {r["node"]: r["root"] for r in got} == {k: find(k) for k in list(root)}
    assert len(got) == len(root)


def test_row_sets_are_shingles():
    words = A.words_of(*A.text_buffer(pa.array(["a b c", "", "a b c d e f"])),
                       A.NOT_SPACE)
    assert [len(s) for s in jaccard.row_sets(words, 5)] == [1, 0, 2]


def test_words_made_to_share_a_hash_do_not_link(spark):
    from tests.llm.test_llm_tokens import thue_morse

    rows = [(i, w) for i, w in enumerate(w for k in (6, 10, 12, 16) for w in thue_morse(k))]
    found = jaccard.jaccard_components(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(i, i) for i, _ in rows]


@pytest.mark.parametrize("seed", range(3))
def test_long_lists_are_compared_in_blocks(spark, monkeypatch, seed):
    """With all lists long and all groups tiny, chains of copies are still whole."""
    monkeypatch.setattr(jaccard, "LONG_LIST", 2)
    monkeypatch.setattr(jaccard, "GROUP_SETS", 3)
    monkeypatch.setattr(jaccard, "LARGEST_BOUNDARY", 0)
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(200)]
    texts, words = [], [rng.choice(vocabulary) for _ in range(80)]
    for _ in range(60):  # each copy differs from the first a little elsewhere
        copy = list(words)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    rows = list(enumerate(texts + [t for _, t in near_copies(seed, 6)], 100))
    got = jaccard.jaccard_components(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == plain_components(rows)


def test_small_tables_are_few_tasks(spark):
    """A few links are no more tasks than cores, however many shuffle partitions there are."""
    settings = {"spark.sql.shuffle.partitions": "64",
                "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    links = [(k, k + 1) for k in range(30)] + [(100, 200 + k) for k in range(30)]
    df = spark.createDataFrame(links, "u long, v long")
    sc = spark.sparkContext
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        sc.setJobGroup("few", "few")
        got = components.components(df).collect()
        tracker = sc.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("few")
                  for s in tracker.getJobInfo(j).stageIds]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r["root"] for r in got if r["node"] <= 30} == {0}
    assert len(got) == 62
    assert max(s.numTasks for s in stages if s) <= 16


def test_sketches_are_small_and_tell_sets_apart():
    rng = np.random.default_rng(5)
    one, other = (np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64)) for _ in range(2))
    a, b = jaccard.sketch(one), jaccard.sketch(other)
    assert len(a) == 64
    assert not jaccard.could_link(500, a, 500, b, 75)


def test_lists_of_two_sets_have_no_more_pairs(spark):
    entries = [(1, jaccard._WHOLE, 0, 9, 11), (1, jaccard._WHOLE, 0, 9, 12), (2, jaccard._WHOLE, 0, 9, 11),
               (3, jaccard._WHOLE, 0, 9, 11), (3, jaccard._WHOLE, 0, 9, 12), (3, jaccard._WHOLE, 0, 9, 13),
               (3, jaccard._WHOLE, 0, 9, 13), (4, 1, 0, 9, 14)]
    got = jaccard._lists(spark.createDataFrame(entries, jaccard._ENTRIES), 75, len(entries)).collect()
    assert sorted((r["list"], r["set_id"], r["more"]) for r in got) == [
        (1, 11, False), (1, 12, False), (3, 11, True), (3, 12, True), (3, 13, True), (4, 14, True)]
