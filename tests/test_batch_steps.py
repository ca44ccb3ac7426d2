"""The parallel packing against the plain rule, on random inputs."""

import random

import numpy as np
import pytest

from tomewright.operators.batches import (CLOSED, _advance, _compose, _starts, _summary,
                                          assign_batches)


def plain(tokens, shards, budget):
    ids, batch, current, previous = [], -1, CLOSED, None
    for t, s in zip(tokens, shards):
        if s != previous:
            current = CLOSED
        if t > budget:
            batch, current = batch + 1, CLOSED
        elif current == CLOSED or current + t > budget:
            batch, current = batch + 1, t
        else:
            current += t
        ids.append(batch)
        previous = s
    return ids


@pytest.mark.parametrize("seed", range(300))
def test_ranges_give_the_plain_result(seed):
    rng = random.Random(seed)
    budget = rng.choice([1, 5, 20, 100])
    n = rng.randint(1, 60)
    tokens = [rng.choice([0, 0, 1, 2, rng.randint(0, budget), rng.randint(0, 2 * budget + 1)])
              for _ in range(n)]
    shards = sorted(rng.choice("ab" if seed % 2 else "a") for _ in range(n))
    cuts = sorted({0, n, *(rng.randint(0, n) for _ in range(rng.randint(0, 8)))})
    state, before, previous, got = CLOSED, 0, None, []
    for a, b in zip(cuts, cuts[1:]):
        t = np.array(tokens[a:b], dtype=np.int64)
        first = np.array([i > a and shards[i] != shards[i - 1] for i in range(a, b)])
        if shards[a] != previous:
            state = CLOSED
        flags, after = _starts(t, first, state, budget)
        got += list(before + np.cumsum(flags) - 1)
        state, started = _advance(state, _summary(t, first, budget), budget)
        assert (state, started) == (after, int(flags.sum()))
        before, previous = before + started, shards[b - 1]
    assert got == plain(tokens, shards, budget)


def random_files(rng, n, budget):
    tokens = [rng.choice([0, 0, 1, 2, rng.randint(0, budget), rng.randint(0, 2 * budget + 1)])
              for _ in range(n)]
    return tokens, sorted(rng.choice("abc") for _ in range(n))


@pytest.mark.parametrize("seed", range(60))
def test_functions_of_ranges_put_together(seed):
    """Composed in any order of pairs, for any state at the beginning."""
    rng = random.Random(seed)
    budget = rng.choice([1, 5, 20, 100])
    tokens, shards = random_files(rng, rng.randint(2, 80), budget)
    if seed % 3:
        shards = ["a"] * len(tokens)
    parts = []
    cuts = sorted({0, len(tokens), *(rng.randrange(len(tokens)) for _ in range(12))})
    for a, b in zip(cuts, cuts[1:]):
        first = np.array([i > a and shards[i] != shards[i - 1] for i in range(a, b)])
        parts.append((shards[a], shards[b - 1],
                      _summary(np.array(tokens[a:b], dtype=np.int64), first, budget)))
    whole = _summary(np.array(tokens, dtype=np.int64), np.array(
        [i > 0 and shards[i] != shards[i - 1] for i in range(len(tokens))]), budget)
    while len(parts) > 1:
        k = rng.randrange(len(parts) - 1)
        one, two = parts[k], parts[k + 1]
        parts[k:k + 2] = [(one[0], two[1], _compose(one[2], two[2], two[0] == one[1], budget))]
    for state in [CLOSED, *range(budget + 1)]:
        assert _advance(state, parts[0][2], budget) == _advance(state, whole, budget), state


def test_ten_thousand_ranges():
    rng = random.Random(1)
    tokens, shards = random_files(rng, 10_000, 50)
    joined, tail = None, None
    for t, s in zip(tokens, shards):
        one = _summary(np.array([t]), np.array([False]), 50)
        joined, tail = (one if joined is None else _compose(joined, one, s == tail, 50)), s
    assert _advance(CLOSED, joined, 50)[1] == plain(tokens, shards, 50)[-1] + 1


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_batches_do_not_depend_on_ranges(spark, ranges):
    rng = random.Random(ranges)
    tokens, shards = random_files(rng, 3000, 100)
    rows = [(f"{s}/{i:05}", t) for i, (t, s) in enumerate(zip(tokens, shards))]
    df = spark.createDataFrame(rows, "path string, tokens long")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = assign_batches(df, 100, shard=df["path"].substr(1, 1)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert [r.batch_id for r in sorted(got, key=lambda r: r.path)] == plain(tokens, shards, 100)
    empty = assign_batches(df.where("false"), 100)
    assert empty.collect() == []
