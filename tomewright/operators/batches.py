"""Packing files into batches of at most so many tokens, in path order.

Files go into the open batch one after the other; one that does not fit starts the next batch,
and one that is larger than a whole batch stands alone. Where a batch starts thus depends on all
files before it. To still work in parallel, each range of files is first summed up by what it
does to the batch that is open when it begins: a step function from the tokens already in that
batch to the tokens left open at the end. Such functions put together are one again, so ranges are
first joined in groups, all groups at once; following the few functions of groups gives the state in
which each group begins, and following those within a group the state in which each range begins. Then
all ranges are packed at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright import constants as K
from tomewright.functions.text import utf16_prefix
from tomewright.operators.ordering import freeze

CLOSED = -1  # no batch is open; otherwise the tokens in the open batch


def _breaks(tokens: np.ndarray, first: np.ndarray, budget: int) -> np.ndarray:
    """Places where a batch must start whatever came before, and the end."""
    large = np.flatnonzero(tokens > budget)
    forced = np.concatenate([np.flatnonzero(first), large, large + 1, [len(tokens)]])
    return np.unique(forced[forced <= len(tokens)])


def _next_start(at: np.ndarray, total: np.ndarray, breaks: np.ndarray, budget: int) -> np.ndarray:
    """For batches that start at ``at``, where the next one starts (or the end)."""
    full = np.searchsorted(total, total[at] + budget, side="right") - 1
    stop = breaks[np.searchsorted(breaks, at, side="right")]
    return np.minimum(np.maximum(full, at + 1), stop)


def _shard_starts(shards: np.ndarray, previous: str) -> np.ndarray:
    return np.concatenate([[shards[0] != previous], shards[1:] != shards[:-1]])


def _running(tokens: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(tokens)])


def _summary(tokens: np.ndarray, first: np.ndarray, budget: int) -> tuple[list, list, list]:
    """What a range does to an open batch: ``(room, starts, left)`` steps.

    With ``room`` tokens free in the open batch (at least ``room[i]``, less than ``room[i + 1]``)
    the range starts ``starts[i]`` batches and leaves ``left[i]`` tokens open. ``starts`` of zero
    means that all of it fits; ``left`` is then what it adds. The last step, with a room of -1 in
    front, is for a range that begins with no batch open.
    """
    n = len(tokens)
    total, breaks = _running(tokens), _breaks(tokens, first, budget)
    # From each start: the batches to the end of the range, and the start of the last of them. Each
    # round doubles how far a start looks ahead.
    jump = np.append(_next_start(np.arange(n), total, breaks, budget), n)
    starts, last = np.append(np.ones(n, dtype=np.int64), 0), np.arange(n + 1)
    while (jump[:-1] < n).any():
        starts += np.where(jump < n, starts[np.minimum(jump, n)], 0)
        last = np.where(jump < n, last[jump], last)
        jump = jump[jump]
    starts, last = starts[:-1], last[:-1]
    left = np.where(tokens[last] > budget, CLOSED, total[n] - total[last])
    # Room for all before i, but not for i itself.
    stop = int(breaks[0])  # the first place that is a start in any case
    at = np.arange(min(n, stop + 1))
    at = at[(total[at] <= budget) & ((at == stop) | (tokens[at] > 0))]
    rooms = np.concatenate([[-1], total[at]])
    counts, lefts = (np.concatenate([v[:1], v[at]]) for v in (starts, left))
    if stop >= n and total[n] <= budget:
        rooms, counts, lefts = (np.append(v, x) for v, x in (
            (rooms, total[n]), (counts, 0), (lefts, total[n])))
    return _steps(rooms, counts, lefts)


def _steps(rooms: np.ndarray, counts: np.ndarray, lefts: np.ndarray) -> tuple[list, list, list]:
    """Steps that differ from the one before."""
    keep = np.ones(len(rooms), dtype=bool)
    keep[2:] = (counts[2:] == 0) | (counts[2:] != counts[1:-1]) | (lefts[2:] != lefts[1:-1])
    return tuple(np.asarray(v)[keep].tolist() for v in (rooms, counts, lefts))


def _compose(one: tuple[list, list, list], two: tuple[list, list, list], joined: bool,
             budget: int) -> tuple[list, list, list]:
    """The summary of two ranges in a row; unless ``joined`` the second begins with none open."""
    rooms, counts, lefts = [], [], []

    def step(room: int, count: int, left: int) -> None:
        rooms.append(room), counts.append(count), lefts.append(left)

    for room, count, left in zip(*one, strict=True):
        if count > 0 or room < 0 or not joined:
            # Whatever room there was, the first range leaves the same behind.
            state, more = _advance(left if joined else CLOSED, two, budget)
            step(room, count + more, state)
            continue
        # All of the first range fits: the second sees as much less room.
        for k, (low, more, rest) in enumerate(zip(*two, strict=True)):
            if k:
                step(low + left, more, rest + left if more == 0 else rest)
    places = [k for k, room in enumerate(rooms) if room <= budget]
    return _steps(*(np.array(v, np.int64)[places] for v in (rooms, counts, lefts)))


def _advance(state: int, summary: tuple[list, list, list], budget: int) -> tuple[int, int]:
    """State after a range that begins in ``state``, and the batches it starts."""
    rooms, counts, lefts = summary
    if state == CLOSED:
        return lefts[0], counts[0]
    i = int(np.searchsorted(rooms[1:], budget - state, side="right"))
    if i == 0:  # an empty range
        return state, 0
    return (state + lefts[i], 0) if counts[i] == 0 else (lefts[i], counts[i])


def _starts(tokens: np.ndarray, first: np.ndarray, state: int, budget: int) -> tuple[np.ndarray, int]:
    """Which files start a batch, given the state before them, and the state after them."""
    n = len(tokens)
    total, breaks = _running(tokens), _breaks(tokens, first, budget)
    flags = np.zeros(n, dtype=np.int64)
    if state == CLOSED:
        at = 0
    else:
        full = int(np.searchsorted(total, budget - state, side="right")) - 1
        at = min(full, int(breaks[0]))
    last = None
    while at < n:
        flags[at] = 1
        last = at
        at = int(_next_start(np.array([at]), total, breaks, budget)[0])
    if last is None:
        return flags, state + int(total[n])
    return flags, CLOSED if tokens[last] > budget else int(total[n] - total[last])


_SUMMARY = ("part int, head string, tail string, room array<bigint>, starts array<bigint>, "
            "left array<bigint>")


def _begins(summaries: DataFrame, budget: int) -> DataFrame:
    """``part, state, before``: the state each range begins in, and the batches started before it.

    Ranges are put together in as many groups as a group has ranges, so no task sees more than the
    square root of all. The driver receives their number.
    """
    ranges = summaries.agg(F.coalesce(F.max("part"), F.lit(0)) + 1).first()[0]
    grouped = summaries.withColumn("group", F.floor(F.col("part") / (math.isqrt(ranges) + 1))
                                   .cast("int"))

    def rows(table: pd.DataFrame) -> Iterator[tuple[int, str, str, tuple]]:
        for r in table.sort_values("part").itertuples(index=False):
            yield r.part, r.head, r.tail, (list(r.room), list(r.starts), list(r.left))

    def join(table: pd.DataFrame) -> pd.DataFrame:
        done, head, tail = None, None, None
        for _, first, last, summary in rows(table):
            done = summary if done is None else _compose(done, summary, first == tail, budget)
            head, tail = first if head is None else head, last
        room, starts, left = done
        return pd.DataFrame({"part": table["group"].iloc[:1].to_numpy(), "head": [head],
                             "tail": [tail], "room": [room], "starts": [starts], "left": [left]})

    def follow(table: pd.DataFrame, state: int, before: int, shard: str | None) -> pd.DataFrame:
        out = []
        for part, first, last, summary in rows(table):
            state = state if first == shard else CLOSED
            out.append((part, state, before, shard))
            state, started = _advance(state, summary, budget)
            before, shard = before + started, last
        return pd.DataFrame(out, columns=["part", "state", "before", "open_shard"])

    follows = "part int, state bigint, before bigint, open_shard string"
    groups = freeze(grouped.groupBy("group").applyInPandas(join, _SUMMARY)
                    .withColumn("all", F.lit(0)).groupBy("all").applyInPandas(
                        lambda table: follow(table, CLOSED, 0, None), follows)
                    .withColumnRenamed("part", "group"))

    def within(state: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        begin = state.iloc[0]
        return follow(table, int(begin["state"]), int(begin["before"]), begin["open_shard"])

    return groups.groupBy("group").cogroup(grouped.groupBy("group")).applyInPandas(
        within, follows).drop("open_shard")


def assign_batches(files: DataFrame, budget: int = K.BATCH_TOKEN_BUDGET,
                   shard: Column | None = None) -> DataFrame:
    """``shard, path, tokens, batch_id`` of ``files(path, tokens)``.

    Only paths and token counts are moved, never text. With ``shard`` no batch spans two shards.
    """
    narrow = files.select((F.lit("") if shard is None else shard.cast("string")).alias("shard"),
                          "path", "tokens")
    placed = freeze(narrow.repartitionByRange("shard", "path")
                    .sortWithinPartitions("shard", "path")
                    .withColumn("part", F.spark_partition_id()))

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, first, head, tail, part = [], [], None, None, None
        for b in batches:
            if not len(b):
                continue
            codes = b["shard"].to_numpy()
            if part is None:
                part, head, tail = int(b["part"].iloc[0]), codes[0], codes[0]
            tokens.append(b["tokens"].to_numpy())
            first.append(_shard_starts(codes, tail))
            tail = codes[-1]
        if part is not None:
            room, starts, left = _summary(np.concatenate(tokens), np.concatenate(first), budget)
            yield pd.DataFrame({"part": [part], "head": [head], "tail": [tail],
                                "room": [room], "starts": [starts], "left": [left]})

    summaries = placed.select("part", "shard", "tokens").mapInPandas(
        summarise, _SUMMARY)
    begin = _begins(freeze(summaries), budget)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = before = previous = None
        for b in batches:
            if not len(b):
                continue
            if state is None:
                state, before = int(b["state"].iloc[0]), int(b["before"].iloc[0])
            codes, tokens = b["shard"].to_numpy(), b["tokens"].to_numpy()
            first = _shard_starts(codes, codes[0] if previous is None else previous)
            flags, state = _starts(tokens, first, state, budget)
            ids = before + np.cumsum(flags) - 1
            before, previous = before + int(flags.sum()), codes[-1]
            yield pd.DataFrame({"shard": codes, "path": b["path"], "tokens": tokens,
                                "batch_id": ids})

    return placed.join(F.broadcast(begin), "part").mapInPandas(  # one row per range of files
        pack, "shard string, path string, tokens bigint, batch_id bigint")


def pack_batches(assigned: DataFrame, budget: int = K.BATCH_TOKEN_BUDGET) -> DataFrame:
    """One row per batch. A file larger than the budget counts as the budget."""
    return assigned.groupBy("batch_id").agg(
        F.min("shard").alias("shard"), F.count("*").alias("n_files"),
        F.least(F.sum("tokens"), F.lit(budget)).alias("est_tokens"),
        F.min("path").alias("first_path"), F.max("path").alias("last_path"))


def batch_text(assigned: DataFrame, files: DataFrame,
               budget: int = K.BATCH_TOKEN_BUDGET) -> DataFrame:
    """``batch_id, path, text``: a batch's text is that of its files in path order.

    Rows stay apart because empty files cost no tokens, so nothing bounds how many share a batch.
    """
    title = F.concat(F.lit("=== "), F.col("path"), F.lit(" ===\n"))
    limit = budget * K.CHARS_PER_TOKEN
    whole = F.concat(title, "content", F.lit("\n\n"))
    cut = F.concat(title, utf16_prefix(F.col("content"), limit), F.lit("\n... (truncated)"))
    return (assigned.join(files.select("path", "content"), "path")
            .select("batch_id", "path",
                    F.when(F.col("tokens") > budget, cut).otherwise(whole).alias("text")))
