"""N-gram Jaccard join: a size-aware heavy-light join.

A document is the set of its word shingles; two link when 100 * intersection >= 75 * union (or
another whole percentage). Every link between different sets is found; what is returned is the
component of each document, which links decide.

* Equal sets are one node from the start, so copies cost nothing further.
* *Light* sets, of at most ``boundary`` shingles, list their subsets of the sizes that a link needs.
  Sets that share a subset are linked if their sizes allow it, without a further check; among the
  sets of a subset it is enough to link each with the smallest.
* *Heavy* sets are put in inverted lists under their rarest shingles, as many as a link needs to
  have one in common (light sets that are large enough to link with a heavy one are there too). What
  a shingle is rare by is a count over all sets in ``CELLS`` cells, so common passages come last.
* The boundary is the one of least cost: subsets listed against list places times the mean number
  of sets that share a shingle.

In a list, each set is compared with the first of a size that could link: by sketches, which are
small and rule out most pairs for certain, then by the whole sets of those left. Linked sets become
components; then only pairs of a list that are in different components are left to compare, where
they stand, again by sketches and then by whole sets. So a list of near copies costs its length, not
its square, and nothing is skipped. Very frequent shingles are dealt over several lists first.

Sets and shingles are known by 64-bit hashes; a link could only be wrong by a collision.

Cases: a text of fewer words than a shingle is one shingle; null and texts without words have an
empty set, link with nothing and are their own component. Repeated rows share a component. With
null ids a component is named by its smallest other id. Columns other than the id and the text are
not needed; only ``doc_id``, ``n_shingles`` and ``component_id`` are returned.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tomewright.llm import arrays as A
from tomewright.llm.components import components
from tomewright.llm.frames import (few_tasks, give_back, slices, sum_vectors, vector_rows,
                                   written)

WORDS = 5
PERCENT = 75
#: Cells of the shingle counts, broadcast as one byte each.
CELLS = 1 << 21
#: Shingles that a light set may have at most.
LARGEST_BOUNDARY = 14
#: Sets of a list beyond which it is dealt over several, by the estimate of the counts.
LIST_SETS = 1 << 15
#: Sets from which a list is long; sets that meet in one group.
LONG_LIST = 32
GROUP_SETS = 1 << 11
#: Rounds in which a set of a long list is compared with its nearest of another component only.
NEAREST_ROUNDS = 3
#: Bits of the filter that picks the sets to be compared.
FILTER_BITS = 1 << 26

_SETS = T.StructType([T.StructField("doc_id", T.LongType()),
                      T.StructField("n_shingles", T.LongType()),
                      T.StructField("set_id", T.LongType()),
                      T.StructField("sketch", T.BinaryType())])
_WHOLE = -1  # the salt of a list that is not dealt over several
_ENTRIES = "list long, salt int, need int, size int, set_id long"
_LISTED = "list long, need int, size int, set_id long, hub_size int, hub long, more boolean"
_WIDE = 16  # narrow rows that one with a sketch or a set counts for


def needed(a: int, b: int, percent: int) -> int:
    """Shingles that sets of sizes a and b must share to link."""
    return -(-percent * (a + b) // (100 + percent))


def partners(size: int, percent: int) -> tuple[int, int]:
    """The least and greatest size that a set of ``size`` can link with."""
    return -(-percent * size // 100), 100 * size // percent


def prefix(size: int, percent: int) -> int:
    """Of how many shingles, in one order for all sets, linked sets share one."""
    return size - partners(size, percent)[0] + 1


def subset_sizes(size: int, boundary: int, percent: int) -> set[int]:
    """Sizes of the subsets that a light set lists."""
    low, high = partners(size, percent)
    return {needed(size, t, percent) for t in range(low, min(high, boundary) + 1)}


def row_sets(words: A.Words, n: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each row of a block."""
    runs = A.RunHash(words.hash)
    for lo, hi in zip(words.first[:-1], words.first[1:], strict=True):
        if hi == lo:
            yield np.zeros(0, np.uint64)
        else:
            at = np.arange(lo, max(hi - n, lo) + 1)
            yield np.unique(runs(at, np.minimum(at + n, hi)))


def set_id(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    return int(A.mix(A.mix(shingles).sum(keepdims=True))[0].astype(np.int64))


def sketch(shingles: np.ndarray) -> bytes:
    """Parities of the numbers of shingles in one to two cells a shingle, 256 at least.

    Every shingle that two sets do not share turns over one parity, so sketches differ in at most
    as many places as the sets. Those of sets with nothing in common differ in nearly half of the
    cells, while a link of 75 percent allows two sevenths of the shingles.
    """
    cells = 1 << max(8, (len(shingles) - 1).bit_length())
    counts = np.bincount((shingles % np.uint64(cells)).astype(np.int64), minlength=cells)
    return np.packbits((counts & 1).astype(bool), bitorder="little").tobytes()


def could_link(size_a: int, a: bytes, size_b: int, b: bytes, percent: int) -> bool:
    """False only where the sketches prove that two sets do not link."""
    while len(a) != len(b):  # parities of half as many cells
        if len(a) < len(b):
            a, b = b, a
        half = len(a) // 2
        a = (int.from_bytes(a[:half], "little") ^ int.from_bytes(a[half:], "little")).to_bytes(
            half, "little")
    differ = (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count()
    return (size_a + size_b - differ) // 2 >= needed(size_a, size_b, percent)


def distinct_sets(batches: Iterator[pa.RecordBatch], text: str,
                  n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each different, not empty set of a task once."""
    seen: set[int] = set()
    for batch in slices(batches):
        for _, _, words in A.block_words(batch.column(text), A.NOT_SPACE):
            for shingles in row_sets(words, n):
                if len(shingles) and (known := set_id(shingles)) not in seen:
                    seen.add(known)
                    yield known, shingles


def _documents(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, ids, sketches = [], [], []
            for _, _, words in A.block_words(batch.column("text"), A.NOT_SPACE):
                for shingles in row_sets(words, n):
                    sizes.append(len(shingles))
                    ids.append(set_id(shingles) if len(shingles) else None)
                    sketches.append(sketch(shingles) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()),
                 pa.array(sketches, pa.binary())], names=_SETS.names)

    return docs.mapInArrow(run, _SETS)


def shingle_counts(docs: DataFrame, n: int) -> np.ndarray:
    """How often shingles of different sets fall in each of ``CELLS`` cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, waiting, size = np.zeros(CELLS, np.int32), [], 0
        for _, shingles in distinct_sets(batches, "text", n):
            waiting.append(shingles)
            size += len(shingles)
            if size > CELLS:
                cells += np.bincount(_cell(np.concatenate(waiting)), minlength=CELLS)
                waiting, size = [], 0
        if waiting:
            cells += np.bincount(_cell(np.concatenate(waiting)), minlength=CELLS)
        yield vector_rows(cells)

    return sum_vectors(docs.select("text").mapInArrow(run, "block int, values binary"), CELLS,
                       np.int32)


def _cell(shingles: np.ndarray) -> np.ndarray:
    return (shingles % np.uint64(CELLS)).astype(np.int64)


def choose_boundary(sizes: dict[int, int], sharing: float, percent: int) -> int:
    """The boundary of least cost; ``sizes`` has the number of small sets by size."""
    def cost(boundary: int) -> float:
        total = 0.0
        for size, sets in sizes.items():
            if size <= boundary:
                total += sets * sum(math.comb(size, c)
                                    for c in subset_sizes(size, boundary, percent))
            if partners(size, percent)[1] > boundary:
                total += sets * prefix(size, percent) * sharing
        return total

    return min(range(LARGEST_BOUNDARY + 1), key=cost)


def _entries(docs: DataFrame, n: int, percent: int, boundary: int, order) -> DataFrame:
    """List places of heavy sets and subsets of light sets."""
    def rows_of(size: int, known: int, shingles: np.ndarray, weight: np.ndarray):
        if size <= boundary:
            parts = A.mix(shingles)
            for c in subset_sizes(size, boundary, percent):
                picks = np.array(list(itertools.combinations(range(size), c)))
                sums = parts[picks].sum(axis=1) + np.uint64(c)
                yield A.mix(sums), np.full(len(sums), _WHOLE, np.int32), c
        if partners(size, percent)[1] > boundary:
            level = weight[_cell(shingles)]
            first = np.lexsort((shingles, level))[:prefix(size, percent)]
            lists = np.maximum(1, (1 << level[first].astype(np.int64)) // LIST_SETS)
            salts = np.where(lists > 1, known % lists, _WHOLE)
            yield shingles[first], salts.astype(np.int32), 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for known, shingles in distinct_sets(batches, "text", n):
            for lists, salts, need in rows_of(len(shingles), known, shingles, order.value):
                waiting.append((lists, salts, need, len(shingles), known))
                size += len(lists)
            if size > 100_000:
                yield _entry_rows(waiting)
                waiting, size = [], 0
        if waiting:
            yield _entry_rows(waiting)

    return docs.select("text").mapInArrow(run, _ENTRIES)


def _entry_rows(waiting: list) -> pa.RecordBatch:
    count = [len(w[0]) for w in waiting]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([w[0] for w in waiting]).astype(np.int64)),
         pa.array(np.concatenate([w[1] for w in waiting])),
         *(pa.array(np.repeat(np.array([w[k] for w in waiting], kind), count))
           for k, kind in ((2, np.int32), (3, np.int32), (4, np.int64)))],
        names=["list", "salt", "need", "size", "set_id"])


def _lists(entries: DataFrame, percent: int, rows: int) -> DataFrame:
    """Entries that share a list, each with the set to compare it with.

    There are about ``rows`` entries. ``more`` tells lists of three and more sets, or dealt over
    several, from those whose only pair is a set and its hub.

    The sets of a subset come sorted by size and are compared with the first. Those of an inverted
    list come in an order that is the same for all lists and as good as random, so that near copies
    meet the same few hubs everywhere: each set is compared with the first that it could link with by
    its size, and is a hub itself if there is none.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the entry before
        hub: tuple | None = None   # its hub
        hubs: list[tuple] = []     # of its list
        begun: list[tuple] = []    # the first two of its list, until there is a third
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            key = columns[0]
            rows = len(key)
            # Entries whose list is theirs alone are most of all: they are found by array work.
            same = np.zeros(rows + 1, dtype=bool)
            same[1:rows] = (key[1:] == key[:-1]) & (columns[1][1:] == columns[1][:-1]) & (
                columns[2][1:] == columns[2][:-1])
            joined = np.flatnonzero(same[:rows] | same[1:] | (np.arange(rows) == 0)
                                    | (np.arange(rows) == rows - 1) | (columns[1] != _WHOLE))
            picked = list(zip(*(c[joined].tolist() for c in columns), strict=True))
            for row in picked:
                if last is not None and row[:3] == last[:3]:
                    if row[4] == last[4]:
                        continue  # one set from two tasks
                    if row[2] == 0:
                        hub = next((h for h in hubs if 100 * min(h[3], row[3])
                                    >= percent * max(h[3], row[3])), row)
                        if hub is row:
                            hubs.append(row)
                    if len(begun) == 2:
                        out.extend(_listed(*of, True) for of in begun)
                        begun = []
                    if begun:
                        begun.append((row, hub))
                    else:
                        out.append(_listed(row, hub, True))
                else:
                    out.extend(_short_list(begun))
                    hub, hubs, begun = row, [row], [(row, row)]
                last = row
            if out:
                yield _listed_rows(out)
        out = _short_list(begun)
        if out:
            yield _listed_rows(out)

    order = F.when(F.col("need") > 0, F.col("size")).otherwise(F.xxhash64("set_id"))
    return (few_tasks(entries.repartition("list", "salt"), rows)
            .sortWithinPartitions("list", "salt", "need", order, "set_id")
            .mapInArrow(run, _LISTED))


def _listed(row: tuple, hub: tuple, more: bool) -> tuple:
    return row[0], row[2], row[3], row[4], hub[3], hub[4], more


def _short_list(begun: list[tuple]) -> list[tuple]:
    """A list of two sets; parts of a dealt list are kept whatever their length."""
    if not begun or (len(begun) == 1 and begun[0][0][1] == _WHOLE):
        return []
    return [_listed(row, hub, row[1] != _WHOLE) for row, hub in begun]


def _listed_rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
        names=["list", "need", "size", "set_id", "hub_size", "hub", "more"])


def _filter_places(ids: np.ndarray) -> np.ndarray:
    """Two places in the filter for each id."""
    h = A.mix(ids.astype(np.uint64))
    return np.concatenate([h % np.uint64(FILTER_BITS), (h >> np.uint64(32)) % np.uint64(
        FILTER_BITS)]).astype(np.int64)


def _id_filter(pairs: DataFrame) -> np.ndarray:
    """Bits of the sets in ``pairs``; of a fixed size, whatever the number of pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            for k in range(2):
                at = _filter_places(batch.column(k).to_numpy(zero_copy_only=False))
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield vector_rows(bits)

    return sum_vectors(pairs.select("u", "v").mapInArrow(run, "block int, values binary"),
                       FILTER_BITS // 8, np.uint8, np.bitwise_or)


def _possible(pairs: DataFrame, members: DataFrame, percent: int, rows: int) -> DataFrame:
    """The about ``rows`` pairs (u, v) that their sets' sketches, some bits a shingle, leave possible."""
    sets = (members.where("set_id IS NOT NULL").groupBy("set_id")
            .agg(F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch")))
    one, two = (sets.select(F.col("set_id").alias(k), F.col("size").alias(f"size_{k}"),
                            F.col("sketch").alias(f"sketch_{k}")) for k in ("u", "v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)
            keep = pa.array([could_link(*row, percent) for row in rows], pa.bool_())
            yield batch.select([0, 1]).filter(keep)

    half = few_tasks(pairs.join(one, "u"), rows, _WIDE)
    both = few_tasks(half.join(two, "v"), rows, _WIDE).select("u", "v", "size_u", "sketch_u",
                                                              "size_v", "sketch_v")
    return written(both.mapInArrow(run, "u long, v long"), "possible")


def _shingles(docs: DataFrame, pairs: DataFrame, n: int, rows: int) -> DataFrame:
    """``id, shingles`` of the sets that the ``rows`` ``pairs`` (u, v) name, and of few others."""
    known = docs.sparkSession.sparkContext.broadcast(_id_filter(pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, shingles in distinct_sets(batches, "text", n):
            at = _filter_places(np.array([one]))
            if (known.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).all():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([one], pa.int64()),
                     pa.array([shingles.astype(np.int64)], pa.list_(pa.int64()))],
                    names=["id", "shingles"])

    sets = (docs.select("text").mapInArrow(run, "id long, shingles array<long>")
            .groupBy("id").agg(F.first("shingles").alias("shingles")))
    sets = written(few_tasks(sets, 2 * rows, _WIDE), "sets")
    known.destroy()
    return sets


def _linked(pairs: DataFrame, sets: DataFrame, percent: int, rows: int) -> DataFrame:
    """Those of ``rows`` pairs (u, v) that link, by whole sets."""
    one, two = (sets.select(F.col("id").alias(k), F.col("shingles").alias(f"of_{k}"))
                for k in ("u", "v"))
    shared = F.size(F.array_intersect("of_u", "of_v"))
    both = F.size("of_u") + F.size("of_v") - shared
    half = few_tasks(pairs.join(one, "u"), rows, _WIDE)
    return (few_tasks(half.join(two, "v"), rows, _WIDE)
            .where(100 * shared >= percent * both).select("u", "v"))


def jaccard_components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    members = written(_documents(docs, n), "members")
    counts = shingle_counts(docs, n)
    total = max(int(counts.sum(dtype=np.int64)), 1)
    # Beyond what chance puts in a cell, how many sets share a shingle on average.
    sharing = 1 + max(0.0, float((counts.astype(np.float64) ** 2).sum()) / total - 1
                      - total / CELLS)
    small = (members.where((F.col("n_shingles") > 0) & (F.col("n_shingles")
                                                        <= 2 * LARGEST_BOUNDARY))
             .groupBy("n_shingles").agg(F.approx_count_distinct("set_id").alias("sets")))
    boundary = choose_boundary({r["n_shingles"]: r["sets"] for r in small.collect()}, sharing,
                               percent)
    weight = np.zeros(CELLS, np.uint8)
    weight[counts > 0] = np.floor(np.log2(counts[counts > 0])).astype(np.uint8)
    order = spark.sparkContext.broadcast(weight)

    shingles = members.agg(F.sum("n_shingles")).first()[0] or 0
    listed = written(_lists(_entries(docs, n, percent, boundary, order), percent, shingles // 4),
                     "listed")
    rows = listed.count()
    apart = listed.where("set_id <> hub")
    subsets = (F.col("need") > 0) & ((100 + percent) * F.col("need")
                                     >= percent * (F.col("size") + F.col("hub_size")))
    pair = (F.col("set_id").alias("u"), F.col("hub").alias("v"))
    sure = few_tasks(apart.where(subsets).select(*pair).distinct(), rows)
    first = written(few_tasks(apart.where("need = 0").select(*pair).distinct(), rows), "pairs")
    first = _possible(first, members, percent, first.count())
    rows = first.count()
    links = written(sure.union(_linked(first, _shingles(docs, first, n, rows), percent, rows)),
                    "links")
    order.destroy()
    give_back()
    return _named(members, _joined(docs, listed, members, links, boundary, n, percent))


def _joined(docs: DataFrame, listed: DataFrame, members: DataFrame, links: DataFrame,
            boundary: int, n: int, percent: int) -> DataFrame:
    """``(node, root)`` of all links: those given, and those between their components.

    First each set is compared with the nearest one, by sketches, of another component in each of
    its lists; what links makes components larger. After some such rounds all pairs that are left
    between components are compared.
    """
    roots = written(components(links), "roots")
    sets = None
    rounds = [True] * NEAREST_ROUNDS + [False]
    while rounds:
        nearest = rounds.pop(0)
        pairs = written(_rest(listed, members, roots, sets, boundary, percent, nearest), "rest")
        rows = pairs.count()
        if not rows:
            break
        if sets is None:  # later rounds have no other sets
            sets = _shingles(docs, pairs, n, rows)
        more = written(_linked(pairs, sets, percent, rows), "links")
        if more.isEmpty():
            rounds = rounds[-1:] if nearest else []
        else:
            links = links.union(more)
            roots = written(components(links), "roots")
    return roots


def _rest(listed: DataFrame, members: DataFrame, roots: DataFrame, only: DataFrame | None,
          boundary: int, percent: int, nearest: bool) -> DataFrame:
    """Pairs of a list that could link by their sketches, are in different components and were not
    compared with their hub; of ``only`` these sets, if they are given.

    All pairs of a short list are few. A long one is dealt over blocks, and each two blocks meet in a
    group of their own, so no task holds a list. A pair of sets in several long lists comes from the
    first of these only.
    """
    roots = roots.select(F.col("node").alias("set_id"), "root")
    heavy = listed.where("need = 0 AND more").drop("more")
    rows = heavy.count()
    if only is not None:
        heavy = heavy.join(only.select(F.col("id").alias("set_id")), "set_id", "left_semi")
    rooted = few_tasks(heavy.join(roots, "set_id", "left"), rows).withColumn(
        "root", F.coalesce("root", "set_id"))
    of = Window.partitionBy("list")
    mixed = (rooted.withColumn("mixed", F.min("root").over(of) != F.max("root").over(of))
             .withColumn("sets", F.count("*").over(of)).where("mixed").drop("mixed"))
    rooted = written(few_tasks(mixed, rows), "rooted")
    short, long = (rooted.where(c) for c in (F.col("sets") <= LONG_LIST, F.col("sets") > LONG_LIST))
    pairs = _rest_of_short(short, members, boundary, percent).union(
        _rest_of_long(long, members, boundary, percent, nearest))
    return few_tasks(pairs.distinct(), rows)


def _rest_of_short(rooted: DataFrame, members: DataFrame, boundary: int,
                   percent: int) -> DataFrame:
    """Such pairs of lists that have few sets: all pairs are no more than some for each set."""
    x, y = (rooted.select("list", *[F.col(c).alias(f"{k}_{c}") for c in (
        "set_id", "size", "root", "hub")]) for k in "xy")
    could = ((F.col("x_set_id") < F.col("y_set_id")) & (F.col("x_root") != F.col("y_root"))
             & (100 * F.least("x_size", "y_size") >= percent * F.greatest("x_size", "y_size"))
             & (F.col("x_hub") != F.col("y_set_id")) & (F.col("y_hub") != F.col("x_set_id"))
             & ((F.col("x_size") > boundary) | (F.col("y_size") > boundary)))
    rows = rooted.count() * 4  # about
    pairs = few_tasks(x.join(y, "list"), rows).where(could).select(
        F.col("x_set_id").alias("u"), F.col("y_set_id").alias("v")).distinct()
    return _possible(pairs, members, percent, rows)


def _rest_of_long(rooted: DataFrame, members: DataFrame, boundary: int, percent: int,
                  nearest: bool) -> DataFrame:
    """Such pairs of lists that have many sets."""
    rows = rooted.count()
    if not rows:
        return rooted.select(F.col("set_id").alias("u"), F.col("hub").alias("v"))
    long = rooted.groupBy("set_id").agg(F.sort_array(F.collect_set("list")).alias("long"))
    sets = (members.where("set_id IS NOT NULL").join(long, "set_id").groupBy("set_id")
            .agg(F.first("sketch").alias("sketch"), F.first("long").alias("long")))
    blocks = F.ceil(F.col("sets") / GROUP_SETS).cast("int")
    own = F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    met = (few_tasks(rooted.withColumn("blocks", blocks).withColumn("own", own)
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .join(sets, "set_id"), rows, _WIDE)
           .select("list", F.least("own", "other").alias("one"), F.greatest("own", "other")
                   .alias("two"), "own", "set_id", "size", "root", "hub", "sketch", "long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            pairs = list(_group_pairs(group, boundary, percent, nearest))
            if pairs:
                u, v = zip(*pairs, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return (few_tasks(met.repartition("list", "one", "two"), rows, _WIDE)
            .sortWithinPartitions("list", "one", "two", "size", "set_id")
            .mapInArrow(run, "u long, v long"))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows that follow each other with the same first ``keys`` values, two at least."""
    group: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and row[:keys] != group[0][:keys]:
                if len(group) > 1:
                    yield group
                group = []
            group.append(row)
    if len(group) > 1:
        yield group


def _group_pairs(group: list[tuple], boundary: int, percent: int,
                 nearest: bool) -> Iterator[tuple[int, int]]:
    """Pairs of a group, sorted by size, that could link and are this group's to name.

    With ``nearest`` only one pair for each set.
    """
    for x, y in _near_by_sketch(group, percent, nearest):
        of, one, two, own_x, id_x, size_x, root_x, hub_x, sketch_x, long_x = x
        _, _, _, own_y, id_y, size_y, root_y, hub_y, sketch_y, long_y = y
        if (root_x == root_y or 100 * size_y < percent * size_x or hub_x == id_y or hub_y == id_x
                or size_x <= boundary or (one != two and own_x == own_y)
                or not could_link(size_x, sketch_x, size_y, sketch_y, percent)):
            continue
        if nearest or of == min(set(long_x).intersection(long_y)):
            yield min(id_x, id_y), max(id_x, id_y)


def _near_by_sketch(group: list[tuple], percent: int,
                    nearest: bool) -> Iterator[tuple[tuple, tuple]]:
    """Pairs to compare whose sketches, folded to the shortest length, are near."""
    own, ids, size, root, hub = (np.array([r[k] for r in group]) for k in (3, 4, 5, 6, 7))
    across = group[0][1] != group[0][2]
    width = min(len(r[8]) for r in group)
    bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(r[8], np.uint8).reshape(-1, width), axis=0)
                     for r in group]).view(np.uint64)
    first = np.searchsorted(100 * size, percent * size)  # the smallest that could link with each
    least = np.full(len(group), np.iinfo(np.int64).max)
    partner = np.full(len(group), -1)
    for k in range(1, len(group)):
        others = slice(first[k], k)
        differ = np.bitwise_count(bits[others] ^ bits[k]).sum(axis=1).astype(np.int64)
        both = size[others] + size[k]
        # ``needed`` of what they have in common, as in ``could_link``.
        near = (((both - differ) // 2 >= -(-percent * both // (100 + percent)))
                & (root[others] != root[k]) & (hub[others] != ids[k]) & (ids[others] != hub[k]))
        if across:
            near &= own[others] != own[k]
        found = np.flatnonzero(near)
        at = found + first[k]
        if not nearest:
            for j in at.tolist():
                yield group[k], group[j]
        elif len(at):
            best = int(np.argmin(differ[found]))
            if differ[found[best]] < least[k]:
                least[k], partner[k] = differ[found[best]], at[best]
            closer = differ[found] < least[at]
            least[at[closer]], partner[at[closer]] = differ[found[closer]], k
    for k in np.flatnonzero(partner >= 0).tolist():
        j = int(partner[k])
        yield (group[k], group[j]) if k > j else (group[j], group[k])


def _named(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Each document with the smallest id of its component."""
    sets = members.where("set_id IS NOT NULL").groupBy("set_id").agg(
        F.min("doc_id").alias("least"))
    rooted = sets.join(roots.select(F.col("node").alias("set_id"), "root"), "set_id", "left") \
        .withColumn("root", F.coalesce("root", "set_id"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("set_id", "root").join(names, "root").select("set_id", "component_id")
    return (members.join(named, "set_id", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("set_id").isNull(), F.col("doc_id"))
                    .otherwise(F.col("component_id")).alias("component_id")))
