"""Alignment of two tokenizers over a corpus: which of their tokens cover the same text.

Each text is encoded by a byte-level vocabulary (A) and by a piece model (B) to the same bytes. Two
products of sparse matrices, hand-built by compressed rows (``csr``), say what belongs together:

* tokens of A by bytes, times bytes by tokens of B: the *overlap* links, and how many bytes each has;
* ids of A by groups, times groups by ids of B: the *shared-group* links. A group is a shortest
  stretch of bytes at whose end tokens of both end. Entries count how often an id occurs in a group,
  so the product counts links of occurrences without listing them.

A pair's count is the number of documents that hold it linked. Documents are encoded once, into a
written table of their pairs; each task adds up its pairs before they are shuffled. Counts come back to
documents in two ways. The most frequent pairs, at most ``FREQUENT``, are broadcast: they are nearly
all occurrences. Any other pair is in few documents, fewer than each of those, so it is joined with its
documents by a shuffle in which no key is hot.

Cases: texts that are null, empty, or whose tokens do not give back the text (as one that holds
U+2581, which B takes for a space) have no tokens and zeros. Very long texts are encoded word by word;
memory is that of their tokens. Repeated rows and null ids count as rows of their own. An empty
table gives an empty table. Columns with the names of added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomewright.llm import arrays as A
from tomewright.llm.bpe import list_array
from tomewright.llm.csr import Csr
from tomewright.llm.frames import internal, map_arrow, written
from tomewright.llm.pretokens import Ids, PreTokens, gather
from tomewright.llm.token_files import LibraryEncoder, byte_letters, library_classes

#: Pairs whose counts are broadcast; 16 bytes each.
FREQUENT = 400_000
#: Pairs that a task adds up before it passes them on.
_TASK_PAIRS = 500_000
_SPACE = "▁"

DIGEST = T.StructType([
    *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_overlaps")],
    T.StructField("groups", T.StringType())])
PAIRS = T.StructType([
    T.StructField("pair_a", T.ArrayType(T.IntegerType())),
    T.StructField("pair_b", T.ArrayType(T.IntegerType())),
    T.StructField("pair_links", T.ArrayType(T.LongType()))])


class PieceEncoder:
    """Ids of the pieces of " " + text, and their bytes.

    No piece of the vocabulary goes over the place in front of a space that follows another
    character, so texts are cut there and each distinct word is encoded once. Models for which that
    does not hold encode whole texts.
    """

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_proto=model)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        plain = "  　ﬁ\tÁ \n"
        self.by_word = (not any(_SPACE in p.lstrip(_SPACE) for p in pieces)
                        and self.library.normalize(plain) == (" " + plain).replace(" ", _SPACE))
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else
                      b"" if self.library.is_control(i) or self.library.is_unknown(i)
                      else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        # A space at the end of a text, which the library gives only behind something.
        self.last_space = self.library.encode("a ")[len(self.library.encode("a")):]
        self.known = Ids()

    def words(self, data: np.ndarray, offsets: np.ndarray) -> PreTokens:
        """The separately encoded parts of rows; each begins with a space."""
        begins = offsets[:-1][np.diff(offsets) > 0]
        if self.by_word:
            space = data == 0x20
            start = space.copy()
            start[1:] &= ~space[:-1]
            start[begins] = True
            begins = np.flatnonzero(start)
        end = np.append(begins, len(data))[1:]
        return PreTokens(data, begins, end, np.searchsorted(begins, offsets),
                         A.ByteRuns(data)(begins, end))

    def encode(self, data: np.ndarray, offsets: np.ndarray):
        """``(ids, number of ids of each row, whether each row is given back)``; rows are bytes."""
        parts = self.words(data, offsets)
        ids, count = self.known.look_up(parts, lambda places: self._new(parts, places))
        totals = np.concatenate([[0], np.cumsum(count)])[parts.first]
        losses = np.concatenate([[0], np.cumsum(count == 0)])[parts.first]
        return ids, np.diff(totals), np.diff(losses) == 0

    def _new(self, parts: PreTokens, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some parts; none of a part that they do not give back."""
        out, counts, texts = [], [], parts.texts(places)
        for at in range(0, len(texts), 4096):
            some = texts[at:at + 4096]
            for part, ids in zip(some, self.library.encode([p[1:].decode() for p in some],
                                                           num_threads=1), strict=True):
                if part == b" ":
                    ids = self.last_space
                same = b"".join([self.bytes[i] for i in ids]) == part
                out += ids if same else []
                counts.append(len(ids) if same else 0)
        return np.array(out, np.int32), np.array(counts, np.int64)


@dataclass
class Tokens:
    """Tokens of the usable rows of a block: ids and ends in its bytes, and their numbers by row."""

    ids: np.ndarray
    end: np.ndarray
    count: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def incidence(self) -> Csr:
        """Tokens by bytes."""
        first = np.concatenate([[0], self.end])
        return Csr(first, np.arange(first[-1]), np.ones(first[-1], np.int32), int(first[-1]))


class Aligner:
    """Aligns the texts of a task."""

    def __init__(self, tokenizer_json: str, classes: np.ndarray, model: bytes):
        self.a = LibraryEncoder(tokenizer_json, classes)
        self.b = PieceEncoder(model)
        sizes = self.a.library.get_vocab_size()
        letters = byte_letters()
        names = [self.a.library.id_to_token(i) for i in range(sizes)]
        entries = [bytes(letters[c] for c in n) if set(n) <= letters.keys() else n.encode()
                   for n in names]
        self.a_size = np.array([len(e) for e in entries], np.int64)
        self.a_first = np.cumsum(self.a_size) - self.a_size
        self.a_bytes = np.frombuffer(b"".join(entries), np.uint8)
        largest = max(sizes, len(self.b.bytes))
        digits = [str(i).encode() for i in range(largest)]
        self.digit_size = np.array([len(d) for d in digits], np.int64)
        self.digit_first = np.cumsum(self.digit_size) - self.digit_size
        self.digits = np.frombuffer(b"".join(digits), np.uint8)

    def column(self, texts: pa.Array) -> dict[str, pa.Array]:
        """All columns of ``DIGEST`` and ``PAIRS`` for a text column."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        spaced = pc.binary_join_element_wise(
            pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        data, offsets = A.text_buffer(spaced)
        parts = [self._block(data, offsets, empty, at, to, ids, first)
                 for at, to, ids, first in self.a.column(spaced)]
        out = {name: np.concatenate([p[name] for p in parts]) if parts else np.zeros(0, np.int64)
               for name in DIGEST.names[:-1]}
        made = {name: pa.array(v.astype(np.int64)) for name, v in out.items()}
        made["groups"] = pa.array([g for p in parts for g in p["groups"]], pa.string())
        counts = [p["pairs"] for p in parts]
        for name, kind in zip(PAIRS.names, (pa.int32(), pa.int32(), pa.int64()), strict=True):
            made[name] = list_array([p[name] for p in parts], counts, kind)
        return made

    def _block(self, data, offsets, empty, at, to, a_ids, a_first) -> dict[str, np.ndarray]:
        offsets = offsets[at:to + 1]
        data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
        b_ids, b_count, usable = self.b.encode(data, offsets)
        a_count, size = np.diff(a_first), np.diff(offsets)
        usable &= ~empty[at:to] & self._given_back(data, offsets, a_ids, a_first)
        a = self._tokens(a_ids, a_count, usable, self.a_size)
        b = self._tokens(b_ids, b_count, usable, self.b.size)
        rows = int(usable.sum())
        # Groups end where tokens of both do; the ends of rows are among them.
        ends = np.intersect1d(a.end, b.end, assume_unique=True)
        a_group, b_group = np.searchsorted(ends, a.end), np.searchsorted(ends, b.end)
        row_of_group = np.searchsorted(np.cumsum(size[usable]), ends)
        found = {"n_a": a.count, "n_b": b.count,
                 "n_groups": np.bincount(row_of_group, minlength=rows),
                 "n_overlaps": self._overlaps(a, b, rows)}
        pair_row, pair_a, pair_b, links = self._pairs(a, b, a_group, b_group, len(ends))
        found["n_links"] = _sum_by(pair_row, links, rows)
        pairs = np.zeros(to - at, np.int64)
        pairs[usable] = np.bincount(pair_row, minlength=rows)
        out = {name: np.zeros(to - at, np.int64) for name in found}
        for name, values in found.items():
            out[name][usable] = values
        texts = np.full(to - at, "", object)
        texts[usable] = self._lines(a, b, a_group, b_group)
        return {**out, "groups": texts.tolist(), "pairs": pairs, "pair_a": pair_a,
                "pair_b": pair_b, "pair_links": links}

    def _given_back(self, data, offsets, ids, first) -> np.ndarray:
        """Whether the joined bytes of A's tokens are those of each row."""
        size = self.a_size[ids]
        joined = np.concatenate([[0], np.cumsum(size)])[first]
        same = np.diff(joined) == np.diff(offsets)
        if same.all():  # then all rows stand at the same places in both
            differ = gather(self.a_bytes, self.a_first[ids], size) != data
            return np.diff(np.concatenate([[0], np.cumsum(differ)])[offsets]) == 0
        out = gather(self.a_bytes, self.a_first[ids], size)
        for k in np.flatnonzero(same):
            same[k] = np.array_equal(out[joined[k]:joined[k + 1]], data[offsets[k]:offsets[k + 1]])
        return same

    @staticmethod
    def _tokens(ids: np.ndarray, count: np.ndarray, usable: np.ndarray,
                size: np.ndarray) -> Tokens:
        ids = ids[np.repeat(usable, count)]
        return Tokens(ids, np.cumsum(size[ids]), count[usable])

    @staticmethod
    def _overlaps(a: Tokens, b: Tokens, rows: int) -> np.ndarray:
        """Overlap links of each row: entries of tokens by bytes times bytes by tokens."""
        out, row = np.zeros(rows, np.int64), a.row
        for tokens, _, _ in a.incidence().times(_transposed_cover(b)):
            out += np.bincount(row[tokens], minlength=rows)
        return out

    @staticmethod
    def _pairs(a: Tokens, b: Tokens, a_group: np.ndarray, b_group: np.ndarray, groups: int):
        """``(row, id of A, id of B, links)`` of all linked pairs of ids within a row."""
        (a_key, a_row), (b_key, b_row) = (np.unique(
            (t.row.astype(np.int64) << 32) | t.ids, return_inverse=True) for t in (a, b))
        left = Csr.of(a_row, a_group, len(a_key), groups)
        right = Csr.of(b_group, b_row, groups, len(b_key))
        parts = list(left.times(right))
        none = np.zeros(0, np.int64)
        i, j, links = (np.concatenate([none, *(p[k] for p in parts)]) for k in range(3))
        low = (1 << 32) - 1
        return a_key[i] >> 32, a_key[i] & low, b_key[j] & low, links

    def _lines(self, a: Tokens, b: Tokens, a_group: np.ndarray,
               b_group: np.ndarray) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each row."""
        if not len(a.ids):
            return [""] * len(a.count)
        key = np.concatenate([2 * a_group, 2 * b_group + 1])
        order = np.argsort(key, kind="stable")
        key, ids = key[order], np.concatenate([a.ids, b.ids])[order]
        # A mark follows each id: "," within a side, "|" after A, ";" after B.
        mark = np.where(key % 2 == 0, ord("|"), ord(";")).astype(np.uint8)
        mark[:-1][key[1:] == key[:-1]] = ord(",")
        size = self.digit_size[ids]
        last = np.cumsum(size + 1) - 1
        out = np.empty(int(last[-1]) + 1, np.uint8)
        out[last] = mark
        body = np.ones(len(out), dtype=bool)
        body[last] = False
        out[body] = gather(self.digits, self.digit_first[ids], size)
        cuts = last[np.cumsum(a.count + b.count) - 1] if len(a.count) else last[:0]
        line, at = out.tobytes().decode(), 0
        lines = []
        for cut in cuts.tolist():
            lines.append(line[at:cut])
            at = cut + 1
        return lines


def _transposed_cover(b: Tokens) -> Csr:
    """Bytes by tokens: the transposed incidence, whose rows have one entry each."""
    size = np.diff(np.concatenate([[0], b.end]))
    n = int(size.sum())
    return Csr(np.arange(n + 1), np.repeat(np.arange(len(size)), size), np.ones(n, np.int32),
               len(size))


def _sum_by(row: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """Whole-number sums; ``row`` is in order."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return np.diff(sums[np.searchsorted(row, np.arange(rows + 1))])


def align(docs: DataFrame, tokenizer_path: str, model_path: str, text: str = "text") -> DataFrame:
    """``docs`` with their numbers of tokens, groups and links, the groups, and linked pairs of ids.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``. ``pair_a``, ``pair_b`` and ``pair_links`` are parallel
    lists: two ids, and how many links between their occurrences the document has.
    """
    with open(tokenizer_path, encoding="utf-8") as json, open(model_path, "rb") as model:
        known = docs.sparkSession.sparkContext.broadcast(
            (json.read(), library_classes(), model.read()))
    kept: list[Aligner] = []

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        if not kept:
            kept.append(Aligner(*known.value))
        return kept[0].column(batch.column(text))

    return map_arrow(docs, run, T.StructType([*DIGEST, *PAIRS]))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``a, b, docs, best``: documents that hold a pair linked; whether no pair of ``a`` has more."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        size = 0

        def merged():
            found, place = np.unique(np.concatenate([keys, *waiting]), return_inverse=True)
            weight = np.concatenate([counts, np.ones(size, np.int64)])
            return found, np.bincount(place, weight).astype(np.int64)

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array((keys >> 32).astype(np.int32)),
                 pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(counts)],
                names=["a", "b", "docs"])

        for batch in batches:
            a, b = (np.asarray(batch.column(k).flatten()).astype(np.int64) for k in (0, 1))
            waiting.append((a << 32) | b)
            size += len(a)
            if size > _TASK_PAIRS:
                keys, counts = merged()
                waiting, size = [], 0
                if len(keys) > _TASK_PAIRS:
                    yield out()
                    keys, counts = keys[:0], counts[:0]
        keys, counts = merged()
        if len(keys):
            yield out()

    counts = (aligned.select("pair_a", "pair_b").mapInArrow(add, "a int, b int, docs long")
              .groupBy("a", "b").agg(F.sum("docs").alias("docs")))
    counts = written(counts, "pairs")
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return written(counts.join(most, "a").select("a", "b", "docs", (F.col("docs") == F.col("most"))
                                                 .alias("best")), "pair-counts")


def _threshold(counts: DataFrame, limit: int) -> float:
    """A number of documents that at most ``limit`` pairs have or exceed.

    Numbers of documents are looked at in steps of a hundredth, of which there are few.
    """
    step = F.floor(F.log(F.col("docs").cast("double")) * 100)
    total, least = 0, float("inf")
    for row in counts.groupBy(step.alias("step")).agg(
            F.count("*").alias("n"), F.min("docs").alias("docs")).orderBy(F.desc("step")).collect():
        total += row["n"]
        if total > limit:
            break
        least = row["docs"]
    return least


def with_counts(aligned: DataFrame, counts: DataFrame, row: str,
                limit: int = FREQUENT) -> DataFrame:
    """``row`` (a number of its own for each row of ``aligned``) with ``n_best`` and ``count_sum``.

    ``n_best`` is the number of links whose pair no other pair of its A id exceeds, ``count_sum`` the
    sum of pair counts over all links.
    """
    least = _threshold(counts, limit)
    high = counts.where(F.col("docs") >= least).select("a", "b", "docs", "best").toArrow()
    key = (high["a"].to_numpy().astype(np.int64) << 32) | high["b"].to_numpy()
    order = np.argsort(key)
    known = aligned.sparkSession.sparkContext.broadcast(
        (key[order], high["docs"].to_numpy()[order],
         high["best"].to_numpy(zero_copy_only=False).astype(bool)[order]))
    sums = [T.StructField(c, T.LongType()) for c in ("n_best", "count_sum")]
    rest = T.StructField("rest", T.ArrayType(T.StructType([
        T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()),
        T.StructField("links", T.LongType())])))

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        keys, docs, best = known.value
        a, b, links = (np.asarray(batch.column(c).flatten()).astype(np.int64)
                       for c in PAIRS.names)
        count = pc.list_value_length(batch.column("pair_a")).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(count)), count)
        pair = (a << 32) | b
        at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
        hit = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
        value, top = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
        value[hit] = links[hit] * docs[at[hit]]
        top[hit] = links[hit] * best[at[hit]]
        left = ~hit
        offsets = np.searchsorted(owner[left], np.arange(len(count) + 1)).astype(np.int32)
        items = pa.StructArray.from_arrays(
            [pa.array(a[left].astype(np.int32)), pa.array(b[left].astype(np.int32)),
             pa.array(links[left])], names=["a", "b", "links"])
        return {"n_best": pa.array(_sum_by(owner, top, len(count))),
                "count_sum": pa.array(_sum_by(owner, value, len(count))),
                "rest": pa.ListArray.from_arrays(pa.array(offsets), items)}

    def mapped(*names: str) -> DataFrame:
        pairs = aligned.select(row, *PAIRS.names)
        return map_arrow(pairs, run, T.StructType([*sums, rest])).select(row, *names)

    near = mapped("n_best", "count_sum")
    far = (mapped(F.explode("rest").alias("rest")).select(row, "rest.*")
           .join(counts.where(F.col("docs") < least), ["a", "b"])
           .select(row, (F.col("links") * F.col("best").cast("long")).alias("n_best"),
                   (F.col("links") * F.col("docs")).alias("count_sum")))
    return near.unionByName(far).groupBy(row).agg(
        *[F.sum(c.name).alias(c.name) for c in sums])


def align_corpus(docs: DataFrame, tokenizer_path: str, model_path: str, text: str = "text",
                 keep: Callable[[DataFrame], DataFrame] | None = None,
                 limit: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """``docs`` with all columns of ``align`` and the corpus-wide ``n_best`` and ``count_sum``; and
    the table of ``pair_counts``.

    ``keep`` may shorten what is stored of aligned documents; the pairs must stay.
    """
    row = internal(docs, "__row")
    aligned = align(docs.withColumn(row, F.monotonically_increasing_id()), tokenizer_path,
                    model_path, text)
    aligned = written(keep(aligned) if keep else aligned, "aligned")
    counts = pair_counts(aligned)
    names = [c for c in aligned.columns if c.lower() not in ("n_best", "count_sum")]
    sums = with_counts(aligned, counts, row, limit)
    return aligned.select(*names).join(sums, row).drop(row), counts
