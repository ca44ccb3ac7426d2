"""Token ids of documents in Parquet files.

The table is cut into ranges of ids, one file each, documents in ascending order. Columns:

* ``doc_id``, ``part`` (the file's number), ``local_start`` (ids before it in its file) and
  ``n_tokens``: delta encoding, so that they take a few bits a row;
* ``ids``, a list of 32-bit ids with the end id last: dictionary encoding, which packs an id into as
  many bits as the vocabulary needs.

Row groups and pages have set sizes and page indexes, so a reader that asks for some documents, or
for the numbers without the ids, reads only those pages. Beside the files lies an index with a row
per file: how many ids come before it. The position of a document in the stream of all ids is that
plus its ``local_start``.

Cases: null and empty texts have only the end id. Null doc_ids come first; ties go by a hash of the
text. An empty table gives no files. Other columns are not stored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tomewright.llm import pretokens as P
from tomewright.llm.bpe import list_array
from tomewright.llm.frames import map_arrow
from tomewright.llm.ordered import range_bounds, range_number

#: The id after each document.
END_ID = 2
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10

FILE = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("local_start", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType()))])


def library_classes() -> np.ndarray:
    """Classes of code points as the patterns of the tokenizers library see them."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    def find(pattern: str, text: str):
        probe = Split(Regex(f"{pattern}+"), "removed", invert=True)
        return (piece for piece, _ in probe.pre_tokenize_str(text))

    return P.classes(find)


def byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level names: printable Latin-1, then 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(others)}


class LibraryEncoder:
    """Ids by the tokenizers library; a distinct pre-token is given to it once."""

    def __init__(self, tokenizer_json: str, classes: np.ndarray):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer_json)
        self.library.encode_special_tokens = True
        self.model = self.library.model
        self.letters = {b: c for c, b in byte_letters().items()}
        self.classes, self.known = classes, P.Ids()

    def column(self, column: pa.Array):
        """``(from row, to row, ids, where the ids of each row begin)``, block by block."""
        for at, to, tokens in P.blocks(column, self.classes):
            ids, count = self.known.look_up(tokens, lambda places, t=tokens: self._new(t, places))
            yield at, to, ids, np.concatenate([[0], np.cumsum(count)])[tokens.first]

    def _new(self, tokens: P.PreTokens, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # The library's model takes a pre-token with a character for each byte.
        size = tokens.end[places] - tokens.start[places]
        letters = P.gather(tokens.data, tokens.start[places], size).tobytes().decode(
            "latin-1").translate(self.letters)
        cuts = np.concatenate([[0], np.cumsum(size)]).tolist()
        ids: list[int] = []
        counts = np.zeros(len(places), np.int64)
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            found = self.model.tokenize(letters[a:b])
            ids += [t.id for t in found]
            counts[k] = len(found)
        return np.array(ids, np.int32), counts


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, text: str = "text",
                 ranges: int | None = None, end_id: int = END_ID) -> None:
    """Encode ``docs`` (doc_id and ``text``) into files below ``path``, which must be new.

    Texts are dealt once, by ranges of ids, and encoded where their file is written.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        known = spark.sparkContext.broadcast((file.read(), library_classes()))
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(docs, "doc_id", n)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = LibraryEncoder(*known.value), 0
        for batch in batches:
            for at, to, ids, first in encoder.column(batch.column("text")):
                count = np.diff(first) + 1
                last = np.cumsum(count)
                out = np.full(int(last[-1]), end_id, np.int32)
                body = np.ones(len(out), dtype=bool)
                body[last - 1] = False
                out[body] = ids
                rows = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("part"),
                     pa.array(before + last - count), pa.array(count),
                     list_array([out], [count])], names=FILE.names)
                before += int(last[-1])

    writer = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
        .withColumn("part", range_number("doc_id", bounds))
        .repartitionById(len(bounds) + 1, F.col("part"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
        .mapInArrow(encode, FILE).write
        .option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES)
        .option("parquet.enable.dictionary", "true"))
    for name in FILE.names[:-1]:  # without a dictionary, whole numbers are written as deltas
        writer = writer.option(f"parquet.enable.dictionary#{name}", "false")
    writer.parquet(f"{path}/tokens")
    sizes = (spark.read.schema(FILE).parquet(f"{path}/tokens").groupBy("part")
             .agg(F.sum("n_tokens").alias("n_tokens")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    (sizes.select("part", "n_tokens", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))
                  .alias("tokens_before")).coalesce(1).write.parquet(f"{path}/index"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids``.

    Select what is needed: columns and rows that are not asked for are not read.
    """
    index = spark.read.parquet(f"{path}/index").select("part", "tokens_before")
    return (spark.read.schema(FILE).parquet(f"{path}/tokens")
            .join(F.broadcast(index), "part")  # a row per file
            .select("doc_id", (F.col("tokens_before") + F.col("local_start")).alias("start"),
                    "n_tokens", "ids"))


def with_crc32(tokens: DataFrame, ids: str = "ids", name: str = "ids_crc32") -> DataFrame:
    """crc32 of the ids as little-endian unsigned 32-bit numbers."""
    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        column = batch.column(ids)
        values = memoryview(np.asarray(column.flatten()).astype("<u4").tobytes())
        lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        cuts = 4 * np.concatenate([[0], np.cumsum(lengths)])
        return {name: pa.array([zlib.crc32(values[a:b])
                                for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.int64())}

    return map_arrow(tokens, run, T.StructType([T.StructField(name, T.LongType())]))
