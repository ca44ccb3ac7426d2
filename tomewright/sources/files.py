"""The file corpus: where files come from, and which of them are read."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.config import KbConfig
from tomewright.functions import paths, secrets, text
from tomewright.operators.ordering import freeze

DEFAULT = KbConfig()


def is_walked(path: Column, cfg: KbConfig = DEFAULT) -> Column:
    """Files a walk of the tree visits: not ignored, and of a wanted suffix."""
    keep = ~paths.is_ignored(path, cfg.all_ignored)
    if cfg.include_extensions:
        keep &= paths.extension(path).isin(list(cfg.include_extensions))
    return keep


def filter_ignored(files: DataFrame, patterns: list[str]) -> DataFrame:
    return files.where(~paths.is_ignored(F.col("path"), patterns))


def filter_extensions(files: DataFrame, extensions: list[str]) -> DataFrame:
    if not extensions:
        return files
    return files.where(paths.extension(F.col("path")).isin(extensions))


def drop_sensitive(files: DataFrame) -> DataFrame:
    return files.where(~secrets.is_sensitive_path(F.col("path")))


def filter_size(files: DataFrame, limit: int = DEFAULT.max_file_bytes) -> DataFrame:
    return files.where(F.col("size") <= limit)


def decode_utf8(content: Column) -> Column:
    """Bytes as text, with U+FFFD in place of what is not UTF-8."""
    return F.make_valid_utf8(content.cast("string"))


def files_from_table(df: DataFrame, path: str = "path", content: str = "content",
                     size: str | None = None) -> DataFrame:
    """Any table of paths and texts as a corpus: ``path, content, size`` (bytes)."""
    return df.select(F.col(path).alias("path"), F.col(content).alias("content"),
                     (F.col(size) if size else F.octet_length(content))
                     .cast("long").alias("size"))


def dropped_files(files: DataFrame, cfg: KbConfig = DEFAULT) -> DataFrame:
    """``reason, n_files, bytes`` of files that are not read; the first reason of a file counts."""
    path = F.col("path")
    wanted = F.lit(True)
    if cfg.include_extensions:
        wanted = paths.extension(path).isin(list(cfg.include_extensions))
    reason = (F.when(paths.is_ignored(path, cfg.all_ignored), F.lit("ignored"))
              .when(~wanted, F.lit("extension")).when(secrets.is_sensitive_path(path),
                                                      F.lit("sensitive"))
              .when(F.col("size") > cfg.max_file_bytes, F.lit("too large"))
              .when(F.col("content").isNull(), F.lit("unreadable")))
    return (files.select(reason.alias("reason"), "size").where("reason IS NOT NULL")
            .groupBy("reason").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes")))


def scan_corpus(spark: SparkSession, root: str, cfg: KbConfig = DEFAULT, *,
                skip_unreadable: bool = False) -> DataFrame:
    """Files below ``root`` that a walk visits: ``path, content, size, modified``.

    A file that cannot be read fails the job, unless ``skip_unreadable`` says to leave it out.

    Names and sizes are tested on ``_metadata``, which drops files while they are listed: ignored
    ones are never opened, and neither are sensitive and oversize ones. The latter are part of the
    walk, which change detection needs, and come with null content. Spark's file source lists no
    empty files and none whose name starts with a dot or underscore; ``walk_corpus`` does.
    """
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
           .option("ignoreCorruptFiles", skip_unreadable)
           .option("ignoreMissingFiles", skip_unreadable).load(root))
    base = root.split(":", 1)[-1].rstrip("/") + "/"
    listed_as = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    path = F.substring(listed_as, F.locate(base, listed_as) + len(base), F.lit(2147483647))
    opened = (~secrets.is_sensitive_path(path)
              & (F.col("_metadata.file_size") <= cfg.max_file_bytes))

    def rows(which: Column, content: Column) -> DataFrame:
        return raw.where(is_walked(path, cfg) & which).select(
            path.alias("path"), content.alias("content"),
            F.col("_metadata.file_size").alias("size"),
            F.col("_metadata.file_modification_time").alias("modified"))

    return rows(opened, decode_utf8(F.col("content"))).unionByName(
        rows(~opened, F.lit(None).cast("string")))


def _list_folders(root: str):
    def listing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for folder in b["path"]:
                with os.scandir(os.path.join(root, folder)) as found:
                    rows = [(os.path.join(folder, e.name), e.is_dir(follow_symlinks=False),
                             e.stat(follow_symlinks=False))
                            for e in found if not e.is_symlink()]
                yield pd.DataFrame({
                    "path": [r[0] for r in rows], "folder": [r[1] for r in rows],
                    "size": [r[2].st_size for r in rows],
                    "micros": [r[2].st_mtime_ns // 1000 for r in rows]})

    return listing


def _read_files(root: str, batch_bytes: int = 32 << 20):
    def reading(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, paths_, held = [], [], 0
        for b in batches:
            for path in b["path"]:
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        data = f.read()
                except OSError:
                    continue
                paths_.append(path)
                texts.append(data.decode("utf-8", "replace"))
                held += len(data)
                if held >= batch_bytes:
                    yield pd.DataFrame({"path": paths_, "content": texts})
                    texts, paths_, held = [], [], 0
        yield pd.DataFrame({"path": paths_, "content": texts})

    return reading


def walk_corpus(spark: SparkSession, root: str, cfg: KbConfig = DEFAULT) -> DataFrame:
    """Like ``scan_corpus`` for a folder mounted on all executors, with every file there is.

    Folders are listed level by level, those of a level in parallel; ignored ones are not entered,
    and only files that pass the tests on name and size are opened.
    """
    columns = "path string, folder boolean, size bigint, micros bigint"
    level = spark.range(1).select(F.lit("").alias("path"))
    levels = []
    while True:
        found = level.mapInPandas(_list_folders(root), columns).where(
            ~paths.is_ignored(F.col("path"), cfg.all_ignored))
        found = freeze(found)
        levels.append(found.where(~F.col("folder")))
        folders = found.where("folder").select("path")
        if folders.isEmpty():
            break
        level = folders.repartition("path")
    walked = reduce(DataFrame.unionByName, levels).where(is_walked(F.col("path"), cfg))
    readable = walked.where(~secrets.is_sensitive_path(F.col("path"))
                            & (F.col("size") <= cfg.max_file_bytes)).select("path")
    texts = readable.repartition("path").mapInPandas(_read_files(root), "path string, content string")
    return walked.join(texts, "path", "left").select(
        "path", "content", "size", F.timestamp_micros("micros").alias("modified"))


def is_readable(cfg: KbConfig = DEFAULT) -> Column:
    """Files whose text is used: not sensitive by name, not too large, and there to be read."""
    return (~secrets.is_sensitive_path(F.col("path")) & (F.col("size") <= cfg.max_file_bytes)
            & F.col("content").isNotNull())


def _derived() -> list[Column]:
    content = F.col("content")
    return [text.count_lines(content).alias("lines"),
            text.estimate_tokens(content).alias("tokens"),
            text.content_hash(content).alias("hash")]


def prepare_files(files: DataFrame, cfg: KbConfig = DEFAULT) -> DataFrame:
    """Readable files with redacted content, and what is derived from it.

    Narrow from end to end: one pass over the corpus, no shuffle. Columns that are not asked for
    later are pruned, down to not redacting at all when only paths are used.
    """
    read = files.where(is_walked(F.col("path"), cfg) & is_readable(cfg))
    kept = secrets.redact(read.select("path", "size", "content"), "content")
    return kept.select("path", paths.extension(F.col("path")).alias("extension"), "size",
                       *_derived(), "content")


def inspect_files(files: DataFrame, cfg: KbConfig = DEFAULT) -> DataFrame:
    """Every walked file without its text; what derives from the text is null if it is not read.

    Columns other than ``content`` are kept.
    """
    walked = files.where(is_walked(F.col("path"), cfg))
    read = walked.withColumn("content", F.when(is_readable(cfg), F.col("content")))
    kept = [c for c in files.columns if c != "content"]
    return secrets.redact(read, "content").select(
        *kept, paths.extension(F.col("path")).alias("extension"), *_derived())


def fingerprints(files: DataFrame, cfg: KbConfig = DEFAULT) -> DataFrame:
    """Every walked path with the hash of its redacted text, null where it is not read."""
    return inspect_files(files.select("path", "size", "content"), cfg).select("path", "hash")
