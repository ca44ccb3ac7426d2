"""Keeping a knowledge base up to date from a stream of files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tomewright.config import KbConfig
from tomewright.operators import changes as ch
from tomewright.operators.changes import State, read_state
from tomewright.operators.tables import KnowledgeBase, read_kb, write_kb
from tomewright.plans.assemble import assemble_entries, resolve_collisions
from tomewright.plans.directory import plan_by_directory
from tomewright.sources.files import DEFAULT, inspect_files

FILES = "path string, extension string, size bigint, lines int, tokens bigint, hash string"
# What is known of every path that ever arrived, so that a late row cannot undo a newer one.
SEEN = f"{FILES}, modified timestamp, deleted boolean"


@dataclass(frozen=True)
class KbStore:
    """Versions of a knowledge base below ``path``, one folder per micro-batch.

    A version is complete before it is named in the log, and a batch that is run again writes
    its own version again, so a lost executor or a restart leaves no half-written state.
    """

    spark: SparkSession
    path: str

    def latest(self, before: int | None = None) -> int | None:
        try:
            log = self.spark.read.schema("batch bigint").parquet(f"{self.path}/log")
        except AnalysisException:
            return None
        if before is not None:
            log = log.where(F.col("batch") < before)
        return log.agg(F.max("batch")).first()[0]

    def folder(self, batch: int) -> str:
        return f"{self.path}/version-{batch:012d}"

    def seen(self, batch: int) -> DataFrame:
        """The newest row of every path, also of those that are gone or not read."""
        return self.spark.read.schema(SEEN).parquet(f"{self.folder(batch)}/seen")

    def files(self, batch: int) -> DataFrame:
        """The files that are read."""
        return self.seen(batch).where("hash IS NOT NULL AND NOT deleted").select(
            *StructType.fromDDL(FILES).names)

    def state(self, batch: int) -> State:
        return read_state(self.spark, f"{self.folder(batch)}/state")

    def report(self, batch: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder(batch)}/report")

    def kb(self, batch: int) -> KnowledgeBase:
        return read_kb(self.spark, self.folder(batch))

    def commit(self, batch: int) -> None:
        (self.spark.range(1).select(F.lit(batch).cast("long").alias("batch"))
         .write.mode("append").parquet(f"{self.path}/log"))


def refresh_batch(store: KbStore, arrived: DataFrame, batch: int, as_of: str,
                  cfg: KbConfig = DEFAULT, keep_manual: bool = False) -> None:
    """Bring the store up to date with ``arrived(path, content, size, modified[, deleted])``.

    The newest row of a path counts, by ``modified``, whenever it arrives; of rows of one time a
    deletion counts most, then the greatest hash. Files are redacted and hashed where they arrive
    and their text goes no further: no shuffle moves it and no table holds it, so planning reads
    little however large the corpus is.
    """
    gone = F.col("deleted") if "deleted" in arrived.columns else F.lit(False)
    arrived = arrived.select("path", "content", "size", "modified",
                             F.coalesce(gone, F.lit(False)).alias("deleted"))
    names = StructType.fromDDL(SEEN).names
    rows = inspect_files(arrived, cfg).select(*names)
    last, folder = store.latest(before=batch), store.folder(batch)
    if last is not None:
        rows = store.seen(last).unionByName(rows)
    when = F.struct("modified", "deleted", F.coalesce("hash", F.lit("")))
    (rows.groupBy("path").agg(F.max_by(F.struct(*[c for c in names if c != "path"]), when)
                              .alias("f")).select("path", "f.*")
     .write.mode("overwrite").parquet(f"{folder}/seen"))
    seen, files = store.seen(batch), store.files(batch)
    new = assemble_entries(resolve_collisions(plan_by_directory(files)), as_of)
    if last is None:
        write_kb(new, folder, "overwrite")
        report = ch.init_counts(new, files)
    else:
        # Files that are there but not read are walked all the same; they count when they arrive.
        came = arrived.select("path").distinct()
        unread = seen.where("hash IS NULL AND NOT deleted").select("path", "hash").join(
            came, "path", "left_semi")
        walked = files.select("path", "hash").unionByName(unread)
        ch.detect_changes(walked, ch.file_state(store.files(last))).write.mode("overwrite").parquet(
            f"{folder}/changes")
        found = store.spark.read.schema("path string, status string").parquet(f"{folder}/changes")
        existing = store.kb(last)
        stale = ch.stale_entries(existing, found, keep_manual=keep_manual)
        write_kb(ch.upsert_entries(existing, stale, new), folder, "overwrite")
        report = ch.refresh_report(existing, stale, new, files)
    report.write.mode("overwrite").parquet(f"{folder}/report")
    ch.write_state(files, store.kb(batch).entries, as_of, f"{folder}/state", mode="overwrite")
    store.commit(batch)


def stream_refresh(files: DataFrame, path: str, checkpoint: str, as_of: Callable[[int], str], *,
                   cfg: KbConfig = DEFAULT, keep_manual: bool = False) -> StreamingQuery:
    """Run ``refresh_batch`` on a streaming DataFrame of files until there is nothing new.

    ``as_of`` names the time of a batch, so that a batch run again writes the same.
    """
    def run(arrived: DataFrame, batch: int) -> None:
        refresh_batch(KbStore(arrived.sparkSession, path), arrived, batch, as_of(batch), cfg,
                      keep_manual)

    return (files.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
