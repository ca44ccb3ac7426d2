"""What changed since the last run, and what to do about it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.operators.tables import KnowledgeBase


def detect_changes(walked: DataFrame, prior: DataFrame, *,
                   exclude_dropped: bool = False) -> DataFrame:
    """``path, status`` of files that were added, changed or removed.

    ``walked`` is ``sources.files.fingerprints``: every walked path, with a null hash where the
    file is not read. Such a file is in no stored state, so it counts as added every time; set
    ``exclude_dropped`` to leave it out. One that was read before and no longer is, is no change.
    """
    now = walked.select("path", F.col("hash").alias("__now"), F.lit(True).alias("__walked"))
    was = prior.select("path", F.col("hash").alias("__was"), F.lit(True).alias("__known"))
    added = F.col("__known").isNull()
    if exclude_dropped:
        added &= F.col("__now").isNotNull()
    status = (F.when(F.col("__walked").isNull(), F.lit("removed"))
              .when(added, F.lit("added"))
              .when(F.col("__known") & (F.col("__now") != F.col("__was")), F.lit("changed")))
    return (now.join(was, "path", "full_outer").select("path", status.alias("status"))
            .where(F.col("status").isNotNull()))


def changed_paths(changes: DataFrame, vcs_paths: DataFrame | None = None) -> DataFrame:
    """Changed and added paths, and those that version control names as well."""
    own = changes.where(F.col("status") != "removed").select("path")
    return (own if vcs_paths is None else own.unionByName(vcs_paths.select("path"))).distinct()


def removed_paths(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("status") == "removed").select("path")


def is_up_to_date(changes: DataFrame, vcs_paths: DataFrame | None = None) -> bool:
    return changes.isEmpty() and (vcs_paths is None or vcs_paths.isEmpty())


def stale_entries(kb: KnowledgeBase, changes: DataFrame, vcs_paths: DataFrame | None = None, *,
                  keep_manual: bool = False) -> DataFrame:
    """``filename`` of entries to drop: any source changed or went away, or there are none.

    Entries without sources are those added by hand; ``keep_manual`` spares them.
    """
    touched = changed_paths(changes, vcs_paths).unionByName(removed_paths(changes))
    by_source = kb.sources.join(touched, F.col("value") == F.col("path"), "left_semi")
    stale = by_source.select("filename")
    if not keep_manual:
        manual = kb.entries.select("filename").join(kb.sources, "filename", "left_anti")
        stale = stale.unionByName(manual)
    return stale.distinct()


def upsert_entries(existing: KnowledgeBase, stale: DataFrame, new: KnowledgeBase) -> KnowledgeBase:
    """The old entries but the stale ones, with all new entries written over them."""
    replaced = stale.select("filename").unionByName(new.entries.select("filename"))
    return existing.without(replaced).plus(new)


def one_row(metrics: dict[str, DataFrame | tuple[DataFrame, Column]]) -> DataFrame:
    """Counts (or sums of a column) of several tables, side by side in one row."""
    parts = []
    for name, what in metrics.items():
        df, value = what if isinstance(what, tuple) else (what, F.lit(1))
        parts.append(df.select(F.lit(name).alias("m"), value.cast("long").alias("v")))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.agg(*[F.coalesce(F.sum(F.when(F.col("m") == name, F.col("v"))), F.lit(0))
                      .alias(name) for name in metrics])


def refresh_report(existing: KnowledgeBase, stale: DataFrame, new: KnowledgeBase,
                   file_state: DataFrame) -> DataFrame:
    """Counters of an update. ``entries_created_ref`` is the customary figure, which counts what
    was removed; ``entries_created`` counts entries that were not there before."""
    created = new.entries.join(existing.entries.select("filename"), "filename", "left_anti")
    return one_row({"entries_updated": new.entries, "entries_removed": stale,
                    "entries_created_ref": stale, "entries_created": created,
                    "files_scanned": file_state})


def init_counts(new: KnowledgeBase, files: DataFrame) -> DataFrame:
    """The counters of ``refresh_report`` for a first run."""
    none = new.entries.where("false")
    return one_row({"entries_updated": new.entries, "entries_removed": none,
                    "entries_created_ref": none, "entries_created": new.entries,
                    "files_scanned": files})


def file_state(files: DataFrame) -> DataFrame:
    """What the next run compares with: ``path, hash`` of the files that were read."""
    return files.select("path", "hash")


def category_totals(entries: DataFrame) -> DataFrame:
    """One row ``categories``: a JSON object of the entries in each category, by name."""
    counts = entries.groupBy("category").agg(F.count("*").alias("n"))  # a row per category
    return counts.agg(F.sort_array(F.collect_list(F.struct("category", "n"))).alias("c")).select(
        F.to_json(F.map_from_entries("c")).alias("categories"))


def state_summary(files: DataFrame, entries: DataFrame, as_of: str,
                  last_commit: str | None = None) -> DataFrame:
    """One row about the run. The creation time starts anew with every run."""
    return one_row({"total_files": files, "total_entries": entries}).crossJoin(
        category_totals(entries)).select(  # one row each
        F.lit(1).alias("version"), F.lit(as_of).alias("created_at"),
        F.lit(as_of).alias("updated_at"), F.lit(last_commit).cast("string").alias("last_commit"),
        "total_files", "total_entries", "categories")


@dataclass(frozen=True)
class State:
    """What is kept between runs: ``files`` (path, hash) and one row of ``summary``."""

    files: DataFrame
    summary: DataFrame


def write_state(files: DataFrame, entries: DataFrame, as_of: str, path: str,
                last_commit: str | None = None, mode: str = "errorifexists") -> None:
    """Store below ``path`` what the next run compares with."""
    file_state(files).write.mode(mode).parquet(f"{path}/files")
    state_summary(files, entries, as_of, last_commit).write.mode(mode).parquet(f"{path}/summary")


def read_state(spark: SparkSession, path: str) -> State | None:
    """The stored state, or None where there is none yet."""
    try:
        return State(spark.read.parquet(f"{path}/files"), spark.read.parquet(f"{path}/summary"))
    except AnalysisException:
        return None
