"""One planned entry per directory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright.functions import paths
from tomewright.plans.model import Plans, shown_lines


def plan_by_directory(files: DataFrame) -> Plans:
    """Plans from ``files(path, size, lines)``.

    A directory may hold a large share of all files, so its files are not gathered into one row:
    they stay rows of ``sources``, in path order, and a plan only counts them.
    """
    directory = paths.dirname(F.col("path"))
    sources = files.select(directory.alias("plan_id"),
                           paths.entry_filename(directory).alias("filename"),
                           F.lit(0).cast("long").alias("pos"), "path", shown_lines().alias("lines"))
    plans = (files.groupBy(directory.alias("plan_id"))
             .agg(F.min("path").alias("first_path"), F.count("*").alias("n_sources"))
             .select("plan_id",
                     F.struct(F.lit(0).cast("long").alias("n"),
                              F.col("first_path").alias("key")).alias("plan_order"),
                     paths.entry_filename(F.col("plan_id")).alias("filename"),
                     F.when(F.col("plan_id") == ".", F.lit("root"))
                     .otherwise(F.col("plan_id")).alias("title"),
                     F.lit("module").alias("category"),
                     F.concat(F.lit("Files in "), F.col("plan_id")).alias("brief"),
                     "n_sources"))
    return Plans(plans, sources)
