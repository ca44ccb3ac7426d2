"""Columns over relative, slash-separated file paths."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomewright import constants as K


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """The folder of a path; ``.`` for a file at the root."""
    return F.when(F.contains(path, F.lit("/")),
                  F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def extension(path: Column, *, lower: bool = True) -> Column:
    """The suffix from the last dot on; a leading dot starts no suffix (``.env`` has none)."""
    name = basename(path)
    ext = F.when(name == "..", F.lit("")).otherwise(
        F.regexp_extract(name, r"(?s)^.+(\.[^.]*)$", 1))
    return F.lower(ext) if lower else ext


def is_ignored(path: Column, patterns: Iterable[str]) -> Column:
    """True if any folder or file name on the path is ignored.

    ``*.x`` ignores names ending in ``.x``; any other pattern ignores exactly that name.
    """
    patterns = list(patterns)
    suffixes = [p[1:] for p in patterns if p.startswith("*.")]
    names = [p for p in patterns if not p.startswith("*.")]
    segments = F.split(path, "/")
    tests = []
    if names:
        tests.append(F.arrays_overlap(segments, F.array(*map(F.lit, names))))
    if suffixes:
        tests.append(F.exists(segments, lambda s: reduce(
            lambda a, b: a | b, [F.endswith(s, F.lit(x)) for x in suffixes])))
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def _lookup(table: dict[str, str], *, lower: bool = False) -> Column:
    return F.create_map(*[F.lit(x) for key, value in table.items()
                          for x in (key.lower() if lower else key, value)])


def classify(path: Column) -> Column:
    """Category of a file: by its name, else its name without suffix, else its suffix."""
    name = F.lower(basename(path))
    ext = extension(path)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    by_name = _lookup(K.FILENAME_CATEGORIES, lower=True)
    return F.coalesce(F.element_at(by_name, name), F.element_at(by_name, stem),
                      F.element_at(_lookup(K.EXTENSION_CATEGORIES), ext), F.lit("general"))


def detect_language(ext: Column) -> Column:
    return F.coalesce(F.element_at(_lookup(K.LANGUAGE_EXTENSIONS), ext), F.lit("unknown"))


def entry_filename(directory: Column) -> Column:
    """File name of the entry that describes a directory."""
    flat = F.regexp_replace(F.regexp_replace(directory, r"[:/\\]", "_"), "_+", "_")
    return F.when(flat == "_", F.lit("general.md")).otherwise(F.concat(flat, F.lit(".md")))
