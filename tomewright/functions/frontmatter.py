"""The header of an entry document: written as simple YAML, read by a simpler grammar.

Reading is not the inverse of writing, and queries see what was read. An empty list reads back as
the next list that is not empty, the header ends at the first ``---`` wherever it stands, and
quotes inside a value do not survive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomewright.functions.text import first_match, let, trim

END = 2147483647


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))


def list_item(c: Column) -> Column:
    return F.concat(F.lit("  - "), c, F.lit("\n"))


def header_end(raw: Column) -> Column:
    """Place of the ``---`` that closes the header, 0 without a header."""
    return F.when(F.startswith(raw, F.lit("---")),
                  F.locate("---", raw, 4)).otherwise(F.lit(0))


def yaml_string(yaml: Column, key: str) -> Column:
    value = F.coalesce(first_match(yaml, rf'^{key}:\s*"([^"]*)"\s*$', 1, "m"),
                       first_match(yaml, rf"^{key}:\s*([^:\n]+?)\s*$", 1, "m"))
    return trim(value)


def yaml_list(yaml: Column, key: str) -> Column:
    """The first run of ``- `` lines after the first place that reads ``key:``."""
    def is_item(line: Column) -> Column:
        return F.startswith(line, F.lit("- "))

    def run_from(lines: Column, start: Column) -> Column:
        rest = F.slice(lines, start, F.size(lines))
        return let(rest, lambda r: let(
            F.array_position(F.transform(r, is_item), F.lit(False)).cast("int"),
            lambda stop: F.when(stop == 0, r).otherwise(F.slice(r, F.lit(1), stop - 1))))

    def items(lines: Column) -> Column:
        return let(F.array_position(F.transform(lines, is_item), F.lit(True)).cast("int"),
                   lambda start: F.when(start == 0, F.array().cast("array<string>"))
                   .otherwise(run_from(lines, start)))

    at = F.locate(f"{key}:", yaml)
    after = F.substring(yaml, at + len(key) + 1, F.lit(END))
    found = let(F.transform(F.split(after, "\n"), trim), items)
    return F.when(at == 0, F.array().cast("array<string>")).otherwise(
        F.transform(found, lambda line: trim(F.substring(line, 3, END))))
