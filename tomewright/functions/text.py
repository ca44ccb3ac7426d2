"""String columns with ECMAScript semantics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomewright import constants as K
from tomewright.functions.regex import jvm

# The white space of ``regex.WS``, as characters.
SPACES = "\t\n\x0b\x0c\r " + "".join(
    chr(n) for n in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
                     0x3000, 0xFEFF))


def trim(c: Column) -> Column:
    """Strip every kind of white space at both ends (Spark's ``trim`` strips spaces only)."""
    return F.btrim(c, F.lit(SPACES))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units, the unit in which token estimates and cut-offs are counted."""
    return F.floor(F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def utf16_prefix(c: Column, units: int) -> Column:
    """The first ``units`` UTF-16 units; a character cut in half becomes U+FFFD."""
    raw = F.encode(c, "UTF-16BE")
    last = F.hex(F.substring(raw, 2 * units - 1, 1))
    exact = F.when(
        last.between("D8", "DB"),
        F.concat(F.decode(F.substring(raw, 1, 2 * units - 2), "UTF-16BE"), F.lit("\ufffd")),
    ).otherwise(F.decode(F.substring(raw, 1, 2 * units), "UTF-16BE"))
    # Units and characters are the same thing for nearly every text.
    return F.when(utf16_length(c) == F.length(c), F.substring(c, 1, units)).otherwise(exact)


def cut(c: Column, limit: int, marker: str = "...") -> Column:
    """Text longer than ``limit`` is cut so that it ends in ``marker`` and fits the limit."""
    kept = utf16_prefix(c, limit - len(marker))
    return F.when(utf16_length(c) > limit, F.concat(kept, F.lit(marker))).otherwise(c)


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def count_lines(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1).cast("int")


def estimate_tokens(c: Column) -> Column:
    return F.ceil(utf16_length(c) / K.CHARS_PER_TOKEN).cast("long")


def before(c: Column, stop: str) -> Column:
    """The text in front of the first ``stop``, or all of it."""
    return F.substring_index(c, stop, 1)


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 2147483647))


def collapse_space(c: Column) -> Column:
    return F.regexp_replace(c, jvm(r"\s+"), " ")


def split_words(name: Column) -> Column:
    """``loadUserMap`` becomes ``load user map``."""
    return trim(F.lower(F.regexp_replace(name, "([A-Z])", " $1")))


def replace_all(c: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    return F.regexp_replace(c, jvm(pattern, flags), replacement)


def all_matches(c: Column, pattern: str, group: int = 0, flags: str = "") -> Column:
    return F.regexp_extract_all(c, F.lit(jvm(pattern, flags)), F.lit(group))


def match_groups(c: Column, pattern: str, **names: int) -> Column:
    """One struct per match with the named groups; a group that took no part is empty.

    A long text is searched once, for whole matches; their groups are read from each match. The
    pattern must not look at what surrounds a match.
    """
    regex = jvm(pattern)
    return F.transform(all_matches(c, pattern), lambda m: F.struct(*[
        (m if g == 0 else F.regexp_extract(m, regex, g)).alias(n) for n, g in names.items()]))


def first_match(c: Column, pattern: str, group: int = 1, flags: str = "") -> Column:
    """The group of the first match, or null where nothing matches."""
    found = F.regexp_substr(c, F.lit(jvm(pattern, flags)))
    if group == 0:
        return found
    return F.when(found.isNotNull(), F.regexp_extract(c, jvm(pattern, flags), group))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` reads it.

    Long chains of rewrites need this: written as one projection per rewrite, a filter or a
    generator above them would be pushed down through all, copying each input at every level.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def holding(c: Column, *literals: str) -> Column:
    """The text where it holds one of ``literals``, otherwise an empty one.

    For patterns that need one of them: looking for plain text is many times cheaper.
    """
    held = reduce(lambda a, b: a | b, [F.contains(c, F.lit(x)) for x in literals])
    return F.when(~held, F.lit("")).otherwise(c)


def matches(c: Column, pattern: str, flags: str = "") -> Column:
    return c.rlike(jvm(pattern, flags))
