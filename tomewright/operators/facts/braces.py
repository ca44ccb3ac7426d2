"""Facts about scripts that need matching braces, as column expressions.

What a pair of braces encloses is matched by a pattern that is nested ``LEVELS`` deep. Every repeat in
it is possessive, so a text is read once from each place that opens a block, whatever it holds.
Blocks are captured by a look-ahead: a block inside another one is still found by itself.

Scripts that nest deeper (the running sum of their braces tells which) are first taken apart: each
header with its block is a text of its own, in which braces far down are written as other signs, so
the same patterns read it. Which braces belong together is found with a stack, at any depth.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.functions.regex import WORD, WS, jvm
from tomewright.functions.text import holding, match_groups
from tomewright.operators.facts import javascript as js
from tomewright.operators.facts.comments import parameters
from tomewright.operators.facts.kinds import filled, listed

#: How deep blocks may be nested for the patterns, and how deep they stay in a deeper script.
LEVELS = 60
_KEPT_LEVELS = 40
# Signs for a header's begin and end, and for braces far down: code points that no text may hold.
_BEGIN, _END, _OPEN, _CLOSE = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"

# --- Fixed values: what is looked for, and names that are no property ------------------------
NOT_A_PROPERTY = ["type", "interface", "export", "import", "const", "let", "var", "function",
                  "class", "return", "if", "else"]
CATCH_SIGNS = [  # (any of these words in the block, what it means)
    (["log", "console"], "logs errors"), (["throw", "raise"], "re-throws"),
    (["return"], "returns error value"), (["retry"], "implements retry logic"),
    (["notify", "report"], "reports errors"),
]
METHOD = (r"(?:(?:public|private|protected|static|async|abstract)\s+)*(\w+)\s*"
          r"\(([^)]*)\)\s*(?::\s*[^{]+)?\s*\{")
CATCH = r"catch\s*\((\w+)\)\s*\{"
OPTIONS = (r"(?:const|export\s+const)\s+(\w*(?:CONFIG|OPTIONS|SETTINGS|DEFAULTS|"
           r"CONSTANTS)\w*)\s*(?::\s*\w+)?\s*=\s*(?:\{|Readonly\()")

_TAKEN = re.compile("[:][\\s\ufeff]*[}]")
# What stands between two braces that belong together.
_INSIDES = list(accumulate(range(LEVELS), lambda inner, _: rf"(?:[^{{}}]++|\{{{inner}\}})*+",
                           initial="[^{}]*+"))
_INSIDE = _INSIDES[-1]
# Braces that rise by more than LEVELS, see ``is_deep``.
_RISE = "".join(rf"\{{{inside}" for inside in _INSIDES[LEVELS - 1::-1]) + r"\{"
_BLOCK = rf"\{{{_INSIDE}\}}"
# A name with its colon; the character after it belongs to it, even a brace. ``%s`` is the name.
_PROPERTY = (rf"(?<![^;,{{{WS}])(?!(?:{'|'.join(NOT_A_PROPERTY)})\??:)"
             rf"(%s[A-Za-z]{WORD}*+\??):[{WS}]*+(?s:.)?")
_OPTION = rf"""(?<!{WORD})["']?(%s{WORD}++)["']?[{WS}]*+:(?s:.)?"""
_NO_GROUP, _GROUP = "?:", ""


def _names(content: Column, header: str, name: str, flags: str = "") -> tuple[Column, Column]:
    """The first group of each ``header``, and the names directly in the next block from there.

    A header ends at its block or before it; a block that is never closed is read to its end.
    """
    direct = rf"(?:{name % _NO_GROUP}|[^{{}}]|{_BLOCK})*+"
    pattern = F.lit(rf"{jvm(header, flags)}(?=[^{{]*+(?:\{{({direct}))?)")
    titles = F.regexp_extract_all(content, pattern, F.lit(1))
    inside = F.regexp_extract_all(content, pattern, F.lit(_groups(header) + 1))
    return titles, F.transform(inside, lambda text: filled(F.regexp_extract_all(
        text, F.lit(f"{_BLOCK}|{name % _GROUP}"), F.lit(1))))


def _groups(pattern: str) -> int:
    """Number of capturing groups; no pattern here has a bare bracket in a class."""
    return pattern.count("(") - pattern.count("(?") - pattern.count(r"\(")


def _before_brace(pattern: str) -> str:
    """A header that ends in front of its brace instead of behind it."""
    return pattern.removesuffix(r"(?:=|\{)") + r"(?:=|(?=\{))"


# Each family has its headers, and a function that gives one value for each header of a text.

_TYPE_HEADER = js.TYPE_BEGIN + _before_brace(js.TYPE)
_OPTIONS_HEADER = OPTIONS.replace(r"(?:\{|Readonly\()", r"(?:(?=\{)|Readonly\()")


def _properties(content: Column) -> Column:
    names, inside = _names(js.needed(content, js.TYPE), _TYPE_HEADER, _PROPERTY)

    def line(name: Column, props: Column) -> Column:
        more = F.when(F.size(props) > 6, F.concat(
            F.lit(", +"), (F.size(props) - 6).cast("string"), F.lit(" more"))).otherwise("")
        return F.when(F.size(props) > 0, F.concat(
            F.lit("`"), name, F.lit("` defines: "), listed(props, 6), more)).otherwise("")

    return F.zip_with(names, inside, line)


def _options(content: Column) -> Column:
    declared = F.contains(F.lower(content), F.lit("const"))
    names, inside = _names(F.when(~declared, F.lit("")).otherwise(content), _OPTIONS_HEADER,
                           _OPTION, "i")
    return F.zip_with(names, inside, lambda name, options: F.when(
        F.size(options) > 0, F.concat(F.lit("`"), name, F.lit("`: "), listed(options, 8)))
        .otherwise(""))


def _methods(content: Column) -> Column:
    """Methods of documented classes; a comment's own braces count as the class's, if it has any."""
    head = jvm(js.DOCUMENTED_CLASS)
    # A text is searched once, for heads with what follows them; their parts are read from each.
    pattern = F.lit(rf"(?=({head}{_INSIDE}\}}?)){head}")
    classes = F.regexp_extract_all(js.needed(content, js.DOCUMENTED_CLASS), pattern, F.lit(1))

    def of_class(whole: Column) -> Column:
        name = F.regexp_extract(whole, head, 2)
        body = F.translate(F.regexp_extract(
            whole, rf"\A[^{{]*+({_BLOCK})", 1), _OPEN + _CLOSE, "{}")
        found = F.filter(match_groups(body, METHOD, name=1, params=2), lambda m: (
            m["name"] != "constructor") & ~F.startswith(m["name"], F.lit("_")))
        return F.transform(found, lambda m: F.concat(
            F.lit("`"), name, F.lit("."), m["name"], F.lit("("), parameters(m.params),
            F.lit(")`")))

    return F.transform(classes, of_class)


def _catches(content: Column) -> Column:
    pattern = F.lit(rf"{jvm(CATCH)}(?=(?:({_INSIDE})\}})?)")
    content = holding(content, "catch")
    errors, bodies = (F.regexp_extract_all(content, pattern, F.lit(k)) for k in (1, 2))

    def line(error: Column, body: Column) -> Column:
        signs = F.array_compact(F.array(*[
            F.when(reduce(lambda a, b: a | b, [F.contains(body, F.lit(w)) for w in words]),
                   F.lit(label)) for words, label in CATCH_SIGNS]))
        said = F.when(F.size(signs) > 0, F.array_join(signs, ", ")).otherwise(
            F.concat(F.lit("catches `"), error, F.lit("` errors")))
        return F.when(body != "", said).otherwise("")

    return F.zip_with(errors, bodies, line)


# Family: its headers (pattern and flags), whether its block is looked for from the header's begin
# on (else from its end), how it reads a text, and how its values become a list.
_FAMILIES = {
    "properties": (_TYPE_HEADER, "", False, _properties, filled),
    "methods": (js.DOCUMENTED_CLASS, "", True, _methods, F.flatten),
    "catches": (CATCH.removesuffix(r"\{") + r"(?=\{)", "", False, _catches, filled),
    "options": (_OPTIONS_HEADER, "i", False, _options, filled),
}


def is_deep(content: Column) -> Column:
    """Whether braces rise by more than ``LEVELS`` anywhere in a text.

    Where they first do, ``LEVELS + 1`` braces are open, and between the k-th and the next are only
    blocks of up to ``LEVELS - k`` levels. What the next one opens is deeper, so no block takes it.
    """
    signs = F.regexp_replace(content, "[^{}]++", "")
    return (F.length(signs) > LEVELS) & signs.rlike(_RISE)


class _Braces:
    """The braces of a text: where they are, how deep each is, and which belong together."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        self.at = np.flatnonzero((self.points == ord("{")) | (self.points == ord("}")))
        self.opens = self.points[self.at] == ord("{")
        level = np.concatenate([[0], np.cumsum(np.where(self.opens, 1, -1))])
        level -= np.minimum.accumulate(level)  # a brace that closes nothing lowers nothing
        self.after = level[1:]
        self.depth = np.where(self.opens, self.after, level[:-1])

    def close(self, opened: int) -> int:
        """Where the block that ``opened`` opens ends; the end of the text if it is never closed."""
        n = np.searchsorted(self.at, opened)
        below = self.after[n + 1:] < self.after[n]
        k = int(below.argmax()) if below.size else 0
        return int(self.at[n + 1 + k]) if below.size and below[k] else len(self.text) - 1

    def piece(self, begin: int, opened: int, stop: int) -> str:
        """A part of the text with other signs for the braces far below the one ``opened``."""
        first, last = np.searchsorted(self.at, [opened, stop])
        far = self.depth[first:last] > self.depth[first] + _KEPT_LEVELS
        if not far.any():
            return self.text[begin:stop]
        signs = self.points[begin:stop].copy()
        signs[self.at[first:last][far] - begin] = np.where(
            self.opens[first:last][far], ord(_OPEN), ord(_CLOSE))
        return signs.tobytes().decode("utf-32-le", "surrogatepass")


def _taken_apart(marked: dict[str, str]) -> dict[str, list[str]]:
    """Each header, marked by its begin and end, with its block as a text of its own.

    The texts of all families are the same but for their marks.
    """
    found, out = None, {}
    for name, text in marked.items():
        parts, headers, at = [], [], 0
        for part in re.split(f"([{_BEGIN}{_END}])", text):
            if part == _BEGIN:
                headers.append([at, at])
            elif part == _END:
                headers[-1][1] = at
            else:
                parts.append(part)
                at += len(part)
        if found is None:
            found = _Braces("".join(parts))
        out[name] = [_piece(found, begin, end, begin if _FAMILIES[name][2] else end)
                     for begin, end in headers]
    return out


def _piece(found: _Braces, begin: int, end: int, search_from: int) -> str:
    opened = found.text.find("{", search_from)
    if opened < 0:
        return found.text[begin:end]
    # A block that is never closed goes to the end of the text.
    stop = max(found.close(opened) + 1, end)
    if _TAKEN.search(found.text, opened, stop):  # a name takes a brace: the block may go on behind it
        stop = len(found.text)
    return found.piece(begin, opened, stop)


def _deep(content: Column) -> Column:
    """``struct(properties, methods, catches, options)`` of scripts that nest deeper."""
    plain = F.regexp_replace(content, f"[{_BEGIN}{_END}{_OPEN}{_CLOSE}]", "?")
    marked = F.when(content.isNotNull(), F.struct(*[
        F.regexp_replace(plain, jvm(header, flags), f"{_BEGIN}$0{_END}").alias(name)
        for name, (header, flags, _, _, _) in _FAMILIES.items()]))

    kind = "struct<" + ",".join(f"{n}:array<string>" for n in _FAMILIES) + ">"

    @F.arrow_udf(kind)
    def take_apart(rows: pa.Array) -> pa.Array:
        out = [None if r is None else _taken_apart(r) for r in (x.as_py() for x in rows)]
        return pa.array(out, pa.struct([(n, pa.list_(pa.string())) for n in _FAMILIES]))

    return take_apart(marked)


def with_brace_facts(rows: DataFrame, content: Column, name: str) -> DataFrame:
    """``rows`` with ``struct(properties, methods, catches, options)`` of scripts; null stays null."""
    # A column of its own: every header's pattern asks for it.
    deep = F.coalesce(is_deep(content), F.lit(False))
    rows = rows.withColumn("__is_deep", deep)
    rows = rows.withColumn("__deep", _deep(F.when(F.col("__is_deep"), content)))

    def of(family: str) -> Column:
        _, _, _, read, put = _FAMILIES[family]
        none = F.array().cast("array<string>")
        flat = F.when(F.contains(content, F.lit("{")), put(read(content))).otherwise(none)
        # The first header of a text is its own; others are in its block.
        first = put(F.transform(F.col(f"__deep.{family}"), lambda t: F.element_at(read(t), 1)))
        return F.when(F.col("__deep").isNotNull(), first).otherwise(flat).alias(family)

    facts = F.when(content.isNotNull(), F.struct(*[of(f) for f in _FAMILIES]))
    return rows.withColumn(name, facts).drop("__deep", "__is_deep")
