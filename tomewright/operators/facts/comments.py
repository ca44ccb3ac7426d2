"""What the comments of a source file say about it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomewright.functions import text
from tomewright.functions.regex import WS, jvm
from tomewright.functions.text import (all_matches, first_match, holding, let, replace_all,
                                       trim, utf16_length)
from tomewright.operators.facts.kinds import filled

MEANINGFUL = 10  # a shorter comment says nothing


def _long(c: Column) -> Column:
    return utf16_length(c) > MEANINGFUL


def comment_body(block: Column) -> Column:
    """A block comment without the stars in front of its lines."""
    return trim(replace_all(block, r"^\s*\*\s?", "", "m"))


def doc_comments(content: Column) -> Column:
    """Bodies of ``/** */`` blocks; those on a single line come a second time, after the rest."""
    content = holding(content, "/*")
    blocks = F.transform(all_matches(content, r"\/\*\*([\s\S]*?)\*\/", 1), comment_body)
    one_line = F.transform(all_matches(content, r"\/\*\*?\s*([^*\n]+?)\s*\*\/", 1), trim)
    return F.filter(F.concat(blocks, one_line), _long)


def docstrings(content: Column) -> Column:
    """Docstrings of classes and functions, that of the module in front."""
    content = holding(content, '"""')
    inner = all_matches(
        content, r'(?:^|\n)(?:class|def|async\s+def)\s+\w+[^:]*:\s*\n\s+"""([\s\S]*?)"""', 1)
    module = F.array_compact(F.array(first_match(content, r'^"""([\s\S]*?)"""', 1)))
    return F.filter(F.transform(F.concat(module, inner), trim), _long)


def _first_paragraph(comment: Column) -> Column:
    paragraph = F.split(comment, jvm(r"\n\s*\n")).getItem(0)
    return trim(replace_all(paragraph, r"@\w+[\s\S]*$", ""))


def leading_comment(content: Column) -> Column:
    """The ``//`` lines a file opens with, as one line; blank lines between them do not count."""
    def open_lines(lines: Column) -> Column:
        stop = F.array_position(F.transform(
            lines, lambda x: F.startswith(x, F.lit("//")) | (x == "")), F.lit(False)).cast("int")
        return let(stop, lambda s: F.when(s == 0, lines).otherwise(
            F.slice(lines, F.lit(1), s - 1)))

    lines = F.transform(F.split(content, "\n"), trim)
    comments = F.transform(
        F.filter(let(lines, open_lines), lambda x: F.startswith(x, F.lit("//"))),
        lambda x: replace_all(x, r"^\/\/\s?", ""))
    joined = let(trim(F.array_join(comments, " ")), lambda j: F.when(_long(j), j))
    # Only a file whose first line is such a comment has any, so most are not split at all.
    return F.when(content.rlike(rf"\A[{WS}&&[^\n]]*//"), joined)


def module_description(family: Column, content: Column) -> Column:
    """What the first comment of a file says about it, or null."""
    docs = (F.when(family == "python", docstrings(content))
            .when(family.isin("script", "other"), doc_comments(content)))
    first = let(F.get(docs, F.lit(0)), lambda c: F.when(c.isNotNull(), let(
        _first_paragraph(c), lambda p: F.when(_long(p), p))))
    reads_comments = family.isin("python", "script", "other")
    return F.when(reads_comments, F.coalesce(first, leading_comment(content)))


def first_sentence_or_none(about: Column) -> Column:
    return F.when(about.isNotNull(), F.concat(text.before(about, "."), F.lit(".")))


def provides(name: Column) -> Column:
    """What to say of a file that has a name to offer and nothing else."""
    return F.when(name.isNotNull(), F.concat(
        F.lit("Provides "), text.split_words(name), F.lit(" functionality.")))


def parameters(params: Column) -> Column:
    """Names of up to three parameters, without types and defaults."""
    names = filled(F.transform(F.split(params, ","), lambda p: trim(
        F.regexp_extract(trim(p), "^([^:=?]*)", 1))))
    return let(names, lambda n: F.concat(
        F.array_join(F.slice(n, 1, 3), ", "),
        F.when(F.size(n) > 3, F.lit(", ...")).otherwise(F.lit(""))))
