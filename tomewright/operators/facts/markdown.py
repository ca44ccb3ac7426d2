"""Facts about markdown files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomewright.functions import text
from tomewright.functions.regex import jvm
from tomewright.functions.frontmatter import END
from tomewright.functions.text import all_matches, first_match, let, replace_all, trim, utf16_length
from tomewright.operators.facts.kinds import Facts, when_some

# --- Fixed values: what is looked for in markdown --------------------------------------------
HEADING = r"^#{1,3}\s+(.+)$"
TITLE = r"^#\s+(.+)$"
FENCE = r"```\w+"
# Only what begins so is looked at as a line.
MARK = r"(?=#)"


def headings(content: Column) -> Column:
    names = F.transform(all_matches(content, MARK + HEADING, 0, "m"),
                        lambda h: trim(replace_all(h, r"^#+\s+", "")))
    return F.slice(F.filter(names, lambda n: utf16_length(n) > 2), 1, 15)


def purpose(content: Column) -> Column:
    """First sentence below the title; the title where nothing much follows it."""
    def from_title(title: Column) -> Column:
        rest = F.substring(content, F.position(title, content) + F.length(title), F.lit(END))
        paragraph = trim(F.split(trim(rest), jvm(r"\n\s*\n")).getItem(0))
        named = trim(F.regexp_extract(title, jvm(TITLE, "m"), 1))
        return let(paragraph, lambda p: F.when(
            utf16_length(p) > 10, F.concat(text.before(p, "."), F.lit("."))).otherwise(
            F.concat(F.lit("Documentation: "), named, F.lit("."))))

    return let(first_match(content, MARK + TITLE, 0, "m"),
               lambda t: F.when(t.isNotNull(), from_title(t)))


def fenced_languages(content: Column) -> Column:
    names = F.array_distinct(F.transform(all_matches(content, FENCE),
                                         lambda f: F.substring(f, 4, END)))
    return let(names, lambda n: when_some(F.size(n) > 0, F.concat(
        F.lit("Code examples in: "), F.array_join(n, ", "))))


def facts(content: Column) -> Column:
    found = Facts(purpose(content))
    found.add("keyConcepts", headings(content))
    found.add("patterns", fenced_languages(content))
    return found.column()
