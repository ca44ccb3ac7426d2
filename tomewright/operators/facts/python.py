"""Facts about Python files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomewright.functions import text
from tomewright.functions.text import all_matches, first_match, let, match_groups, trim
from tomewright.operators.facts.comments import first_sentence_or_none, parameters, provides
from tomewright.operators.facts.kinds import Facts, code, listed, when_some

# --- Fixed values: what is looked for in Python ----------------------------------------------
CLASS = r"class\s+(\w+)(?:\(([^)]+)\))?:"
DOCUMENTED_DEF = (r'(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)(?:\s*->\s*[^:]+)?:\s*\n\s+'
                  r'"""([\s\S]*?)"""')
DECORATOR = r"@(\w+)"
IMPORT = r"^(?:from|import)\s+(\w[\w.]*)"
EXCEPTION = r"(?:raise|except)\s+(\w+)"
TOP_CLASS = r"^class\s+(\w+)"
TOP_DEF = r"^(?:async\s+)?def\s+(\w+)"
DECORATOR_PATTERNS = [
    ("Abstract base classes", ["abstractmethod"]),
    ("Data classes", ["dataclass", "attrs"]),
    ("pytest fixtures", ["pytest", "fixture"]),
    ("Class/static methods", ["staticmethod", "classmethod"]),
]


def classes(content: Column) -> Column:
    return F.transform(match_groups(content, CLASS, name=1, parents=2), lambda c: F.when(c.parents != "", F.concat(
        code(c["name"]), F.lit(" inherits from "), code(c.parents))).otherwise(code(c["name"])))


def decorator_patterns(content: Column) -> Column:
    return let(all_matches(content, DECORATOR, 1), lambda d: F.array_compact(F.array(*[
        F.when(F.arrays_overlap(d, F.array(*map(F.lit, names))), F.lit(label))
        for label, names in DECORATOR_PATTERNS])))


def imports(content: Column) -> Column:
    return F.transform(all_matches(content, IMPORT, 1, "m"), code)


def exceptions(content: Column) -> Column:
    names = F.array_distinct(all_matches(content, EXCEPTION, 1))
    return let(names, lambda n: when_some(F.size(n) > 0, F.concat(
        F.lit("Handles/raises: "), listed(F.transform(n, code), 6))))


def documented_functions(content: Column) -> Column:
    return match_groups(content, DOCUMENTED_DEF, name=1, params=2, doc=3)


def facts(content: Column, about: Column, functions: Column) -> Column:
    duties = F.filter(F.transform(functions, lambda f: let(
        trim(text.before(trim(f.doc), "\n")), lambda line: F.when(line != "", F.concat(
            line, F.lit(" (via "), code(f["name"]), F.lit(")"))))), lambda d: d.isNotNull())
    api = F.transform(functions, lambda f: F.concat(
        F.lit("`"), f["name"], F.lit("("), parameters(f.params), F.lit(")`")))
    main = F.coalesce(first_match(content, TOP_CLASS, 1, "m"),
                      first_match(content, TOP_DEF, 1, "m"))
    found = Facts(F.coalesce(first_sentence_or_none(about), provides(main)))
    found.add("keyConcepts", classes(content))
    found.add("responsibilities", duties)
    found.add("apiSurface", api)
    found.add("patterns", decorator_patterns(content))
    found.add("dependencyPurposes", imports(content))
    found.add("errorHandling", exceptions(content))
    return found.column()
