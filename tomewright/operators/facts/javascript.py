"""Facts about TypeScript and JavaScript files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomewright.functions import text
from tomewright.functions.regex import jvm
from tomewright.functions.text import (all_matches, collapse_space, first_match, holding, let,
                                       match_groups, matches, replace_all, trim)
from tomewright.operators.facts.comments import comment_body, parameters, provides
from tomewright.operators.facts.kinds import Facts, code, filled, listed, strings, when_some

# --- Fixed values: what is looked for in a script --------------------------------------------
TYPE = r"(?:export\s+)?(?:type|interface)\s+(\w+)(?:\s+extends\s+(\w+))?\s*(?:=|\{)"
ENUM = r"enum\s+(\w+)\s*\{([^}]+)\}"
# The comment must end at the first "*/", hence the group that is never re-entered.
DOCUMENTED_FUNCTION = (r"\/\*\*(?>([\s\S]*?)\*\/)\n(?:\s*\n)?\s*(?:export\s+)?(?:async\s+)?"
                       r"function\s+(\w+)\s*\(([^)]*)\)")
ARROW = (r"(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s+)?\(([^)]*)\)\s*"
         r"(?::\s*[^=]+?)?\s*=>")
_CLASS = (r"\*\/\s*(?:export\s+)?(?:default\s+)?class\s+(%s\w+)"
          r"(?:\s+extends\s+(%s\w+))?(?:\s+implements\s+(%s[^{]+))?\s*\{")
# The comment goes to the first end with a class behind it; only stars are looked at closely.
DOCUMENTED_CLASS = (rf"\/\*\*([^*]*+(?:(?!{_CLASS % (('?:',) * 3)})\*[^*]*+)*+)"
                    + _CLASS % (("",) * 3))
CUSTOM_ERROR = r"class\s+(\w+)\s+extends\s+(?:Error|[\w.]*Error)"
IMPORT = r"""import\s+.*?\s+from\s+['"]([^./][^'"]*)['"]"""
ASSERTION = r"assert(?:\.strict)?\.(?:equal|deepEqual|ok|throws)\([^)]+\)"
TYPE_GUARD = r"function\s+is\w+\(.*\)\s*:\s*\w+\s+is\s+\w+"
VALIDATION = r"\.test\(|\.match\(|typeof\s+\w+\s*===|instanceof\s+"
TYPEOF = r"""typeof\s+(\w+)\s*===?\s*['"](\w+)['"]"""
EXPORTS = [
    r"export\s+(?:default\s+)?function\s+(\w+)", r"export\s+(?:default\s+)?class\s+(\w+)",
    r"export\s+const\s+(\w+)", r"export\s+(?:type|interface)\s+(\w+)", r"export\s+\{([^}]+)\}",
]
# First letters of ``TYPE``: what begins otherwise is passed over at once.
TYPE_BEGIN = r"(?=[eti])"
# (what it is called, patterns that must all occur, with their flags)
DESIGN_PATTERNS = [
    ("Event-driven / Observer pattern",
     [(r"\.on\(|\.emit\(|\.subscribe\(|addEventListener", "")]),
    ("Factory pattern",
     [(r"create\w+|factory|build\w+|make\w+", "i"), (r"return\s+(?:new|\{)", "")]),
    ("Middleware pattern", [(r"middleware|next\(\)|\.use\(", "")]),
    ("Singleton pattern",
     [(r"getInstance|private\s+static\s+instance|private\s+constructor", "")]),
    ("Builder pattern", [(r"builder|\.with\w+\(|\.set\w+\(.*return\s+this", "")]),
    ("Asynchronous execution with Promises/async-await", [(r"Promise|async|await", "")]),
    ("Generator/Iterator pattern", [(r"function\s*\*|yield", "")]),
    ("Plugin/Extension architecture", [(r"register|plugin|extension|hook", "")]),
    ("Map/Record-based data structures", [(r"new\s+Map\(\[|Record<|as\s+const", "")]),
]

# Of a pattern above, plain text of which each match holds one.
NEEDED = {
    DESIGN_PATTERNS[0][1][0][0]: [".on(", ".emit(", ".subscribe(", "addEventListener"],
    DESIGN_PATTERNS[1][1][1][0]: ["return"],
    DESIGN_PATTERNS[2][1][0][0]: ["middleware", "next()", ".use("],
    DESIGN_PATTERNS[3][1][0][0]: ["getInstance", "private"],
    DESIGN_PATTERNS[4][1][0][0]: ["builder", ".with", ".set"],
    DESIGN_PATTERNS[5][1][0][0]: ["Promise", "async", "await"],
    DESIGN_PATTERNS[6][1][0][0]: ["function", "yield"],
    DESIGN_PATTERNS[7][1][0][0]: ["register", "plugin", "extension", "hook"],
    DESIGN_PATTERNS[8][1][0][0]: ["Map([", "Record<", "const"],
    TYPE: ["type", "interface"], ENUM: ["enum"], DOCUMENTED_FUNCTION: ["/**"], ARROW: ["=>"],
    DOCUMENTED_CLASS: ["/**"], CUSTOM_ERROR: ["Error"], IMPORT: ["import"],
    ASSERTION: ["assert"], TYPE_GUARD: ["function"], TYPEOF: ["typeof"],
    **{p: ["export"] for p in EXPORTS},
}


def needed(content: Column, pattern: str) -> Column:
    """A text in which ``pattern`` finds what it finds in ``content``; empty if that is nothing."""
    return holding(content, *NEEDED[pattern]) if pattern in NEEDED else content


def parsed(content: Column) -> Column:
    """What several kinds of facts are made of, found once: types, functions and classes."""
    functions = F.transform(
        match_groups(needed(content, DOCUMENTED_FUNCTION), DOCUMENTED_FUNCTION, doc=1, name=2, params=3),
        lambda f: F.struct(comment_body(f.doc).alias("doc"), f["name"].alias("name"),
                           trim(f.params).alias("params")))
    classes = F.transform(
        match_groups(needed(content, DOCUMENTED_CLASS), DOCUMENTED_CLASS, doc=1, name=2, parent=3, interfaces=4),
        lambda c: c.withField("doc", comment_body(c.doc)))
    types = match_groups(needed(content, TYPE), TYPE_BEGIN + TYPE, name=1, parent=2)
    return F.struct(types.alias("types"),
                    functions.alias("functions"), classes.alias("classes"))


def purpose(content: Column, about: Column) -> Column:
    line = trim(collapse_space(about))

    def sentence(s: Column) -> Column:
        stop = F.locate(".", s)
        return F.when(stop.between(2, 120), F.substring(s, F.lit(1), stop)).otherwise(s)

    exported = F.coalesce(*[first_match(needed(content, p), p, 1) for p in EXPORTS])
    return F.coalesce(F.when(about.isNotNull(), let(line, sentence)), provides(exported))


def type_names(types: Column) -> Column:
    shown = F.transform(types, lambda t: F.when(t.parent != "", F.concat(
        code(t["name"]), F.lit(" extends "), code(t.parent))).otherwise(code(t["name"])))
    return F.when(F.size(types) > 0, strings(
        F.concat(F.lit("Types: "), listed(shown, 8)))).otherwise(strings())


def enums(content: Column) -> Column:
    def values(body: Column) -> Column:
        return filled(F.transform(F.split(body, ","), lambda v: trim(text.before(trim(v), "="))))

    return F.transform(match_groups(needed(content, ENUM), ENUM, name=1, body=2), lambda e: F.concat(
        code(e["name"]), F.lit(" enum: "), listed(values(e.body), 10)))


def _described(doc: Column) -> Column:
    """The first sentence of a comment, before its tags; empty if there is none."""
    return text.before(trim(F.split(doc, r"@[A-Za-z0-9_]").getItem(0)), ".")


def _has_description(doc: Column) -> Column:
    return trim(F.split(doc, r"@[A-Za-z0-9_]").getItem(0)) != ""


def documented_functions(found: Column) -> tuple[Column, Column, Column]:
    """Responsibilities, data flow and API of functions with a comment right above them."""
    duties = F.transform(F.filter(found, lambda f: _has_description(f.doc)), lambda f: F.concat(
        _described(f.doc), F.lit(" (via "), code(f["name"]), F.lit(")")))
    flow = F.flatten(F.transform(found, lambda f: filled(F.transform(
        all_matches(f.doc, r"@param\s+\w+\s+-?\s*([^@]+)"),
        lambda m: trim(replace_all(m, r"@param\s+\w+\s+-?\s*", ""))))))

    def call(f: Column) -> Column:
        return F.concat(F.lit("`"), f["name"], F.lit("("), parameters(f.params), F.lit(")`"))

    api = F.transform(found, lambda f: F.concat(call(f), let(
        first_match(f.doc, r"@returns?\s+([^@]+)", 1),
        lambda r: F.coalesce(F.concat(F.lit(" → "), trim(r)), F.lit("")))))
    return duties, flow, api


def arrow_functions(content: Column) -> Column:
    found = F.filter(match_groups(needed(content, ARROW), ARROW, name=1, params=2),
                     lambda f: ~F.startswith(f["name"], F.lit("_")))
    return F.transform(found, lambda f: F.concat(
        F.lit("`"), f["name"], F.lit("("), parameters(trim(f.params)), F.lit(")`")))


def documented_classes(found: Column) -> tuple[Column, Column]:
    """Responsibilities and key concepts of classes with a comment."""
    duties = F.transform(F.filter(found, lambda c: _has_description(c.doc)),
                         lambda c: _described(c.doc))
    concepts = F.transform(found, lambda c: F.concat(
        code(c["name"]),
        F.when(c.parent != "", F.concat(F.lit(" extends "), code(c.parent))).otherwise(""),
        F.when(c.interfaces != "", F.concat(F.lit(" implements "), code(trim(c.interfaces))))
        .otherwise("")))
    return duties, concepts


def custom_errors(content: Column) -> Column:
    return F.transform(all_matches(needed(content, CUSTOM_ERROR), CUSTOM_ERROR, 1), lambda n: F.concat(
        F.lit("Defines custom error: "), code(n)))


def optional_chaining(content: Column) -> Column:
    return when_some(F.regexp_count(content, F.lit(r"\?\.")) > 3,
                     "Uses optional chaining for null safety")


def imports(content: Column) -> Column:
    """Modules that are not files, and what is imported from them.

    A module keeps the place of its first import and the names of its last.
    """
    def names(line: Column) -> Column:
        braces = first_match(line, r"\{([^}]+)\}", 1)
        named = F.transform(F.split(braces, ","), lambda s: trim(
            F.split(trim(s), jvm(r"\s+as\s+")).getItem(0)))
        single = first_match(line, r"import\s+(\w+)", 1)
        return F.when(braces.isNotNull(), named).when(single.isNotNull(), strings(single))

    lines = F.transform(match_groups(needed(content, IMPORT), IMPORT, line=0, module=1), lambda i: F.struct(
        i["module"].alias("module"), names(i.line).alias("names")))
    usable = F.filter(lines, lambda i: i.names.isNotNull())
    return let(usable, lambda all_: F.transform(
        F.array_distinct(F.transform(all_, lambda i: i["module"])),
        lambda m: F.concat(code(m), F.lit(" → "), listed(
            F.element_at(F.filter(all_, lambda i: i["module"] == m), -1).names, 5))))


def design_patterns(content: Column) -> Column:
    def all_found(tests) -> Column:
        found = F.lit(True)
        for p, flags in reversed(tests):  # patterns that need plain text stand behind the rest
            found = found & matches(needed(content, p), p, flags)
        return found

    return F.array_compact(F.array(*[
        F.when(all_found(tests), F.lit(name)) for name, tests in DESIGN_PATTERNS]))


def constraints(content: Column) -> list[Column]:
    asserts = F.size(all_matches(needed(content, ASSERTION), ASSERTION))
    checks = all_matches(needed(content, TYPEOF), TYPEOF)
    return [
        when_some(asserts > 0, F.concat(F.lit("Contains "), asserts.cast("string"),
                                        F.lit(" assertion(s) for validation"))),
        F.transform(all_matches(needed(content, TYPE_GUARD), TYPE_GUARD), lambda g: F.concat(
            F.lit("Type guard: "), collapse_space(g))),
        when_some((F.size(checks) > 0) & matches(content, VALIDATION),
                  F.concat(F.lit("Runtime type validation: "), listed(checks, 5))),
    ]


def facts(content: Column, about: Column, seen: Column, braces: Column) -> Column:
    duties, flow, api = documented_functions(seen.functions)
    class_duties, class_concepts = documented_classes(seen.classes)
    found = Facts(purpose(content, about))
    found.add("responsibilities", duties, class_duties)
    found.add("keyConcepts", type_names(seen.types), braces.properties, enums(content),
              class_concepts)
    found.add("dataFlow", flow)
    found.add("patterns", design_patterns(content))
    found.add("errorHandling", braces.catches, optional_chaining(content),
              custom_errors(content))
    found.add("dependencyPurposes", imports(content))
    found.add("apiSurface", api, arrow_functions(content), braces.methods)
    found.add("configuration", braces.options)
    found.add("constraints", *constraints(content))
    return found.column()
