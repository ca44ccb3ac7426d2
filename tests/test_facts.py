import re

from pyspark.sql import functions as F

from tomewright.functions import text
from tomewright.operators.facts import braces, extract_facts
from tomewright.operators.facts import javascript as js
from tomewright.operators.facts.merge import describe, merge_facts

SCRIPT = '''import fs, { readFile as rf, stat, } from "node:fs";
import * as path from 'path';
import def from "lib";
import { later } from "node:fs";
export interface User extends Base { id: string; name?: string; fn(a: { b: number }): void; a:1; b:2; c:3; d:4; e: 5 }
type Alias = { x: number };
enum Color { Red = 1, Green, Blue, }
/** Add two numbers. They are summed.
 * @param a - first number
 * @param b second
 * @returns the sum
 */
export async function add(a: number, b = 2, c?: string, d) { try { x } catch (err) { console.log(err); throw err; } }
const arrow = async (x: number, y) => x;
const _hidden = () => 1;
export const MY_CONFIG: X = { "a": 1, b: { c: 2 }, 'd': 3 };
function isUser(x: any): x is User { return typeof x === 'object' }
a?.b; a?.c; a?.d; a?.e; assert.equal(1, 2);
try {} catch (e) { }
try {} catch (e) {}
try {} catch (io) { return retry(report) }
class MyError extends TypeError {}
'''
CLASS = '''/**
 * A store of users. Fast.
 */
export default class Store extends Base implements I, J {
  constructor(a) { if (a) { b } }
  async load(id: string): Promise<void> { return new Y(); }
  static make({ a }, b?: T) { yield 1 }
  _p() {}
}
'''
MODULE = '''"""Module for things. Second sentence."""
from os import path
import sys.x
@dataclass
class Foo(Bar, Baz):
    """Doc of Foo class"""
    async def run(self, a: int, b=1) -> int:
        """Run it now.
        More."""
        raise ValueError("x")
'''
FILES = {
    "a/x.ts": SCRIPT, "a/s.js": CLASS, "a/y.py": MODULE, "a/z.py": "def other():\n    pass\n",
    "a/package.json": '{"name":"n","version":"1.2.3","scripts":{"b":"x","a":1},'
                      '"dependencies":{"z":"1","a":"2"},"main":"m.js"}',
    "a/tsconfig.json": '{"compilerOptions":{"strict":true,"lib":["a","b"],"o":{}},"include":["src"]}',
    "a/o.json": '{"b":[1,2],"a":null,"10":1.0,"2":{},"t":true}', "a/bad.json": "{x",
    "a/c.yaml": "a: 1\nb-c:\n  d: 2\n", "a/c.toml": "[x]\na=1\n[y.z]\n [no]\n",
    "a/d.md": "# Title here\n\nFirst paragraph of it. More.\n\n## Sub one\n### ab\n```js\n```\n```js\n",
    "a/short.md": "# Only\n\ntiny", "a/e.go": "\n// not at the top of it\n",
    "a/f.go": "// Package f does things. Well\n\n// and more\npackage f\n// not\n",
    "a/g.js": "export const fooBarBaz = 1",
}


def test_all_families(spark):
    df = spark.createDataFrame(list(FILES.items()), "path string, content string")
    got = {}
    for r in extract_facts(df).orderBy("path", "kind", "ord").collect():
        got.setdefault((r.path[2:], r.kind), []).append(r.value)

    def of(name, kind):
        return got.get((name, kind), [])

    assert of("x.ts", "keyConcepts") == [
        "Types: `User` extends `Base`, `Alias`",
        "`User` defines: id, name?, a, b, c, d, +1 more", "`Alias` defines: x",
        "`Color` enum: Red, Green, Blue"]
    assert of("x.ts", "dependencyPurposes") == ["`node:fs` → later", "`lib` → def"]
    assert of("x.ts", "responsibilities") == ["Add two numbers (via `add`)"]
    assert of("x.ts", "dataFlow") == ["first number", "second"]
    assert of("x.ts", "apiSurface") == ["`add(a, b, c, ...)` → the sum", "`arrow(x, y)`"]
    assert of("x.ts", "errorHandling") == [
        "logs errors, re-throws", "catches `e` errors",
        "returns error value, implements retry logic, reports errors",
        "Uses optional chaining for null safety", "Defines custom error: `MyError`"]
    assert of("x.ts", "configuration") == ["`MY_CONFIG`: a, b, d"]
    assert of("x.ts", "constraints") == [
        "Contains 1 assertion(s) for validation", "Type guard: function isUser(x: any): x is User",
        "Runtime type validation: typeof x === 'object'"]
    assert of("x.ts", "purpose") == ["Add two numbers."]
    assert of("s.js", "purpose") == ["A store of users."]
    assert of("s.js", "responsibilities") == ["A store of users"]
    assert of("s.js", "keyConcepts") == ["`Store` extends `Base` implements `I, J`"]
    assert of("s.js", "apiSurface") == [
        "`Store.if(a)`", "`Store.load(id)`", "`Store.make({ a }, b)`"]
    assert of("s.js", "patterns") == [
        "Asynchronous execution with Promises/async-await", "Generator/Iterator pattern"]
    assert of("y.py", "purpose") == ["Module for things."]
    assert of("y.py", "keyConcepts") == ["`Foo` inherits from `Bar, Baz`"]
    assert of("y.py", "responsibilities") == ["Run it now. (via `run`)"]
    assert of("y.py", "apiSurface") == ["`run(self, a, b)`"]
    assert of("y.py", "patterns") == ["Data classes"]
    assert of("y.py", "dependencyPurposes") == ["`os`", "`sys.x`"]
    assert of("y.py", "errorHandling") == ["Handles/raises: `ValueError`"]
    assert of("z.py", "purpose") == ["Provides other functionality."]
    assert of("package.json", "purpose") == ["Node.js package manifest for `n` (v1.2.3)."]
    assert of("package.json", "configuration") == ["Scripts: `b`: x, `a`: 1"]
    assert of("package.json", "dependencyPurposes") == ["Dependencies: z, a"]
    assert of("package.json", "keyConcepts") == ["Entry point: `m.js`"]
    assert of("tsconfig.json", "configuration") == [
        "Compiler options: strict: true, lib: a,b, o: [object Object]", "Includes: src"]
    assert of("o.json", "configuration") == [
        "`2`: object", "`10`: number", "`b`: array (2 items)", "`a`: object", "`t`: boolean"]
    assert of("bad.json", "purpose") == ["JSON configuration file (possibly malformed)."]
    assert of("c.yaml", "purpose") == ["YAML configuration covering: a, b-c."]
    assert of("c.toml", "configuration") == ["`[x]`", "`[y.z]`"]
    assert of("d.md", "purpose") == ["First paragraph of it."]
    assert of("d.md", "keyConcepts") == ["Title here", "Sub one"]
    assert of("d.md", "patterns") == ["Code examples in: js"]
    assert of("short.md", "purpose") == ["Documentation: Only."]
    assert of("e.go", "purpose") == []
    assert of("f.go", "purpose") == ["Package f does things."]
    assert of("g.js", "purpose") == ["Provides foo bar baz functionality."]


def test_merge_and_describe(spark):
    rows = [("b", "patterns", 0, "p"), ("a", "patterns", 1, "q"), ("a", "patterns", 0, "p"),
            ("b", "purpose", 0, "second"), ("a", "purpose", 0, "x" * 151)]
    rows += [("c", "errorHandling", i, f"e{i}") for i in range(9)]
    rows += [("c", "responsibilities", 0, "Does it (via `f`)"), ("d", "apiSurface", 0, "`f()`"),
             ("d", "apiSurface", 1, "`g()`")]
    facts = spark.createDataFrame(rows, "path string, kind string, ord int, value string")
    members = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "c"), ("i", "d"), ("j", "e")],
                                    "group_id string, path string")
    merged = merge_facts(facts, members)
    got = {}
    for r in merged.orderBy("group_id", "kind", "rank").collect():
        got.setdefault((r.group_id, r.kind), []).append(r.value)
    assert got["g", "patterns"] == ["p", "q"] and got["g", "purpose"] == ["x" * 151]
    assert got["h", "errorHandling"] == [f"e{i}" for i in range(6)]
    groups = members.select("group_id", F.lit("api").alias("category")).distinct()
    assert dict(map(tuple, describe(merged, groups).collect())) == {
        "g": "x" * 147 + "...", "h": "Does it", "i": "Exposes: `f()`, `g()`", "j": "api module"}


SCRIPTS = [
    "/** a * b ** c */ x /* no */\n/** One ***/\nexport default class A extends B implements C, D {"
    " m(a) { } }\n/** Two */ function f(a) { }\n/** Three **/class E { n() { } }",
    "/** never closed class X {", "/***/class Y { o() { } }", "/** a */ class { } /** b */ class Z{}",
    "a.on('x') .use( builder hook yield async", "return {} make1 new  Map([ as const",
    "private\tconstructor() instanceof Foo", "enum K { A = 1, B }\nconst f = (a) => a",
    "class Q extends my.OwnError { }\nimport a from 'lib'\nassert.ok(x) typeof x === 'y'",
    "function isA(v): v is A {}\nexport type T = 1; interface  I extends J { a: b }",
    "CONST my_Config = { one: 1 }", "nothing of it", "",
]


def test_patterns_find_the_same_in_what_they_need(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate([*SCRIPTS, None])], "id int, c string")
    c = F.col("c")
    found = {p: 0 for p in js.NEEDED}
    rows = texts.select("id", *[F.struct(
        text.all_matches(c, p).alias("plain"), text.all_matches(js.needed(c, p), p).alias("needed"))
        .alias(str(k)) for k, p in enumerate(found)]).collect()
    for r in rows:
        for k, p in enumerate(found):
            assert r[str(k)].plain == r[str(k)].needed
            found[p] += len(r[str(k)].plain or [])
    assert sum(n > 0 for n in found.values()) > 18


def test_class_comment_goes_to_the_first_end_before_a_class(spark):
    lazy = re.compile(r"/\*\*([\s\S]*?)\*/\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)"
                      r"(?:\s+extends\s+(\w+))?(?:\s+implements\s+([^{]+))?\s*\{")
    texts = spark.createDataFrame([(t,) for t in SCRIPTS], "c string")
    got = {r.c: r for r in texts.select("c", text.match_groups(
        F.col("c"), js.DOCUMENTED_CLASS, doc=1, name=2, parent=3, interfaces=4).alias("found"),
        braces._methods(F.col("c")).alias("methods")).collect()}
    for t in SCRIPTS:
        assert [tuple(f) for f in got[t].found] == [
            tuple(g or "" for g in m.groups()) for m in lazy.finditer(t)]
    # The braces in the second comment are those of the function it goes over.
    assert got[SCRIPTS[0]].methods == [["`A.m(a)`"], []]
    assert got[SCRIPTS[2]].methods == [["`Y.o()`"]]


def test_classes_are_searched_once_for_their_methods():
    assert braces._methods(F.col("c"))._jc.toString().count("regexp_extract_all") <= 2
