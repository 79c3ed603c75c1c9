"""The block-structured scanner and the resolution of names, on literals."""

import time

import pytest
from pyspark.sql import functions as F

from stratalith.functions.text import language_of
from stratalith.operators import names, scanner

TS = '''import def, { a as b, c } from './x';
import * as ns from "../y";
export { d as e } from './z';
/** Doc of A. */
export class A<T> extends B {
  // function fake() { class Nope {
  private text = `class X { ${[1,2].map((q) => { return `${q}}`; }).join("}")} function y() {`;
  static readonly re = /[{"'`]/g;
  /** runs */
  async run(count: number, o = { a: 1 }): Promise<string> { const inner = () => { return this.size() }; if (count) { return inner(); } return "}{"; }
  abstract size(): number;
  get value() { return 1 }
  constructor(private x: string) { super(); }
  @dec({a: 1}) on(e: {t: string}) { }
}
interface I { m(a: string): void; p?: { q: number }; other: () => void }
type T1 = { a: string } | 'function z() {'
enum E { A = 1, B }
const f = async (x: number) => x + 1
export default function main() {
  function nested() { class Deep { go() {} } }
  return c(b, ns.q(new A()));
}
'''
TS_TREE = [
    (-1, "class", "A", 5, 15), (0, "field", "text", 7, 7), (0, "field", "re", 8, 8), (0, "method", "run", 10, 10), (3, "function", "inner", 10, 10), (0, "method", "size", 11, 11), (0, "method", "value", 12, 12),
    (0, "constructor", "constructor", 13, 13), (0, "method", "on", 14, 14), (-1, "interface", "I", 16, 16), (9, "method", "m", 16, 16), (9, "field", "p", 16, 16), (9, "field", "other", 16, 16), (-1, "type", "T1", 17, 17),
    (-1, "enum", "E", 18, 18), (-1, "function", "f", 19, 19), (-1, "function", "main", 20, 23), (16, "function", "nested", 21, 21), (17, "class", "Deep", 21, 21), (18, "method", "go", 21, 21),
]
PY = '''from .a import (b, c as d)
import os.path as p
X = 1
class A(Base):
    """Doc "class B:" of A."""
    y: int = 3
    async def run(self, x={"def": 1}):
        \'\'\'runs\'\'\'
        def inner():
            return """
def fake(): pass
"""
        return inner()

    @property
    def size(self): return 1

# def no(): pass
## the last
def last():
    return A().run()
'''
PY_TREE = [(-1, "constant", "X", 3, 3), (-1, "class", "A", 4, 16), (1, "field", "y", 6, 6), (1, "method", "run", 7, 13), (3, "function", "inner", 9, 12), (1, "method", "size", 16, 16), (-1, "function", "last", 20, 21)]
OTHERS = {
    "a.rs": ("/// Doc\npub struct P<'a> { x: &'a str, c: char }\nimpl<'a> P<'a> { pub fn new(s: &'a str) -> Self { let q = '{'; P { x: s, c: q } } }\npub trait T { fn t(&self); }\nmod m { pub(crate) fn inner() {} }\n", ["class P", "class P", "method new", "variable q", "interface T", "method t", "module m", "function inner"]),
    "a.go": ("package main\n// Doc\ntype S struct {\n\tA int\n}\nfunc (s *S) Run(x int) error { return nil }\nfunc main() { s := S{1}; s.Run(`}{`) }\n", ["class S", "method Run", "function main"]),
    "A.java": ('public class J { private final int x = 3; public J(int a) { } @Override public String toString() { return "}"; } enum K { A, B } }', ["class J", "field x", "constructor J", "method toString", "enum K"]),
}
FILES = "path string, content string"


def test_trees(spark):
    rows = [("a.ts", TS), ("a.py", PY), ("none.ts", None), ("empty.py", ""), *[(p, c) for p, (c, _) in OTHERS.items()]]
    files = spark.createDataFrame(rows, FILES).withColumn("language", F.when(F.col("path") == "A.java", "java"))
    got = scanner.symbol_tree(files.withColumn("language", F.coalesce("language", language_of(F.col("path"))))).orderBy("path", "pos").collect()
    tree = lambda path: [(r["parent"], r["kind"], r["name"], r["line"], r["end_line"]) for r in got if r["path"] == path]
    assert tree("a.ts") == TS_TREE and tree("a.py") == PY_TREE
    for path, (_, want) in OTHERS.items():
        assert [f"{r['kind']} {r['name']}" for r in got if r["path"] == path] == want
    by = {(r["path"], r["name"]): r for r in got}
    assert by["a.ts", "A"]["documentation"] == "Doc of A." and by["a.ts", "run"]["documentation"] == "runs" and by["a.ts", "size"]["documentation"] is None
    assert by["a.py", "A"]["documentation"] == 'Doc "class B:" of A.' and by["a.py", "last"]["documentation"] == "the last" and by["a.rs", "t"]["documentation"] is None
    assert by["a.ts", "run"]["signature"] == "async run(count: number, o = { a: 1 }): Promise<string>" and by["a.ts", "run"]["modifiers"] == ["async"]
    assert by["a.ts", "text"]["visibility"] == "private" and by["a.ts", "main"]["exported"] and not by["a.ts", "f"]["exported"]
    docs = scanner.doc_comments(spark.createDataFrame(rows, FILES)).collect()
    assert {(r["path"], r["line"], r["symbol"]) for r in docs} == {("a.ts", 4, "A"), ("a.ts", 9, "run"), ("a.py", 5, "A"), ("a.py", 8, "run"), ("a.py", 19, "last"), ("a.rs", 1, "P")}
    imports = scanner.import_bindings(spark.createDataFrame(rows, FILES)).filter("path LIKE 'a.%'").collect()
    assert {tuple(r)[2:] for r in imports if r["path"] == "a.ts"} == {("./x", "a", "b", False), ("./x", "c", "c", False), ("./x", "default", "def", False), ("../y", "*", "ns", False), ("./z", "d", "e", True)}
    assert {tuple(r)[2:] for r in imports if r["path"] == "a.py"} == {(".a", "b", "b", False), (".a", "c", "d", False), ("os.path", "*", "p", False)}


@pytest.mark.parametrize("language", ["typescript", "python", "rust", "go", "java"])
def test_broken_texts_do_not_crash(language):
    pieces = ["{" * 50, "}" * 50, "class", "class A {", "`${`${", "/*", "'", '"""', "function (", "const {a} = b", "", "\x00 \U0001f600", "class A { m( }", "export", "@", "(", "export default", "impl", "func (", "def", "async def", "import", "from x import", "import {", "export * from", "/[", "a\r\nb"]
    for a in pieces:
        for b in pieces:
            text = a + " " + b
            found, symbols, _ = scanner.structure(text, language)
            assert "".join("".join(t.text for t in found).split()) == "".join(text.split())
            assert all(0 <= s.at <= s.end <= len(text) and s.parent < s.pos for s in symbols)
            list(scanner._use_rows(text, language)), list(scanner._import_rows(text, language))


@pytest.mark.parametrize(("text", "language"), [(TS, "typescript"), (PY, "python"), ("{ ( [ ", "typescript"), ("=/[", "typescript"), ("=/a ", "typescript"), ("'\\a", "rust"), ('"', "python"), ("`${", "typescript"), ("/** x */ ", "typescript")])
def test_time_is_linear(text, language):
    took = []
    for n in (1 << 17, 1 << 20):
        whole = text * (n // len(text))
        start = time.process_time()
        scanner.structure(whole, language), list(scanner._use_rows(whole, language)), list(scanner._import_rows(whole, language))
        took.append(time.process_time() - start)
    assert took[1] < 24 * took[0] + 1


MODULES = [
    ("src/base.ts", "export class Base { size(): number { return 1; } }\nexport function helper() { return 0; }\nexport default function start() { helper(); }\n"),
    ("src/again.ts", "export { helper as aid } from './base';\nexport * from './base';\n"),
    ("src/far.ts", "export * from './again';\n"),
    ("src/user.ts", "import begin, { aid } from './far';\nimport go from './base';\nimport * as all from './again';\nimport { Base } from './far';\nexport class User extends Base {\n  run(helper: number): number { this.size(); this.walk(); return aid(); }\n  walk(): Base { const aid = () => 2; aid(); go(); all.helper(); return new Base(); }\n}\nfunction local() { return local(); }\nlocal();\n"),
]


def test_names(spark):
    files = spark.createDataFrame(MODULES, FILES)
    symbols = scanner.symbol_tree(files).withColumn("id", F.concat_ws("#", "path", "pos"))
    name = {r["id"]: f"{r['path'][4:-3]}.{r['name']}" for r in symbols.collect()}
    got = names.resolve_names(files)
    edges = {(name.get(r["src"]), name[r["dst"]], r["calls"]) for r in names.text_call_edges(got, symbols).collect()}
    assert edges == {
        ("base.start", "base.helper", 1), ("user.run", "base.helper", 1), ("user.run", "user.walk", 1), ("user.walk", "user.aid", 1), ("user.walk", "base.start", 1),
        ("user.walk", "base.helper", 1), ("user.walk", "base.Base", 1), ("user.local", "user.local", 1), (None, "user.local", 1),
    }
    refs = {(name[r["target"]], r["path"], r["line"]) for r in names.references(got).collect()}
    assert {("base.Base", "src/user.ts", 5), ("base.Base", "src/user.ts", 7), ("base.helper", "src/user.ts", 6), ("user.aid", "src/user.ts", 7)} <= refs
    types = {(r["path"], r["name"], name[r["target"]]) for r in names.type_targets(got, symbols).collect()}
    assert types == {("src/user.ts", "Base", "base.Base")}
    said = {(r["path"], r["name"]): r["contents"] for r in names.hovers(got, symbols.withColumn("documentation", F.lit("Doc."))).collect()}
    assert said["src/user.ts", "local"] == "function local()\n\nDoc."
    assert names.resolve_names(files.filter("false")).collect() == []
