"""Extraction, chunks, contexts and plain filters on literals."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stratalith.operators import extraction, filters

CODE = """/** Adds. */
export function add(a: number): number { return a; }
function _hidden() {}
export default class Box {}
export { x, y as z };
export type Id = string;
"""


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string")


def test_symbols(spark):
    got = {(r.kind, r.name): (r.line, r.signature, r.exported) for r in extraction.extract_symbols(files(spark, ("a", CODE), ("b", None))).collect()}
    assert got["function", "add"] == (1, "(a: number): number", True) and got["class", "Box"][2] is False and ("function", "_hidden") not in got
    assert got["type", "Id"] == (6, "Id", True)


def test_exports(spark):
    rows = extraction.extract_exports(files(spark, ("a", CODE + "export { x };"), ("b", "pub struct S;\npub async fn go() {}"), ("c", "__all__ = ['p', \"q\"]\n"), ("d", "func Run() {}\nfunc run() {}")))
    got = {}
    for r in rows.orderBy("path", "pos").collect():
        got.setdefault(r.path, []).append((r.name, r.is_default, r.is_type_only))
    assert got["a"] == [("add", False, False), ("Box", True, False), ("x", False, False), ("z", False, False), ("Id", False, True)]
    assert [n for n, _, _ in got["b"]] == ["S", "go"] and [n for n, _, _ in got["c"]] == ["p", "q"] and [n for n, _, _ in got["d"]] == ["Run"]
    merged = extraction.merge_exports(rows.filter("name = 'x'"), rows.filter("path = 'a'"))
    assert merged.count() == 5


def test_types(spark):
    t = spark.createDataFrame([(1, "string | Foo & Bar[]"), (2, "A[][]"), (3, " Null ")], "id int, raw string")
    got = {(r.id, tuple(r.path)): r.kind for r in extraction.parse_types(t).collect()}
    assert got[1, ()] == "array" and got[1, (0,)] == "union" and got[1, (0, 0)] == "primitive" and got[1, (0, 1)] == "intersection"
    assert got[2, (0, 0)] == "reference" and got[3, ()] == "primitive"


def test_chunks(spark):
    s = spark.createDataFrame([("p", "f", "function", "export function f(a) {" + " x" * 120 + "}"), ("p", "g", "function", "short")], "path string, name string, kind string, text string")
    rows = extraction.symbol_chunks(s).collect()
    assert len(rows) == 1 and rows[0].signature == "export function f(a)" and rows[0].visibility == "public" and rows[0].exported
    c = spark.createDataFrame([("p", 3, "/** " + "word " * 60 + "*/", "f")], "path string, line int, text string, symbol string")
    assert extraction.comment_chunks(c).first().content.startswith("word word")
    r = spark.createDataFrame([(7, "T", "B", ["c1", "c2"])], "num int, title string, body string, comments array<string>")
    assert extraction.request_chunks(r).first().content == "# T\n\nB\n\n## Discussion\n- c1\n- c2"
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(extraction.file_context(F.lit("import a\nfoo\n// c\nbar"))) == "import a\n// c"
    assert one(extraction.prepare(F.lit("docs"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("x" * 3000))) == ("[documentation]\n" + "x" * 3000)[:2000]
    v = one(extraction.hashed_embedding(F.array(F.lit("a"), F.lit("b"), F.lit("a")), 8))
    assert len(v) == 8 and sum(x * x for x in v) == pytest.approx(1)
    assert one(extraction.hashed_embedding(F.array().cast("array<string>"), 4)) == [0.0] * 4


def test_contexts(spark):
    s = spark.createDataFrame([("m", 0, "C", "C", "class", [], "e1", None), ("m", 1, "C.go", "go", "method", [], None, "#/definitions/run"), ("m", 2, "size", "size", "property", ["#/definitions/C"], "e2", None)], "module string, pos int, qualified string, name string, kind string, refs array<string>, example string, replacement string")
    exports = spark.createDataFrame([("m", "go"), ("m", "C")], "path string, name string")
    assert extraction.module_purpose(s, exports).first().text == "Module providing class, method, property definitions. Main exports: C, go."
    r = extraction.class_members(s).first()
    assert (r.name, r.methods, r.properties) == ("C", ["go"], ["size"])
    r = extraction.usage_patterns(s).first()
    assert r.usage == ["C: e1", "size: e2"] and r.practices == ["Use run instead of go"]
    cov = spark.createDataFrame([("a", 10, 2), ("b", 0, 0), ("c", 4, 4)], "path string, symbols int, documented int")
    imp = spark.createDataFrame([("a", 8.0), ("c", 9.0)], "path string, score double")
    assert [(x.path, x.percent, x.advice) for x in extraction.coverage_report(cov, imp).collect()] == [("a", 20.0, "document the public symbols"), ("c", 100.0, "good")]
    assert extraction.coverage_report(cov, imp, True).count() == 3
    note = spark.range(1).select(extraction.migration_note(F.lit("removed"), F.lit("f"), F.array().cast("array<string>")).alias("x")).first().x
    assert "`f` export has been removed" in note


def test_dependency_tree(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 4), (4, 1)], "src long, dst long")
    rows = extraction.dependency_tree(e, spark.createDataFrame([(1,)], "root long"), 2).collect()
    assert {(r.parent, r.id, r.level) for r in rows} == {(None, 1, 0), (1, 2, 1), (1, 3, 1), (3, 4, 2)}
    assert len(extraction.dependency_tree(e, spark.createDataFrame([(1,)], "root long"), 2, 1).collect()) == 3


def test_filters(spark):
    c = spark.createDataFrame([("code", "symbol"), ("docs", "file"), ("comments", "symbol")], "type string, level string")
    assert filters.code_symbols(c).count() == 1 and filters.doc_chunks(c).count() == 2
    m = spark.createDataFrame([("a", "Alpha", "d", "chat", ["text"], True, 2), ("b", "Beta", None, "code", ["image"], False, 3), ("c", "Gamma", "", "chat", ["text"], False, 5)], "id string, name string, description string, category string, modalities array<string>, is_cached boolean, created long")
    assert [r.id for r in filters.filtered_models(m, "chat", True).collect()] == ["a"] and filters.filtered_models(m, query="BET").count() == 1
    assert [r.id for r in filters.model_options(m).orderBy("pos").collect()] == ["auto", "c", "a"]
    one = lambda x: spark.range(1).select(x.alias("x")).first().x
    assert tuple(one(filters.parse_collection(F.lit("code_symbol")))) == ("code", "symbol") and one(filters.parse_collection(F.lit("code_nothing"))) is None
    assert one(filters.symbol_kind(F.lit(11), {"11": "function"})) == "function" and one(filters.symbol_kind(F.lit(99), {"11": "function"})) == "variable"
    r = spark.createDataFrame([("x", "error"), ("y", "info")], "rule string, severity string")
    assert [tuple(x) for x in filters.with_severity(r, {"x": "off", "y": "warning"}).collect()] == [("y", "warning")]
    assert filters.merged_config({"a": {"x": 1, "y": 2}, "b": [1]}, {"a": {"x": 3}, "b": [2], "c": None}) == {"a": {"x": 3, "y": 2}, "b": [2], "c": None}
    checks = spark.createDataFrame([("a", "error", False), ("b", "info", True)], "id string, severity string, passed boolean")
    assert filters.failed_checks(checks).count() == 1 and filters.checks_by_severity(checks, "info").first().id == "b"
    f = spark.createDataFrame([(" ", "ts", ["a"]), ("u", "", ["a"]), ("u", "ts", None), ("u", "ts", [])], "uri string, language_id string, symbols array<string>")
    assert [x.error for x in filters.valid_extractions(f).collect()] == ["uri is empty", "language is empty", "symbols are missing", None]
    e = spark.createDataFrame([("Src/A", "fresh"), ("lib", "stale")], "path string, status string")
    assert filters.filtered_entries(e, "fresh", "src").count() == 1 and filters.filtered_entries(e).count() == 2
    n = spark.createDataFrame([(None, None, None)], "name string, signature string, modifiers array<string>")
    assert tuple(filters.normalized_symbols(n).first()) == ("unknown", "", [])
