"""Operators on literals: code metrics, signatures, diffs, graphs, chunks, lint, traceability, rendering."""

from __future__ import annotations

import math
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratalith.operators import coverage, diff, graph, incoherence, lint, metrics, ranking, rendering, retrieval, sequences, trace

CODE = """import { a } from './lib/a';
import './side';
const x = require('./b');
export function add(n: number, m): number {
  // if (hidden)
  if (n > 1 && m) {
    for (const i of []) { return n; }
  } else if (m) {
    throw new RangeError('no');
  }
  return n ? m : 0;
}
export class Box extends Base implements Kept { }
interface Shape { b: string; a: number }
type Id = string | number;
const twice = async (v: number): number => { return v * 2; };
"""


def files(spark, *rows):
    return spark.createDataFrame([(p, c) for p, c in rows], "path string, content string")


def one(df):
    return df.first().asDict(recursive=True)


# --- metrics ---------------------------------------------------------------------------


def plain_last_line(lines, line):
    """The walk over the characters that the brace index replaces."""
    depth, opened = 0, False
    for i in range(line, len(lines)):
        for ch in lines[i]:
            depth += (ch == "{") - (ch == "}")
            opened |= ch == "{"
            if ch == "}" and opened and depth == 0:
                return i
        if opened and depth == 0:
            return line
    return line


def test_brace_index_matches_a_walk():
    rng = random.Random(2)
    for _ in range(300):
        content = "".join(rng.choice("{}{}a\n") for _ in range(rng.randrange(0, 60)))
        lines = content.split("\n")
        braces = metrics.Braces(content)
        assert [braces.last_line(i) for i in range(len(lines))] == [plain_last_line(lines, i) for i in range(len(lines))]


def test_languages(spark):
    python = "# one\ndef run(a, b):\n    '''two\n    three'''\n    return {1: a}  # four\n\ndef stop():\n    pass // 2\n"
    rust = "// one\npub async fn go(a: i32) {\n  if (a > 1) { loop {} }\n}\nfn two() {}\n"
    go = "func (s *T) Get(k string) {\n}\nfunc Put() {\n  /* x\n y */\n}\n"
    df = files(spark, ("a.py", python), ("b.rs", rust), ("c.go", go), ("d.js", "function f(a) {\n}\nconst g = async (x) => { };\n"))
    got = {(r.path, r.name): (r.line, r.end_line) for r in metrics.function_bodies(df).collect()}
    assert got == {("a.py", "run"): (2, 5), ("a.py", "stop"): (7, 7), ("b.rs", "go"): (2, 4), ("b.rs", "two"): (5, 5), ("c.go", "Get"): (1, 2), ("c.go", "Put"): (3, 6), ("d.js", "f"): (1, 2), ("d.js", "g"): (3, 3)}
    all_ = {r.path: r for r in metrics.analyze_complexity(df).collect()}
    # a hash comment, the whole line of another, and a quoted one over two lines
    assert (all_["a.py"].comment_lines, all_["a.py"].code_lines, all_["a.py"].functions) == (4, 4, 2)
    assert (all_["b.rs"].comment_lines, all_["b.rs"].code_lines) == (1, 4) and (all_["c.go"].comment_lines, all_["c.go"].functions) == (2, 2)


def test_many_functions_in_time():
    content = "".join(f"function f{i}(a, b) {{\n  if (a) {{ return {{}}; }}\n}}\n" + "// " + "x" * 150 + "\n" for i in range(5000))
    start = time.time()
    rows = next(metrics._bodies(iter([pd.DataFrame({"path": ["a.ts"], "content": [content], "language": ["typescript"]})])))
    rows = rows[rows.name != "if"]  # the pattern takes a branch for a method
    assert len(rows) == 5000 and rows.end_line.tolist() == [4 * i + 3 for i in range(5000)] and time.time() - start < 5


def test_cyclomatic_and_flow(spark):
    r = one(files(spark, ("a.ts", CODE)).select(metrics.cyclomatic(F.col("content")).alias("c"), metrics.estimated_cyclomatic(F.col("content")).alias("e"), metrics.flow_matrix(F.col("content"), F.lit("add(n): number")).alias("m"), metrics.max_nesting(F.lit("a(b[c]{d})]]]((")).alias("n")))
    # if twice (one in else if), else if, for, ternary (across lines too), &&
    assert r["c"] >= 6 and r["e"] == r["c"] + 1  # the comment's if counts in the estimate
    m = r["m"]
    assert m["error_paths"] == 1 and m["error_types"] == ["RangeError"] and m["early_returns"] == 2 and m["async_boundaries"] == 0
    assert m["conditionals"][0] == "if: hidden" and m["happy_path"] == "Success path after handles 1 error case and 2 early exits → returns number"
    assert r["n"] == 2


def cognitive(content):
    """The fold, line by line."""
    import re

    score = depth = 0
    for line in content.split("\n"):
        for p in metrics.NESTING:
            if re.search(p, line):
                score += 1 + depth
                depth += "{" in line
        score += sum(bool(re.search(p, line)) for p in metrics.SIMPLE)
        depth = max(0, depth + line.count("{") - line.count("}"))
    return score


def test_cognitive_matches_a_fold(spark):
    rng = random.Random(1)
    parts = ["if (x) {", "}", "else {", "for (;;) {", "try {", "} catch (e) {", "a && b || c", "=> {", "break ;", "x ? y : z", "}}", "function f() {", ""]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(40)] + [CODE, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", metrics.cognitive(F.col("t")).alias("c"))
    assert {r.id: r.c for r in df.collect()} == {i: cognitive(t) for i, t in enumerate(texts)}


def test_halstead(spark):
    h = one(spark.range(1).select(metrics.halstead(F.lit("a + b + 'x' + 1; typeof a")).alias("h")))["h"]
    # + three times, typeof; operands a b x a (with x also inside the quotes), 1 and 'x'
    assert (h["operators"], h["unique_operators"]) == (4, 2)
    assert h["operands"] == 6 and h["unique_operands"] == 5
    assert math.isclose(h["difficulty"], 2 / 2 * 6 / 5) and math.isclose(h["effort"], 10 * math.log2(7) * h["difficulty"])
    assert one(spark.range(1).select(metrics.halstead(F.lit("")).alias("h")))["h"]["effort"] == 0


def test_functions_and_overall(spark):
    df = files(spark, ("a.ts", CODE), ("b.ts", ""))
    got = {r["name"]: r for r in metrics.function_complexity(df).collect()}
    assert got["add"]["line"] == 4 and got["add"]["line_count"] == 9 and got["add"]["parameters"] == 2
    assert "async" in got  # an arrow with a return type is named by the word before its parameters
    all_ = {r["path"]: r for r in metrics.analyze_complexity(df).collect()}
    assert all_["b.ts"]["overall"] == 0 and all_["b.ts"]["maintainability"] == pytest.approx((171 - 0.23) * 100 / 171)
    assert all_["a.ts"]["lines"] == 17 and all_["a.ts"]["comment_lines"] == 1


def test_signatures(spark):
    got = {(r["category"], r["name"]): r["hash"] for r in metrics.extract_signatures(files(spark, ("a.ts", CODE))).collect()}
    import hashlib

    h = lambda s: hashlib.md5(s.encode()).hexdigest()[:8]
    assert got["function", "add"] == h("(n: number, m): number") and got["type", "Id"] == h("string | number")
    assert got["class", "Box"] == h("extends Base implements Kept") and got["interface", "Shape"] == h(" {a: number; b: string}")
    assert ("export", "add") in got and ("export", "Box") in got


def test_staleness(spark):
    t = "timestamp'2024-06-01'"
    f = spark.sql(f"SELECT * FROM VALUES ('a', {t}), ('b', CAST(NULL AS TIMESTAMP)), ('c', {t} + INTERVAL 200 DAYS) AS t(path, doc_ts)")
    c = spark.createDataFrame([("a", "removed"), ("a", "signature-changed"), ("c", "added")], "path string, change string")
    h = spark.sql(f"SELECT * FROM VALUES ('a', {t} + INTERVAL 100 DAYS, 21L), ('c', {t}, 3L) AS t(path, ts, recent)")
    got = {r.path: (r.score, r.status) for r in metrics.staleness(f, c, h, F.lit("2024-12-31").cast("timestamp")).collect()}
    assert got == {"a": (8, "very-stale"), "b": (8, "undocumented"), "c": (1, "fresh")}


# --- graphs ----------------------------------------------------------------------------


def test_imports_resolve(spark):
    rows = files(spark, ("src/x.ts", CODE), ("src/p.py", "from os.path import join\nimport sys"))
    from stratalith.functions.text import language_of

    imports = rows.select(F.col("path").alias("importer"), F.posexplode(graph.extract_imports(F.col("content"), language_of(F.col("path")))).alias("pos", "source"))
    assert sorted(r.source for r in imports.filter("importer LIKE '%ts'").collect()) == ["./b", "./lib/a", "./side"]
    assert {r.source for r in imports.filter("importer LIKE '%py'").collect()} >= {"os.path", "sys"}
    there = spark.createDataFrame([("src/lib/a.tsx",), ("src/lib/a.ts",), ("src/b/index.js",)], "path string")
    got = {r.target for r in graph.resolve_imports(imports, there).collect()}
    assert got == {"src/lib/a.ts", "src/b/index.js"}


def test_merge_edges(spark):
    df = spark.createDataFrame([("a", "b", 1, ["x", "y"]), ("a", "b", 0, ["y", "z"]), ("a", "c", 2, ["q", "q"])], "src string, dst string, pos int, imports array<string>")
    assert {(r.src, r.dst): r.imports for r in graph.merge_edges(df).collect()} == {("a", "b"): ["y", "z", "x"], ("a", "c"): ["q", "q"]}


def strong(edges):
    reach = {}
    for s in {x for e in edges for x in e}:
        seen, todo = set(), [s]
        while todo:
            x = todo.pop()
            for a, b in edges:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[s] = seen
    out = {}
    for x in reach:
        own = {y for y in reach[x] if x in reach.get(y, ())} | {x}
        if len(own) > 1:
            out[x] = min(own)
    return out, reach


@pytest.mark.parametrize("seed", range(3))
def test_cycles_closure_and_paths(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(14), rng.randrange(14)) for _ in range(18)] + [(3, 3)]
    df = spark.createDataFrame(edges, "src long, dst long")
    want, reach = strong(set(edges))
    got = {r.id: r.cycle for r in graph.cycle_members(df).collect()}
    assert got == want
    marked = {(r.src, r.dst): r.in_cycle for r in graph.mark_circular(df, graph.cycle_members(df)).collect()}
    assert marked == {e: e[0] in want and want.get(e[0]) == want.get(e[1]) for e in edges}
    seeds = spark.createDataFrame([(edges[0][0],)], "seed long")
    assert {r.id for r in graph.transitive_closure(df, seeds).collect()} == reach[edges[0][0]]
    goal = max(reach[edges[0][0]])
    pairs = spark.createDataFrame([(edges[0][0], goal), (edges[0][0], 99)], "start long, goal long")
    path = one(graph.shortest_paths(df, pairs))["path"]
    assert path[0] == edges[0][0] and path[-1] == goal and all((a, b) in edges for a, b in zip(path, path[1:], strict=False))


def test_topological_levels(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 3)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    assert {r.id: r.level for r in graph.topological_levels(nodes, df).collect()} == {1: 0, 4: 0, 5: 0, 2: 1, 3: 2}
    with pytest.raises(ValueError, match="cycles"):
        graph.topological_levels(nodes, spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long"))


def test_impact(spark):
    edges = spark.createDataFrame([("m:a", "s"), ("n:b", "s"), ("n:b", "s"), ("o:c", "m:a"), ("p:d", "o:c"), ("q:e", "p:d"), ("r:f", "q:e")], "src string, dst string")
    nodes = spark.createDataFrame([("m:a", "mod", True)], "id string, module string, exported boolean")
    r = one(graph.analyze_impact(edges, spark.createDataFrame([("s",)], "seed string"), nodes))
    assert (r["direct"], r["transitive"], r["modules"], r["exports"], r["blast_radius"], r["level"]) == (3, 3, 5, 1, 6, "medium")


def test_call_graph_and_participants(spark):
    s = spark.createDataFrame([("f", "function"), ("g", "method"), ("C", "class")], "id string, kind string")
    calls = spark.createDataFrame([("f", "g", 1), ("g", "h", 0)], "src string, dst string, pos int")
    got = {r.id: (r.is_entry, r.is_leaf) for r in graph.call_graph(s, calls).collect()}
    assert got == {"f": (True, False), "g": (False, False)}
    assert [r.id for r in graph.participants(calls).collect()] == ["g", "h", "f"]
    assert "sequenceDiagram" in one(rendering.sequence_diagram(calls.withColumn("label", F.lit("x"))))["text"]


# --- sequences -------------------------------------------------------------------------


def test_greedy_chunks(spark):
    rng = random.Random(1)
    rows = [(m, p, rng.randrange(1, 90)) for m in range(5) for p in range(30)]
    got = {(r.module, r.pos): r.chunk for r in sequences.greedy_chunks(spark.createDataFrame(rows, "module int, pos int, tokens int"), 300).collect()}
    for m in range(5):
        used = chunk = 0
        for p in range(30):
            t = next(x for a, b, x in rows if (a, b) == (m, p))
            if used and used + t > 100:
                chunk, used = chunk + 1, 0
            used += t
            assert got[m, p] == chunk


def test_windows_and_sections(spark):
    text = "\n".join(f"line {i} " + "x" * 40 for i in range(100))
    got = sequences.text_windows(files(spark, ("a", text), ("b", "short"))).collect()
    assert {r.path for r in got} == {"a"} and got[0].line_start == 0
    for before, after in zip(got, got[1:], strict=False):
        assert after.line_start == before.line_end - 12  # 13 lines are carried over
        assert after.content == "\n".join(text.split("\n")[after.line_start : after.line_end + 1])
    md = "intro\n# One\n" + "a" * 300 + "\n## Two\nshort\n# Three\n" + "b" * 400
    rows = sequences.sections(files(spark, ("d.md", md))).collect()
    assert {(r.symbol, r.line_start, r.line_end) for r in rows if r.level == "symbol"} == {("One", 1, 2), ("Three", 5, 6)}
    assert sum(r.level == "file" for r in rows) == 1


def test_commit_chunks(spark):
    c = spark.createDataFrame([("s1", "fix", "diff --git a/x b/x\n+1\ndiff --git a/y b/y\n-2")], "sha string, msg string, diff string")
    rows = sequences.commit_chunks(c).collect()
    assert {r.path for r in rows} == {"s1", "x", "y"} and rows[0].content.startswith("fix\n\n2 files (+1/-1)")


def test_semantic_tokens(spark):
    rows = spark.createDataFrame([("f", 0, 1, 4), ("f", 1, 0, 3), ("f", 2, 2, 1), ("f", 3, 0, 5)], "file string, i int, delta_line int, delta_char int")
    got = [(r.line, r.character) for r in sequences.semantic_tokens(rows).orderBy("i").collect()]
    assert got == [(1, 4), (1, 7), (3, 1), (3, 6)]
    assert one(spark.range(1).select(sequences.modifier_names(F.lit(5), ["a", "b", "c"]).alias("x")))["x"] == ["a", "c"]


# --- lint, traceability, incoherence -----------------------------------------------------


@pytest.fixture
def symbols(spark):
    schema = "path string, name string, kind string, description string, return_type string, modifiers array<string>, examples array<string>, signature string, params array<struct<name:string,description:string>>, refs array<string>"
    return spark.createDataFrame(
        [
            ("m", "f", "function", "TODO: write", "string", ["export"], [], "f() {}", [("x", ""), ("count", "n")], ["#/definitions/g", "#/definitions/gone"]),
            ("m", "g", "class", " \n ", None, ["private"], ["g()"], "class g", [], []),
        ],
        schema,
    )


def test_lint(spark, symbols):
    got = sorted((r.rule, r.name) for r in lint.lint(symbols).collect())
    assert got == sorted([("missing-description", "g"), ("missing-param-description", "f"), ("missing-return-description", "f"), ("missing-example", "f"), ("placeholder", "f"), ("stub", "f"), ("generic-parameter", "f"), ("broken-reference", "f")])
    assert lint.lint(symbols, dict.fromkeys([r for r in lint.RULES if r != "stub"], "off") | {"stub": "error"}).first().severity == "error"
    exports = spark.createDataFrame([("m", "f"), ("m", "g"), ("m", "h")], "path string, name string")
    assert {r.name for r in lint.undocumented_exports(exports, symbols).collect()} == {"g", "h"}
    told = spark.createDataFrame([("m", "f", ["x", "old"])], "path string, name string, names array<string>")
    assert [r.param for r in lint.outdated_params(told, symbols).collect()] == ["old"]
    assert one(spark.range(1).select(lint.outdated_return(F.lit("Str ing"), F.lit("string")).alias("a"), lint.outdated_return(F.lit("int"), F.lit("string")).alias("b"))) == {"a": False, "b": True}


def test_traceability(spark):
    code = trace.specs_in_code(files(spark, ("a.ts", "/** @requirement R-1, R-2\n * @see docs */\n// REQ-7\n// TODO: ABC-12")))
    assert {(r.id, r.type, r.line) for r in code.collect()} == {("R-1", "requirement", 1), ("R-2", "requirement", 1), ("docs", "doc", 2), ("7", "requirement", 3), ("ABC-12", "ticket", 4)}
    docs = trace.specs_in_docs(files(spark, ("s.md", "# REQ-7 login\n- [x] REQ-8: show it\n## Spec A1\ntext")))
    assert {r.id for r in docs.collect()} == {"7", "8", "A1"}
    states = {r.id: r.state for r in trace.cross_reference(code, docs).collect()}
    assert states == {"7": "implemented", "ABC-12": "implemented", "8": "unimplemented", "A1": "unimplemented"}
    assert one(trace.trace_report(trace.cross_reference(code, docs), docs))["coverage"] == pytest.approx(200 / 3)


def test_incoherence(spark):
    schema = "id string, path string, symbol string, kind string, content string, signature string, visibility string, exported boolean, complexity int, vec array<double>"
    row = lambda i, s, c, v, sig="f(a): string": (i, "p", s, "function", c, sig, "public", True, 9, v)
    code = spark.createDataFrame([row("1", "lone", "x", [1.0, 0.0]), row("2", "said", "throw x", [0.0, 1.0])], schema)
    docs = spark.createDataFrame([row("3", "said", "about it", [-1.0, 0.2]), row("4", "gone", "old", [-1.0, -1.0])], schema)
    got = {(r.type, r.id): r.severity for r in incoherence.find_incoherence(code, docs).collect()}
    assert got[("missing", "1")] == pytest.approx(0.9) and got[("orphaned", "4")] == 0.5 and got[("incomplete", "2")] == 0.75
    assert set(got) == {("missing", "1"), ("orphaned", "4"), ("incomplete", "2"), ("mismatch", "2")}
    issues = incoherence.find_incoherence(code, docs)
    score = one(incoherence.file_scores(code, docs, issues))
    assert score["issues"] == 4 and 0 <= score["score"] <= 1
    assert sum(r.total for r in incoherence.project_summary(issues).collect()) == 4


# --- coverage, diffs, ranking, texts -----------------------------------------------------


def test_hardening(spark, symbols):
    files_ = spark.createDataFrame([("README.md",), ("LICENCE",)], "name string")
    checks = coverage.hardening_checks(files_, coverage.quality_measures(symbols))
    got = one(coverage.hardening_score(checks))
    assert got["is_complete"] and got["passed"] + got["failed"] == 8
    assert "- [x] has-readme" in one(rendering.checklist_markdown(checks))["text"]


def test_flow_comparison(spark):
    schema = "symbol string, branches int, error_paths int, level string, errors array<string>"
    b = spark.createDataFrame([("f", 1, 0, "trivial", []), ("g", 2, 1, "simple", ["E"])], schema)
    a = spark.createDataFrame([("f", 6, 0, "moderate", []), ("g", 2, 1, "simple", ["E"])], schema)
    got = {r.symbol: (r.branch_delta, r.breaking) for r in diff.compare_flow(b, a).collect()}
    assert got == {"f": (5, True), "g": (0, False)}


def test_rendering(spark, symbols):
    rows = symbols.withColumnRenamed("path", "module").withColumn("params", F.transform("params", lambda p: F.struct(p["name"].alias("name"), F.lit("a|b").alias("type"), F.lit(False).alias("optional"), p["description"].alias("description"))))
    text = one(rendering.module_markdown(rows))["text"]
    assert text.startswith("# m\n\n### class\n- [g](#g)") and "| x | a\\|b | Yes |" in text
    assert "type g {" in one(rendering.graphql_types(symbols))["text"]
    head = rendering.front_matter(spark.createDataFrame([("s1", 2, 0, 0)], "snapshot_id string, modules long, exports long, documented long"))
    assert {(r.key, r.value) for r in rendering.parse_front_matter(head.withColumnRenamed("snapshot_id", "id")).collect()} == {("id", "s1"), ("modules", "2"), ("exports", "0"), ("coverage", "100.0")}
    changes = spark.createDataFrame([("p", "a", "added", False, "minor"), ("p", "b", "removed", True, "major")], "path string, name string, change string, breaking boolean, semver string")
    assert one(rendering.changelog_markdown(diff.changelog_sections(changes)))["text"].startswith("## Breaking Changes\n\n- p: b removed")
    assert {r.description for r in diff.describe_changes(changes).collect()} == {"New export 'a'", "Export 'b' removed - BREAKING"}


def test_trees_and_definitions(spark):
    t = spark.createDataFrame([(1, None, 0), (2, 1, 0), (3, 1, 1), (4, 2, 0), (5, None, 1)], "id long, parent_id long, pos int")
    assert [(r.id, r.depth) for r in ranking.flatten_tree(t).collect()] == [(1, 0), (2, 1), (4, 2), (3, 1), (5, 0)]
    s = spark.createDataFrame([("m", "a", None, 0, 0), ("m", "b", "a", 1, 1), ("m", "a", None, 0, 2)], "module string, name string, parent string, depth int, pos int")
    assert {(r.key, r.pos) for r in ranking.module_definitions(s).collect()} == {("a", 2), ("a.b", 1)}


def test_ranking(spark):
    s = spark.createDataFrame([("p", "add", 10, "function", False), ("q", "adder", 1, "variable", True)], "path string, name string, line int, kind string, deprecated boolean")
    assert [r.relevance for r in ranking.completions(s, "AD", "p", 12).collect()] == [178, 0]
    n = spark.createDataFrame([("a", 1.0, 0.0), ("b", 1.0, 90.0), ("c", 1.0, None)], "path string, importance double, coverage double")
    assert [r.path for r in ranking.by_need(n).collect()] == ["a", "c", "b"]
    assert one(ranking.newest(spark.createDataFrame([], "id string, created long"), "auto"))["id"] == "auto"


def test_retrieval_edges(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, ""), (3, "gamma")], "id long, text string")
    q = spark.createDataFrame([(1, "beta beta"), (2, "nothing here")], "qid long, text string")
    rows = retrieval.bm25_scores(q, docs).collect()
    n, df, tf, length, avg = 3, 1, 2, 3, 4 / 3
    want = 2 * math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg))
    assert len(rows) == 1 and rows[0].id == 1 and rows[0].bm25 == pytest.approx(want)
