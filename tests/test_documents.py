"""Documents laid out as numbered blocks, their files, and variants of queries."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stratalith.functions import text
from stratalith.operators import documents, rendering
from stratalith.sources.block_files import read_lines, write_blocks, write_files

CALLS = "src string, dst string, pos long, calls int, recursive boolean"
EDGES = "src string, dst string, pos long, imports int, in_cycle boolean"
EXPORTS = "path string, name string, signature string, description string, deprecated boolean"


def said(blocks):
    rows = sorted(blocks.collect())
    assert [r.n for r in rows] == list(range(len(rows)))
    return "\n".join(r.text for r in rows)


def test_dependency_chart(spark):
    nodes = spark.createDataFrame([("a/b.ts", "a/b.ts"), ("c(1)", 'x/"c(1)"'), ("_", "")], "id string, path string")
    edges = spark.createDataFrame([("c(1)", "a/b.ts", 2, 1, True), ("a/b.ts", "c(1)", 1, 2, False), ("_", "_", 3, 0, True), ("_", "_", 4, None, None)], EDGES)
    assert said(documents.dependency_chart(nodes, edges)).split("\n") == [
        "graph TD", "    node[unknown]", "    a_b_ts[b.ts]", "    c_1['c1']", "    a_b_ts -->|2 imports| c_1", "    c_1 -->|1 import| a_b_ts", "    node --> node", "    node --> node",
        "    linkStyle 1 stroke:red,stroke-width:2px", "    linkStyle 2 stroke:red,stroke-width:2px",
    ]
    assert said(documents.dependency_chart(nodes.limit(0), edges.limit(0))) == "graph TD"


def test_call_chart(spark):
    nodes = spark.createDataFrame([("m:f", "f", True, False), ("m:g", None, False, True), ("m:h", "h", True, True), ("m:i", "i", None, None)], "id string, name string, is_entry boolean, is_leaf boolean")
    calls = spark.createDataFrame([("m:f", "m:g", 0, 3, False), ("m:f", "m:f", 1, None, True)], CALLS)
    assert said(documents.call_chart(nodes, calls)).split("\n") == [
        "graph TD", "    m_f([f])", "    m_g(m:g)", "    m_h([h])", "    m_i[i]", "    m_f -->|3 calls| m_g", "    m_f --> m_f",
        "    style m_f fill:#90EE90,stroke:#228B22", "    style m_h fill:#90EE90,stroke:#228B22", "    style m_g fill:#ADD8E6,stroke:#4682B4", "    style m_h fill:#ADD8E6,stroke:#4682B4",
        "    linkStyle 1 stroke:orange,stroke-width:2px",
    ]


def test_sequence_chart(spark):
    calls = spark.createDataFrame([("b", "a", 1, 1, False), ("a", "a", 2, 2, True)], CALLS)
    assert said(documents.sequence_chart(calls)) == "sequenceDiagram\n    participant b as b\n    participant a as a\n\n    b->>a: call\n    a-->>a: 2 calls\n    Note right of a: recursive"
    assert said(documents.sequence_chart(calls.limit(0))) == "sequenceDiagram\n    Note over System: No calls to display"


def test_checklist(spark):
    kind = "name string, severity string, passed boolean, value string, target string"
    rows = [("B", "error", False, "x", "y"), ("A", "error", True, "x", "y"), ("C", "info", False, "40%", "80%"), ("C", "info", False, "40%", "80%")]
    assert said(documents.checklist(spark.createDataFrame(rows, kind))) == (
        "# Documentation Hardening Checklist\n\n**Score: 25%** (1/4 checks passed)\n\n## Critical\n\n- ✅ **A**: Pass\n- ❌ **B**: Fail\n\n## Recommendations\n\n- ℹ️ **C**: 40% (target: 80%)\n- ℹ️ **C**: 40% (target: 80%)\n"
    )
    assert said(documents.checklist(spark.createDataFrame([], kind))) == "# Documentation Hardening Checklist\n\n**Score: 0%** (0/0 checks passed)\n"


def test_change_log(spark):
    before = spark.createDataFrame([("m", "a", "a()", "", False), ("m", "b", "b()", "", False), ("m", "d", "d()", "", False), ("gone", "x", "x()", "", False)], EXPORTS)
    after = spark.createDataFrame([("m", "b", "b(n)", "", False), ("m", "c", "c()", "", False), ("m", "d", "d()", "", True)], EXPORTS)
    log = said(documents.change_log(before, after, "v1", "v2", "today"))
    head, body = log.split("## Module Changes\n\n")
    assert "> Comparing v1 to v2" in head and "**MAJOR**" in head and "- Breaking changes: 3" in head
    assert body == (
        "- - `gone` **BREAKING**\n\n## Breaking Changes\n\n### gone\n\n- **-** `x` **BREAKING**\n  - Export 'x' removed - BREAKING\n\n### m\n\n- **-** `a` **BREAKING**\n  - Export 'a' removed - BREAKING\n\n"
        "## Deprecations\n\n- **⚠** `d`\n  - 'd' deprecated\n\n## New Features\n\n- **+** `c`\n  - New export 'c'\n\n"
        "## Other Changes\n\n- **~** `b`\n  - 'b' modified\n  - Signature changed:\n    - Before: `b()`\n    - After: `b(n)`\n\n---\n\n*Generated at today*"
    )
    none = said(documents.change_log(before.limit(0), after.limit(0), "v1", "v2", "today"))
    assert "**NONE**" in none and none.endswith("- Modules affected: 0\n\n---\n\n*Generated at today*")


@pytest.mark.parametrize("parts", [1, 7])
def test_schema_file_round_trip(spark, tmp_path, parts):
    """The files in the order of their names are the document; a block may have several lines, and equal blocks are many."""
    rows = [("m", f"T{i:04}", "class", f'said "{i}"\nagain') for i in range(300)] + [("m", "f", "function", "no")] + [("z", "Same", "type", None)] * 400
    symbols = spark.createDataFrame(rows, "path string, name string, kind string, description string").repartition(parts)
    blocks = documents.schema_file(symbols)
    want = said(blocks)
    assert want.count("type Same {") == 400 and '"""said \\"7\\"\nagain"""\ntype T0007 {\n  _id: ID\n}\n' in want
    write_blocks(blocks, str(tmp_path / "out"))
    files = sorted(p for p in Path(tmp_path / "out").glob("part-*"))
    assert "".join(p.read_text() for p in files) == want + "\n"
    lines = sorted(read_lines(spark, str(tmp_path / "out")).collect())
    assert "\n".join(r.text for r in lines) == want


def test_many_equal_blocks_are_numbered_apart(spark):
    rows = spark.range(20_000).select(F.lit("p").alias("path"), F.lit("Same").alias("name"), F.lit("type").alias("kind"), F.lit("").alias("description"))
    blocks = documents.schema_file(rows)
    assert blocks.count() == 20_001 and blocks.select(F.count_distinct("n")).first()[0] == 20_001


def test_module_files(spark, tmp_path):
    """Each module's file is the text that is made of the module as one row."""
    kind = "module string, name string, kind string, signature string, description string, params array<struct<name:string,type:string,optional:boolean,description:string>>"
    rows = [("a", f"f{i:03}", "function" if i % 3 else "fun", f"f{i}()", None if i % 5 else f"says {i}", [("x", "int|null", i % 2 == 0, None)] if i % 2 else []) for i in range(200)]
    rows += [("b/c", "K", "class", None, "<b>", [])]
    symbols = spark.createDataFrame(rows, kind).repartition(5)
    want = {r.module: r.text for r in rendering.module_markdown(symbols).collect()}
    files = documents.module_files(symbols)
    found = {}
    for r in sorted(files.collect(), key=lambda r: r.n):
        found.setdefault(r.module, []).append(r.text)
    assert {m: "\n".join(t) for m, t in found.items()} == {m: t + "\n" for m, t in want.items()}
    write_files(files, "module", str(tmp_path / "out"))
    for m, folder in (("a", "module=a"), ("b/c", "module=b%2Fc")):
        assert "".join(p.read_text() for p in sorted(Path(tmp_path / "out" / folder).glob("part-*"))) == want[m] + "\n\n"
    nameless = documents.module_files(spark.createDataFrame([(None, "n", None, None, None, [])], kind)).orderBy("n").collect()
    assert [r.module for r in nameless] == [""] * 5 and nameless[0].text == "# \n"
    assert documents.module_files(symbols.limit(0)).isEmpty()


QUERIES = ["delete file", "Test the TEST class", "get it", "", "error, Error: send!", "création update"]


def test_query_variants(spark):
    df = spark.createDataFrame([(q,) for q in QUERIES], "q string")
    assert [r.v for r in df.select(text.query_variants(F.col("q")).alias("v")).collect()] == [text.expand_query(q) for q in QUERIES]
    assert spark.createDataFrame([(None,)], "q string").select(text.query_variants(F.col("q")).alias("v")).first().v is None
