"""Every placeholder is reported, wherever it stands in a document."""

import duckdb

from stratalith.plans.registry import QUERIES, SQL

SAID = {
    "todo": "todo: more", "fixme": "a FIXME here", "xxx": "XXX", "hack": "a hack", "placeholder": "Placeholder text", "lorem-ipsum": "Lorem  ipsum dolor", "documentation-needed": "documentation needed",
    "fill-in": "fill in", "add-description": "Add description", "insert-here": "insert some words here", "tbd": "TBD", "coming-soon": "coming soon",
}


def test_all_placeholders_behind_the_first_line(spark, tmp_path):
    rows = [(6 * i + 1, f"A first line.\nThen {said} it stands.", "en", "src", 9) for i, said in enumerate(SAID.values())] + [(6 * len(SAID) + 1, "Clean.\nxxx", "en", "src", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["lint_documents"](spark, str(tmp_path)).collect()
    assert {int(r.name): r.hit for r in got if r.rule == "placeholder"} == {6 * i + 1: name for i, name in enumerate(SAID)}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT path, name, rule, severity, hit FROM ({SQL['lint_documents']})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
