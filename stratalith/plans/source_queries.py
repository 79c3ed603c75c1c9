"""Queries over source files made of the documents, one for each: a class, its doc block and members, a function, an import of the document before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..operators import names, scanner
from .inputs import table
from .register import query


def source_files(spark: SparkSession, sf: str) -> DataFrame:
    """path, content: each whole text stands in a template string, among braces in strings and comments."""
    d = table(spark, sf, "documents")
    own, before = F.col("doc_id").cast("string"), (F.col("doc_id") - 1).cast("string")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[`\\$]", " ")
    said = [
        "import { helper", before, " as before } from './d", before, "';\n/** Document ", own, " in ", F.coalesce("lang", F.lit("none")), ". */\nexport class Doc", own,
        " {\n  // function fake() { class Nope {\n  private text = `", text, "`;\n  run(count: number): string { return this.size() + before(`{`); }\n  size(): number { return helper", own,
        "(1); }\n}\nexport function helper", own, "(n: number) { const step = () => n; return step(); }\n",
    ]
    return d.select(F.concat(F.lit("m/d"), own, F.lit(".ts")).alias("path"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in said]).alias("content"))


_D = "d AS (SELECT doc_id AS i, 'm/d' || doc_id || '.ts' AS path, coalesce(lang, 'none') AS lang, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS l FROM documents)"
_RUN, _SIZE = "run(count: number): string", "size(): number"
_SYMBOLS = f"""{_D}, s AS (SELECT i, path, 0 AS pos, -1 AS parent, 'class' AS kind, 'Doc' || i AS name, 3 AS line, 8 + l AS end_line, 'Document ' || i || ' in ' || lang || '.' AS documentation, TRUE AS exported FROM d
UNION ALL SELECT i, path, 1, 0, 'field', 'text', 5, 5 + l, NULL, FALSE FROM d UNION ALL SELECT i, path, 2, 0, 'method', 'run', 6 + l, 6 + l, NULL, FALSE FROM d UNION ALL SELECT i, path, 3, 0, 'method', 'size', 7 + l, 7 + l, NULL, FALSE FROM d
UNION ALL SELECT i, path, 4, -1, 'function', 'helper' || i, 9 + l, 9 + l, NULL, TRUE FROM d UNION ALL SELECT i, path, 5, 4, 'function', 'step', 9 + l, 9 + l, NULL, FALSE FROM d)"""


@query(f"WITH {_SYMBOLS} SELECT path, pos, parent, kind, name, line, end_line, documentation, CASE WHEN pos < 2 THEN 'private' ELSE 'public' END AS visibility, exported FROM s")
def symbol_trees(spark, sf):
    return scanner.symbol_tree(source_files(spark, sf)).select("path", "pos", "parent", "kind", "name", "line", "end_line", "documentation", "visibility", "exported")


@query(f"WITH {_D} SELECT path, 2 AS line, 'Document ' || i || ' in ' || lang || '.' AS text, 'Doc' || i AS symbol FROM d")
def doc_blocks(spark, sf):
    return scanner.doc_comments(source_files(spark, sf)).select("path", "line", "text", "symbol")


@query(
    f"""WITH {_D} SELECT path || '#2' AS src, path || '#3' AS dst, 1 AS calls FROM d UNION ALL SELECT path || '#3', path || '#4', 1 FROM d UNION ALL SELECT path || '#4', path || '#5', 1 FROM d
UNION ALL SELECT d.path || '#2', p.path || '#4', 1 FROM d JOIN d p ON p.i = d.i - 1"""
)
def text_calls(spark, sf):
    files = source_files(spark, sf)
    symbols = scanner.symbol_tree(files).withColumn("id", F.concat_ws("#", "path", "pos"))
    return names.text_call_edges(names.resolve_names(files), symbols).withColumn("calls", F.col("calls").cast("int"))


@query(
    f"""WITH {_D}, n AS (SELECT d.*, x.path AS next FROM d LEFT JOIN d x ON x.i = d.i + 1) SELECT path || '#3' AS target, path, 6 + l AS line, '{_SIZE}' AS contents FROM n UNION ALL SELECT path || '#5', path, 9 + l, 'const step = () => n;' FROM n
UNION ALL SELECT path || '#4', path, 7 + l, 'export function helper' || i || '(n: number)' FROM n UNION ALL SELECT path || '#4', next, 1, 'export function helper' || i || '(n: number)' FROM n WHERE next IS NOT NULL
UNION ALL SELECT n.path || '#4', next, 6 + x.l, 'export function helper' || n.i || '(n: number)' FROM n JOIN d x ON x.path = n.next"""
)
def text_references(spark, sf):
    files = source_files(spark, sf)
    symbols = checkpointed(scanner.symbol_tree(files).withColumn("id", F.concat_ws("#", "path", "pos")))
    found = checkpointed(names.resolve_names(files))
    said = names.hovers(found, symbols).select("path", "at", "contents").distinct()
    return names.references(found).join(said, ["path", "at"]).select("target", "path", "line", "contents")


@query(f"WITH {_SYMBOLS} SELECT path, pos, name, FALSE AS is_default, FALSE AS is_type_only FROM s WHERE exported")
def tree_exports(spark, sf):
    return scanner.tree_exports(scanner.symbol_tree(source_files(spark, sf)))


@query(f"WITH {_SYMBOLS} SELECT c.path AS module, CASE WHEN c.parent < 0 THEN c.name ELSE p.name || '.' || c.name END AS key, c.kind, c.line, c.documentation FROM s c LEFT JOIN s p ON p.path = c.path AND p.pos = c.parent")
def module_schemas(spark, sf):
    return scanner.module_schema(scanner.symbol_tree(source_files(spark, sf))).select("module", "key", "kind", "line", "documentation")


_TEXT = r"regexp_replace(coalesce(text, ''), '[`\\$]', ' ', 'g')"
_CLASS = f"'export class Doc' || i || ' {{' || chr(10) || '  // function fake() {{ class Nope {{' || chr(10) || '  ' || field || chr(10) || '  {_RUN} {{ return this.size() + before(`{{`); }}' || chr(10) || '  {_SIZE} {{ return helper' || i || '(1); }}' || chr(10) || '}}'"
_HEAD = "'import { helper' || (i - 1) || ' as before } from ''./d' || (i - 1) || ''';' || chr(10) || '/** Document ' || i || ' in ' || lang || '. */' || chr(10)"
_FOOT = "chr(10) || 'export function helper' || i || '(n: number) { const step = () => n; return step(); }' || chr(10)"
_CHUNK = "substr(sha256(path || ':{}:' || {}), 1, 16)"


@query(
    f"""WITH t AS (SELECT doc_id AS i, 'm/d' || doc_id || '.ts' AS path, coalesce(lang, 'none') AS lang, 'private text = `' || {_TEXT} || '`' AS field FROM documents), u AS (SELECT i, path, lang, field || ';' AS field FROM t),
c AS (SELECT *, {_CLASS} AS class FROM u), w AS (SELECT *, {_HEAD} || class || {_FOOT} AS content FROM c)
SELECT {_CHUNK.format("file", "'context'")} AS id, path, 'file' AS level, NULL AS symbol, array_to_string(list_slice(list_filter(string_split(content, chr(10)), lambda l: regexp_matches(l, '^\\s*(import|export|module|//|/\\*|\\*|#)')), 1, 50), chr(10)) AS content FROM w
UNION ALL SELECT {_CHUNK.format("symbol", "'Doc' || i")}, path, 'symbol', 'Doc' || i, class FROM w WHERE ceil(length(class) / 4.0) >= 50
UNION ALL SELECT {_CHUNK.format("symbol", "'text'")}, path, 'symbol', 'text', field FROM w WHERE ceil(length(field) / 4.0) >= 50"""
)
def source_chunks(spark, sf):
    return scanner.source_chunks(source_files(spark, sf))


@query("SELECT 'm/d' || doc_id || '.ts' AS path, CASE WHEN doc_id % 7 = 0 THEN 'empty' ELSE 'no symbols' END AS reason FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0")
def unscannable_files(spark, sf):
    """Every seventh file is empty, every eleventh all in a comment."""
    number = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    content = F.when(number % 7 == 0, " ").when(number % 11 == 0, F.concat(F.lit("/* "), F.regexp_replace("content", r"\*/", "* "), F.lit(" */"))).otherwise(F.col("content"))
    return scanner.schema_failures(source_files(spark, sf).withColumn("content", content))
