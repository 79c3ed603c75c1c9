"""Queries over documents laid out as numbered blocks, and over variants of queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import documents
from ..sources.block_files import read_lines, write_blocks
from . import inputs
from .inputs import PART_AFTER, PART_BEFORE, SYMBOLS, table
from .register import query
from .text_queries import _folder


def _id(c: str) -> str:
    plain = f"regexp_replace(regexp_replace({c}, '[^a-zA-Z0-9]', '_', 'g'), '^_+|_+$', '', 'g')"
    return f"CASE WHEN {plain} = '' THEN 'node' ELSE {plain} END"


def _numbered(parts: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY p, a, k, b) - 1 AS n, text FROM ({parts})"


_TYPES = _numbered(
    f"""SELECT 0 AS p, '' AS a, 0 AS k, '' AS b, '# Generated types' || chr(10) || 'schema {{' || chr(10) || '  query: Query' || chr(10) || '}}' || chr(10) || chr(10) || 'type Query {{' || chr(10) || '  _health: String' || chr(10) || '}}' || chr(10) AS text
UNION ALL SELECT 1, path, 0, name, repeat(chr(34), 3) || replace(coalesce(description, ''), '"', '\\"') || repeat(chr(34), 3) || chr(10) || 'type ' || name || ' {{' || chr(10) || '  _id: ID' || chr(10) || '}}' || chr(10) FROM {SYMBOLS.replace("split_part(text, chr(10), 1)", "text")} WHERE kind IN ('class', 'interface')"""
)


@query(_TYPES)
def schema_blocks(spark, sf):
    """Documents as types: whole texts are descriptions."""
    return documents.schema_file(inputs.symbols(spark, sf, whole=True).withColumn("path", F.coalesce("path", F.lit(""))))


_PAGES = """(SELECT coalesce(source, '') AS m, doc_id || 'd' AS name, coalesce(lang, '') AS kind, text AS d, doc_id % 2 = 0 AS param FROM documents)"""


@query(
    f"WITH s AS (SELECT * FROM {_PAGES}), k AS (SELECT DISTINCT m, kind FROM s), r AS ("
    + """SELECT m, 0 AS k, '' AS b, '# ' || m || chr(10) AS text FROM (SELECT DISTINCT m FROM s) UNION ALL SELECT m, 1, kind, '### ' || kind FROM k UNION ALL SELECT m, 1, kind || chr(2), '' FROM k
UNION ALL SELECT m, 1, kind || chr(1) || name, '- [' || name || '](#' || name || ') - ' || CASE WHEN length(d) > 60 THEN substr(d, 1, 57) || '...' ELSE coalesce(d, '') END FROM s
UNION ALL SELECT m, 2, name, '## ' || name || chr(10) || chr(10) || '`' || kind || '`' || chr(10) || chr(10) || '```' || chr(10) || 'f()' || chr(10) || '```' || chr(10) || chr(10) || coalesce(d, '*No description*')
 || CASE WHEN param THEN chr(10) || chr(10) || '| Name | Type | Required | Description |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || '| a | int | Yes | first |' ELSE '' END || chr(10) FROM s) SELECT m AS module, row_number() OVER (ORDER BY m, k, b) - 1 AS n, text FROM r"""
)
def module_blocks(spark, sf):
    """A file for each source, with a section for each document."""
    one = F.struct(F.lit("a").alias("name"), F.lit("int").alias("type"), F.lit(False).alias("optional"), F.lit("first").alias("description"))
    params = F.when(F.col("doc_id") % 2 == 0, F.array(one)).otherwise(F.slice(F.array(one), 1, 0))
    rows = table(spark, sf, "documents").select(F.col("source").alias("module"), F.format_string("%dd", "doc_id").alias("name"), F.coalesce("lang", F.lit("")).alias("kind"), F.lit("f()").alias("signature"), F.col("text").alias("description"), params.alias("params"))
    return documents.module_files(rows)


_LOG = f"""WITH b AS ({PART_BEFORE}), a AS ({PART_AFTER}), j AS (SELECT coalesce(b.path, a.path) AS path, coalesce(b.name, a.name) AS name, b.signature AS old, a.signature AS new, CASE WHEN b.name IS NULL THEN 'added' WHEN a.name IS NULL THEN 'removed' WHEN a.deprecated THEN 'deprecated' WHEN b.signature <> a.signature THEN 'modified' END AS change FROM b FULL OUTER JOIN a ON b.path = a.path AND b.name = a.name),
c AS (SELECT *, CASE change WHEN 'removed' THEN 10 WHEN 'deprecated' THEN 11 WHEN 'added' THEN 12 ELSE 13 END AS p FROM j WHERE change IS NOT NULL),
m AS (SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'added' ELSE 'removed' END AS change FROM (SELECT DISTINCT path FROM b) b FULL OUTER JOIN (SELECT DISTINCT path FROM a) a ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL),
u AS (SELECT path, change FROM c UNION ALL SELECT path, change FROM m), s AS (SELECT count(*) AS t, count_if(change = 'removed') AS r, count_if(change = 'added') AS ad, count_if(change = 'modified') AS md, count_if(change = 'deprecated') AS de, count(DISTINCT path) AS pa FROM u),
w AS (SELECT p, count(DISTINCT path) AS n FROM c GROUP BY 1), h AS (SELECT p FROM w UNION SELECT 10 FROM m WHERE change = 'removed'),
x AS (SELECT 0 AS p, '' AS a, 0 AS k, '' AS b, '# Changelog' || chr(10) || chr(10) || '> Comparing v1 to v2' || chr(10) || chr(10) || '## Recommended Version Bump: **' || CASE WHEN r > 0 THEN 'MAJOR' WHEN ad + de > 0 THEN 'MINOR' WHEN t > 0 THEN 'PATCH' ELSE 'NONE' END || '**' || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10)
 || '- Total changes: ' || t || chr(10) || '- Breaking changes: ' || r || chr(10) || '- Additions: ' || ad || chr(10) || '- Modifications: ' || md || chr(10) || '- Deprecations: ' || de || chr(10) || '- Modules affected: ' || pa || chr(10) AS text FROM s
UNION ALL SELECT 1, '', 0, '', '## Module Changes' || chr(10) FROM (SELECT count(*) AS n FROM m) WHERE n > 0 UNION ALL SELECT 3, '', 0, '', '' FROM (SELECT count(*) AS n FROM m) WHERE n > 0
UNION ALL SELECT 2, '', 0, path, CASE change WHEN 'added' THEN '- + `' || path || '`' ELSE '- - `' || path || '` **BREAKING**' END FROM m
UNION ALL SELECT p, '', -1, '', '## ' || ['Breaking Changes', 'Deprecations', 'New Features', 'Other Changes'][p - 9] || chr(10) FROM h
UNION ALL SELECT DISTINCT c.p, path, 0, '', '### ' || path || chr(10) FROM c JOIN w ON w.p = c.p WHERE n > 1
UNION ALL SELECT p, path, 1, name, CASE change WHEN 'removed' THEN '- **-** `' || name || '` **BREAKING**' || chr(10) || '  - Export ''' || name || ''' removed - BREAKING' WHEN 'added' THEN '- **+** `' || name || '`' || chr(10) || '  - New export ''' || name || '''' WHEN 'deprecated' THEN '- **⚠** `' || name || '`' || chr(10) || '  - ''' || name || ''' deprecated'
 ELSE '- **~** `' || name || '`' || chr(10) || '  - ''' || name || ''' modified' || chr(10) || '  - Signature changed:' || chr(10) || '    - Before: `' || old || '`' || chr(10) || '    - After: `' || new || '`' END || chr(10) FROM c
UNION ALL SELECT 99, '', 0, '', '---' || chr(10) || chr(10) || '*Generated at 2024-01-01*') """


@query(_LOG + _numbered("SELECT * FROM x"))
def changelog_blocks(spark, sf):
    """The change log between both versions of the parts."""
    return documents.change_log(*inputs.part_versions(spark, sf), "v1", "v2", "2024-01-01")


_ORDERS = "(SELECT o_orderkey AS pos, 'src/c' || o_custkey || '.ts' AS src, 'lib/p-' || substr(o_orderpriority, 1, 1) || '.ts' AS dst, o_orderkey % 3 AS imports, o_orderkey % 5 = 0 AS loop FROM orders)"
_NODES = f"(SELECT src AS id FROM {_ORDERS} UNION SELECT dst FROM {_ORDERS})"


def _order_edges(spark, sf):
    """Orders as edges from their customers' files to those of priorities."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(F.format_string("src/c%d.ts", "o_custkey").alias("src"), F.concat(F.lit("lib/p-"), F.substring("o_orderpriority", 1, 1), F.lit(".ts")).alias("dst"), k.alias("pos"), (k % 3).alias("n"), (k % 5 == 0).alias("loop"))


def _ends(edges):
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


@query(
    f"""WITH l AS (SELECT row_number() OVER (ORDER BY p, k, b) - 1 AS n, * FROM (SELECT 0 AS p, 0 AS k, '' AS b, FALSE AS loop, 'graph TD' AS text UNION ALL SELECT 1, 0, id, FALSE, '    ' || {_id("id")} || '[' || substr(id, 5) || ']' FROM {_NODES}
UNION ALL SELECT 2, pos, src, loop, '    ' || {_id("src")} || CASE imports WHEN 0 THEN ' --> ' WHEN 1 THEN ' -->|1 import| ' ELSE ' -->|2 imports| ' END || {_id("dst")} FROM {_ORDERS})), t AS (SELECT count(*) AS t, count_if(p < 2) AS f FROM l)
SELECT n, text FROM l UNION ALL SELECT t + row_number() OVER (ORDER BY n) - 1, '    linkStyle ' || (n - f) || ' stroke:red,stroke-width:2px' FROM l, t WHERE loop"""
)
def dependency_blocks(spark, sf):
    """Every order is an edge of the chart."""
    edges = _order_edges(spark, sf)
    return documents.dependency_chart(_ends(edges).withColumn("path", F.col("id")), edges.select("src", "dst", "pos", F.col("n").alias("imports"), F.col("loop").alias("in_cycle")))


_MARKED = f"(SELECT id, starts_with(id, 'src') AS e, NOT starts_with(id, 'src') OR length(id) = 9 AS f FROM {_NODES})"


@query(
    f"""WITH l AS (SELECT row_number() OVER (ORDER BY p, k, b) - 1 AS n, * FROM (SELECT 0 AS p, 0 AS k, '' AS b, FALSE AS e, FALSE AS f, FALSE AS loop, 'graph TD' AS text UNION ALL SELECT 1, 0, id, e, f, FALSE, '    ' || {_id("id")} || CASE WHEN e THEN '([' || id || '])' WHEN f THEN '(' || id || ')' ELSE '[' || id || ']' END FROM {_MARKED}
UNION ALL SELECT 2, pos, src, FALSE, FALSE, loop, '    ' || {_id("src")} || CASE imports WHEN 2 THEN ' -->|2 calls| ' ELSE ' --> ' END || {_id("dst")} FROM {_ORDERS})), t AS (SELECT count(*) AS t, count_if(p < 2) AS first FROM l),
s AS (SELECT 1 AS g, n, '    style ' || {_id("b")} || ' fill:#90EE90,stroke:#228B22' AS text FROM l WHERE e UNION ALL SELECT 2, n, '    style ' || {_id("b")} || ' fill:#ADD8E6,stroke:#4682B4' FROM l WHERE f UNION ALL SELECT 3, n, '    linkStyle ' || (n - first) || ' stroke:orange,stroke-width:2px' FROM l, t WHERE loop)
SELECT n, text FROM l UNION ALL SELECT t + row_number() OVER (ORDER BY g, n) - 1, text FROM s, t"""
)
def call_blocks(spark, sf):
    """Orders as calls; customers' files are entries, those of priorities leaves, those of some customers both."""
    edges, start = _order_edges(spark, sf), F.startswith("id", F.lit("src"))
    nodes = _ends(edges).select("id", F.lit(None).cast("string").alias("name"), start.alias("is_entry"), (~start | (F.length("id") == 9)).alias("is_leaf"))
    return documents.call_chart(nodes, edges.select("src", "dst", "pos", F.col("n").alias("calls"), F.col("loop").alias("recursive")))


@query(
    f"""WITH o AS (SELECT * FROM {_ORDERS}), f AS (SELECT id, min(k) AS k FROM (SELECT src AS id, 2 * pos AS k FROM o UNION ALL SELECT dst, 2 * pos + 1 FROM o) GROUP BY 1) """
    + _numbered(
        f"""SELECT 0 AS p, '' AS a, 0 AS k, '' AS b, 'sequenceDiagram' AS text UNION ALL SELECT 1, '', k, '', '    participant ' || {_id("id")} || ' as ' || id FROM f UNION ALL SELECT 2, '', 0, '', ''
UNION ALL SELECT 3, '', pos, '', '    ' || {_id("src")} || CASE WHEN loop THEN '-->>' ELSE '->>' END || {_id("dst")} || ': ' || CASE imports WHEN 2 THEN '2 calls' ELSE 'call' END || CASE WHEN loop THEN chr(10) || '    Note right of ' || {_id("dst")} || ': recursive' ELSE '' END FROM o"""
    )
)
def sequence_blocks(spark, sf):
    """Every order is an arrow."""
    return documents.sequence_chart(_order_edges(spark, sf).select("src", "dst", "pos", F.col("n").alias("calls"), F.col("loop").alias("recursive")))


_CHECKS = "(SELECT 'part ' || p_partkey AS name, CASE p_size % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, p_partkey % 4 <> 0 AS passed, p_size || '%' AS value FROM part)"


@query(
    f"WITH c AS (SELECT * FROM {_CHECKS}), t AS (SELECT count(*) AS n, count_if(passed) AS g FROM c), g AS (SELECT severity, CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 6 ELSE 9 END AS p FROM c GROUP BY 1) "
    + _numbered(
        """SELECT 0 AS p, '' AS a, 0 AS k, '' AS b, '# Documentation Hardening Checklist' || chr(10) || chr(10) || '**Score: ' || CAST(round(g * 100.0 / n) AS BIGINT) || '%** (' || g || '/' || n || ' checks passed)' || chr(10) AS text FROM t
UNION ALL SELECT p, '', 0, '', CASE severity WHEN 'error' THEN '## Critical' WHEN 'warning' THEN '## Warnings' ELSE '## Recommendations' END || chr(10) FROM g UNION ALL SELECT p + 2, '', 0, '', '' FROM g
UNION ALL SELECT p + 1, '', 0, name, '- ' || CASE WHEN passed THEN '✅' WHEN severity = 'error' THEN '❌' WHEN severity = 'warning' THEN '⚠️' ELSE 'ℹ️' END || ' **' || name || '**: ' || CASE WHEN severity = 'error' THEN CASE WHEN passed THEN 'Pass' ELSE 'Fail' END ELSE value || ' (target: 80%)' END FROM c JOIN g USING (severity)"""
    )
)
def checklist_blocks(spark, sf):
    """Parts as checks."""
    size = F.col("p_size") % 3
    severity = F.when(size == 0, "error").when(size == 1, "warning").otherwise("info")
    return documents.checklist(table(spark, sf, "part").select(F.format_string("part %d", "p_partkey").alias("name"), severity.alias("severity"), (F.col("p_partkey") % 4 != 0).alias("passed"), F.format_string("%d%%", "p_size").alias("value"), F.lit("80%").alias("target")))


@query(f"SELECT count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(count_if(text = '  _id: ID') AS BIGINT) AS types FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM ({_TYPES}))")
def schema_files(spark, sf):
    """The schema file written and read back."""
    folder = _folder(spark, "schema-file")
    write_blocks(schema_blocks(spark, sf), folder)
    return read_lines(spark, folder).agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("characters"), F.count_if(F.col("text") == "  _id: ID").alias("types"))


_WORDS = list(text.CODE_SYNONYMS)
_PAIRS = ", ".join(f"('{w}', {i}, '{s}')" for w, own in text.CODE_SYNONYMS.items() for i, s in enumerate(own))


@query(
    f"""WITH q AS (SELECT conv_id, turn, coalesce([{", ".join(f"'{w}'" for w in _WORDS)}][1 + (conv_id + turn) % 16] || ' ', '') || coalesce(text, '') AS q FROM conversations), w AS (SELECT conv_id, turn, q, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT *, string_split_regex(regexp_replace(lower(q), '[^\\w\\s]', ' ', 'g'), '\\s+') AS l FROM q)),
v AS (SELECT conv_id, turn, 0 AS i, 0 AS j, q AS variant FROM q UNION ALL SELECT conv_id, turn, i, j, regexp_replace(q, p.w, s, 'gi') FROM w JOIN (VALUES {_PAIRS}) p(w, j, s) ON p.w = w.w WHERE w.w <> 'get')
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY i, j) - 1 AS INTEGER) AS pos, variant FROM (SELECT conv_id, turn, variant, min((i, j)) AS f, f[1] AS i, f[2] AS j FROM v GROUP BY 1, 2, 3)"""
)
def expanded_turns(spark, sf):
    """Every turn of the conversations, most with a keyword before it, and its variants."""
    lead = F.try_element_at(F.array(*[F.lit(f"{w} ") for w in _WORDS]), ((F.col("conv_id") + F.col("turn")) % 16 + 1).cast("int"))
    asked = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.coalesce(lead, F.lit("")), F.coalesce("text", F.lit(""))).alias("q"))
    return asked.select("conv_id", "turn", F.posexplode(text.query_variants(F.col("q"))).alias("pos", "variant"))
