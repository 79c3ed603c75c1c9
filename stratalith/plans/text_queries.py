"""Registered queries over sequences, renderings, contexts, chunks, stores, and incoherence."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..checkpoints import checkpointed, ensure_checkpoint_dir
from ..operators import diff, embedder, extraction, freshness, metrics, rendering, retrieval, sequences
from ..sources import stores
from . import inputs
from .inputs import CURRENT, PART_AFTER, PART_BEFORE, STORE, SYMBOLS, table
from .register import SQL, count_sql, query


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- sequences --------------------------------------------------------------------------------


@query(
    """WITH e AS (SELECT user_id AS file, event_id AS i, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS dl, event_id % 7 AS dc, event_id % 8 AS bits FROM events), l AS (SELECT *, sum(dl) OVER (PARTITION BY file ORDER BY i) AS line FROM e)
SELECT file, i, CAST(line AS BIGINT) AS line, CAST(sum(dc) OVER (PARTITION BY file, line ORDER BY i) AS BIGINT) AS character, array_to_string(list_filter([CASE WHEN bits & 1 <> 0 THEN 'static' END, CASE WHEN bits & 2 <> 0 THEN 'async' END, CASE WHEN bits & 4 <> 0 THEN 'readonly' END], lambda x: x IS NOT NULL), ',') AS modifiers FROM l"""
)
def token_places(spark, sf):
    i = F.col("event_id")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("file"), i.alias("i"), (i % 3 == 0).cast("int").alias("delta_line"), (i % 7).alias("delta_char"), (i % 8).cast("int").alias("bits"))
    return sequences.semantic_tokens(rows).select("file", "i", "line", "character", F.array_join(sequences.modifier_names(F.col("bits"), ["static", "async", "readonly"]), ",").alias("modifiers"))


_LINE = ", ".join(f"CASE WHEN regexp_matches(l, '{p}') THEN 1 ELSE 0 END" for p in metrics.NESTING), ", ".join(f"CASE WHEN regexp_matches(l, '{p}') THEN 1 ELSE 0 END" for p in metrics.SIMPLE)
_PLAIN = "regexp_replace(regexp_replace(html, '//[^\\n]*', '', 'g'), '/\\*.*?\\*/', '', 'gs')"


@query(
    f"""WITH x AS (SELECT page_id, html, {_PLAIN} AS plain FROM pages),
c AS (SELECT page_id, html, plain, list_transform(string_split(html, chr(10)), lambda l: {{'s': list_sum([{_LINE[0]}]), 'd': list_sum([{_LINE[1]}]), 'o': len(l) - len(replace(l, '{{', '')), 'c': len(l) - len(replace(l, '}}', ''))}}) AS lines,
list_transform(string_split(regexp_replace(plain, '[^\\[\\](){{}}]', '', 'g'), ''), lambda m: CASE WHEN m IN ('{{', '(', '[') THEN 1 WHEN m IN ('}}', ')', ']') THEN -1 ELSE 0 END) AS marks FROM x)
SELECT page_id AS path, CAST(list_reduce(list_prepend({{'s': 0, 'd': 0, 'o': 0, 'c': 0}}, lines), lambda a, x: {{'s': a.s + x.s * (1 + a.d) + CASE WHEN x.o > 0 THEN x.s * (x.s - 1) / 2 ELSE 0 END + x.d, 'd': greatest(0, a.d + CASE WHEN x.o > 0 THEN x.s ELSE 0 END + x.o - x.c), 'o': 0, 'c': 0}}).s AS INTEGER) AS cognitive,
CAST(list_reduce(list_prepend(0, list_transform(marks, lambda m: m + 0)), lambda a, m: greatest(0, a % 100000 + m) + 100000 * greatest(a // 100000, greatest(0, a % 100000 + m))) // 100000 AS INTEGER) AS nesting,
CAST(len(list_filter(string_split(plain, chr(10)), lambda l: regexp_matches(l, '\\S'))) AS INTEGER) AS code_lines,
CAST(coalesce(list_sum(list_transform(list_concat(regexp_extract_all(html, '//[^\\n]*'), regexp_extract_all(html, '(?s)/\\*.*?\\*/')), lambda m: len(string_split(m, chr(10))))), 0) AS INTEGER) AS comment_lines FROM c"""
)
def line_metrics(spark, sf):
    c = F.col("html")
    return table(spark, sf, "pages").select(F.col("page_id").alias("path"), metrics.cognitive(c).alias("cognitive"), metrics.max_nesting(metrics.strip_comments(c)).alias("nesting"), metrics.code_lines(c).alias("code_lines"), metrics.comment_lines(c).alias("comment_lines"))


@query(
    """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS path, p_partkey AS k, p_size AS z FROM part)
SELECT path, 'run' AS name, CAST(2 AS INTEGER) AS line, CAST(CASE WHEN k % 2 = 0 THEN 4 ELSE 2 END AS INTEGER) AS line_count, CAST(CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS cyclomatic, CAST(CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS parameters FROM p WHERE k % 4 <> 1
UNION ALL SELECT path, 'stop', CAST(CASE WHEN k % 2 = 0 THEN 6 ELSE 4 END AS INTEGER), 2, 1, 0 FROM p WHERE k % 4 <> 1
UNION ALL SELECT path, 'run', 1, 1, 1, CAST(CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) FROM p WHERE k % 4 = 1"""
)
def function_metrics(spark, sf):
    k = F.col("p_partkey")
    params = F.when(k % 3 == 0, "a, b").otherwise("a")
    body = F.when(k % 2 == 0, " {\n  if (a) {\n  }\n}\n").otherwise(" {\n}\n")
    word = F.when(k % 4 == 0, "function").when(k % 4 == 2, "pub async fn").otherwise("func")
    code = F.concat(F.lit("// first\n"), word, F.lit(" run("), params, F.lit(")"), body, word, F.lit(" stop() {\n}\n"))
    python = F.concat(F.lit("def run("), params, F.lit("):\n  pass\n"))
    language = F.when(k % 4 == 0, "typescript").when(k % 4 == 1, "python").when(k % 4 == 2, "rust").otherwise("go")
    files = table(spark, sf, "part").select(k.cast("string").alias("path"), F.when(k % 4 == 1, python).otherwise(code).alias("content"), language.alias("language"))
    return metrics.function_complexity(files).filter("name IN ('run', 'stop')").select("path", "name", "line", "line_count", "cyclomatic", "parameters")


@query(
    """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS path, p_name AS n, p_type AS t, p_partkey AS k FROM part)
SELECT path, 'function' AS category, 'add' AS name, substr(md5('(a: int, b: ' || t || '): ' || CASE WHEN k % 2 = 0 THEN t ELSE 'void' END), 1, 8) AS hash FROM p UNION ALL SELECT path, 'function', 'twice', substr(md5('(v): void'), 1, 8) FROM p
UNION ALL SELECT path, 'class', 'Box', substr(md5('extends Base implements ' || t), 1, 8) FROM p UNION ALL SELECT path, 'interface', 'Shape', substr(md5(' {a: ' || t || '; b: 1}'), 1, 8) FROM p UNION ALL SELECT path, 'type', 'Id', substr(md5(t || ' | null'), 1, 8) FROM p
UNION ALL SELECT path, 'export', x, NULL FROM p, (VALUES ('Box'), ('add')) v(x)"""
)
def signatures(spark, sf):
    result = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(": "), "p_type")).otherwise("")
    code = F.concat(F.lit("export function add(a:int , b: "), "p_type", F.lit(")"), result, F.lit(" {}\nconst twice = (v) => 1\nexport class Box extends Base implements "), "p_type", F.lit(" { }\ninterface Shape { b: 1;\n a: "), "p_type", F.lit(" }\ntype Id = "), "p_type", F.lit(" | null;\n"))
    return metrics.extract_signatures(table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("path"), code.alias("content")))


# --- changelogs ---------------------------------------------------------------------------------


@query(
    f"""WITH b AS ({PART_BEFORE}), a AS ({PART_AFTER}), j AS (SELECT coalesce(b.path, a.path) AS path, coalesce(b.name, a.name) AS name, CASE WHEN b.name IS NULL THEN 'added' WHEN a.name IS NULL THEN 'removed' WHEN a.deprecated THEN 'deprecated' WHEN b.signature <> a.signature THEN 'modified' END AS change FROM b FULL OUTER JOIN a ON b.path = a.path AND b.name = a.name)
SELECT path, name, CASE change WHEN 'added' THEN 'New export ''' || name || '''' WHEN 'removed' THEN 'Export ''' || name || ''' removed - BREAKING' WHEN 'deprecated' THEN '''' || name || ''' deprecated' ELSE '''' || name || ''' modified' END AS description,
CASE WHEN change = 'removed' THEN 'The `' || name || '` export has been removed.' WHEN CAST(name AS BIGINT) % 2 = 0 THEN 'Old: `' || name || '(existingArgs)`; new: `' || name || '(existingArgs, {{ a: string, n: ' || name || ' }})`' END AS note FROM j WHERE change IS NOT NULL""".replace("{{", "{").replace("}}", "}")
)
def change_texts(spark, sf):
    changes = diff.describe_changes(diff.diff_exports(*inputs.part_versions(spark, sf)))
    added = F.when(F.col("name").cast("long") % 2 == 0, F.array(F.lit("a: string"), F.concat(F.lit("n: "), "name"))).otherwise(F.array().cast("array<string>"))
    return changes.select("path", "name", "description", extraction.migration_note(F.col("change"), F.col("name"), added).alias("note"))


@query(
    """WITH c AS (SELECT CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS priority, 'Section ' || o_orderstatus AS section, CAST(o_custkey AS VARCHAR) AS path, CAST(o_orderkey AS VARCHAR) AS name, o_orderpriority AS change FROM orders),
s AS (SELECT priority, section, '## ' || section || chr(10) || chr(10) || string_agg('- ' || path || ': ' || name || ' ' || change, chr(10) ORDER BY path, name) AS body FROM c GROUP BY 1, 2) SELECT string_agg(body, chr(10) || chr(10) ORDER BY priority) AS text FROM s"""
)
def changelog_text(spark, sf):
    s = F.col("o_orderstatus")
    rows = table(spark, sf, "orders").select(F.when(s == "F", 1).when(s == "O", 2).otherwise(3).alias("priority"), F.concat(F.lit("Section "), s).alias("section"), F.col("o_custkey").cast("string").alias("path"), F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderpriority").alias("change"))
    return rendering.changelog_markdown(rows)


@query("SELECT p_brand AS path, min(p_partkey) AS first, array_to_string(list(p_name ORDER BY p_partkey), ',') AS names FROM part GROUP BY 1")
def module_changes(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"))
    return diff.changes_by_module(rows).withColumn("names", F.array_join("names", ","))


# --- renderings -----------------------------------------------------------------------------------


@query("SELECT string_agg(CASE WHEN s_suppkey % 3 <> 0 THEN '- [x] ' ELSE '- [ ] ' END || s_name || ' (info): ' || CAST(s_suppkey AS DOUBLE) || ' / 5.0', chr(10) ORDER BY s_name) AS text FROM supplier")
def checklist_text(spark, sf):
    rows = table(spark, sf, "supplier").select(F.col("s_name").alias("id"), F.lit("info").alias("severity"), (F.col("s_suppkey") % 3 != 0).alias("passed"), F.col("s_suppkey").cast("double").alias("value"), F.lit(5.0).alias("target"))
    return rendering.checklist_markdown(rows)


_PARAMS = "'| Name | Type | Required | Description |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || '| a | ' || p_type || '\\|null | No | first |' || chr(10) || '| b |  | Yes |  |'"


@query(
    f"""WITH s AS (SELECT p_brand AS module, p_partkey || 'x' AS name, p_type AS kind, p_name AS description, '## ' || p_partkey || 'x' || chr(10) || chr(10) || '`' || p_type || '`' || chr(10) || chr(10) || '```' || chr(10) || 'f()' || chr(10) || '```' || chr(10) || chr(10) || p_name || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || chr(10) || {_PARAMS} ELSE '' END AS body FROM part),
k AS (SELECT module, kind, '### ' || kind || chr(10) || string_agg('- [' || name || '](#' || name || ') - ' || description, chr(10) ORDER BY name) AS part FROM s GROUP BY 1, 2), t AS (SELECT module, string_agg(part, chr(10) || chr(10) ORDER BY kind) AS toc FROM k GROUP BY 1)
SELECT t.module, '# ' || t.module || chr(10) || chr(10) || toc || chr(10) || chr(10) || string_agg(body, chr(10) || chr(10) ORDER BY name) AS text FROM t JOIN s ON s.module = t.module GROUP BY t.module, toc"""
)
def module_pages(spark, sf):
    p = lambda n, t, o, d: F.struct(F.lit(n).alias("name"), t.alias("type"), F.lit(o).alias("optional"), F.lit(d).cast("string").alias("description"))
    params = F.array(p("a", F.concat("p_type", F.lit("|null")), True, "first"), p("b", F.lit(None).cast("string"), False, None))
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("module"), F.concat(F.col("p_partkey").cast("string"), F.lit("x")).alias("name"), F.col("p_type").alias("kind"), F.lit("f()").alias("signature"), F.col("p_name").alias("description"), F.when(F.col("p_partkey") % 2 == 0, params).otherwise(F.slice(params, 1, 0)).alias("params"))
    return rendering.module_markdown(rows)


@query("SELECT 'sequenceDiagram' || chr(10) || string_agg('    Supplier_' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || '->>n' || s_nationkey || ': calls', chr(10) ORDER BY s_suppkey) AS text FROM supplier")
def sequence_text(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("src"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("dst"), F.col("s_suppkey").alias("pos"), F.lit("calls").alias("label"))
    return rendering.sequence_diagram(s)


@query("""SELECT string_agg('\"\"\"' || replace(s_name, '#', '\\"') || '\"\"\"' || chr(10) || 'type S' || s_suppkey || ' {' || chr(10) || '  id: ID' || chr(10) || '}', chr(10) || chr(10) ORDER BY 'S' || s_suppkey) AS text FROM supplier WHERE s_suppkey % 4 <> 3""")
def graphql_text(spark, sf):
    k = F.col("s_suppkey")
    kind = F.when(k % 4 == 0, "class").when(k % 4 == 1, "interface").when(k % 4 == 2, "type").otherwise("function")
    return rendering.graphql_types(table(spark, sf, "supplier").select(F.concat(F.lit("S"), k.cast("string")).alias("name"), kind.alias("kind"), F.replace("s_name", F.lit("#"), F.lit('"')).alias("description")))


@query("""WITH s AS (SELECT p_name AS name, max_by(p_type, p_partkey) AS d FROM part WHERE p_partkey % 3 <> 2 GROUP BY 1) SELECT name, '{"type":"object","description":"' || d || '"}' AS schema FROM s""")
def schema_texts(spark, sf):
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(k.alias("pos"), F.col("p_name").alias("name"), F.when(k % 3 == 0, "interface").when(k % 3 == 1, "type").otherwise("class").alias("kind"), F.col("p_type").alias("description"))
    return rendering.openapi_schemas(rows)


_STATS = "(SELECT p_brand AS snapshot_id, count(DISTINCT p_type) AS modules, count(*) FILTER (p_partkey % 2 = 0) AS exports, count(*) FILTER (p_partkey % 6 = 0) AS documented FROM part GROUP BY 1)"
_SHARE = "CASE WHEN exports > 0 THEN floor(documented * 100.0 / exports * 10 + 0.5) / 10 ELSE 100.0 END"


def _stats(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("snapshot_id")).agg(F.count_distinct("p_type").alias("modules"), F.count_if(k % 2 == 0).alias("exports"), F.count_if(k % 6 == 0).alias("documented"))


@query(f"SELECT snapshot_id, '---' || chr(10) || 'id: ' || snapshot_id || chr(10) || 'modules: ' || modules || chr(10) || 'exports: ' || exports || chr(10) || 'coverage: ' || CAST({_SHARE} AS DOUBLE) || chr(10) || '---' AS text FROM {_STATS}")
def front_matter(spark, sf):
    return rendering.front_matter(_stats(spark, sf))


@query(f"SELECT snapshot_id AS id, unnest(['id', 'modules', 'exports', 'coverage']) AS key, unnest([snapshot_id, CAST(modules AS VARCHAR), CAST(exports AS VARCHAR), CAST(CAST({_SHARE} AS DOUBLE) AS VARCHAR)]) AS value FROM {_STATS}")
def parsed_front_matter(spark, sf):
    return rendering.parse_front_matter(rendering.front_matter(_stats(spark, sf)).select(F.col("snapshot_id").alias("id"), "text"))


# --- contexts -----------------------------------------------------------------------------------


@query("""SELECT p_partkey AS pos, CAST(ceil(length('{"name":"' || p_name || '","signature":"f(' || p_size || ')","purpose":"' || p_type || '"}') / 4.0) AS BIGINT) AS tokens, upper(substr(p_brand, 1, 1)) || substr(p_brand, 2) || ' `' || p_name || '` ' || p_type || '.' AS summary FROM part""")
def context_sizes(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.concat(F.lit("f("), F.col("p_size").cast("string"), F.lit(")")).alias("signature"), F.col("p_type").alias("description"), "p_brand")
    return rendering.context_tokens(rows).select("pos", "tokens", extraction.template_summary(F.col("p_brand"), F.col("name"), F.col("description")).alias("summary"))


@query(
    """WITH s AS (SELECT p_brand AS module, p_partkey AS pos, p_partkey || 'n' AS name, p_type AS kind, p_partkey % 3 = 0 AS out FROM part), k AS (SELECT module, kind, min(pos) AS p FROM s GROUP BY 1, 2), o AS (SELECT module, name, pos, row_number() OVER (PARTITION BY module ORDER BY pos) AS r FROM s WHERE out),
m AS (SELECT module, string_agg(name, ', ' ORDER BY pos) AS main FROM o WHERE r <= 3 GROUP BY 1) SELECT k.module, 'Module providing ' || string_agg(kind, ', ' ORDER BY p) || ' definitions. Main exports: ' || coalesce(any_value(main), 'none') || '.' AS text FROM k LEFT JOIN m ON m.module = k.module GROUP BY k.module"""
)
def module_purposes(spark, sf):
    name = F.concat(F.col("p_partkey").cast("string"), F.lit("n"))
    p = table(spark, sf, "part").select(F.col("p_brand").alias("module"), F.col("p_partkey").alias("pos"), name.alias("name"), F.col("p_type").alias("kind"))
    return extraction.module_purpose(p, p.filter("pos % 3 = 0").select(F.col("module").alias("path"), "name"))


@query(
    """WITH s AS (SELECT p_brand AS module, p_partkey AS pos, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS e, CASE WHEN p_partkey % 3 = 0 THEN 'a/b/' || p_type END AS r, row_number() OVER (PARTITION BY p_brand, p_partkey % 2 = 0 ORDER BY p_partkey) AS ei, row_number() OVER (PARTITION BY p_brand, p_partkey % 3 = 0 ORDER BY p_partkey) AS ri FROM part)
SELECT module, coalesce(string_agg(name || ': ' || e, '|' ORDER BY pos) FILTER (e IS NOT NULL AND ei <= 5), '') AS usage, coalesce(string_agg('Use ' || split_part(r, '/', 3) || ' instead of ' || name, '|' ORDER BY pos) FILTER (r IS NOT NULL AND ri <= 5), '') AS practices FROM s GROUP BY 1"""
)
def usage_patterns(spark, sf):
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("module"), k.alias("pos"), F.col("p_name").alias("name"), F.when(k % 2 == 0, F.col("p_type")).alias("example"), F.when(k % 3 == 0, F.concat(F.lit("a/b/"), "p_type")).alias("replacement"))
    return extraction.usage_patterns(rows).select("module", F.array_join("usage", "|").alias("usage"), F.array_join("practices", "|").alias("practices"))


@query(
    """WITH c AS (SELECT n_regionkey AS module, n_name AS name, n_nationkey AS k FROM nation), s AS (SELECT n_regionkey AS module, s_nationkey AS k, 'm' || s_suppkey AS name, s_suppkey % 2 = 0 AS method FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT CAST(c.module AS VARCHAR) AS module, c.name, coalesce(array_to_string(list_sort(list(s.name) FILTER (s.method)), ','), '') AS methods, coalesce(array_to_string(list_sort(list(s.name) FILTER (NOT s.method)), ','), '') AS properties FROM c LEFT JOIN s ON s.module = c.module AND s.k = c.k GROUP BY 1, 2"""
)
def class_members(spark, sf):
    n = table(spark, sf, "nation")
    none = F.array().cast("array<string>")
    module = F.col("n_regionkey").cast("string").alias("module")
    classes = n.select(module, F.col("n_name").alias("qualified"), F.col("n_name").alias("name"), F.lit("class").alias("kind"), none.alias("refs"))
    s = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    name = F.concat(F.lit("m"), F.col("s_suppkey").cast("string"))
    below = F.col("s_suppkey") % 3 == 0  # the others refer to their class
    members = s.select(module, F.when(below, F.concat("n_name", F.lit("."), name)).otherwise(name).alias("qualified"), name.alias("name"), F.when(F.col("s_suppkey") % 2 == 0, "method").otherwise("field").alias("kind"), F.when(below, none).otherwise(F.array(F.concat(F.lit("x/"), "n_name"))).alias("refs"))
    out = extraction.class_members(classes.unionByName(members))
    return out.select("module", "name", F.array_join("methods", ",").alias("methods"), F.array_join("properties", ",").alias("properties"))


# --- chunks -------------------------------------------------------------------------------------

_HASH = "substr(sha256({}), 1, 16)"


# white space of any kind at the ends, as the operators take it off
_STRIP = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(8232) || chr(8233) || chr(65279))"


@query(
    f"""WITH s AS (SELECT source AS path, 's' || doc_id AS symbol, 'private export ' || CASE WHEN doc_id % 3 = 0 THEN 'function f' || doc_id || '(a)' || chr(10) || '  {{ ' ELSE '' END || text AS content FROM documents),
h AS (SELECT *, string_split(content, chr(10))[1] AS line, {_STRIP.format("string_split(content, '{')[1]")} AS head FROM s WHERE ceil(length(content) / 4.0) >= 50)
SELECT {_HASH.format("path || ':symbol:' || symbol")} AS id, path, symbol, 'function' AS kind, content, CASE WHEN contains(content, '{{') THEN head WHEN length(line) > 100 THEN substr(line, 1, 100) || '...' ELSE line END AS signature, 'private' AS visibility, TRUE AS exported FROM h"""
)
def symbol_chunks(spark, sf):
    d = table(spark, sf, "documents")
    own = F.col("doc_id").cast("string")
    start = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("function f"), own, F.lit("(a)\n  { "))).otherwise("")
    rows = d.select(F.col("source").alias("path"), F.concat(F.lit("s"), own).alias("name"), F.lit("function").alias("kind"), F.concat(F.lit("private export "), start, "text").alias("text"))
    return extraction.symbol_chunks(rows)


# a comment's markers at the ends, slashes and stars at the starts of lines, quotes at the ends
_UNMARKED = _STRIP.format("""regexp_replace(regexp_replace(regexp_replace(regexp_replace(' ' || text || ' ', '(?m)^///?', '', 'g'), '(?m)^\\s*\\*\\s?', '', 'g'), '^"{3}|"{3}$', '', 'g'), '^''{3}|''{3}$', '', 'g')""")


@query(
    f"""WITH c AS (SELECT conv_id, turn, role, {_UNMARKED} AS content FROM conversations)
SELECT {_HASH.format("conv_id || ':comment:' || turn")} AS id, CAST(conv_id AS VARCHAR) AS path, role AS symbol, content FROM c WHERE ceil(length(content) / 4.0) >= 50
UNION ALL SELECT {_HASH.format("'pr-' || page_id || ':pr'")}, 'pr/' || page_id, NULL, '# ' || url || chr(10) || chr(10) || 'body' || chr(10) || chr(10) || '## Discussion' || chr(10) || '- one' || chr(10) || '- ' || page_id FROM pages"""
)
def talk_chunks(spark, sf):
    talk = table(spark, sf, "conversations")
    comments = extraction.comment_chunks(talk.select(F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("line"), F.concat(F.lit("/** "), "text", F.lit(" */")).alias("text"), F.col("role").alias("symbol")))
    number = F.col("page_id").cast("string")
    requests = extraction.request_chunks(table(spark, sf, "pages").select(F.col("page_id").alias("num"), F.col("url").alias("title"), F.lit("body").alias("body"), F.array(F.lit("one"), number).alias("comments")))
    return comments.select("id", "path", "symbol", "content").unionByName(requests.select("id", "path", F.lit(None).cast("string").alias("symbol"), "content"))


@query(
    f"""WITH c AS (SELECT 'c' || s_suppkey AS sha, s_name AS msg, 'diff --git a/x' || s_nationkey || ' b/x' || chr(10) || '+one' || chr(10) AS d1, 'diff --git a/y b/y' || chr(10) || '-two' AS d2 FROM supplier)
SELECT {_HASH.format("sha || ':commit'")} AS id, 'project' AS level, sha AS path, msg || chr(10) || chr(10) || '2 files (+1/-1)' AS content, NULL AS parent FROM c
UNION ALL SELECT {_HASH.format("sha || ':file:' || regexp_extract(d1, 'a/(.+?) b/', 1)")}, 'file', regexp_extract(d1, 'a/(.+?) b/', 1), d1, {_HASH.format("sha || ':commit'")} FROM c UNION ALL SELECT {_HASH.format("sha || ':file:y'")}, 'file', 'y', d2, {_HASH.format("sha || ':commit'")} FROM c"""
)
def commit_chunks(spark, sf):
    d = F.concat(F.lit("diff --git a/x"), F.col("s_nationkey").cast("string"), F.lit(" b/x\n+one\ndiff --git a/y b/y\n-two"))
    return sequences.commit_chunks(table(spark, sf, "supplier").select(F.concat(F.lit("c"), F.col("s_suppkey").cast("string")).alias("sha"), F.col("s_name").alias("msg"), d.alias("diff")))


@query("SELECT doc_id, array_to_string(list_slice(list_filter(string_split('import x' || chr(10) || text || chr(10) || '  // end', chr(10)), lambda l: regexp_matches(l, '^\\s*(import|export|module|//|/\\*|\\*|#)')), 1, 50), chr(10)) AS context FROM documents")
def file_contexts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", extraction.file_context(F.concat(F.lit("import x\n"), "text", F.lit("\n  // end"))).alias("context"))


@query(
    """WITH c AS (SELECT p_partkey AS path, p_size AS symbols, least(p_size, p_partkey % 60) AS documented FROM part), i AS (SELECT p_partkey AS path, p_retailprice / 100 AS score FROM part WHERE p_partkey % 3 <> 0)
SELECT c.path, symbols, documented, round(documented * 100.0 / symbols, 1) AS percent, coalesce(score, 0.0)::DOUBLE AS importance, CASE WHEN documented * 100.0 / symbols < 50 THEN 'document the public symbols' WHEN documented * 100.0 / symbols < 80 THEN 'fill the gaps' ELSE 'good' END AS advice FROM c LEFT JOIN i ON i.path = c.path WHERE coalesce(score, 0) >= 5"""
)
def coverage_report(spark, sf):
    p = table(spark, sf, "part")
    told = p.select(F.col("p_partkey").alias("path"), F.col("p_size").alias("symbols"), F.least(F.col("p_size").cast("long"), F.col("p_partkey") % 60).alias("documented"))
    return extraction.coverage_report(told, p.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("path"), (F.col("p_retailprice") / 100).alias("score")))


# --- stores -------------------------------------------------------------------------------------

_BASE = "SELECT 'e' || vec_id AS id, 'p' || vec_id % 97 AS path, 'v' || label AS content, CASE WHEN label % 2 = 0 THEN 'code' ELSE 'docs' END AS type, CASE WHEN vec_id % 3 = 0 THEN 'file' ELSE 'symbol' END AS level FROM embeddings"


def _chunks(spark, sf):
    v = table(spark, sf, "embeddings")
    tag = lambda a, c: F.concat(F.lit(a), c.cast("string"))
    return v.select(tag("e", F.col("vec_id")).alias("id"), tag("p", F.col("vec_id") % 97).alias("path"), tag("v", F.col("label")).alias("content"), F.when(F.col("label") % 2 == 0, "code").otherwise("docs").alias("type"), F.when(F.col("vec_id") % 3 == 0, "file").otherwise("symbol").alias("level"))


@query(f"SELECT id, path, CASE WHEN CAST(substr(id, 2) AS BIGINT) % 5 = 0 THEN 'new' ELSE content END AS content, type, level FROM ({_BASE}) WHERE CAST(substr(id, 2) AS BIGINT) % 7 <> 0 AND path <> 'p3' AND NOT (type = 'docs' AND level = 'file')")
def chunk_store(spark, sf):
    rows = _chunks(spark, sf)
    number = F.substring("id", 2, 20).cast("long")
    store = stores.ChunkStore(spark, _folder(spark, "chunks"))
    store.insert(rows.filter(number % 2 == 0))
    store.upsert(rows.filter(number % 2 == 1))
    store.upsert(rows.filter(number % 5 == 0).withColumn("content", F.lit("new")))
    store.delete(rows.filter(number % 7 == 0))
    store.delete(spark.createDataFrame([("p3",)], "path string"), "path")
    store.drop_collection("docs", "file")
    return store.read()


@query(f"SELECT 'n ' || type || ' ' || level AS what, count(*) AS n FROM ({_BASE}) GROUP BY 1 UNION ALL SELECT 'path', count(*) FROM ({_BASE}) WHERE path = 'p5' UNION ALL SELECT 'id', count(*) FROM ({_BASE}) WHERE id = 'e8' UNION ALL SELECT 'docs', count(*) FROM ({_BASE}) WHERE type = 'docs'")
def chunk_lookups(spark, sf):
    store = stores.ChunkStore(spark, _folder(spark, "chunks"))
    store.replace_paths(spark.createDataFrame([("p0",)], "path string"), _chunks(spark, sf))
    one = lambda df, what: df.select(F.lit(what).alias("what")).groupBy("what").agg(F.count("*").alias("n"))
    told = store.collections().select(F.concat_ws(" ", F.lit("n"), "type", "level").alias("what"), "n")
    return told.unionByName(one(store.by_path("p5"), "path")).unionByName(one(store.by_id("e8"), "id")).unionByName(one(store.read("docs"), "docs"))


@query("SELECT 's2' AS snapshot_id, 'v2' AS tag, count(*) AS exports, 'latest' AS list FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT 's1', 'v1', count(*), 'tag' FROM part WHERE p_partkey % 11 <> 0 UNION ALL SELECT 's1', 'modules', count(DISTINCT p_brand), 'stats' FROM part WHERE p_partkey % 11 <> 0 UNION ALL SELECT 's1', 'documented', count(*), 'stats' FROM part WHERE p_partkey % 11 <> 0 AND length(p_name) > 0")
def snapshots(spark, sf):
    before, after = inputs.part_versions(spark, sf)
    store = stores.SnapshotStore(spark, _folder(spark, "snapshots"))
    made = store.create(before, "s1", "w", "v1", "2024-01-01").first()
    store.create(after, "s2", "w", "v2", "2024-02-01")
    store.create(after, "s3", "w", "v3", "2024-03-01")
    store.delete("s3")
    row = lambda df, name: df.select("snapshot_id", "tag", "exports", F.lit(name).alias("list"))
    stats = spark.createDataFrame([("s1", "modules", made["modules"], "stats"), ("s1", "documented", made["documented"], "stats")], "snapshot_id string, tag string, exports long, list string")
    return row(store.latest("w"), "latest").unionByName(row(store.by_tag("w", "v1"), "tag")).unionByName(stats)


@query("SELECT CAST(doc_id AS VARCHAR) AS uri, md5(text) AS source_hash, md5(source) AS doc_hash, TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS last_generated, CASE WHEN doc_id % 2 = 0 THEN 'c' || doc_id END AS git_commit FROM documents WHERE text IS NOT NULL")
def freshness_round_trip(spark, sf):
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("doc_id") * 60)
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("uri"), F.md5("text").alias("source_hash"), F.md5("source").alias("doc_hash"), ts.alias("last_generated"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("c"), F.col("doc_id").cast("string"))).alias("git_commit"))
    path = _folder(spark, "freshness")
    stores.write_freshness(d, path)
    return stores.read_freshness(spark, path, lines=True)


@query(f"SELECT uri, hash AS source_hash FROM {CURRENT} WHERE CAST(uri AS BIGINT) % 7 <> 0 UNION ALL SELECT uri, source_hash FROM {STORE} WHERE uri NOT IN (SELECT uri FROM {CURRENT}) AND CAST(uri AS BIGINT) % 7 <> 0")
def recorded_store(spark, sf):
    current, store = inputs.freshness_store(spark, sf)
    new = freshness.record(store, current.withColumnRenamed("hash", "source_hash"))
    return freshness.remove(new, table(spark, sf, "documents").filter("doc_id % 7 = 0").select(F.col("doc_id").cast("string").alias("uri")))


@query(f"SELECT id, CAST(substr(id, 2) AS BIGINT) AS line_start, CAST(substr(id, 2) AS BIGINT) + 9 AS line_end, CASE WHEN CAST(substr(id, 2) AS BIGINT) % 2 = 0 THEN content END AS author FROM ({_BASE})")
def chunk_records(spark, sf):
    number = F.substring("id", 2, 20).cast("long")
    rows = _chunks(spark, sf).select("id", F.array(number, number + 9).alias("lines"), F.struct(F.when(number % 2 == 0, F.col("content")).alias("author")).alias("meta"))
    back = stores.to_chunk(stores.to_record(rows), "struct<author:string>")
    return back.select("id", F.col("lines")[0].alias("line_start"), F.col("lines")[1].alias("line_end"), F.col("meta.author").alias("author"))


@query("SELECT page_id, sha256(html) AS hash FROM pages")
def module_hashes(spark, sf):
    from ..functions.text import content_hash

    return table(spark, sf, "pages").select("page_id", content_hash(F.col("html")).alias("hash"))


# --- retrieval ------------------------------------------------------------------------------------

_COS = "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))))"


@query(f"SELECT qid, id, rank, round(vec, 6) AS vec FROM (SELECT q.vec_id AS qid, e.vec_id AS id, {_COS} AS vec, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND {_COS} >= 0.2) WHERE rank <= 20")
def global_search(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    q = v.filter("id % 20 = 0").select(F.col("id").alias("qid"), "vec")
    return retrieval.knn(q, v, 20, 0.2).select("qid", "id", F.col("rank").cast("long").alias("rank"), F.round("vec", 6).alias("vec"))


@query(f"WITH x AS (SELECT q.vec_id AS id, max({_COS}) AS best FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND e.vec_id % 2 = 1 GROUP BY 1) SELECT id, round(best, 6) AS best FROM x")
def best_matches(spark, sf):
    from ..operators.incoherence import best_match

    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return best_match(v.filter("id % 20 = 0"), v.filter("id % 2 = 1")).withColumn("best", F.round("best", 6))


#: The issues of the query "incoherence": even documents are code, odd ones documentation.
INCOHERENCE = f"""WITH x AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, source AS path, 's' || doc_id % 50 AS symbol, text AS content, embedding FROM embeddings JOIN documents ON vec_id = doc_id),
c AS (SELECT * FROM x WHERE doc_id % 2 = 0), d AS (SELECT * FROM x WHERE doc_id % 2 = 1), s AS (SELECT q.id AS cid, e.id AS did, {_COS} AS sim FROM c q, d e),
bc AS (SELECT cid AS id, max(sim) AS best FROM s GROUP BY 1), bd AS (SELECT did AS id, max(sim) AS best FROM s GROUP BY 1),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, symbol ORDER BY id) AS n FROM d) WHERE n = 1)
SELECT path, id, 'missing' AS type, 0.8::DOUBLE AS severity, 'No documentation for function "' || symbol || '"' AS message FROM c WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.path = c.path AND (d.symbol = c.symbol OR contains(lower(d.content), c.symbol))) AND id NOT IN (SELECT id FROM bc WHERE best >= 0.5)
UNION ALL SELECT path, id, 'orphaned', 0.5, 'Doc for "' || symbol || '" has no code' FROM d WHERE (path, symbol) NOT IN (SELECT (path, symbol) FROM c) AND id NOT IN (SELECT id FROM bd WHERE best >= 0.5)
UNION ALL SELECT c.path, c.id, 'mismatch', round(1 - sim, 6), 'mismatch' FROM c JOIN f ON f.path = c.path AND f.symbol = c.symbol JOIN s ON s.cid = c.id AND s.did = f.id WHERE sim < 0.6
UNION ALL SELECT path, id, 'incomplete', 0.25 * (p + r + t), 'Missing: ' || array_to_string(list_filter([CASE WHEN p = 1 THEN 'parameters' END, CASE WHEN r = 1 THEN 'return' END, CASE WHEN t = 1 THEN 'exceptions' END], lambda m: m IS NOT NULL), ', ') FROM (SELECT c.path, c.id, CASE WHEN NOT contains(lower(f.content), '@param') AND NOT contains(lower(f.content), 'parameter') THEN 1 ELSE 0 END AS p, CASE WHEN NOT contains(lower(f.content), '@return') AND NOT contains(lower(f.content), 'returns') THEN 1 ELSE 0 END AS r,
CASE WHEN contains(c.content, 'throw ') AND NOT contains(lower(f.content), '@throws') AND NOT contains(lower(f.content), 'throws') THEN 1 ELSE 0 END AS t FROM c JOIN f ON f.path = c.path AND f.symbol = c.symbol) WHERE p + r + t > 0"""


@query(INCOHERENCE)
def incoherence(spark, sf):
    from ..operators.incoherence import find_incoherence

    e = table(spark, sf, "embeddings").join(table(spark, sf, "documents"), F.col("vec_id") == F.col("doc_id"))
    rows = e.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("path"), F.concat(F.lit("s"), (F.col("doc_id") % 50).cast("string")).alias("symbol"), F.lit("function").alias("kind"), F.col("text").alias("content"), F.lit("f(a): string").alias("signature"), F.lit("public").alias("visibility"), F.lit(True).alias("exported"), F.lit(1).alias("complexity"), F.col("embedding").alias("vec"), "doc_id")
    found = find_incoherence(rows.filter("doc_id % 2 = 0").drop("doc_id"), rows.filter("doc_id % 2 = 1").drop("doc_id"))
    said = F.when(F.col("type") == "mismatch", "mismatch").otherwise(F.col("message"))  # its message holds a rounded share
    return found.select("path", "id", "type", F.round("severity", 6).alias("severity"), said.alias("message"))


_OPS = " + ".join(f"(length(plain) - length(replace(plain, '{o}', ''))) // {len(o)}" for o in metrics.OPERATORS)
_KINDS = " + ".join(f"CASE WHEN contains(plain, '{o}') THEN 1 ELSE 0 END" for o in metrics.OPERATORS)
_WORDS = ", ".join(f"'{o}'" for o in metrics.OPERATORS)
_STRINGS_SQL = r"''(?:[^''\\]|\\.)*''" + r'|"(?:[^"\\]|\\.)*"|`(?:[^`\\]|\\.)*`'


@query(
    f"""WITH p AS (SELECT page_id, html, {_PLAIN} AS plain FROM pages),
o AS (SELECT page_id, {_OPS} AS n, {_KINDS} AS k, list_concat(list_concat(list_filter(regexp_extract_all(plain, '\\b[a-zA-Z_]\\w*\\b'), lambda w: w NOT IN ({_WORDS})), regexp_extract_all(plain, '\\b\\d+(?:\\.\\d+)?\\b')), regexp_extract_all(plain, '{_STRINGS_SQL}')) AS words FROM p),
h AS (SELECT page_id, n, k, len(words) AS total, len(list_distinct(words)) AS kinds FROM o)
SELECT page_id AS path, CAST(n AS INTEGER) AS operators, CAST(total AS INTEGER) AS operands, CAST(k AS INTEGER) AS unique_operators, CAST(kinds AS INTEGER) AS unique_operands, round(CASE WHEN kinds > 0 THEN k / 2.0 * (total / kinds) ELSE 0 END, 6)::DOUBLE AS difficulty FROM h"""
)
def halstead_metrics(spark, sf):
    h = metrics.halstead(F.col("html"))
    rows = table(spark, sf, "pages").select(F.col("page_id").alias("path"), h.alias("h"))
    return rows.select("path", "h.operators", "h.operands", "h.unique_operators", "h.unique_operands", F.round("h.difficulty", 6).alias("difficulty"))


@query("SELECT p_partkey, round(greatest(0.0, least(100.0, (171 - 5.2 * ln(p_retailprice) - 0.23 * p_size - 16.2 * ln(p_size)) * 100 / 171)), 6) AS maintainability, CAST(least(10, CASE WHEN p_size > 50 THEN 3 WHEN p_size > 20 THEN 2 WHEN p_size > 10 THEN 1 ELSE 0 END + CASE WHEN p_size * 3 > 100 THEN 3 WHEN p_size * 3 > 50 THEN 2 WHEN p_size * 3 > 20 THEN 1 ELSE 0 END + CASE WHEN p_size < 20 THEN 2 WHEN p_size < 40 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 9 > 6 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 5 > 3 THEN 1 ELSE 0 END) AS INTEGER) AS overall FROM part")
def overall_scores(spark, sf):
    z, k = F.col("p_size"), F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", F.round(metrics.maintainability(F.col("p_retailprice"), z, z), 6).alias("maintainability"), metrics.overall_score(z, z * 3, z, k % 9, k % 5).cast("int").alias("overall"))


# pages behind a small function, so that every file has bodies: run over three lines with two parameters, and the branch in it
_CODE = "(SELECT page_id, 'function run(a, b) {' || chr(10) || '  if (a) { return ' || page_id || '; }' || chr(10) || '}' || chr(10) || html AS html FROM pages)"
_PART = {name: f"({SQL[name].replace('FROM pages', f'FROM {_CODE}')})" for name in ("line_metrics", "halstead_metrics")}
_PART["halstead_metrics"] = _PART["halstead_metrics"].replace("round(CASE WHEN kinds", "(CASE WHEN kinds").replace("END, 6)::DOUBLE", "END)::DOUBLE")  # not rounded
_BRANCHES = f"(SELECT page_id AS path, CAST(1 + {count_sql(_PLAIN, [*metrics.DECISIONS, *metrics.LOGICAL])} AS INTEGER) AS cyclomatic FROM {_CODE})"


@query(
    f"""WITH x AS (SELECT l.path, l.code_lines, l.comment_lines, c.cyclomatic, l.cognitive, l.nesting, CASE WHEN unique_operators + unique_operands > 0 THEN (operators + operands) * log2(unique_operators + unique_operands) * difficulty ELSE 0 END AS effort FROM {_PART["line_metrics"]} l JOIN {_PART["halstead_metrics"]} h ON h.path = l.path JOIN {_BRANCHES} c ON c.path = l.path),
m AS (SELECT *, greatest(0.0, least(100.0, (171 - 5.2 * CASE WHEN effort > 0 THEN ln(effort) ELSE 0 END - 0.23 * cyclomatic - 16.2 * CASE WHEN code_lines > 0 THEN ln(code_lines) ELSE 0 END) * 100 / 171)) AS mi FROM x)
SELECT path, code_lines, comment_lines, cyclomatic, cognitive, nesting AS max_nesting, 2::BIGINT AS functions, 2.0::DOUBLE AS avg_function_length, 3::BIGINT AS parameters, round(mi, 4) AS maintainability,
CAST(least(10, CASE WHEN cyclomatic > 50 THEN 3 WHEN cyclomatic > 20 THEN 2 WHEN cyclomatic > 10 THEN 1 ELSE 0 END + CASE WHEN cognitive > 100 THEN 3 WHEN cognitive > 50 THEN 2 WHEN cognitive > 20 THEN 1 ELSE 0 END + CASE WHEN mi < 20 THEN 2 WHEN mi < 40 THEN 1 ELSE 0 END + CASE WHEN nesting > 6 THEN 1 ELSE 0 END) AS INTEGER) AS overall FROM m"""
)
def complexity(spark, sf):
    code = F.concat(F.lit("function run(a, b) {\n  if (a) { return "), F.col("page_id").cast("string"), F.lit("; }\n}\n"), "html")
    rows = metrics.analyze_complexity(table(spark, sf, "pages").select(F.col("page_id").alias("path"), code.alias("content")))
    return rows.select("path", "code_lines", "comment_lines", "cyclomatic", "cognitive", "max_nesting", "functions", "avg_function_length", "parameters", F.round("maintainability", 4).alias("maintainability"), "overall")


@query()
def fitted_neighbours(spark, sf):
    """The nearest documents of every twentieth one by the fitted embedder."""
    docs = inputs.texts(spark, sf)
    model = embedder.fit_embedder(docs)
    rows = checkpointed(embedder.embed(docs, model))  # each text once, for counts, queries and candidates
    hits = retrieval.knn(rows.filter("id % 20 = 0").select(F.col("id").alias("qid"), "vec"), rows, 5, exclude_self=True)
    return hits.select("qid", F.col("rank").cast("long").alias("rank"), "id", F.round("vec", 6).alias("score"))
