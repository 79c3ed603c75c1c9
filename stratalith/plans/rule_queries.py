"""Registered queries over rules, filters, top-k lists, coverage, graphs and traceability."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage, extraction, filters, freshness, graph, incoherence, lint, ranking, trace
from ..operators.overlap import overlap_totals
from . import inputs
from .inputs import CALL_EDGES, CURRENT, CUSTOMER_GRAPH, STORE, SYMBOLS, table
from .register import query


def _long(df, *names):
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# --- rules ------------------------------------------------------------------------------------


@query(f"SELECT path, name, 'rule ' || CASE WHEN doc_id % 3 = 0 THEN 'x0' WHEN doc_id % 3 = 1 THEN 'x1' ELSE 'x2' END AS param FROM {SYMBOLS}")
def outdated_params(spark, sf):
    s = inputs.symbols(spark, sf)
    k = F.col("name").cast("long") % 3
    told = s.select("path", "name", F.array(F.lit("data"), F.concat(F.lit("x"), k.cast("string"))).alias("names"))
    return lint.outdated_params(told, s).select("path", "name", F.concat(F.lit("rule "), "param").alias("param"))


_EXPORTED = "SELECT source AS path, CAST(doc_id + doc_id % 2 * 1000000 AS VARCHAR) AS name FROM documents"


@query(f"SELECT e.path, e.name, 'Export \"' || e.name || '\" is undocumented' AS message FROM ({_EXPORTED}) e LEFT JOIN {SYMBOLS} s ON s.path = e.path AND s.name = e.name WHERE s.name IS NULL OR NOT regexp_matches(coalesce(s.description, ''), '\\S')")
def undocumented_exports(spark, sf):
    d = table(spark, sf, "documents")
    exports = d.select(F.col("source").alias("path"), (F.col("doc_id") + F.col("doc_id") % 2 * 1_000_000).cast("string").alias("name"))
    return lint.undocumented_exports(exports, inputs.symbols(spark, sf)).select("path", "name", "message")


@query(f"SELECT path, name, '#/definitions/' || doc_id * 2 AS ref FROM {SYMBOLS} WHERE doc_id * 2 IN (SELECT doc_id FROM documents)")
def kept_references(spark, sf):
    return lint.kept_references(inputs.symbols(spark, sf)).select("path", "name", "ref")


_PLACEHOLDER = " OR ".join(f"regexp_matches(description, '{p}')" for _, p in lint.PLACEHOLDERS)
_RULED = f"""SELECT path, name, 'missing-description' AS rule, 'error' AS severity FROM {SYMBOLS} WHERE NOT regexp_matches(coalesce(description, ''), '\\S')
UNION ALL SELECT path, name, 'missing-param-description', 'warning' FROM {SYMBOLS} UNION ALL SELECT path, name, 'missing-param-description', 'warning' FROM {SYMBOLS} WHERE NOT regexp_matches(coalesce(lang, ''), '\\S')
UNION ALL SELECT path, name, 'missing-return-description', 'error' FROM {SYMBOLS} WHERE kind = 'function' AND return_type = 'string' AND NOT contains(lower(coalesce(description, '')), '@return') AND NOT contains(lower(coalesce(description, '')), 'returns ')
UNION ALL SELECT path, name, 'placeholder', 'warning' FROM {SYMBOLS} WHERE {_PLACEHOLDER} UNION ALL SELECT path, name, 'stub', 'error' FROM {SYMBOLS} WHERE kind = 'function' AND signature = 'return null;'
UNION ALL SELECT path, name, 'generic-parameter', 'info' FROM {SYMBOLS} UNION ALL SELECT path, name, 'broken-reference', 'error' FROM {SYMBOLS} WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)"""


@query(f"SELECT * FROM ({_RULED}) WHERE path IS NOT NULL")
def lint_configured(spark, sf):
    """All rules but the one that the configuration switches off, over all modules; two have another severity."""
    config = {"stub": "error", "missing-return-description": "error", "missing-example": "off"}
    modules = table(spark, sf, "documents").select(F.col("source").alias("path"))
    return lint.lint_modules(modules, inputs.symbols(spark, sf), config).select("path", "name", "rule", "severity")


@query(f"SELECT path, name, rule, CASE rule WHEN 'stub' THEN 'warning' ELSE severity END AS severity FROM ({_RULED}) WHERE path IS NOT NULL AND rule <> 'missing-description'")
def severity_overrides(spark, sf):
    return filters.with_severity(lint_configured(spark, sf), {"stub": "warning", "missing-description": "off"})


_MESSAGES = f"""SELECT path, name, 'Symbol "' || name || '" is missing a description' AS message FROM {SYMBOLS} WHERE NOT regexp_matches(coalesce(description, ''), '\\S')
UNION ALL SELECT path, name, 'Parameter "data" in "' || name || '" is missing a description' FROM {SYMBOLS} UNION ALL SELECT path, name, 'Parameter "count" in "' || name || '" is missing a description' FROM {SYMBOLS} WHERE NOT regexp_matches(coalesce(lang, ''), '\\S')
UNION ALL SELECT path, name, 'Function "' || name || '" is missing a return value description' FROM {SYMBOLS} WHERE kind = 'function' AND return_type = 'string' AND NOT contains(lower(coalesce(description, '')), '@return') AND NOT contains(lower(coalesce(description, '')), 'returns ')
UNION ALL SELECT path, name, 'Public symbol "' || name || '" is missing a code example' FROM {SYMBOLS} WHERE modifier = 'export' AND kind IN ('function', 'class', 'interface') AND NOT has_example AND NOT contains(lower(coalesce(description, '')), '@example')
UNION ALL SELECT path, name, 'Function "' || name || '" appears to be a stub: returns-null' FROM {SYMBOLS} WHERE kind = 'function' AND signature = 'return null;'
UNION ALL SELECT path, name, 'Parameter "data" in "' || name || '" has a generic name' FROM {SYMBOLS}
UNION ALL SELECT path, name, 'Symbol "' || name || '" refers to "#/definitions/' || doc_id * 2 || '", which is unknown' FROM {SYMBOLS} WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)"""


@query(_MESSAGES)
def lint_messages(spark, sf):
    s = inputs.symbols(spark, sf)
    rules = lint.missing_description, lint.missing_param_description, lint.missing_return_description, lint.missing_example, lint.stub_code, lint.generic_parameters, lint.broken_references
    out = None
    for rule in rules:
        out = rule(s) if out is None else out.unionByName(rule(s))
    return out.select("path", "name", "message")


# --- filters ----------------------------------------------------------------------------------

_CHUNK = "CASE label % 4 WHEN 0 THEN 'code' WHEN 1 THEN 'docs' WHEN 2 THEN 'comments' ELSE 'commits' END"
_LEVEL = "CASE vec_id % 3 WHEN 0 THEN 'symbol' WHEN 1 THEN 'file' ELSE 'weird' END"


@query(f"WITH c AS (SELECT vec_id, {_CHUNK} AS t, {_LEVEL} AS l FROM embeddings) SELECT vec_id, t = 'code' AND l = 'symbol' AS code_symbol, t IN ('comments', 'docs') AS doc, CASE WHEN l <> 'weird' THEN t END AS type, CASE WHEN l <> 'weird' THEN l END AS level FROM c")
def chunk_kinds(spark, sf):
    k = F.col("label") % 4
    kind = F.when(k == 0, "code").when(k == 1, "docs").when(k == 2, "comments").otherwise("commits")
    level = F.when(F.col("vec_id") % 3 == 0, "symbol").when(F.col("vec_id") % 3 == 1, "file").otherwise("weird")
    c = table(spark, sf, "embeddings").select("vec_id", kind.alias("type"), level.alias("level"))
    flag = lambda rows, name: rows.select("vec_id", F.lit(True).alias(name))
    parsed = filters.parse_collection(F.concat_ws("_", "type", "level"))
    out = c.join(flag(filters.code_symbols(c), "code_symbol"), "vec_id", "left").join(flag(filters.doc_chunks(c), "doc"), "vec_id", "left")
    return out.select("vec_id", F.coalesce("code_symbol", F.lit(False)).alias("code_symbol"), F.coalesce("doc", F.lit(False)).alias("doc"), parsed["type"].alias("type"), parsed["level"].alias("level"))


_MODELS = "(SELECT 'm' || p_partkey AS id, p_name AS name, p_type AS description, p_brand AS category, p_partkey % 3 = 0 AS is_cached, CASE p_partkey % 4 WHEN 0 THEN ['text'] WHEN 1 THEN ['image', 'text'] WHEN 2 THEN ['image'] ELSE [] END AS modalities, TIMESTAMP '2024-01-01' + p_partkey % 97 * INTERVAL 1 DAY AS created, p_retailprice AS score FROM part)"


def _models(spark, sf):
    k = F.col("p_partkey")
    kinds = F.when(k % 4 == 0, F.array(F.lit("text"))).when(k % 4 == 1, F.array(F.lit("image"), F.lit("text"))).when(k % 4 == 2, F.array(F.lit("image"))).otherwise(F.array().cast("array<string>"))
    created = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + k % 97 * 86400)
    return table(spark, sf, "part").select(F.concat(F.lit("m"), k.cast("string")).alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.col("p_brand").alias("category"), (k % 3 == 0).alias("is_cached"), kinds.alias("modalities"), created.alias("created"), F.col("p_retailprice").alias("score"))


@query(f"SELECT id, 'chat' AS list FROM {_MODELS} WHERE list_contains(modalities, 'text') UNION ALL SELECT id, 'found' FROM {_MODELS} WHERE category = 'Brand#2' AND is_cached AND contains(lower(name || ' ' || description || ' ' || id), 'e') UNION ALL SELECT id, 'category' FROM {_MODELS} WHERE category = 'Brand#1'")
def model_lists(spark, sf):
    m = _models(spark, sf)
    named = lambda rows, n: rows.select("id", F.lit(n).alias("list"))
    return named(filters.text_chat_models(m), "chat").unionByName(named(filters.filtered_models(m, "Brand#2", True, "E"), "found")).unionByName(named(filters.filtered_models(m, "Brand#1"), "category"))


@query(f"SELECT 0 AS pos, 'auto' AS id, 'Automatic' AS label UNION ALL SELECT CAST(row_number() OVER (ORDER BY created DESC, id) AS INTEGER), id, name FROM {_MODELS} WHERE list_contains(modalities, 'text')")
def model_options(spark, sf):
    return filters.model_options(_models(spark, sf)).select("pos", "id", "label")


@query(f"SELECT id FROM {_MODELS} ORDER BY created DESC, id DESC LIMIT 1")
def newest_model(spark, sf):
    return ranking.newest(_models(spark, sf), "none")


@query(f"SELECT m.id, c.id IS NOT NULL AS cached, r.score FROM {_MODELS} m LEFT JOIN (SELECT 'm' || p_partkey * 2 AS id FROM part) c ON c.id = m.id LEFT JOIN (SELECT 'm' || p_partkey * 3 AS id, p_size AS score FROM part) r ON r.id = m.id")
def merged_models(spark, sf):
    p = table(spark, sf, "part")
    name = lambda n: F.concat(F.lit("m"), (F.col("p_partkey") * n).cast("string")).alias("id")
    out = ranking.merged_models(_models(spark, sf).drop("is_cached", "score"), p.select(name(2)), p.select(name(3), F.col("p_size").alias("score")))
    return out.select("id", F.col("is_cached").alias("cached"), "score")


_STATUS = f"(SELECT uri AS path, CASE WHEN source_hash IS NULL THEN 'unknown' WHEN hash = source_hash THEN 'fresh' ELSE 'stale' END AS status FROM {CURRENT} LEFT JOIN {STORE} USING (uri))"


@query(f"SELECT path, 'stale' AS list FROM {_STATUS} WHERE status = 'stale' AND contains(path, '1') UNION ALL SELECT path, 'any' FROM {_STATUS} WHERE contains(path, '7')")
def entry_lists(spark, sf):
    rows = freshness.check_freshness(*inputs.freshness_store(spark, sf)).withColumnRenamed("uri", "path")
    named = lambda df, n: df.select("path", F.lit(n).alias("list"))
    return named(filters.filtered_entries(rows, "stale", "1"), "stale").unionByName(named(filters.filtered_entries(rows, None, "7"), "any"))


@query(f"SELECT folder, count(*) AS files, count(*) FILTER (status = 'fresh') AS fresh, count(*) FILTER (status = 'stale') AS stale, array_to_string(list_sort(list(path)), ',') AS paths FROM (SELECT 'd' || CAST(uri AS BIGINT) % 7 || '/x' AS folder, 'd' || CAST(uri AS BIGINT) % 7 || '/x/' || uri AS path, s.status FROM {CURRENT} c JOIN {_STATUS} s ON s.path = c.uri) GROUP BY 1")
def explorer_tree(spark, sf):
    status = freshness.check_freshness(*inputs.freshness_store(spark, sf))
    path = F.concat(F.lit("d"), (F.col("uri").cast("long") % 7).cast("string"), F.lit("/x/"), "uri")
    rows = status.select(path.alias("path"), "status")
    return coverage.explorer_tree(rows.select("path"), rows.select(F.col("path").alias("uri"), "status")).withColumn("paths", F.array_join("paths", ","))


_DAY = "CAST(epoch({}) // 86400 AS BIGINT)"


@query(
    f"""WITH s AS (SELECT o_custkey % 400 AS path, o_orderkey AS k, {_DAY.format("o_orderdate")} AS a, {_DAY.format("o_orderdate")} + CASE WHEN o_orderkey % 50 = 0 THEN 700 ELSE o_orderkey % 4 END AS b FROM orders),
r AS (SELECT l_suppkey % 400 AS path, l_orderkey * 10 + l_linenumber AS k, {_DAY.format("l_shipdate")} AS a, {_DAY.format("l_shipdate")} + CASE WHEN l_orderkey % 90 = 0 THEN 2000 ELSE CAST(l_quantity AS BIGINT) % 12 END AS b FROM lineitem)
SELECT s.k AS selection, count(*) AS n, min(r.k) AS first, CAST(sum(r.k) AS BIGINT) AS total FROM s JOIN r ON s.path = r.path AND s.a <= r.b AND r.a <= s.b GROUP BY 1"""
)
def selection_overlaps(spark, sf):
    """Many selections over many spans, short and long: what each one meets."""
    day = lambda c: F.unix_date(F.col(c).cast("date")).cast("long")
    key = F.col("o_orderkey")
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 400).alias("path"), key.alias("k"), day("o_orderdate").alias("start_line"), (day("o_orderdate") + F.when(key % 50 == 0, 700).otherwise(key % 4)).alias("end_line"))
    long = F.when(F.col("l_orderkey") % 90 == 0, 2000).otherwise(F.col("l_quantity").cast("long") % 12)
    li = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 400).alias("path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), day("l_shipdate").alias("start_line"), (day("l_shipdate") + long).alias("end_line"))
    met = overlap_totals(o, li, ["path"], "k")
    return met.groupBy(F.col("k").alias("selection")).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.sum("total").alias("total"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_linenumber * 2 <= 9 AND 5 <= l_linenumber * 2 + l_quantity GROUP BY 1, 2")
def selection(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 2).alias("start_line"), (F.col("l_linenumber") * 2 + F.col("l_quantity")).alias("end_line"))
    return ranking.overlapping(li, F.lit(5), F.lit(9)).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query(
    """WITH x AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE p_name END AS name, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS signature, p_partkey % 4 AS m FROM part)
SELECT k, coalesce(nullif(name, ''), 'unknown') AS name, coalesce(signature, '') AS signature, CASE m WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 2 THEN 'variable' ELSE 'variable' END AS kind, m < 3 AS exportable,
CASE WHEN trim(coalesce(name, '')) = '' THEN 'uri is empty' WHEN signature IS NULL THEN 'symbols are missing' WHEN m = 0 THEN 'language is empty' END AS error FROM x"""
)
def normal_symbols(spark, sf):
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(k.alias("k"), F.when(k % 5 == 0, "").when(k % 5 == 1, None).otherwise(F.col("p_name")).alias("name"), F.when(k % 3 == 0, F.col("p_type")).alias("signature"), F.lit(None).cast("array<string>").alias("modifiers"), (k % 4).alias("m"))
    rows = rows.withColumn("kind", filters.symbol_kind(F.col("m"), {"0": "class", "1": "function", "2": "variable"}))
    checked = filters.valid_extractions(rows.select("k", F.col("name").alias("uri"), F.when(F.col("m") == 0, "").otherwise("ts").alias("language_id"), F.col("signature").alias("symbols")))
    told = filters.normalized_symbols(rows).join(checked.select("k", "error"), "k")
    loose = F.when(F.col("m") == 3, "snippet").otherwise(F.col("kind"))
    return told.filter(F.size("modifiers") == 0).select("k", "name", "signature", "kind", filters.is_exportable(loose).alias("exportable"), "error")


# --- top-k lists ------------------------------------------------------------------------------


@query(
    """WITH f AS (SELECT p_partkey AS path, CAST(p_size AS DOUBLE) AS importance, CASE WHEN p_partkey % 6 <> 0 THEN CAST(p_partkey % 101 AS DOUBLE) END AS coverage FROM part)
SELECT path, 'need' AS list, row_number() OVER (ORDER BY importance * (100 - coalesce(coverage, 0)) DESC, path) AS place FROM f
UNION ALL SELECT path, 'low', place FROM (SELECT path, row_number() OVER (ORDER BY coverage, path) AS place FROM f WHERE coverage IS NOT NULL) WHERE place <= 25
UNION ALL SELECT path, 'high', place FROM (SELECT path, row_number() OVER (ORDER BY importance DESC, path) AS place FROM f) WHERE place <= 50"""
)
def file_lists(spark, sf):
    from ..numbering import numbered

    k = F.col("p_partkey")
    f = table(spark, sf, "part").select(k.alias("path"), F.col("p_size").cast("double").alias("importance"), F.when(k % 6 != 0, (k % 101).cast("double")).alias("coverage"))
    need = numbered(ranking.by_need(f), [-F.col("need"), "path"]).select("path", F.lit("need").alias("list"), (F.col("n") + 1).alias("place"))
    low = numbered(ranking.least(f.filter("coverage IS NOT NULL"), "coverage", 25), ["coverage", "path"]).select("path", F.lit("low").alias("list"), (F.col("n") + 1).alias("place"))
    high = numbered(ranking.most(f, "importance", 50), [-F.col("importance"), "path"]).select("path", F.lit("high").alias("list"), (F.col("n") + 1).alias("place"))
    return need.unionByName(low).unionByName(high)


@query(
    """WITH s AS (SELECT p_brand AS path, p_name AS name, p_partkey AS id, p_size AS line, p_partkey % 3 = 0 AS deprecated, CASE WHEN p_partkey % 2 = 0 THEN 'class' ELSE 'variable' END AS kind FROM part WHERE starts_with(lower(p_name), 's')),
r AS (SELECT *, CASE WHEN path = 'Brand#2' THEN 100 + greatest(0, 50 - abs(line - 20)) ELSE 0 END + CASE WHEN deprecated THEN 0 ELSE 20 END + CASE WHEN kind = 'class' THEN 10 ELSE 0 END AS relevance FROM s)
SELECT path, name, CAST(relevance AS INTEGER) AS relevance FROM r ORDER BY relevance DESC, path, name LIMIT 10"""
)
def completion_list(spark, sf):
    k = F.col("p_partkey")
    s = table(spark, sf, "part").select(F.col("p_brand").alias("path"), F.col("p_name").alias("name"), F.col("p_size").alias("line"), (k % 3 == 0).alias("deprecated"), F.when(k % 2 == 0, "class").otherwise("variable").alias("kind"))
    return ranking.completions(s, "S", "Brand#2", 20).select("path", "name", F.col("relevance").cast("int").alias("relevance"))


_TREE = "(SELECT 'r' || r_regionkey AS id, NULL AS parent_id, r_regionkey AS pos FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_suppkey FROM supplier)"


def _tree(spark, sf):
    tag = lambda a, c: F.concat(F.lit(a), F.col(c).cast("string"))
    none = F.lit(None).cast("string")
    r = table(spark, sf, "region").select(tag("r", "r_regionkey").alias("id"), none.alias("parent_id"), F.col("r_regionkey").cast("long").alias("pos"))
    n = table(spark, sf, "nation").select(tag("n", "n_nationkey").alias("id"), tag("r", "n_regionkey").alias("parent_id"), F.col("n_nationkey").cast("long").alias("pos"))
    return r.unionByName(n).unionByName(table(spark, sf, "supplier").select(tag("s", "s_suppkey").alias("id"), tag("n", "s_nationkey").alias("parent_id"), F.col("s_suppkey").alias("pos")))


@query(f"WITH RECURSIVE t AS (SELECT id, parent_id, 0 AS depth, CAST(pos AS VARCHAR) AS path FROM {_TREE} WHERE parent_id IS NULL UNION ALL SELECT c.id, c.parent_id, depth + 1, path || '/' || c.pos FROM t JOIN {_TREE} c ON c.parent_id = t.id) SELECT * FROM t")
def flat_symbols(spark, sf):
    return ranking.flatten_tree(_tree(spark, sf)).withColumn("path", F.array_join("path", "/"))


@query("WITH d AS (SELECT p_brand AS module, p_partkey AS pos, CASE WHEN p_partkey % 2 = 1 THEN p_type || '.' || p_name ELSE p_name END AS key FROM part) SELECT module, key, max(pos) AS pos FROM d GROUP BY 1, 2")
def definition_keys(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("module"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.col("p_type").alias("parent"), (F.col("p_partkey") % 2).alias("depth"))
    return ranking.module_definitions(p).select("module", "key", "pos")


# --- coverage ---------------------------------------------------------------------------------


@query(
    f"""SELECT (SELECT count(DISTINCT source) FROM documents) AS modules, count(*) AS symbols, count(*) FILTER (regexp_matches(coalesce(description, ''), '\\S')) AS documented, (SELECT count(*) FROM {_STATUS} WHERE status = 'fresh') AS fresh, (SELECT count(*) FROM {_STATUS} WHERE status = 'stale') AS stale,
floor(count(*) FILTER (regexp_matches(coalesce(description, ''), '\\S')) * 100.0 / count(*) * 100 + 0.5) / 100 AS percent, 3 AS circular FROM {SYMBOLS}"""
)
def workspace_statistics(spark, sf):
    modules = table(spark, sf, "documents").select("source").distinct()
    return coverage.workspace_statistics(modules, inputs.symbols(spark, sf), freshness.check_freshness(*inputs.freshness_store(spark, sf)), 3)


@query(f"SELECT count(*) AS symbols, count(*) FILTER (NOT regexp_matches(coalesce(description, ''), '\\S')) AS undocumented, count(*) FILTER (NOT has_example) AS without_examples, CAST(count(*) + count(*) FILTER (NOT regexp_matches(coalesce(lang, ''), '\\S')) AS BIGINT) AS bare_params, CAST(floor(count(*) FILTER (regexp_matches(coalesce(description, ''), '\\S')) * 100.0 / count(*) + 0.5) AS BIGINT) AS percent FROM {SYMBOLS}")
def gaps_summary(spark, sf):
    return coverage.gaps_summary(inputs.symbols(spark, sf))


@query("SELECT floor(avg(p_size / 5.0) * 10 + 0.5) / 10 AS avg_overall, floor(avg(p_retailprice / 20.0) * 10 + 0.5) / 10 AS avg_maintainability, count(*) FILTER (p_size / 5.0 >= 5) AS complex_files FROM part")
def complexity_overview(spark, sf):
    return coverage.complexity_overview(table(spark, sf, "part").select((F.col("p_size") / 5).alias("overall"), (F.col("p_retailprice") / 20).alias("maintainability")))


@query(f"SELECT count(*) AS total, count(*) FILTER (status = 'fresh') AS fresh, count(*) FILTER (status = 'stale') AS stale, 0::BIGINT AS orphaned, 0::BIGINT AS missing, count(*) FILTER (status = 'fresh') / count(*) AS fresh_percent FROM {_STATUS}")
def fresh_share(spark, sf):
    return freshness.fresh_share(freshness.check_freshness(*inputs.freshness_store(spark, sf)))


@query("SELECT count(*) AS entries, CAST(sum(p_size) AS BIGINT) AS bytes FROM part")
def cache_statistics(spark, sf):
    return coverage.cache_statistics(table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("size")))


_CHECKED = "(SELECT p_partkey AS id, p_partkey % 3 <> 0 AS passed, CASE p_partkey % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS severity FROM part)"


def _checks(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("id"), (k % 3 != 0).alias("passed"), F.when(k % 4 == 0, "error").when(k % 4 == 1, "warning").otherwise("info").alias("severity"))


@query(f"SELECT id, 'failed' AS list FROM {_CHECKED} WHERE NOT passed UNION ALL SELECT id, 'warning' FROM {_CHECKED} WHERE severity = 'warning'")
def check_lists(spark, sf):
    c = _checks(spark, sf)
    return filters.failed_checks(c).select("id", F.lit("failed").alias("list")).unionByName(filters.checks_by_severity(c, "warning").select("id", F.lit("warning").alias("list")))


@query(f"SELECT count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, floor(count(*) FILTER (passed) * 100.0 / count(*) * 10 + 0.5) / 10 AS score, count(*) FILTER (NOT passed AND severity = 'error') = 0 AS is_complete, array_to_string(list_sort(list('c' || id) FILTER (NOT passed)), ',') AS failed_ids FROM {_CHECKED}")
def validation(spark, sf):
    return coverage.hardening_score(_checks(spark, sf).withColumn("id", F.concat(F.lit("c"), F.col("id").cast("string"))))


# --- traceability, incoherence ------------------------------------------------------------------

_CODE = "(SELECT CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'x' END || doc_id AS id FROM documents)"


@query(f"SELECT DISTINCT CAST(item_id * 3 AS VARCHAR) AS id, 'unimplemented-spec' AS kind, 'warning' AS severity FROM benchmark WHERE CAST(item_id * 3 AS VARCHAR) NOT IN (SELECT id FROM {_CODE}) UNION ALL SELECT name, 'undocumented-symbol', 'info' FROM {SYMBOLS} WHERE NOT regexp_matches(coalesce(description, ''), '\\S')")
def trace_gaps(spark, sf):
    code = table(spark, sf, "documents").select(inputs.code_id().alias("id"), F.lit("spec").alias("type"))
    docs = table(spark, sf, "benchmark").select((F.col("item_id") * 3).cast("string").alias("id"))
    return trace.trace_gaps(trace.cross_reference(code, docs), inputs.symbols(spark, sf).filter(lint.is_blank(F.col("description"))).select("name"))


_ISSUES = "(SELECT user_id AS path, CASE event_type WHEN 'click' THEN 'missing' WHEN 'view' THEN 'orphaned' ELSE 'mismatch' END AS type, least(1.0, value / 100) AS severity FROM events)"


def _issues(spark, sf):
    e = F.col("event_type")
    return table(spark, sf, "events").select(F.col("user_id").alias("path"), F.when(e == "click", "missing").when(e == "view", "orphaned").otherwise("mismatch").alias("type"), F.least(F.lit(1.0), F.col("value") / 100).alias("severity"))


@query(f"SELECT type, count(*) FILTER (severity > 0.7) AS high, count(*) FILTER (severity > 0.4 AND severity <= 0.7) AS medium, count(*) FILTER (severity <= 0.4) AS low, count(*) AS total FROM {_ISSUES} GROUP BY 1")
def project_summary(spark, sf):
    return incoherence.project_summary(_issues(spark, sf))


@query(f"WITH c AS (SELECT c_custkey % 50 AS path, count(*) AS code FROM customer WHERE c_custkey % 50 < 40 GROUP BY 1), d AS (SELECT s_suppkey % 50 AS path, count(*) AS docs FROM supplier GROUP BY 1), n AS (SELECT coalesce(c.path, d.path) AS path, coalesce(code, 0) AS code, coalesce(docs, 0) AS docs FROM c FULL OUTER JOIN d ON c.path = d.path), s AS (SELECT path, count(*) AS issues, sum(severity) AS severity FROM {_ISSUES} GROUP BY 1) SELECT n.path, coalesce(issues, 0) AS issues, CASE WHEN code = 0 THEN 1.0 ELSE round(greatest(0.0, least(1.0, 1 - 0.1 * coalesce(severity, 0) + 0.1 * docs / code)), 9) END::DOUBLE AS score FROM n LEFT JOIN s ON s.path = n.path")
def file_scores(spark, sf):
    code = table(spark, sf, "customer").filter("c_custkey % 50 < 40").select((F.col("c_custkey") % 50).alias("path"))
    docs = table(spark, sf, "supplier").select((F.col("s_suppkey") % 50).alias("path"))
    return incoherence.file_scores(code, docs, _issues(spark, sf)).withColumn("score", F.round("score", 9))


# --- graphs -------------------------------------------------------------------------------------

_FILE = "'src/n' || s_nationkey || '/s' || s_suppkey || '.ts'"


def _sources(spark, sf):
    s = table(spark, sf, "supplier")
    path = F.concat(F.lit("src/n"), F.col("s_nationkey").cast("string"), F.lit("/s"), F.col("s_suppkey").cast("string"), F.lit(".ts"))
    near, far = (F.col("s_suppkey") + 1).cast("string"), (F.col("s_suppkey") % 7).cast("string")
    code = F.concat(F.lit("import { a } from './s"), near, F.lit("'\nimport '../n3/s"), far, F.lit("'\nconst r = require('react')\nexport { x } from './s"), far, F.lit("'\nimport t from '/src/n1/s"), near, F.lit("'\n"))
    return s.select(path.alias("path"), code.alias("content"))


_SAID = """(SELECT s_nationkey AS n, s_suppkey AS k, 'src/n' || s_nationkey || '/s' || s_suppkey || '.ts' AS importer, 0 AS pos, './s' || (s_suppkey + 1) AS source, 'src/n' || s_nationkey || '/s' || (s_suppkey + 1) || '.ts' AS target FROM supplier
UNION ALL SELECT s_nationkey, s_suppkey, 'src/n' || s_nationkey || '/s' || s_suppkey || '.ts', 1, '/src/n1/s' || (s_suppkey + 1), '/src/n1/s' || (s_suppkey + 1) || '.ts' FROM supplier
UNION ALL SELECT s_nationkey, s_suppkey, 'src/n' || s_nationkey || '/s' || s_suppkey || '.ts', 2, '../n3/s' || s_suppkey % 7, 'src/n3/s' || s_suppkey % 7 || '.ts' FROM supplier
UNION ALL SELECT s_nationkey, s_suppkey, 'src/n' || s_nationkey || '/s' || s_suppkey || '.ts', 3, 'react', NULL FROM supplier
UNION ALL SELECT s_nationkey, s_suppkey, 'src/n' || s_nationkey || '/s' || s_suppkey || '.ts', 4, './s' || s_suppkey % 7, 'src/n' || s_nationkey || '/s' || s_suppkey % 7 || '.ts' FROM supplier)"""


@query(f"SELECT importer, pos, source FROM {_SAID}")
def imports(spark, sf):
    files = _sources(spark, sf)
    return files.select(F.col("path").alias("importer"), F.posexplode(graph.extract_imports(F.col("content"), F.lit("typescript"))).alias("pos", "source"))


@query(f"SELECT importer, pos, target FROM {_SAID} WHERE target IN (SELECT {_FILE} FROM supplier)")
def resolved_imports(spark, sf):
    return graph.resolve_imports(imports(spark, sf), _sources(spark, sf).select("path"))


@query(f"SELECT importer AS src, target AS dst, array_to_string(list_distinct(list(source ORDER BY pos)), ',') IS NOT NULL AS named, count(DISTINCT source) AS names FROM {_SAID} WHERE target IN (SELECT {_FILE} FROM supplier) GROUP BY 1, 2")
def module_edges(spark, sf):
    said = imports(spark, sf)
    edges = graph.resolve_imports(said, _sources(spark, sf).select("path")).join(said, ["importer", "pos"])
    merged = graph.merge_edges(edges.select(F.col("importer").alias("src"), F.col("target").alias("dst"), "pos", F.array("source").alias("imports")))
    return merged.select("src", "dst", F.col("imports").isNotNull().alias("named"), F.size(F.array_distinct("imports")).cast("long").alias("names"))


@query("SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN FALSE WHEN 3 THEN TRUE WHEN 4 THEN FALSE ELSE TRUE END AS entry FROM supplier")
def entry_points(spark, sf):
    k = F.col("s_suppkey") % 6
    path = F.when(k == 0, "src/index.ts").when(k == 1, "__main__.py").when(k == 2, "src/indexer.ts").when(k == 3, "a/b/main.rs").when(k == 4, "server.py").otherwise("x/cli.jsx")
    return table(spark, sf, "supplier").select("s_suppkey", graph.is_entry_point(path).alias("entry"))


@query(f"SELECT dst AS seed, src AS caller FROM {CALL_EDGES} JOIN supplier ON s_suppkey = dst")
def direct_callers(spark, sf):
    return graph.direct_callers(inputs.call_edges(spark, sf), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("seed")))


@query(f"WITH e AS (SELECT DISTINCT * FROM {CALL_EDGES}), d AS (SELECT dst AS seed, src AS caller FROM e JOIN supplier ON s_suppkey = dst), t1 AS (SELECT seed, e.src AS caller FROM d JOIN e ON e.dst = caller), t2 AS (SELECT seed, e.src AS caller FROM t1 JOIN e ON e.dst = caller), t3 AS (SELECT seed, e.src AS caller FROM t2 JOIN e ON e.dst = caller) SELECT * FROM (SELECT * FROM t1 UNION SELECT * FROM t2 UNION SELECT * FROM t3) WHERE caller <> seed AND (seed, caller) NOT IN (SELECT (seed, caller) FROM d)")
def transitive_callers(spark, sf):
    return graph.transitive_callers(inputs.call_edges(spark, sf), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("seed")))


@query(f"WITH i AS (SELECT dst AS id, count(*) AS n FROM {CALL_EDGES} GROUP BY 1), o AS (SELECT src AS id, count(*) AS n FROM {CALL_EDGES} GROUP BY 1) SELECT s_suppkey AS id, coalesce(i.n, 0) AS callers, coalesce(o.n, 0) AS callees, i.n IS NULL AS is_entry, o.n IS NULL AS is_leaf, CASE WHEN i.n IS NULL THEN 'stadium' WHEN o.n IS NULL THEN 'rounded' ELSE 'rect' END AS shape FROM supplier LEFT JOIN i ON i.id = s_suppkey LEFT JOIN o ON o.id = s_suppkey WHERE s_suppkey % 3 <> 2")
def call_graph(spark, sf):
    from ..operators.rendering import node_shape

    k = F.col("s_suppkey") % 3
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.when(k == 0, "function").when(k == 1, "method").otherwise("class").alias("kind"))
    return graph.call_graph(s, inputs.call_edges(spark, sf)).withColumn("shape", node_shape(F.col("is_entry"), F.col("is_leaf")))


_SCC = f"""WITH RECURSIVE e AS (SELECT DISTINCT * FROM {CUSTOMER_GRAPH} WHERE src <> dst), r AS (SELECT src AS a, dst AS b FROM e WHERE src <= 21 UNION SELECT a, dst FROM r JOIN e ON b = src),
c AS (SELECT x.a AS id, min(least(x.a, x.b)) AS cycle FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1 HAVING count(DISTINCT x.b) > 1)"""


@query(f"{_SCC} SELECT g.src, g.dst, coalesce(a.cycle = b.cycle, FALSE) AS in_cycle FROM {CUSTOMER_GRAPH} g LEFT JOIN c a ON a.id = g.src LEFT JOIN c b ON b.id = g.dst")
def circular_edges(spark, sf):
    g = inputs.customer_graph(spark, sf)
    return graph.mark_circular(g, graph.cycle_members(g)).select("src", "dst", "in_cycle")


@query(f"WITH e AS (SELECT src, dst, src AS pos FROM {CALL_EDGES}), x AS (SELECT src AS id, pos * 2 AS p FROM e UNION ALL SELECT dst, pos * 2 + 1 FROM e) SELECT id, min(p) AS first FROM x GROUP BY 1")
def participants(spark, sf):
    return graph.participants(inputs.call_edges(spark, sf).withColumn("pos", F.col("src")))


@query("WITH x AS (SELECT s_suppkey AS seed, CASE WHEN s_suppkey % 4 = 0 THEN 'critical' WHEN s_suppkey % 4 = 1 THEN 'high' ELSE 'low' END AS level, s_suppkey * 2 AS blast_radius FROM supplier) SELECT (SELECT count(*) FROM x WHERE level IN ('critical', 'high')) AS high_impact, CAST(sum(blast_radius) AS BIGINT) AS blast FROM x")
def high_impact(spark, sf):
    k = F.col("s_suppkey")
    x = table(spark, sf, "supplier").select(k.alias("seed"), F.when(k % 4 == 0, "critical").when(k % 4 == 1, "high").otherwise("low").alias("level"), (k * 2).alias("blast_radius"))
    told = graph.impact_summary(x)
    return told.select((F.col("critical") + F.col("high")).alias("high_impact"), F.col("total_blast").alias("blast"))


# --- exports --------------------------------------------------------------------------------------


def _modules(spark, sf):
    k = F.col("s_suppkey").cast("string")
    ts = F.concat(F.lit("export async function f"), k, F.lit("() {}\nexport const c"), k, F.lit(" = 1\nexport type T"), k, F.lit(" = string\n  export { a as b, d"), k, F.lit(" }\nexport default class K"), k, F.lit(" {}\nexport const c"), k, F.lit(" = 2\nlet hidden = 3"))
    rs = F.concat(F.lit("pub fn r"), k, F.lit("() {}\npub struct S;\nfn private() {}"))
    go = F.concat(F.lit("func G"), k, F.lit("() {}\nfunc small() {}"))
    py = F.concat(F.lit("__all__ = ['x"), k, F.lit("', \"y\"]\n"))
    n = F.col("s_suppkey") % 4
    return table(spark, sf, "supplier").select(k.alias("path"), F.when(n == 0, ts).when(n == 1, rs).when(n == 2, go).otherwise(py).alias("content"))


_EXPORTS = """(WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS k, s_suppkey % 4 AS n FROM supplier)
SELECT k AS path, pos, replace(name, '?', k) AS name, is_default, is_type_only FROM s JOIN (VALUES (0, 0, 'f?', FALSE, FALSE), (0, 1, 'c?', FALSE, FALSE), (0, 2, 'T?', FALSE, TRUE), (0, 3, 'b', FALSE, FALSE), (0, 4, 'd?', FALSE, FALSE), (0, 5, 'K?', TRUE, FALSE),
(1, 0, 'r?', FALSE, FALSE), (1, 1, 'S', FALSE, FALSE), (2, 0, 'G?', FALSE, FALSE), (3, 0, 'x?', FALSE, FALSE), (3, 1, 'y', FALSE, FALSE)) v(n, pos, name, is_default, is_type_only) ON v.n = s.n)"""


@query(f"SELECT * FROM {_EXPORTS}")
def module_exports(spark, sf):
    return extraction.extract_exports(_modules(spark, sf))


@query(f"SELECT path, name, 'default' AS list FROM {_EXPORTS} WHERE is_default UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'S', 'exported' FROM supplier WHERE s_suppkey % 4 = 1")
def export_lists(spark, sf):
    exports = extraction.extract_exports(_modules(spark, sf))
    asked = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), F.lit("S").alias("name"))
    own = extraction.is_exported(asked, exports).filter("exported").select("path", "name", F.lit("exported").alias("list"))
    return extraction.default_exports(exports).select("path", "name", F.lit("default").alias("list")).unionByName(own)


@query(f"SELECT path, name, min(s) AS source FROM (SELECT path, name, 0 AS s FROM {_EXPORTS} UNION ALL SELECT CAST(s_suppkey AS VARCHAR), CASE WHEN s_suppkey % 2 = 0 THEN 'b' ELSE 'z' END, 1 FROM supplier) GROUP BY 1, 2")
def export_union(spark, sf):
    exports = extraction.extract_exports(_modules(spark, sf)).select("path", "pos", "name", F.lit(0).alias("source"))
    more = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), F.lit(0).alias("pos"), F.when(F.col("s_suppkey") % 2 == 0, "b").otherwise("z").alias("name"), F.lit(1).alias("source"))
    return extraction.merge_exports(exports, more).select("path", "name", "source")


@query("SELECT count(*) AS files, count(*) FILTER (length(trim(html)) = 0 OR html IS NULL OR page_id % 9 = 0) AS failed FROM pages")
def schema_failures(spark, sf):
    return extraction.schema_failures(table(spark, sf, "pages").select(F.when(F.col("page_id") % 9 != 0, F.col("html")).alias("content")))


@query("WITH t AS (SELECT p_partkey AS id, p_type AS t FROM part) SELECT id, '' AS path, t || '[] | null' AS raw, 'union' AS kind FROM t UNION ALL SELECT id, '0', t || '[]', 'array' FROM t UNION ALL SELECT id, '0.0', t, 'reference' FROM t UNION ALL SELECT id, '1', 'null', 'primitive' FROM t")
def type_parts(spark, sf):
    raw = F.concat("p_type", F.lit("[] | null "))
    return extraction.parse_types(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), raw.alias("raw"))).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), "."))
