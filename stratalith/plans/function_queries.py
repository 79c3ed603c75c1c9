"""Registered queries over column functions: names, texts, numbers, types, vectors, comments, references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring, text, vectors
from ..operators import lint, metrics, trace
from .inputs import table
from .register import query

_EXT = "CASE p_partkey % 4 WHEN 0 THEN 'ts' WHEN 1 THEN 'py' WHEN 2 THEN 'rs' ELSE 'txt' END"


def _pick(key: str, *values):
    """The value for a key modulo their number."""
    out = None
    for i, v in enumerate(values[:-1]):
        hit = F.col(key) % len(values) == i
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return out.otherwise(values[-1])


def _text(*parts):
    """Texts and columns as one text; a plain string is a column's name behind a $, else itself."""
    return F.concat(*[F.col(p[1:]).cast("string") if p.startswith("$") else F.lit(p) for p in parts])


@query(
    f"""SELECT p_partkey, 'c:/src/' || p_type || '/m' || p_partkey || '.' || {_EXT} AS plain, '/a b/c+d/m' || p_partkey AS decoded,
CASE p_partkey % 4 WHEN 0 THEN 'src/a' || p_partkey || '.ts' WHEN 1 THEN 'index' WHEN 2 THEN 'src/b' || p_partkey ELSE 'b/c/d' || p_partkey END AS relative,
'mod' || p_partkey || '.x.' || p_name AS qualified, 'a.m' || p_partkey || '.ts:' || CASE WHEN p_partkey % 2 = 0 THEN p_brand || '#' ELSE '' END || p_name AS symbol,
CASE p_partkey % 4 WHEN 1 THEN 'python' WHEN 2 THEN 'rust' ELSE 'typescript' END AS language, CASE p_partkey % 4 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' WHEN 2 THEN 'rust' END AS known,
CASE p_partkey % 3 WHEN 0 THEN 'src/a/x' || p_partkey WHEN 1 THEN 'src/u' || p_partkey ELSE 'react' END AS imported, p_partkey % 5 = 0 OR p_partkey % 5 = 3 AS excluded FROM part"""
)
def path_names(spark, sf):
    ext = _pick("p_partkey", "ts", "py", "rs", "txt")
    raw = F.concat(F.lit("file:///c:\\src\\"), "p_type", F.lit("\\m"), F.col("p_partkey").cast("string"), F.lit("."), ext)
    rooted = _pick("p_partkey", _text("/w/p/src/a", "$p_partkey", ".ts"), F.lit("/w/p"), _text("/x/src/b", "$p_partkey"), _text("/a/b/c/d", "$p_partkey"))
    source = _pick("p_partkey", _text("./lib/../x", "$p_partkey"), _text("../u", "$p_partkey"), F.lit("react"))
    watched = _pick("p_partkey", _text("a/node_modules/", "$p_partkey"), _text("src/", "$p_partkey"), _text("distant/", "$p_partkey"), _text("dist/", "$p_partkey"), _text("b/", "$p_partkey"))
    parent = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand"))
    return table(spark, sf, "part").select(
        "p_partkey",
        text.normalize_module_path(raw).alias("plain"),
        text.decode_uri_path(_text("file:///a%20b/c+d/m", "$p_partkey")).alias("decoded"),
        text.module_path(rooted, "/w/p").alias("relative"),
        text.qualified_name(_text("q/mod", "$p_partkey", ".x.ts"), F.col("p_name")).alias("qualified"),
        text.symbol_id(_text("file:///a/m", "$p_partkey", ".ts"), F.col("p_name"), parent).alias("symbol"),
        text.language_of(raw).alias("language"),
        text.language_of(raw, None).alias("known"),
        text.resolve_import(source, F.lit("src/a/b.ts")).alias("imported"),
        text.is_watch_excluded(watched).alias("excluded"),
    )


_CUT = "CASE WHEN ceil(length(text) / 4.0) <= 20 THEN text WHEN regexp_matches(substr(text, 1, 81), '(?s)^.+[ \\t\\n\\r]') THEN regexp_extract(substr(text, 1, 81), '(?s)^(.*)[ \\t\\n\\r]', 1) ELSE substr(text, 1, 80) END"


@query(
    f"""SELECT doc_id, {_CUT} AS short, array_to_string(list_transform(list_slice(list_filter(string_split(text, chr(10)), lambda l: contains(lower(l), 'the') OR contains(lower(l), 'un')), 1, 3),
lambda l: trim(regexp_replace(regexp_replace(l, '(?i)(the)', '**\\1**', 'g'), '(?i)(un)', '**\\1**', 'g'), chr(9) || ' ' || chr(13))), '|') AS hits,
replace(replace(replace(text, '|', '\\|'), '<', '&lt;'), '>', '&gt;') AS escaped FROM documents"""
)
def text_shapes(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", text.truncate_to_tokens(t, 20).alias("short"), F.array_join(text.highlight(["the", "un"], t), "|").alias("hits"), text.escape_markdown(t).alias("escaped"))


@query(
    """WITH x AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS n, o_orderkey AS k, CAST(o_orderkey % 40 AS BIGINT) * 1073741824 AS ram, o_orderdate FROM orders), s AS (SELECT *, n * CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 1024 ELSE 1048576 END AS b FROM x),
u AS (SELECT *, CAST(least(floor(ln(b) / ln(1024.0)), 4) AS INTEGER) AS st FROM s WHERE b > 0 UNION ALL SELECT *, 0 FROM s WHERE b <= 0)
SELECT o_orderkey, CASE WHEN b <= 0 THEN '0 Bytes' ELSE regexp_replace(CAST(round(b / pow(1024.0, st), 1) AS VARCHAR), '\\.0$', '') || ' ' || ['Bytes', 'KB', 'MB', 'GB', 'TB'][st + 1] END AS size,
CASE WHEN b < 1024 THEN b || ' B/s' WHEN b < 1048576 THEN format('{:.1f}', round(b / 1024.0, 1)) || ' KB/s' ELSE format('{:.1f}', round(b / 1048576.0, 1)) || ' MB/s' END AS speed,
CAST(CASE WHEN k % 4 = 3 THEN 0 ELSE (1 + k % 9) * CASE k % 4 WHEN 0 THEN 1024.0 WHEN 1 THEN 1048576.0 ELSE 1073741824.0 END END AS DOUBLE) AS memory,
CAST(CASE WHEN ram >= 34359738368 THEN 21474836480 WHEN ram >= 17179869184 THEN 10737418240 WHEN ram >= 8589934592 THEN 5368709120 WHEN ram >= 4294967296 THEN 2147483648 ELSE 1073741824 END AS BIGINT) AS cache,
CASE WHEN a < 60 THEN 'just now' WHEN a < 3600 THEN (a // 60) || 'm ago' WHEN a < 86400 THEN (a // 3600) || 'h ago' WHEN a < 604800 THEN (a // 86400) || 'd ago' ELSE month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate) END AS ago FROM (SELECT *, CAST(epoch(TIMESTAMP '1998-08-01') - epoch(o_orderdate) AS BIGINT) AS a FROM u)"""
)
def number_formats(spark, sf):
    b = F.floor("o_totalprice") * _pick("o_orderkey", F.lit(1), F.lit(1024), F.lit(1048576))
    said = F.concat((1 + F.col("o_orderkey") % 9).cast("string"), _pick("o_orderkey", F.lit("KB"), F.lit(" MB"), F.lit("gb"), F.lit(" of it")))
    ram = (F.col("o_orderkey") % 40) * (1 << 30)
    return table(spark, sf, "orders").select("o_orderkey", text.format_bytes(b).alias("size"), text.format_speed(b).alias("speed"), text.parse_ram(said).alias("memory"), scoring.suggested_cache_limit(ram).cast("long").alias("cache"), text.format_relative_time(F.col("o_orderdate"), F.lit("1998-08-01").cast("timestamp")).alias("ago"))


@query(
    """WITH x AS (SELECT p_partkey, CAST(p_size AS BIGINT) * 20000000 AS s, CAST(p_retailprice AS BIGINT) * 1000000 AS a, p_partkey % 2 = 0 AS gpu, p_partkey % 3 = 0 AS mg, p_partkey % 5 <> 0 AS mc, p_partkey % 7 = 0 AS rec FROM part)
SELECT p_partkey, CAST(greatest(0, least(100, CASE WHEN NOT mc AND NOT gpu THEN 0 ELSE 100 - CASE WHEN s * 2.5 > a * 0.7 THEN 30 ELSE 0 END - CASE WHEN s * 2.5 > a THEN 50 ELSE 0 END + CASE WHEN mg AND gpu THEN 10 ELSE 0 END END + CASE WHEN s < 200000000 THEN 5 WHEN s < 500000000 THEN 3 ELSE 0 END + CASE WHEN rec THEN 5 ELSE 0 END)) AS INTEGER) AS score FROM x"""
)
def model_scores(spark, sf):
    k = F.col("p_partkey")
    score = scoring.model_score(F.col("p_size").cast("long") * 20_000_000, F.rint("p_retailprice").cast("long") * 1_000_000, k % 2 == 0, k % 3 == 0, k % 5 != 0, k % 7 == 0)
    return table(spark, sf, "part").select("p_partkey", score.cast("int").alias("score"))


# Types before and after a change, whether it widens or narrows, and its direction.
_CHANGES = [
    ("string", "string", False, False, None), ("string", "string | null", True, False, "contravariant"), ("string | null", "string", False, True, "covariant"), ("string", "number", False, False, "invariant"),
    ("a | b", "a | b | c", True, False, "contravariant"), ("a | b | c", "c | a", False, True, "covariant"), ("a | b", "c | d", False, False, "invariant"), ("number", "number | undefined", True, False, "contravariant"),
    (None, "string", False, None, "contravariant"), ("string", None, None, False, "covariant"),
]
_said = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"'{v}'"
_ROWS = ", ".join(f"({i}, {', '.join(_said(v) for v in row)})" for i, row in enumerate(_CHANGES))


@query(
    f"""SELECT p_partkey, before, after, widened, narrowed, direction, coalesce(direction IN ('covariant', 'invariant'), FALSE) AS breaking, coalesce(direction = 'contravariant', FALSE) AS safe_input, coalesce(direction = 'covariant', FALSE) AS safe_output
FROM part JOIN (VALUES {_ROWS}) t(i, before, after, widened, narrowed, direction) ON i = p_partkey % {len(_CHANGES)}"""
)
def type_changes(spark, sf):
    told = [F.lit(x[0]).cast("string") for x in _CHANGES], [F.lit(x[1]).cast("string") for x in _CHANGES]
    rows = table(spark, sf, "part").select("p_partkey", _pick("p_partkey", *told[0]).alias("before"), _pick("p_partkey", *told[1]).alias("after"))
    b, a = F.col("before"), F.col("after")
    rows = rows.withColumn("direction", scoring.type_direction(b, a)).withColumn("widened", scoring.type_widened(b, a)).withColumn("narrowed", scoring.type_narrowed(b, a))
    safe = lambda side: F.coalesce(scoring.type_safe(F.lit(side), F.col("direction")), F.lit(False)).alias(f"safe_{side}")
    return rows.select("p_partkey", "before", "after", "widened", "narrowed", "direction", scoring.type_breaking(F.col("direction")).alias("breaking"), safe("input"), safe("output"))


@query(
    """WITH d AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), x AS (SELECT vec_id, e, list_reverse(e) AS r, sqrt(list_dot_product(e, e)) AS n FROM d)
SELECT vec_id, round(list_distance(e, r), 6) AS far, round(e[1] / n, 6) AS first, round(e[-1] / n, 6) AS last, round(0.25 * list_dot_product(e, r) / (n * n) + 0.75 * e[2], 6) AS mixed FROM x"""
)
def vector_pairs(spark, sf):
    e, r = F.col("embedding"), F.reverse("embedding")
    unit = vectors.normalize(e)
    return table(spark, sf, "embeddings").select("vec_id", F.round(vectors.euclidean(e, r), 6).alias("far"), F.round(unit[0], 6).alias("first"), F.round(F.element_at(unit, -1), 6).alias("last"), F.round(vectors.hybrid_score(vectors.cosine(e, r), e[1].cast("double"), 0.25), 6).alias("mixed"))


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || chr(10) || p_type WHEN 1 THEN p_name WHEN 2 THEN p_name ELSE p_name END AS plain, p_partkey % 4 <> 2 AS is_doc,
'a ' || p_name || chr(10) || 'b  c' AS code, CASE WHEN p_partkey % 2 = 0 THEN 'x = 1 ' ELSE 'x = 1 # ' || p_name END AS stripped FROM part"""
)
def comment_texts(spark, sf):
    said = _pick("p_partkey", _text("/** ", "$p_name", "\n * ", "$p_type", "\n */"), _text("/// ", "$p_name"), _text("// ", "$p_name"), _text('"""', "$p_name", '"""'))
    code = _text("a ", "$p_name", "// gone\nb /* ", "$p_type", "\n */ c")
    hashes = text.strip_comments(_text("x = 1 # ", "$p_name"), F.when(F.col("p_partkey") % 2 == 0, "python").otherwise("go"))
    return table(spark, sf, "part").select("p_partkey", text.clean_comment(said).alias("plain"), text.is_doc_comment(said).alias("is_doc"), text.strip_comments(code).alias("code"), hashes.alias("stripped"))


@query(
    """SELECT p_partkey, '2 files (+3/-2)' AS summary, 'a' || p_partkey || '.ts,b' || p_partkey || '.ts' AS files, 'R-' || p_partkey || '+S' || p_size AS ids,
CASE WHEN p_partkey % 2 = 0 THEN upper(replace(p_name, ' ', '-')) || '-X' ELSE 'AUTO-' || p_size END AS auto, 'a: ' || p_type || ', b' AS params, 'a: 1; b: ' || p_type AS body FROM part"""
)
def code_texts(spark, sf):
    d = _text("diff --git a/a", "$p_partkey", ".ts b/a", "$p_partkey", ".ts\n--- a\n+++ b\n+one\ndiff --git a/b", "$p_partkey", ".ts b/b\n-two\n+three\n")
    files = F.array_join(F.transform(text.split_diff(d), lambda f: f["path"]), ",")
    auto = text.auto_spec_id(F.when(F.col("p_partkey") % 2 == 0, _text("$p_name", " x (y) z")).otherwise(""), F.col("p_size"))
    return table(spark, sf, "part").select(
        "p_partkey", text.summarize_diff(d).alias("summary"), files.alias("files"), F.array_join(text.parse_spec_ids(_text(" R-", "$p_partkey", ", ;S", "$p_size", ";")), "+").alias("ids"), auto.alias("auto"),
        text.normalize_params(_text("a :", "$p_type", " , b ,")).alias("params"), text.normalize_interface_body(_text("b: ", "$p_type", ";\n a: 1;// no\n")).alias("body"),
    )


@query("SELECT query, variant FROM (VALUES ('delete file', 'delete file'), ('delete file', 'remove file'), ('delete file', 'destroy file'), ('delete file', 'drop file'), ('delete file', 'clear file'), ('what is up', 'what is up')) t(query, variant)")
def query_variants(spark, sf):
    return spark.createDataFrame([(q, v) for q in ("delete file", "what is up") for v in text.expand_query(q)], "query string, variant string")


# --- references to specifications -----------------------------------------------------------


def _spec_files(spark, sf):
    code = _text("// REQ-", "$p_partkey", "\n * @spec A-", "$p_partkey", ", B", "$p_size", "\nTODO: AB-", "$p_partkey", " do\n/** @see ", "$p_name", " */\n//! Requirements: Q", "$p_partkey", "; R\nnothing")
    docs = _text("# REQ-", "$p_partkey", " head\ntext\n- [x] SPEC-S", "$p_size", ": done\n- [ ] write the ", "$p_type", " part\n2. REQ-", "$p_partkey", ": it")
    p = table(spark, sf, "part").withColumn("path", F.col("p_partkey").cast("string"))
    return p.select("path", code.alias("content")), p.select("path", docs.alias("content"))


@query(
    """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS path, p_partkey AS k, p_size AS z, p_name AS name FROM part)
SELECT path, 1 AS line, CAST(k AS VARCHAR) AS id, 'requirement' AS type FROM p UNION ALL SELECT path, 2, 'A-' || k, 'spec' FROM p UNION ALL SELECT path, 2, 'B' || z, 'spec' FROM p UNION ALL SELECT path, 3, 'AB-' || k, 'ticket' FROM p
UNION ALL SELECT path, 4, name, 'doc' FROM p UNION ALL SELECT path, 5, 'Q' || k, 'requirement' FROM p UNION ALL SELECT path, 5, 'R', 'requirement' FROM p"""
)
def spec_references(spark, sf):
    return trace.specs_in_code(_spec_files(spark, sf)[0])


@query(
    """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS path, p_partkey AS k, p_size AS z, p_type AS t FROM part)
SELECT path, 1 AS line, CAST(k AS VARCHAR) AS id, NULL AS description FROM p UNION ALL SELECT path, 3, 'S' || z, 'done' FROM p
UNION ALL SELECT path, 4, 'write', 'the ' || t || ' part' FROM p UNION ALL SELECT path, 5, CAST(k AS VARCHAR), 'it' FROM p"""
)
def spec_definitions(spark, sf):
    return trace.specs_in_docs(_spec_files(spark, sf)[1])


# --- flow -------------------------------------------------------------------------------------


def _flow_code():
    branchy = _text("if (a == ", "$p_size", ") { throw new RangeError('x') } else if (b) { return 1 } for (const i of x) { await go() } return Err(Bad", "$p_size", ")")
    return F.when(F.col("p_partkey") % 2 == 0, branchy).otherwise(_text("return ", "$p_size"))


@query(
    """SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 0 END AS INTEGER) AS branches, CAST(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS early_returns, CAST(CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END AS INTEGER) AS error_paths,
CAST(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS loops, CAST(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS async_boundaries, CASE WHEN p_partkey % 2 = 0 THEN 'simple' ELSE 'trivial' END AS level,
CASE WHEN p_partkey % 2 = 0 THEN 'RangeError,Bad' || p_size ELSE '' END AS errors, CASE WHEN p_partkey % 2 = 0 THEN 'if: a == ' || p_size || ',if: b' ELSE '' END AS conditions,
CASE WHEN p_partkey % 2 = 0 THEN 'Success path after handles 2 error cases and 1 early exit → returns ' || p_type ELSE 'Linear execution returning ' || p_type END AS happy FROM part"""
)
def flow_matrices(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", metrics.flow_matrix(_flow_code(), _text("go(a): ", "$p_type")).alias("m"))
    plain = lambda c: F.array_join(f"m.{c}", ",")
    return rows.select("p_partkey", "m.branches", "m.early_returns", "m.error_paths", "m.loops", "m.async_boundaries", "m.level", plain("error_types").alias("errors"), plain("conditionals").alias("conditions"), F.col("m.happy_path").alias("happy"))


@query(
    """WITH b AS (SELECT p_partkey AS k, p_size AS n, CASE WHEN p_size <= 1 THEN 0 WHEN p_size <= 3 THEN 1 WHEN p_size <= 7 THEN 2 WHEN p_size <= 15 THEN 3 ELSE 4 END AS l, CASE WHEN p_partkey % 3 = 0 THEN ['E'] ELSE [] END AS e FROM part WHERE p_partkey % 5 <> 0),
a AS (SELECT p_partkey AS k, p_size * 2 AS n, CASE WHEN p_size * 2 <= 1 THEN 0 WHEN p_size * 2 <= 3 THEN 1 WHEN p_size * 2 <= 7 THEN 2 WHEN p_size * 2 <= 15 THEN 3 ELSE 4 END AS l, CASE WHEN p_partkey % 4 = 0 THEN ['E', 'F'] ELSE [] END AS e FROM part WHERE p_partkey % 7 <> 0)
SELECT CAST(coalesce(a.k, b.k) AS VARCHAR) AS symbol, CAST(coalesce(a.n, 0) - coalesce(b.n, 0) AS INTEGER) AS branch_delta, CAST(len(coalesce(a.e, [])) - len(coalesce(b.e, [])) AS INTEGER) AS error_delta,
array_to_string(list_sort(list_filter(coalesce(a.e, []), lambda x: NOT list_contains(coalesce(b.e, []), x))), ',') AS new_errors, len(list_filter(coalesce(a.e, []), lambda x: NOT list_contains(coalesce(b.e, []), x))) > 0 OR coalesce(a.l - b.l >= 2, FALSE) AS breaking FROM b FULL OUTER JOIN a ON a.k = b.k"""
)
def flow_changes(spark, sf):
    from ..operators.diff import compare_flow

    p, none = table(spark, sf, "part"), F.array().cast("array<string>")

    def side(rows, n, errors):
        return rows.select(F.col("p_partkey").cast("string").alias("symbol"), n.cast("int").alias("branches"), F.size(errors).alias("error_paths"), scoring.complexity_level(n).alias("level"), errors.alias("errors"))

    k, n = F.col("p_partkey"), F.col("p_size")
    before = side(p.filter(k % 5 != 0), n, F.when(k % 3 == 0, F.array(F.lit("E"))).otherwise(none))
    after = side(p.filter(k % 7 != 0), n * 2, F.when(k % 4 == 0, F.array(F.lit("E"), F.lit("F"))).otherwise(none))
    return compare_flow(before, after).withColumn("new_errors", F.array_join(F.array_sort("new_errors"), ","))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'todo' WHEN 1 THEN 'lorem-ipsum' WHEN 2 THEN 'insert-here' END AS placeholder, CASE p_partkey % 4 WHEN 0 THEN 'throws-error' WHEN 1 THEN 'raises' WHEN 2 THEN 'empty-body' END AS stub, p_partkey % 3 = 1 AS outdated FROM part")
def rule_patterns(spark, sf):
    said = _pick("p_partkey", _text("$p_name", " ToDo later"), _text("Lorem  ipsum ", "$p_name"), _text("insert ", "$p_name", " here"), F.col("p_name"), F.lit(""))
    code = _pick("p_partkey", F.lit("f() { throw new Error('Not Implemented') }"), F.lit("raise NotImplementedError"), _text("f", "$p_partkey", "() { }"), F.lit("return 1;"))
    old = _pick("p_partkey", F.lit("Promise<string>"), F.lit("number"), F.lit("string"))
    return table(spark, sf, "part").select("p_partkey", lint.first_match(said, lint.PLACEHOLDERS).alias("placeholder"), lint.first_match(code, lint.STUBS).alias("stub"), lint.outdated_return(old, F.lit("promise < String >")).alias("outdated"))
