"""Registered queries of the engine and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..checkpoints import ensure_checkpoint_dir
from ..functions import scoring, text, vectors
from ..operators import coverage, diff, freshness, graph, lint, metrics, ranking, rendering, retrieval, sequences, trace
from ..sources.inverted_index import InvertedIndex
from ..sources.vector_index import VectorIndex
from . import inputs
from .register import QUERIES, SQL, count_sql, query  # noqa: F401, the driver's tables
from .inputs import CALL_EDGES, CURRENT, CUSTOMER_GRAPH, PARAMS_AFTER, PARAMS_BEFORE, PART_AFTER, PART_BEFORE, STORE, SYMBOLS, WHOLE_SYMBOLS, table

STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
TOKENS = f"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\w\\s]', ' ', 'g'), '\\s+'), lambda x: length(x) > 2 AND x NOT IN ({STOP}))"
ROUND2 = "floor(({}) * 100 + 0.5) / 100"


def _n(*names: str) -> list:
    return [F.col(c).cast("long").alias(c) for c in names]


# --- text functions --------------------------------------------------------------------


@query(f"SELECT doc_id, CAST(len({TOKENS}) AS BIGINT) AS n_terms, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS est_tokens, array_to_string(list_slice(string_split(text, chr(10)), 1, 2), chr(10)) AS head FROM documents")
def doc_token_stats(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.size(text.tokenize(t)).cast("long").alias("n_terms"), F.coalesce(text.estimate_tokens(t), F.lit(0)).cast("long").alias("est_tokens"), text.summarize(t, 2).alias("head"))


@query("SELECT doc_id, substr(sha256(CAST(doc_id AS VARCHAR) || ':' || source || ':file'), 1, 16) AS id, sha256(text) AS content, substr(md5(text), 1, 8) AS short FROM documents")
def content_hashes(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", text.hash_id(F.col("doc_id").cast("string"), F.col("source"), F.lit("file")).alias("id"), text.content_hash(F.col("text")).alias("content"), text.signature_hash(F.col("text")).alias("short"))


@query("SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, regexp_replace(regexp_replace(url, '[^a-zA-Z0-9]', '_', 'g'), '^_+|_+$', '', 'g') AS node, split_part(url, '/', -1) AS last, CASE WHEN length(url) > 20 THEN substr(url, 1, 17) || '...' ELSE url END AS short FROM pages")
def page_names(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", text.slugify(u).alias("slug"), text.sanitize_id(u).alias("node"), text.last_segment(u).alias("last"), text.truncate(u, 20).alias("short"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '//[^\\n]*', '', 'g'), '/\\*.*?\\*/', '', 'gs')) AS plain FROM pages")
def strip_page_comments(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.trim(text.strip_comments(F.col("html"))).alias("plain"))


@query("SELECT c_custkey, CASE WHEN c_acctbal <= 0 THEN 0.0 ELSE floor(c_acctbal * 100 + 0.5) / 100 END AS balance, CASE WHEN c_nationkey <= 1 THEN 'trivial' WHEN c_nationkey <= 3 THEN 'simple' WHEN c_nationkey <= 7 THEN 'moderate' WHEN c_nationkey <= 15 THEN 'complex' ELSE 'galaxy-brain' END AS level, CASE WHEN c_acctbal / 100 > 80 THEN 'great' WHEN c_acctbal / 100 >= 50 THEN 'good' ELSE 'marginal' END AS tier FROM customer")
def score_bands(spark, sf):
    b = F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", F.when(b <= 0, 0.0).otherwise(scoring.round2(b)).alias("balance"), scoring.complexity_level(F.col("c_nationkey")).alias("level"), scoring.recommendation_tier(b / 100).alias("tier"))


# --- vectors and retrieval ---------------------------------------------------------------

_COS = "list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))))"


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("type"))


_KNN = f"SELECT qid, id, rank, round(vec, 6) AS vec FROM (SELECT q.vec_id AS qid, e.vec_id AS id, {_COS} AS vec, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id) WHERE rank <= 10"


@query(_KNN)
def indexed_knn(spark, sf):
    """The same by the index on disk: cells near a query first, then those that angles cannot rule out."""
    v = _vectors(spark, sf)
    index = VectorIndex(spark, f"{ensure_checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex}")
    index.insert(v.filter("id % 3 <> 0").select("id", "vec"))
    index.insert(v.filter("id % 3 = 0").select("id", "vec"))
    hits = index.search(v.filter("id % 20 = 0").select(F.col("id").alias("qid"), "vec"), 10, exact=True, exclude_self=True).hits
    return hits.select("qid", "id", F.col("rank").cast("long").alias("rank"), F.round("vec", 6).alias("vec"))


@query(_KNN)
def knn_topk(spark, sf):
    v = _vectors(spark, sf)
    q = v.filter("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vec"))
    return retrieval.knn(q, v.select("id", "vec"), 10, exclude_self=True).select("qid", "id", F.col("rank").cast("long").alias("rank"), F.round("vec", 6).alias("vec"))


@query(f"SELECT qid, id, rank, round(vec, 6) AS vec FROM (SELECT q.vec_id AS qid, e.vec_id AS id, {_COS} AS vec, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id AND e.label = q.label) WHERE rank <= 5")
def similar_same_type(spark, sf):
    v = _vectors(spark, sf)
    out = retrieval.similar_of_type(v, v.filter("id % 20 = 0").select(F.col("id").alias("qid")), 5)
    return out.select("qid", "id", F.col("rank").cast("long").alias("rank"), F.round("vec", 6).alias("vec"))


@query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(list_reverse(embedding) AS DOUBLE[])), 6) AS twist FROM embeddings")
def vector_norms(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.round(vectors.norm(e), 6).alias("norm"), F.round(vectors.dot(e, F.reverse(e)), 6).alias("twist"))


_BM25 = f"""WITH d AS (SELECT doc_id AS id, {TOKENS} AS toks FROM documents), q AS (SELECT item_id AS qid, {TOKENS} AS toks FROM benchmark),
n AS (SELECT count(*) AS n, avg(len(toks)) AS al FROM d), p AS (SELECT id, len(toks) AS l, unnest(toks) AS term FROM d), tf AS (SELECT id, l, term, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), qt AS (SELECT qid, unnest(toks) AS term FROM q),
s AS (SELECT qid, id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * (l / al)))) AS s FROM qt JOIN tf USING (term) JOIN df USING (term), n GROUP BY 1, 2)"""


@query(f"{_BM25} SELECT qid, id, rank, round(s, 6) AS bm25 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, id) AS rank FROM s) WHERE rank <= 10")
def bm25_topk(spark, sf):
    scores = retrieval.bm25_scores(inputs.queries_from_benchmark(spark, sf), inputs.texts(spark, sf)).withColumn("bm25", F.round("bm25", 6))
    return retrieval.top_k(scores, 10, "qid", "bm25", "id").select("qid", "id", F.col("rank").cast("long").alias("rank"), "bm25")


@query(f"{_BM25} SELECT qid, id, rank, round(s, 6) AS bm25 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, id) AS rank FROM s) WHERE rank <= 10")
def indexed_bm25(spark, sf):
    """The same by postings on disk, of which only blocks that can matter are read; a third of the documents is written anew in between."""
    texts = inputs.texts(spark, sf)
    index = InvertedIndex(spark, f"{ensure_checkpoint_dir(spark)}/postings-{uuid.uuid4().hex}")
    index.update(texts.withColumn("text", F.when(F.col("id") % 3 == 0, F.concat(F.lit("older words "), F.reverse("text"))).otherwise(F.col("text"))))
    index.update(texts.filter("id % 3 = 0"))
    hits = index.search(inputs.queries_from_benchmark(spark, sf), 10, digits=6).hits
    return hits.select("qid", "id", F.col("rank").cast("long").alias("rank"), F.round("bm25", 6).alias("bm25"))


@query(f"WITH t AS (SELECT doc_id, {TOKENS} AS toks FROM documents), u AS (SELECT DISTINCT doc_id, unnest(toks) AS term FROM t) SELECT term, count(*) AS df FROM u GROUP BY 1")
def bm25_document_frequency(spark, sf):
    return retrieval.bm25_index(inputs.texts(spark, sf))[1]


_HYBRID = f"""WITH c AS (SELECT q.vec_id AS qid, e.vec_id AS id, {_COS} AS vec FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY vec DESC, id) AS r FROM c) WHERE r <= 30),
t AS (SELECT qid, id, vec, {TOKENS} AS toks FROM k JOIN documents ON doc_id = id), g AS (SELECT qid, count(*) AS n, avg(len(toks)) AS al FROM t GROUP BY 1),
p AS (SELECT qid, id, len(toks) AS l, unnest(toks) AS term FROM t), tf AS (SELECT qid, id, l, term, count(*) AS tf FROM p GROUP BY ALL), df AS (SELECT qid, term, count(*) AS df FROM tf GROUP BY 1, 2),
bt AS (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark), qt AS (SELECT vec_id AS qid, term FROM embeddings JOIN bt ON item_id = vec_id // 20 % (SELECT count(*) FROM benchmark) WHERE vec_id % 20 = 0),
s AS (SELECT qid, id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * (l / al)))) AS raw FROM qt JOIN tf USING (qid, term) JOIN df USING (qid, term) JOIN g USING (qid) GROUP BY 1, 2),
a AS (SELECT k.qid, k.id, k.vec, coalesce(raw, 0.0) AS raw FROM k LEFT JOIN s USING (qid, id))
SELECT qid, id, round(raw / greatest(max(raw) OVER (PARTITION BY qid), 1.0), 6) AS bm25, round(0.7 * vec + 0.3 * (raw / greatest(max(raw) OVER (PARTITION BY qid), 1.0)), 6) AS score FROM a"""


@query(_HYBRID)
def hybrid_search(spark, sf):
    v = _vectors(spark, sf).select("id", "vec")
    q = v.filter("id % 20 = 0").select(F.col("id").alias("qid"), "vec")
    texts = inputs.queries_from_benchmark(spark, sf).withColumnRenamed("qid", "item")
    number = texts.agg(F.count("*").alias("n"))  # each query has the text of an item, round after round
    asked = q.join(F.broadcast(number)).select("qid", F.floor(F.col("qid") / 20 % F.col("n")).alias("item")).join(texts, "item").select("qid", "text")
    out = retrieval.hybrid(retrieval.knn(q, v, 30, exclude_self=True).select("qid", "id", "vec"), asked, inputs.texts(spark, sf))
    return out.select("qid", "id", F.round("bm25", 6).alias("bm25"), F.round("score", 6).alias("score"))


@query("SELECT doc_id AS id, least(1.0::DOUBLE, 0.7::DOUBLE + CASE WHEN source IN ('src1', 'src2') THEN 0.1 ELSE 0 END + CASE WHEN source IN ('src2', 'src3') THEN 0.15 ELSE 0 END + CASE WHEN lang = 'fr' THEN 0.2 ELSE 0 END) AS score FROM documents")
def graph_boosted(spark, sf):
    hits = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("path"), F.col("lang").alias("symbol"), F.lit(0.7).alias("score"))
    names = lambda c, *xs: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    return retrieval.graph_boost(hits, names("path", "src1", "src2"), names("path", "src2", "src3"), names("symbol", "fr")).select("id", "score")


# --- coverage, freshness -----------------------------------------------------------------


def _good():
    return F.coalesce(F.col("quality") == 1, F.lit(False))


def _labelled(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")


@query(f"SELECT lang, count(*) AS total, count(*) FILTER (quality = 1) AS documented, {ROUND2.format('count(*) FILTER (quality = 1) * 100.0 / count(*)')} AS percent FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def coverage_by_group(spark, sf):
    return coverage.coverage(_labelled(spark, sf), "lang", _good())


@query(f"SELECT lang, CAST(grouping(lang) AS INTEGER) AS is_total, count(*) AS total, count(*) FILTER (quality = 1) AS documented, {ROUND2.format('count(*) FILTER (quality = 1) * 100.0 / count(*)')} AS percent FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)")
def coverage_rollup(spark, sf):
    return coverage.coverage_rollup(_labelled(spark, sf), "lang", _good())


@query(f"SELECT count(*) AS exports, count(*) FILTER (length(description) > 0) AS described, count(*) FILTER (has_example) AS with_examples, CAST(2 * count(*) AS BIGINT) AS params, CAST(count(*) FILTER (length(lang) > 0) AS BIGINT) AS described_params, count(*) FILTER (kind = 'function') AS callables, count(*) FILTER (kind = 'function' AND return_type IS NOT NULL) AS with_return FROM {SYMBOLS}")
def quality_measures(spark, sf):
    return coverage.quality_measures(inputs.symbols(spark, sf))


_HARDENING = f"""WITH m AS (SELECT count(*) FILTER (length(description) > 0) * 100.0 / count(*) AS a, count(*) FILTER (has_example) * 100.0 / count(*) AS b, count(*) FILTER (length(lang) > 0) * 100.0 / (2 * count(*)) AS c, count(*) FILTER (kind = 'function' AND return_type IS NOT NULL) * 100.0 / count(*) FILTER (kind = 'function') AS d FROM {SYMBOLS}),
f AS (SELECT bool_or(lower(name) LIKE '%readme%') AS r, bool_or(lower(name) LIKE '%changelog%' OR lower(name) LIKE '%history%') AS h, bool_or(lower(name) LIKE '%contributing%') AS k, bool_or(lower(name) LIKE '%license%' OR lower(name) LIKE '%licence%') AS l FROM (SELECT DISTINCT n_name AS name FROM nation UNION ALL SELECT 'README.md' UNION ALL SELECT 'LICENSE'))
SELECT 'has-readme' AS id, 'error' AS severity, r AS passed, CAST(r AS DOUBLE) AS value, 1.0::DOUBLE AS target FROM f UNION ALL SELECT 'has-changelog', 'warning', h, CAST(h AS DOUBLE), 1.0 FROM f UNION ALL SELECT 'has-contributing', 'info', k, CAST(k AS DOUBLE), 1.0 FROM f UNION ALL SELECT 'has-license', 'error', l, CAST(l AS DOUBLE), 1.0 FROM f
UNION ALL SELECT 'public-api-coverage', 'warning', a >= 80, floor(a * 10 + 0.5) / 10, 80 FROM m UNION ALL SELECT 'example-coverage', 'info', b >= 50, floor(b * 10 + 0.5) / 10, 50 FROM m UNION ALL SELECT 'parameter-coverage', 'warning', c >= 70, floor(c * 10 + 0.5) / 10, 70 FROM m UNION ALL SELECT 'return-type-coverage', 'info', d >= 60, floor(d * 10 + 0.5) / 10, 60 FROM m"""


@query(_HARDENING)
def hardening_checks(spark, sf):
    return coverage.hardening_checks(_files(spark, sf), coverage.quality_measures(inputs.symbols(spark, sf)))


def _files(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_name").alias("name")).distinct().union(spark.createDataFrame([("README.md",), ("LICENSE",)], "name string"))


@query(f"""WITH c AS ({_HARDENING}) SELECT count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, floor(count(*) FILTER (passed) * 100.0 / count(*) * 10 + 0.5) / 10 AS score, count(*) FILTER (NOT passed AND severity = 'error') = 0 AS is_complete, array_to_string(list_sort(list(id) FILTER (NOT passed)), ',') AS failed_ids FROM c""")
def hardening_score(spark, sf):
    return coverage.hardening_score(hardening_checks(spark, sf))


@query("SELECT CAST(label AS BIGINT) AS label, CAST(vec_id % 4 AS BIGINT) AS bucket, count(*) AS n, CAST(grouping(label) * 2 + grouping(vec_id % 4) AS INTEGER) AS level FROM embeddings GROUP BY GROUPING SETS ((), (label), (vec_id % 4), (label, vec_id % 4))")
def vector_stats(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("label"), (F.col("vec_id") % 4).alias("bucket"))
    return coverage.vector_stats(v, "label", "bucket")


@query("WITH f AS (SELECT regexp_replace(url, '/[^/]*$', '') AS directory, regexp_extract(url, '(\\.[^./]+)$', 1) AS ext FROM pages) SELECT directory, count(*) AS files, array_to_string(list_sort(list(DISTINCT ext)), ',') AS extensions FROM f GROUP BY 1 ORDER BY files DESC, directory LIMIT 30")
def structure_summary(spark, sf):
    return coverage.structure_summary(table(spark, sf, "pages").select(F.col("url").alias("path")))


@query("SELECT d.status, count(e.event_id) AS n FROM (VALUES ('click'), ('purchase'), ('view'), ('nothing')) d(status) LEFT JOIN events e ON e.event_type = d.status GROUP BY 1")
def status_counts(spark, sf):
    return coverage.status_counts(table(spark, sf, "events").withColumnRenamed("event_type", "status"), ["click", "purchase", "view", "nothing"])


@query(f"SELECT uri, CASE WHEN source_hash IS NULL THEN 'unknown' WHEN hash = source_hash THEN 'fresh' ELSE 'stale' END AS status FROM {CURRENT} LEFT JOIN {STORE} USING (uri)")
def freshness_status(spark, sf):
    return freshness.check_freshness(*inputs.freshness_store(spark, sf))


@query(f"SELECT uri FROM {CURRENT} JOIN {STORE} USING (uri) WHERE hash <> source_hash")
def stale_files(spark, sf):
    return freshness.stale_files(*inputs.freshness_store(spark, sf))


@query(f"SELECT uri FROM {STORE} WHERE uri NOT IN (SELECT uri FROM {CURRENT})")
def orphaned_docs(spark, sf):
    current, store = inputs.freshness_store(spark, sf)
    return freshness.orphaned_docs(store, current)


@query(f"WITH x AS (SELECT s.uri, hash, source_hash, c.uri AS here FROM {STORE} s LEFT JOIN {CURRENT} c USING (uri)) SELECT count(*) AS total, greatest(0, count(*) - count(*) FILTER (hash <> source_hash) - count(*) FILTER (hash IS NULL)) AS fresh, count(*) FILTER (hash <> source_hash) AS stale, count(*) FILTER (hash IS NULL) AS orphaned FROM x")
def freshness_statistics(spark, sf):
    return freshness.freshness_statistics(*inputs.freshness_store(spark, sf))


@query("SELECT event_id FROM events e LEFT JOIN (SELECT user_id, max(ts) AS seen FROM events WHERE event_type = 'click' GROUP BY 1) USING (user_id) WHERE seen IS NULL OR ts > seen")
def incremental_rows(spark, sf):
    e = table(spark, sf, "events")
    seen = e.filter("event_type = 'click'").groupBy(F.col("user_id").alias("path")).agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("mtime"))
    return freshness.needs_reindex(e.select(F.col("user_id").alias("path"), F.unix_micros(F.col("ts").cast("timestamp")).alias("mtime"), "event_id"), seen).select("event_id")


# --- diffs -------------------------------------------------------------------------------

_EXPORTS = f"""WITH b AS ({PART_BEFORE}), a AS ({PART_AFTER}), j AS (SELECT coalesce(b.path, a.path) AS path, coalesce(b.name, a.name) AS name, b.name IS NOT NULL AS bh, a.name IS NOT NULL AS ah, b.signature AS bs, a.signature AS as_, a.deprecated AS ad FROM b FULL OUTER JOIN a ON b.path = a.path AND b.name = a.name),
c AS (SELECT path, name, CASE WHEN NOT bh THEN 'added' WHEN NOT ah THEN 'removed' WHEN ad THEN 'deprecated' WHEN bs IS DISTINCT FROM as_ THEN 'modified' END AS change, bs IS DISTINCT FROM as_ AS sc FROM j),
e AS (SELECT path, name, change, change = 'removed' AS breaking, CASE WHEN change = 'removed' THEN 'major' WHEN change IN ('added', 'deprecated') THEN 'minor' ELSE 'patch' END AS semver, sc AND change = 'modified' AS signature_changed FROM c WHERE change IS NOT NULL),
m AS (SELECT coalesce(x.path, y.path) AS path, CASE WHEN x.path IS NULL THEN 'added' ELSE 'removed' END AS change, y.path IS NULL AS breaking FROM (SELECT DISTINCT path FROM b) x FULL OUTER JOIN (SELECT DISTINCT path FROM a) y ON x.path = y.path WHERE x.path IS NULL OR y.path IS NULL)"""


@query(f"{_EXPORTS} SELECT * FROM e")
def snapshot_diff(spark, sf):
    return diff.diff_exports(*inputs.part_versions(spark, sf))


@query(f"{_EXPORTS}, u AS (SELECT path, change, breaking FROM e UNION ALL SELECT * FROM m) SELECT count(*) AS total, count(*) FILTER (breaking) AS breaking, count(*) FILTER (change = 'added') AS additions, count(*) FILTER (change = 'removed') AS removals, count(*) FILTER (change = 'modified') AS modifications, count(*) FILTER (change = 'deprecated') AS deprecations, count(DISTINCT path) AS modules_affected FROM u")
def diff_summary(spark, sf):
    b, a = inputs.part_versions(spark, sf)
    return diff.diff_summary(diff.diff_exports(b, a), diff.diff_modules(b, a))


@query(f"{_EXPORTS} SELECT CASE WHEN (SELECT bool_or(breaking) FROM e) THEN 'major' WHEN (SELECT bool_or(semver = 'minor') FROM e) THEN 'minor' WHEN (SELECT count(*) FROM e) > 0 THEN 'patch' ELSE 'none' END AS bump")
def semver_bump(spark, sf):
    b, a = inputs.part_versions(spark, sf)
    return diff.semver_bump(diff.diff_exports(b, a), diff.diff_modules(b, a))


@query(f"{_EXPORTS} SELECT path, name, change, 1 AS priority, 'Breaking Changes' AS section FROM e WHERE breaking UNION ALL SELECT path, name, change, 2, 'Deprecations' FROM e WHERE change = 'deprecated' UNION ALL SELECT path, name, change, 3, 'New Features' FROM e WHERE change = 'added' AND NOT breaking UNION ALL SELECT path, name, change, 4, 'Changes' FROM e WHERE change = 'modified' AND NOT breaking")
def changelog_sections(spark, sf):
    return diff.changelog_sections(diff.diff_exports(*inputs.part_versions(spark, sf)))


_DIRECTION = "CASE WHEN b.type = a.type THEN NULL WHEN (NOT contains(b.type, 'null') AND contains(a.type, 'null')) OR (NOT contains(b.type, '|') AND contains(a.type, '|') AND contains(a.type, b.type)) THEN 'contravariant' WHEN (contains(b.type, 'null') AND NOT contains(a.type, 'null')) THEN 'covariant' ELSE 'invariant' END"


@query(
    f"""WITH b AS ({PARAMS_BEFORE}), a AS ({PARAMS_AFTER}), j AS (SELECT coalesce(b.symbol, a.symbol) AS symbol, coalesce(b.param, a.param) AS param, b.symbol IS NULL AS nb, a.symbol IS NULL AS na, CASE WHEN b.symbol IS NOT NULL AND a.symbol IS NOT NULL THEN {_DIRECTION} END AS direction, b.pos <> a.pos AS moved, b.optional <> a.optional AS opt, a.optional AS ao, a.default_value AS dv FROM b FULL OUTER JOIN a ON b.symbol = a.symbol AND b.param = a.param),
c AS (SELECT *, CASE WHEN na THEN 'removed' WHEN nb THEN 'added' WHEN moved THEN 'reordered' WHEN direction IS NOT NULL OR opt THEN 'modified' END AS change FROM j)
SELECT symbol, param, change, direction, CASE WHEN na THEN TRUE WHEN nb THEN NOT ao AND dv IS NULL ELSE moved OR (opt AND NOT ao) OR coalesce(direction IN ('covariant', 'invariant'), FALSE) END AS breaking FROM c WHERE change IS NOT NULL"""
)
def param_diff(spark, sf):
    return diff.diff_parameters(*inputs.parameters(spark, sf))


@query(f"WITH b AS ({PARAMS_BEFORE}), a AS ({PARAMS_AFTER}), j AS (SELECT b.symbol, {_DIRECTION} AS direction FROM b JOIN a ON b.symbol = a.symbol AND b.param = '2' AND a.param = '2') SELECT symbol, direction, direction = 'contravariant' AS breaking FROM j WHERE direction IS NOT NULL")
def return_diff(spark, sf):
    b, a = (x.filter("param = '2'").select("symbol", "type") for x in inputs.parameters(spark, sf))
    return diff.diff_returns(b, a)


@query("WITH b AS (SELECT 'function' AS category, CAST(s_suppkey AS VARCHAR) AS name, md5(s_name) AS hash FROM supplier WHERE s_suppkey % 9 <> 0 UNION ALL SELECT 'class', CAST(n_nationkey AS VARCHAR), md5(n_name) FROM nation), a AS (SELECT 'function' AS category, CAST(s_suppkey AS VARCHAR) AS name, md5(CASE WHEN s_suppkey % 4 = 0 THEN s_name || '!' ELSE s_name END) AS hash FROM supplier WHERE s_suppkey % 10 <> 0 UNION ALL SELECT 'class', CAST(n_nationkey AS VARCHAR), md5(CASE WHEN n_regionkey = 1 THEN 'x' ELSE n_name END) FROM nation) SELECT coalesce(b.category, a.category) AS category, coalesce(b.name, a.name) AS name, CASE WHEN b.name IS NULL THEN 'added' WHEN a.name IS NULL THEN 'removed' WHEN b.category = 'function' THEN 'signature-changed' ELSE 'modified' END AS change FROM b FULL OUTER JOIN a ON b.category = a.category AND b.name = a.name WHERE b.hash IS DISTINCT FROM a.hash")
def semantic_diff(spark, sf):
    return diff.semantic_diff(*_signature_versions(spark, sf))


def _signature_versions(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    row = lambda df, c, k, h: df.select(F.lit(c).alias("category"), F.col(k).cast("string").alias("name"), F.md5(h).alias("hash"))
    before = row(s.filter("s_suppkey % 9 <> 0"), "function", "s_suppkey", F.col("s_name")).unionByName(row(n, "class", "n_nationkey", F.col("n_name")))
    changed = F.when(F.col("s_suppkey") % 4 == 0, F.concat("s_name", F.lit("!"))).otherwise(F.col("s_name"))
    after = row(s.filter("s_suppkey % 10 <> 0"), "function", "s_suppkey", changed).unionByName(row(n, "class", "n_nationkey", F.when(F.col("n_regionkey") == 1, "x").otherwise(F.col("n_name"))))
    return before, after


# --- graphs ------------------------------------------------------------------------------


@query("SELECT l_suppkey AS src, l_partkey AS dst, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS imports FROM lineitem GROUP BY 1, 2")
def edge_merge(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.array("l_returnflag").alias("imports"))
    return graph.merge_edges(li).select("src", "dst", F.array_join(F.array_sort("imports"), ",").alias("imports"))


_REACH = f"""WITH e AS (SELECT DISTINCT * FROM {CALL_EDGES}), d AS (SELECT s_suppkey AS seed, src AS caller FROM supplier JOIN e ON dst = s_suppkey),
t1 AS (SELECT DISTINCT seed, e.src AS caller FROM d JOIN e ON e.dst = caller), t2 AS (SELECT DISTINCT seed, e.src AS caller FROM t1 JOIN e ON e.dst = caller), t3 AS (SELECT DISTINCT seed, e.src AS caller FROM t2 JOIN e ON e.dst = caller),
t AS (SELECT * FROM t1 UNION SELECT * FROM t2 UNION SELECT * FROM t3), f AS (SELECT * FROM t WHERE caller <> seed AND (seed, caller) NOT IN (SELECT (seed, caller) FROM d)),
x AS (SELECT seed, caller, 1 AS d FROM d UNION ALL SELECT seed, caller, 0 FROM f), g AS (SELECT seed, sum(d) AS direct, sum(1 - d) AS transitive, count(DISTINCT s_nationkey) AS modules, count(DISTINCT CASE WHEN s_acctbal > 0 THEN caller END) AS exports FROM x LEFT JOIN supplier ON s_suppkey = caller GROUP BY 1),
i AS (SELECT s_suppkey AS seed, CAST(coalesce(direct, 0) AS BIGINT) AS direct, CAST(coalesce(transitive, 0) AS BIGINT) AS transitive, coalesce(modules, 0) AS modules, coalesce(exports, 0) AS exports FROM supplier LEFT JOIN g ON seed = s_suppkey),
l AS (SELECT *, direct + transitive AS blast_radius, CASE WHEN exports >= 5 THEN 'critical' WHEN direct >= 10 OR exports >= 2 THEN 'high' WHEN direct >= 3 OR transitive >= 10 THEN 'medium' WHEN direct >= 1 THEN 'low' ELSE 'none' END AS level FROM i)"""


def _impact(spark, sf):
    s = table(spark, sf, "supplier")
    nodes = s.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("module"), (F.col("s_acctbal") > 0).alias("exported"))
    return graph.analyze_impact(inputs.call_edges(spark, sf), s.select(F.col("s_suppkey").alias("seed")), nodes)


@query(f"{_REACH} SELECT * FROM l")
def impact_levels(spark, sf):
    return _impact(spark, sf)


@query(f"{_REACH} SELECT count(*) FILTER (level = 'critical') AS critical, count(*) FILTER (level = 'high') AS high, count(*) FILTER (level = 'medium') AS medium, count(*) FILTER (level = 'low') AS low, count(*) FILTER (level = 'none') AS none, CAST(sum(blast_radius) AS BIGINT) AS total_blast, (SELECT seed FROM l WHERE blast_radius > 0 ORDER BY blast_radius DESC, seed LIMIT 1) AS widest FROM l")
def impact_summary(spark, sf):
    return graph.impact_summary(_impact(spark, sf))


@query(f"WITH RECURSIVE e AS (SELECT DISTINCT * FROM {CUSTOMER_GRAPH}), r AS (SELECT src AS seed, dst AS id, 1 AS level FROM e UNION SELECT seed, dst, level + 1 FROM r JOIN e ON id = src WHERE level < 40) SELECT seed, id, min(level) AS level FROM r GROUP BY 1, 2")
def transitive_closure(spark, sf):
    seeds = table(spark, sf, "customer").select(F.col("c_custkey").alias("seed"))
    return graph.transitive_closure(inputs.customer_graph(spark, sf), seeds)


@query(f"WITH RECURSIVE e AS (SELECT DISTINCT * FROM {CUSTOMER_GRAPH}), r AS (SELECT src AS start, dst AS id, 1 AS level FROM e UNION SELECT start, dst, level + 1 FROM r JOIN e ON id = src WHERE level < 40) SELECT start, 1::BIGINT AS goal, CAST(min(level) AS BIGINT) AS hops FROM r WHERE id = 1 AND start <> 1 GROUP BY 1 UNION ALL SELECT 1, 1, 0")
def shortest_path(spark, sf):
    pairs = table(spark, sf, "customer").select(F.col("c_custkey").alias("start"), F.lit(1).cast("long").alias("goal"))
    return graph.shortest_paths(inputs.customer_graph(spark, sf), pairs).select("start", "goal", (F.size("path") - 1).cast("long").alias("hops"))


@query(f"WITH RECURSIVE e AS (SELECT DISTINCT * FROM {CUSTOMER_GRAPH} WHERE src <> dst), n AS (SELECT src FROM e WHERE src <= 21), r AS (SELECT src AS a, dst AS b FROM e WHERE src <= 21 UNION SELECT a, dst FROM r JOIN e ON b = src) SELECT x.a AS id, min(least(x.a, x.b)) AS cycle FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1 HAVING count(DISTINCT x.b) > 1")
def scc_members(spark, sf):
    return graph.cycle_members(inputs.customer_graph(spark, sf))


@query(f"WITH RECURSIVE e AS (SELECT DISTINCT * FROM {CALL_EDGES}), n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), r AS (SELECT id, 0 AS level FROM n WHERE id NOT IN (SELECT dst FROM e) UNION SELECT dst, level + 1 FROM r JOIN e ON id = src) SELECT id, max(level) AS level FROM r GROUP BY 1")
def topo_levels(spark, sf):
    e = inputs.call_edges(spark, sf)
    return graph.topological_levels(e.select(F.col("src").alias("id")).union(e.select("dst")), e)


@query("WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey <> l_partkey), f AS (SELECT p_partkey AS path, p_size > 45 AS is_entry, p_partkey % 2 = 0 AS has_api, p_size AS c, p_retailprice AS lines FROM part), i AS (SELECT dst AS path, count(*) AS n FROM e GROUP BY 1), o AS (SELECT src AS path, count(*) AS n FROM e GROUP BY 1), x AS (SELECT DISTINCT dst AS path FROM e JOIN f ON src = f.path WHERE is_entry) SELECT f.path, coalesce(i.n, 0) AS dependents, coalesce(o.n, 0) AS dependencies, CAST(greatest(0.0, least(10.0, least(coalesce(i.n, 0) * 1.5, 4) + CASE WHEN is_entry THEN 2 ELSE 0 END + CASE WHEN has_api THEN 1 ELSE 0 END + CASE WHEN x.path IS NOT NULL THEN 0.5 ELSE 0 END + CASE WHEN c > 20 THEN 1.5 WHEN c > 10 THEN 1 WHEN c > 5 THEN 0.5 ELSE 0 END + CASE WHEN lines > 500 THEN 1 WHEN lines > 200 THEN 0.5 ELSE 0 END - CASE WHEN coalesce(i.n, 0) = 0 AND NOT is_entry THEN 0.5 ELSE 0 END)) AS DOUBLE) AS score FROM f LEFT JOIN i ON i.path = f.path LEFT JOIN o ON o.path = f.path LEFT JOIN x ON x.path = f.path")
def importance_scores(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).filter("src <> dst").distinct()
    files = table(spark, sf, "part").select(F.col("p_partkey").alias("path"), (F.col("p_size") > 45).alias("is_entry"), (F.col("p_partkey") % 2 == 0).alias("has_api"), F.col("p_size").alias("cyclomatic"), F.col("p_retailprice").alias("lines"))
    return graph.file_importance(files, e)


# --- sequences ---------------------------------------------------------------------------


@query("SELECT conv_id, turn, CAST(row_number() OVER w - 1 AS INTEGER) AS index, count(*) OVER (PARTITION BY conv_id) AS total, lag(turn) OVER w AS prev, lead(turn) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def link_chunks(spark, sf):
    return sequences.link_chunks(table(spark, sf, "conversations"), "conv_id", "turn", "turn").select("conv_id", "turn", "index", "total", "prev", "next")


@query("WITH x AS (SELECT p_brand AS cache, p_partkey AS key, p_size AS size, p_retailprice AS last_used, sum(p_size) OVER (PARTITION BY p_brand) AS t, coalesce(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM part) SELECT cache, key FROM x WHERE t - b > 500")
def cache_prune(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("cache"), F.col("p_partkey").alias("key"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("last_used"))
    return sequences.evictions(p, F.lit(500)).select("cache", "key")


@query("SELECT CAST(s.day AS DATE) AS day, count(e.event_id) AS n FROM (SELECT unnest(generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY)) AS day) s LEFT JOIN events e ON CAST(e.ts AS DATE) = s.day GROUP BY 1")
def date_spine(spark, sf):
    daily = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return sequences.date_spine(daily, "2023-12-25", "2024-02-05")


@query("WITH x AS (SELECT user_id AS key, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 3600000000 THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT key, ts, sum(f) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS r FROM x) SELECT key, min(ts) AS started, max(ts) + INTERVAL 3600 SECOND AS emitted, count(*) AS n FROM y GROUP BY key, r")
def debounce_batch(spark, sf):
    return sequences.debounce(table(spark, sf, "events").select(F.col("user_id").alias("key"), "ts"), 3600)


@query("WITH x AS (SELECT ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) > 600000000 THEN 1 ELSE 0 END AS f FROM events), y AS (SELECT ts, sum(f) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS r FROM x) SELECT 0::BIGINT AS key, min(ts) AS started, max(ts) + INTERVAL 600 SECOND AS emitted, count(*) AS n FROM y GROUP BY r")
def global_debounce(spark, sf):
    return sequences.debounce(table(spark, sf, "events").select(F.lit(0).cast("long").alias("key"), "ts"), 600)


@query("WITH v AS (SELECT user_id AS id, ts, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) - value AS d FROM events) SELECT id, round(sum(CASE WHEN d > 0.3 THEN d ELSE 0 END), 4) AS drift, round(least(1.0, sum(CASE WHEN d > 0.3 THEN d ELSE 0 END) / count(*)), 4) AS severity FROM v GROUP BY 1 HAVING count(*) > 1 AND sum(CASE WHEN d > 0.3 THEN d ELSE 0 END) > 0")
def drift(spark, sf):
    from ..operators.incoherence import detect_drift

    v = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("pos"), F.col("value").alias("sim"))
    return detect_drift(v).select("id", F.round("drift", 4).alias("drift"), F.round("severity", 4).alias("severity"))


@query(
    """WITH RECURSIVE c AS (SELECT conv_id AS module, turn AS pos, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
g AS (SELECT module, pos, tokens, r, tokens AS used, 0 AS chunk FROM c WHERE r = 1 UNION ALL SELECT c.module, c.pos, c.tokens, c.r, CASE WHEN used > 0 AND used + c.tokens > 200 THEN c.tokens ELSE used + c.tokens END, CASE WHEN used > 0 AND used + c.tokens > 200 THEN chunk + 1 ELSE chunk END FROM g JOIN c ON c.module = g.module AND c.r = g.r + 1)
SELECT module, pos, tokens, chunk FROM g"""
)
def greedy_chunks(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("module"), F.col("turn").alias("pos"), text.estimate_tokens(F.col("text")).alias("tokens"))
    return sequences.greedy_chunks(c, 400)


_TOKENS_OF = "CAST(ceil(length({}) / 4.0) AS BIGINT)"


@query(
    f"""WITH RECURSIVE d AS (SELECT CAST(doc_id AS VARCHAR) AS path, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
w AS (SELECT path, lines, 1 AS i, [lines[1]] AS held, {_TOKENS_OF.format("lines[1]")} AS used, 0 AS start, CAST(NULL AS INTEGER) AS line_start, CAST(NULL AS INTEGER) AS line_end, CAST(NULL AS VARCHAR) AS content FROM d
UNION ALL SELECT path, lines, i + 1, CASE WHEN cut THEN list_append(carried, lines[i + 1]) ELSE list_append(held, lines[i + 1]) END, n + CASE WHEN cut THEN {_TOKENS_OF.format("array_to_string(carried, chr(10))")} ELSE used END, CASE WHEN cut THEN i - len(carried) ELSE start END,
CAST(CASE WHEN cut THEN start END AS INTEGER), CAST(CASE WHEN cut THEN i - 1 END AS INTEGER), CASE WHEN cut THEN array_to_string(held, chr(10)) END FROM (SELECT *, {_TOKENS_OF.format("lines[i + 1]")} AS n, used + {_TOKENS_OF.format("lines[i + 1]")} > 512 AS cut, list_slice(held, -13, len(held)) AS carried FROM w WHERE i < len(lines)))
SELECT path, line_start, line_end, content FROM w WHERE content IS NOT NULL UNION ALL SELECT path, CAST(start AS INTEGER), CAST(len(lines) - 1 AS INTEGER), array_to_string(held, chr(10)) FROM w WHERE i = len(lines) AND used >= 50"""
)
def chunk_windows(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return sequences.text_windows(d)


_HEADER = "regexp_matches(text, '^([A-Z][a-z]{1,3}) ')"


@query(
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
c AS (SELECT doc_id, text, line, sum(CASE WHEN {_HEADER} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS section FROM l),
s AS (SELECT doc_id, section, min(line) AS line_start, max(line) AS line_end, string_agg(text, chr(10) ORDER BY line) AS content, CASE WHEN section > 0 THEN regexp_extract(min_by(text, line), '^([A-Z][a-z]{{1,3}}) ', 1) ELSE '' END AS title FROM c GROUP BY 1, 2),
x AS (SELECT *, line_end = max(line_end) OVER (PARTITION BY doc_id) AS last FROM s)
SELECT CAST(doc_id AS VARCHAR) AS path, substr(sha256(doc_id || ':section:' || CASE WHEN title <> '' THEN title WHEN last THEN 'end' ELSE 'intro' END), 1, 16) AS id, CASE WHEN title <> '' THEN title WHEN last THEN 'Content' ELSE 'Introduction' END AS symbol, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end, content, 'symbol' AS level FROM x WHERE ceil(length(content) / 4.0) >= 50
UNION ALL SELECT CAST(doc_id AS VARCHAR), substr(sha256(doc_id || ':file'), 1, 16), NULL, NULL, NULL, array_to_string(list_slice(string_split(text, chr(10)), 1, 20), chr(10)), 'file' FROM documents"""
)
def chunk_sections(spark, sf):
    # no line starts with '#': lines of a capital and a short word open a section
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return sequences.sections(d, header=r"^([A-Z][a-z]{1,3}) ")


# --- code metrics ------------------------------------------------------------------------


def _pages(spark, sf):
    return table(spark, sf, "pages").select(F.col("page_id").alias("path"), F.col("html").alias("content"))


_PLAIN = "regexp_replace(regexp_replace(html, '//[^\\n]*', '', 'g'), '/\\*.*?\\*/', '', 'gs')"


@query(f"SELECT page_id AS path, CAST(1 + {count_sql(_PLAIN, [*metrics.DECISIONS, *metrics.LOGICAL])} AS INTEGER) AS cyclomatic, CAST(1 + {count_sql('html', metrics.ESTIMATE)} AS INTEGER) AS estimated FROM pages")
def cyclomatic(spark, sf):
    c = F.col("content")
    return _pages(spark, sf).select("path", metrics.cyclomatic(c).alias("cyclomatic"), metrics.estimated_cyclomatic(c).alias("estimated"))


@query(f"SELECT page_id AS path, CAST({count_sql('html', metrics.FLOW['loops'])} AS INTEGER) AS loops, CAST({count_sql('html', metrics.FLOW['errors'])} AS INTEGER) AS error_paths, CAST(greatest(0, len(regexp_extract_all(html, '\\breturn\\b')) - 1) AS INTEGER) AS early_returns FROM pages")
def flow_counts(spark, sf):
    rows = _pages(spark, sf).select("path", metrics.flow_matrix(F.col("content"), F.lit("f(): void")).alias("m"))
    return rows.select("path", "m.loops", "m.error_paths", "m.early_returns")


@query("SELECT page_id AS path, len(string_split(html, chr(10))) AS lines FROM pages")
def line_counts(spark, sf):
    return _pages(spark, sf).select("path", F.size(F.split("content", "\n")).cast("long").alias("lines"))


@query("WITH d AS (SELECT o_orderkey AS path, o_orderdate AS doc_ts FROM orders), c AS (SELECT l_orderkey AS path, l_shipdate AS ts, count(*) AS n, min(l_linenumber) AS k FROM lineitem GROUP BY 1, 2) SELECT d.path, max_by(k, ts) AS content FROM d LEFT JOIN c ON c.path = d.path AND ts <= doc_ts + INTERVAL 60 DAY GROUP BY 1")
def as_of_commit(spark, sf):
    docs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), (F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("doc_ts"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_shipdate").alias("ts"), "l_linenumber")
    lines = lines.repartition(max(1, -(-lines.count() // 500_000)), "path")  # what a task gathers doesn't grow
    commits = lines.groupBy("path", "ts").agg(F.min("l_linenumber").alias("content"))
    return metrics.as_of_content(docs, commits).select("path", "content")


_NOW = "TIMESTAMP '1998-09-01'"


@query(
    f"""WITH c AS (SELECT l_orderkey AS path, max(l_shipdate) AS ts, count(*) FILTER (l_shipdate >= {_NOW} - INTERVAL 30 DAY) AS recent, sum(CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END) AS p FROM lineitem GROUP BY 1),
x AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS doc_ts, coalesce(p, 0) AS p, floor((epoch_us({_NOW}) - epoch_us(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END)) / 86400000000) AS age, floor((epoch_us({_NOW}) - epoch_us(ts)) / 86400000000) AS code, recent FROM orders LEFT JOIN c ON path = o_orderkey),
s AS (SELECT path, doc_ts, p + CASE WHEN code < age AND age > 90 THEN 2 WHEN code < age AND age > 30 THEN 1 ELSE 0 END + CASE WHEN recent > 20 THEN 2 WHEN recent > 10 THEN 1 ELSE 0 END AS s FROM x)
SELECT path, CAST(CASE WHEN doc_ts IS NULL THEN 8 ELSE least(10, s) END AS INTEGER) AS score, CASE WHEN doc_ts IS NULL THEN 'undocumented' WHEN s >= 6 THEN 'very-stale' WHEN s >= 3 THEN 'stale' ELSE 'fresh' END AS status FROM s"""
)
def staleness_score(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("path", F.col("l_orderkey").cast("string"))
    files = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("doc_ts"))
    changes = li.select("path", F.when(F.col("l_returnflag") == "R", "removed").otherwise("added").alias("change"))
    now = F.lit("1998-09-01").cast("timestamp")
    commits = metrics.churn(li.select("path", F.col("l_shipdate").alias("ts"), F.col("l_returnflag").alias("author")), now).select("path", F.col("last_modified").alias("ts"), "recent")
    return metrics.staleness(files, changes, commits, now)


# --- lint, traceability, ranking, rendering ------------------------------------------------


@query(f"SELECT path, name, rule, severity FROM (SELECT path, name, 'missing-description' AS rule, 'error' AS severity FROM {SYMBOLS} WHERE trim(coalesce(description, '')) = '' UNION ALL SELECT path, name, 'missing-param-description', 'warning' FROM {SYMBOLS} UNION ALL SELECT path, name, 'missing-return-description', 'warning' FROM {SYMBOLS} WHERE kind = 'function' AND return_type = 'string' AND NOT contains(lower(description), '@return') AND NOT contains(lower(description), 'returns ') UNION ALL SELECT path, name, 'missing-example', 'info' FROM {SYMBOLS} WHERE modifier = 'export' AND kind IN ('function', 'class', 'interface') AND NOT has_example AND NOT contains(lower(description), '@example') UNION ALL SELECT path, name, 'stub', 'warning' FROM {SYMBOLS} WHERE kind = 'function' AND signature = 'return null;' UNION ALL SELECT path, name, 'generic-parameter', 'info' FROM {SYMBOLS} UNION ALL SELECT path, name, 'broken-reference', 'error' FROM {SYMBOLS} WHERE CAST(doc_id * 2 AS VARCHAR) NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents))")
def lint_rules(spark, sf):
    return lint.lint(inputs.symbols(spark, sf), {"placeholder": "off"}).select("path", "name", "rule", "severity")


_SAID = "lower(coalesce(description, ''))"
_HIT = "CASE " + " ".join(f"WHEN regexp_matches(description, '{p}') THEN '{name}'" for name, p in lint.PLACEHOLDERS) + " END"


@query(
    f"""WITH s AS (SELECT * FROM {WHOLE_SYMBOLS}), d AS (SELECT CAST(doc_id AS VARCHAR) AS name FROM documents)
SELECT path, name, 'missing-description' AS rule, 'error' AS severity, NULL AS hit FROM s WHERE NOT regexp_matches(coalesce(description, ''), '\\S')
UNION ALL SELECT path, name, 'missing-param-description', 'warning', NULL FROM s
UNION ALL SELECT path, name, 'missing-param-description', 'warning', NULL FROM s WHERE NOT regexp_matches(coalesce(lang, ''), '\\S')
UNION ALL SELECT path, name, 'missing-return-description', 'warning', NULL FROM s WHERE kind = 'function' AND return_type = 'string' AND NOT contains({_SAID}, '@return') AND NOT contains({_SAID}, 'returns ')
UNION ALL SELECT path, name, 'missing-example', 'info', NULL FROM s WHERE modifier = 'export' AND kind IN ('function', 'class', 'interface') AND NOT has_example AND NOT contains({_SAID}, '@example')
UNION ALL SELECT path, name, 'placeholder', 'warning', {_HIT} FROM s WHERE {_HIT} IS NOT NULL
UNION ALL SELECT path, name, 'stub', 'warning', NULL FROM s WHERE kind = 'function' AND signature = 'return null;'
UNION ALL SELECT path, name, 'generic-parameter', 'info', NULL FROM s
UNION ALL SELECT path, name, 'broken-reference', 'error', NULL FROM s WHERE CAST(doc_id * 2 AS VARCHAR) NOT IN (SELECT name FROM d)"""
)
def lint_documents(spark, sf):
    # all default rules over whole texts; the placeholder that was found stands behind its message's colon
    hit = F.when(F.col("rule") == "placeholder", F.regexp_extract("message", r": ([a-z-]+)$", 1))
    return lint.lint(inputs.symbols(spark, sf, whole=True)).select("path", "name", "rule", "severity", hit.alias("hit"))


@query("SELECT CAST(conv_id AS VARCHAR) AS path, CAST(turn AS VARCHAR) AS name, CASE WHEN regexp_matches(text, '(?i)\\bTODO\\b') THEN 'todo' WHEN regexp_matches(text, '(?i)\\bTBD\\b') THEN 'tbd' END AS hit, length(text) > 0 AS any_text FROM conversations")
def placeholder_rules(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("path"), F.col("turn").cast("string").alias("name"), lint.first_match(F.col("text"), [p for p in lint.PLACEHOLDERS if p[0] in ("todo", "tbd")]).alias("hit"), (F.length("text") > 0).alias("any_text"))


@query("WITH code AS (SELECT CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'x' END || doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN 'ticket' ELSE 'spec' END AS type FROM documents), docs AS (SELECT CAST(item_id * 3 AS VARCHAR) AS id FROM benchmark) SELECT DISTINCT id, 'implemented' AS state FROM code WHERE id IN (SELECT id FROM docs) OR type = 'ticket' UNION ALL SELECT DISTINCT id, 'unimplemented' FROM docs WHERE id NOT IN (SELECT id FROM code)")
def trace_states(spark, sf):
    return trace.cross_reference(*_specs(spark, sf))


def _specs(spark, sf):
    code = table(spark, sf, "documents").select(inputs.code_id().alias("id"), F.when(F.col("doc_id") % 9 == 0, "ticket").otherwise("spec").alias("type"))
    return code, table(spark, sf, "benchmark").select((F.col("item_id") * 3).cast("string").alias("id"))


@query("WITH code AS (SELECT CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'x' END || doc_id AS id, doc_id % 9 = 0 AS t FROM documents), docs AS (SELECT CAST(item_id * 3 AS VARCHAR) AS id FROM benchmark), i AS (SELECT count(DISTINCT id) AS implemented FROM code WHERE t OR id IN (SELECT id FROM docs)) SELECT implemented, (SELECT count(DISTINCT id) FROM docs) AS defined, implemented * 100.0 / (SELECT count(DISTINCT id) FROM docs)::DOUBLE AS coverage FROM i")
def trace_report(spark, sf):
    code, docs = _specs(spark, sf)
    return trace.trace_report(trace.cross_reference(code, docs), docs)


@query("SELECT p_partkey AS path, p_retailprice AS score FROM part WHERE p_retailprice >= 950 ORDER BY score DESC, path")
def high_scores(spark, sf):
    return ranking.at_least(table(spark, sf, "part").select(F.col("p_partkey").alias("path"), F.col("p_retailprice").alias("score")), "score", 950)


@query("SELECT l_partkey AS path, count(*) AS dependents FROM lineitem GROUP BY 1 ORDER BY dependents DESC, path LIMIT 10")
def most_depended(spark, sf):
    return ranking.most(table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("path")).agg(F.count("*").alias("dependents")), "dependents", 10)


@query("WITH t AS (SELECT p_partkey AS path, p_retailprice / 250 AS score FROM part WHERE p_partkey % 3 <> 0 ORDER BY score DESC, path LIMIT 40) SELECT path, score, CASE WHEN score >= 7 THEN 'critical' WHEN score >= 5 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS priority FROM t WHERE score >= 1 ORDER BY score DESC, path LIMIT 20")
def undocumented_important(spark, sf):
    p = table(spark, sf, "part")
    rows = p.select(F.col("p_partkey").alias("path"), (F.col("p_retailprice") / 250).alias("score"))
    return graph.undocumented_important(rows, p.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("path")), 20, 1.0)


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE contains(lower(s_name), 'r#00') OR regexp_matches(s_name, '(?i)r.*#.*0.*0') ORDER BY id LIMIT 50")
def symbol_search(spark, sf):
    return ranking.search_symbols(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), "r#00")


@query("SELECT n_name AS symbol FROM nation UNION SELECT r_name FROM region")
def set_ops_symbols(spark, sf):
    d = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("key"), F.col("r_name").alias("id"))
    return ranking.symbol_set(d)


@query("SELECT 'graph TD' || chr(10) || string_agg('    ' || regexp_replace(regexp_replace(n_name, '[^a-zA-Z0-9]', '_', 'g'), '^_+|_+$', '', 'g') || ' --> ' || regexp_replace(regexp_replace(r_name, '[^a-zA-Z0-9]', '_', 'g'), '^_+|_+$', '', 'g'), chr(10) ORDER BY n_nationkey) AS text FROM nation JOIN region ON n_regionkey = r_regionkey")
def dependency_diagram(spark, sf):
    e = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rendering.dependency_diagram(e.select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"), F.col("n_nationkey").alias("pos"), F.lit(False).alias("in_cycle")))


@query("WITH k AS (SELECT p_brand AS module, p_type AS kind, string_agg('- [' || p_name || '](#' || regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') || ') - ' || p_type, chr(10) ORDER BY p_name, p_partkey) AS body FROM part GROUP BY 1, 2) SELECT module, string_agg('### ' || kind || chr(10) || body, chr(10) || chr(10) ORDER BY kind) AS text FROM k GROUP BY 1")
def table_of_contents(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("module"), F.col("p_type").alias("kind"), F.col("p_name").alias("name"), F.col("p_type").alias("description"))
    return rendering.table_of_contents(p)


@query("WITH r AS (SELECT s_nationkey AS uri, -1 AS pos, 'document' AS label FROM supplier GROUP BY 1 UNION ALL SELECT s_nationkey, s_suppkey, 'range' FROM supplier) SELECT CAST(row_number() OVER (ORDER BY uri, pos) AS INTEGER) AS id, label FROM r")
def index_lines(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("uri"), F.col("s_suppkey").alias("pos"), F.lit(0).alias("start_line"))
    return rendering.index_lines(s).select("id", "label")


# --- extraction and contexts --------------------------------------------------------------


_SYM = [r"(?:export\s+)?(?:async\s+)?function\s+\w+", r"(?:export\s+)?class\s+\w+", r"(?:export\s+)?interface\s+\w+", r"(?:export\s+)?type\s+\w+\s*="]


@query(f"SELECT page_id AS path, CAST({count_sql('html', _SYM)} AS INTEGER) AS symbols, CAST(least({count_sql('html', _SYM)}, len(regexp_extract_all(html, '/\\*\\*(.|\\n)*?\\*/'))) AS INTEGER) AS documented FROM pages")
def text_coverage(spark, sf):
    from ..operators.extraction import text_coverage as run

    return run(_pages(spark, sf))


@query("SELECT p_partkey, CASE WHEN p_type LIKE '%[]' THEN 'array' WHEN contains(t, ' | ') THEN 'union' WHEN contains(t, ' & ') THEN 'intersection' WHEN lower(t) IN ('string', 'number', 'boolean', 'null', 'undefined', 'void', 'never', 'any', 'unknown') THEN 'primitive' ELSE 'reference' END AS kind FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN p_type || ' | null' WHEN 1 THEN p_type || ' & Part' WHEN 2 THEN 'String' ELSE p_type END AS t FROM part)")
def type_kinds(spark, sf):
    from ..operators.extraction import type_kind

    t, k = F.col("p_type"), F.col("p_partkey") % 4
    raw = F.when(k == 0, F.concat(t, F.lit(" | null"))).when(k == 1, F.concat(t, F.lit(" & Part"))).when(k == 2, "String").otherwise(t)
    return table(spark, sf, "part").select("p_partkey", type_kind(raw).alias("kind"))


@query("SELECT CAST(doc_id AS VARCHAR) AS name, upper(substr(kind, 1, 1)) || substr(kind, 2) || ' `' || name || '` provides functionality as defined by its signature.' AS description FROM (SELECT doc_id, CAST(doc_id AS VARCHAR) AS name, kind FROM " + SYMBOLS + " WHERE trim(description) = '')")
def template_descriptions(spark, sf):
    from ..functions.text import strip
    from ..operators.extraction import fill_descriptions

    return fill_descriptions(inputs.symbols(spark, sf).filter(strip(F.col("description")) == "")).select("name", "description")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN '[documentation]' || chr(10) || c_name ELSE '[class] ' || c_name || chr(10) || 'Language: python' || chr(10) || c_name END AS text FROM customer")
def embedding_texts(spark, sf):
    from ..operators.extraction import prepare

    doc, n = F.col("c_mktsegment") == "BUILDING", F.col("c_name")
    return table(spark, sf, "customer").select("c_custkey", prepare(F.when(doc, "docs").otherwise("code"), n, F.lit("class"), F.lit("python"), n).alias("text"))


@query("WITH RECURSIVE e AS (SELECT DISTINCT * FROM " + CALL_EDGES + "), r AS (SELECT s_suppkey AS root, s_suppkey AS id, 0 AS level FROM supplier UNION ALL SELECT root, dst, level + 1 FROM r JOIN e ON id = src WHERE level < 3) SELECT root, id, min(level) AS level FROM r GROUP BY 1, 2")
def dependency_tree(spark, sf):
    from ..operators.extraction import dependency_tree as run

    roots = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("root"))
    return run(inputs.call_edges(spark, sf), roots, 3).select("root", "id", "level")


@query("SELECT source AS module, array_to_string(list_sort(list(name) FILTER (kind = 'function')), ',') AS functions, array_to_string(list_sort(list(name) FILTER (kind = 'class')), ',') AS classes FROM (SELECT path AS source, name, kind FROM " + SYMBOLS + ") GROUP BY 1")
def context_buckets(spark, sf):
    from ..operators.extraction import context_buckets as run

    rows = run(inputs.symbols(spark, sf).withColumnRenamed("path", "module"))
    return rows.select("module", F.nullif(F.array_join("functions", ","), F.lit("")).alias("functions"), F.nullif(F.array_join("classes", ","), F.lit("")).alias("classes"))


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS path, replace(kind, '?', '') AS kind, name || p_partkey AS name, CAST(line AS INTEGER) AS line, replace(replace(signature, '#', CAST(p_partkey AS VARCHAR)), '@', p_type) AS signature, exported, documented
FROM part, (VALUES ('function', 'add_', 1, '(a: @): number', TRUE, FALSE), ('class', 'K', 3, 'K#', FALSE, TRUE), ('interface', 'I', 5, 'I#<T>', FALSE, TRUE), ('type', 'T', 6, 'T#', TRUE, TRUE)) v(kind, name, line, signature, exported, documented)"""
)
def extracted_symbols(spark, sf):
    from ..operators.extraction import extract_symbols

    k = F.col("p_partkey").cast("string")
    code = F.concat(F.lit("/** Adds. */\nexport function add_"), k, F.lit("(a: "), "p_type", F.lit("): number { }\nabstract class K"), k, F.lit(" {}\n// one\ninterface I"), k, F.lit("<T> {}\nexport type T"), k, F.lit(" = string\nfunction _hidden() {}\n"))
    return extract_symbols(table(spark, sf, "part").select(k.alias("path"), code.alias("content")))


@query("SELECT vec_id, CAST(label AS BIGINT) AS label FROM embeddings WHERE label IN (1, 2)")
def collection_filter(spark, sf):
    from ..operators.filters import doc_chunks

    kind = F.when(F.col("label") == 1, "docs").when(F.col("label") == 2, "comments").otherwise("code")
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), kind.alias("type"))
    return doc_chunks(rows).select("vec_id", "label")


@query("SELECT s_suppkey AS id, floor((epoch(TIMESTAMP '2024-06-01') - epoch(TIMESTAMP '2024-01-01' + s_suppkey * INTERVAL 1 HOUR)) / 86400)::BIGINT AS days FROM supplier")
def age_days(spark, sf):
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("s_suppkey") * 3600)
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), scoring.floor_days(F.lit("2024-06-01").cast("timestamp"), ts).alias("days"))


# the other families register themselves
from . import document_queries, function_queries, rule_queries, source_queries, text_queries  # noqa: E402, F401
