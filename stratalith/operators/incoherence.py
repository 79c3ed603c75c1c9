"""Incoherence between code chunks and documentation chunks, for all paths at once.

Chunks: id, path, symbol, kind, content, signature, visibility, exported, complexity, vec.
Issues: path, id, type, severity, confidence, message. Code meets the first
document of its symbol in a null-safe join; whether a chunk resembles any other is
asked of slices of the others, behind the cheaper tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed, few
from ..functions.scoring import missing_doc_severity
from ..functions.vectors import cosine
from .retrieval import vector_scores


FEW_NAMES = 5_000  # names that are looked for beside each text


def first_docs(docs: DataFrame) -> DataFrame:
    """The first document (smallest id) of every path and symbol."""
    n = F.row_number().over(Window.partitionBy("path", "symbol").orderBy("id"))
    return docs.withColumn("n", n).filter("n = 1").drop("n")


def best_match(chunks: DataFrame, others: DataFrame) -> DataFrame:
    """(id, best): the largest cosine of each chunk with any other, block by block."""
    hits = vector_scores(chunks.select(F.col("id").alias("qid"), "vec"), others.select("id", "vec"), k=1)
    return hits.groupBy(F.col("qid").alias("id")).agg(F.max("vec").alias("best"))


def resembling(chunks: DataFrame, others: DataFrame, match: float, first: int = 16_384) -> DataFrame:
    """(id) of chunks (id, vec) whose cosine with any other reaches ``match``.

    A slice of the others comes first, and each next one, four times larger, meets only chunks that
    have found none; so only those that resemble nothing are compared with all.
    """
    left, others = checkpointed(chunks.select("id", "vec")), checkpointed(others.select("id", "vec"))
    slices = max(1, -(-others.count() // first))
    at, end, found = 0, 1, None
    while True:
        part = F.pmod(F.xxhash64("id", F.lit("slice")), F.lit(slices))
        hits = vector_scores(left.withColumnRenamed("id", "qid"), others.filter((part >= at) & (part < end)), k=1, least=match)
        hits = checkpointed(hits.select(F.col("qid").alias("id")).distinct())
        found = hits if found is None else found.unionByName(hits)
        if end >= slices:
            return found
        left = checkpointed(left.join(few(hits), "id", "left_anti"))
        if left.isEmpty():
            return found
        at, end = end, min(slices, 4 * end)


def _issue(df: DataFrame, kind: str, severity, confidence: float, message) -> DataFrame:
    return df.select("path", "id", F.lit(kind).alias("type"), severity.cast("double").alias("severity"), F.lit(confidence).alias("confidence"), message.alias("message"))


def missing(code: DataFrame, docs: DataFrame, match: float = 0.5) -> DataFrame:
    """Exported, not private code that no document of its path names and none anywhere resembles."""
    open_ = code.filter((F.coalesce("visibility", F.lit("")) != "private") & F.col("exported"))
    # a name is looked for once, however many chunks have it, and where names are few, beside the texts
    names = checkpointed(open_.select("path", "symbol").distinct())
    texts = docs.select(F.col("path").alias("p"), F.col("symbol").alias("s"), F.lower("content").alias("t"))
    same = (F.col("path") == F.col("p")) & F.col("symbol").eqNullSafe(F.col("s"))
    own = names.join(texts.select("p", "s").distinct(), same, "left_semi")
    rest = checkpointed(names.join(texts.select("p", "s").distinct(), same, "left_anti"))
    told = (F.col("path") == F.col("p")) & F.contains("t", F.lower(F.coalesce("symbol", F.lit(""))))
    within = texts.select("p", "t").join(F.broadcast(rest), told).select("path", "symbol").distinct() if rest.count() <= FEW_NAMES else rest.join(texts.select("p", "t"), told, "left_semi")
    named = checkpointed(own.unionByName(within)).select(F.col("path").alias("p"), F.col("symbol").alias("s"))
    bare = checkpointed(open_.join(few(named), same, "left_anti").select("path", "id", "symbol", "kind", "visibility", "exported", "complexity", "vec"))
    rows = bare.join(few(resembling(bare, docs, match)), "id", "left_anti")
    severity = missing_doc_severity(F.col("exported"), F.col("visibility"), F.col("complexity"), F.col("kind"))
    return _issue(rows, "missing", severity, 0.9, F.format_string('No documentation for %s "%s"', F.coalesce("kind", F.lit("symbol")), "symbol"))


def orphaned(code: DataFrame, docs: DataFrame, match: float = 0.5) -> DataFrame:
    """Documents of a symbol that their path doesn't have and no code resembles."""
    bare = checkpointed(docs.filter("symbol <> ''").select("path", "id", "symbol", "vec").join(few(checkpointed(code.select("path", "symbol").distinct())), ["path", "symbol"], "left_anti"))
    rows = bare.join(few(resembling(bare, code, match)), "id", "left_anti")
    return _issue(rows, "orphaned", F.lit(0.5), 0.8, F.format_string('Doc for "%s" has no code', "symbol"))


def mismatch(code: DataFrame, docs: DataFrame, coherence: float = 0.6) -> DataFrame:
    """Code whose first document has a low cosine."""
    d = first_docs(docs).select(F.col("path").alias("p"), F.col("symbol").alias("s"), F.col("vec").alias("v"))
    rows = code.join(d, (F.col("path") == F.col("p")) & F.col("symbol").eqNullSafe(F.col("s"))).withColumn("sim", cosine(F.col("vec"), F.col("v"))).filter(F.col("sim") < coherence)
    return _issue(rows, "mismatch", 1 - F.col("sim"), 0.85, F.format_string("Doc doesn't match code (%.1f%% similarity)", F.col("sim") * 100))


def incomplete(code: DataFrame, docs: DataFrame) -> DataFrame:
    """Functions whose first document leaves out parameters, return value or exceptions."""
    d = first_docs(docs).select(F.col("path").alias("p"), F.col("symbol").alias("s"), F.lower("content").alias("t"))
    rows = code.filter(F.col("kind").isin("function", "method")).join(d, (F.col("path") == F.col("p")) & F.col("symbol").eqNullSafe(F.col("s")))
    sig = F.coalesce("signature", F.lit(""))
    has = lambda c, w: F.contains(c, F.lit(w))
    t = F.col("t")
    lacks = F.array_compact(
        F.array(
            F.when(has(sig, "(") & ~has(sig, "()") & ~has(t, "@param") & ~has(t, "parameter"), "parameters"),
            F.when(has(sig, ": ") & ~has(sig, ": void") & ~has(t, "@return") & ~has(t, "returns"), "return"),
            F.when((has(F.lower(sig), "throw") | has(F.col("content"), "throw ")) & ~has(t, "@throws") & ~has(t, "throws"), "exceptions"),
        )
    )
    rows = rows.withColumn("lacks", lacks).filter(F.size("lacks") > 0)
    return _issue(rows, "incomplete", F.size("lacks") * 0.25, 0.9, F.concat(F.lit("Missing: "), F.array_join("lacks", ", ")))


def find_incoherence(code: DataFrame, docs: DataFrame, match: float = 0.5, coherence: float = 0.6) -> DataFrame:
    """All issues; either side is computed once."""
    code, docs = checkpointed(code), checkpointed(docs)
    return missing(code, docs, match).unionByName(orphaned(code, docs, match)).unionByName(mismatch(code, docs, coherence)).unionByName(incomplete(code, docs))


def file_scores(code: DataFrame, docs: DataFrame, issues: DataFrame) -> DataFrame:
    """path, issues, score: 1 less a tenth of the severities, plus a tenth of documents over code; 1 without code."""
    n = code.groupBy("path").agg(F.count("*").alias("code")).join(docs.groupBy("path").agg(F.count("*").alias("docs")), "path", "full_outer")
    s = issues.groupBy("path").agg(F.count("*").alias("issues"), F.sum("severity").alias("severity"))
    rows = n.join(s, "path", "left").fillna(0, ["code", "docs", "issues", "severity"])
    score = 1 - 0.1 * F.col("severity") + 0.1 * F.col("docs") / F.col("code")
    return rows.select("path", "issues", F.when(F.col("code") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).alias("score"))


def project_summary(issues: DataFrame) -> DataFrame:
    """type, high, medium, low, total of all issues."""
    s = F.col("severity")
    return issues.groupBy("type").agg(F.count_if(s > 0.7).alias("high"), F.count_if((s > 0.4) & (s <= 0.7)).alias("medium"), F.count_if(s <= 0.4).alias("low"), F.count("*").alias("total"))


def detect_drift(versions: DataFrame, least: float = 0.3) -> DataFrame:
    """(id, drift, severity) of versions (id, pos, sim): the sum of drops over ``least``; one version has none."""
    w = Window.partitionBy("id").orderBy("pos")
    drops = versions.withColumn("d", F.lag("sim").over(w) - F.col("sim"))
    out = drops.groupBy("id").agg(F.sum(F.when(F.col("d") > least, F.col("d")).otherwise(0.0)).alias("drift"), F.count("*").alias("n")).filter("n > 1 AND drift > 0")
    return out.select("id", "drift", F.least(F.lit(1.0), F.col("drift") / F.col("n")).alias("severity"))
