"""Documentation coverage, hardening checks and validation over symbol tables.

Symbols are flat: module, name, kind, description, examples, params, return_type.
Each operator is one aggregation; groups and totals come from one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import percent, round1, round2
from ..functions.text import strip


def documented(description: Column) -> Column:
    """Whether a description says anything."""
    return F.coalesce(F.length(strip(description)) > 0, F.lit(False))


def coverage(symbols: DataFrame, by: str, flag: Column) -> DataFrame:
    """total, documented and percent of each group; an empty group would be 100."""
    out = symbols.groupBy(by).agg(F.count("*").alias("total"), F.count_if(flag).alias("documented"))
    return out.withColumn("percent", round2(percent(F.col("documented"), F.col("total"))))


def coverage_rollup(symbols: DataFrame, by: str, flag: Column) -> DataFrame:
    """Groups and, with a null group, the whole workspace."""
    out = symbols.rollup(by).agg(F.count("*").alias("total"), F.count_if(flag).alias("documented"), F.grouping(by).cast("int").alias("is_total"))
    return out.withColumn("percent", round2(percent(F.col("documented"), F.col("total"))))


def workspace_statistics(modules: DataFrame, symbols: DataFrame, freshness: DataFrame, cycles: int = 0) -> DataFrame:
    """One row: modules, symbols, documented, percent, fresh, stale, circular."""
    m = modules.agg(F.count("*").alias("modules"))
    s = symbols.agg(F.count("*").alias("symbols"), F.count_if(documented(F.col("description"))).alias("documented"))
    f = freshness.agg(F.count_if(F.col("status") == "fresh").alias("fresh"), F.count_if(F.col("status") == "stale").alias("stale"))
    one = m.crossJoin(s).crossJoin(f)  # three rows of totals
    return one.withColumn("percent", round2(percent(F.col("documented"), F.col("symbols")))).withColumn("circular", F.lit(cycles))


def quality_measures(symbols: DataFrame) -> DataFrame:
    """One row of counts: exports, with description, with examples, parameters, described, callables, with return type."""
    call = F.col("kind").isin("function", "method")
    described = F.filter("params", lambda p: F.length(p["description"]) > 0)
    size = lambda c: F.greatest(F.size(c), F.lit(0))
    return symbols.agg(
        F.count("*").alias("exports"),
        F.count_if(F.length("description") > 0).alias("described"),
        F.count_if(F.size("examples") > 0).alias("with_examples"),
        F.sum(size(F.col("params"))).alias("params"),
        F.sum(size(described)).alias("described_params"),
        F.count_if(call).alias("callables"),
        F.count_if(call & F.col("return_type").isNotNull()).alias("with_return"),
    )


# Checks, their severity and what they ask for.
FILE_CHECKS = [("has-readme", "error", "readme"), ("has-changelog", "warning", "changelog|history"), ("has-contributing", "info", "contributing"), ("has-license", "error", "license|licence")]
COVERAGE_CHECKS = [("public-api-coverage", "warning", "described", "exports", 80), ("example-coverage", "info", "with_examples", "exports", 50), ("parameter-coverage", "warning", "described_params", "params", 70), ("return-type-coverage", "info", "with_return", "callables", 60)]


def hardening_checks(files: DataFrame, measures: DataFrame) -> DataFrame:
    """Eight rows: id, severity, passed, value, target. files: name; measures: as quality_measures gives them."""
    held = files.agg(*[F.coalesce(F.bool_or(F.lower("name").rlike(p)), F.lit(False)).alias(i) for i, _, p in FILE_CHECKS])
    wide = held.crossJoin(measures)  # one row each
    row = lambda i, s, ok, value, target: F.struct(F.lit(i).alias("id"), F.lit(s).alias("severity"), ok.alias("passed"), value.cast("double").alias("value"), F.lit(float(target)).alias("target"))
    rows = [row(i, s, F.col(f"`{i}`"), F.col(f"`{i}`").cast("int"), 1) for i, s, _ in FILE_CHECKS]
    for i, s, part, whole, target in COVERAGE_CHECKS:
        value = percent(F.col(part), F.col(whole))
        rows.append(row(i, s, value >= target, round1(value), target))
    return wide.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def hardening_score(checks: DataFrame) -> DataFrame:
    """One row: passed, failed, score, is_complete (no error failed), failed_ids."""
    return checks.agg(
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        round1(F.count_if("passed") * 100.0 / F.count("*")).alias("score"),
        (F.count_if(~F.col("passed") & (F.col("severity") == "error")) == 0).alias("is_complete"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("id")))), ",").alias("failed_ids"),
    )


def vector_stats(chunks: DataFrame, *by: str) -> DataFrame:
    """Counts overall, by each column and by all of them: grouping sets in one pass."""
    sets = [[], *[[c] for c in by], list(by)]
    return chunks.groupingSets([[F.col(c) for c in s] for s in sets], *by).agg(F.count("*").alias("n"), F.grouping_id(*by).cast("int").alias("level"))


def status_counts(rows: DataFrame, domain: list[str], column: str = "status") -> DataFrame:
    """A histogram over a domain, with zeros."""
    all_ = rows.sparkSession.createDataFrame([(s,) for s in domain], f"{column} string")
    return all_.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def structure_summary(files: DataFrame, most: int = 30) -> DataFrame:
    """directory, files, extensions of the largest directories. files: path."""
    parts = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("directory"), F.regexp_extract("path", r"(\.[^./]+)$", 1).alias("ext"))
    out = parts.groupBy("directory").agg(F.count("*").alias("files"), F.array_join(F.array_sort(F.collect_set("ext")), ",").alias("extensions"))
    return out.orderBy(F.desc("files"), "directory").limit(most)


def complexity_overview(files: DataFrame, least: float = 5.0) -> DataFrame:
    """avg_overall, avg_maintainability and the number of complex files."""
    return files.agg(round1(F.avg("overall")).alias("avg_overall"), round1(F.avg("maintainability")).alias("avg_maintainability"), F.count_if(F.col("overall") >= least).alias("complex_files"))


def gaps_summary(symbols: DataFrame) -> DataFrame:
    """One row: symbols, undocumented, without_examples, bare_params and the documented share in whole percent, null without symbols."""
    bare = F.size(F.filter("params", lambda p: F.coalesce(F.length(strip(p["description"])), F.lit(0)) == 0))
    n = symbols.agg(F.count("*").alias("symbols"), F.count_if(~documented(F.col("description"))).alias("undocumented"), F.count_if(F.coalesce(F.size("examples"), F.lit(0)) <= 0).alias("without_examples"), F.coalesce(F.sum(F.greatest(bare, F.lit(0))), F.lit(0)).alias("bare_params"))
    return n.withColumn("percent", F.when(F.col("symbols") > 0, F.floor((F.col("symbols") - F.col("undocumented")) * 100.0 / F.col("symbols") + 0.5)))


def explorer_tree(modules: DataFrame, freshness: DataFrame, mode: str = "all") -> DataFrame:
    """folder, files, fresh, stale, paths: modules (path) by their folder, with the status (uri, status) of each; ``mode`` is a status or all."""
    told = modules.join(freshness.withColumnRenamed("uri", "path"), "path", "left").withColumn("status", F.coalesce("status", F.lit("unknown")))
    rows = told if mode == "all" else told.filter(F.col("status") == mode)
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return rows.groupBy(folder.alias("folder")).agg(F.count("*").alias("files"), n("fresh"), n("stale"), F.array_sort(F.collect_list("path")).alias("paths"))


def cache_statistics(entries: DataFrame) -> DataFrame:
    """One row: entries and bytes of a cache (key, size)."""
    return entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
