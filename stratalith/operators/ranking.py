"""Top-k lists, priorities and small table operators."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..functions.scoring import completion_relevance
from ..functions.text import matches_query


def at_least(rows: DataFrame, column: str, least: float, tie: str = "path") -> DataFrame:
    """Rows from a threshold on, highest first."""
    return rows.filter(F.col(column) >= least).orderBy(F.desc(column), tie)


def most(rows: DataFrame, column: str, k: int, tie: str = "path") -> DataFrame:
    """The k highest rows, planned as a take-ordered."""
    return rows.orderBy(F.desc(column), tie).limit(k)


def least(rows: DataFrame, column: str, k: int, tie: str = "path") -> DataFrame:
    return rows.orderBy(F.asc(column), tie).limit(k)


def by_need(files: DataFrame) -> DataFrame:
    """Files (path, importance, coverage) by importance times what coverage lacks, highest first."""
    need = F.col("importance") * (100 - F.coalesce("coverage", F.lit(0.0)))
    return files.withColumn("need", need).orderBy(F.desc("need"), "path")


def search_symbols(symbols: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Symbols (id, name) that match a query; by id, so that reruns agree."""
    return symbols.filter(matches_query(F.col("name"), query)).orderBy("id").limit(limit)


def completions(symbols: DataFrame, prefix: str, path: str, line: int, k: int = 10) -> DataFrame:
    """The k symbols (path, name, line, kind, deprecated) with a prefix that are most relevant at a place."""
    score = completion_relevance(F.col("path") == path, F.abs(F.col("line") - line), F.col("deprecated"), F.col("kind"))
    return symbols.filter(F.lower("name").startswith(prefix.lower())).withColumn("relevance", score).orderBy(F.desc("relevance"), "path", "name").limit(k)


def overlapping(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows whose range (start_line, end_line) meets the selection."""
    return rows.filter((F.col("start_line") <= end) & (start <= F.col("end_line")))


def merged_models(registry: DataFrame, cached: DataFrame, recommended: DataFrame) -> DataFrame:
    """registry (id, ...) with is_cached and the recommendation's score."""
    return registry.join(cached.select("id", F.lit(True).alias("is_cached")).distinct(), "id", "left").join(recommended.select("id", "score"), "id", "left").fillna({"is_cached": False})


def newest(rows: DataFrame, default: str) -> DataFrame:
    """One row: the id created last, or a default."""
    return rows.agg(F.coalesce(F.max_by("id", F.struct("created", "id")), F.lit(default)).alias("id"))


def flatten_tree(symbols: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, parent_id, depth, path) of a forest (id, parent_id, pos) in pre-order by path; raises on rows below ``depth``, or where ids repeat in a ring."""
    most = symbols.count() if depth is None else depth
    level = symbols.filter("parent_id IS NULL").select("id", F.lit(None).cast(symbols.schema["id"].dataType).alias("parent_id"), F.lit(0).alias("depth"), F.array(F.col("pos").cast("long")).alias("path"))
    out = level
    for d in count(1):
        up = level.select(F.col("id").alias("parent_id"), F.col("path").alias("up"))
        level = checkpointed(symbols.join(up, "parent_id").select("id", "parent_id", F.lit(d).alias("depth"), F.concat("up", F.array(F.col("pos").cast("long"))).alias("path")))
        if level.isEmpty():
            break
        if d > most:
            raise ValueError(f"rows are left below depth {most}")
        out = out.unionByName(level)
    return out.orderBy("path")


def module_definitions(symbols: DataFrame) -> DataFrame:
    """(module, key, ...): one row for each key, name or parent.name; of equal keys the last place counts."""
    key = F.when(F.col("depth") == 1, F.concat_ws(".", "parent", "name")).otherwise(F.col("name"))
    rows = symbols.withColumn("key", key)
    last = rows.groupBy("module", "key").agg(F.max("pos").alias("pos"))
    return rows.join(last, ["module", "key", "pos"])


def symbol_set(definitions: DataFrame) -> DataFrame:
    """Distinct names and ids of definitions (key, id)."""
    return definitions.select(F.explode(F.array("key", "id")).alias("symbol")).distinct()
