"""Freshness of documentation against a store of hashes, and its statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_freshness(current: DataFrame, store: DataFrame) -> DataFrame:
    """uri, status for current (uri, hash) against store (uri, source_hash): unknown, fresh or stale.

    Without a current hash an entry counts as fresh.
    """
    joined = current.alias("c").join(store.alias("s"), "uri", "left")
    status = F.when(F.col("s.source_hash").isNull(), "unknown").when(F.col("c.hash").isNull(), "fresh").when(F.col("c.hash") == F.col("s.source_hash"), "fresh").otherwise("stale")
    return joined.select("uri", status.alias("status"))


def stale_files(current: DataFrame, store: DataFrame) -> DataFrame:
    return current.join(store, "uri").filter("hash <> source_hash").select("uri")


def orphaned_docs(store: DataFrame, current: DataFrame) -> DataFrame:
    return store.join(current, "uri", "left_anti").select("uri")


def freshness_statistics(current: DataFrame, store: DataFrame) -> DataFrame:
    """One row: total, fresh, stale, orphaned, from one full outer join."""
    both = store.select("uri", "source_hash").join(current.select("uri", "hash", F.lit(1).alias("here")), "uri", "left")
    n = both.agg(F.count("*").alias("total"), F.count_if(F.col("hash") != F.col("source_hash")).alias("stale"), F.count_if(F.col("here").isNull()).alias("orphaned"))
    return n.select("total", F.greatest(F.lit(0), F.col("total") - F.col("stale") - F.col("orphaned")).alias("fresh"), "stale", "orphaned")


def fresh_share(status: DataFrame) -> DataFrame:
    """Counts by status and the fresh ratio, 0 where there is nothing."""
    n = status.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("fresh", "stale", "orphaned", "missing")])
    return n.withColumn("fresh_percent", F.when(F.col("total") > 0, F.col("fresh") / F.col("total")).otherwise(0.0))


def record(store: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by uri: the new entries, and those of the store that none replaces."""
    return store.join(new, "uri", "left_anti").unionByName(new)


def remove(store: DataFrame, uris: DataFrame) -> DataFrame:
    return store.join(uris, "uri", "left_anti")


def needs_reindex(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files (path, mtime) that are newer than the index has them, or not there; a mark of 0 is never."""
    last = F.nullif(F.col("i.mtime"), F.lit(0))
    return files.alias("f").join(indexed.alias("i"), F.col("f.path") == F.col("i.path"), "left").filter(last.isNull() | (F.col("f.mtime") > last)).select("f.*")
