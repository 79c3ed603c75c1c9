"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import checkpointed, parts
from .spread import spread_join


def forest(a: list[int], b: list[int]) -> dict[int, int]:
    """Smallest member reachable from each end of these links, by union-find."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: top(x) for x in list(parent)}


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    a, b = [], []
    for batch in batches:
        own = forest([*a, *batch["a"].tolist()], [*b, *batch["b"].tolist()])
        a, b = [x for x, t in own.items() if x != t], [t for x, t in own.items() if x != t]
    yield pd.DataFrame({"a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64")})


def components(links: DataFrame, per_part: int = 500_000) -> DataFrame:
    """(id, component) of every id that a link (a, b) joins with another; the component is its smallest id.

    Parts of about ``per_part`` links shrink to stars on their own first, which are
    dealt by id, so that no later task has to read a whole part; then
    large-star and small-star rounds alternate until nothing changes, each cut
    off by a checkpoint. Links of an id with itself and repeated links say nothing;
    an id with very many links is spread over tasks.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    n = parts(links.count(), per_part)
    stars = checkpointed(links.withColumn("part", F.pmod(F.xxhash64("a"), F.lit(n))).repartition(n, "part").select("a", "b").mapInPandas(_stars, "a long, b long").repartition("a"))
    told = None
    while n > 1:
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(stars.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = checkpointed(spread_join(both, least, ["u"], "n", 2 * stars.count()).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, low, ["a"], "n", large.count()).filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        stars = checkpointed(small.distinct())
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == told:
            break
        told = now
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
