"""Approximate nearest neighbours with a hash-prefix forest.

Every tree gives a vector a long string of bits, the sides of random planes
through the middle of a bounded sample. A block of rows is indexed by one
sorted array of strings for each tree. A query descends in all trees to its
longest matching prefixes, then ascends in all trees together, one bit at a
time, until the rows under the prefixes are several times the block: each is
found in several trees. Those with the longest prefixes, summed over the trees,
are measured exactly, a given share of the block. Every row is indexed, each in
one block, and every block is searched by blocks of queries.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import checkpointed, parts
from .vectors import matrix, sample_of, valid_vectors

BITS = 32


class Forest:
    """Sorted strings of a block of rows: all trees' arrays one behind the other, the tree's number on top of a string."""

    def __init__(self, rows: np.ndarray, planes: np.ndarray, middle: np.ndarray):
        self.planes, self.middle, self.size = planes, middle, len(rows)
        codes = self.codes(rows)
        order = np.argsort(codes, axis=1, kind="stable")
        self.sorted, self.order = np.take_along_axis(codes, order, axis=1).ravel(), order.ravel()

    def codes(self, rows: np.ndarray) -> np.ndarray:
        """(trees, rows) strings as unsigned numbers, first bit on top."""
        trees = self.planes.shape[1] // BITS
        out = np.zeros((trees, len(rows)), np.uint64)
        weight = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
        for lo in range(0, len(rows), 1024):
            side = ((rows[lo : lo + 1024] - self.middle) @ self.planes > 0).reshape(-1, trees, BITS)
            out[:, lo : lo + 1024] = (side * weight).sum(axis=2, dtype=np.uint64).T
        return out + (np.arange(trees, dtype=np.uint64) << np.uint64(BITS))[:, None]

    def candidates(self, codes: np.ndarray, want: int, votes: float) -> np.ndarray:
        """The ``want`` rows with the longest prefixes of one query's strings.

        Prefixes shorten in all trees together until they hold ``votes`` times the
        rows there are, and at least ``want`` different ones.
        """
        for depth in range(BITS, -1, -1):
            rest = np.uint64((1 << BITS - depth) - 1)
            low = codes & ~rest
            a, b = np.searchsorted(self.sorted, low, "left"), np.searchsorted(self.sorted, low | rest, "right")
            n = b - a
            if n.sum() < votes * self.size and depth:
                continue
            at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
            apart = (self.sorted[at] ^ np.repeat(codes, n)).astype(np.float64)
            shared = BITS - np.ceil(np.log2(apart + 1.0)) - depth + 1  # bits of the prefix from this depth on
            length = np.bincount(self.order[at], weights=shared, minlength=self.size)
            if np.count_nonzero(length) >= want or not depth:
                return np.argsort(-length, kind="stable")[:want]
        return np.arange(self.size)


def _searching(planes: np.ndarray, middle: np.ndarray, k: int, share: float, least: int, votes: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        rows, queries = rows.sort_values("vec_id", kind="stable"), queries.sort_values("vec_id", kind="stable")
        x, q, ids = matrix(rows["embedding"], len(middle)), matrix(queries["embedding"], len(middle)), rows["vec_id"].to_numpy()
        group, first = pd.factorize(pd.Series([v.tobytes() for v in x + 0.0]))  # equal vectors are one row of the index
        place = np.argsort(group, kind="stable")
        begin = np.searchsorted(group[place], np.arange(len(first) + 1))
        x = x[place[begin[:-1]]]
        forest = Forest(x, planes, middle)
        strings = forest.codes(q)
        want = min(len(x), max(least, int(np.ceil(share * len(x)))))
        out: list[tuple[int, int, float]] = []
        for i, own in enumerate(queries["vec_id"].tolist()):
            near = forest.candidates(strings[:, i], want, votes)
            far = np.sqrt(((x[near] - q[i]) ** 2).sum(axis=1))
            close = np.argsort(far, kind="stable")
            close = close[far[close] <= far[close[min(k, len(close) - 1)]]]
            hits = sorted((float(far[j]), int(v)) for j in close.tolist() for v in ids[place[begin[near[j]] : begin[near[j] + 1]][: k + 1]].tolist() if v != own)
            out += [(own, v, f) for f, v in hits[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def nearest(
    rows: DataFrame, queries: DataFrame, k: int = 10, trees: int = 160, share: float = 0.2, least: int = 512, votes: float = 8.0, per_block: int = 16_384, sample: int = 4096, seed: int = 11
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's nearest rows by Euclidean distance, ties to the smaller vec_id.

    Vectors that are null, zero, hold null or non-finite components or have another
    length than most of ``rows`` take no part, as rows or as queries. Of sound rows
    that repeat a vec_id the smallest vector counts; a query isn't its own
    neighbour. ``share`` is the part of a block that a query measures, ``votes`` how
    often a row of the block is found on average before they are ranked.
    """
    columns = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")]
    sound, d = valid_vectors(rows.select(columns))
    once = lambda df: df.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = once(valid_vectors(queries.select(columns), d)[0])
    middle = sample_of(sound, sample, d)
    middle = middle.mean(axis=0) if len(middle) else np.zeros(d)
    planes = np.random.default_rng(seed).standard_normal((d, trees * BITS))
    n_rows, n_queries = parts(sound.count(), per_block), parts(asked.count(), per_block)
    block = F.pmod(F.xxhash64("vec_id"), F.lit(n_rows)).alias("block")
    group = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_queries)).alias("asked")
    left = once(sound).select("*", block, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_queries - 1).cast("long"))).alias("asked"))
    right = asked.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_rows - 1).cast("long"))).alias("block"), group)
    found = left.groupBy("block", "asked").cogroup(right.groupBy("block", "asked")).applyInPandas(_searching(planes, middle, k, share, least, votes), "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return checkpointed(found).withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector among all."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.filter("vec_id % 100 = 0"))
