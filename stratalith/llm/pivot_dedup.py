"""Near-duplicate embeddings with a pivot-permutation index.

A vector is described by its nearest reference points (pivots), in order of
distance. Inverted lists hold, for each label and pivot, the vectors that name
it; two vectors of a list are candidates when they share at least ``shared``
pivots, and are measured exactly, in the list of the first pivot they share; a
vector needs no place in the lists of its last ``shared`` - 1.
Equal vectors are one node with a count, and long lists are dealt to pairs of
blocks of bounded size. Lists return counts of links and a spanning forest,
not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components, forest
from .session import checkpointed
from .spread import spread_join
from .vectors import matrix, sample_of, valid_vectors


FEW_LISTS = 100_000


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows over their norms; scaled first, so that no square overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _describing(pivots: np.ndarray, names: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            order = np.argsort(-(unit_rows(matrix(batch["embedding"], pivots.shape[1])) @ pivots.T), axis=1, kind="stable")[:, :names] if len(batch) else np.zeros((0, names), int)
            yield batch.assign(pivots=list(order.astype(np.int32)))

    return run


def _linking(least: float, shared: int, n_pivots: int, d: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        pivot, low, high = (int(group[c].iloc[0]) for c in ("pivot", "low", "high"))
        group = group.sort_values("node", kind="stable")
        sides = [group] if low == high else [group[group["block"] == low], group[group["block"] == high]]
        named, units, ids, copies = [], [], [], []
        for side in sides:
            mark = np.zeros((len(side), n_pivots), np.float32)
            if len(side):
                mark[np.arange(len(side))[:, None], np.stack(side["pivots"].to_numpy())] = 1
            named.append(mark)
            units.append(unit_rows(matrix(side["embedding"], d)) if len(side) else np.zeros((0, d)))
            ids.append(side["node"].to_numpy())
            copies.append(side["copies"].to_numpy())
        a, b = 0, len(sides) - 1
        both = named[a] @ named[b].T >= shared
        if pivot:
            both &= named[a][:, :pivot] @ named[b][:, :pivot].T == 0
        if a == b:
            np.fill_diagonal(both, False)
        i, j = np.nonzero(both)
        near = np.zeros(len(i), bool)
        for s in range(0, len(i), 1 << 16):
            near[s : s + (1 << 16)] = np.einsum("ij,ij->i", units[a][i[s : s + (1 << 16)]], units[b][j[s : s + (1 << 16)]]) >= least
        i, j = i[near], j[near]
        links = [(ids[a], np.bincount(i, weights=copies[b][j], minlength=len(ids[a])))]
        if a != b:
            links.append((ids[b], np.bincount(j, weights=copies[a][i], minlength=len(ids[b]))))
        tree = {x: t for x, t in forest(ids[a][i].tolist(), ids[b][j].tolist()).items() if x != t}
        rows = [(int(x), None, int(n)) for own, counts in links for x, n in zip(own, counts, strict=True) if n]
        rows += [(x, t, 0) for x, t in tree.items()]
        return pd.DataFrame({"a": pd.Series([r[0] for r in rows], dtype="int64"), "b": pd.Series([r[1] for r in rows], dtype="Int64"), "n": pd.Series([r[2] for r in rows], dtype="int64")})

    return run


def near_vectors(rows: DataFrame, least: float = 0.93, pivots: int = 256, names: int = 14, shared: int = 3, per_block: int = 2048, most_pivots: int = 4096) -> DataFrame:
    """One row for each row: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null and their cosine is at
    least ``least``. Those that are null, zero, hold null or non-finite components
    or have another length than most link with nothing. Rows that repeat a vec_id
    count as one vector, the smallest by label, then components; a null vec_id has a
    null component, no links and is kept.
    Pivots are a sample of distinct vectors: ``pivots``, or the square root of the rows if
    that is more, ``most_pivots`` at most; a vector names ``names`` of them, five more
    for each fourfold of the pivots.
    """
    kind = "array<float>" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    columns = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), F.col("label").cast("string").alias("label")]
    sound, d = valid_vectors(rows.select(columns).filter("label IS NOT NULL"))
    total = sound.count()
    everyone = rows.select(F.col("vec_id").cast("long").alias("vec_id"))
    if not total:
        return everyone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    points = unit_rows(sample_of(sound, min(max(pivots, math.isqrt(total)), most_pivots), d))
    names = min(names + round(2.5 * max(0.0, math.log2(len(points) / pivots))), len(points))
    shared = min(shared, len(points))
    zero = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))  # -0 is 0
    digest = [F.xxhash64("label", zero, F.lit(s)).alias(n) for s, n in ((1, "h1"), (2, "h2"))]
    own = sound.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.label", "v.embedding").select("*", *digest)
    equal = checkpointed(own.groupBy("h1", "h2").agg(F.min(F.struct("vec_id", "label", "embedding")).alias("v"), F.count("*").alias("copies")).select("h1", "h2", F.col("v.vec_id").alias("node"), "copies", "v.label", "v.embedding"))
    member = own.select("vec_id", "h1", "h2")
    described = checkpointed(equal.select("node", "copies", "label", "embedding").mapInPandas(_describing(points, names), f"node long, copies long, label string, embedding {kind}, pivots array<int>"))
    # the first of at least ``shared`` pivots that two vectors have in common is not among either's last ``shared`` - 1
    posted = described.select("*", F.explode(F.slice(F.array_sort("pivots"), 1, names - shared + 1)).alias("pivot"))
    size = posted.groupBy("label", "pivot").agg(F.ceil(F.count("*") / per_block).alias("blocks"), F.count("*").alias("n"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    size = checkpointed(size)
    few = size.count() <= FEW_LISTS  # a bounded broadcast, or a join that no long list sends to one task
    held = posted.join(F.broadcast(size.drop("n")), ["label", "pivot"]) if few else spread_join(posted, size, ["label", "pivot"], "n", described.count() * names)
    dealt = held.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    lists = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    found = checkpointed(lists.groupBy("label", "pivot", "low", "high").applyInPandas(_linking(least, shared, len(points), d), "a long, b long, n long"))
    part = components(found.filter("b IS NOT NULL").select("a", "b"))
    links = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    told = equal.select("h1", "h2", "node", "copies").join(links, "node", "left").join(part.withColumnRenamed("id", "node"), "node", "left")
    told = checkpointed(told.select("h1", "h2", F.col("copies").alias("rows"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "node").alias("c")))
    each = spread_join(member, told, ["h1", "h2"], "rows", total).select("vec_id", "n", "c")
    out = everyone.alias("e").join(each.alias("t"), F.col("e.vec_id") == F.col("t.vec_id"), "left").select("e.vec_id", F.coalesce("t.n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("t.c", "e.vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op8_pivot_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of near-duplicate embeddings with equal labels."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
