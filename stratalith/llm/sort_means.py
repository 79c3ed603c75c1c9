"""Exact k-means of integer vectors by sort-means.

Each round sorts, for every centroid, the other centroids by their distance from
it. A vector starts at its centroid of the round before and walks that list; it
stops at the first centroid strictly beyond twice its distance from where it
started, for by the triangle inequality none from there on can be as near. All
arithmetic is in integers, so ties are exact and results do not depend on
partitions. Vectors and their clusters are written anew each round; only the
centroids, a stated number of rows, pass the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import ensure_checkpoint_dir
from .spread import small

REACH = 1 << 27  # components below this keep 64 squared differences within a long


def centroid_order(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, squared distance in that order): for each centroid all of them, nearest first, itself in front of its equals."""
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
    key = apart + 1
    np.fill_diagonal(key, 0)
    order = np.argsort(key, axis=1, kind="stable")
    return order, np.take_along_axis(apart, order, axis=1)


def nearest_centroid(x: np.ndarray, start: np.ndarray, centroids: np.ndarray, order: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, distances computed) of each row, ties to the smaller number."""
    best, far, measured = start.copy(), np.zeros(len(x), np.int64), 0
    for a in np.unique(start).tolist():
        rows = np.flatnonzero(start == a)
        own = ((x[rows] - centroids[a]) ** 2).sum(axis=1)
        # squared: beyond twice the distance is beyond four times its square; halved on the left, as four times may not fit
        stop = np.searchsorted(apart[a], np.minimum(own, (1 << 60)) * 4, "right")
        by_stop = np.argsort(-stop, kind="stable")
        rows, own, stop = rows[by_stop], own[by_stop], stop[by_stop]
        label, least = np.full(len(rows), a), own
        measured += len(rows)
        for j in range(1, int(stop[0]) if len(stop) else 0):
            n = int(np.searchsorted(-stop, -j, "left"))  # those that walk beyond place j
            c = order[a, j]
            d = ((x[rows[:n]] - centroids[c]) ** 2).sum(axis=1)
            measured += n
            nearer = (d < least[:n]) | ((d == least[:n]) & (c < label[:n]))
            least[:n][nearer] = d[nearer]
            label[:n][nearer] = c
        best[rows], far[rows] = label, least
    return best, far, measured


def _assigning(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, apart = centroid_order(centroids)
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(batch), centroids.shape[1])
            cluster, far, _ = nearest_centroid(x, batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64), centroids, order, apart)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cluster.astype(np.int32)), pa.array(far)], ["vec_id", "v", "cluster", "distance"])

    return run


def integer_vectors(rows: DataFrame, d: int, scale: int) -> DataFrame:
    """vec_id and v, the floor of each component times ``scale``, of the vectors with ``d`` sound components."""
    v = F.col("embedding").cast("array<double>")
    at = lambda x: F.floor(x * F.lit(float(scale)))
    sound = (F.size(v) == d) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) * F.lit(float(scale)) < F.lit(float(REACH))), F.lit(False)))
    return rows.filter(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: at(x).cast("int")).alias("v"))


def cluster_vectors(rows: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, d: int = 64, scale: int = 256) -> DataFrame:
    """One row for each vector that takes part: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors with another length than ``d``, that are null or hold null or non-finite
    components take no part; nor do those with a component of 2**27 or more after
    scaling, whose squared distance need not fit a long. The first centroids are the
    ``k`` vectors with the smallest sha256 of "seed:vec_id" (all, if fewer), ties by
    components; a null vec_id is last. Rows that repeat a vec_id are clustered each.
    No vectors give no rows. Sums that don't fit a long are null.
    """
    spark, folder = rows.sparkSession, f"{ensure_checkpoint_dir(rows.sparkSession)}/sort-means-{uuid.uuid4().hex}"
    integer_vectors(rows, d, scale).write.parquet(f"{folder}/vectors")
    vectors = spark.read.parquet(f"{folder}/vectors")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.select("v", digest.alias("digest")).orderBy(F.asc_nulls_last("digest"), "v").limit(k).collect()
    centroids = np.array([r["v"] for r in sorted(first, key=lambda r: (r["digest"] is None, r["digest"] or "", r["v"]))], np.int64).reshape(len(first), d)
    table = vectors.withColumn("cluster", F.lit(0))
    if len(centroids):
        for turn in range(rounds + 1):
            table.select("vec_id", "v", "cluster").mapInArrow(_assigning(centroids), "vec_id long, v array<int>, cluster int, distance long").write.parquet(f"{folder}/{turn}")
            table = spark.read.parquet(f"{folder}/{turn}")
            _delete(spark, f"{folder}/{turn - 1}" if turn else f"{folder}/vectors")
            if turn < rounds:
                sums = table.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(d)])
                for r in sums.collect():  # a row for each centroid
                    centroids[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(d)]
    else:
        table = table.withColumn("distance", F.lit(0).cast("long"))
    text = spark.createDataFrame([(i, ",".join(map(str, c))) for i, c in enumerate(centroids.tolist())], "cluster int, components string").select("cluster", F.sha2("components", 256).alias("centroid_sha256"))
    each = table.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia")).join(F.broadcast(text), "cluster")
    total = table.agg(F.try_sum("distance").alias("inertia"))
    told = small(each.crossJoin(F.broadcast(total)))  # one row for each centroid, one of totals
    return table.select("vec_id", "cluster", "distance").join(told, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty clusters of the embeddings after five rounds."""
    return cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
