"""A vector index on disk, by cells of coarse centroids.

Centroids come from a bounded sample; each vector is written below the cell of its
nearest one, with its angle to it, and a cell that grows beyond a limit is split.
A search reads the folders of few cells only: those nearest to its queries, and,
where it has to be exact, those that the angles cannot rule out.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..checkpoints import checkpointed
from ..operators.retrieval import _block_scores, top_k
from .commits import CommitLog

ZERO = -1  # the cell of vectors without a direction
MOST_PROBES = 1 << 16  # queries with a cell that a task holds at once


class Found(NamedTuple):
    """Hits (qid, rank, id, vec), and how much was read for them."""

    hits: DataFrame
    cells: int
    rows: int


def units(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def spherical_means(x: np.ndarray, k: int, turns: int = 8, seed: int = 3) -> np.ndarray:
    """Up to k directions of unit rows; those that no row is nearest to go."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(turns):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        c = (sums / np.maximum(norm, 1e-12))[norm[:, 0] > 1e-12]
    return c


def _placing(ids: np.ndarray, centroids: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = units(batch["vec"])
            cosine = x @ centroids.T if len(batch) else np.zeros((0, len(ids)))
            best = np.argmax(cosine, axis=1)
            some = x.any(axis=1)
            angle = np.arccos(np.clip(cosine[np.arange(len(best)), best], -1, 1))
            yield batch.assign(cell=np.where(some, ids[best], ZERO).astype(np.int32), angle=np.where(some, angle, math.pi))

    return run


def _probing(ids: np.ndarray, centroids: np.ndarray, radius: np.ndarray, probes: int, k: int, rest: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Queries with each cell they look into: the nearest ``probes``, or, of the rest, those that may hold one of the k best."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = max(1, MOST_PROBES // max(1, len(ids)))
        for batch in (b.iloc[lo : lo + each] for b in batches for lo in range(0, len(b), each)):
            x = units(batch["vec"])
            cosine = x @ centroids.T
            order = np.argsort(-cosine, axis=1, kind="stable")
            first = np.zeros(cosine.shape, bool)
            np.put_along_axis(first, order[:, :probes], True, axis=1)
            if rest:
                apart = np.arccos(np.clip(cosine, -1, 1)) - radius
                most = np.where(ids == ZERO, 0.0, np.cos(np.maximum(apart, 0)))
                least = np.where(batch["n"].to_numpy() < k, -np.inf, batch["worst"].to_numpy(dtype=float))
                most[~x.any(axis=1)] = 0.0
                first = ~first & (most + 1e-9 >= least[:, None])
            i, j = np.nonzero(first)
            yield pd.DataFrame({"qid": batch["qid"].to_numpy()[i], "vec": batch["vec"].to_numpy()[i], "cell": ids[j].astype(np.int32)})

    return run


class VectorIndex:
    """Rows (id, vec, ...) below a folder; ``most`` rows a cell before it is split."""

    def __init__(self, spark: SparkSession, path: str, most: int = 4096, sample: int = 16_384):
        self.spark, self.path, self.most, self.sample = spark, path.rstrip("/"), most, sample
        self.log = CommitLog(spark, f"{self.path}/_commits")

    def _sample(self, rows: DataFrame) -> np.ndarray:
        """Unit vectors of the smallest hashes, a bounded number."""
        found = rows.select("vec", F.xxhash64("vec").alias("h")).orderBy("h").limit(self.sample).collect()
        x = units(pd.Series([r["vec"] for r in found]))
        return x[x.any(axis=1)]

    def _write(self, rows: DataFrame, cells: dict[str, list[float]]) -> dict[str, dict]:
        """Rows below their nearest cells: folders, numbers and radius of each."""
        ids, c = np.array([int(k) for k in cells]), np.array(list(cells.values()))
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        batch = uuid.uuid4().hex
        placed = rows.mapInPandas(_placing(ids, c), f"{kinds}, cell int, angle double").hint("rebalance", "cell")
        placed.write.partitionBy("cell").parquet(f"{self.path}/batch={batch}")
        told = self.spark.read.parquet(f"{self.path}/batch={batch}").groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()  # a row for each cell
        return {str(r["cell"]): {"folders": [f"batch={batch}/cell={r['cell']}"], "n": r["n"], "radius": r["radius"]} for r in told}

    def insert(self, rows: DataFrame) -> None:
        """Adds rows; null vectors are left out. Cells beyond the limit are split, unless their vectors are one."""
        number, state = self.log.read()
        state = state or {"centroids": {}, "cells": {}, "next": 0, "whole": []}
        rows = rows.filter(F.col("vec").isNotNull())
        if not state["centroids"]:
            x = self._sample(rows)
            if not len(x):
                x = np.zeros((1, 1))
            means = spherical_means(x, max(1, min(math.isqrt(rows.count()), len(x) // 8 or 1)))
            state["centroids"] = {str(i): m.tolist() for i, m in enumerate(means if len(means) else x[:1])}
            state["next"], state["kind"] = len(state["centroids"]), rows.schema.json()
        for cell, more in self._write(rows, state["centroids"]).items():
            old = state["cells"].get(cell, {"folders": [], "n": 0, "radius": 0.0})
            state["cells"][cell] = {"folders": [*old["folders"], *more["folders"]], "n": old["n"] + more["n"], "radius": max(old["radius"], more["radius"])}
        while large := [c for c, told in state["cells"].items() if told["n"] > self.most and int(c) != ZERO and c not in state["whole"]]:
            for cell in large:
                own = self._read(state, [cell])
                means = spherical_means(self._sample(own), 2 * -(-state["cells"][cell]["n"] // self.most))
                if len(means) < 2:
                    state["whole"].append(cell)
                    continue
                names = {str(state["next"] + i): m.tolist() for i, m in enumerate(means)}
                made = self._write(own, names)
                if max(told["n"] for told in made.values()) == state["cells"][cell]["n"]:
                    state["whole"] += made
                state["next"] += len(names)
                del state["cells"][cell], state["centroids"][cell]
                state["cells"] |= made
                state["centroids"] |= {c: m for c, m in names.items() if c in made}
        self.log.commit(number + 1, state)

    def _read(self, state: dict, cells: list[str]) -> DataFrame:
        """The rows of these cells; no other folder is listed or read."""
        folders = [f"{self.path}/{f}" for c in cells for f in state["cells"][c]["folders"]]
        rows = self.spark.read.option("basePath", self.path).parquet(*folders)
        return rows.drop("angle", "batch", "cell")

    def rows(self) -> DataFrame:
        """All rows, for an exact search without cells."""
        state = self.log.read()[1]
        return self._read(state, list(state["cells"]))

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, exact: bool = False, exclude_self: bool = False) -> Found:
        """The k nearest by cosine of queries (qid, vec) in the ``probes`` nearest cells; with ``exact``, of all."""
        number, state = self.log.read()
        asked = checkpointed(queries.filter(F.col("vec").isNotNull()).select("qid", "vec"))
        kind = f"qid {asked.schema['qid'].dataType.simpleString()}, vec {asked.schema['vec'].dataType.simpleString()}"
        cells = [c for c in state["cells"] if int(c) != ZERO] + [c for c in state["cells"] if int(c) == ZERO]
        ids, d = np.array([int(c) for c in cells]), len(next(iter(state["centroids"].values())))
        c = np.array([state["centroids"].get(x, [0.0] * d) for x in cells]).reshape(len(cells), d)
        radius = np.array([state["cells"][x]["radius"] for x in cells])
        read: set[str] = set()

        def scan(probe: DataFrame) -> DataFrame:
            probe = checkpointed(probe)
            told = probe.groupBy("cell").count().collect()  # a row for each cell
            here = [str(r["cell"]) for r in told]
            read.update(here)
            if not here:
                return self.spark.createDataFrame([], f"qid {asked.schema['qid'].dataType.simpleString()}, id {self._kind(state, 'id')}, vec double")
            blocks = F.broadcast(self.spark.createDataFrame([(r["cell"], -(-r["count"] // 4096)) for r in told], "cell int, blocks int"))
            folders = [f"{self.path}/{f}" for x in here for f in state["cells"][x]["folders"]]
            rows = self.spark.read.option("basePath", self.path).parquet(*folders).select("id", "vec", F.col("cell").cast("int").alias("cell")).join(blocks, "cell")
            left = probe.join(blocks, "cell").select("qid", "vec", "cell", F.pmod(F.xxhash64("qid"), "blocks").cast("int").alias("block"))
            right = rows.select("id", "vec", F.col("cell").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
            shape = f"qid {asked.schema['qid'].dataType.simpleString()}, id {self._kind(state, 'id')}, vec double"
            met = left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInPandas(_block_scores(k, None, exclude_self), shape)
            return checkpointed(top_k(met, k, "qid", "vec", "id").drop("rank"))

        hits = scan(asked.mapInPandas(_probing(ids, c, radius, probes, k, False), f"{kind}, cell int"))
        if exact:
            worst = hits.groupBy("qid").agg(F.count("*").alias("n"), F.min("vec").alias("worst"))
            open_ = asked.join(worst, "qid", "left").select("qid", "vec", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("worst", F.lit(-2.0)).alias("worst"))
            hits = hits.unionByName(scan(open_.mapInPandas(_probing(ids, c, radius, probes, k, True), f"{kind}, cell int")))
        return Found(top_k(hits, k, "qid", "vec", "id").select("qid", "rank", "id", "vec"), len(read), sum(state["cells"][x]["n"] for x in read))

    def _kind(self, state: dict, name: str) -> str:
        return StructType.fromJson(json.loads(state["kind"]))[name].dataType.simpleString()
