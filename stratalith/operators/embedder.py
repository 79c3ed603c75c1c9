"""A fitted embedder: TF-IDF of hashed words, projected by a distributed randomised SVD.

Document frequencies of a bounded number of slots count all documents. Two passes
over a sample of the documents multiply the matrix and its transpose with a narrow
one; each task adds up its own part, in whole numbers, so that the sums and the model
do not depend on partitions. What the driver holds is as large as the slots, not the
documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..functions.text import tokenize
from .retrieval import top_k

SLOTS = 4096
GRID = float(1 << 24)


class Embedder(NamedTuple):
    idf: np.ndarray
    basis: np.ndarray  # a row for each slot

    def weigh(self, slots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, slot, weight) of the unit TF-IDF rows of these documents."""
        sizes = np.array([len(s) for s in slots], np.int64)
        row = np.repeat(np.arange(len(slots)), sizes)
        flat = np.concatenate([np.zeros(0, np.int64), *[np.asarray(s, np.int64) for s in slots]])
        key, tf = np.unique(row * len(self.idf) + flat, return_counts=True)
        row, slot = np.divmod(key, len(self.idf))
        weight = (1 + np.log(tf)) * self.idf[slot]
        norm = np.sqrt(np.bincount(row, weight * weight, minlength=len(slots)))
        return row, slot, weight / norm[row]

    def project(self, slots: list[np.ndarray], basis: np.ndarray) -> np.ndarray:
        """The rows times a matrix with a row for each slot."""
        row, slot, weight = self.weigh(slots)
        out = np.zeros((len(slots), basis.shape[1]))
        if len(row):
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            out[row[starts]] = np.add.reduceat(basis[slot] * weight[:, None], starts, axis=0)
        return out


def slots_of(text: Column, n: int = SLOTS) -> Column:
    """The slot of each word of a text."""
    return F.transform(F.coalesce(tokenize(text), F.array().cast("array<string>")), lambda t: F.pmod(F.xxhash64(t), F.lit(n)).cast("int"))


def _multiplying(model: Embedder, narrow: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A task's part of the transpose times the matrix times a narrow one, in whole numbers: a row for each slot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(narrow.shape, np.int64)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                slots = batch["slots"].iloc[lo : lo + 256].tolist()
                row, slot, weight = model.weigh(slots)
                part = np.rint(model.project(slots, narrow)[row] * weight[:, None] * GRID).astype(np.int64)
                np.add.at(total, slot, part)
        some = np.flatnonzero(total.any(axis=1))
        yield pd.DataFrame(total[some], columns=[f"c{i}" for i in range(narrow.shape[1])]).assign(slot=some.astype(np.int32))

    return run


def fit_embedder(docs: DataFrame, size: int = 64, sample: int = 20_000, more: int = 16, rounds: int = 2, seed: int = 1) -> Embedder:
    """Learns from docs (text): frequencies of all, directions from the ``sample`` texts of the smallest hashes. Null and empty texts teach nothing; without any text the basis is zero."""
    said = docs.select(F.col("text").cast("string").alias("text")).filter("length(text) > 0")
    counted = said.select(F.explode(F.array_distinct(slots_of(F.col("text")))).alias("slot")).groupBy("slot").agg(F.count("*").alias("df")).collect()  # a row for each slot
    df = np.zeros(SLOTS)
    for r in counted:
        df[r["slot"]] = r["df"]
    idf = np.log((1 + said.count()) / (1 + df)) + 1
    model, wide = Embedder(idf, np.zeros((SLOTS, size))), size + more
    rows = checkpointed(said.select("text", F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(sample).repartition("h").select(slots_of(F.col("text")).alias("slots")))  # for all rounds
    narrow = np.linalg.qr(np.random.default_rng(seed).standard_normal((SLOTS, wide)))[0]
    names = [f"c{i}" for i in range(wide)]
    for turn in range(rounds):
        parts = rows.mapInPandas(_multiplying(model, narrow), ", ".join(f"{c} long" for c in names) + ", slot int")
        product = np.zeros((SLOTS, wide))
        for r in parts.groupBy("slot").agg(*[F.sum(c).alias(c) for c in names]).collect():  # a row for each slot
            product[r["slot"]] = [r[c] / GRID for c in names]
        if turn == rounds - 1:
            values, vectors = np.linalg.eigh((narrow.T @ product + product.T @ narrow) / 2)
            best = np.argsort(-values)[:size]
            basis = narrow @ vectors[:, best]
            return Embedder(idf, basis * (values[best] > 1e-9) / np.sqrt(np.sqrt(np.maximum(values[best], 1e-9))))
        narrow = np.linalg.qr(product)[0]
    return model


def _embedding(model: Embedder) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [np.zeros((0, model.basis.shape[1]))]
            for lo in range(0, len(batch), 256):
                x = model.project(batch["slots"].iloc[lo : lo + 256].tolist(), model.basis)
                n = np.sqrt((x * x).sum(axis=1, keepdims=True))
                out.append(np.divide(x, n, out=np.zeros_like(x), where=n > 0))
            yield pd.DataFrame({"id": batch["id"], "vec": list(np.concatenate(out))})

    return run


def embed(docs: DataFrame, model: Embedder) -> DataFrame:
    """(id, vec) unit vectors of docs (id, text); a text without words has the zero vector."""
    rows = docs.select("id", slots_of(F.col("text").cast("string")).alias("slots"))
    return rows.mapInPandas(_embedding(model), f"id {docs.schema['id'].dataType.simpleString()}, vec array<double>")


def rerank(hits: DataFrame, queries: DataFrame, docs: DataFrame, model: Embedder, k: int = 10) -> DataFrame:
    """(qid, rank, id, score): candidates (qid, id) of queries (qid, text) anew by the cosine of the model's vectors; the k best of each."""
    asked = embed(queries.withColumnRenamed("qid", "id"), model).select(F.col("id").alias("qid"), F.col("vec").alias("q"))
    wanted = docs.join(hits.select("id").distinct(), "id", "left_semi")  # only candidates are embedded
    pairs = hits.select("qid", "id").join(asked, "qid").join(embed(wanted, model), "id")
    cosine = F.aggregate(F.zip_with("q", "vec", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return top_k(pairs.select("qid", "id", cosine.alias("score")), k, "qid", "score", "id").select("qid", "rank", "id", "score")


def halves(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each text (id, text) as its words of odd and of even place: a good embedder finds the one by the other."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    part = lambda k: docs.select("id", F.array_join(F.filter(words, lambda w, i: i % 2 == k), " ").alias("text"))
    return part(0), part(1)
