"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of hashed byte n-grams (one to three, words
folded and set apart by one space). Inverse document frequencies come from all
training documents; several spherical k-means centroids of each language from a
bounded sample of its own. A text gets the language of the centroid with the largest
cosine; one that is farther than that centroid's training documents are is
marked as rejected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sampling import hash_limit
from .textvec import classes, code_points, trimmed, utf8_chunks

WIDTH = 4096
GRID = 1 << 20
UNKNOWN = "und"


def _fold_table() -> np.ndarray:
    """Bytes to letters: A-Z to a-z, non-ASCII kept, all else a space."""
    t = np.full(256, 32, np.uint8)
    t[0x61:0x7B] = np.arange(0x61, 0x7B)
    t[0x41:0x5B] = np.arange(0x61, 0x7B)
    t[0x80:] = np.arange(0x80, 0x100)
    return t


FOLD = _fold_table()


def ngram_counts(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Counts of hashed n-grams, one row for each text; none spans two texts."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros((n, width), np.float32)
    folded = FOLD[data]
    row = np.repeat(np.arange(n), np.diff(offsets))
    keep = folded != 32
    keep[1:] |= (folded[:-1] != 32) & (row[1:] == row[:-1])  # one space after a word
    folded, row = folded[keep].astype(np.uint32), row[keep]
    where, key = [np.zeros(0, np.int64)], np.zeros(len(folded), np.uint32)
    for size in (1, 2, 3):
        m = len(folded) - size + 1
        if m <= 0:
            break
        key = key[:m] * np.uint32(257) + folded[size - 1 :]
        same = row[:m] == row[size - 1 :]
        mixed = (key[same] + np.uint32(size)) * np.uint32(2654435761)
        where.append(row[:m][same] * width + (mixed >> np.uint32(16)) % np.uint32(width))
    return np.bincount(np.concatenate(where), minlength=n * width).reshape(n, width).astype(np.float32)


def _row_blocks(data: np.ndarray, offsets: np.ndarray, most: int = 256) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A chunk of many short texts in blocks of rows, so that count matrices stay small."""
    for lo in range(0, len(offsets) - 1, most):
        hi = min(len(offsets) - 1, lo + most)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows; a row without n-grams stays zero."""
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def grid_rows(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows as whole numbers of 1 / GRID, which depend on nothing but the row.

    Logarithms come from a table by count, weights are rounded to whole numbers whose
    squares add up exactly, and products of two such rows do so too, so that neither the rows
    of a block nor the order of summation can change a bit.
    """
    counts = counts.astype(np.int64)
    weight = np.rint(np.log1p(np.arange(int(counts.max(initial=0)) + 1))[counts] * (1024.0 * idf.astype(np.float64)))
    return np.rint(weight / np.maximum(np.sqrt((weight * weight).sum(axis=1, keepdims=True)), 1.0) * GRID)


class Centroids(NamedTuple):
    idf: np.ndarray
    names: list[str]
    language: np.ndarray  # of each centroid
    rows: np.ndarray
    reach: np.ndarray  # least cosine of the training documents of each centroid


def spherical_kmeans(x: np.ndarray, k: int, turns: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, cosine reach) of unit rows; starts from rows far apart, so reruns agree."""
    mean = x.mean(axis=0)
    picked = [int(np.argmax(x @ mean))]
    nearest = x @ x[picked[0]]
    while len(picked) < min(k, len(x)):
        picked.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, x @ x[picked[-1]])
    c = x[picked].copy()
    for _ in range(turns):
        own = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                c[j] = x[own == j].sum(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    cosine = x @ c.T
    own = np.argmax(cosine, axis=1)
    reach = np.array([np.quantile(cosine[own == j, j], 0.005) if (own == j).any() else 1.0 for j in range(len(c))])
    return c, reach


def _frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, seen = np.zeros(WIDTH, np.int64), 0
    for batch in batches:
        for _, _, data, offsets in utf8_chunks(batch.column("text")):
            for _, d, o in _row_blocks(data, offsets):
                total += (ngram_counts(d, o) > 0).sum(axis=0)
                seen += len(o) - 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(WIDTH + 1, dtype=np.int32)), pa.array(np.append(total, seen))], ["gram", "n"])


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in utf8_chunks(batch.column("text")):
            for at, d, o in _row_blocks(data, offsets):
                counts = np.minimum(ngram_counts(d, o), 65535).astype("<u2")
                own = batch.slice(lo + at, len(o) - 1)
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("lang"), pa.array([r.tobytes() for r in counts], pa.binary())], ["doc_id", "lang", "counts"])


def _clustering(idf: np.ndarray, per_language: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        pairs = sorted(zip(rows.column("doc_id").to_pylist(), rows.column("counts").to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        x = unit(np.frombuffer(b"".join(c for _, c in pairs), "<u2").reshape(len(pairs), WIDTH).astype(np.float32), idf)
        x = x[x.any(axis=1)]
        c, far = spherical_kmeans(x, per_language) if len(x) else (np.zeros((0, WIDTH), np.float32), np.zeros(0))
        name = pa.array(rows.column("lang").to_pylist()[: len(c)], pa.string())
        return pa.table([name, pa.array(np.arange(len(c), dtype=np.int32)), pa.array([r.astype("<f4").tobytes() for r in c], pa.binary()), pa.array(far, pa.float64())], ["lang", "k", "row", "reach"])

    return run


def _sample(train: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` distinct rows of each language: those of the smallest hashes.

    A limit on the hash, set by an estimate of each language's rows, lets about
    twice as many through; the sets of these hashes say where a language's sample ends,
    and only texts up to there are moved, each by its own hash. One row for each language
    comes to the driver.
    """
    spark = train.sparkSession
    told = train.groupBy("lang").agg(F.approx_count_distinct("hash", 0.02).alias("n")).collect()
    limit = spark.createDataFrame([(r["lang"], hash_limit(r["n"], sample)) for r in told], "lang string, limit long")
    near = train.join(F.broadcast(limit), "lang").filter(F.col("hash") <= F.col("limit"))
    edges = near.groupBy("lang").agg(F.element_at(F.slice(F.sort_array(F.collect_set("hash")), 1, sample), -1).alias("edge")).collect()
    edge = spark.createDataFrame([(r["lang"], r["edge"]) for r in edges], "lang string, edge long")
    return train.join(F.broadcast(edge), "lang").filter(F.col("hash") <= F.col("edge")).dropDuplicates(["lang", "hash"]).select("doc_id", "lang", "text")


def fit(train: DataFrame, sample: int = 4000, per_language: int = 4) -> Centroids | None:
    """Learns from the columns text and lang. Centroids come from at most ``sample`` documents of each language, however rare, those of the smallest hashes."""
    train = train.filter(F.col("lang").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text").alias("hash"))
    counted = train.select("text").mapInArrow(trimmed(_frequency), "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    frequency = np.zeros(WIDTH + 1, np.int64)
    for r in counted:
        frequency[r["gram"]] = r["n"]
    if not frequency[WIDTH]:
        return None
    idf = (np.log((1 + frequency[WIDTH]) / (1 + frequency[:WIDTH])) + 1).astype(np.float32)
    rows = _sample(train, sample).mapInArrow(trimmed(_counting), "doc_id long, lang string, counts binary")
    found = rows.groupBy("lang").applyInArrow(_clustering(idf, per_language), "lang string, k int, row binary, reach double").collect()
    if not found:
        return None
    found.sort(key=lambda r: (r["lang"], r["k"]))
    names = sorted({r["lang"] for r in found})
    at = {name: i for i, name in enumerate(names)}
    return Centroids(idf, names, np.array([at[r["lang"]] for r in found]), np.stack([np.frombuffer(r["row"], "<f4") for r in found]), np.array([r["reach"] for r in found]))


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    _, cp, places = code_points(data, offsets)
    upto = np.concatenate([[0], np.cumsum(classes()[cp] == 1)])
    return upto[places[1:]] > upto[places[:-1]]


def _predicting(model: Centroids | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, score, rejected = [], [np.zeros(0)], [np.zeros(0, bool)]
            for _, _, data, offsets in utf8_chunks(batch.column("text")):
                for _, d, o in _row_blocks(data, offsets):
                    known = has_letter(d, o) & (model is not None)
                    best = np.zeros(len(known), np.int64)
                    value, far = np.zeros(len(known)), np.ones(len(known), bool)
                    if model is not None:
                        cosine = grid_rows(ngram_counts(d, o), model.idf) @ np.rint(model.rows.T.astype(np.float64) * GRID) / GRID**2
                        best = np.argmax(cosine, axis=1)
                        value = np.clip(cosine[np.arange(len(best)), best], 0, 1)
                        far = value < model.reach[best]
                    name += [model.names[model.language[b]] if k else UNKNOWN for k, b in zip(known, best, strict=True)]
                    score.append(np.where(known, value, 0.0))
                    rejected.append(~known | far)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(name, pa.string()), pa.array(np.concatenate(score)), pa.array(np.concatenate(rejected))], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, sample: int = 4000, per_language: int = 4) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score, rejected.

    held_out is crc32(doc_id as text) mod 3 = 1; such rows and rows without lang
    teach nothing. ``und``, score 0, where the text is null or has no letter, or
    where nothing could be learned. A null doc_id isn't held out. The score is the
    cosine with the nearest centroid; rejected rows keep their nearest language.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = fit(docs.filter(~held), sample, per_language)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(_predicting(model)), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
