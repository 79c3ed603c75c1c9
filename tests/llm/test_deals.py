"""Repeated rows are dealt out, and no result depends on the order or the batches of rows."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from stratalith.llm import source_mixing
from stratalith.llm.best_fit_packing import PIECES, pack
from stratalith.llm.language_id import WIDTH, Centroids, _predicting, grid_rows, ngram_counts
from stratalith.llm.source_mixing import mix, mixed_documents

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pieces_without_ids_are_dealt_out(spark):
    pieces = spark.range(60_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(300).cast("long").alias("length"), F.lit(1).cast("long").alias("ids_crc32"))
    got = pack(pieces, per_part=2000, rounds=2)
    assert got.columns == [*[c.split()[0] for c in PIECES.split(", ")], "sequence_id", "offset", "bins", "bound"]
    by = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.countDistinct("offset").alias("o"))
    assert got.count() == 60_000 and by.filter("n > 1024 OR k <> o").count() == 0
    assert by.count() <= 20_000 + 40  # three to a sequence, and one that isn't full for each partition
    assert got.filter("bins < 2 * bound").agg(F.max("bins")).first()[0] < 2000  # about 667 for 2,000 pieces


def test_repeated_rows_of_the_mix(spark):
    rows = [(None, None, "en", "a", 1)] * 3000 + [(None, "one two three", "en", "a", 1)] * 9000 + [(i, "four five", "en", "b", 1) for i in range(500)]
    docs = spark.createDataFrame(rows, DOCS)
    one, two = (sorted(mix(docs.repartition(n), per_chunk=1000).drop("doc_id").collect(), key=repr) for n in (1, 6))
    assert one == two and len(one) == len(rows)
    target = {r["source"]: r["target"] for r in one}
    assert all(abs(sum(r["taken"] for r in one if r["source"] == s) - target[s]) <= 3 for s in target)


def test_texts_of_one_id_are_stable(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdefgh", k=10)) for _ in range(40)]
    rows = [(5, t, "en", "b", 7) for t in texts] + [(6, "same text here", "en", "c", i % 3) for i in range(30)] + [(None, "w x", "en", None, 1), (-(1 << 63), "w x", "en", None, 2)]
    docs = spark.createDataFrame(rows, DOCS)
    want = None
    for df, few in ((docs.orderBy("text"), 10_000), (docs.orderBy(F.desc("text")).repartition(5), 10_000), (docs, 5)):
        monkeypatch.setattr(source_mixing, "FEW", few)
        got = sorted(map(tuple, mixed_documents(df).collect()), key=repr)
        want = want or got
        assert got == want
    told = {r[0]: r[1] for r in mix(docs).groupBy("doc_id").agg(F.sum("copies")).collect()}
    assert all(sum(r[0] == i for r in want) == n for i, n in told.items())


def test_languages_do_not_depend_on_batches():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcdefgh éß "), int(n))) for n in rng.integers(0, 300, 200)]
    centroids = rng.random((12, WIDTH)).astype(np.float32)
    centroids /= np.linalg.norm(centroids, axis=1, keepdims=True)
    model = Centroids(rng.random(WIDTH).astype(np.float32) + 1, ["x", "y"], np.arange(12) % 2, centroids, np.full(12, 0.5))
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array([False] * 200), pa.array(texts)], ["doc_id", "held_out", "text"])
    run = _predicting(model)
    whole = pa.Table.from_batches(run(iter([batch])))
    for size in (1, 7, 64):
        assert pa.Table.from_batches(run(batch.slice(i, size) for i in range(0, 200, size))).to_pylist() == whole.to_pylist()
    x = grid_rows(ngram_counts(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])), model.idf)
    assert (x == np.rint(x)).all() and np.abs(np.linalg.norm(x[np.any(x, axis=1)], axis=1) / (1 << 20) - 1).max() < 1e-4
