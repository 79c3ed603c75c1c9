"""The fitted embedder: deterministic, and better than the hashed bag at finding a text by half of its words."""

import numpy as np
from pyspark.sql import functions as F

from stratalith.functions.text import tokenize
from stratalith.operators import embedder
from stratalith.operators.extraction import hashed_embedding
from stratalith.operators.retrieval import knn

SF = "/root/testdata/sf0.001"


def hit_share(odd, even):
    """How many texts' nearest other half is their own."""
    hits = knn(odd.select(F.col("id").alias("qid"), "vec"), even, 1)
    return hits.filter("qid = id").count() / odd.count()


def test_neighbours(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text").dropDuplicates(["text"]).filter("length(text) > 200")
    model = embedder.fit_embedder(docs)
    again = embedder.fit_embedder(docs.repartition(7))
    assert (model.basis == again.basis).all() and (model.idf == again.idf).all()
    odd, even = embedder.halves(docs)
    bag = lambda df: df.select("id", hashed_embedding(tokenize(F.col("text"))).alias("vec"))
    fitted, plain = hit_share(embedder.embed(odd, model), embedder.embed(even, model)), hit_share(bag(odd), bag(even))
    print("share of halves found: fitted", fitted, "hashed", plain)
    assert fitted > plain + 0.05
    queries = odd.filter("id % 40 = 0").withColumnRenamed("id", "qid")
    hits = queries.select("qid").crossJoin(docs.filter("id % 10 = 0").select("id"))
    top = embedder.rerank(hits, queries, docs, model, 1).collect()
    assert len(top) == queries.count() and sum(r["qid"] == r["id"] for r in top) >= 0.7 * len(top)


def test_awkward_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "?!"), (4, "alpha beta alpha"), (5, "alpha beta alpha"), (6, "gamma delta " * 5000)], "id long, text string")
    model = embedder.fit_embedder(docs, size=4)
    got = {r["id"]: np.array(r["vec"]) for r in embedder.embed(docs, model).collect()}
    assert len(got) == 6 and not got[1].any() and not got[2].any() and not got[3].any()
    assert (got[4] == got[5]).all() and abs(np.linalg.norm(got[6]) - 1) < 1e-9 and abs(got[4] @ got[6]) < 0.5
    assert not embedder.fit_embedder(docs.filter("false"), size=4).basis.any()
