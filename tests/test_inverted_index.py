"""The inverted index against scores of every document, what it reads, and documents replaced."""

import random

from pyspark.sql import functions as F

from stratalith.operators.retrieval import bm25_scores, top_k
from stratalith.sources.inverted_index import InvertedIndex


def hits(df):
    return sorted((r["qid"], r["rank"], r["id"], round(r["bm25"], 6)) for r in df.collect())


def test_search_and_update(spark, tmp_path):
    rng = random.Random(4)
    words = [f"word{int(rng.paretovariate(0.7)) % 400}" for _ in range(60_000)]
    texts = [(i, " ".join(words[i * 20 : i * 20 + rng.randrange(1, 20)]) + (f" rare{i % 40} rare{i % 40} rare{i % 40}" if 500 <= i < 540 else "")) for i in range(2500)]
    docs = spark.createDataFrame([*texts, (9000, None), (9001, "")], "id long, text string")
    queries = spark.createDataFrame([(1, "rare7 word1 word2"), (2, "word3 word3 word1"), (3, "nothing known"), (4, None), (5, "rare1 rare2 word5 word6 word7 word8")], "qid int, text string")
    index = InvertedIndex(spark, str(tmp_path / "i"), per_block=32, buckets=8)
    index.update(docs)
    want = lambda d: hits(top_k(bm25_scores(queries, d).withColumn("bm25", F.round("bm25", 9)), 10, "qid", "bm25", "id"))
    found = index.search(queries, 10, digits=9)
    assert hits(found.hits) == want(docs)
    few = index.search(queries.filter("qid = 1"), 1, digits=9)
    assert few.read < few.postings / 2  # most blocks of frequent terms cannot matter
    changed = docs.filter("id % 5 = 0").withColumn("text", F.concat(F.lit("rare7 word3 "), F.coalesce("text", F.lit(""))))
    index.update(changed)
    index.update(spark.createDataFrame([(3, ""), (9002, "rare7 rare7")], "id long, text string"))
    now = docs.filter("id % 5 <> 0 AND id <> 3").unionByName(changed).unionByName(spark.createDataFrame([(3, ""), (9002, "rare7 rare7")], "id long, text string"))
    assert hits(index.search(queries, 10, digits=9).hits) == want(now)
    empty = InvertedIndex(spark, str(tmp_path / "none"))
    assert empty.search(queries).hits.collect() == []
