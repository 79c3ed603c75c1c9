"""The vector index: recall, what it reads, exact searches, growth."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalith.operators.retrieval import knn
from stratalith.sources.vector_index import VectorIndex


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(60, 24))
    x = middles[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 24)) * 0.35
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7000 + i, x[0].tolist()) for i in range(300)] + [(8000, [0.0] * 24), (8001, None)]
    return spark.createDataFrame(rows, "id long, vec array<double>").repartition(4).cache()


def pairs(df):
    return sorted((r["qid"], r["rank"], r["id"], round(r["vec"], 9)) for r in df.collect())


def test_search(spark, clustered, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "v"), most=400)
    index.insert(clustered.filter("id < 3000"))
    index.insert(clustered.filter("id >= 3000"))
    state = index.log.read()[1]
    total = sum(c["n"] for c in state["cells"].values())
    assert total == 6301 and all(c["n"] <= 400 or k in state["whole"] or k == "-1" for k, c in state["cells"].items())
    queries = clustered.filter("id % 97 = 0 OR id IN (8000, 7001)").select(F.col("id").alias("qid"), "vec")
    want = pairs(knn(queries, clustered, 10, exclude_self=True))
    near = index.search(queries.filter("qid <> 8000"), 10, probes=4, exclude_self=True)
    got = {(q, i) for q, _, i, _ in pairs(near.hits)}
    exact = {(q, i) for q, _, i, _ in want if q != 8000}
    assert len(got & exact) >= 0.95 * len(exact)
    one = index.search(queries.filter("qid = 97"), 10, probes=4)
    assert one.cells == 4 and one.rows < total / 5
    read = index._read(state, list(state["cells"])[:3])
    assert len(read.inputFiles()) < len(index.rows().inputFiles()) / 5  # only folders of the cells asked for
    whole = index.search(queries, 10, probes=4, exact=True, exclude_self=True)
    assert pairs(whole.hits) == want
    assert index.search(queries.filter("qid = 97"), 10, probes=4, exact=True).rows < total
    assert index.rows().count() == 6301


def test_copies_and_zeros_alone(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "v"), most=10)
    rows = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)] + [(60, [0.0, 0.0])], "id long, vec array<double>")
    index.insert(rows)
    q = rows.filter("id IN (3, 60)").select(F.col("id").alias("qid"), "vec")
    assert pairs(index.search(q, 5, exact=True).hits) == pairs(knn(q, rows, 5))
