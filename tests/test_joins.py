"""As-of and overlap joins against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from stratalith.operators.asof import asof_join
from stratalith.operators.overlap import overlap_join


def brute_asof(left, right):
    out = []
    for k, t, x in left:
        before = [(rt, v) for rk, rt, v in right if rk is not None and rk == k and rt is not None and t is not None and rt <= t]
        out.append((k, t, x, max(before)[1] if before else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_asof_join(spark, parts):
    rng = random.Random(parts)
    left = [(rng.choice(["a", "b", "hot", "hot", "hot", "none", None]), rng.choice([None, *range(60)]), i % 5) for i in range(400)]
    right = [(rng.choice(["a", "b", "hot", "hot", None]), rng.choice([None, *range(20, 90)]), f"v{rng.randrange(30)}") for _ in range(120)]
    df = spark.createDataFrame(left, "path string, found int, row int").withColumnRenamed("found", "at")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = asof_join(df.repartition(parts), spark.createDataFrame(right, "path string, ts int, v string"), ["path"], "at", "ts")
        assert got.columns == ["path", "at", "row", "found"]
        assert sorted(((r[0], r[1], r[2], r[3] and r[3]["v"]) for r in got.collect()), key=repr) == brute_asof(left, right)
        empty = spark.createDataFrame([], "path string, ts int, v string")
        assert {r["found"] for r in asof_join(df, empty, ["path"], "at", "ts").collect()} == {None}
        assert asof_join(df.filter("false"), empty, ["path"], "at", "ts").collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_asof_join_of_one_hot_key_pairs_no_rows(spark):
    """100,000 rows meet 100,000 of one key: ten thousand million pairs, were they compared; and a range beyond the key's commits finds the one before."""
    docs = spark.range(100_000).select(F.lit("hot").alias("path"), (F.col("id") * 2 + 1).alias("at"))
    commits = spark.range(100_000).select(F.lit("hot").alias("path"), F.when(F.col("id") < 50_000, F.col("id") * 2).otherwise(-F.col("id")).alias("ts"))
    got = asof_join(docs, commits, ["path"], "at", "ts")
    assert got.filter("found.ts IS NULL OR found.ts <> least(at - 1, 99998)").count() == 0 and got.count() == 100_000


@pytest.mark.parametrize("parts", [1, 7])
def test_overlap_join(spark, parts):
    rng = random.Random(parts)

    def ranges(n, longest):
        return [(rng.choice(["x", "y", None]), i, a, a + rng.choice([0, 1, 5, rng.randrange(longest), -1])) for i in range(n) for a in [rng.randrange(-3000, 3000)]] + [("x", n, None, 5), ("x", n + 1, 5, None), ("y", n + 2, -(1 << 40), 1 << 40)]

    left, right = ranges(150, 40), ranges(250, 2500)
    schema = "path string, left int, start_line long, end_line long"
    one, two = spark.createDataFrame(left, schema).repartition(parts), spark.createDataFrame(right, schema)
    got = overlap_join(one, two, ["path"]).select("left.left", "right.left").collect()
    want = [(i, j) for k, i, a, b in left for m, j, c, d in right if k is not None and k == m and None not in (a, b, c, d) and a <= b and c <= d and a <= d and c <= b]
    assert sorted(map(tuple, got)) == sorted(want)
    assert overlap_join(one.filter("false"), two, ["path"]).collect() == []


def test_overlap_join_does_not_multiply_long_ranges(spark):
    one = spark.range(1000).select(F.lit("p").alias("path"), (F.col("id") * 1000).alias("start_line"), (F.col("id") * 1000 + 3).alias("end_line"))
    long = spark.range(3).select(F.lit("p").alias("path"), F.lit(0).cast("long").alias("start_line"), F.lit(1 << 40).alias("end_line"))
    assert overlap_join(one, long, ["path"]).count() == 3000
    plan = overlap_join(one, long, ["path"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
