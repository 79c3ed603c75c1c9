"""Joins of ranges that meet.

A range belongs to the level of the power of two that holds it, where it lies in
one bin or two. It also stands in the bins of the higher levels at which the
other side has ranges of their own, again one or two for each, so that a long range is never
multiplied by its length. Two ranges meet at the higher of their levels, in the
bin where the later of them starts, and nowhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(start: Column, end: Column) -> Column:
    """The least l for which 2 ** l holds the range."""
    size = end - start
    return F.when(size <= 0, 0).otherwise(F.length(F.bin(size))).cast("int")


def _levels(rows: DataFrame) -> list[int]:
    return [r["level"] for r in rows.select("level").distinct().collect()]  # 64 at most


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], start: str = "start_line", end: str = "end_line") -> DataFrame:
    """(left, right) structs of rows with equal keys whose closed ranges meet, each pair once.

    Ranges are of whole numbers; those with a null key or end, or that end before they
    start, meet nothing. Repeated rows are rows of their own.
    """
    keys = [f"k{i}" for i in range(len(on))]

    def known(rows: DataFrame, name: str) -> DataFrame:
        sound = rows.select(F.struct("*").alias(name), *[F.col(c).alias(k) for c, k in zip(on, keys, strict=True)], F.col(start).cast("long").alias("a"), F.col(end).cast("long").alias("b"))
        return sound.dropna(subset=[*keys, "a", "b"]).filter("a <= b").withColumn("level", _level(F.col("a"), F.col("b")))

    one, two = known(left, "left"), known(right, "right")

    def placed(rows: DataFrame, others: list[int]) -> DataFrame:
        above = F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda x: x > F.col("level"))
        at = rows.withColumn("at", F.explode(F.concat(F.array("level"), above)))
        return at.withColumn("bin", F.explode(F.sequence(F.expr("shiftright(a, at)"), F.expr("shiftright(b, at)")))).withColumn("own", F.col("at") == F.col("level"))

    ours = placed(one, _levels(two)).withColumnsRenamed({"a": "a1", "b": "b1", "own": "own1"}).drop("level")
    theirs = placed(two, _levels(one)).withColumnsRenamed({"a": "a2", "b": "b2", "own": "own2"}).drop("level")
    # two joins, so that two short ranges are never compared in the bin of a longer one
    met = ours.filter("own1").join(theirs, [*keys, "at", "bin"]).unionByName(ours.filter("NOT own1").join(theirs.filter("own2"), [*keys, "at", "bin"]))
    return met.filter("a1 <= b2 AND a2 <= b1 AND shiftright(greatest(a1, a2), at) = bin").select("left", "right")


def overlap_totals(left: DataFrame, right: DataFrame, on: list[str], number: str, start: str = "start_line", end: str = "end_line") -> DataFrame:
    """left with n, first and total of ``number`` over the rows of right that each range meets; those that meet none are left out.

    Equal ranges stand for all their rows on either side, so that the join grows
    with the different ranges and not with the pairs of rows.
    """
    names = [*on, start, end]
    there = right.groupBy(*names).agg(F.count("*").alias("n"), F.min(number).alias("first"), F.sum(number).alias("total"))
    met = overlap_join(left.select(*names).distinct(), there, on, start, end)
    told = met.groupBy(*[F.col(f"left.{c}").alias(c) for c in names]).agg(F.sum("right.n").alias("n"), F.min("right.first").alias("first"), F.sum("right.total").alias("total"))
    return left.join(told, names)
