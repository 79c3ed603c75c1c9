"""Running numbers over a whole table without one task that sorts it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import checkpointed


def numbered(rows: DataFrame, order: list[Column | str], name: str = "n") -> DataFrame:
    """rows with the place of each in an order, from 0.

    Ranges are sorted and numbered on their own; only the count of each range comes
    to the driver, and goes back as its offset.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    marks = [f"__o{i}" for i in range(len(keys))]
    keyed = rows.withColumns(dict(zip(marks, keys, strict=True)))
    dealt = checkpointed(keyed.repartitionByRange(*marks).withColumn("__range", F.spark_partition_id()))
    offsets, upto = [], 0
    for r in sorted(dealt.groupBy("__range").count().collect()):
        offsets.append((r["__range"], upto))
        upto += r["count"]
    table = rows.sparkSession.createDataFrame(offsets, "__range int, __before long")
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*marks)) - 1
    return dealt.join(F.broadcast(table), "__range").withColumn(name, F.col("__before") + place).drop("__range", "__before", *marks)  # a row for each range
