"""As-of joins: each row with the last row of another table, of its key, up to its time.

Both tables are put in one order by key and time, over ranges, and the last row
seen is carried along; no two rows are ever paired to be compared. A key with very
many rows is spread over ranges: the last row of a range goes to those after it
that begin with the same key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..checkpoints import checkpointed

ANSWERED, OPEN, TAIL = 0, 1, 2


def _carrying(on: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [*on, "row", "found", "part", "kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, begun, part, tail = None, None, False, None, None  # the last row of the present key; whether a second key has come
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            keys = [batch.column(c) for c in on]
            new = np.zeros(n, bool)
            for c in keys:
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            now = tuple(c[0].as_py() for c in keys)
            new[0] = key is not None and key != now
            own = batch.column("found").is_valid().to_numpy(zero_copy_only=False)
            at = np.arange(n)
            begin, last = np.maximum.accumulate(np.where(new, at, -1)), np.maximum.accumulate(np.where(own, at, -1))
            hit = np.where((last >= 0) & (last >= begin), last, -1)
            source = batch.column("found")
            if held is not None:
                source = pa.concat_arrays([source, held])
                hit = np.where((hit < 0) & (begin < 0), n, hit)
            index = pa.array(hit, mask=hit < 0)
            later = begun | (begin >= 0)  # of another key than the range's first
            kind = np.where((hit < 0) & ~later, OPEN, ANSWERED).astype(np.int32)
            asked = np.flatnonzero(~own)
            pick = pa.array(asked)
            yield pa.RecordBatch.from_arrays([*(c.take(pick) for c in keys), batch.column("row").take(pick), source.take(index.take(pick)), batch.column("part").take(pick), pa.array(kind[asked])], names)
            held = source.take(pa.array([int(hit[-1])])) if hit[-1] >= 0 else None
            begun, part, tail = bool(later[-1]), batch.column("part").slice(n - 1), batch.slice(n - 1)
            key = tuple(c[n - 1].as_py() for c in keys)
        if held is not None:
            nothing = tail.column("row").filter(pa.array([False]))
            yield pa.RecordBatch.from_arrays([*(tail.column(c) for c in on), pa.concat_arrays([nothing, pa.nulls(1, nothing.type)]), held, part, pa.array([TAIL], pa.int32())], names)

    return run


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, each: int = 250_000) -> DataFrame:
    """left with a column ``found``: the last row of right with its key and a time up to its own, as a struct, or null.

    Of right's rows with one key and time the largest counts. Rows of left with a
    null key or time, or without an earlier row, find nothing; repeated rows are
    answered each, and all of left's columns are kept, whatever their names. A range
    holds about ``each`` rows, however many there are.
    """
    keys = [f"__k{i}" for i in range(len(on))]
    keyed = lambda rows, time: [*[F.col(c).alias(k) for c, k in zip(on, keys, strict=True)], F.col(time).alias("__t")]
    whole = left.select(F.struct("*").alias("row"), *keyed(left, left_time))
    known = lambda rows: rows.dropna(subset=[*keys, "__t"])
    told = known(right.select(F.struct("*").alias("found"), *keyed(right, right_time))).groupBy(*keys, "__t").agg(F.max("found").alias("found"))
    row, found = whole.schema["row"].dataType, told.schema["found"].dataType
    asked = known(whole).withColumn("found", F.lit(None).cast(found))
    order = [*keys, "__t", F.col("found").isNull(), F.monotonically_increasing_id()]
    both = told.select("*", F.lit(None).cast(row).alias("row")).select(asked.columns).unionByName(asked)
    both = checkpointed(both)  # read for its number, for the ranges and for its rows
    dealt = both.repartitionByRange(max(1, -(-both.count() // each)), *order).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*keys, "__t", F.col("found").isNull())
    shape = StructType([*(whole.schema[k] for k in keys), StructField("row", row), StructField("found", found), StructField("part", IntegerType()), StructField("kind", IntegerType())])
    out = checkpointed(dealt.select(*keys, "row", "found", "part").mapInArrow(_carrying(keys), shape))
    heads = out.filter(F.col("kind") == OPEN).select(*keys, "part").distinct().withColumn("found", F.lit(None).cast(found)).withColumn("after", F.lit(0))
    tails = out.filter(F.col("kind") == TAIL).select(*keys, "part", "found", F.lit(1).alias("after"))
    upto = Window.partitionBy(*keys).orderBy("part", "after").rowsBetween(Window.unboundedPreceding, 0)  # two rows for each range at most
    carried = heads.unionByName(tails).withColumn("found", F.last("found", ignorenulls=True).over(upto)).filter("after = 0").select(*keys, "part", F.col("found").alias("carried"))
    open_ = out.filter(F.col("kind") == OPEN).join(carried, [*keys, "part"], "left").select("row", F.col("carried").alias("found"))
    unknown = whole.filter(" OR ".join(f"{k} IS NULL" for k in [*keys, "__t"])).select("row", F.lit(None).cast(found).alias("found"))
    return out.filter(F.col("kind") == ANSWERED).select("row", "found").unionByName(open_).unionByName(unknown).select("row.*", "found")

