"""Bounded samples by hash, whose size at the driver doesn't grow with rows or partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOWEST, SPAN = -(1 << 63), 1 << 64


def hash_limit(distinct: int, most: int) -> int:
    """A 64-bit hash below which about twice ``most`` of ``distinct`` hashes lie."""
    share = min(1.0, (2 * most + 64) / max(distinct, 1))
    return min(LOWEST + int(share * SPAN), -LOWEST - 1)


def smallest_hashes(rows: DataFrame, most: int) -> DataFrame:
    """One row for each of the ``most`` smallest values of the column ``hash``, a hash of all that counts in a row.

    A limit on the hash, set by an estimate of how many there are, lets about twice
    as many rows through; only those are sorted, so that no partition sends
    ``most`` rows of its own.
    """
    distinct = rows.agg(F.approx_count_distinct("hash", 0.02).alias("n")).first()["n"]
    near = rows.filter(F.col("hash") <= hash_limit(distinct, most)).dropDuplicates(["hash"])
    return near.orderBy("hash").limit(most)
