"""Joins that no hot key sends to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_HOT = 1000


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], n: str, total: int, once: bool = False) -> DataFrame:
    """rows joined with a table of one row for each key, whose column ``n`` says how many of the ``total`` rows hold it at most.

    Keys that a thousandth of all rows hold, of which there can be no more than a
    thousand, are broadcast, so that their rows stay where they are; the others
    are dealt by key. ``n`` itself is left out. With ``once``, rows that repeat a
    key are one. The join of the others is a sort-merge join at every size, so that
    what is moved grows with the rows alone and not with what happens to be ready first.
    """
    hot = table.filter(F.col(n) * MOST_HOT >= F.lit(total)).drop(n)
    rest = table.filter(F.col(n) * MOST_HOT < F.lit(total)).drop(n)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    near, far = rows.join(F.broadcast(hot), on), cold.join(rest.hint("merge"), on)
    return near.dropDuplicates(on).unionByName(far.dropDuplicates(on)) if once else near.unionByName(far)


def small(table: DataFrame, most: int = 100_000) -> DataFrame:
    """A table of a few numbers a row, to be broadcast if its count, checked here, allows it."""
    return F.broadcast(table) if table.count() <= most else table
