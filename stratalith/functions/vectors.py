"""Column functions over arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norms: Column | None = None) -> Column:
    """Cosine similarity, 0 where a norm is 0; ``norms`` is the norms' product where it is known already."""
    n = norm(a) * norm(b) if norms is None else norms
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def normalize(a: Column) -> Column:
    """The unit vector; a zero vector as it is."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def hybrid_score(vector: Column, lexical: Column, alpha: float = 0.7) -> Column:
    return F.lit(alpha) * vector + F.lit(1 - alpha) * lexical
