"""What the two vector operators share: which vectors take part, and a bounded sample of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import smallest_hashes


def valid_vectors(rows: DataFrame, d: int | None = None) -> tuple[DataFrame, int]:
    """The rows whose vector takes part, and the dimension.

    Not null, all components there and finite, not zero, and of length ``d``, else
    of that which most vectors have (the longer of equals).
    """
    v = F.col("embedding")
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = rows.filter(F.col("vec_id").isNotNull() & sound)
    if d is None:
        most = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        d = most["d"] if most else 0
    return rows.filter(F.size("embedding") == d), d


def matrix(column: pd.Series, d: int) -> np.ndarray:
    """A column of vectors as rows in double precision."""
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, d))


def sample_of(rows: DataFrame, most: int, d: int) -> np.ndarray:
    """At most ``most`` distinct vectors, those of the smallest hashes, one for each line."""
    found = smallest_hashes(rows.select("embedding", F.xxhash64("embedding").alias("hash")), most).collect()
    return np.array([r["embedding"] for r in sorted(found, key=lambda r: r["hash"])], np.float64).reshape(len(found), d)
