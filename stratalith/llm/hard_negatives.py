"""Hard negatives by a Voronoi-partitioned distributed nearest-neighbour join.

Vectors of integers gain one component that gives all of them the largest norm,
so that the largest inner product is the smallest distance. Anchors fall into
the Voronoi cells of a bounded sample of pivots; a cell is known by its radius,
the norms of its anchors and the scores they look for. By the triangle
inequality, with and without the added component, a cell bounds what its anchors
can have in common with a candidate, and the candidate is sent to those cells
alone that it might serve. Cells are joined exactly in blocks of anchors and
candidates: first the best of the same label, whose worst possible scores bound
the search; then, under each of those, the best of other labels within a range
of its score.

Equal anchors of a label are one class, and of equal candidates of a label only
the smallest ids can be among the first few, so no group of copies is large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sampling import smallest_hashes
from .session import checkpointed, parts
from .spread import spread_join

LARGEST = float(1 << 56)  # a hundred times a squared norm below this is a long
EXACT = float(1 << 53)  # below this, products of integers are exact in double precision
LABELS_HELD = 1024
ROWS = "vec_id long, label string, v array<int>"


def padded(column: pd.Series, d: int) -> np.ndarray:
    """Lists of integers as rows of d; what a shorter one lacks is 0."""
    if all(len(x) == d for x in column):
        return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, d))
    out = np.zeros((len(column), d))
    for i, x in enumerate(column):
        out[i, : len(x)] = x
    return out


def inner(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products of all rows of two tables, as integers."""
    if largest < EXACT:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Cells:
    """Pivots, and for each what is known of the anchors of its cell."""

    def __init__(self, pivots: np.ndarray, largest: float):
        n = len(pivots)
        self.pivots, self.largest, self.square = pivots, largest, (pivots * pivots).sum(axis=1)
        self.radius, self.norm, self.low, self.high = np.full(n, -1.0), np.zeros(n), np.full(n, np.inf), np.full(n, -np.inf)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its pivot) of anchors."""
        cell = np.argmin(self.square - 2 * (x @ self.pivots.T), axis=1)
        return cell, np.sqrt(((x - self.pivots[cell]) ** 2).sum(axis=1))

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) score of candidates with any anchor of each cell, a little wider for rounding."""
        at = x @ self.pivots.T
        size = np.sqrt((x * x).sum(axis=1))[:, None]
        slack = 1e-9 * size * (np.sqrt(self.square) + self.radius) + 1
        # norm-augmented: candidates have the largest norm, anchors and pivots a 0 there
        apart = np.sqrt(np.maximum(self.largest + self.square - 2 * at, 0))
        beyond = np.maximum(apart - self.radius, 0)
        most = np.minimum(at + self.radius * size, (self.norm + self.largest - beyond**2) / 2 + 1e-9 * (self.norm + self.largest))
        return at - self.radius * size - slack, most + slack


def _celling(cells: Cells) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = padded(batch["v"], cells.pivots.shape[1])
            cell, far = cells.nearest(x)
            yield batch.assign(cell=cell.astype(np.int32), far=far, norm=(x * x).sum(axis=1))

    return run


def _thresholds(cells: Cells, most: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The ``most`` largest least scores of each label and cell that a task has seen; handed on when there are many labels."""
    inside = np.flatnonzero(cells.radius >= 0)

    def rows(held: dict[str, np.ndarray]) -> pd.DataFrame:
        found = [(label, int(c), float(x)) for label, table in held.items() for c, own in zip(inside, table, strict=True) for x in own if x > -np.inf]
        return pd.DataFrame(found, columns=["label", "cell", "score"]).astype({"label": "object", "cell": "int32", "score": "float64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            least = cells.bounds(padded(batch["v"], cells.pivots.shape[1]))[0][:, inside]
            for label, at in batch.groupby("label", sort=False).indices.items():
                own = np.concatenate([held.get(label, np.full((most, len(inside)), -np.inf).T), least[at].T], axis=1)
                held[label] = -np.partition(-own, most - 1, axis=1)[:, :most]
                if len(held) >= LABELS_HELD:
                    yield rows(held)
                    held = {}
        yield rows(held)

    return run


def _sending(cells: Cells, by_label: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each candidate once for every cell that it might serve: above the label's threshold there, or within the cell's range of scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 1024):
                batch = whole.slice(lo, 1024)
                least, most = cells.bounds(padded(batch.column("v").to_pandas(), cells.pivots.shape[1]))
                if by_label:
                    floor = np.stack(batch.column("floor").to_pandas().to_numpy())
                    serves = most >= floor
                else:
                    serves = (most >= cells.low) & (least <= cells.high)
                row, cell = np.nonzero(serves & (cells.radius >= 0))
                sent = batch.select(["vec_id", "label", "v"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(cell.astype(np.int32))], ["vec_id", "label", "v", "cell"])

    return run


def _first(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, largest first, equal ones in their order."""
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        near = np.arange(len(scores))
    return near[np.argsort(-scores[near], kind="stable")[:k]]


def _best_of_label(d: int, largest: float, k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The k best of each anchor's own label; an anchor that is a class by itself isn't its own."""

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable")
        out: list[tuple[int, int, int]] = []
        own = rows.groupby("label", sort=False).indices
        for label, at in asked.groupby("label", sort=False).indices.items():
            if label not in own:
                continue
            ids, x = rows["vec_id"].to_numpy()[own[label]], padded(rows["v"].iloc[own[label]], d)
            for lo in range(0, len(at), 256):
                some = asked.iloc[at[lo : lo + 256]]
                for node, alone, s in zip(some["node"].tolist(), some["alone"].tolist(), inner(padded(some["v"], d), x, largest), strict=True):
                    near = [j for j in _first(s, k + 1).tolist() if not (alone and ids[j] == node)][:k]
                    out += [(node, int(ids[j]), int(s[j])) for j in near]
        return pd.DataFrame(out, columns=["node", "vec_id", "score"]).astype("int64")

    return run


def _under_positives(d: int, largest: float, k: int, low: int, high: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """For each anchor and each score of its positives the k best of other labels within the range below it."""

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable")
        ids, labels, x = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), padded(rows["v"], d)
        out: list[tuple[int, int, int, int]] = []
        for lo in range(0, len(asked), 256):
            some = asked.iloc[lo : lo + 256]
            products = inner(padded(some["v"], d), x, largest)
            for node, label, tops, s in zip(some["node"].tolist(), some["label"].tolist(), some["tops"].tolist(), products, strict=True):
                near = np.flatnonzero((high * s >= low * min(tops)) & (s <= max(tops)))
                near = near[labels[near] != label]
                near = near[np.argsort(-s[near], kind="stable")]
                ranked = s[near]
                for top in sorted(set(tops)):
                    begin = int(np.searchsorted(-ranked, -top, "left"))
                    out += [(node, top, int(ids[j]), int(s[j])) for j in near[begin : begin + k].tolist() if high * int(s[j]) >= low * top]
        return pd.DataFrame(out, columns=["node", "top", "vec_id", "score"]).astype("int64")

    return run


def _joined(sent: DataFrame, asked: DataFrame, sizes: dict[int, int], per_block: int, per_anchors: int, run: Callable, schema: str) -> DataFrame:
    """Blocks of a cell's candidates with blocks of its anchors."""
    spark = sent.sparkSession
    counts = {r["cell"]: r["count"] for r in sent.groupBy("cell").count().collect()}  # a row for each pivot
    table = lambda: F.broadcast(spark.createDataFrame([(c, parts(n, per_block), parts(sizes[c], per_anchors)) for c, n in counts.items()], "cell int, here long, there long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = sent.join(table(), "cell").select("*", F.pmod(F.xxhash64("vec_id"), "here").alias("block"), every("there").alias("group"))
    right = asked.join(table(), "cell").select("*", every("here").alias("block"), F.pmod(F.xxhash64("node"), "there").alias("group"))
    key = ["cell", "block", "group"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(lambda a, b: run(a, b), schema)


def _ranked(found: DataFrame, of: list[str], k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, per_pivot: int = 64, least_pivots: int = 8, most_pivots: int = 1024, per_block: int = 16_384, per_anchors: int = 1024
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Scores are inner products of the components times ``scale``, floored. The
    positives of a row for which ``anchor`` holds are its best other rows of the same
    label; under each of them, the best rows of other labels are listed that score
    ``low`` to ``high`` hundredths of it. Ties go to the smaller vec_id.
    Rows with a null vec_id, label or vector or a null or non-finite component take no
    part, nor do those whose squared norm reaches 2**56 after scaling (their scores need
    not fit). Zero vectors take part; a shorter vector counts as filled up with
    zeros. Rows that repeat a vec_id are one, the smallest by label and vector.
    No anchors, or none with both, give no rows.
    """
    spark = rows.sparkSession
    v = F.col("embedding").cast("array<double>")
    sound = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) * F.lit(float(scale)) < F.lit(float(1 << 28))), F.lit(False)))
    valid = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))
    whole = valid.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("int")).alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    whole = whole.withColumn("norm", norm).filter(F.col("norm") < LARGEST)
    one = whole.groupBy("vec_id").agg(F.min(F.struct("label", "v", "norm")).alias("r"), F.max("anchor").alias("anchor")).select("vec_id", "r.*", "anchor")
    own = checkpointed(one.select("*", *[F.xxhash64("label", "v", F.lit(s)).alias(h) for s, h in ((1, "h1"), (2, "h2"))]))
    seen = own.agg(F.max("norm").alias("largest"), F.max(F.size("v")).alias("d"), F.count_if("anchor").alias("asked")).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not seen["asked"]:
        return spark.createDataFrame([], schema)
    d, largest = max(seen["d"], 1), seen["largest"]
    copies = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    few = checkpointed(own.withColumn("n", copies).filter(F.col("n") <= max(positives + 1, negatives)).select("vec_id", "label", "v"))
    member = own.filter("anchor").select("vec_id", "h1", "h2")
    classes = own.filter("anchor").groupBy("h1", "h2").agg(F.min(F.struct("vec_id", "label", "v")).alias("r"), F.count("*").alias("n")).select("h1", "h2", "n", F.col("r.vec_id").alias("node"), "r.label", "r.v")
    want = min(max(least_pivots, seen["asked"] // per_pivot), most_pivots)
    chosen = smallest_hashes(few.select("v", F.xxhash64("v").alias("hash")), want).collect()
    cells = Cells(padded(pd.Series([r["v"] for r in sorted(chosen, key=lambda r: r["hash"])]), d), largest)
    asked = checkpointed(classes.select("h1", "h2", "n", "node", "label", "v").mapInPandas(_celling(cells), "h1 long, h2 long, n long, node long, label string, v array<int>, cell int, far double, norm double"))
    sizes = {}
    for r in asked.groupBy("cell").agg(F.max("far").alias("far"), F.max("norm").alias("norm"), F.count("*").alias("n")).collect():  # a row for each pivot
        cells.radius[r["cell"]], cells.norm[r["cell"]], sizes[r["cell"]] = r["far"], r["norm"], r["n"]

    found = few.mapInPandas(_thresholds(cells, positives + 1), "label string, cell int, score double").withColumn("vec_id", F.lit(0))
    floor = _ranked(found, ["label", "cell"], positives + 1).groupBy("label", "cell").agg(F.when(F.count("*") > positives, F.min("score")).otherwise(float("-inf")).alias("score"))
    there = asked.select("label", "cell").distinct().join(floor, ["label", "cell"])  # a label has no threshold, and sends nothing, where it has no anchors
    by_cell = F.map_from_entries(F.collect_list(F.struct("cell", "score")))
    bounds = there.groupBy("label").agg(by_cell.alias("at")).select("label", F.transform(F.sequence(F.lit(0), F.lit(len(cells.pivots) - 1)), lambda c: F.coalesce(F.col("at")[c], F.lit(float("inf")))).alias("floor"))
    sizes_of = few.groupBy("label").agg(F.count("*").alias("n"))
    total = few.count()
    near = spread_join(few, checkpointed(bounds.join(sizes_of, "label")), ["label"], "n", total)
    sent = checkpointed(near.select("vec_id", "label", "v", "floor").mapInArrow(_sending(cells, True), f"{ROWS}, cell int"))
    anchors = asked.select("node", "label", "v", "cell", (F.col("n") == 1).alias("alone"))
    best = _joined(sent, anchors, sizes, per_block, per_anchors, _best_of_label(d, largest, positives + 1), "node long, vec_id long, score long")
    best = checkpointed(_ranked(checkpointed(best), ["node"], positives + 1))

    tops = best.filter("score >= 0").groupBy("node").agg(F.collect_set("score").alias("tops"))
    looking = checkpointed(asked.select("node", "label", "v", "cell").join(tops, "node"))
    ranges = looking.groupBy("cell").agg(F.min(F.array_min("tops")).alias("low"), F.max(F.array_max("tops")).alias("high"), F.count("*").alias("n")).collect()
    sizes = {r["cell"]: r["n"] for r in ranges}
    for r in ranges:
        cells.low[r["cell"]], cells.high[r["cell"]] = r["low"] * low / high, r["high"]
    sent = checkpointed(few.mapInArrow(_sending(cells, False), f"{ROWS}, cell int"))
    below = _joined(sent, looking, sizes, per_block, per_anchors, _under_positives(d, largest, negatives, low, high), "node long, top long, vec_id long, score long")
    below = _ranked(checkpointed(below), ["node", "top"], negatives).groupBy("node", "top").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("vec_id").alias("id"), F.col("score").alias("s")))).alias("under"))
    under = best.select("node", F.col("rank").alias("place"), F.col("vec_id").alias("p"), F.col("score").alias("top")).join(below, ["node", "top"], "left")
    listed = under.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("place", "p", "top", "under"))).alias("list"))
    told = checkpointed(asked.select("h1", "h2", "n", "node").join(listed, "node").drop("node"))
    each = spread_join(member, told, ["h1", "h2"], "n", member.count())
    others = F.slice(F.filter("list", lambda x: x["p"] != F.col("vec_id")), 1, positives)
    pairs = each.select(F.col("vec_id").alias("anchor_id"), F.explode(others).alias("x")).select("anchor_id", F.col("x.p").alias("positive_id"), F.col("x.top").alias("positive_score"), F.explode("x.under").alias("y"))
    return pairs.select("anchor_id", "positive_id", F.col("y.rank").alias("rank"), F.col("y.id").alias("negative_id"), "positive_score", F.col("y.s").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding, with every seventh label moved on."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(moved, F.col("vec_id") % 100 == 0)
