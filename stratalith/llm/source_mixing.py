"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source may be taken the same expected number of times, its
source's target over its size; the whole part is taken for certain and the
fraction is rounded. Two fractional documents of a source at a time trade
word mass at random until one of them is whole, which keeps both expectations
and the source's words. Chunks of bounded size do so on their own; the one
fractional document that a chunk may leave for each source goes up a reduction
tree, whose groups do the same, until one is left for a source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..numbering import numbered
from .session import checkpointed, parts
from .spread import spread_join
from .textvec import trimmed, utf8_chunks

WEIGHTS = (5.0, 2.0, 1.0)
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
A_BLOCK = 1000  # repeated rows that are dealt together
FEW = 10_000  # rows of one document that a window may number
ROWS = "many long, doc_id long, source string, said long, size long, source_size long, target double, copies long, chance double, order long, chunk long, open boolean"


def _sizing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [np.zeros(0, np.int64)]
        for _, _, data, offsets in utf8_chunks(batch.column("text")):
            word = ~_GAP[data]
            first = word.copy()
            first[1:] &= ~word[:-1]
            cuts = offsets[1:-1][offsets[1:-1] < len(data)]
            first[cuts] |= word[cuts]
            upto = np.concatenate([[0], np.cumsum(first, dtype=np.int64)])
            sizes.append(np.diff(upto[offsets]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "said")), pa.array(np.concatenate(sizes))], ["doc_id", "source", "said", "size"])


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, said: the runs of bytes other than ASCII white space, 0 for null, and a hash of the text."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("said"), text.alias("text"))
    return rows.mapInArrow(trimmed(_sizing), "doc_id long, source string, said long, size long")


def ordered_weights(sources: DataFrame) -> DataFrame:
    """sources with weight: 5, 2, 1, repeating, in the order of their code points, null last.

    Ranges are numbered on their own; only the count of each range comes to the driver.
    """
    key = [F.col("source").isNull().alias("none"), F.col("source")]
    dealt = checkpointed(sources.repartitionByRange(*key).withColumn("range", F.spark_partition_id()))
    before, upto = {}, 0
    for r in sorted(dealt.groupBy("range").count().collect()):
        before[r["range"]], upto = upto, upto + r["count"]
    offset = dealt.sparkSession.createDataFrame(list(before.items()), "range int, before long")
    place = F.row_number().over(Window.partitionBy("range").orderBy(*key)) - 1
    told = dealt.join(F.broadcast(offset), "range").withColumn("place", (F.col("before") + place) % len(WEIGHTS))
    return told.withColumn("weight", F.array(*map(F.lit, WEIGHTS))[F.col("place").cast("int")]).drop("range", "before", "place")


def mix_targets(sources: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources (source, source_size, ...) with the words that each gives: by weight, at most ``most`` times its size, the excess shared anew.

    The words for a unit of weight only grow as sources reach their limit, so each
    turn is one sum over the sources, until the unit stays.
    """
    weighed = checkpointed(ordered_weights(sources))
    full, limit = F.col("weight"), F.lit(most) * F.col("source_size")
    unit, told = 0.0, None
    while told != unit:
        told = unit
        above = F.col("weight") * F.lit(unit) > limit
        r = weighed.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, F.col("source_size"))).alias("closed"), F.sum(F.when(~above, full)).alias("open")).first()
        if r["open"]:
            unit = max(unit, (share * r["all"] - most * (r["closed"] or 0)) / r["open"])
    return weighed.withColumn("target", F.least(full * F.lit(unit), limit)).drop("weight")


def pivot(size: np.ndarray, chance: np.ndarray, dice: np.random.Generator) -> int:
    """Rounds chance in place, keeping the sum of size * chance; the row left fractional, or -1."""
    near = 1e-9
    held = -1
    for j in range(len(size)):
        if not near < chance[j] < 1 - near:
            chance[j] = round(chance[j])
            continue
        if held < 0:
            held = j
            continue
        i = held
        a, b, p, q = float(size[i]), float(size[j]), float(chance[i]), float(chance[j])
        up, down = min(a * (1 - p), b * q), min(a * p, b * (1 - q))
        move = up if dice.random() * (up + down) < down else -down
        p, q = p + move / a, q - move / b
        whole_i, whole_j = not near < p < 1 - near, not near < q < 1 - near
        chance[i], chance[j] = round(p) if whole_i else p, round(q) if whole_j else q
        held = j if whole_i and not whole_j else -1 if whole_i else i
    return held


def _rounding(level: int, last: bool, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        if level == 0:
            group = group.loc[group.index.repeat(group["many"])].assign(many=1)  # repeated rows came as one
        group = group.sort_values(["order", "doc_id", "said", "size"], kind="stable").reset_index(drop=True)
        chunk = int(group["chunk"].iloc[0])
        if level == 0:
            r = group["target"].to_numpy() / np.maximum(group["source_size"].to_numpy(), 1)
            whole = np.floor(r + 1e-12)
            group["copies"], group["chance"] = whole.astype(np.int64), np.maximum(0.0, r - whole)
        chance = group["chance"].to_numpy(copy=True)
        open_ = np.zeros(len(group), bool)
        names = group["source"].map(lambda s: "" if s is None or pd.isna(s) else f"s{s}").to_numpy(object)
        for name, rows in sorted(pd.Series(names).groupby(names, sort=False).indices.items()):
            dice = np.random.default_rng([seed, level, chunk, *name.encode()])
            size, own = group["size"].to_numpy()[rows], chance[rows]
            empty = size == 0
            own[empty] = dice.random(int(empty.sum())) < own[empty]
            left = pivot(size, own, dice)
            if left >= 0:
                if last:
                    own[left] = float(dice.random() < own[left])
                else:
                    open_[rows[left]] = True
            chance[rows] = own
        group["copies"] = group["copies"] + np.where(open_, 0, np.round(chance)).astype(np.int64)
        group["chance"] = np.where(open_, chance, 0.0)
        group["open"] = open_
        return group

    return run


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, per_chunk: int = 20_000, fan_in: int = 64, seed: int = 7) -> DataFrame:
    """One row for each row of docs: doc_id, size, source, source_size, target, copies, taken, said (a hash of the text).

    Documents without words take part in nothing but are listed, taken 0. A null
    source is one of its own, last in order. Repeated rows are documents each.
    The same rows give the same result, whatever their partitions. A chunk holds
    about ``per_chunk`` documents of any sources, so that a hot one is dealt out;
    repeated rows are dealt in blocks of a thousand, and the table of sources is joined
    without gathering it.
    """
    sizes = checkpointed(document_sizes(docs))
    told = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    about = checkpointed(mix_targets(told, share, most))
    total = about.agg(F.sum("n")).first()[0] or 0
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("key")
    same = sizes.groupBy("doc_id", "source", "said", "size").agg(F.count("*").alias("all"))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("all") - 1) / A_BLOCK).cast("long"))).alias("block")
    dealt = same.select("*", block).withColumn("many", F.least(F.lit(A_BLOCK).cast("long"), F.col("all") - F.col("block") * A_BLOCK)).drop("all")
    rows = spread_join(dealt.select("*", key), about.select(key, "source_size", "target", "n"), ["key"], "n", total)
    chunks = parts(total, per_chunk)
    order, chunk = F.xxhash64("doc_id", "said", "size", F.lit(seed)), F.pmod(F.xxhash64(F.lit(seed), "doc_id", "said", "block"), F.lit(chunks))
    rows = rows.withColumn("order", order).withColumn("chunk", chunk).withColumn("copies", F.lit(0).cast("long")).withColumn("chance", F.lit(0.0)).withColumn("open", F.lit(True))
    columns = ["many", "doc_id", "source", "said", "size", "source_size", "target", "copies", "chance", "order", "chunk", "open"]
    placed, level = None, 0
    while True:
        last = chunks == 1
        done = checkpointed(rows.select(columns).groupBy("chunk").applyInPandas(_rounding(level, last, seed), ROWS))
        placed = done.filter(~F.col("open")) if placed is None else placed.unionByName(done.filter(~F.col("open")))
        if last:
            break
        rows = done.filter("open").withColumn("chunk", F.floor(F.col("chunk") / fan_in).cast("long"))
        chunks, level = parts(chunks, fan_in), level + 1
    return placed.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "said")


def mixed_documents(docs: DataFrame, **options: float) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; a document without words is kept once.

    Rows that repeat doc_id, text and source are one key; where the mix takes some of
    them once more than the others, those come first in the order of their hashes.
    Only such rows are numbered: in a window, or over ranges where a key has very many.
    """
    keys = lambda source: [F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("id"), F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("")).alias("from")]
    on = ["id", "from", "said"]
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))
    told = mix(docs, **options).select(*keys("source"), "said", copies.alias("copies")).groupBy(*on).agg(F.min("copies").alias("least"), F.sum("copies").alias("all"), F.count("*").alias("m"))
    told = checkpointed(told.select(*on, "least", (F.col("all") - F.col("least") * F.col("m")).alias("more"), "m", F.col("m").alias("n")).filter("least + more > 0"))
    rows = docs.select(F.struct("*").alias("row"), *keys("source"), F.xxhash64(F.col("text").cast("string")).alias("said"))
    taken = spread_join(rows, told, on, "n", told.agg(F.sum("m")).first()[0] or 0)
    alike = taken.filter("more = 0").select("row", F.col("least").alias("copies"))
    first = F.row_number().over(Window.partitionBy(*on).orderBy(F.xxhash64("row")))
    few = taken.filter(f"more > 0 AND m <= {FEW}").withColumn("place", first).select("row", (F.col("least") + (F.col("place") <= F.col("more")).cast("long")).alias("copies"))
    out = alike.unionByName(few)
    if told.filter(f"more > 0 AND m > {FEW}").take(1):
        many = numbered(taken.filter(f"more > 0 AND m > {FEW}").withColumn("salt", F.monotonically_increasing_id()), [*on, F.xxhash64("row"), "salt"], "place")
        begin = many.groupBy(*on).agg(F.min("place").alias("begin"), F.count("*").alias("n"))
        placed = spread_join(many, begin, on, "n", many.count())
        out = out.unionByName(placed.select("row", (F.col("least") + (F.col("place") - F.col("begin") < F.col("more")).cast("long")).alias("copies")))
    copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return out.filter("copies > 0").withColumn("copy", copy).select("row.*")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed to 150 % of their words."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("said")
