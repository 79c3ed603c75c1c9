"""Near-duplicate documents by BagMinHash, bands and exact multiset overlap.

A document is the multiset of its five-word shingles. Weights are discretised
into unit steps, which are joined into blocks [0,1), [1,2), [2,4), [4,8) ...;
each block of a shingle is a Poisson process in time whose rate is the block's
length, and each of its points has a register and a place in the block. Only
points below the weight count. A register holds the first point's time, so two
documents share a register with the probability of their weighted Jaccard
similarity, at the cost of log(weight) processes, most of which end at once
because their first point lies beyond the time by which all registers are full.

Equal texts are one node. Nodes that share a band meet at the band's smallest
node and their multisets are compared. Where a band still holds several
components, every node outside its largest one is compared with all others of
the band whose size allows the similarity, in blocks of bounded size; a block
returns a spanning forest, not its pairs. So every candidate pair is linked
through others or measured. Joins keep hot keys apart: no node, band or group of
equal texts is one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components, forest
from .session import checkpointed
from .spread import small, spread_join
from .textvec import U64, mix64, span_hashes, trimmed, utf8_chunks, word_spans

REGISTERS, BAND = 252, 6
PER_NODE = 512  # shingles of a node that a block reckons with; longer ones count for several nodes
_GOLDEN, _SIDE = U64(0x9E3779B97F4A7C15), U64(0xD1B54A32D192ED03)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document of each distinct shingle, its hash, its count, two 64-bit digests of each document's words).

    A document of fewer words is one shingle of all its words; one without words has none.
    """
    folded, starts, ends, first = word_spans(data, offsets)
    keys = span_hashes(folded, starts, ends)
    digests = [span_hashes(keys ^ seed, first[:-1], first[1:]) for seed in (U64(0), _SIDE)]
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    with np.errstate(over="ignore"):
        part = [mix64(keys + U64(j + 1) * _GOLDEN) for j in range(words)]
        at = np.flatnonzero(np.arange(len(keys)) + words <= first[1:][doc]) if len(keys) else np.zeros(0, np.int64)
        full = sum((part[j][at + j] for j in range(words)), np.zeros(len(at), U64))
        short = np.flatnonzero((n > 0) & (n < words))
        rest = np.zeros(len(short), U64)
        for j in range(words - 1):
            has = n[short] > j
            rest[has] += part[j][first[short][has] + j]
        rest += n[short].astype(U64) * _SIDE
    d, h = np.concatenate([doc[at], short]), mix64(np.concatenate([full, rest]))
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    cuts = np.flatnonzero(new)
    return d[new], h[new], np.diff(np.append(cuts, len(d))), *digests


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U64(11)).astype(np.float64) + 1.0) * 2.0**-53


def bag_signatures(doc: np.ndarray, keys: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """First arrival times, one row of registers for each of n documents; infinite for a document without shingles."""
    out = np.full((n, registers), np.inf)
    mass = np.bincount(doc, weights=weight, minlength=n)
    todo = np.flatnonzero(mass > 0)
    beyond = np.log(registers) + 4.0
    while len(todo):
        chosen = np.zeros(n, bool)
        chosen[todo] = True
        until = np.where(mass > 0, beyond / np.maximum(mass, 1), 0.0)
        picked = chosen[doc]
        d, k, w = doc[picked], keys[picked], weight[picked].astype(np.float64)
        rows, states, rates, parts_ = [], [], [], []
        low, level = 0.0, 0
        while len(d):
            length = 1.0 if level == 0 else low
            rows.append(d)
            with np.errstate(over="ignore"):
                states.append(mix64(k + U64(level + 1) * _SIDE))
            rates.append(np.full(len(d), length * registers))
            parts_.append(np.minimum(1.0, (w - low) / length))
            low, level = low + length, level + 1
            more = w > low
            d, k, w = d[more], k[more], w[more]
        d, state, rate, part = (np.concatenate(x) for x in (rows, states, rates, parts_))
        time = np.zeros(len(d))
        flat = np.full(n * registers, np.inf)
        while len(d):
            with np.errstate(over="ignore"):
                state = state + _GOLDEN
            time = time - np.log(_uniform(mix64(state))) / rate
            alive = time <= until[d]
            d, state, rate, part, time = d[alive], state[alive], rate[alive], part[alive], time[alive]
            dice = mix64(state ^ _SIDE)
            counts = _uniform(dice) <= part
            np.minimum.at(flat, d[counts] * registers + (dice[counts] % U64(registers)).astype(np.int64), time[counts])
        out[todo] = flat.reshape(n, registers)[todo]
        todo = todo[np.isinf(out[todo]).any(axis=1)]  # not full by then: the same processes, for longer
        beyond *= 2
    return out


def band_keys(signatures: np.ndarray, band: int = BAND) -> np.ndarray:
    """One 64-bit key for each run of ``band`` registers, distinct between bands."""
    n, m = signatures.shape
    bits = mix64(signatures.view(U64)).reshape(n, m // band, band)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(m // band, dtype=U64) + _SIDE, (n, m // band)).copy()
        for j in range(band):
            key = mix64(key * _GOLDEN + bits[:, :, j])
    return key.view(np.int64)


def _signing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in utf8_chunks(batch.column("text")):
            doc, keys, weight, left, right = shingles(data, offsets)
            n = hi - lo
            size = np.bincount(doc, weights=weight, minlength=n).astype(np.int64)
            some = size > 0
            bands = band_keys(bag_signatures(doc, keys, weight, n))
            width = bands.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * width)]).astype(np.int32)), pa.array(bands[some].ravel()))
            own = [batch.column(c).slice(lo, n) for c in ("doc_id", "said")]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(x.view(np.int64), mask=~some) for x in (left, right)), pa.array(size), lists], ["doc_id", "said", "left", "right", "size", "bands"])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Multisets as sets of 64-bit hashes: the j-th occurrence of a shingle is an element of its own."""
    for batch in batches:
        for lo, hi, data, offsets in utf8_chunks(batch.column("text")):
            doc, keys, weight, _, _ = shingles(data, offsets)
            which = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
            with np.errstate(over="ignore"):
                elements = mix64(np.repeat(keys, weight) + which.astype(U64) * _SIDE)
            counts = np.bincount(doc, weights=weight, minlength=hi - lo).astype(np.int64)
            bags = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(elements.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), bags], ["id", "bag"])


def text_key(text: Column) -> Column:
    """What tells rows of one doc_id apart."""
    return F.xxhash64(text.cast("string"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("said"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")


def verified(pairs: DataFrame, bags: DataFrame, least: float, per_task: int = 4096) -> DataFrame:
    """The pairs (a, b) whose multisets have a Jaccard similarity of at least ``least``.

    A node that a thousandth of all pairs name has its bag at several places, one
    for each ``per_task`` pairs.
    """
    times = pairs.groupBy("a").agg(F.count("*").alias("n"))
    busy = times.crossJoin(times.agg(F.sum("n").alias("all"))).filter(f"n > {per_task} AND n * 1000 >= all")  # one row of totals; at most a thousand stay
    busy = F.broadcast(busy.select("a", F.ceil(F.col("n") / per_task).cast("int").alias("places")))
    places = F.coalesce("places", F.lit(1))
    there = bags.select(F.col("id").alias("a"), F.col("bag").alias("bag_a")).join(busy, "a", "left").select("a", "bag_a", F.explode(F.sequence(F.lit(0), places - 1)).alias("place"))
    asks = pairs.join(busy, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), places).cast("int").alias("place"))
    both = asks.join(there.hint("merge"), ["a", "place"]).join(bags.select(F.col("id").alias("b"), F.col("bag").alias("bag_b")).hint("merge"), "b")
    shared = F.size(F.array_intersect("bag_a", "bag_b"))
    return both.filter(shared >= F.lit(least) * (F.size("bag_a") + F.size("bag_b") - shared)).select("a", "b").distinct()


def _crossing(least: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["id", "asks"], kind="stable").reset_index(drop=True)
        sides = group[~group["asks"]].drop_duplicates("id"), group[group["asks"]].drop_duplicates("id")
        bags = sides[0]["bag"].to_list()
        size = np.array([len(x) for x in bags], np.int64)
        elements, inverse = np.unique(np.concatenate([np.zeros(0, np.int64), *bags]), return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        holder = np.repeat(np.arange(len(bags)), size)[order]  # who holds each element, element by element
        first = np.searchsorted(inverse[order], np.arange(len(elements) + 1))
        ids, parts = sides[0]["id"].to_numpy(), sides[0]["component"].to_numpy()
        a: list[int] = []
        b: list[int] = []
        for u, part, bag in zip(sides[1]["id"].tolist(), sides[1]["component"].tolist(), sides[1]["bag"], strict=True):
            at = np.minimum(np.searchsorted(elements, bag), max(len(elements) - 1, 0))
            at = at[elements[at] == bag] if len(elements) else at[:0]
            met = np.concatenate([np.zeros(0, np.int64), *(holder[first[e] : first[e + 1]] for e in at.tolist())])
            shared = np.bincount(met, minlength=len(bags))
            near = np.flatnonzero((shared >= least * (len(bag) + size - shared)) & (parts != part))
            a += [u] * len(near)
            b += ids[near].tolist()
        tree = [(x, t) for x, t in forest(a, b).items() if x != t]
        return pd.DataFrame({"a": pd.Series([x for x, _ in tree], dtype="int64"), "b": pd.Series([t for _, t in tree], dtype="int64")})

    return run


def cross_links(placed: DataFrame, part: DataFrame, bags: DataFrame, least: float, per_block: int = 2048) -> DataFrame:
    """Links (a, b) between the components (id, component) that meet in a band (band, id, size).

    Two bags of this similarity differ in size by a factor of 1 / least at most, so
    that nodes of a band meet by classes of size, each with its two neighbours.
    """
    own = placed.join(part, "id", "left").select("band", "id", "size", F.coalesce("component", "id").alias("component"))
    sign = [F.bit_xor(F.xxhash64("id", F.lit(seed))).alias(c) for seed, c in ((1, "s"), (2, "t"))]
    sizes = own.groupBy("band", "component").agg(F.count("*").alias("k"), *sign)
    sides = sizes.groupBy("band").agg(F.count("*").alias("of"), F.sum("k").alias("n"), F.max(F.struct("k", "component")).alias("main"), F.bit_xor("s").alias("s"), F.bit_xor("t").alias("t")).filter("of > 1")
    sides = sides.groupBy("n", "s", "t").agg(F.min(F.struct("band", "main")).alias("one")).select("one.band", F.col("one.main.component").alias("main"), "n")  # bands of the same nodes ask the same
    sides = checkpointed(sides)
    rank = F.floor(F.log(F.col("size").cast("double")) / float(np.log(1.0 / least) + 1e-6)).cast("int").alias("rank")
    mixed = checkpointed(spread_join(own.select("band", "id", "size", "component", rank), sides, ["band"], "n", placed.count()))
    blocks = lambda n: F.ceil(F.greatest(F.count("*") / per_block, F.sum("size") / (per_block * PER_NODE))).cast("int").alias(n)
    asking = mixed.filter("component <> main").withColumn("rank", F.explode(F.array(*[F.col("rank") + d for d in (-1, 0, 1)])))
    n_asks, n_all = (df.groupBy("band", "rank").agg(blocks(x), F.count("*").alias(f"{x}_rows")) for df, x in ((asking, "n_asks"), (mixed, "n_all")))
    meets = checkpointed(n_all.join(n_asks, ["band", "rank"]))
    held = meets.agg(F.sum("n_all_rows"), F.sum("n_asks_rows")).first()
    block = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    there = spread_join(mixed, meets.drop("n_asks_rows"), ["band", "rank"], "n_all_rows", held[0] or 0).select("band", "rank", "id", "component", F.lit(False).alias("asks"), block("n_all", 1).alias("x"), each("n_asks").alias("y"))
    asks = spread_join(asking, meets.drop("n_all_rows"), ["band", "rank"], "n_asks_rows", held[1] or 0).select("band", "rank", "id", "component", F.lit(True).alias("asks"), each("n_all").alias("x"), block("n_asks", 2).alias("y"))
    dealt = there.unionByName(asks).join(bags.hint("merge"), "id")
    return dealt.groupBy("band", "rank", "x", "y").applyInPandas(_crossing(least), "a long, b long")


def near_duplicates(docs: DataFrame, least: float = 0.8, per_block: int = 2048) -> DataFrame:
    """One row for each row of docs: doc_id, class_id, kept, said.

    class_id is the smallest doc_id that links reach: equal words, or a weighted
    Jaccard similarity of at least ``least`` on five-word shingles. kept marks the
    class's own row. Documents without words (null, empty, marks only) are each
    their own. Rows that share a doc_id are told apart by their text, whose key is
    ``said``; repeated rows are marked alike. A null doc_id has a null class and is
    kept. ``per_block`` bounds the nodes of a band that meet in a task, and their shingles.
    """
    rows = _texts(docs)
    signed = checkpointed(rows.mapInArrow(trimmed(_signing), "doc_id long, said long, left long, right long, size long, bands array<long>"))
    total = signed.count()
    equal = signed.filter("left IS NOT NULL").groupBy("left", "right").agg(F.min(F.struct("doc_id", "said")).alias("first"), F.max("size").alias("size"), F.count("*").alias("n"))
    equal = checkpointed(equal.select("left", "right", "first.doc_id", "first.said", "size", "n"))
    again = small(equal.groupBy("doc_id").agg(F.count("*").alias("texts")).filter("texts > 1").select("doc_id", F.lit(True).alias("again")))
    other = -1 - F.pmod(F.xxhash64("doc_id", "left", "right"), F.lit(1 << 62))  # a number of its own for each text of such an id
    nodes = checkpointed(equal.join(again, "doc_id", "left").withColumn("id", F.when(F.col("again"), other).otherwise(F.col("doc_id"))).drop("again"))
    n_nodes = nodes.count()
    key = ["doc_id", "said"]
    banded = spread_join(signed.select(*key, "bands"), nodes.select(*key, "id", "size", "n"), key, "n", total, once=True).select("id", "size", F.explode("bands").alias("band"))
    met = checkpointed(banded.groupBy("band").agg(F.min(F.struct("id", "size")).alias("least"), F.max("id").alias("most"), F.count("*").alias("n")).filter("least.id < most").drop("most"))
    placed = checkpointed(spread_join(banded, met, ["band"], "n", n_nodes * (REGISTERS // BAND)))
    wanted = nodes.join(placed.select("id").distinct(), "id", "left_semi").select(*key, "id", "n")
    bags = checkpointed(spread_join(rows, wanted, key, "n", total, once=True).mapInArrow(trimmed(_bags), "id long, bag array<long>"))
    fits = F.least("size", "least.size") >= F.lit(least - 1e-9) * F.greatest("size", "least.size")
    pairs = checkpointed(placed.filter(F.col("id") > F.col("least.id")).filter(fits).select(F.col("least.id").alias("a"), F.col("id").alias("b")).distinct())
    links = checkpointed(verified(pairs, bags, least))
    links = checkpointed(links.unionByName(cross_links(placed.select("band", "id", "size"), components(links), bags, least, per_block)))
    found = components(links)
    told = checkpointed(nodes.join(found, "id", "left").select("left", "right", "doc_id", "said", "n", F.coalesce("component", "id").alias("component")))
    first = told.groupBy("component").agg(F.min(F.struct("doc_id", "said")).alias("own"), F.count("*").alias("k"))
    table = spread_join(told.select("left", "right", "n", "component"), first, ["component"], "k", n_nodes).drop("component")
    own = F.col("own.doc_id")
    out = spread_join(signed.select("doc_id", "said", "left", "right"), table, ["left", "right"], "n", total).select("doc_id", own.alias("class_id"), (F.struct("doc_id", "said") == F.col("own")).alias("kept"), "said")
    alone = signed.filter("left IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"), "said")
    none = docs.filter(F.col("doc_id").cast("long").isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"), text_key(F.col("text")).alias("said"))
    return out.unionByName(alone).unionByName(none)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "kept")
