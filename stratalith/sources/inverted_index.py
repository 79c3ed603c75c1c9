"""Postings on disk with block maxima, and searches that skip blocks.

Documents are counted and inverted batch by batch, so that one shuffle of arrays, by ranges
of terms and documents, is all that a change moves. A term's postings lie in blocks by document, each with its largest frequency
and its shortest document, below a bucket of the term. Of these small columns alone
a search learns document frequencies, and the most that a block can give to a
score. A first look at each query's best blocks sets the score to beat; then
only blocks are read whose documents could reach it with all of the query's other terms.
Documents are replaced by merging: a change writes its own postings, its numbers of
documents by term, and the ids that it replaces.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed, few
from ..functions.text import tokenize
from ..operators.overlap import overlap_join
from ..operators.retrieval import B, K1, top_k
from .commits import CommitLog

FIRST = 2  # best blocks of each query's term that set the score to beat
STEP = 2_000  # documents or pieces that a task holds as arrays
DOCUMENT = "id long, length int, terms array<string>, tfs array<int>"
PIECE = "term string, ids array<bigint>, tfs array<int>, lengths array<int>"
BLOCK = f"{PIECE}, block long, n long, tf int, length int, first long, last long"


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            yield batch.slice(at, STEP)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tokens) to (id, length, terms, tfs), terms distinct."""
    for batch in _steps(batches):
        ids, tokens = batch.column(0), batch.column(1)
        length = np.asarray(tokens.value_lengths(), np.int32)
        words = tokens.flatten().dictionary_encode()
        size = max(1, len(words.dictionary))
        key, tf = np.unique(np.repeat(np.arange(len(ids)), length) * size + np.asarray(words.indices, np.int64), return_counts=True)
        ends = np.searchsorted(key, np.arange(len(ids) + 1) * size)
        terms = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.dictionary.take(pa.array(key % size)))
        yield pa.RecordBatch.from_arrays([ids, pa.array(length), terms, _lists(ends, tf.astype(np.int32))], ["id", "length", "terms", "tfs"])


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, length, terms, tfs) to a piece for each term of some documents."""
    for batch in _steps(batches):
        ids, length, terms, tfs = (batch.column(c) for c in ("id", "length", "terms", "tfs"))
        words = terms.flatten().dictionary_encode()
        if not len(words):
            continue
        codes, row = np.asarray(words.indices), np.repeat(np.arange(len(ids)), np.asarray(terms.value_lengths()))
        order = np.lexsort((np.asarray(ids)[row], codes))
        ends, row = np.searchsorted(codes[order], np.arange(len(words.dictionary) + 1)), row[order]
        columns = [_lists(ends, x) for x in (np.asarray(ids)[row], np.asarray(tfs.flatten())[order], np.asarray(length)[row])]
        yield pa.RecordBatch.from_arrays([words.dictionary, *columns], ["term", "ids", "tfs", "lengths"])


def _blocks(per_block: int):
    """Sorted pieces to blocks of at most ``per_block`` postings; the last term of a step waits for the next."""

    def made(term: pa.Array, sizes: np.ndarray, ids: np.ndarray, tfs: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum(sizes)])
        low = lambda f, x: f.reduceat(x, ends[:-1])
        first = low(np.minimum, ids)
        rest = [first, sizes.astype(np.int64), low(np.maximum, tfs), low(np.minimum, lengths), first, low(np.maximum, ids)]
        return pa.RecordBatch.from_arrays([term, *[_lists(ends, x) for x in (ids, tfs, lengths)], *map(pa.array, rest)], ["term", "ids", "tfs", "lengths", "block", "n", "tf", "length", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def cut(pieces: list[tuple], whole: bool) -> tuple[list[tuple], pa.RecordBatch | None]:
            """Full blocks, and all blocks but the last term's if more may follow."""
            names = pa.concat_arrays([p[0] for p in pieces])
            counts, ids, tfs, lengths = (np.concatenate([p[i] for p in pieces]) for i in (1, 2, 3, 4))
            new = np.append(True, np.asarray(pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False), bool))
            starts = np.concatenate([[0], np.cumsum(counts)])[:-1][new]
            at = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
            order = np.lexsort((ids, np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))))
            ids, tfs, lengths = ids[order], tfs[order], lengths[order]
            begins = np.nonzero(at % per_block == 0)[0]
            sizes = np.diff(np.append(begins, len(ids)))
            owner = np.nonzero(new)[0][np.searchsorted(starts, begins, "right") - 1]
            left: list[tuple] = []
            if not whole and sizes[-1] < per_block:  # may grow
                k = begins[-1]
                left = [(names[owner[-1] : owner[-1] + 1], np.array([sizes[-1]]), ids[k:], tfs[k:], lengths[k:])]
                sizes, owner, ids, tfs, lengths = sizes[:-1], owner[:-1], ids[:k], tfs[:k], lengths[:k]
            return left, made(names.take(pa.array(owner)), sizes, ids, tfs, lengths) if len(sizes) else None

        for batch in _steps(batches):
            arrays = [batch.column(c) for c in ("ids", "tfs", "lengths")]
            held, out = cut([*held, (batch.column("term"), np.asarray(arrays[0].value_lengths(), np.int64), *[np.asarray(a.flatten()) for a in arrays])], False)
            if out is not None:
                yield out
        if held:
            yield cut(held, True)[1]

    return run


class Hits(NamedTuple):
    """Hits (qid, rank, id, bm25), and the postings read of those that the terms have."""

    hits: DataFrame
    read: int
    postings: int


class InvertedIndex:
    """BM25 over documents (id long, text) below a folder, in blocks of ``per_block`` postings."""

    def __init__(self, spark: SparkSession, path: str, per_block: int = 128, buckets: int = 64):
        self.spark, self.path, self.per_block, self.buckets = spark, path.rstrip("/"), per_block, buckets
        self.log = CommitLog(spark, f"{self.path}/_commits")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")

    def update(self, docs: DataFrame) -> None:
        """Adds documents, in place of those with their ids; of rows that share an id one counts. A null id is left out; a null text has no terms."""
        number, state = self.log.read()
        state, new, name = state or {"batches": []}, number + 1, uuid.uuid4().hex
        given = docs.filter(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), "text")
        twice = checkpointed(given.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"))
        if not twice.isEmpty():  # only texts of repeated ids are moved
            several = few(twice)
            given = given.join(several, "id", "left_anti").unionByName(given.join(several, "id", "left_semi").groupBy("id").agg(F.max("text").alias("text")))
        there = lambda kind: f"{self.path}/{kind}/batch={name}"
        tokens = given.select("id", F.coalesce(tokenize(F.col("text")), F.array().cast("array<string>")).alias("tokens"))
        tokens.mapInArrow(_counted, DOCUMENT).write.parquet(there("docs"))
        told = self.spark.read.schema(DOCUMENT).parquet(there("docs"))
        many = told.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
        pieces = told.mapInArrow(_inverted, PIECE).withColumn("bucket", self._bucket())
        # ranges of terms and documents, so that no term is one task
        placed = pieces.repartitionByRange(max(1, -(-many // 500_000)), "bucket", "term", F.col("ids")[0]).sortWithinPartitions("bucket", "term", F.col("ids")[0])
        rows = placed.drop("bucket").mapInArrow(_blocks(self.per_block), BLOCK).withColumn("bucket", self._bucket())
        rows.write.partitionBy("bucket").parquet(there("postings"))
        counts = self.spark.read.schema("term string, n long").parquet(there("postings")).groupBy("term").agg(F.sum("n").alias("df"))
        before = {"n": 0, "length": 0}
        if state["batches"]:
            gone = checkpointed(self._docs(state, checkpointed(told.select("id"))))
            before = gone.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first().asDict()
            counts = counts.unionByName(gone.select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count("*")).alias("df")))
        counts.groupBy("term").agg(F.sum("df").alias("df")).withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(there("terms"))
        now = told.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
        if now["n"]:
            state["batches"].append({"name": name, "made": new, "n": now["n"] - before["n"], "length": now["length"] - before["length"]})
        self.log.commit(new, state)

    def _load(self, state: dict, kind: str, schema: str) -> DataFrame:
        """Rows of all batches with the commit that made them."""
        names = [f"{self.path}/{kind}/batch={b['name']}" for b in state["batches"]]
        made = F.broadcast(self.spark.createDataFrame([(b["name"], b["made"]) for b in state["batches"]], "batch string, made long"))  # a row for each change
        return self.spark.read.schema(f"{schema}, batch string").option("basePath", f"{self.path}/{kind}").parquet(*names).join(made, "batch").drop("batch")

    def _docs(self, state: dict, ids: DataFrame) -> DataFrame:
        """Documents of these ids as they are: of each id the last change."""
        rows = self._load(state, "docs", "id long, length int, terms array<string>").join(few(ids), "id", "left_semi")
        if len(state["batches"]) == 1:
            return rows.select("id", "length", "terms")
        return rows.groupBy("id").agg(F.max_by(F.struct("length", "terms"), "made").alias("d")).select("id", "d.*")

    def _replaced(self, state: dict) -> DataFrame:
        """(id, last) of documents that more than one batch has, with their last change."""
        return self._load(state, "docs", "id long").groupBy("id").agg(F.max("made").alias("last"), F.count("*").alias("n")).filter("n > 1").select("id", "last")

    def search(self, queries: DataFrame, k: int = 10, digits: int | None = None) -> Hits:
        """The k best documents of queries (qid, text) by BM25, all that share a term if fewer; ties, after rounding to ``digits``, go to the smaller id.

        Repeated terms of a query count each. The result is that of scoring every
        document; blocks are left out only where none of their documents can be
        among the k.
        """
        state = self.log.read()[1]
        kind = queries.schema["qid"].dataType.simpleString()
        empty = self.spark.createDataFrame([], f"qid {kind}, rank int, id long, bm25 double")
        if not state or not state["batches"]:
            return Hits(empty, 0, 0)
        total, length = (sum(b[c] for b in state["batches"]) for c in ("n", "length"))
        average = length / total if total else 0.0
        asked = checkpointed(queries.select("qid", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf")).withColumn("bucket", self._bucket()))
        wanted = few(checkpointed(asked.select("term", "bucket").distinct()))
        df = self._load(state, "terms", "term string, df long, bucket int").join(wanted, ["bucket", "term"], "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        idf = F.log((F.lit(float(total)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        terms = checkpointed(asked.join(df.filter("df > 0").select("term", idf.alias("idf")), "term").withColumn("t", F.monotonically_increasing_id()))
        terms, last = few(terms), few(checkpointed(self._replaced(state))) if len(state["batches"]) > 1 else None
        part = lambda tf, size: tf * (K1 + 1) / (tf + K1 * (1 - B + B * (size / F.lit(average or 1.0))))

        short = "term string, block long, n long, tf int, length int, first long, last long, bucket int"
        heads = checkpointed(self._load(state, "postings", short).join(wanted, ["bucket", "term"], "left_semi"))
        most = F.col("qtf") * F.col("idf") * part(F.col("tf"), F.col("length"))
        bounds = checkpointed(heads.drop("bucket").join(terms, "term").select("qid", "t", "term", "block", "made", "n", "first", "last", most.alias("most")).withColumn("row", F.monotonically_increasing_id()))
        postings = heads.join(terms.select("term").distinct(), "term", "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

        best = F.row_number().over(Window.partitionBy("qid", "t").orderBy(F.desc("most"), "made", "block"))
        scores = self._scores(state, terms, wanted, last, bounds.withColumn("r", best).filter(F.col("r") <= FIRST), part)
        # a document's score over some of its postings is the least that it has
        least = top_k(scores[0], k, "qid", "bm25", "id").groupBy("qid").agg(F.when(F.count("*") >= k, F.min("bm25")).otherwise(-1.0).alias("beat"))
        slack = 10.0 ** -(digits if digits is not None else 9)
        tops = bounds.groupBy("qid", "t").agg(F.max("most").alias("top"))
        sums = tops.groupBy("qid").agg(F.sum("top").alias("all")).join(least, "qid", "left").withColumn("beat", F.coalesce("beat", F.lit(-1.0)) - slack)
        bars = checkpointed(tops.join(sums, "qid").select("t", (F.col("all") - F.col("top")).alias("others"), "beat"))
        # blocks that could reach the score with the best of all other terms, and then with those of their own ranges
        open_ = checkpointed(bounds.join(few(bars), "t").filter("most + others >= beat"))
        ranges = [F.col("first").alias("start_line"), F.col("last").alias("end_line")]
        met = overlap_join(open_.filter("beat >= 0 AND most < beat").select("qid", "t", "row", *ranges), bounds.select("qid", "t", "most", *ranges), ["qid"])
        pairs = met.filter("left.t <> right.t").select(F.col("left.row").alias("row"), F.col("right.t").alias("t"), F.col("right.most").alias("m"))
        reach = pairs.groupBy("row", "t").agg(F.max("m").alias("m")).groupBy("row").agg(F.sum("m").alias("near"))
        needed = open_.join(reach, "row", "left").filter("beat < 0 OR most + coalesce(near, 0.0) >= beat")
        scored, read = self._scores(state, terms, wanted, last, needed, part)
        rounded = scored if digits is None else scored.withColumn("bm25", F.round("bm25", digits))
        return Hits(top_k(rounded, k, "qid", "bm25", "id").select("qid", "rank", "id", "bm25"), read, postings)

    def _scores(self, state: dict, terms: DataFrame, wanted: DataFrame, last: DataFrame | None, blocks: DataFrame, part) -> tuple[DataFrame, int]:
        """((qid, id, bm25) over the postings of these blocks alone, how many those are)."""
        chosen = checkpointed(blocks.select("term", "block", "made").distinct())
        rows = self._load(state, "postings", f"{PIECE}, block long, bucket int").join(wanted, ["bucket", "term"], "left_semi").drop("bucket")
        held = checkpointed(rows.join(few(chosen), ["term", "block", "made"]))
        read = held.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
        each = held.select("term", "made", F.explode(F.arrays_zip(F.col("ids").alias("id"), F.col("tfs").alias("tf"), F.col("lengths").alias("length"))).alias("p")).select("term", "made", "p.*")
        valid = each if last is None else each.join(last, "id", "left").filter("last IS NULL OR made = last")
        weight = F.col("qtf") * (F.col("idf") * part(F.col("tf"), F.col("length")))
        scored = valid.join(terms, "term").groupBy("qid", "id").agg(F.sum(weight).alias("bm25"))
        return checkpointed(scored), read
