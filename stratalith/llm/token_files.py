"""Token ids on disk, compressed by Re-Pair grammars.

Documents are encoded once, put in ascending order of doc_id over ranges, and
cut into blocks of about a million ids. A block's grammar replaces its frequent
adjacent pairs by nonterminals, many pairs a round, and again over what results,
until none is frequent. A block is one row of Parquet files: its rules with the
length each expands to, its symbols, and where each document begins among
symbols and ids. A stretch of a document is thus read by seeking over expansion
lengths, and only the symbols it touches are expanded. Spark's writer commits
the files, so a lost executor's blocks are written again.
"""

from __future__ import annotations

import functools
import os
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .best_fit_packing import PieceEncoder
from .session import checkpointed, ensure_checkpoint_dir, parts
from .spread import small
from .textvec import code_points, trimmed, unassigned, utf8_chunks, word_level_spans
from .token_counts import TokenCounter, byte_symbols

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread for each task

TOKENIZER = "word_bpe_49k.json"
BLOCK = (
    "part int, block int, before long, docs int, null_docs int, n_tokens long, first_doc long, last_doc long, terminals int, width int, "
    "doc_ids binary, doc_symbols binary, doc_tokens binary, rules binary, lengths binary, symbols binary"
)
BUCKETS = 18  # bits of the table that finds frequent pairs


class WordEncoder(PieceEncoder):
    """Token ids under a word-level vocabulary: each distinct pre-token of the normal text goes to the library's model once."""

    def __init__(self, path: str):
        super().__init__(path)
        self.model, self.symbols = self.tokenizer.model, dict(enumerate(byte_symbols()))

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokenize, symbols = self.model.tokenize, self.symbols
        lists = [[t.id for t in tokenize(w.encode("utf-8", "surrogatepass").decode("latin-1").translate(symbols))] for w in words]
        return np.array([i for own in lists for i in own], np.uint32), np.array([len(own) for own in lists], np.int64)

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        if raw.isascii() and not any(x in raw for x in self.special):
            text, places = raw.decode("ascii").lower(), offsets
        else:
            text, cp, places = code_points(data, offsets)
            texts = [text[a:b] for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]
            if any(x in raw for x in self.special) or unassigned()[cp].any():
                lists = [self.whole(x) for x in texts]
                return np.concatenate([np.zeros(0, np.uint32), *lists]), np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
            texts = [TokenCounter.normal(x) for x in texts]
            text, places = "".join(texts), np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)])
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self._spans(text, cp, *word_level_spans(cp, places), places)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class Grammar:
    """Symbols of a block, its rules (pairs of smaller symbols) and the length that each rule expands to."""

    def __init__(self, symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, terminals: int):
        self.symbols, self.rules, self.lengths, self.terminals = symbols, rules, lengths, terminals

    @functools.cached_property
    def sizes(self) -> np.ndarray:
        """Ids that each symbol stands for."""
        inner = self.symbols >= self.terminals
        out = np.ones(len(self.symbols), np.int64)
        out[inner] = self.lengths[self.symbols[inner] - self.terminals]
        return out

    @functools.cached_property
    def pool(self) -> tuple[np.ndarray, np.ndarray]:
        """(expansions of all rules in a row, where each begins)."""
        made: list[list[int]] = []
        for a, b in self.rules.tolist():
            made.append((made[a - self.terminals] if a >= self.terminals else [a]) + (made[b - self.terminals] if b >= self.terminals else [b]))
        ends = np.cumsum(self.lengths, dtype=np.int64)
        return np.array([x for own in made for x in own], np.uint32), ends - self.lengths

    def expand(self, first: int, last: int) -> np.ndarray:
        """Ids of the symbols from ``first`` up to ``last``."""
        symbols, sizes = self.symbols[first:last].astype(np.int64), self.sizes[first:last]
        pool, begin = self.pool
        flat = np.concatenate([pool, np.zeros(len(symbols), np.uint32)])
        inner = symbols >= self.terminals
        flat[len(pool) :][~inner] = symbols[~inner]
        at = np.where(inner, begin[np.where(inner, symbols - self.terminals, 0)] if len(begin) else 0, len(pool) + np.arange(len(symbols)))
        upto = np.cumsum(sizes) - sizes
        return flat[np.repeat(at - upto, sizes) + np.arange(int(sizes.sum()))]

    def stretch(self, first: int, last: int, start: int, length: int) -> np.ndarray:
        """Ids from ``start`` on of the document whose symbols are those, found by expansion lengths alone."""
        ends = np.cumsum(self.sizes[first:last])
        if not length or not len(ends):
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + length, "left")
        skipped = start - (int(ends[a - 1]) if a else 0)
        return self.expand(first + int(a), min(first + int(b) + 1, last))[skipped : skipped + length]


def re_pair(ids: np.ndarray, ends: np.ndarray, terminals: int, least: int = 16, rounds: int = 5, a_round: int = 2048) -> tuple[Grammar, np.ndarray]:
    """(grammar, where each document ends among its symbols) of documents that end at ``ends`` of ids; no pair reaches over an end.

    Each round counts adjacent pairs in a table of buckets, takes the most frequent
    buckets, one pair of each, and replaces their places that don't overlap with
    those of a more frequent pair; in a run of one symbol every second place. A pair
    left out for that, or for its bucket, is counted again in the next round.
    Rounds end when no pair is left ``least`` times; no more rules are made than keep
    symbols in two bytes where ids are.
    """
    symbols, finals = ids.astype(np.uint32), ends - 1
    rules, lengths, known = [], [], np.ones(terminals, np.int64)
    room = (1 << 16) - terminals if terminals < 1 << 16 else 1 << 20
    for _ in range(rounds):
        if len(symbols) < 2 or room <= 0:
            break
        left, right = symbols[:-1], symbols[1:]
        bucket = ((left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA77)) >> np.uint32(32 - BUCKETS)).astype(np.intp)
        bucket[finals[:-1]] = 1 << BUCKETS  # no pair stands at a document's end
        count = np.bincount(bucket, minlength=1 << BUCKETS)[: 1 << BUCKETS]
        top = np.flatnonzero(count >= least)
        top = top[np.argsort(-count[top], kind="stable")[: min(a_round, room)]]
        if not len(top):
            break
        rank = np.full((1 << BUCKETS) + 1, len(top), np.int32)
        rank[top] = np.arange(len(top), dtype=np.int32)
        own = rank[bucket]
        at = np.flatnonzero(own < len(top))
        own = own[at]
        example = np.zeros(len(top), np.int64)
        example[own[::-1]] = at[::-1]  # a bucket's first pair is the one that it stands for
        pairs = np.stack([left[example], right[example]], axis=1)
        same = (left[at] == pairs[own, 0]) & (right[at] == pairs[own, 1])
        at, own = at[same], own[same]
        # of neighbouring places the more frequent pair wins, in runs of one pair every second one
        joined = at[1:] == at[:-1] + 1
        value = 2 * own
        equal = np.flatnonzero(joined & (own[1:] == own[:-1])) + 1
        if len(equal):
            new = np.ones(len(equal), bool)
            new[1:] = equal[1:] != equal[:-1] + 1
            begins = np.maximum.accumulate(np.where(new, np.arange(len(equal)), 0))
            value[equal] += (np.arange(len(equal)) - begins + 1) & 1
        less = value[:-1] < value[1:]
        taken = np.ones(len(at), bool)
        taken[1:] &= ~(joined & less)
        taken[:-1] &= ~joined | less
        uses = np.bincount(own[taken], minlength=len(top))
        kept = np.flatnonzero(uses >= least)
        if not len(kept):
            break
        name = np.zeros(len(top), np.uint32)
        name[kept] = len(known) + np.arange(len(kept))
        taken &= name[own] > 0
        places, pairs = at[taken], pairs[kept]
        size = known[pairs[:, 0]] + known[pairs[:, 1]]
        rules.append(pairs)
        lengths.append(size)
        known = np.concatenate([known, size])
        symbols[places] = name[own[taken]]
        stays = np.ones(len(symbols), bool)
        stays[places + 1] = False
        symbols = symbols[stays]
        finals = finals - np.searchsorted(places, finals, "left")
        room -= len(kept)
    grammar = Grammar(symbols, np.concatenate([np.zeros((0, 2), np.uint32), *rules]), np.concatenate([np.zeros(0, np.int64), *lengths]), terminals)
    return grammar, finals + 1


def _encoding(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for lo, hi, data, offsets in utf8_chunks(batch.column("text")):
                ids, at = encoder(path).chunk(data, offsets)
                kind = "<u2" if encoder(path).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
                whole = np.insert(ids, at[1:], end_id).astype(kind)
                ends = at + np.arange(len(at))
                raw = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer((ends * whole.itemsize).astype(np.int64)), pa.py_buffer(whole)]).cast(pa.binary())
                crc = [zlib.crc32(whole[a:b].astype("<u4")) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids.slice(lo, hi - lo), pa.array(np.diff(ends)), pa.array(crc, pa.int64()), raw], ["doc_id", "n_tokens", "crc", "ids"])

    return run


def _block(part: int, block: int, before: int, docs: list[int | None], pieces: list[np.ndarray], terminals: int, least: int, rounds: int) -> dict[str, object]:
    ends = np.cumsum([len(x) for x in pieces], dtype=np.int64)
    grammar, at = re_pair(np.concatenate(pieces), ends, terminals, least, rounds)
    width = 2 if terminals <= 1 << 16 else 4
    known = [x for x in docs if x is not None]
    return {
        "part": part, "block": block, "before": before, "docs": len(docs), "null_docs": len(docs) - len(known), "n_tokens": int(ends[-1]),
        "first_doc": known[0] if known else None, "last_doc": known[-1] if known else None, "terminals": terminals, "width": width,
        "doc_ids": np.array(known, "<i8").tobytes(), "doc_symbols": at.astype("<u4").tobytes(), "doc_tokens": ends.astype("<u4").tobytes(),
        "rules": grammar.rules.astype(f"<u{width}").tobytes(), "lengths": grammar.lengths.astype("<u4").tobytes(), "symbols": grammar.symbols.astype(f"<u{width}").tobytes(),
    }


def _blocks(path: str, per_block: int, least: int, rounds: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terminals = encoder(path).tokenizer.get_vocab_size()
        kind = "<u2" if terminals <= 1 << 16 else "<u4"
        docs, pieces, held, before, block, part = [], [], 0, 0, 0, 0

        def made() -> pa.RecordBatch:
            names = [x.split()[0] for x in BLOCK.split(", ")]
            kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
            row = _block(part, block, before, docs, pieces, terminals, least, rounds)
            return pa.RecordBatch.from_arrays([pa.array([row[n]], kinds[x.split()[1]]) for n, x in zip(names, BLOCK.split(", "), strict=True)], names)

        for batch in batches:
            for own, doc, raw in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                part = own  # the same for all rows of a task
                docs.append(doc)
                pieces.append(np.frombuffer(raw.as_buffer(), kind))
                held += len(pieces[-1])
                if held >= per_block:
                    yield made()
                    docs, pieces, held, before, block = [], [], 0, before + held, block + 1
        if docs:
            yield made()

    return run


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = 2, per_block: int = 1 << 20, per_part: int = 1 << 24, least: int = 16, rounds: int = 5) -> None:
    """Writes every document's ids, and ``end_id`` behind them, in ascending order of doc_id, as blocks of Parquet files.

    A null or empty text is ``end_id`` alone. A null doc_id stands first; rows of one
    doc_id are ordered by their ids, repeated rows are written each, and neither is
    one task however many they are. Other columns play no part; an empty table
    writes a folder without blocks. A task holds a block, or one longer document.
    """
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(_encoding(path, end_id)), "doc_id long, n_tokens long, crc long, ids binary")
    encoded = checkpointed(made.withColumn("row", F.monotonically_increasing_id()))
    tokens = encoded.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
    order = ["doc_id", "crc", "n_tokens", "row"]
    dealt = encoded.repartitionByRange(parts(tokens, per_part), *order).sortWithinPartitions(*order)
    blocks = dealt.select(F.spark_partition_id().alias("part"), "doc_id", "ids").mapInArrow(trimmed(_blocks(path, per_block, least, rounds)), BLOCK)
    blocks.write.parquet(folder)


def _grammar(row: dict[str, object]) -> Grammar:
    kind = f"<u{row['width']}"
    return Grammar(np.frombuffer(row["symbols"], kind), np.frombuffer(row["rules"], kind).reshape(-1, 2), np.frombuffer(row["lengths"], "<u4").astype(np.int64), row["terminals"])


def _documents(with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                grammar, ends = _grammar(row), np.frombuffer(row["doc_tokens"], "<u4").astype(np.int64)
                ids = grammar.expand(0, len(grammar.symbols)).astype("<u4")
                begins = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                doc_ids = [None] * row["null_docs"] + np.frombuffer(row["doc_ids"], "<i8").tolist()
                columns = [pa.array(doc_ids, pa.int64()), pa.array([row["part"]] * len(ends), pa.int32()), pa.array(row["before"] + begins), pa.array(ends - begins), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(np.append(begins, ends[-1]).astype(np.int32), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "within", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return run


def read_documents(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids, decoded from the files."""
    if not spark.read.schema(BLOCK).parquet(folder).take(1):
        return spark.createDataFrame([], f"doc_id long, start long, n_tokens long, ids_crc32 long{', ids array<int>' * with_ids}")
    blocks = spark.read.schema(BLOCK).parquet(folder)
    docs = blocks.mapInArrow(trimmed(_documents(with_ids)), f"doc_id long, part int, within long, n_tokens long, ids_crc32 long{', ids array<int>' * with_ids}")
    sums = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each part
    offsets = small(checkpointed(sums.select("part", F.coalesce(upto, F.lit(0)).alias("ahead"))))
    return docs.join(offsets, "part").select("doc_id", (F.col("ahead") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, block, nulls, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "null_docs", "doc_ids")), strict=True):
            known = np.frombuffer(raw, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(known), pa.array([part] * len(known), pa.int32()), pa.array([block] * len(known), pa.int32()), pa.array(nulls + np.arange(len(known), dtype=np.int32))], ["doc_id", "part", "block", "place"])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            row = batch.slice(i, 1).to_pylist()[0]
            grammar = _grammar(row)
            symbols, tokens = np.frombuffer(row["doc_symbols"], "<u4").astype(np.int64), np.frombuffer(row["doc_tokens"], "<u4").astype(np.int64)
            out = []
            for asked in row["asked"]:
                k = asked["place"]
                first, size = int(symbols[k - 1]) if k else 0, int(tokens[k] - (tokens[k - 1] if k else 0))
                start = min(max(asked["start"], 0), size)
                out.append((asked["doc_id"], asked["start"], grammar.stretch(first, int(symbols[k]), start, min(max(asked["length"], 0), size - start)).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int32()))], ["doc_id", "start", "ids"])


def read_stretches(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """doc_id, start, ids of the stretches (doc_id, start, length) asked for; beyond a document's end there is nothing.

    Only the numbers of documents are read of all blocks, and whole blocks only where
    a document asked for is; of these only the symbols of a stretch are expanded. Rows
    that share a doc_id answer each.
    """
    blocks = spark.read.schema(BLOCK).parquet(folder)
    at = blocks.select("part", "block", "null_docs", "doc_ids").mapInArrow(_places, "doc_id long, part int, block int, place int")
    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"))
    found = asked.join(at, "doc_id").groupBy("part", "block").agg(F.collect_list(F.struct("doc_id", "place", "start", "length")).alias("asked"))
    return blocks.join(found, ["part", "block"]).mapInArrow(trimmed(_stretches), "doc_id long, start long, ids array<int>")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as compressed ids and read back."""
    folder = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path(TOKENIZER))
    return read_documents(spark, folder)
