"""Bound-certified best-fit packing of tokenised documents into sequences.

Documents become pieces of at most ``size`` tokens. Pieces are dealt to
partitions of bounded size; each partition packs by best-fit decreasing (with a
look ahead of two pieces where that falls short) and proves a lower bound of its
bin count with dual-feasible functions. A partition whose count equals its bound
is certified and done. From the others the pieces
of bins with gaps are exchanged (dealt anew to fewer partitions) and packed
again, for a few rounds. Only piece rows move, never texts or token lists.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .session import checkpointed, parts
from .textvec import HashTable, byte_level_starts, code_points, span_hashes, trimmed, unassigned, utf8_chunks

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread for each task

TOKENIZER = "byte_bpe_50k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
A_BLOCK = 1000  # repeated pieces that are dealt together
SEQUENCE = "sequence_id long, offset long"


class PieceEncoder:
    """Token ids of texts by the tokenizers library, asked once for each distinct pre-token."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.special]
        self._reset()

    def _reset(self) -> None:
        self.table = HashTable()
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these pre-tokens in a row, how many each has)."""
        made = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        return np.array(made.ids, np.uint32), np.bincount(np.array(made.word_ids, np.int64), minlength=len(words))

    def _learn(self, words: list[str]) -> None:
        flat, sizes = self._ids_of(words)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.begin = np.concatenate([self.begin, self.used + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.used += len(flat)

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's begin, with the end)."""
        raw = data.tobytes()
        text, cp, places = code_points(data, offsets)
        if any(x in raw for x in self.special) or unassigned()[cp].any():
            lists = [self.whole(text[a:b]) for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]
            return np.concatenate([np.zeros(0, np.uint32), *lists]), np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
        starts = byte_level_starts(cp, places)
        return self._spans(text, cp, starts, np.append(starts[1:], len(cp)), places)

    def _spans(self, text: str, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of pre-tokens that stand at these places."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(places), np.int64)
        keys, example, inverse = np.unique(span_hashes(cp, starts, ends), return_index=True, return_inverse=True)
        if self.table.full():
            self._reset()
        rows = self.table.find(keys)
        new = np.flatnonzero(rows < 0)
        if len(new):
            self._learn([text[a:b] for a, b in zip(starts[example[new]].tolist(), ends[example[new]].tolist(), strict=True)])
            rows[new] = self.table.add(keys[new])
        token = rows[inverse]
        sizes = self.size[token]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.pool[np.repeat(self.begin[token] - upto[:-1], sizes) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(starts, places)]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def _cutting(path: str, end_id: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for lo, _, data, offsets in utf8_chunks(batch.column("text")):
                ids, at = encoder(path).chunk(data, offsets)
                row, piece, start, length, crc = [], [], [], [], []
                for d in range(len(at) - 1):
                    own = np.append(ids[at[d] : at[d + 1]], np.uint32(end_id)).astype("<u4")
                    cuts = [0, *range((len(own) - 1) % size + 1, len(own) + 1, size)]  # all but the first are whole
                    for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        part = own[s:e]
                        row.append(lo + d)
                        piece.append(k)
                        start.append(s)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def tokenized_pieces(docs: DataFrame, path: str, end_id: int = 2, size: int = 1024) -> DataFrame:
    """Pieces of every document: its ids and the end id, cut into ``size`` tokens each, of which the first piece may be shorter; a null or empty text is the end id alone."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(_cutting(path, end_id, size)), PIECES)


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """The most that dual-feasible functions prove of the bins needed.

    The identity gives the volume bound. For each k up to size / 2, f_k lifts an
    item over size - k to a whole bin, keeps those from k to size - k, and drops
    smaller ones; u_m rounds x (m + 1) / size down to m-ths where it isn't whole.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=size + 1)[: size + 1].astype(np.int64)
    value = np.arange(size + 1)
    volume, many = np.cumsum(count * value), np.cumsum(count)
    best = -(-int(volume[-1]) // size)
    k = np.arange(1, size // 2 + 1)
    lifted = many[size] - many[size - k]
    kept = volume[size - k] - volume[k - 1]
    best = max(best, int((lifted + -(-kept // size)).max(initial=0)))
    for m in range(1, 33):
        whole = value * (m + 1) % size == 0
        up = np.where(whole, value * m, value * (m + 1) // size * size)  # in parts of m * size
        best = max(best, -(-int((count * up).sum()) // (m * size)))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset, bins): each piece, longest first, goes to the open bin with the least room that holds it."""
    order = np.argsort(-lengths, kind="stable")
    room: list[list[int]] = [[] for _ in range(size + 1)]  # bins by free space
    some = 0  # bit r: some bin has r tokens free
    used: list[int] = []
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = some >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                some &= ~(1 << free)
        else:
            free, b = size, len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        if free > n:
            room[free - n].append(b)
            some |= 1 << (free - n)
    return bins, offsets, len(used)


def best_fit_pairs(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing that looks two pieces ahead.

    Each bin takes the longest piece left. Then the best fit is a piece that fills
    the rest, else the pair that does and of which most are left, else the longest
    piece that fits, after which the same is asked of the new rest.
    """
    order = np.argsort(-lengths, kind="stable")
    count = np.bincount(lengths, minlength=size + 1)
    after = np.cumsum(count[::-1])[::-1]  # pieces of a length stand in a row of the order, up to here
    have = count > 0
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    n, left, top = 0, len(lengths), size
    while left:
        while not have[top]:
            top -= 1
        room, picked = size, [top]
        while picked:
            for x in picked:
                i = order[after[x] - count[x]]
                bins[i], offsets[i] = n, size - room
                count[x] -= 1
                have[x] = count[x] > 0
                room -= x
                left -= 1
            picked = []
            if not room or not left:
                break
            if have[room]:
                picked = [room]
                continue
            pair = np.flatnonzero(have[1:room] & have[1:room][::-1]) + 1
            pair = pair[(2 * pair > room) | ((2 * pair == room) & (count[pair] > 1))]
            if len(pair):
                a = int(pair[np.argmax(np.minimum(count[pair], count[room - pair]))])
                picked = [a, room - a]
                continue
            fits = np.flatnonzero(have[1 : room + 1])
            picked = [int(fits[-1]) + 1] if len(fits) else []
        n += 1
    return bins, offsets, n


def _packing(size: int, turn: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        many = group["many"].to_numpy()
        first = np.cumsum(many) - many
        group = group.loc[group.index.repeat(many)].assign(many=1)  # repeated pieces came as one row
        group["copy"] += np.arange(len(group)) - np.repeat(first, many)
        group = group.sort_values(["length", "doc_id", "piece", "ids_crc32", "start", "copy"], ascending=[False, *[True] * 5], kind="stable")
        lengths = group["length"].to_numpy()
        bins, offsets, n = best_fit_decreasing(lengths, size)
        bound = lower_bound(lengths, size)
        if n > bound:
            bins, offsets, n = min((bins, offsets, n), best_fit_pairs(lengths, size), key=lambda x: x[2])
        fill = np.bincount(bins, weights=lengths, minlength=n)
        done = np.full(len(group), last or n == bound) | (fill[bins] == size)
        part = int(group["part"].iloc[0])
        return group.assign(sequence_id=((turn << 56) | (part << 24)) + bins, offset=offsets, done=done, bins=n, bound=bound)

    return run


def pack(pieces: DataFrame, size: int = 1024, rounds: int = 3, per_part: int = 20_000) -> DataFrame:
    """Packs pieces (doc_id, piece, start, length, ids_crc32) into sequences of at most ``size`` tokens.

    Adds sequence_id (distinct, not dense), offset (gapless from 0), and bins and
    bound of the partition that packed it. A whole piece of ``size`` tokens is a
    sequence by itself and is not moved. Ties go by doc_id and piece; repeated
    rows are packed each, numbered, and dealt in blocks of a thousand; no rows give
    none. Each partition holds about ``per_part`` pieces whatever the input.
    """
    pieces = checkpointed(pieces)
    full = pieces.filter(F.col("length") >= size).select("*", (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(1).cast("long").alias("bins"), F.lit(1).cast("long").alias("bound"))
    names = [c.split()[0] for c in PIECES.split(", ")]
    same = pieces.filter(F.col("length") < size).groupBy(*names).agg(F.count("*").alias("n"))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / A_BLOCK).cast("long")))
    open_ = same.select(*names, "n", block.alias("block")).withColumn("copy", F.col("block") * A_BLOCK).select(*names, "copy", F.least(F.lit(A_BLOCK).cast("long"), F.col("n") - F.col("copy")).alias("many"))
    schema = f"{PIECES}, copy long, many long, part long, {SEQUENCE}, done boolean, bins long, bound long"
    placed = full
    for turn in range(1, rounds + 1):
        n = parts(open_.agg(F.sum("many")).first()[0] or 0, per_part)
        dealt = open_.select(*names, "copy", "many", F.pmod(F.xxhash64(F.lit(turn), *names, "copy"), F.lit(n)).alias("part"))
        packed = checkpointed(dealt.groupBy("part").applyInPandas(_packing(size, turn, turn == rounds or n == 1), schema))
        placed = placed.unionByName(packed.filter("done").drop("done", "part", "copy", "many"))
        open_ = packed.filter(~F.col("done"))
        if n == 1:
            break
    return placed


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(tokenized_pieces(docs, public_tokenizers.path(TOKENIZER)))
