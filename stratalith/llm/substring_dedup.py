"""Substring dedup by content-defined chunking with a gear rolling hash.

The hash h = 2 h + gear[byte] runs over the text's bytes; its low bits, which
hold the last sixteen bytes only, rank the places where a word starts. A place
is a boundary when it has the smallest rank among its neighbours, so chunks
depend on content alone and an insertion shifts none but its own. Chunks are
deduplicated by digest: the document with the smallest id keeps one, at its
first place. Elsewhere a run of repeated chunks goes if it has at least
``least`` words: every passage of over 50 words that two texts share holds such
a run, while shorter repetitions, such as notices, stay. Scripts without spaces
are cut into words of about two characters (Chinese, Japanese) or four (Thai,
Lao, Burmese, Khmer), other runs over 64 bytes into words of about eight, where
the hash says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import checkpointed
from .spread import spread_join
from .textvec import U64, mix64, span_hashes, trimmed, utf8_chunks

GEAR = (mix64(np.arange(1, 257, dtype=U64)) >> U64(32)).astype(np.uint32)
_BITS = np.uint32(0xFFFF)


def gear_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The rolling hash behind every byte, begun anew with each text."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    place = np.arange(len(data)) + 32 * (row + 1)
    h = np.zeros(len(data) + 32 * len(offsets), np.uint32)
    h[place] = GEAR[data]
    for s in (1, 2, 4, 8, 16):
        h[s:] = h[s:] + (h[:-s] << np.uint32(s))
    return h[place]


def word_sizes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """At each byte that starts a character of a script without spaces, about how many of them a word has, less one; else 0."""
    out = np.zeros(len(data), np.uint32)
    at = np.flatnonzero(data >= 0xE0)
    at = at[at + 2 < len(data)]
    a, b, c = (data[at + k].astype(np.uint32) for k in range(3))
    code = (a & 15) << 12 | (b & 63) << 6 | c & 63
    two = (a < 0xF0) & ((code >= 0x3040) & (code < 0x3100) | (code >= 0x3400) & (code < 0xA000) | (code >= 0xF900) & (code < 0xFB00) | (code >= 0xFF66) & (code < 0xFFA0)) | (a == 0xF0) & (b >= 0xA0) & (b < 0xB4)
    four = (a < 0xF0) & ((code >= 0x0E00) & (code < 0x0F00) | (code >= 0x1000) & (code < 0x10A0) | (code >= 0x1780) & (code < 0x1800))
    out[at[two]], out[at[four]] = 1, 3
    size = np.diff(np.append(starts, len(data)))
    if (size > 64).any():
        long = np.repeat(size > 64, size)
        out[long & (out == 0) & ((data & 0xC0) != 0x80)] = 7
    return out


def chunk_starts(data: np.ndarray, offsets: np.ndarray, reach: int = 3, most: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte of each chunk, its words, index of each text's first chunk).

    Words are runs of bytes over space, and stretches between hash hits in runs
    over 64 bytes and in scripts without spaces. A boundary ranks below ``reach`` words before and as low as
    those after it; stretches without one are cut every ``most`` words.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    h = gear_hashes(data, offsets)
    solid = data > 32
    head = solid.copy()
    head[1:] &= ~solid[:-1]
    begin = offsets[:-1][offsets[:-1] < n]
    head[begin] = True  # white space before the first word is part of it
    lead = np.zeros(n, bool)
    lead[begin] = ~solid[begin]
    starts = np.flatnonzero(head)
    size = word_sizes(data, starts)
    if size.any():
        head[1:] |= (size[1:] > 0) & (((h[:-1] >> np.uint32(5)) & size[1:]) == 0)
        starts = np.flatnonzero(head)
    rank = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    inner = starts > 0
    rank[inner] = (h[starts[inner] - 1] & _BITS) * np.uint32(40503) & _BITS
    doc = np.searchsorted(offsets, starts, "right") - 1
    first = np.searchsorted(starts, offsets)
    opens = np.zeros(len(starts), bool)
    opens[first[:-1][np.diff(offsets) > 0]] = True
    rank[opens] = 0xFFFFFFFF
    low = ~opens
    for k in range(1, reach + 1):
        same = doc[k:] == doc[:-k]
        low[k:] &= ~same | (rank[k:] < rank[:-k])
        low[:-k] &= ~same | (rank[:-k] <= rank[k:])
    cut = low | opens
    at = np.flatnonzero(cut)
    words = np.diff(np.append(at, len(starts)))
    if (words > most).any():
        into = np.arange(len(starts)) - np.repeat(at, words)
        cut |= into % most == 0
        at = np.flatnonzero(cut)
        words = np.diff(np.append(at, len(starts)))
    return starts[at], words, np.searchsorted(starts[at], offsets)


def _ends(starts: np.ndarray, n: int) -> np.ndarray:
    return np.append(starts[1:], n)


def _digests(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit digests; white space at a chunk's end is no part of it."""
    ends = _ends(starts, len(data))
    solid = np.flatnonzero(data > 32)
    if len(solid):
        last = np.searchsorted(solid, ends) - 1
        ends = np.where(last >= 0, np.maximum(starts, solid[np.maximum(last, 0)] + 1), starts)
    return span_hashes(data, starts, ends).view(np.int64)


def _chunking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct digests of each text, and those that stand in it more than once."""
    for batch in batches:
        for lo, hi, data, offsets in utf8_chunks(batch.column("text")):
            starts, _, first = chunk_starts(data, offsets)
            row, digest = np.repeat(np.arange(hi - lo), np.diff(first)), _digests(data, starts)
            order = np.lexsort((digest, row))
            row, digest = row[order], digest[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (digest[1:] != digest[:-1])
            twice = np.diff(np.append(np.flatnonzero(new), len(row))) > 1
            row, digest = row[new], digest[new]
            lists = []
            for own in (np.ones(len(row), bool), twice):
                ends = np.concatenate([[0], np.cumsum(np.bincount(row[own], minlength=hi - lo))])
                lists.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(digest[own])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *lists], ["doc_id", "digests", "twice"])


def _runs(flag: np.ndarray, doc: np.ndarray, words: np.ndarray, least: int) -> np.ndarray:
    """Flags of the runs, within a document, that have at least ``least`` words."""
    if not flag.any():
        return flag
    new = np.ones(len(flag), bool)
    new[1:] = (flag[1:] != flag[:-1]) | (doc[1:] != doc[:-1])
    run = np.cumsum(new) - 1
    return flag & (np.bincount(run, weights=words)[run] >= least)


def _removing(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in utf8_chunks(batch.column("text")):
                starts, words, first = chunk_starts(data, offsets)
                digest, n = _digests(data, starts), np.diff(first)
                doc = np.repeat(np.arange(hi - lo), n)
                gone = np.zeros(len(starts), bool)
                lists = [batch.column(c).slice(lo, hi - lo) for c in ("elsewhere", "own")]
                for d in np.flatnonzero([x.is_valid or y.is_valid for x, y in zip(*lists, strict=True)]).tolist():
                    a, b = first[d], first[d + 1]
                    away, own = (np.asarray(x[d].values if x[d].is_valid else [], np.int64) for x in lists)
                    _, at = np.unique(digest[a:b], return_index=True)
                    again = np.ones(b - a, bool)
                    again[at] = False
                    gone[a:b] = np.isin(digest[a:b], away) | np.isin(digest[a:b], own) & again
                gone = _runs(gone, doc, words, least)
                ends = _ends(starts, len(data))
                kept, removed, lost = [], [], np.zeros(hi - lo, np.int64)
                np.add.at(lost, doc[gone], (ends - starts)[gone])
                raw = data.tobytes()
                for d in range(hi - lo):
                    own = gone[first[d] : first[d + 1]]
                    spans: list[dict[str, int]] = []
                    if not own.any():
                        kept.append(raw[offsets[d] : offsets[d + 1]])
                        removed.append(spans)
                        continue
                    pieces = []
                    for c in range(first[d], first[d + 1]):
                        if not gone[c]:
                            pieces.append(raw[starts[c] : ends[c]])
                        elif spans and spans[-1]["until"] == starts[c] - offsets[d]:
                            spans[-1]["until"] = int(ends[c] - offsets[d])
                        else:
                            spans.append({"from": int(starts[c] - offsets[d]), "until": int(ends[c] - offsets[d])})
                    kept.append(b"".join(pieces))
                    removed.append(spans)
                text = pa.array([x.decode("utf-8", "replace") for x in kept], pa.string())
                text = pa.compute.if_else(pa.compute.is_null(batch.column("text").slice(lo, hi - lo)), pa.scalar(None, pa.string()), text)
                kind = pa.list_(pa.struct([("from", pa.int64()), ("until", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(lo, hi - lo), text, pa.array(lost), pa.array(removed, kind)], ["row", "text", "lost", "removed"])

    return run


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """For each document with a chunk that stands elsewhere too: the digests kept elsewhere, and those that it keeps."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    chunked = checkpointed(texts.mapInArrow(trimmed(_chunking), "doc_id long, digests array<long>, twice array<long>"))
    chunks = chunked.select("doc_id", F.explode("digests").alias("digest"))
    counted = chunks.select("digest", "doc_id").unionByName(chunked.select(F.explode("twice").alias("digest"), "doc_id"))
    shared = checkpointed(counted.groupBy("digest").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1"))
    total = chunked.agg(F.sum(F.size("digests") + F.size("twice"))).first()[0] or 0
    found = spread_join(chunks, shared, ["digest"], "n", total).select("doc_id", "digest", (F.col("doc_id") == F.col("keeper")).alias("own"))
    return found.groupBy("doc_id").agg(F.collect_set(F.when(~F.col("own"), F.col("digest"))).alias("elsewhere"), F.collect_set(F.when(F.col("own"), F.col("digest"))).alias("own"))


def without_repeats(docs: DataFrame, least: int = 20) -> DataFrame:
    """row, text, lost, removed: each row of docs as a struct, its text without passages kept elsewhere, the bytes and byte spans that went.

    Null and empty texts stay as they are, as do rows without doc_id; rows that
    share a doc_id are one document, so that what one keeps the others keep. A
    passage that repeats within a document stays at its first place.
    """
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("key"))
    joined = rows.join(repeated_chunks(docs).hint("merge"), F.col("key") == F.col("doc_id"), "left").select("row", "text", "elsewhere", "own")
    kind = f"row {joined.schema['row'].dataType.simpleString()}, text string, lost long, removed array<struct<from:long,until:long>>"
    return joined.mapInArrow(trimmed(_removing(least)), kind)


def repeats_removed(docs: DataFrame, **options: int) -> DataFrame:
    """The rows of docs with such texts; a document of which nothing is left goes, n_chars follows the text."""
    kept = without_repeats(docs, **options).filter("lost = 0 OR length(text) > 0")
    kinds = {f.name: f.dataType for f in docs.schema.fields}

    def column(c: str) -> Column:
        if c == "text":
            return F.col("text").cast(kinds[c]).alias(c)
        own = F.col("row").getField(c)
        return (F.when(F.col("lost") > 0, F.length("text")).otherwise(own).cast(kinds[c]) if c == "n_chars" else own).alias(c)

    return kept.select(*[column(c) for c in docs.columns])


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that another one keeps."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs).select("row.doc_id", "text", F.col("lost").alias("n_removed"), "removed")
