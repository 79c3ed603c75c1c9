"""Vectorised text primitives shared by the operators that run in Arrow batches.

Everything here works on whole UTF-8 buffers with numpy: a batch column is cut
into chunks of about ``target`` bytes (always whole documents, so no result
depends on a document's neighbours), and words or pre-tokens of a chunk are
hashed together with one prefix sum instead of a Python call for each.
"""

from __future__ import annotations

import ctypes
import functools
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_GOLDEN = U64(0x9E3779B97F4A7C15)


Batches = Iterator[pa.RecordBatch]


def trimmed(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run, after which the worker gives freed memory back: workers outlive their tasks."""

    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return wrapped


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, element by element."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8_chunks(column: pa.Array, target: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of whole texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + target, "right")) - 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([np.ones(1, U64), np.full(n, b, U64)]), dtype=U64) for b in (_BASE, inverse))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of codes[s:e] for every span: polynomial over mixed codes, then finalised with the length."""
    n = len(codes)
    size = 1 << max(20, (n + 1).bit_length())
    power, inverse = _powers(size)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, U64)
        np.cumsum(mix64(codes.astype(U64) + _GOLDEN) * power[:n], out=total[1:])
        return mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64) * _GOLDEN)


def word_table() -> np.ndarray:
    """Byte map for words: A-Z to a-z, digits, a-z and non-ASCII bytes kept, all else 0."""
    t = np.zeros(256, np.uint8)
    for b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
        t[b] = b
    t[0x41:0x5B] = np.arange(0x61, 0x7B)
    return t


WORDS = word_table()


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, word starts, word ends, index of each document's first word, with the total at the end)."""
    folded = WORDS[data]
    inside = folded != 0
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begin[cuts] |= inside[cuts]
    end[cuts - 1] |= inside[cuts - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return folded, starts, ends, np.searchsorted(starts, offsets)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """(text, its code points, offsets in code points)."""
    raw = data.tobytes()
    try:
        text = raw.decode("utf-8")
        heads = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
        places = heads[offsets]
    except UnicodeDecodeError:  # invalid bytes are replaced, text by text
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        text, places = "".join(texts), np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)])
    return text, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), places


OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point: letter, number, white space or other."""
    kinds = {"L": LETTER, "N": NUMBER}
    t = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    for lo, hi in ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        t[lo : hi + 1] = SPACE
    return t


@functools.lru_cache(maxsize=1)
def unassigned() -> np.ndarray:
    """Code points without a category in this Python's tables; a library's may know more of them."""
    return np.fromiter((unicodedata.category(chr(i)) == "Cn" for i in range(0x110000)), bool, 0x110000)


def _contractions(cp: np.ndarray, first: np.ndarray, start: np.ndarray) -> None:
    """Tokens such as 's and 'll, where a token starts with the apostrophe: moves the start behind them."""
    at = np.flatnonzero((cp == 39) & start)
    if not len(at):
        return
    n = len(cp)
    padded, barred = np.concatenate([cp, np.zeros(3, cp.dtype)]), np.concatenate([first, np.ones(3, bool)])
    a, b = padded[at + 1], padded[at + 2]
    two = np.isin(a, [ord(c) for c in "stmd"]) & ~barred[at + 1]
    three = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & ~barred[at + 1] & ~barred[at + 2]
    for hit, size in ((two, 2), (three, 3)):
        p = at[hit]
        start[p + 1] = False
        after = p + size
        start[after[after < n]] = True


def byte_level_starts(cp: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Where pre-tokens of the byte-level pattern start: a word takes one space before it, runs of white space keep all but their last."""
    n = len(cp)
    kind = classes()[cp]
    first = np.zeros(n, bool)
    first[places[:-1][places[:-1] < n]] = True
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    start[:-1] |= space[:-1] & ~space[1:] & ~first[1:]
    start[1:] &= ~((cp[:-1] == 32) & ~space[1:] & ~first[1:])
    _contractions(cp, first, start)
    return np.flatnonzero(start)


def word_level_spans(cp: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pre-tokens of the word pattern: letters, single numbers, other marks; white space goes."""
    n = len(cp)
    kind = classes()[cp]
    first = np.zeros(n, bool)
    first[places[:-1][places[:-1] < n]] = True
    start = first | (kind == NUMBER)
    start[1:] |= kind[1:] != kind[:-1]
    _contractions(cp, first, start)
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    solid = kind[starts] != SPACE
    return starts[solid], ends[solid]


class HashTable:
    """64-bit keys to row numbers of a growing store; emptied when full, so that memory has a bound."""

    def __init__(self, most: int = 400_000):
        self.most, self.keys, self.rows, self.size = most, np.zeros(0, U64), np.zeros(0, np.int64), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where unknown."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rows[at], -1)

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Takes in new distinct keys; their rows follow those there."""
        rows = np.arange(self.size, self.size + len(keys))
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.rows = np.insert(self.keys, at, keys[order]), np.insert(self.rows, at, rows[order])
        self.size += len(keys)
        return rows

    def full(self) -> bool:
        return self.size > self.most
