"""Token counts by heap-and-linked-list byte-pair merging.

The count of a pre-token is its initial symbols minus the merges that apply:
adjacent pairs wait in a heap by rank, the lowest is popped and merged in a
linked list, and only its two neighbouring pairs are new. No token identifiers
are made. Whole texts are pre-tokenised with numpy and each distinct pre-token
is merged once for a worker's cache, which has a bound; no row is shuffled.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .textvec import HashTable, code_points, span_hashes, trimmed, unassigned, utf8_chunks, word_level_spans

TOKENIZER = "word_bpe_49k.json"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    of = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [of[b] for b in range(256)]


class PairMerger:
    """Counts the symbols left of a pre-token when every merge that applies is done."""

    def __init__(self, merges: list[list[str]], suffix: str):
        names: dict[str, int] = {}
        number = lambda s: names.setdefault(s, len(names))
        chars = byte_symbols()
        self.inner = [number(c) for c in chars]
        self.last = [number(c + suffix) for c in chars]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for i, pair in enumerate(merges):
            a, b = pair if not isinstance(pair, str) else pair.split(" ")
            self.rank.setdefault((number(a), number(b)), (i, number(a + b)))

    def count(self, word: bytes) -> int:
        n = len(word)
        if n < 2:
            return n
        rank = self.rank
        symbol = [self.inner[b] for b in word]
        symbol[-1] = self.last[word[-1]]
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*found, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (found := rank.get((symbol[i], symbol[i + 1])))]
        heap = [(r, i, a, b, new) for r, new, i, a, b in heap]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j < 0 or symbol[j] != b:
                continue  # one of the two has been merged since
            symbol[i], symbol[j] = new, -1
            left -= 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := rank.get((new, symbol[k])):
                    heapq.heappush(heap, (found[0], i, new, symbol[k], found[1]))
            if (h := before[i]) >= 0 and (found := rank.get((symbol[h], new))):
                heapq.heappush(heap, (found[0], h, symbol[h], new, found[1]))
        return left


class TokenCounter:
    """Token counts of texts under a word-level byte-pair vocabulary file; texts with code points younger than this Python go to the library."""

    def __init__(self, path: str):
        self.path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merger = PairMerger(spec["model"]["merges"], spec["model"]["end_of_word_suffix"] or "")
        self.special = re.compile("|".join(re.escape(x["content"]) for x in spec["added_tokens"] if x["special"]) or r"(?!)")
        self.special_bytes = [x["content"].encode() for x in spec["added_tokens"] if x["special"]]
        self.table, self.counts = HashTable(), np.zeros(0, np.int32)

    @staticmethod
    def normal(text: str) -> str:
        """Composed, then lower case; final sigma gets no form of its own."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def _many(self, text: str, cp: np.ndarray, places: np.ndarray) -> np.ndarray:
        starts, ends = word_level_spans(cp, places)
        if not len(starts):
            return np.zeros(len(places) - 1, np.int64)
        keys, example, inverse = np.unique(span_hashes(cp, starts, ends), return_index=True, return_inverse=True)
        if self.table.full():
            self.table, self.counts = HashTable(self.table.most), np.zeros(0, np.int32)
        rows = self.table.find(keys)
        new = np.flatnonzero(rows < 0)
        if len(new):
            count = self.merger.count
            made = [count(text[a:b].encode("utf-8", "surrogatepass")) for a, b in zip(starts[example[new]].tolist(), ends[example[new]].tolist(), strict=True)]
            self.counts = np.concatenate([self.counts, np.array(made, np.int32)])
            rows[new] = self.table.add(keys[new])
        total = np.concatenate([[0], np.cumsum(self.counts[rows][inverse], dtype=np.int64)])
        at = np.searchsorted(starts, places)
        return total[at[1:]] - total[at[:-1]]

    def one(self, text: str) -> int:
        pieces = self.special.split(text)
        if len(pieces) == 1:
            return int(self._texts([text])[0])
        return len(pieces) - 1 + int(self._texts(pieces).sum())

    def _texts(self, texts: list[str]) -> np.ndarray:
        normal = [self.normal(x) for x in texts]
        whole = "".join(normal)
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self._many(whole, cp, np.concatenate([[0], np.cumsum([len(x) for x in normal], dtype=np.int64)]))

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        raw = data.tobytes()
        plain = not any(x in raw for x in self.special_bytes)
        if plain and raw.isascii():
            text = raw.decode("ascii").lower()
            return self._many(text, np.frombuffer(text.encode("utf-32-le"), np.uint32), offsets)
        text, cp, places = code_points(data, offsets)
        texts = [text[a:b] for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]
        out = self._texts(texts) if plain else np.array([self.one(x) for x in texts], np.int64)
        new = np.flatnonzero(unassigned()[cp])  # code points younger than this Python: the library knows their classes and cases
        for i in np.unique(np.searchsorted(places, new, "right") - 1).tolist():
            out[i] = len(self.library().encode(texts[i], add_special_tokens=False).ids)
        return out

    def library(self) -> Tokenizer:
        if self._library is None:
            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library


@functools.lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def _counting(path: str, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bytes_, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, data, offsets in utf8_chunks(batch.column("text")):
                bytes_.append(np.diff(offsets))
                tokens.append(counter(path).chunk(data, offsets))
            n = np.concatenate(tokens)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(bytes_)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_tokens, over_limit.

    Null and empty texts have no bytes and no tokens; other columns play no part
    and repeated rows are counted each; an empty table gives an empty one. Special
    strings inside a text are one token each. Memory: a chunk of 1 MB, or one
    longer text, and a cache of distinct pre-tokens with a bound.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(_counting(path, limit)), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(TOKENIZER))
