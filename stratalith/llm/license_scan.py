"""Licence scans: base phrases, and an exact set-similarity join with licence templates.

A text block is a line or a paragraph (lines up to an empty one). It meets a
template when it holds at least ``least`` of the template's distinct words.
Words are ordered by how many documents hold them, counted over all documents,
rarest first; a template's prefix is as long as it must be for every block that
meets it to share one of its words. Blocks that share one pass a length and a
positional filter and are then counted exactly, so no pair is missed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textvec import span_hashes, trimmed, utf8_chunks, word_spans

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Paragraphs of public licence texts, their openings, and the usual one-line notices.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
]


def words_of(text: str) -> list[str]:
    """Words of a text: A-Z in lower case, runs of letters, digits and non-ASCII characters."""
    data = np.frombuffer(text.encode(), np.uint8)
    folded, starts, ends, _ = word_spans(data, np.array([0, len(data)]))
    return [folded[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]


WINDOW = 2  # a template's words stand within so many times its length


def word_keys(words: list[str]) -> np.ndarray:
    """The hashes that span_hashes gives these words."""
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
    return span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(x) for x in raw], ends) if raw else np.zeros(0, np.uint64)


class Vocabulary(NamedTuple):
    """Distinct words of all templates, in order of their hashes."""

    keys: np.ndarray
    words: list[str]

    @classmethod
    def of(cls, templates: list[tuple[str, str]]) -> Vocabulary:
        words = sorted({w for _, t in templates for w in words_of(t)})
        keys = word_keys(words)
        order = np.argsort(keys)
        return cls(keys[order], [words[i] for i in order])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in keys that hold a word of these, which word)."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == keys)
        return hit, at[hit]


def _frequency(templates: list[tuple[str, str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(templates)
        v = len(vocabulary.words)
        total = np.zeros(v, np.int64)
        for batch in batches:
            for _, _, data, offsets in utf8_chunks(batch.column("text")):
                folded, starts, ends, first = word_spans(data, offsets)
                hit, which = vocabulary.find(span_hashes(folded, starts, ends))
                doc = np.searchsorted(first, hit, "right") - 1
                total += np.bincount(np.unique(doc * v + which) % max(v, 1), minlength=v)
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary.words, pa.string()), pa.array(total)], ["word", "n"])

    return run


def document_frequency(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[str, int]:
    """In how many documents each template word stands; its size is that of the templates' vocabulary."""
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(trimmed(_frequency(templates)), "word string, n long")
    return {r["word"]: r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


class Templates:
    """The templates' side of the join: an inverted index of the prefixes."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[str, int], least: float):
        self.vocabulary, self.least = Vocabulary.of(templates), least
        words = self.vocabulary.words
        order = sorted(range(len(words)), key=lambda i: (frequency.get(words[i], 0), words[i]))
        self.rank = np.zeros(len(words), np.int64)
        self.rank[order] = np.arange(len(words))
        of = {words[i]: int(self.rank[i]) for i in range(len(words))}
        self.sets, self.labels, self.needs, self.reach = [], [], [], []
        self.index: dict[int, list[tuple[int, int]]] = {}
        for label, text in templates:
            ranks = sorted({of[w] for w in words_of(text)})
            if not ranks:
                continue
            need = math.ceil(least * len(ranks) - 1e-9)
            for place in range(len(ranks) - need + 1):
                self.index.setdefault(ranks[place], []).append((len(self.sets), place))
            self.sets.append(ranks)
            self.reach.append(WINDOW * len(words_of(text)))
            self.labels.append(label)
            self.needs.append(need)
        self.prefix = np.zeros(len(words), bool)
        self.prefix[[r for r in self.index]] = True

    def match(self, block: np.ndarray) -> dict[int, float]:
        """Containment in a block, its distinct ranks in order, of every template that meets ``least``."""
        ranks = block.tolist()
        own, met, seen = set(ranks), {}, set()
        for j, r in enumerate(ranks):
            for t, i in self.index.get(r, ()):
                if t in seen or len(ranks) < self.needs[t]:  # length
                    continue
                seen.add(t)
                if 1 + min(len(self.sets[t]) - i - 1, len(ranks) - j - 1) < self.needs[t]:  # position, at the first shared word
                    continue
                both = sum(x in own for x in self.sets[t])
                if both >= self.needs[t]:
                    met[t] = both / len(self.sets[t])
        return met


def closest(places: np.ndarray, ranks: np.ndarray, reach: int) -> int:
    """The most different ranks that stand within ``reach`` words of each other; places in order."""
    held: dict[int, int] = {}
    most = low = 0
    for p, r in zip(places.tolist(), ranks.tolist(), strict=True):
        held[r] = held.get(r, 0) + 1
        while p - places[low] >= reach:
            gone = int(ranks[low])
            held[gone] -= 1
            if not held[gone]:
                del held[gone]
            low += 1
        most = max(most, len(held))
    return most


def _blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Bytes at which blocks of a kind begin: lines, then paragraphs."""
    feed = data == 10
    lines = np.concatenate([offsets[:-1], np.flatnonzero(feed) + 1])
    yield np.unique(lines)
    starts = np.unique(lines)
    starts = starts[starts < len(data)]
    empty = starts[feed[starts]]
    yield np.unique(np.concatenate([offsets[:-1], empty]))


def _scanning(templates: list[tuple[str, str]], frequency: dict[str, int], least: float, phrases: dict[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = Templates(templates, frequency, least)
        sought = [(word_keys(words_of(p)), label) for p, label in phrases.items()]
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for _, _, data, offsets in utf8_chunks(batch.column("text")):
                n = len(offsets) - 1
                folded, starts, ends, first = word_spans(data, offsets)
                keys = span_hashes(folded, starts, ends)
                n_base, first_word, last_word = np.zeros(n, np.int64), [None] * n, [None] * n
                base: list[set[str]] = [set() for _ in range(n)]
                best: list[dict[str, float]] = [{} for _ in range(n)]
                for phrase, label in sought:
                    at = np.flatnonzero(keys == phrase[0])
                    at = at[at + len(phrase) <= len(keys)]
                    for k in range(1, len(phrase)):
                        at = at[keys[at + k] == phrase[k]]
                    doc = np.searchsorted(first, at, "right") - 1
                    whole = at + len(phrase) <= first[doc + 1]
                    for d, w in zip(doc[whole].tolist(), (at - first[doc])[whole].tolist(), strict=True):
                        n_base[d] += 1
                        base[d].add(label)
                        first_word[d] = w if first_word[d] is None else min(w, first_word[d])
                        last_word[d] = w if last_word[d] is None else max(w, last_word[d])
                hit, which = side.vocabulary.find(keys)
                rank = side.rank[which]
                for begin in _blocks(data, offsets):
                    block = np.searchsorted(begin, starts[hit], "right") - 1
                    wanted = np.isin(block, block[side.prefix[rank]])
                    pairs = np.unique(block[wanted] * len(side.rank) + rank[wanted])
                    groups, own = pairs // max(len(side.rank), 1), pairs % max(len(side.rank), 1)
                    cuts = np.flatnonzero(np.diff(groups)) + 1
                    for g, ranks in zip(groups[np.concatenate([[0], cuts])] if len(groups) else (), np.split(own, cuts), strict=False):
                        for t, share in side.match(ranks).items():
                            there = np.arange(*np.searchsorted(block, [g, g + 1]))
                            there = there[np.isin(rank[there], side.sets[t])]
                            if len(there) and hit[there[-1]] - hit[there[0]] >= side.reach[t]:  # a long block: the words have to stand together
                                both = closest(hit[there], rank[there], side.reach[t])
                                if both < side.needs[t]:
                                    continue
                                share = both / len(side.sets[t])
                            d = int(np.searchsorted(offsets, begin[g], "right")) - 1
                            label = side.labels[t]
                            best[d][label] = max(share, best[d].get(label, 0.0))
                rows[0] += np.diff(first).tolist()
                rows[1] += n_base.tolist()
                rows[2] += first_word
                rows[3] += last_word
                rows[4] += [",".join(sorted(x)) for x in base]
                rows[5] += [",".join(sorted(x | y.keys())) for x, y in zip(base, best, strict=True)]
                rows[6] += [1.0 if x else max(y.values(), default=0.0) for x, y in zip(base, best, strict=True)]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(rows, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return run


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.9, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null text is empty: no words, no labels (empty strings), score 0. The score
    is 1 where a base phrase stands, else the largest containment of a template
    that meets ``least`` within a line or paragraph, in a stretch of ``WINDOW`` times the
    template's words, else 0. Repeated rows are scanned each; no rows give none.
    """
    frequency = document_frequency(docs, templates)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        trimmed(_scanning(templates, frequency, least, phrases)), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in all documents."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
