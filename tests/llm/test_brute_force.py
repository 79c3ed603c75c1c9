"""Operators against plain second implementations: chunks, nearest centroids, surest rows, bounded samples, spread joins."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalith.llm import language_id, quality_classifier, substring_dedup
from stratalith.llm.sampling import smallest_hashes
from stratalith.llm.spread import spread_join
from stratalith.llm.textvec import utf8_chunks

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- shared passages ---------------------------------------------------------------------


def plain_chunks(raw, reach=3, most=64):
    """[(bytes, words)] of one spaced text, byte by byte."""
    if not raw:
        return []
    h, hashes = 0, []
    for x in raw:
        h = (2 * h + int(substring_dedup.GEAR[x])) & 0xFFFFFFFF
        hashes.append(h)
    solid = [x > 32 for x in raw]
    starts = [i for i in range(len(raw)) if i == 0 or solid[i] and not solid[i - 1]]
    rank = [1 << 32 if i == 0 else (hashes[i - 1] & 0xFFFF) * 40503 & 0xFFFF for i in starts]
    cut = [True]
    for j in range(1, len(starts)):
        cut.append(all(rank[j] < rank[k] for k in range(max(0, j - reach), j)) and all(rank[j] <= rank[k] for k in range(j + 1, min(len(starts), j + reach + 1))))
    out, begin = [], 0
    for j in range(1, len(starts) + 1):
        if j == len(starts) or cut[j] or j - begin == most:
            end = starts[j] if j < len(starts) else len(raw)
            out.append((raw[starts[begin] : end], j - begin))
            begin = j
    return out


def plain_dedup(docs, least=20):
    name = lambda x: x.rstrip(bytes(range(33)))
    chunks = {d: plain_chunks((t or "").encode()) for d, t in docs}
    keeper, seen = {}, Counter()
    for d in sorted(chunks):
        for x, _ in chunks[d]:
            keeper.setdefault(name(x), d)
            seen[name(x)] += 1
    out = {}
    for d, own in chunks.items():
        here, flags = set(), []
        for x, _ in own:
            n = name(x)
            flags.append(seen[n] > 1 and (keeper[n] != d or n in here))
            here.add(n)
        kept, j = b"", 0
        while j < len(own):
            k = j
            while k < len(own) and flags[k] == flags[j]:
                k += 1
            if not (flags[j] and sum(w for _, w in own[j:k]) >= least):
                kept += b"".join(x for x, _ in own[j:k])
            j = k
        out[d] = kept.decode()
    return out


def test_repeats_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert all(max(len(w.encode()) for w in (t or "a").split() or ["a"]) <= 64 for _, t in rows)
    got = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs).select("row.doc_id", "text").collect()}
    want = plain_dedup(rows)
    assert {d: t or "" for d, t in got.items()} == want
    assert any(want[d] != (t or "") for d, t in rows)


# --- languages ---------------------------------------------------------------------------


def plain_vector(text, idf):
    """TF-IDF of hashed n-grams of one to three bytes, one space behind each word."""
    said = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in text.encode())
    said = b"".join(bytes([x]) for i, x in enumerate(said) if x != 32 or i and said[i - 1] != 32)
    counts = Counter()
    for size in (1, 2, 3):
        for i in range(len(said) - size + 1):
            key = 0
            for x in said[i : i + size]:
                key = (key * 257 + x) & 0xFFFFFFFF
            counts[((key + size) * 2654435761 & 0xFFFFFFFF) >> 16 & 4095] += 1
    v = np.zeros(4096)
    for k, n in counts.items():
        v[k] = np.log1p(n) * idf[k]
    return v / max(np.linalg.norm(v), 1e-12)


def test_languages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").union(spark.createDataFrame([(10**6, "  Ab c", "en", "s", 1), (10**6 + 1, "éé x", None, "s", 1), (10**6 + 2, "12 ..", "de", "s", 1)], DOCS))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = language_id.fit(docs.filter(~held))
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    seen, texts = Counter(), 0
    train = [r for r in docs.filter(~held & F.col("lang").isNotNull()).collect()]
    one = np.ones(4096)
    for r in train:
        seen.update(np.flatnonzero(plain_vector(r.text or "", one)).tolist())
        texts += 1
    idf = np.log((1 + texts) / (1 + np.array([seen[k] for k in range(4096)]))) + 1
    assert np.allclose(model.idf, idf, rtol=1e-5)
    for r in docs.collect():
        cosine = model.rows @ plain_vector(r.text or "", idf)
        best = max(cosine)
        if any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].lang_pred in {model.names[model.language[i]] for i in np.flatnonzero(cosine > best - 1e-4)}
            assert got[r.doc_id].score == pytest.approx(min(max(best, 0), 1), abs=1e-4)
        else:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
    # a centroid is the unit sum of its language's rows next to it
    for name in model.names:
        own = np.stack([plain_vector(r.text or "", idf) for r in train if r.lang == name])
        own = own[own.any(axis=1)]
        mine = model.rows[model.language == model.names.index(name)].astype(float)
        near = np.argmax(own @ mine.T, axis=1)
        for j in range(len(mine)):
            if (near == j).any():
                mean = own[near == j].sum(axis=0)
                assert mean @ mine[j] / np.linalg.norm(mean) > 0.98


# --- quality -----------------------------------------------------------------------------


def test_features_match_brute_force():
    texts = ["", "One two two three", "a a a b | #x 12!", "é" * 30, "w\nw\nw", " ".join(f"w{i}" for i in range(50))]
    for _, _, data, offsets in utf8_chunks(pa.array(texts)):
        got = quality_classifier.text_features(data, offsets)
    for t, row in zip(texts, got, strict=True):
        raw = t.encode()
        said = "".join(c.lower() if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in t).split()
        n, size = max(len(said), 1), max(len(raw), 1)
        assert row[2] == pytest.approx(sum(48 <= x <= 57 for x in raw) / size) and row[6] == pytest.approx(sum(x >= 128 for x in raw) / size)
        assert row[8] == pytest.approx(raw.count(b"\n") / size) and row[9] == pytest.approx(raw.count(b"|") / size)
        assert row[13] == pytest.approx(sum(len(w.encode()) for w in said) / n / 10) and row[19] == pytest.approx(len(set(said)) / n)
        assert row[16] == pytest.approx(sum(a == b for a, b in zip(said, said[1:], strict=False)) / n)
        assert row[20] == pytest.approx(max(Counter(said).values(), default=0) / n)
        assert row[22:].sum() == pytest.approx(1.0 if said else 0.0)


def test_surest_rows_match_brute_force(spark):
    """Pseudo-labels are the surest of all rows, whatever their partitions, and none is told twice."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality_classifier.featured(docs)
    every = rows.collect()
    text, meta = quality_classifier._unpacked([bytes(r.text) for r in every], [bytes(r.meta) for r in every])
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, len(every)).astype(float)
    models = [quality_classifier.fit_view(x[:200], y[:200], w) for x, w in ((text, quality_classifier.TEXT_WIDTH), (quality_classifier.meta_features(meta), quality_classifier.META_PAIRS))]
    assert np.allclose(models[1].margin(meta), models[1].margin(quality_classifier.meta_features(meta)))
    known = [{r.key for r in every[:100]}, set()]
    for pool in (rows, rows.repartition(13)):
        got = quality_classifier._surest(pool, 0.6, 7, salts=5)(models, known)
        for v, x in ((0, text), (1, meta)):
            margin = {r.key: round(m, 6) for r, m in zip(every, models[v].margin(x).tolist(), strict=True) if r.key not in known[v]}
            for c, sign in ((1, 1), (0, -1)):
                want = sorted((k for k, m in margin.items() if sign * m >= np.log(0.6 / 0.4)), key=lambda k: (-sign * margin[k], k))[:7]
                assert sorted(k for w, d, k, *_ in got if (w, d) == (v, c)) == sorted(want)


def test_model_does_not_depend_on_partitions(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    docs = docs.union(docs.withColumn("text", F.concat("text", F.lit(" more")))).union(docs)  # ids three times, with two texts
    told = [{(r.doc_id, round(r.score, 6)) for r in quality_classifier.classify(d, labels).collect()} for d in (docs, docs.repartition(11))]
    assert told[0] == told[1]


# --- samples and joins -------------------------------------------------------------------


def test_samples_are_bounded(spark):
    rows = spark.range(50_000).select("id", F.xxhash64("id").alias("hash")).union(spark.range(20_000).select(F.lit(7).alias("id"), F.xxhash64(F.lit(7).cast("long"))))
    for parts in (1, 64):
        sample = smallest_hashes(rows.repartition(parts), 100)
        assert [r.hash for r in sample.collect()] == [r.hash for r in rows.distinct().orderBy("hash").limit(100).collect()]
    assert smallest_hashes(rows.limit(0), 100).count() == 0 and smallest_hashes(rows.filter("id < 30"), 100).count() == 30


def test_spread_join(spark):
    rng = random.Random(1)
    held = [rng.choice([1, 1, 1, 2, rng.randrange(3, 4000)]) for _ in range(9000)]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(held)], "k long, i long")
    table = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("x", F.col("k") * 2).filter("k % 5 <> 0")
    got = spread_join(rows, table, ["k"], "n", len(held))
    assert sorted(tuple(r) for r in got.select("k", "i", "x").collect()) == [(k, i, 2 * k) for k, i in sorted((k, i) for i, k in enumerate(held)) if k % 5]
    assert got.filter("k = 1").count() > 3000 and spread_join(rows, table, ["k"], "n", len(held), once=True).count() == len({k for k in held if k % 5})
