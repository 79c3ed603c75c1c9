"""The training-data operators against libraries, brute force and awkward rows."""

from __future__ import annotations

import json
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratalith.llm.ann_forest import nearest
from stratalith.llm.best_fit_packing import PieceEncoder, best_fit_decreasing, best_fit_pairs, lower_bound, pack, tokenized_pieces
from stratalith.llm.components import components, forest
from stratalith.llm.language_id import identify
from stratalith.llm.license_scan import TEMPLATES, scan_licenses, words_of
from stratalith.llm.minhash_dedup import bag_signatures, near_duplicates
from stratalith.llm.pivot_dedup import near_vectors
from stratalith.llm.quality_classifier import classify, kept_documents
from stratalith.llm.source_mixing import mix, mix_targets, mixed_documents, pivot
from stratalith.llm.substring_dedup import repeats_removed, without_repeats
from stratalith.llm.textvec import utf8_chunks
from stratalith.llm.token_counts import TokenCounter, count_tokens

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

AWKWARD = [
    "", " ", "\n", "it's we'll they're Don'than ''s 's !'s", "İstanbul ΑΣ ΣΑΣ", "<|endoftext|>x<|startoftext|> y", "a b  12³4 ½ ​日本語 é \U0001f600\U0001f600",
    "\n'll'd", " 's '", "a \n\n b\n  c", "\t\ta  ", "\x85x \x85 y　z", "'sé're''s", "### @@ ||", "e" * 5000, "é",
]


#: Names that the operators use for columns of their own; each value is its column's.
CLASHING = "kept n _n id _id key row copy copies size said label limit hash own elsewhere lost removed digest total chunk".split()


def rows_of(spark, texts, **columns):
    rows = [(i, t, columns.get("lang", "en"), columns.get("source", "s"), len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, pool=4000):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, and a clashing extra column."""
    rng = random.Random(5)
    same = words(rng, 80)
    texts = [None, *AWKWARD, same, same, same, words(rng, 30_000)]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "src", None if i % 5 == 0 else 7) for i, t in enumerate(texts)]
    rows += [rows[-2], (None, same, None, None, None)]
    return spark.createDataFrame(rows, DOCS).select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHING))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- token counts and pieces -----------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abs tlrevdm'’.!#12 \n\té日ΣİǅǺ  <|>")), max_size=40), min_size=1, max_size=4))
def test_tokenizers_agree(texts):
    from stratalith.llm.best_fit_packing import encoder
    from stratalith.llm.token_counts import counter

    import pyarrow as pa

    own, lib = counter(public_tokenizers.path("word_bpe_49k.json")), encoder(public_tokenizers.path("byte_bpe_50k.json"))
    word = word_tokenizer()
    for _, _, data, offsets in utf8_chunks(pa.array(texts)):
        assert own.chunk(data, offsets).tolist() == [len(word.encode(t, add_special_tokens=False).ids) for t in texts]
        ids, at = lib.chunk(data, offsets)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [lib.whole(t).tolist() for t in texts]


def word_tokenizer(cache={}):  # noqa: B006
    if not cache:
        cache["t"] = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return cache["t"]


def test_token_counts_of_documents(spark, awkward, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(awkward.select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, path).collect())
    lib = word_tokenizer()
    want = []
    for r in docs.collect():
        n = len(lib.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id or 0, len((r.text or "").encode()), n, n > 2048))
    assert got == sorted(want)
    assert count_tokens(empty, path).count() == 0


def test_new_code_points():
    """Letters that this Python's tables don't know are counted as the library does."""
    import pyarrow as pa

    from stratalith.llm.token_counts import counter

    word = word_tokenizer()
    texts = ["", "a\ua7cbb x\ua7dc1 plain", "plain", "\ua7dc", "\U0001f8ff \U000e0fff <|endoftext|> \u0378a", "\ua7cb" * 9]
    for _, _, data, offsets in utf8_chunks(pa.array(texts)):
        assert counter(public_tokenizers.path("word_bpe_49k.json")).chunk(data, offsets).tolist() == [len(word.encode(t, add_special_tokens=False).ids) for t in texts]


def test_cache_has_a_bound():
    counter = TokenCounter(public_tokenizers.path("word_bpe_49k.json"))
    counter.table.most = 3
    texts = ["one two three four", "five six seven", "one two three four"]
    assert [counter.one(t) for t in texts] == [len(word_tokenizer().encode(t, add_special_tokens=False).ids) for t in texts]


def test_pieces_and_packing(spark, awkward, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(awkward.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    packed = pack(tokenized_pieces(docs, path), per_part=50).toPandas()
    encode = PieceEncoder(path).whole
    for r in docs.collect():
        ids = np.append(encode(r.text or ""), np.uint32(2)).astype("<u4")
        own = packed[packed.doc_id == r.doc_id].sort_values("piece")
        assert own.piece.tolist() == list(range(len(own))) and own.length.sum() == len(ids)
        for p in own.itertuples():
            assert p.length <= 1024 and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    for _, seq in packed.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]] and seq.length.sum() <= 1024
    bound = lower_bound(packed.length.to_numpy(), 1024)
    assert bound <= packed.sequence_id.nunique() <= 1.03 * bound + 2
    whole = pack(tokenized_pieces(docs, path)).select("sequence_id").distinct().count()
    assert bound <= whole <= 1.005 * bound + 1
    assert pack(tokenized_pieces(empty, path)).count() == 0
    odd = pack(tokenized_pieces(awkward, path))  # with null and repeated ids
    assert odd.filter("piece = 0").count() == awkward.count() and odd.filter("doc_id IS NULL").count() == awkward.filter("doc_id IS NULL").count()
    assert odd.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
def test_bounds_hold(lengths):
    """No packing of few pieces is below the bound, and best fit is valid."""
    sizes = np.array(lengths)
    for f in (best_fit_pairs, best_fit_decreasing):
        bins, offsets, n = f(sizes, 12)
        for b in range(n):
            own = np.flatnonzero(bins == b)
            own = own[np.argsort(offsets[own])]
            assert len(own) and sizes[own].sum() <= 12 and offsets[own].tolist() == [0, *np.cumsum(sizes[own])[:-1].tolist()]

    def least(left, room):
        if not left:
            return len(room)
        best = len(left) + len(room)
        for i, r in enumerate(room):
            if r >= left[0] and r not in room[:i]:
                best = min(best, least(left[1:], (*room[:i], r - left[0], *room[i + 1 :])))
        return min(best, least(left[1:], (*room, 12 - left[0])))

    assert lower_bound(sizes, 12) <= least(tuple(sorted(lengths, reverse=True)), ()) <= min(n, best_fit_pairs(sizes, 12)[2])


# --- quality and language --------------------------------------------------------------


def test_quality(spark, awkward, empty):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = classify(docs, labels).join(labels, "doc_id")
    right = got.agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).first()[0]
    false = got.filter("quality = 1 AND NOT kept").count()
    assert right > 0.93 and false <= 0.02 * got.count()
    assert classify(awkward, labels).count() == awkward.count()
    assert classify(empty, labels).count() == 0
    assert classify(docs, labels.limit(0)).filter("NOT kept").count() == 0
    kept = kept_documents(awkward, labels)
    assert kept.columns == awkward.columns and kept_documents(docs, labels).count() == classify(docs, labels).filter("kept").count()


def test_language(spark, awkward, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert (got[got.held_out].lang == got[got.held_out].lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()
    odd = identify(docs.unionByName(awkward.select(docs.columns).withColumn("doc_id", F.col("doc_id") + 10**6))).filter(f"doc_id >= {10**6}").toPandas().set_index("doc_id")
    texts = {r.doc_id: r.text for r in awkward.collect() if r.doc_id is not None}
    for i, t in texts.items():
        blank = t is None or not any(c.isalpha() for c in t)
        assert (np.atleast_1d(odd.loc[10**6 + i].lang_pred)[0] == "und") == blank
    assert identify(empty).count() == 0
    assert {r.lang_pred for r in identify(docs.limit(20).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# --- licences --------------------------------------------------------------------------


def brute_license(text):
    import re

    said = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", said)
    places, labels = [], set()
    for phrase, label in {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}.items():
        p = phrase.split()
        at = [i for i in range(len(found)) if found[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    best = {}
    lines = said.split("\n")
    paragraphs, held = [], []
    for line in lines:
        if line == "":
            paragraphs.append(held)
            held = []
        else:
            held.append(line)
    blocks = lines + ["\n".join(p) for p in [*paragraphs, held]]
    for block in blocks:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", block)
        for label, template in TEMPLATES:
            want, reach = set(words_of(template)), 2 * len(words_of(template))
            if len(want & set(own)) < 0.9 * len(want) - 1e-9:
                continue
            both = max(len(want & set(own[i : i + reach])) for i in range(max(1, len(own) - reach + 1)))
            if both >= 0.9 * len(want) - 1e-9:
                best[label] = max(best.get(label, 0), both / len(want))
    score = 1.0 if labels else max(best.values(), default=0.0)
    return len(found), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | best.keys())), score


def test_licenses(spark, awkward, empty):
    rng = random.Random(3)
    texts = ["MIT-License; the Apache  License and general public license", "mit\nlicense MIT LICENSE mit license", "xmit license", "Licensed under CC BY-NC 4.0.", "licensed under cc by sa 4 0", None]
    for _, t in TEMPLATES:
        w = t.split()
        texts += [t, f"{words(rng, 20)}\n{t}\n{words(rng, 9)}", "\n".join(w), f"{words(rng, 3)}\n\n" + "\n".join(w), " ".join(w[: len(w) * 4 // 5]), " ".join(x for x in w if rng.random() < 0.95)]
    far = [f" {words(rng, 60)} ".join(t.split()) for _, t in TEMPLATES]  # all words of a template in one long line, but not together
    texts += far + [f"{far[0]} {TEMPLATES[0][1]} {words(rng, 300)}"]
    docs = rows_of(spark, texts).unionByName(awkward.select("doc_id", "text", "lang", "source", "n_chars").filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).withColumn("doc_id", F.col("doc_id") + 1000))
    got = {r.doc_id: tuple(r)[1:] for r in scan_licenses(docs).collect()}
    assert got == {r.doc_id: brute_license(r.text) for r in docs.collect()}
    apart = range(len(texts) - 1 - len(far), len(texts) - 1)
    assert all(got[i][5] == got[i][4] for i in apart) and TEMPLATES[0][0] in got[len(texts) - 1][5]
    assert scan_licenses(empty).count() == 0 and scan_licenses(awkward).count() == awkward.count()


# --- near duplicates -------------------------------------------------------------------


def brute_classes(rows, least=0.8):
    bags = []
    for d, t in rows:
        w = words_of(t or "")
        bags.append((d, Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (Counter([tuple(w)]) if w else Counter())))
    a, b = [], []
    for i, (d, x) in enumerate(bags):
        for e, y in bags[:i]:
            n = sum((x & y).values())
            if n and n >= least * (sum(x.values()) + sum(y.values()) - n):
                a.append(d)
                b.append(e)
    return forest(a, b)


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(1)
    a = {i: int(rng.integers(1, 9)) for i in range(60)}
    b = {i: int(rng.integers(1, 9)) for i in range(20, 90)}
    want = sum(min(a.get(k, 0), b.get(k, 0)) for k in range(90)) / sum(max(a.get(k, 0), b.get(k, 0)) for k in range(90))
    got = []
    for seed in range(12):
        flat = [(0, k, w) for k, w in a.items()] + [(1, k, w) for k, w in b.items()]
        keys = np.array([(k + 1) * 1_000_003 + seed * 7_919_777 for _, k, _ in flat], np.uint64)
        s = bag_signatures(np.array([d for d, _, _ in flat]), keys, np.array([w for _, _, w in flat]), 2, 512)
        got.append((s[0] == s[1]).mean())
    assert abs(np.mean(got) - want) < 0.02


def test_near_duplicates_match_brute_force(spark, awkward, empty):
    rng = random.Random(11)
    texts = [words(rng, rng.randrange(1, 120)) for _ in range(60)]
    for i in range(40):  # copies with edits: chains of likeness
        w = texts[i].split()
        for j in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"e{i}{j}"
        texts.append(" ".join(w))
    hot = words(rng, 150).split()
    for _ in range(60):
        w = hot[:]
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(len(w))] = f"h{rng.randrange(99)}"
        texts.append(" ".join(w))
    texts += ["a a a a a a a a a a a a", "a a a a a a a a a a a a a", "x y z", "X, y; z", "", "", None, "..."]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.class_id, r.kept) for r in near_duplicates(rows_of(spark, texts)).collect()}
    want = brute_classes(rows)
    assert got == {d: (want.get(d, d), want.get(d, d) == d) for d, _ in rows}
    dealt = {r.doc_id: r.class_id for r in near_duplicates(rows_of(spark, texts), per_block=6).collect()}
    assert dealt == {d: want.get(d, d) for d, _ in rows}
    assert near_duplicates(empty).count() == 0
    odd = near_duplicates(awkward)
    assert odd.count() == awkward.count() and odd.filter("doc_id IS NULL").first().kept


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    want = {x: t for x, t in forest([a for a, b in links if a != b], [b for a, b in links if a != b]).items()}
    for each in (10, 10**6):
        assert {r.id: r.component for r in components(df, per_part=each).collect()} == want
    assert components(df.limit(0)).count() == 0


# --- substring dedup -------------------------------------------------------------------


def test_shared_passages_go_once(spark, awkward, empty):
    rng = random.Random(4)
    shared = [words(rng, 60, 10**6) for _ in range(5)]
    clean = [words(rng, rng.randrange(20, 400), 10**6) for _ in range(30)]
    notice = "Licensed under the terms of this short notice, see the file."
    texts = [f"{c}\n{notice}" for c in clean]
    holders = {}
    for k, passage in enumerate(shared):
        for _ in range(4):
            i = len(texts)
            holders.setdefault(k, []).append(i)
            texts.append(f"{words(rng, rng.randrange(0, 50), 10**6)} {passage} {words(rng, rng.randrange(0, 50), 10**6)}".strip())
    got = {r.row.doc_id: r for r in without_repeats(rows_of(spark, texts)).collect()}
    for i in range(30):
        assert got[i].text == texts[i] and got[i].lost == 0
    for k, own in holders.items():
        assert [shared[k] in got[i].text for i in own] == [True, False, False, False]
        middle = " ".join(shared[k].split()[25:35])
        assert sum(middle in got[i].text for i in own) == 1
    for i, t in enumerate(texts):  # the spans say what went
        raw = t.encode()
        for s in reversed(got[i].removed):
            raw = raw[: s["from"]] + raw[s["until"] :]
        assert raw.decode() == got[i].text
    odd = without_repeats(awkward)
    assert odd.count() == awkward.count() and repeats_removed(awkward).columns == awkward.columns
    assert odd.filter("text IS NULL").count() == awkward.filter("text IS NULL").count()
    assert without_repeats(empty).count() == 0


def test_insertions_shift_nothing(spark):
    rng = random.Random(9)
    base = words(rng, 300, 10**6)
    w = base.split()
    other = " ".join([*w[:150], "inserted", "words", "here", *w[150:]])
    got = {r.row.doc_id: r.text for r in without_repeats(rows_of(spark, [base, other])).collect()}
    assert got[0] == base and "inserted words here" in got[1] and len(got[1].split()) < 60


# --- vectors ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(240):
        v = rng.standard_normal(16)
        if i % 4 == 1:
            v = np.array(rows[-1][1]) + 0.05 * rng.standard_normal(16)
        rows.append((i, [float(x) for x in v], i // 60 % 2))
    rows += [(300, rows[0][1], 0), (301, [2 * x for x in rows[0][1]], 0), (302, None, 0), (303, [0.0] * 16, 0), (304, [float("nan")] + [1.0] * 15, 0), (305, [None] + [1.0] * 15, 0), (306, [1.0] * 3, 0), (307, rows[0][1], None), (308, [float("inf")] + [1.0] * 15, 0), (300, rows[0][1], 0), (None, rows[0][1], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rank", F.lit("x")).withColumn("block", F.lit(2))


def sound(rows):
    return {r.vec_id: (np.array(r.embedding), r.label) for r in rows if r.vec_id is not None and r.embedding and len(r.embedding) == 16 and all(x is not None and np.isfinite(x) for x in r.embedding) and any(r.embedding)}


def test_nearest(spark, odd_vectors):
    good = sound(odd_vectors.collect())
    got = nearest(odd_vectors, odd_vectors.filter("vec_id % 10 = 0"), k=5, per_block=50).toPandas()
    asked = [i for i in good if i % 10 == 0]
    assert set(got.query_id) == set(asked)
    for i in asked:
        far = sorted((float(np.sqrt(((v - good[i][0]) ** 2).sum())), j) for j, (v, _) in good.items() if j != i)[:5]
        own = got[got.query_id == i].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and own.vec_id.tolist() == [j for _, j in far] and np.allclose(own.score, [f for f, _ in far])
    assert nearest(odd_vectors.limit(0), odd_vectors.limit(0)).count() == 0


def test_repeated_vec_ids(spark):
    """Unsound twins of a query or row count for nothing; of sound ones the smallest vector does."""
    rng = np.random.default_rng(3)
    base = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(40)]
    odd = [(0, None), (0, [1.0]), (10, [float("nan")] * 8), (20, [9.0] * 8), (30, [0.0] * 8), (7, None), (8, [5.0] * 8)]
    good = dict(base)
    for i, v in odd:
        if v and len(v) == 8 and np.isfinite(v).all() and any(v):
            good[i] = min(good[i], v)
    want = []
    for i in (0, 10, 20, 30):
        far = sorted((float(np.sqrt(((np.array(v) - np.array(good[i])) ** 2).sum())), j) for j, v in good.items() if j != i)[:5]
        want += [(i, r, j, round(f, 9)) for r, (f, j) in enumerate(far, 1)]
    for rows in (base + odd, odd + base[::-1]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
        got = nearest(df, df.filter("vec_id % 10 = 0"), k=5)
        assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got.collect()) == want
        links = near_vectors(df.withColumn("label", F.lit(1)))
        assert links.count() == len(rows)


def test_equal_vectors_do_not_hide_others(spark):
    """A vector with many copies near a query leaves room for all that is nearer."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(16)]) for i in range(900)]
    common = [float(x) for x in rng.standard_normal(16)]
    rows += [(1000 + i, common) for i in range(2000)] + [(5000, [x + 0.01 for x in common]), (5001, [x + 0.001 for x in common])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(df, df.filter("vec_id IN (5000, 1000)"), k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(1000, 1001), (1000, 1002), (1000, 1003), (5000, 5001), (5000, 1000), (5000, 1001)]


def test_recall_of_the_forest(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = {r.vec_id: np.array(r.embedding, np.float64) for r in rows.collect()}
    ids = np.array(sorted(x))
    m = np.stack([x[i] for i in ids])
    got = nearest(rows, rows.filter("vec_id % 100 = 0")).toPandas()
    hit = n = 0
    for i in ids[ids % 100 == 0]:
        far = np.sqrt(((m - x[i]) ** 2).sum(axis=1))
        far[ids == i] = np.inf
        best = set(ids[np.lexsort((ids, far))[:10]])
        hit, n = hit + len(best & set(got[got.query_id == i].vec_id)), n + 10
    assert hit / n >= 0.95


@pytest.mark.parametrize("per_block", [2048, 7])
def test_near_vectors(spark, odd_vectors, per_block):
    good = {i: (v, k) for i, (v, k) in sound(odd_vectors.collect()).items() if k is not None}
    a, b = [], []
    links = Counter()
    for i, (v, k) in good.items():
        for j, (u, m) in good.items():
            if i != j and k == m and v @ u / np.sqrt((v @ v) * (u @ u)) >= 0.93:
                links[i] += 1
                a.append(i)
                b.append(j)
    want = forest(a, b)
    got = near_vectors(odd_vectors, pivots=24, names=8, per_block=per_block).toPandas()
    assert len(got) == odd_vectors.count()
    found = total = 0
    for r in got[got.vec_id.notna()].itertuples():
        i = int(r.vec_id)
        assert r.n_links <= links[i] and (r.component_id == want.get(i, i) or r.n_links < links[i])
        found, total = found + r.n_links, total + links[i]
    assert found >= 0.97 * total
    assert near_vectors(odd_vectors.limit(0)).count() == 0


def test_near_vectors_with_all_pivots_named(spark, odd_vectors):
    """Where every vector names every pivot all pairs are candidates: links and components are those of brute force."""
    good = {i: (v, k) for i, (v, k) in sound(odd_vectors.collect()).items() if k is not None}
    a, b, links = [], [], Counter()
    for i, (v, k) in good.items():
        for j, (u, m) in good.items():
            if i != j and k == m and v @ u / np.sqrt((v @ v) * (u @ u)) >= 0.93:
                links[i] += 1
                a.append(i)
                b.append(j)
    want = forest(a, b)
    for per_block in (2048, 11):
        got = near_vectors(odd_vectors, pivots=24, names=24, per_block=per_block)
        told = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got.collect()}
        assert told == {i: (links[i], want.get(i, i), i is None or want.get(i, i) == i) for i in {r.vec_id for r in odd_vectors.collect()}}


# --- mixing ----------------------------------------------------------------------------


def brute_targets(sizes, share=1.5, most=2.0):
    """Sources in order, weights 5, 2, 1; what stands above its limit is closed and the rest shared anew."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), list(order), dict.fromkeys(order, 0.0)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if weight[s] * unit > most * sizes[s]]
        for s in above or open_:
            target[s] = most * sizes[s] if above else weight[s] * unit
        if not above:
            break
        left -= sum(target[s] for s in above)
        open_ = [s for s in open_ if s not in above]
    return target


def targets(spark, sizes, **options):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    return {r.source: r.target for r in mix_targets(rows, **options).collect()}


def test_targets(spark):
    rng = random.Random(6)
    many = {f"s{rng.randrange(10**6)}": rng.choice([0, 1, rng.randrange(10), rng.randrange(10**6)]) for _ in range(200)}
    for sizes in ({"b": 100, "a": 10, None: 50, "c": 40}, {}, {"a": 0}, many | {"": 7, "\U0001f600": 3, "\ue000": 900, None: 12}):
        assert targets(spark, sizes) == pytest.approx(brute_targets(sizes))
    # weights 5, 2, 1 by order: a, b, c
    assert targets(spark, {"a": 1000, "b": 1000, "c": 1000}, share=0.5) == pytest.approx({"a": 937.5, "b": 375, "c": 187.5})


def test_pivot_keeps_mass_and_expectation():
    size = np.array([3, 5, 2, 7, 4, 6])
    total = np.zeros(6)
    for seed in range(4000):
        p = np.full(6, 0.4)
        left = pivot(size, p, np.random.default_rng(seed))
        assert abs((p * size).sum() - 0.4 * size.sum()) < 1e-6
        assert all(x in (0, 1) for i, x in enumerate(p) if i != left)
        total += p
    assert np.abs(total / 4000 - 0.4).max() < 0.04


def test_mix(spark, awkward, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mix(docs, per_chunk=40, fan_in=3).toPandas()
    assert len(got) == docs.count() and (got.taken <= 2 * got["size"]).all()
    import re

    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs.collect()}
    assert got.set_index("doc_id")["size"].to_dict() == size
    by = got.groupby("source").agg(t=("target", "first"), n=("taken", "sum"), most=("size", "max"), whole=("source_size", "first"), own=("size", "sum"))
    assert ((by.n - by.t).abs() <= by.most).all() and (by.whole == by.own).all() and abs(by.t.sum() - 1.5 * by.own.sum()) < 1e-6
    again = mix(docs.repartition(7), per_chunk=40, fan_in=3).toPandas()
    assert got.set_index("doc_id").taken.to_dict() == again.set_index("doc_id").taken.to_dict()
    odd = mix(awkward)
    assert odd.count() == awkward.count() and odd.filter("source IS NULL").count() == awkward.filter("source IS NULL").count()
    assert mix(empty).count() == 0
    many = mixed_documents(awkward)
    assert many.columns == awkward.columns and many.count() == odd.agg(F.sum(F.when(F.col("size") == 0, 1).otherwise(F.col("copies")))).first()[0]


# --- the pipeline ----------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept[name] = docs.count()
    assert kept["quality classifier"] >= kept["minhash near-dedup"] >= kept["substring dedup"] > 0
    two = spark.read.parquet(str(tmp_path / "1"))
    assert two.count() == two.select("doc_id").distinct().count()
    assert near_duplicates(two).filter("NOT kept").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == kept["best-fit packing"]


def test_stages_take_awkward_rows(spark, awkward, empty):
    """Every stage takes nulls, repeated rows, repeated ids and columns with any names, whose values stay."""
    import corpus_pipeline

    many = spark.read.parquet(f"{SF}/documents.parquet").select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHING))
    for docs in (awkward, many):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "best-fit packing":
                assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
                for r in out.select(*CLASHING).distinct().collect():
                    assert r.asDict() == {c: f"own {c}" for c in CLASHING}, name
            assert out.count() > 0
            assert stage(spark, empty.select("*", *(F.lit("x").alias(c) for c in CLASHING)), SF).count() == 0


def test_rows_of_one_id(spark):
    """Texts of one doc_id are told apart: only those in another's class go."""
    import corpus_pipeline

    rng = random.Random(8)
    a, b, c, d = (words(rng, 90) for _ in range(4))
    rows = [(1, a), (2, f"{a} end"), (2, b), (2, b), (3, f"{b} end"), (4, c), (4, f"{c} end"), (4, d), (5, None), (5, ""), (5, "..."), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicate(spark, docs, SF).collect()), key=repr)
    near = {(r.doc_id, r.class_id) for r in near_duplicates(docs).collect()}
    assert near == {(1, 1), (2, 1), (2, 2), (3, 2), (4, 4), (5, 5), (None, None)}
    one = [t for i, t in got if i == 4]
    assert len(one) == 2 and d in one
    assert [x for x in got if x[0] != 4] == sorted([(1, a), (2, b), (5, None), (5, ""), (5, "..."), (None, a), (None, a)], key=repr)


def test_stages_take_empty_tables(spark, empty):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_registered():
    from stratalith.llm.queries import queries

    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))
    assert json.dumps(sorted(queries()))
