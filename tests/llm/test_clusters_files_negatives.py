"""Sort-means, token files and hard negatives against SQL, libraries, brute force and awkward rows."""

import hashlib
import uuid
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratalith.llm.hard_negatives import hard_negatives, op13_hard_negatives
from stratalith.llm.queries import oracle_sql
from stratalith.llm.sort_means import centroid_order, cluster_vectors, nearest_centroid, op11_sort_means
from stratalith.llm.token_files import op12_token_files, re_pair, read_documents, read_stretches, write_tokens

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("word_bpe_49k.json")
AWKWARD = "vec_id long, embedding array<double>, label int, v string, cluster int, distance string"


@pytest.mark.parametrize("query", [op11_sort_means, op13_hard_negatives])
def test_against_sql(spark, query):
    df = query(spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    found = con.execute(oracle_sql()[query.__name__])
    assert [c[0] for c in found.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(found.fetchall())


def test_sort_means_walks_less_and_finds_the_nearest():
    rng = np.random.default_rng(5)
    middles = rng.integers(-200, 200, (30, 8))
    x = middles[rng.integers(0, 30, 2000)] + rng.integers(-3, 4, (2000, 8))
    centroids = np.concatenate([middles, middles[:3]])  # equal centroids: the smaller number wins
    plain = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    for start in (np.zeros(2000, np.int64), plain.argmin(axis=1)):
        cluster, far, measured = nearest_centroid(x, start, centroids, *centroid_order(centroids))
        assert (cluster == plain.argmin(axis=1)).all() and (far == plain.min(axis=1)).all()
    assert measured < plain.size / 8


def brute_means(rows, k, rounds, seed, d):
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centroids = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        centroids = [[sum(x) // len(g) for x in zip(*g, strict=True)] if (g := [v for (_, v), o in zip(kept, own, strict=True) if o == c]) else centroids[c] for c in range(len(centroids))]
    last = [(i, *near(v)) for i, v in kept]
    return sorted([(i, c, far, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, far, c in last], key=repr)


def test_sort_means_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 5), -0.3 * i, 0.0]) for i in range(40)]
    rows += [(7, [1.0, 1.0, 1.0]), (7, [1.0, 1.0, 1.0]), (None, [0.5, 0.5, 0.5]), (41, None), (42, [1.0, None, 2.0]), (43, [nan, 1.0, 1.0]), (44, [inf, 1.0, 1.0]), (45, [1.0, 2.0]), (46, []), (47, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "v", 3, "x") for i, v in rows], AWKWARD)
    for parts in (1, 7):
        got = cluster_vectors(df.repartition(parts), k=6, rounds=3, d=3).collect()
        assert sorted([(r["vec_id"], r["cluster"], r["distance"], r["centroid_sha256"]) for r in got], key=repr) == brute_means(rows, 6, 3, 2, 3)
        assert {r["inertia"] for r in got} == {sum(r["distance"] for r in got)}
        for c in {r["cluster"] for r in got}:
            assert {r["cluster_inertia"] for r in got if r["cluster"] == c} == {sum(r["distance"] for r in got if r["cluster"] == c)}
    assert len(cluster_vectors(df.limit(3), k=6, d=3).collect()) == 3
    assert cluster_vectors(df.filter("false"), d=3).collect() == []


def brute_negatives(rows, step, positives=5, negatives=5):
    taken = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v):
            taken[i] = min(taken.get(i, (str(label), [int(np.floor(256 * x)) for x in v])), (str(label), [int(np.floor(256 * x)) for x in v]))
    out = []
    for a, (label, v) in taken.items():
        if a % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), b, own == label) for b, (own, w) in taken.items() if b != a)
        for s, b, _ in [x for x in scored if x[2]][:positives]:
            below = [x for x in scored if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s][:negatives]
            out += [(a, b, r + 1, x[1], -s, -x[0]) for r, x in enumerate(below)]
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 7])
def test_hard_negatives_awkward_rows(spark, parts):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(size=6).round(2).tolist(), int(rng.integers(0, 3))) for i in range(150)]
    rows += [(200 + i, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0], i % 2) for i in range(60)]  # copies, anchors among them
    rows += [(300, None, 1), (301, [float("nan")] * 6, 1), (302, [1.0] * 6, None), (303, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (None, [1.0] * 6, 1), (304, [1.0, 2.0], 1), (305, [], 1), (306, [0.0] * 6, 0), (310, [0.0] * 6, 2), (5, rows[5][1], rows[5][2]), (7, [9.0] * 6, 0)]
    df = spark.createDataFrame([(i, v, label, "v", 3, "x") for i, v, label in rows], AWKWARD).repartition(parts)
    got = hard_negatives(df, F.col("vec_id") % 5 == 0, per_pivot=4, per_block=40, per_anchors=8)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, 5)
    assert hard_negatives(df.filter("false"), F.col("vec_id") % 5 == 0).collect() == []
    assert hard_negatives(df.filter("label = 1"), F.col("vec_id") % 5 == 0).collect() == []


def test_cells_that_cannot_serve_get_no_candidates():
    from stratalith.llm.hard_negatives import Cells

    rng = np.random.default_rng(1)
    pivots = np.eye(8) * 1000
    cells = Cells(pivots, 1.1e6)
    anchors = np.repeat(pivots, 20, axis=0) + rng.integers(-20, 20, (160, 8))
    cell, far = cells.nearest(anchors)
    for c in range(8):
        cells.radius[c], cells.norm[c] = far[cell == c].max(), (anchors[cell == c] ** 2).sum(axis=1).max()
    x = np.repeat(pivots, 50, axis=0) + rng.integers(-20, 20, (400, 8))
    least, most = cells.bounds(x)
    scores = x @ anchors.T
    for c in range(8):
        own = scores[:, cell == c]
        assert (least[:, c] <= own.min(axis=1)).all() and (most[:, c] >= own.max(axis=1)).all()
    assert (most >= 500_000).sum() == 400  # each candidate serves one cell of eight


def ids_of(texts):
    t = Tokenizer.from_file(PATH)
    return [[*x.ids, 2] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_whole_table(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    want, upto = [], 0
    for r, ids in zip(docs, ids_of([r["text"] for r in docs]), strict=True):
        want.append((r["doc_id"], upto, len(ids), crc(ids)))
        upto += len(ids)
    assert sorted(map(tuple, op12_token_files(spark, SF).collect())) == want


def test_token_files_awkward_rows(spark, tmp_path):
    long = "one two three " * 30_000 + "end"
    rows = [(5, "b"), (5, "a"), (5, "a"), (None, "no id"), (None, None), (3, ""), (2, None), (-7, "Ünïcode ﬃ Σς <|endoftext|> x"), (9, long), (8, "it's we'll 12 !!??"), (1, "\U0001f600 \U00033333"), *[(6, "same")] * 400]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, part int")
    for parts in (1, 5):
        folder = f"{tmp_path}/{uuid.uuid4().hex}"
        write_tokens(df.repartition(parts), folder, PATH, per_block=1000, per_part=300)
        got = read_documents(spark, folder, with_ids=True).orderBy("start").collect()
        assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda x: (x is not None, x))
        assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
        made = ids_of([t for _, t in rows])
        assert sorted(((r["doc_id"], r["ids"], r["ids_crc32"]) for r in got), key=repr) == sorted(((i, x, crc(x)) for (i, _), x in zip(rows, made, strict=True)), key=repr)
        asked = spark.createDataFrame([(9, 40_000, 7), (9, 0, 3), (9, 89_999, 100), (8, 2, 3), (3, 0, 5), (3, 9, 5), (77, 0, 1)], "doc_id long, start long, length long")
        whole = {i: x for (i, _), x in zip(rows, made, strict=True)}
        want = [(i, s, whole[i][s : s + n]) for i, s, n in [(9, 40_000, 7), (9, 0, 3), (9, 89_999, 100), (8, 2, 3), (3, 0, 5), (3, 9, 5)]]
        assert sorted(map(tuple, read_stretches(spark, folder, asked).collect())) == sorted(want)
        blocks = spark.read.parquet(folder)
        assert blocks.select(F.max("docs")).first()[0] < 400  # repeated rows are dealt over tasks and blocks
        big = blocks.filter("n_tokens > 50000").select(F.length("symbols").alias("s"), "n_tokens").first()
        assert big["s"] < big["n_tokens"]  # two bytes an id without rules
    folder = f"{tmp_path}/none"
    write_tokens(df.filter("false"), folder, PATH)
    assert read_documents(spark, folder).collect() == []


@pytest.mark.parametrize("rounds", [1, 5, 40])
def test_re_pair_round_trip(rounds):
    rng = np.random.default_rng(rounds)
    docs = [rng.integers(0, 4, int(n)) for n in rng.integers(1, 400, 60)] + [np.zeros(5000, int), np.tile([1, 2, 3], 999), np.array([3])]
    ids, ends = np.concatenate(docs).astype(np.uint32), np.cumsum([len(x) for x in docs])
    grammar, at = re_pair(ids, ends, 4, least=2, rounds=rounds)
    assert (grammar.expand(0, len(grammar.symbols)) == ids).all()
    begins = np.concatenate([[0], at[:-1]])
    for k, x in enumerate(docs):  # no rule reaches over the end of a document
        assert (grammar.expand(begins[k], at[k]) == x).all()
        a = len(x) // 3
        assert (grammar.stretch(begins[k], at[k], a, 17) == x[a : a + 17]).all()
    assert all(max(pair) < 4 + i for i, pair in enumerate(grammar.rules.tolist()))
    assert len(grammar.symbols) < len(ids) * (0.75 if rounds == 1 else 0.6)
