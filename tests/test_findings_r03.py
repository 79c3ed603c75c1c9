"""What the third round of findings brought to light."""

import re

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalith.llm.best_fit_packing import encoder, tokenized_pieces
from stratalith.llm.textvec import utf8_chunks
from stratalith.operators import asof, batches, extraction, graph, metrics, overlap, retrieval, sequences
from stratalith.plans.registry import QUERIES, SQL
from stratalith.sources import vector_index
from stratalith.sources.inverted_index import InvertedIndex


@pytest.mark.parametrize("n", [1, 1023, 1024, 1025, 2047, 2048, 3000])
def test_only_the_first_piece_is_shorter(spark, n):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = encoder(path).whole("a1" * ((n - 1) // 2) + "!" * ((n - 1) % 2))
    docs = spark.createDataFrame([(7, "a1" * ((n - 1) // 2) + "!" * ((n - 1) % 2))], "doc_id long, text string")
    got = [(r.piece, r.start, r.length) for r in tokenized_pieces(docs, path).orderBy("piece").collect()]
    total = len(whole) + 1
    first = (total - 1) % 1024 + 1
    assert got == [(0, 0, first), *((k + 1, s, 1024) for k, s in enumerate(range(first, total, 1024)))]


def test_pieces_of_new_code_points():
    """Letters and numbers that this Python's tables don't know are split as the library does."""
    lib = encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", "aꟋ's xꟜ'll plain", "plain", "\U000105c0've", "ꟋꟋ't", "Ɤ" * 9]
    for _, _, data, offsets in utf8_chunks(pa.array(texts)):
        ids, at = lib.chunk(data, offsets)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [lib.whole(t).tolist() for t in texts]


def test_model_scores_of_broken_prices(spark, tmp_path):
    """Prices round to even as in SQL, and what just fits, fits."""
    prices = [1499.5, 1500.5, 1500.0, 3000.0, 900.5, 901.5, 999.51, 1249.5, 50.0, None, -0.5]
    rows = [(i * 8 + j, s, p) for i, (s, p) in enumerate((s, p) for s in (21, 42, 13, 14, 1, None) for p in prices) for j in (1, 2)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = sorted((r.p_partkey, r.score) for r in QUERIES["model_scores"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert got == sorted(con.execute(SQL["model_scores"]).fetchall())


def test_shortest_paths_from_the_side_with_fewer_ends(spark):
    """One goal of many starts is searched from the goal: no start keeps rows of its own; of equal paths the smallest."""
    edges = spark.createDataFrame([(i, i // 3) for i in range(3, 400)] + [(i, i // 3 + 1) for i in range(3, 400)], "src long, dst long")
    pairs = edges.select(F.col("src").alias("start"), F.lit(1).cast("long").alias("goal")).distinct()
    links: dict[int, list[int]] = {}
    for r in edges.collect():
        links.setdefault(r.src, []).append(r.dst)

    def smallest(start):
        level, seen = [[start]], {start}
        while level:
            done = [p for p in level if p[-1] == 1]
            if done:
                return min(done)
            level = [[*p, x] for p in level for x in links.get(p[-1], []) if x not in seen]
            seen |= {p[-1] for p in level}
        return None

    got = {r.start: r.path for r in graph.shortest_paths(edges, pairs).collect()}
    want = {r.start: smallest(r.start) for r in pairs.collect()}
    assert got == {k: v for k, v in want.items() if v}
    taken = []
    own = graph._spread_out
    graph._spread_out = lambda known, *a, **k: taken.append(known.count()) or own(known, *a, **k)
    try:
        graph.shortest_paths(edges, pairs)
    finally:
        graph._spread_out = own
    assert taken == [1]


def test_equal_ranges_are_joined_once(spark):
    one = spark.range(3000).select(F.lit("a").alias("path"), F.col("id").alias("k"), F.lit(1).alias("start_line"), F.lit(4).alias("end_line"))
    two = spark.range(5000).select(F.lit("a").alias("path"), F.col("id").alias("k"), F.lit(3).alias("start_line"), F.lit(9).alias("end_line"))
    met = overlap.overlap_totals(one, two, ["path"], "k")
    assert {tuple(r) for r in met.select("n", "first", "total").collect()} == {(5000, 0, 4999 * 2500)} and met.count() == 3000
    assert overlap.overlap_totals(one, two.filter("false"), ["path"], "k").count() == 0


@pytest.mark.parametrize("k", [1, 5, 30])
def test_block_scores_keep_ties(k):
    """The best of a block are those of a stable sort of all rounded scores."""
    rng = np.random.default_rng(k)
    x = rng.integers(-2, 3, (700, 4)).astype(float)
    x[5] = np.nan
    ids = rng.permutation(700)
    rows = pd.DataFrame({"id": ids, "vec": list(x)})
    asked = pd.DataFrame({"qid": ids[::7], "vec": list(x[::7])})
    got = retrieval._block_scores(k, None, True)(asked, rows)
    unit = retrieval._unit(rows["vec"])
    want = set()
    for qid, q in zip(asked["qid"], retrieval._unit(asked["vec"]), strict=True):
        near = sorted((-s, i) for s, i in zip(np.round(unit @ q, 14) + 0.0, ids, strict=True) if i != qid and not np.isnan(s))
        want |= {(int(qid), int(i), float(-s)) for s, i in near[:k]}
    assert {(int(a), int(b)) for a, b in zip(got["qid"], got["id"], strict=True)} == {w[:2] for w in want}


def test_tasks_hand_on_small_frames():
    """What a task holds has a bound, however many rows a batch holds or makes."""
    files = pd.DataFrame({"path": [f"{i}.ts" for i in range(300)], "content": [("x" * 190 + "\n") * 60] * 300, "language": "typescript"})
    windows = batches.handing(sequences._windowing(512, 50, 50), ["path", "content"], ["path", "line_start", "line_end", "content"])
    made = list(windows(iter([files])))
    assert len(made) > 1 and max(f["content"].str.len().sum() for f in made) < 2 * batches.HELD
    alone = [f for i in range(300) for f in windows(iter([files[i : i + 1]]))]
    assert pd.concat(made).values.tolist() == pd.concat(alone).values.tolist()
    ids = np.arange(400)
    probe = vector_index._probing(ids, np.eye(400)[:, :8] + 0.01, np.full(400, 3.0), 8, 5, True)
    asked = pd.DataFrame({"qid": np.arange(2000), "vec": list(np.ones((2000, 8))), "n": 0, "worst": -2.0})
    frames = list(probe(iter([asked])))
    assert sum(map(len, frames)) == 2000 * 392 and max(map(len, frames)) <= vector_index.MOST_PROBES


def test_small_files_are_dealt(spark, tmp_path):
    """A file of few bytes and many rows isn't the work of one task."""
    spark.range(45_000).select(F.concat(F.col("id").cast("string"), F.lit(".ts")).alias("path"), F.lit("function f() {}").alias("content")).coalesce(1).write.parquet(f"{tmp_path}/f")
    rows = extraction.extract_symbols(spark.read.parquet(f"{tmp_path}/f"))
    assert rows.rdd.getNumPartitions() == 5 and rows.count() == 45_000


def test_ranges_of_asof_are_bounded(spark):
    left = spark.range(900).select((F.col("id") % 7).alias("k"), F.col("id").alias("t"))
    right = spark.range(0, 900, 5).select((F.col("id") % 7).alias("k"), F.col("id").alias("ts"), F.col("id").alias("v"))
    got = {(r.k, r.t): r.found and r.found.v for r in asof.asof_join(left, right, ["k"], "t", "ts", each=40).collect()}
    assert got == {(t % 7, t): max((v for v in range(0, t + 1, 5) if v % 7 == t % 7), default=None) for t in range(900)}


def _shuffled(spark) -> int:
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_postings_are_shuffled_once_in_blocks_of_bounded_size(spark, tmp_path):
    """A block has no more than its number of postings however ids lie, and a change moves less than its texts."""
    rng = np.random.default_rng(3)
    texts = [(int(i), " ".join(f"w{x:09d}" for x in rng.integers(0, 400, 60)) + " always") for i in [*range(3000), *range(10**12, 10**12 + 9)]]
    docs = spark.createDataFrame([*texts, (5, "a always"), (None, "always")], "id long, text string").repartition(4).localCheckpoint()
    index = InvertedIndex(spark, str(tmp_path / "i"), per_block=32, buckets=4)
    before = _shuffled(spark)
    index.update(docs)
    assert _shuffled(spark) - before < sum(len(t) for _, t in texts) * 0.75
    blocks = spark.read.parquet(str(tmp_path / "i" / "postings"))
    n, rows, most = blocks.filter("term = 'always'").agg(F.sum("n"), F.count("*"), F.max("n")).first()
    assert (n, most) == (3009, 32) and rows < 3009 / 32 + 8
    assert blocks.agg(F.max("n")).first()[0] <= 32
    assert index.search(spark.createDataFrame([(1, "always")], "qid long, text string"), 4000).hits.count() == 3009


def test_names_are_looked_for_once_and_like_chunks_found_in_slices(spark, monkeypatch):
    """Chunks of one name share its answer; of chunks without a like, and with, no slice is left out."""
    rows = lambda xs, path="p": [(i, path, s, "function", t, "f()", "public", True, 1, v) for i, s, t, v in xs]
    kinds = "id string, path string, symbol string, kind string, content string, signature string, visibility string, exported boolean, complexity int, vec array<float>"
    code = spark.createDataFrame(rows([(f"c{i}", f"n{i % 3}", "", [1.0, 0.0, 0.0]) for i in range(60)]) + rows([("x", None, "", [1.0, 0.0, 0.0]), ("y", "n9", "", [0.0, 0.0, 1.0])]) + rows([("z", "n0", "", [1.0, 0.0, 0.0])], None), kinds)
    docs = spark.createDataFrame(rows([("d0", "other", "tells of N0", [0.0, 1.0, 0.0]), ("d1", "n1", None, None)]) + rows([(f"e{i}", "q", None, [0.0, 1.0, 0.0]) for i in range(40)] + [("f", "q", None, [0.0, 0.0, 2.0])], "r"), kinds)
    from stratalith.operators import incoherence

    # a null symbol stands for the empty one, which every text holds; z has no path, y has a like
    want = {*(f"c{i}" for i in range(60) if i % 3 == 2), "z"}
    for few_names in (5000, 0):
        monkeypatch.setattr(incoherence, "FEW_NAMES", few_names)
        assert {r.id for r in incoherence.missing(code, docs).collect()} == want
    for first in (1, 7, 1000):
        assert {r.id for r in incoherence.resembling(code, docs, 0.5, first).collect()} == {"y"}


def test_halstead_reads_long_strings(spark):
    """A string of many characters is one operand, and doesn't overflow the stack."""
    text = "a ?. b ?.( c ?? '" + "it\\'s new " * 30_000 + "' + `x\n\\` y` === 1.5 // gone\n" + '"open'
    h = spark.createDataFrame([(text,)], "t string").select(metrics.halstead(F.col("t")).alias("h")).first()["h"]
    found = {op: text.replace(" // gone", " ").count(op) for op in metrics.OPERATORS}
    assert (h["operators"], h["unique_operators"]) == (sum(found.values()), sum(n > 0 for n in found.values()))
    plain = re.sub(r"(?m)//.*$", "", text)
    operands = [w for w in re.findall(r"\b[a-zA-Z_]\w*\b", plain) if w not in metrics.OPERATORS] + re.findall(r"\b\d+(?:\.\d+)?\b", plain)
    operands += [m.group() for m in re.finditer(r"(['\"`])(?:(?!\1)[^\\]|\\.)*\1", plain)]
    assert (h["operands"], h["unique_operands"]) == (len(operands), len(set(operands)))
    assert len(operands) > 60_000


def test_closure_is_dealt_by_what_it_makes(spark):
    """Levels that grow within one plan, or that all end at one node, leave no partition with much more than its share."""
    fan = [(1000, i) for i in range(1, 4)] + [(i, 3 * i + k) for i in range(1, 40) for k in (1, 2, 3)]
    edges = spark.createDataFrame(fan, "src long, dst long")
    first = spark.range(2000, 2400).select(F.col("id").alias("seed"), F.lit(1000).cast("long").alias("id"), F.lit(0).alias("level"))
    known = graph._spread_out(first, edges, "seed", None, each=2000)
    assert known.count() == 400 * 121
    assert known.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 2 * 2000
    last = first.select("seed", F.col("id").alias("src"))
    near, made, hot = graph._near(last, edges.withColumn("step", F.lit(1)), 100)
    met = graph._met(last, near, hot, "seed", made // 100)
    assert (made, met.count(), hot.collect()) == (1200, 1200, [(1000, 12)])
    assert met.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 600


def _levels(links: dict[int, set[int]], seed: int) -> dict[int, int]:
    found: dict[int, int] = {}
    level, at = links.get(seed, set()), 1
    while level:
        found |= dict.fromkeys(level, at)
        level, at = {y for x in level for y in links.get(x, ())} - found.keys(), at + 1
    return found


@pytest.mark.parametrize(("kind", "seeds", "each"), [("chain", "all", 250_000), ("dense", "all", 200), ("dense", "some", 60)])
def test_closure_of_odd_graphs(spark, monkeypatch, kind, seeds, each):
    """Known rows stand in for edges where all sources are seeds; first levels stay right, with hot sources dealt out or not."""
    rng = np.random.default_rng(19)
    pairs = {"chain": [(i, i + 1) for i in range(10)] + [(10, 10), (7, 3)], "dense": rng.integers(0, 16, (48, 2)).tolist() + [(99, 98)]}[kind]
    links: dict[int, set[int]] = {}
    for a, b in pairs:
        links.setdefault(a, set()).add(b)
    own = graph._spread_out
    monkeypatch.setattr(graph, "_spread_out", lambda *a, **k: own(*a, **k, each=each))
    edges = spark.createDataFrame([*pairs, pairs[0], (None, 1), (1, None)], "src long, dst long")
    starts = sorted({x for p in pairs for x in p})[:: 1 if seeds == "all" else 5]
    got = graph.transitive_closure(edges, spark.createDataFrame([(x,) for x in [*starts, None, 12345]], "seed long"))
    assert got.schema["level"].dataType.simpleString() == "int"
    rows = [tuple(r) for r in got.filter("id IS NOT NULL").collect()]
    assert sorted(rows) == sorted((s, x, n) for s in starts for x, n in _levels(links, s).items())
