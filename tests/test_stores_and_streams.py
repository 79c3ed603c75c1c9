"""Stores on disk and streaming operators."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratalith.operators import sequences
from stratalith.sources import stores
from stratalith.streaming import watch


def test_source_files(spark, tmp_path):
    for name, text in {"a.ts": "x", "sub/b.py": "y", "node_modules/c.js": "z", "d.md": "w"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    got = {r.path.rsplit("/", 1)[1]: r.content for r in stores.find_source_files(spark, str(tmp_path)).collect()}
    assert got == {"a.ts": "x", "b.py": "y"}
    kinds = {r.path.rsplit("/", 1)[1]: r.language for r in stores.file_table(spark, str(tmp_path)).collect()}
    assert kinds["d.md"] == "text" and kinds["b.py"] == "python"


def test_freshness_round_trip(spark, tmp_path):
    good = {"u1": {"sourceHash": "a", "docHash": "b", "lastGenerated": "2024-01-02T03:04:05.000Z"}, "u2": {"sourceHash": "a", "docHash": "b", "lastGenerated": "2024-01-02T03:04:05.000Z", "gitCommit": "c"}}
    bad = {"u3": {"sourceHash": "a"}, "u4": {"sourceHash": "a", "docHash": "b", "lastGenerated": "never"}}
    first = tmp_path / "in"
    first.mkdir()
    (first / "f.json").write_text(json.dumps(good | bad))
    store = stores.read_freshness(spark, str(first))
    assert {r.uri for r in store.collect()} == {"u1", "u2"}
    stores.write_freshness(store, str(tmp_path / "out"))
    again = stores.read_freshness(spark, str(tmp_path / "out"), lines=True)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, store.collect()), key=str)
    assert stores.read_freshness(spark, str(tmp_path / "none")).count() == 0


def test_chunk_store(spark, tmp_path):
    store = stores.ChunkStore(spark, str(tmp_path / "chunks"))
    rows = lambda *x: spark.createDataFrame(list(x), "id string, path string, content string, type string, level string")
    assert store.read() is None and store.collections() is None
    store.insert(rows(("1", "a", "x", "code", "file"), ("2", "b", "y", "docs", "symbol")))
    store.insert(rows(("3", "a", "z", "code", "symbol")))
    store.upsert(rows(("1", "a", "new", "code", "file"), ("4", "c", "w", "code", "file")))
    assert {r.id: r.content for r in store.read().collect()} == {"1": "new", "2": "y", "3": "z", "4": "w"}
    assert {(r.type, r.level): r.n for r in store.collections().collect()} == {("code", "file"): 2, ("code", "symbol"): 1, ("docs", "symbol"): 1}
    assert {r.id for r in store.by_path("a").collect()} == {"1", "3"} and store.by_id("4").first().content == "w"
    store.delete(spark.createDataFrame([("a",)], "path string"), "path")
    assert {r.id for r in store.read().collect()} == {"2", "4"}
    store.drop_collection("docs", "symbol")
    assert {r.id for r in store.read().collect()} == {"4"}
    store.delete(spark.createDataFrame([("4",)], "id string"))
    assert store.read().collect() == [] and store.collections().collect() == []
    store.upsert(rows(("5", "a", "v", "code", "file")))
    assert {r.id for r in store.read("code", "file").collect()} == {"5"} and store.read("docs").collect() == []


def test_chunk_store_commits(spark, tmp_path):
    """A reader keeps its commit, an unfinished change shows nowhere, a second writer fails, and what stays is not written again."""
    store = stores.ChunkStore(spark, str(tmp_path / "chunks"))
    rows = lambda *r: spark.createDataFrame(list(r), "id string, path string, content string, type string, level string")
    store.insert(rows(("1", "a", "x", "code", "file"), ("2", "b", "y", "docs", "file"), ("3", "c", "z", "code", "file")))
    before, first = store.read(), store._state()[1]["folders"]
    store.upsert(rows(("1", "a", "new", "code", "file")))
    assert {r.content for r in before.collect()} == {"x", "y", "z"} and {r.content for r in store.read().collect()} == {"new", "y", "z"}
    number, state = store._state()
    assert state["folders"]["type=docs/level=file"] == first["type=docs/level=file"]
    assert [f for f in state["folders"]["type=code/level=file"] if f not in first["type=code/level=file"]] and all(f in state["folders"]["type=code/level=file"] for f in first["type=code/level=file"])
    store._written(rows(("9", "z", "lost", "code", "file")), 16)  # a writer that dies before its commit
    assert {r.id for r in store.read().collect()} == {"1", "2", "3"}
    with pytest.raises(Exception, match="(?i)exist"):
        store.log.commit(number, {})
    assert {r.id for r in store.read().collect()} == {"1", "2", "3"}
    assert {r.content for r in store.read(commit=0).collect()} == {"x", "y", "z"}
    store.compact()
    store.vacuum(1)
    assert store.commits() == [number + 1] and {r.content for r in store.read().collect()} == {"new", "y", "z"}
    assert not list((tmp_path / "chunks" / "_deletes").glob("*")) and not store._state()[1]["deletes"]


def test_half_written_commits_are_none(spark, tmp_path):
    store = stores.ChunkStore(spark, str(tmp_path / "chunks"))
    row = spark.createDataFrame([("1", "a", "x", "code", "file")], "id string, path string, content string, type string, level string")
    store.insert(row)
    (tmp_path / "chunks/_commits/1.json").write_text("")  # an empty file where the next commit would be
    (tmp_path / "chunks/_commits/.1-abc").write_text('{"schema"')  # a writer between create and rename
    assert store.commits() == [0] and [r.id for r in store.read().collect()] == ["1"]
    store.insert(row.withColumn("id", F.lit("2")))
    assert store.commits() == [0, 1] and {r.id for r in store.read().collect()} == {"1", "2"}


def test_bytes_written_follow_the_change(spark, tmp_path):
    store = stores.ChunkStore(spark, str(tmp_path / "chunks"), buckets=8)
    size = lambda: sum(p.stat().st_size for p in (tmp_path / "chunks").rglob("*.parquet"))
    said = F.concat_ws(" ", F.sha2(F.col("id").cast("string"), 512), F.sha2((-F.col("id")).cast("string"), 512))
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("p"), F.col("id") % 500).alias("path"), said.alias("content"), F.lit("code").alias("type"), F.lit("file").alias("level"))
    store.insert(rows)
    whole = size()
    for k in range(3):
        store.replace_paths(spark.createDataFrame([(f"p{k}",)], "path string"), rows.filter(F.col("path") == f"p{k}").withColumn("content", F.lit("new")))
    assert size() - whole < whole / 20
    got = store.read()
    assert got.count() == 20_000 and got.filter("content = 'new'").count() == 120
    assert len(store.by_path("p77").inputFiles()) < len(got.inputFiles()) / 3 and store.by_path("p77").count() == 40


def test_snapshots(spark, tmp_path):
    store = stores.SnapshotStore(spark, str(tmp_path / "s"))
    exports = spark.createDataFrame([("p", "f", "says", "f()"), ("p", "g", "", "g()"), ("q", "h", None, "h()")], "path string, name string, description string, signature string")
    assert store.create(exports, "s1", "w", "v1", "2024-01-01").first().asDict() == {"modules": 2, "exports": 3, "documented": 1}
    store.create(exports.limit(1), "s2", "w", "v2", "2024-02-01")
    assert [r.snapshot_id for r in store.list("w").collect()] == ["s2", "s1"]
    assert store.latest("w").first().snapshot_id == "s2" and store.by_tag("w", "v1").first().exports == 3
    store.delete("s2")
    assert [r.snapshot_id for r in store.list("w").collect()] == ["s1"]


def test_records(spark):
    rows = spark.sql("SELECT '1' AS id, array(3, 9) AS lines, named_struct('author', 'x') AS meta UNION ALL SELECT '2', NULL, NULL")
    back = stores.to_chunk(stores.to_record(rows), "struct<author:string>")
    got = {r.id: (r.lines, r.meta and r.meta.author) for r in back.collect()}
    assert got == {"1": ([3, 9], "x"), "2": (None, None)}


def test_debounce_stream_matches_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(seconds=s)) for k, times in {"a": [0, 5, 12, 100, 104], "b": [3, 30]}.items() for s in times]
    late = [("z", start + timedelta(days=1))]
    source = tmp_path / "events"
    spark.createDataFrame(rows, "key string, ts timestamp").coalesce(1).write.parquet(str(source))
    spark.createDataFrame(late, "key string, ts timestamp").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(source))
    q = watch.debounced(watch.watched(stream), "10 seconds", "1 minute").writeStream.format("memory").queryName("quiet").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.key, r.started, r.emitted, r.n) for r in spark.table("quiet").filter("key <> 'z'").collect()}
    batch = sequences.debounce(spark.createDataFrame(rows, "key string, ts timestamp"), 10)
    assert got == {(r.key, r.started, r.emitted, r.n) for r in batch.collect()} and len(got) == 4


def test_incremental_index(spark, tmp_path):
    store = stores.ChunkStore(spark, str(tmp_path / "chunks"))
    source = tmp_path / "files"

    def chunk(files):
        return files.select(F.sha2("content", 256).alias("id"), "path", "content", F.lit("code").alias("type"), F.lit("file").alias("level"))

    def turn(*rows):
        spark.createDataFrame(list(rows), "path string, content string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("path string, content string").parquet(str(source))
        watch.incremental_index(stream, store, chunk, str(tmp_path / "cp")).awaitTermination()
        return {r.path: r.content for r in store.read().collect()}

    assert turn(("a", "1"), ("b", "2")) == {"a": "1", "b": "2"}
    assert turn(("a", "3")) == {"a": "3", "b": "2"}


def test_converge(spark):
    rows, turns = watch.converge(lambda df: df.select(F.floor(F.col("id") / 2).alias("id")), spark.range(5))
    assert turns == 4 and {r.id for r in rows.collect()} == {0}
    with pytest.raises(ValueError, match="settled"):
        watch.converge(lambda df: df.select((F.col("id") + 1).alias("id")), spark.range(5), most=2, strict=True)


def test_quiet_batches(spark, tmp_path):
    """A gap flushes all paths of a root together; late and repeated changes join; a restart loses and repeats nothing; a busy root is cut."""
    start = datetime(2024, 1, 1)
    source, done = str(tmp_path / "in"), str(tmp_path / "out")

    def put(*rows):
        made = [(r, p, start + timedelta(seconds=s)) for r, p, s in rows]
        spark.createDataFrame(made, "root string, path string, ts timestamp").coalesce(1).write.mode("append").parquet(source)

    def turn(most=100):
        stream = spark.readStream.schema("root string, path string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
        q = watch.quiet_batches(stream, 2000, "5 seconds", most).writeStream.format("parquet").option("path", done).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        rows = spark.read.parquet(done).collect()
        return sorted((r.root, (r.started - start).total_seconds(), (r["last"] - start).total_seconds(), tuple(r.paths), r.quiet) for r in rows)

    put(("w", "a", 0), ("w", "b", 1), ("w", "a", 2.5), ("v", "x", 1), (None, "n", 1))
    turn()
    put(("w", "c", 1.5), ("w", "d", 4), ("w", "a", 7))  # c comes late and joins; a follows a quiet gap
    first = turn()
    assert ("w", 0.0, 4.0, ("a", "b", "c", "d"), True) in first and not [r for r in first if "n" in r[3]]
    put(("w", "z", 60))  # after a restart the watermark closes what waited
    put(("w", "z", 61))
    got = turn()
    assert got == [("v", 1.0, 1.0, ("x",), True), ("w", 0.0, 4.0, ("a", "b", "c", "d"), True), ("w", 7.0, 7.0, ("a",), True)]
    put(*[("busy", f"p{i}", 100 + i) for i in range(5)])
    cut = [r for r in turn(most=2) if r[0] == "busy"]
    assert [r[3:] for r in cut if not r[4]] == [(("p0", "p1"), False), (("p2", "p3"), False)]
