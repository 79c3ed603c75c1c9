"""Sources and sinks: source files, JSON stores, the partitioned chunk store, snapshots."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import language_of
from .commits import CommitLog

# Extensions of source files and folders that are left out.
SOURCE_GLOB = "*.{ts,tsx,js,jsx,py,rs,go}"
IGNORED = r"/(node_modules|dist|build|\.git)/"

FRESHNESS = "struct<sourceHash:string,docHash:string,lastGenerated:string,gitCommit:string>"


def find_source_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the source files below a folder."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", SOURCE_GLOB).load(root)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return rows.filter(~F.col("path").rlike(IGNORED)).dropDuplicates(["path"])


def file_table(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, mtime, size, language) below a folder; the content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), language_of(F.col("path"), "text").alias("language"))


def parse_freshness(texts: DataFrame) -> DataFrame:
    """(uri, source_hash, doc_hash, last_generated, git_commit) of JSON stores (text); entries with a gap are dropped."""
    entries = texts.select(F.explode(F.from_json("text", f"map<string,{FRESHNESS}>")).alias("uri", "e"))
    made = entries.select("uri", F.col("e.sourceHash").alias("source_hash"), F.col("e.docHash").alias("doc_hash"), F.try_to_timestamp("e.lastGenerated").alias("last_generated"), F.col("e.gitCommit").alias("git_commit"))
    return made.filter("source_hash IS NOT NULL AND doc_hash IS NOT NULL AND last_generated IS NOT NULL")


def read_freshness(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The store at a path, JSON objects of entries by uri, one for each file or line; empty if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "uri string, source_hash string, doc_hash string, last_generated timestamp, git_commit string")
    return parse_freshness(spark.read.text(path, wholetext=not lines).withColumnRenamed("value", "text"))


def write_freshness(store: DataFrame, path: str) -> None:
    """The store as lines, each a JSON object of one entry, so that no row holds a whole store."""
    entry = F.struct(F.col("source_hash").alias("sourceHash"), F.col("doc_hash").alias("docHash"), F.date_format("last_generated", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("lastGenerated"), F.col("git_commit").alias("gitCommit"))
    store.select(F.to_json(F.create_map("uri", entry)).alias("value")).write.mode("overwrite").text(path)


class ChunkStore:
    """Chunks in Parquet by (type, level) and a bucket of their path; reads of a collection or path touch its folders only.

    A change writes its own rows, and the keys of those that go, and then a commit; what
    was there is left as it is. Reading merges: a chunk is gone if its id or path
    was deleted by a later commit than its own. ``compact`` writes what is left anew.
    Readers follow the last commit, so that they never see half a change, and of two
    writers that start from the same commit the second fails. Folders that no kept
    commit names go with ``vacuum``.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.fs_path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        self.fs = self.fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.log = CommitLog(spark, f"{self.path}/_commits")

    def commits(self) -> list[int]:
        return self.log.numbers()

    def _state(self, commit: int | None = None) -> tuple[int, dict]:
        """(number, state): schema, buckets, folders of each collection and deletes, both with the number of their commit."""
        number, told = self.log.read(commit)
        return number, told or {"schema": None, "buckets": self.buckets, "folders": {}, "deletes": []}

    def _bucket(self, path: Column, n: int) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(n)).cast("int")

    def _written(self, rows: DataFrame, buckets: int) -> dict[str, list[str]]:
        """Writes rows to new folders; those of each collection."""
        name = uuid.uuid4().hex
        placed = rows.withColumn("bucket", self._bucket(F.col("path"), buckets)).hint("rebalance", "type", "level", "bucket")  # a hot path is split over tasks
        placed.withColumn("batch", F.lit(name)).write.mode("append").partitionBy("type", "level", "bucket", "batch").parquet(self.path)
        found = self.fs.globStatus(self.fs_path(f"{self.path}/type=*/level=*/bucket=*/batch={name}")) or []
        out: dict[str, list[str]] = {}
        for s in found:
            parts = s.getPath().toString().split("/")[-4:]
            out.setdefault("/".join(parts[:2]), []).append("/".join(parts))
        return out

    def _rows(self, state: dict, folders: list[list]) -> DataFrame:
        """The rows of these folders that no later commit deletes."""
        kind = StructType.fromJson(json.loads(state["schema"]))
        if not folders:
            return self.spark.createDataFrame([], kind)
        whole = StructType([*kind.fields, StructField("batch", StringType())])
        rows = self.spark.read.schema(whole).option("basePath", self.path).parquet(*[f"{self.path}/{f}" for f, _ in folders])
        since = min(n for _, n in folders)
        later = [d for d in state["deletes"] if d[2] > since]
        if not later:
            return rows.select(kind.names)
        numbers = self.spark.createDataFrame(sorted({(f.rsplit("batch=", 1)[1], n) for f, n in folders}), "batch string, __made long")
        rows = rows.join(F.broadcast(numbers), "batch")  # a row for each change since the last compaction
        for key in sorted({k for k, _, _ in later}):
            made = [self.spark.read.parquet(f"{self.path}/{f}").select(F.col("key").alias(key), F.lit(n).cast("long").alias("__gone")) for k, f, n in later if k == key]
            gone = reduce(DataFrame.unionByName, made).groupBy(key).agg(F.max("__gone").alias("__gone"))
            rows = rows.join(gone, key, "left").filter("__gone IS NULL OR __gone <= __made").drop("__gone")
        return rows.select(kind.names)

    def read(self, type_: str | None = None, level: str | None = None, commit: int | None = None) -> DataFrame | None:
        """All chunks, or those of a collection; null if nothing was ever written."""
        number, state = self._state(commit)
        if number < 0:
            return None
        wanted = [f for key, own in state["folders"].items() for f in own if (type_ is None or key.startswith(f"type={type_}/")) and (level is None or key.endswith(f"/level={level}"))]
        return self._rows(state, wanted)

    def _change(self, gone: DataFrame | None, key: str, rows: DataFrame | None) -> None:
        """Chunks whose key ``gone`` holds go and rows come, in one commit; no row that stays is written again."""
        number, state = self._state()
        schema, new = state["schema"], number + 1
        if number >= 0 and gone is not None:
            folder = f"_deletes/{uuid.uuid4().hex}"
            gone.select(F.col(key).alias("key")).distinct().write.parquet(f"{self.path}/{folder}")
            state["deletes"].append([key, folder, new])
        if rows is not None:
            rows = rows if schema is None else rows.select(StructType.fromJson(json.loads(schema)).names)
            for k, own in self._written(rows, state["buckets"]).items():
                state["folders"][k] = [*state["folders"].get(k, []), *([f, new] for f in own)]
            state["schema"] = schema or rows.schema.json()
        self.log.commit(new, state)

    def compact(self) -> None:
        """Writes all chunks that are left anew, without deletes."""
        number, state = self._state()
        if number >= 0:
            there = self._rows(state, [f for own in state["folders"].values() for f in own])
            folders = {k: [[f, number + 1] for f in own] for k, own in self._written(there, state["buckets"]).items()}
            self.log.commit(number + 1, state | {"folders": folders, "deletes": []})

    def insert(self, rows: DataFrame) -> None:
        """Adds chunks; those there stay, also those of the same id."""
        self._change(None, "id", rows)

    def upsert(self, rows: DataFrame) -> None:
        """rows, and the chunks there whose id they don't hold."""
        self._change(rows, "id", rows)

    def replace_paths(self, paths: DataFrame, rows: DataFrame) -> None:
        """rows in place of all chunks of these paths."""
        self._change(paths, "path", rows)

    def delete(self, by: DataFrame, key: str = "id") -> None:
        """Deletes the chunks whose id or path ``by`` holds."""
        if self.commits():
            self._change(by, key, None)

    def drop_collection(self, type_: str, level: str) -> None:
        number, state = self._state()
        if number >= 0:
            state["folders"].pop(f"type={type_}/level={level}", None)
            self.log.commit(number + 1, state)

    def vacuum(self, keep: int = 2) -> None:
        """Deletes older commits than the last ``keep``, and folders that none of these names. Not while a writer is at work."""
        done = self.commits()
        states = [self._state(n)[1] for n in done[-keep:]]
        wanted = {f for s in states for own in s["folders"].values() for f, _ in own} | {d[1] for s in states for d in s["deletes"]}
        for pattern, depth in (("type=*/level=*/bucket=*/batch=*", 4), ("_deletes/*", 2)):
            for status in self.fs.globStatus(self.fs_path(f"{self.path}/{pattern}")) or []:
                if "/".join(status.getPath().toString().split("/")[-depth:]) not in wanted:
                    self.fs.delete(status.getPath(), True)
        for n in done[:-keep]:
            self.log.forget(n)

    def collections(self) -> DataFrame | None:
        there = self.read()
        return None if there is None else there.groupBy("type", "level").agg(F.count("*").alias("n"))

    def by_path(self, path: str) -> DataFrame | None:
        """Chunks of a path; only its bucket is read."""
        number, state = self._state()
        if number < 0:
            return None
        bucket = self.spark.range(1).select(self._bucket(F.lit(path), state["buckets"]).alias("b")).first()["b"]
        return self._rows(state, [f for own in state["folders"].values() for f in own if f"/bucket={bucket}/" in f[0]]).filter(F.col("path") == path)

    def by_id(self, key: str) -> DataFrame | None:
        there = self.read()
        return None if there is None else there.filter(F.col("id") == key).limit(1)


class SnapshotStore:
    """API snapshots in Parquet, partitioned by snapshot_id."""

    COLUMNS = "path string, name string, description string, signature string, workspace string, tag string, created_at timestamp, snapshot_id string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def create(self, exports: DataFrame, snapshot_id: str, workspace: str, tag: str, created_at: str) -> DataFrame:
        """Writes exports (path, name, description, signature); returns modules, exports, documented."""
        rows = exports.select("path", "name", "description", "signature", F.lit(workspace).alias("workspace"), F.lit(tag).alias("tag"), F.lit(created_at).cast("timestamp").alias("created_at"))
        rows.write.mode("overwrite").parquet(f"{self.path}/snapshot_id={snapshot_id}")
        return snapshot_stats(self.load(snapshot_id))

    def _all(self) -> DataFrame:
        return self.spark.read.schema(self.COLUMNS).parquet(self.path)

    def load(self, snapshot_id: str) -> DataFrame:
        return self._all().filter(F.col("snapshot_id") == snapshot_id)

    def list(self, workspace: str) -> DataFrame:
        rows = self._all().filter(F.col("workspace") == workspace).groupBy("snapshot_id", "tag", "created_at").agg(F.count("*").alias("exports"))
        return rows.orderBy(F.desc("created_at"))

    def by_tag(self, workspace: str, tag: str) -> DataFrame:
        return self.list(workspace).filter(F.col("tag") == tag).limit(1)

    def latest(self, workspace: str) -> DataFrame:
        return self.list(workspace).limit(1)

    def delete(self, snapshot_id: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/snapshot_id={snapshot_id}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def snapshot_stats(exports: DataFrame) -> DataFrame:
    """One row: modules, exports, documented (a description that isn't empty)."""
    return exports.agg(F.count_distinct("path").alias("modules"), F.count("*").alias("exports"), F.count_if(F.length("description") > 0).alias("documented"))


def to_record(chunks: DataFrame) -> DataFrame:
    """chunks with lines as two columns and meta as JSON."""
    return chunks.select("*", F.col("lines")[0].alias("line_start"), F.col("lines")[1].alias("line_end"), F.to_json("meta").alias("meta_json")).drop("lines", "meta")


def to_chunk(records: DataFrame, meta: str) -> DataFrame:
    """The inverse: lines only where both ends are there; meta that isn't JSON is empty."""
    lines = F.when(F.col("line_start").isNotNull() & F.col("line_end").isNotNull(), F.array("line_start", "line_end"))
    return records.select("*", lines.alias("lines"), F.from_json(F.coalesce("meta_json", F.lit("{}")), meta).alias("meta")).drop("line_start", "line_end", "meta_json")
