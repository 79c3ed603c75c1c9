"""Ordered operators: eviction, linked chunks, date spines, debouncing, greedy packing, line windows, sections."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, hash_id, summarize
from .batches import handing


def evictions(entries: DataFrame, limit: Column, by: str = "cache") -> DataFrame:
    """Entries (cache, key, size, last_used) that go, oldest first, until the rest fits the limit."""
    w = Window.partitionBy(by).orderBy("last_used", "key")
    before = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("size").over(Window.partitionBy(by))
    return entries.withColumn("over", total - before).filter(F.col("over") > limit).drop("over")


def link_chunks(chunks: DataFrame, by: str = "path", order: str = "pos", key: str = "id") -> DataFrame:
    """chunks with index, total, prev and next."""
    w = Window.partitionBy(by).orderBy(order)
    return chunks.withColumns({"index": F.row_number().over(w) - 1, "total": F.count("*").over(Window.partitionBy(by)), "prev": F.lag(key).over(w), "next": F.lead(key).over(w)})


def date_spine(daily: DataFrame, start: str, end: str) -> DataFrame:
    """(day, n): every day of the range, 0 where daily (day, n) has none."""
    days = daily.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    return days.join(daily, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def debounce(events: DataFrame, gap_seconds: int, key: str = "key", ts: str = "ts") -> DataFrame:
    """One row for each quiet gap of a key: key, started, emitted (last event and the gap), n."""
    w = Window.partitionBy(key).orderBy(ts)
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    fresh = F.coalesce((seconds(F.col(ts)) - seconds(F.lag(ts).over(w)) > gap_seconds).cast("int"), F.lit(0))
    runs = events.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "run").agg(F.min(ts).alias("started"), (F.max(ts) + F.expr(f"INTERVAL {gap_seconds} SECONDS")).alias("emitted"), F.count("*").alias("n")).drop("run")


def semantic_tokens(rows: DataFrame, by: str = "file") -> DataFrame:
    """(file, i, line, character) of delta-coded tokens (file, i, delta_line, delta_char, ...); a new line sets the character anew."""
    w = Window.partitionBy(by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    lined = rows.withColumn("line", F.sum("delta_line").over(w))
    inside = Window.partitionBy(by, "line").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return lined.withColumn("character", F.sum("delta_char").over(inside))


def modifier_names(bits: Column, names: list[str]) -> Column:
    """Names of the bits that are set."""
    return F.filter(F.array(*[F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(names)]), lambda x: x.isNotNull())


def _filling(room: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunk numbers of rows that come by module and place; only the open chunk is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        module, used, chunk = object(), 0, 0
        for batch in batches:
            chunks = []
            for own, size in zip(batch.column("by").to_pylist(), batch.column("size").to_pylist(), strict=True):
                if own != module:
                    module, used, chunk = own, 0, 0
                elif used > 0 and used + size > room:
                    used, chunk = 0, chunk + 1
                used += size
                chunks.append(chunk)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("by", "pos", "tokens")), pa.array(chunks, pa.int32())], ["by", "pos", "tokens", "chunk"])

    return run


def greedy_chunks(symbols: DataFrame, budget: int, overhead: int = 200, by: str = "module") -> DataFrame:
    """symbols (module, pos, tokens) with chunk: each goes on while the budget holds, else it opens a chunk.

    Rows of a module pass one task in order, which holds the open chunk's size alone.
    A null size counts as 0.
    """
    kinds = ", ".join(f"{name} {symbols.schema[c].dataType.simpleString()}" for name, c in (("by", by), ("pos", "pos"), ("tokens", "tokens")))
    rows = symbols.select(F.col(by).alias("by"), "pos", "tokens", F.coalesce(F.col("tokens").cast("long"), F.lit(0).cast("long")).alias("size"))
    made = rows.repartition("by").sortWithinPartitions("by", "pos", "tokens").mapInArrow(_filling(budget - overhead), f"{kinds}, chunk int")
    return made.select(F.col("by").alias(by), "pos", "tokens", "chunk")


def _windowing(most: int, least: int, overlap: int) -> Callable[[str, str | None], Iterator[tuple]]:
    size = lambda s: -(-(len(s.encode("utf-16-le")) // 2) // 4)
    keep = math.ceil(overlap / 4)

    def run(path: str, content: str | None) -> Iterator[tuple]:
        lines = (content or "").split("\n")
        held: list[str] = []
        used = start = 0
        for i, line in enumerate(lines):
            n = size(line)
            if held and used + n > most:
                yield path, start, i - 1, "\n".join(held)
                held = held[-keep:]
                used, start = size("\n".join(held)), i - len(held)
            held.append(line)
            used += n
        if held and used >= least:
            yield path, start, len(lines) - 1, "\n".join(held)

    return run


def text_windows(files: DataFrame, most: int = 512, least: int = 50, overlap: int = 50) -> DataFrame:
    """Windows of whole lines of up to ``most`` tokens with some lines carried over; a short tail is dropped.

    (path, line_start, line_end, content) of files (path, content).
    """
    return files.select("path", "content").mapInPandas(handing(_windowing(most, least, overlap), ["path", "content"], ["path", "line_start", "line_end", "content"]), "path string, line_start int, line_end int, content string")


def sections(files: DataFrame, least: int = 50, header: str = r"^#+\s+(.+)") -> DataFrame:
    """(path, id, symbol, line_start, line_end, content, level): the file's head, and its sections by header lines."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("line", "text"))
    head = F.col("text").rlike(header)
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    cut = lines.withColumn("section", F.sum(head.cast("int")).over(w))
    grouped = cut.groupBy("path", "section").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("rows"), F.min("line").alias("line_start"), F.max("line").alias("line_end"), F.max("line").alias("last"))
    end = F.max("line_end").over(Window.partitionBy("path"))
    made = grouped.withColumn("content", F.array_join(F.transform("rows", lambda r: r["text"]), "\n")).withColumn("end", end)
    title = F.when(F.col("section") > 0, F.regexp_extract(F.col("rows")[0]["text"], header, 1)).otherwise("")
    last = F.col("line_end") == F.col("end")
    named = F.when(title != "", title).otherwise(F.when(last, "Content").otherwise("Introduction"))
    key = F.when(title != "", title).otherwise(F.when(last, "end").otherwise("intro"))
    own = made.filter(estimate_tokens(F.col("content")) >= least).select("path", hash_id(F.col("path"), F.lit("section"), key).alias("id"), named.alias("symbol"), "line_start", "line_end", "content", F.lit("symbol").alias("level"))
    top = files.select("path", hash_id(F.col("path"), F.lit("file")).alias("id"), F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"), summarize(F.col("content"), 20).alias("content"), F.lit("file").alias("level"))
    return top.unionByName(own)


def commit_chunks(commits: DataFrame) -> DataFrame:
    """A project chunk of every commit (sha, msg, diff), and one for each file of its diff."""
    from ..functions.text import split_diff, summarize_diff

    whole = commits.select(hash_id(F.col("sha"), F.lit("commit")).alias("id"), F.lit("project").alias("level"), F.col("sha").alias("path"), F.concat("msg", F.lit("\n\n"), summarize_diff(F.col("diff"))).alias("content"), F.lit(None).cast("string").alias("parent"))
    files = commits.select("sha", F.explode(split_diff(F.col("diff"))).alias("f"))
    return whole.unionByName(files.select(hash_id(F.col("sha"), F.lit("file"), F.col("f.path")).alias("id"), F.lit("file").alias("level"), F.col("f.path").alias("path"), F.col("f.diff").alias("content"), hash_id(F.col("sha"), F.lit("commit")).alias("parent")))
