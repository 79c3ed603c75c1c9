"""Event-driven operators with Structured Streaming.

A watch's trailing debounce is a session window: it closes after a quiet gap and is
emitted once the watermark has passed it. State is kept for open sessions only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..checkpoints import checkpointed
from ..functions.text import is_watch_excluded


def debounced(events: DataFrame, gap: str, late: str = "10 minutes", enabled: str | None = None) -> DataFrame:
    """(key, started, emitted, n): one row for each quiet gap of a key in a stream (key, ts)."""
    rows = events.filter(F.col(enabled)) if enabled else events
    windows = rows.withWatermark("ts", late).groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return windows.select("key", F.col("w.start").alias("started"), F.col("w.end").alias("emitted"), "n")


def watched(events: DataFrame) -> DataFrame:
    """Events (key, ts) of files that are to be regenerated."""
    return events.filter(~is_watch_excluded(F.col("key")))


def _quiet(gap: int, most: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The state of a root: the start and the last time of what waits, and its paths; times in milliseconds."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple[pd.Timestamp, pd.Timestamp, list[str], bool]] = []
        begun, last, paths = state.get if state.exists else (0, 0, [])
        waiting = dict.fromkeys(paths)

        def flush(quiet: bool) -> None:
            out.append((pd.Timestamp(begun, unit="ms"), pd.Timestamp(last, unit="ms"), sorted(waiting), quiet))
            waiting.clear()

        if state.hasTimedOut:
            flush(True)
        rows = [(t.value // 1_000_000, path) for frame in frames for t, path in zip(frame["ts"], frame["path"], strict=True)]
        for at, path in sorted(rows):
            if waiting and at - last > gap:
                flush(True)
            if not waiting:
                begun = last = at
            begun, last = min(begun, at), max(last, at)
            waiting[path] = None
            if len(waiting) >= most:
                flush(False)
        if waiting and last + gap < state.getCurrentWatermarkMs():
            flush(True)
        if waiting:
            state.update((begun, last, list(waiting)))
            state.setTimeoutTimestamp(last + gap)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["root", "started", "last", "paths", "quiet"])

    return run


def quiet_batches(events: DataFrame, gap: int = 1000, late: str = "10 seconds", most: int = 10_000) -> DataFrame:
    """(root, started, last, paths, quiet) of a stream (root, path, ts): all paths that changed below a root, once it has been quiet.

    Changes wait in state until none has come for ``gap`` milliseconds of event time,
    and go on together, each path once; what comes while a batch is being handled waits for
    the next. A root that is never quiet hands its paths on when ``most`` wait (quiet
    is false), which bounds the state. A change that comes late joins what waits. State
    is checkpointed, so that a restart neither loses nor repeats a path. Rows with a
    null root, path or time are left out.
    """
    rows = events.select("root", "path", "ts").dropna().withWatermark("ts", late)
    shape = "root string, started timestamp, last timestamp, paths array<string>, quiet boolean"
    return rows.groupBy("root").applyInPandasWithState(_quiet(gap, most), shape, "begun long, last long, paths array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def global_batches(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, trigger: str = "1 second") -> StreamingQuery:
    """Hands every micro-batch's distinct paths to ``handle``; after a restart a batch has the same number and rows."""
    once = lambda batch, number: handle(batch.dropDuplicates(["key"]), number)
    return events.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()


def incremental_index(events: DataFrame, store, chunk: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Files (path, content) in a stream become chunks and replace those of their paths; all that is there, then it ends."""

    def replace(batch: DataFrame, number: int) -> None:
        store.replace_paths(batch.select("path").distinct(), chunk(batch.dropDuplicates(["path"])))

    return events.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def converge(step: Callable[[DataFrame], DataFrame], rows: DataFrame, most: int = 5, strict: bool = False) -> tuple[DataFrame, int]:
    """Repeats a step until a checksum over its rows stays; (rows, turns). Each turn's rows are checkpointed, so that none is computed twice; with ``strict``, rows that have not settled after ``most`` turns raise."""
    check = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first())
    told = check(rows)
    for turn in range(1, most + 1):
        rows = checkpointed(step(rows))
        now = check(rows)
        if now == told:
            return rows, turn
        told = now
    if strict:
        raise ValueError(f"rows have not settled after {most} turns")
    return rows, most
