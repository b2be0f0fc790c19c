"""Change streams: a log of file changes, the last event of each path, and debounced flushes."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.operators.search import path_filter
from quillon.schema import CHANGES
from quillon.session import ship
from quillon.sources import tree
from quillon.sources.corpus import EXCLUDES, EXTENSIONS


def change_stream(spark: SparkSession, folder: str, extensions=EXTENSIONS, excludes=EXCLUDES, files_per_trigger: int = 20) -> DataFrame:
    """A stream of (relative_path, op, ts) from Parquet files that are added to ``folder``; op is change, create or delete."""
    rows = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return path_filter(rows.filter(F.lower(F.regexp_extract("relative_path", r"(\.[^./]+)$", 1)).isin(*extensions)), (), excludes)


def watch(spark: SparkSession, root: str, state: str, extensions=EXTENSIONS) -> DataFrame:
    """The same of what changes in a tree itself, with no log that another has to write. Excluded folders are watched too: what is
    excluded is the sync's matter."""
    rows = tree.watch_tree(spark, root, state)
    return rows.filter(F.lower(F.regexp_extract("relative_path", r"(\.[^./]+)$", 1)).isin(*extensions))


def last_event(changes: DataFrame, key: str = "relative_path", tie: str = "op") -> DataFrame:
    """The latest op of each path; of events at one time, the one with the greater ``tie``."""
    return changes.groupBy(key).agg(F.max_by("op", F.struct("ts", tie)).alias("op"), F.max("ts").alias("ts"))


def debounce(events: DataFrame, gap: str = "5 seconds", keys: tuple[str, ...] = ()) -> DataFrame:
    """One row for each run of events with less than ``gap`` between them: first, last, n, and when its timer fires.

    On a stream, give ``events`` a watermark first: a run is put out once the watermark passes its end.
    """
    if not keys and not events.isStreaming:
        return _debounced(events, gap)
    window = F.session_window("ts", gap)
    whole = [F.pmod(F.hash("ts"), F.lit(1)).alias("_whole")] if not keys else []  # streams need a key
    out = events.groupBy(window, *keys, *whole).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    return out.select(*keys, "first_ts", "last_ts", "n", F.col("session_window.end").alias("fires_at"))


def _debounced(events: DataFrame, gap: str) -> DataFrame:
    """Runs over all events of a table: events within one ``gap`` of the clock are one row before rows are put in order."""
    step = F.expr(f"interval {gap}")
    buckets = events.filter("ts is not null").groupBy(F.window("ts", gap).getField("start").alias("_at")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    order = Window.orderBy("_at")
    runs = buckets.withColumn("_new", F.when(F.col("first_ts") <= F.lag("last_ts").over(order) + step, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
    out = runs.groupBy("_run").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("n").alias("n"))
    return out.select("first_ts", "last_ts", "n", (F.col("last_ts") + step).alias("fires_at"))


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Quiet(StatefulProcessor):
    """For each key, the last event of each of its paths, and one timer that every event sets anew."""

    def __init__(self, delay_ms: int):
        self.delay = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.paths = handle.getMapState("paths", "relative_path string", "op string, at long")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = []
        for batch in rows:
            at = batch["ts"].astype("datetime64[us]").astype("int64") // 1000
            events += zip(at.tolist(), batch["relative_path"], batch["op"], strict=True)
        before = due = self.due.get()[0] if self.due.exists() else None
        latest: dict[str, tuple[int, str]] = {}
        for t, path, op in sorted(events):
            if due is not None and t > due:  # the quiet before this event is over, though its timer is yet to come
                self._keep(latest)
                yield self._flushed(key, due)
                latest, due = {}, None
            latest[path] = max(latest.get(path, (t, op)), (t, op))
            due = max(due or 0, t + self.delay)
        self._keep(latest)
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
            self.due.update((due,))

    def _keep(self, latest: dict) -> None:
        for path, (t, op) in latest.items():
            held = self.paths.getValue((path,)) if self.paths.containsKey((path,)) else None
            if held is None or (t, op) > (held[1], held[0]):
                self.paths.updateValue((path,), (op, t))

    def _flushed(self, key, due: int) -> pd.DataFrame:
        rows = [(key[0], path[0], value[0], value[1]) for path, value in self.paths.iterator()]
        self.paths.clear()
        out = pd.DataFrame(rows, columns=["root", "relative_path", "op", "at"])
        out["ts"] = pd.to_datetime(out.pop("at"), unit="ms")
        out["fires_at"] = pd.to_datetime(due, unit="ms")
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        yield self._flushed(key, expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def quiet_changes(events: DataFrame, delay: float = 5.0, late: str = "0 seconds") -> DataFrame:
    """A stream's events (root, relative_path, op, ts) by root, held back until none has come for ``delay`` seconds of event time: then
    (root, relative_path, op, ts, fires_at) with the last event of each path.

    State and timers are kept by root, so roots are different tasks' matter; a flush clears its root's state, and the checkpoint has all. An
    event that comes later than one after its own quiet belongs to the run that is open then.
    """
    spark = events.sparkSession
    ship(spark)
    if spark.conf.get(STORE) != ROCKS:
        spark.conf.set(STORE, ROCKS)  # the one store with timers
    grouped = events.withWatermark("ts", late).groupBy("root")
    return grouped.transformWithStateInPandas(Quiet(int(delay * 1000)), "root string, relative_path string, op string, ts timestamp, fires_at timestamp", "Append", "EventTime")


class AutoSync:
    """Runs ``flush`` once no mark has come for ``delay`` seconds; off where not enabled or disposed of."""

    def __init__(self, flush: Callable[[], object], delay: float = 5.0, enabled: bool = True):
        self.flush_, self.delay, self.enabled = flush, delay, enabled
        self.marked, self.timer, self.disposed, self.lock = set(), None, False, threading.Lock()

    def mark(self, path: str) -> None:
        with self.lock:
            self.marked.add(path)
            if not self.enabled or self.disposed:
                return
            if self.timer is not None:
                self.timer.cancel()
            self.timer = threading.Timer(self.delay, self.flush)
            self.timer.daemon = True
            self.timer.start()

    def flush(self) -> None:
        with self.lock:
            if not self.marked or self.disposed:
                return
            self.marked.clear()
        self.flush_()

    def dispose(self) -> None:
        with self.lock:
            self.disposed = True
            if self.timer is not None:
                self.timer.cancel()


def follow(changes: DataFrame, flush: Callable[[DataFrame, DataFrame], None], checkpoint: str, once: bool = True):
    """Run ``flush(dirty, removed)`` (paths) for each micro-batch of a change stream; returns the query."""

    def batch(rows: DataFrame, _: int) -> None:
        last = last_event(rows)
        flush(last.filter("op <> 'delete'").select("relative_path"), last.filter("op = 'delete'").select("relative_path"))

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
