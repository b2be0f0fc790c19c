"""Watching a tree, state with timers, and the way from a changed file to the index."""

import os
import time

import pytest
from pyspark.sql import functions as F

from quillon.operators.index import Index, Status
from quillon.streaming import changes


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_a_watched_tree_gives_its_changes(spark, tmp_path):
    ws, seen = tmp_path / "ws", []
    put(ws / "a.c", "int a(void) { }\n")
    put(ws / "d/b.c", "int b(void) { }\n")

    def look():
        stream = changes.watch(spark, str(ws), str(tmp_path / "state"))
        query = stream.writeStream.foreachBatch(lambda df, _: seen.extend((r["relative_path"], r["op"]) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        out = sorted(seen)
        seen.clear()
        return out

    assert look() == []  # what is there at first is no change
    put(ws / "a.c", "int aa(void) { return 1; }\n")
    put(ws / "d/new.c", "x")
    put(ws / "note.txt", "x")
    os.remove(ws / "d/b.c")
    assert look() == [("a.c", "change"), ("d/b.c", "delete"), ("d/new.c", "create")]
    assert look() == [] and len([n for n in os.listdir(tmp_path / "state") if n.startswith("listing-")]) <= 2


def test_from_a_changed_file_to_the_index(spark, tmp_path):
    """Watcher, stream and index know each other: editing files changes what a search finds."""
    ws = tmp_path / "ws"
    put(ws / "a.c", "int first(void) { }\n")
    put(ws / "b.c", "int other(void) { }\n")
    idx = Index(spark, str(ws), str(tmp_path / "index"))
    idx.synchronize()
    follow = lambda: changes.follow(changes.watch(spark, str(ws), str(tmp_path / "state")), idx.take_up, str(tmp_path / "cp")).awaitTermination(180)
    assert follow() and idx.count("first") == 1
    put(ws / "a.c", "int second(void) { return 2; }\n")
    os.remove(ws / "b.c")
    assert follow()
    assert idx.count("second") == 1 and idx.count("first") == 0 and idx.count("other") == 0 and idx.status is Status.READY


def test_a_mark_reaches_the_index_after_quiet(spark, tmp_path):
    ws = tmp_path / "ws"
    put(ws / "a.c", "int first(void) { }\n")
    idx = Index(spark, str(ws), str(tmp_path / "index"), auto_sync=0.2)
    idx.synchronize()
    put(ws / "a.c", "int third(void) { return 2; }\n")
    idx.mark("a.c")
    until = time.time() + 60
    while idx.status is not Status.READY and time.time() < until:
        time.sleep(0.2)
    idx.dispose()
    assert idx.count("third") == 1


def test_a_disabled_index_does_nothing(spark, tmp_path):
    ws = tmp_path / "ws"
    put(ws / "a.c", "int first(void) { }\n")
    idx = Index(spark, str(ws), str(tmp_path / "index"), enabled=False)
    idx.mark("a.c")
    assert idx.synchronize() is None and idx.sync_dirty() is None and not idx._dirty and not (tmp_path / "index").exists() and idx.count("first") == 0


def events_of(spark, rows):
    return spark.createDataFrame(rows, "root string, relative_path string, op string, t double").select("root", "relative_path", "op", F.timestamp_seconds("t").alias("ts"))


ROUNDS = [
    [("w", "a.c", "change", 0.0), ("w", "b.c", "create", 1.0), ("v", "x.c", "change", 0.5)],
    [("w", "a.c", "delete", 4.0), ("w", "b.c", "change", 0.5)],  # in time: the timer is set anew; the late event of b.c loses
    [("w", "c.c", "change", 30.0), ("v", "y.c", "change", 31.0)],
    [("u", "end.c", "change", 300.0)],
]
WANT = [("v", "x.c", "change", 5.5), ("v", "y.c", "change", 36.0), ("w", "a.c", "delete", 9.0), ("w", "b.c", "create", 9.0), ("w", "c.c", "change", 35.0)]


def test_events_wait_for_quiet_by_root(spark, tmp_path):
    """Each round is a run of its own from the checkpoint, so timers and state outlive restarts; the rows equal the batch form's."""
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for rows in [*ROUNDS, [("u", "later.c", "change", 301.0)]]:
            events_of(spark, rows).coalesce(1).write.mode("append").parquet(log)
            stream = changes.quiet_changes(spark.readStream.schema("root string, relative_path string, op string, ts timestamp").parquet(log), 5.0)
            query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
            assert query.awaitTermination(180)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = spark.read.parquet(out).select("root", "relative_path", "op", F.unix_millis("fires_at").alias("f")).collect()
    assert sorted((r[0], r[1], r[2], r[3] / 1000) for r in got) == WANT
    whole = events_of(spark, [r for rows in ROUNDS for r in rows])
    runs = changes.debounce(whole, "5 seconds", ("root",)).filter("root <> 'u'")
    assert sorted({(r[0], r[3] / 1000) for r in got}) == sorted((r["root"], r["f"] / 1000) for r in runs.select("root", F.unix_millis("fires_at").alias("f")).collect())


@pytest.mark.parametrize("delay", [0.0])
def test_no_delay_puts_events_out_at_once(spark, tmp_path, delay):
    log = str(tmp_path / "log")
    events_of(spark, [("w", "a.c", "change", 1.0)]).coalesce(1).write.parquet(log)
    events_of(spark, [("w", "b.c", "change", 9.0)]).coalesce(1).write.mode("append").parquet(log)
    stream = changes.quiet_changes(spark.readStream.schema("root string, relative_path string, op string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(log), delay)
    query = stream.writeStream.format("memory").queryName("at_once").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    assert spark.sql("select relative_path from at_once").collect()
