"""Connected components of a graph held as rows, and small sketches merged across partitions."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillon.llm import kernels
from quillon.llm.shared import forget, store


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of undirected ``edges`` (a, b bigint): the smallest node reachable, for each node with an edge.

    Rounds of linking each node's larger neighbours to its smallest one, then each node's smaller neighbours to its
    smallest one, until nothing changes. Both are minima and distinct pairs, so a node with many links is reduced before
    the shuffle, and each round starts from a written table.
    """
    now = store(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    total = _state(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = store(large.filter("u <> v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        done, now = now, store(small.filter("u <> v").distinct(), "edges")
        forget(done)
        forget(large)
        before, total = total, _state(now)
        if total == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def merged(df: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int, chunk: int = 1 << 16, kind: type = np.uint32) -> np.ndarray:
    """The sum of ``part``'s arrays (``size`` long) over the partitions of ``df``, added up by chunk on the executors; uint8 stops at 255."""

    def emit(batches):
        counts = part(batches)
        rows = [(i, zlib.compress(counts[i * chunk : (i + 1) * chunk].tobytes(), 1)) for i in range(-(-size // chunk)) if counts[i * chunk : (i + 1) * chunk].any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["chunk", "data"])

    def add(group: pa.Table) -> pa.Table:
        total = None
        for data in group.column("data"):
            counts = np.frombuffer(zlib.decompress(data.as_py()), kind)
            total = counts.astype(np.uint32) if total is None else total + counts
        total = np.minimum(total, np.iinfo(kind).max).astype(kind)
        return pa.table({"chunk": group.column("chunk")[:1], "data": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    schema = "chunk int, data binary"
    out = np.zeros(size, kind)
    for row in df.mapInArrow(kernels.tidy(emit), schema).groupBy("chunk").applyInArrow(add, schema).collect():  # `size` counters in all
        counts = np.frombuffer(zlib.decompress(row["data"]), kind)
        out[row["chunk"] * chunk : row["chunk"] * chunk + len(counts)] = counts
    return out


def id_filter(ids: DataFrame, bits: int = 1 << 26) -> np.ndarray:
    """A bitmap of ``bits`` with two places for each of ``ids`` (one bigint column): no id is missed, some others pass."""

    def part(batches) -> np.ndarray:
        flags = np.zeros(bits // 32, np.uint32)
        for batch in batches:
            for at in id_bits(batch.column(0).to_numpy(zero_copy_only=False), bits):
                np.bitwise_or.at(flags, at >> 5, np.uint32(1) << (at & 31).astype(np.uint32))
        return flags

    def emit(batches):
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(part(batches).tobytes(), 1)], pa.binary())], ["data"])

    flags = np.zeros(bits // 32, np.uint32)
    for row in ids.coalesce(16).mapInArrow(kernels.tidy(emit), "data binary").toLocalIterator():  # 16 bitmaps at most, one at a time
        flags |= np.frombuffer(zlib.decompress(row["data"]), np.uint32)
    return flags


def id_bits(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mixed = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(20)).astype(np.int64) % bits, ((mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(20)).astype(np.int64) % bits


def passes(flags: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.ones(len(ids), bool)
    for at in id_bits(ids, len(flags) * 32):
        out &= (flags[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) != 0
    return out
