"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected to eight random directions, several times over, and each projection is decoded to its nearest point of
the E8 lattice. A vector is kept at its own cell of each table and looked for there and in the neighbouring cells that
lie nearest to it. Pairs that meet are verified by cosine in double precision, so no link is below the threshold; what is missed is what
meets in no table (tests measure the recall against brute force).

Vectors are compared only within a label and a number of components. Equal vectors are one class, looked up once and
counted with their number. Components are found over links between classes.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label, link with nothing;
a null vec_id likewise; rows that share a vec_id are rows of their own, each with its links, copies of one another where their labels and vectors
are equal; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quillon.llm import kernels
from quillon.llm.components import components
from quillon.llm.shared import forget, store

TABLES, PROBES, CELL = 8, 8, 1.2

#: The 240 shortest vectors of E8.
NEIGHBOURS = np.array(
    [v for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1) for v in [[a if k == i else b if k == j else 0 for k in range(8)]]]
    + [list(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
)


def nearest(y: np.ndarray) -> np.ndarray:
    """The E8 point nearest to each row: the better of the two cosets of D8."""

    def even(z: np.ndarray) -> np.ndarray:
        r = np.rint(z)
        odd = np.flatnonzero(r.sum(1) % 2)
        off = z[odd] - r[odd]
        worst = np.abs(off).argmax(1)
        r[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
        return r

    a, b = even(y), even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


def cells(units: np.ndarray, tables: int = TABLES, probes: int = PROBES, cell: float = CELL) -> tuple[np.ndarray, np.ndarray]:
    """(own, probed): hashed cells, one column a table, and ``1 + probes`` a table."""
    rng = np.random.default_rng((units.shape[1], 8))
    own, probed = [], []
    for t in range(tables):
        y = units @ rng.standard_normal((units.shape[1], 8)) / cell + rng.random(8)
        point = nearest(y)
        near = np.argpartition(-((y - point) @ NEIGHBOURS.T), probes, axis=1)[:, :probes]
        around = np.concatenate([point[:, None, :], point[:, None, :] + NEIGHBOURS[near]], 1)
        code = np.rint(around * 2).astype(np.int64).view(np.uint64)
        h = np.full(code.shape[:2], np.uint64(t + 1))
        for k in range(8):
            h = kernels.mix(h ^ (code[:, :, k] + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))))
        own.append(h[:, 0])
        probed.append(h)
    return np.stack(own, 1), np.concatenate(probed, 1)


def signs(units: np.ndarray) -> np.ndarray:
    """64 bits of each row: on which side of as many random planes it is."""
    planes = np.random.default_rng((units.shape[1], 64)).standard_normal((units.shape[1], 64))
    return np.packbits(units @ planes > 0, axis=1).view(np.uint64)[:, 0]


def most_apart(threshold: float) -> int:
    """In how many of 64 signs vectors with that cosine may differ: 6.5 standard deviations above the mean, which one pair in a
    thousand million exceeds."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return math.ceil(64 * p + 6.5 * math.sqrt(64 * p * (1 - p)))


def usable() -> Column:
    """Whether a row (vec_id, label, v: array<double>) can link."""
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(fine, F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def candidates(classes: DataFrame, tables: int, probes: int, cell: float, threshold: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, of classes (vec_id, label, v) that meet in a cell of a table and whose signs don't speak against
    a cosine of ``threshold``."""
    entry, apart = pa.schema([("cell", pa.int64()), ("vec_id", pa.int64()), ("sign", pa.int64()), ("looks", pa.bool_())]), most_apart(threshold)

    def place(batches):
        for batch in batches:
            size = np.array([len(x) for x in batch.column("v")])
            labels = np.array([int.from_bytes(str(x).encode()[:64].ljust(8, b"\0"), "little") % (1 << 63) for x in batch.column("label").to_pylist()], np.uint64)
            for d in np.unique(size):
                rows = np.flatnonzero(size == d)
                v = _matrix(batch.column("v").take(pa.array(rows)))
                v = v / np.abs(v).max(1, keepdims=True)
                v = v / np.linalg.norm(v, axis=1, keepdims=True)
                own, probed = cells(v, tables, probes, cell)
                sign = signs(v).view(np.int64)
                mark = kernels.mix(labels[rows] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(d))[:, None]
                ids = batch.column("vec_id").to_numpy()[rows]
                for keys, looks in ((own, False), (probed, True)):
                    keys = kernels.mix(keys ^ mark)
                    n = keys.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids, n)), pa.array(np.repeat(sign, n)), pa.array(np.full(keys.size, looks))], schema=entry)

    pair = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def meet(batches):
        held = None
        out: list[np.ndarray] = []

        def flush():
            both = np.unique(np.concatenate(out), axis=0)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], schema=pair)

        def runs(cols, last):
            cell_, ids, sign, looks = cols
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(cell_)) + 1, [len(cell_)]])
            long = np.flatnonzero(np.diff(bounds) > 1)
            for r in long if last else long[long < len(bounds) - 2]:
                s = slice(bounds[r], bounds[r + 1])
                here, its = ids[s][~looks[s]], sign[s][~looks[s]]
                there, first = np.unique(ids[s][looks[s]], return_index=True)
                theirs = sign[s][looks[s]][first]
                for lo in range(0, len(here), 256):
                    x, y = np.nonzero(np.bitwise_count((its[lo : lo + 256, None] ^ theirs).view(np.uint64)) <= apart)
                    x, y = here[lo + x], there[y]
                    keep = x != y
                    if keep.any():
                        out.append(np.stack([np.minimum(x, y)[keep], np.maximum(x, y)[keep]], 1))
                    if sum(map(len, out)) > 500_000:
                        yield flush()
            held.append(bounds[-2])

        carry = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if carry is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(carry, cols, strict=True)]
            if len(cols[0]):
                held = []
                yield from runs(cols, False)
                carry = [c[held[0] :] for c in cols]
        if carry is not None and len(carry[0]):
            held = []
            yield from runs(carry, True)
        if out:
            yield flush()

    entries = classes.select("vec_id", "label", "v").mapInArrow(kernels.tidy(place), "cell long, vec_id long, sign long, looks boolean")
    return entries.repartition("cell").sortWithinPartitions("cell").mapInArrow(kernels.tidy(meet), "a long, b long").distinct()


def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    out = np.zeros(len(a))
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = x.values.to_numpy(), y.values.to_numpy()
        if len(x) == len(y):
            x, y = x / np.abs(x).max(), y / np.abs(y).max()  # else squares of extreme values overflow
            out[i] = (x @ y) / (np.sqrt(x @ x) * np.sqrt(y @ y))
    return pa.array(out)


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, tables: int = TABLES, probes: int = PROBES, cell: float = CELL, vec: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, label, ``vec``)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col(vec).cast("array<double>").alias("v"))
    key = F.when(usable(), F.sha2(F.to_json(F.struct("label", "v")), 256))
    members = store(rows.withColumn("key", key), "vectors")
    classes = members.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = store(classes.withColumn("vec_id", F.monotonically_increasing_id()), "classes")  # a class's own number: ids may repeat
    pairs = store(candidates(classes, tables, probes, cell, threshold), "met")
    score = F.arrow_udf(cosine, "double")
    one, two = (classes.select(F.col("vec_id").alias(x), F.col("label").alias(f"label_{x}"), F.col("v").alias(f"v_{x}")) for x in "ab")
    links = pairs.join(one, "a").join(two, "b").filter("label_a = label_b").withColumn("cosine", score(F.col("v_a"), F.col("v_b")))
    links = store(links.filter(F.col("cosine") >= threshold).select("a", "b"), "links")
    forget(pairs)
    copies = classes.select(F.col("vec_id").alias("b"), "copies")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(copies, "b").groupBy("a").agg(F.sum("copies").alias("others"))
    of_class = classes.select("key", "least", F.col("vec_id").alias("lead"), "copies").join(degree, F.col("lead") == F.col("a"), "left").join(components(links), F.col("lead") == F.col("node"), "left")
    of_class = store(of_class.select("key", "least", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "lead").alias("component")), "linked")
    forget(links)
    forget(classes)
    least = of_class.groupBy("component").agg(F.min("least").alias("component_id"))
    found = of_class.join(least, "component").select("key", "n_links", "component_id")
    out = members.select("vec_id", "key").join(found, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
