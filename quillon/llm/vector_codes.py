"""Product-quantised codes of vectors, with codebooks found by integer rounds and nearest entries by VA-file filtering.

Components become integers, ``floor(256 x)``, and vectors are cut into equal parts, each position with a codebook of its own. A codebook's
coordinates are quantised to a few bits: cells of about as many entries each, between marks. For a batch of parts, tables by coordinate
and cell hold the least and the largest squared difference that a part can have to a value of that cell; adding the looked-up values
bounds the distance to each entry from below and above. Entries whose lower bound exceeds the least upper bound can't be nearest; the others
are compared by exact integer distances, ties to the lower index.

The codebooks are the only state of a round, a number of rows fixed by ``parts`` and ``entries``: tasks send one sum an entry and batch, Spark
adds them, and the driver divides.

Defined cases: rows whose vector is null, empty, or holds null or non-finite components are dropped, as are those whose length isn't a multiple of
``parts`` or differs from that of the smallest remaining id's vector; integers stop at 2^24 in size (components beyond 65,536), so squares fit; with fewer
than ``entries`` vectors a codebook is smaller; equal ids are taken in order of their components, null ids last; repeated rows count each; null
labels are one group; a group's error beyond 63 bits is null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillon.llm import kernels
from quillon.llm.shared import store

PARTS, ENTRIES, ROUNDS, BITS, LARGEST, SALTS = 16, 64, 2, 3, 1 << 24, 16
ROWS = 1024  # parts that are bounded at once


def kept(vectors: DataFrame, vec: str = "embedding", parts: int = PARTS) -> DataFrame:
    """(vec_id, label, q) of the rows that can be coded; q holds integers."""
    rows = vectors.select("vec_id", "label", F.col(vec).cast("array<double>").alias("_v")).filter(F.col("_v").isNotNull())
    rows = rows.filter((F.size("_v") > 0) & (F.size("_v") % parts == 0) & ~F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    whole = lambda x: F.floor(F.least(F.greatest(x * 256, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("int")
    return rows.select("vec_id", "label", F.transform("_v", whole).alias("q"))


class Filter:
    """Bounds and exact distances to one position's entries."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        cells = 1 << bits
        order = np.argsort(entries, axis=0, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(len(entries))[:, None], 0)
        self.code = rank * cells // len(entries)  # cells of about as many entries
        low, high = np.full((cells, entries.shape[1]), np.iinfo(np.int64).max), np.full((cells, entries.shape[1]), np.iinfo(np.int64).min)
        for j in range(entries.shape[1]):
            np.minimum.at(low[:, j], self.code[:, j], entries[:, j])
            np.maximum.at(high[:, j], self.code[:, j], entries[:, j])
        empty = low > high
        low[empty] = high[empty] = 0  # no entry has that cell
        self.low, self.high = low, high

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, its squared distance) of each row."""
        index, error = np.empty(len(q), np.int64), np.empty(len(q), np.int64)
        for lo in range(0, len(q), ROWS):
            here = q[lo : lo + ROWS]
            under, over = np.zeros((len(here), len(self.entries)), np.int64), np.zeros((len(here), len(self.entries)), np.int64)
            for j in range(q.shape[1]):
                x = here[:, j, None]
                to_low, to_high = x - self.low[:, j], x - self.high[:, j]  # tables by query and cell
                least = np.maximum(np.maximum(-to_low, to_high), 0) ** 2
                most = np.maximum(np.abs(to_low), np.abs(to_high)) ** 2
                under += np.take(least, self.code[:, j], axis=1)
                over += np.take(most, self.code[:, j], axis=1)
            row, entry = np.nonzero(under <= over.min(1, keepdims=True))
            distance = ((here[row] - self.entries[entry]) ** 2).sum(1)
            first = np.searchsorted(row, np.arange(len(here)))  # each row has its entry of the least upper bound
            best = np.minimum.reduceat(distance, first)
            hit = np.flatnonzero(distance == best[row])
            _, at = np.unique(row[hit], return_index=True)
            index[lo : lo + ROWS], error[lo : lo + ROWS] = entry[hit[at]], best
        return index, error


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    """Rows, positions, components."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), parts, -1)


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: each entry the floor of the mean of the parts that are nearest to it, or as it was."""
    parts, entries, width = books.shape

    def sums(batches):
        filters = [Filter(b) for b in books]
        for batch in batches:
            q = _matrix(batch.column("q"), parts)
            for p, f in enumerate(filters):
                index, _ = f.nearest(q[:, p])
                count = np.bincount(index, minlength=entries)
                total = np.zeros((entries, width), np.int64)
                np.add.at(total, index, q[:, p])
                used = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p), pa.int32()), pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], ["p", "e", "n", "total"])

    found = rows.select("q").mapInArrow(kernels.tidy(sums), "p int, e int, n long, total array<long>")
    added = found.groupBy("p", "e").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(width)]).alias("total"))
    out = books.copy()
    for r in added.collect():  # at most parts x entries
        out[r["p"], r["e"]] = [t // r["n"] for t in r["total"]]
    return out


def codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """(positions, entries, components) after all rounds; None without rows."""
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").select("q").limit(entries).collect()
    if not seeds:
        return None
    first = len(seeds[0]["q"])
    seeds = [s["q"] for s in rows.filter(F.size("q") == first).orderBy(F.col("vec_id").asc_nulls_last(), "q").select("q").limit(entries).collect()] if any(len(s["q"]) != first for s in seeds) else [s["q"] for s in seeds]
    books = np.ascontiguousarray(np.array(seeds, np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2))
    rows = rows.filter(F.size("q") == first)
    for _ in range(rounds):
        books = moved(rows, books)
    return books


def codes(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of rows."""
    parts, _, width = books.shape

    def assign(q: pa.Array) -> pa.Array:
        q, index, error = _matrix(q, parts), np.empty((len(q), parts), np.uint8), np.zeros(len(q), np.int64)
        for p in range(parts):
            index[:, p], far = Filter(books[p]).nearest(q[:, p])
            error += far
        return pa.StructArray.from_arrays([pa.array([i.tobytes().hex() for i in index], pa.string()), pa.array(error)], ["code", "error"])

    coded = rows.filter(F.size("q") == parts * width).withColumn("_coded", F.arrow_udf(assign, "code string, error long")(F.col("q")))
    return coded.select("vec_id", "label", "_coded.code", "_coded.error")


def compressed(vectors: DataFrame, vec: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every row of ``vectors`` (vec_id, label, ``vec``) that can be coded."""
    rows = store(kept(vectors, vec, parts), "integers")
    books = codebooks(rows, parts, entries, rounds)
    if books is None:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = store(codes(rows, books), "codes")
    # a label may hold most rows: their sums are made before the shuffle, and the join is dealt by label and salt
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    sums = sums.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    out = salted.join(sums, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_deal")))
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
