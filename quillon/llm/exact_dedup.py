"""Exact deduplication of whole texts by an extendible-hash index on shared files.

Keys are 64-bit hashes of texts, and buckets are ranges of keys. The directory has a slot for each value of a key's first ``depth`` bits; an
overfull bucket is split by one more bit, and the directory doubles where the bucket has as many bits as it. Loads come from one count over all
texts by the first ``DEEPEST`` bits, so the directory has a fixed largest size. A bucket that no more bits can split (one key may hold a
third of all rows) gets overflow pages instead.

Tasks that read texts put equal ones together before anything is shuffled, so a text leaves a task once, with its ids. Owner tasks take contiguous
ranges of buckets and pages of about equal load, sorted by key; rows of one key are chained: each is compared byte by byte with the distinct
texts of its chain, and stands for one of them or becomes the next. What they write, the index, has each distinct text of a page once. Chains
of a bucket's pages are then put together by comparing those. Rows get their group's totals through the page they are in, so the rows of a large group are
spread over its pages in every step.

Defined cases: a null text equals an empty one; very long texts are compared whole; of repeated largest ids one row, and of a group without ids one row,
is kept, and all of its rows have a null keep_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from quillon.llm import kernels
from quillon.llm.shared import store

DEEPEST = 16
CAPACITY = 8 << 20  # bytes of text in a bucket; more where the directory would have over 2^15 full buckets
HELD, HELD_IDS, OUT = 24 << 20, 200_000, 4 << 20  # what a reading task puts together at once; bytes of a batch that it sends

ENTRY = "owner int, bucket int, page int, paged boolean, key long, text string, top long, size long, ids array<long>, entry long"


class Directory:
    """Slots by the first ``depth`` bits of a key, each the number of a bucket, with each bucket's own depth, load and pages."""

    def __init__(self, loads: np.ndarray, capacity: int, depth: int, deepest: int = DEEPEST):
        """``loads`` has the bytes of texts by their keys' first ``deepest`` bits."""
        self.loads, self.deepest, self.depth = np.asarray(loads, np.int64), deepest, min(depth, deepest)
        self.before = np.concatenate([[0], np.cumsum(self.loads)])
        self.slots = np.arange(1 << self.depth)
        self.local = [self.depth] * len(self.slots)
        self.first = [i << (deepest - self.depth) for i in range(len(self.slots))]  # of the deepest slots
        todo = [b for b in range(len(self.local)) if self.load(b) > capacity]
        while todo:
            b = todo.pop()
            if self.local[b] == deepest:
                continue  # one slot of the deepest directory: pages
            todo += [x for x in self.split(b) if self.load(x) > capacity]
        self.pages = np.array([max(1, math.ceil(self.load(b) / capacity)) for b in range(len(self.local))])

    def load(self, b: int) -> int:
        return int(self.before[self.first[b] + (1 << (self.deepest - self.local[b]))] - self.before[self.first[b]])

    def split(self, b: int) -> tuple[int, int]:
        if self.local[b] == self.depth:
            self.slots, self.depth = np.repeat(self.slots, 2), self.depth + 1
        self.local[b] += 1
        new = len(self.local)
        self.local.append(self.local[b])
        self.first.append(self.first[b] + (1 << (self.deepest - self.local[b])))
        width = 1 << (self.depth - self.local[b])
        at = self.first[new] >> (self.deepest - self.depth)
        self.slots[at : at + width] = new
        return b, new

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return self.slots[(keys.view(np.uint64) >> np.uint64(64 - self.depth)).astype(np.int64)] if self.depth else np.zeros(len(keys), np.int64)

    def owners(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of a bucket's first page, owner by number): pages in the order of keys, dealt in runs of about equal load."""
        order = np.argsort(self.first, kind="stable")
        base = np.zeros(len(order), np.int64)
        base[order] = np.concatenate([[0], np.cumsum(self.pages[order])[:-1]])
        each = np.repeat([self.load(b) / self.pages[b] for b in order], self.pages[order]) + 1
        middle = np.cumsum(each) - each / 2
        return base, np.minimum((middle / each.sum() * n).astype(np.int64), n - 1)


def loads(texts: DataFrame, deepest: int = DEEPEST) -> np.ndarray:
    """Bytes of ``texts`` (key, text) by the first bits of the key: at most 2^deepest rows."""
    out = np.zeros(1 << deepest, np.int64)
    slot = F.shiftrightunsigned("key", 64 - deepest)
    for r in texts.groupBy(slot.alias("slot")).agg(F.sum(F.octet_length("text") + 32).alias("n")).collect():
        out[r["slot"]] = r["n"]
    return out


def entries(texts: DataFrame, directory: Directory, n_owners: int) -> DataFrame:
    """Each task's distinct texts with the ids (`id`) of its rows that have them."""
    base, owner = directory.owners(n_owners)
    shape = pa.schema([("owner", pa.int32()), ("bucket", pa.int32()), ("page", pa.int32()), ("paged", pa.bool_()), ("key", pa.int64()), ("text", pa.string()), ("top", pa.int64()), ("size", pa.int64()), ("ids", pa.list_(pa.int64())), ("entry", pa.int64())])

    def flush(found: list, part: int, serial: int):
        rows, size = [], 0
        for i, e in enumerate(found):
            rows.append((*e, (part << 32) + serial + i))
            size += len(e[1]) + 8 * len(e[2])
            if size > OUT or i == len(found) - 1:
                keys = np.array([r[0] for r in rows], np.int64)
                bucket = directory.bucket(keys)
                pages = directory.pages[bucket]
                page = (part * 0x9E3779B1 + serial) % pages
                ids = [r[2] for r in rows]
                columns = [owner[base[bucket] + page].astype(np.int32), bucket.astype(np.int32), page.astype(np.int32), pages > 1, keys, pa.array([r[1] for r in rows], pa.binary()).cast(pa.string())]
                columns += [pa.array([max((x for x in g if x is not None), default=None) for g in ids], pa.int64()), np.array([len(g) for g in ids], np.int64), pa.array(ids, pa.list_(pa.int64())), np.array([r[3] for r in rows], np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=shape)
                rows, size = [], 0

    def combine(batches):
        part, serial = TaskContext.get().partitionId(), 0
        chains, found, size, n = {}, [], 0, 0
        for batch in batches:
            texts_ = batch.column("text").cast(pa.large_binary())
            for key, id_, text in zip(batch.column("key").to_numpy().tolist(), batch.column("id").to_pylist(), texts_, strict=True):
                text = text.as_buffer()
                chain = chains.setdefault(key, [])
                for e in chain:
                    if pa.py_buffer(e[1]).equals(text):
                        e[2].append(id_)
                        break
                else:
                    chain.append((key, text.to_pybytes(), [id_]))
                    found.append(chain[-1])
                    size += text.size
                n += 1
                if size > HELD or n > HELD_IDS:
                    yield from flush(found, part, serial)
                    serial += len(found)
                    chains, found, size, n = {}, [], 0, 0
        yield from flush(found, part, serial)

    return texts.select("id", "key", "text").mapInArrow(kernels.tidy(combine), ENTRY)


def chained(rows: DataFrame, by: tuple[str, ...] = ("page", "key")) -> DataFrame:
    """``rows`` (key, text, ...), which are sorted by ``by`` within their partitions, with ``chain``, the number of the text among those of
    one ``by``; text is null where its chain has it already."""
    names = rows.columns
    text_at = names.index("text")

    def run(batches):
        last, chain = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, texts = np.stack([batch.column(names.index(c)).to_numpy().astype(np.int64) for c in by], 1), batch.column(text_at).cast(pa.large_binary())
            number, new = np.zeros(len(keys), np.int32), np.ones(len(keys), bool)
            bounds = np.concatenate([[0], np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1, [len(keys)]]).tolist()
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if last is None or (keys[lo] != last).any():
                    last, chain = keys[lo], []
                if hi - lo == 1 and not chain and hi < len(keys):
                    continue  # the only row of its key
                for i in range(lo, hi):
                    text = texts[i].as_buffer()
                    at = next((j for j, t in enumerate(chain) if t.equals(text)), None)
                    if at is None:
                        at = len(chain)
                        chain.append(pa.py_buffer(text.to_pybytes()))  # a copy: batches go
                    else:
                        new[i] = False
                    number[i] = at
            columns = list(batch.columns)
            if not new.all():
                columns[text_at] = columns[text_at].take(pa.array(np.arange(len(keys)), mask=~new))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(number)], [*names, "chain"])

    return rows.mapInArrow(kernels.tidy(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", chain int")


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", normal=lambda c: c, capacity: int = CAPACITY, deepest: int = DEEPEST) -> tuple[DataFrame, Directory]:
    """(the index, its directory): rows (bucket, page, paged, key, chain, text, digest, top, size, ids, entry), whose text and digest are null but
    for the first of a chain's text in a page. Texts are equal when ``normal`` of them is."""
    spark = docs.sparkSession
    texts = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(normal(F.col(text)).cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("key", F.xxhash64("text"))
    found = loads(texts, deepest)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    directory = Directory(found, max(capacity, int(found.sum() >> (deepest - 1))), (8 * n).bit_length(), deepest)
    rows = entries(texts, directory, n).repartitionById(n, "owner").sortWithinPartitions("bucket", "page", "key", "entry")
    index = chained(rows.select("bucket", "page", "paged", "key", "text", "top", "size", "ids", "entry"))
    return store(index.withColumn("digest", F.when(F.col("text").isNotNull(), F.sha2(F.col("text").cast("binary"), 256))), "hash-index"), directory


def groups(index: DataFrame, directory: Directory) -> DataFrame:
    """(key, page, chain, keep_id, winner, group_size, digest): totals of a text's group, for each page that has it."""
    page = index.groupBy("paged", "bucket", "key", "page", "chain").agg(F.max(F.struct("top", "entry")).alias("best"), F.sum("size").alias("n"), F.max("digest").alias("digest"))
    out = page.filter("not paged").select("key", "page", "chain", "best", "n", "digest")
    if (directory.pages > 1).any():
        whole = index.filter("paged and text is not null").select("key", "page", F.col("chain").alias("paged_chain"), "text")
        whole = chained(whole.repartition("key").sortWithinPartitions("key", "page", "paged_chain"), ("key",))
        place = whole.select("key", "page", F.col("paged_chain").alias("chain"), F.col("chain").alias("one"))
        parts = store(page.filter("paged").drop("paged", "bucket").join(place, ["key", "page", "chain"]), "hash-pages")
        total = parts.groupBy("key", "one").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
        out = out.unionByName(parts.drop("best", "n").join(total, ["key", "one"]).select(out.columns))
    return out.select("key", "page", "chain", F.col("best.top").alias("keep_id"), F.col("best.entry").alias("winner"), F.col("n").alias("group_size"), "digest")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", normal=lambda c: c, capacity: int = CAPACITY, deepest: int = DEEPEST) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs``; of equal texts the row with the largest id is kept."""
    index, directory = build(docs, key, text, normal, capacity, deepest)
    rows = index.select("key", "page", "chain", "ids", "entry").join(groups(index, directory), ["key", "page", "chain"])
    kept_at = F.when(F.col("entry") == F.col("winner"), F.coalesce(F.array_position("ids", F.col("keep_id")), F.lit(1)) - 1)
    each = rows.select(F.posexplode("ids").alias("at", "doc_id"), "keep_id", "group_size", "digest", kept_at.alias("_kept"))
    return each.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("at") == F.col("_kept"), F.lit(False)).alias("kept"), F.col("digest").alias("text_sha256"))
