"""Suffix-array deduplication of byte strings.

Every byte covered by a ``width``-byte string that also starts anywhere else, in any document, goes; strings are judged on
the input, texts as UTF-8. Anchored segments (see ``repeats``) stand for all windows that the sketch lets through. Copies of one segment are
one segment that repeats as a whole; of each distinct one whose anchor has others, a copy is dealt to a shard by anchor, so that
equal strings meet. A shard's segments are written end to end to a file as they come, and sorted by external induced sorting
(``induced_sort``), whose tuples carry the common prefixes through sweeps and recursion; neighbours in suffix order that have ``width``
bytes in common are repeats.

No array of the size of a shard is held: text, places, queues, order and marks are files of the task's scratch folder, some 20 bytes a
byte of the shard, which go with the task. ``SORT_MEMORY`` bounds the blocks and queues, ``IN_MEMORY`` the strings of names that are sorted without
further recursion; every text of more than a thousand bytes goes through sweeps and queues. So an anchor with many distinct segments, all in one shard, costs time and disk but no memory.

Defined cases: a null text is empty; texts shorter than ``width`` keep all; very long texts are taken whole; repeated rows
repeat each other, as do rows that share a doc_id or have none; an empty table gives an empty result; other columns stay as they are, but
``kept``, ``kept_text``, ``n_bytes``, ``n_removed`` and ``n_spans`` of the input are replaced. Bytes that are left may no longer be whole characters: ``kept``
is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillon.llm import induced_sort, kernels
from quillon.llm.repeats import ROW, Repeats, covered, with_spans
from quillon.llm.shared import store

GRAM = 64  # shorter anchors recur by chance, in segments that then have to be sorted
SHARD = 2 << 20  # bytes of segments sorted at once, on average
SORT_MEMORY = 16 << 20
IN_MEMORY = 1 << 20  # names


class Shard:
    """Segments end to end in files: their bytes as symbols, a 1 after each and a 0 after all, and where each is from."""

    def __init__(self, scratch: induced_sort.Scratch):
        self.scratch, self.n, self.segments = scratch, 0, 0
        self.paths = {c: scratch.path() for c in ("text", "begin", *ROW, "at")}

    def add(self, batch: pa.RecordBatch) -> None:
        data = batch.column("data").cast(pa.large_binary())
        offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        sizes = np.diff(offsets)
        begins = np.cumsum(sizes + 1) - (sizes + 1)
        text = np.ones(int(sizes.sum()) + len(sizes), np.uint16)
        inside = np.ones(len(text), bool)
        inside[begins + sizes] = False
        text[inside] = np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint16) + 2
        columns = {"text": text, "begin": begins + self.n, **{c: batch.column(c).to_numpy().astype(np.int64) for c in (*ROW, "at")}}
        for c, values in columns.items():
            with open(self.paths[c], "ab") as file:
                file.write(values.tobytes())
        self.n += len(text)
        self.segments += len(sizes)

    def array(self, c: str) -> np.ndarray:
        return np.memmap(self.paths[c], np.uint16, "r") if c == "text" else np.memmap(self.paths[c], np.int64, "r", shape=(self.segments,))

    def repeated(self, width: int, memory: int, in_memory: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, lengths) of runs of starts of ``width``-byte strings that start more than once."""
        with open(self.paths["text"], "ab") as file:
            file.write(np.zeros(1, np.uint16).tobytes())
        order, common = induced_sort.sort_suffixes(self.array("text"), width, memory, self.scratch, in_memory)
        marks, block, begins = self.scratch.array(self.n + 1, bool), max(64, memory // 16), self.array("begin")
        for lo in range(0, len(order), block):
            shared = np.append(common[lo : lo + block + 1], 0)[: block + 1] >= width  # each with the one before, and the one after
            places = np.asarray(order[lo : lo + block]).astype(np.int64)
            places = places[shared[: len(places)] | shared[1 : len(places) + 1]]
            after = np.searchsorted(begins, places, "right")
            end = np.where(after < self.segments, begins[np.minimum(after, self.segments - 1)], self.n)
            marks[places[places + width < end]] = True  # not those that reach over a segment's end
        for lo in range(0, self.n, block):
            here = np.concatenate([[False], marks[lo : min(lo + block, self.n)], [False]])
            edge = np.flatnonzero(here[1:] != here[:-1])
            if len(edge):
                yield edge[::2] + lo, edge[1::2] - edge[::2]


def removed_windows(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, digest, at, n): runs of window starts that repeat anywhere."""
    repeats = Repeats(docs, width, min(GRAM, width // 2), False)
    segments = repeats.candidates()
    grouped = repeats.grouped(segments)
    keys = ["anchor", "s1", "s2"]
    whole = segments.join(grouped.filter("copies > 1").select(*keys), keys, "left_semi").select(*ROW, "at", "n")
    schema = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("at", pa.int32()), ("data", pa.binary())])

    def contents(ids, digests, local, at, n, anchor, data, offsets, units):
        parts = [data[a : a + k + width - 1].tobytes() for a, k in zip(at.tolist(), n.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(ids), pa.array(digests), pa.array(local.astype(np.int32)), pa.array(parts, pa.binary())], schema=schema)

    mixed = store(repeats.unsettled(grouped, contents, "anchor long, doc_id long, digest long, at int, data binary", False), "mixed")
    # segments that are settled already stand for their content with one copy
    size = mixed.agg(F.sum(F.length("data")).alias("n")).first()["n"] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(size // SHARD) + 1)
    out = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("at", pa.int32()), ("n", pa.int32())])

    memory, in_memory = SORT_MEMORY, IN_MEMORY

    def sort_shard(batches):
        kernels.trim()
        with induced_sort.Scratch() as scratch:
            shard = Shard(scratch)
            for batch in batches:
                if len(batch):
                    shard.add(batch)
            if not shard.n:
                return
            begins, (doc, digest, at) = shard.array("begin"), (shard.array(c) for c in (*ROW, "at"))
            for places, lengths in shard.repeated(width, memory, in_memory):
                of = np.searchsorted(begins, places, "right") - 1
                columns = (doc[of], digest[of], at[of] + places - begins[of], lengths)
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(f.type.to_pandas_dtype())) for x, f in zip(columns, out, strict=True)], schema=out)

    single = mixed.repartition(shards, "anchor").mapInArrow(kernels.tidy(sort_shard), "doc_id long, digest long, at int, n int")
    return whole.unionByName(store(single, "single"))


def dedup(docs: DataFrame, width: int = 200) -> DataFrame:
    """``docs`` with ``kept`` (binary), ``kept_text`` (its whole characters), ``n_bytes``, ``n_removed`` and ``n_spans`` (maximal removed
    runs), in place of columns of these names."""
    joined = with_spans(docs, removed_windows(docs, width))
    schema = {"kept": "binary", "kept_text": "string", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint"}

    @F.arrow_udf(f"struct<{','.join(f'{c}:{t}' for c, t in schema.items())}>")
    def keep(texts: pa.Array, spans_: pa.Array) -> pa.Array:
        rows = []
        for text, runs in zip(texts.cast(pa.binary()), spans_, strict=True):
            raw = text.as_py() or b""
            if not runs.is_valid:
                rows.append((raw, raw, len(raw), 0, 0))
                continue
            mask = covered(runs.as_py(), width, len(raw))
            begins = int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1]))
            left = np.frombuffer(raw, np.uint8)[~mask].tobytes()
            rows.append((left, left.decode("utf-8", "ignore").encode(), len(raw), int(mask.sum()), begins))  # part of a character goes
        kept, whole, *counts = zip(*rows, strict=True) if rows else ((), (), (), (), ())
        kernels.trim()
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(whole, pa.binary()).cast(pa.string()), *[pa.array(c, pa.int64()) for c in counts]], list(schema))

    # said not to be deterministic, so that no filter on its columns is put before it and makes them twice
    out = joined.withColumn("_quillon_kept", keep.asNondeterministic()(F.col("text"), F.col("_quillon_spans")))
    return out.withColumns({c: F.col(f"_quillon_kept.{c}") for c in schema}).drop("_quillon_kept", "_quillon_spans")
