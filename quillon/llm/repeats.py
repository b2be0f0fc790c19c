"""Windows that repeat, by anchored segments: what substring and suffix-array deduplication share.

A window (``width`` words or bytes) is anchored at its smallest hashed ``gram``-unit run, the leftmost of equals. Consecutive windows with
one anchor make a segment; every window is in exactly one, and equal windows have equal anchors at equal places. So

* a count-min sketch of anchors, merged over partitions, overestimates each window's count, and a window whose anchor is
  estimated once occurs once;
* segments of the same content repeat whole, and are settled by grouping their hashes;
* only anchors that are met in different segments (edits, and where a shared passage begins and ends) leave windows to
  compare, one copy of each distinct segment.

Contents are hashed whole, to 128 bits (XXH3); the sketch and the bitmap of segments only ever let too much through.

A row is known by doc_id (0 for null) and a digest of doc_id and text, so rows that share a doc_id stay apart; rows equal in both
have the same windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quillon.llm import kernels
from quillon.llm.components import id_filter, merged, passes
from quillon.llm.shared import forget, plan_bytes, store

ROW = ["doc_id", "digest"]
SEGMENT = "doc_id long, digest long, at int, n int, anchor long, s1 long, s2 long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("anchor", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64())])
FLAGS = 1 << 29  # bits of the bitmap of unsettled segments that is broadcast at most


def row_key() -> tuple[Column, Column]:
    """(doc_id, digest) of a row with doc_id and text."""
    doc = F.col("doc_id").cast("long")
    return F.coalesce(doc, F.lit(0).cast("long")), F.xxhash64(doc, F.coalesce("text", F.lit("")))


class Repeats:
    def __init__(self, docs: DataFrame, width: int, gram: int, words: bool):
        doc, digest = row_key()
        self.docs = docs.select(doc.alias("doc_id"), digest.alias("digest"), "text")
        self.width, self.gram, self.words = width, gram, words

    def __getstate__(self):
        return {"width": self.width, "gram": self.gram, "words": self.words}

    def segments(self, data: np.ndarray, offsets: np.ndarray):
        """(text, at, n, anchor, units, first): segments of each text, ``at`` the first window's place in the
        chunk's units and ``n`` the number of windows; ``first`` where each text's units begin."""
        if self.words:
            starts, ends, first = kernels.words(data, offsets)
            lane = kernels.word_hashes(data, starts)
            units = (starts, ends)
        else:
            first = offsets
            lane = kernels._BYTES[0][data] + np.uint64(0x9E3779B97F4A7C15) * data
            units = None
        n = len(lane) - self.width + 1
        none = np.zeros(0, np.int64)
        if n <= 0:
            return none, none, none, none, units, first
        text = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
        grams = kernels.window_hashes(lane, self.gram)
        anchor = kernels.sliding_argmin(grams, self.width - self.gram + 1)
        valid = text[:n] == text[self.width - 1 :]
        edge = np.ones(n, bool)
        edge[1:] = (anchor[1:] != anchor[:-1]) | (text[1:n] != text[: n - 1]) | (valid[1:] != valid[:-1])
        begins = np.flatnonzero(edge)
        sizes = np.diff(np.append(begins, n))
        keep = valid[begins]
        begins, sizes = begins[keep], sizes[keep]
        return text[begins].astype(np.int64), begins, sizes, grams[anchor[begins]].view(np.int64), units, first

    def contents(self, data: np.ndarray, units, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit hashes, in two halves, of what runs of units (bytes, or words with one space between) hold."""
        if self.words:
            starts, stops = units
            data, shift = kernels.single_spaced(data, starts, stops)
            begins, ends = starts[begins] - shift[begins], stops[ends - 1] - shift[ends - 1]
        view, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_128_digest
        both = np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]), np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def _counters(self, size: int):
        def part(batches) -> np.ndarray:
            counts = np.zeros(size, np.uint8)
            for batch in batches:
                for _, data, offsets in kernels.chunks(batch.column("text")):
                    anchors, n = np.unique(self.segments(data, offsets)[3], return_counts=True)
                    for at in self.slots(anchors, size):
                        np.add.at(counts, at, np.minimum(n, 2).astype(np.uint8))
                        counts[at] = np.minimum(counts[at], 2)
            return counts

        return part

    @staticmethod
    def slots(anchor: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """A counter in each of the sketch's two rows."""
        a, half = anchor.view(np.uint64), size // 2
        return (a >> np.uint64(8)).astype(np.int64) & (half - 1), ((a * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)).astype(np.int64) & (half - 1)) + half

    def candidates(self) -> DataFrame:
        """Segments whose anchors the sketch estimates to repeat: the smaller of their two counters says so."""
        size = 1 << max(20, min(27, (plan_bytes(self.docs) // 8).bit_length()))
        counts = merged(self.docs.select("text"), self._counters(size), size, 1 << 18, np.uint8)
        bits = self.docs.sparkSession.sparkContext.broadcast(np.packbits(counts >= 2))

        def emit(batches):
            for batch in batches:
                ids, digests = (batch.column(c).to_numpy(zero_copy_only=False) for c in ROW)
                for row, data, offsets in kernels.chunks(batch.column("text")):
                    text, at, n, anchor, units, first = self.segments(data, offsets)
                    keep = np.ones(len(anchor), bool)
                    for slot in self.slots(anchor, size):
                        keep &= (bits.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 != 0
                    text, at, n = text[keep], at[keep], n[keep]
                    s1, s2 = self.contents(data, units, at, at + n + self.width - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids[row + text], digests[row + text], (at - first[text]).astype(np.int32), n.astype(np.int32), anchor[keep], s1, s2), _SCHEMA, strict=True)], schema=_SCHEMA)

        return store(self.docs.mapInArrow(kernels.tidy(emit), SEGMENT), "segments")

    @staticmethod
    def grouped(segments: DataFrame) -> DataFrame:
        """Distinct segments of anchors seen twice or more: copies, the first (doc_id, digest, at) and whether the anchor has others."""
        one = store(segments.groupBy("anchor", "s1", "s2").agg(F.count("*").alias("copies"), F.min(F.struct(*ROW, "at")).alias("lead"), F.max("doc_id").alias("last")), "distinct")
        kinds = one.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("copies").alias("seen")).filter("seen > 1")
        out = store(one.join(kinds, "anchor").select("anchor", "s1", "s2", "copies", "lead", "last", (F.col("kinds") > 1).alias("mixed")), "grouped")
        forget(one)
        return out

    def unsettled(self, grouped: DataFrame, emit_rows, ddl: str, whole_document: bool) -> DataFrame:
        """``emit_rows`` of one copy (and seldom some others) of each segment whose anchor has others, or of all segments with its
        anchor in the document where it is first.

        What is wanted is a bitmap of 16 bits a segment, as far as ``FLAGS`` bits go; beyond, texts are joined with what is wanted of them.
        """
        key = ["doc_id"] if whole_document else ROW

        def name(doc, digest, local, anchor):
            what = anchor if whole_document else kernels.mix(digest.view(np.uint64) + local.astype(np.uint64)).view(np.int64)
            return kernels.mix(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ what.view(np.uint64)).view(np.int64)

        def names(batches):
            for batch in batches:
                cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*ROW, "at", "anchor")]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in key], pa.array(name(*cols))], [*key, "id"])

        wanted = store(grouped.filter("mixed").select("lead.*", "anchor").mapInArrow(kernels.tidy(names), ", ".join(f"{c} long" for c in [*key, "id"])), "wanted")
        bits = wanted.count() * 16

        def emit(batches, known):
            for batch in batches:
                ids, digests = (batch.column(c).to_numpy(zero_copy_only=False) for c in ROW)
                for row, data, offsets in kernels.chunks(batch.column("text")):
                    text, at, n, anchor, units, first = self.segments(data, offsets)
                    local = at - first[text]
                    keep = known(batch, row, len(offsets) - 1, name(ids[row + text], digests[row + text], local, anchor))
                    if keep.any():
                        yield from emit_rows(ids[row + text[keep]], digests[row + text[keep]], local[keep], at[keep], n[keep], anchor[keep], data, offsets, units)

        if bits <= FLAGS:
            flags = self.docs.sparkSession.sparkContext.broadcast(id_filter(wanted.select("id"), 1 << max(20, bits.bit_length())))
            return self.docs.mapInArrow(kernels.tidy(lambda batches: emit(batches, lambda batch, row, n, ids: passes(flags.value, ids))), ddl)
        of_row = wanted.groupBy(*[F.col(c).alias(f"_{c}") for c in key]).agg(F.collect_set("id").alias("wanted"))
        joined = self.docs.join(of_row, [F.col(c) == F.col(f"_{c}") for c in key]).select(*ROW, "text", "wanted")
        return joined.mapInArrow(kernels.tidy(lambda batches: emit(batches, lambda batch, row, n, ids: np.isin(ids, batch.column("wanted")[row : row + n].flatten().to_numpy()))), ddl)


def spans(rows: DataFrame) -> DataFrame:
    """(doc_id, digest, spans): each row's removed runs of window starts, as (at, n); equal rows' runs are the same, and one set."""
    return rows.groupBy(*ROW).agg(F.sort_array(F.collect_set(F.struct("at", "n"))).alias("spans"))


def with_spans(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` with ``_quillon_spans``."""
    gone = spans(rows).select(F.col("doc_id").alias("_quillon_id"), F.col("digest").alias("_quillon_digest"), F.col("spans").alias("_quillon_spans"))
    doc, digest = row_key()
    return docs.join(gone, (doc == F.col("_quillon_id")) & (digest == F.col("_quillon_digest")), "left").drop("_quillon_id", "_quillon_digest")


def covered(spans_: list, width: int, total: int) -> np.ndarray:
    """Which of ``total`` units a document's removed windows cover."""
    mask = np.zeros(total + 1, np.int32)
    if spans_:
        at = np.array([s["at"] for s in spans_])
        end = at + np.array([s["n"] for s in spans_]) + width - 1
        np.add.at(mask, at, 1)
        np.add.at(mask, np.minimum(end, total), -1)
    return np.cumsum(mask[:-1]) > 0
