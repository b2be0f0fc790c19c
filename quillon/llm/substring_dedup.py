"""Substring deduplication over windows of words, with a count-min prefilter.

A window is ``width`` consecutive words of one document. A word goes when a window that covers it also starts in a document
with a smaller doc_id; windows are judged on the input. A merged sketch overestimates how often windows occur
(see ``repeats``); a second pass groups exactly those estimated to repeat: whole segments by their hashes first, then the
single windows of segments that share an anchor but differ.

Defined cases: a null text has no words; documents of fewer words than a window keep all; very long texts are taken whole; rows of
the same doc_id don't take from each other, each is judged by its own text; null doc_ids are smaller than none, so their rows keep all
words and take none; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillon.llm import kernels
from quillon.llm.repeats import ROW, Repeats, covered, with_spans
from quillon.llm.shared import store

GRAM = 8


def removed_windows(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, digest, at, n): runs of windows that also start in a document with a smaller doc_id."""
    repeats = Repeats(docs.filter(F.col("doc_id").isNotNull()), width, min(GRAM, width), True)
    segments = repeats.candidates()
    grouped = repeats.grouped(segments)  # ``last`` and ``lead`` have the largest and the smallest doc_id
    keys = ["anchor", "s1", "s2"]
    later = segments.join(grouped.filter("last > lead.doc_id").select(*keys, F.col("lead.doc_id").alias("first")), keys).filter("doc_id > first").select(*ROW, "at", "n")
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("at", pa.int32())])

    def windows(ids, digests, local, at, n, anchor, data, offsets, units):
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(at, n) + step
        h1, h2 = repeats.contents(data, units, place, place + width)
        yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(np.repeat(ids, n)), pa.array(np.repeat(digests, n)), pa.array((np.repeat(local, n) + step).astype(np.int32))], schema=schema)

    single = store(repeats.unsettled(grouped, windows, "h1 long, h2 long, doc_id long, digest long, at int", True), "windows")
    least = store(single.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("last > first").drop("last"), "least")
    ones = single.join(least, ["h1", "h2"]).filter("doc_id > first").select(*ROW, "at", F.lit(1).alias("n"))
    return later.unionByName(ones)


def dedup(docs: DataFrame, width: int = 50) -> DataFrame:
    """``docs`` with ``kept`` (the kept words, joined by one space), ``n_words`` and ``n_removed``, in place of columns of these names."""
    joined = with_spans(docs, removed_windows(docs, width))

    @F.arrow_udf("struct<kept:string,n_words:bigint,n_removed:bigint>")
    def keep(texts: pa.Array, spans_: pa.Array) -> pa.Array:
        kept, total, removed = [], [], []
        for text, runs in zip(texts.cast(pa.binary()), spans_, strict=True):
            words = (text.as_py() or b"").split()
            total.append(len(words))
            if runs.is_valid:
                mask = covered(runs.as_py(), width, len(words))
                removed.append(int(mask.sum()))
                words = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
            else:
                removed.append(0)
            kept.append(b" ".join(words).decode())
        kernels.trim()
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], ["kept", "n_words", "n_removed"])

    out = joined.withColumn("_quillon_kept", keep(F.col("text"), F.col("_quillon_spans")))
    return out.withColumns({c: F.col(f"_quillon_kept.{c}") for c in ("kept", "n_words", "n_removed")}).drop("_quillon_kept", "_quillon_spans")
