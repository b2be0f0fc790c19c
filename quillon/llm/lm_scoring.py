"""Language-model scores by stupid backoff.

Words are runs without white space, A-Z lower-cased. A word's score is ``ln(c(w1..wn) / c(w1..wn-1))`` for the longest n-gram ending
there that the corpus holds, and ``ln(ALPHA)`` more for each word by which that is shorter than the longest one that the text
has there; single words score ``ln(c(w) / words)``. A document's score is the sum. Every n-gram counts, those that occur once too.

Texts are gathered in runs of about ``RUN`` words, which are stored as hashes of distinct words and each word's number among them. A run
sends each distinct n-gram of every length once, with how often its texts of the corpus have it, to the part that its hash's range
gives; the part adds up the counts of equal n-grams and answers each run with the counts of all it was sent, in the order sent. Ranges follow one another, so
a run's answers, part by part, are the counts of its n-grams in order; with them each word backs off within its run. One shuffle
goes to the parts and one comes back, for any share of words that back off. A frequent n-gram has a row a run at most, so no part is
larger for it. Parts hold at most about ``rows`` rows at any size of the input, and go in ``slices`` so that disk holds a share of the rows at a time,
as do the runs when their answers come back.

N-grams are known by 63-bit hashes.

Defined cases: a null text or one without words has no words and score 0, with a null mean; very long texts are taken whole; repeated
rows each count in the corpus, and each gets its score; rows with one doc_id are scored apart; null doc_ids
are scored like others; an empty table gives an empty result; other columns are ignored; words outside the corpus score as if
they had been seen once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from quillon.llm import kernels
from quillon.llm.shared import forget, store

ALPHA = 0.4
ROWS = 1_500_000  # rows of a part at most, on average
MANY = 2_000_000  # words from which rows go by slices
RUN = 1 << 18  # words, about, of texts that ask together


class Model:
    """Scores of ``docs`` by the counts of a corpus: another table, the rows of ``docs`` that a condition holds for, or (by default) all of them."""

    def __init__(self, docs: DataFrame, order: int = 3, slices: int = 3, hot: float | None = None, rows: int = ROWS, corpus: DataFrame | Column | None = None):
        """``hot`` has no effect: frequent n-grams need no care."""
        if order < 1:
            raise ValueError("an order of 1 or more is needed")
        self.order, self.slices, self.rows, self.spark = order, slices, rows, docs.sparkSession
        each = lambda df, counted, asked: df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(counted, F.lit(False)).alias("counted"), F.lit(asked).alias("asked"))
        if isinstance(corpus, DataFrame):
            self.texts = each(docs, F.lit(False), True).unionByName(each(corpus, F.lit(True), False))
        else:
            self.texts = each(docs, F.lit(True) if corpus is None else corpus, True)

    def scores(self) -> DataFrame:
        """(doc_id, n_words, log_score, mean_log_score) of every row of ``docs``."""
        runs = store(self.texts.mapInArrow(kernels.tidy(_gather), "run long, words long, counted long, data binary"), "runs")
        sent, total = runs.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("counted"), F.lit(0))).first()
        slices = self.slices if sent > MANY else 1
        parts = max(1, math.ceil(sent * self.order / slices / self.rows))
        at_once = max(parts, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        both, stored = runs.select("run", F.lit(-1).alias("part"), "data"), [runs]
        for number in range(slices):
            asked = runs.select("run", "data").mapInArrow(kernels.tidy(_dealer(self.order, number, slices, parts)), "part int, run long, data binary")
            counts = asked.repartition(at_once, "part").groupBy("part").applyInArrow(_part_counts, "run long, part int, data binary")
            if slices > 1:
                stored.append(counts := store(counts, "counts", alone=True))
            both = both.unionByName(counts)
        scores = lambda df: df.groupBy("run").applyInArrow(_scorer(self.order, total), "doc_id long, n_words long, t double")
        if slices > 1:
            share = F.pmod(F.xxhash64("run"), F.lit(slices))
            out = reduce(DataFrame.unionByName, [store(scores(both.filter(share == number)), "scores", alone=True) for number in range(slices)])
            for df in stored:
                forget(df)
        else:
            out = scores(both)
        return out.select("doc_id", "n_words", F.round("t", 4).alias("log_score"), F.round(F.col("t") / F.when(F.col("n_words") > 0, F.col("n_words")), 6).alias("mean_log_score"))


def _planes(a: np.ndarray) -> bytes:
    """An array's bytes, those of one weight together: zeros, and what numbers in order share, then need little room on disk."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""


def _array(data: bytes, kind: type, n: int, at: int = 0) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).reshape(n)


def _pack(*arrays: np.ndarray) -> bytes:
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(map(_planes, arrays))


def _unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    sizes = np.frombuffer(data, np.int64, len(kinds))
    out, at = [], 8 * len(kinds)
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(_array(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


class Run:
    """A run's texts: their doc_ids, what they are for, their sizes in words, and the words' hashes."""

    def __init__(self, data: bytes):
        self.ids, self.null, self.counted, self.asked, self.sizes, distinct, number = _unpack(data, np.int64, bool, bool, bool, np.int64, np.uint64, np.uint32)
        self.words = distinct[number]
        self.text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.place = np.arange(len(self.words)) - (np.cumsum(self.sizes) - self.sizes)[self.text]

    @staticmethod
    def packed(ids: np.ndarray, null: np.ndarray, counted: np.ndarray, asked: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> bytes:
        distinct, number = np.unique(words, return_inverse=True)
        return _pack(ids, null, counted, asked, sizes, distinct, number.astype(np.uint32))

    def grams(self, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """(keys, even, of the n-grams of each length up to ``order``, one length after the other; the places among the words where each length's end)."""
        ends = [np.flatnonzero(self.place >= n - 1) for n in range(1, order + 1)]
        key = np.concatenate([self.words, *[kernels.window_hashes(self.words, n)[ends[n - 1] - (n - 1)] for n in range(2, order + 1)]])
        key &= ~np.uint64(1)
        return key, ends


_RUNS = pa.schema([("run", pa.int64()), ("words", pa.int64()), ("counted", pa.int64()), ("data", pa.binary())])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as runs: (run, words, words of the corpus, data)."""
    base, number, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

    def run():
        ids, null, counted, asked, sizes, words = (np.concatenate(x) for x in zip(*held, strict=True))
        row = base + number, len(words), int(sizes[counted].sum()), Run.packed(ids, null, counted, asked, sizes, words)
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _RUNS, strict=True)], schema=_RUNS)

    for batch in batches:
        for row, data, offsets in kernels.chunks(batch.column("text")):
            lower = kernels.LOWER[data]
            starts, _, first = kernels.words(lower, offsets)
            rows = batch.slice(row, len(offsets) - 1)
            ids, flag = rows.column("doc_id"), lambda c, rows=rows: rows.column(c).to_numpy(zero_copy_only=False).astype(bool)
            held.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), flag("counted"), flag("asked"), np.diff(first).astype(np.int64), kernels.word_hashes(lower, starts)))
            size += len(starts) + len(rows)
            if size >= RUN:
                yield run()
                number, held, size = number + 1, [], 0
    if held:
        yield run()


_KINDS = np.int64, np.uint64, np.uint32  # of a block: whether the run waits for counts, n-grams, how often the run's part of the corpus has them
_ASKED = pa.schema([("part", pa.int32()), ("run", pa.int64()), ("data", pa.binary())])


def _dealer(order: int, number: int, slices: int, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (part, run, data): a run's distinct n-grams of one part of this slice, in order, and how often its texts of the corpus have each."""
    edges = [-(-(p << 63) // (parts * slices)) * 2 for p in range(number * parts, (number + 1) * parts + 1)]
    least, most, starts = np.uint64(edges[0]), np.uint64(edges[-1] - 1), np.array(edges[:-1], np.uint64)

    def emit(batches):
        for batch in batches:
            for me, data in zip(batch.column("run").to_pylist(), batch.column("data").to_pylist(), strict=True):
                run = Run(data)
                key, ends = run.grams(order)
                counted = run.counted.astype(np.uint64)[run.text]
                for n, end in enumerate(ends):  # the lowest bit tells which are the corpus's
                    at = sum(map(len, ends[:n]))
                    key[at : at + len(end)] |= counted[end]
                key = np.sort(key[(key >= least) & (key <= most)])
                new = np.flatnonzero(np.concatenate([[True], key[1:] ^ key[:-1] > np.uint64(1)])[: len(key)])
                c = np.add.reduceat(key & np.uint64(1), new).astype(np.uint32) if len(key) else np.zeros(0, np.uint32)
                distinct, asks = key[new] & ~np.uint64(1), np.array([run.asked.any()], np.int64)
                cut = np.append(np.searchsorted(distinct, starts), len(distinct))
                filled = np.flatnonzero(np.diff(cut))
                for lo in range(0, len(filled), 64):
                    some = filled[lo : lo + 64]
                    blocks = [_pack(asks, distinct[cut[p] : cut[p + 1]], c[cut[p] : cut[p + 1]]) for p in some]
                    yield pa.RecordBatch.from_arrays([pa.array(some + number * parts, pa.int32()), pa.array([me] * len(some), pa.int64()), pa.array(blocks, pa.binary())], schema=_ASKED)

    return emit


_COUNTS = pa.schema([("run", pa.int64()), ("part", pa.int32()), ("data", pa.binary())])


def _part_counts(group: pa.Table) -> pa.Table:
    """Rows (run, part, data): the counts in the whole corpus of the n-grams that each run has sent."""
    sent = [_unpack(b, *_KINDS) for b in group.column("data").to_pylist()]
    key, c = np.concatenate([k for _, k, _ in sent]), np.concatenate([c for _, _, c in sent])
    order = np.argsort(key)
    key = key[order]
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    total = np.empty(len(key), np.int64)
    total[order] = np.repeat(np.add.reduceat(c[order].astype(np.int64), cut), np.diff(np.append(cut, len(key))))
    runs, part, out, at = group.column("run").to_pylist(), group.column("part")[0].as_py(), [], 0
    total = total if total.max() >> 32 else total.astype(np.uint32)
    for me, (asks, k, _) in zip(runs, sent, strict=True):
        if asks[0]:
            out.append((me, part, bytes([total.itemsize]) + _planes(total[at : at + len(k)])))
        at += len(k)
    del sent, key, c, order, total
    kernels.release()
    return pa.table([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_COUNTS)], schema=_COUNTS)


def _counts_of(data: bytes) -> np.ndarray:
    return _array(data, np.int64 if data[0] == 8 else np.uint32, len(data) // data[0], 1)


_SCORES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("t", pa.float64())])


def _scorer(order: int, total: int) -> Callable[[pa.Table], pa.Table]:
    """The scores of a run's texts by the counts of its n-grams."""

    def scores(group: pa.Table) -> pa.Table:
        parts, data = group.column("part").to_pylist(), group.column("data").to_pylist()
        by = sorted(range(len(parts)), key=parts.__getitem__)
        data = [data[i] for i in by]
        run = Run(data[0])
        if not run.asked.any():
            return _SCORES.empty_table()
        key, ends = run.grams(order)
        by_key = np.argsort(key)
        key = key[by_key]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        times, counts = np.diff(np.append(new, len(key))), np.empty(len(key), np.int64)
        del key
        counts[by_key] = np.repeat(np.concatenate([np.zeros(0, np.int64), *[_counts_of(b) for b in data[1:]]]), times)
        del by_key, times, new, data
        c = np.zeros((order, len(run.words)), np.int64)  # of the n-gram that ends at a word
        for n, end in enumerate(ends):
            c[n, end], counts = counts[: len(end)], counts[len(end) :]
        score, left, top = np.zeros(len(run.words)), np.ones(len(run.words), bool), np.minimum(run.place + 1, order)
        for n in range(order, 0, -1):
            at = np.flatnonzero(left & (c[n - 1] > 0)) if n > 1 else np.flatnonzero(left)
            share = c[n - 1, at] / c[n - 2, at - 1] if n > 1 else np.maximum(c[0, at], 1) / max(total, 1)
            score[at] = np.log(share) + (top[at] - n) * math.log(ALPHA)
            left[at] = False
        sums = np.bincount(run.text, weights=score, minlength=len(run.sizes))
        del c, counts, score, left, top
        kernels.release()
        return pa.table([pa.array(run.ids, mask=run.null), pa.array(run.sizes), pa.array(sums)], schema=_SCORES).filter(pa.array(run.asked))

    return scores


def scored(docs: DataFrame, corpus: DataFrame | Column | None = None, order: int = 3) -> DataFrame:
    """Scores of ``docs`` by the counts of ``corpus`` (a table, or a condition on ``docs``), or by their own."""
    return Model(docs, order, corpus=corpus).scores()
