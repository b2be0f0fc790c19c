"""N-gram Jaccard join by prefix trees.

A document's set is its distinct ``n``-word shingles, in one global order: by how frequent a merged sketch of all documents
says they are (rarest first, in steps of two), then by hash. Sets as alike as asked share a shingle among their first
few in this order, so documents meet by those prefixes, as runs of one key. Documents with equal sets are one class and meet
others once; what moves are classes.

Where documents meet, their sets are stored in one trie by the global order, and all of them walk it together: at a node the
overlap of its shingles with each probe still alive is found once for all sets below, and a probe leaves a subtree when its overlap so far
and the shortest remainder can't reach what the sets there need. What is linked is decided on whole sets, in integers.

Two rounds find the components. In the first a run is held against one centre, the document with the key earliest in its order (the
one with the fewest rare shingles, so the least edited of near copies). In the second, documents with one centre, which are all that
met, are met in full where they are of several components, but for pairs that are refuted: a parity bitmap of a set has some bits for
each shingle, and the bits in which two differ are never more than the shingles in which the sets do. Only memberships of runs and
blocks are rows, no pairs; large blocks are split.

Defined cases: null doc_ids are compared like others, but are never a component's id (which is null where no row of it has one); a
null text or one without words has an empty set and links with nothing (its component is its own); with fewer than ``n`` words the whole
sequence is the one shingle; very long texts are taken whole; equal rows are equal sets; rows that share a doc_id are nodes of their own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillon.llm import kernels
from quillon.llm.components import components, id_filter, merged, passes
from quillon.llm.repeats import row_key
from quillon.llm.shared import forget, store

COUNTERS = 1 << 22
BLOCK = 1 << 21  # shingles of the sets that go into one trie
MEMBERS = 1 << 12  # bitmaps that are held against each other at once
STEP = 32  # shingles of a node that are overlapped between looks at the bounds
FLAGS = 1 << 29  # bits of the bitmap of wanted rows at most; a fuller one lets more through


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text of each) of the distinct shingles of each text, 58 bits, sorted by text and hash."""
    starts, ends, first = kernels.words(kernels.LOWER[data], offsets)
    values = kernels.word_hashes(kernels.LOWER[data], starts)
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    grams = kernels.window_hashes(values, n)
    if len(grams):
        inside = text[: len(grams)] == text[n - 1 :]
        grams, owner = grams[inside], text[: len(inside)][inside]
    else:
        owner = np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):  # the whole sequence, told from a shingle by its length
        whole = np.array([kernels.window_hashes(values[first[i] : first[i + 1]], int(counts[i]))[0] for i in short], np.uint64)
        grams = np.concatenate([grams, kernels.mix(whole ^ np.uint64(0x5851F42D4C957F2D) * counts[short].astype(np.uint64))])
        owner = np.concatenate([owner, short])
    grams = grams >> np.uint64(6)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    if len(grams):
        keep = np.ones(len(grams), bool)
        keep[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        grams, owner = grams[keep], owner[keep]
    return grams, owner


def _counter(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(7)).astype(np.int64) & (COUNTERS - 1)


def frequency_levels(docs: DataFrame, n: int) -> np.ndarray:
    """For each counter, how far above the usual its documents are, in powers of two; 0 for most."""

    def part(batches) -> np.ndarray:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, data, offsets in kernels.chunks(batch.column("text")):
                counts += np.bincount(_counter(shingle_sets(data, offsets, n)[0]), minlength=COUNTERS)
        return counts.astype(np.uint32)

    counts = merged(docs.select("text"), part, COUNTERS)
    usual = float(np.median(counts))  # most counters hold rare shingles alone, as many as chance deals them
    above = np.maximum(counts - usual, 1) / (8 + 4 * usual**0.5)
    return np.maximum(0, np.floor(np.log2(above)) + 1).astype(np.uint8)


def ordered_sets(texts: pa.Array, levels: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, keys end to end, bounds) of runs of rows: the ordered set of each row."""
    for at, data, offsets in kernels.chunks(texts):
        grams, owner = shingle_sets(data, offsets, n)
        keys = grams | (levels[_counter(grams)].astype(np.uint64) << np.uint64(58))
        yield at, keys[np.lexsort((keys, owner))], np.searchsorted(owner, np.arange(len(offsets)))


def needed(a, b, percent: int):
    """The smallest intersection with which sets of sizes a and b are linked: 100 * i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 8 << 20, limit: int = 20_000):
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes)) + 32
        if size > most or len(held) >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


class Node:
    """A prefix-tree node: a run of shingles, the sets that end with it, and what lies below."""

    __slots__ = ("run", "ends", "kids", "least", "most")

    def __init__(self, run: np.ndarray):
        self.run, self.ends, self.kids, self.least, self.most = run, [], {}, 1 << 62, 0


def tree(sets: list[tuple[int, np.ndarray]]) -> Node:
    """A path-compressed prefix tree of ordered sets."""
    root = Node(np.zeros(0, np.uint64))
    for name, keys in sets:
        node, at, n = root, 0, len(keys)
        root.least, root.most = min(root.least, n), max(root.most, n)
        while at < n:
            kid = node.kids.get(int(keys[at]))
            if kid is None:
                kid = node.kids[int(keys[at])] = Node(keys[at:])
                kid.least = kid.most = n
                node, at = kid, n
                break
            same = min(len(kid.run), n - at)
            differ = np.flatnonzero(kid.run[:same] != keys[at : at + same])
            stop = int(differ[0]) if len(differ) else same
            if stop < len(kid.run):  # split the run
                upper = Node(kid.run[:stop])
                upper.least, upper.most = kid.least, kid.most
                upper.kids[int(kid.run[stop])] = kid
                node.kids[int(keys[at])] = upper
                kid.run = kid.run[stop:]
                kid = upper
            kid.least, kid.most = min(kid.least, n), max(kid.most, n)
            node, at = kid, at + stop
        node.ends.append((name, n))
    return root


def matches(root: Node, probe: np.ndarray, percent: int) -> Iterator[int]:
    """Names of the sets in the trie that are linked with ``probe``."""
    stack = [(root, 0, 0, 0)]  # node, overlap so far, shingles so far, place in the probe
    size = len(probe)
    while stack:
        node, overlap, depth, place = stack.pop()
        if len(node.run):
            spots = np.searchsorted(probe, node.run)
            overlap += int(np.count_nonzero(probe[np.minimum(spots, size - 1)] == node.run))
            depth += len(node.run)
            place = int(np.searchsorted(probe, node.run[-1], "right"))
        for name, n in node.ends:
            if overlap >= needed(size, n, percent):
                yield name
        for kid in node.kids.values():
            if overlap + min(size - place, kid.most - depth) >= needed(size, kid.least, percent):
                stack.append((kid, overlap, depth, place))


def self_join(sets: list[np.ndarray], ties: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Linked pairs of places in ``sets`` with different ties, by one walk of all sets over one trie of them."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    by = np.argsort(flat, kind="stable")
    tokens, first = np.unique(flat[by], return_index=True)
    first = np.append(first, len(flat))
    owner, place = owner[by], place[by]
    at_place = np.zeros(len(sets), np.int64)

    def walked(node, alive, overlap, at, depth):
        """(probes alive, their overlap so far and place in themselves, shingles so far) behind the node's own shingles."""
        for lo in range(0, len(node.run), STEP):
            run = node.run[lo : lo + STEP]
            where = np.searchsorted(tokens, run)
            spots = np.concatenate([np.arange(first[w], first[w + 1]) for w in where])
            overlap = overlap + np.bincount(owner[spots], minlength=len(sets))[alive]
            at_place[alive] = at
            np.maximum.at(at_place, owner[spots], place[spots] + 1)
            at = at_place[alive]
            depth += len(run)
            live = overlap + np.minimum(sizes[alive] - at, node.most - depth) >= needed(sizes[alive], node.least, percent)
            if not live.all():
                alive, overlap, at = alive[live], overlap[live], at[live]
                if not len(alive):
                    break
        return alive, overlap, at, depth

    root = tree(list(enumerate(sets)))
    none = np.zeros(len(sets), np.int64)
    path = [(iter(root.kids.values()), np.arange(len(sets)), none, none, 0)]  # one branch at a time, so the arrays are a path's
    while path:
        kids, alive, overlap, at, depth = path[-1]
        node = next(kids, None)
        if node is None:
            path.pop()
            continue
        live = overlap + np.minimum(sizes[alive] - at, node.most - depth) >= needed(sizes[alive], node.least, percent)
        if not node.kids:  # a leaf: those of its own tie need not go on
            live &= np.isin(ties[alive], ties[[name for name, _ in node.ends]], invert=True) if len(node.ends) == 1 else True
        if not live.any():
            continue
        alive, overlap, at, depth = walked(node, alive[live], overlap[live], at[live], depth)
        if not len(alive):
            continue
        for name, n in node.ends:
            for other in alive[(overlap >= needed(sizes[alive], n, percent)) & (alive < name) & (ties[alive] != ties[name])]:
                yield int(other), name
        if node.kids:
            path.append((iter(node.kids.values()), alive, overlap, at, depth))


def parity(keys: np.ndarray) -> bytes:
    """A bit for each of 64 or more buckets, four to eight for each key: whether an odd number of keys falls into it."""
    bits = 1 << min(max(6, (4 * len(keys) - 1).bit_length()), 17)
    odd = np.bincount((kernels.mix(keys) >> np.uint64(40)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(words: np.ndarray, size: int) -> np.ndarray:
    """A parity bitmap of fewer buckets (a power of two)."""
    while len(words) > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def partners(size: np.ndarray, tie: np.ndarray, bits: list[bytes], percent: int) -> np.ndarray:
    """Which sets may be linked with one of another tie, as far as sizes and bitmaps tell."""
    out = np.zeros(len(size), bool)
    order = np.argsort(size, kind="stable")
    size, tie = size[order], tie[order]
    words = np.array([len(bits[k]) // 8 for k in order])
    # by number of words: the bitmaps that have it, and those of twice as many, folded; sets that can be linked differ by no more
    tables = {}
    for w in np.unique(words).tolist():
        mine, more = np.flatnonzero(words == w), np.flatnonzero(words == 2 * w)
        of = lambda which: np.stack([np.frombuffer(bits[order[k]], np.uint64) for k in which]) if len(which) else np.zeros((0, w), np.uint64)  # noqa: B023, E731
        double = of(more)
        tables[w] = (mine, of(mine), more, double[:, :w] ^ double[:, w:] if len(more) else double)
    for i in range(len(size) - 1):
        mine, table, more, folded = tables[int(words[i])]
        own = int(np.searchsorted(mine, i))
        for which, rows in ((mine[own + 1 :], table[own + 1 :]), (more, folded)):
            last = int(np.searchsorted(size[which], size[i] * 100 // percent, "right")) if len(which) else 0
            here = np.flatnonzero(tie[which[:last]] != tie[i])
            if not len(here):
                continue
            apart = size[i] + size[which[here]] - 2 * needed(size[i], size[which[here]], percent)
            close = here[np.bitwise_count(rows[here] ^ table[own]).sum(1, dtype=np.int64) <= apart]
            if len(close):
                out[order[i]] = True
                out[order[which[close]]] = True
    return out


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal keys."""
    differ = np.zeros(max(0, len(keys[0]) - 1), bool)
    for k in keys:
        differ |= k[1:] != k[:-1]
    return np.concatenate([[0], np.flatnonzero(differ) + 1, [len(keys[0])]])


def _whole_runs(batches: Iterator[pa.RecordBatch], columns: list[str], most: int = 1 << 40) -> Iterator[pa.Table]:
    """Tables of whole runs of equal ``columns``, which are in order; a run beyond ``most`` rows comes in pieces."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if not len(held):
            continue
        cut = int(_runs(*(held.column(c).to_numpy() for c in columns))[-2])
        if not cut and len(held) >= most:
            cut = len(held)
        if cut:
            yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut)
    if held is not None and len(held):
        yield held.combine_chunks()


class Join:
    def __init__(self, docs: DataFrame, n: int = 5, percent: int = 80):
        row, digest = row_key()
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), digest.alias("digest"), "text")
        self.n, self.percent, self.spark = n, percent, docs.sparkSession
        self.levels = self.spark.sparkContext.broadcast(frequency_levels(self.docs, n))

    def prefixes(self) -> DataFrame:
        """(doc_id, row, digest, size, d1, d2, prefix): the digest of each row's set and its first shingles, packed."""
        n, percent, levels = self.n, self.percent, self.levels

        def emit(batches):
            for batch in batches:
                for at, keys, bounds in ordered_sets(batch.column("text"), levels.value, n):
                    size = np.diff(bounds)
                    full = np.flatnonzero(size)
                    digests = []
                    for c in (0x1234567, 0x89ABCDEF01234567):
                        d = np.zeros(len(size), np.uint64)
                        if len(full):
                            d[full] = np.add.reduceat(kernels.mix(keys ^ np.uint64(c)), bounds[:-1][full])
                        digests.append(pa.array(d.view(np.int64)))
                    # equal sizes need the most, so a set half as long again needs no more of its prefix
                    reach = bounds[:-1] + np.where(size > 0, size - -(-percent * size // 100) + 1, 0)
                    data = keys.tobytes()
                    parts = [data[8 * a : 8 * b] for a, b in zip(bounds[:-1].tolist(), reach.tolist(), strict=True)]
                    for lo in range(0, len(size), 2_000):
                        s = slice(lo, lo + 2_000)
                        rows = batch.slice(at + lo, len(size[s]))
                        yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in ("doc_id", "row", "digest")], pa.array(size[s]), *[d[s] for d in digests], pa.array(parts[s], pa.binary())], ["doc_id", "row", "digest", "size", "d1", "d2", "prefix"])

        return self.docs.mapInArrow(kernels.tidy(emit), "doc_id long, row long, digest long, size long, d1 long, d2 long, prefix binary")

    def sets(self, classes: DataFrame, form) -> DataFrame:
        """(node, keys): ``form`` of the whole sets of ``classes`` (node, row, digest)."""
        classes = store(classes, "wanted")
        name = lambda row, digest: kernels.mix(row.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ digest.view(np.uint64)).view(np.int64)
        names = classes.select("row", "digest").mapInArrow(kernels.tidy(lambda batches: (pa.RecordBatch.from_arrays([pa.array(name(b.column(0).to_numpy(), b.column(1).to_numpy()))], ["id"]) for b in batches)), "id long")
        flags = self.spark.sparkContext.broadcast(id_filter(names, 1 << max(20, min(FLAGS, classes.count() * 16).bit_length())))
        n, levels = self.n, self.levels
        schema = pa.schema([("row", pa.int64()), ("digest", pa.int64()), ("keys", pa.binary())])

        def rows(batches):
            for batch in batches:
                batch = batch.filter(pa.array(passes(flags.value, name(batch.column("row").to_numpy(), batch.column("digest").to_numpy()))))
                ids, digests = batch.column("row").to_pylist(), batch.column("digest").to_pylist()
                for at, keys, bounds in ordered_sets(batch.column("text"), levels.value, n):
                    for i in range(len(bounds) - 1):
                        yield ids[at + i], digests[at + i], form(keys[bounds[i] : bounds[i + 1]])

        found = self.docs.select("row", "digest", "text").mapInArrow(kernels.tidy(lambda b: _batches(rows(b), schema)), "row long, digest long, keys binary")
        return found.join(classes, ["row", "digest"]).select("node", "keys").dropDuplicates(["node"])

    def runs(self, heads: DataFrame) -> DataFrame:
        """(centre, node, near): the classes that have a key in their prefixes, where there are several, with the run's centre (itself
        included); ``near`` where the two may be linked."""
        percent = self.percent
        entry = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("pos", pa.int32())])

        def entries(batches):
            for batch in batches:
                sizes, nodes = (batch.column(c).to_numpy() for c in ("size", "node"))
                for lo in range(0, len(nodes), 500):
                    prefixes = [np.frombuffer(p.as_py(), np.int64) for p in batch.column("prefix")[lo : lo + 500]]
                    n = np.array([len(p) for p in prefixes])
                    s = slice(lo, lo + 500)
                    pos = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((np.concatenate(prefixes), np.repeat(nodes[s], n), np.repeat(sizes[s], n).astype(np.int32), pos.astype(np.int32)), entry, strict=True)], schema=entry)

        def emit(batches):
            held = None  # key, centre, its size and place of the run that the last piece ended with
            for table in _whole_runs(batches, ["key"], 1 << 20):
                key, node, size, pos = (table.column(c).to_numpy() for c in entry.names)
                order = np.lexsort((kernels.mix(node.view(np.uint64)), pos, key))
                key, node, size, pos = key[order], node[order], size[order].astype(np.int64), pos[order].astype(np.int64)
                bounds = _runs(key)
                n = np.diff(bounds)
                first = bounds[:-1]
                lead, most, place = node[first], size[first], pos[first]
                several = n > 1
                if held is not None and held[0] == key[0]:
                    lead[0], most[0], place[0], several[0] = *held[1:], True
                held = key[-1], lead[-1], most[-1], place[-1]
                centre, b, q = np.repeat(lead, n), np.repeat(most, n), np.repeat(place, n)
                near = (1 + np.minimum(pos, q) + np.minimum(size - pos - 1, b - q - 1) >= needed(size, b, percent)) & (node != centre)
                keep = np.repeat(several, n)
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (centre, node, near)], ["centre", "node", "near"])

        rows = heads.mapInArrow(kernels.tidy(entries), "key long, node long, size int, pos int").repartition("key").sortWithinPartitions("key")
        return rows.mapInArrow(kernels.tidy(emit), "centre long, node long, near boolean").groupBy("centre", "node").agg(F.max("near").alias("near"))

    @staticmethod
    def dealt(blocks: DataFrame, load: str, most: int, in_full: bool) -> DataFrame:
        """``blocks`` (block, node, ...) with ``part``: parts of at most about ``most`` of ``load``, in which each two members
        meet, or each meets the node that the block is named after."""
        cuts = blocks.groupBy("block").agg(F.ceil(F.sum(F.expr(load)) / most).alias("cuts"))
        own = F.pmod(F.xxhash64("node"), F.col("cuts"))
        every = F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)
        if in_full:  # each two cuts meet
            parts = F.transform(every, lambda i: F.least(own, i) * F.col("cuts") + F.greatest(own, i))
        else:
            parts = F.when(F.col("node") == F.col("block"), every).otherwise(F.array(own))
        return blocks.join(cuts, "block").withColumn("part", F.explode(parts)).drop("cuts")

    def linked(self, blocks: DataFrame, classes: DataFrame, in_full: bool) -> DataFrame:
        """(a, b): links within blocks (block, node, tie), of the node that a block is named after or of all with different ties."""
        percent = self.percent
        blocks = store(blocks.join(classes.select("node", "size"), "node"), "blocks")
        nodes = blocks.select("node").distinct().join(classes.select("node", "row", "digest"), "node")
        sets = self.sets(nodes, lambda keys: keys.tobytes())
        rows = self.dealt(blocks, "size", BLOCK, in_full).join(sets, "node").select("block", "part", "node", "tie", "keys").repartition("block", "part").sortWithinPartitions("block", "part", "node")
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def links(block, nodes, ties, sets):
            ties = np.array(ties)
            if not in_full:
                centre = nodes.index(block)
                yield from ((block, nodes[i]) for i in matches(tree([(i, s) for i, s in enumerate(sets) if i != centre]), sets[centre], percent))
                return
            for a, b in self_join(sets, ties, percent):
                yield nodes[a], nodes[b]

        def emit(batches):
            def found():
                where, held = None, ([], [], [])
                for batch in batches:
                    for block, part, node, tie, keys in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                        if where != (block, part):
                            if where is not None:
                                yield from links(where[0], *held)
                            where, held = (block, part), ([], [], [])
                        for column, value in zip(held, (node, tie, np.frombuffer(keys, np.uint64)), strict=True):
                            column.append(value)
                if where is not None:
                    yield from links(where[0], *held)

            yield from _batches(found(), schema)

        out = store(rows.mapInArrow(kernels.tidy(emit), "a long, b long").distinct(), "links")
        forget(blocks)
        return out

    def unrefuted(self, blocks: DataFrame, bitmaps: DataFrame, in_full: bool) -> DataFrame:
        """(block, node, tie): those of ``blocks`` (block, node, tie, size) that may be linked, as far as sizes and bitmaps tell, with one
        of another tie, or with the node that the block is named after (which stays)."""
        percent = self.percent
        rows = self.dealt(blocks, "1", MEMBERS, in_full).join(bitmaps, "node").select("block", "part", "node", "size", "tie", "bits")
        rows = rows.repartition("block", "part").sortWithinPartitions("block", "part", "node")

        def kept(block, node, size, tie, bits) -> np.ndarray:
            if in_full:
                return partners(size, tie, bits, percent)
            out = np.zeros(len(node), bool)
            centre = int(np.flatnonzero(node == block)[0])
            mine = np.frombuffer(bits[centre], np.uint64)
            for i in range(len(node)):
                theirs = np.frombuffer(bits[i], np.uint64)
                least = min(len(mine), len(theirs))
                apart = int(np.bitwise_count(_folded(mine, least) ^ _folded(theirs, least)).sum())
                out[i] = apart <= size[i] + size[centre] - 2 * needed(int(size[i]), int(size[centre]), percent)
            return out

        def emit(batches):
            for table in _whole_runs(batches, ["block", "part"]):
                block, node, size, tie = (table.column(c).to_numpy() for c in ("block", "node", "size", "tie"))
                bounds, bits = _runs(block, table.column("part").to_numpy()), table.column("bits").to_pylist()
                keep = np.zeros(len(block), bool)
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    keep[a:b] = kept(block[a], node[a:b], size[a:b], tie[a:b], bits[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (block, node, tie)], ["block", "node", "tie"])

        return rows.mapInArrow(kernels.tidy(emit), "block long, node long, tie long").distinct()

    @staticmethod
    def several(blocks: DataFrame) -> DataFrame:
        """``blocks`` in which more than one tie is left."""
        found = blocks.groupBy("block").agg(F.min("tie").alias("x"), F.max("tie").alias("y")).filter("x < y").select("block")
        return blocks.join(found, "block", "left_semi")

    def run(self) -> DataFrame:
        """(doc_id, row, digest, n_shingles, component, component_id) of every row: ``component`` numbers the components of rows
        that have a set, and is null for others."""
        every = store(self.prefixes(), "prefixes")
        same = ["size", "d1", "d2"]
        grouped = every.filter("size > 0").groupBy(*same).agg(F.min("doc_id").alias("least"), F.min(F.struct("row", "digest", "prefix")).alias("rep"))
        classes = store(grouped.select(*same, "least", "rep.*", F.monotonically_increasing_id().alias("node")), "classes")
        runs_ = store(self.runs(classes.select("node", "size", "prefix")), "runs")
        runs = runs_.join(classes.select("node", "size"), "node")
        nodes = runs.select("node").distinct().join(classes.select("node", "row", "digest"), "node")
        bitmaps = store(self.sets(nodes, parity).withColumnRenamed("keys", "bits"), "bitmaps")
        stars = runs.filter("near or node = centre").select(F.col("centre").alias("block"), "node", F.col("node").alias("tie"), "size")
        stars = self.several(store(self.unrefuted(self.several(stars), bitmaps, False), "stars"))
        links = self.linked(stars, classes, False)
        found = store(components(links), "found")
        tied = runs.join(found.withColumnRenamed("component", "tie"), "node", "left")
        tied = store(tied.select(F.col("centre").alias("block"), "node", F.coalesce("tie", "node").alias("tie"), "size"), "tied")
        left = self.several(store(self.unrefuted(self.several(tied), bitmaps, True), "left"))
        more = self.linked(left, classes, True)
        for done in (runs_, bitmaps, tied):
            forget(done)
        found = components(links.unionByName(more))
        tied = store(classes.select(*same, "least", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "tied")
        least = tied.groupBy("component").agg(F.min("least").alias("component_id"))
        named = tied.join(least, "component").select(*same, "component", "component_id")
        full = every.filter("size > 0").select("doc_id", "row", "digest", *same).join(named, same)
        empty = every.filter("size = 0").withColumns({"component_id": F.col("doc_id"), "component": F.lit(None).cast("long")})
        columns = ["doc_id", "row", "digest", F.col("size").alias("n_shingles"), "component", "component_id"]
        return full.select(columns).unionByName(empty.select(columns))


def join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents tied by Jaccard similarity of ``percent`` hundredths or more."""
    return Join(docs, n, percent).run().select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id, of these the one with the smallest digest of its text,
    and of equal ones the least by the other columns. Rows without words stay."""
    found = store(Join(docs, n, percent).run(), "labels")
    order = F.struct(F.col("doc_id").isNull().alias("_null"), "row", "digest")
    firsts = found.filter("component is not null").groupBy("component").agg(F.min(order).alias("_first"))
    keep = firsts.select("_first.row", "_first.digest").unionByName(found.filter("component is null").select("row", "digest").distinct())
    keep = keep.select(F.col("row").alias("_quillon_row"), F.col("digest").alias("_quillon_digest"))
    # rows equal in doc_id and text: a short list, by which alone whole rows are grouped
    twice = store(found.filter("component is not null").groupBy(F.col("row").alias("_quillon_row"), F.col("digest").alias("_quillon_digest")).count().filter("count > 1").drop("count"), "twice")
    row, digest = row_key()
    keys = ["_quillon_row", "_quillon_digest"]
    rows = docs.withColumns({"_quillon_row": row, "_quillon_digest": digest}).join(keep, keys, "left_semi")
    equal = rows.join(twice, keys, "left_semi").groupBy(*keys).agg(F.min(F.struct(*docs.columns)).alias("_quillon_one")).select("_quillon_one.*")
    return rows.join(twice, keys, "left_anti").select(docs.columns).unionByName(equal)
