"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

The vocabulary is read from a SentencePiece model file on the driver (its path is a parameter); the trie, the scores
and the piece table travel to the executors in one broadcast of a size that the vocabulary sets.

Encoding puts the whitespace marker U+2581 for each space and before the text, cuts the text where no piece can span
(before a run of markers, and around line ends when no piece holds one), and finds for each distinct part the pieces
with the highest sum of log scores; of equal sums, the one with the longer last piece. Parts are solved together, one array
step per byte; a bounded cache keeps what was solved. Characters outside the vocabulary, and the marker itself where the text
holds it, become byte pieces. Decoding joins the pieces, reads byte pieces as UTF-8 and turns markers into spaces, so that every text comes back
exactly.

Model files of merge-rank vocabularies hold minus the rank where a unigram model holds a log probability; ``log_ranks``
turns rank r into ``-ln(r + 2)``, as frequencies that fall with the rank do.

Defined cases: null encodes to null and decodes from null; the empty text has no pieces; ids outside the vocabulary,
control pieces and null ids decode to nothing; bytes that aren't UTF-8 decode to U+FFFD; very long parts are solved with a
bounded window; repeated rows are encoded alike; an empty table gives an empty result; other columns stay as they are, but
``ids``, ``n_tokens``, ``n_byte_tokens`` and ``decoded`` of the input are replaced.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillon.llm import kernels

MARK = "▁"
NORMAL, CONTROL, USER, UNUSED, BYTE = 1, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
CACHE_PARTS = 200_000
PARTS_AT_ONCE = 200_000
LONG_PART = 64  # bytes; longer parts are solved one at a time


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, data[at : at + n]
        at += n


def read_model(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id."""
    with open(path, "rb") as file:
        data = file.read()
    out = []
    for field, value in _fields(data):
        if field == 1:
            piece = dict(_fields(value))
            out.append((piece.get(1, b"").decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
    return out


class DoubleArray:
    """A trie over byte strings in two arrays: the child of node n by byte b is ``t = base[n] + b``, where ``check[t] == n``."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for key, value in keys.items():
            node = 0
            for b in key:
                step = children[node].get(b)
                if step is None:
                    step = children[node][b] = len(children)
                    children.append({})
                    ends.append(-1)
                node = step
            ends[node] = value
        size = len(children) * 2 + 1024
        self.base, self.check, self.value = (np.full(size, fill, np.int32) for fill in (0, -1, -1))
        self.check[0] = 0  # the root; no child may land on it
        used = bytearray(size)
        used[0] = 1
        place, free, tail, queue = [0] * len(children), 256, 256, [0]  # from 256 on, any first byte has a base
        for node in queue:
            kids = children[node]
            self.value[place[node]] = ends[node]
            if not kids:
                continue
            bytes_ = sorted(kids)
            while used[free]:
                free += 1
            at = free if len(bytes_) == 1 else max(free, tail)
            while True:
                base = at - bytes_[0]
                if base + 256 >= len(used):
                    grow = len(used)
                    used.extend(bytes(grow))
                    self.base, self.check, self.value = (np.concatenate([a, np.full(grow, fill, np.int32)]) for a, fill in ((self.base, 0), (self.check, -1), (self.value, -1)))
                if not any(used[base + b] for b in bytes_):
                    break
                at += 1
            if len(bytes_) > 1:
                tail = max(tail, at - 64)  # wider nodes don't search the full slots again
            self.base[place[node]] = base
            for b in bytes_:
                used[base + b] = 1
                self.check[base + b] = place[node]
                place[kids[b]] = base + b
                queue.append(kids[b])
        top = max(place) + 257
        self.base, self.check, self.value = self.base[:top].copy(), self.check[:top].copy(), self.value[:top].copy()


class Unigram:
    """A vocabulary with its trie, as broadcast to the executors."""

    def __init__(self, path: str, log_ranks: bool = True):
        pieces = read_model(path)
        score = np.array([-np.log(max(0.0, -s) + 2) if log_ranks else s for _, s, _ in pieces])
        whole = [i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER) and p]
        self.trie = DoubleArray({pieces[i][0].encode(): i for i in whole})
        self.score = score
        self.unknown = float(min(score[i] for i in whole) - UNKNOWN_PENALTY)
        self.byte_id = np.full(256, -1, np.int32)
        table = [b""] * len(pieces)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_id[int(p[1:-1], 16)] = i
                table[i] = bytes([int(p[1:-1], 16)])
            elif kind in (NORMAL, USER):
                table[i] = p.replace(MARK, " ").encode()
        if (self.byte_id < 0).any():
            raise ValueError("the vocabulary has no byte fallback")
        self.longest = max(len(pieces[i][0].encode()) for i in whole)
        self.piece_size = np.array([len(t) for t in table], np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_size)])
        self.piece_data = np.frombuffer(b"".join(table), np.uint8)
        inner = any(MARK in pieces[i][0].lstrip(MARK) for i in whole)
        breaks = "".join(c for c in "\n\t\r" if not any(c in pieces[i][0] for i in whole))
        own = re.escape(breaks)
        # a literal marker stands apart, as a part of its own; a text's spaces become markers in ``_solve``
        self.parts = None if inner else re.compile(f" *[^ {own}{MARK}]+| +|[{own}{MARK}]" if own else f" *[^ {MARK}]+| +|{MARK}")
        self._forget()

    def _forget(self) -> None:
        """Empty the cache of solved parts: place by part, and ids end to end."""
        self._index: dict[str, int] = {}
        self._pool, self._sizes, self._starts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __getstate__(self):
        none = {"_index": {}, "_pool": np.zeros(0, np.int32), "_sizes": np.zeros(0, np.int64), "_starts": np.zeros(0, np.int64)}
        return {k: v for k, v in self.__dict__.items() if k not in ("_plain", "_raw_sizes", "_raw_table")} | none

    # solving parts

    def solve(self, parts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """(positions in ``parts``, ids end to end, number of ids of each), a marker standing for each space."""
        raw = [p.replace(" ", MARK).encode() for p in parts]
        marks = [i for i, p in enumerate(parts) if p == MARK]
        if marks:
            yield marks, np.tile(self.byte_id[list(MARK.encode())], len(marks)), np.full(len(marks), 3)
        todo = sorted((i for i, p in enumerate(parts) if p != MARK), key=lambda i: len(raw[i]))
        at = 0
        while at < len(todo):
            n = len(raw[todo[at]])
            if n > LONG_PART:
                ids = self._solve_one(raw[todo[at]])
                yield [todo[at]], ids, np.array([len(ids)])
                at += 1
                continue
            end = at
            while end < len(todo) and len(raw[todo[end]]) <= max(n + 3, 8) and len(raw[todo[end]]) <= LONG_PART and end - at < 8_000:
                end += 1
            yield todo[at:end], *self._solve_many([raw[i] for i in todo[at:end]])
            at = end

    def _solve_many(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi over all of ``raw`` at once, one array step per start and byte."""
        base, check, value, score = self.trie.base, self.trie.check, self.trie.value, self.score
        size = np.array([len(r) for r in raw])
        rows, width = len(raw), int(size.max())
        text = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), np.uint8).reshape(rows, width).astype(np.int32)
        best = np.full((width + 1, rows), -np.inf)
        best[0] = 0
        last = np.full((width + 1, rows), -1, np.int32)  # the piece that ends here; -2 - n: n bytes outside the vocabulary
        head = np.array([1] * 192 + [2] * 32 + [3] * 16 + [4] * 16)
        for i in range(width):
            live = np.flatnonzero((best[i] > -np.inf) & (size > i))
            if not len(live):
                continue
            whole = i + head[text[live, i]]  # where this character ends
            known = np.zeros(len(live), bool)
            who, node = np.arange(len(live)), np.zeros(len(live), np.int32)
            for k in range(i, min(width, i + self.longest)):
                to = base[node] + text[live[who], k]
                ok = (check[to] == node) & (size[live[who]] > k) & (to > 0)
                who, node = who[ok], to[ok]
                if not len(who):
                    break
                hit = value[node] >= 0
                if hit.any():
                    w, ids = who[hit], value[node[hit]]
                    rows_ = live[w]
                    known[w] |= whole[w] == k + 1
                    total = best[i, rows_] + score[ids]
                    better = total > best[k + 1, rows_]
                    best[k + 1, rows_[better]] = total[better]
                    last[k + 1, rows_[better]] = ids[better]
            for w in np.flatnonzero(~known):
                row, to = live[w], whole[w]
                if (total := best[i, row] + self.unknown) > best[to, row]:
                    best[to, row], last[to, row] = total, -2 - (to - i)
        # back from the ends, a piece of each row at a time
        lengths = self._length_table
        here, trail, lost = size.copy(), [], np.zeros(rows, bool)
        while True:
            at = np.flatnonzero(here > 0)
            if not len(at):
                break
            piece = last[here[at], at]
            lost[at[piece < 0]] = True
            step = np.full(rows, -1, np.int32)
            step[at] = piece
            trail.append(step)
            here[at] -= np.where(piece >= 0, lengths[np.maximum(piece, 0)], -2 - piece)
        grid = np.stack(trail[::-1], 1)
        sizes = (grid >= 0).sum(1)
        if not lost.any():
            return grid[grid >= 0], sizes
        spans = np.where(last >= 0, 0, -2 - last)
        found = [self._walk(last[:, r], spans[:, r], text[r], int(size[r])) if lost[r] else grid[r][grid[r] >= 0] for r in range(rows)]
        return np.concatenate(found), np.array([len(f) for f in found])

    def _walk(self, last, spans, text, at: int) -> np.ndarray:
        ids: list[int] = []
        starts = self._lengths
        while at > 0:
            piece = last[at]
            if piece >= 0:
                ids.append(piece)
                at -= starts[piece]
            else:
                n = int(spans[at])
                ids.extend(self.byte_id[text[at - n : at]][::-1])
                at -= n
        return np.array(ids[::-1], np.int32)

    @property
    def _lengths(self) -> list[int]:
        """Bytes of each piece with its markers (a marker has three, a space one)."""
        if "_raw_sizes" not in self.__dict__:
            blanks = [self.piece_data[a:b].tobytes().count(b" ") for a, b in zip(self.piece_at[:-1], self.piece_at[1:], strict=True)]
            self._raw_sizes = [int(n) + 2 * c for n, c in zip(self.piece_size, blanks, strict=True)]
        return self._raw_sizes

    @property
    def _length_table(self) -> np.ndarray:
        if "_raw_table" not in self.__dict__:
            self._raw_table = np.array(self._lengths)
        return self._raw_table

    def _solve_one(self, raw: bytes) -> np.ndarray:
        """Viterbi over one long part."""
        base, check, value, score = self._lists()
        n = len(raw)
        best, last = [0.0] + [-np.inf] * n, [0] * (n + 1)
        for i in range(n):
            if best[i] == -np.inf:
                continue
            b = raw[i]
            whole = i + (1 if b < 192 else 2 if b < 224 else 3 if b < 240 else 4)
            node, known, here = 0, False, best[i]
            for k in range(i, min(n, i + self.longest)):
                to = base[node] + raw[k]
                if check[to] != node or to == 0:
                    break
                node = to
                if (piece := value[node]) >= 0:
                    known |= whole == k + 1
                    if (total := here + score[piece]) > best[k + 1]:
                        best[k + 1], last[k + 1] = total, piece
            if not known and here + self.unknown > best[whole]:
                best[whole], last[whole] = here + self.unknown, -2 - (whole - i)
        last_ = np.array(last)
        return self._walk(last_, np.where(last_ >= 0, 0, -2 - last_), np.frombuffer(raw, np.uint8), n)

    def _lists(self):
        if "_plain" not in self.__dict__:
            self._plain = tuple(a.tolist() for a in (self.trie.base, self.trie.check, self.trie.value, self.score))
        return self._plain

    # columns

    def encode(self, texts: pa.Array) -> pa.Array:
        """list<int32> of each text; works through the column a bounded number of parts at a time."""
        done, held, n = [], [], 0
        for text in texts:
            text = text.as_py()
            held.append([] if not text else self.cut(" " + text))
            if text is None:
                held[-1] = None
            n += len(held[-1] or ())
            if n > PARTS_AT_ONCE:
                done.append(self._lists_of(held))
                held, n = [], 0
        done.append(self._lists_of(held))
        return pa.concat_arrays(done)

    def cut(self, text: str) -> list[str]:
        return [text] if self.parts is None else self.parts.findall(text)

    def _lists_of(self, rows: list[list[str] | None]) -> pa.Array:
        if len(self._index) > CACHE_PARTS:
            self._forget()
        index = self._index
        flat = list(chain.from_iterable(r for r in rows if r))
        new = list({p for p in flat if p not in index})
        if new:
            pools, all_sizes = [self._pool], [self._sizes]
            for at, ids, sizes in self.solve(new):
                start = len(index)
                index.update(zip([new[i] for i in at], range(start, start + len(at)), strict=True))
                pools.append(ids)
                all_sizes.append(sizes)
            self._pool, self._sizes = np.concatenate(pools), np.concatenate(all_sizes)
            self._starts = np.cumsum(self._sizes) - self._sizes
        which = np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))
        if len(which):
            sizes = self._sizes[which]
            ends = np.cumsum(sizes)
            ids = self._pool[np.repeat(self._starts[which] - (ends - sizes), sizes) + np.arange(ends[-1])]
        else:
            ends, ids = np.zeros(0, np.int64), np.zeros(0, np.int32)
        ends = np.concatenate([[0], ends])
        counts = np.cumsum([0, *(len(r or ()) for r in rows)])
        offsets = pa.array(ends[counts].astype(np.int32), pa.int32(), mask=np.array([*(r is None for r in rows), False]))
        return pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))

    def decode(self, lists: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for ids in lists:
            if not ids.is_valid:
                out.append(None)
                continue
            values = ids.values.fill_null(-1).to_numpy(zero_copy_only=False)
            values = values[(values >= 0) & (values < len(self.piece_size))]
            sizes = self.piece_size[values]
            ends = np.cumsum(sizes)
            data = self.piece_data[np.repeat(self.piece_at[values] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
            out.append(data.decode("utf-8", "replace").removeprefix(" "))
        return pa.array(out, pa.string())


@lru_cache(4)
def load(path: str, log_ranks: bool = True) -> Unigram:
    return Unigram(path, log_ranks)


def coder(spark: SparkSession, path: str, log_ranks: bool = True):
    """(encode, decode): functions of a column, for text to ids (array<int>) and back."""
    shared = spark.sparkContext.broadcast(load(path, log_ranks))

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return shared.value.encode(texts)

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        return shared.value.decode(ids)

    return encode, decode


def encoded(docs: DataFrame, path: str, text: str = "text", log_ranks: bool = True) -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens``, ``n_byte_tokens`` and ``decoded``, in place of columns of these names.

    One function makes ids and decoded text together: two that hang together would each encode.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path, log_ranks))
    byte_ids = [int(i) for i in load(path, log_ranks).byte_id]

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def both_ways(texts: pa.Array) -> pa.Array:
        ids = shared.value.encode(texts)
        out = pa.StructArray.from_arrays([ids, shared.value.decode(ids)], ["ids", "decoded"])
        kernels.trim()
        return out

    lo, hi = min(byte_ids), max(byte_ids)
    out = docs.withColumn("_quillon_pieces", both_ways(F.col(text)))
    return out.withColumns({
        "ids": F.col("_quillon_pieces.ids"),
        "n_tokens": F.coalesce(F.size("_quillon_pieces.ids"), F.lit(0)).cast("long"),
        "n_byte_tokens": F.coalesce(F.size(F.filter("_quillon_pieces.ids", lambda i: i.between(lo, hi))), F.lit(0)).cast("long"),
        "decoded": F.col("_quillon_pieces.decoded"),
    }).drop("_quillon_pieces")
