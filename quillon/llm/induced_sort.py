"""Suffix order and common prefixes of a shard by external induced sorting.

A string's suffixes fall into kinds by whether they are larger (L) or smaller (S) than the next one; an S after an L (S*) starts a
substring of a shorter string, of the substrings' names, that is sorted by recursion. From the order of the S* suffixes, one
ascending sweep induces that of all L suffixes and one descending sweep that of all S suffixes: a suffix that has been reached passes a
tuple of position and common prefix for the suffix before it to a priority queue by first character. Within a character
tuples leave in the order in which they came. The common prefix that a tuple carries is one more than the least one between its
source and the source of the tuple before it, where both have one first character, and 1 otherwise; the recursion's common prefixes,
counted in names, become characters by the names' places, and the last few characters by comparison.

Text, names, queues, seeds and results are files in a scratch folder, read in blocks (or, by position, through mapped files);
``memory`` bounds the arrays that are held. Names are sorted by distribution to parts that fit. Names of a large alphabet go down
as digits of ``DIGITS`` symbols, so that a sweep has few characters at any level; a string of at most ``in_memory`` names, which is where
recursion ends, and a text of at most ``DIRECT`` symbols are sorted by doubling.

Common prefixes count up to ``cap``; suffixes with that much in common are neighbours in any order.
"""

from __future__ import annotations

import shutil
import tempfile
from collections import deque
from collections.abc import Iterator
from pathlib import Path

import numpy as np

IN_MEMORY = 1 << 19
DIRECT = 1 << 10
DIGITS = 1 << 10
SHIFT = np.uint64(24)
LOW = np.uint64((1 << 24) - 1)
MOST = 1 << 24


class Scratch:
    """Arrays in files of a folder that ``close`` removes."""

    def __init__(self):
        self.folder, self.files, self.spilled = tempfile.mkdtemp(prefix="induced-"), 0, 0

    def path(self) -> str:
        self.files += 1
        return f"{self.folder}/{self.files}"

    def array(self, n: int, kind: type) -> np.ndarray:
        return np.memmap(self.path(), kind, "w+", shape=(n,)) if n else np.zeros(0, kind)

    def drop(self, *arrays: np.ndarray) -> None:
        """Remove the files of arrays that are done with."""
        for a in arrays:
            if isinstance(a, np.memmap) and a.filename:
                Path(a.filename).unlink(missing_ok=True)

    def close(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


class DiskQueue:
    """A priority queue of tuples by character, popped a character at a time; equal characters in order of arrival.

    Beyond ``memory`` bytes the queue's arrays go to a file.
    """

    def __init__(self, scratch: Scratch, memory: int):
        self.scratch, self.memory, self.held = scratch, memory, 0
        self.parts: dict[int, deque] = {}
        self.paths: list[str] = []

    def close(self) -> None:
        for path in self.paths:
            Path(path).unlink(missing_ok=True)

    def push(self, chars: np.ndarray, tuples: np.ndarray) -> None:
        """``chars`` in ascending order."""
        if not len(chars):
            return
        cuts = np.flatnonzero(chars[1:] != chars[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(chars)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            self.parts.setdefault(int(chars[a]), deque()).append(tuples[a:b].copy())
        self.held += tuples.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        path, at = self.scratch.path(), 0
        self.paths.append(path)
        self.scratch.spilled += 1
        with open(path, "wb") as file:
            for c, parts in self.parts.items():
                loose = [p for p in parts if isinstance(p, np.ndarray)]
                if loose:
                    n = sum(map(len, loose))
                    for p in loose:
                        file.write(p.tobytes())
                    self.parts[c] = deque([p for p in parts if not isinstance(p, np.ndarray)] + [(path, at, n)])  # later arrivals stand behind
                    at += n
        self.held = 0

    def pop(self, c: int, most: int) -> np.ndarray | None:
        """The next tuples of character ``c``, about ``most`` of them."""
        parts, out, n = self.parts.get(c), [], 0
        while parts and n < most:
            part = parts.popleft()
            if isinstance(part, tuple):
                path, at, size = part
                if size > most:
                    parts.appendleft((path, at + most, size - most))
                    size = most
                part = np.fromfile(path, np.uint64, size, offset=8 * at)
            else:
                self.held -= part.nbytes
            out.append(part)
            n += len(part)
        if not out:
            self.parts.pop(c, None)
            return None
        return np.concatenate(out)


def place_kind(n: int) -> type:
    """The type of places in a string of ``n``."""
    return np.int32 if n < 1 << 31 else np.int64


def range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of ``values[lo..hi]`` for each range (none empty)."""
    out = np.empty(len(lo), values.dtype)
    level = np.frexp((hi - lo + 1).astype(float))[1] - 1
    table, span = values, 1
    for j in range(int(level.max()) + 1 if len(level) else 0):
        if j:
            table = np.minimum(table[: len(table) - span], table[span:])
            span *= 2
        here = np.flatnonzero(level == j)
        out[here] = np.minimum(table[lo[here]], table[hi[here] - span + 1])
    return out


def doubling(text: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefixes with the one before) in memory; the last symbol is the only smallest one."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int32)
    ranks, step = [rank], 1
    while step < cap and rank.max() + 1 < n:
        key = rank.astype(np.int64) * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        rank = np.empty(n, np.int32)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
        ranks.append(rank)
        step *= 2
    order = np.argsort(rank, kind="stable")
    prefix = np.zeros(n, np.int64)
    a, b, same = order[:-1].copy(), order[1:].copy(), prefix[1:]
    for level in range(len(ranks) - 1, -1, -1):
        inside = np.flatnonzero(np.maximum(a, b) < n)
        more = inside[ranks[level][a[inside]] == ranks[level][b[inside]]]
        a[more] += 1 << level
        b[more] += 1 << level
        same[more] += 1 << level
    return order, np.minimum(prefix, cap)


def sort_suffixes(text: np.ndarray, cap: int, memory: int, scratch: Scratch, in_memory: int = IN_MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the suffixes in order, common prefix of each with the one before, up to ``cap``).

    ``text`` has symbols of 16 bits, its last one the only 0; results are arrays in ``scratch``.
    """
    n, block = len(text), max(64, memory // 64)
    if cap >= MOST:
        raise ValueError("cap is too large")
    if n <= min(in_memory, DIRECT):
        order, prefix = doubling(np.asarray(text), cap)
        out, common = scratch.array(n, place_kind(n)), scratch.array(n, np.int32)
        out[:], common[:] = order, prefix
        return out, common
    counts = np.zeros(1 << 16, np.int64)
    for lo in range(0, n, block):
        counts += np.bincount(text[lo : lo + block], minlength=len(counts))
    symbols = int(np.flatnonzero(counts)[-1]) + 1
    counts = counts[:symbols]
    small, stars = _kinds(text, block, scratch)
    m = len(stars)
    order, names, distinct = _named(text, small, stars, symbols, block, scratch)
    scratch.drop(small)
    del small
    names_cap = cap // 2 + 2
    if distinct < m:
        scratch.drop(order)
    if distinct == m:
        common = None
    elif m <= in_memory or m * _width(distinct) + 1 >= n:  # the latter where nothing would be shorter
        order, common = doubling(np.asarray(names), names_cap)
    else:
        order, common = _reduced(names, distinct, names_cap, memory, scratch, in_memory)
    seeds, first = _seeds(text, stars, order, common, symbols, cap, block, scratch)
    scratch.drop(stars, names, order, common)
    del stars, names, order, common
    return _induced(text, counts, symbols, seeds, first, cap, memory, scratch)


def _kinds(text: np.ndarray, block: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """(whether each suffix is S, positions of the S* ones)."""
    n = len(text)
    small = scratch.array(n, bool)
    small[n - 1] = True
    for hi in range(n - 1, 0, -block):  # right to left; ``hi`` itself is known
        lo = max(0, hi - block)
        part = np.asarray(text[lo : hi + 1])
        differ = np.flatnonzero(part[1:] != part[:-1])
        kind = np.full(hi - lo, small[hi])  # up to an equal run at the end
        if len(differ):
            to = differ[np.minimum(np.searchsorted(differ, np.arange(hi - lo)), len(differ) - 1)]
            inside = np.arange(hi - lo) <= differ[-1]
            kind[inside] = (part[to] < part[to + 1])[inside]
        small[lo:hi] = kind
    found, path = 0, scratch.path()
    with open(path, "wb") as file:
        for lo in range(0, n, block):
            part = small[max(0, lo - 1) : lo + block]
            here = np.flatnonzero(part[1:] & ~part[:-1]) + 1 + max(0, lo - 1)
            file.write(here.astype(place_kind(n)).tobytes())
            found += len(here)
    return small, np.memmap(path, place_kind(n), "r", shape=(found,))


class _Keys:
    """The next few symbols of S* substrings from a depth on, with their kinds, as one number."""

    def __init__(self, text, small, stars, symbols: int):
        self.text, self.small, self.stars = text, small, stars
        self.bits = (2 * symbols + 2).bit_length()
        self.reach = 63 // self.bits

    def sizes(self, which: np.ndarray) -> np.ndarray:
        nxt = np.minimum(which + 1, len(self.stars) - 1)
        return (self.stars[nxt] - self.stars[which]).astype(np.int64)

    def __call__(self, which: np.ndarray, depth: int) -> np.ndarray:
        at, left = self.stars[which].astype(np.int64) + depth, self.sizes(which) - depth
        out = np.zeros(len(which), np.int64)
        for j in range(self.reach):
            here = np.flatnonzero(left >= j)
            spot = at[here] + j
            out[here] |= (self.text[spot].astype(np.int64) * 2 + self.small[spot] + 1) << (self.bits * (self.reach - 1 - j))
        return out


def _part(which, lo: int, hi: int) -> np.ndarray:
    """A part of S* substrings, given as an array or a range."""
    part = which[lo:hi]
    return np.arange(part.start, part.stop) if isinstance(part, range) else np.asarray(part).astype(np.int64)


def _in_order(keys: _Keys, which: np.ndarray | range, depth: int, block: int, scratch: Scratch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(S* substrings in order, whether each differs from the one before), ``which`` being equal up to ``depth``."""
    kind = place_kind(len(keys.stars))
    while len(which) > block:
        spots = np.linspace(0, len(which) - 1, 2_000).astype(np.int64)
        sample = keys(spots if isinstance(which, range) else which[spots], depth)
        cuts = np.unique(np.sort(sample)[:: max(1, 2_000 * block // (2 * len(which)))])
        paths, sizes = [scratch.path() for _ in range(2 * len(cuts) + 1)], np.zeros(2 * len(cuts) + 1, np.int64)
        for lo in range(0, len(which), block):
            part = _part(which, lo, lo + block)
            key = keys(part, depth)
            at = np.searchsorted(cuts, key, "left") + np.searchsorted(cuts, key, "right")  # odd: equal to a cut
            by = np.argsort(at, kind="stable")
            bounds = np.searchsorted(at[by], np.arange(len(paths) + 1))
            for p in np.flatnonzero(np.diff(bounds)):
                with open(paths[p], "ab") as file:
                    file.write(part[by[bounds[p] : bounds[p + 1]]].astype(kind).tobytes())
            sizes += np.diff(bounds)
        full = np.flatnonzero(sizes)
        scratch.drop(which)
        if len(full) == 1 and full[0] % 2:  # one key
            which = np.memmap(paths[full[0]], kind, "r", shape=(int(sizes[full[0]]),))
            depth += keys.reach
            if int(keys.sizes(_part(which, 0, 1))[0]) < depth:  # all at their end
                for lo in range(0, len(which), block):
                    part = _part(which, lo, lo + block)
                    yield part, np.arange(lo, lo + len(part)) == 0
                return
            continue
        for p in full:
            yield from _in_order(keys, np.memmap(paths[p], kind, "r", shape=(int(sizes[p]),)), depth, block, scratch)
        return
    scratch.drop(which)
    which = _part(which, 0, len(which))
    if not len(which):
        return
    key = keys(which, depth)
    by = np.argsort(key, kind="stable")
    which, key = which[by], key[by]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    open_ = np.arange(len(which))
    while True:
        depth += keys.reach
        group = np.cumsum(new)
        several = np.bincount(group, minlength=len(which) + 2)[group[open_]] > 1
        open_ = open_[several]
        open_ = open_[keys.sizes(which[open_]) >= depth]
        if not len(open_):
            break
        key, g = keys(which[open_], depth), group[open_]
        by = np.lexsort((key, g))
        which[open_] = which[open_][by]
        key, g = key[by], g[by]
        new[open_] |= np.concatenate([[True], (key[1:] != key[:-1]) & (g[1:] == g[:-1])]) & np.concatenate([[False], np.ones(len(key) - 1, bool)])
    yield which, new


def _named(text, small, stars, symbols: int, block: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray, int]:
    """(S* substrings in order, name of each by place, number of names)."""
    m = len(stars)
    names, order = scratch.array(m, place_kind(m)), scratch.array(m, place_kind(m))
    at, count = 0, 0
    for which, new in _in_order(_Keys(text, small, stars, symbols), range(m), 0, block, scratch):
        order[at : at + len(which)] = which
        names[which] = count + np.cumsum(new) - 1
        count += int(new.sum())
        at += len(which)
    return order, names, count


def _width(distinct: int) -> int:
    """Digits of a name."""
    return max(1, -(-(distinct - 1).bit_length() // (DIGITS.bit_length() - 1)))


def _reduced(names: np.ndarray, distinct: int, cap: int, memory: int, scratch: Scratch, in_memory: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and common prefixes, in names, of the string of names: sorted as a string of digits."""
    m, block = len(names), max(64, memory // 64)
    width = _width(distinct)
    text = scratch.array(m * width + 1, np.uint16)
    for lo in range(0, m, block):
        part = np.asarray(names[lo : lo + block]).astype(np.int64)
        digits = np.stack([part // DIGITS ** (width - 1 - j) % DIGITS + 1 for j in range(width)], 1)
        text[lo * width : (lo + len(part)) * width] = digits.ravel()
    text[-1] = 0
    found, common = sort_suffixes(text, cap * width, memory, scratch, in_memory)
    scratch.drop(text, names)
    order, prefix, at, least = scratch.array(m, place_kind(m)), scratch.array(m, np.int32), 0, MOST
    for lo in range(0, len(found), block):
        place, shared = (np.asarray(x[lo : lo + block]).astype(np.int64) for x in (found, common))
        keep = np.flatnonzero((place % width == 0) & (place < m * width))
        if not len(keep):
            least = min(least, int(shared.min()))
            continue
        # the least of what lies between two that stay
        between = np.minimum.reduceat(shared, np.concatenate([[0], keep[:-1] + 1]))
        between[0] = min(between[0], least)
        order[at : at + len(keep)] = place[keep] // width
        prefix[at : at + len(keep)] = between // width
        at += len(keep)
        least = int(shared[keep[-1] + 1 :].min(initial=MOST))
    scratch.drop(found, common)
    return order, prefix


def _seeds(text, stars, order, common, symbols: int, cap: int, block: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """(tuples of the S* suffixes in order, where each character's begin); common prefixes in characters."""
    n, m = len(text), len(stars)
    seeds, counts, before = scratch.array(m, np.uint64), np.zeros(symbols, np.int64), None
    for lo in range(0, m, block):
        which = np.asarray(order[lo : lo + block]).astype(np.int64)
        shared = np.zeros(len(which), np.int64) if common is None else np.asarray(common[lo : lo + block]).astype(np.int64)
        here = stars[which].astype(np.int64)
        prior = np.concatenate([which[:1] if before is None else before, which[:-1]])
        there = stars[prior].astype(np.int64)
        same = np.minimum(stars[np.minimum(which + shared, m - 1)] - here, cap)
        if before is None:
            same[0] = 0
        alive = np.arange(0 if before is not None else 1, len(which))
        while len(alive):
            a, b = here[alive] + same[alive], there[alive] + same[alive]
            alive = alive[(same[alive] < cap) & (np.maximum(a, b) < n)]
            alive = alive[text[here[alive] + same[alive]] == text[there[alive] + same[alive]]]
            same[alive] += 1
        seeds[lo : lo + len(which)] = here.astype(np.uint64) << SHIFT | same.astype(np.uint64)
        counts += np.bincount(text[here], minlength=symbols)
        before = which[-1:]
    return seeds, np.concatenate([[0], np.cumsum(counts)])


class _Bucket:
    """What a character's suffixes pass on, block by block in their order."""

    def __init__(self, text, queue: DiskQueue, c: int, cap: int, up: bool):
        self.text, self.queue, self.c, self.cap, self.up = text, queue, c, cap, up
        self.chars, self.least = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the least common prefix since a character was last passed on

    def pass_on(self, places: np.ndarray, common: np.ndarray, own: bool) -> None:
        """Tuples for the suffixes before ``places`` go to the queue; those with this character too where ``own``."""
        at = np.flatnonzero(places > 0)
        chars = self.text[places[at] - 1].astype(np.int64)
        take = (chars > self.c if self.up else chars < self.c) | ((chars == self.c) if own else False)
        at, chars = at[take], chars[take]
        lowest = int(common.min())
        if not len(at):
            self.least = np.minimum(self.least, lowest)
            return
        by = np.argsort(chars.astype(np.uint16), kind="stable")
        at, chars = at[by], chars[by]
        first = np.concatenate([[True], chars[1:] != chars[:-1]])
        shared = range_min(common, np.where(first, 0, np.concatenate([[0], at[:-1] + 1])), at).astype(np.int64)
        lead = np.flatnonzero(first)
        spot = np.minimum(np.searchsorted(self.chars, chars[lead]), max(0, len(self.chars) - 1))
        known = self.chars[spot] == chars[lead] if len(self.chars) else np.zeros(len(lead), bool)
        shared[lead] = np.where(known, np.minimum(shared[lead], self.least[spot] if len(self.chars) else 0), 0)
        self.queue.push(chars, (places[at] - 1).astype(np.uint64) << SHIFT | np.minimum(shared + 1, self.cap).astype(np.uint64))
        last = at[np.append(lead[1:], len(at)) - 1]
        after = np.append(np.minimum.accumulate(common[::-1])[::-1], MOST)[last + 1].astype(np.int64)
        gone = ~np.isin(self.chars, chars[lead])
        merged = np.concatenate([self.chars[gone], chars[lead]])
        by = np.argsort(merged)
        self.chars, self.least = merged[by], np.concatenate([np.minimum(self.least[gone], lowest), after])[by]


def _run(text, at: int, c: int, cap: int) -> int:
    n = 0
    while n < cap and text[at + n] == c:
        n += 1
    return n


def _induced(text, counts, symbols: int, seeds, first, cap: int, memory: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    n, block = len(text), max(64, memory // 64)
    large, queue, ends, at = scratch.array(n, np.uint64), DiskQueue(scratch, memory), np.zeros(symbols, np.int64), 0
    split = lambda tuples: ((tuples >> SHIFT).astype(np.int64), (tuples & LOW).astype(np.int32))
    begins = np.zeros(symbols, np.int64)
    for c in range(symbols):  # ascending: L suffixes
        bucket, begins[c], last = _Bucket(text, queue, c, cap, True), at, None
        while (tuples := queue.pop(c, block)) is not None:
            if last is None:
                tuples[0] &= ~LOW  # nothing in common with the characters below
            large[at : at + len(tuples)] = tuples
            at += len(tuples)
            places, common = split(tuples)
            last = int(places[-1])
            bucket.pass_on(places, common, True)
        ends[c] = at
        for lo in range(int(first[c]), int(first[c + 1]), block):
            places, common = split(np.asarray(seeds[lo : min(lo + block, int(first[c + 1]))]))
            if lo == first[c]:
                common[0] = 0 if last is None else min(_run(text, last, c, cap), _run(text, int(places[0]), c, cap))
            bucket.pass_on(places, common, False)
    queue.close()
    scratch.drop(seeds)
    out, shared = scratch.array(n, place_kind(n)), scratch.array(n + 1, np.uint8 if cap < 256 else np.int32)
    starts = np.concatenate([[0], np.cumsum(counts)])
    queue = DiskQueue(scratch, memory)
    for c in range(symbols - 1, 0, -1):  # descending: S suffixes, largest first
        bucket, end, last = _Bucket(text, queue, c, cap, False), int(starts[c + 1]), None
        while (tuples := queue.pop(c, block)) is not None:
            places, common = split(tuples)
            if last is None:
                common[0] = 0
            out[end - len(places) : end] = places[::-1]
            shared[end - len(places) + 1 : end + 1] = common[::-1]  # each has its own with the next smaller one
            end -= len(places)
            last = int(places[-1])
            bucket.pass_on(places, common, True)
        a, b = int(begins[c]), int(ends[c])
        if b > a:
            seam = 0 if last is None else min(_run(text, last, c, cap), _run(text, int(large[b - 1] >> SHIFT), c, cap))
            shared[end] = seam
            for hi in range(b, a, -block):
                lo = max(a, hi - block)
                places, common = split(np.asarray(large[lo : hi + 1]))  # and the one before in this sweep
                if hi == b:
                    places, common = places[: hi - lo], np.append(common[1 : hi - lo], seam).astype(np.int32)
                else:
                    places, common = places[:-1], common[1:]
                to = int(starts[c]) + lo - a
                out[to : to + len(places)] = places
                shared[to : to + len(places)] = np.asarray(large[lo:hi] & LOW)
                bucket.pass_on(places[::-1], common[::-1], False)
        elif last is not None:
            shared[end] = 0
    out[0], shared[0] = n - 1, 0
    queue.close()
    scratch.drop(large)
    return out, shared[:n]
