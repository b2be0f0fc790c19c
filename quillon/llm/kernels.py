"""Array code over the UTF-8 bytes of many texts at once: words, their hashes, and hashes of windows.

Hashes are polynomials modulo 2^64 in an odd base over random values for bytes (or words), so a window's hash is a difference
of two running sums times a power of the base's inverse; a last mixing step spreads the bits.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes of text worked on at once; a longer text makes a chunk of its own
_rng = np.random.default_rng(20_240_229)
_BASES = [int(x) | 1 for x in _rng.integers(1 << 62, 1 << 63, 4, dtype=np.uint64)]
_BYTES = _rng.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES[:, SPACE] = 0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def trim() -> None:
    """Give memory that this process has freed back to the system; workers live on from stage to stage."""
    _powers.clear()
    gc.collect()
    release()


def release() -> None:
    """Give free memory back, without a search for garbage: between groups."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``rows``, a function of a partition's batches, and ``trim`` at its end."""

    def run(batches):
        try:
            yield from rows(batches)
        finally:
            trim()

    return run


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i below n (or more)."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 12)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(size, np.uint64)
            p[1:] = np.uint64(b)
            np.multiply.accumulate(p, out=p)
            out.append(p)
        got = _powers[base] = (out[0], out[1])
    return got


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values, one to one."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows; a null text has no bytes."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): where words start and end, and the first word of each text (one more than there are texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    starts = edge[:-1] & inside
    ends = edge[1:] & inside
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    starts[cut] |= inside[cut]
    ends[cut - 1] |= inside[cut - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def single_spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the words with one space after each, how far each word has moved to the front)."""
    keep = ~SPACE[data]
    after = ends[(ends < len(data))]
    keep[after] = True  # the first byte after a word: a space, or where texts meet the next word's first
    out = np.where(SPACE[data], np.uint8(0x20), data)[keep]
    return out, starts - (np.cumsum(keep)[starts] - 1 if len(starts) else starts)


def word_hashes(data: np.ndarray, starts: np.ndarray, lane: int = 0) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(_BASES[lane], len(data))
    return mix(np.add.reduceat(_BYTES[lane][data] * up[: len(data)], starts) * down[starts])


def window_hashes(values: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` values; texts' ends are the caller's matter."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(_BASES[2 + lane], len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[width:] - total[:-width]) * down[:n])


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value (by the upper 32 bits; the leftmost of equals) in each run of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # minima of runs of doubling length, the position in the lower bits
    best = values >> np.uint64(32) << np.uint64(32) | np.arange(len(values), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        best = np.minimum(best[: len(best) - span], best[span:])
        span *= 2
    return (np.minimum(best[:n], best[width - span : width - span + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
