"""Fill-in-the-middle rearrangement of texts, cut at line ends.

One scan runs a table-driven DFA over the UTF-8 bytes of a batch of texts, each ended by a symbol of its own. Its states say whether a line
has begun, how many continuation bytes are due, and how much of a sentinel has been read; each step emits the number of its transition, and
tables say which transitions begin a character, end a unit or complete a sentinel. Counting them gives a text's units and whether it holds a
sentinel. A second pass over the emitted transitions locates the two cuts, and counts characters between them.

A state is settled by the three bytes before it, so the bytes are laid out in lanes that start three bytes early and advance together, one
array operation a step for all lanes. Blocks bound what is held beside a text and its transitions (one byte a byte).

Defined cases: a null text is empty, and an empty text ``plain``, as is one that holds a sentinel; a null id hashes like an empty one; very long
texts are taken whole; repeated rows give repeated rows; an empty table gives an empty result; other columns stay as they are, but ``n``,
``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of the input are replaced. Bytes that are no UTF-8 count one character each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Symbols: one for each class of bytes, and the end of a text.
OTHER, NEWLINE, OPEN, LETTER, CLOSE, CONTINUE, LEAD2, LEAD3, LEAD4, END = range(10)
SYMBOLS = 10
# States: at a unit's start, within one, after `<`, after `<` and a letter, and with 1, 2 or 3 continuation bytes due.
START, INSIDE, OPENED, NAMED, DUE1, DUE2, DUE3 = range(7)
STATES = 7
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SETTLES = 3  # so many bytes settle the state
LANES = 8192
BLOCK = 4 << 20


def byte_classes() -> np.ndarray:
    """The symbol of each byte."""
    out = np.full(256, OTHER, np.uint8)
    out[0x80:0xC0] = CONTINUE
    out[0xC2:0xE0], out[0xE0:0xF0], out[0xF0:0xF5] = LEAD2, LEAD3, LEAD4
    out[ord("\n")], out[ord("<")], out[ord(">")] = NEWLINE, OPEN, CLOSE
    out[[ord(c) for c in "PSM"]] = LETTER
    return out


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(next state, begins a character, ends a unit, completes a sentinel), by transition ``state * SYMBOLS + symbol``."""
    to = np.zeros(STATES * SYMBOLS, np.uint8)
    char, unit, sentinel = (np.zeros(STATES * SYMBOLS, bool) for _ in range(3))
    for state in range(STATES):
        for symbol in range(SYMBOLS):
            t = state * SYMBOLS + symbol
            due = state - DUE1 + 1 if state >= DUE1 else 0
            goes = {OPEN: OPENED, LEAD2: DUE1, LEAD3: DUE2, LEAD4: DUE3, NEWLINE: START, END: START}.get(symbol, INSIDE)
            if symbol == LETTER and state == OPENED:
                goes = NAMED
            if symbol == CONTINUE and due > 1:
                goes = DUE1 + due - 2
            to[t] = goes
            char[t] = symbol != END and not (symbol == CONTINUE and due)
            unit[t] = symbol == NEWLINE or symbol == END and state != START
            sentinel[t] = symbol == CLOSE and state == NAMED
    return to, char, unit, sentinel


CLASS = byte_classes()
NEXT, CHAR, UNIT, SENTINEL = tables()


def transitions(symbols: np.ndarray, block: int = BLOCK, lanes: int = LANES) -> np.ndarray:
    """The DFA's transition at each symbol, from START at the first."""
    out = np.empty(len(symbols), np.uint8)
    for lo in range(0, len(symbols), block):
        here = symbols[lo : lo + block]
        n = min(lanes, max(1, len(here) // 64))
        width = -(-len(here) // n)
        padded = np.full(SETTLES + n * width, END, np.uint8)  # END before the first byte leaves START
        padded[SETTLES : SETTLES + len(here)] = here
        before = symbols[max(0, lo - SETTLES) : lo]
        padded[SETTLES - len(before) : SETTLES] = before
        steps = np.lib.stride_tricks.as_strided(padded, (width + SETTLES, n), (1, width))  # column i starts at i * width
        found, state = np.empty((width, n), np.uint8), np.zeros(n, np.uint8)
        for k in range(width + SETTLES):
            t = state * np.uint8(SYMBOLS) + steps[k]
            state = NEXT[t]
            if k >= SETTLES:
                found[k - SETTLES] = t
        out[lo : lo + block] = found.T.reshape(-1)[: len(here)]
    return out


def rearranged(texts: pa.Array, h1: np.ndarray, h2: np.ndarray, h3: np.ndarray, h4: np.ndarray, rate: int, spm: int) -> pa.Array:
    """(n, form, prefix_chars, middle_chars, output) of a batch of texts."""
    data = [t.as_buffer() if t.is_valid else b"" for t in texts.cast(pa.large_binary())]
    size = np.array([memoryview(d).nbytes for d in data], np.int64)
    end = np.cumsum(size + 1)
    start = end - size - 1
    symbols = np.empty(end[-1] if len(end) else 0, np.uint8)
    for lo, n, d in zip(start, size, data, strict=True):
        symbols[lo : lo + n] = CLASS[np.frombuffer(d, np.uint8)]
        symbols[lo + n] = END
    emitted = transitions(symbols)
    del symbols

    # counted transitions: units, and sentinels, by text
    ends = np.flatnonzero(UNIT[emitted])
    first = np.searchsorted(ends, start)
    n_units = np.searchsorted(ends, end) - first
    marks = np.flatnonzero(SENTINEL[emitted])
    marked = np.searchsorted(marks, end) > np.searchsorted(marks, start)
    plain = (size == 0) | marked | (h3 % 100 >= rate)
    suffix_first = h4 % 100 < spm

    # second pass: byte places of the cuts, and characters up to them
    one, two = h1 % (n_units + 1), h2 % (n_units + 1)

    def place(units: np.ndarray) -> np.ndarray:
        """Where the unit after so many starts; the last unit may end at the text's end symbol, which is no byte."""
        at = ends[np.maximum(first + units - 1, 0)] + 1 if len(ends) else np.zeros(len(units), np.int64)
        return np.where(units == 0, start, np.minimum(at, end - 1))

    a, b = place(np.minimum(one, two)), place(np.maximum(one, two))
    char = CHAR[emitted]
    chars = lambda lo, hi: np.array([np.count_nonzero(char[x:y]) for x, y in zip(lo, hi, strict=True)], np.int64)
    prefix_chars, middle_chars = chars(start, a), chars(a, b)
    out, form = [], []
    for d, p, lo, x, y, last in zip(data, plain, start, a - start, b - start, suffix_first, strict=True):
        if p:
            out.append(bytes(d))
            form.append("plain")
            continue
        d = memoryview(d)
        parts = (SUFFIX, d[y:], PREFIX, d[:x], MIDDLE, d[x:y]) if last else (PREFIX, d[:x], SUFFIX, d[y:], MIDDLE, d[x:y])
        out.append(b"".join(parts))
        form.append("spm" if last else "psm")
    return pa.StructArray.from_arrays(
        [pa.array(n_units, pa.int64()), pa.array(form, pa.string()), pa.array(prefix_chars, pa.int64(), mask=plain), pa.array(middle_chars, pa.int64(), mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
        ["n", "form", "prefix_chars", "middle_chars", "output"],
    )


def draws(key: Column, seed: str = "7:") -> list[Column]:
    """Four numbers below 2^32 from the SHA-256 of ``seed`` and a row's key."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def arranged(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: int = 100, spm: int = 50, seed: str = "7:") -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output.

    ``rate`` of a hundred texts are rearranged, and ``spm`` of a hundred of these have their suffix first.
    """

    def run(texts: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
        return rearranged(texts, *(h.to_numpy() for h in (h1, h2, h3, h4)), rate, spm)

    cut = F.arrow_udf(run, "n long, form string, prefix_chars long, middle_chars long, output string")
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    others = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    cells = docs.withColumn("_cut", cut(F.col(text), *draws(F.col(key), seed)))
    return cells.select(*others, *[F.col(f"_cut.{c}").alias(c) for c in names])


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from: what is between sentinels, of which the text had none."""
    part = F.split(output, "<[PSM]>", -1)
    at = lambda i: F.get(part, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(1), at(3), at(2))).otherwise(F.concat(at(2), at(3), at(1)))
