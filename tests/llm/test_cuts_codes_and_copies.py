"""Fill-in-middle, vector codes and exact deduplication against brute force on small tables of odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import exact_dedup, fill_in_middle, vector_codes

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()

# 11 fill-in-middle

UNITS = re.compile(r"[^\n]*\n|[^\n]+")


def plain_arranged(key, text, rate=100, spm=50):
    text = text or ""
    digest = sha("7:" + ("" if key is None else str(key)))
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    units = UNITS.findall(text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_lines():
    rng = random.Random(11)
    bits = ["a", "é", "漢", "🎉", "<", "P", "S", "M", ">", "\n", "\n\n", "\r\n", "<P", "S>", " ", "<<", "\0", " "]
    texts = [None, "", "\n", "a", "a\n", "\na", "<P>", "x<M>y\n", "<P\n>", "< P>", "<<S>", "<P", "🎉" * 70 + "\n" + "é" * 3, "\n" * 500, "line\n" * 3000, "漢" * 40_000, "<Pé>\n<S\n>M>"]
    return texts + ["".join(rng.choices(bits, k=rng.randint(1, 60))) for _ in range(400)]


def test_fill_in_middle(spark, none):
    rows = [(i, t, "mine", i) for i, t in enumerate(odd_lines())]
    rows += [rows[14], (None, "one\ntwo\nthree\n", "mine", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(3)
    for rate, spm in ((100, 50), (60, 0)):
        out = fill_in_middle.arranged(docs, rate=rate, spm=spm).withColumn("again", fill_in_middle.restored(F.col("output"), F.col("form")))
        got = sorted((tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "again")) for r in out.collect()), key=str)
        assert got == sorted(((k, *plain_arranged(k, t, rate, spm), t or "") for k, t, *_ in rows), key=str)
    assert {r["form"] for r in fill_in_middle.arranged(docs).collect()} == {"plain", "spm", "psm"}
    assert fill_in_middle.arranged(none).count() == 0


@pytest.mark.parametrize(("block", "lanes"), [(64, 1), (100, 7), (4096, 64), (1 << 22, 8192)])
def test_transitions_are_those_of_one_walk(block, lanes):
    """Lanes and blocks of any size emit what a byte-by-byte walk emits, also on bytes that are no UTF-8."""
    rng = random.Random(12)
    data = bytes(rng.choice([0x3C, 0x50, 0x3E, 0x0A, 0xF0, 0x9F, 0x8E, 0x89, 0xC3, 0xA9, 0xE2, 0x80, 0xFF, 0xC0, 0x41]) for _ in range(5000))
    symbols = fill_in_middle.CLASS[np.frombuffer(data, np.uint8)]
    symbols[rng.sample(range(5000), 60)] = fill_in_middle.END
    state, walk = fill_in_middle.START, []
    for s in symbols.tolist():
        walk.append(state * fill_in_middle.SYMBOLS + s)
        state = fill_in_middle.NEXT[walk[-1]]
    assert fill_in_middle.transitions(symbols, block, lanes).tolist() == walk


def test_characters_are_counted_by_the_tables():
    text = "aé漢🎉\n<P> "
    symbols = np.append(fill_in_middle.CLASS[np.frombuffer(text.encode(), np.uint8)], fill_in_middle.END).astype(np.uint8)
    emitted = fill_in_middle.transitions(symbols)
    assert fill_in_middle.CHAR[emitted].sum() == len(text)
    assert fill_in_middle.UNIT[emitted].sum() == 2
    assert fill_in_middle.SENTINEL[emitted].sum() == 1


# 12 vector codes


def plain_codes(rows, parts, entries, rounds):
    """Every distance to every entry, in Python's own integers."""
    fine = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    fine.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    fine = [r for r in fine if len(r[2]) == len(fine[0][2])]
    width = len(fine[0][2]) // parts
    cut = lambda q, p: q[p * width : (p + 1) * width]
    books = [[cut(q, p) for _, _, q in fine[:entries]] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for _, _, q in fine:
                held[near(p, cut(q, p))[1]].append(cut(q, p))
            books[p] = [[sum(x) // len(x) for x in zip(*held[e], strict=True)] if e in held else c for e, c in enumerate(books[p])]
    out, by_label = [], Counter()
    for i, label, q in fine:
        best = [near(p, cut(q, p)) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
        by_label[label] += out[-1][3]
    digest = sha(",".join(str(x) for b in books for c in b for x in c))
    return [(i, label, code, error, by_label[label], digest) for i, label, code, error in out]


def odd_vectors(n=300, dim=32, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(i, [0, 1, None][i % 3], [float(x) for x in rng.choice([0.1, -0.2, 1 / 256, -1e-9], dim) * rng.integers(-9, 9, dim)]) for i in range(n)]
    rows[5], rows[9] = (5, 0, None), (9, 0, [1.0, None] * (dim // 2))
    rows[12], rows[20], rows[21] = (12, 1, [float("nan")] * dim), (20, 1, [float("inf")] + [0.0] * (dim - 1)), (21, 1, [])
    rows[30], rows[31] = (30, 2, [0.5] * (dim - 1)), (31, 2, [0.5] * (2 * dim))  # other lengths
    rows[40], rows[41] = (40, None, [0.25] * dim), (40, 3, [0.125] * dim)  # an id twice
    return [*rows, rows[50], (None, 3, [0.75] * dim)]


def test_vector_codes(spark):
    rows = odd_vectors()
    table = spark.createDataFrame([(*r, "mine") for r in rows], "vec_id long, label int, embedding array<double>, code string").repartition(5)
    for entries, rounds in ((64, 2), (5, 3), (64, 0)):
        got = [tuple(r) for r in vector_codes.compressed(table, entries=entries, rounds=rounds).collect()]
        assert sorted(got, key=str) == sorted(plain_codes(rows, 16, entries, rounds), key=str)
    assert vector_codes.compressed(table.limit(0)).collect() == []
    assert vector_codes.compressed(table.filter("vec_id in (5, 12)")).collect() == []
    few = [r for r in rows if r[0] in (0, 1, 2)]
    got = [tuple(r) for r in vector_codes.compressed(table.filter("vec_id in (0, 1, 2)")).collect()]
    assert sorted(got) == sorted(plain_codes(few, 16, 64, 2))


def test_filter_is_exact_and_filters():
    rng = np.random.default_rng(6)
    for low, high, width in ((-3, 3, 2), (-300, 300, 4), (-(1 << 24), 1 << 24, 6)):
        entries, q = rng.integers(low, high, (64, width)), rng.integers(low, high, (3000, width))
        index, error = vector_codes.Filter(entries).nearest(q)
        far = ((q[:, None, :] - entries) ** 2).sum(2)
        assert (error == far.min(1)).all() and (index == far.argmin(1)).all()  # argmin takes the first of ties


def test_large_components_stop(spark):
    rows = [(1, 0, [1e30] * 16), (2, 0, [-1e30] * 16), (3, 0, [float(2**16)] * 16)]
    out = {r["vec_id"]: r for r in vector_codes.compressed(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    assert out[1]["code"] == out[3]["code"] != out[2]["code"]
    assert all(r["error"] == 0 for r in out.values())


# 13 exact deduplication


def plain_copies(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[text or ""].append(key)
    out = []
    for text, keys in groups.items():
        top = max((k for k in keys if k is not None), default=None)
        left = True
        for k in keys:
            out.append((k, top, len(keys), left and k == top, sha(text)))
            left = left and k != top
    return sorted(out, key=str)


def test_exact_dedup(spark, odd, odd_rows, none):
    got = sorted((tuple(r) for r in exact_dedup.dedup(odd).collect()), key=str)
    assert got == plain_copies([(r[0], r[1]) for r in odd_rows])
    assert exact_dedup.dedup(none).collect() == []


def test_exact_dedup_splits_and_pages(spark, monkeypatch):
    """A small capacity: the directory doubles, and one text with a third of all rows gets pages whose chains are put together."""
    rng = random.Random(13)
    texts = ["the same text " * 20 if rng.random() < 0.35 else f"text {rng.randint(0, 900)} " * rng.randint(1, 9) for _ in range(3000)] + ["", None, "é" * 70_000]
    rows = list(enumerate(texts)) + [(None, "alone"), (None, "alone"), (7, texts[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(13)
    index, directory = exact_dedup.build(docs, capacity=2000)
    assert directory.depth > 7 and max(directory.pages) > 20 and len(directory.local) > 128
    assert index.filter("paged").select("page").distinct().count() > 1
    monkeypatch.setattr(exact_dedup, "HELD_IDS", 40)  # tasks send a text several times
    got = sorted((tuple(r) for r in exact_dedup.dedup(docs, capacity=2000).collect()), key=str)
    assert got == plain_copies(rows)


def test_exact_dedup_compares_texts_of_one_key(spark, monkeypatch):
    """Other texts with one key stay apart: chains tell them by their bytes."""
    real = F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: real(F.length(c)))
    rows = [(i, t) for i, t in enumerate(["aa", "bb", "aa", "cc", "c", "bb", "dd", "", None, "aa"] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for capacity in (50, 1 << 20):
        assert sorted((tuple(r) for r in exact_dedup.dedup(docs, capacity=capacity).collect()), key=str) == plain_copies(rows)


def test_exact_dedup_after_a_change(spark):
    docs = spark.createDataFrame([(1, "Ab"), (2, "aB "), (3, "x")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in exact_dedup.dedup(docs, normal=lambda c: F.lower(F.trim(c))).collect()}
    assert out[1]["keep_id"] == 2 and out[2]["kept"] and out[2]["text_sha256"] == sha("ab") and out[3]["group_size"] == 1


def test_directory_is_extendible():
    loads = np.zeros(256, np.int64)
    loads[7], loads[8:16], loads[200] = 1000, 30, 90
    d = exact_dedup.Directory(loads, 100, 1, 8)
    assert d.depth == 8 and (1 << d.depth) == len(d.slots)
    keys = (np.arange(256, dtype=np.uint64) << np.uint64(56)).view(np.int64)
    b = d.bucket(keys)
    held = np.bincount(b, weights=loads, minlength=len(d.local))
    assert [d.load(x) for x in range(len(d.local))] == held.tolist()
    assert d.pages[b[7]] == 10 and all(held[x] <= 100 for x in range(len(held)) if x != b[7])
    for x in range(len(d.local)):  # a bucket's slots share its bits, and no other bucket's
        slots = np.flatnonzero(d.slots == x)
        assert len(slots) == 1 << (d.depth - d.local[x]) and len(set(slots >> (d.depth - d.local[x]))) == 1
    base, owner = d.owners(5)
    assert len(owner) == d.pages.sum() and sorted(set(owner)) == list(range(5)) and (np.diff(owner) >= 0).all()
