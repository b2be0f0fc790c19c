"""The pipeline's stages on a small table of odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quillon.llm import langid, unigram
from quillon.llm.queries import vocabulary


def test_stages(spark, odd, odd_rows, none):
    docs, sizes = odd.select(cp.COLUMNS), []
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, "").cache()
        sizes.append(docs.count())
        if name != "sentencepiece":
            assert docs.columns == cp.COLUMNS
        if name == "language_id":
            assert all(r["text"] and any(c.isalpha() for c in r["text"]) for r in docs.collect())
        if name == "jaccard_join":
            kept = [r["doc_id"] for r in docs.collect()]
            assert 18 not in kept and 21 not in kept and 15 in kept  # copies of document 15
    assert docs.filter("not round_trip").count() == 0 and sizes[-1] > 0
    empty = none.select(cp.COLUMNS)
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, "")
        assert empty.count() == 0


def test_repeated_row_survives_once(spark, odd, odd_rows):
    docs = odd.select(cp.COLUMNS)
    for stage in (cp.join_near_copies, cp.remove_repeated_strings):
        docs = stage(spark, docs, "").cache()
        assert [r["text"] for r in docs.filter("doc_id = 15").collect()] == [odd_rows[5][1]]


def test_rows_of_one_id_are_documents_of_their_own(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(9, text("a")), (2, text("a")), (9, text("b")), (2, text("c")), (2, text("c")), (7, text("c")), (1, text("d")), (None, text("a"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in cp.join_near_copies(spark, docs, "").collect())
    assert got == sorted([(2, text("a")), (9, text("b")), (2, text("c")), (1, text("d"))])  # null ids come last


# all stages, one after the other, in plain Python


def plain_languages(rows, model):
    packers = {}
    for lang, data in model.items():
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=langid.LEVEL)
        packers[lang] = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
    out = []
    for r in rows:
        if r[1] is not None and any(c.isalpha() for c in r[1]):
            size = {lang: len(p.compress(r[1].lower().encode())) for lang, p in packers.items()}
            if 1 / sum(2.0 ** (min(size.values()) - x) for x in size.values()) >= langid.NARROW:
                out.append(r)
    return out


def plain_one_of_each(rows, n=5, percent=80):
    rows = list(dict.fromkeys(rows))
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)})
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= percent * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    return [min((r for r, x in zip(rows, root, strict=True) if x == c), key=lambda r: (r[0] is None, r[0] or 0)) for c in sorted(set(root))]


def plain_cut(rows, width=200):
    raws = [r[1].encode() for r in rows]
    counts = Counter(b[k : k + width] for b in raws for k in range(len(b) - width + 1))
    out = []
    for r, b in zip(rows, raws, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if counts[b[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        text = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        if not any(gone) or text:
            out.append((r[0], text, r[2], r[3], len(text)))
    return out


def plain_mix(rows, block=256):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1]) for r in rows]
    names = sorted({r[3] for r in rows if r[3] is not None}, key=str.encode) + ([None] if any(r[3] is None for r in rows) else [])
    held = {s: sum(len(w) for r, w in zip(rows, words, strict=True) if r[3] == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    budget, full = 1.5 * sum(held.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        level = (budget - sum(2 * held[s] for s in full)) / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weight[s] * level >= 2 * held[s]}
        if not over:
            break
        full |= over
    target = {s: 2.0 * held[s] if s in full else weight[s] * level for s in names}
    total, hi, span = sum(target.values()), 0.0, {}
    for s in names:
        hi += target[s]
        span[s] = (math.floor((hi - target[s]) / total * 2**32), 2**32 if s == names[-1] else math.floor(hi / total * 2**32))
    slots = Counter()
    for j in range(math.ceil(total / block)):
        point = j * 2654435769 % 2**32
        slots[next(s for s in names if span[s][0] <= point < span[s][1])] += 1
    out = []
    for s in names:
        mine = sorted((hashlib.md5(f"mix:{'' if r[0] is None else r[0]}".encode()).hexdigest(), len(w), r, w) for r, w in zip(rows, words, strict=True) if r[3] == s)
        for pass_ in range(2):
            at = pass_ * held[s]
            for _, size, r, w in mine:
                take = max(0, min(at + size, slots[s] * block) - at)
                at += size
                if take:
                    text = r[1] if take >= size else " ".join(w[:take])
                    out.append((r[0], text, r[2], r[3], len(text)))
    return out


def test_all_stages_against_plain_ones(spark, odd, odd_rows, tmp_path):
    """The whole run, its tables and all, gives the rows that plain stages give, one after the other."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    shared = " ".join(word() for _ in range(70))
    more = [(1000 + i, f"{' '.join(word() for _ in range(rng.randint(30, 500)))} {shared if i % 5 == 0 else ''} é{i}", "en" if i % 2 else "de", ["a", "b", None, "c"][i % 4], 1) for i in range(40)]
    rows = [r[:5] for r in odd_rows] + more
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    want = plain_languages(rows, langid.learn(docs.filter(~langid.held_out(F.col("doc_id")))))
    sizes = [len(want)]
    for stage in (plain_one_of_each, plain_cut, plain_mix):
        want = stage(want)
        sizes.append(len(want))
    assert sizes[1] < sizes[0] and len({r[4] for r in want}) > 20
    got = cp.run(spark, str(tmp_path)).collect()
    model = unigram.load(vocabulary())
    texts = model.decode(pa.array([r["ids"] for r in got], pa.list_(pa.int32()))).to_pylist()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], t, r["lang"], r["source"], r["n_chars"]) for r, t in zip(got, texts, strict=True)), key=key) == sorted(want, key=key)
    assert all(r["round_trip"] for r in got)
