"""Each operator against brute force on a small table of odd rows, and on an empty one."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import components, embedding_dedup, fingerprints, induced_sort, jaccard_join, kernels, langid, lm_scoring, mixing, repeats, substring_dedup, suffix_dedup, unigram, url_filter
from quillon.llm.queries import vocabulary

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPLIT.findall(text or "")


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def distinct_ids(rows):
    """Rows by doc_id, without null ids; repeated rows are equal here."""
    return {r[0]: r[1] for r in rows if r[0] is not None}


# 1 URL filters


def test_url_rules_and_model(spark):
    urls = [
        ("http://ththre.Example.com/fr/825?p=2", "ththre.example.com", "/fr/825", "com/", "allow"), ("http://m.example.com/en/1", "m.example.com", "/en/1", "example.com/en/", "block"),
        ("https://www.example.com/en/1#t", "www.example.com", "/en/1", "www.example.com/en/", "allow"), ("x://a.net/es/", "a.net", "/es/", "net/es/", "block"), ("x://net/fr/2", "net", "/fr/2", "net/fr/", "block"),
        ("x://planet/fr/2", "planet", "/fr/2", None, None), ("x://a.com", "a.com", "", None, None), ("x://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), (None, "", "", None, None), ("", "", "", None, None),
        ("no scheme", "", "", None, None), ("a://b://c/d", "b:", "//c/d", None, None), ("x://É.COM/" + "z" * 9000, "É.com", "/" + "z" * 9000, "com/", "allow"), ("x://h?q/x", "h", "", None, None),
    ]
    pages = spark.createDataFrame([(i, u[0], "mine") for i, u in enumerate(urls)] * 2, "page_id long, url string, rule string")
    got = sorted(url_filter.judge(pages).collect(), key=lambda r: r["page_id"])
    assert len(got) == 2 * len(urls)
    weights = url_filter.fit(spark)
    for r in got:
        _, host, path, rule, verdict = urls[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["p_block"] >= 0.5 else "allow"))
    assert len(weights) == 2 * url_filter.DIM + 1
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_model_is_the_primal_descent(spark):
    """The dual descent gives the weights of plain gradient descent, and separates its table."""
    rows = spark.createDataFrame([(u, y) for u, y in url_filter.LABELLED], "url string, y int")
    rows = rows.withColumns({"host": url_filter.host_of(F.col("url")), "path": url_filter.path_of(F.col("url"))}).withColumn("slots", url_filter.grams(F.col("host"), F.col("path"))).collect()
    x = np.zeros((len(rows), 2 * url_filter.DIM + 1))
    for i, r in enumerate(rows):
        x[i, r["slots"]] = 1 / math.sqrt(len(r["slots"]))
    y, w = np.array([r["y"] for r in rows], float), np.zeros(x.shape[1])
    for _ in range(url_filter.STEPS):
        w = (1 - url_filter.RATE * url_filter.DECAY) * w + url_filter.RATE / len(y) * x.T @ (y - 1 / (1 + np.exp(-x @ w)))
    got = np.array(url_filter.fit(spark))
    assert np.allclose(got, w, atol=1e-6)
    assert np.mean((x @ got > 0) == (y == 1)) > 0.9


def test_url_scores_are_the_model_by_hand(spark):
    """p_block from weights and hashed character n-grams, counted in plain Python."""
    import xxhash

    urls = [r[0] for r in url_filter.LABELLED[:12]] + ["x://new.example.org/some/long/path", "x://a/", None, "x://h"]
    pages = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(urls)], "page_id long, url string, _rule string")
    weights = url_filter.fit(spark)
    slot = lambda text, n, i: xxhash.xxh64(text[i : i + n].encode(), seed=42).intdigest()
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def grams(text, first):
        return {signed(slot(text, n, i)) % url_filter.DIM + first for n in url_filter.SIZES for i in range(len(text) - n + 1)}

    for r in url_filter.judge(pages).collect():
        slots = (grams(f"^{r['host']}$", 0) if r["host"] else set()) | grams(r["path"], url_filter.DIM) | {2 * url_filter.DIM}
        z = sum(weights[i] for i in slots) / math.sqrt(len(slots))
        assert r["p_block"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9) and r["_rule"] == "kept"


# 2 SentencePiece


def test_pieces_come_back_and_score_best(spark, odd, none):
    rows = unigram.encoded(odd, vocabulary()).collect()
    assert all(r["decoded"] == r["text"] for r in rows) and any(r["text"] is None and r["ids"] is None for r in rows)
    assert unigram.encoded(none, vocabulary()).count() == 0
    model = unigram.load(vocabulary())
    pieces = {p: i for i, (p, _, kind) in enumerate(unigram.read_model(vocabulary())) if kind in (unigram.NORMAL, unigram.USER)}

    def best(text):  # plain Viterbi over characters of the whole marked text
        s = (" " + text).replace(" ", unigram.MARK)
        top = [0.0] + [-math.inf] * len(s)
        for i in range(len(s)):
            for j in range(i + 1, min(len(s), i + 48) + 1):
                if (p := pieces.get(s[i:j])) is not None:
                    top[j] = max(top[j], top[i] + model.score[p])
            if s[i] not in pieces:
                top[i + 1] = max(top[i + 1], top[i] + model.unknown)
        return top[-1]

    import pyarrow as pa

    for text in ("the the", "hello  world\n\tx", "naïve 漢字", "internationalization of " * 5, "a" * 200, " lead", "trail  "):
        ids = model.encode(pa.array([text]))[0].as_py()
        byte_ids = set(model.byte_id.tolist())
        score, i = 0.0, 0
        while i < len(ids):
            if ids[i] in byte_ids:
                n = {0: 1, 1: 1, 2: 2, 3: 3, 4: 4}[len(bytes([int(np.flatnonzero(model.byte_id == ids[i])[0])]).hex()) and (1 if (b := int(np.flatnonzero(model.byte_id == ids[i])[0])) < 192 else 2 if b < 224 else 3 if b < 240 else 4)]
                score, i = score + model.unknown, i + n
            else:
                score, i = score + model.score[ids[i]], i + 1
        assert score == pytest.approx(best(text))
    out = model.decode(pa.array([[10**6, -1, None, 1, model.byte_id[0xFF]], None, []], pa.list_(pa.int32()))).to_pylist()
    assert out == ["�", None, ""]


def test_columns_with_the_operators_names_are_replaced(spark):
    docs = spark.createDataFrame([(1, "the cat", "old", 5.0, "x")], "doc_id long, text string, ids string, n_tokens double, keep string")
    row = unigram.encoded(docs, vocabulary()).first()
    assert row["decoded"] == "the cat" and row["n_tokens"] == len(row["ids"]) and row["keep"] == "x"
    docs = spark.createDataFrame([(1, "the cat", "old", "y", "x")], "doc_id long, text string, lang_pred string, _judged string, keep string")
    row = langid.classified(docs, {"en": b"the cat sat", "de": b"die katze"}).first()
    assert row["lang_pred"] in ("en", "de") and row["_judged"] == "y" and row["keep"] == "x"


def test_columns_are_encoded_and_decoded(spark, odd, odd_rows):
    encode, decode = unigram.coder(spark, vocabulary())
    got = odd.select("text", encode(F.col("text")).alias("ids")).select("text", "ids", decode(F.col("ids")).alias("back")).collect()
    assert len(got) == len(odd_rows) and all(r["back"] == r["text"] and (r["ids"] is None) == (r["text"] is None) for r in got)


def test_literal_marker_comes_back():
    import pyarrow as pa

    model = unigram.load(vocabulary())
    texts = ["a▁b", "▁", "▁ ▁", "x ▁y"]
    assert model.decode(model.encode(pa.array(texts))).to_pylist() == texts


# 3 fingerprints


def test_fingerprints(spark, odd, odd_rows, none):
    got = fingerprints.with_edits(odd).collect()
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in order]
    want = Counter()
    for i, (r, t) in enumerate(zip(order, texts, strict=True)):
        k = len(t) // 4
        want[(r[0], len(t), hashlib.sha256((t[: len(t) - k] + texts[(i + 1) % len(texts)][:k]).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    by_text = {}
    text_of = {r[0]: r[1] or "" for r in odd_rows}
    for r in got:
        by_text.setdefault(text_of[r["doc_id"]], set()).add(tuple(r["vec"]))
    assert all(len(v) == 1 for v in by_text.values())
    assert len(set().union(*by_text.values())) == len({tuple(sorted(x for x in t.split("\n") if x)) for t in by_text})
    assert fingerprints.with_edits(none).count() == 0


def test_fingerprint_is_homomorphic(spark):
    df = spark.createDataFrame([("ab", "p one\np two"), ("ba", "p two\np one"), ("a", "p one"), ("b", "p two"), ("", "")], "k string, text string")
    vec = {r["k"]: r for r in fingerprints.sums(df, ["k", "text"], "text").select("k", fingerprints.lanes("acc").alias("v")).collect()}
    v = spark.createDataFrame([tuple(vec[k]["v"] for k in ("ab", "ba", "a", "b", ""))], "ab array<long>, ba array<long>, a array<long>, b array<long>, e array<long>")
    r = v.select((F.col("ab") == F.col("ba")).alias("x"), (fingerprints.plus(F.col("a"), F.col("b")) == F.col("ab")).alias("y"), (fingerprints.minus(F.col("ab"), F.col("b")) == F.col("a")).alias("z"), fingerprints.likeness(F.col("ab"), F.col("ba")).alias("same"), fingerprints.likeness(F.col("e"), F.col("a")).alias("none")).first()
    assert (r["x"], r["y"], r["z"], r["same"], r["none"]) == (True, True, True, 1.0, 0.0)


def test_likeness_is_near_exact_shares(spark):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    assert fingerprints.SIGNS == 128
    for size, off in ((40, 0.1), (64, 0.1), (200, 0.1), (3200, 0.05)):
        docs = spark.createDataFrame([(i, text(size)) for i in range(60)], "doc_id long, text string")
        got = fingerprints.with_edits(docs).select(fingerprints.likeness(F.col("vec"), F.col("edited_vec")).alias("e"), fingerprints.likeness(F.col("vec"), F.col("next_vec")).alias("x"), F.size("vec").alias("n")).collect()
        assert all(r["n"] == 8 + 128 for r in got)
        assert sum(r["e"] for r in got) / len(got) == pytest.approx(0.75, abs=off)  # the edit replaces a quarter
        assert sum((r["e"] - 0.75) ** 2 for r in got) / len(got) < 0.12**2
        assert sum(r["x"] for r in got) / len(got) < 0.1  # nothing is shared

# 4 embeddings


def test_embedding_links(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 16))
    rows = [(i, (centres[i % 30] + 0.16 * rng.standard_normal(16)).tolist(), i % 3) for i in range(300)]
    rows += [(300, rows[7][1], rows[7][2]), (301, None, 1), (302, [0.0] * 16, 1), (303, [float("nan")] * 16, 1), (304, [None] * 16, 1), (305, rows[1][1], None), (306, [], 1), (307, [float("inf")] + [1.0] * 15, 1), (308, [1.0, 2.0], 1), (309, [x * 1e30 for x in rows[4][1]], rows[4][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, kept string")
    good = {i: (np.array(v), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: {j for j, (w, m) in good.items() if j != i and m == lab and len(w) == len(v) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93} for i, (v, lab) in good.items()}
    root = {i: i for i, *_ in rows}
    for _ in rows:
        for i, js in links.items():
            root[i] = min([root[i], *(root[j] for j in js)])
    got = embedding_dedup.near_duplicates(df).collect()
    exact = sum(r["n_links"] == len(links.get(r["vec_id"], ())) for r in got)
    assert len(got) == len(rows) and all(r["n_links"] <= len(links.get(r["vec_id"], ())) for r in got)  # none below the threshold
    assert sum(r["n_links"] for r in got) >= 0.99 * sum(map(len, links.values())) and exact >= 0.97 * len(rows)
    assert sum(r["component_id"] == root[r["vec_id"]] for r in got) >= 0.97 * len(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_rows_that_share_a_vec_id_keep_their_own_links(spark):
    rows = [(1, [1.0, 0.0, 0.0, 0.0], 0), (1, [0.0, 1.0, 0.0, 0.0], 0), (2, [1.0, 0.001, 0.0, 0.0], 0), (3, [0.0, 0.0, 1.0, 0.0], 0), (3, [0.0, 0.0, 1.0, 0.0], 0), (1, [1.0, 0.0, 0.0, 0.0], 1), (0, [0.0, 0.999, 0.02, 0.0], 0), (None, [1.0, 0.0, 0.0, 0.0], 0)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(i, v, label) for i, v, label in rows], "vec_id long, embedding array<double>, label int")).collect()
    want = [(1, 1, 1), (1, 1, 0), (2, 1, 1), (3, 1, 3), (3, 1, 3), (1, 0, 1), (0, 1, 0), (None, 0, None)]
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == sorted(want, key=str)


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(1)
    y = rng.standard_normal((200, 8)) * 2
    p = embedding_dedup.nearest(y)
    around = p[:, None, :] + embedding_dedup.NEIGHBOURS
    assert len(embedding_dedup.NEIGHBOURS) == 240
    assert (((y - p) ** 2).sum(1)[:, None] <= ((y[:, None, :] - around) ** 2).sum(2) + 1e-9).all()
    assert ((p * 2 % 1 == 0).all(1) & (p.sum(1) % 2 == 0)).all()


@pytest.fixture(scope="module")
def shared_ids(spark, odd_rows):
    """Rows with equal and null doc_ids and texts of other lengths, that repeat each other and themselves."""
    base = next(r[1] for r in odd_rows if r[0] == 15)
    cut = base.split()
    texts = [base, " ".join(cut[:90]), " ".join(cut[40:200]) + " x " + " ".join(cut[60:180]), None, base + " tail", " ".join(cut[::-1]), " ".join(cut[:150] * 2), " ".join([*cut[:30], "y", *cut[31:200]])]
    rows = [(i, t) for i, t in zip([7, 7, 7, 7, 2, 2, None, 9], texts, strict=True)] + [(None, base), (7, base), (9, texts[7]), (None, None), (11, " ".join(cut[10:120]))]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()


# 5 Jaccard join


def shingles(text, n):
    w = words(ascii_lower(text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def classes_of(rows, n, percent):
    """(doc_id, size, component) of each row, by comparing all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return sorted(((d, len(s), least.get(r)) for (d, _), s, r in zip(rows, sets, root, strict=True)), key=str)


@pytest.mark.parametrize("n,percent", [(4, 85), (1, 50)])
def test_jaccard_join(spark, odd, odd_rows, none, shared_ids, n, percent):
    for rows, docs in (([r[:2] for r in odd_rows], odd), shared_ids)[: 2 if n == 4 else 1]:
        got = jaccard_join.join(docs, n, percent).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == classes_of(rows, n, percent)
    if n == 1:
        return
    assert jaccard_join.join(none, n, percent).count() == 0
    blank = spark.createDataFrame([(None, None), (1, None), (2, " ")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.join(blank).collect()), key=str) == [(1, 0, 1), (2, 0, 2), (None, 0, None)]


def test_jaccard_join_of_near_copies_that_do_not_all_link(spark, monkeypatch, block=300, members=7):
    """Copies with several edits each, of which few pairs are alike enough; small blocks change nothing."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "MEMBERS", members)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(60)] = f"e{rng.randrange(8)}"
        rows.append((1000 - i, " ".join(t[rng.randint(0, 3) :])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_join.join(docs, 4, 85).collect()
    want = classes_of(rows, 4, 85)
    assert 5 < len({c for _, _, c in want}) < 115
    assert sorted((tuple(r) for r in got), key=str) == want


def test_self_join_and_parity():
    rng = np.random.default_rng(4)
    sets = [np.sort(rng.choice(70, rng.integers(1, 50), replace=False)).astype(np.uint64) for _ in range(120)]
    sets += [np.sort(np.append(sets[i][1:], np.uint64(200 + i))) for i in range(40)]
    ties = rng.integers(0, 30, len(sets))
    for percent in (30, 60, 85):
        want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and ties[i] != ties[j] and 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))}
        assert set(jaccard_join.self_join(sets, ties, percent)) == want
    sizes, bits = np.array([len(x) for x in sets]), [jaccard_join.parity(x) for x in sets]
    for percent in (50, 85):
        linked = {k for i, j in jaccard_join.self_join(sets, ties, percent) for k in (i, j)}
        may = set(np.flatnonzero(jaccard_join.partners(sizes, ties, bits, percent)).tolist())
        assert linked <= may and len(may) < len(sets)


def test_tree_finds_all_links():
    rng = np.random.default_rng(2)
    sets = [(i, np.sort(rng.choice(60, rng.integers(1, 40), replace=False)).astype(np.uint64)) for i in range(150)]
    root = jaccard_join.tree(sets)
    for _, probe in sets[:40]:
        for percent in (30, 60, 85):
            want = {i for i, s in sets if 100 * len(np.intersect1d(s, probe)) >= percent * len(np.union1d(s, probe))}
            assert set(jaccard_join.matches(root, probe, percent)) == want


# 6 and 8, repeats


def removed_words(rows, width):
    first = {}
    for i, t in rows:
        w = words(t or "")
        for k in range(len(w) - width + 1):
            if i is not None:
                first[tuple(w[k : k + width])] = min(i, first.get(tuple(w[k : k + width]), i))
    out = []
    for i, t in rows:
        w, gone = words(t or ""), set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def removed_bytes(rows, width):
    raws = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(b[k : k + width] for _, b in raws for k in range(len(b) - width + 1))
    out = []
    for i, b in raws:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if counts[b[k : k + width]] > 1:
                gone[k : k + width] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, *(x or 0 if k == 0 else x for k, x in enumerate(r))))


@pytest.mark.parametrize("flags", [1 << 29, 0])
def test_substring_dedup(spark, odd, odd_rows, none, shared_ids, flags, monkeypatch):
    monkeypatch.setattr(repeats, "FLAGS", flags)  # above it, texts are joined with what is wanted of them
    for rows, docs, width in (([r[:2] for r in odd_rows], odd, 20), (*shared_ids, 20)):
        want = removed_words(rows, width)
        assert any(r[2] for r in want)
        assert by_id((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.dedup(docs, width).collect()) == by_id(want)
    assert substring_dedup.dedup(none, width).count() == 0
    blank = spark.createDataFrame([(None, None), (1, None)], "doc_id long, text string")
    assert [tuple(r) for r in substring_dedup.dedup(blank).select("n_words", "n_removed", "kept").collect()] == [(0, 0, "")] * 2


@pytest.mark.parametrize("flags", [1 << 29, 0])
def test_suffix_array_dedup(spark, odd, odd_rows, none, shared_ids, flags, monkeypatch):
    monkeypatch.setattr(repeats, "FLAGS", flags)
    for rows, docs, width in (([r[:2] for r in odd_rows], odd, 60), (*shared_ids, 60)):
        want = removed_bytes(rows, width)
        assert any(r[2] for r in want)
        # input columns with the operator's inner names stay
        docs = docs.withColumns({c: F.lit(c) for c in ("_id", "_spans", "_kept")})
        got = suffix_dedup.dedup(docs, width).collect()
        assert by_id((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == by_id(want)
        assert all(r["_id"] == "_id" and r["_kept"] == "_kept" for r in got)
    assert suffix_dedup.dedup(none, width).count() == 0
    blank = spark.createDataFrame([(None, None), (1, None)], "doc_id long, text string")
    assert [tuple(r) for r in suffix_dedup.dedup(blank).select("n_bytes", "n_removed", "n_spans").collect()] == [(0, 0, 0)] * 2


def test_induced_order_with_common_prefixes():
    """Against plain sorting, with blocks, queues and base cases so small that everything spills and recurses."""
    rng, spilled = np.random.default_rng(1), 0
    for k in range(120):
        n, cap = int(rng.integers(1, 300)), int(rng.choice([3, 7, 50, 1000]))
        text = rng.integers(1, int(rng.choice([2, 3, 4, 20, 2000])), n)
        if k % 3 == 0 and n > 20:
            text = np.tile(text[: int(rng.integers(2, 20))], n)[:n]
        text = np.append(text, 0).astype(np.uint16)
        with induced_sort.Scratch() as scratch:
            order, common = induced_sort.sort_suffixes(text, cap, int(rng.choice([0, 100, 10_000])), scratch, int(rng.choice([1, 5, 50])))
            order, common, spilled = order.tolist(), common.tolist(), spilled + scratch.spilled
        assert not os.path.exists(scratch.folder) and sorted(order) == list(range(n + 1))
        heads = [text[i : i + cap].tolist() for i in order]
        assert heads == sorted(heads)
        assert common == [0] + [next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(heads, heads[1:], strict=False)]
    assert spilled > 1000


@pytest.mark.parametrize(("n", "levels"), [(78_000, 0), (3_600_000, 1)])
def test_the_query_s_limits_sweep_and_recurse(n, levels, monkeypatch):
    """A shard as small as sf0.01's goes through sweeps and queues, one of some millions recurses too, at the operator's own limits."""
    rng = np.random.default_rng(2)
    text = rng.integers(2, 28, n).astype(np.uint16)
    for _ in range(40):  # passages that repeat
        a, b = rng.integers(0, n - 1000, 2)
        text[b : b + 700] = text[a : a + 700].copy()
    text = np.append(text, 0).astype(np.uint16)
    calls, induced, reduced = Counter(), induced_sort._induced, induced_sort._reduced
    monkeypatch.setattr(induced_sort, "_induced", lambda *a: calls.update(["sweeps"]) or induced(*a))
    monkeypatch.setattr(induced_sort, "_reduced", lambda *a: calls.update(["levels"]) or reduced(*a))
    with induced_sort.Scratch() as scratch:
        order, common = induced_sort.sort_suffixes(text, 200, suffix_dedup.SORT_MEMORY, scratch, suffix_dedup.IN_MEMORY)
        order, common = np.array(order), np.array(common)
    assert calls["sweeps"] == levels + 1 and calls["levels"] == levels
    assert (np.sort(order) == np.arange(n + 1)).all()
    again, prefix = induced_sort.doubling(text, 200)
    assert (np.sort(order[common >= 200]).size == np.sort(again[prefix >= 200]).size) and (common == prefix).all()


def test_suffix_array_dedup_spills_and_recurses(spark, shared_ids, monkeypatch):
    """The query's own shards with 64 bytes of memory: the same rows."""
    monkeypatch.setattr(suffix_dedup, "SORT_MEMORY", 64)
    monkeypatch.setattr(suffix_dedup, "IN_MEMORY", 40)
    rows, docs = shared_ids
    got = suffix_dedup.dedup(docs, 60).collect()
    assert by_id((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == by_id(removed_bytes(rows, 60))


def test_kernels_against_plain_python():
    import pyarrow as pa

    texts = ["a b", None, "", " c  d e", "é\u2003f g\x1ch"]
    for _, data, offsets in kernels.chunks(pa.array(texts), 4):
        starts, ends, first = kernels.words(data, offsets)
        raw = data.tobytes()
        for i in range(len(offsets) - 1):
            assert [raw[a:b] for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)] == raw[offsets[i] : offsets[i + 1]].split()
    values = np.random.default_rng(0).integers(0, 5, 200).astype(np.uint64)
    for width in (1, 2, 3, 7, 64, 200):
        assert kernels.sliding_argmin(values << np.uint64(32) | values[::-1], width).tolist() == [i + int(values[i : i + width].argmin()) for i in range(200 - width + 1)]
    h = kernels.window_hashes(values, 3)
    assert len(set(h.tolist())) == len({tuple(values[i : i + 3]) for i in range(198)})


# 7 language-model scores


def plain_scores(texts, corpus, order):
    """(words, score) of each text: stupid backoff, counted and looked up in plain Python."""
    tokens = [words(ascii_lower(t or "")) for t in corpus]
    counts = [Counter(tuple(t[i : i + n]) for t in tokens for i in range(len(t) - n + 1)) for n in range(1, order + 1)]
    total, out = max(1, sum(map(len, tokens))), []
    for text in texts:
        t, s = words(ascii_lower(text or "")), 0.0
        for j in range(len(t)):
            top = min(order, j + 1)
            for n in range(top, 0, -1):
                gram = tuple(t[j - n + 1 : j + 1])
                c = counts[n - 1][gram] or (n == 1)
                if c:
                    s += math.log(c / (counts[n - 2][gram[:-1]] if n > 1 else total)) + (top - n) * math.log(lm_scoring.ALPHA)
                    break
        out.append((len(t), s))
    return out


def same_scores(got, texts, want):
    left = sorted((r["n_words"], r["log_score"]) for r in got)
    assert len(left) == len(want)
    for a, b in zip(left, sorted((n, round(s, 4)) for n, s in want), strict=True):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], abs=2e-4, rel=1e-9)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_count_every_ngram(spark, odd, odd_rows, none, order):
    texts = [r[1] for r in odd_rows]
    want = plain_scores(texts, texts, order)
    same_scores(lm_scoring.scored(odd, order=order).collect(), texts, want)
    if order != 3:
        return
    for kinds in (dict(hot=0.01, rows=100), dict(hot=1.0)):  # parts and frequent n-grams change nothing
        same_scores(lm_scoring.Model(odd, order, **kinds).scores().collect(), texts, want)
    assert lm_scoring.scored(none, order=order).count() == 0
    by_id = {r["doc_id"]: r for r in lm_scoring.scored(odd, order=order).collect()}
    assert by_id[0]["n_words"] == 0 and by_id[0]["log_score"] == 0 and by_id[0]["mean_log_score"] is None


def test_scores_of_rows_that_share_a_doc_id(spark):
    texts = ["a b c", "a b c d e f g h", None, "a b c"]
    docs = spark.createDataFrame([(1, t) for t in texts[:3]] + [(None, texts[3])], "doc_id long, text string")
    same_scores(lm_scoring.scored(docs).collect(), texts, plain_scores(texts, texts, 3))


def test_scores_by_slices(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(lm_scoring, "MANY", 10)
    same_scores(lm_scoring.Model(docs, 3, slices=4, rows=50).scores().collect(), texts, plain_scores(texts, texts, 3))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_by_another_corpus_back_off(spark, odd, odd_rows, none, order):
    texts = [r[1] for r in odd_rows]
    corpus = [t[: len(t) // 2] for t in texts if t] + ["one two words and", None]
    other = spark.createDataFrame([(i, t) for i, t in enumerate(corpus)], "doc_id long, text string")
    same_scores(lm_scoring.scored(odd, other, order=order).collect(), texts, plain_scores(texts, corpus, order))
    if order != 3:
        return
    assert lm_scoring.scored(none, other, order=order).count() == 0
    same_scores(lm_scoring.scored(other, none, order=order).collect(), corpus, plain_scores(corpus, [], order))
    same_scores(lm_scoring.scored(odd, odd, order=order).collect(), texts, plain_scores(texts, texts, order))


def test_scores_by_part_of_a_table_in_slices(spark, monkeypatch):
    """Held-out texts took rows of five keys an n-gram, in joins; now runs ask once for each n-gram, and a frequent one has a row a run, not one an occurrence."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["a", "a", "a", *"bcdefghijklmnop"]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(lm_scoring, "MANY", 10)
    monkeypatch.setattr(lm_scoring, "RUN", 500)
    model = lm_scoring.Model(docs, 3, slices=4, rows=1000, corpus=F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 3 != 1))  # null: not in the corpus
    same_scores(model.scores().collect(), texts, plain_scores(texts, [t for i, t in enumerate(texts) if i % 5 and i % 3 != 1], 3))
    runs = model.texts.coalesce(1).mapInArrow(lm_scoring._gather, "run long, words long, counted long, data binary")
    (run,) = map(lm_scoring.Run, (r["data"] for r in runs.collect()))
    key, ends = run.grams(3)
    sent = 0
    for number in range(3):
        for _, k, c in (lm_scoring._unpack(r["data"], *lm_scoring._KINDS) for r in runs.mapInArrow(lm_scoring._dealer(3, number, 3, 2), "part int, run long, data binary").collect()):
            assert len(set(k.tolist())) == len(k) == len(c)
            sent += len(k)
    assert sent == len(set(key.tolist())) < sum(map(len, ends)) / 2  # a text's frequent n-grams are not rows an occurrence


# 9 mixing


def test_mix(spark, none):
    rows = [(i, " ".join(["w"] * (i % 40)), "abcdefgh"[int(i**0.5) % 8] if i % 9 else None) for i in range(2000)] + [(2000, None, "zz"), (2001, "", "zz")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, target string")
    pieces, out = mixing.mix(docs, block=32)
    got = out.collect()
    size = {i: len(words(t)) for i, t, _ in rows}
    assert {r["doc_id"]: r["size"] for r in got} == size and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    by = {}
    for i, _, s in rows:
        by.setdefault(s, []).append(i)
    names = sorted((s for s in by if s), key=lambda s: s.encode()) + [None]
    held = {s: sum(size[i] for i in by[s]) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, full, rest = {}, set(), 1.5 * sum(held.values())
    while True:
        open_ = [s for s in names if s not in full]
        level = (rest - sum(2 * held[s] for s in full)) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * held[s]}
        if not over:
            break
        full |= over
    target = {s: 2.0 * held[s] if s in full else weight[s] * level for s in names}
    source = {i: s for i, _, s in rows}
    for r in got:
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]]) and r["source_size"] == held[source[r["doc_id"]]]
    for s in names:
        assert abs(sum(r["taken"] for r in got if source[r["doc_id"]] == s) - target[s]) <= 32 * 12
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(5), block=32)[1].collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    order = [r["source"] for r in pieces.select("slot", "source").distinct().orderBy("slot").collect()]
    half = Counter(order[: len(order) // 2])
    assert all(abs(half[s] - n / 2) <= 8 for s, n in Counter(order).items())  # each prefix is mixed alike
    assert mixing.mix(none)[1].count() == 0


def test_mix_of_odd_rows(odd, odd_rows):
    got = mixing.mix(odd)[1].collect()
    assert len(got) == len(odd_rows) and all(r["taken"] <= 2 * r["size"] for r in got)


# 10 language identification


def test_language_id(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = langid.classified(docs, langid.learn(docs.filter(~langid.held_out(F.col("doc_id"))))).filter(langid.held_out(F.col("doc_id")) & F.col("lang").isNotNull()).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in out]) > 0.97 and np.mean([r["rejected"] for r in out]) < 0.02
    model = langid.learn(odd)
    rows = langid.classified(odd, model).collect()
    assert set(model) == {"en", "de"}
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) and 0 <= r["score"] <= 1 for r in rows)
    assert langid.learn(none) == {} and {r["lang_pred"] for r in langid.classified(odd, {}).collect()} == {"und"} and langid.classified(none, model).count() == 0


def test_language_id_against_plain_compression(spark, odd, odd_rows):
    import zstandard

    model = langid.learn(odd)
    packers = {}
    for lang, data in model.items():
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=langid.LEVEL)
        packers[lang] = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
    want = Counter()
    for r in odd_rows:
        if r[1] is None or not any(c.isalpha() for c in r[1]):
            want[(r[0], "und", 0.0, True)] += 1
            continue
        size = {lang: len(p.compress(r[1].lower().encode())) for lang, p in packers.items()}
        best = min(sorted(size), key=size.get)
        score = 1 / sum(2.0 ** (size[best] - x) for x in size.values())
        want[(r[0], best, round(score, 9), score < langid.NARROW)] += 1
    assert Counter((r["doc_id"], r["lang_pred"], round(r["score"], 9), r["rejected"]) for r in langid.classified(odd, model).collect()) == want
    held = {r["doc_id"]: r["h"] for r in odd.select("doc_id", langid.held_out(F.col("doc_id")).alias("h")).collect()}
    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, h in held.items())


# shared


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(500, 560)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in root.items() if x in got} and all(x in got for e in edges if e[0] != e[1] for x in e)
