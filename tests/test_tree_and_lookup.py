"""Trees read by name and in ranges, look-ups against full scans, and writers that race."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from quillon.functions import grams
from quillon.operators import extract, index, lookup, search
from quillon.operators.index import Index, Store
from quillon.schema import FILES, SearchOptions
from quillon.sources import corpus, tree


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    out = {f"d{i % 4}/e{i % 3}/f{i}.c": "".join(rng.choice(["\n", "a", "bb", "\n\n", "é", "\r\n", "long " * 9]) for _ in range(rng.choice([0, 1, 2, 50, 300]))) for i in range(24)}
    return out | {"top.h": "x", "ends.h": "x\n", "d0/none.h": ""}


@pytest.fixture(scope="module")
def root(texts, tmp_path_factory):
    at = tmp_path_factory.mktemp("tree")
    for path, text in texts.items():
        (at / path).parent.mkdir(parents=True, exist_ok=True)
        (at / path).write_bytes(text.encode())
    return str(at)


def test_a_tree_is_listed_in_partitions(spark, root, texts):
    listed = tree.list_tree(spark, root)
    assert {r["relative_path"]: r["size_bytes"] for r in listed.collect()} == {p: len(t.encode()) for p, t in texts.items()}
    assert listed.rdd.getNumPartitions() > 8
    only = {r["relative_path"] for r in tree.list_tree(spark, root, ["d1", "d1/e0", "d2/e1"]).collect()}
    assert only == {p for p in texts if p.startswith(("d1/", "d2/e1/"))}
    named = tree.named_files(spark, root, ["top.h", "nope.c", "../top.h", "d0", "", "/etc/passwd"])
    assert [r["relative_path"] for r in named.collect()] == ["top.h"]


def test_only_named_files_are_opened(spark, root, texts):
    names = [p for p in texts if p.startswith("d0/")]
    got = tree.read_files(spark.createDataFrame([(n,) for n in [*names, "gone.c"]], "relative_path string"), root).collect()
    assert {r["relative_path"]: r["content"] for r in got} == {n: texts[n] for n in names} and not any(r["error"] for r in got)


@pytest.mark.parametrize("size", [1, 3, 7, 64, 1 << 20])
def test_ranges_give_the_lines_of_whole_files(spark, root, texts, size):
    listed = tree.list_tree(spark, root).filter(F.col("size_bytes") < (60 if size < 8 else 1 << 30))
    got = sorted((tuple(r) for r in tree.read_lines(listed, root, size).collect()), key=str)
    want = []
    for path, text in texts.items():
        if len(text.encode()) < (60 if size < 8 else 1 << 30):
            lines = text.split("\n")
            want += [(path, i + 1, x, lines[i + 1] if i + 1 < len(lines) else None) for i, x in enumerate(lines)]
    assert got == sorted(want, key=str)


def test_places_are_read_up_to_the_last(spark, root, texts):
    places = [(p, n) for p in list(texts)[:9] for n in (1, 2, 5, 400)] + [("gone.c", 1), ("top.h", 0)]
    got = {(r[0], r[1]): r[2] for r in tree.read_places(spark.createDataFrame(places, "relative_path string, line_number int"), root).collect()}
    assert got == {(p, n): texts[p].split("\n")[n - 1] for p, n in places if p in texts and 0 < n <= len(texts[p].split("\n"))}


def test_large_files_are_extracted_in_ranges(spark, tmp_path):
    """Ranges that cut lines, and the brace on the next line, give what one pass over all lines gives."""
    body = "".join(f"#define REG_{i} {i}\nstatic int fn_{i}(int a)\n{{\n}}\nstruct s_{i} {{ int x; }};\nint one_{i}(void) {{\n}}\n" for i in range(400))
    (tmp_path / "big.c").write_text(body)
    files = tree.list_tree(spark, str(tmp_path))
    whole = spark.createDataFrame([("big.c", body)], "relative_path string, content string")
    want = sorted(tuple(r) for r in extract.by_line(corpus.split_lines(whole)).select("relative_path", "line_number", "col", "name", "kind").collect())
    for size in (17, 1000):
        rows = index.extract_rows(files, str(tmp_path), 1000, size).collect()
        assert sorted((r["relative_path"], r["line_number"], r["col"], r["name"], r["kind"]) for r in rows if r["name"]) == want
        assert [(r["relative_path"], r["size_bytes"]) for r in rows if r["name"] is None] == [("big.c", len(body))]
    assert tree.line_ranges(files, 1000).count() == -(-len(body) // 1000)


def test_a_page_and_a_dirty_sync_open_their_files_alone(spark, tmp_path, monkeypatch):
    """Files that nobody asks for can't be opened here, and nothing fails."""
    ws = tmp_path / "ws"
    ws.mkdir()
    for i in range(6):
        (ws / f"f{i}.c").write_text(f"int fn_{i}(int a) {{ return a; }}\n")
    idx = Index(spark, str(ws), str(tmp_path / "index"))
    idx.synchronize()
    (ws / "f2.c").write_text("int second(int a) { return a; }\n")
    kept = os.stat(ws / "f5.c")
    os.remove(ws / "f5.c")  # of the same time and size, but a folder's worth of trouble to open
    os.mkdir(ws / "f5.c.d")
    idx.mark("f2.c")
    idx.sync_dirty()
    assert idx.count("second") == 1 and idx.count("fn_5") == 1 and not idx.errors.count() and kept.st_size
    asked, plain = [], tree.read_places
    monkeypatch.setattr(tree, "read_places", lambda places, root: asked.append({r[0] for r in places.select("relative_path").collect()}) or plain(places, root))
    assert idx.search("second").first()["line_content"].startswith("int second") and asked == [{"f2.c"}]
    read, plain_files = [], tree.read_files
    monkeypatch.setattr(tree, "read_files", lambda paths, root: read.append({r[0] for r in paths.select("relative_path").collect()}) or plain_files(paths, root))
    (ws / "f3.c").write_text("int third(int a) { return a; }\n")
    idx.synchronize()  # one file is gone, one is other, four are as they were
    assert read == [{"f3.c"}] and idx.count("fn_5") == 0 and idx.count("third") == 1


# look-ups

NAMES = ["device_init", "amdgpu_device_init", "init_device", "device_reinit", "small_ring", "ring_small", "RingBuffer", "ring", "RING_1", "part_1_x", "x_part_1", "_", "__a", "a", "Ünit_ring", "unit", "ring_ring_ring", "Kelvin", "kelvin", "ſet_ring", "İnit", "device_device_init"]


def symbols_of(spark, names, path="a.c", first=1):
    return extract.symbols(spark.createDataFrame([(n, "macro", path, first + i, 0) for i, n in enumerate(names)], "name string, kind string, relative_path string, line_number int, col int"))


def files_of(spark, rows):
    return spark.createDataFrame(rows, FILES)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(4)
    more = ["_".join(rng.choice(["ring", "small", "dev", "init", "x1", "Buffer", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(150)]
    store = Store(spark, str(tmp_path_factory.mktemp("store") / "s"))
    store.publish(files_of(spark, [("a.c", 1, 1, len(NAMES) + 150)]), symbols_of(spark, NAMES + more))
    return store.load()


def found(df):
    return sorted((r["name"], r["relative_path"], r["line_number"]) for r in df.select("name", "relative_path", "line_number").collect())


QUERIES = [
    ("device_init", {}), ("ring", {}), ("RING", dict(case_sensitive=True)), ("small ring", {}), ("small_ring", {}), ("ring_ring", {}), ("_ring_ring_ring", {}), ("dev", {}), ("_", {}), ("__", {}), ("part_1", {}), ("é_ring", {}),
    ("ring", dict(whole_word=True)), ("RING", dict(whole_word=True)), ("RING_1", dict(whole_word=True, case_sensitive=True)), ("device.*init", dict(regex=True)), ("^ring$|small_.*", dict(regex=True)), ("^.$", dict(regex=True)), ("(", dict(regex=True)), ("", {}),
]


def test_look_ups_find_what_a_scan_finds(spark, stored):
    symbols = stored.symbols.cache()
    for query, options in QUERIES:
        for mode in ("compat", "exact"):
            o = SearchOptions(**options)
            assert found(search.matching(stored, query, o, mode)) == found(search.matching(symbols, query, o, mode)), (query, options, mode)
            assert search.count_matches(stored, query, o, mode).first()["n"] == search.count_matches(symbols, query, o, mode).first()["n"]
    symbols.unpersist()


def test_look_ups_read_postings_alone(stored):
    opened = lambda df: {p.split("/segment/")[-1].split("/")[0] if "/segment/" in p else "symbols" for p in df.inputFiles()}
    assert opened(search.matching(stored, "small_ring")) == {"postings"} == opened(search.count_matches(stored, "ring"))
    assert opened(search.matching(stored, "ring", SearchOptions(whole_word=True))) == {"names"}
    assert "symbols" not in opened(search.matching(stored, "mall_ri", mode="exact")) and "symbols" not in opened(search.matching(stored, "mal.*_rin", SearchOptions(regex=True), "exact"))
    assert opened(search.matching(stored, "_")) == {"symbols"}


def test_look_ups_open_the_parts_of_their_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lookup, "PART_ROWS", 40)
    store = Store(spark, str(tmp_path / "s"))
    store.publish(files_of(spark, [("a.c", 1, 1, 600)]), symbols_of(spark, [f"name_{i}_x{i % 50}" for i in range(600)]))
    now = store.load()
    assert now.segments.segments[0]["parts"]["postings"]["of"] >= 16
    assert len(search.matching(now, "x7").inputFiles()) == 1 and search.matching(now, "x7").count() == 12
    assert len(search.matching(now, "name_7_x7", SearchOptions(whole_word=True)).inputFiles()) == 1


def test_conditions_hold_for_every_match(spark):
    """Random patterns: each name that Java's pattern matches meets the condition, without regard to case too."""
    rng = random.Random(9)
    bits = ["ring", "dev", "init", "_", "x", ".", ".*", "[a-c]", "(ring|dev)", "(?:small|init)+", "r?", "i*", "buf{2}", "^", "$", "\\b", "\\w+", "(?=ring)", "K", "s"]
    names = NAMES + ["_".join(rng.choice(["ring", "small", "dev", "init", "buff", "K", "x"]) for _ in range(3)) for _ in range(100)]
    table = spark.createDataFrame([(n,) for n in names], "name string").select("name", grams.of_column(grams.folded(F.col("name"))).alias("have")).cache()
    told, checks = 0, []
    for i in range(120):
        pattern = "".join(rng.choice(bits) for _ in range(rng.randint(1, 5)))
        condition = grams.of_pattern(pattern)
        if condition is None or not search.valid_regex(spark, pattern):
            continue
        told += 1
        checks.append(F.sum(F.when(F.col("name").rlike("(?iu)" + pattern) & ~grams.met(condition, F.col("have")), 1).otherwise(0)).alias(f"p{i}"))
    assert told > 40
    assert set(table.agg(*checks).first()) == {0}
    table.unpersist()


@pytest.mark.parametrize(("pattern", "want"), [
    ("abc", "abc"), ("ab", None), ("abcd", ("and", ["abc", "bcd"])), ("ABC", "abc"), ("abc|xyz", ("or", ["abc", "xyz"])), ("abc|x", None), ("a(bc)d", ("and", ["abc", "bcd"])), ("abc.*xyz", ("and", ["abc", "xyz"])), ("(abc)?", None),
    ("(abc)+", "abc"), ("[a[b]c]ddd", None), ("\\Qabc\\E", None), ("[abc]xyz", "xyz"), ("a.b.c", None), ("(?i)abc", "abc"), ("(?x)a b c", None), ("abc\\.def", ("and", ["abc", "bc.", "c.d", ".de", "def"])), ("((", None), ("éabc", "abc"),
])
def test_conditions_of_patterns(pattern, want):
    assert grams.of_pattern(pattern) == want


def test_segments_follow_changes(spark, tmp_path):
    """Many small changes: the look-ups equal a scan after each, and segments stay few."""
    rng = random.Random(3)
    store, state = Store(spark, str(tmp_path / "s")), {}
    store.publish(files_of(spark, [(f"f{i}.c", 1, 1, 0) for i in range(6)]), symbols_of(spark, ["x"]).limit(0))
    state = {f"f{i}.c": [] for i in range(6)}
    for step in range(5):
        path = f"f{rng.randint(0, 7)}.c"
        gone = [p for p in list(state)[:1] if step == 3 and p != path]
        state[path] = [f"ring_{step}_{k}" for k in range(rng.randint(0, 3))]
        for p in gone:
            del state[p]
        meta = files_of(spark, [(path, step, 1, len(state[path]))])
        store.apply(meta, symbols_of(spark, [*state[path], "ignored"][:-1] or ["x"], path).filter("name <> 'x'"), spark.createDataFrame([(p,) for p in gone], "relative_path string"))
        now = store.load()
        want = sorted((n, p, i + 1) for p, names in state.items() for i, n in enumerate(names))
        assert found(search.matching(now, "ring")) == want == found(now.symbols) == found(search.matching(now, "ing_", mode="exact"))
    assert store.integrity() == "ok" and len(now.segments.segments) <= 4
    store.compact()
    assert found(search.matching(store.load(), "ring")) == want


def test_a_large_base_keeps_its_segment(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.publish(files_of(spark, [(f"f{i}.c", 1, 1, 2000) for i in range(3)]), symbols_of(spark, [f"ring_{i}" for i in range(2000)], "f0.c").unionByName(symbols_of(spark, [f"dev_{i}" for i in range(2000)], "f1.c")).unionByName(symbols_of(spark, [f"x_{i}" for i in range(2000)], "f2.c")))
    base = store._meta()["segments"][0]["path"]
    store.apply(files_of(spark, [("f0.c", 2, 1, 1)]), symbols_of(spark, ["ring_new"], "f0.c"), spark.createDataFrame([("f2.c",)], "relative_path string"))
    now = store.load()
    assert [s["path"] for s in now.meta["segments"]][0] == base and [s["gone"] for s in now.meta["segments"]] == [0, 2]
    assert found(search.matching(now, "ring")) == [("ring_new", "f0.c", 1)] and search.count_matches(now, "x").first()["n"] == 0 and search.count_matches(now, "dev").first()["n"] == 2000
    assert found(search.matching(now, "ing_", mode="exact")) == [("ring_new", "f0.c", 1)] and store.integrity() == "ok"
    assert now.file("f1.c").first()["symbol_count"] == 2000 and now.file("f2.c").count() == 0


def test_racing_writers_lose_no_change(spark, tmp_path):
    """Two stores make changes from one state: of other buckets, which are put together, and of one bucket, which is made again."""
    root = str(tmp_path / "s")
    one = Store(spark, root)
    one.publish(files_of(spark, [("base.c", 1, 1, 3000)]), symbols_of(spark, ["base", *[f"b_{i}" for i in range(2999)]], "base.c"))  # so much that its segment stays
    paths = [f"p{i}.c" for i in range(400)]
    bucket = lambda p: lookup.part_of(p, one.LEAST)
    same = next((p, q) for p in paths for q in paths if p != q and bucket(p) == bucket(q) != bucket("base.c"))
    apart = next((p, q) for p in paths for q in paths if bucket(p) != bucket(q) and not {p, q} & set(same))
    for p, q in (apart, same):
        first, second = Store(spark, root), Store(spark, root)
        swap, made, done = first._swap, [], []

        def late(name, number, swap=swap, second=second, q=q, done=done):
            if not done:  # the other comes first
                done.append(second.apply(files_of(spark, [(q, 1, 1, 1)]), symbols_of(spark, [f"sym_{q}"], q), spark.createDataFrame([], "relative_path string")))
            return swap(name, number)

        changed = first._changed
        first._swap, first._changed = late, lambda *a, changed=changed, made=made: made.append(1) or changed(*a)
        first.apply(files_of(spark, [(p, 1, 1, 1)]), symbols_of(spark, [f"sym_{p}"], p), spark.createDataFrame([], "relative_path string"))
        assert len(made) == (1 if (p, q) == apart else 2)
        now = Store(spark, root).load()
        assert {p, q, "base.c"} <= {r[0] for r in now.files.select("relative_path").collect()}
        assert {f"sym_{p}", f"sym_{q}", "base"} <= {r[0] for r in now.symbols.select("name").collect()} and one.integrity() == "ok"


def test_threads_that_write_at_once(spark, tmp_path):
    root = str(tmp_path / "s")
    Store(spark, root).publish(files_of(spark, [("base.c", 1, 1, 0)]), symbols_of(spark, ["x"]).limit(0))
    work = [threading.Thread(target=lambda i=i: Store(spark, root).apply(files_of(spark, [(f"t{i}.c", 1, 1, 1)]), symbols_of(spark, [f"t_{i}"], f"t{i}.c"), spark.createDataFrame([], "relative_path string"))) for i in range(3)]
    for t in work:
        t.start()
    for t in work:
        t.join(240)
    now = Store(spark, root).load()
    assert {r[0] for r in now.files.select("relative_path").collect()} == {"base.c", "t0.c", "t1.c", "t2.c"} and Store(spark, root).integrity() == "ok"


def test_buckets_grow_with_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Store, "BUCKET_ROWS", 10)
    store = Store(spark, str(tmp_path / "s"))
    store.publish(files_of(spark, [("a.c", 1, 1, 1)]), symbols_of(spark, ["a"], "a.c"))
    assert store._meta()["of"] == Store.LEAST
    store.apply(files_of(spark, [("b.c", 1, 1, 700)]), symbols_of(spark, [f"b_{i}" for i in range(700)], "b.c"), spark.createDataFrame([], "relative_path string"))
    assert store._meta()["of"] == 128 and store.integrity() == "ok" and store.load().symbols.count() == 701


# pages


def test_seeking_gives_the_pages_that_counting_gives(spark, stored):
    rows, seek, page = [], None, None
    while True:
        page = search.search(stored, "ring", limit=17, seek=seek).collect()
        if not page:
            break
        rows += page
        seek = (page[-1]["relative_path"], page[-1]["line_number"], page[-1]["col"], page[-1]["name"])
    assert rows == search.search(stored, "ring", limit=1000).collect() and len(rows) > 34


def test_result_lines_sends_the_page_to_the_lines(spark):
    page = search.search(symbols_of(spark, NAMES), "ring")
    lines = spark.createDataFrame([("a.c", i, f"line {i}") for i in range(1, 5)], "relative_path string, line_number int, line string")
    plan = search.result_lines(page, lines.repartition(4))._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi, BuildRight" in plan
    got = {r["line_number"]: r["line_content"] for r in search.result_lines(page, lines).collect()}
    assert got and all(v == (f"line {k}" if k < 5 else "") for k, v in got.items())


def test_a_hit_keeps_the_full_text_search_from_running(spark):
    lines = spark.range(1).select(F.lit("a.c").alias("relative_path"), F.lit(1).alias("line_number"), F.raise_error(F.lit("lines were searched")).cast("string").alias("line"))
    names = symbols_of(spark, ["ring", "dev"])
    none = spark.createDataFrame([], "relative_path string, line_number int, line_content string, match_start int, match_length int")
    some = spark.createDataFrame([("a.c", 1, "x", 0, 1)], none.schema)
    assert search.either(some, search.text_search(lines, "x")).count() == 1 and search.either(none, some).count() == 1
    hit = search.hybrid_search(names, lines.limit(0), "ring")
    assert hit.count() == 1
    with pytest.raises(Exception, match="lines were searched"):
        search.hybrid_search(names, lines, "nothing").collect()
