"""Search semantics on a small symbol table, by the expected names of each query."""

import re

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import extract, search
from quillon.schema import SearchOptions, decode_kind, encode_kind

SEED = [("amdgpu_device_init", "function", "a.c", 10, 0), ("amdgpu_fini", "function", "a.c", 20, 0), ("AMDGPU_MAX", "macro", "a.c", 1, 0), ("init", "function", "b.h", 5, 0)]
ALL = {s[0] for s in SEED}
A = {"AMDGPU_MAX", "amdgpu_device_init", "amdgpu_fini"}
CASES = [
    ("amdgpu_device_init", 1, 1, 0, {"amdgpu_device_init"}), ("AMDGPU_DEVICE_INIT", 0, 1, 0, {"amdgpu_device_init"}), ("AMDGPU_DEVICE_INIT", 1, 1, 0, set()),
    ("amdgpu", 0, 1, 0, set()), ("amdgpu", 0, 0, 0, A), ("amdgpu", 1, 0, 0, {"amdgpu_device_init", "amdgpu_fini"}), ("AMDGPU", 1, 0, 0, {"AMDGPU_MAX"}),
    ("init", 0, 0, 0, {"amdgpu_device_init", "init"}), ("dev", 0, 0, 0, set()), ("device_init", 0, 0, 0, {"amdgpu_device_init"}), ("amdgpu_dev", 0, 0, 0, set()), ("dgpu", 0, 0, 0, set()),
    ("_", 0, 0, 0, A), ("_", 1, 0, 0, A), ("a", 0, 0, 0, A), ("amdgpu init", 0, 0, 0, set()), ("in*t", 1, 0, 0, set()), ("%", 0, 0, 0, set()),
    ("amdgpu.*init", 0, 0, 1, {"amdgpu_device_init"}), ("^init$", 0, 0, 1, {"init"}), (r"\binit\b", 0, 0, 1, set()), ("dev.*", 0, 0, 1, set()), (".+", 0, 0, 1, ALL), ("^A", 1, 0, 1, {"AMDGPU_MAX"}),
    ("foo(", 0, 0, 1, set()), ("init", 0, 1, 1, {"amdgpu_device_init", "init"}), ("", 0, 1, 0, set()), ("__", 0, 0, 0, set()),
]
EXACT = [("dev", 0, 0, 0, {"amdgpu_device_init"}), ("dgpu", 0, 0, 0, A), ("amdgpu_dev", 0, 0, 0, {"amdgpu_device_init"}), (r"\binit\b", 0, 0, 1, {"init"}), ("dev.*", 0, 0, 1, {"amdgpu_device_init"})]


@pytest.fixture(scope="module")
def symbols(spark):
    return extract.symbols(spark.createDataFrame(SEED, "name string, kind string, relative_path string, line_number int, col int")).cache()


@pytest.mark.parametrize("mode,case", [*[("compat", c) for c in CASES], *[("exact", c) for c in EXACT]])
def test_golden(symbols, mode, case):
    query, cs, word, regex, want = case
    options = SearchOptions(bool(cs), bool(word), bool(regex))
    got = [r["name"] for r in search.search(symbols, query, options, mode=mode).collect()]
    assert set(got) == want and len(got) == len(want)
    assert search.count_matches(symbols, query, options, mode).first()["n"] == len(want)


def test_pages_follow_path_then_line(symbols):
    names = [r["name"] for r in search.search(symbols, ".+", SearchOptions(regex=True), limit=2).collect()]
    assert names == ["AMDGPU_MAX", "amdgpu_device_init"]
    assert [r["name"] for r in search.search(symbols, ".+", SearchOptions(regex=True), limit=2, offset=2).collect()] == ["amdgpu_fini", "init"]


def test_tokens_driver_and_column_agree(spark):
    words = ["café_x", "camelCase", "漢字かな", "_a__B1", "", "Ünï-Cödé", "x́y"]
    got = [r["t"] for r in spark.createDataFrame([(w,) for w in words], "w string").select(T.tokens(F.col("w")).alias("t")).collect()]
    assert got == [T.tokens_of(w) for w in words]
    assert got[0] == ["cafe", "x"]


@pytest.mark.parametrize("text,want", [("amdgpu.*init", ["amdgpu", "init"]), ("^foo_bar$", ["foo_bar"]), (r"\d+", []), ("a.+b", [])])
def test_literal_tokens(text, want):
    assert T.literal_tokens_of(text) == want


@pytest.mark.parametrize("raw,want", [(None, 1 << 20), (-1, 1 << 20), (float("nan"), 1 << 20), ("7", 1 << 20), (0, 0), (12, 12), (12.9, 12)])
def test_size_setting(raw, want):
    assert T.max_file_bytes(raw) == want


def test_kind_codec(spark):
    rows = spark.range(9).select(F.col("id"), encode_kind(decode_kind(F.col("id"))).alias("back")).collect()
    assert all(r["id"] == r["back"] for r in rows)
    assert spark.range(1).select(decode_kind(F.lit(99)).alias("k")).first()["k"] == "variable"


GREP = [("test.c", i + 1, t) for i, t in enumerate(["#include <stdio.h>", "int hello_func() {", '  print("Hello");', "  hello();", "}", "éé hello"])] + [("ignore.txt", 1, "hello"), (".git/x.c", 1, "hello")]


def test_text_search(spark):
    lines = spark.createDataFrame(GREP, "relative_path string, line_number int, line string")
    find = lambda q, o=SearchOptions(), **k: {(r["relative_path"], r["line_number"], r["match_start"]) for r in search.text_search(lines, q, o, **k).collect()}
    assert find("hello", include=[".c", ".h"]) == {("test.c", 2, 4), ("test.c", 3, 9), ("test.c", 4, 2), ("test.c", 6, 5)}
    assert ("test.c", 2, 4) not in find("hello", SearchOptions(whole_word=True))
    assert find("print.*hello", SearchOptions(regex=True)) == {("test.c", 3, 2)}
    assert find("HELLO", SearchOptions(True)) == set() and find("(", SearchOptions(regex=True)) == set()


def test_parse_grep_line(spark):
    rows = ["./src/foo.c:42:7:    int bar = baz();", "", "rg: error", "a.c:x:1:t", "a.c:1:2:b:c"]
    got = [r["x"] for r in spark.createDataFrame([(r,) for r in rows], "r string").select(search.parse_grep_line(F.col("r")).alias("x")).collect()]
    assert (got[0]["relative_path"], got[0]["line_number"], got[0]["match_start"], got[0]["match_length"]) == ("src/foo.c", 42, 6, 0)
    assert got[1] is None and got[2] is None and got[3] is None and got[4]["line_content"] == "b:c"


@pytest.mark.parametrize("row,want", [
    (("cancel", 5000, 0, None), ("cancel", None)), (("grep-fallback", 5000, 0, None), ("grep", None)), (("prompt-cancel", 5000, 0, None), ("prompt", "cancel")),
    (("prompt-grep-fallback", 5000, 0, None), ("prompt", "grep-fallback")), (("odd", 5000, 0, None), ("prompt", "grep-fallback")),
    (("cancel", 5000, 4001, "grep"), ("grep", None)), (("cancel", 5000, 4000, "grep"), ("cancel", None)), (("grep-fallback", 5000, 4500, "cancel"), ("cancel", None)),
])
def test_sync_decision(spark, row, want):
    df = spark.createDataFrame([row], "b string, n long, l long, c string")
    x = df.select(search.sync_decision(*map(F.col, "bnlc")).alias("x")).first()["x"]
    assert (x["action"], x["expect"]) == want


def test_random_names_against_plain_python(spark):
    import random

    rng = random.Random(7)
    names = ["".join(rng.choice("abAB_1") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    table = extract.symbols(spark.createDataFrame([(n, "macro", "x.c", i, 0) for i, n in enumerate(names)], "name string, kind string, relative_path string, line_number int, col int")).cache()
    for query in ("a", "_", "ab", "A_b", "1", "b1"):
        want = []
        for n in names:
            parts = [p for p in n.lower().split("_") if p]
            ok = query.lower() in n.lower()
            if runs := re.findall("[A-Za-z0-9_]{2,}", query):
                phrases = [[p for p in r.lower().split("_") if p] for r in runs]
                ok = ok and any(p and any(parts[i : i + len(p)] == p for i in range(len(parts))) for p in phrases)
            want += [n] if ok else []
        assert sorted(r["name"] for r in search.matching(table, query).collect()) == sorted(want)


def test_occurrences_of_more_than_1000_highlights(spark):
    lines = spark.createDataFrame([("a", i, f"<{i}>") for i in range(1200)], "relative_path string, line_number int, line string")
    marks = spark.createDataFrame([(f"<{i}>", "red") for i in range(1200)], "text string, color string")
    from quillon.operators import session

    got = session.occurrences(lines, marks)
    assert got.columns == ["relative_path", "line_number", "at", "text", "color"]
    assert got.select("text").distinct().count() == got.count() == 1200
    assert session.occurrences(lines, marks.limit(0)).count() == 0
