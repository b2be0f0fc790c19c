"""Extractors, the index store, synchronisation, sessions and change streams."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import extract, index, search, session, telemetry
from quillon.operators.index import Index, Status, Store
from quillon.plans import registry
from quillon.schema import SearchOptions
from quillon.sources import corpus
from quillon.streaming import changes

CODE = """#define FOO_REG 1
#define BAR(x) (x)
struct Point { int x; };
union U {
enum Color { RED };
class Widget : Base {
namespace ns {
int foo(int a) {
  if (a) {
  return bar(a);
}
static void baz(void)
{
}
struct fwd;
int proto(int);
"""


def found(df):
    return sorted((r["line_number"], r["name"], r["kind"]) for r in df.collect())


def lines_of(spark, content, path="x.cpp"):
    return corpus.split_lines(spark.createDataFrame([(path, content)], "relative_path string, content string"))


WANT = [(1, "FOO_REG", "macro"), (2, "BAR", "macro"), (3, "Point", "struct"), (4, "U", "union"), (5, "Color", "enum"), (6, "Widget", "class"), (7, "ns", "namespace"), (8, "foo", "function"), (12, "baz", "function")]


def test_by_line(spark):
    assert found(extract.by_line(lines_of(spark, CODE))) == WANT
    assert found(extract.by_line(lines_of(spark, CODE.replace("\n", "\r\n")))) == WANT
    assert found(extract.by_line(lines_of(spark, CODE), macros_only=True)) == WANT[:2]


def test_by_text_agrees_with_by_line(spark):
    files = spark.createDataFrame([("x.cpp", CODE), ("e.c", "")], "relative_path string, content string")
    assert found(extract.by_text(files)) == WANT


def test_by_text_in_parts(spark):
    """Cut after any line, a file gives what it gives whole; matches reach over lines, and over many parts."""
    code = (
        "struct A\n\n\n{\n int x;\n};\nint f(int a,\n#define IN(x) x\n int b)\n\n{\n}\ntemplate <class T,\n class U { ; }\nclass V {\n> class W : public\n{\n"
        "int p(int a\nint q(int b)\n{\nint r(int c;\nint s(int d) {\n}\n#define M 1\nenum class E\n\n{\nclass X : Y\n{\ntemplate < class\nint t(\n> class Z\n{ int u()\n{\nclass Q\nclass R\n{\nunion N\n"
    )
    lines = code.splitlines()
    sizes = (1, 2, 3, 5, 100)
    whole = spark.createDataFrame([(str(n), code) for n in sizes], "relative_path string, content string")
    want = sorted(map(tuple, extract.by_text(whole).collect()))
    assert {n for _, _, n, *_ in want} >= {"A", "f", "IN", "W", "s", "M", "E", "X"}
    rows = spark.createDataFrame([(str(n), i // n, i, line) for n in sizes for i, line in enumerate(lines)], "relative_path string, p int, i int, line string")
    parts = extract.in_parts(rows, F.col("p"), "i")
    assert parts.filter("relative_path = '2'").agg(F.max(F.char_length("content"))).first()[0] <= 2 * max(map(len, lines)) + 2
    assert sorted(map(tuple, extract.by_text(parts).collect())) == want


def test_no_row_holds_a_large_file(spark, sf, monkeypatch):
    """One task read all orders as one text before; now files come in parts, of so many lines."""
    seen = []
    monkeypatch.setattr(extract, "by_text", lambda files: seen.append(files) or files)
    registry.large_file(spark, sf)
    registry.queries()["extract_whole_text"](spark, sf)
    for files in seen:
        got = files.agg(F.count("*").alias("n"), F.max(F.size(F.split("content", "\n"))).alias("m")).first()
        assert got["n"] > 1 and got["m"] <= registry.LINES + 1


def test_columns_are_places_in_the_match(spark):
    got = {r["name"]: r["col"] for r in extract.by_line(lines_of(spark, "#define d 1\n  struct S {\n")).collect()}
    assert got == {"d": 1, "S": 9}


def test_lexer(spark):
    c = 'int foo(int a) { return 1; }\n/* int no(void) { */\nstatic void bar(void)\n{ char *s = "struct Q {"; }\nstruct Point { int x; };\ntypedef struct { int y; } Pt;\ntypedef int T[3];\n#define M 1 \\\n  struct Z {\n#define F(x) x\nint proto(int);\nchar *ptr(void) { return 0; }\nvoid use(void) { if (x) { } }\n'
    files = spark.createDataFrame([("a.c", c), ("b.hpp", "class Widget { void m() { } };\nnamespace ns { enum class E { A }; }\nvoid W::n() { }\n"), ("c.py", "def f(): pass")], "relative_path string, content string")
    got = {(r["relative_path"], r["name"], r["kind"], r["line_number"]) for r in extract.by_lexer(files).collect()}
    assert got == {
        ("a.c", "foo", "function", 1), ("a.c", "bar", "function", 3), ("a.c", "Point", "struct", 5), ("a.c", "Pt", "typedef", 6), ("a.c", "T", "typedef", 7), ("a.c", "M", "macro", 8), ("a.c", "F", "macro", 10), ("a.c", "use", "function", 13),
        ("b.hpp", "Widget", "class", 1), ("b.hpp", "m", "function", 1), ("b.hpp", "ns", "namespace", 2), ("b.hpp", "E", "enum", 2),
    }


def test_two_hundred_thousand_macros(spark):
    rows = spark.range(200_000).select(F.lit("big.h").alias("relative_path"), (F.col("id") + 1).cast("int").alias("line_number"), F.concat(F.lit("#define MACRO_"), F.col("id").cast("string"), F.lit(" 1")).alias("line"))
    assert extract.by_line(rows, macros_only=True).count() == 200_000


def test_null_names_are_refused(spark):
    bad = spark.createDataFrame([(None, "macro", "x.c", 1, 0)], "name string, kind string, relative_path string, line_number int, col int")
    with pytest.raises(Exception, match="symbol name is null"):
        extract.symbols(bad).collect()


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "ws"
    for path, text in {"src/util.c": "int add(int a) { return a; }\nint subtract(int a) { return a; }\n", "include/util.h": "#define UTIL_MAX 3\n", "build/gen.c": "int gen(void) { }\n", "note.txt": "x"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


def test_synchronise_then_follow_changes(spark, tree, tmp_path):
    states = []
    idx = Index(spark, str(tree), str(tmp_path / "index"))
    idx.on_status.append(states.append)
    assert not idx.load() and idx.tables() is None
    assert idx.synchronize() and idx.status is Status.READY and states[-2:] == [Status.BUILDING, Status.READY]
    files, symbols = idx.tables()
    assert {(r["relative_path"], r["symbol_count"]) for r in files.collect()} == {("src/util.c", 2), ("include/util.h", 1)}
    assert {r["name"] for r in symbols.collect()} == {"add", "subtract", "UTIL_MAX"}
    assert idx.synchronize() is None  # nothing changed, nothing written
    (tree / "src/util.c").write_text("int multiply(int a) { return a; }\n")
    os.remove(tree / "include/util.h")
    idx.mark("src/util.c")
    idx.mark("include/util.h", removed=True)
    assert idx.status is Status.STALE
    idx.sync_dirty()
    assert {r["name"] for r in idx.tables()[1].collect()} == {"multiply"} and idx.status is Status.READY
    assert idx.load() and idx.integrity() == "ok"


def test_a_change_writes_its_own_buckets(spark, tmp_path):
    root = tmp_path / "ws"
    root.mkdir()
    for i in range(40):
        (root / f"f{i}.c").write_text(f"int fn_{i}(int a) {{ return a; }}\n")
    idx = Index(spark, str(root), str(tmp_path / "index"))
    first = idx.synchronize()
    before = idx.store._meta()["buckets"]
    (root / "f7.c").write_text("int seven(int a) { return a; }\nint more(int a) { return a; }\n")
    idx.mark("f7.c")
    second = idx.sync_dirty()
    after = idx.store._meta()["buckets"]
    moved = {b for b, n in after.items() if n[0] == second}
    assert len(moved) == 1 and all(after[b][0] == first for b in before if b not in moved)
    assert {r["name"] for r in idx.tables()[1].collect()} == {f"fn_{i}" for i in range(40) if i != 7} | {"seven", "more"} and idx.integrity() == "ok"
    os.remove(root / "f8.c")
    idx.synchronize()
    idx.store.compact()
    assert idx.count("seven") == 1 and idx.count("fn_8") == 0 and idx.count("fn") == 38 and idx.integrity() == "ok"


def test_store_versions_and_quarantine(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    files = spark.createDataFrame([("a.c", 1, 2, 0)], "relative_path string, mtime_ms long, size_bytes long, symbol_count int")
    symbols = extract.symbols(spark.createDataFrame([], "name string, kind string, relative_path string, line_number int, col int"))
    store.publish(files, symbols)
    assert store.load()[0].count() == 1 and store.version() == 2
    assert store._point(store._meta() | {"schema_version": 99}, 1)
    with pytest.raises(ValueError, match="schema 99"):
        store.load()
    assert store._point(store._meta() | {"schema_version": 0}, 2)
    assert store.load() is None and not os.path.exists(tmp_path / "s")
    store.publish(files, symbols)
    (tmp_path / "s" / "live-000000000009").write_text("{broken")
    assert store.load() is None and any(".corrupt-" in p for p in os.listdir(tmp_path))


def test_a_crash_at_any_step_leaves_a_whole_index(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    files = lambda n: spark.createDataFrame([(f"{i}.c", 1, 2, 0) for i in range(n)], "relative_path string, mtime_ms long, size_bytes long, symbol_count int")
    symbols = extract.symbols(spark.createDataFrame([("x", "macro", "0.c", 1, 0)], "name string, kind string, relative_path string, line_number int, col int"))
    store.publish(files(1), symbols)
    with monkeypatch.context() as m:
        m.setattr(store, "_point", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))  # after the tables, before the pointer
        with pytest.raises(RuntimeError):
            store.publish(files(2), symbols)
    assert store.load()[0].count() == 1
    (tmp_path / "s" / "pointer.abc").write_text('{"snap')  # a pointer that was being written
    assert store.load()[0].count() == 1
    store.publish(files(3), symbols)
    assert store.load()[0].count() == 3 and len(store._pointers()) == 2
    store.compact()
    assert store.load()[0].count() == 3 and len(store._pointers()) == 1 and (tmp_path / "s" / "pointer.abc").exists()  # another writer's, for what we know
    os.utime(tmp_path / "s" / "pointer.abc", (1, 1))
    store.compact()
    assert store.load()[0].count() == 3 and not (tmp_path / "s" / "pointer.abc").exists()
    # errors that aren't the store's don't set it aside
    with monkeypatch.context() as m:
        m.setattr(store, "_meta", lambda: (_ for _ in ()).throw(RuntimeError("executor lost")))
        with pytest.raises(RuntimeError, match="executor lost"):
            store.load()
    assert store.load()[0].count() == 3 and not any(".corrupt-" in p for p in os.listdir(tmp_path))
    # a snapshot with a broken table is set aside
    live = store._meta()["snapshot"]
    store = Store(spark, str(tmp_path / "s"))
    for f in (tmp_path / "s" / live / "symbols").rglob("*.parquet"):
        f.write_bytes(b"junk")
    for f in (tmp_path / "s" / live / "symbols").rglob(".*.crc"):
        f.unlink()
    assert store.integrity() != "ok"
    assert store.load() is None and any(".corrupt-" in p for p in os.listdir(tmp_path))


def test_a_file_that_fails_keeps_its_old_rows(spark, tree, tmp_path, monkeypatch):
    idx = Index(spark, str(tree), str(tmp_path / "index"))
    idx.synchronize()
    (tree / "src/util.c").write_text("int changed(void) { return 1; }\n")
    plain = index.extract_rows

    def failing(*a):
        rows = plain(*a)
        bad = F.col("relative_path") == "src/util.c"
        return rows.withColumns({"error": F.when(bad & F.col("name").isNotNull(), F.lit("src/util.c: broken")).otherwise(F.col("error")), "name": F.when(~bad, F.col("name"))})

    monkeypatch.setattr(index, "extract_rows", failing)
    idx.mark("src/util.c")
    idx.sync_dirty()
    assert {r["name"] for r in idx.tables()[1].collect()} == {"add", "subtract", "UTIL_MAX"}
    assert [r["error"] for r in idx.errors.collect()] == ["src/util.c: broken"]


def test_syncs_take_turns(spark, tree, tmp_path):
    idx = Index(spark, str(tree), str(tmp_path / "index"))
    idx.synchronize()
    (tree / "src/util.c").write_text("int one(void) { return 1; }\n")
    (tree / "include/util.h").write_text("#define TWO 22\n")
    idx.mark("src/util.c")
    running, most, plain = [0], [0], idx._read_and_publish

    def watched(*a):
        running[0] += 1
        most[0] = max(most[0], running[0])
        try:
            return plain(*a)
        finally:
            running[0] -= 1

    idx._read_and_publish = watched
    threads = [threading.Thread(target=f) for f in (idx.synchronize, idx.sync_dirty, idx.synchronize)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert most[0] == 1 and {r["name"] for r in idx.tables()[1].collect()} == {"one", "TWO"} and idx.integrity() == "ok"
    assert idx.drain(1.0) and not idx.sync_in_progress


def test_a_cancelled_sync_publishes_nothing(spark, tree, tmp_path):
    idx = Index(spark, str(tree), str(tmp_path / "index"))
    idx.synchronize()
    before = idx.store._meta()["snapshot"]
    (tree / "src/util.c").write_text("int other(void) { return 1; }\n")
    idx.mark("src/util.c")
    with pytest.raises(index.Cancelled):
        idx.synchronize(lambda phase: idx.cancel() if phase == "parsing" else None)
    assert idx.store._meta()["snapshot"] == before and idx.status is Status.STALE and not idx._dirty
    idx._turn.acquire()
    assert idx.sync_in_progress and not idx.drain(0.05) and idx.warnings
    idx._turn.release()


def test_search_and_count_of_the_index(spark, tree, tmp_path):
    idx = Index(spark, str(tree), str(tmp_path / "index"))
    assert idx.search("add").count() == 0 and idx.count("add") == 0 and idx.integrity() == "not opened"
    seen = []
    idx.on_stats.append(seen.append)
    idx.synchronize()
    assert seen[-1] == {"files": 2, "symbols": 3} and idx.schema_version() == 2 and idx.integrity() == "ok"
    row = idx.search("ADD", SearchOptions(whole_word=True)).first()
    assert row["name"] == "add" and row["file_path"] == f"{idx.root}/src/util.c" and row["line_content"].startswith("int add(")
    assert idx.count("util") == 1 and idx.count("(", SearchOptions(regex=True)) == 0
    page, total = idx.hybrid("subtract")
    assert total == 1 and page.count() == 1
    (tree / ".gitignore").write_text("include/\n# note\n*.tmp\n")
    page, total = idx.hybrid("return a")  # no symbol: the full text
    assert total == 2 and {r["relative_path"] for r in page.collect()} == {"src/util.c"}
    assert idx.hybrid("3;")[1] == 0
    idx._turn.acquire()
    for setting, answer, n in (("cancel", None, 0), ("grep-fallback", None, 2), ("prompt-cancel", None, 0), ("prompt-grep-fallback", None, 2), ("prompt-cancel", "grep", 2)):
        idx.during_sync, idx._choice, asked = setting, (0.0, None), []
        idx.ask = lambda expect, a=answer, s=asked: s.append(expect) or a or ("grep" if expect == "grep-fallback" else "cancel")
        assert idx.hybrid("return a")[1] == n and len(asked) == setting.startswith("prompt")
    idx.during_sync = "cancel"
    idx._choice = (time.time() + 60, "grep")  # a choice just made holds
    assert idx.hybrid("return a")[1] == 2
    idx._turn.release()
    assert index.file_metadata(idx.tables()[0], "src/util.c").first()["symbol_count"] == 2
    off = Index(spark, str(tree), str(tmp_path / "index"), enabled=False)
    off.load()
    assert off.count("add") == 0
    idx.clear()
    assert idx.status is Status.NONE and idx.count("add") == 0


def test_stored_search_pushes_filters(spark, tree, tmp_path):
    idx = Index(spark, str(tree), str(tmp_path / "index"))
    idx.synchronize()
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    exact = plan(search.matching(idx.tables()[1], "ADD", SearchOptions(whole_word=True)))
    assert "EqualTo(name_fold,add)" in exact
    part = plan(search.matching(idx.tables()[1], "_", SearchOptions()))
    assert "StringContains(name_fold,_)" in part
    counted = plan(search.count_matches(idx.tables()[1], "add", SearchOptions(True, True)))
    assert "EqualTo(name,add)" in counted and "ReadSchema: struct<name:string>" in counted
    assert search.matching(idx.tables(), "_", SearchOptions()).inputFiles()  # no look-up for it: all symbols


def test_whole_text_extraction_is_linear(spark):
    """Five MB of macros, twice as many rows in about twice the time."""
    text = lambda n: spark.createDataFrame([("big.h", "".join(f"#define REG_FIELD_{i}_MASK 0x{i:08x}\n" for i in range(n)))], "relative_path string, content string")
    files = text(140_000)
    got = extract.by_text(files).agg(F.count("*").alias("n"), F.max("line_number").alias("m"), F.sum("line_number").alias("s")).first()
    assert tuple(got) == (140_000, 140_000, 140_000 * 140_001 // 2)


def test_upsert_clears_files_without_symbols(spark):
    have = extract.symbols(spark.createDataFrame([("old_sym", "macro", "a.c", 1, 0), ("keep", "macro", "b.c", 1, 0)], "name string, kind string, relative_path string, line_number int, col int"))
    meta = spark.createDataFrame([("a.c",)], "relative_path string")
    out = index.apply_symbols(have, have.limit(0), meta, meta.limit(0))
    assert [r["name"] for r in out.collect()] == ["keep"]


def test_overlapping_include_paths_read_once(spark, tree):
    got = corpus.scan_tree(spark, str(tree), include_paths=["src", "src"]).collect()
    assert [r["relative_path"] for r in got] == ["src/util.c"]


def test_session():
    s, calls = session.Session(), []
    s.listeners.append(lambda: calls.append(1))
    first = s.add("q", SearchOptions(), ["a", "b"], total=5)
    assert s.step(1) == "a" and s.step(1) == "b" and s.step(1) == "a" and s.step(-1) == "b"
    assert s.load_more(lambda e, limit, offset: ["c"] if offset == 2 else []) == 1
    assert s.entries[first].loaded == 3 and s.entries[first].total == 5
    second = s.add("r", SearchOptions(), ["z"], append=True)
    assert [r for _, r in s.results()] == ["a", "b", "c", "z"] and s.cursor == -1
    assert not s.select("nope") and s.select(first) and s.go_to(2) and not s.go_to(3)
    s.delete(first)
    assert s.active is None and second in s.entries and calls
    flat = session.Session(wrap=False)
    flat.add("q", SearchOptions(), ["a"])
    assert flat.step(1) == "a" and flat.step(1) is None


def test_a_failed_search_keeps_entries():
    s = session.Session()
    s.add("q", SearchOptions(), ["a"])
    assert s.run("bad", SearchOptions(), lambda: 1 / 0) == 0 and isinstance(s.error, ZeroDivisionError) and [r for _, r in s.results()] == ["a"]
    assert s.run("r", SearchOptions(), lambda: (["b"], 7)) == 7 and s.error is None and [r for _, r in s.results()] == ["b"]


def test_highlights_and_hits(spark):
    marks = session.toggled(session.toggled([], "a"), "b")
    assert marks == [{"text": "a", "color_index": 0}, {"text": "b", "color_index": 1}] and session.toggled(marks, "a") == [marks[1]]
    assert session.hit_label(3, 1, "x") == "2 of 3" and session.hit_label(0, -1, "x") == "No results" == session.hit_label(3, 0, "") and session.hit_label(0, -1, "(", False) == "Invalid regex"
    rows = spark.createDataFrame([("/w/a.c", "a.c", i, "Foo bar", i, 4, i) for i in range(4)], "file_path string, relative_path string, line_number int, line_content string, match_start int, match_length int, global_index int")
    hits = session.numbered_hits(rows.filter("global_index <> 1"), "foo").orderBy("k").collect()
    assert [(r["global_index"], r["k"], r["n"]) for r in hits] == [(0, 1, 3), (2, 2, 3), (3, 3, 3)]
    assert [(r["line_number"], r["match_end"]) for r in session.in_open_file(rows, "/w/a.c", 2).orderBy("line_number").collect()] == [(1, 5), (2, 6)]
    assert session.first_in_file(rows, "a.c").first()["global_index"] == 0 and session.first_in_file(rows, "a.c", 3).first()["global_index"] == 3 and session.first_in_file(rows, "b.c").count() == 0
    shown = spark.range(1).select(T.highlighted(F.lit("a<B aB"), [("ab", "red"), ("<b", "blue")]).alias("h")).first()["h"]
    assert shown.count("<span") == 2 and "&lt;b</span>" in shown and ">ab</span>" in shown


def test_settings_and_ignore_rules(spark):
    assert [T.page_size(x) for x in (None, 1, 200, 99_999, float("nan"), True, 60.5)] == [200, 50, 200, 10_000, 200, 200, 60]
    assert T.merged_filters([".c"], ["x"], [], ["y"]) == ([".c"], ["x", "y"]) and T.merged_filters([".c"], ["x"], ["*.h"]) == (["*.h"], ["x"])
    paths = ["a.tmp", "src/a.tmp", "build/x.c", "src/build/x.c", "keep.tmp", "docs/a/b.md", "docs/b.md", "x.c"]
    rules = T.ignore_rules("# c\n*.tmp\n!keep.tmp\n/build/\ndocs/*.md\n")
    left = search.not_ignored(spark.createDataFrame([(p,) for p in paths], "relative_path string"), rules)
    assert {r[0] for r in left.collect()} == {"src/build/x.c", "keep.tmp", "docs/a/b.md", "x.c"}
    got = spark.range(1).select(T.max_file_bytes_column(F.lit(float("inf"))).alias("a"), T.clean_name(F.lit("🎉" * 600)).alias("b"), T.clean_name(F.lit("a" + "🎉" * 600)).alias("c"), T.clean_name(F.lit("🎉\r\nb")).alias("d")).first()
    assert got["a"] == T.max_file_bytes(float("inf")) == 1 << 20
    assert got["b"] == "🎉" * 512 and got["c"] == "a" + "🎉" * 511 + "\ufffd" and got["d"] == "🎉 b"


def test_unicode_words_and_folds(spark):
    lines = spark.createDataFrame([("a.c", 1, "un café"), ("a.c", 2, "caf x"), ("b.c", 1, "État final"), ("b.c", 2, "a\0caf")], "relative_path string, line_number int, line string")
    found = lambda q, **o: {(r["relative_path"], r["line_number"]) for r in search.text_search(lines, q, SearchOptions(**o)).collect()}
    assert found("caf", whole_word=True) == {("a.c", 2), ("b.c", 2)} and found("état", whole_word=True) == {("b.c", 1)}
    names = extract.symbols(spark.createDataFrame([("État_1", "macro", "x.c", 1, 0)], "name string, kind string, relative_path string, line_number int, col int"))
    assert search.matching(names, "^éta.", SearchOptions(regex=True), "exact").count() == 1
    files = spark.createDataFrame([("a.c", "x\r\ny"), ("bin.c", "a\0b\nc")], "relative_path string, content string")
    assert [(r["line_number"], r["line"]) for r in corpus.split_lines(files).orderBy("line_number").collect()] == [(1, "x\r"), (2, "y")]
    assert corpus.split_lines(files, binary=True).count() == 4


def test_canonical_root(tmp_path):
    (tmp_path / "real").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "real")
    assert corpus.canonical_root(f"{tmp_path}/link/../link/") == os.path.realpath(tmp_path / "real")
    assert corpus.canonical_root(f"{tmp_path}/none/") == os.path.realpath(tmp_path) + "/none" and corpus.canonical_root("s3://b/x/") == "s3://b/x"


def test_diagnostics_and_samples(spark, tmp_path, monkeypatch):
    events = spark.createDataFrame([(5, "file:error", 7, "a.c"), (6, "file:entered", 7, None)], "t long, event string, pid int, file string")
    assert not telemetry.write_diagnostics(events, str(tmp_path / "log")) and not (tmp_path / "log").exists()
    monkeypatch.setenv(telemetry.SWITCH, "1")
    assert telemetry.write_diagnostics(events, str(tmp_path / "log")) and telemetry.write_diagnostics(events, str(tmp_path / "log"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "log")).collect()]
    assert sorted(lines) == sorted(['{"t":5,"event":"file:error","pid":7,"file":"a.c"}', '{"t":6,"event":"file:entered","pid":7}'] * 2)
    (tmp_path / "file").write_text("x")
    assert not telemetry.write_diagnostics(events, str(tmp_path / "file" / "below"))  # can't be written, doesn't raise
    samples = spark.createDataFrame([(1, 10, 20, 30), (4, 50, 60, 70)], "timestamp long, rss_kb long, heap_kb long, db_size_bytes long")
    telemetry.write_samples(samples, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == telemetry.SAMPLES
    assert tuple(telemetry.sample_summary(samples, "timestamp", "rss_kb").first()) == (50, 2, 3)
    assert tuple(telemetry.sample_summary(samples.limit(0), "timestamp", "rss_kb").first()) == (0, 0, 0)


def test_session_ids_clear_and_progress(spark, tree, tmp_path):
    s = session.Session()
    ids = [s.add("q", SearchOptions(), ["a"]) for _ in range(3)]
    assert len(set(ids)) == 3 and all(i.startswith("search-") for i in ids)
    s.clear()
    assert not s.entries and s.active is None and s.results() == []
    phases = []
    Index(spark, str(tree), str(tmp_path / "index")).synchronize(phases.append)
    assert phases == ["scanning", "classifying", "parsing", "saving"]


def test_change_stream_takes_few_files_at_a_time(spark, tmp_path):
    log = str(tmp_path / "log")
    for i in range(5):
        spark.createDataFrame([(f"{i}.c", "change", i)], "relative_path string, op string, t long").select("relative_path", "op", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(log)
    seen = []
    changes.follow(changes.change_stream(spark, log, files_per_trigger=2), lambda dirty, gone: seen.append(dirty.count()), str(tmp_path / "cp")).awaitTermination(60)
    assert sum(seen) == 5 and max(seen) <= 2


def test_a_stopped_search_raises(spark):
    def work():
        threading.Timer(0.5, lambda: spark.sparkContext.cancelJobsWithTag("find-1")).start()
        return spark.range(8).mapInArrow(lambda batches: (time.sleep(3) or b for b in batches), "id long").count()

    with pytest.raises(index.Cancelled):
        index.stoppable(spark, "find-1", work)


def test_auto_sync_waits_for_quiet():
    calls = []
    auto = changes.AutoSync(lambda: calls.append(1), 0.15)
    for _ in range(3):
        auto.mark("a.c")
        time.sleep(0.03)
    time.sleep(0.4)
    assert calls == [1]
    auto.mark("b.c")
    auto.dispose()
    time.sleep(0.3)
    off = changes.AutoSync(lambda: calls.append(2), 0.01, enabled=False)
    off.mark("a.c")
    time.sleep(0.1)
    assert calls == [1]


def test_batches_are_runs_in_path_order(spark):
    paths = [f"d{i % 7}/f{i}.c" for i in range(1_000)]
    got = index.batches(spark.createDataFrame([(p, 1) for p in paths], "relative_path string, size_bytes long").repartition(5), 128, groups=4)
    assert {r["relative_path"]: r["batch"] for r in got.collect()} == {p: i // 128 for i, p in enumerate(sorted(paths))}
    assert [r["files_done"] for r in index.progress(got).orderBy("batch").collect()] == [min(1_000, 128 * (i + 1)) for i in range(8)]


def test_find_in_results_and_overlapping_highlights(spark):
    rows = spark.createDataFrame([("a.c", 1, "Foo bar"), ("foo.c", 2, "x")], "relative_path string, line_number int, line_content string")
    assert session.find_in_results(rows, "foo").count() == 2 and session.find_in_results(rows, "foo", SearchOptions(True)).count() == 1
    assert session.find_in_results(rows, "(", SearchOptions(regex=True)).count() == 0
    lines = spark.createDataFrame([("a.c", 1, "aAaa")], "relative_path string, line_number int, line string")
    marks = spark.createDataFrame([("aa", "red")], "text string, color string")
    assert [r["at"] for r in session.occurrences(lines, marks).orderBy("at").collect()] == [0, 1, 2]


def test_change_stream_equals_batch(spark, tmp_path):
    rows = [("a.c", "change", 1), ("b.c", "delete", 2), ("a.c", "delete", 3), ("b.c", "create", 4), ("note.txt", "change", 5), ("build/x.c", "change", 6)]
    log = str(tmp_path / "log")
    df = spark.createDataFrame(rows, "relative_path string, op string, t long").select("relative_path", "op", F.timestamp_seconds("t").alias("ts"))
    df.coalesce(1).write.parquet(log)
    seen = []
    query = changes.follow(changes.change_stream(spark, log), lambda dirty, gone: seen.append(({r[0] for r in dirty.collect()}, {r[0] for r in gone.collect()})), str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert seen == [({"b.c"}, {"a.c"})]


def test_debounce_as_a_stream(spark, tmp_path):
    log = str(tmp_path / "log")
    df = spark.createDataFrame([(i,) for i in (0, 1, 3, 20, 22, 100)], "t long").select(F.timestamp_seconds("t").alias("ts"))
    df.coalesce(1).write.parquet(log)
    stream = changes.debounce(spark.readStream.schema("ts timestamp").parquet(log).withWatermark("ts", "1 second"), "5 seconds")
    query = stream.writeStream.format("memory").queryName("runs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r["n"] for r in spark.sql("select n from runs").collect()) == [2, 3]  # the last run is still open
