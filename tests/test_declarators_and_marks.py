"""Declarators in C and C++, ignore files against git, highlights against plain searches."""

import random
import re
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import extract, search, session
from quillon.sources import corpus

FUNCTIONS = [
    ("int f() noexcept {", "f"), ("auto g() -> int {", "g"), ("int h(void) __attribute__((unused)) {", "h"), ("int k(int a) noexcept(sizeof(a) > 1) {", "k"), ("auto m(int a) -> std::vector<int> {", "m"),
    ("static inline const struct page *p(int a) {", None), ("int (*fp(int a))(int) {", None), ("int (f)(int a) {", None), ("int W::n() {", None), ("int f(void (*cb)(int, char), int x) {", "f"), ("std::map<int, std::pair<a, b>> f(T x) {", "f"),
    ("template <typename T, class U = less<T>> T f(T a) {", "f"), ("__attribute__((noinline)) int f(void) {", "f"), ("[[nodiscard]] int f() {", "f"), ("alignas(8) int f(int a) {", "f"), ("decltype(x) f(int a) {", "f"), ("extern \"C\" int f(int a) {", "f"),
    ("MODULE(x) int f(int a) {", "f"), ("int f(int a) __acquires(lock) {", "f"), ("for_each(x) {", None), ("if (a) {", None), ("else if (a) {", None), ("return f(a) {", None), ("int x = f(a) {", None), ("struct S {", None), ("enum E : int {", None),
    ("class A : public B<int(int)> {", None), ("struct S f(int a) {", "f"), ("unsigned long f(int a) {", "f"), ("int &f(int a) {", None), ("T operator+(T a) {", None), ("operator bool() {", None), ("auto f = [](int a) {", None), ("do {", None), ("namespace a::b {", None),
    ("int f(int a) const volatile && {", "f"), ("int f() requires C<int> {", "f"), ("int f(int a[3], char (*b)[4]) {", "f"), ("int\nf\n(\nint a\n)\n{", "f"), ("virtual int f() override final {", "f"), ("~A() {", None), ("catch (E e) {", None), ("int f(int a = (1 + 2)) try {", "f"),
]


@pytest.mark.parametrize(("code", "want"), FUNCTIONS)
def test_declarators(code, want):
    got = [n for n, kind, _, _ in extract.lexed(code + "\n}\n", True) if kind == "function"]
    assert got == ([want] if want else [])


def test_declarations_in_their_places():
    code = "class A {\npublic:\n  int one(int a) { if (a) { f(a); } return 1; }\nprivate: int two() const {\n}\n};\nint three(void) { for (;;) { } }\nint proto(int);\nint four(int a)\n{\n}\nnamespace a::b { int five() { } }\nnamespace c { }\n"
    got = [(n, k, line) for n, k, line, _ in extract.lexed(code, True)]
    assert got == [("A", "class", 1), ("one", "function", 3), ("two", "function", 4), ("three", "function", 7), ("four", "function", 9), ("five", "function", 12), ("c", "namespace", 13)]
    init = "struct B { int x; };\nint late(int a) : x{1}, y{2} { }\nint next(int a) { }\n"
    assert [n for n, k, *_ in extract.lexed(init, True) if k == "function"] == ["late", "next"]
    assert [(n, line, col) for n, k, line, col in extract.lexed("int a(void) { }\n  long bb(void)\n  { }\n", False)] == [("a", 1, 4), ("bb", 2, 7)]


def test_files_in_parts(spark):
    """Read in parts cut after any line, a file gives what it gives whole; its tokens aren't held, nor its parts before the last ones."""
    code = 'struct A\n{ int x; } /* a\n comment { */ a;\nint f(int a,\n  char *b = "x\\\ny")\n{ }\n#define M(a) \\\n  struct N { \\\n  }\n  # define  O\ntypedef struct { int y;\n} P[3]\n[4];\n// line \\\n int no() {\nlate(int a) : x{1},\n y{\n2} { }\ntemplate <\nclass T>\nint g(T a)\n{ }\nu8"s"\nint h() {'
    lines = code.splitlines(keepends=True)
    want = sorted(extract.lexed(code, True))
    assert {n for n, *_ in want} == {"A", "f", "M", "O", "P", "g"}
    for n in (1, 2, 3, 7):
        assert sorted(extract.lexed(["".join(lines[i : i + n]) for i in range(0, len(lines), n)], True)) == want
    rows = spark.createDataFrame([(p, i, line) for p in ("b.cpp", "a.cpp") for i, line in enumerate(lines)], "relative_path string, part int, content string").repartition(5)
    got = sorted((r["relative_path"], r["name"], r["kind"], r["line_number"], r["col"]) for r in extract.by_lexer(rows).collect())
    assert got == [(p, *x) for p in ("a.cpp", "b.cpp") for x in want]
    tokens = extract.Tokens(extract._tokens(("int f(int a) { return a; }\n" for _ in range(5_000)), []))
    held = [len(tokens.held) for _ in extract._definitions(tokens, True)]
    assert max(held) < 25_000 < tokens.first  # of 60,000 tokens


def test_template_parameters_are_no_classes():
    assert [(n, k) for n, k, *_ in extract.lexed("template <class T, class U = map<int, S>> class Box { };\ntemplate <typename T> struct Pair;\ntemplate < class\n", True)] == [("Box", "class"), ("Pair", "struct")]


def test_unclosed_code_ends():
    for code in ("int f(int a {", "template < int f() {", "int f(a) : b{ {{{", "class A < {", "(" * 500 + "{" * 500, "int f() -> {", "[[ int f() {", "struct"):
        list(extract.lexed(code, True))


# ignore files


@pytest.fixture(scope="module")
def ignored_tree(tmp_path_factory):
    at = tmp_path_factory.mktemp("ignored")
    rng = random.Random(8)
    names = ["a.c", "b.c", "c.h", "x.tmp", "keep.tmp", "gen_1.c", "gen_12.c", "README", "[x].c", "sp ace.c", "#h.c", "!n.c"]
    folders = ["", "src", "src/gen", "src/deep/er", "include", "build", "lib/build", "docs/a", "lib"]
    for folder in folders:
        for name in rng.sample(names, 8):
            (at / folder).mkdir(parents=True, exist_ok=True)
            (at / folder / name).write_text("x\n")
    (at / ".gitignore").write_text("# top\n*.tmp\n!keep.tmp\n/build/\ninclude/\n!include/a.c\ngen_?.c\ndocs/**/b.c\n\\#h.c\n\\!n.c\n[[]x].c\nsp ace.c  \n")
    (at / "src/.gitignore").write_text("/gen/*\n!/gen/a.c\n!x.tmp\ndeep/\n")
    (at / "src/deep/er/.gitignore").write_text("!a.c\n")
    (at / "lib/.gitignore").write_text("*\n!*/\n!c.h\n[!a-b].c\n**/README\n")
    return at


@pytest.mark.skipif(shutil.which("git") is None, reason="no git")
def test_ignore_files_as_git_reads_them(spark, ignored_tree):
    subprocess.run(["git", "init", "-q", str(ignored_tree)], check=True)
    paths = sorted(str(p.relative_to(ignored_tree)) for p in ignored_tree.rglob("*") if p.is_file() and ".git/" not in f"{p.relative_to(ignored_tree)}/" and p.name != ".gitignore")
    told = subprocess.run(["git", "-C", str(ignored_tree), "-c", "core.excludesFile=/dev/null", "check-ignore", "--no-index", "--stdin", "-z"], input="\0".join(paths) + "\0", capture_output=True, text=True).stdout
    left = search.not_ignored(spark.createDataFrame([(p,) for p in paths], "relative_path string"), corpus.ignore_rules(spark, str(ignored_tree)))
    assert sorted(r[0] for r in left.collect()) == sorted(set(paths) - set(told.split("\0"))) and 10 < left.count() < len(paths) - 20


def test_a_folder_that_is_ignored_stays_so(spark):
    rules = T.ignore_rules("include/\n!include/a.h\n")
    left = search.not_ignored(spark.createDataFrame([("include/a.h",), ("include",), ("b/include/c.h",), ("x.h",)], "relative_path string"), rules)
    assert {r[0] for r in left.collect()} == {"include", "x.h"}


# highlights


def test_one_automaton_finds_what_each_search_finds(spark):
    rng = random.Random(5)
    alphabet = "abAB é İ"
    lines = [("a.c", i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))) for i in range(60)] + [("a.c", 60, None)]
    marks = {("".join(rng.choice("abABé ") for _ in range(rng.randint(1, 4))), rng.choice(["red", "blue"])) for _ in range(300)}
    marks |= {(f"mark{i}", "red") for i in range(2000)} | {("", "red")}
    got = session.occurrences(spark.createDataFrame(lines, "relative_path string, line_number int, line string"), spark.createDataFrame(sorted(marks), "text string, color string"))
    want = []
    for path, number, line in lines:
        low, places = session.folded(line or "")
        for text, color in marks:
            if text:
                want += [(path, number, places[m.start()] if places else m.start(), text, color) for m in re.finditer(f"(?={re.escape(text.lower())})", low)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 1000
    assert session.occurrences(spark.createDataFrame(lines, "relative_path string, line_number int, line string"), spark.createDataFrame([], "text string, color string")).count() == 0


def test_many_highlights_go_in_several_automata(spark, monkeypatch):
    monkeypatch.setattr(session, "MARKS", 3)
    lines = spark.createDataFrame([("a.c", 1, "abcdefgh")], "relative_path string, line_number int, line string")
    marks = spark.createDataFrame([(c, "red") for c in "abcdefgh"], "text string, color string")
    assert sorted((r["at"], r["text"]) for r in session.occurrences(lines, marks).collect()) == list(enumerate("abcdefgh"))


def test_highlights_outside_tags(spark):
    html = F.lit('<span class="a">A span &lt;a&gt; in</span> text > a < b <a')
    shown = lambda marks, box=False: spark.range(1).select(T.highlighted_html(html, marks, box).alias("h")).first()["h"]
    one = shown([("a", "red")])
    start = '<span class="manual-highlight" style="background:red;color:#1e1e1e;border-color:transparent">'
    assert one == '<span class="a">' + "A span &lt;a&gt; in</span> text > a < b <a".replace("a", f"{start}a</span>").replace("A", f"{start}A</span>", 1).replace(f"sp{start}a</span>n>", "span>")
    assert shown([("<a>", "red")]).count(f"{start}&lt;a&gt;</span>") == 1 and "border-color:red;background:inherit" in shown([("text", "red")], True)
    assert shown([]) == shown([("", "x")]) and "$" in spark.range(1).select(T.highlighted_html(F.lit("a$1"), [("$1", "red")]).alias("h")).first()["h"]
