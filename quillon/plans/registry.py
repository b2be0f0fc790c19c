"""Named queries over the driver's tables, with the SQL that states the same result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillon import schema
from quillon.functions import text as T
from quillon.operators import extract, index, search, session, telemetry
from quillon.schema import SearchOptions
from quillon.session import scratch_dir
from quillon.sources import corpus
from quillon.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# SQL of the synthetic corpus and what is extracted from it. The definition patterns, as in `extract`.

CORPUS = """
corpus as (select path as relative_path, row_number() over (partition by path order by tag, k)::int as line_number, line from (
  select 'include/' || lower(replace(p_brand, '#', '_')) || '.h' as path, 1 as tag, p_partkey as k,
    '#define PART_' || p_partkey::varchar || '_' || upper(replace(p_name, ' ', '_')) || ' ' || p_size::varchar as line from part
  union all select 'src/nation_' || s_nationkey::varchar || '.cpp', 1, s_suppkey, 'struct supplier_' || s_suppkey::varchar || ' {' from supplier
  union all select 'src/nation_' || c_nationkey::varchar || '.cpp', 2, c_custkey,
    'static inline const char *customer_' || c_custkey::varchar || '_' || lower(c_mktsegment) || '(int a, struct t *b) {' from customer))"""
SYMBOLS = CORPUS + """,
found as (select relative_path, line_number, line, 'macro' as kind, regexp_extract(line, '^[ \\t]*#[ \\t]*define[ \\t]+([A-Za-z_][A-Za-z0-9_]*)', 1) as name from corpus
  union all select relative_path, line_number, line, 'struct', regexp_extract(line, '^[ \\t]*(?:typedef[ \\t]+)?struct[ \\t]+([A-Za-z_][A-Za-z0-9_]*)[ \\t]*\\{', 1) from corpus
  union all select relative_path, line_number, line, 'function', regexp_extract(line, '^[ \\t]*(?:(?:static|inline|extern|const|virtual|explicit|constexpr|[A-Z_]+)[ \\t]+)*[A-Za-z_][A-Za-z0-9_:<>, \\t\\*&]*?[ \\t\\*&]+([A-Za-z_][A-Za-z0-9_]*)[ \\t]*\\([^;{}]*\\)[ \\t]*\\{', 1) from corpus),
symbols as (select name, kind, relative_path, line_number, (strpos(line, name) - 1)::int as col, line,
  translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as name_fold,
  ' ' || array_to_string(list_filter(string_split_regex(lower(name), '[^\\p{L}\\p{N}]+'), lambda t: t <> ''), ' ') || ' ' as toks from found where name <> '')"""
DOC_LINES = """
doc_lines as (select relative_path, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1)::int as line_number
  from (select 'docs/' || coalesce(source, 'none') || '/' || doc_id::varchar || '.txt' as relative_path, text from documents where text is not null))"""


def _symbols(spark: SparkSession, sf: str) -> DataFrame:
    return extract.symbols(extract.by_line(corpus.synthetic_lines(spark, sf)))


def register(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        SQL[name] = sql


# corpus and extraction

register("corpus_lines", corpus.synthetic_lines, f"with {CORPUS} select relative_path, line_number, line from corpus")
register("doc_lines", lambda s, d: corpus.document_lines(s, d), f"with {DOC_LINES} select relative_path, line_number, rtrim(line, chr(13)) as line from doc_lines")
for _kind in ("macro", "struct", "function"):
    register(
        f"extract_{_kind}s",
        lambda s, d, k=_kind: extract.by_line(corpus.synthetic_lines(s, d)).filter(F.col("kind") == k),
        f"with {SYMBOLS} select relative_path, line_number, col, name, kind, line from symbols where kind = '{_kind}'",
    )


def brace_next_line(spark: SparkSession, sf: str) -> DataFrame:
    """All lines, with each brace at a line's end put on a line of its own: functions are found, types aren't."""
    lines = corpus.synthetic_lines(spark, sf)
    parts = F.array(F.regexp_replace("line", r" \{$", ""), F.when(F.col("line").endswith(" {"), "{").otherwise(""))
    two = lines.select("relative_path", F.posexplode(parts).alias("p", "line"), (F.col("line_number") * 2).alias("n"))
    return extract.by_line(two.select("relative_path", (F.col("n") + F.col("p")).alias("line_number"), "line")).drop("line")


register("extract_brace_next_line", brace_next_line, f"with {SYMBOLS} select relative_path, line_number * 2 as line_number, col, name, kind from symbols where kind <> 'struct'")


LINES = 4096  # of a part of a file


def _contents(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus as files in parts."""
    return extract.in_parts(corpus.synthetic_lines(spark, sf), F.expr(f"(line_number - 1) div {LINES}"), "line_number")


register("extract_whole_text", lambda s, d: extract.by_text(_contents(s, d)), f"with {SYMBOLS} select relative_path, line_number, 0 as col, name, kind from symbols")
register(
    "extract_syntax_tree",
    lambda s, d: extract.by_lexer(_contents(s, d)).select("relative_path", "line_number", "col", "name", "kind"),
    f"""with {SYMBOLS}, lines as (select relative_path, line_number, name, kind, line from symbols)
select relative_path, line_number, (strpos(line, name) - 1)::int as col, name, kind from lines where kind in ('macro', 'struct')
union all select relative_path, line_number, (strpos(line, 'struct t') + 6)::int, 't', 'struct' from lines where kind = 'function'""",
)


# How a customer's function is declared, and whether that makes a function of its name.
FORMS = (
    ("int {n}(int a) noexcept {{", True), ("auto {n}(int a) -> int {{", True), ("int {n}(void) __attribute__((unused)) {{", True), ("char *{n}(int a) {{", False), ("int W::{n}() {{", False), ("template <class T, typename U = less<T>> T {n}(T a) {{", True),
    ("int (*{n}(int a))(int) {{", False), ("int {n}(void (*cb)(int), int b) const {{", True), ("[[nodiscard]] static std::map<int, pair<a, b>> {n}(int a[3]) {{", True), ("int x = {n}(a) {{", False), ("for_each({n}(a)) {{", False),
)


def declarators(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as functions, declared in many forms, by the lexer."""
    name = F.concat(F.lit("fn_"), F.col("c_custkey").cast("string"))
    form = F.element_at(F.array(*[F.lit(f.replace("{{", "{")) for f, _ in FORMS]), (F.col("c_custkey") % len(FORMS) + 1).cast("int"))
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(F.concat(F.lit("src/"), F.col("c_nationkey").cast("string"), F.lit(".cpp")).alias("relative_path"), "c_custkey", F.concat(F.replace(form, F.lit("{n}"), name), F.lit("\n}")).alias("line"))
    files = extract.in_parts(rows, F.expr(f"c_custkey div {LINES}"), "c_custkey")
    return extract.by_lexer(files).select("relative_path", "line_number", "col", "name", "kind")


register(
    "extract_declarators",
    declarators,
    "with forms as (select unnest([" + ", ".join("'" + f.replace("{{", "{") + "'" for f, _ in FORMS) + "]) as form, unnest([" + ", ".join(str(ok).lower() for _, ok in FORMS) + "]) as ok, unnest(range(" + str(len(FORMS)) + ")) as k), "
    "heads as (select 'src/' || c_nationkey::varchar || '.cpp' as relative_path, (row_number() over (partition by c_nationkey order by c_custkey) * 2 - 1)::int as line_number, 'fn_' || c_custkey::varchar as name, form, ok from customer join forms on c_custkey % "
    + str(len(FORMS)) + " = k) select relative_path, line_number, (strpos(form, '{n}') - 1)::int as col, name, 'function' as kind from heads where ok",
)


def large_file(spark: SparkSession, sf: str) -> DataFrame:
    """All orders as macros of one file (five megabytes at sf0.1)."""
    line = F.concat(F.lit("#define REG_FIELD_"), F.col("o_orderkey").cast("string"), F.lit("_MASK 0x0000ff"))
    lines = spark.read.parquet(f"{sf}/orders.parquet").select(F.lit("big.h").alias("relative_path"), "o_orderkey", line.alias("line"))
    return extract.by_text(extract.in_parts(lines, F.expr(f"o_orderkey div {LINES}"), "o_orderkey"))


register(
    "extract_large_file",
    large_file,
    "select 'big.h' as relative_path, (row_number() over (order by o_orderkey))::int as line_number, 0 as col, 'REG_FIELD_' || o_orderkey::varchar || '_MASK' as name, 'macro' as kind from orders",
)


def keyword_names(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as functions and types whose names are words that are none, but for one in so many."""
    words = F.array(*map(F.lit, (*extract.KEYWORDS, "good")))
    word = F.element_at(words, (F.col("c_custkey") % (len(extract.KEYWORDS) + 1) + 1).cast("int"))
    path = F.concat(F.lit("src/"), F.col("c_nationkey").cast("string"), F.lit(".c"))
    pair = F.array(F.concat(F.lit("void "), word, F.lit("(int a) {")), F.concat(F.lit("struct "), word, F.lit(" {")))
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(path.alias("relative_path"), F.posexplode(pair).alias("p", "line"), "c_custkey")
    return extract.by_line(rows.select("relative_path", (F.col("c_custkey") * 2 + F.col("p")).cast("int").alias("line_number"), "line")).select("relative_path", "line_number", "name", "kind")


register(
    "extract_keyword_names",
    keyword_names,
    f"select 'src/' || c_nationkey::varchar || '.c' as relative_path, (c_custkey * 2 + i)::int as line_number, 'good' as name, ['function', 'struct'][i + 1] as kind from customer, range(2) r(i) where c_custkey % {len(extract.KEYWORDS) + 1} = {len(extract.KEYWORDS)}",
)
register(
    "extract_macros_only",
    lambda s, d: extract.by_line(corpus.synthetic_lines(s, d), macros_only=True).drop("line"),
    f"with {SYMBOLS} select relative_path, line_number, col, name, kind from symbols where kind = 'macro'",
)
register(
    "symbols_all",
    lambda s, d: _symbols(s, d).select("name", "name_fold", F.col("kind").cast("int").alias("kind"), "relative_path", "line_number", "col", F.array_join("tokens", " ").alias("tokens")),
    f"with {SYMBOLS} select name, name_fold, case kind when 'function' then 0 when 'struct' then 2 else 6 end as kind, relative_path, line_number, col, trim(toks) as tokens from symbols",
)
register(
    "kind_codec",
    lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", (F.col("p_size") % 11 - 1).alias("code")).select("p_partkey", schema.decode_kind(F.col("code")).alias("kind"), schema.encode_kind(schema.decode_kind(F.col("code"))).cast("int").alias("back")),
    "select p_partkey, coalesce(case when c between 0 and 8 then ks[c + 1] end, 'variable') as kind, case when c between 0 and 8 then c else 7 end::int as back from (select p_partkey, p_size % 11 - 1 as c, ['function','class','struct','enum','typedef','namespace','macro','variable','union'] as ks from part)",
)
register(
    "clean_names",
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").filter("text is not null").select("doc_id", T.clean_name(F.col("text")).alias("name")),
    "select doc_id, substring(regexp_replace(text, '\\r\\n|\\r|\\n', ' ', 'g'), 1, 1024) as name from documents where text is not null",
)

# search

FIND = {
    "find_exact_cs": (lambda s, d: _seventh(s, d), SearchOptions(True, True), "name = (select 'customer_7_' || lower(c_mktsegment) from customer where c_custkey = 7)"),
    "find_exact_ci": (lambda s, d: _seventh(s, d).upper(), SearchOptions(False, True), "name_fold = (select 'customer_7_' || lower(c_mktsegment) from customer where c_custkey = 7)"),
    "find_substring_ci": ("Ring", SearchOptions(), "contains(name_fold, lower('{q}')) and contains(toks, ' ring ')"),
    "find_substring_cs": ("RING", SearchOptions(True), "contains(name, '{q}') and contains(toks, ' ring ')"),
    "find_substring_no_token": ("_", SearchOptions(), "contains(name_fold, '_')"),
    "find_substring_cs_no_token": ("R", SearchOptions(True), "contains(name, 'R')"),
    "find_token_phrase": ("small_ring", SearchOptions(), "contains(name_fold, 'small_ring') and contains(toks, ' small ring ')"),
    "find_partial_token": ("rin", SearchOptions(), "contains(name_fold, 'rin') and contains(toks, ' rin ')"),
    "find_number_token": ("PART_1", SearchOptions(), "contains(name_fold, 'part_1') and contains(toks, ' part 1 ')"),
    "find_regex": ("supplier.*1$", SearchOptions(regex=True), "regexp_matches(name, '(?i)supplier.*1$') and contains(toks, ' supplier ')"),
    "find_regex_no_token": ("^c.+g$", SearchOptions(True, regex=True), "regexp_matches(name, '^c.+g$')"),
    "find_nothing": ("", SearchOptions(), "false"),
    "find_bad_regex": ("foo(", SearchOptions(regex=True), "false"),
    "find_two_words": ("small ring", SearchOptions(), "contains(name_fold, 'small ring') and (contains(toks, ' small ') or contains(toks, ' ring '))"),
    "find_two_runs": ("small.*_ring|part_1.*", SearchOptions(regex=True), "regexp_matches(name, '(?i)small.*_ring|part_1.*') and (contains(toks, ' small ') or contains(toks, ' ring ') or contains(toks, ' part 1 '))"),
    "find_long_phrase": ("_small_ring_", SearchOptions(), "contains(name_fold, '_small_ring_') and contains(toks, ' small ring ')"),
}
_ROW = "name, relative_path, line_number, col"


def _seventh(spark: SparkSession, sf: str) -> str:
    """A name that the corpus has at any size."""
    segment = spark.read.parquet(f"{sf}/customer.parquet").filter("c_custkey = 7").first()["c_mktsegment"]
    return f"customer_7_{segment.lower()}"


_published: dict[tuple[str, str], str] = {}


def _stored(spark: SparkSession, sf: str) -> index.Snapshot:
    """A published index, written once an application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _published:
        root = f"{scratch_dir(spark)}/quillon-index-{uuid.uuid4().hex[:12]}"
        lines = corpus.synthetic_lines(spark, sf)
        files = lines.groupBy("relative_path").agg(F.lit(1).alias("mtime_ms"), F.sum(F.length("line")).alias("size_bytes"), F.count("*").alias("symbol_count"))
        index.Store(spark, root).publish(files, _symbols(spark, sf))
        _published[key] = root
    return index.Store(spark, _published[key]).load()


for _name, (_q, _options, _where) in FIND.items():
    _cond = _where.format(q=_q)
    for _from, _source in (("", _symbols), ("stored_", _stored)):  # extracted on the way, and from an index
        _ask = lambda s, d, q=_q: q(s, d) if callable(q) else q
        register(_from + _name, lambda s, d, q=_ask, o=_options, f=_source: search.matching(f(s, d), q(s, d), o).select("name", "relative_path", "line_number", "col"), f"with {SYMBOLS} select {_ROW} from symbols where {_cond}")
        register(_from + _name.replace("find_", "count_"), lambda s, d, q=_ask, o=_options, f=_source: search.count_matches(f(s, d), q(s, d), o), f"with {SYMBOLS} select count(*)::bigint as n from symbols where {_cond}")
for _name, _q, _options, _where in (
    ("exact_mode_substring", "rin", SearchOptions(), "contains(name_fold, 'rin')"),
    ("exact_mode_regex", "dev.*|.*ring", SearchOptions(regex=True), "regexp_matches(name, '(?i)dev.*|.*ring')"),
    ("exact_mode_literals", "customer_[0-9]*7_(auto|mach)", SearchOptions(True, regex=True), "regexp_matches(name, 'customer_[0-9]*7_(auto|mach)')"),
):
    for _from, _source in (("", _symbols), ("stored_", _stored)):
        register(_from + _name, lambda s, d, q=_q, o=_options, f=_source: search.matching(f(s, d), q, o, "exact").select("name", "relative_path", "line_number", "col"), f"with {SYMBOLS} select {_ROW} from symbols where {_where}")

_PAGE_SQL = "select name, relative_path, line_number, col, 0 as match_start, len(name)::int as match_length from symbols where contains(name_fold, 'ring') and contains(toks, ' ring ') order by relative_path, line_number, col, name"
register("page_first", lambda s, d: search.search(_symbols(s, d), "ring"), f"with {SYMBOLS} {_PAGE_SQL} limit 200")
register("stored_page_first", lambda s, d: search.search(_stored(s, d), "ring"), f"with {SYMBOLS} {_PAGE_SQL} limit 200")
register("stored_page_second", lambda s, d: search.search(_stored(s, d), "ring", offset=200), f"with {SYMBOLS} {_PAGE_SQL} limit 200 offset 200")
register(
    "page_renumbered",
    lambda s, d: session.numbered(search.search(_symbols(s, d), "part", offset=200), ["relative_path", "line_number", "col", "name"], 200).select("name", F.col("global_index").cast("int").alias("global_index")),
    f"with {SYMBOLS}, page as (select * from symbols where contains(name_fold, 'part') and contains(toks, ' part ') order by relative_path, line_number, col, name limit 200 offset 200) select name, (row_number() over (order by relative_path, line_number, col, name) + 199)::int as global_index from page",
)
def seek_page(spark: SparkSession, sf: str) -> DataFrame:
    """The second page, sought from the first one's last row."""
    last = search.search(_stored(spark, sf), "ring").collect()[-1]
    return search.search(_stored(spark, sf), "ring", seek=(last["relative_path"], last["line_number"], last["col"], last["name"]))


register("stored_page_sought", seek_page, f"with {SYMBOLS} {_PAGE_SQL} limit 200 offset 200")
register("page_second", lambda s, d: search.search(_symbols(s, d), "ring", offset=200), f"with {SYMBOLS} {_PAGE_SQL} limit 200 offset 200")
register(
    "result_lines",
    lambda s, d: search.result_lines(search.search(_symbols(s, d), "ring"), corpus.synthetic_lines(s, d), "/work").select("file_path", "relative_path", "line_number", "line_content", "match_start", "match_length"),
    f"with {SYMBOLS}, page as ({_PAGE_SQL} limit {search.PAGE}) select '/work/' || relative_path as file_path, relative_path, line_number, coalesce(c.line, '') as line_content, match_start, match_length from page left join corpus c using (relative_path, line_number)",
)
register(  # every symbol's line, and a line after each file's end
    "line_lookup",
    lambda s, d: corpus.line_at(corpus.synthetic_lines(s, d), _symbols(s, d).select("relative_path", "line_number").unionByName(_symbols(s, d).groupBy("relative_path").agg((F.max("line_number") + 1).alias("line_number"))).distinct()),
    f"with {SYMBOLS}, wanted as (select relative_path, line_number from symbols union select relative_path, max(line_number) + 1 from symbols group by 1) select relative_path, line_number, coalesce(line, '') as line from wanted left join corpus using (relative_path, line_number)",
)
register(
    "preview_window",
    lambda s, d: corpus.preview(corpus.synthetic_lines(s, d), "src/nation_3.cpp", 20, 10),
    f"with {CORPUS} select line_number as num, line as content from corpus where relative_path = 'src/nation_3.cpp' and line_number between 10 and 30",
)
register(
    "global_index",
    lambda s, d: session.numbered(search.search(_symbols(s, d), "ring"), ["relative_path", "line_number", "col", "name"]).select("name", F.col("global_index").cast("int").alias("global_index")),
    f"with {SYMBOLS}, page as ({_PAGE_SQL} limit {search.PAGE}) select name, (row_number() over (order by relative_path, line_number, col, name) - 1)::int as global_index from page",
)
register(
    "search_filtered",
    lambda s, d: search.path_filter(_symbols(s, d), ["src/**"], ["**/nation_1*"]).select("name", "relative_path", "line_number", "col"),
    f"with {SYMBOLS} select {_ROW} from symbols where relative_path like 'src/%' and relative_path not like '%/nation\\_1%' escape '\\'",
)

# full text

_GREP = "relative_path, line_number, line as line_content"
_BYTES = "strlen(substr(line, 1, strpos({hay}, {needle}) - 1))::int as match_start, 0 as match_length"
register(
    "grep_literal_ci",
    lambda s, d: search.text_search(corpus.document_lines(s, d), "tion"),
    f"with {DOC_LINES} select relative_path, line_number, case when strlen(line) > 4096 then '[Omitted long line with ' || len(regexp_extract_all(line, '(?i)tion'))::varchar || ' matches]' else line end as line_content, "
    + _BYTES.format(hay="lower(line)", needle="'tion'") + " from doc_lines where regexp_matches(line, '(?i)tion')",
)
register(
    "grep_literal_cs",
    lambda s, d: search.text_search(corpus.synthetic_lines(s, d), "struct supplier", SearchOptions(True)),
    f"with {CORPUS} select {_GREP}, " + _BYTES.format(hay="line", needle="'struct supplier'") + " from corpus where contains(line, 'struct supplier')",
)
register(
    "grep_word",
    lambda s, d: search.text_search(corpus.document_lines(s, d), "the", SearchOptions(whole_word=True)).select("relative_path", "line_number"),
    f"with {DOC_LINES} select relative_path, line_number from doc_lines where regexp_matches(line, '(?i)(^|[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}])the([^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]|$)')",
)
register(
    "grep_regex",
    lambda s, d: search.text_search(corpus.synthetic_lines(s, d), "customer_[0-9]+5_[a-m]", SearchOptions(regex=True)).select("relative_path", "line_number", "match_start"),
    f"with {CORPUS} select relative_path, line_number, strlen(regexp_extract(line, '(?i)^(.*?)customer_[0-9]+5_[a-m]', 1))::int as match_start from corpus where regexp_matches(line, '(?i)customer_[0-9]+5_[a-m]')",
)
register(
    "grep_globs",
    lambda s, d: search.text_search(corpus.synthetic_lines(s, d), "struct", include=[".cpp"], exclude=["src/nation_2*"]).select("relative_path", "line_number"),
    f"with {CORPUS} select relative_path, line_number from corpus where contains(lower(line), 'struct') and relative_path like '%.cpp' and relative_path not like 'src/nation\\_2%' escape '\\'",
)
register(
    "grep_long_line",
    lambda s, d: search.text_search(s.read.parquet(f"{d}/pages.parquet").select(F.concat(F.lit("p/"), F.col("page_id").cast("string")).alias("relative_path"), F.lit(1).alias("line_number"), F.regexp_replace("html", "\n", " ").alias("line")), "div", SearchOptions(True)),
    "select 'p/' || page_id::varchar as relative_path, 1 as line_number, case when strlen(line) > 4096 then '[Omitted long line with ' || len(regexp_extract_all(line, 'div'))::varchar || ' matches]' else line end as line_content, strlen(substr(line, 1, strpos(line, 'div') - 1))::int as match_start, 0 as match_length from (select page_id, replace(html, chr(10), ' ') as line from pages) where contains(line, 'div')",
)
register(
    "grep_conversations",
    lambda s, d: search.text_search(s.read.parquet(f"{d}/conversations.parquet").select(F.concat(F.lit("c/"), F.col("conv_id").cast("string")).alias("relative_path"), F.col("turn").cast("int").alias("line_number"), F.col("text").alias("line")), "th", SearchOptions(True)).select("relative_path", "line_number", "match_start"),
    "select 'c/' || conv_id::varchar as relative_path, turn::int as line_number, strlen(substr(text, 1, strpos(text, 'th') - 1))::int as match_start from conversations where contains(text, 'th')",
)
_RAW = "concat_ws(':', concat('./', relative_path), cast(line_number as string), cast(line_number % 9 + 1 as string), line)"
register(
    "parse_grep_line",
    lambda s, d: corpus.synthetic_lines(s, d).select(search.parse_grep_line(F.expr(_RAW)).alias("x")).filter("x is not null").select("x.*"),
    f"with {CORPUS} select relative_path, line_number, (line_number % 9)::int as match_start, line as line_content, 0 as match_length from corpus",
)

# hybrid

_RESULT = "relative_path, line_number, line_content, match_start, match_length"
register(
    "hybrid_hit",
    lambda s, d: search.hybrid_search(_symbols(s, d), corpus.synthetic_lines(s, d), "ring"),
    f"with {SYMBOLS}, page as ({_PAGE_SQL} limit 200) select relative_path, line_number, c.line as line_content, match_start, match_length from page join corpus c using (relative_path, line_number)",
)
register(
    "hybrid_fallback",
    lambda s, d: search.hybrid_search(_symbols(s, d), corpus.synthetic_lines(s, d), "omer_1"),
    f"with {CORPUS} select {_GREP}, " + _BYTES.format(hay="lower(line)", needle="'omer_1'") + " from corpus where contains(lower(line), 'omer_1')",
)
register(
    "hybrid_page_past_end",
    lambda s, d: search.hybrid_search(_symbols(s, d), corpus.synthetic_lines(s, d), "omer_1", offset=200),
    "select '' as relative_path, 0 as line_number, '' as line_content, 0 as match_start, 0 as match_length where false",
)


def sync_time_decision(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*map(F.lit, ("cancel", "grep-fallback", "prompt-cancel", "prompt-grep-fallback", "other")))
    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("behavior"), (F.col("o_orderkey") * 7 % 2000).alias("age"), F.element_at(F.array(F.lit(""), F.lit("grep"), F.lit("cancel")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("cached"))
    return rows.select("o_orderkey", search.sync_decision(F.col("behavior"), F.lit(10_000), 10_000 - F.col("age"), F.col("cached")).alias("x")).select("o_orderkey", "x.action", "x.expect")


register("sync_time_decision", sync_time_decision, """
with rows as (select o_orderkey, ['cancel','grep-fallback','prompt-cancel','prompt-grep-fallback','other'][o_orderkey % 5 + 1] as b, o_orderkey * 7 % 2000 < 1000 and o_orderkey % 3 > 0 as held, ['','grep','cancel'][o_orderkey % 3 + 1] as cached from orders)
select o_orderkey, case when held then cached when b = 'cancel' then 'cancel' when b = 'grep-fallback' then 'grep' else 'prompt' end as action,
  case when held or b in ('cancel', 'grep-fallback') then null when b = 'prompt-cancel' then 'cancel' else 'grep-fallback' end as expect from rows""")

# maintenance


def _files(spark: SparkSession, sf: str, old: bool) -> DataFrame:
    """Orders as files: the old state lacks some and differs in others."""
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.concat(F.lit("f/"), F.col("o_orderkey").cast("string"), F.lit(".c")).alias("relative_path"), "o_orderkey")
    if old:
        rows = rows.filter("o_orderkey % 11 <> 0")
        return rows.select("relative_path", (F.col("o_orderkey") * 10 + F.when(F.expr("o_orderkey % 7 = 0"), 1).otherwise(0)).alias("mtime_ms"), (F.col("o_orderkey") % 100).alias("size_bytes"), (F.col("o_orderkey") % 3).cast("int").alias("symbol_count"))
    rows = rows.filter("o_orderkey % 13 <> 0")
    return rows.select("relative_path", (F.col("o_orderkey") * 10).alias("mtime_ms"), (F.col("o_orderkey") % 100 + F.when(F.expr("o_orderkey % 17 = 0"), 1).otherwise(0)).alias("size_bytes"), F.lit(1).alias("symbol_count"))


_CHANGED = "k % 13 <> 0 and (k % 11 = 0 or k % 7 = 0 or k % 17 = 0)"
_ORDERS = "orders_ as (select o_orderkey as k, 'f/' || o_orderkey::varchar || '.c' as relative_path from orders)"
register("classify_changed", lambda s, d: index.changed(_files(s, d, False), _files(s, d, True)).select("relative_path"), f"with {_ORDERS} select relative_path from orders_ where {_CHANGED}")
register("classify_deleted", lambda s, d: index.deleted(_files(s, d, False), _files(s, d, True)), f"with {_ORDERS} select relative_path from orders_ where k % 11 <> 0 and k % 13 = 0")
register(
    "apply_changes_files",
    lambda s, d: index.apply_files(_files(s, d, True), index.changed(_files(s, d, False), _files(s, d, True)), index.deleted(_files(s, d, False), _files(s, d, True))),
    f"with {_ORDERS} select relative_path, k * 10 as mtime_ms, k % 100 + case when k % 17 = 0 then 1 else 0 end as size_bytes, case when {_CHANGED} then 1 else (k % 3)::int end as symbol_count from orders_ where k % 13 <> 0",
)


def apply_changes_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Re-read one nation's files, remove another's, and bring in symbols of a file that isn't in the batch (dropped)."""
    have = _symbols(spark, sf)
    meta = spark.createDataFrame([("src/nation_3.cpp",)], "relative_path string")
    gone = spark.createDataFrame([("src/nation_4.cpp",)], "relative_path string")
    new = have.filter("relative_path in ('src/nation_3.cpp', 'src/nation_5.cpp') and kind = 2").withColumn("name", F.concat(F.lit("new_"), "name"))
    return index.apply_symbols(have, new, meta, gone).select("name", "relative_path", "line_number")


register("apply_changes_symbols", apply_changes_symbols, f"with {SYMBOLS} select name, relative_path, line_number from symbols where relative_path not in ('src/nation_3.cpp', 'src/nation_4.cpp') union all select 'new_' || name, relative_path, line_number from symbols where relative_path = 'src/nation_3.cpp' and kind = 'struct'")
register(
    "group_symbols",
    lambda s, d: index.group_symbols(corpus.synthetic_lines(s, d).select("relative_path").distinct().unionByName(s.createDataFrame([("empty.c",)], "relative_path string")), extract.by_line(corpus.synthetic_lines(s, d))).select("relative_path", F.size("symbols").alias("n"), F.array_join(F.transform("symbols", lambda x: x["name"]), ",").alias("names")),
    f"with {SYMBOLS} select relative_path, count(*)::int as n, string_agg(name, ',' order by line_number, name, kind) as names from symbols group by 1 union all select 'empty.c', 0, ''",
)
register(
    "symbol_counts",
    lambda s, d: index.symbol_counts(corpus.synthetic_lines(s, d).select("relative_path").distinct(), _symbols(s, d)),
    f"with {SYMBOLS} select relative_path, count(*)::int as symbol_count from symbols group by 1",
)
register(
    "index_stats",
    lambda s, d: index.stats(corpus.synthetic_lines(s, d).select("relative_path").distinct(), _symbols(s, d)),
    f"with {SYMBOLS} select (select count(distinct relative_path) from corpus)::bigint as files, (select count(*) from symbols)::bigint as symbols",
)
register(
    "size_routing",
    lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", extract.route(F.col("o_orderkey") * 1000).alias("how")),
    "select o_orderkey, case when o_orderkey * 1000 < 1048576 then 'ast' when o_orderkey * 1000 < 10485760 then 'stream' else 'macros' end as how from orders",
)
register(
    "language_routing",
    lambda s, d: corpus.synthetic_lines(s, d).select("relative_path").distinct().select("relative_path", extract.language(F.col("relative_path")).alias("lang")),
    f"with {CORPUS} select distinct relative_path, case when relative_path like '%.h' then 'c' else 'cpp' end as lang from corpus",
)
register(
    "parse_batches",
    lambda s, d: index.batches(_files(s, d, False).select("relative_path")).select("relative_path", F.col("batch").cast("bigint").alias("batch")),
    f"with {_ORDERS} select relative_path, ((row_number() over (order by relative_path) - 1) // 128)::bigint as batch from orders_ where k % 13 <> 0",
)

# change streams (batch form; tests run them as streams)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "create").otherwise("change")
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").cast("string").alias("relative_path"), op.alias("op"), "ts", "event_id")


register(
    "last_event_wins",
    lambda s, d: changes.last_event(_events(s, d), tie="event_id").select("relative_path", "op"),
    "select user_id::varchar as relative_path, arg_max(case event_type when 'error' then 'delete' when 'signup' then 'create' else 'change' end, row(ts, event_id)) as op from events group by 1",
)
register(
    "debounce_sessions",
    lambda s, d: changes.debounce(_events(s, d), "5 minutes").select(F.unix_micros(F.col("first_ts").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("last_ts").cast("timestamp")).alias("last_us"), "n"),
    """with gaps as (select ts, case when ts - lag(ts) over (order by ts) <= interval 5 minutes then 0 else 1 end as new from events),
runs as (select ts, sum(new) over (order by ts rows unbounded preceding) as run from gaps)
select epoch_us(min(ts)) as first_us, epoch_us(max(ts)) as last_us, count(*)::bigint as n from runs group by run""",
)

# session


def _loaded(spark: SparkSession, sf: str) -> DataFrame:
    page = search.result_lines(search.search(_symbols(spark, sf), "ring"), corpus.synthetic_lines(spark, sf))
    return session.numbered(page, ["relative_path", "line_number", "col", "name"])


_LOADED = f"{SYMBOLS}, page as ({_PAGE_SQL} limit {search.PAGE}), loaded as (select page.*, c.line as line_content, (row_number() over (order by relative_path, line_number, col, name) - 1)::int as global_index from page join corpus c using (relative_path, line_number))"
register(
    "navigate_wrap",
    lambda s, d: session.neighbours(_loaded(s, d)).select("name", F.col("next_index").cast("int").alias("next_index"), F.col("previous_index").cast("int").alias("previous_index")),
    f"with {_LOADED} select name, ((global_index + 1) % count(*) over ())::int as next_index, ((global_index - 1 + count(*) over ()) % count(*) over ())::int as previous_index from loaded",
)
register(
    "navigate_ends",
    lambda s, d: session.neighbours(_loaded(s, d), wrap=False).select("name", *[F.coalesce(F.col(c), F.lit(-1)).cast("int").alias(c) for c in ("next_index", "previous_index")]),
    f"with {_LOADED} select name, coalesce(lead(global_index) over (order by global_index), -1)::int as next_index, coalesce(lag(global_index) over (order by global_index), -1)::int as previous_index from loaded",
)
register(
    "find_in_results",
    lambda s, d: session.numbered_hits(_loaded(s, d), "brand_1").select("name", "line_content", F.col("k").cast("int").alias("k"), F.col("n").cast("int").alias("n")),
    f"with {_LOADED} select name, line_content, (row_number() over (order by global_index))::int as k, (count(*) over ())::int as n from loaded where regexp_matches(line_content || chr(10) || relative_path, '(?i)brand_1')",
)
register(
    "jump_to_result",
    lambda s, d: session.first_in_file(_loaded(s, d), "include/brand_11.h").select("name"),
    f"with {_LOADED} select name from loaded where relative_path = 'include/brand_11.h' order by global_index limit 1",
)

register(
    "highlight_positions",
    lambda s, d: session.occurrences(corpus.synthetic_lines(s, d), s.createDataFrame([("ring", "red"), ("11", "blue")], "text string, color string")).select("relative_path", "line_number", F.col("at").cast("int").alias("at"), "text", "color"),
    f"with {CORPUS}, marks as (select * from (values ('ring', 'red'), ('11', 'blue')) m(text, color)) select relative_path, line_number, (i - 1)::int as at, text, color from (select *, unnest(range(1, len(line) + 1)) as i from corpus, marks) where substr(lower(line), i, len(text)) = text",
)
register(
    "color_cycle",
    lambda s, d: s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", session.cycled(F.col("s_suppkey"), ["a", "b", "c"]).alias("color")),
    "select s_suppkey, ['a', 'b', 'c'][s_suppkey % 3 + 1] as color from supplier",
)


def history_summary(spark: SparkSession, sf: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf}/conversations.parquet").groupBy(F.col("conv_id").cast("string").alias("id")).agg(F.concat(F.lit("q"), F.first("conv_id").cast("string")).alias("query"), F.collect_list("turn").alias("results"))
    return session.history_summary(turns.withColumn("total_count", F.when(F.length("id") > 1, F.lit(None).cast("int")).otherwise(7)), "3")


register("history_summary", history_summary, "select conv_id::varchar as id, 'q' || conv_id::varchar as query, case when len(conv_id::varchar) > 1 then count(turn) else 7 end::int as n, conv_id::varchar = '3' as active from conversations group by conv_id")

# scalar functions

register(
    "escape_functions",
    lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", T.quote_phrase(F.concat("p_name", F.lit('"'))).alias("phrase"), T.escape_glob(F.concat(F.lit("*["), "p_brand", F.lit("]?"))).alias("glob"), T.escape_like(F.concat(F.lit("%_"), "p_brand", F.lit("\\"))).alias("like"), T.escape_regex(F.concat("p_brand", F.lit(".*(x)"))).alias("regex")),
    """select p_partkey, '"' || replace(p_name || '"', '"', '""') || '"' as phrase, '[*][[]' || p_brand || '[]][?]' as glob, '\\%\\_' || replace(p_brand, '_', '\\_') || '\\\\' as "like", p_brand || '\\.\\*\\(x\\)' as regex from part""",
)
register(
    "html_escape",
    lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", T.escape_html(F.col("html")).alias("html")),
    "select page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as html from pages",
)
register(
    "extract_tokens",
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.size(T.literal_tokens(F.col("text"))).alias("n"), F.md5(F.array_join(T.literal_tokens(F.col("text")), "|").cast("binary")).alias("digest")),
    "select doc_id, len(t)::int as n, md5(array_to_string(t, '|')) as digest from (select doc_id, regexp_extract_all(text, '[A-Za-z0-9_一-鿿]{2,}') as t from documents)",
)
register(
    "tokenize",
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.size(T.tokens(F.col("text"))).alias("n"), F.md5(F.array_join(T.tokens(F.col("text")), " ")).alias("digest")),
    "select doc_id, len(t)::int as n, md5(array_to_string(t, ' ')) as digest from (select doc_id, list_filter(string_split_regex(lower(strip_accents(text)), '[^\\p{L}\\p{N}\\p{Co}]+'), lambda x: x <> '') as t from documents)",
)
register(
    "ascii_fold",
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", T.ascii_fold(F.col("text")).alias("folded")),
    "select doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as folded from documents",
)
register(
    "comma_list",
    lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.array_join(T.comma_list(F.concat(F.lit(" a, ,"), "p_name", F.lit(" , b"))), "|").alias("items")),
    "select p_partkey, 'a|' || trim(p_name) || '|b' as items from part",
)
register(
    "size_setting",
    lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", T.max_file_bytes_column(F.col("c_acctbal")).alias("bytes")),
    "select c_custkey, case when c_acctbal is null or c_acctbal < 0 then 1048576 else floor(c_acctbal)::bigint end as bytes from customer",
)
register(
    "status_text",
    lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", session.status_text(F.col("o_orderkey"), F.expr("o_orderkey % 2 = 0")).alias("label")),
    "select o_orderkey, format('{:,}', o_orderkey) || ' symbols' || case when o_orderkey % 2 = 0 then ' (stale)' else '' end as label from orders",
)
register(
    "progress_running",
    lambda s, d: index.progress(index.batches(_files(s, d, False))).select(F.col("batch").cast("bigint").alias("batch"), "files_done", "bytes_done"),
    f"with {_ORDERS}, cut as (select (row_number() over (order by relative_path) - 1) // 128 as batch, k % 100 + case when k % 17 = 0 then 1 else 0 end as size from orders_ where k % 13 <> 0) select batch::bigint as batch, sum(count(*)) over (order by batch)::bigint as files_done, sum(sum(size)) over (order by batch)::bigint as bytes_done from cut group by batch",
)
register(
    "diagnostics_json",
    lambda s, d: s.read.parquet(f"{d}/nation.parquet").select(T.diagnostic_line(F.lit("file:parseDone"), F.lit(1), F.col("n_nationkey"), file=F.col("n_name")).alias("line")),
    """select '{"t":' || n_nationkey::varchar || ',"event":"file:parseDone","pid":1,"file":"' || n_name || '"}' as line from nation""",
)
register(
    "sample_summary",
    lambda s, d: telemetry.sample_summary(s.read.parquet(f"{d}/events.parquet").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.round("value").cast("bigint").alias("used")), by=("event_type",)),
    "select event_type, coalesce(max(round(value)::bigint), 0) as peak, count(*)::bigint as samples, epoch_us(max(ts)) - epoch_us(min(ts)) as duration from events group by 1",
)
register(
    "language_alias",
    lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", extract.canonical_language(F.element_at(F.array(*map(F.lit, ["c", "shellscript", "plaintext", "typescriptreact", "cobol"])), (F.col("p_partkey") % 5 + 1).cast("int")), ("c", "bash", "tsx")).alias("lang")),
    "select p_partkey, ['c', 'bash', null, 'tsx', null][p_partkey % 5 + 1] as lang from part",
)
register(
    "highlight_html",
    lambda s, d: corpus.synthetic_lines(s, d).select("relative_path", "line_number", T.highlighted(F.col("line"), [("CUSTOMER", "red"), ("&", "blue")]).alias("html")),
    f"""with {CORPUS} select relative_path, line_number, regexp_replace(regexp_replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
  '&amp;', '<span class="manual-highlight" style="background:blue;color:#1e1e1e;border-color:transparent">&amp;</span>', 'g'),
  'customer', '<span class="manual-highlight" style="background:red;color:#1e1e1e;border-color:transparent">CUSTOMER</span>', 'gi') as html from corpus""",
)
_MARK = '<span class="manual-highlight" style="background:{};color:#1e1e1e;border-color:transparent">'
register(  # a mark is put in where it stands outside tags
    "highlight_html_tags",
    lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", T.highlighted_html(F.col("html"), [("div", "red"), ("th", "blue")]).alias("html")),
    "with first as (select page_id, array_to_string(list_transform(regexp_extract_all(html, '<[^>]*>|[^<]+|<'), lambda x: case when starts_with(x, '<') then x else regexp_replace(x, 'th', '" + _MARK.format("blue") + "\\0</span>', 'gi') end), '') as html from pages) "
    "select page_id, array_to_string(list_transform(regexp_extract_all(html, '<[^>]*>|[^<]+|<'), lambda x: case when starts_with(x, '<') then x else regexp_replace(x, 'div', '" + _MARK.format("red") + "\\0</span>', 'gi') end), '') as html from first",
)
register(
    "highlight_words",
    lambda s, d: session.occurrences(corpus.document_lines(s, d), s.read.parquet(f"{d}/nation.parquet").select(F.lower(F.substring("n_name", 1, 3)).alias("text"), F.first("n_name").over(Window.partitionBy(F.substring("n_name", 1, 3)).orderBy("n_nationkey")).alias("color")).distinct()),
    f"with {DOC_LINES}, marks as (select lower(substr(n_name, 1, 3)) as text, arg_min(n_name, n_nationkey) as color from nation group by 1), parts as (select relative_path, line_number, line, unnest(range(1, len(line) - 1)) as i from doc_lines) "
    "select relative_path, line_number, (i - 1)::int as at, text, color from parts join marks on lower(substr(line, i, 3)) = text",
)
register(  # a file is brought back, but none below a folder that is ignored
    "ignore_files",
    lambda s, d: search.not_ignored(corpus.synthetic_lines(s, d).select("relative_path").distinct(), T.ignore_rules("include/\n*_1.cpp\n!include/brand_11.h\n/src/nation_2*\n!nation_21.cpp\n")),
    f"with {CORPUS} select distinct relative_path from corpus where relative_path = 'src/nation_21.cpp' or not (relative_path like 'include/%' or relative_path like '%\\_1.cpp' escape '\\' or relative_path like 'src/nation\\_2%' escape '\\')",
)
register("file_metadata", lambda s, d: index.file_metadata(_files(s, d, True), "f/1.c"), f"with {_ORDERS} select relative_path, k * 10 as mtime_ms, k % 100 as size_bytes, (k % 3)::int as symbol_count from orders_ where k = 1")
register(
    "open_file_results",
    lambda s, d: session.in_open_file(_loaded(s, d), "/include/brand_11.h", 30).select("name", "line_number", "match_end"),
    f"with {_LOADED} select name, line_number, least(match_start + match_length, len(line_content))::int as match_end from loaded where relative_path = 'include/brand_11.h' and line_number between 1 and 30",
)
register(
    "counts_by_kind",
    lambda s, d: _symbols(s, d).groupBy(schema.decode_kind(F.col("kind")).alias("kind")).agg(F.count("*").alias("n")),
    f"with {SYMBOLS} select kind, count(*)::bigint as n from symbols group by 1",
)


def entry(spark: SparkSession) -> DataFrame:
    """Where is `ring` defined: the first page of definitions, with their lines."""
    sf = "/root/testdata/sf0.001"
    return search.hybrid_search(_symbols(spark, sf), corpus.synthetic_lines(spark, sf), "ring")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
