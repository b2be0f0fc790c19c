"""Symbol search, counts, line text and full-text search.

``compat`` mode matches the engine this one replaces: a query that holds a run of word characters must also match whole tokens.
``exact`` mode is true substring and regular-expression search. One predicate serves search and count, so they agree.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.functions import text as T
from quillon.schema import SearchOptions

PAGE = 200
LONG_LINE = 4096


def phrases(query: str) -> list[list[str]]:
    """The tokens of each of a query's runs of word characters; a run without tokens is empty and matches nothing."""
    return [T.tokens_of(run) for run in T.literal_tokens_of(query)]


def phrase_match(tokens: Column, query: str) -> Column:
    """Whether one of the query's runs is a phrase of adjacent tokens."""
    joined = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    return reduce(lambda a, b: a | b, [joined.contains(f" {' '.join(p)} ") for p in phrases(query) if p], F.lit(False))


def valid_regex(spark, pattern: str) -> bool:
    """Whether the executors' regular expressions take ``pattern``; asked of the JVM, before any task."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except Exception:  # noqa: BLE001 - py4j wraps the syntax error
        return False


def residual(query: str, options: SearchOptions = SearchOptions(), fold: Column | None = None) -> Column:
    """The condition on a symbol's name without that on its tokens; ``fold`` is the folded name."""
    fold = F.col("name_fold") if fold is None else fold
    if options.regex:
        return F.col("name").rlike(query if options.case_sensitive else f"(?iu){query}")
    if options.whole_word:
        return F.col("name") == query if options.case_sensitive else fold == T.fold(query)
    return F.col("name").contains(query) if options.case_sensitive else fold.contains(T.fold(query))


def predicate(query: str, options: SearchOptions = SearchOptions(), mode: str = "compat") -> Column:
    """The condition on (name, name_fold, tokens) that a non-empty query sets."""
    hit = residual(query, options)
    compat = mode == "compat" and (options.regex or not options.whole_word) and bool(T.literal_tokens_of(query))
    return phrase_match(F.col("tokens"), query) & hit if compat else hit


def matching(symbols, query: str, options: SearchOptions = SearchOptions(), mode: str = "compat") -> DataFrame:
    """The symbols that a query finds. ``symbols`` is a table of them, or a stored snapshot, whose look-ups then tell which to read."""
    stored = None if isinstance(symbols, DataFrame) else symbols
    table = symbols if stored is None else stored.symbols
    if not query or (options.regex and not valid_regex(table.sparkSession, query)):
        return table.limit(0)
    if stored is not None and (some := stored.candidates(query, options, mode)) is not None:
        return some.withColumn("name_fold", T.ascii_fold(F.col("name"))).filter(residual(query, options))
    return table.filter(predicate(query, options, mode))


def after(page: DataFrame, token: tuple) -> DataFrame:
    """The rows behind a place (path, line, column, name) in the order of pages, for seeking instead of counting off."""
    order = ("relative_path", "line_number", "col", "name")
    behind = F.lit(False)
    for c, v in reversed(list(zip(order, token, strict=True))):
        behind = (F.col(c) > v) | ((F.col(c) == v) & behind)
    return page.filter((F.col("relative_path") >= token[0]) & behind)


def search(symbols, query: str, options: SearchOptions = SearchOptions(), limit: int = PAGE, offset: int = 0, mode: str = "compat", include=(), exclude=(), seek: tuple | None = None) -> DataFrame:
    """One page of matches (name, relative_path, line_number, col, match_start, match_length), by path, line, column and name.

    ``seek`` is the last row of the page before, as (path, line, column, name): a page then costs what the first does, wherever it is.
    """
    found = path_filter(matching(symbols, query, options, mode), include, exclude)
    found = found if seek is None else after(found, seek)
    page = found.orderBy("relative_path", "line_number", "col", "name").offset(offset).limit(limit)
    return page.select("name", "relative_path", "line_number", "col", F.lit(0).alias("match_start"), F.char_length("name").alias("match_length"))


def count_matches(symbols, query: str, options: SearchOptions = SearchOptions(), mode: str = "compat") -> DataFrame:
    return matching(symbols, query, options, mode).agg(F.count("*").alias("n"))


def result_lines(page: DataFrame, lines: DataFrame, root: str = "") -> DataFrame:
    """A page's rows with absolute path and line text, empty where the line is missing.

    The page is cut before, and its places, at most a page of them, are sent to where the lines are; so the lines aren't shuffled.
    """
    places = page.select("relative_path", "line_number").distinct()
    these = lines.select("relative_path", "line_number", "line").join(F.broadcast(places), ["relative_path", "line_number"], "left_semi")
    joined = page.join(these, ["relative_path", "line_number"], "left")
    return joined.withColumns({"file_path": F.concat_ws("/", F.lit(root), "relative_path"), "line_content": F.coalesce("line", F.lit(""))}).drop("line")


def path_filter(df: DataFrame, include=(), exclude=(), path: str = "relative_path") -> DataFrame:
    """Rows whose path fits one of ``include`` (if any) and none of ``exclude``."""
    if include:
        df = df.filter(reduce(lambda a, b: a | b, [F.col(path).rlike(T.glob_regex(g)) for g in include]))
    for g in exclude:
        df = df.filter(~F.col(path).rlike(T.glob_regex(g)))
    return df


def not_ignored(df: DataFrame, rules: list[T.IgnoreRule], path: str = "relative_path") -> DataFrame:
    """Rows whose path no ignore rule takes out: for the path and each folder above it, the last rule that fits counts, and what is in an
    ignored folder is ignored."""
    if not rules:
        return df

    def ignored(at: Column, folder: bool) -> Column:
        out = F.lit(False)
        for r in rules:
            if folder or not r.folders:
                out = F.when(at.rlike(r.pattern), F.lit(r.ignores)).otherwise(out)
        return out

    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    in_folder = F.when(F.size(parts) > 1, F.exists(above, lambda x: ignored(x, True))).otherwise(False)
    return df.filter(~(in_folder | ignored(F.col(path), False)))


def text_search(lines: DataFrame, query: str, options: SearchOptions = SearchOptions(), include=(), exclude=(), skip_hidden: bool = True, ignore=()) -> DataFrame:
    """Full-text search: a row for each matching line, with the 0-based byte of its first match.

    Case folds are Unicode's; lines over 4096 bytes keep their row, with a placeholder for the text. ``ignore`` has the rules of ignore
    files. Files with a NUL are binary; ``split_lines`` leaves them out.
    """
    pattern = query if options.regex else re.escape(query)
    if not query or not valid_regex(lines.sparkSession, pattern):
        return lines.select("relative_path", "line_number", F.col("line").alias("line_content"), F.lit(0).alias("match_start"), F.lit(0).alias("match_length")).limit(0)
    if options.whole_word:
        pattern = rf"(?<!\w)(?:{pattern})(?!\w)"
    # word classes are Unicode's, as are case folds
    pattern = ("(?U)" if options.case_sensitive else "(?iuU)") + pattern
    found = not_ignored(path_filter(lines, include, exclude), list(ignore))
    if skip_hidden:
        found = found.filter(~F.col("relative_path").rlike(r"(^|/)\."))
    plain = not options.regex and not options.whole_word and options.case_sensitive
    found = found.filter(F.col("line").contains(query) if plain else F.col("line").rlike(pattern))
    # regexp_instr counts code points; a match starts after as many bytes as the text before it has
    at = F.instr("line", query) if plain else F.regexp_instr("line", F.lit(pattern))
    start = F.octet_length(F.substring(F.col("line"), F.lit(1), at - 1))
    shown = F.when(F.octet_length("line") > LONG_LINE, F.concat(F.lit("[Omitted long line with "), F.regexp_count("line", F.lit(pattern)), F.lit(" matches]"))).otherwise(F.col("line"))
    return found.select("relative_path", "line_number", shown.alias("line_content"), start.alias("match_start"), F.lit(0).alias("match_length"))


def parse_grep_line(raw: Column) -> Column:
    """``path:line:column:text`` as a struct, null for blank and malformed lines."""
    pattern = r"(?s)^(.+?):(\d+):(\d+):(.*)$"
    ok = (F.trim(raw) != "") & raw.rlike(pattern)
    part = lambda i: F.regexp_extract(raw, pattern, i)
    return F.when(ok, F.struct(
        F.regexp_replace(part(1), r"^\.[\\/]", "").alias("relative_path"), part(2).cast("int").alias("line_number"),
        (part(3).cast("int") - 1).alias("match_start"), part(4).alias("line_content"), F.lit(0).alias("match_length")))


def either(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first's rows, or the second's if it has none.

    One row of the first is asked for when this is called, so the second isn't run beside a first that has rows.
    """
    return second if first.isEmpty() else first


def hybrid_search(symbols, lines: DataFrame, query: str, options: SearchOptions = SearchOptions(), limit: int = PAGE, offset: int = 0, include=(), exclude=(), mode: str = "compat") -> DataFrame:
    """A page of symbols with their lines; where the first page is empty, the full-text search, unpaged."""
    page = search(symbols, query, options, limit, offset, mode)
    if offset == 0 and matching(symbols, query, options, mode).isEmpty():
        return text_search(lines, query, options, include, exclude)
    return result_lines(page, lines).select("relative_path", "line_number", "line_content", "match_start", "match_length")


def sync_choice(behavior: str, now: float, last: float, cached: str | None) -> tuple[str, str | None]:
    """The driver's twin of ``sync_decision``, in seconds: (action, what a prompt expects)."""
    if cached and now - last < 1:
        return ("grep" if cached == "grep" else "cancel"), None
    if behavior in ("cancel", "grep-fallback"):
        return ("cancel" if behavior == "cancel" else "grep"), None
    return "prompt", "cancel" if behavior == "prompt-cancel" else "grep-fallback"


def sync_decision(behavior: Column, now: Column, last: Column, cached: Column) -> Column:
    """What a search does while a sync runs: a choice of less than a second ago holds, else the setting decides."""
    recent = (now - last < 1000) & cached.isNotNull() & (cached != "")
    action = F.when(recent, F.when(cached == "grep", "grep").otherwise("cancel")).when(behavior == "cancel", "cancel").when(behavior == "grep-fallback", "grep").otherwise("prompt")
    expect = F.when(~recent & (action == "prompt"), F.when(behavior == "prompt-cancel", "cancel").otherwise("grep-fallback"))
    return F.struct(action.alias("action"), expect.alias("expect"))
