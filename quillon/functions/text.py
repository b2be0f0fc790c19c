"""Scalar functions: tokens, case folds, escapes and settings, as Column builders with driver twins where both are used."""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs that make search phrases.
TOKEN_RUN = "[A-Za-z0-9_一-鿿]{2,}"
SEPARATORS = r"[^\p{L}\p{N}\p{Co}]+"
DEFAULT_MAX_BYTES = 1 << 20


def ascii_fold(text: Column) -> Column:
    """Lower case of A-Z alone; other letters keep their case."""
    return F.translate(text, UPPER, LOWER)


def fold(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


@lru_cache(1)
def _marks() -> tuple[str, str]:
    """Letters with diacritics and their bases, by decomposition of the Latin, Greek and Cyrillic blocks."""
    source, target = [], []
    for code in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        parts = unicodedata.normalize("NFD", chr(code))
        base = "".join(c for c in parts if not unicodedata.combining(c))
        if len(parts) > 1 and len(base) == 1:
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


def strip_diacritics(text: Column) -> Column:
    source, target = _marks()
    return F.regexp_replace(F.translate(text, source, target), r"\p{Mn}+", "")


def tokens(text: Column) -> Column:
    """array<string>: letter, number and private-use runs, lower-cased, without diacritics; ``_`` separates."""
    return F.filter(F.split(F.lower(strip_diacritics(text)), SEPARATORS), lambda t: t != "")


def tokens_of(text: str) -> list[str]:
    """The driver's twin of ``tokens``."""
    source, target = _marks()
    plain = "".join(c for c in text.translate(str.maketrans(source, target)) if unicodedata.category(c) != "Mn").lower()
    return [t for t in re.split(r"\s+", "".join(c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " " for c in plain)) if t]


def literal_tokens(text: Column) -> Column:
    """array<string>: runs of two and more word characters or CJK ideographs."""
    return F.regexp_extract_all(text, F.lit(f"({TOKEN_RUN})"), F.lit(1))


def literal_tokens_of(text: str) -> list[str]:
    return re.findall(TOKEN_RUN, text)


def quote_phrase(text: Column) -> Column:
    """In double quotes, inner ones doubled."""
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def escape_glob(text: Column) -> Column:
    return F.regexp_replace(text, r"([*?\[\]])", "[$1]")


def escape_like(text: Column) -> Column:
    return F.regexp_replace(text, r"([%_\\])", r"\\$1")


def escape_regex(text: Column) -> Column:
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def comma_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def clean_name(name: Column) -> Column:
    """Line ends become a space, at most 1024 UTF-16 units (a pair that this cuts becomes U+FFFD); a null name is an error."""
    checked = F.when(name.isNull(), F.raise_error(F.lit("symbol name is null")).cast("string")).otherwise(name)
    flat = F.regexp_replace(checked, "\r\n|\r|\n", " ")
    # where there are pairs, a second unit stands after each for the cut, as a character that isn't one
    wide, filler = r"([\x{10000}-\x{10FFFF}])", "\uffff"
    cut = F.substring(F.regexp_replace(flat, wide, f"$1{filler}"), 1, 1024)
    cut = F.replace(F.regexp_replace(cut, wide + "$", "\ufffd"), F.lit(filler), F.lit(""))
    return F.when(flat.rlike(wide) & (F.char_length(flat) > 512), cut).otherwise(F.substring(flat, 1, 1024))


def max_file_bytes(raw) -> int:
    """A size setting: 0 stays 0, a fraction is cut, what is no number or negative becomes 1 MiB."""
    if isinstance(raw, bool) or not isinstance(raw, (int, float)) or math.isnan(raw) or raw < 0:
        return DEFAULT_MAX_BYTES
    return int(math.floor(raw)) if math.isfinite(raw) else DEFAULT_MAX_BYTES


def page_size(raw) -> int:
    """A page-size setting, kept between 50 and 10,000; 200 where it is no number."""
    if isinstance(raw, bool) or not isinstance(raw, (int, float)) or not math.isfinite(raw):
        return 200
    return int(min(10_000, max(50, raw)))


def merged_filters(setting_includes, setting_excludes, includes=(), excludes=()) -> tuple[list[str], list[str]]:
    """Filters of a search: a user's includes take the place of the settings', excludes add to them."""
    return list(includes or setting_includes), [*setting_excludes, *(excludes or ())]


@dataclass(frozen=True)
class IgnoreRule:
    """A line of an ignore file: what paths it fits (a file's or folder's own path), whether it ignores, and whether it fits folders alone."""

    pattern: str
    ignores: bool
    folders: bool


def ignore_rules(text: str, folder: str = "") -> list[IgnoreRule]:
    """The rules of an ignore file in ``folder``, in order. Of all that fit a path the last counts, and files of deeper folders come later; what
    is below an ignored folder is ignored, whatever a rule says of it."""
    out = []
    for line in text.splitlines():
        rule = re.sub(r"(?<!\\) +$", "", line)
        if not rule or rule.startswith("#"):
            continue
        ignores = not rule.startswith("!")
        rule = rule if ignores else rule[1:]
        folders, body = rule.endswith("/"), rule.rstrip("/")
        anchored = "/" in body
        body = body.lstrip("/") if body.startswith("/") else body
        if not body:
            continue
        base = re.escape(folder) + "/" if folder else ""
        out.append(IgnoreRule("^" + base + ("" if anchored else "(?:.*/)?") + _ignore_regex(body) + "$", ignores, folders))
    return out


def _ignore_regex(body: str) -> str:
    """An ignore pattern as a regular expression: ``*`` and ``?`` stay within a folder, ``**`` between slashes spans folders."""
    out, i = [], 0
    while i < len(body):
        c = body[i]
        if body.startswith("**/", i) and (i == 0 or body[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
        elif body[i:] == "**" and i and body[i - 1] == "/":
            out.append(".+")
            i += 2
        elif c == "\\" and i + 1 < len(body):
            out.append(re.escape(body[i + 1]))
            i += 2
        elif c == "[" and (end := body.find("]", i + 2 + (body[i + 1 : i + 2] in ("!", "^")))) > 0:
            inner = body[i + 1 : end]
            inner = "^/" + inner[1:] if inner[:1] in ("!", "^") else inner
            out.append("[" + inner.replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&") + "]")
            i = end + 1
        else:
            while c == "*" and body[i + 1 : i + 2] == "*":
                i += 1
            out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c))
            i += 1
    return "".join(out)


def diagnostic_line(event: Column, pid: Column, t: Column, **payload: Column) -> Column:
    """An event as a line of JSON: time in ms, event, process, and what else is given."""
    return F.to_json(F.struct(t.alias("t"), event.alias("event"), pid.alias("pid"), *[v.alias(k) for k, v in payload.items()]))


# The markup of a highlight.
HIGHLIGHT = ('<span class="manual-highlight" style="', '">', "</span>")
BOX = "border-color:{color};background:inherit;color:inherit"
FILL = "background:{color};color:#1e1e1e;border-color:transparent"


def _span(color: str, box: bool) -> tuple[str, str]:
    return HIGHLIGHT[0] + (BOX if box else FILL).format(color=color) + HIGHLIGHT[1], HIGHLIGHT[2]


def _quoted(replacement: str) -> str:
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def _plain_html(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def highlighted(text: Column, marks: list[tuple[str, str]], box: bool = False) -> Column:
    """HTML of ``text`` in which each mark (text, color) is put in a span, the last first, without regard to case; what is
    found takes the mark's own letters."""
    out = escape_html(text)
    for mark, color in reversed([m for m in marks if m[0]]):
        start, end = _span(color, box)
        out = F.regexp_replace(out, "(?iu)" + re.escape(_plain_html(mark)), _quoted(start + _plain_html(mark) + end))
    return out


def highlighted_html(html: Column, marks: list[tuple[str, str]], box: bool = False) -> Column:
    """``html`` in which each mark is put in a span where it stands outside tags, the last first, without regard to case; what is found
    keeps its letters."""
    for mark, color in reversed([m for m in marks if m[0]]):
        start, end = _span(color, box)
        pattern, put = "(?iu)" + re.escape(_plain_html(mark)), _quoted(start) + "$0" + _quoted(end)
        pieces = F.regexp_extract_all(html, F.lit("<[^>]*>|[^<]+|<"), F.lit(0))
        html = F.array_join(_outside_tags(pieces, pattern, put), "")
    return html


def _outside_tags(pieces: Column, pattern: str, put: str) -> Column:
    return F.transform(pieces, lambda x: F.when(x.startswith("<"), x).otherwise(F.regexp_replace(x, pattern, put)))


def max_file_bytes_column(raw: Column) -> Column:
    return F.when(raw.isNull() | F.isnan(raw) | (raw < 0) | (raw == float("inf")), F.lit(DEFAULT_MAX_BYTES)).otherwise(F.floor(raw)).cast("bigint")


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression: ``**`` spans folders, ``*`` and ``?`` don't; a pattern without ``/`` fits names."""
    if pattern.startswith(".") and "*" not in pattern and "/" not in pattern:
        pattern = "*" + pattern
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out.append("(?:" + "|".join(glob_regex(x)[1:-1].removeprefix("(?:.*/)?") for x in pattern[i + 1 : end].split(",")) + ")")
            i = end + 1
            continue
        out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c))
        i += 1
    return "^" + ("" if "/" in pattern else "(?:.*/)?") + "".join(out) + "$"
