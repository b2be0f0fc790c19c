"""Symbol extraction: by lines, by whole text, and by a lexer of C and C++."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain, count, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.functions import text as T
from quillon.schema import encode_kind
from quillon.session import ship

# The definition patterns and the words that are no names.
NAME = "([A-Za-z_][A-Za-z0-9_]*)"
SHAPES = (
    ("macro", rf"^[ \t]*#[ \t]*define[ \t]+{NAME}"),
    ("struct", rf"^[ \t]*(?:typedef[ \t]+)?struct[ \t]+{NAME}<gap>\{{"),
    ("union", rf"^[ \t]*(?:typedef[ \t]+)?union[ \t]+{NAME}<gap>\{{"),
    ("enum", rf"^[ \t]*(?:typedef[ \t]+)?enum(?:[ \t]+class)?[ \t]+{NAME}<gap>\{{"),
    ("class", rf"^[ \t]*(?:template[ \t]*<[^>]*>[ \t]*)?class[ \t]+{NAME}(?:[ \t]*:[^{{\n]*)?<gap>\{{"),
    ("namespace", rf"^[ \t]*namespace[ \t]+{NAME}<gap>\{{"),
)
DECLARATION = rf"^[ \t]*(?:(?:static|inline|extern|const|virtual|explicit|constexpr|[A-Z_]+)[ \t]+)*[A-Za-z_][A-Za-z0-9_:<>, \t\*&]*?[ \t\*&]+{NAME}[ \t]*\([^;{{}}]*\)"
KEYWORDS = (
    "if", "for", "while", "switch", "return", "sizeof", "typeof", "do", "else", "case", "break", "continue", "goto", "default",
    "typedef", "struct", "union", "enum", "class", "namespace", "template", "static", "inline", "extern", "const", "volatile",
    "register", "auto", "signed", "unsigned", "void", "int", "char", "short", "long", "float", "double", "bool",
)

ON_LINE = [(kind, shape.replace("<gap>", r"[ \t]*")) for kind, shape in SHAPES]
FUNCTION_ON_LINE = DECLARATION + r"[ \t]*\{"
FUNCTION_HEAD = DECLARATION + r"[ \t]*$"
LONE_BRACE = r"^[ \t]*\{[ \t]*$"
IN_TEXT = [*((kind, shape.replace("<gap>", r"[ \t\r\n]*")) for kind, shape in SHAPES), ("function", DECLARATION + r"[ \t\r\n]*\{")]


def _hits(text: Column, kind: str, pattern: str, order: int, line_number: Column) -> Column:
    """A struct of what ``pattern`` finds in a line, null where it finds nothing or a keyword."""
    name = F.regexp_extract(text, pattern, 1)
    col = F.position(name, F.regexp_extract(text, pattern, 0)) - 1  # the first place of the name's letters in the match
    return F.when((name != "") & ~name.isin(*KEYWORDS), F.struct(name.alias("name"), F.lit(kind).alias("kind"), line_number.alias("line_number"), col.alias("col"), text.alias("line"), F.lit(order).alias("rule")))


def by_line(lines: DataFrame, macros_only: bool = False) -> DataFrame:
    """(relative_path, line_number, col, name, kind, line) of the definitions that one line shows, or a declaration
    line with a lone brace on the next. The first rule to give a name and kind on a line counts, but for macros only.

    Where ``lines`` has ``after``, the next line, as ranges of large files do, no window looks for it."""
    clean = lambda c: F.regexp_replace(c, "\r$", "")
    if macros_only:
        rows = lines.select("relative_path", "line_number", clean("line").alias("line"))
        found = [_hits(F.col("line"), *ON_LINE[0], 0, F.col("line_number"))]
    else:
        after = F.col("after") if "after" in lines.columns else F.lead("line").over(Window.partitionBy("relative_path").orderBy("line_number"))
        rows = lines.select("relative_path", "line_number", clean("line").alias("line"), clean(after).alias("after"))
        found = [_hits(F.col("line"), kind, pattern, i, F.col("line_number")) for i, (kind, pattern) in enumerate(ON_LINE)]
        found.append(_hits(F.col("line"), "function", FUNCTION_ON_LINE, len(ON_LINE), F.col("line_number")))
        found.append(F.when(F.col("after").rlike(LONE_BRACE), _hits(F.col("line"), "function", FUNCTION_HEAD, len(ON_LINE) + 1, F.col("line_number"))))
    hits = rows.select("relative_path", F.explode(F.filter(F.array(*found), lambda h: h.isNotNull())).alias("h")).select("relative_path", "h.*")
    if macros_only:
        return hits.drop("rule")
    # rules of one kind and name on one line: functions are the only kind with two, and these can't both fit
    return hits.groupBy("relative_path", "line_number", "name", "kind").agg(F.min_by(F.struct("col", "line"), "rule").alias("x")).select("relative_path", "line_number", "x.col", "name", "kind", "x.line")


def in_parts(lines: DataFrame, part: Column, *order: str) -> DataFrame:
    """(relative_path, part, content) of files given by ``lines`` (relative_path, line, ``order``): runs of lines in order, each line with its
    line feed, so that no file is one row. ``part`` must grow with ``order``; null lines are left out."""
    line = F.transform(F.sort_array(F.collect_list(F.struct(*order, "line"))), lambda x: F.concat(x["line"], F.lit("\n")))
    return lines.groupBy("relative_path", part.cast("long").alias("part")).agg(F.concat_ws("", line).alias("content"))


def _breaks(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))


# What a match needs that goes on after a part: the part opens it, and each later part either goes on with it or ends it, found or not.
NAMED = rf"(?:struct|union|enum|class|namespace)[ \t]+{NAME}(?:[ \t]*:[^{{\n]*)?[ \t\r\n]*\z"
OPENS = {
    "parameters": lambda text: F.substring_index(F.translate(text, ";{", "}}"), "}", -1).rlike("(?md)" + DECLARATION.removesuffix(r"[^;{}]*\)")),
    "angles": lambda text: F.substring_index(text, ">", -1).rlike(r"(?md)^[ \t]*template[ \t]*<"),
    "name": lambda text: text.rlike("(?d)" + NAMED),
}
ENDS = {"parameters": "[;{}]", "angles": ">", "name": r"[^ \t\r\n]"}


def _pieces(files: DataFrame) -> DataFrame:
    """(relative_path, piece, above, content): parts of files, those together over whose border a match may reach, and the line feeds above each."""
    marks = [c for k in OPENS for c in (OPENS[k](F.col("content")).alias(f"opens_{k}"), F.col("content").rlike(ENDS[k]).alias(f"ends_{k}"))]
    here = files.select("relative_path", "part", _breaks(F.col("content")).cast("long").alias("breaks"), *marks)
    by = Window.partitionBy("relative_path").orderBy("part")
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda flag: F.max(F.when(F.col(flag), F.col("part"))).over(so_far)
    is_open = reduce(lambda a, b: a | b, [F.coalesce(last(f"opens_{k}") >= F.coalesce(last(f"ends_{k}"), last(f"opens_{k}")), F.lit(False)) for k in OPENS])
    known = here.select("relative_path", "part", "breaks", is_open.alias("open"))
    known = known.withColumn("new", F.when(F.coalesce(F.lag("open").over(by), F.lit(False)), 0).otherwise(1))
    known = known.select("relative_path", "part", F.sum("new").over(so_far).alias("piece"), (F.sum("breaks").over(so_far) - F.col("breaks")).alias("above"))
    text = F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("part", "content"))), lambda x: x["content"]))
    return files.join(known, ["relative_path", "part"]).groupBy("relative_path", "piece").agg(F.min("above").alias("above"), text.alias("content"))


def by_text(files: DataFrame) -> DataFrame:
    """(relative_path, line_number, col, name, kind) of the definitions in whole texts (relative_path, content); a brace may
    stand some lines below. The column is that of the match, 0.

    A text is cut at the matches of a rule; what goes on is the line ends in each piece and match, and a running sum of them
    numbers the lines, so the work grows with the text. Where ``files`` has ``part``, a file is its parts in that order, each but the last
    ending with a line feed (see ``in_parts``): parts are many tasks', and only those that a match may reach over are put together.
    """
    zero = F.lit(0).cast("long")
    pieces = _pieces(files) if "part" in files.columns else files.select("relative_path", zero.alias("piece"), zero.alias("above"), "content")
    found = []
    for rule, (kind, pattern) in enumerate(IN_TEXT):
        whole = "(?md)" + pattern
        matches = F.regexp_extract_all("content", F.lit(whole), F.lit(0))
        match = F.transform(matches, lambda m: F.struct(F.regexp_extract(m, whole, 1).alias("name"), _breaks(m).alias("inside")))  # noqa: B023 - called at once
        before = F.transform(F.split("content", whole), _breaks)  # one more than there are matches
        found.append(F.struct(F.lit(kind).alias("kind"), F.lit(rule).alias("rule"), match.alias("match"), before.alias("before")))
    rows = pieces.select("relative_path", "piece", "above", F.explode(F.array(*found)).alias("f")).filter(F.size("f.match") > 0)
    rows = rows.select("relative_path", "piece", "above", "f.kind", "f.rule", F.posexplode(F.arrays_zip("f.match", F.slice("f.before", F.lit(1), F.size("f.match")).alias("before"))).alias("i", "x"))
    rows = rows.select("relative_path", "piece", "above", "kind", "rule", "i", "x.match.name", "x.match.inside", "x.before")
    so_far = Window.partitionBy("relative_path", "piece", "rule").orderBy("i")
    line = F.col("above") + F.sum(F.col("before") + F.col("inside")).over(so_far) - F.col("inside") + 1
    every = rows.select("relative_path", line.cast("int").alias("line_number"), F.lit(0).alias("col"), "name", "kind", "rule").filter(~F.col("name").isin(*KEYWORDS))
    return every.groupBy("relative_path", "line_number", "name", "kind").agg(F.min("col").alias("col"), F.min("rule").alias("rule")).drop("rule")


def symbols(found: DataFrame) -> DataFrame:
    """Extracted rows as the symbol table: clean names, folded names, codes of kinds, tokens."""
    name = T.clean_name(F.col("name"))
    return found.select(name.alias("name"), T.ascii_fold(name).alias("name_fold"), encode_kind(F.col("kind")).alias("kind"), "relative_path", F.col("line_number").cast("int").alias("line_number"), F.col("col").cast("int").alias("col"), T.tokens(name).alias("tokens"))


def route(size: Column, limit: int = T.DEFAULT_MAX_BYTES, macro_limit: int = 10 << 20) -> Column:
    """How a file is read by its size: ``ast`` below the limit (0: no limit), then ``stream``, then ``macros``."""
    return F.when((F.lit(limit) == 0) | (size < limit), "ast").when(size < macro_limit, "stream").otherwise("macros")


def language(path: Column) -> Column:
    """``c`` or ``cpp`` by extension; null for others."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(ext.isin(".c", ".h"), "c").when(ext.isin(".cpp", ".hpp", ".cc", ".cxx", ".hxx", ".inl"), "cpp")


# editors' names of languages that have another name here.
ALIASES = {"typescriptreact": "tsx", "javascriptreact": "jsx", "shellscript": "bash", "plaintext": "text"}


def canonical_language(name: Column, supported: tuple[str, ...]) -> Column:
    """A language by its own name or an alias, if it is supported; else null."""
    other = F.coalesce(*[F.when(name == a, F.lit(b)) for a, b in ALIASES.items()])
    return F.when(name.isin(*supported), name).when(other.isin(*supported), other)


# The lexer

LEX = re.compile(
    r"""(?P<skip>//(?:\\\n|[^\n])*|/\*.*?(?:\*/|\Z)|[ \t\r\f\v]+|\\\r?\n)|(?P<line>\n)|(?P<text>(?:u8|[uUL])?"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)"""
    r"""|(?P<word>[A-Za-z_]\w*)|(?P<num>\d[\w.']*)|(?P<hash>\#)|(?P<sign>::|->|[^\w\s])""",
    re.S | re.X,
)
DEFINE = re.compile(r"#[ \t]*define[ \t]+([A-Za-z_]\w*)")
SPECS = {"struct": "struct", "union": "union", "enum": "enum", "class": "class"}


class Tokens:
    """A file's tokens by number, read as far as they are asked for; those that no rule looks back at are let go."""

    def __init__(self, source: Iterator[tuple[str, str, int, int]]):
        self.source, self.held, self.first = source, [], 0

    def has(self, at: int) -> bool:
        while at >= self.first + len(self.held):
            if (token := next(self.source, None)) is None:
                return False
            self.held.append(token)
        return True

    def __getitem__(self, at: int) -> tuple[str, str, int, int]:
        if at < 0:  # before the first
            return "", "", 0, 0
        if at < self.first or not self.has(at):
            raise IndexError(at)
        return self.held[at - self.first]

    def forget(self, before: int) -> None:
        if before - self.first > 4096:  # seldom, as it moves the rest
            del self.held[: before - self.first]
            self.first = before


def lexed(content: str | Iterable[str], cpp: bool) -> Iterator[tuple[str, str, int, int]]:
    """(name, kind, line, column) of function definitions, named struct, union, enum (and class, namespace) specifiers,
    typedef names and macros; line from 1, column from 0, at the name. A content may come in parts, each but the last ending with a line feed;
    what is read and no longer needed is let go, so memory grows with a statement, not with the file."""
    macros: list[tuple[str, str, int, int]] = []
    for found in _definitions(Tokens(_tokens(iter([content] if isinstance(content, str) else content), macros)), cpp):
        yield from macros
        macros.clear()
        if found is not None:
            yield found


def _tokens(parts: Iterator[str], macros: list) -> Iterator[tuple[str, str, int, int]]:
    """(kind, word, line, column) of a file's tokens; the macros go to ``macros``. What reaches a part's end is read again with the next part."""
    text, at, line, start, fresh = "", 0, 0, 0, True  # ``start``: where the line begins, below 0 if before the text

    def more() -> bool:
        nonlocal text, at, start
        part = next((p for p in parts if p), None)
        if part is not None:
            text, start, at = text[at:] + part, start - at, 0
        return part is not None

    while at < len(text) or more():
        m = LEX.match(text, at)
        if m is None:
            at += 1
            continue
        kind, word = m.lastgroup, m.group()
        if kind == "hash" and fresh:
            end = at
            while True:  # a directive ends at a line end that no backslash hides
                end = text.find("\n", end)
                if end < 0 or text[end - 1] != "\\" and text[end - 2 : end] != "\\\r":
                    break
                end += 1
            if end < 0 and more():
                continue
            end = len(text) if end < 0 else end
            if d := DEFINE.match(text, at):
                macros.append((d.group(1), "macro", line + 1, d.start(1) - start))
            if breaks := text.count("\n", at, end):
                line, start = line + breaks, text.rindex("\n", at, end) + 1
            at = end
            continue
        if m.end() == len(text) and kind != "line" and more():
            continue
        if kind in ("word", "sign", "num", "text"):
            yield kind, word, line, at - start
            fresh = False
        if breaks := word.count("\n"):
            line, start = line + breaks, at + word.rindex("\n") + 1
        fresh = fresh or kind == "line"
        at = m.end()


def _definitions(tokens: Tokens, cpp: bool) -> Iterator[tuple[str, str, int, int] | None]:
    """What the tokens define, and now and then null, with which macros are passed on."""
    depth_of_typedef, depth, typedef, start, opened = None, 0, False, 0, 0
    i = 0
    while tokens.has(i):
        if i % 4096 == 0:
            yield None
            tokens.forget(min(start, opened if typedef else start) - 2)
        kind, word, line, col = tokens[i]
        if kind == "word":
            if word in SPECS and (cpp or word != "class"):
                j = i + 1
                if cpp and word == "enum" and tokens.has(j) and tokens[j][1] in ("class", "struct"):
                    j += 1
                if tokens.has(j) and tokens[j][0] == "word":
                    yield tokens[j][1], SPECS[word], tokens[j][2] + 1, tokens[j][3]
                    i = j + 1
                    continue
            elif cpp and word == "namespace" and tokens.has(i + 2) and tokens[i + 1][0] == "word" and tokens[i + 2][1] == "{":
                yield tokens[i + 1][1], "namespace", tokens[i + 1][2] + 1, tokens[i + 1][3]
            elif word == "typedef":
                typedef, depth_of_typedef, opened = True, depth, i
            elif cpp and word == "template" and tokens.has(i + 1) and tokens[i + 1][1] == "<":  # its parameters are no types of the file
                i = _angles_end(tokens, i + 1) + 1
                continue
        elif word == "{":
            if (end := _inner_brace(tokens, start, i)) is not None:  # braces of a member's first value or an argument
                i = end + 1
                continue
            if (name := Declaration(tokens, start, i).function()) is not None:
                yield name[1], "function", name[2] + 1, name[3]
            depth, start = depth + 1, i + 1
        elif word == "}":
            depth, start = depth - 1, i + 1
        if word == ";":
            start = i + 1
        if word == ";" and typedef and depth == depth_of_typedef:
            j = i - 1
            while j > opened and tokens[j][1] == "]":  # arrays
                while j > opened and tokens[j][1] != "[":
                    j -= 1
                j -= 1
            if tokens[j][0] == "word" and tokens[j - 1][1] != "*":
                yield tokens[j][1], "typedef", tokens[j][2] + 1, tokens[j][3]
            typedef = False
        i += 1
    yield None


CLOSES = {"(": ")", "[": "]", "{": "}"}
# Words that may stand before a name and parentheses without making them a declaration.
NO_TYPE = ("return", "else", "new", "goto", "case", "throw", "delete", "co_return", "co_yield", "operator")
# Specifiers that take parentheses.
PARENTHESISED = ("__attribute__", "__attribute", "__declspec", "alignas", "_Alignas", "decltype", "typeof", "__typeof__", "noexcept", "throw", "explicit", "requires", "__asm__", "asm")


def _closing(tokens: Tokens, at: int, end: int | None = None) -> int | None:
    """Where the bracket that opens at ``at`` is closed, before ``end``."""
    opens, level = tokens[at][1], 0
    for j in count(at) if end is None else range(at, end):
        if not tokens.has(j):
            return None
        if tokens[j][1] == opens:
            level += 1
        elif tokens[j][1] == CLOSES[opens]:
            level -= 1
            if level == 0:
                return j
    return None


def _angles_end(tokens: Tokens, at: int) -> int:
    """Where ``<...>`` that opens at ``at`` ends; ``at`` where it isn't closed."""
    level, j = 0, at
    while tokens.has(j):
        w = tokens[j][1]
        if w in ("(", "["):
            to = _closing(tokens, j)
            if to is None:
                return at
            j = to
        level += {"<": 1, ">": -1}.get(w, 0)
        if level == 0:
            return j
        if w in (";", "{", "}"):
            return at
        j += 1
    return at


def _inner_brace(tokens: Tokens, start: int, brace: int) -> int | None:
    """Where a brace closes that opens within a constructor's list of members (``: a{1}, b{2} {``), which is no body."""
    before = tokens[brace - 1] if brace > start else None
    if before is None or before[0] != "word" and before[1] != ">":
        return None
    level, colon = 0, False
    for j in range(start, brace):
        level += {"(": 1, ")": -1}.get(tokens[j][1], 0)
        if level == 0 and tokens[j][1] == ":" and j > start and tokens[j - 1][1] in (")", "noexcept"):
            colon = True
    if not colon or level:
        return None
    end = _closing(tokens, brace, brace + 10_000)
    return end if end is not None and tokens.has(end + 1) and tokens[end + 1][1] in (",", "{") else None


class Declaration:
    """The tokens from a statement's start to a brace, read as a C or C++ declaration by recursive descent.

    ``declaration: specifier* declarator suffix*``, where a declarator that makes a function of a plain name is ``name ( parameters )``: a
    name that pointers, references, qualifiers or parentheses hold is none, as only a direct declarator counts.
    """

    def __init__(self, tokens: Tokens, start: int, end: int):
        self.tokens, self.at, self.end = tokens, start, end

    def _word(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][1] if self.at + ahead < self.end else ""

    def _kind(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][0] if self.at + ahead < self.end else ""

    def _skip(self) -> bool:
        """Past a bracketed group; false where it isn't closed."""
        to = _closing(self.tokens, self.at, self.end)
        self.at = self.end if to is None else to + 1
        return to is not None

    def _angles(self) -> bool:
        """Past ``<...>``; false where it isn't closed."""
        level = 0
        while self.at < self.end:
            w = self._word()
            if w in ("(", "[") and not self._skip():
                return False
            if w in ("(", "["):
                continue
            level += {"<": 1, ">": -1}.get(w, 0)
            self.at += 1
            if level == 0:
                return True
            if w in (";", "{", "}"):
                return False
        return False

    def _attribute(self) -> bool:
        if self._word() == "[" and self._word(1) == "[":
            return self._skip()
        if self._kind() == "word" and self._word() in PARENTHESISED:
            self.at += 1
            return self._word() != "(" or self._skip()
        return False

    def function(self) -> tuple | None:
        """The token of the function's name, where the whole is a function's head."""
        typed = False  # whether something stands before that can be a type
        while self.at < self.end:
            kind, word = self._kind(), self._word()
            if word in ("struct", "union", "class", "enum") and kind == "word" and not typed and self._is_body_of_type():
                return None
            if word == "template" and self._word(1) == "<":
                self.at += 1
                if not self._angles():
                    return None
            elif self._attribute():
                typed = typed or word in ("decltype", "typeof", "__typeof__")
            elif kind == "word" and self._word(1) == "(":
                name, before = self.tokens[self.at], self.tokens[self.at - 1] if typed else None
                self.at += 1
                if not self._skip():
                    return None
                if not typed and word not in KEYWORDS and self._kind() == "word" and not self._suffixes_only():
                    typed = False  # a macro with arguments before the declaration
                    continue
                direct = before is not None and (before[0] == "word" and before[1] not in NO_TYPE or before[1] in (">", ")", "]"))
                return name if direct and word not in KEYWORDS and self._suffix() else None
            elif kind == "word":
                typed = typed or word not in NO_TYPE
                if word in NO_TYPE:
                    return None
                self.at += 1
                if self._word() == "<" and not self._angles():
                    return None
            elif word == ":" and not typed or word == ":" and self.tokens[self.at - 1][1] in ("public", "private", "protected", "default"):
                typed = False
                self.at += 1
            elif word in ("*", "&", "::", "~"):
                self.at += 1
                if self._kind() == "word" and self._word(1) == "(":  # the declarator isn't direct
                    return None
            elif kind == "text" and typed:  # extern "C"
                self.at += 1
            else:
                return None
        return None

    def _is_body_of_type(self) -> bool:
        """Whether the brace is that of a struct, union, class or enum: no parameters follow its name and bases."""
        depth = 0
        for j in range(self.at, self.end):
            w = self.tokens[j][1]
            if w == "(" and depth == 0 and self.tokens[j - 1][0] == "word" and self.tokens[j - 1][1] not in PARENTHESISED:
                return self.tokens[j - 2][1] in ("struct", "union", "class", "enum")
            if w == ":" and depth == 0 and self.tokens[j - 1][1] != ")":
                return True
            depth += {"<": 1, ">": -1}.get(w, 0)
        return True

    def _suffixes_only(self) -> bool:
        """Whether what is left can only follow parameters."""
        here = self.at
        out = all(self.tokens[j][1] in ("const", "volatile", "noexcept", "override", "final", "try", "mutable") for j in range(here, self.end) if self.tokens[j][0] == "word" and self.tokens[j][1] != "noexcept")
        return out

    def _suffix(self) -> bool:
        """What may stand between parameters and body: qualifiers, exceptions, attributes, annotations, ``-> type``, members' values."""
        while self.at < self.end:
            word = self._word()
            if word in ("->", ":") or word == "requires":
                return True
            if self._attribute() or word in ("&",):
                self.at += word == "&"
                continue
            if self._kind() == "word":
                self.at += 1
                if self._word() == "(" and not self._skip():
                    return False
                continue
            return False
        return True


_LEXED = pa.schema([("relative_path", pa.string()), ("mtime_ms", pa.int64()), ("size_bytes", pa.int64()), ("line_number", pa.int32()), ("col", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("error", pa.string())])


def _lexed_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_LEXED)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LEXED, strict=True)], schema=_LEXED)


def _lexed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches (relative_path, mtime_ms, size_bytes, content, error, lang, part): a row for each file that could be read, symbol and error.
    A file's parts follow each other; a null part is a file of its own."""

    def rows() -> Iterator[tuple]:
        number, last = 0, None
        for batch in batches:
            for k in range(batch.num_rows):  # one content at a time
                path, mtime, size, content, error, lang, part = (batch.column(i)[k].as_py() for i in range(7))
                if part is None or path != last:
                    number += 1
                last = path
                yield number, path, mtime, size, content, error, lang

    for _, parts in groupby(rows(), lambda r: r[0]):
        _, path, mtime, size, content, error, lang = next(parts)
        done, found = [], []
        try:
            if error is None and lang is not None:
                for name, kind, line, col in lexed(chain([content or ""], (r[4] or "" for r in parts)), lang == "cpp"):
                    found.append((path, None, None, line, col, name, kind, None))
                    if len(found) == 10_000:
                        done.append(_lexed_batch(found))
                        found = []
        except Exception as e:  # noqa: BLE001 - one bad file must not stop the others
            error = f"{path}: {e}"
        if error is None:
            yield from (*done, _lexed_batch([(path, mtime, size, None, None, None, None, None), *found]))
        else:
            yield _lexed_batch([(path, None, None, None, None, None, None, error)])


def lexed_rows(files: DataFrame) -> DataFrame:
    """What the lexer finds in files (relative_path, mtime_ms, size_bytes, content, error), in one pass over them: a row for each file, with
    null name and error, one for each symbol, and one for each file that fails, with its error. Files may come in parts (see ``in_parts``)."""
    ship(files.sparkSession)
    parted = "part" in files.columns
    known = files.select("relative_path", "mtime_ms", "size_bytes", "content", "error", language(F.col("relative_path")).alias("lang"), (F.col("part") if parted else F.lit(None)).cast("long").alias("part"))
    if parted:
        known = known.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "relative_path").sortWithinPartitions("relative_path", "part")
    return known.mapInArrow(_lexed_batches, "relative_path string, mtime_ms bigint, size_bytes bigint, line_number int, col int, name string, kind string, error string")


def by_lexer(files: DataFrame) -> DataFrame:
    """(relative_path, line_number, col, name, kind, error) of files (relative_path, content); a file that fails gives one row with
    its error. Files of other languages give nothing. A file may come in parts, as for ``by_text``: one task reads it, a part at a time."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    part = ["part"] if "part" in files.columns else []
    rows = lexed_rows(files.select("relative_path", none("bigint", "mtime_ms"), none("bigint", "size_bytes"), "content", none("string", "error"), *part))
    return rows.filter("name is not null or error is not null").select("relative_path", "line_number", "col", "name", "kind", "error")
