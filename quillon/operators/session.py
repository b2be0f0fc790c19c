"""Search sessions: history, cursor, find in results, highlights."""

from __future__ import annotations

import itertools
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillon.functions import text as T
from quillon.operators.search import PAGE, valid_regex
from quillon.schema import SearchOptions
from quillon.session import ship


def numbered(results: DataFrame, order: list[str], offset: int = 0, name: str = "global_index") -> DataFrame:
    """Results numbered from ``offset`` in ``order``; meant for loaded pages, whose size the page limit bounds."""
    return results.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1 + offset)


def neighbours(results: DataFrame, index: str = "global_index", wrap: bool = True) -> DataFrame:
    """``next_index`` and ``previous_index`` of each result; null at the ends unless wrapped."""
    n = F.max(F.col(index) + 1).over(Window.partitionBy())
    ahead, back = F.col(index) + 1, F.col(index) - 1
    if wrap:
        return results.withColumns({"next_index": F.pmod(ahead, n), "previous_index": F.pmod(back, n)})
    return results.withColumns({"next_index": F.when(ahead < n, ahead), "previous_index": F.when(back >= 0, back)})


def find_in_results(results: DataFrame, query: str, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Loaded results whose line or path holds ``query``. A regular expression ignores whole words; an invalid one finds nothing."""
    pattern = query if options.regex else re.escape(query)
    if not query or not valid_regex(results.sparkSession, pattern):
        return results.limit(0)
    if options.whole_word and not options.regex:
        pattern = rf"\b{pattern}\b"
    text = F.concat_ws("\n", "line_content", "relative_path")
    return results.filter(text.rlike(pattern if options.case_sensitive else f"(?iu){pattern}"))


def hit_label(hits: int, active: int, query: str, valid: bool = True) -> str:
    """The label of a find in results: which of how many."""
    if not valid:
        return "Invalid regex"
    return f"{active + 1} of {hits}" if query and hits else "No results"


def numbered_hits(results: DataFrame, query: str, options: SearchOptions = SearchOptions(), index: str = "global_index") -> DataFrame:
    """Hits of a find in results with ``k`` (from 1) and ``n``; results are a loaded page."""
    hits = find_in_results(results, query, options)
    return hits.withColumns({"k": F.row_number().over(Window.orderBy(index)), "n": F.count("*").over(Window.partitionBy())})


def first_in_file(results: DataFrame, path: str, line_number: int | None = None, index: str = "global_index") -> DataFrame:
    """The first result of a file, or of a line in it."""
    here = results.filter(F.col("relative_path") == path)
    here = here if line_number is None else here.filter(F.col("line_number") == line_number)
    return here.orderBy(index).limit(1)


def in_open_file(results: DataFrame, file_path: str, line_count: int) -> DataFrame:
    """Results that an open file shows: of its path, on lines that it has, with the end of the match cut at the line's end."""
    here = results.filter((F.col("file_path") == file_path) & F.col("line_number").between(1, line_count))
    return here.withColumn("match_end", F.least(F.col("match_start") + F.col("match_length"), F.char_length("line_content")))


def toggled(marks: list[dict], text: str) -> list[dict]:
    """Highlights with that of ``text`` taken out, or put at the end with the next color."""
    rest = [m for m in marks if m["text"] != text]
    return rest if len(rest) < len(marks) else [*marks, {"text": text, "color_index": len(marks)}]


MARKS = 50_000  # highlights in one automaton


def folded(text: str) -> tuple[str, list[int]]:
    """(lower case, place in ``text`` of each of its characters): a letter may have several in lower case."""
    low = text.lower()
    if len(low) == len(text):
        return low, []
    parts = [c.lower() for c in text]
    return "".join(parts), [i for i, p in enumerate(parts) for _ in p]


def automaton(texts: list[str]):
    """An Aho-Corasick automaton over lower-cased texts; its values are the numbers of the texts with that lower case."""
    import ahocorasick

    by_text: dict[str, list[int]] = {}
    for i, text in enumerate(texts):
        by_text.setdefault(text.lower(), []).append(i)
    out = ahocorasick.Automaton()
    for text, numbers in by_text.items():
        out.add_word(text, (len(text), numbers))
    out.make_automaton()
    return out


def occurrences(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """Every place of every highlight (text, color) in the lines, overlapping ones too, without regard to case.

    One automaton over all highlights goes over each line once, so the cost of a line is that of its length and hits, not of the number of
    highlights. Beyond ``MARKS`` highlights there are several automata, each over the lines.
    """
    ship(lines.sparkSession)
    marks = [(r["text"], r["color"]) for r in texts.filter("text <> ''").select("text", "color").toLocalIterator()]
    shape = pa.schema([("relative_path", pa.string()), ("line_number", pa.int32()), ("at", pa.int32()), ("text", pa.string()), ("color", pa.string())])
    out = None
    for lo in range(0, len(marks), MARKS):
        part = marks[lo : lo + MARKS]

        def run(batches, part=part):
            found = automaton([t for t, _ in part])
            for batch in batches:
                rows = []
                for path, number, line in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    low, places = folded(line or "")
                    for last, (n, numbers) in found.iter(low):
                        at = last - n + 1
                        rows += [(path, number, places[at] if places else at, *part[i]) for i in numbers]
                    if len(rows) > 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)

        here = lines.select("relative_path", F.col("line_number").cast("int"), "line").mapInArrow(run, "relative_path string, line_number int, at int, text string, color string")
        out = here if out is None else out.unionByName(here)
    return lines.sparkSession.createDataFrame([], "relative_path string, line_number int, at int, text string, color string") if out is None else out


def cycled(index: Column, colors: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, colors)), (F.pmod(index, F.lit(len(colors))) + 1).cast("int"))


def history_summary(entries: DataFrame, active: str | None) -> DataFrame:
    """(id, query, n, active): the total where one is known, else the number of loaded results."""
    return entries.select("id", "query", F.coalesce("total_count", F.size("results")).alias("n"), F.coalesce(F.col("id") == F.lit(active), F.lit(False)).alias("active"))


def status_text(symbols: Column, stale: Column) -> Column:
    return F.concat(F.format_number(symbols, 0), F.lit(" symbols"), F.when(stale, " (stale)").otherwise(""))


_ids = itertools.count(1)


@dataclass
class Entry:
    id: str
    query: str
    options: SearchOptions
    results: list
    total: int
    loaded: int
    timestamp: int = field(default_factory=lambda: int(time.time() * 1000))


class Session:
    """A user's searches: pages that were loaded (bounded by the page size), the active one and a cursor in it."""

    def __init__(self, wrap: bool = True):
        self.entries: dict[str, Entry] = {}
        self.active: str | None = None
        self.cursor, self.wrap, self.error = -1, wrap, None
        self.listeners: list[Callable[[], None]] = []

    def _changed(self) -> None:
        for f in self.listeners:
            f()

    def add(self, query: str, options: SearchOptions, results: list, append: bool = False, total: int | None = None) -> str:
        """A new entry from ``results``, after the active entry's when appending."""
        held = list(self.entries[self.active].results) if append and self.active else []
        name = f"search-{int(time.time() * 1000)}-{next(_ids)}"
        both = held + list(results)
        self.entries[name] = Entry(name, query, options, both, (total if total is not None else len(results)) + len(held), len(both))
        self.active, self.cursor = name, -1
        self._changed()
        return name

    def run(self, query: str, options: SearchOptions, fetch: Callable[[], tuple[list, int]], append: bool = False) -> int:
        """Search and add what ``fetch`` finds, (results, total); where it fails, entries stay as they are and the count is 0."""
        try:
            results, total = fetch()
        except Exception as e:  # noqa: BLE001 - a failed search shows as one without results
            self.error = e
            self._changed()
            return 0
        self.error = None
        self.add(query, options, results, append, total)
        return total

    def results(self) -> list:
        return list(enumerate(self.entries[self.active].results)) if self.active else []

    def extend(self, more: list) -> None:
        """Add a page to the active entry; its total stays."""
        if self.active and more:
            entry = self.entries[self.active]
            entry.results.extend(more)
            entry.loaded += len(more)
            self._changed()

    def load_more(self, fetch: Callable[[Entry, int, int], list], limit: int = PAGE) -> int:
        if not self.active:
            return 0
        entry = self.entries[self.active]
        rows = fetch(entry, limit, entry.loaded)
        self.extend(rows)
        return len(rows)

    def select(self, name: str) -> bool:
        if name not in self.entries:
            return False
        self.active, self.cursor = name, -1
        self._changed()
        return True

    def delete(self, name: str) -> None:
        if self.entries.pop(name, None) and self.active == name:
            self.active, self.cursor = None, -1
        self._changed()

    def clear_results(self) -> None:
        self.active, self.cursor = None, -1
        self._changed()

    def clear(self) -> None:
        self.entries.clear()
        self.clear_results()

    def go_to(self, index: int) -> bool:
        if self.active and 0 <= index < len(self.entries[self.active].results):
            self.cursor = index
            return True
        return False

    def step(self, by: int):
        """The next (1) or previous (-1) result, or None at an end that doesn't wrap."""
        rows = self.entries[self.active].results if self.active else []
        if not rows:
            return None
        at = self.cursor + by if self.cursor >= 0 or by > 0 else len(rows) - 1
        if not 0 <= at < len(rows):
            if not self.wrap:
                return None
            at %= len(rows)
        self.cursor = at
        return rows[at]
