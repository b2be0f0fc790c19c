"""What an index keeps beside its symbols so that searches read few of them: symbols by name, positional postings, trigrams of names.

Each family is dealt to parts by a checksum of its key, which the driver can work out too, and sorted by key within a part, so a look-up opens the
parts of its keys and skips pages in them. Families are written in segments. A segment holds the rows of the files that its change
read, and names the files whose rows in older segments no longer count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from quillon.functions import grams as G, text as T
from quillon.operators import search as find
from quillon.schema import SearchOptions

PLACE = "name string, relative_path string, line_number int, col int, kind tinyint"
FAMILIES = {"names": "name_fold string, " + PLACE, "postings": "token string, positions array<int>, " + PLACE, "grams": "gram string, name string"}
KEYS = {"names": "name_fold", "postings": "token", "grams": "gram"}
PART_ROWS = 250_000
MOST_PARTS = 1024
FEW_NAMES = 1000
_PLACE = ["name", "relative_path", "line_number", "col", "kind"]


def part_of(key: str, parts: int) -> int:
    return zlib.crc32(key.encode()) % parts


def part_column(key: Column, parts: int) -> Column:
    return F.pmod(F.crc32(key.cast("binary")), F.lit(parts)).cast("int")


def parts_for(rows: int) -> int:
    """A power of two, of about ``PART_ROWS`` rows each."""
    return min(MOST_PARTS, 1 << max(0, (max(1, rows) - 1) // PART_ROWS).bit_length())


def by_name(symbols: DataFrame) -> DataFrame:
    return symbols.select("name_fold", *_PLACE)


def postings(symbols: DataFrame) -> DataFrame:
    """(token, positions, ...): a row for each symbol and distinct token, with the token's places in the name."""
    places = lambda t: F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: F.get("tokens", i) == t)
    each = F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("token"), places(t).cast("array<int>").alias("positions")))
    return symbols.filter(F.size("tokens") > 0).withColumn("_t", F.explode(each)).select("_t.token", "_t.positions", *_PLACE)


def name_grams(symbols: DataFrame) -> DataFrame:
    """(gram, name) of distinct names."""
    return symbols.select("name").distinct().select(F.explode(G.of_column(G.folded(F.col("name")))).alias("gram"), "name")


BUILD = {"names": by_name, "postings": postings, "grams": name_grams}


class Segments:
    """The families of a snapshot's segments, oldest first: dicts of ``path``, ``parts`` (by family) and ``gone`` (how many files it voids)."""

    SMALL = 100_000  # files that a segment voids, up to which they are broadcast

    def __init__(self, spark, root: str, segments: list[dict]):
        self.spark, self.root, self.segments = spark, root, segments

    def gone(self, after: int) -> DataFrame | None:
        """The files that segments after that one void; null where there are none."""
        later = [s for s in self.segments[after + 1 :] if s["gone"]]
        if not later:
            return None
        out = self.spark.read.schema("relative_path string").parquet(*[f"{self.root}/{s['path']}/gone" for s in later])
        return F.broadcast(out) if sum(s["gone"] for s in later) <= self.SMALL else out

    def rows(self, family: str, keys: Iterable[str] | None = None) -> DataFrame:
        """A family's rows, or those of ``keys``, of which only the parts are opened."""
        out = self.spark.createDataFrame([], FAMILIES[family])
        keys = None if keys is None else sorted(set(keys))
        for i, s in enumerate(self.segments):
            parts = s["parts"][family]
            if not parts:
                continue
            base = f"{self.root}/{s['path']}/{family}"
            want = {part_of(k, parts["of"]) for k in keys} if keys is not None else set(parts["have"])
            folders = [f"{base}/part={p}" for p in parts["have"] if p in want]
            if not folders:
                continue
            df = self.spark.read.schema(FAMILIES[family]).parquet(*folders)
            df = df if keys is None else df.filter(F.col(KEYS[family]).isin(*keys))
            if family != "grams" and (void := self.gone(i)) is not None:
                df = df.join(void, "relative_path", "left_anti")
            out = df if out.isLocal() and not i else out.unionByName(df)
        return out

    # searches

    def phrases(self, query: str) -> DataFrame:
        """Symbols in whose tokens one of the query's runs is a phrase, from postings alone."""
        wanted = [p for p in find.phrases(query) if p]
        found = self.rows("postings", [t for p in wanted for t in p])
        if len(wanted) == 1 and len(wanted[0]) == 1:
            return found.select(_PLACE)
        have = found.groupBy(_PLACE).agg(F.map_from_entries(F.collect_list(F.struct("token", "positions"))).alias("at"))
        met = F.lit(False)
        for phrase in wanted:
            met = met | _adjacent(F.col("at"), phrase)
        return have.filter(F.coalesce(met, F.lit(False))).select(_PLACE)

    def named(self, names: DataFrame) -> DataFrame:
        """The symbols of ``names`` (name, distinct): by their parts where they are few, else by a join with symbols by name."""
        few = [r[0] for r in names.limit(FEW_NAMES + 1).collect()]
        if len(few) <= FEW_NAMES:
            return self.rows("names", [T.fold(n) for n in few]).filter(F.col("name").isin(*few)).select(_PLACE)
        return self.rows("names").join(names, "name", "left_semi").select(_PLACE)

    def with_grams(self, condition: G.Condition) -> DataFrame:
        """Distinct names that meet a condition on trigrams."""
        have = self.rows("grams", G.members(condition)).groupBy("name").agg(F.collect_set("gram").alias("have"))
        return have.filter(G.met(condition, F.col("have"))).select("name")

    def candidates(self, query: str, options: SearchOptions = SearchOptions(), mode: str = "compat") -> DataFrame | None:
        """Symbols (name, relative_path, line_number, col, kind) among which are all matches of a query that isn't empty, from look-ups;
        None where no look-up can tell and all symbols must be read."""
        if options.whole_word and not options.regex:
            return self.rows("names", [T.fold(query)]).select(_PLACE)
        if mode == "compat" and T.literal_tokens_of(query):
            return self.phrases(query)
        condition = G.of_pattern(query) if options.regex else G.of_literal(query)
        if condition is None:
            return None
        names = self.with_grams(condition)
        return self.named(names.filter(find.residual(query, options, fold=T.ascii_fold(F.col("name")))))


def _adjacent(at: Column, phrase: list[str]) -> Column:
    """Whether the phrase's tokens, by whose places ``at`` is a map, follow one another somewhere."""
    here = _every([at[t].isNotNull() for t in dict.fromkeys(phrase)])
    return here & F.exists(at[phrase[0]], lambda p: _every([F.array_contains(at[t], (p + i).cast("int")) for i, t in enumerate(phrase) if i]))


def _every(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out
