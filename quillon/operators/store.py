"""The index on disk: immutable snapshots, and numbered pointers by which writers take turns."""

from __future__ import annotations

import json
import os
import random
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from quillon import schema
from quillon.functions import text as T
from quillon.operators import lookup
from quillon.schema import SearchOptions


class Unreadable(Exception):
    """A pointer or a footer that can't be read."""


class Conflict(Exception):
    """Other writers published first, time and again."""


def apply_files(files: DataFrame, metadata: DataFrame, removed: DataFrame) -> DataFrame:
    """The file table after a changeset: deletes, then upserts by path."""
    gone = removed.select("relative_path").unionByName(metadata.select("relative_path")).distinct()
    return files.join(gone, "relative_path", "left_anti").unionByName(metadata.select(files.columns))


def apply_symbols(symbols: DataFrame, added: DataFrame, metadata: DataFrame, removed: DataFrame) -> DataFrame:
    """The symbol table after a changeset: rows of removed and of re-read files go (also where a file has no symbols any
    more), and new rows come in for files that the batch holds."""
    gone = removed.select("relative_path").unionByName(metadata.select("relative_path")).distinct()
    fresh = added.join(metadata.select("relative_path"), "relative_path", "left_semi")
    return symbols.join(gone, "relative_path", "left_anti").unionByName(fresh.select(symbols.columns))


class Snapshot:
    """A published state of the index: its tables, and the look-ups beside them."""

    def __init__(self, spark: SparkSession, root: str, meta: dict):
        self.spark, self.root, self.meta = spark, root, meta
        self.segments = lookup.Segments(spark, root, meta["segments"])

    def _table(self, name: str, shape: str, only: set[int] | None = None) -> DataFrame:
        """A table, or those of its buckets that ``only`` names."""
        folders = [f"{self.root}/{snap}/{name}/bucket={b}" for b, (snap, *have) in sorted(self.meta["buckets"].items()) if have[name == "symbols"] and (only is None or b in only)]
        return self.spark.read.schema(shape).parquet(*folders) if folders else self.spark.createDataFrame([], shape)

    @property
    def files(self) -> DataFrame:
        return self._table("files", schema.FILES)

    @property
    def symbols(self) -> DataFrame:
        return self._table("symbols", schema.SYMBOLS)

    def file(self, path: str) -> DataFrame:
        """One file's row, from its bucket."""
        return self._table("files", schema.FILES, {lookup.part_of(path, self.meta["of"])}).filter(F.col("relative_path") == path)

    def candidates(self, query: str, options: SearchOptions = SearchOptions(), mode: str = "compat") -> DataFrame | None:
        return self.segments.candidates(query, options, mode)

    def __iter__(self):
        return iter((self.files, self.symbols))

    def __getitem__(self, i: int) -> DataFrame:
        return (self.files, self.symbols)[i]


class Store:
    """Snapshots ``<root>/<id>/`` and pointers ``<root>/live-<number>``, each of which describes one state; the highest number counts.

    Files and symbols are in buckets by a checksum of their path, and a pointer says in which snapshot each bucket is: a change
    writes the buckets of its paths, the others stay where they are. Beside them are segments of look-ups (see ``lookup``): a change writes a
    segment of its own files' rows, taking in older segments that are less than twice as large, so there are few and a row
    is written again a few times at most. Where symbols have outgrown the buckets, all is written anew with more.

    A snapshot is written whole; then its pointer takes the number after the one that the change was based on. Only one writer can: the number
    is taken by a link or rename that fails where it is taken. The other writers' changes are put on top of the new state if they touch other
    buckets, and made again from it if not. So a reader or a lost job sees one state or the next, and no change is lost.
    """

    POINTER, BUCKET_ROWS, LEAST, MOST, TRIES, ABANDONED = "live-", 200_000, 16, 4096, 30, 86_400

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._sound: set[str] = set()  # folders whose footers have been read
        self._staged: set[str] = set()

    # names and pointers

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self) -> list[tuple[str, bool]]:
        """(name, whether a folder) of what the store holds."""
        fs = self._fs()
        if not fs.exists(self._path("")):
            return []
        return [(s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(self._path(""))]

    def _pointers(self) -> list[str]:
        return sorted(n for n, folder in self._names() if not folder and n.startswith(self.POINTER) and n.removeprefix(self.POINTER).isdigit())

    def _meta(self) -> dict | None:
        """What the live pointer says, with its number; ``Unreadable`` where it says nothing."""
        pointers = self._pointers()
        if not pointers:
            return None
        text = self._read(pointers[-1])
        try:
            meta = json.loads(text)
            out = {"snapshot": str(meta["snapshot"]), "schema_version": int(meta["schema_version"]), "number": int(pointers[-1].removeprefix(self.POINTER))}
            if out["schema_version"] == schema.SCHEMA_VERSION:
                out |= {"of": int(meta["of"]), "buckets": {int(b): tuple(x) for b, x in meta["buckets"].items()}, "segments": list(meta["segments"])}
            return out
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise Unreadable(f"pointer {pointers[-1]}") from e

    def _read(self, name: str) -> str:
        file = self._fs().open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
        finally:
            file.close()

    def _swap(self, name: str, number: int) -> bool:
        """Give a written pointer its number; false where another has it."""
        to = f"{self.POINTER}{number:012d}"
        local = self._fs().getScheme() == "file"
        if local:  # a rename would overwrite
            at = self._path("").toUri().getPath()
            try:
                os.link(f"{at}/{name}", f"{at}/{to}")
            except FileExistsError:
                return False
            os.remove(f"{at}/{name}")
            return True
        if self._fs().rename(self._path(name), self._path(to)):
            return True
        if self._fs().exists(self._path(to)):
            return False
        raise OSError("could not move the snapshot pointer")

    def _point(self, meta: dict, after: int) -> bool:
        """Publish a state as the one after number ``after``; false where there is one already."""
        name = f"pointer.{uuid.uuid4().hex[:8]}"
        out = self._fs().create(self._path(name), True)
        out.write(bytearray(json.dumps({k: v for k, v in meta.items() if k != "number"}).encode()))
        out.close()
        if self._swap(name, after + 1):
            return True
        self._fs().delete(self._path(name), False)
        return False

    def version(self) -> int | None:
        meta = self._meta()
        return meta and meta["schema_version"]

    # reading

    def load(self) -> Snapshot | None:
        """The live state; None where there is none or it has no file. A newer schema is an error, an older one starts anew, a store
        whose pointer or file footers can't be read is set aside; other errors rise."""
        try:
            meta = self._meta()
            if meta is None:
                return None
            if meta["schema_version"] > schema.SCHEMA_VERSION:
                raise ValueError(f"the index has schema {meta['schema_version']}, this engine knows {schema.SCHEMA_VERSION}")
            if meta["schema_version"] < schema.SCHEMA_VERSION:
                self.clear()
                return None
            if (problem := self._problem(meta)) is not None:
                raise Unreadable(problem)
            return Snapshot(self.spark, self.root, meta) if any(x[1] for x in meta["buckets"].values()) else None
        except Unreadable:
            self.quarantine()
            return None

    def _problem(self, meta: dict) -> str | None:
        """What keeps a state's files from being read, by their footers alone; a job that fails otherwise raises."""
        folders: dict[str, list[str]] = {}
        for b, (snap, files, symbols) in sorted(meta["buckets"].items()):
            for table, rows in (("files", files), ("symbols", symbols)):
                if rows:
                    folders.setdefault(f"{snap}/{table}", []).append(f"{snap}/{table}/bucket={b}")
        for s in meta["segments"]:
            for family, parts in s["parts"].items():
                if parts:
                    folders.setdefault(f"{s['path']}/{family}", []).extend(f"{s['path']}/{family}/part={p}" for p in parts["have"])
        for whole, parts in folders.items():
            if all(p in self._sound for p in parts):
                continue
            if not self._fs().exists(self._path(f"{whole}/_SUCCESS")) or not all(self._fs().exists(self._path(p)) for p in parts):
                return f"{whole} isn't whole"
            try:
                self.spark.read.parquet(*[f"{self.root}/{p}" for p in parts])  # reads a footer
            except Exception as e:  # noqa: BLE001 - py4j and Spark wrap the cause
                if any(x in str(e) for x in ("not a Parquet file", "read footer", "UNABLE_TO_INFER_SCHEMA", "CANNOT_READ_FILE_FOOTER")):
                    return f"{whole}: {str(e)[:200]}"
                raise
            self._sound.update(parts)
        return None

    def integrity(self) -> str:
        """``ok``, ``not opened`` where there is no index, or what is wrong: every row is read, each symbol must be of a known file, and
        the look-ups must have the symbols' rows."""
        try:
            meta = self._meta()
            if meta is None:
                return "not opened"
            self._sound.clear()
            if (problem := self._problem(meta)) is not None:
                return problem
            now = Snapshot(self.spark, self.root, meta)
            files, symbols = now
            if files.groupBy("relative_path").count().filter("count > 1").limit(1).count():
                return "a file has two rows"
            if symbols.select("relative_path").distinct().join(files, "relative_path", "left_anti").limit(1).count():
                return "symbols of no file"
            counted = symbols.groupBy("relative_path").agg(F.count("*").alias("n"))
            if files.join(counted, "relative_path", "left").filter(F.coalesce("n", F.lit(0)) != F.col("symbol_count")).limit(1).count():
                return "symbol counts differ"
            digest = lambda df, c: tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*c).cast("decimal(20,0)"))).first())
            place = ["name", "relative_path", "line_number", "col", "kind"]
            if digest(symbols, place) != digest(now.segments.rows("names"), place):
                return "symbols by name differ"
            if digest(lookup.postings(symbols), ["token", "positions", *place]) != digest(now.segments.rows("postings"), ["token", "positions", *place]):
                return "postings differ"
            return "ok"
        except Unreadable as e:
            return str(e)

    # writing

    @staticmethod
    def bucket(of: int) -> Column:
        return lookup.part_column(F.col("relative_path"), of)

    def _dealt(self, df: DataFrame, path: str, by: Column, column: str, order: str) -> tuple[list[int], int]:
        """Write ``df`` in folders by ``by``, sorted by ``order``: (the folders, rows)."""
        seen = Observation()
        rows = df.withColumn(column, by).repartition(column).sortWithinPartitions(column, order).observe(seen, F.count("*").alias("n"))
        rows.write.partitionBy(column).parquet(f"{self.root}/{path}")
        names = [s.getPath().getName() for s in self._fs().listStatus(self._path(path))]
        return sorted(int(n.removeprefix(f"{column}=")) for n in names if n.startswith(f"{column}=")), seen.get["n"]

    def _together(self, *work: Callable[[], object]) -> list:
        """What independent writes return; their jobs run side by side, under this thread's tags."""
        with ThreadPoolExecutor(len(work)) as pool:
            return [f.result() for f in [pool.submit(inheritable_thread_target(self.spark)(w)) for w in work]]

    def _written(self, name: str, files: DataFrame, symbols: DataFrame, of: int, fresh: DataFrame, rows: int, gone: DataFrame | None = None, older: lookup.Segments | None = None, void: DataFrame | None = None) -> tuple[dict, dict]:
        """Write both tables' rows in buckets, and a segment with the look-ups of the symbols ``fresh``, with the rows of ``older`` segments that
        aren't of the files ``void``, and the names of files that are ``gone`` from yet older ones: what a pointer says of both."""
        shape = [F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in schema.FILES.split(", ")]
        path = f"{name}/segment"

        def family(which: str):
            df = lookup.BUILD[which](fresh)
            if older is not None and older.segments:
                old = older.rows(which)
                df = df.unionByName(old if which == "grams" or void is None else old.join(void, "relative_path", "left_anti"))
                df = df.distinct() if which == "grams" else df
            of_ = lookup.parts_for(rows * {"names": 1, "postings": 2, "grams": 8}[which])
            have, n = self._dealt(df, f"{path}/{which}", lookup.part_column(F.col(lookup.KEYS[which]), of_), "part", lookup.KEYS[which])
            return {"of": of_, "have": have, "rows": n} if have else None

        def void_files() -> int:
            if gone is None:
                return 0
            seen = Observation()
            gone.observe(seen, F.count("*").alias("n")).write.parquet(f"{self.root}/{path}/gone")
            return seen.get["n"]

        columns = ["name", "name_fold", "kind", "relative_path", "line_number", "col", "tokens"]
        (in_files, _), (in_symbols, _), n_gone, *parts = self._together(
            lambda: self._dealt(files.select(*shape), f"{name}/files", self.bucket(of), "bucket", "relative_path"),
            lambda: self._dealt(symbols.select(*columns), f"{name}/symbols", self.bucket(of), "bucket", "name_fold"),
            void_files, *[lambda w=which: family(w) for which in lookup.BUILD])
        buckets = {b: (name, int(b in in_files), int(b in in_symbols)) for b in {*in_files, *in_symbols}}
        parts = dict(zip(lookup.BUILD, parts, strict=True))
        return buckets, {"path": path, "parts": parts, "gone": n_gone, "rows": (parts["names"] or {"rows": 0})["rows"]}

    def buckets_for(self, rows: int) -> int:
        return min(self.MOST, max(self.LEAST, 1 << max(0, (max(1, rows) - 1) // self.BUCKET_ROWS).bit_length()))

    @staticmethod
    def _named() -> str:
        return f"{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:8]}"

    def _whole(self, files: DataFrame, symbols: DataFrame) -> dict:
        """Write a state anew: what its pointer says."""
        name = self._named()
        symbols = self.stage(symbols, "whole")
        rows = symbols.count()
        of = self.buckets_for(rows)
        buckets, segment = self._written(name, files, symbols, of, symbols, rows)
        return {"snapshot": name, "schema_version": schema.SCHEMA_VERSION, "of": of, "buckets": buckets, "segments": [segment]}

    def publish(self, files: DataFrame, symbols: DataFrame) -> str:
        """Write a whole new state, which takes the place of the live one, whatever that is by then."""
        meta = self._whole(files, symbols)
        while not self._point(meta, max([int(p.removeprefix(self.POINTER)) for p in self._pointers()], default=0)):
            pass
        return meta["snapshot"]

    def stage(self, df: DataFrame, label: str) -> DataFrame:
        """``df``, written once to the store's staging folder; ``compact`` removes it."""
        name = f"staging-{label}-{uuid.uuid4().hex[:8]}"
        self._staged.add(name)
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def apply(self, metadata: DataFrame, added: DataFrame, removed: DataFrame) -> str | None:
        """Publish the live state changed by a changeset; nothing is written for an empty one."""
        if metadata.isEmpty() and removed.isEmpty():
            return None
        for attempt in range(self.TRIES):
            live = self.load()
            base = self._meta() if live is not None else None
            mine, touched = self._changed(base, metadata, added, removed)
            after = base["number"] if base else max([int(p.removeprefix(self.POINTER)) for p in self._pointers()], default=0)
            while True:
                if self._point(mine, after):
                    return mine["snapshot"]
                now = self._meta()
                if base is None or (mine := self._rebased(mine, base, now, touched)) is None:
                    break  # make the change again from what is live now
                base, after = now, now["number"]
            time.sleep(random.random() * min(0.05 * 2**attempt, 2))
        raise Conflict(f"other writers came first {self.TRIES} times")

    def _changed(self, base: dict | None, metadata: DataFrame, added: DataFrame, removed: DataFrame) -> tuple[dict, set[int]]:
        """Write what a changeset makes of a state: the new state, and the buckets that differ."""
        empty = lambda shape: self.spark.createDataFrame([], shape)
        if base is None:
            files, symbols = empty(schema.FILES), empty(schema.SYMBOLS)
            return self._whole(apply_files(files, metadata, removed), apply_symbols(symbols, added, metadata, removed)), set()
        now, of = Snapshot(self.spark, self.root, base), base["of"]
        fresh = added.join(metadata.select("relative_path"), "relative_path", "left_semi")
        rows = fresh.count()
        if self.buckets_for(rows + sum(s["rows"] for s in base["segments"])) > 2 * of:
            return self._whole(apply_files(now.files, metadata, removed), apply_symbols(now.symbols, fresh, metadata, removed)), set(range(of))
        name = self._named()
        paths = metadata.select("relative_path").unionByName(removed.select("relative_path")).distinct()
        touched = {r[0] for r in paths.select(self.bucket(of).alias("b")).distinct().collect()}  # at most as many as there are buckets
        files = apply_files(now._table("files", schema.FILES, touched), metadata, removed)
        symbols = apply_symbols(now._table("symbols", schema.SYMBOLS, touched), fresh, metadata, removed)
        segments, small = list(base["segments"]), []
        size = rows
        while segments and segments[-1]["rows"] < 2 * size + 1000:  # a segment takes in those that aren't much larger
            small.insert(0, segments.pop())
            size += small[0]["rows"]
        older = lookup.Segments(self.spark, self.root, small)
        gone = older.gone(-1)
        gone = None if not segments else paths if gone is None else paths.unionByName(gone).distinct()  # none where nothing is older
        buckets, segment = self._written(name, files, symbols, of, fresh, size, gone, older, paths)
        buckets = {b: x for b, x in base["buckets"].items() if b not in touched} | buckets
        return {"snapshot": name, "schema_version": schema.SCHEMA_VERSION, "of": of, "buckets": buckets, "segments": [*segments, segment]}, touched

    def _rebased(self, mine: dict, base: dict, now: dict | None, touched: set[int]) -> dict | None:
        """My state put on top of another that was made from the same base; None where both touch a bucket or have merged segments."""
        if now is None or now.get("of") != base["of"] or mine["of"] != base["of"] or now["segments"][: len(base["segments"])] != base["segments"]:
            return None
        theirs = {b for b in base["buckets"].keys() | now["buckets"].keys() if base["buckets"].get(b) != now["buckets"].get(b)}
        if theirs & touched:
            return None
        buckets = {b: x for b, x in now["buckets"].items() if b not in touched} | {b: x for b, x in mine["buckets"].items() if b in touched}
        return mine | {"buckets": buckets, "segments": [*mine["segments"], *now["segments"][len(base["segments"]) :]]}

    def compact(self, keep: int = 1) -> list[str]:
        """Remove what no one of the newest ``keep`` pointers leads to, the pointers before them, and what this store staged. What another
        writer may still be at, snapshots and files that never had a pointer, stays for ``ABANDONED`` seconds."""
        fs, names, pointers = self._fs(), self._names(), self._pointers()
        leads = lambda p: self._leads(json.loads(self._read(p)))
        held = {n for p in pointers[-keep:] for n in leads(p)}
        old = {n for p in pointers[:-keep] for n in leads(p)} - held
        age = lambda n: time.time() - fs.getFileStatus(self._path(n)).getModificationTime() / 1000
        present = {n for n, _ in names}
        for n in present - held - old:
            if n in self._staged or not n.startswith(self.POINTER) and age(n) > self.ABANDONED:
                old.add(n)
        self._staged.clear()
        for n in [*sorted(old & present), *pointers[:-keep]]:
            fs.delete(self._path(n), True)
        return sorted(n for n in old if n[:13].isdigit())

    @staticmethod
    def _leads(meta: dict) -> set[str]:
        """The snapshots that a pointer leads to."""
        return {meta["snapshot"], *(x[0] for x in meta.get("buckets", {}).values()), *(s["path"].split("/")[0] for s in meta.get("segments", []))}

    def clear(self) -> None:
        self._sound.clear()
        self._fs().delete(self._path(""), True)

    def quarantine(self) -> str | None:
        """Rename the store to ``<root>.corrupt-<time>`` and start empty."""
        fs = self._fs()
        self._sound.clear()
        if not fs.exists(self._path("")):
            return None
        to = self.root + ".corrupt-" + time.strftime("%Y-%m-%dT%H-%M-%S", time.gmtime()) + f"-{time.time_ns() % 10**9:09d}Z"
        fs.rename(self._path(""), self.spark._jvm.org.apache.hadoop.fs.Path(to))
        return to
