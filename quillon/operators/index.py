"""Maintenance of the symbol index: changes of files, changesets, and snapshots on disk."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from enum import Enum

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillon import schema
from quillon.functions import text as T
from quillon.operators import extract, search as find
from quillon.operators.store import Conflict, Snapshot, Store, Unreadable, apply_files, apply_symbols  # noqa: F401 - the maintenance operators
from quillon.sources import corpus, tree
from quillon.streaming import changes

BATCH = 128


def changed(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Files of ``current`` that are new or differ in time (whole ms) or size."""
    old = previous.select("relative_path", F.col("mtime_ms").cast("bigint").alias("_t"), F.col("size_bytes").alias("_s"))
    both = current.join(old, "relative_path", "left")
    same = F.col("mtime_ms").cast("bigint").eqNullSafe(F.col("_t")) & F.col("size_bytes").eqNullSafe(F.col("_s"))
    return both.filter(~same).drop("_t", "_s")


def deleted(current: DataFrame, previous: DataFrame) -> DataFrame:
    return previous.join(current.select("relative_path"), "relative_path", "left_anti").select("relative_path")


def batches(files: DataFrame, size: int = BATCH, groups: int = 64) -> DataFrame:
    """``files`` with ``batch``: runs of ``size`` files in path order, numbered from 0.

    Paths are ranked in two levels: ranges, cut at paths that a hash picks, whose counts (one row a range) are added up, and places in
    a range.
    """
    paths = files.select("relative_path")
    every = max(1, paths.count() // (4 * groups))
    cuts = [r[0] for r in paths.filter(F.pmod(F.xxhash64("relative_path"), F.lit(every)) == 0).orderBy("relative_path").limit(16 * groups).collect()]
    cuts = sorted(set(cuts))[:: max(1, len(cuts) // groups)]
    group = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("relative_path"))) if cuts else F.lit(0)
    keyed = files.withColumn("_g", group)
    before, at = [0] * (len(cuts) + 2), 0
    counts = dict(keyed.groupBy("_g").count().collect())  # one row a range
    for g in range(len(cuts) + 1):
        before[g], at = at, at + counts.get(g, 0)
    place = F.row_number().over(Window.partitionBy("_g").orderBy("relative_path")) - 1 + F.element_at(F.array(*map(F.lit, before)), F.col("_g") + 1)
    return keyed.withColumn("batch", F.floor(place / size)).drop("_g")


def progress(files: DataFrame, batch: str = "batch", size: str = "size_bytes") -> DataFrame:
    """For each batch, how many files and bytes are done with it and all before it: (batch, files_done, bytes_done)."""
    per = files.groupBy(batch).agg(F.count("*").alias("_n"), F.sum(size).alias("_s"))
    so_far = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, 0)  # a row a batch
    return per.select(batch, F.sum("_n").over(so_far).alias("files_done"), F.sum("_s").over(so_far).alias("bytes_done"))


def file_metadata(files: DataFrame, path: str) -> DataFrame:
    """The row of one file."""
    return files.filter(F.col("relative_path") == path)


def group_symbols(metadata: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each file's symbols in one array, empty for files without; symbols of files that aren't in ``metadata`` go."""
    grouped = symbols.groupBy("relative_path").agg(F.sort_array(F.collect_list(F.struct("line_number", "name", "kind"))).alias("symbols"))
    joined = metadata.join(grouped, "relative_path", "left")
    return joined.withColumn("symbols", F.coalesce("symbols", F.array().cast("array<struct<line_number:int,name:string,kind:string>>")))


def symbol_counts(files: DataFrame, symbols: DataFrame) -> DataFrame:
    counts = symbols.groupBy("relative_path").agg(F.count("*").cast("int").alias("symbol_count"))
    return files.drop("symbol_count").join(counts, "relative_path", "left").withColumn("symbol_count", F.coalesce("symbol_count", F.lit(0)))


def stats(files: DataFrame, symbols: DataFrame) -> DataFrame:
    n = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("_one", F.lit(1))
    return n(files, "files").join(n(symbols, "symbols"), "_one").drop("_one")


class Cancelled(Exception):
    """A sync or a search that its caller stopped."""


class Status(Enum):
    NONE, BUILDING, READY, STALE = "none", "building", "ready", "stale"


class Index:
    """The engine's face: synchronise a tree, follow changes, search, count.

    One sync runs at a time. Callers of ``synchronize`` that come while one runs share its result; ``sync_dirty`` waits for its turn. A disabled
    index does nothing, and drops its marks.
    """

    KEEP = 2  # states that stay after a sync, so that readers of the one before aren't cut off

    def __init__(self, spark: SparkSession, root: str, store: str, extensions=corpus.EXTENSIONS, excludes=corpus.EXCLUDES, include_paths=(), enabled: bool = True, during_sync: str = "prompt-grep-fallback", max_file_bytes=T.DEFAULT_MAX_BYTES, auto_sync: float | None = None):
        self.spark, self.root, self.store, self.enabled = spark, corpus.canonical_root(root), Store(spark, store), enabled
        self.scan = dict(extensions=extensions, excludes=excludes, include_paths=include_paths)
        self.max_file_bytes = T.max_file_bytes(max_file_bytes)
        self.status, self.errors, self._dirty, self._gone = Status.NONE, None, set(), set()
        self._lock, self._turn, self._running, self._cancel = threading.Lock(), threading.Lock(), None, None
        self.on_status: list[Callable[[Status], None]] = []
        self.on_stats: list[Callable[[dict], None]] = []
        self.warnings: list[str] = []
        #: With ``auto_sync``, marks are taken up once none has come for so many seconds.
        self.auto = None if auto_sync is None else changes.AutoSync(self.sync_dirty, auto_sync, enabled)
        #: What a search does while a sync runs; ``ask`` is called with what a prompt expects, and answers ``grep`` or ``cancel``.
        self.during_sync, self.ask, self._choice = during_sync, lambda expect: "grep" if expect == "grep-fallback" else "cancel", (0.0, None)

    def _set(self, status: Status) -> None:
        if status is not self.status:
            self.status = status
            for f in self.on_status:
                f(status)

    def _emit_stats(self) -> None:
        if self.on_stats:
            now = self.stats()
            for f in self.on_stats:
                f(now)

    def load(self) -> bool:
        found = self.store.load() is not None
        self._set(Status.READY if found else Status.NONE)
        self._emit_stats()
        return found

    def mark(self, path: str, removed: bool = False) -> None:
        """Note a change or removal; the last of a path counts."""
        if not self.enabled:
            return
        with self._lock:
            (self._dirty.discard if removed else self._gone.discard)(path)
            (self._gone if removed else self._dirty).add(path)
        if self.status is Status.READY:
            self._set(Status.STALE)
        if self.auto is not None:
            self.auto.mark(path)

    def dispose(self) -> None:
        """No more automatic syncs."""
        if self.auto is not None:
            self.auto.dispose()

    @property
    def sync_in_progress(self) -> bool:
        return self._turn.locked()

    def cancel(self) -> None:
        """Stop the sync that runs: its Spark jobs are cancelled, nothing of it is published."""
        tag = self._cancel
        if tag is not None:
            tag["stop"] = True
            self.spark.sparkContext.cancelJobsWithTag(tag["name"])

    def drain(self, timeout: float = 60.0) -> bool:
        """Wait until no sync runs; after ``timeout`` seconds give up, with a warning."""
        if not self._turn.acquire(timeout=timeout):
            self.warnings.append(f"a sync still ran after {timeout:g} s")
            return False
        self._turn.release()
        return True

    def _in_turn(self, work: Callable[[], str | None]) -> str | None:
        """``work`` alone, under a tag by which it can be cancelled."""
        with self._turn:
            context, tag = self.spark.sparkContext, {"name": f"sync-{uuid.uuid4().hex[:12]}", "stop": False}
            self._cancel = tag
            context.addJobTag(tag["name"])
            try:
                return work()
            except Exception as e:
                if tag["stop"]:
                    raise Cancelled from e
                raise
            finally:
                context.removeJobTag(tag["name"])
                self._cancel = None

    def _check(self) -> None:
        if self._cancel and self._cancel["stop"]:
            raise Cancelled

    def synchronize(self, progress: Callable[[str], None] = lambda phase: None) -> str | None:
        """Scan, classify, extract and publish; callers that come while one runs wait for it and share its result."""
        if not self.enabled:
            return self._disabled()
        self._choice = (0.0, None)
        with self._lock:
            mine = self._running is None
            if mine:
                self._running = {"done": threading.Event()}
            run = self._running
        if not mine:
            run["done"].wait()
            if "error" in run:
                raise run["error"]
            return run["result"]
        before = self.status
        try:
            run["result"] = self._in_turn(lambda: self._full(progress))
            return run["result"]
        except Cancelled as e:
            run["error"] = e
            self._dirty.clear()
            self._gone.clear()
            self._set(Status.STALE if self.store.load() else Status.NONE)
            raise
        except Exception as e:
            run["error"] = e
            self._set(Status.STALE if before is not Status.NONE else Status.NONE)  # marks are kept
            raise
        finally:
            with self._lock:
                self._running = None
            run["done"].set()

    def _full(self, progress) -> str | None:
        self._set(Status.BUILDING)
        dirty, gone = set(self._dirty), set(self._gone)
        progress("scanning")
        current = self.store.stage(corpus.scan_tree(self.spark, self.root, **self.scan), "listing")  # listed once
        progress("classifying")
        old = self.store.load()
        previous = old.files if old else self.spark.createDataFrame([], schema.FILES)
        out = self._read_and_publish(changed(current, previous), self.store.stage(deleted(current, previous), "removed"), progress)
        self._settle(dirty, gone)
        return out

    def _settle(self, dirty: set, gone: set) -> None:
        """After a sync: marks that it took up go; those that came meanwhile stay, and the index is stale by them."""
        with self._lock:
            self._dirty -= dirty
            self._gone -= gone
            left = self._dirty or self._gone
        if self.store.load() is None:
            self._set(Status.NONE)
        else:
            self.store.compact(self.KEEP)
            self._set(Status.STALE if left else Status.READY)
        self._emit_stats()

    def _disabled(self) -> None:
        with self._lock:
            self._dirty.clear()
            self._gone.clear()

    def sync_dirty(self) -> str | None:
        """Take up the marks: only the marked files are looked at and read."""
        if not self.enabled:
            return self._disabled()

        def work() -> str | None:
            with self._lock:
                dirty, gone = set(self._dirty), set(self._gone)
            out = None
            if dirty or gone:
                todo = corpus.scan_tree(self.spark, self.root, **self.scan, paths=sorted(dirty))
                removed = self.spark.createDataFrame([(p,) for p in sorted(gone)], "relative_path string")
                out = self._read_and_publish(todo, removed, lambda phase: None)
            self._settle(dirty, gone)
            return out

        return self._in_turn(work)

    def take_up(self, dirty: DataFrame, removed: DataFrame) -> str | None:
        """Mark the files (relative_path) of a change stream's batch and take the marks up; for ``changes.follow``."""
        for path in [r[0] for r in dirty.select("relative_path").toLocalIterator()]:
            self.mark(path)
        for path in [r[0] for r in removed.select("relative_path").toLocalIterator()]:
            self.mark(path, removed=True)
        return self.sync_dirty()

    def _read_and_publish(self, todo: DataFrame, removed: DataFrame, progress) -> str | None:
        """``todo`` (relative_path, mtime_ms, size_bytes) has the files to read, and no other is opened."""
        progress("parsing")
        self._check()
        todo = self.store.stage(todo.select("relative_path", "mtime_ms", "size_bytes"), "todo")
        if todo.isEmpty() and removed.isEmpty():
            return None
        read = self.store.stage(extract_rows(todo, self.root, self.max_file_bytes), "read")  # small files are read and lexed once
        self._check()
        bad = read.filter("error is not null").select("relative_path", "error")
        fresh = self.store.stage(extract.symbols(read.filter("name is not null")), "symbols")
        good = read.filter("name is null and error is null").select("relative_path", "mtime_ms", "size_bytes").join(bad.select("relative_path").distinct(), "relative_path", "left_anti")
        self.errors = self.spark.createDataFrame(bad.limit(1_000).collect(), bad.schema)  # a report: staged files go
        self.error_count = self.errors.count() if self.errors.isEmpty() else bad.count()
        progress("saving")
        self._check()
        return self.store.apply(symbol_counts(good, fresh), fresh, removed)

    # reading

    def tables(self) -> Snapshot | None:
        """The state, (files, symbols), where the index is usable: enabled, and ready or stale."""
        return self.store.load() if self.enabled and self.status in (Status.READY, Status.STALE) else None

    def lines(self, include=(), exclude=(), ignore=()) -> DataFrame:
        """The lines of the tree's text files. A search's own ``include`` takes the place of the settings' extensions, ``exclude`` adds to
        the settings'. Files that the filters take out aren't read."""
        includes, excludes = T.merged_filters([e for e in self.scan["extensions"]], self.scan["excludes"], include, exclude)
        files = corpus.scan_tree(self.spark, self.root, (), excludes, self.scan["include_paths"])
        files = find.not_ignored(find.path_filter(files, includes), list(ignore)).filter(~F.col("relative_path").rlike(r"(^|/)\."))
        return corpus.split_lines(corpus.contents(files, self.root).filter("error is null"))

    def search(self, query: str, options: schema.SearchOptions = schema.SearchOptions(), limit: int = find.PAGE, offset: int = 0, mode: str = "compat", seek: tuple | None = None) -> DataFrame:
        """A page of symbols with their lines; nothing where the index isn't usable. Only the page's files are opened."""
        now = self.tables()
        if now is None:
            none = find.search(self.spark.createDataFrame([], schema.SYMBOLS), query, options)
            return find.result_lines(none, self.spark.createDataFrame([], schema.LINES), self.root)
        page = find.search(now, query, options, T.page_size(limit), offset, mode, seek=seek)
        page = self.spark.createDataFrame(page.collect(), page.schema)  # at most 10,000 rows
        places = page.select("relative_path", "line_number").distinct()
        if corpus.is_local(self.root):
            lines = tree.read_places(places, self.root)
        else:
            lines = corpus.split_lines(corpus.contents(places.select("relative_path").distinct(), self.root), binary=True)
        return find.result_lines(page, lines, self.root)

    def count(self, query: str, options: schema.SearchOptions = schema.SearchOptions(), mode: str = "compat") -> int:
        now = self.tables()
        return find.count_matches(now, query, options, mode).first()["n"] if now else 0

    def grep(self, query: str, options: schema.SearchOptions = schema.SearchOptions(), include=(), exclude=()) -> DataFrame:
        """The full-text search of the tree's files that ignore files leave in."""
        return find.text_search(self.lines(include, exclude, corpus.ignore_rules(self.spark, self.root)), query, options)

    def _choose(self) -> str:
        """``grep`` or ``cancel`` for a search while a sync runs: a choice of less than a second ago, the setting, or an answer."""
        action, expect = find.sync_choice(self.during_sync, time.time(), *self._choice)
        if action == "prompt":
            try:
                action = "grep" if self.ask(expect) == "grep" else "cancel"
            except Exception:  # noqa: BLE001 - a prompt that fails is a prompt that nobody answered
                action = "cancel"
        self._choice = (time.time(), action)
        return action

    def hybrid(self, query: str, options: schema.SearchOptions = schema.SearchOptions(), limit: int = find.PAGE, offset: int = 0, include=(), exclude=(), tag: str | None = None) -> tuple[DataFrame, int]:
        """(page, total): symbols; where the first page is empty or the index unusable, the full-text search; while a sync runs,
        the full-text search or nothing (see ``during_sync``). With a ``tag``, ``abort`` stops it, and ``Cancelled`` rises."""
        return stoppable(self.spark, tag, lambda: self._hybrid(query, options, limit, offset, include, exclude))

    def abort(self, tag: str) -> None:
        self.spark.sparkContext.cancelJobsWithTag(tag)

    def _hybrid(self, query, options, limit, offset, include, exclude) -> tuple[DataFrame, int]:
        if self.sync_in_progress:
            found = self.grep(query if self._choose() == "grep" else "", options, include, exclude)  # an empty query finds nothing
            return found, found.count()
        if self.tables():
            page = self.search(query, options, limit, offset)
            if offset or not page.isEmpty():
                return page, self.count(query, options)
        found = self.grep(query, options, include, exclude)
        return found, found.count()

    def stats(self) -> dict:
        tables = self.tables()
        return stats(*tables).first().asDict() if tables else {"files": 0, "symbols": 0}

    def integrity(self) -> str:
        return self.store.integrity()

    def schema_version(self) -> int | None:
        return self.store.version()

    def clear(self) -> None:
        with self._turn:
            self.store.clear()
            self._dirty.clear()
            self._gone.clear()
            self._set(Status.NONE)
        self._emit_stats()


def stoppable(spark: SparkSession, tag: str | None, work: Callable[[], object]):
    """``work`` under a job tag; ``spark.sparkContext.cancelJobsWithTag(tag)`` stops it, and ``Cancelled`` rises."""
    if tag is None:
        return work()
    spark.sparkContext.addJobTag(tag)
    try:
        return work()
    except Exception as e:
        if "cancel" in str(e).lower():
            raise Cancelled from e
        raise
    finally:
        spark.sparkContext.removeJobTag(tag)


def extract_rows(files: DataFrame, root: str, limit: int = T.DEFAULT_MAX_BYTES, range_bytes: int = tree.RANGE_BYTES) -> DataFrame:
    """One row for each file of ``files`` (relative_path, mtime_ms, size_bytes) that could be read, with null name and error, and one for each
    symbol or error. Files are read in the way their size asks for: small ones whole, by the lexer; large ones in ranges, by lines."""
    how = files.withColumn("how", extract.route(F.col("size_bytes"), limit))
    out = extract.lexed_rows(corpus.contents(how.filter("how = 'ast'"), root))
    large = how.filter("how <> 'ast'")
    if large.isEmpty():
        return out
    none = lambda kind: F.lit(None).cast(kind)
    shape = {"mtime_ms": "bigint", "size_bytes": "bigint", "line_number": "int", "col": "int", "name": "string", "kind": "string", "error": "string"}
    row = lambda df, have: df.select("relative_path", *[(F.col(c).cast(t) if c in have else none(t)).alias(c) for c, t in shape.items()])
    checked = large.join(tree.readable(large, root), "relative_path")
    out = out.unionByName(row(checked.filter("error is null"), ("mtime_ms", "size_bytes"))).unionByName(row(checked.filter("error is not null"), ("error",)))
    for name, macros_only in (("stream", False), ("macros", True)):
        lines = tree.read_lines(checked.filter((F.col("how") == name) & F.col("error").isNull()), root, range_bytes)
        out = out.unionByName(row(extract.by_line(lines, macros_only), ("line_number", "col", "name", "kind")))
    return out
