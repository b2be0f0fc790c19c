"""Directory trees as a data source: listed in partitions, and read only where asked.

``list_tree`` lists folders in tasks, one folder at the top a partition, and opens no file. ``read_files`` opens the files of a table of paths where
Spark has dealt the paths, and no other file. ``line_ranges`` and ``read_lines`` read files in byte ranges, so one large file is many
tasks': newlines are counted by range, added up by file, and lines are then read with their numbers.

Local roots are opened as files, others (``hdfs://``, ``s3://``, ...) by Arrow's file systems. Every executor must reach the root.
"""

from __future__ import annotations

import io
import json
import os
import time
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quillon.schema import CHANGES
from quillon.session import ship

LISTED = "relative_path string, mtime_ms bigint, size_bytes bigint"
READ = LISTED + ", content string, error string"
BATCH_BYTES = 8 << 20
RANGE_BYTES = 32 << 20


def opened(root: str) -> tuple[arrow_fs.FileSystem, str]:
    """(file system, path) of a root."""
    if "://" not in root or root.startswith("file:"):
        return arrow_fs.LocalFileSystem(), os.path.abspath("/" + root.removeprefix("file:").lstrip("/") if root.startswith("file:") else root)
    return arrow_fs.FileSystem.from_uri(root)


def _joined(base: str, path: str) -> str:
    return f"{base.rstrip('/')}/{path}" if path else base


def _millis(info: arrow_fs.FileInfo) -> int:
    return (info.mtime_ns or 0) // 1_000_000


def children(fs: arrow_fs.FileSystem, base: str, folder: str) -> tuple[list[tuple[str, int, int]], list[str]]:
    """(files, folders) right below ``folder``; files as (path, time in ms, size). Folders behind links and what can't be read are left out."""
    files, folders = [], []
    try:
        found = fs.get_file_info(arrow_fs.FileSelector(_joined(base, folder), allow_not_found=True))
    except OSError:
        return [], []
    local = isinstance(fs, arrow_fs.LocalFileSystem)
    for info in found:
        path = f"{folder}/{info.base_name}" if folder else info.base_name
        if info.type is arrow_fs.FileType.File:
            files.append((path, _millis(info), info.size))
        elif info.type is arrow_fs.FileType.Directory and not (local and os.path.islink(info.path)):
            folders.append(path)
    return files, folders


def status(fs: arrow_fs.FileSystem, base: str, path: str) -> tuple[str, int, int] | None:
    """One file's (path, time, size); None where there is no such file below the root."""
    if path.startswith("/") or ".." in path.split("/"):
        return None
    info = fs.get_file_info(_joined(base, path))
    return (path, _millis(info), info.size) if info.type is arrow_fs.FileType.File else None


@dataclass
class Folder(InputPartition):
    """A folder with all below it, or, without ``deep``, the files of one folder alone."""

    path: str
    deep: bool


class TreeReader(DataSourceReader):
    SPREAD = 256  # folders are opened until there are so many

    def __init__(self, root: str, tops: list[str]):
        self.root = root
        self.tops = [t for t in sorted(set(tops)) if not any(t.startswith(f"{u}/") for u in tops)] or [""]

    def partitions(self):
        fs, base = opened(self.root)
        flat, deep = self.tops, [d for t in self.tops for d in children(fs, base, t)[1]]
        while deep and len(flat) + len(deep) < self.SPREAD:
            below = [children(fs, base, d)[1] for d in deep]
            if not any(below):
                break
            flat, deep = flat + deep, [f for b in below for f in b]
        return [Folder(f, False) for f in flat] + [Folder(d, True) for d in deep]

    def read(self, partition):
        fs, base = opened(self.root)
        rows, todo = [], [partition.path]
        while todo:
            files, folders = children(fs, base, todo.pop())
            rows += files
            todo += folders if partition.deep else []
            if len(rows) > 50_000:
                yield _listed(rows)
                rows = []
        yield _listed(rows)


def _listed(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["relative_path", "mtime_ms", "size_bytes"])


class TreeSource(DataSource):
    """``spark.read.format("quillon_tree").option("root", ...)``: the files below a root."""

    @classmethod
    def name(cls):
        return "quillon_tree"

    def schema(self):
        return LISTED

    def reader(self, schema):
        return TreeReader(self.options["root"], json.loads(self.options.get("tops", "[]")))


def _listing(root: str, tops: list[str]) -> dict[str, list[int]]:
    """Time and size of each file below a root."""
    fs, base = opened(root)
    out, todo = {}, list(tops) or [""]
    while todo:
        files, folders = children(fs, base, todo.pop())
        out.update({p: [t, n] for p, t, n in files})
        todo += folders
    return out


class TreeChanges(DataSourceStreamReader):
    """What has changed in a tree from one look at it to the next.

    An offset is the number of a listing, which is kept as a file of the ``state`` folder until all before it is committed. So a
    restart goes on from the listing it had reached, and a batch that is run again gives the same rows.
    """

    PARTS = 8

    def __init__(self, options: dict):
        self.root, self.state, self.tops = options["root"], options["state"], json.loads(options.get("tops", "[]"))
        os.makedirs(self.state, exist_ok=True)

    def _numbers(self) -> list[int]:
        return sorted(int(n.removeprefix("listing-")) for n in os.listdir(self.state) if n.startswith("listing-"))

    def _load(self, number: int) -> dict:
        with open(f"{self.state}/listing-{number:09d}", encoding="utf-8") as f:
            return json.load(f)

    def _save(self, number: int, files: dict) -> None:
        name = f"{self.state}/writing-{os.getpid()}"
        with open(name, "w", encoding="utf-8") as f:
            json.dump({"at": time.time_ns() // 1_000_000, "files": files}, f)
        os.replace(name, f"{self.state}/listing-{number:09d}")

    def initialOffset(self):
        if not self._numbers():
            self._save(0, _listing(self.root, self.tops))  # what is there at first is no change
        return {"listing": self._numbers()[0]}

    def latestOffset(self):
        if not self._numbers():  # asked for before the first
            return self.initialOffset()
        last = self._numbers()[-1]
        now = _listing(self.root, self.tops)
        if now != self._load(last)["files"]:
            last += 1
            self._save(last, now)
        return {"listing": last}

    def partitions(self, start, end):
        return [Span(start["listing"], end["listing"], i) for i in range(self.PARTS)]

    def read(self, partition):
        old, new = self._load(partition.start), self._load(partition.end)
        mine = lambda p: zlib.crc32(p.encode()) % self.PARTS == partition.part
        when = lambda ms: datetime.fromtimestamp(ms / 1000, timezone.utc)
        for path, (mtime, size) in new["files"].items():
            before = old["files"].get(path)
            if mine(path) and before != [mtime, size]:
                yield path, "create" if before is None else "change", when(new["at"])
        for path in old["files"]:
            if mine(path) and path not in new["files"]:
                yield path, "delete", when(new["at"])

    def commit(self, end):
        for n in self._numbers():
            if n < end["listing"]:
                os.remove(f"{self.state}/listing-{n:09d}")


@dataclass
class Span(InputPartition):
    """A share of the paths, between two listings."""

    start: int
    end: int
    part: int


class TreeChangeSource(DataSource):
    """``spark.readStream.format("quillon_tree_changes")``: (relative_path, op, ts) of changed, created and deleted files."""

    @classmethod
    def name(cls):
        return "quillon_tree_changes"

    def schema(self):
        return CHANGES

    def streamReader(self, schema):
        return TreeChanges(self.options)


def watch_tree(spark: SparkSession, root: str, state: str, tops: Iterable[str] = ()) -> DataFrame:
    """A stream of (relative_path, op, ts) of what changes below a local root from now on. ``state`` is a folder that the driver and all
    executors reach, and belongs to one query, as its checkpoint does."""
    ship(spark)
    spark.dataSource.register(TreeChangeSource)
    return spark.readStream.format("quillon_tree_changes").option("root", root).option("state", state).option("tops", json.dumps(list(tops))).load()


def list_tree(spark: SparkSession, root: str, tops: Iterable[str] = ()) -> DataFrame:
    """(relative_path, mtime_ms, size_bytes) of all files below ``root``, or its folders ``tops``; tasks list the folders."""
    ship(spark)
    spark.dataSource.register(TreeSource)
    return spark.read.format("quillon_tree").option("root", root).option("tops", json.dumps(list(tops))).load()


def named_files(spark: SparkSession, root: str, paths: Iterable[str]) -> DataFrame:
    """The same of those of ``paths`` that are there, each looked up by name on the driver: for marks, which it holds anyway."""
    fs, base = opened(root)
    rows = [s for p in sorted({p for p in paths if p}) if (s := status(fs, base, p)) is not None]
    return spark.createDataFrame(rows, LISTED)


def read_files(paths: DataFrame, root: str) -> DataFrame:
    """(relative_path, mtime_ms, size_bytes, content, error) of the files that ``paths`` (relative_path) names, opened where Spark has put the
    names. Files that aren't there give no row; one that can't be read gives its error. Bytes that are no UTF-8 become U+FFFD."""
    ship(paths.sparkSession)
    shape = pa.schema([("relative_path", pa.string()), ("mtime_ms", pa.int64()), ("size_bytes", pa.int64()), ("content", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(root)
        rows, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    if path is None or (found := status(fs, base, path)) is None:
                        continue
                    with fs.open_input_stream(_joined(base, path)) as f:
                        data = f.read()
                    rows.append((*found[:2], len(data), data.decode("utf-8", "replace"), None))
                    size += len(data)
                except OSError as e:
                    rows.append((path, None, None, None, f"{path}: {e}"))
                if size > BATCH_BYTES or len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)

    return paths.select("relative_path").mapInArrow(run, READ)


def read_places(places: DataFrame, root: str) -> DataFrame:
    """(relative_path, line_number, line) of the lines that ``places`` (relative_path, line_number) names. A file is read up to the last
    line asked of it, a line at a time."""
    ship(places.sparkSession)
    shape = pa.schema([("relative_path", pa.string()), ("line_number", pa.int32()), ("line", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(root)
        for batch in batches:
            for r in batch.to_pylist():
                path, rows, want = r["relative_path"], [], set(r["numbers"])
                try:
                    if status(fs, base, path) is None:
                        continue
                    with io.BufferedReader(fs.open_input_file(_joined(base, path)), 1 << 16) as f:
                        last, feed = max(want, default=0), True
                        for n in range(1, last + 1):
                            if not feed:
                                break
                            line = f.readline()
                            feed = line.endswith(b"\n")
                            if n in want:
                                rows.append((path, n, (line[:-1] if feed else line).decode("utf-8", "replace")))
                except OSError:  # gone meanwhile: its lines are missing, as a page shows them
                    continue
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)

    grouped = places.filter("line_number > 0").groupBy("relative_path").agg(F.collect_set("line_number").alias("numbers"))
    return grouped.mapInArrow(run, "relative_path string, line_number int, line string")


def readable(files: DataFrame, root: str) -> DataFrame:
    """(relative_path, error): what keeps a file from being opened, null where nothing does."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(root)
        for batch in batches:
            errors = []
            for path in batch.column(0).to_pylist():
                try:
                    fs.open_input_file(_joined(base, path)).close()
                    errors.append(None)
                except OSError as e:
                    errors.append(f"{path}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(errors, pa.string())], ["relative_path", "error"])

    return files.select("relative_path").mapInArrow(run, "relative_path string, error string")


# ranges of large files


def _range_lines(f: io.BufferedReader, start: int, end: int, size: int) -> Iterator[tuple[int, bytes, bool]]:
    """(lines before it in the range, line, whether it is past the range) of the lines that start in [start, end), and of the one after them; lines are without
    their line feeds, and after a file's last line feed stands an empty line, as it does for ``split``. The first number is 1 where a
    line goes on from the range before."""
    f.seek(max(0, start - 1))
    skipped = f.readline() if start else b"\n"  # one byte where a line starts at ``start``
    at, n = f.tell(), 1 if len(skipped) > 1 else 0
    feed, past = skipped.endswith(b"\n"), False
    while not past and feed:
        past = at >= end and not at == size == end
        line = f.readline()
        feed = line.endswith(b"\n")
        yield n, (line[:-1] if feed else line), past
        at += len(line)
        n += 1


def line_ranges(files: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """(relative_path, size_bytes, part, start, end): each file of ``files`` (relative_path, size_bytes) cut into ranges of ``size`` bytes."""
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size_bytes") / size) - 1, F.lit(0)).cast("int"))
    rows = files.select("relative_path", F.col("size_bytes").cast("long").alias("size_bytes"), F.explode(parts).alias("part"))
    return rows.withColumns({"start": F.col("part") * F.lit(size).cast("long"), "end": F.least((F.col("part") + 1) * F.lit(size).cast("long"), F.col("size_bytes"))})


def read_lines(files: DataFrame, root: str, size: int = RANGE_BYTES) -> DataFrame:
    """(relative_path, line_number, line, after) of the lines of ``files`` (relative_path, size_bytes), read in ranges.

    ``after`` is the next line, also across ranges, so that what looks one line on needs no window over a file; null at a file's end. Each
    range is opened twice: to count its line feeds, and, with the counts of those before it, to read its lines.
    """
    spark = files.sparkSession
    ship(spark)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(root)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                feeds, left = 0, r["end"] - r["start"]
                with fs.open_input_file(_joined(base, r["relative_path"])) as f:
                    f.seek(r["start"])
                    while left > 0 and (data := f.read(min(left, 1 << 20))):
                        feeds += data.count(b"\n")
                        left -= len(data)
                out.append(feeds)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "feeds"])

    shape = pa.schema([("relative_path", pa.string()), ("line_number", pa.int32()), ("line", pa.string()), ("after", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(root)
        for batch in batches:
            for r in batch.to_pylist():
                rows, held, last = [], 0, None
                with io.BufferedReader(fs.open_input_file(_joined(base, r["relative_path"])), 1 << 20) as f:
                    for i, line, past in _range_lines(f, r["start"], r["end"], r["size_bytes"]):
                        text = line.decode("utf-8", "replace")
                        if last is not None:
                            rows.append((*last, text))
                        last = None if past else (r["relative_path"], r["feeds_before"] + 1 + i, text)
                        held += len(line) + 64
                        if held > BATCH_BYTES and rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)
                            rows, held = [], 0
                if last is not None:
                    rows.append((*last, None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape)

    counted = line_ranges(files, size).repartition(n, "relative_path", "part").mapInArrow(count, "relative_path string, size_bytes long, part int, start long, end long, feeds long")
    before = F.coalesce(F.sum("feeds").over(Window.partitionBy("relative_path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    placed = counted.withColumn("feeds_before", before).repartition(n, "relative_path", "part")
    return placed.mapInArrow(read, "relative_path string, line_number int, line string, after string")
