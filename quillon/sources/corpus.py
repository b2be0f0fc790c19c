"""Where files and lines come from: a directory tree, the driver's tables, and a synthetic code corpus."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quillon.functions import text as T
from quillon.operators.search import path_filter
from quillon.sources import tree

# The settings' defaults.
EXTENSIONS = (".c", ".h", ".cpp", ".hpp", ".cc", ".cxx", ".hxx", ".inl")
EXCLUDES = ("**/build/**", "**/.git/**", "**/node_modules/**")


def wanted(files: DataFrame, extensions=EXTENSIONS, excludes=EXCLUDES) -> DataFrame:
    """The rows of ``files`` whose path a scan takes in."""
    if extensions:
        files = files.filter(F.lower(F.regexp_extract("relative_path", r"(\.[^./]+)$", 1)).isin(*extensions))
    return path_filter(files, (), excludes)


def is_local(root: str) -> bool:
    return "://" not in root or root.startswith("file:")


def scan_tree(spark: SparkSession, root: str, extensions=EXTENSIONS, excludes=EXCLUDES, include_paths=(), with_content: bool = False, paths=None) -> DataFrame:
    """Files below ``root``: relative_path, abs_path, mtime_ms, size_bytes and, if asked, content. ``paths``, a small set, are looked up by name.

    A local tree is listed in tasks (see ``tree``); others are listed by Spark's file source. No content is read but of the files that
    are asked for. Overlapping ``include_paths`` give each file once.
    """
    root = root.rstrip("/")
    tops = [p.strip("/") for p in include_paths if p.strip("/")]
    if is_local(root):
        files = tree.list_tree(spark, root, tops) if paths is None else tree.named_files(spark, root, paths)
    else:
        files = _listed_by_spark(spark, root, [f"{root}/{p}" for p in tops] or [root])
        files = files if paths is None else files.filter(F.col("relative_path").isin(*paths))
    if paths is not None and tops:
        files = files.filter(reduce(lambda a, b: a | b, [F.startswith("relative_path", F.lit(f"{t}/")) for t in tops]))
    files = wanted(files, extensions, excludes)
    if with_content:
        files = contents(files, root).filter("error is null").drop("error")
    at = F.concat(F.lit(root.removeprefix("file://") + "/"), "relative_path")
    return files.select("relative_path", at.alias("abs_path"), "mtime_ms", "size_bytes", *(["content"] if with_content else []))


def _listed_by_spark(spark: SparkSession, root: str, tops: list[str]) -> DataFrame:
    read = lambda top: spark.read.format("binaryFile").option("recursiveFileLookup", True).load(top)
    files = reduce(DataFrame.unionByName, map(read, tops))
    files = files.select(_below("path", root).alias("relative_path"), F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size_bytes"))
    return files.dropDuplicates(["relative_path"]) if len(tops) > 1 else files


def _below(path: str, root: str) -> Column:
    return F.substring(F.col(path), len(root) + 2, 1 << 20)


def contents(files: DataFrame, root: str) -> DataFrame:
    """(relative_path, mtime_ms, size_bytes, content, error) of ``files`` (relative_path), of which alone contents are read. On other than
    local roots, Spark loads the files by name, in groups, so their names pass through the driver."""
    if is_local(root):
        n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return tree.read_files(files.select("relative_path").repartition(n, "relative_path"), root)
    spark, out = files.sparkSession, []
    names = [r[0] for r in files.select("relative_path").toLocalIterator()]
    for i in range(0, len(names), 5_000):
        loaded = spark.read.format("binaryFile").load([f"{root}/{n}" for n in names[i : i + 5_000]])
        out.append(loaded.select(_below("path", root).alias("relative_path"), F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size_bytes"), F.decode("content", "UTF-8").alias("content"), F.lit(None).cast("string").alias("error")))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], tree.READ)


def split_lines(files: DataFrame, content: str = "content", binary: bool = False) -> DataFrame:
    """(relative_path, line_number, line): lines from 1, cut at line feeds alone; files with a NUL only where ``binary``."""
    files = files if binary else files.filter(~F.coalesce(F.col(content).contains("\0"), F.lit(False)))
    rows = files.select("relative_path", F.posexplode(F.split(F.col(content), "\n")).alias("i", "line"))
    return rows.select("relative_path", (F.col("i") + 1).alias("line_number"), "line")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of lines, one file a document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat(F.lit("docs/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return split_lines(docs.filter("text is not null").select(path.alias("relative_path"), "text"), "text")


def canonical_root(root: str) -> str:
    """A local root without links and relative parts; other file systems' roots, and what can't be resolved, as they are."""
    if "://" in root and not root.startswith("file://"):
        return root.rstrip("/")
    return os.path.realpath(os.path.abspath(root.removeprefix("file://")))


def ignore_rules(spark: SparkSession, root: str, names: tuple[str, ...] = (".gitignore", ".ignore")) -> list[T.IgnoreRule]:
    """The rules of all ignore files of a tree, those of deeper folders later; of one folder's, in the order of ``names``. The files are
    listed with the tree and are read alone; their rules are few."""
    named = "(^|/)(" + "|".join(n.replace(".", "\\.") for n in names) + ")$"
    found = contents(scan_tree(spark, root, (), ()).filter(F.col("relative_path").rlike(named)), root).filter("error is null").collect()
    place = lambda path: (path.count("/"), path.rpartition("/")[0], names.index(path.rpartition("/")[2]))
    files = sorted(((r["relative_path"], r["content"]) for r in found), key=lambda r: place(r[0]))
    return [rule for path, text in files for rule in T.ignore_rules(text, path.rpartition("/")[0])]


def synthetic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code corpus from parts (macros), suppliers (structs) and customers (functions): (relative_path, line_number, line)."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    text = lambda c: F.col(c).cast("string")
    nation = lambda c: F.concat(F.lit("src/nation_"), text(c), F.lit(".cpp"))
    parts = read("part").select(
        F.concat(F.lit("include/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit(".h")).alias("relative_path"), F.lit(1).alias("tag"), F.col("p_partkey").alias("k"),
        F.concat(F.lit("#define PART_"), text("p_partkey"), F.lit("_"), F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit(" "), text("p_size")).alias("line"))
    suppliers = read("supplier").select(nation("s_nationkey").alias("relative_path"), F.lit(1).alias("tag"), F.col("s_suppkey").alias("k"), F.concat(F.lit("struct supplier_"), text("s_suppkey"), F.lit(" {")).alias("line"))
    customers = read("customer").select(
        nation("c_nationkey").alias("relative_path"), F.lit(2).alias("tag"), F.col("c_custkey").alias("k"),
        F.concat(F.lit("static inline const char *customer_"), text("c_custkey"), F.lit("_"), F.lower("c_mktsegment"), F.lit("(int a, struct t *b) {")).alias("line"))
    rows = parts.unionByName(suppliers).unionByName(customers)
    number = F.row_number().over(Window.partitionBy("relative_path").orderBy("tag", "k"))
    return rows.select("relative_path", number.alias("line_number"), "line")


def line_at(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (relative_path, line_number) with ``line``, empty where there is none."""
    return wanted.join(lines.select("relative_path", "line_number", "line"), ["relative_path", "line_number"], "left").withColumn("line", F.coalesce("line", F.lit("")))


def preview(lines: DataFrame, path: str, center: int, around: int = 50) -> DataFrame:
    """(num, content) of the lines around ``center``."""
    near = lines.filter((F.col("relative_path") == path) & F.col("line_number").between(center - around, center + around))
    return near.select(F.col("line_number").alias("num"), F.col("line").alias("content"))
