"""Shared-folder tables and text access for the corpus operators.

Intermediate tables are Parquet files below ``spark.checkpoint.dir`` (a folder of our own only where
that is unset), so a lost executor never takes the only copy of one with it.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quillon.session import scratch_dir


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    return scratch_dir(spark)


def store(df: DataFrame, label: str, alone: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later plans start from the files.

    Shuffle files of plans that are no longer referred to are let go first, so disk holds few steps at a time; with ``alone``, those of
    this plan go as soon as it is written.
    """
    spark = df.sparkSession
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    path = f"{shared_dir(spark)}/quillon-{label}-{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    try:
        spark.conf.set(cleanup, str(alone or before == "true").lower())
        df.write.parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillon_path = path  # for forget()
    return out


def forget(stored: DataFrame) -> None:
    """Remove the files of a table that ``store`` wrote and nothing will read again."""
    spark = stored.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(stored._quillon_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's size (for file scans: the size of the files)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


_shipped: set[str] = set()


def _bytes(setting: str) -> int:
    number = setting.strip().lower().removesuffix("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(number[-1:], 0)
    return int(number[:-1] if unit else number) << unit


BATCH_BYTES = 6 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once an application; they need not have it installed. Batches of texts go to Python
    in at most ``BATCH_BYTES``, however long the texts are."""
    context = spark.sparkContext
    if not 0 < _bytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m")) <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="quillon-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
