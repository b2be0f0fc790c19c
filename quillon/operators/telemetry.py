"""What a run leaves behind about itself: diagnostic lines, samples of memory, and their summary."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, functions as F

from quillon.functions import text as T

SWITCH = "QUILLON_DIAGNOSTICS"
SAMPLES = ["timestamp", "rss_kb", "heap_kb", "db_size_bytes"]


def write_diagnostics(events: DataFrame, path: str) -> bool:
    """Events (t, event, pid, and what else they hold) as JSON lines, added to ``path``, where the switch is 1. A failure to write is
    none of the caller's: it returns False."""
    if os.environ.get(SWITCH) != "1":
        return False
    rest = {c: F.col(c) for c in events.columns if c not in ("t", "event", "pid")}
    try:
        events.select(T.diagnostic_line(F.col("event"), F.col("pid"), F.col("t"), **rest).alias("value")).write.mode("append").text(path)
        return True
    except Exception:  # noqa: BLE001 - diagnostics never fail the work
        return False


def write_samples(samples: DataFrame, path: str) -> None:
    """Samples as CSV with a header, added to ``path``."""
    samples.select(*SAMPLES).write.mode("append").option("header", True).csv(path)


def sample_summary(samples: DataFrame, time: str = "t", used: str = "used", by: tuple[str, ...] = ()) -> DataFrame:
    """(peak, samples, duration): the largest use, the number of samples, and from the first to the last of them; 0 without samples."""
    out = samples.groupBy(*by).agg(F.max(used).alias("peak"), F.count("*").alias("samples"), (F.max(time) - F.min(time)).alias("duration"))
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("peak", "duration")})
