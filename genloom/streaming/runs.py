"""Runs and summaries of ordered rows on unbounded input: the batch operators' semantics with event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_runs(events: DataFrame, keys: list[str], at: str, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Runs of each key: events with gaps below `gap`, closed once the watermark has passed. One row for each run."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp"))
    timed = timed.withWatermark("_at", late) if events.isStreaming else timed
    grouped = timed.groupBy(*keys, F.session_window("_at", gap).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.max("_at").alias("run_end")).select(*keys, F.col("w.start").alias("run_start"), "run_end", "n")


def windowed_summary(events: DataFrame, at: str, value: str, kind: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and mean values for each kind of event and window of time."""
    timed = events.withColumn("_at", F.col(at).cast("timestamp"))
    timed = timed.withWatermark("_at", late) if events.isStreaming else timed
    return timed.groupBy(F.window("_at", width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), kind, "n", "mean")
