"""Batch diagnostics of a stream of scores: the windowed form of the batch summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_summary(scores: DataFrame, ts: str = "ts", by: str = "event_type", value: str = "value", every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows, mean, deviation and largest value per window; works on streams and tables alike."""
    rows = scores.withWatermark(ts, late) if scores.isStreaming else scores
    return rows.groupBy(F.window(ts, every), by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.max(value).alias("max")).select(F.col("window.start").alias("start"), by, "n", "mean", "std", "max")
