"""Presence counts from a stream of points: late rows within the watermark still count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def presence_by_window(points: DataFrame, cell: str, time: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, cell, points; the same plan for batch and stream."""
    # watermarks need a time with a zone
    timed = points.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if points.isStreaming else points
    counts = timed.groupBy(F.window(time, window), F.col(cell)).agg(F.count("*").alias("points"))
    return counts.select(F.col("window.start").alias("window_start"), cell, "points")
