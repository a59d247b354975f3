"""Windowed counts of events, the same for batches and streams. On a stream the
watermark bounds state; on a batch it is ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``(start, by, n, total)`` per window and key; events without a time are left out."""
    rows = events.where(F.col(at).isNotNull()).withWatermark(at, late)
    return rows.groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, at: str, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """``(by, start, end, n)``: runs of a key's events with no pause of ``gap`` or more."""
    rows = events.where(F.col(at).isNotNull()).withWatermark(at, late)
    return rows.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
