"""The counting aggregates over a stream: bin counts and gain sums are associative, so they run incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.counting import count_bins


def stream_counts(fragments: DataFrame, width: int, mode: str = "fractional") -> DataFrame:
    """Running bin counts of a fragment stream (update or complete mode); the state is one row per bin."""
    return count_bins(fragments, width, mode)


def stream_gains(rows: DataFrame) -> DataFrame:
    """Mergeable gain sums per sample: n, mean and population deviation."""
    return rows.groupBy("sample").agg(F.count("gain").alias("n"), F.avg("gain").alias("mean"), F.stddev_pop("gain").alias("sd"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Event-time windows with a watermark: sample, window, n, value."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "sample").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
