"""Intervals to bins: one expression per count mode, summed with map-side aggregation on (contig, bin, sample)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def touched_bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor((end - 1) / width))


def overlap(start: Column, end: Column, bin_: Column, width: int) -> Column:
    return F.least(end, (bin_ + 1) * width) - F.greatest(start, bin_ * width)


def count_bins(rows: DataFrame, width: int, mode: str = "fractional", keys: tuple[str, ...] = ("contig", "sample")) -> DataFrame:
    """keys, bin, value, noise_mass. ``rows``: keys, start, end, count.

    coverage: count to every bin touched. fractional: count split by overlap. endpoints: both ends, a bin that holds both
    ends of one record gets twice the count. center: the bin of the midpoint.
    """
    s, e, c = F.col("start"), F.col("end"), F.col("count").cast("double")
    if mode in ("coverage", "fractional"):
        d = rows.withColumn("bin", F.explode(touched_bins(s, e, width)))
        share = overlap(s, e, F.col("bin"), width) / (e - s) if mode == "fractional" else F.lit(1.0)
        d = d.withColumn("_v", c * share).withColumn("_m", c * share * share)
    elif mode == "endpoints":
        lo, hi = F.floor(s / width), F.floor((e - 1) / width)
        ends = F.when(lo == hi, F.array(F.struct(lo.alias("bin"), F.lit(2.0).alias("k")))).otherwise(F.array(F.struct(lo.alias("bin"), F.lit(1.0).alias("k")), F.struct(hi.alias("bin"), F.lit(1.0).alias("k"))))
        d = rows.withColumn("_e", F.explode(ends)).withColumn("bin", F.col("_e.bin")).withColumn("_v", c * F.col("_e.k")).withColumn("_m", c * F.col("_e.k") * F.col("_e.k"))
    elif mode == "center":
        d = rows.withColumn("bin", F.floor(F.floor((s + e) / 2) / width)).withColumn("_v", c).withColumn("_m", c)
    else:
        raise ValueError(mode)
    return d.groupBy(*keys, "bin").agg(F.sum("_v").alias("value"), F.sum("_m").alias("noise_mass"))


def mean_signal_bins(rows: DataFrame, width: int, keys: tuple[str, ...] = ("contig", "sample")) -> DataFrame:
    """Overlap-weighted mean of a piecewise-constant signal per bin."""
    d = rows.withColumn("bin", F.explode(touched_bins(F.col("start"), F.col("end"), width)))
    w = overlap(F.col("start"), F.col("end"), F.col("bin"), width)
    return d.groupBy(*keys, "bin").agg((F.sum(F.col("value") * w) / F.sum(w)).alias("value"))


def dense_grid(counts: DataFrame, contigs: DataFrame, samples: DataFrame, width: int) -> DataFrame:
    """Explicit zeros: every bin of every contig for every sample. ``samples`` is a handful of rows."""
    bins = contigs.select("contig", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / width))).alias("bin"))
    listed = samples.select("sample").distinct().agg(F.collect_list("sample").alias("_samples"))  # the sample sheet, one row
    grid = bins.join(F.broadcast(listed), F.lit(True)).select("contig", "bin", F.explode("_samples").alias("sample"))
    return grid.join(counts, ["contig", "bin", "sample"], "left").fillna(0.0, ["value", "noise_mass"])


def trimmed_mean(values: Column, trim: float) -> Column:
    """Mean of an array without floor(trim * k) values at each end."""
    ordered = F.array_sort(values)
    k = F.size(values)
    cut = F.floor(k * trim).cast("int")
    part = F.slice(ordered, cut + 1, F.greatest(k - 2 * cut, F.lit(1)))
    return F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / F.size(part)
