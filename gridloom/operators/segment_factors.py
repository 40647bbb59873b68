"""Segment factors: how much larger errors are than their standard errors, per contig and segment, shrunk genome to contig to segment.

The raw log factor of a scope is ln((Q / z)^2) of the weighted quantile Q of |residual| / sqrt(variance). Its variance comes from a
Poisson bootstrap over groups of rows: a group counts a hashed Poisson(1) number of times in each replicate. All replicates
are found together: weights per (scope, group, cell) of the ratio give each replicate's cell, and only the rows of such cells are
ordered. Raw factors are then drawn to the contig's, and those to the genome's, by moment estimates of their spread."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.models import uniform
from gridloom.operators.statistics import CELLS, placed
from gridloom.staging import staged


def poisson(seed: int, *columns: str, most: int = 12) -> Column:
    """A Poisson(1) number from the hash of the columns: how many of the distribution's steps the uniform number exceeds."""
    total, term, steps = 0.0, math.exp(-1), []
    for k in range(most):
        total += term
        term /= k + 1
        steps.append(total)
    u = uniform(seed, *columns)
    return F.size(F.filter(F.array(*(F.lit(s) for s in steps)), lambda s: s <= u))


def bootstrap_quantiles(rows: DataFrame, keys: list[str], value: str, weight: str, group: str, q: float, replicates: int, seed: int, cells: int = CELLS) -> DataFrame:
    """keys, replicate (0: every group once), quantile: the smallest value whose running weight reaches q of the replicate's total."""
    d = rows.groupBy(*keys, group, value).agg(F.sum(weight).alias("_w"))
    cut = staged(placed(staged(d.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_k")), "values"), keys, value, cells).select(*keys, value, "_cell"), "cells")
    d = staged(d.join(cut, [*keys, value]), "rows")
    filled = d.groupBy(*keys, group, "_cell").agg(F.sum("_w").alias("_w"))
    times = F.when(F.col("replicate") == 0, 1).otherwise(poisson(seed, "replicate", group))
    drawn = filled.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates)))).withColumn("_w", F.col("_w") * times)
    by = [*keys, "replicate"]
    sums = drawn.groupBy(*by, "_cell").agg(F.sum("_w").alias("_w"))
    upto = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most ``cells`` rows
    whole = Window.partitionBy(*by)
    run = sums.withColumn("_run", F.sum("_w").over(upto)).withColumn("_need", q * F.sum("_w").over(whole))
    hit = run.filter((F.col("_need") > 0) & (F.col("_run") >= F.col("_need") - 1e-9)).groupBy(*by).agg(F.min_by(F.struct("_cell", (F.col("_run") - F.col("_w")).alias("_under"), "_need"), "_cell").alias("_h"))
    hit = staged(hit.select(*by, "_h._cell", "_h._under", "_h._need"), "hits")
    near = d.join(hit, [*keys, "_cell"]).withColumn("_w", F.col("_w") * times).groupBy(*by, value).agg(F.sum("_w").alias("_w"), F.first("_under").alias("_under"), F.first("_need").alias("_need"))
    order = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one cell
    reached = near.withColumn("_run", F.col("_under") + F.sum("_w").over(order)).filter(F.col("_run") >= F.col("_need") - 1e-9)
    return reached.groupBy(*by).agg(F.min(value).alias("quantile"))


def log_factors(rows: DataFrame, keys: list[str], q: float, z: float, replicates: int, seed: int, low: float, high: float) -> DataFrame:
    """keys, raw (log factor) and variance (of the replicates'; null where there are too few, or none). ``rows``: ratio, weight, group."""
    found = bootstrap_quantiles(rows, keys, "ratio", "weight", "group", q, replicates, seed)
    log = F.log(F.least(F.greatest(F.pow(F.col("quantile") / z, 2), F.lit(low)), F.lit(high)))
    var = F.var_samp(F.when(F.col("replicate") > 0, F.col("log")))
    per = found.withColumn("log", log).groupBy(*keys).agg(F.max(F.when(F.col("replicate") == 0, F.col("log"))).alias("raw"), var.alias("_v"))
    return per.select(*keys, "raw", F.when(F.col("_v") > 0, F.col("_v")).alias("variance"))


def shrunk(factors: DataFrame, parent: Column) -> DataFrame:
    """``factors`` (raw, variance) with theta and alpha: drawn to ``parent`` by the spread beyond their variances."""
    d = factors.withColumn("_p", parent)
    w = 1 / F.greatest(F.col("variance"), F.lit(1e-12))
    tau = d.filter(F.col("raw").isNotNull() & F.col("variance").isNotNull()).agg(F.greatest(F.lit(0.0), F.sum(w * (F.pow(F.col("raw") - F.col("_p"), 2) - F.col("variance"))) / F.sum(w)).alias("_tau"))
    d = d.join(F.broadcast(tau), F.lit(True))  # one row
    alpha = F.coalesce(F.when(F.col("_tau") + F.col("variance") > 0, F.col("_tau") / (F.col("_tau") + F.col("variance"))), F.lit(0.0))
    d = d.withColumn("alpha", F.when(F.col("raw").isNull(), 0.0).otherwise(alpha))
    return d.withColumn("theta", F.col("alpha") * F.coalesce("raw", F.lit(0.0)) + (1 - F.col("alpha")) * F.col("_p")).drop("_p", "_tau")


def segment_factors(rows: DataFrame, q: float, z: float, replicates: int = 64, seed: int = 7, low: float = 0.05, high: float = 20.0) -> DataFrame:
    """contig, segment, raw, variance, alpha, theta, factor (at least 1). ``rows``: contig, segment, ratio, weight, group."""
    d = rows.filter((F.col("weight") > 0) & F.col("ratio").isNotNull())
    contigs = staged(log_factors(d, ["contig"], q, z, replicates, seed, low, high), "contigs")
    held = F.col("variance").isNotNull()
    w = F.when(held, 1 / F.greatest(F.col("variance"), F.lit(1e-12)))
    genome = contigs.agg(F.coalesce(F.sum(w * F.col("raw")) / F.sum(w), F.avg("raw")).alias("_genome"))
    contigs = shrunk(contigs.join(F.broadcast(genome), F.lit(True)), F.col("_genome")).select("contig", F.col("theta").alias("_contig"))
    segments = log_factors(d, ["contig", "segment"], q, z, replicates, seed, low, high).join(contigs, "contig")
    out = shrunk(staged(segments, "segments"), F.col("_contig"))
    return out.select("contig", "segment", "raw", "variance", "alpha", "theta", F.greatest(F.exp("theta"), F.lit(1.0)).alias("factor"))
