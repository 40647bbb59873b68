"""Dependence span: how far along a contig a signal stays correlated, from censored radii of many windows.

A window's autocorrelations (masked, one per sample) are pooled by their median; its radius is the first lag from which the smoothed
absolute correlation stays below a threshold, or it is censored where that never happens. Windows are sampled with odds by
the rank of their signal; product-limit (Kaplan-Meier) quantiles of the radii are the span, and a stationary bootstrap that draws
contigs and walks their windows gives the band. Draws depend on hashes of the seed and places only."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.models import uniform
from gridloom.operators.statistics import mid_ranks
from gridloom.staging import staged


def radius_correction(threshold: float) -> float:
    """A Gaussian correlation that crosses ``threshold`` at lag h has its inflection at h / sqrt(-2 ln threshold)."""
    return 1.0 / math.sqrt(-2.0 * math.log(threshold))


def pooled_correlation(x: np.ndarray, lags: int, least_pairs: int, least_share: float, clip: float = 0.005) -> np.ndarray:
    """Correlations at lags 1.. of the rows of ``x`` (NaN: missing), their median per lag, as far as half of the rows have enough
    pairs. Empty if no row has a variance."""
    rows, n = [], x.shape[1]
    for values in x:
        seen = np.isfinite(values)
        if seen.sum() < 2:
            continue
        ends = np.quantile(values[seen], [clip, 1 - clip])
        v = np.where(seen, np.clip(values, *ends), 0.0)
        v = np.where(seen, v - v[seen].mean(), 0.0)
        size = 1 << int(2 * n - 1).bit_length()
        spectrum = lambda a: np.fft.irfft(np.abs(np.fft.rfft(a, size)) ** 2, size)[: lags + 1]  # noqa: B023, E731
        sums, pairs = spectrum(v), np.rint(spectrum(seen.astype(float)))
        enough = (pairs >= least_pairs) & (pairs / (n - np.arange(lags + 1)) >= least_share)
        if not enough[0] or sums[0] / pairs[0] <= 1e-300:
            continue
        cov = np.where(enough, sums / np.maximum(pairs, 1), np.nan)
        rows.append(cov[1:] / cov[0])
    if not rows:
        return np.zeros(0)
    held = np.isfinite(rows).sum(0)
    short = np.flatnonzero(held < max(1, math.ceil(len(rows) / 2)))
    cap = int(short[0]) if len(short) else lags
    return np.nanmedian(np.array(rows)[:, :cap], axis=0) if cap else np.zeros(0)


def crossing(correlation: np.ndarray, threshold: float, smooth: int, persistence: int) -> tuple[int, bool] | None:
    """Lag from which the mean of |correlation| over ``smooth`` (odd) lags stays below ``threshold`` for ``persistence`` lags, or the
    last lag that could have been one and True. None where there are too few lags."""
    half, cap = smooth // 2, len(correlation)
    last = cap - half - persistence + 1
    if last < 1 + half:
        return None
    prefix = np.concatenate([[0.0], np.cumsum(np.abs(correlation))])
    lags = np.arange(1 + half, cap - half + 1)
    below = (prefix[lags + half] - prefix[lags - half - 1]) / smooth < threshold
    for start in range(1 + half, last + 1):
        if below[start - 1 - half : start - 1 - half + persistence].all():
            return start, False
    return last, True


def window_radii(tracks: DataFrame, window: int, lags: int, threshold: float = 0.1, smooth: int = 1, persistence: int = 1, least_pairs: int = 200, least_share: float = 0.5) -> DataFrame:
    """contig, window, score, radius (in bins), censored, for every whole window with a result. ``tracks``: contig, sample, bin, x.
    The score is the median over well covered samples of the positive signal, scaled to a full window."""
    scale = radius_correction(threshold)

    def run(batches):
        for batch in batches:
            out = []
            for contig, number, cells in zip(*(batch[c].to_pylist() for c in ("contig", "window", "cells")), strict=True):
                names = sorted({c["sample"] for c in cells})
                x = np.full((len(names), window), np.nan)
                for c in cells:
                    if c["x"] is not None:
                        x[names.index(c["sample"]), c["bin"] - number * window] = c["x"]
                x = np.unique(x, axis=0)  # equal tracks count once
                seen = np.isfinite(x).sum(1)
                ranked = [window / k * np.maximum(row[np.isfinite(row)], 0.0).sum() for row, k in zip(x, seen, strict=True) if k and k / window >= math.sqrt(least_share)]
                found = crossing(pooled_correlation(x, lags, least_pairs, least_share), threshold, smooth, persistence) if ranked else None
                if found:
                    out.append((contig, number, float(np.median(ranked)), found[0] * scale, found[1]))
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["contig", "window", "score", "radius", "censored"])

    ends = tracks.groupBy("contig").agg((F.max("bin") + 1).alias("_n"))
    d = tracks.withColumn("window", F.floor(F.col("bin") / window)).join(ends, "contig").filter((F.col("window") + 1) * window <= F.col("_n"))
    packed = d.groupBy("contig", "window").agg(F.collect_list(F.struct("sample", "bin", F.col("x").cast("double").alias("x"))).alias("cells"))
    return packed.mapInArrow(run, "contig string, window long, score double, radius double, censored boolean")


def sampled_windows(windows: DataFrame, count: int, seed: int) -> DataFrame:
    """``count`` windows: the smallest exponential keys over weights n - rank + 1, ranks by falling score, ties at their mean."""
    ranked = mid_ranks(windows, "score", "_rank", descending=True)
    n = windows.agg(F.count(F.lit(1)).alias("_n"))
    key = -F.log(uniform(seed, "contig", "window")) / (F.col("_n") - F.col("_rank") + 1)
    return ranked.join(F.broadcast(n), F.lit(True)).withColumn("_key", key).orderBy("_key", "contig", "window").limit(count).drop("_key", "_rank", "_n")


def survival(radii: DataFrame, keys: list[str]) -> DataFrame:
    """keys, radius, survival: the product-limit estimate after each distinct radius. ``radii``: a bounded number of rows per key."""
    steps = radii.groupBy(*keys, "radius").agg(F.count_if(~F.col("censored")).alias("_d"), F.count(F.lit(1)).alias("_k"))
    rest = Window.partitionBy(*keys).orderBy("radius").rowsBetween(0, Window.unboundedFollowing)
    upto = Window.partitionBy(*keys).orderBy("radius").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_risk = steps.withColumn("_r", F.sum("_k").over(rest))
    ended = F.max(F.col("_d") == F.col("_r")).over(upto)  # nothing survives
    factor = F.when(F.col("_d") < F.col("_r"), F.log(1 - F.col("_d") / F.col("_r"))).otherwise(0.0)
    return at_risk.select(*keys, "radius", "_d", F.when(ended, 0.0).otherwise(F.exp(F.sum(factor).over(upto))).alias("survival"))


def survival_quantile(curve: DataFrame, keys: list[str], q: float, name: str) -> DataFrame:
    """Least radius with an event by which a share ``q`` has ended; null where the curve does not come down so far."""
    reached = F.min(F.when((F.col("_d") > 0) & (1 - F.col("survival") + 1e-12 >= q), F.col("radius"))).alias(name)
    return curve.groupBy(*keys).agg(reached) if keys else curve.agg(reached)


def bootstrap_radii(windows: DataFrame, draws: int, block: float, seed: int) -> DataFrame:
    """draw, radius, censored. A draw takes as many contigs as there are, with replacement, and as many windows of each as it has:
    it walks on to the next window, or restarts at one drawn at random with probability 1 / ``block``, and past a gap or the end."""
    order = Window.partitionBy("contig").orderBy("window")
    listed = windows.withColumn("_i", F.row_number().over(order) - 1).withColumn("_run", F.col("window") - F.col("_i"))
    sizes = listed.groupBy("contig").agg(F.count(F.lit(1)).alias("_n"))
    names = sizes.withColumn("_c", F.row_number().over(Window.orderBy("contig")) - 1)
    total = sizes.agg(F.count(F.lit(1)).alias("_m"))
    whole = lambda u, n: F.least(F.floor(u * n), n - 1)
    slots = total.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)))
    drawn = slots.withColumn("_c", whole(uniform(seed, "draw", "slot"), F.col("_m"))).join(F.broadcast(names), "_c")
    steps = drawn.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    start = (F.col("step") == 0) | (uniform(seed + 1, "draw", "slot", "step") < 1.0 / block)
    to = whole(uniform(seed + 2, "draw", "slot", "step"), F.col("_n"))
    walk = Window.partitionBy("draw", "slot").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(start, F.struct(F.col("step").alias("s"), to.alias("at"))), ignorenulls=True).over(walk)
    at = steps.withColumn("_from", last).withColumn("_at", F.col("_from.at") + F.col("step") - F.col("_from.s"))
    # a walk that leaves its run of adjacent windows goes on from the window drawn for that very step
    runs = listed.groupBy("contig", "_run").agg(F.max("_i").alias("_last"))
    home = listed.select("contig", F.col("_i").alias("_home"), "_run").join(runs, ["contig", "_run"]).select("contig", "_home", "_last")
    placed = at.withColumn("_home", F.col("_from.at")).join(home, ["contig", "_home"])
    placed = placed.withColumn("_i", F.when(F.col("_at") <= F.col("_last"), F.col("_at")).otherwise(to))
    return placed.join(listed.select("contig", "_i", "radius", "censored"), ["contig", "_i"]).select("draw", "radius", "censored")


def dependence_span(windows: DataFrame, count: int = 256, q: float = 0.75, draws: int = 200, block: float = 4.0, seed: int = 1729) -> DataFrame:
    """One row: windows, censored, median, span (the ``q`` quantile), and the 90 % band of the median from the bootstrap.
    ``windows``: contig, window, score, radius, censored."""
    chosen = staged(sampled_windows(windows, count, seed), "windows")
    curve = staged(survival(chosen, []), "curve")
    redrawn = survival_quantile(survival(bootstrap_radii(chosen, draws, block, seed), ["draw"]), ["draw"], 0.5, "m")
    band = redrawn.agg(F.percentile("m", F.lit(0.05)).alias("low"), F.percentile("m", F.lit(0.95)).alias("high"), F.count("m").alias("resolved"))
    size = chosen.agg(F.count(F.lit(1)).alias("windows"), F.count_if("censored").alias("censored"))
    one = [size, survival_quantile(curve, [], 0.5, "median"), survival_quantile(curve, [], q, "span"), band]
    out = one[0]
    for table in one[1:]:  # one row each
        out = out.join(F.broadcast(table), F.lit(True))
    least, most = F.least("low", "median"), F.greatest("high", "median")
    return out.select("windows", "censored", "median", "span", least.alias("low"), most.alias("high"), "resolved")

