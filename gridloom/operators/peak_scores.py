"""Peak scores with null replays: candidate segments of the observed and of every bootstrap track, in one job, and what share of the null
is as good. The draws are keys like the contigs, so a replay costs a track."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.scan import halo_window, previous, running
from gridloom.operators.statistics import empirical_p, replay_q
from gridloom.staging import staged

METRICS = ("adjusted", "integrated", "top")


def candidate_segments(track: DataFrame, keys: list[str], value: str, scales: tuple[int, ...], thresholds: tuple[float, ...], least: int = 1) -> DataFrame:
    """keys, first, last and the statistics of the best view of each span: runs of the track, smoothed by boxes of the (odd) ``scales``,
    above each threshold. integrated: summed excess; top: largest; adjusted: integrated over the root of the width."""
    views = None
    for scale in scales:
        half = scale // 2
        s = halo_window(track, keys, "bin", half, half, {"_y": lambda w: F.avg(value).over(w)}).select(*keys, "bin", "_y", F.lit(scale).alias("_scale"))
        views = s if views is None else views.unionByName(s)
    by = [*keys, "_scale", "_z"]
    above = views.withColumn("_z", F.explode(F.array(*(F.lit(float(z)) for z in thresholds)))).filter("_y > _z").withColumn("_x", F.col("_y") - F.col("_z"))
    d = previous(staged(above, "views"), by, "bin", ["bin"])
    d = running(d.withColumn("_new", (F.col("prev_bin").isNull() | (F.col("bin") - F.col("prev_bin") > 1)).cast("int")), by, ["bin"], F.col("_new"), "_run")
    runs = d.groupBy(*by, "_run").agg(F.min("bin").alias("first"), F.max("bin").alias("last"), F.sum("_x").alias("integrated"), F.max("_x").alias("top"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    runs = runs.withColumn("adjusted", F.col("integrated") / F.sqrt("_n"))
    best = runs.groupBy(*keys, "first", "last").agg(F.max(F.struct("adjusted", "integrated", "top")).alias("_b"))
    return best.select(*keys, "first", "last", *(F.col(f"_b.{m}").alias(m) for m in METRICS))


def score_peaks(peaks: DataFrame, track: DataFrame, null: DataFrame, value: str, scales: tuple[int, ...], thresholds: tuple[float, ...], draws: int, least: int = 1, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """``peaks`` (contig, first, last) with their statistics and, for each of ``metrics``, p (pooled null segments as large) and q (replay false discovery
    rate among all observed segments, at least p). ``track``: contig, bin, value; ``null``: contig, draw, bin, value. A peak
    that is no candidate is scored over its own bins at the threshold that suits it best."""
    observed = staged(candidate_segments(track, ["contig"], value, scales, thresholds, least), "observed")
    replays = staged(candidate_segments(null, ["contig", "draw"], value, scales, thresholds, least), "replays")
    known = observed.select("contig", "first", "last")
    own = peaks.select("contig", "first", "last").join(known, ["contig", "first", "last"], "left_anti")
    bins = own.withColumn("bin", F.explode(F.sequence("first", "last"))).join(track.select("contig", "bin", value), ["contig", "bin"])
    excess = bins.withColumn("_z", F.explode(F.array(*(F.lit(float(z)) for z in thresholds)))).withColumn("_x", F.greatest(F.col(value) - F.col("_z"), F.lit(0.0)))
    at = excess.groupBy("contig", "first", "last", "_z").agg(F.sum("_x").alias("integrated"), F.max("_x").alias("top"), F.count(F.lit(1)).alias("_n")).withColumn("adjusted", F.col("integrated") / F.sqrt("_n"))
    own = at.groupBy("contig", "first", "last").agg(F.max(F.struct("adjusted", "integrated", "top")).alias("_b")).select("contig", "first", "last", *(F.col(f"_b.{m}").alias(m) for m in METRICS))
    out = staged(observed.unionByName(own), "scored")
    for m in metrics:
        stat = out.select(m).distinct()
        p = empirical_p(stat, replays.select(m), m).withColumnRenamed("p", f"p_{m}")
        q = replay_q(out.select(m), replays.select(m, "draw"), m, "draw", draws).distinct().withColumnRenamed("q", f"q_{m}")
        out = out.join(p, m).join(q, m).withColumn(f"q_{m}", F.greatest(f"q_{m}", f"p_{m}"))
    return peaks.select("contig", "first", "last").join(out, ["contig", "first", "last"])
