"""Over-wide peaks: the genome-wide width policy, the best low-score gap to split at, and the core to contract to.

The gap with the largest deficit is a difference of prefix sums: running sums and running extremes per tile, so a peak of any width is
many tasks. Peaks split level by level, all peaks of a level in one job; what cannot be split is contracted."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.scan import running
from gridloom.operators.statistics import benjamini_hochberg, cumulative, quantiles
from gridloom.staging import small_join, staged


def _upper_tail(z: DataFrame) -> DataFrame:
    """``z`` with the normal upper tail ``p`` (one row per distinct width)."""

    def run(batches):
        for batch in batches:
            p = [0.5 * math.erfc(v / math.sqrt(2)) for v in batch["z"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "p"])

    return z.mapInArrow(run, "width long, count long, z double, p double")


def width_policy(peaks: DataFrame, least: int = 7500, alpha: float = 0.1, bulk: float = 0.95, most: float = 0.005, gap: float = 0.10, peaks_needed: int = 25, cap_z: float = 3.0) -> dict:
    """centre, scale, threshold (None: no peak is over-wide), tail (peaks in the tail) of ``peaks`` (width). The widths' logarithms give
    a robust normal tail; the threshold is the first width behind a gap of ``gap`` in log width from which on all are in
    the tail (q <= ``alpha``) and few, at most ``cap_z`` scales out and at least ``least``."""
    per = staged(peaks.filter("width > 0").groupBy(F.col("width").cast("long").alias("width")).agg(F.count(F.lit(1)).alias("count")), "widths")
    n = per.agg(F.sum("count")).first()[0] or 0
    told = {"centre": None, "scale": None, "threshold": None, "tail": 0}
    if n < peaks_needed:
        return told
    logs = peaks.filter("width > 0").select(F.log(F.greatest("width", F.lit(1))).alias("l"))
    cut = quantiles(logs, [], "l", {"c": bulk}).first()["c"]
    low = logs.filter(F.col("l") <= cut)
    if low.count() < max(5, math.ceil(0.1 * n)):
        low = logs
    q = quantiles(low, [], "l", {"m": 0.5, "a": 0.25, "b": 0.75}).first()
    scale = 1.4826 * quantiles(low.select(F.abs(F.col("l") - q["m"]).alias("d")), [], "d", {"m": 0.5}).first()["m"]
    scale = scale if scale > 1e-12 else (q["b"] - q["a"]) / 1.349
    scale = scale if scale > 1e-12 else 1.0
    told |= {"centre": q["m"], "scale": scale}
    tailed = staged(_upper_tail(per.withColumn("z", (F.log(F.greatest("width", F.lit(1))) - q["m"]) / scale)), "tail")
    each = tailed.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "count"))).select("width", "p")
    qs = benjamini_hochberg(each, "p").groupBy("width").agg(F.max("q").alias("q"))
    d = cumulative(tailed.select("width", "count", F.lit(1).alias("_all")), ["_all"], "width", {"_right": "count"}, descending=True).join(qs, "width")
    told["tail"] = d.filter((F.col("width") >= least) & (F.col("q") <= alpha)).agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    # the width before each: largest width of all smaller ones
    before = cumulative(d.select((-F.col("width")).alias("_neg"), "width", F.lit(1).alias("_all")), ["_all"], "width", {"_rank": "_all"})
    ranked = before.select("width", "_rank")
    pairs = d.join(ranked, "width").join(ranked.select(F.col("width").alias("_before"), (F.col("_rank") + 1).alias("_rank")), "_rank")
    fits = pairs.filter((F.col("width") >= least) & (F.log("width") - F.log("_before") >= gap) & (F.col("_right") <= max(1, math.floor(most * n))) & (F.col("q") <= alpha))
    first = fits.agg(F.min("width")).first()[0]
    if first is not None:
        told["threshold"] = max(least, min(float(first), max(float(least), math.exp(q["m"] + cap_z * scale))))
    return told


def best_gaps(cells: DataFrame, least: DataFrame, cost: float, split: float = 0.25) -> DataFrame:
    """contig, peak, gap_first, gap_last (bins), deficit, gain, z: the gap of at least ``least`` bins, as far from both ends, whose scores
    fall short of the peak's lower quartile by the most. ``cells``: contig, peak (first bin), bin, score; ``least``: contig, peak, least.
    Peaks of fewer than three times ``least`` bins have none. The first gap of equal deficits, with its latest start
    of the least prefix, is taken."""
    keys = ["contig", "peak"]
    q = staged(quantiles(cells, keys, "score", {"_base": split, "_q1": 0.25, "_mid": 0.5, "_q3": 0.75}), "quartiles")
    off = small_join(cells, q, keys)
    mad = quantiles(off.withColumn("_off", F.abs(F.col("score") - F.col("_mid"))), keys, "_off", {"_mad": 0.5})
    size = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    told = staged(q.join(mad, keys).join(size, keys).join(least, keys), "told")
    d = small_join(cells, told, keys).filter(F.col("_n") >= 3 * F.col("least"))
    d = running(d.withColumn("_i", F.col("bin") - F.col("peak")), keys, ["_i"], F.col("_base") - F.col("score"), "_sum")
    d = staged(d.withColumn("_before", F.col("_sum") - (F.col("_base") - F.col("score"))), "sums")
    starts = d.filter(F.col("_i") >= F.col("least")).select(*keys, "_i", (-F.col("_before")).alias("_neg"))
    top = running(starts, keys, ["_i"], F.col("_neg"), "_top", "max").select(*keys, (F.col("_i")).alias("_s"), "_top")
    ends = d.filter(F.col("_i") <= F.col("_n") - F.col("least") - 1).withColumn("_s", F.col("_i") - F.col("least") + 1)
    found = ends.join(top, [*keys, "_s"]).withColumn("deficit", F.col("_sum") + F.col("_top"))
    best = found.groupBy(*keys).agg(F.max_by(F.struct("_i", "_s", "_top", "deficit"), F.struct("deficit", -F.col("_i"))).alias("_b"))
    best = staged(best.select(*keys, F.col("_b._i").alias("_end"), F.col("_b._s").alias("_last"), F.col("_b._top").alias("_top"), F.col("_b.deficit").alias("deficit")), "best")
    begin = small_join(starts, best, keys).filter((F.col("_i") <= F.col("_last")) & (F.col("_neg") == F.col("_top"))).groupBy(*keys).agg(F.min("_i").alias("_start"))
    out = best.join(begin, keys).join(told, keys)
    scale = 1.4826 * F.col("_mad")
    scale = F.when(scale > 1e-12, scale).when((F.col("_q3") - F.col("_q1")) / 1.349 > 1e-12, (F.col("_q3") - F.col("_q1")) / 1.349).otherwise(1.0)
    z = F.col("deficit") / (scale * F.sqrt(F.col("_end") - F.col("_start") + 1))
    return out.select(*keys, (F.col("peak") + F.col("_start")).alias("gap_first"), (F.col("peak") + F.col("_end")).alias("gap_last"), "deficit", (F.col("deficit") - 2 * max(cost, 0.0)).alias("gain"), z.alias("z"))


def cores(cells: DataFrame, cap: int, least: int, split: float = 0.25) -> DataFrame:
    """contig, peak, first, last of the core of each peak that has one: the island over half of the height above the lower quartile
    around the middle of the maximum, if it has at least ``least`` and fewer than ``cap`` bins; else the bins that growing from the middle to
    the higher neighbour takes before ``cap``. Only bins nearer than ``cap`` to the middle reach a task of a peak."""
    keys = ["contig", "peak"]
    ends = cells.groupBy(*keys).agg(F.max("score").alias("_max"), F.max("bin").alias("_last"))
    q = staged(quantiles(cells, keys, "score", {"_low": split}).join(ends, keys), "ends")
    d = small_join(cells, q, keys)
    at_top = d.filter(F.col("score") >= F.col("_max") - F.greatest(F.lit(1e-12), F.abs("_max") * 1e-12))
    middle = quantiles(at_top.select(*keys, F.col("bin").cast("double").alias("_b")), keys, "_b", {"_mid": 0.5})
    d = small_join(d, staged(middle.withColumn("_centre", F.ceil(F.col("_mid") - 0.5)), "middle"), keys)
    floor = F.col("_low") + 0.5 * (F.col("_max") - F.col("_low"))
    below, c = F.col("score") < floor, F.col("_centre")
    island = d.filter(F.col("_max") - F.col("_low") > 1e-12).groupBy(*keys).agg(
        (F.coalesce(F.max(F.when(below & (F.col("bin") < c), F.col("bin"))), F.col("peak") - 1) + 1).alias("first"),
        (F.coalesce(F.min(F.when(below & (F.col("bin") > c), F.col("bin"))), F.max("_last") + 1) - 1).alias("last"),
        F.max(F.when(F.col("bin") == c, ~below)).alias("_on"),
        F.max("_last").alias("_end"),
    )
    wide = F.col("last") - F.col("first") + 1
    island = staged(island.filter(F.col("_on") & (wide >= least) & (wide < cap) & (wide < F.col("_end") - F.col("peak") + 1)).select(*keys, "first", "last"), "islands")
    rest = small_join(d.filter(F.abs(F.col("bin") - c) < cap), island.select(*keys), keys, "left_anti")
    listed = rest.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "score"))).alias("r"), F.first("_mid").alias("mid"), F.first("_centre").alias("centre"), F.first("_last").alias("end"))

    def run(batches):
        for batch in batches:
            out = []
            for contig, peak, r, mid, centre, end in zip(*(batch[k].to_pylist() for k in ("contig", "peak", "r", "mid", "centre", "end")), strict=True):
                score = {x["bin"]: x["score"] for x in r}
                a = b = int(centre)
                while b - a + 2 < cap:
                    ways = [(score[at], -abs(at - mid), side) for at, side in ((a - 1, -1), (b + 1, 1)) if at in score]
                    if not ways:
                        break
                    a, b = (a - 1, b) if max(ways)[2] < 0 else (a, b + 1)
                if least <= b - a + 1 < min(cap, end - peak + 1):
                    out.append((contig, peak, a, b))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["contig", "peak", "first", "last"])

    return island.unionByName(listed.mapInArrow(run, "contig string, peak long, first long, last long"))


def tame(peaks: DataFrame, scores: DataFrame, threshold: int, cap: int, least: int, cost: float, child: int = 10, share: float = 0.05, min_z: float = 2.0, split: float = 0.25, depth: int = 8) -> DataFrame:
    """contig, first, last, how (kept, split, contracted): peaks of ``threshold`` bins or more split at their best gaps, again and again,
    and what has no gap of ``min_z`` and positive gain contracts to fewer than ``cap`` bins. Pieces have at least ``least`` and ``child``
    bins, and ``share`` of the peak they come from. ``peaks``: contig, first, last; ``scores``: contig, bin, score."""
    fine = peaks.filter(F.col("last") - F.col("first") + 1 < threshold).select("contig", "first", "last", F.lit("kept").alias("how"))
    size = F.col("last") - F.col("first") + 1
    open_ = peaks.filter(size >= threshold).select("contig", "first", "last", F.lit("kept").alias("how"), F.greatest(F.lit(least), F.lit(child), F.ceil(share * size)).alias("least"))
    open_, done = staged(open_, "wide"), fine
    for level in range(depth + 1):
        if open_.isEmpty():
            break
        places = open_.select("contig", F.col("first").alias("peak"), F.explode(F.sequence("first", "last")).alias("bin"))
        cells = staged(places.join(scores.select("contig", "bin", "score"), ["contig", "bin"]), "cells")
        named = open_.withColumnRenamed("first", "peak")
        gaps = staged(best_gaps(cells, named.select("contig", "peak", "least"), cost, split).filter((F.col("gain") > 0) & (F.col("z") >= min_z)), "gaps") if level < depth else None
        stuck = named if gaps is None else small_join(named, gaps, ["contig", "peak"], "left_anti")
        core = staged(cores(small_join(cells, staged(stuck.select("contig", "peak"), "stuck"), ["contig", "peak"]), cap, max(least, child), split), "cores")
        held = stuck.join(core.withColumnRenamed("last", "_to"), ["contig", "peak"], "left")
        done = done.unionByName(held.select("contig", F.coalesce("first", "peak").alias("first"), F.coalesce("_to", "last").alias("last"), F.when(F.col("first").isNotNull(), "contracted").otherwise(F.col("how")).alias("how")))
        if gaps is None:
            break
        cut = gaps.join(named, ["contig", "peak"])
        halves = cut.select("contig", "least", F.explode(F.array(F.struct(F.col("peak").alias("first"), (F.col("gap_first") - 1).alias("last")), F.struct((F.col("gap_last") + 1).alias("first"), F.col("last").alias("last")))).alias("h")).select("contig", "h.first", "h.last", F.lit("split").alias("how"), "least")
        halves = staged(halves, "halves")
        done = done.unionByName(halves.filter(size < threshold).drop("least"))
        open_ = staged(halves.filter(size >= threshold), "wide")
    return done
