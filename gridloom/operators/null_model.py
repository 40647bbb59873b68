"""Null centre and scale of scores: half-sample mode of the lower bulk, central support around it, robust scale of that."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.statistics import cumulative, quantiles
from gridloom.staging import freed, small_join, staged

#: A key's remaining values are halved by one task from here on.
SMALL = 4096


def mode_of_sorted(values: np.ndarray) -> float:
    """Half-sample mode: the shortest half, again and again; of equally short ones the first."""
    while len(values) > 3:
        half = (len(values) + 1) // 2
        at = int((values[half - 1 :] - values[: len(values) - half + 1]).argmin())
        values = values[at : at + half]
    if len(values) == 3:
        values = values[:2] if values[1] - values[0] <= values[2] - values[1] else values[1:]
    return float(values.mean())


def half_sample_mode(rows: DataFrame, keys: list[str], value: str, name: str = "mode", small: int = SMALL) -> DataFrame:
    """keys and the half-sample mode of their values (nulls do not count). Values are ranked by counts per distinct value; a
    halving joins every rank with the one half the values further on and keeps the shortest stretch; half of the ranks go on.
    No key's values are ever sorted in one task before at most ``small`` are left."""
    per = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_k"))
    by = [*keys, "_all"]
    ranked = cumulative(per.withColumn("_all", F.lit(1)), by, "_v", {"_to": "_k"})
    ranked = staged(ranked.select(*by, "_v", F.explode(F.sequence(F.col("_to") - F.col("_k"), F.col("_to") - 1)).alias("_r")), "ranked")
    left = staged(ranked.groupBy(*by).agg(F.lit(0).cast("long").alias("_lo"), F.count(F.lit(1)).alias("_n")), "left")
    while not left.filter(F.col("_n") > small).isEmpty():
        inside = small_join(ranked, left, by).filter((F.col("_r") >= F.col("_lo")) & (F.col("_r") < F.col("_lo") + F.col("_n"))).select(*by, "_r", "_v", "_n")
        going = staged(inside.filter(F.col("_n") > small).withColumn("_h", F.floor((F.col("_n") + 1) / 2)), "going")
        ends = going.select(*by, (F.col("_r") - F.col("_h") + 1).alias("_r"), F.col("_v").alias("_end"))
        best = going.join(ends, [*by, "_r"]).groupBy(*by).agg(F.min_by("_r", F.struct(F.col("_end") - F.col("_v"), "_r")).alias("_lo"), F.first("_h").alias("_n"))
        before, left = left, staged(left.filter(F.col("_n") <= small).unionByName(best), "left")
        old, ranked = ranked, staged(inside.drop("_n"), "ranked")
        freed(before, old, going)
    inside = small_join(ranked, left, by).filter((F.col("_r") >= F.col("_lo")) & (F.col("_r") < F.col("_lo") + F.col("_n")))
    listed = inside.groupBy(*by).agg(F.array_sort(F.collect_list("_v")).alias("_values")).drop("_all")  # at most ``small``

    def run(batches):
        for batch in batches:
            found = pa.array([mode_of_sorted(np.array(v)) for v in batch["_values"].to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.select(keys).columns, found], names=[*keys, name])

    head = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    return listed.select(*keys, "_values").mapInArrow(run, f"{head}`{name}` double")


def robust_scale(rows: DataFrame, keys: list[str], value: str, name: str, floor: float = 1e-6) -> DataFrame:
    """keys, name and its median: the largest of MAD * 1.4826, interquartile range / 1.349 (from 4 values on), the standard deviation
    and ``floor``."""
    q = staged(quantiles(rows, keys, value, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75}), "quartiles")
    d = small_join(rows, q, keys) if keys else rows.join(F.broadcast(q), F.lit(True))
    mad = quantiles(d.withColumn("_off", F.abs(F.col(value) - F.col("_q2"))), keys, "_off", {"_mad": 0.5})
    sd = rows.groupBy(*keys).agg(F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("_sd"), F.count(value).alias("_n"))
    out = q.join(mad, keys).join(sd, keys) if keys else q.join(F.broadcast(mad), F.lit(True)).join(F.broadcast(sd), F.lit(True))
    spread = F.when(F.col("_n") >= 4, (F.col("_q3") - F.col("_q1")) / 1.349).otherwise(0.0)
    return out.select(*keys, F.greatest(1.4826 * F.col("_mad"), spread, F.col("_sd"), F.lit(floor)).alias(name))


def null_centre(scores: DataFrame, keys: list[str], value: str, bulk: float = 0.6) -> DataFrame:
    """keys, centre, scale, support, radius. The centre is the half-sample mode of the values up to the ``bulk`` quantile; the support
    lies within 2.5 robust scales of it (or the nearest 16, or 5 %, if that is too few); the scale is that of the support."""
    d = scores.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_z"))
    least = F.greatest(F.lit(16), F.ceil(0.05 * F.col("_all_n")))
    cut = quantiles(d, keys, "_z", {"_cut": bulk}, inverted=True)
    size = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all_n"))
    cut = staged(cut.join(size, keys), "cut")
    low = small_join(d, cut, keys).groupBy(*keys).agg(F.count_if(F.col("_z") <= F.col("_cut")).alias("_low"), F.first("_cut").alias("_cut"), F.first("_all_n").alias("_all_n"))
    low = staged(low, "low")
    lower = staged(small_join(d, low, keys).filter((F.col("_z") <= F.col("_cut")) | (F.col("_low") < least)).select(*keys, "_z"), "lower")
    mode = staged(half_sample_mode(lower, keys, "_z", "centre"), "mode")
    off = small_join(lower, mode, keys).select(*keys, (F.col("_z") - F.col("centre")).alias("_off"))
    wide = robust_scale(off, keys, "_off", "_scale").join(quantiles(off.select(*keys, F.abs("_off").alias("_off")), keys, "_off", {"_half": 0.5}, inverted=True), keys)
    at = staged(mode.join(wide, keys).join(low.select(*keys, least.alias("_least")), keys).select(*keys, "centre", "_least", F.greatest(2.5 * F.col("_scale"), F.col("_half"), F.lit(1e-6)).alias("radius")), "radius")
    far = small_join(d, at, keys).withColumn("_far", F.abs(F.col("_z") - F.col("centre")))
    counts = cumulative(far.groupBy(*keys, "_far").agg(F.count(F.lit(1)).alias("_k")), keys, "_far", {"_to": "_k"})
    needed = counts.join(at.select(*keys, "_least"), keys).filter(F.col("_to") >= F.col("_least")).groupBy(*keys).agg(F.min("_far").alias("_enough"))
    reach = staged(at.select(*keys, "radius").join(needed, keys, "left").select(*keys, F.greatest("radius", F.coalesce("_enough", F.lit(float("inf")))).alias("_reach")), "reach")
    support = staged(small_join(far, reach, keys).filter(F.col("_far") <= F.col("_reach")).select(*keys, (F.col("_z") - F.col("centre")).alias("_off")), "support")
    found = robust_scale(support, keys, "_off", "scale").join(support.groupBy(*keys).agg(F.count(F.lit(1)).alias("support")), keys)
    return at.select(*keys, "centre", "radius").join(found, keys)
