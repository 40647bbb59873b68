"""Weighted quantiles, ranks and multiple testing over whole columns, by sorted bucket sums rather than one sorted task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.staging import staged

#: Cells that the values of a key are dealt to.
CELLS = 64


def placed(per: DataFrame, keys: list[str], value: str, cells: int = CELLS) -> DataFrame:
    """``per`` with ``_cell``: the number of cut points below the value. The cuts come from a sketch of ``per`` itself, so cells hold
    about as many rows each, whatever the values' unit and spread."""
    cuts = per.groupBy(*keys).agg(F.percentile_approx(value, F.array(*(F.lit(i / cells) for i in range(1, cells))), F.lit(20 * cells)).alias("_cuts"))
    return per.join(cuts, keys).withColumn("_cell", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")


def cumulative(per: DataFrame, keys: list[str], value: str, sums: dict[str, str], descending: bool = False, how: str = "sum", cells: int = CELLS) -> DataFrame:
    """``per`` (one row per keys and value) with running sums or maxima up to and with each value: output name -> column. Values are
    ordered inside cells only; the carries of a key are at most ``cells`` rows."""
    agg = {"sum": F.sum, "max": F.max}[how]
    d = staged(placed(staged(per, "values"), keys, value, cells), "cells")
    order, cell = (F.desc(value), F.desc("_cell")) if descending else (F.asc(value), F.asc("_cell"))
    before = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = d.groupBy(*keys, "_cell").agg(*(agg(c).alias(f"_t{i}") for i, c in enumerate(sums.values())))
    carry = carry.select(*keys, "_cell", *(agg(f"_t{i}").over(before).alias(f"_c{i}") for i in range(len(sums))))
    d = d.join(carry, [*keys, "_cell"])
    both = lambda here, there: F.greatest(here, there) if how == "max" else here + F.coalesce(there, F.lit(0))
    return d.select(*per.columns, *(both(agg(c).over(inside), F.col(f"_c{i}")).alias(name) for i, (name, c) in enumerate(sums.items())))


def weighted_quantile(rows: DataFrame, keys: list[str], value: str, weight: str, q: float) -> DataFrame:
    """Smallest value whose running weight reaches q of the total, per key. Equal values are summed first."""
    by = [*keys, "_all"]
    per = rows.groupBy(*keys, value).agg(F.sum(weight).alias("_weight")).withColumn("_all", F.lit(1))
    cum = cumulative(per, by, value, {"_c": "_weight"})
    total = cum.groupBy(*by).agg(F.max("_c").alias("_t"))
    return cum.join(total, by).filter(F.col("_c") >= q * F.col("_t") - 1e-9).groupBy(*by).agg(F.min(value).alias("quantile")).drop("_all")


def mid_ranks(rows: DataFrame, value: str, name: str, descending: bool = False) -> DataFrame:
    """``rows`` with the rank of ``value`` among all, ties sharing the mean of theirs."""
    per = rows.groupBy(value).agg(F.count(F.lit(1)).alias("_k"), F.lit(1).alias("_all"))
    cum = cumulative(per, ["_all"], value, {"_to": "_k"}, descending)
    return rows.join(cum.select(value, (F.col("_to") - (F.col("_k") - 1) / 2).alias(name)), value)


def benjamini_hochberg(rows: DataFrame, p: str) -> DataFrame:
    """``q``: min over larger p of p * n / rank. Ties share the largest rank. Ranks come from counts per distinct p."""
    per = rows.filter(F.col(p).isNotNull()).groupBy(p).agg(F.count(F.lit(1)).alias("_k"), F.lit(1).alias("_all"))
    total = rows.filter(F.col(p).isNotNull()).agg(F.count(F.lit(1)).alias("_n"))
    ranked = cumulative(per, ["_all"], p, {"_rank": "_k"}).join(F.broadcast(total), F.lit(True)).withColumn("_neg", -F.col(p) * F.col("_n") / F.col("_rank"))
    low = cumulative(ranked.select(p, "_all", "_neg"), ["_all"], p, {"_best": "_neg"}, descending=True, how="max")
    return rows.join(low.select(p, F.least(F.lit(1.0), -F.col("_best")).alias("q")), p, "left")


def empirical_p(observed: DataFrame, null: DataFrame, stat: str) -> DataFrame:
    """(1 + null values >= stat) / (n_null + 1), from counts per distinct value of both sides in one descending pass."""
    both = observed.select(F.col(stat).alias("_s")).withColumn("_k", F.lit(0)).unionByName(null.select(F.col(stat).alias("_s"), F.lit(1).alias("_k")))
    at = cumulative(both.groupBy("_s").agg(F.sum("_k").alias("_k"), F.lit(1).alias("_all")), ["_all"], "_s", {"_above": "_k"}, descending=True)
    n = null.agg(F.count(F.lit(1)).alias("_n"))
    return observed.join(at.select(F.col("_s").alias(stat), "_above"), stat).join(F.broadcast(n), F.lit(True)).withColumn("p", (1 + F.col("_above")) / (F.col("_n") + 1)).drop("_above", "_n")


def quantiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float], cells: int = 64, inverted: bool = False) -> DataFrame:
    """keys and one column per wanted quantile (linear between neighbours at q * (n - 1), or at q * n - 1 if ``inverted``; nulls
    do not count): exact, without one sorted task per key. A sketch gives cut points, counts per distinct value and cell find the cells that hold the wanted ranks, and only
    these are ordered."""
    keyed = rows.select(*(F.col(k) for k in keys), F.lit(1).alias("_all"), F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    keys_ = [*keys, "_all"]
    per = staged(keyed.groupBy(*keys_, "_v").agg(F.count(F.lit(1)).alias("_m")), "values")
    cuts = per.groupBy(*keys_).agg(F.percentile_approx("_v", F.array(*(F.lit(i / cells) for i in range(1, cells))), F.lit(1000)).alias("_cuts"), F.sum("_m").alias("_n"))
    spread = per.join(cuts, keys_).withColumn("_cell", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    filled = spread.groupBy(*keys_, "_cell").agg(F.sum("_m").alias("_k"), F.first("_n").alias("_n"))
    before = Window.partitionBy(*keys_).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # at most ``cells`` rows
    filled = filled.withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0)))
    ranks = F.array(*(F.struct(F.lit(name).alias("name"), (F.greatest(q * F.col("_n") - 1, F.lit(0.0)) if inverted else q * (F.col("_n") - 1)).alias("at")) for name, q in wanted.items()))
    asked = filled.withColumn("_q", F.explode(ranks)).filter((F.ceil("_q.at") >= F.col("_before")) & (F.floor("_q.at") < F.col("_before") + F.col("_k")))
    hit = spread.join(asked.select(*keys_, "_cell", "_before").distinct(), [*keys_, "_cell"])
    inside = Window.partitionBy(*keys_, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = hit.withColumn("_to", F.col("_before") + F.sum("_m").over(inside)).withColumn("_from", F.col("_to") - F.col("_m"))
    near = hit.join(asked.select(*keys_, "_cell", "_q"), [*keys_, "_cell"])
    holds = lambda r: (r >= F.col("_from")) & (r < F.col("_to"))
    low, high = F.floor("_q.at"), F.ceil("_q.at")
    ends = near.groupBy(*keys_, "_q").agg(F.max(F.when(holds(low), F.col("_v"))).alias("_lo"), F.max(F.when(holds(high), F.col("_v"))).alias("_hi"))
    at = F.col("_lo") + (F.col("_q.at") - low) * (F.col("_hi") - F.col("_lo"))
    return ends.groupBy(*keys_).agg(*(F.max(F.when(F.col("_q.name") == name, at)).alias(name) for name in wanted)).drop("_all")


def replay_q(observed: DataFrame, null: DataFrame, stat: str, draw: str, draws: int) -> DataFrame:
    """``q``: least over thresholds up to the statistic's own of (mean null count >= t + 1 / (draws + 1)) / observed count >= t,
    from counts per distinct value of both sides in one descending and one ascending pass. ``null`` holds ``draw``."""
    both = observed.select(F.col(stat).alias("_s"), F.lit(1).alias("_o"), F.lit(0).alias("_k")).unionByName(null.select(F.col(stat).alias("_s"), F.lit(0).alias("_o"), F.lit(1).alias("_k")))
    per = both.groupBy("_s").agg(F.sum("_o").alias("_o"), F.sum("_k").alias("_k"), F.lit(1).alias("_all"))
    down = cumulative(per, ["_all"], "_s", {"_seen": "_o", "_null": "_k"}, descending=True)
    raw = F.least(F.lit(1.0), (F.col("_null") / F.lit(draws) + F.lit(1.0 / (draws + 1))) / F.col("_seen"))
    low = cumulative(down.filter("_o > 0").select("_s", "_all", (-raw).alias("_neg")), ["_all"], "_s", {"_best": "_neg"}, how="max")
    return observed.join(low.select(F.col("_s").alias(stat), F.least(F.lit(1.0), -F.col("_best")).alias("q")), stat)
