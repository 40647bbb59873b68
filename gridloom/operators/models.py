"""Pieces of the variance, dependence and null models: seeded draws, dependence of samples, effective sizes, wild bootstrap,
order-statistic bounds, robust locations. Aggregates run in Spark; what reaches the driver are a few scalars per key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.scan import halo_window, running
from gridloom.operators.statistics import cumulative


def uniform(seed: int, *columns: str) -> Column:
    """A number in (0, 1) that depends on the seed and the columns only, the same on every engine (32 bits of MD5)."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32


def normal(seed: int, *columns: str) -> Column:
    """A standard normal number by Box and Muller from two uniform ones."""
    return F.sqrt(-2 * F.log(uniform(seed, *columns))) * F.cos(2 * math.pi * uniform(seed + 1, *columns))


def weighted_sample(rows: DataFrame, weight: Column, n: int, seed: int, *identity: str) -> DataFrame:
    """``n`` rows without replacement, with odds by weight: the smallest exponential keys. A top-n, not a sort."""
    return rows.withColumn("_key", -F.log(uniform(seed, *identity)) / weight).orderBy("_key", *identity).limit(n).drop("_key")


def sliding_mean(rows: DataFrame, keys: list[str], position: str, value: str, allowed: str, width: int, name: str) -> DataFrame:
    """Mean of the allowed cells in a window of ``width`` dense positions (from 0) that slides inward at the edges; a window
    without any keeps the cell's own value. Prefix sums and two lookups, so the width costs nothing."""
    d = rows.withColumn("_w", F.col(allowed).cast("long"))
    d = running(d, keys, [position], F.when(F.col(allowed), F.col(value)).otherwise(0.0), "_sum")
    d = running(d, keys, [position], F.col("_w"), "_cnt")
    size = d.groupBy(*keys).agg((F.max(position) + 1).alias("_n"))
    d = d.join(size, keys).withColumn("_lo", F.greatest(F.lit(0), F.least(F.col(position) - (width - 1) // 2, F.col("_n") - width))).withColumn("_hi", F.least(F.col("_n") - 1, F.col("_lo") + width - 1))
    at = d.select(*keys, F.col(position).alias("_p"), "_sum", "_cnt")
    low = at.select(*keys, (F.col("_p") + 1).alias("_lo"), F.col("_sum").alias("_s0"), F.col("_cnt").alias("_c0"))
    high = at.select(*keys, F.col("_p").alias("_hi"), F.col("_sum").alias("_s1"), F.col("_cnt").alias("_c1"))
    d = d.join(high, [*keys, "_hi"]).join(low, [*keys, "_lo"], "left")
    count = F.col("_c1") - F.coalesce("_c0", F.lit(0))
    mean = (F.col("_s1") - F.coalesce("_s0", F.lit(0.0))) / count
    return d.withColumn(name, F.when(count > 0, mean).otherwise(F.col(value))).select(*rows.columns, name)


def span_mean(rows: DataFrame, keys: list[str], position: str, value: str, low: Column, high: Column, name: str) -> DataFrame:
    """Mean of the dense positions (from 0) between ``low`` and ``high`` of each row, as far as they exist."""
    d = running(rows, keys, [position], F.col(value), "_sum")
    size = rows.groupBy(*keys).agg(F.max(position).alias("_end"))
    d = d.join(size, keys).withColumn("_lo", F.greatest(F.lit(0), low)).withColumn("_hi", F.least(F.col("_end"), high))
    at = d.select(*keys, F.col(position).alias("_p"), F.col("_sum").alias("_s"))
    d = d.join(at.select(*keys, F.col("_p").alias("_hi"), F.col("_s").alias("_s1")), [*keys, "_hi"])
    d = d.join(at.select(*keys, (F.col("_p") + 1).alias("_lo"), F.col("_s").alias("_s0")), [*keys, "_lo"], "left")
    return d.withColumn(name, (F.col("_s1") - F.coalesce("_s0", F.lit(0.0))) / (F.col("_hi") - F.col("_lo") + 1)).select(*rows.columns, name)


def centred_boxcar(rows: DataFrame, keys: list[str], position: str, value: str, half: int, name: str) -> DataFrame:
    """Value less the mean of the 2 half + 1 cells around it; beyond an edge the edge cell repeats. Dense positions from 0."""
    edge = rows.groupBy(*keys).agg(F.min_by(value, position).alias("_first"), F.max_by(value, position).alias("_last"), F.max(position).alias("_end"))
    d = halo_window(rows, keys, position, half, half, {"_sum": lambda w: F.sum(value).over(w)}).join(edge, keys)
    left, right = F.greatest(F.lit(0), half - F.col(position)), F.greatest(F.lit(0), F.col(position) + half - F.col("_end"))
    return d.withColumn(name, F.col(value) - (F.col("_sum") + left * F.col("_first") + right * F.col("_last")) / (2 * half + 1)).select(*rows.columns, name)


def effective_size(rows: DataFrame, keys: list[str], position: str, value: str, lags: int) -> DataFrame:
    """keys, n, tau, ess, lags_used: 1 + 2 * sum of the autocorrelations up to the first that is not positive. All lags in one
    self-join on position + lag; the cut needs ``lags`` rows per key."""
    mean = rows.groupBy(*keys).agg(F.avg(value).alias("_mu"), F.var_pop(value).alias("_var"), F.count(F.lit(1)).alias("n"))
    d = rows.join(mean, keys).select(*keys, F.col(position).alias("_p"), (F.col(value) - F.col("_mu")).alias("_x"))
    shifted = d.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("_lag"), "_p", F.col("_x").alias("_y")).withColumn("_p", F.col("_p") - F.col("_lag"))
    rho = shifted.join(d, [*keys, "_p"]).groupBy(*keys, "_lag").agg((F.sum(F.col("_x") * F.col("_y")) / F.count(F.lit(1))).alias("_cov")).join(mean, keys)
    rho = rho.filter("_lag < n").withColumn("_rho", F.col("_cov") / F.col("_var"))
    stop = Window.partitionBy(*keys).orderBy("_lag").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = rho.withColumn("_low", F.min("_rho").over(stop)).filter("_low > 0").groupBy(*keys).agg(F.sum("_rho").alias("_s"), F.count(F.lit(1)).alias("lags_used"))
    tau = F.greatest(F.lit(1.0), 1 + 2 * F.coalesce("_s", F.lit(0.0)))
    return mean.join(kept, keys, "left").select(*keys, "n", tau.alias("tau"), (F.col("n") / tau).alias("ess"), F.coalesce("lags_used", F.lit(0)).alias("lags_used"))


def fisher_dependence(pairs: DataFrame, keys: list[str], r: str, n: str, cap: float = 0.25) -> DataFrame:
    """keys, rho: weighted mean of Fisher's z of pair correlations (weights n - 3), drawn to 0 by one standard error, back
    to a correlation and clipped to [0, cap]."""
    w = F.greatest(F.col(n) - 3, F.lit(0))
    s = pairs.groupBy(*keys).agg((F.sum(w * F.atanh(F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), F.col(r))))) / F.sum(w)).alias("_z"), F.sqrt(1 / F.sum(w)).alias("_se"), F.count(F.lit(1)).alias("n_pairs"))
    shrunk = F.signum("_z") * F.greatest(F.lit(0.0), F.abs("_z") - F.col("_se"))
    return s.select(*keys, "n_pairs", F.tanh("_z").alias("raw_rho"), F.least(F.lit(cap), F.greatest(F.lit(0.0), F.tanh(shrunk))).alias("rho"))


def sign_test_p(wins: Column, n: Column) -> Column:
    """Two-sided binomial p of ``wins`` out of ``n`` at one half, summed in log space."""
    k = F.least(wins, n - wins)
    first = n * math.log(0.5)
    step = lambda a, i: F.when(i == 0, a["lp"]).otherwise(a["lp"] + F.log((n - i + 1) / F.greatest(i, F.lit(1))))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), k), F.struct(first.cast("double").alias("lp"), F.lit(0.0).alias("s")), lambda a, i: F.struct(step(a, i).alias("lp"), (a["s"] + F.exp(step(a, i))).alias("s")), lambda a: a["s"])
    return F.least(F.lit(1.0), 2 * tail)


def pac_index(n: int, coverage: float, delta: float) -> int | None:
    """Smallest k with P(Bin(n, coverage) <= k - 1) >= 1 - delta: the k-th smallest of n scores bounds the quantile with that
    confidence. None where even the largest does not."""
    total, log_p, log_q = 0.0, math.log(coverage), math.log1p(-coverage)
    for k in range(n):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * log_p + (n - k) * log_q)
        if total >= 1 - delta:
            return k + 1
    return None


def pac_bounds(scores: DataFrame, key: str, score: str, coverage: float, delta: float, z: float) -> DataFrame:
    """key, n_blocks, order_index, bound, scale: the order statistic of ``pac_index`` and its ratio to the nominal quantile
    ``z``. One number per key goes through the driver."""
    sizes = {r[key]: r["n"] for r in scores.groupBy(key).agg(F.count(F.lit(1)).alias("n")).collect()}
    index = [(k, n, pac_index(n, coverage, delta)) for k, n in sizes.items()]
    kind = scores.schema[key].dataType.simpleString()
    table = scores.sparkSession.createDataFrame(index, f"`{key}` {kind}, n_blocks long, order_index long")
    cum = cumulative(scores.groupBy(key, score).agg(F.count(F.lit(1)).alias("_m")), [key], score, {"_c": "_m"})
    found = cum.join(F.broadcast(table), key).filter("_c >= order_index").groupBy(key).agg(F.min(score).alias("bound"))
    return table.join(found, key, "left").withColumn("scale", F.col("bound") / z)


def wild_bootstrap(rows: DataFrame, keys: list[str], position: str, residual: str, draws: int, span: int, seed: int) -> DataFrame:
    """keys, position, draw, null: residuals times a smooth Gaussian multiplier (Bartlett weights, unit variance inside) per
    draw, less the draw's mean. Noise depends on (seed, keys, position, draw) only; the weights are two box sums."""
    d = rows.select(*keys, position, residual, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    by, d = [*keys, "draw"], d.withColumn("_e", normal(seed, *keys, position, "draw"))
    # sums of e and of position * e over the left and the right half of the triangle give its weights, gaps or not
    d, at = d.withColumn("_pe", F.col(position) * F.col("_e")), F.col(position)
    left, right = (1 - span, 0), (1, span - 1)
    sums = {f"_{side}{c}": (lambda w, c=c, ends=ends: F.sum(c).over(w.rangeBetween(*ends))) for side, ends in (("l", left), ("r", right)) for c in ("_e", "_pe") if ends[0] <= ends[1]}
    smooth = halo_window(d, by, position, span - 1, span - 1, sums)
    side = lambda name: F.coalesce(F.col(name), F.lit(0.0)) if span > 1 else F.lit(0.0)
    smooth = smooth.withColumn("_g", (span - at) * F.col("_l_e") + F.col("_l_pe") + (span + at) * side("_r_e") - side("_r_pe"))
    norm = math.sqrt(sum((span - abs(k)) ** 2 for k in range(1 - span, span)))
    out = smooth.withColumn("_n", F.col(residual) * F.col("_g") / norm)
    mean = out.groupBy(*keys, "draw").agg(F.avg("_n").alias("_mu"))
    return out.join(mean, [*keys, "draw"]).select(*keys, position, "draw", (F.col("_n") - F.col("_mu")).alias("null"))


def huber_location(values: Column, scale_floor: float = 1e-12, rounds: int = 4) -> Column:
    """Huber-weighted location of a short array: median and MAD start, ``rounds`` steps at 1.345."""
    middle = lambda a: (F.element_at(a, F.floor((F.size(a) + 1) / 2).cast("int")) + F.element_at(a, F.floor(F.size(a) / 2).cast("int") + 1)) / 2
    start = middle(F.array_sort(values))
    scale = 1.4826 * middle(F.array_sort(F.transform(values, lambda v: F.abs(v - start))))
    zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("n"))

    def step(loc: Column, _) -> Column:
        w = lambda v: F.least(F.lit(1.0), 1.345 * scale / F.greatest(F.abs(v - loc), F.lit(1e-12)))
        return F.aggregate(values, zero, lambda a, v: F.struct((a["d"] + w(v)).alias("d"), (a["n"] + w(v) * v).alias("n")), lambda a: a["n"] / a["d"])

    return F.when(scale <= scale_floor, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step))


def delta_variance(full: Column, masked: Column, held: Column, least: float, low: float, high: float) -> tuple[Column, Column]:
    """Variance of full against deleted states, covariance difference before held-out information, and which it is (1, 2; 0
    invalid)."""
    difference, info = masked - full, full * held / (1 - held)
    by_cov = (full > 0) & (masked > 0) & (difference > least)
    by_info = (full > 0) & held.between(low, high) & (held < 1) & (info > least)
    return F.when(by_cov, difference).when(by_info, info), F.when(by_cov, 1).when(by_info, 2).otherwise(0)


def read_geometry(flag: Column, start: Column, end: Column, tlen: Column, shift: int = 0, extend: int = 0) -> tuple[Column, Column]:
    """[start, end) of what a read counts for: a fixed extension from the shifted 5' end, or the template its signed length
    spans, or the read."""
    forward = flag.bitwiseAND(16) == 0
    five = F.when(forward, start + shift).otherwise(end - shift)
    if extend:
        return F.when(forward, five).otherwise(five - extend), F.when(forward, five + extend).otherwise(five)
    return F.when(tlen < 0, end + tlen).otherwise(start), F.when(tlen > 0, start + tlen).otherwise(end)


def flag_exclusion(mode: Column, exclude: int = 3844) -> Column:
    """read1 input also drops mate-unmapped (8) and second reads (128)."""
    return F.when(mode == "read1", F.lit(exclude).bitwiseOR(F.lit(8 | 128))).otherwise(F.lit(exclude))


def block_length(n: Column, interval: int, least_bp: int, multiple: int, folds: int, least: int) -> Column:
    """Bins of a hold-out block: enough base pairs, at most what ``folds`` blocks leave of ``n`` bins, within [least, n]."""
    wanted = round(max(least_bp, multiple * interval) / interval)
    most = F.greatest(F.floor((n + folds - 1) / folds), F.lit(least))
    return F.least(F.greatest(F.least(F.lit(wanted), most), F.lit(least)), F.greatest(n, F.lit(1)))


def odd_bins(window: Column, interval: int, least: int = 3) -> Column:
    """An odd number of bins that covers ``window`` base pairs."""
    n = F.greatest(F.lit(least), F.ceil(window / interval))
    return n + F.when(n % 2 == 0, 1).otherwise(0)


def remaining_gap(path: Column) -> Column:
    """Of an array of objectives: (f - last) / (first - last) per pass, 0 where nothing was gained."""
    first, last = F.element_at(path, 1), F.element_at(path, -1)
    return F.transform(path, lambda f: F.when(F.abs(first - last) <= 1e-12, 0.0).otherwise((f - last) / (first - last)))
