"""Registered queries of the dependence, calibration and null models, and of rows around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import expr
from gridloom.operators import counting, intervals, models, scan, statistics, trend, variance
from gridloom.plans import views as V
from gridloom.plans.queries import query, r4
from gridloom.plans.queries_more import _PEAKS, _peaks
from gridloom.plans.views import FRAGMENTS, MEAN, REGIONS, TRACKS, WIDTH


def u(seed: int, *columns: str) -> str:
    """The SQL of ``models.uniform``."""
    return f"((CAST('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(columns)})), 1, 8) AS BIGINT) + 0.5) / 4294967296.0)"


# ---- sources and geometry -------------------------------------------------------------------------------------------
@query("SELECT s_suppkey AS sample, mode, CASE WHEN mode = 'read1' THEN 3844 | 136 ELSE 3844 END AS exclude FROM (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN CASE WHEN s_nationkey % 2 = 0 THEN 'fragments' ELSE 'reads' END WHEN 1 THEN 'fragments' WHEN 2 THEN 'reads' ELSE 'read1' END AS mode FROM supplier)")
def p2_input_modes(spark, d):
    """Input mode of a sample: auto goes by the kind of its source."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    given, fragments = F.element_at(F.array(*(F.lit(x) for x in ("auto", "fragments", "reads", "read1"))), (F.col("s_suppkey") % 4 + 1).cast("int")), F.col("s_nationkey") % 2 == 0
    mode = F.when(given != "auto", given).when(fragments, "fragments").otherwise("reads")
    return s.select(F.col("s_suppkey").alias("sample"), mode.alias("mode")).withColumn("exclude", models.flag_exclusion(F.col("mode")))


@query(f"WITH {FRAGMENTS}, t AS (SELECT *, CASE WHEN flag & 16 = 0 THEN e - s ELSE s - e END AS tlen FROM fragments), g AS (SELECT sample, contig, CASE WHEN flag & 16 = 0 THEN s + 3 ELSE e - 3 - x END AS a, CASE WHEN flag & 16 = 0 THEN s + 3 + x ELSE e - 3 END AS b, CASE WHEN tlen < 0 THEN e + tlen ELSE s END AS ta, CASE WHEN tlen > 0 THEN s + tlen ELSE e END AS tb FROM t, LATERAL (SELECT 20 AS x)) SELECT sample, contig, CAST(sum(a) AS BIGINT) AS ext_start, CAST(sum(b) AS BIGINT) AS ext_end, CAST(sum(ta) AS BIGINT) AS span_start, CAST(sum(tb) AS BIGINT) AS span_end FROM g GROUP BY ALL")
def p3_p4_read_geometry(spark, d):
    f = V.fragments(spark, d).withColumn("tlen", F.when(F.col("flag").bitwiseAND(16) == 0, F.col("end") - F.col("start")).otherwise(F.col("start") - F.col("end")))
    columns = [F.col(c) for c in ("flag", "start", "end", "tlen")]
    (a, b), (ta, tb) = models.read_geometry(*columns, shift=3, extend=20), models.read_geometry(*columns)
    return f.groupBy("sample", "contig").agg(F.sum(a).alias("ext_start"), F.sum(b).alias("ext_end"), F.sum(ta).alias("span_start"), F.sum(tb).alias("span_end"))


@query(f"WITH {FRAGMENTS}, k AS (SELECT sample, 1e6 / sum(c) AS scale FROM fragments GROUP BY sample), h AS (SELECT *, unnest(range(s // {WIDTH}, (e - 1) // {WIDTH} + 1)) AS bin FROM fragments) SELECT contig, sample, bin, round(sum(c * (least(e, (bin + 1) * {WIDTH}) - greatest(s, bin * {WIDTH})) / CAST(e - s AS DOUBLE)) * any_value(scale), 3) AS value FROM h JOIN k USING (sample) GROUP BY ALL")
def a7_scaled_sources(spark, d):
    """Scan to bins for all sources of the sheet at once: count, times the source's scale factor."""
    f = V.fragments(spark, d)
    scale = f.groupBy("sample").agg((1e6 / F.sum("count")).alias("scale"))
    c = counting.count_bins(f, WIDTH, "fractional")
    return c.join(scale, "sample").select("contig", "sample", "bin", F.round(F.col("value") * F.col("scale"), 3).alias("value"))


@query(f"WITH {FRAGMENTS} SELECT sample, CAST(coalesce(floor(quantile_cont(e - s, 0.5) FILTER (WHERE e - s BETWEEN 10 AND 45 AND c < 7)), 147) AS BIGINT) AS fragment_length FROM fragments GROUP BY sample")
def a12_fragment_length(spark, d):
    """Median absolute template length within bounds; 147 where there is none."""
    f = V.fragments(spark, d).withColumn("n", F.col("end") - F.col("start"))
    m = statistics.quantiles(f.filter("n BETWEEN 10 AND 45 AND count < 7"), ["sample"], "n", {"m": 0.5})
    return f.select("sample").distinct().join(m, "sample", "left").select("sample", F.coalesce(F.floor("m"), F.lit(147)).alias("fragment_length"))


# ---- rows and weights -----------------------------------------------------------------------------------------------
@query(f"WITH {FRAGMENTS}, h AS (SELECT *, unnest(range(s // {WIDTH}, (e - 1) // {WIDTH} + 1)) AS bin FROM fragments), b AS (SELECT contig, sample, control, bin, sum(c * w) AS raw, sum(c * w * w) AS mass FROM (SELECT *, (least(e, (bin + 1) * {WIDTH}) - greatest(s, bin * {WIDTH})) / CAST(e - s AS DOUBLE) AS w FROM h) GROUP BY ALL), f AS (SELECT contig, sample, bin, CASE WHEN sample = 's3' THEN NULL ELSE power(0.5 / (ln(2) * ((raw + 0.5) * 0.5 + 1)), 2) * (mass + 0.5 * mass / raw) END AS floor FROM b) SELECT contig, sample, bin, round(sum(floor), 5) AS floor FROM f GROUP BY ALL")
def p8_pair_floors(spark, d):
    """Count-noise floors of treatment and control summed per bin; none for signal sources (here s3)."""
    c = counting.count_bins(V.fragments(spark, d), WIDTH, "fractional", ("contig", "sample", "control"))
    import math

    slope = 0.5 / (math.log(2) * ((F.col("value") + 0.5) * 0.5 + 1))
    floor = F.when(F.col("sample") != "s3", slope * slope * (F.col("noise_mass") + 0.5 * F.col("noise_mass") / F.col("value")))
    return c.groupBy("contig", "sample", "bin").agg(F.round(F.sum(floor), 5).alias("floor"))


@query(f"WITH {TRACKS}, a AS (SELECT contig, bin, x, greatest(0.05, least(0.95, raw / (raw + 10))) AS h, greatest(0.2, least(5.0, 8 / (7 + power(x - 5, 2)))) AS lam FROM tracks WHERE raw > 0 AND bin % 17 <> 0) SELECT contig, count(*) AS cells, round(sum(h), 3) AS by_h, round(sum(sqrt(h)), 3) AS by_root, round(sum(lam), 3) AS lambda FROM a GROUP BY contig")
def p11_p14_p16_row_weights(spark, d):
    """Active cells (positive, unmasked) with clipped information weights h and root h, and clipped precision values."""
    t = V.tracks(spark, d).filter((F.col("raw") > 0) & (F.col("bin") % 17 != 0))
    clip = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), c))
    h, lam = clip(F.col("raw") / (F.col("raw") + 10), 0.05, 0.95), clip(8 / (7 + F.pow(F.col("x") - 5, 2)), 0.2, 5.0)
    return t.groupBy("contig").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum(h), 3).alias("by_h"), F.round(F.sum(F.sqrt(h)), 3).alias("by_root"), F.round(F.sum(lam), 3).alias("lambda"))


@query(f"WITH {TRACKS}, {MEAN} SELECT contig, bin, round(least(greatest(x - 4, -0.5), 2.0) + 1e-9, 4) AS level FROM mean_track")
def p13_bounded_level(spark, d):
    m = V.mean_track(spark, d)
    return m.select("contig", "bin", r4(F.least(F.greatest(F.col("x") - 4, F.lit(-0.5)), F.lit(2.0)) + 1e-9).alias("level"))


@query(f"WITH {TRACKS}, v AS (SELECT contig, bin, 1 / sum(raw + 1) AS f, 1 / sum(CASE WHEN sample <> 's' || (bin % 4) THEN raw + 1 END) AS m, sum(CASE WHEN sample = 's' || (bin % 4) THEN raw + 1 ELSE 0 END) / sum(raw + 1) AS h FROM tracks GROUP BY ALL), c AS (SELECT contig, bin, CASE WHEN m - f > 0.002 THEN m - f WHEN h BETWEEN 0.05 AND 0.9 AND f * h / (1 - h) > 0.002 THEN f * h / (1 - h) END AS delta, CASE WHEN m - f > 0.002 THEN 1 WHEN h BETWEEN 0.05 AND 0.9 AND f * h / (1 - h) > 0.002 THEN 2 ELSE 0 END AS source FROM v) SELECT contig, source, count(*) AS bins, round(sum(delta), 4) AS delta FROM c GROUP BY ALL")
def p15_a23_delta_variance(spark, d):
    """Kept and held-out information per bin (one sample is held out), and the variance of the deleted state's difference."""
    w, held = F.col("raw") + 1, F.col("sample") == F.concat(F.lit("s"), F.col("bin") % 4)
    v = V.tracks(spark, d).groupBy("contig", "bin").agg((1 / F.sum(w)).alias("f"), (1 / F.sum(F.when(~held, w))).alias("m"), (F.sum(F.when(held, w).otherwise(0.0)) / F.sum(w)).alias("h"))
    delta, source = models.delta_variance(F.col("f"), F.col("m"), F.col("h"), 0.002, 0.05, 0.9)
    return v.groupBy("contig", source.alias("source")).agg(F.count(F.lit(1)).alias("bins"), r4(F.sum(delta)).alias("delta"))


@query(f"WITH {TRACKS}, {MEAN}, f AS (SELECT contig, bin, x, 0.3 + x / 20 AS p, (bin * 5) // 256 AS seg FROM mean_track) SELECT contig, bin, round(greatest(sqrt(greatest(exp(0.1 * seg - 0.2) * p, 0.25)), 0.6), 4) AS se FROM f")
def p18_segment_factors(spark, d):
    """Log factors per segment applied to variances: exp, floor, root, never below the model's standard error."""
    f = V.mean_track(spark, d).withColumn("seg", F.floor(F.col("bin") * 5 / 256))
    factors = f.groupBy("seg").agg(F.exp(0.1 * F.first("seg") - 0.2).alias("factor"))
    se = F.greatest(F.sqrt(F.greatest(F.col("factor") * (0.3 + F.col("x") / 20), F.lit(0.25))), F.lit(0.6))
    return f.join(factors, "seg").select("contig", "bin", r4(se).alias("se"))


@query(f"WITH {TRACKS}, {MEAN}, c AS (SELECT contig, bin, greatest(0, 0.3 * least(x, 2) + 0.1 * greatest(0, x - 4) - 0.9 * greatest(0, x - 5)) AS v FROM mean_track) SELECT contig, bin, round(v, 4) AS v FROM c")
def p22_additive_covariate(spark, d):
    """Additive covariate variance: hinge basis of a predictor times coefficients, never negative."""
    x, none = F.col("x"), F.lit(0.0)
    basis = F.array(F.least(x, F.lit(2.0)), F.greatest(none, x - 4), F.greatest(none, x - 5))
    dot = F.aggregate(F.zip_with(basis, F.array(F.lit(0.3), F.lit(0.1), F.lit(-0.9)), lambda a, b: a * b), none, lambda s, y: s + y)
    return V.mean_track(spark, d).select("contig", "bin", r4(F.greatest(none, dot)).alias("v"))


@query(f"WITH {TRACKS}, {MEAN}, m AS (SELECT contig, quantile_cont(x, 0.5) AS mid FROM mean_track GROUP BY contig) SELECT contig, bin, round(abs(x - mid), 4) AS gc FROM mean_track JOIN m USING (contig)")
def p24_centred_covariate(spark, d):
    m = V.mean_track(spark, d)
    mid = statistics.quantiles(m, ["contig"], "x", {"mid": 0.5})
    return m.join(mid, "contig").select("contig", "bin", r4(F.abs(F.col("x") - F.col("mid"))).alias("gc"))


@query(f"WITH {TRACKS}, m AS (SELECT contig, bin, avg(x) AS x, avg(raw + 1) AS v FROM tracks GROUP BY ALL), g AS (SELECT contig, bin, ln(v) AS a, abs(x) AS b, abs(x - coalesce(lag(x) OVER (PARTITION BY contig ORDER BY bin), x)) AS c FROM m), q AS (SELECT quantile_cont(a, 0.5) AS qa, quantile_cont(b, 0.5) AS qb, quantile_cont(c, 0.5) AS qc, quantile_cont(b, 0.9) AS top FROM g), e AS (SELECT quantile_cont(abs(a - qa), 0.5) AS da, quantile_cont(abs(b - qb), 0.5) AS db, quantile_cont(abs(c - qc), 0.5) AS dc FROM g, q) SELECT contig, bin, round((a - qa) / (1.4826 * da), 3) AS log_v, round((b - qb) / (1.4826 * db), 3) AS level, round((c - qc) / (1.4826 * dc), 3) AS step, b >= top AS high FROM g, q, e")
def p27_robust_features(spark, d):
    """Feature columns, each less its median and over its MAD; cells of high signal."""
    m = V.tracks(spark, d).groupBy("contig", "bin").agg(F.avg("x").alias("x"), F.avg(F.col("raw") + 1).alias("v"))
    g = scan.previous(m, ["contig"], "bin", ["x"]).select("contig", "bin", F.log("v").alias("a"), F.abs("x").alias("b"), F.abs(F.col("x") - F.coalesce("prev_x", "x")).alias("c"))
    stacked = g.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(k).alias("y")) for k in "abc"))).alias("s")).select("s.*")
    mid = statistics.quantiles(stacked, ["k"], "y", {"mid": 0.5, "top": 0.9})
    dev = stacked.join(mid, "k").withColumn("dev", F.abs(F.col("y") - F.col("mid")))
    mad = statistics.quantiles(dev, ["k"], "dev", {"mad": 0.5}).join(mid, "k")
    wide = mad.agg(*(F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}_{k}") for k in "abc" for c in ("mid", "mad", "top")))  # one row
    z = lambda k: F.round((F.col(k) - F.col(f"mid_{k}")) / (1.4826 * F.col(f"mad_{k}")), 3)
    return g.join(F.broadcast(wide), F.lit(True)).select("contig", "bin", z("a").alias("log_v"), z("b").alias("level"), z("c").alias("step"), (F.col("b") >= F.col("top_b")).alias("high"))


@query(f"WITH {_PEAKS}, c AS (SELECT pk.contig, a, b, quantile_cont(x, 0.5) AS mid, quantile_cont(1 / (1 + x), 0.5) AS se, max(x) AS top FROM pk JOIN mean_track m ON pk.contig = m.contig AND m.bin BETWEEN a AND b GROUP BY ALL) SELECT contig, a AS first_bin, b AS last_bin FROM c WHERE (b - a + 1) * {WIDTH} >= 20 AND mid >= -1.5 * se AND top >= 5.15")
def p30_filtered_peaks(spark, d):
    """Peaks that are wide enough, whose median level is not below minus 1.5 median uncertainties, with a high enough summit."""
    p, m = _peaks(spark, d), V.mean_track(spark, d)
    cells = p.select("contig", "a", "b", "top", F.explode(F.sequence("a", "b")).alias("bin")).join(m.select("contig", "bin", "x"), ["contig", "bin"])
    mid = statistics.quantiles(cells, ["contig", "a"], "x", {"mid": 0.5})
    se = statistics.quantiles(cells.withColumn("se", 1 / (1 + F.col("x"))), ["contig", "a"], "se", {"se": 0.5})
    kept = p.join(mid, ["contig", "a"]).join(se, ["contig", "a"]).filter((F.col("b") - F.col("a") + 1) * WIDTH >= 20).filter("mid >= -1.5 * se AND top >= 5.15")
    return kept.select("contig", F.col("a").alias("first_bin"), F.col("b").alias("last_bin"))


# ---- aggregates -----------------------------------------------------------------------------------------------------
@query(f"WITH {TRACKS}, f AS (SELECT contig, bin, avg(x) AS every, avg(CASE WHEN sample <> 's' || (bin // 25 % 4) THEN x END) AS del FROM tracks GROUP BY ALL) SELECT contig, bin // 25 AS block, count(*) AS bins, round(avg(every - del), 4) AS mean_residual, round(max(abs(every - del)), 4) AS worst FROM f GROUP BY ALL")
def a29_a52_deleted_residuals(spark, d):
    """Full state against the state without the sample that its block holds out, and the blocks' rows."""
    held = F.col("sample") == F.concat(F.lit("s"), F.floor(F.col("bin") / 25) % 4)
    f = V.tracks(spark, d).groupBy("contig", "bin").agg((F.avg("x") - F.avg(F.when(~held, F.col("x")))).alias("r"))
    return f.groupBy("contig", F.floor(F.col("bin") / 25).alias("block")).agg(F.count(F.lit(1)).alias("bins"), r4(F.avg("r")).alias("mean_residual"), r4(F.max(F.abs("r"))).alias("worst"))


@query(f"WITH {TRACKS} SELECT contig, bin // 25 AS block, round(avg(CASE WHEN raw > 3 THEN x END), 4) AS covariate, count(CASE WHEN raw > 3 THEN 1 END) AS present FROM tracks GROUP BY ALL")
def a31_block_covariates(spark, d):
    t = V.tracks(spark, d).withColumn("c", F.when(F.col("raw") > 3, F.col("x")))
    return t.groupBy("contig", F.floor(F.col("bin") / 25).alias("block")).agg(r4(F.avg("c")).alias("covariate"), F.count("c").alias("present"))


@query(f"WITH {TRACKS}, {MEAN}, b AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY contig, bin // 25) AS w, x - 5 AS y FROM mean_track) SELECT round(sum(w), 4) AS blocks, round(sum(w * y), 4) AS s1, round(sum(w * y * y), 4) AS s2, round(sum(w * abs(y)), 4) AS sa, round(sum(CASE WHEN abs(y) < 0.5 THEN w ELSE 0 END), 4) AS near_null FROM b")
def a35_block_weighted_sums(spark, d):
    """Initial sums of the spike and slab prior: every block has weight 1."""
    m = V.mean_track(spark, d).withColumn("block", F.floor(F.col("bin") / 25)).withColumn("y", F.col("x") - 5)
    w = m.groupBy("contig", "block").agg((1.0 / F.count(F.lit(1))).alias("w"))
    b = m.join(w, ["contig", "block"])
    s = lambda c: r4(F.sum(c))
    return b.agg(s("w").alias("blocks"), s(F.col("w") * F.col("y")).alias("s1"), s(F.col("w") * F.col("y") ** 2).alias("s2"), s(F.col("w") * F.abs("y")).alias("sa"), s(F.when(F.abs("y") < 0.5, F.col("w")).otherwise(0.0)).alias("near_null"))


_DENSITY = "exp(-0.5 * y * y / ({v} + 0.2)) / sqrt({v} + 0.2)"


@query(f"WITH {TRACKS}, {MEAN}, l AS (SELECT y, 0.7 * {_DENSITY.format(v=0)} AS l0, 0.2 * {_DENSITY.format(v=0.5)} AS l1, 0.1 * {_DENSITY.format(v=2)} AS l2 FROM (SELECT x - 5 AS y FROM mean_track)) SELECT round(sum(l0 / (l0 + l1 + l2)), 3) AS null_mass, round(sum(l1 / (l0 + l1 + l2)), 3) AS slab1, round(sum(l2 / (l0 + l1 + l2)), 3) AS slab2, round(sum(l1 / (l0 + l1 + l2) * (0.5 * 0.2 / 0.7 + power(0.5 / 0.7 * y, 2))), 3) AS second1, round(sum(l2 / (l0 + l1 + l2) * (2 * 0.2 / 2.2 + power(2 / 2.2 * y, 2))), 3) AS second2, round(sum(ln(l0 + l1 + l2)), 2) AS loglik FROM l")
def a36_mixture_sums(spark, d):
    """Expectation step of the spike and slab mixture: masses, second moments and log-likelihood, one aggregate."""
    y = F.col("x") - 5
    part = lambda share, v: share * F.exp(-0.5 * y * y / (v + 0.2)) / F.sqrt(F.lit(v + 0.2))
    m = V.mean_track(spark, d).select(y.alias("y"), part(0.7, 0.0).alias("l0"), part(0.2, 0.5).alias("l1"), part(0.1, 2.0).alias("l2"))
    total = F.col("l0") + F.col("l1") + F.col("l2")
    second = lambda c, v: F.sum(F.col(c) / total * (v * 0.2 / (v + 0.2) + F.pow(v / (v + 0.2) * F.col("y"), 2)))
    return m.agg(F.round(F.sum(F.col("l0") / total), 3).alias("null_mass"), F.round(F.sum(F.col("l1") / total), 3).alias("slab1"), F.round(F.sum(F.col("l2") / total), 3).alias("slab2"), F.round(second("l1", 0.5), 3).alias("second1"), F.round(second("l2", 2.0), 3).alias("second2"), F.round(F.sum(F.log(total)), 2).alias("loglik"))


@query(f"WITH {TRACKS}, {MEAN}, t AS (SELECT contig, x - lag(x) OVER (PARTITION BY contig ORDER BY bin) AS dx FROM mean_track) SELECT contig, count(dx) AS transitions, round(sum(dx * dx + 0.1), 3) AS second_moment, round(avg(dx * dx / 0.3), 4) AS nis FROM t GROUP BY contig")
def a37_a38_transition_sums(spark, d):
    """Expected squared transitions of a level (variance terms 0.1) and the mean normalised innovation."""
    t = scan.previous(V.mean_track(spark, d), ["contig"], "bin", ["x"]).withColumn("dx", F.col("x") - F.col("prev_x"))
    return t.groupBy("contig").agg(F.count("dx").alias("transitions"), F.round(F.sum(F.col("dx") ** 2 + 0.1), 3).alias("second_moment"), r4(F.avg(F.col("dx") ** 2 / 0.3)).alias("nis"))


_BLOCKS = f"WITH {TRACKS}, b AS (SELECT contig, sample, bin // 10 AS block, avg(x) AS m, count(*) AS k FROM tracks GROUP BY ALL)"


def _blocks(spark, d):
    return V.tracks(spark, d).groupBy("contig", "sample", F.floor(F.col("bin") / 10).alias("block")).agg(F.avg("x").alias("m"))


def _pairs(b):
    return b.withColumnsRenamed({"sample": "a", "m": "ma"}).join(b.withColumnsRenamed({"sample": "b", "m": "mb"}), ["contig", "block"]).filter("a < b")


@query(_BLOCKS + ", p AS (SELECT x.contig, x.sample AS a, y.sample AS b, corr(x.m, y.m) AS r, count(*) AS n FROM b x JOIN b y ON x.contig = y.contig AND x.block = y.block AND x.sample < y.sample GROUP BY ALL), z AS (SELECT contig, sum((n - 3) * atanh(least(0.999999, greatest(-0.999999, r)))) / sum(n - 3) AS z, sqrt(1.0 / sum(n - 3)) AS se, count(*) AS n_pairs FROM p GROUP BY contig) SELECT contig, n_pairs, round(tanh(z), 4) AS raw_rho, round(least(0.25, greatest(0, tanh(sign(z) * greatest(0, abs(z) - se)))), 4) AS rho FROM z")
def a40_replicate_dependence(spark, d):
    p = _pairs(_blocks(spark, d)).groupBy("contig", "a", "b").agg(F.corr("ma", "mb").alias("r"), F.count(F.lit(1)).alias("n"))
    return models.fisher_dependence(p, ["contig"], "r", "n").select("contig", "n_pairs", r4("raw_rho").alias("raw_rho"), r4("rho").alias("rho"))


@query(_BLOCKS + ", p AS (SELECT x.contig, x.sample AS a, y.sample AS b, count(*) FILTER (WHERE x.m > y.m) AS wins, count(*) FILTER (WHERE x.m <> y.m) AS n FROM b x JOIN b y ON x.contig = y.contig AND x.block = y.block AND x.sample < y.sample GROUP BY ALL) SELECT contig, a, b, wins, n, round(least(1.0, 2 * list_sum(list_transform(range(0, least(wins, n - wins) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))), 6) AS p FROM p")
def a42_pairwise_sign_test(spark, d):
    p = _pairs(_blocks(spark, d)).groupBy("contig", "a", "b").agg(F.count_if(F.col("ma") > F.col("mb")).alias("wins"), F.count_if(F.col("ma") != F.col("mb")).alias("n"))
    return p.withColumn("p", F.round(models.sign_test_p(F.col("wins"), F.col("n")), 6))


@query(f"WITH {TRACKS}, {MEAN} SELECT contig, round(coalesce(quantile_cont(x - 5, 0.5) FILTER (WHERE x > 5), 1), 4) AS scale, round(least(50, greatest(0.5, 0.5 * 12 * coalesce(quantile_cont(x - 5, 0.5) FILTER (WHERE x > 5), 1))), 4) AS gamma FROM mean_track GROUP BY contig")
def a44_m22_boundary_penalty(spark, d):
    """Median positive excess over the null centre, and the boundary penalty it gives for a dependence span of 12 bins."""
    m = V.mean_track(spark, d).withColumn("y", F.col("x") - 5)
    s = statistics.quantiles(m.filter("y > 0"), ["contig"], "y", {"s": 0.5})
    scale = F.coalesce("s", F.lit(1.0))
    return m.select("contig").distinct().join(s, "contig", "left").select("contig", r4(scale).alias("scale"), r4(F.least(F.lit(50.0), F.greatest(F.lit(0.5), 6 * scale))).alias("gamma"))


@query(f"WITH {TRACKS}, k AS (SELECT contig, least(5.0, greatest(0.2, 11 / (8 + power(x - 5, 2) * 2))) AS lam FROM tracks) SELECT contig, count(*) AS cells, round(avg(lam), 4) AS mean, round(quantile_cont(lam, 0.5), 4) AS median, round(quantile_cont(lam, 0.1), 4) AS q10, round(quantile_cont(lam, 0.9), 4) AS q90 FROM k GROUP BY contig")
def a45_a46_precision_summary(spark, d):
    k = V.tracks(spark, d).select("contig", F.least(F.lit(5.0), F.greatest(F.lit(0.2), 11 / (8 + F.pow(F.col("x") - 5, 2) * 2))).alias("lam"))
    q = statistics.quantiles(k, ["contig"], "lam", {"median": 0.5, "q10": 0.1, "q90": 0.9})
    return k.groupBy("contig").agg(F.count(F.lit(1)).alias("cells"), r4(F.avg("lam")).alias("mean")).join(q, "contig").select("contig", "cells", "mean", *(r4(c).alias(c) for c in ("median", "q10", "q90")))


_HUBER = "list_sum(list_transform(v, lambda y: y * least(1.0, 1.345 * sc / greatest(abs(y - {l}), 1e-12)))) / list_sum(list_transform(v, lambda y: least(1.0, 1.345 * sc / greatest(abs(y - {l}), 1e-12))))"


@query(f"WITH {TRACKS}, v AS (SELECT contig, bin, list(x) AS v, quantile_cont(x, 0.5) AS l0 FROM tracks GROUP BY ALL), s AS (SELECT *, 1.4826 * list_median(list_transform(v, lambda y: abs(y - l0))) AS sc FROM v), a AS (SELECT *, {_HUBER.format(l='l0')} AS l1 FROM s), b AS (SELECT *, {_HUBER.format(l='l1')} AS l2 FROM a), c AS (SELECT *, {_HUBER.format(l='l2')} AS l3 FROM b), e AS (SELECT *, {_HUBER.format(l='l3')} AS l4 FROM c) SELECT contig, bin, round(CASE WHEN sc <= 1e-12 THEN l0 ELSE l4 END + 1e-9, 4) AS location FROM e")
def a47_robust_location(spark, d):
    v = V.tracks(spark, d).groupBy("contig", "bin").agg(F.collect_list("x").alias("v"))  # one value per sample
    return v.select("contig", "bin", r4(models.huber_location(F.col("v")) + 1e-9).alias("location"))


@query(f"WITH {FRAGMENTS}, k AS (SELECT sample, 1e6 / sum(c) AS f FROM fragments GROUP BY sample) SELECT round(min(f), 3) AS least, round(max(f), 3) AS most, count(*) FILTER (WHERE NOT isfinite(f) OR f <= 0) AS bad, max(f) > 3 * min(f) AS spread FROM k")
def a50_scale_sanity(spark, d):
    k = V.fragments(spark, d).groupBy("sample").agg((1e6 / F.sum("count")).alias("f"))
    bad = F.isnan("f") | F.col("f").isNull() | (F.col("f") <= 0) | (F.abs("f") == float("inf"))
    return k.agg(F.round(F.min("f"), 3).alias("least"), F.round(F.max("f"), 3).alias("most"), F.count_if(bad).alias("bad"), (F.max("f") > 3 * F.min("f")).alias("spread"))


# ---- joins ----------------------------------------------------------------------------------------------------------
_GAPS = f"{_PEAKS}, n AS (SELECT contig, b + 1 AS a, lead(a) OVER (PARTITION BY contig ORDER BY a) - 1 AS b FROM pk), gaps AS (SELECT contig, a, b FROM n WHERE b >= a), {REGIONS}"


@query(f"WITH {_GAPS} SELECT contig, a AS first_bin, b AS last_bin, EXISTS (SELECT 1 FROM regions r WHERE r.contig = gaps.contig AND r.s < (gaps.b + 1) * {WIDTH} AND r.e > gaps.a * {WIDTH}) AS blocked FROM gaps")
def j9_blocked_gaps(spark, d):
    """Gaps between neighbouring runs, and whether a blacklist region lies in them."""
    n = scan.previous(_peaks(spark, d), ["contig"], "a", ["b"]).filter("prev_b IS NOT NULL AND a > prev_b + 1")
    g = n.select("contig", (F.col("prev_b") + 1).alias("first_bin"), (F.col("a") - 1).alias("last_bin")).withColumn("start", F.col("first_bin") * WIDTH).withColumn("end", (F.col("last_bin") + 1) * WIDTH)
    hit = intervals.range_join(g, V.regions(spark, d), 256, "left_semi").select("contig", "first_bin", F.lit(True).alias("_hit"))
    return g.join(hit, ["contig", "first_bin"], "left").select("contig", "first_bin", "last_bin", F.coalesce("_hit", F.lit(False)).alias("blocked"))


@query(f"WITH {_PEAKS}, c AS (SELECT contig, a // 25 AS parent, (a // 25) * 25 AS lo, (a // 25) * 25 + 24 AS hi, greatest(a, (a // 25) * 25) AS s, least(b, (a // 25) * 25 + 24) AS e FROM pk) SELECT contig, parent, string_agg(CAST(e - s + 1 AS VARCHAR), ',' ORDER BY s) AS sizes, string_agg(CAST(s - lo AS VARCHAR), ',' ORDER BY s) AS starts, count(*) AS blocks FROM c GROUP BY ALL")
def j15_k6_gapped_rows(spark, d):
    """Child blocks clipped into a broad parent, and the parent's row with lists of block sizes and starts."""
    lo = F.floor(F.col("a") / 25) * 25
    c = _peaks(spark, d).select("contig", F.floor(F.col("a") / 25).alias("parent"), F.struct((F.col("a") - lo).alias("at"), (F.least(F.col("b"), lo + 24) - F.col("a") + 1).alias("n")).alias("block"))
    g = c.groupBy("contig", "parent").agg(F.sort_array(F.collect_list("block")).alias("bs"))  # the blocks of one parent of 25 bins
    text = lambda f: F.concat_ws(",", F.transform("bs", lambda x: x[f].cast("string")))
    return g.select("contig", "parent", text("n").alias("sizes"), text("at").alias("starts"), F.size("bs").cast("long").alias("blocks"))


# ---- windows --------------------------------------------------------------------------------------------------------
@query(f"WITH {TRACKS}, {MEAN}, n AS (SELECT contig, max(bin) + 1 AS n FROM mean_track GROUP BY contig), w AS (SELECT m.contig, m.bin, m.x, greatest(0, least(m.bin - 2, n - 5)) AS lo FROM mean_track m JOIN n USING (contig)) SELECT w.contig, w.bin, round(coalesce(avg(y.x) FILTER (WHERE y.bin % 17 <> 0 AND y.x > 4.6), w.x) + 1e-9, 4) AS mean FROM w JOIN mean_track y ON y.contig = w.contig AND y.bin BETWEEN w.lo AND w.lo + 4 GROUP BY w.contig, w.bin, w.x")
def w2_sliding_masked_mean(spark, d):
    m = V.mean_track(spark, d).withColumn("ok", (F.col("bin") % 17 != 0) & (F.col("x") > 4.6))
    return models.sliding_mean(m, ["contig"], "bin", "x", "ok", 5, "mean").select("contig", "bin", r4(F.col("mean") + 1e-9).alias("mean"))


@query(f"WITH {TRACKS}, {MEAN}, n AS (SELECT contig, max(bin) AS n FROM mean_track GROUP BY contig), o AS (SELECT m.contig, m.bin, m.x, greatest(0, least(n, m.bin + k)) AS j FROM mean_track m JOIN n USING (contig), (SELECT unnest(range(-20, 21)) AS k)) SELECT o.contig, o.bin, round(o.x - avg(y.x) + 1e-9, 4) AS centred FROM o JOIN mean_track y ON y.contig = o.contig AND y.bin = o.j GROUP BY o.contig, o.bin, o.x")
def w3_centred_track(spark, d):
    return models.centred_boxcar(V.mean_track(spark, d), ["contig"], "bin", "x", 20, "centred").select("contig", "bin", r4(F.col("centred") + 1e-9).alias("centred"))


@query(f"WITH {TRACKS}, s AS (SELECT contig, sample, avg(x) AS mu, var_pop(x) AS v, count(*) AS n FROM tracks GROUP BY ALL), r AS (SELECT a.contig, a.sample, b.bin - a.bin AS lag, avg((a.x - mu) * (b.x - mu)) / any_value(v) AS rho FROM tracks a JOIN tracks b ON a.contig = b.contig AND a.sample = b.sample AND b.bin - a.bin BETWEEN 1 AND 12 JOIN s ON s.contig = a.contig AND s.sample = a.sample GROUP BY ALL), m AS (SELECT *, min(rho) OVER (PARTITION BY contig, sample ORDER BY lag) AS low FROM r), t AS (SELECT contig, sample, sum(rho) AS sr, count(*) AS used FROM m WHERE low > 0 GROUP BY ALL) SELECT contig, sample, n, round(greatest(1.0, 1 + 2 * coalesce(sr, 0)), 4) AS tau, round(n / greatest(1.0, 1 + 2 * coalesce(sr, 0)), 3) AS ess, coalesce(used, 0) AS lags_used FROM s LEFT JOIN t USING (contig, sample)")
def w5_effective_sample_size(spark, d):
    e = models.effective_size(V.tracks(spark, d), ["contig", "sample"], "bin", "x", 12)
    return e.select("contig", "sample", "n", r4("tau").alias("tau"), F.round("ess", 3).alias("ess"), "lags_used")


@query(f"WITH {TRACKS}, {MEAN}, w AS (SELECT DISTINCT contig, bin // 5 AS win FROM mean_track WHERE x > 5), g AS (SELECT *, win - row_number() OVER (PARTITION BY contig ORDER BY win) AS k FROM w), r AS (SELECT contig, k, count(*) AS n FROM g GROUP BY ALL) SELECT contig, count(*) AS runs, max(n) AS longest FROM r GROUP BY contig")
def w16_window_runs(spark, d):
    """Runs of adjacent windows, and the longest."""
    w = V.mean_track(spark, d).filter("x > 5").select("contig", F.floor(F.col("bin") / 5).alias("bin")).distinct()
    r = intervals.runs(w).withColumn("n", F.col("last_bin") - F.col("first_bin") + 1)
    return r.groupBy("contig").agg(F.count(F.lit(1)).alias("runs"), F.max("n").alias("longest"))


# ---- sampling -------------------------------------------------------------------------------------------------------
@query(f"SELECT o_orderkey FROM orders ORDER BY -ln({u(31, 'o_orderkey')}) / (1 + o_totalprice), o_orderkey LIMIT 500")
def t3_weighted_sample(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return models.weighted_sample(o, 1 + F.col("o_totalprice"), 500, 31, "o_orderkey").select("o_orderkey")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY {u(32, 'l_orderkey', 'l_linenumber')}, l_orderkey, l_linenumber LIMIT 1000")
def t7_priority_reservoir(spark, d):
    """A reservoir by hash priority: the same rows whatever the order and number of the parts it is merged from."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.withColumn("_k", models.uniform(32, "l_orderkey", "l_linenumber")).orderBy("_k", "l_orderkey", "l_linenumber").limit(1000).select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"WITH {TRACKS}, {MEAN}, n AS (SELECT contig, max(bin) // 8 + 1 AS n FROM mean_track GROUP BY contig), b AS (SELECT contig, bin // 8 AS block, avg(x) AS m, var_samp(x) AS v FROM mean_track GROUP BY ALL) SELECT contig, block, round(m, 4) AS m, round(v, 4) AS v FROM b JOIN n USING (contig) WHERE (block * 12) // n <> ((block - 1) * 12) // n OR block = 0")
def t11_block_windows(spark, d):
    """About 12 evenly spaced blocks per contig with mean and variance, for the variance trend."""
    b = V.mean_track(spark, d).groupBy("contig", F.floor(F.col("bin") / 8).alias("block")).agg(F.avg("x").alias("m"), F.var_samp("x").alias("v"))
    n = b.groupBy("contig").agg((F.max("block") + 1).alias("n"))
    cell = lambda k: F.floor(k * 12 / F.col("n"))
    return b.join(n, "contig").filter((F.col("block") == 0) | (cell(F.col("block")) != cell(F.col("block") - 1))).select("contig", "block", r4("m").alias("m"), r4("v").alias("v"))


# ---- calibration and null models ------------------------------------------------------------------------------------
@query("WITH s AS (SELECT c_mktsegment AS stratum, abs(c_acctbal) / 4000 AS z FROM customer), n AS (SELECT stratum, count(*) AS n FROM s GROUP BY 1), k AS (SELECT stratum, n, unnest(range(0, n)) AS k FROM n), c AS (SELECT stratum, n, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.95) + (n - k) * ln(0.05))) OVER (PARTITION BY stratum ORDER BY k) AS cdf FROM k), i AS (SELECT stratum, min(k) + 1 AS idx FROM c WHERE cdf >= 0.95 GROUP BY 1), r AS (SELECT stratum, z, row_number() OVER (PARTITION BY stratum ORDER BY z) AS rn FROM s) SELECT n.stratum, n.n AS n_blocks, idx AS order_index, round(r.z, 4) AS bound, round(r.z / 1.959964, 4) AS scale FROM n LEFT JOIN i USING (stratum) LEFT JOIN r ON r.stratum = n.stratum AND r.rn = idx")
def m14_pac_bounds(spark, d):
    s = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_mktsegment").alias("stratum"), (F.abs("c_acctbal") / 4000).cast("double").alias("z"))
    return models.pac_bounds(s, "stratum", "z", 0.95, 0.05, 1.959964).select("stratum", "n_blocks", "order_index", r4("bound").alias("bound"), r4("scale").alias("scale"))


_NORMAL = f"sqrt(-2 * ln({u(41, 'contig', 'bin', 'draw')})) * cos(2 * pi() * {u(42, 'contig', 'bin', 'draw')})"
_DRAWS = f"""{TRACKS}, {MEAN}, c AS (SELECT contig, avg(x) AS mu FROM mean_track GROUP BY contig), e AS (SELECT contig, bin, x - mu AS r, unnest(range(0, 6)) AS draw FROM mean_track JOIN c USING (contig)), z AS (SELECT *, {_NORMAL} AS e FROM e),
g AS (SELECT a.contig, a.bin, a.draw, a.r * sum(b.e * (4 - abs(a.bin - b.bin))) / sqrt(44.0) AS v FROM z a JOIN z b ON a.contig = b.contig AND a.draw = b.draw AND abs(a.bin - b.bin) < 4 GROUP BY a.contig, a.bin, a.draw, a.r),
nul AS (SELECT contig, draw, bin, v - avg(v) OVER (PARTITION BY contig, draw) AS v FROM g)"""


def _draws(spark, d):
    m = V.mean_track(spark, d)
    mu = m.groupBy("contig").agg(F.avg("x").alias("mu"))
    return models.wild_bootstrap(m.join(mu, "contig").withColumn("r", F.col("x") - F.col("mu")), ["contig"], "bin", "r", 6, 4, 41)


@query(f"WITH {_DRAWS} SELECT contig, draw, count(*) AS cells, round(avg(v * v), 4) AS second_moment, round(max(v), 3) AS top FROM nul GROUP BY ALL")
def m17_wild_bootstrap(spark, d):
    return _draws(spark, d).groupBy("contig", "draw").agg(F.count(F.lit(1)).alias("cells"), r4(F.avg(F.col("null") ** 2)).alias("second_moment"), F.round(F.max("null"), 3).alias("top"))


@query(f"WITH {_DRAWS}, s AS (SELECT contig, stddev_pop(v) AS s FROM nul GROUP BY contig), o AS (SELECT contig, draw, z, count(*) FILTER (WHERE v > z * s) / CAST(count(*) AS DOUBLE) AS occ, sum(greatest(0, v - z * s)) / count(*) AS soft FROM nul JOIN s USING (contig), (SELECT unnest([1.0, 1.5, 2.0]) AS z) GROUP BY ALL) SELECT contig, CAST(z AS DOUBLE) AS z, round(quantile_cont(occ, 0.9), 4) AS occupancy, round(quantile_cont(soft, 0.9), 4) AS soft_excess FROM o GROUP BY ALL")
def m18_threshold_views(spark, d):
    """Occupancy and soft excess of the null above each threshold, taken at 0.9 over the draws."""
    n = _draws(spark, d)
    s = n.groupBy("contig").agg(F.stddev_pop("null").alias("s"))
    v = n.join(s, "contig").withColumn("z", F.explode(F.array(*(F.lit(x) for x in (1.0, 1.5, 2.0)))))
    over = F.col("null") - F.col("z") * F.col("s")
    o = v.groupBy("contig", "draw", "z").agg((F.count_if(over > 0) / F.count(F.lit(1))).alias("occ"), F.avg(F.greatest(F.lit(0.0), over)).alias("soft"))
    return o.groupBy("contig", "z").agg(r4(F.percentile("occ", 0.9)).alias("occupancy"), r4(F.percentile("soft", 0.9)).alias("soft_excess"))  # one row per draw


@query(f"WITH {_DRAWS}, s AS (SELECT contig, stddev_pop(v) AS s FROM nul GROUP BY contig), o AS (SELECT contig, draw, count(*) FILTER (WHERE v > 1.5 * s) / CAST(count(*) AS DOUBLE) AS occ FROM nul JOIN s USING (contig) GROUP BY ALL), q AS (SELECT contig, quantile_cont(occ, 0.9) AS occ FROM o GROUP BY contig), x AS (SELECT m.contig, count(*) FILTER (WHERE x - mu > 1.5 * s) / CAST(count(*) AS DOUBLE) AS seen FROM mean_track m JOIN c USING (contig) JOIN s USING (contig) GROUP BY m.contig) SELECT contig, round(seen, 4) AS observed, round(occ, 4) AS expected, round(least(0.25, greatest(0.001, seen - occ)), 4) AS budget FROM x JOIN q USING (contig)")
def m20_budgets(spark, d):
    """Observed occupancy less the calibrated null's, clipped."""
    n, m = _draws(spark, d), V.mean_track(spark, d)
    s = n.groupBy("contig").agg(F.stddev_pop("null").alias("s"))
    o = n.join(s, "contig").groupBy("contig", "draw").agg((F.count_if(F.col("null") > 1.5 * F.col("s")) / F.count(F.lit(1))).alias("occ")).groupBy("contig").agg(F.percentile("occ", 0.9).alias("occ"))
    mu = m.groupBy("contig").agg(F.avg("x").alias("mu"))
    x = m.join(mu, "contig").join(s, "contig").groupBy("contig").agg((F.count_if(F.col("x") - F.col("mu") > 1.5 * F.col("s")) / F.count(F.lit(1))).alias("seen"))
    return x.join(o, "contig").select("contig", r4("seen").alias("observed"), r4("occ").alias("expected"), r4(F.least(F.lit(0.25), F.greatest(F.lit(0.001), F.col("seen") - F.col("occ")))).alias("budget"))


@query("WITH o AS (SELECT c_custkey AS id, round(abs(c_acctbal), 0) AS s FROM customer), n AS (SELECT o_custkey % 16 AS draw, round(o_totalprice / 40, 0) AS s FROM orders), t AS (SELECT DISTINCT s FROM o), r AS (SELECT s, least(1.0, ((SELECT count(*) FROM n WHERE n.s >= t.s) / 16.0 + 1 / 17.0) / (SELECT count(*) FROM o WHERE o.s >= t.s)) AS raw FROM t), q AS (SELECT s, min(raw) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) AS q FROM r) SELECT id, round(q, 6) AS q FROM o JOIN q USING (s)")
def x12_replay_q(spark, d):
    o = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.round(F.abs("c_acctbal"), 0).cast("double").alias("s"))
    n = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 16).alias("draw"), F.round(F.col("o_totalprice") / 40, 0).cast("double").alias("s"))
    return statistics.replay_q(o, n, "s", "draw", 16).select("id", F.round("q", 6).alias("q"))


@query(f"WITH {TRACKS}, {MEAN}, t AS (SELECT CAST(z AS DOUBLE) AS z, contig, bin, x FROM mean_track, (SELECT unnest([4.9, 5.0, 5.1, 5.2]) AS z) WHERE x > z), g AS (SELECT *, CASE WHEN bin - lag(bin) OVER (PARTITION BY z, contig ORDER BY bin) = 1 THEN 0 ELSE 1 END AS n FROM t), i AS (SELECT *, sum(n) OVER (PARTITION BY z, contig ORDER BY bin) AS k FROM g), p AS (SELECT z, contig, k, count(*) AS w, max(x) AS top FROM i GROUP BY ALL) SELECT z, count(*) AS peaks, CAST(sum(w) AS BIGINT) AS bins, round(avg(w), 4) AS mean_width, round(max(top), 4) AS top FROM p GROUP BY z")
def x14_k11_cutoff_report(spark, d):
    """Peak calling for several thresholds in one job, keyed by the threshold: the sweep report's rows."""
    t = V.mean_track(spark, d).withColumn("z", F.explode(F.array(*(F.lit(x) for x in (4.9, 5.0, 5.1, 5.2))))).filter("x > z")
    t = t.select(F.concat_ws("|", F.col("z").cast("string"), "contig").alias("contig"), "z", "bin", "x")
    p = intervals.runs(t, 0, (F.first("z").alias("z"), F.max("x").alias("top"))).withColumn("w", F.col("last_bin") - F.col("first_bin") + 1)
    return p.groupBy("z").agg(F.count(F.lit(1)).alias("peaks"), F.sum("w").alias("bins"), r4(F.avg("w")).alias("mean_width"), r4(F.max("top")).alias("top"))


@query(f"WITH {FRAGMENTS} SELECT sample, round(sum(CASE WHEN mapq >= 20 THEN c ELSE 0 END) / sum(c), 4) AS kept_share, round(avg(ln(1 + c)), 4) AS mean_log, round(stddev_samp(ln(1 + c)), 4) AS sd_log, count(*) AS reads FROM fragments GROUP BY sample")
def k8_sample_gains(spark, d):
    """One summary row per sample."""
    f = V.fragments(spark, d)
    log = F.log1p(F.col("count").cast("double"))
    return f.groupBy("sample").agg(r4(F.sum(F.when(F.col("mapq") >= 20, F.col("count")).otherwise(0)) / F.sum("count")).alias("kept_share"), r4(F.avg(log)).alias("mean_log"), r4(F.stddev_samp(log)).alias("sd_log"), F.count(F.lit(1)).alias("reads"))


@query(f"WITH {REGIONS} SELECT contig, count(*) AS intervals, CAST(sum(e - s) AS BIGINT) AS bp, max(e - s) AS longest FROM regions GROUP BY contig")
def s11_interval_summary(spark, d):
    n = F.col("end") - F.col("start")
    return V.regions(spark, d).groupBy("contig").agg(F.count(F.lit(1)).alias("intervals"), F.sum(n).alias("bp"), F.max(n).alias("longest"))


@query("WITH g AS (SELECT p_brand AS genome, p_size * 10 AS read_length, CAST(round(sum(p_retailprice)) AS BIGINT) AS size FROM part GROUP BY ALL), r AS (SELECT DISTINCT p_brand AS genome, l AS want FROM part, (SELECT unnest([36, 101, 250]) AS l)), d AS (SELECT r.genome, want, read_length, size, row_number() OVER (PARTITION BY r.genome, want ORDER BY abs(read_length - want), read_length) AS k FROM r JOIN g USING (genome)) SELECT genome, want, read_length, size FROM d WHERE k = 1")
def s13_effective_genome_size(spark, d):
    """Size by genome and the read length nearest to the wanted one (the smaller of two)."""
    p = spark.read.parquet(f"{d}/part.parquet")
    g = p.groupBy(F.col("p_brand").alias("genome"), (F.col("p_size") * 10).alias("read_length")).agg(F.round(F.sum("p_retailprice")).cast("long").alias("size"))
    w = g.withColumn("want", F.explode(F.array(*(F.lit(x) for x in (36, 101, 250)))))
    best = F.min_by(F.struct("read_length", "size"), F.struct(F.abs(F.col("read_length") - F.col("want")), "read_length")).alias("b")
    return w.groupBy("genome", "want").agg(best).select("genome", "want", "b.read_length", "b.size")


# ---- state models ---------------------------------------------------------------------------------------------------
@query()
def r2_level_trend_smoother(spark, d):
    """Level and slope of the pooled signal; tests hold it against a dense solution."""
    w = 1 / (1 + F.col("raw"))
    cells = V.tracks(spark, d).groupBy("contig", "bin").agg(F.sum(w).alias("info"), F.sum(F.col("x") * w).alias("weighted"))
    return trend.smooth_level_trend(cells, 0.05, 0.01).select("contig", "bin", r4("level").alias("level"), r4("trend").alias("trend"), r4("variance").alias("variance"))


@query()
def r3_robust_level(spark, d):
    """Level under Student-t precision multipliers; tests hold it against a dense iteration."""
    cells = V.tracks(spark, d).select("contig", "bin", "sample", "x", (0.2 + 1 / (1 + F.col("raw"))).alias("r"))
    return trend.robust_level(cells, 0.05, rounds=2).select("contig", "bin", r4("level").alias("level"), r4("variance").alias("variance"))


@query()
def r6_budgeted_runs(spark, d):
    """Runs under a budget of a tenth of a contig's bins: the penalty is searched, the selection exact for it."""
    picked = trend.budgeted_runs(V.mean_track(spark, d).select("contig", "bin", F.col("x").alias("score")), 0.1, 0.3).filter("selected")
    found = intervals.runs(picked.select("contig", "bin"))
    return found.select("contig", (F.col("first_bin") * WIDTH).alias("start"), ((F.col("last_bin") + 1) * WIDTH).alias("end"))


# ---- variance model -------------------------------------------------------------------------------------------------
def _variance_blocks(spark, d):
    return V.tracks(spark, d).groupBy("sample", "contig", F.floor(F.col("bin") / 8).alias("block")).agg(F.avg("raw").alias("m"), F.var_samp("raw").alias("v"), F.count(F.lit(1)).alias("k")).filter("k >= 4 AND v > 0")


@query()
def m1_p23_variance_trend(spark, d):
    """Log-variance trend of the blocks of all samples, evaluated at every block; tests hold the fit against a dense one."""
    b = _variance_blocks(spark, d)
    trend_ = variance.fit_trend(b, "m", "v", F.col("k"))
    return b.select("sample", "contig", "block", r4(trend_.log_variance(expr.signed_log1p(F.col("m")))).alias("log_v"))


@query()
def m4_m5_sample_variance(spark, d):
    """Pooled trend as the prior, its strength from the blocks, and each block's variance drawn to it."""
    b = _variance_blocks(spark, d)
    trend_ = variance.fit_trend(b, "m", "v", F.col("k"))
    prior = F.exp(trend_.log_variance(expr.signed_log1p(F.col("m"))))
    nu = variance.prior_strength(b, "v", prior, 7.0)
    blended = expr.eb_blend(F.col("v"), prior, 7.0, nu, F.lit(0.05), 0.01, 1e4)
    return b.select("sample", "contig", "block", F.round(F.lit(nu), 3).alias("nu_prior"), r4(blended).alias("variance"))


# ---- peaks and spans ------------------------------------------------------------------------------------------------
_LEVELS = f"{TRACKS}, {MEAN}, lt AS (SELECT CAST(z AS DOUBLE) AS z, contig, bin, x FROM mean_track, (SELECT unnest([5.0, 5.1, 5.2]) AS z) WHERE x > z), lg AS (SELECT *, CASE WHEN bin - lag(bin) OVER (PARTITION BY z, contig ORDER BY bin) = 1 THEN 0 ELSE 1 END AS n FROM lt), li AS (SELECT *, sum(n) OVER (PARTITION BY z, contig ORDER BY bin) AS k FROM lg), seg AS (SELECT z, contig, min(bin) AS a, max(bin) AS b, sum(x - z) AS score FROM li GROUP BY z, contig, k)"


@query(f"WITH {_LEVELS} SELECT p.contig, p.a AS first_bin, p.b AS last_bin, count(c.z) AS candidates, round(max(c.score), 4) AS best FROM seg p LEFT JOIN seg c ON c.contig = p.contig AND c.a = p.a AND c.b = p.b AND c.z <> p.z WHERE p.z = 5.1 GROUP BY ALL")
def j14_span_lookup(spark, d):
    """Candidate scores of a peak by its exact span: an equi-join on contig, first and last bin."""
    t = V.mean_track(spark, d).withColumn("z", F.explode(F.array(*(F.lit(x) for x in (5.0, 5.1, 5.2))))).filter("x > z")
    t = t.select(F.concat_ws("|", F.col("z").cast("string"), "contig").alias("contig"), F.col("contig").alias("name"), "z", "bin", (F.col("x") - F.col("z")).alias("excess"))
    seg = intervals.runs(t, 0, (F.first("z").alias("z"), F.first("name").alias("name"), F.sum("excess").alias("score"))).drop("contig").withColumnRenamed("name", "contig")
    span = ["contig", "first_bin", "last_bin"]
    c = seg.filter("z <> 5.1").select(*span, F.col("score").alias("s"))
    return seg.filter("z = 5.1").select(*span).join(c, span, "left").groupBy(*span).agg(F.count("s").alias("candidates"), r4(F.max("s")).alias("best"))


@query(f"WITH {_PEAKS}, c AS (SELECT pk.contig, a, b, summit, bin, x > 0.985 * top AS ok FROM pk JOIN mean_track m ON pk.contig = m.contig AND m.bin BETWEEN a AND b) SELECT contig, a AS peak, coalesce(max(CASE WHEN NOT ok AND bin < summit THEN bin + 1 END), a) AS first_bin, coalesce(min(CASE WHEN NOT ok AND bin > summit THEN bin - 1 END), b) AS last_bin FROM c GROUP BY contig, a, b")
def p29_trimmed_peaks(spark, d):
    """The part of a peak around its summit where the score stays above a floor: the nearest cells below it on both sides."""
    p = _peaks(spark, d).select("contig", "a", "b", "summit", "top", F.explode(F.sequence("a", "b")).alias("bin"))
    c = p.join(V.mean_track(spark, d), ["contig", "bin"]).withColumn("low", F.col("x") <= 0.985 * F.col("top"))
    left = F.max(F.when(F.col("low") & (F.col("bin") < F.col("summit")), F.col("bin") + 1))
    right = F.min(F.when(F.col("low") & (F.col("bin") > F.col("summit")), F.col("bin") - 1))
    return c.groupBy("contig", "a", "b").agg(left.alias("l"), right.alias("r")).select("contig", F.col("a").alias("peak"), F.coalesce("l", "a").alias("first_bin"), F.coalesce("r", "b").alias("last_bin"))


@query(f"WITH {FRAGMENTS}, {REGIONS}, every AS (SELECT contig, s, e FROM regions UNION ALL SELECT contig, s, e FROM fragments), o AS (SELECT *, max(e) OVER (PARTITION BY contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM every), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT contig, min(s) AS start, max(e) AS \"end\" FROM g GROUP BY contig, k")
def u1_merged_sources(spark, d):
    """The regions of two sources in one union, merged."""
    both = V.regions(spark, d).unionByName(V.fragments(spark, d).select("contig", "start", "end"))
    return intervals.merge_intervals(both)


@query(f"WITH {_DRAWS}, s AS (SELECT contig, stddev_pop(v) AS s FROM nul GROUP BY contig), o AS (SELECT draw, z, count(*) FILTER (WHERE v > z * s) / CAST(count(*) AS DOUBLE) AS occ FROM nul JOIN s USING (contig), (SELECT unnest([1.0, 1.5, 2.0]) AS z) GROUP BY ALL) SELECT CAST(z AS DOUBLE) AS z, round(quantile_cont(occ, 0.9), 4) AS floor FROM o GROUP BY z")
def m19_pooled_null_floor(spark, d):
    """Null occupancy per threshold over all contigs pooled."""
    n = _draws(spark, d)
    s = n.groupBy("contig").agg(F.stddev_pop("null").alias("s"))
    v = n.join(s, "contig").withColumn("z", F.explode(F.array(*(F.lit(x) for x in (1.0, 1.5, 2.0)))))
    o = v.groupBy("draw", "z").agg((F.count_if(F.col("null") > F.col("z") * F.col("s")) / F.count(F.lit(1))).alias("occ"))
    return o.groupBy("z").agg(r4(F.percentile("occ", 0.9)).alias("floor"))  # one row per draw


@query(f"WITH {TRACKS}, {MEAN}, n AS (SELECT contig, count(*) AS n FROM mean_track GROUP BY contig), w AS (SELECT contig, n, unnest([25, 60, 133, 400]) AS bp FROM n) SELECT contig, bp, least(greatest(least(40, greatest((n + 3) // 4, 5)), 5), n) AS block, CASE WHEN greatest(3, CAST(ceil(bp / {WIDTH}.0) AS BIGINT)) % 2 = 0 THEN greatest(3, CAST(ceil(bp / {WIDTH}.0) AS BIGINT)) + 1 ELSE greatest(3, CAST(ceil(bp / {WIDTH}.0) AS BIGINT)) END AS bins FROM w")
def a27_p35_block_lengths(spark, d):
    """Hold-out block length and odd windows in bins, from base pairs and the contig's number of bins."""
    n = V.mean_track(spark, d).groupBy("contig").agg(F.count(F.lit(1)).alias("n"))
    w = n.withColumn("bp", F.explode(F.array(*(F.lit(x) for x in (25, 60, 133, 400)))))
    return w.select("contig", "bp", models.block_length(F.col("n"), WIDTH, 400, 12, 4, 5).alias("block"), models.odd_bins(F.col("bp"), WIDTH).alias("bins"))


@query("WITH f AS (SELECT c_nationkey AS run, c_custkey % 6 AS pass, CAST(round(sum(c_acctbal), 2) AS DOUBLE) AS f FROM customer GROUP BY ALL), e AS (SELECT *, first_value(f) OVER w AS f0, last_value(f) OVER w AS f1 FROM f WINDOW w AS (PARTITION BY run ORDER BY pass ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT run, pass, round(f, 2) AS objective, round(CASE WHEN abs(f0 - f1) <= 1e-12 THEN 0 ELSE (f - f1) / (f0 - f1) END, 4) AS gap FROM e")
def a49_convergence_paths(spark, d):
    """Nested diagnostics of runs flattened to a row per pass, with the remaining share of the first gap."""
    c = spark.read.parquet(f"{d}/customer.parquet").groupBy(F.col("c_nationkey").alias("run"), (F.col("c_custkey") % 6).alias("pass")).agg(F.round(F.sum("c_acctbal"), 2).cast("double").alias("f"))
    nested = c.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("pass", "f"))).alias("path"))  # a handful of passes
    rows = nested.select("run", F.explode(F.arrays_zip("path", models.remaining_gap(F.col("path.f")).alias("gap"))).alias("p"))
    return rows.select("run", "p.path.pass", F.round("p.path.f", 2).alias("objective"), r4("p.gap").alias("gap"))
