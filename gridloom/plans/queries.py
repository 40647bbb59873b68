"""Registered queries over the interval views, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import expr
from gridloom.operators import counting, intervals, scan, statistics, tiles
from gridloom.plans import views as V
from gridloom.plans.views import CONTIGS, EVENTS, FRAGMENTS, HOURS, MEAN, REGIONS, TRACKS, WIDTH
from gridloom.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r4(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 4)


# ---- counting -------------------------------------------------------------------------------------------------------
_HITS = f"hits AS (SELECT *, unnest(range(s // {WIDTH}, (e - 1) // {WIDTH} + 1)) AS bin FROM fragments)"


@query(f"WITH {FRAGMENTS}, {_HITS} SELECT contig, sample, bin, CAST(sum(c) AS DOUBLE) AS value FROM hits GROUP BY ALL")
def a1_coverage_counts(spark, d):
    return counting.count_bins(V.fragments(spark, d), WIDTH, "coverage").select("contig", "sample", "bin", "value")


@query(f"WITH {FRAGMENTS}, {_HITS}, w AS (SELECT *, (least(e, (bin + 1) * {WIDTH}) - greatest(s, bin * {WIDTH})) / CAST(e - s AS DOUBLE) AS w FROM hits) SELECT contig, sample, bin, round(sum(c * w), 4) AS value, round(sum(c * w * w), 4) AS noise_mass FROM w GROUP BY ALL")
def a2_fractional_counts(spark, d):
    return counting.count_bins(V.fragments(spark, d), WIDTH, "fractional").select("contig", "sample", "bin", r4("value").alias("value"), r4("noise_mass").alias("noise_mass"))


@query(f"WITH {FRAGMENTS}, ends AS (SELECT contig, sample, c, s // {WIDTH} AS bin, CASE WHEN s // {WIDTH} = (e - 1) // {WIDTH} THEN 2 ELSE 1 END AS k FROM fragments UNION ALL SELECT contig, sample, c, (e - 1) // {WIDTH}, 1 FROM fragments WHERE s // {WIDTH} <> (e - 1) // {WIDTH}) SELECT contig, sample, bin, CAST(sum(c * k) AS DOUBLE) AS value, CAST(sum(c * k * k) AS DOUBLE) AS noise_mass FROM ends GROUP BY ALL")
def a3_endpoint_counts(spark, d):
    return counting.count_bins(V.fragments(spark, d), WIDTH, "endpoints")


@query(f"WITH {FRAGMENTS} SELECT contig, sample, ((s + e) // 2) // {WIDTH} AS bin, CAST(sum(c) AS DOUBLE) AS value FROM fragments GROUP BY ALL")
def a4_center_counts(spark, d):
    return counting.count_bins(V.fragments(spark, d), WIDTH, "center").select("contig", "sample", "bin", "value")


@query(f"WITH {FRAGMENTS} SELECT contig, (CASE WHEN flag & 16 = 0 THEN s ELSE e - 1 END) // {WIDTH} AS bin, count(*) AS n FROM fragments WHERE mapq >= 20 AND e - s BETWEEN 5 AND 40 AND flag & 3844 = 0 GROUP BY ALL")
def a5_five_prime_counts(spark, d):
    f = V.fragments(spark, d).filter(expr.keep_read(F.col("flag"), F.col("mapq"), F.col("end") - F.col("start"), shortest=5, longest=40))
    return f.groupBy("contig", F.floor(expr.five_prime(F.col("flag"), F.col("start"), F.col("end")) / WIDTH).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EVENTS}, h AS (SELECT *, unnest(range(s // {HOURS}, (e - 1) // {HOURS} + 1)) AS bin FROM ev), w AS (SELECT *, least(e, (bin + 1) * {HOURS}) - greatest(s, bin * {HOURS}) AS w FROM h) SELECT contig, sample, bin, round(sum(value * w) / sum(w) + 1e-9, 4) AS value FROM w GROUP BY ALL")
def a6_signal_means(spark, d):
    return counting.mean_signal_bins(V.events(spark, d), HOURS).select("contig", "sample", "bin", r4(F.col("value") + 1e-9).alias("value"))


@query(f"WITH {FRAGMENTS} SELECT contig, min(s) AS lo, max(e) AS hi FROM fragments GROUP BY contig")
def a8_contig_ranges(spark, d):
    return V.fragments(spark, d).groupBy("contig").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))


@query(f"WITH {FRAGMENTS} SELECT sample, CAST(floor(quantile_cont(e - s, 0.5)) AS BIGINT) AS read_length, bool_or(flag & 1 = 1) AS paired FROM fragments GROUP BY sample")
def a9_read_length(spark, d):
    return V.fragments(spark, d).groupBy("sample").agg(F.floor(F.percentile(F.col("end") - F.col("start"), 0.5)).alias("read_length"), F.bool_or(F.col("flag").bitwiseAND(1) == 1).alias("paired"))


@query(f"WITH {FRAGMENTS} SELECT sample, CAST(sum(c) AS BIGINT) AS units, CAST(sum(CASE WHEN mapq >= 20 THEN c ELSE 0 END) AS BIGINT) AS passing, CAST(sum(e - s) AS BIGINT) AS spanned FROM fragments GROUP BY sample")
def a10_mapped_units(spark, d):
    return V.fragments(spark, d).groupBy("sample").agg(F.sum("count").alias("units"), F.sum(F.when(F.col("mapq") >= 20, F.col("count")).otherwise(0)).alias("passing"), F.sum(F.col("end") - F.col("start")).alias("spanned"))


@query(f"WITH {FRAGMENTS} SELECT sample, count(DISTINCT barcode) AS cells FROM fragments GROUP BY sample")
def a11_cell_counts(spark, d):
    return V.fragments(spark, d).groupBy("sample").agg(F.countDistinct("barcode").alias("cells"))


@query(f"WITH {FRAGMENTS} SELECT sample, round(1e6 / sum(c), 5) AS cpm, round(1e9 / (sum(c) * {WIDTH}), 5) AS rpkm FROM fragments GROUP BY sample")
def a14_scale_per_million(spark, d):
    n = F.sum("count")
    return V.fragments(spark, d).groupBy("sample").agg(F.round(1e6 / n, 5).alias("cpm"), F.round(1e9 / (n * WIDTH), 5).alias("rpkm"))


@query(f"WITH {FRAGMENTS}, {CONTIGS}, g AS (SELECT sum(size) AS genome FROM contigs WHERE contig <> 'RO') SELECT sample, round((SELECT genome FROM g) / CAST(sum(e - s) AS DOUBLE), 6) AS one_x FROM fragments WHERE contig <> 'RO' GROUP BY sample")
def a15_one_x_scale(spark, d):
    f = V.fragments(spark, d).filter("contig <> 'RO'")
    genome = f.groupBy("contig").agg(F.max("end").alias("size")).agg(F.sum("size").alias("genome"))
    return f.groupBy("sample").agg(F.sum(F.col("end") - F.col("start")).alias("span")).join(F.broadcast(genome), F.lit(True)).select("sample", F.round(F.col("genome") / F.col("span"), 6).alias("one_x"))


@query(f"WITH {FRAGMENTS}, n AS (SELECT sample, sum(CASE WHEN control THEN 0 ELSE c END) AS t, sum(CASE WHEN control THEN c ELSE 0 END) AS k FROM fragments GROUP BY sample) SELECT sample, round(least(1.0, k / CAST(t AS DOUBLE)), 6) AS treatment_scale, round(least(1.0, t / CAST(k AS DOUBLE)), 6) AS control_scale FROM n")
def a16_pair_scales(spark, d):
    n = V.fragments(spark, d).groupBy("sample").agg(F.sum(F.when(F.col("control"), 0).otherwise(F.col("count"))).alias("t"), F.sum(F.when(F.col("control"), F.col("count")).otherwise(0)).alias("k"))
    return n.select("sample", F.round(F.least(F.lit(1.0), F.col("k") / F.col("t")), 6).alias("treatment_scale"), F.round(F.least(F.lit(1.0), F.col("t") / F.col("k")), 6).alias("control_scale"))


@query(f"WITH {TRACKS}, l AS (SELECT contig, bin, list_sort(list(x)) AS v FROM tracks GROUP BY ALL) SELECT contig, bin, round(list_sum(list_slice(v, 2, len(v) - 1)) / (len(v) - 2), 4) AS level FROM l")
def a18_trimmed_mean(spark, d):
    return V.tracks(spark, d).groupBy("contig", "bin").agg(F.collect_list("x").alias("v")).select("contig", "bin", r4(counting.trimmed_mean(F.col("v"), 0.25)).alias("level"))


@query("WITH v AS (SELECT c_mktsegment AS segment, c_acctbal AS v, greatest(c_acctbal, 0.01) AS w FROM customer), c AS (SELECT segment, v, sum(w) OVER (PARTITION BY segment ORDER BY v) AS cum, sum(w) OVER (PARTITION BY segment) AS total FROM v) SELECT segment, min(v) AS quantile FROM c WHERE cum >= 0.5 * total - 1e-9 GROUP BY segment")
def a19_weighted_quantile(spark, d):
    v = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("v"), F.greatest("c_acctbal", F.lit(0.01)).alias("w"))
    return statistics.weighted_quantile(v, ["segment"], "v", "w", 0.5)


@query(f"WITH {TRACKS} SELECT contig, bin, round(sum(1 / (1 + raw)), 4) AS info, round(sum(x / (1 + raw)), 4) AS weighted, count(*) FILTER (WHERE raw > 0) AS support FROM tracks GROUP BY ALL")
def a21_sufficient_stats(spark, d):
    w = 1 / (1 + F.col("raw"))
    return V.tracks(spark, d).groupBy("contig", "bin").agg(r4(F.sum(w)).alias("info"), r4(F.sum(F.col("x") * w)).alias("weighted"), F.count_if(F.col("raw") > 0).alias("support"))


@query(f"WITH {TRACKS}, s AS (SELECT contig, bin, sum(1 / (1 + raw)) AS w, sum(sqrt(1 / (1 + raw))) AS r FROM tracks GROUP BY ALL) SELECT contig, bin, round(w - 0.1 * (r * r - w) / (1 + 0.1 * 3), 4) AS info FROM s")
def a22_exchangeable_information(spark, d):
    s = V.tracks(spark, d).groupBy("contig", "bin").agg(F.sum(1 / (1 + F.col("raw"))).alias("w"), F.sum(F.sqrt(1 / (1 + F.col("raw")))).alias("r"))
    return s.select("contig", "bin", r4(F.col("w") - 0.1 * (F.col("r") * F.col("r") - F.col("w")) / (1 + 0.1 * 3)).alias("info"))


@query("WITH s AS (SELECT c_mktsegment AS stratum, (c_acctbal - 4500) / 1000 AS r, 2.0 AS sd FROM customer), t AS (SELECT * FROM s, (VALUES (0.5, 0.67449), (0.8, 1.28155), (0.95, 1.95996)) AS z(target, z)) SELECT stratum, CAST(target AS DOUBLE) AS target, round(avg(CASE WHEN abs(r) <= z * sd THEN 1.0 ELSE 0.0 END), 4) AS coverage, round(avg(2 * z * sd), 4) AS width FROM t GROUP BY GROUPING SETS ((stratum, target), (target))")
def a24_coverage_table(spark, d):
    s = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_mktsegment").alias("stratum"), ((F.col("c_acctbal") - 4500) / 1000).alias("r"), F.lit(2.0).alias("sd"))
    z = F.array(*(F.struct(F.lit(t).alias("target"), F.lit(v).alias("z")) for t, v in ((0.5, 0.67449), (0.8, 1.28155), (0.95, 1.95996))))
    t = s.select("*", F.explode(z).alias("z")).select("stratum", "r", "sd", "z.*")
    agg = (r4(F.avg((F.abs("r") <= F.col("z") * F.col("sd")).cast("double"))).alias("coverage"), r4(F.avg(2 * F.col("z") * F.col("sd"))).alias("width"))
    return t.groupBy("stratum", "target").agg(*agg).unionByName(t.groupBy("target").agg(*agg).withColumn("stratum", F.lit(None).cast("string")))


@query(f"WITH {TRACKS}, {MEAN}, b AS (SELECT contig, bin // 25 AS block, abs(x - lag(x) OVER (PARTITION BY contig, bin // 25 ORDER BY bin)) AS dx, x FROM mean_track) SELECT contig, block, round(avg(dx), 4) AS roughness, round(avg(x), 4) AS signal FROM b GROUP BY ALL")
def a25_roughness(spark, d):
    w = Window.partitionBy("contig", "block").orderBy("bin")
    b = V.mean_track(spark, d).withColumn("block", F.floor(F.col("bin") / 25)).withColumn("dx", F.abs(F.col("x") - F.lag("x").over(w)))
    return b.groupBy("contig", "block").agg(r4(F.avg("dx")).alias("roughness"), r4(F.avg("x")).alias("signal"))


@query(f"WITH {TRACKS}, b AS (SELECT contig, sample, bin // 25 AS block, x, 1 / (1 + raw) AS q FROM tracks) SELECT contig, block, sample, round(sum(q * x) / sum(q), 4) AS mean, round(sum(q * x * x) / sum(q) - (sum(q * x) / sum(q)) * (sum(q * x) / sum(q)), 3) AS var, round(sum(q) * sum(q) / sum(q * q), 4) AS support FROM b GROUP BY ALL")
def a30_block_moments(spark, d):
    b = V.tracks(spark, d).select("contig", "sample", F.floor(F.col("bin") / 25).alias("block"), "x", (1 / (1 + F.col("raw"))).alias("q"))
    q, m = F.sum("q"), F.sum(F.col("q") * F.col("x")) / F.sum("q")
    return b.groupBy("contig", "block", "sample").agg(r4(m).alias("mean"), F.round(F.sum(F.col("q") * F.col("x") * F.col("x")) / q - m * m, 3).alias("var"), r4(q * q / F.sum(F.col("q") * F.col("q"))).alias("support"))


@query(f"WITH {TRACKS} SELECT sample, count(*) AS n, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS sd, round(quantile_cont(x, 0.05), 4) AS q05, round(quantile_cont(x, 0.5), 4) AS q50, round(quantile_cont(x, 0.95), 4) AS q95, round(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END), 4) AS positive FROM tracks GROUP BY sample")
def a32_a33_track_summary(spark, d):
    t = V.tracks(spark, d)
    q = statistics.quantiles(t, ["sample"], "x", {"q05": 0.05, "q50": 0.5, "q95": 0.95})
    m = t.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), r4(F.avg("x")).alias("mean"), r4(F.stddev_pop("x")).alias("sd"), r4(F.avg((F.col("x") > 0).cast("double"))).alias("positive"))
    return m.join(q, "sample").select("sample", "n", "mean", "sd", *(r4(c).alias(c) for c in ("q05", "q50", "q95")), "positive")


@query(f"WITH {TRACKS}, {MEAN}, s AS (SELECT contig, sign(x - 3) AS g, lag(sign(x - 3)) OVER (PARTITION BY contig ORDER BY bin) AS p FROM mean_track) SELECT contig, count(*) FILTER (WHERE g * p < 0) AS changes, round(count(*) FILTER (WHERE g * p < 0) * 1000.0 / (count(*) * {WIDTH}), 4) AS per_kb FROM s GROUP BY contig")
def a39_sign_changes(spark, d):
    s = scan.previous(V.mean_track(spark, d).withColumn("g", F.signum(F.col("x") - 3)), ["contig"], "bin", ["g"])
    n = F.count_if(F.col("g") * F.col("prev_g") < 0)
    return s.groupBy("contig").agg(n.alias("changes"), r4(n * 1000.0 / (F.count(F.lit(1)) * WIDTH)).alias("per_kb"))


@query(f"WITH {TRACKS}, b AS (SELECT contig, sample, bin // 25 AS block, avg(x) AS m FROM tracks GROUP BY ALL) SELECT a.sample AS sample_a, b.sample AS sample_b, count(*) AS blocks, count(*) FILTER (WHERE a.m > b.m) AS above, round(atanh(least(0.999999, corr(a.m, b.m))), 3) AS z FROM b a JOIN b ON a.contig = b.contig AND a.block = b.block AND a.sample < b.sample GROUP BY ALL")
def a40_a42_j13_sample_pairs(spark, d):
    b = V.tracks(spark, d).groupBy("contig", "sample", F.floor(F.col("bin") / 25).alias("block")).agg(F.avg("x").alias("m"))
    x, y = b.select("contig", "block", F.col("sample").alias("sample_a"), F.col("m").alias("ma")), b.select("contig", "block", F.col("sample").alias("sample_b"), F.col("m").alias("mb"))
    p = x.join(y, ["contig", "block"]).filter("sample_a < sample_b")
    return p.groupBy("sample_a", "sample_b").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("ma") > F.col("mb")).alias("above"), F.round(F.atanh(F.least(F.lit(0.999999), F.corr("ma", "mb"))), 3).alias("z"))


@query(f"WITH {TRACKS}, m AS (SELECT sample, quantile_cont(x, 0.5) AS med FROM tracks GROUP BY sample), a AS (SELECT t.sample, abs(x - med) AS dev, x FROM tracks t JOIN m USING (sample)) SELECT sample, round(1.4826 * quantile_cont(dev, 0.5), 4) AS mad, round((quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.349, 4) AS iqr, round(stddev_samp(x), 4) AS sd FROM a GROUP BY sample")
def a43_robust_scale(spark, d):
    t = V.tracks(spark, d)
    q = statistics.quantiles(t, ["sample"], "x", {"med": 0.5, "q25": 0.25, "q75": 0.75})
    dev = statistics.quantiles(t.join(q, "sample").withColumn("dev", F.abs(F.col("x") - F.col("med"))), ["sample"], "dev", {"mad": 0.5})
    return t.groupBy("sample").agg(r4(F.stddev_samp("x")).alias("sd")).join(q, "sample").join(dev, "sample").select("sample", r4(1.4826 * F.col("mad")).alias("mad"), r4((F.col("q75") - F.col("q25")) / 1.349).alias("iqr"), "sd")


@query("SELECT CAST(floor(log2(o_totalprice)) AS BIGINT) AS cell, count(*) AS n FROM orders WHERE o_totalprice > 0 GROUP BY 1")
def a48_geometric_histogram(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").filter("o_totalprice > 0").groupBy(F.floor(F.log2("o_totalprice")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


# ---- joins ----------------------------------------------------------------------------------------------------------
@query(f"WITH {FRAGMENTS}, allow AS (SELECT CAST(p_partkey AS VARCHAR) AS barcode FROM part WHERE p_size <= 25) SELECT contig, count(*) AS n FROM fragments SEMI JOIN allow USING (barcode) GROUP BY contig")
def j1_allow_list(spark, d):
    return V.fragments(spark, d).join(V.allow(spark, d), "barcode", "left_semi").groupBy("contig").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FRAGMENTS}, g AS (SELECT CAST(p_partkey AS VARCHAR) AS barcode, p_brand AS grp FROM part WHERE p_size <= 25 AND p_brand LIKE 'Brand#1%') SELECT grp, contig, CAST(sum(c) AS BIGINT) AS units FROM fragments JOIN g USING (barcode) GROUP BY ALL")
def j2_u2_barcode_groups(spark, d):
    chosen = V.groups(spark, d).filter("grp LIKE 'Brand#1%'").join(V.allow(spark, d), "barcode", "left_semi")
    return V.fragments(spark, d).join(chosen, "barcode").groupBy("grp", "contig").agg(F.sum("count").alias("units"))


@query(f"WITH {FRAGMENTS}, {REGIONS}, bins AS (SELECT DISTINCT contig, ((s + e) // 2) // {WIDTH} AS bin FROM fragments) SELECT contig, bin, EXISTS (SELECT 1 FROM regions r WHERE r.contig = b.contig AND r.s < (b.bin + 1) * {WIDTH} AND r.e > b.bin * {WIDTH}) AS masked FROM bins b")
def j3_j4_masked_bins(spark, d):
    bins = V.fragments(spark, d).select("contig", F.floor(F.floor((F.col("start") + F.col("end")) / 2) / WIDTH).alias("bin")).distinct()
    return intervals.masked_bins(bins, V.regions(spark, d), WIDTH)


_PAIRS = f"{FRAGMENTS}, {_HITS}, v AS (SELECT contig, sample, bin, control, sum(c * (least(e, (bin + 1) * {WIDTH}) - greatest(s, bin * {WIDTH})) / CAST(e - s AS DOUBLE)) AS v FROM hits GROUP BY ALL)"


@query(f"WITH {_PAIRS} SELECT contig, sample, bin, round(log2((coalesce(t.v, 0) + 1) / (coalesce(k.v, 0) + 1)), 4) AS ratio FROM (SELECT * FROM v WHERE NOT control) t FULL JOIN (SELECT * FROM v WHERE control) k USING (contig, sample, bin)")
def j5_p6_treatment_control(spark, d):
    v = counting.count_bins(V.fragments(spark, d), WIDTH, keys=("contig", "sample", "control"))
    side = lambda yes: v.filter(F.col("control") == yes).select("contig", "sample", "bin", F.col("value").alias("k" if yes else "t"))
    both = side(False).join(side(True), ["contig", "sample", "bin"], "full")
    return both.select("contig", "sample", "bin", r4(expr.log_ratio(F.coalesce("t", F.lit(0.0)), F.coalesce("k", F.lit(0.0)))).alias("ratio"))


@query(f"WITH {TRACKS}, {MEAN} SELECT contig, bin // 4 AS bin, round(avg(x), 4) AS value FROM mean_track GROUP BY contig, bin // 4")
def j7_rebinned_covariate(spark, d):
    return V.mean_track(spark, d).groupBy("contig", F.floor(F.col("bin") / 4).alias("bin")).agg(r4(F.avg("x")).alias("value"))


@query(f"WITH {FRAGMENTS}, {REGIONS} SELECT contig, s AS start, e AS \"end\", barcode FROM fragments f WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.contig = f.contig AND r.s < f.e AND r.e > f.s) GROUP BY ALL")
def j8_x7_blacklist_filter(spark, d):
    f = V.fragments(spark, d).select("contig", "start", "end", "barcode").distinct()
    return intervals.range_join(f, V.regions(spark, d), 64, "left_anti")


@query(f"WITH {FRAGMENTS}, {REGIONS}, d AS (SELECT DISTINCT contig, s, e FROM regions), p AS (SELECT DISTINCT contig, s, e FROM fragments) SELECT p.contig, p.s AS start, p.e AS \"end\", count(*) AS segments, max(least(p.e, d.e) - greatest(p.s, d.s)) AS best FROM p JOIN d ON p.contig = d.contig AND p.s < d.e AND p.e > d.s GROUP BY ALL")
def j10_overlap_join(spark, d):
    """Peaks with their number of overlapping segments and the largest overlap; only segments in no other one can have that."""
    p, r = V.fragments(spark, d).select("contig", "start", "end").distinct(), V.regions(spark, d).distinct()
    best = intervals.range_join(p, intervals.maximal_intervals(r), 64).groupBy("contig", "start", "end").agg(F.max(F.least("end", "r_end") - F.greatest("start", "r_start")).alias("best"))
    return intervals.overlap_counts(p, r).filter("n > 0").withColumnRenamed("n", "segments").join(best, ["contig", "start", "end"])


@query(f"WITH {FRAGMENTS}, {REGIONS}, m AS (SELECT DISTINCT contig, s, e FROM regions), p AS (SELECT DISTINCT contig, s, s + 1 AS e FROM fragments) SELECT p.contig, p.s AS start, min(m.e - m.s) AS parent_width FROM p JOIN m ON p.contig = m.contig AND m.s <= p.s AND m.e >= p.e GROUP BY ALL")
def j12_smallest_parent(spark, d):
    p = V.fragments(spark, d).select("contig", "start", (F.col("start") + 1).alias("end")).distinct()
    hits = intervals.range_join(p, V.regions(spark, d).distinct(), 64).filter("r_start <= start AND r_end >= end")
    return hits.groupBy("contig", "start").agg(F.min(F.col("r_end") - F.col("r_start")).alias("parent_width"))


@query(f"WITH {FRAGMENTS} SELECT contig, count(*) AS n FROM fragments WHERE contig NOT IN ('RF', 'RO') GROUP BY contig")
def j11_u5_contig_exclusion(spark, d):
    out = spark.read.parquet(f"{d}/lineitem.parquet").filter("l_returnflag = 'R'").select(F.concat("l_returnflag", "l_linestatus").alias("contig")).distinct()
    return V.fragments(spark, d).join(F.broadcast(out), "contig", "left_anti").groupBy("contig").agg(F.count(F.lit(1)).alias("n"))


# ---- windows and runs -----------------------------------------------------------------------------------------------
@query(f"WITH {TRACKS}, {MEAN} SELECT contig, bin, round(sum(x) OVER (PARTITION BY contig ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 4) AS smooth FROM mean_track")
def w1_moving_average(spark, d):
    out = scan.halo_window(V.mean_track(spark, d), ["contig"], "bin", 2, 2, {"s": lambda w: F.sum("x").over(w)})
    return out.select("contig", "bin", r4(F.col("s") / 5).alias("smooth"))


@query(f"WITH {TRACKS}, {MEAN}, c AS (SELECT contig, bin, x - avg(x) OVER (PARTITION BY contig) AS y FROM mean_track), v AS (SELECT contig, sum(y * y) AS v FROM c GROUP BY contig) SELECT a.contig, b.bin - a.bin AS lag, round(sum(a.y * b.y) / any_value(v.v), 4) AS rho FROM c a JOIN c b ON a.contig = b.contig AND b.bin - a.bin BETWEEN 1 AND 8 JOIN v ON v.contig = a.contig GROUP BY 1, 2")
def w5_autocorrelation(spark, d):
    m = V.mean_track(spark, d)
    mean = m.groupBy("contig").agg(F.avg("x").alias("mu"))
    c = m.join(F.broadcast(mean), "contig").select("contig", "bin", (F.col("x") - F.col("mu")).alias("y"))  # one row per contig
    v = c.groupBy("contig").agg(F.sum(F.col("y") * F.col("y")).alias("v"))
    lagged = c.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(8)).cast("array<bigint>"))).select("contig", "lag", (F.col("bin") + F.col("lag")).alias("bin"), F.col("y").alias("y0"))
    s = lagged.join(c, ["contig", "bin"]).groupBy("contig", "lag").agg(F.sum(F.col("y0") * F.col("y")).alias("s"))
    return s.join(F.broadcast(v), "contig").select("contig", "lag", r4(F.col("s") / F.col("v")).alias("rho"))


@query(f"WITH {TRACKS}, {MEAN}, t AS (SELECT contig, bin FROM mean_track WHERE x > 4.5), g AS (SELECT *, CASE WHEN bin - lag(bin) OVER (PARTITION BY contig ORDER BY bin) <= 2 THEN 0 ELSE 1 END AS n FROM t), i AS (SELECT *, sum(n) OVER (PARTITION BY contig ORDER BY bin) AS island FROM g) SELECT contig, min(bin) AS first_bin, max(bin) AS last_bin, count(*) AS bins FROM i GROUP BY contig, island")
def w7_w8_runs(spark, d):
    return intervals.runs(V.mean_track(spark, d).filter("x > 4.5").select("contig", "bin"), 1, (F.count(F.lit(1)).alias("bins"),))


_MERGED = "m AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY contig ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM regions), mi AS (SELECT *, sum(n) OVER (PARTITION BY contig ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m), merged AS (SELECT contig, min(s) AS s, max(e) AS e FROM mi GROUP BY contig, island)"


@query(f"WITH {REGIONS}, {_MERGED} SELECT contig, s AS start, e AS \"end\" FROM merged")
def w9_merged_intervals(spark, d):
    return intervals.merge_intervals(V.regions(spark, d), tile=256)


@query(f"WITH {FRAGMENTS}, {REGIONS}, {CONTIGS}, {_MERGED}, h AS (SELECT m.contig, s, least(e, size) AS e, size, unnest(range(s // 50, (least(e, size) - 1) // 50 + 1)) AS bin FROM merged m JOIN contigs c ON m.contig = c.contig WHERE s < size) SELECT contig, bin, round(sum(least(e, (bin + 1) * 50) - greatest(s, bin * 50)) / CAST(min(least(size, (bin + 1) * 50) - bin * 50) AS DOUBLE), 4) AS fraction FROM h GROUP BY ALL")
def w10_covered_fraction(spark, d):
    return intervals.covered_fraction(V.regions(spark, d), V.contigs(spark, d), 50).select("contig", "bin", r4("fraction").alias("fraction"))


@query(f"WITH {TRACKS}, {MEAN}, w AS (SELECT contig, bin, sum(x) OVER (PARTITION BY contig ORDER BY bin ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS s FROM mean_track) SELECT contig, round(max(s), 4) AS best FROM w GROUP BY contig")
def w12_best_window(spark, d):
    out = scan.halo_window(V.mean_track(spark, d), ["contig"], "bin", 0, 9, {"s": lambda w: F.sum("x").over(w)})
    return out.groupBy("contig").agg(r4(F.max("s")).alias("best"))


@query(f"WITH {TRACKS}, {MEAN} SELECT contig, bin, round(x - lag(x) OVER (PARTITION BY contig ORDER BY bin), 4) AS dx, round(sign(x - 3) * ln(1 + abs(x - 3)), 4) AS logx FROM mean_track")
def w14_p9_p27_features(spark, d):
    m = scan.previous(V.mean_track(spark, d), ["contig"], "bin", ["x"])
    return m.select("contig", "bin", r4(F.col("x") - F.col("prev_x")).alias("dx"), r4(expr.signed_log1p(F.col("x") - 3)).alias("logx"))


@query(f"WITH {TRACKS}, {MEAN}, n AS (SELECT contig, count(*) AS n FROM mean_track GROUP BY contig) SELECT contig, (bin * 8) // n AS segment, count(*) AS bins, round(avg(x), 4) AS level FROM mean_track JOIN n USING (contig) GROUP BY ALL")
def w17_segments(spark, d):
    m = V.mean_track(spark, d)
    n = m.groupBy("contig").agg(F.count(F.lit(1)).alias("n"))
    return m.join(F.broadcast(n), "contig").groupBy("contig", F.floor(F.col("bin") * 8 / F.col("n")).alias("segment")).agg(F.count(F.lit(1)).alias("bins"), r4(F.avg("x")).alias("level"))


# ---- sampling, sets, sinks ------------------------------------------------------------------------------------------
@query(f"WITH {TRACKS}, r AS (SELECT contig, bin, sample, raw, row_number() OVER (PARTITION BY contig, sample ORDER BY raw DESC, bin) AS k FROM tracks) SELECT contig, sample, bin, round(raw, 4) AS raw, CAST(k AS INTEGER) AS k FROM r WHERE k <= 5")
def t2_top_bins(spark, d):
    w = Window.partitionBy("contig", "sample").orderBy(F.desc("raw"), "bin")
    return V.tracks(spark, d).withColumn("k", F.row_number().over(w)).filter("k <= 5").select("contig", "sample", "bin", r4("raw").alias("raw"), "k")


@query(f"WITH {TRACKS}, p AS (SELECT contig, bin % 7 AS phase, count(*) AS n FROM tracks WHERE raw > 20 GROUP BY ALL), b AS (SELECT contig, min(phase) AS phase FROM p WHERE n = (SELECT max(n) FROM p q WHERE q.contig = p.contig) GROUP BY contig) SELECT t.contig, t.sample, t.bin FROM tracks t JOIN b ON t.contig = b.contig AND t.bin % 7 = b.phase WHERE raw > 20")
def t5_thin_by_phase(spark, d):
    t = V.tracks(spark, d).filter("raw > 20").withColumn("phase", F.col("bin") % 7)
    best = t.groupBy("contig", "phase").agg(F.count(F.lit(1)).alias("n")).groupBy("contig").agg(F.max_by("phase", F.struct("n", -F.col("phase"))).alias("phase"))
    return t.join(F.broadcast(best), ["contig", "phase"], "left_semi").select("contig", "sample", "bin")


@query(f"WITH {TRACKS} SELECT sample, contig, bin // 9 AS cell, min(bin) AS bin FROM tracks WHERE raw > 15 GROUP BY ALL")
def t6_first_per_cell(spark, d):
    return V.tracks(spark, d).filter("raw > 15").groupBy("sample", "contig", F.floor(F.col("bin") / 9).alias("cell")).agg(F.min("bin").alias("bin"))


@query(f"WITH {TRACKS}, m AS (SELECT contig, bin, max(CASE WHEN sample = 's0' AND raw > 25 THEN 1 ELSE 0 END) AS a, max(CASE WHEN sample = 's1' AND raw > 25 THEN 1 ELSE 0 END) AS b FROM tracks GROUP BY ALL) SELECT contig, CAST(sum(a * b) AS BIGINT) AS both_sides, CAST(sum(greatest(a, b)) AS BIGINT) AS either, round(sum(a * b) / CAST(nullif(sum(greatest(a, b)), 0) AS DOUBLE), 4) AS jaccard FROM m GROUP BY contig")
def u3_u4_mask_jaccard(spark, d):
    on = lambda s: F.max(((F.col("sample") == s) & (F.col("raw") > 25)).cast("int"))
    m = V.tracks(spark, d).groupBy("contig", "bin").agg(on("s0").alias("a"), on("s1").alias("b"))
    both, either = F.sum(F.col("a") * F.col("b")), F.sum(F.greatest("a", "b"))
    return m.groupBy("contig").agg(both.alias("both_sides"), either.alias("either"), r4(both / F.nullif(either, F.lit(0))).alias("jaccard"))


@query(f"WITH {EVENTS}, z AS (SELECT contig, max(s) AS size FROM ev WHERE contig <> 'c2' GROUP BY contig), b AS (SELECT DISTINCT contig, sample, s, e FROM ev), o AS (SELECT *, lag(e) OVER (PARTITION BY contig, sample ORDER BY s, e) AS p FROM b), v AS (SELECT sample, contig, s, e, CASE WHEN size IS NULL THEN 'unknown contig' WHEN s < 0 OR e <= s THEN 'bounds' WHEN e > size THEN 'beyond contig' WHEN s < p THEN 'overlap' END AS rule FROM o LEFT JOIN z USING (contig)) SELECT sample, contig, s AS start, e AS \"end\", rule FROM v WHERE rule IS NOT NULL")
def k2_k3_track_violations(spark, d):
    """Every sample's track against the rules of a track; sizes are known for two of the contigs."""
    e = V.events(spark, d)
    sizes = e.filter("contig <> 'c2'").groupBy("contig").agg(F.max("start").alias("size"))
    return sinks.track_violations(e.select("sample", "contig", "start", "end").distinct(), sizes, ("sample", "contig"))


@query(f"WITH {TRACKS}, {MEAN} SELECT contig, count(*) AS bins, round(avg(x), 4) AS level, round(max(x), 4) AS top FROM mean_track GROUP BY ROLLUP (contig)")
def k7_run_summary(spark, d):
    return sinks.summary_rows(V.mean_track(spark, d), F.count(F.lit(1)).alias("bins"), r4(F.avg("x")).alias("level"), r4(F.max("x")).alias("top"))


# ---- expressions ----------------------------------------------------------------------------------------------------
@query(f"WITH {TRACKS} SELECT contig, sample, bin, round(2 * sqrt(raw + 0.375), 4) AS anscombe, round(asinh(raw), 4) AS arcsinh, round(ln((raw + sqrt(raw * raw + 1)) / 2), 4) AS glog, round(pow(1 / (ln(2) * (raw + 1.5)), 2) * (raw + 0.5), 4) AS floor_var FROM tracks")
def p5_p7_transforms(spark, d):
    x = F.col("raw")
    t = lambda m: r4(expr.transform_count(x, m)).alias
    return V.tracks(spark, d).select("contig", "sample", "bin", t("anscombe")("anscombe"), t("asinh")("arcsinh"), t("generalizedLog")("glog"), r4(expr.count_floor_log(x, F.lit(1.0), x)).alias("floor_var"))


@query(f"WITH {TRACKS} SELECT contig, sample, bin, round(least(greatest(least(greatest((4 * raw + 10 * 2.0) / 14, 0.1), 50) + 0.5, 0.1), 50), 4) AS blended, round(greatest(raw, 2.5), 4) AS floored FROM tracks")
def p19_p20_blend(spark, d):
    x = F.col("raw")
    blended = expr.eb_blend(x, F.lit(2.0), 4, 10, F.lit(0.5), 0.1, 50.0)
    return V.tracks(spark, d).select("contig", "sample", "bin", r4(blended).alias("blended"), r4(F.greatest(x, F.lit(2.5))).alias("floored"))


@query(f"WITH {TRACKS}, {MEAN}, y AS (SELECT contig, bin, x - 3 AS x FROM mean_track), l AS (SELECT *, ln(0.8) - x * x / 2 / 0.5 - ln(0.5) / 2 AS a, ln(0.2 * 0.7) - x * x / 2 / 1.5 - ln(1.5) / 2 AS b, ln(0.2 * 0.3) - x * x / 2 / 4.5 - ln(4.5) / 2 AS c FROM y) SELECT contig, bin, round((exp(b) * x * 1.0 / 1.5 + exp(c) * x * 4.0 / 4.5) / (exp(a) + exp(b) + exp(c)), 4) AS shrunk FROM l")
def p21_posterior_shrinkage(spark, d):
    return V.mean_track(spark, d).select("contig", "bin", r4(expr.slab_posterior_mean(F.col("x") - 3, F.lit(0.5), 0.8, [(0.7, 1.0), (0.3, 4.0)])).alias("shrunk"))


# ---- testing and peaks ----------------------------------------------------------------------------------------------
_PV = "pv AS (SELECT c_custkey AS k, (rank() OVER (ORDER BY c_acctbal)) / CAST(count(*) OVER () + 1 AS DOUBLE) AS p FROM customer)"


def _pv(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k"), "c_acctbal")
    per = c.groupBy("c_acctbal").agg(F.count(F.lit(1)).alias("_k"), F.lit(1).alias("_all"))
    below = scan.running(per, ["_all"], ["c_acctbal"], F.col("_k"), "_c", position=F.col("c_acctbal"), tile=256)
    n = c.agg(F.count(F.lit(1)).alias("_n"))
    return c.join(below, "c_acctbal").join(F.broadcast(n), F.lit(True)).select("k", ((F.col("_c") - F.col("_k") + 1) / (F.col("_n") + 1)).alias("p"))


@query(f"WITH {_PV}, r AS (SELECT k, p, count(*) OVER (ORDER BY p) AS rk, count(*) OVER () AS n FROM pv) SELECT k, round(least(1.0, min(p * n / rk) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS q FROM r")
def x10_bh_q(spark, d):
    return statistics.benjamini_hochberg(_pv(spark, d), "p").select("k", F.round("q", 6).alias("q"))


@query("WITH o AS (SELECT o_orderkey AS k, o_totalprice AS s FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT o_totalprice AS s FROM orders WHERE o_orderkey % 2 = 1), u AS (SELECT k, s, 0 AS one FROM o UNION ALL SELECT NULL, s, 1 FROM n), c AS (SELECT k, sum(one) OVER (ORDER BY s DESC) AS above, (SELECT count(*) FROM n) AS total FROM u) SELECT k, round((1 + above) / CAST(total + 1 AS DOUBLE), 6) AS p FROM c WHERE k IS NOT NULL")
def x11_empirical_p(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("s"))
    return statistics.empirical_p(o.filter("k % 2 = 0"), o.filter("k % 2 = 1").select("s"), "s").select("k", F.round("p", 6).alias("p"))


_SEG = f"{TRACKS}, {MEAN}, sm AS (SELECT contig, bin, sum(x) OVER (PARTITION BY contig ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3 AS y FROM mean_track), t AS (SELECT *, y - z AS excess FROM sm, (VALUES (3.0), (4.0), (4.5)) AS z(z) WHERE y > z), g AS (SELECT *, CASE WHEN bin - lag(bin) OVER (PARTITION BY contig, z ORDER BY bin) = 1 THEN 0 ELSE 1 END AS n FROM t), i AS (SELECT *, sum(n) OVER (PARTITION BY contig, z ORDER BY bin) AS island FROM g)"


@query(f"WITH {_SEG} SELECT contig, CAST(z AS DOUBLE) AS z, min(bin) AS first_bin, max(bin) AS last_bin, round(sum(excess), 4) AS integrated, round(max(excess), 4) AS top, round(sum(excess) / sqrt(count(*)), 4) AS score FROM i GROUP BY contig, z, island")
def x9_candidate_segments(spark, d):
    s = scan.halo_window(V.mean_track(spark, d), ["contig"], "bin", 1, 1, {"_s": lambda w: F.sum("x").over(w)}).withColumn("y", F.col("_s") / 3)
    t = s.withColumn("z", F.explode(F.array(F.lit(3.0), F.lit(4.0), F.lit(4.5)))).filter("y > z").withColumn("excess", F.col("y") - F.col("z"))
    t = scan.previous(t, ["contig", "z"], "bin", ["bin"]).withColumn("_new", (F.col("prev_bin").isNull() | (F.col("bin") - F.col("prev_bin") > 1)).cast("int"))
    t = scan.running(t, ["contig", "z"], ["bin"], F.col("_new"), "_island")
    return t.groupBy("contig", "z", "_island").agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), r4(F.sum("excess")).alias("integrated"), r4(F.max("excess")).alias("top"), r4(F.sum("excess") / F.sqrt(F.count(F.lit(1)))).alias("score")).drop("_island")


@query(f"WITH RECURSIVE {TRACKS}, cells AS MATERIALIZED (SELECT contig, bin, sum(1 / (1 + raw)) AS i, sum(x / (1 + raw)) AS w FROM tracks GROUP BY ALL), f AS MATERIALIZED (SELECT contig, bin, w / (1 / (1e6 + 0.05) + i) AS m, 1 / (1 / (1e6 + 0.05) + i) AS p FROM cells WHERE bin = 0 UNION ALL SELECT c.contig, c.bin, (f.m / (f.p + 0.05) + c.w) / (1 / (f.p + 0.05) + c.i), 1 / (1 / (f.p + 0.05) + c.i) FROM f JOIN cells c ON c.contig = f.contig AND c.bin = f.bin + 1), n AS (SELECT contig, max(bin) AS n FROM cells GROUP BY contig), b AS (SELECT f.contig, f.bin, m AS x, p AS v FROM f JOIN n ON f.contig = n.contig AND f.bin = n.n UNION ALL SELECT f.contig, f.bin, f.m + f.p / (f.p + 0.05) * (b.x - f.m), f.p + power(f.p / (f.p + 0.05), 2) * (b.v - f.p - 0.05) FROM b JOIN f ON f.contig = b.contig AND f.bin = b.bin - 1) SELECT contig, bin, round(x, 4) AS level, round(v, 4) AS variance FROM b")
def r1_level_smoother(spark, d):
    w = 1 / (1 + F.col("raw"))
    cells = V.tracks(spark, d).groupBy("contig", "bin").agg(F.sum(w).alias("info"), F.sum(F.col("x") * w).alias("weighted"))
    return tiles.smooth_level(cells, 0.05).select("contig", "bin", r4("level").alias("level"), r4("variance").alias("variance"))


@query()
def r6_x2_selected_peaks(spark, d):
    picked = tiles.select_runs(V.mean_track(spark, d).select("contig", "bin", F.col("x").alias("score")), 4.0, 1.0).filter("selected")
    found = intervals.runs(picked.select("contig", "bin"))
    return found.select("contig", (F.col("first_bin") * WIDTH).alias("start"), ((F.col("last_bin") + 1) * WIDTH).alias("end"))


@query(f"WITH RECURSIVE {TRACKS}, mt AS MATERIALIZED (SELECT contig, bin, avg(x) AS x FROM tracks GROUP BY ALL), f AS MATERIALIZED (SELECT contig, bin, x AS e FROM mt WHERE bin = 0 UNION ALL SELECT m.contig, m.bin, 0.2 * m.x + 0.8 * f.e FROM f JOIN mt m ON m.contig = f.contig AND m.bin = f.bin + 1), n AS (SELECT contig, max(bin) AS n FROM mt GROUP BY contig), b AS (SELECT f.contig, f.bin, e FROM f JOIN n ON f.contig = n.contig AND f.bin = n.n UNION ALL SELECT f.contig, f.bin, 0.2 * f.e + 0.8 * b.e FROM b JOIN f ON f.contig = b.contig AND f.bin = b.bin - 1) SELECT contig, bin, round(e, 4) AS ema FROM b")
def w4_bidirectional_ema(spark, d):
    return scan.ema(V.mean_track(spark, d), ["contig"], "bin", "x", 0.2).select("contig", "bin", r4("ema").alias("ema"))


_FLAG = f"{TRACKS}, depth AS (SELECT sample, 1e6 / sum(c) AS k FROM fragments GROUP BY sample), n AS (SELECT contig, bin, log2(raw * k + 1) AS x FROM tracks JOIN depth USING (sample)), l AS (SELECT contig, bin, list_sort(list(x)) AS v FROM n GROUP BY ALL), level AS (SELECT contig, bin, list_sum(list_slice(v, 2, len(v) - 1)) / (len(v) - 2) AS x FROM l), cut AS (SELECT quantile_cont(x, 0.9) AS z FROM level), t AS (SELECT contig, bin, x FROM level, cut WHERE x > z), g AS (SELECT *, CASE WHEN bin - lag(bin) OVER (PARTITION BY contig ORDER BY bin) <= 2 THEN 0 ELSE 1 END AS n FROM t), i AS (SELECT *, sum(n) OVER (PARTITION BY contig ORDER BY bin) AS island FROM g)"


@query(f"WITH {_FLAG} SELECT contig, min(bin) * {WIDTH} AS start, (max(bin) + 1) * {WIDTH} AS \"end\", round(max(x), 4) AS signal, count(*) AS bins FROM i GROUP BY contig, island")
def flagship_peaks(spark, d):
    """Fragments to bins, per-million scale, log2, trimmed mean over samples, top tenth, runs."""
    f = V.fragments(spark, d)
    depth = f.groupBy("sample").agg((1e6 / F.sum("count")).alias("k"))
    t = V.tracks(spark, d).join(F.broadcast(depth), "sample").withColumn("y", expr.transform_count(F.col("raw") * F.col("k")))  # one row per sample
    level = t.groupBy("contig", "bin").agg(F.collect_list("y").alias("v")).select("contig", "bin", counting.trimmed_mean(F.col("v"), 0.25).alias("x"))
    cut = statistics.quantiles(level, [], "x", {"z": 0.9})
    high = level.join(F.broadcast(cut), F.col("x") > F.col("z")).select("contig", "bin", "x")
    found = intervals.runs(high, 1, (F.max("x").alias("signal"), F.count(F.lit(1)).alias("bins")))
    return found.select("contig", (F.col("first_bin") * WIDTH).alias("start"), ((F.col("last_bin") + 1) * WIDTH).alias("end"), r4("signal").alias("signal"), "bins")
