"""More registered queries: scores, strata, thinning, priors, budgets, merging of runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import expr
from gridloom.operators import intervals, models, scan, statistics
from gridloom.plans import views as V
from gridloom.plans.queries import _SEG, query, r4
from gridloom.plans.views import FRAGMENTS, MEAN, TRACKS, WIDTH


@query(f"WITH {TRACKS} SELECT sample, count(*) FILTER (WHERE 1 / (1 + raw) <= 0.05) AS at_floor, count(*) FILTER (WHERE 1 / (1 + raw) >= 0.99) AS at_cap, count(*) AS cells FROM tracks GROUP BY sample")
def a26_a51_bound_hits(spark, d):
    w = 1 / (1 + F.col("raw"))
    return V.tracks(spark, d).groupBy("sample").agg(F.count_if(w <= 0.05).alias("at_floor"), F.count_if(w >= 0.99).alias("at_cap"), F.count(F.lit(1)).alias("cells"))


@query(f"WITH {TRACKS}, {MEAN}, m AS (SELECT t.contig, t.bin // 25 AS block, abs(t.x - m.x) / sqrt(0.2 + 1 / (1 + t.raw)) AS z FROM tracks t JOIN mean_track m USING (contig, bin)) SELECT contig, block, round(max(z), 4) AS top_z, count(*) AS cells FROM m GROUP BY ALL")
def a28_block_scores(spark, d):
    t = V.tracks(spark, d)
    m = t.groupBy("contig", "bin").agg(F.avg("x").alias("mu"))
    z = F.abs(F.col("x") - F.col("mu")) / F.sqrt(0.2 + 1 / (1 + F.col("raw")))
    return t.join(m, ["contig", "bin"]).groupBy("contig", F.floor(F.col("bin") / 25).alias("block")).agg(r4(F.max(z)).alias("top_z"), F.count(F.lit(1)).alias("cells"))


@query(f"WITH RECURSIVE {TRACKS}, g AS (SELECT contig, bin, avg(ln(raw)) AS lg FROM tracks GROUP BY ALL HAVING min(raw) >= 1), sp AS (SELECT contig, min(bin) AS bin FROM g GROUP BY contig UNION ALL SELECT sp.contig, (SELECT min(g.bin) FROM g WHERE g.contig = sp.contig AND g.bin >= sp.bin + 10) FROM sp WHERE sp.bin IS NOT NULL), k AS (SELECT g.* FROM g JOIN sp USING (contig, bin)), r AS (SELECT sample, quantile_cont(ln(raw) - lg, 0.5) AS m FROM tracks JOIN k USING (contig, bin) GROUP BY sample), c AS (SELECT quantile_cont(m, 0.5) AS mid FROM r) SELECT sample, round(1 / least(greatest(exp(m - mid), 0.2), 5.0), 5) AS factor FROM r, c")
def a17_size_factors(spark, d):
    """Median of ratios over bins with every sample at least 1 that are greedily 10 bins apart; centred, clipped, inverted."""
    t = V.tracks(spark, d)
    g = t.groupBy("contig", "bin").agg(F.avg(F.log("raw")).alias("lg"), F.min("raw").alias("lo")).filter("lo >= 1").select("contig", "bin", "lg")
    k = scan.spaced(g, ["contig"], "bin", 10)
    r = statistics.quantiles(t.join(k, ["contig", "bin"]).withColumn("v", F.log("raw") - F.col("lg")), ["sample"], "v", {"m": 0.5})
    mid = r.agg(F.percentile("m", 0.5).alias("mid"))  # one row per sample
    return r.join(F.broadcast(mid), F.lit(True)).select("sample", F.round(1 / F.least(F.greatest(F.exp(F.col("m") - F.col("mid")), F.lit(0.2)), F.lit(5.0)), 5).alias("factor"))


@query("WITH v AS (SELECT c_mktsegment AS segment, c_acctbal AS v, sum(greatest(c_acctbal, 0.01)) AS w FROM customer GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY segment ORDER BY v) - w / 2 AS mid, sum(w) OVER (PARTITION BY segment) AS total FROM v), p AS (SELECT *, mid / total AS q, lag(v) OVER (PARTITION BY segment ORDER BY v) AS v0, lag(mid / total) OVER (PARTITION BY segment ORDER BY v) AS q0 FROM c) SELECT segment, round(v0 + (0.25 - q0) / (q - q0) * (v - v0), 3) AS quantile FROM p WHERE q >= 0.25 AND q0 < 0.25")
def a20_interpolated_quantile(spark, d):
    v = spark.read.parquet(f"{d}/customer.parquet").groupBy(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("v")).agg(F.sum(F.greatest("c_acctbal", F.lit(0.01))).alias("w"))
    c = scan.running(v, ["segment"], ["v"], F.col("w"), "cum", position=F.col("v"), tile=1024)
    total = v.groupBy("segment").agg(F.sum("w").alias("total"))
    c = c.join(F.broadcast(total), "segment").withColumn("q", (F.col("cum") - F.col("w") / 2) / F.col("total"))
    p = scan.previous(c, ["segment"], "v", ["v", "q"], position=F.col("v"), tile=1024)
    at = F.col("prev_v") + (0.25 - F.col("prev_q")) / (F.col("q") - F.col("prev_q")) * (F.col("v") - F.col("prev_v"))
    return p.filter("q >= 0.25 AND prev_q < 0.25").select("segment", F.round(at, 3).alias("quantile"))


@query(f"WITH {TRACKS}, {MEAN}, s AS (SELECT contig, bin, x - 1.5 * 0.4 AS low, max(x) OVER (PARTITION BY contig) AS top FROM mean_track) SELECT contig, bin, round(greatest(low, -2 * top), 4) AS score FROM s")
def p12_score_track(spark, d):
    m = V.mean_track(spark, d)
    top = m.groupBy("contig").agg(F.max("x").alias("top"))
    return m.join(F.broadcast(top), "contig").select("contig", "bin", r4(F.greatest(F.col("x") - 1.5 * 0.4, -2 * F.col("top"))).alias("score"))


@query(f"WITH {TRACKS}, {MEAN}, q AS (SELECT quantile_cont(x, 0.2) AS a, quantile_cont(x, 0.4) AS b, quantile_cont(x, 0.6) AS c, quantile_cont(x, 0.8) AS e FROM mean_track) SELECT contig, CASE WHEN x < a THEN 0 WHEN x < b THEN 1 WHEN x < c THEN 2 WHEN x < e THEN 3 ELSE 4 END AS stratum, count(*) AS bins FROM mean_track, q GROUP BY ALL")
def p31_signal_strata(spark, d):
    m = V.mean_track(spark, d)
    cuts = statistics.quantiles(m, [], "x", {f"c{k}": k / 5 for k in range(1, 5)}).select(F.array("c1", "c2", "c3", "c4").alias("c"))
    code = F.size(F.filter("c", lambda c: F.col("x") >= c))
    return m.join(F.broadcast(cuts), F.lit(True)).groupBy("contig", code.alias("stratum")).agg(F.count(F.lit(1)).alias("bins"))


@query(f"WITH {FRAGMENTS}, h AS (SELECT DISTINCT contig, sample, control, unnest(range(s // {WIDTH}, (e - 1) // {WIDTH} + 1)) AS bin FROM fragments), a AS (SELECT * FROM h WHERE NOT control), b AS (SELECT * FROM h WHERE control) SELECT contig, sample, count(*) AS bins, count(*) FILTER (WHERE a.bin IS NULL OR b.bin IS NULL) AS unmatched FROM a FULL JOIN b USING (contig, sample, bin) GROUP BY contig, sample")
def j6_alignment_check(spark, d):
    """Bins of treatment and control of every sample, and how many of them only one side has."""
    f = V.fragments(spark, d).withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / WIDTH), F.floor((F.col("end") - 1) / WIDTH))))
    side = lambda on, c: f.filter(F.col("control") == on).select("contig", "sample", "bin").distinct().withColumn(c, F.lit(True))
    both = side(False, "a").join(side(True, "b"), ["contig", "sample", "bin"], "full")
    return both.groupBy("contig", "sample").agg(F.count(F.lit(1)).alias("bins"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unmatched"))


@query(f"WITH {TRACKS}, m AS (SELECT contig, bin, max(CASE WHEN raw > 18 THEN 1 ELSE 0 END) AS support, max(CASE WHEN raw > 30 THEN 1 ELSE 0 END) AS anchor FROM tracks GROUP BY ALL), t AS (SELECT * FROM m WHERE support = 1), g AS (SELECT *, CASE WHEN bin - lag(bin) OVER (PARTITION BY contig ORDER BY bin) = 1 THEN 0 ELSE 1 END AS n FROM t), i AS (SELECT *, sum(n) OVER (PARTITION BY contig ORDER BY bin) AS island FROM g) SELECT contig, min(bin) AS first_bin, max(bin) AS last_bin FROM i GROUP BY contig, island HAVING max(anchor) = 1")
def j16_u3_anchored_runs(spark, d):
    on = lambda c: F.max((F.col("raw") > c).cast("int"))
    m = V.tracks(spark, d).groupBy("contig", "bin").agg(on(18).alias("support"), on(30).alias("anchor")).filter("support = 1")
    return intervals.runs(m.select("contig", "bin", "anchor"), 0, (F.max("anchor").alias("anchor"),)).filter("anchor = 1").drop("anchor")


@query(f"WITH {TRACKS}, h AS (SELECT sample, CAST(substr(sample, 2) AS INTEGER) + 1 AS h FROM (SELECT DISTINCT sample FROM tracks)), j AS (SELECT a.contig, a.sample, a.bin, avg(b.x) AS smooth FROM tracks a JOIN h USING (sample) JOIN tracks b ON a.contig = b.contig AND a.sample = b.sample AND abs(a.bin - b.bin) <= h GROUP BY ALL) SELECT contig, sample, bin, round(smooth, 4) AS smooth FROM j")
def w11_per_sample_smoothing(spark, d):
    """Rolling mean whose half width is the sample's: prefix sums and two lookups, whatever the width."""
    t = V.tracks(spark, d).withColumn("h", F.substring("sample", 2, 9).cast("int") + 1)
    out = models.span_mean(t, ["contig", "sample"], "bin", "x", F.col("bin") - F.col("h"), F.col("bin") + F.col("h"), "smooth")
    return out.select("contig", "sample", "bin", r4("smooth").alias("smooth"))


@query(f"WITH {TRACKS}, t AS (SELECT contig, sample, bin FROM tracks WHERE raw > 20), k AS (SELECT a.contig, a.sample, a.bin, sum(exp(-abs(a.bin - b.bin) / 3.0)) AS n FROM t a JOIN t b ON a.contig = b.contig AND a.sample = b.sample GROUP BY ALL) SELECT contig, sample, bin, round(n / (n + 2), 3) AS weight FROM k")
def w13_soft_support(spark, d):
    """Sum of exp(-distance / 3) over all supported bins: a recurrence forward and one backward, less the bin itself."""
    t = V.tracks(spark, d).select("contig", "sample", "bin", (F.col("raw") > 20).cast("double").alias("on"))
    keys, decay = ["contig", "sample"], F.exp(F.lit(-1 / 3))
    n = scan.affine(scan.affine(t, keys, "bin", decay, F.col("on"), "ahead"), keys, "bin", decay, F.col("on"), "back", reverse=True)
    n = n.filter("on > 0").withColumn("n", F.col("ahead") + F.col("back") - F.col("on"))
    return n.select("contig", "sample", "bin", F.round(F.col("n") / (F.col("n") + 2), 3).alias("weight"))


@query(f"WITH {TRACKS}, {MEAN}, r AS (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY bin) - 1 AS k, count(*) OVER (PARTITION BY contig) AS n FROM mean_track) SELECT contig, bin, round(x, 4) AS x FROM r WHERE (k * 20) // n <> ((k - 1) * 20) // n OR k = 0")
def t8_even_sample(spark, d):
    """About 20 evenly spaced rows per contig; bins are dense, so the rank is the bin itself."""
    m = V.mean_track(spark, d)
    n = m.groupBy("contig").agg(F.count(F.lit(1)).alias("n"))
    j = m.join(F.broadcast(n), "contig")
    cell = lambda k: F.floor(k * 20 / F.col("n"))
    return j.filter((F.col("bin") == 0) | (cell(F.col("bin")) != cell(F.col("bin") - 1))).select("contig", "bin", r4("x").alias("x"))


@query(f"WITH {TRACKS}, m AS (SELECT sample, contig, bin, raw, bin % 17 = 0 AS masked FROM tracks), f AS (SELECT sample, quantile_cont(raw, 0.05) FILTER (WHERE NOT masked) AS lo FROM m GROUP BY sample) SELECT sample, contig, bin, round(CASE WHEN masked THEN greatest(raw, lo) ELSE raw END, 4) AS v FROM m JOIN f USING (sample)")
def m6_masked_floor(spark, d):
    m = V.tracks(spark, d).withColumn("masked", F.col("bin") % 17 == 0)
    f = statistics.quantiles(m.filter(~F.col("masked")), ["sample"], "raw", {"lo": 0.05})
    return m.join(F.broadcast(f), "sample").select("sample", "contig", "bin", r4(F.when(F.col("masked"), F.greatest("raw", "lo")).otherwise(F.col("raw"))).alias("v"))


@query("WITH v AS (SELECT o_orderpriority AS stratum, round(abs(o_totalprice - 150000) / (20000 + o_custkey % 7 * 1000), 3) AS z, 1.0 + o_custkey % 3 AS w FROM orders), c AS (SELECT stratum, z, sum(w) OVER (PARTITION BY stratum ORDER BY z) AS cum, sum(w) OVER (PARTITION BY stratum) AS total FROM v) SELECT stratum, round(least(25.0, greatest(0.04, pow(min(z) / 1.644854, 2))), 5) AS factor FROM c WHERE cum >= 0.9 * total - 1e-9 GROUP BY stratum")
def m11_uncertainty_factor(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    v = o.select(F.col("o_orderpriority").alias("stratum"), F.round(F.abs(F.col("o_totalprice") - 150000) / (20000 + F.col("o_custkey") % 7 * 1000), 3).alias("z"), (1.0 + F.col("o_custkey") % 3).alias("w"))
    q = statistics.weighted_quantile(v, ["stratum"], "z", "w", 0.9)
    return q.select("stratum", F.round(F.least(F.lit(25.0), F.greatest(F.lit(0.04), F.pow(F.col("quantile") / 1.644854, F.lit(2)))), 5).alias("factor"))


@query(f"WITH {TRACKS}, {MEAN}, q AS (SELECT contig, quantile_cont(x, 0.5) AS mid FROM mean_track GROUP BY contig), a AS (SELECT contig, x - mid AS e, abs(x - mid) AS dev FROM mean_track JOIN q USING (contig)), s AS (SELECT contig, quantile_cont(dev, 0.5) * 1.4826 AS mad, quantile_cont(dev, 0.95) AS edge FROM a GROUP BY contig) SELECT contig, round(avg(least(greatest(e, -edge), edge)), 4) AS centre, round(any_value(mad), 4) AS scale, round(any_value(edge), 4) AS edge FROM a JOIN s USING (contig) GROUP BY contig")
def m15_m16_null_template(spark, d):
    m = V.mean_track(spark, d)
    q = statistics.quantiles(m, ["contig"], "x", {"mid": 0.5})
    a = m.join(F.broadcast(q), "contig").select("contig", (F.col("x") - F.col("mid")).alias("e"))
    s = statistics.quantiles(a.withColumn("dev", F.abs("e")), ["contig"], "dev", {"mid": 0.5, "edge": 0.95}).withColumn("mad", F.col("mid") * 1.4826).drop("mid")
    clipped = F.least(F.greatest(F.col("e"), -F.col("edge")), F.col("edge"))
    return a.join(F.broadcast(s), "contig").groupBy("contig").agg(r4(F.avg(clipped)).alias("centre"), r4(F.first("mad")).alias("scale"), r4(F.first("edge")).alias("edge"))


@query(f"WITH {TRACKS}, {MEAN}, o AS (SELECT contig, count(*) FILTER (WHERE x > 5.2) AS k, count(*) AS n FROM mean_track GROUP BY contig), t AS (SELECT sum(k) / CAST(sum(n) AS DOUBLE) AS p FROM o) SELECT contig, round(least(0.25, greatest(0.001, (k + 50 * p) / (n + 50))), 5) AS budget FROM o, t")
def m20_m21_budgets(spark, d):
    """Occupancy per contig, shrunk to the pooled one by a beta prior of 50 bins, clipped."""
    o = V.mean_track(spark, d).groupBy("contig").agg(F.count_if(F.col("x") > 5.2).alias("k"), F.count(F.lit(1)).alias("n"))
    p = o.agg((F.sum("k") / F.sum("n")).alias("p"))
    return o.join(F.broadcast(p), F.lit(True)).select("contig", F.round(F.least(F.lit(0.25), F.greatest(F.lit(0.001), (F.col("k") + 50 * F.col("p")) / (F.col("n") + 50))), 5).alias("budget"))


_PEAKS = f"{TRACKS}, {MEAN}, t AS (SELECT * FROM mean_track WHERE x > 5.1), g AS (SELECT *, CASE WHEN bin - lag(bin) OVER (PARTITION BY contig ORDER BY bin) = 1 THEN 0 ELSE 1 END AS n FROM t), i AS (SELECT *, sum(n) OVER (PARTITION BY contig ORDER BY bin) AS island FROM g), pk AS (SELECT contig, min(bin) AS a, max(bin) AS b, max(x) AS top, arg_max(bin, x) AS summit FROM i GROUP BY contig, island)"


def _peaks(spark, d):
    t = V.mean_track(spark, d).filter("x > 5.1")
    return intervals.runs(t, 0, (F.max("x").alias("top"), F.max_by("bin", "x").alias("summit"))).withColumnsRenamed({"first_bin": "a", "last_bin": "b"})


@query(f"WITH {_PEAKS}, n AS (SELECT *, lead(a) OVER (PARTITION BY contig ORDER BY a) AS a2 FROM pk), gap AS (SELECT n.contig, n.a, n.b, sum(m.x - 5.1) AS cost FROM n JOIN mean_track m ON n.contig = m.contig AND m.bin > n.b AND m.bin < n.a2 WHERE n.a2 - n.b <= 6 GROUP BY ALL), k AS (SELECT pk.*, coalesce(lag(gap.cost + 1.0 > 0) OVER (PARTITION BY pk.contig ORDER BY pk.a), false) AS joined FROM pk LEFT JOIN gap USING (contig, a, b)), i2 AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY contig ORDER BY a) AS island FROM k) SELECT contig, min(a) AS first_bin, max(b) AS last_bin, count(*) AS parts FROM i2 GROUP BY contig, island")
def x8_merged_runs(spark, d):
    """Neighbouring runs merge where the gap's score plus the saved boundary costs is positive; every gap decides alone."""
    m, p = V.mean_track(spark, d), _peaks(spark, d)
    n = scan.previous(p, ["contig"], "a", ["b"]).filter("prev_b IS NOT NULL AND a - prev_b <= 6")
    gaps = n.select("contig", "a", F.explode(F.sequence(F.col("prev_b") + 1, F.col("a") - 1)).alias("bin"))
    cost = gaps.join(m, ["contig", "bin"]).groupBy("contig", "a").agg((F.sum(F.col("x") - 5.1) + 1.0 > 0).alias("joined"))
    k = p.join(cost, ["contig", "a"], "left").withColumn("_new", F.when(F.coalesce("joined", F.lit(False)), 0).otherwise(1))
    k = scan.running(k, ["contig"], ["a"], F.col("_new"), "_island")
    return k.groupBy("contig", "_island").agg(F.min("a").alias("first_bin"), F.max("b").alias("last_bin"), F.count(F.lit(1)).alias("parts")).drop("_island")


@query(f"WITH {_PEAKS}, r AS (SELECT contig, min(top) AS lo, max(top) AS hi FROM pk GROUP BY contig) SELECT contig, a * {WIDTH} AS start, (b + 1) * {WIDTH} AS \"end\", CAST(round(CASE WHEN hi > lo THEN 250 + 750 * (top - lo) / (hi - lo) ELSE 1000 END) AS INTEGER) AS score, round(top, 4) AS signal, (summit - a) * {WIDTH} + {WIDTH // 2} AS summit_offset FROM pk JOIN r USING (contig)")
def k5_x2_peak_rows(spark, d):
    p = _peaks(spark, d)
    r = p.groupBy("contig").agg(F.min("top").alias("lo"), F.max("top").alias("hi"))
    score = F.when(F.col("hi") > F.col("lo"), 250 + 750 * (F.col("top") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1000)
    return p.join(F.broadcast(r), "contig").select("contig", (F.col("a") * WIDTH).alias("start"), ((F.col("b") + 1) * WIDTH).alias("end"), F.round(score).cast("int").alias("score"), r4("top").alias("signal"), ((F.col("summit") - F.col("a")) * WIDTH + WIDTH // 2).alias("summit_offset"))


@query(f"WITH {_PEAKS} SELECT contig, count(*) AS peaks, round(avg(b - a + 1), 4) AS mean_width, max(b - a + 1) AS widest, round(quantile_cont(b - a + 1, 0.5), 2) AS median_width FROM pk GROUP BY contig")
def a34_peak_widths(spark, d):
    w = F.col("b") - F.col("a") + 1
    return _peaks(spark, d).groupBy("contig").agg(F.count(F.lit(1)).alias("peaks"), r4(F.avg(w)).alias("mean_width"), F.max(w).alias("widest"), F.round(F.percentile(w, 0.5), 2).alias("median_width"))


@query(f"WITH {_SEG}, s AS (SELECT contig, CAST(z AS DOUBLE) AS z, min(bin) AS a, max(bin) AS b, sum(excess) / sqrt(count(*)) AS score FROM i GROUP BY contig, z, island), r AS (SELECT *, row_number() OVER (PARTITION BY z ORDER BY score DESC, contig, a) AS k FROM s) SELECT DISTINCT contig, a AS first_bin, b AS last_bin FROM r WHERE k <= 4")
def t2_u6_best_segments(spark, d):
    from gridloom.plans.queries import x9_candidate_segments

    s = x9_candidate_segments(spark, d)
    w = Window.partitionBy("z").orderBy(F.desc("score"), "contig", "first_bin")  # z is one of a few thresholds, rows are segments
    return s.withColumn("k", F.row_number().over(w)).filter("k <= 4").select("contig", "first_bin", "last_bin").distinct()


@query("WITH c AS (SELECT o_orderpriority AS code, count(*) AS n FROM orders GROUP BY 1), q AS (SELECT code, n, 200.0 * n / sum(n) OVER () AS x FROM c), f AS (SELECT *, floor(x) AS base, row_number() OVER (ORDER BY x - floor(x) DESC, code) AS k, 200 - sum(floor(x)) OVER () AS left_over FROM q) SELECT code, CAST(base + CASE WHEN k <= left_over THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f")
def t4_largest_remainder_quotas(spark, d):
    c = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_orderpriority").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()  # one row per code
    q = c.withColumn("x", 200.0 * F.col("n") / F.sum("n").over(every)).withColumn("base", F.floor("x"))
    q = q.withColumn("k", F.row_number().over(Window.orderBy(F.desc(F.col("x") - F.col("base")), "code"))).withColumn("rest", 200 - F.sum("base").over(every))
    return q.select("code", (F.col("base") + (F.col("k") <= F.col("rest")).cast("long")).cast("long").alias("quota"))


_U = "((CAST('0x' || substr(md5(concat_ws(':', '{seed}', contig, block)), 1, 8) AS BIGINT) + 0.5) / 4294967296.0)"


@query(f"WITH {TRACKS}, {MEAN}, b AS (SELECT DISTINCT contig, bin // 25 AS block FROM mean_track) SELECT contig, block, CAST(floor(4 * {_U.format(seed=17)}) AS BIGINT) AS fold, {_U.format(seed=18)} < 0.2 AS target FROM b")
def t9_t10_fold_spec(spark, d):
    """Blocks dealt to 4 folds by seeded draws; a fifth of them is the target split."""
    b = V.mean_track(spark, d).select("contig", F.floor(F.col("bin") / 25).alias("block")).distinct()
    return b.select("contig", "block", F.floor(4 * models.uniform(17, "contig", "block")).alias("fold"), (models.uniform(18, "contig", "block") < 0.2).alias("target"))


@query(f"WITH {TRACKS}, h AS (SELECT sample, contig, bin, round(raw, 4) AS raw FROM tracks), p AS (SELECT a.sample AS a, b.sample AS b, count(*) FILTER (WHERE a.raw <> b.raw) AS differing FROM h a JOIN h b ON a.contig = b.contig AND a.bin = b.bin AND a.sample < b.sample GROUP BY ALL) SELECT a, b, differing, differing = 0 AS same FROM p")
def u7_identical_samples(spark, d):
    """Pairs of samples whose tracks are the same."""
    h = V.tracks(spark, d).select("sample", "contig", "bin", r4("raw").alias("raw"))
    x, y = h.withColumnsRenamed({"sample": "a", "raw": "ra"}), h.withColumnsRenamed({"sample": "b", "raw": "rb"})
    p = x.join(y, ["contig", "bin"]).filter("a < b").groupBy("a", "b").agg(F.count_if(F.col("ra") != F.col("rb")).alias("differing"))
    return p.withColumn("same", F.col("differing") == 0)


@query(f"WITH {FRAGMENTS} SELECT sample, count(*) FILTER (WHERE regexp_matches(contig, '^(chr)?([1-9]|1[0-9]|2[0-2])$')) AS autosomal, round(max(-log10((c + 1) / 100.0)), 4) AS top FROM fragments GROUP BY sample")
def p17_p28_predicates(spark, d):
    return V.fragments(spark, d).groupBy("sample").agg(F.count_if(expr.autosome(F.col("contig"))).alias("autosomal"), r4(F.max(expr.minus_log10((F.col("count") + 1) / 100.0))).alias("top"))
