"""Registered queries of the consensus fit, the null, dependence and error models, and the policies for wide peaks."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import functions as F

from gridloom.operators import background, calibration, consensus, dependence, fragment_length, heterogeneity, intervals, null_model, peak_scores, process_seed, refine, segment_factors, slab_prior, tiles, variance_terms, widths
from gridloom.plans import views as V
from gridloom.plans.queries import query, r4
from gridloom.plans.queries_models import _DRAWS, _draws, u
from gridloom.plans.views import CONTIGS, FRAGMENTS, MEAN, TRACKS, WIDTH

# ---- background and consensus -------------------------------------------------------------------------------------------
_FIRST, _SECOND = background.penalties(6.0)


@query(f"""WITH RECURSIVE {TRACKS}, cells AS MATERIALIZED (SELECT contig, bin, sum(1 / (1 + raw)) AS w, sum(x / (1 + raw)) AS r, max(bin) OVER (PARTITION BY contig) + 1 AS n FROM tracks GROUP BY contig, bin),
a AS MATERIALIZED (SELECT contig, bin, n, r, w + {_FIRST} * (CASE WHEN bin > 0 THEN 1 ELSE 0 END + CASE WHEN bin < n - 1 THEN 1 ELSE 0 END) + {_SECOND} * (CASE WHEN bin <= n - 3 THEN 1 ELSE 0 END + CASE WHEN bin BETWEEN 1 AND n - 2 THEN 4 ELSE 0 END + CASE WHEN bin >= 2 THEN 1 ELSE 0 END) AS d,
  -{_FIRST} - 2 * {_SECOND} * (CASE WHEN bin BETWEEN 1 AND n - 2 THEN 1 ELSE 0 END + CASE WHEN bin >= 2 THEN 1 ELSE 0 END) AS o FROM cells),
f AS MATERIALIZED (SELECT contig, bin, d AS dd, CAST(0 AS DOUBLE) AS l1, CAST(0 AS DOUBLE) AS l2, r AS y, CAST(NULL AS DOUBLE) AS d1, CAST(NULL AS DOUBLE) AS y1 FROM a WHERE bin = 0
  UNION ALL SELECT contig, bin, d - m1 * m1 * dd - coalesce(m2 * m2 * d1, 0), m1, coalesce(m2, 0), r - m1 * y - coalesce(m2 * y1, 0), dd, y FROM (
    SELECT a.contig, a.bin, a.d, a.r, f.dd, f.d1, f.y, f.y1, (a.o - CASE WHEN a.bin >= 2 THEN {_SECOND} * f.l1 ELSE 0 END) / f.dd AS m1, {_SECOND} / f.d1 AS m2 FROM f JOIN a ON a.contig = f.contig AND a.bin = f.bin + 1)),
z AS MATERIALIZED (SELECT f.contig, f.bin, y / dd AS v, lead(l1) OVER (PARTITION BY f.contig ORDER BY f.bin) AS n1, lead(l2, 2) OVER (PARTITION BY f.contig ORDER BY f.bin) AS n2 FROM f),
b AS (SELECT z.contig, z.bin, v AS g, CAST(NULL AS DOUBLE) AS g1 FROM z JOIN (SELECT contig, max(bin) AS bin FROM z GROUP BY contig) USING (contig, bin)
  UNION ALL SELECT z.contig, z.bin, z.v - z.n1 * b.g - coalesce(z.n2 * b.g1, 0), b.g FROM b JOIN z ON z.contig = b.contig AND z.bin = b.bin - 1)
SELECT contig, bin, round(g, 4) + 0.0 AS background FROM b""")
def r5_smooth_background(spark, d):
    """Background of the pooled tracks under first and second difference penalties; the SQL is the LDL' recursion of the whole contig."""
    w = 1 / (1 + F.col("raw"))
    cells = V.tracks(spark, d).groupBy("contig", "bin").agg(F.sum(w).alias("weight"), F.sum(F.col("x") * w).alias("rhs"))
    return background.smooth_background(cells, 6.0, tile=100).select("contig", "bin", (r4("background") + 0.0).alias("background"))


def _cells(spark, d):
    return V.tracks(spark, d).select("contig", "bin", "sample", "x", (0.2 + 1 / (1 + F.col("raw"))).alias("v"))


def _pass(k: int, before: str) -> str:
    """SQL of one pass over ``before`` (contig, bin, lam, kap): tables s (smoothed) and m (multipliers)."""
    return f"""i{k} AS MATERIALIZED (SELECT c.contig, c.bin, m, s0, s1, s2, lam * s0 AS info, lam * s1 AS w, 0.05 / kap AS q FROM sums c JOIN {before} USING (contig, bin)),
f{k} AS MATERIALIZED (SELECT contig, bin, CAST(0 AS DOUBLE) AS mp, 1e6 + q AS pp, w / (1 / (1e6 + q) + info) AS x, 1 / (1 / (1e6 + q) + info) AS p FROM i{k} WHERE bin = 0
  UNION ALL SELECT i.contig, i.bin, f.x, f.p + i.q, (f.x / (f.p + i.q) + i.w) / (1 / (f.p + i.q) + i.info), 1 / (1 / (f.p + i.q) + i.info) FROM f{k} f JOIN i{k} i ON i.contig = f.contig AND i.bin = f.bin + 1),
b{k} AS MATERIALIZED (SELECT f.contig, f.bin, x AS xs, p AS ps FROM f{k} f JOIN ends USING (contig, bin)
  UNION ALL SELECT f.contig, f.bin, f.x + f.p / n.pp * (b.xs - n.mp), f.p + power(f.p / n.pp, 2) * (b.ps - n.pp) FROM b{k} b JOIN f{k} f ON f.contig = b.contig AND f.bin = b.bin - 1 JOIN f{k} n ON n.contig = b.contig AND n.bin = b.bin),
m{k} AS MATERIALIZED (SELECT contig, bin, xs, ps, greatest(0.25, least(4.0, (8 + m) / (8 + s2 - 2 * s1 * xs + s0 * xs * xs + s0 * ps))) AS lam,
  CASE WHEN bin = 0 THEN 1.0 ELSE greatest(0.25, least(4.0, 9 / (8 + greatest(0, (power(q / pp * (xs - mp), 2) + q - power(q / pp, 2) * (pp - ps)) / 0.05)))) END AS kap FROM b{k} JOIN f{k} USING (contig, bin) JOIN i{k} USING (contig, bin))"""


@query(f"""WITH RECURSIVE {TRACKS}, sums AS MATERIALIZED (SELECT contig, bin, count(*) AS m, sum(1 / v) AS s0, sum(x / v) AS s1, sum(x * x / v) AS s2 FROM (SELECT contig, bin, x, 0.2 + 1 / (1 + raw) + 1e-4 AS v FROM tracks) GROUP BY contig, bin),
ends AS (SELECT contig, max(bin) AS bin FROM sums GROUP BY contig), m0 AS (SELECT contig, bin, 1.0 AS lam, 1.0 AS kap FROM sums),
{_pass(1, "m0")}, {_pass(2, "m1")}, {_pass(3, "m2")}
SELECT contig, bin, round(xs, 4) AS level, round(ps, 4) AS variance, round(lam, 4) AS lambda, round(kap, 4) AS kappa FROM m3""")
def r3_robust_multipliers(spark, d):
    """Three passes of the robust smoother: level, variance, and the multipliers of observations and of the process after them."""
    model = consensus.Model((0.05,))
    state, _ = consensus.robust_fit(consensus.staged(consensus.packed(_cells(spark, d), 100), "state"), model, passes=3, rtol=0.0)
    rows = state.select("contig", "tile", F.posexplode(F.arrays_zip("level", "var", "lam", "kap")).alias("_i", "_c"))
    return rows.select("contig", (F.col("tile") * 100 + F.col("_i")).alias("bin"), r4("_c.level").alias("level"), r4("_c.var").alias("variance"), r4("_c.lam").alias("lambda"), r4("_c.kap").alias("kappa"))


@query()
def r4_consensus_fit(spark, d):
    """Background and level fitted in turn until both stand still; tests hold every pass against dense and sequential code."""
    out, _ = consensus.consensus_fit(_cells(spark, d), consensus.Model((0.05,)), span=40.0, outer=4, passes=3)
    return out.select("contig", "bin", r4("level").alias("level"), r4("variance").alias("variance"), r4("background").alias("background"), r4("lambda").alias("lambda"), r4("kappa").alias("kappa"))


@query()
def r7_nested_refinement(spark, d):
    """Selected runs of the mean track refined inside their parents; tests hold it against all masks of short parents."""
    m = V.mean_track(spark, d)
    picked = tiles.select_runs(m.select("contig", "bin", F.col("x").alias("score")), 4.0, 1.0)
    scores = m.join(picked, ["contig", "bin"]).select("contig", "bin", (F.col("x") - 4.0).alias("score"), F.col("x").alias("raw"), "selected")
    leaves, _ = refine.refine_runs(scores, 1.0, 0.0)
    return leaves.select("contig", (F.col("first_bin") * WIDTH).alias("start"), ((F.col("last_bin") + 1) * WIDTH).alias("end"))


# ---- null, dependence and error models ----------------------------------------------------------------------------------
_HALVES = """h AS (SELECT contig, l FROM lists UNION ALL SELECT contig, CASE WHEN n = 3 THEN CASE WHEN l[2] - l[1] <= l[3] - l[2] THEN l[1:2] ELSE l[2:3] END ELSE list_slice(l, place, place + w - 1) END FROM (
  SELECT contig, l, len(l) AS n, (len(l) + 1) // 2 AS w, list_position(d, list_min(d)) AS place FROM (SELECT contig, l, [l[i + (len(l) + 1) // 2 - 1] - l[i] FOR i IN range(1, len(l) - (len(l) + 1) // 2 + 2)] AS d FROM h WHERE len(l) > 2)))"""


def _inverted(sorted_list: str, p: float) -> str:
    t = f"greatest({p} * len({sorted_list}) - 1, 0)"
    low = f"{sorted_list}[CAST(floor({t}) AS BIGINT) + 1]"
    return f"({low} + ({t} - floor({t})) * ({sorted_list}[CAST(ceil({t}) AS BIGINT) + 1] - {low}))"


def _spread(v: str) -> str:
    """SQL of the robust scale of the lists ``v``."""
    mid = f"list_aggregate({v}, 'quantile_cont', 0.5)"
    return f"greatest(1.4826 * list_aggregate([abs(y - {mid}) FOR y IN {v}], 'quantile_cont', 0.5), (list_aggregate({v}, 'quantile_cont', 0.75) - list_aggregate({v}, 'quantile_cont', 0.25)) / 1.349, list_aggregate({v}, 'stddev_samp'), 1e-6)"


@query(f"""WITH RECURSIVE {TRACKS}, {MEAN}, whole AS MATERIALIZED (SELECT contig, list_sort(list(x)) AS z FROM mean_track GROUP BY contig),
lists AS MATERIALIZED (SELECT contig, [y FOR y IN z IF y <= cut] AS l FROM (SELECT contig, z, {_inverted("z", 0.6)} AS cut FROM whole)), {_HALVES},
c AS MATERIALIZED (SELECT contig, list_avg(l) AS centre FROM h WHERE len(l) <= 2 QUALIFY row_number() OVER (PARTITION BY contig ORDER BY len(l)) = 1),
o AS MATERIALIZED (SELECT contig, centre, list_sort([y - centre FOR y IN l]) AS r, list_sort([abs(y - centre) FOR y IN l]) AS a FROM lists JOIN c USING (contig)),
k AS MATERIALIZED (SELECT contig, centre, greatest(2.5 * {_spread("r")}, {_inverted("a", 0.5)}, 1e-6) AS radius FROM o),
s AS MATERIALIZED (SELECT contig, centre, radius, list_sort([y - centre FOR y IN z IF abs(y - centre) <= radius]) AS v FROM k JOIN whole USING (contig))
SELECT contig, round(centre, 4) AS centre, round(radius, 4) AS radius, round({_spread("v")}, 4) AS scale, CAST(len(v) AS BIGINT) AS support FROM s""")
def m15_null_centre(spark, d):
    """Half-sample mode of the lower bulk, central support and its robust scale, per contig."""
    n = null_model.null_centre(V.mean_track(spark, d), ["contig"], "x")
    return n.select("contig", r4("centre").alias("centre"), r4("radius").alias("radius"), r4("scale").alias("scale"), "support")


@query(f"""WITH RECURSIVE {TRACKS}, lists AS MATERIALIZED (SELECT sample AS contig, list_sort(list(x)) AS l FROM tracks GROUP BY sample), {_HALVES}
SELECT contig AS sample, round(list_avg(l), 4) AS mode FROM h WHERE len(l) <= 2 QUALIFY row_number() OVER (PARTITION BY contig ORDER BY len(l)) = 1""")
def w15_half_sample_mode(spark, d):
    return null_model.half_sample_mode(V.tracks(spark, d), ["sample"], "x", small=64).select("sample", r4("mode").alias("mode"))


_RADII = f"""t AS MATERIALIZED (SELECT DISTINCT contig, w, sample, list(x ORDER BY bin) AS l FROM (SELECT *, bin // 48 AS w, max(bin) OVER (PARTITION BY contig) + 1 AS n FROM tracks) WHERE (w + 1) * 48 <= n GROUP BY ALL),
u AS MATERIALIZED (SELECT DISTINCT contig, w, l FROM t),
k AS (SELECT contig, w, l, [greatest(quantile_lo, least(quantile_hi, y)) FOR y IN l] AS c FROM (SELECT *, list_aggregate(l, 'quantile_cont', 0.005) AS quantile_lo, list_aggregate(l, 'quantile_cont', 0.995) AS quantile_hi FROM u)),
e AS (SELECT contig, w, l, [y - list_avg(c) FOR y IN c] AS c FROM k),
a AS MATERIALIZED (SELECT contig, w, lag, (list_dot_product(c[1 : 48 - lag], c[1 + lag : 48]) / (48 - lag)) / (list_dot_product(c, c) / 48) AS r FROM e, (SELECT unnest(range(1, 17)) AS lag) WHERE list_dot_product(c, c) > 0),
p AS MATERIALIZED (SELECT contig, w, lag, median(r) AS r FROM a GROUP BY ALL),
m AS (SELECT contig, w, lag, avg(abs(r)) OVER (PARTITION BY contig, w ORDER BY lag ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS r FROM p),
g AS (SELECT contig, w, lag, r < 0.3 AND lead(r) OVER (PARTITION BY contig, w ORDER BY lag) < 0.3 AS below FROM m WHERE lag BETWEEN 2 AND 15),
x AS (SELECT contig, w, coalesce(min(lag) FILTER (WHERE below AND lag <= 14), 14) AS lag, count(*) FILTER (WHERE below AND lag <= 14) = 0 AS censored FROM g GROUP BY ALL),
s AS (SELECT contig, w, median(s) AS score FROM (SELECT contig, w, list_sum([greatest(y, 0) FOR y IN l]) AS s FROM u) GROUP BY ALL),
radii AS MATERIALIZED (SELECT contig, w AS "window", score, lag / sqrt(-2 * ln(0.3)) AS radius, censored FROM x JOIN s USING (contig, w))"""


def _radii(spark, d):
    return dependence.window_radii(V.tracks(spark, d), 48, 16, threshold=0.3, smooth=3, persistence=2, least_pairs=20, least_share=0.5)


@query(f"WITH {TRACKS}, {_RADII} SELECT contig, \"window\", round(score, 4) AS score, round(radius, 4) AS radius, censored FROM radii")
def w6_window_radii(spark, d):
    """Radius of the pooled autocorrelation of every whole window, or where it is censored."""
    return _radii(spark, d).select("contig", "window", r4("score").alias("score"), r4("radius").alias("radius"), "censored")


@query(f"""WITH {TRACKS}, {_RADII}, keyed AS (SELECT *, -ln({u(17, "contig", '"window"')}) / (count(*) OVER () - (rank() OVER (ORDER BY score DESC) + (count(*) OVER (PARTITION BY score) - 1) / 2.0) + 1) AS key FROM radii),
c AS MATERIALIZED (SELECT * FROM keyed ORDER BY key, contig, "window" LIMIT 20),
v AS (SELECT radius, count(*) FILTER (WHERE NOT censored) AS d, sum(count(*)) OVER (ORDER BY radius DESC) AS r FROM c GROUP BY radius),
curve AS (SELECT radius, d, 1 - product(1 - d / r) OVER (ORDER BY radius) AS gone FROM v)
SELECT (SELECT count(*) FROM c) AS windows, (SELECT count(*) FROM c WHERE censored) AS censored, round(min(radius) FILTER (WHERE d > 0 AND gone + 1e-12 >= 0.5), 4) AS median, round(min(radius) FILTER (WHERE d > 0 AND gone + 1e-12 >= 0.75), 4) AS span FROM curve""")
def m7_dependence_span(spark, d):
    """Product-limit median and upper quartile of the radii of 20 windows, sampled with odds by the rank of their signal."""
    chosen = dependence.staged(dependence.sampled_windows(_radii(spark, d), 20, 17), "windows")
    curve = dependence.staged(dependence.survival(chosen, []), "curve")
    out = chosen.agg(F.count(F.lit(1)).alias("windows"), F.count_if("censored").alias("censored"))
    for q, name in ((0.5, "median"), (0.75, "span")):
        out = out.join(F.broadcast(dependence.survival_quantile(curve, [], q, name)), F.lit(True))  # one row
    return out.select("windows", "censored", r4("median").alias("median"), r4("span").alias("span"))


@query()
def m7_dependence_band(spark, d):
    """The span with its bootstrap band; tests hold every draw against a sequential walk."""
    out = dependence.dependence_span(_radii(spark, d), 40, 0.75, 50, 3.0, 17)
    return out.select("windows", "censored", r4("median").alias("median"), r4("span").alias("span"), r4("low").alias("low"), r4("high").alias("high"), "resolved")


_POISSON = "CASE " + " ".join(f"WHEN {{u}} < {t!r} THEN {k}" for k, t in enumerate(accumulate(math.exp(-1) / math.factorial(k) for k in range(12)))) + " ELSE 12 END"


def _logs(scope: str) -> str:
    times = _POISSON.format(u=u(5, "rep", '"group"'))
    return f"""(SELECT {scope}, max(log) FILTER (WHERE rep = 0) AS raw, CASE WHEN var_samp(log) FILTER (WHERE rep > 0) > 0 THEN var_samp(log) FILTER (WHERE rep > 0) END AS variance FROM (
  SELECT {scope}, rep, ln(least(20.0, greatest(0.05, power(min(ratio) FILTER (WHERE run >= 0.9 * total - 1e-9) / 1.645, 2)))) AS log FROM (
    SELECT {scope}, rep, ratio, sum(w) OVER (PARTITION BY {scope}, rep ORDER BY ratio) AS run, sum(w) OVER (PARTITION BY {scope}, rep) AS total FROM (
      SELECT {scope}, rep, ratio, weight * CASE WHEN rep = 0 THEN 1 ELSE {times} END AS w FROM errors, (SELECT unnest(range(17)) AS rep))) WHERE total > 0 GROUP BY {scope}, rep) GROUP BY {scope})"""


@query(f"""WITH {TRACKS}, mt AS (SELECT contig, bin, avg(x) AS mu FROM tracks GROUP BY ALL),
errors AS MATERIALIZED (SELECT contig, bin // 64 AS segment, round(abs(x - mu) / 0.4, 3) AS ratio, 1 + sqrt(raw) AS weight, contig || ':' || sample || ':' || (bin // 16) AS "group" FROM tracks JOIN mt USING (contig, bin)),
c AS MATERIALIZED {_logs("contig")}, g AS (SELECT coalesce(sum(raw / greatest(variance, 1e-12)) FILTER (WHERE variance IS NOT NULL) / sum(1 / greatest(variance, 1e-12)) FILTER (WHERE variance IS NOT NULL), avg(raw)) AS genome FROM c),
ct AS (SELECT greatest(0, sum((power(raw - genome, 2) - variance) / greatest(variance, 1e-12)) / sum(1 / greatest(variance, 1e-12))) AS tau FROM c, g WHERE variance IS NOT NULL),
cc AS (SELECT contig, coalesce(tau / (tau + variance), 0) * raw + (1 - coalesce(tau / (tau + variance), 0)) * genome AS parent FROM c, g, ct),
s AS MATERIALIZED (SELECT * FROM {_logs("contig, segment")} JOIN cc USING (contig)),
st AS (SELECT greatest(0, sum((power(raw - parent, 2) - variance) / greatest(variance, 1e-12)) / sum(1 / greatest(variance, 1e-12))) AS tau FROM s WHERE variance IS NOT NULL)
SELECT contig, segment, round(raw, 4) AS raw, round(variance, 5) AS variance, round(coalesce(tau / (tau + variance), 0), 4) AS alpha, round(greatest(1.0, exp(coalesce(tau / (tau + variance), 0) * raw + (1 - coalesce(tau / (tau + variance), 0)) * parent)), 4) AS factor FROM s, st""")
def m12_segment_factors(spark, d):
    """Error factors per segment: bootstrapped weighted quantiles, drawn to contig and genome."""
    t = V.tracks(spark, d)
    mu = t.groupBy("contig", "bin").agg(F.avg("x").alias("mu"))
    group = F.concat_ws(":", "contig", "sample", F.floor(F.col("bin") / 16).cast("string"))
    rows = t.join(mu, ["contig", "bin"]).select("contig", F.floor(F.col("bin") / 64).alias("segment"), F.round(F.abs(F.col("x") - F.col("mu")) / 0.4, 3).alias("ratio"), (1 + F.sqrt("raw")).alias("weight"), group.alias("group"))
    out = segment_factors.segment_factors(rows, 0.9, 1.645, 16, 5)
    return out.select("contig", "segment", r4("raw").alias("raw"), F.round("variance", 5).alias("variance"), r4("alpha").alias("alpha"), r4("factor").alias("factor"))


def _states(spark, d):
    return V.mean_track(spark, d).select("contig", "bin", (F.col("x") - 4).alias("state"), (0.05 + F.col("x") / 40).alias("variance"))


def _em(k: int) -> str:
    """SQL of one step of the mixture with slabs a and b: parameters p{k} to p{k + 1}."""
    dens = lambda v: f"exp(-0.5 * x * x / (v + {v})) / sqrt(2 * pi() * (v + {v}))"
    second = lambda v: f"(power({v} / ({v} + v) * x, 2) + {v} / ({v} + v) * v)"
    return f"""e{k} AS (SELECT sum(w) AS total, sum(w * l0 / t) AS n0, sum(w * la / t) AS na, sum(w * lb / t) AS nb, sum(w * la / t * {second("va")}) AS sa, sum(w * lb / t * {second("vb")}) AS sb, sum(w * ln(t)) AS loglik FROM (SELECT *, l0 + la + lb AS t FROM (SELECT x, v, w, va, vb, pi0 * {dens(0)} AS l0, (1 - pi0) * wa * {dens("va")} AS la, (1 - pi0) * (1 - wa) * {dens("vb")} AS lb FROM states, p{k}))),
p{k + 1} AS MATERIALIZED (SELECT greatest(0.01, least(0.9999, (n0 + 0.1 * total) / (1.1 * total))) AS pi0, CASE WHEN sa / na <= sb / nb THEN na / (na + nb) ELSE nb / (na + nb) END AS wa, least(sa / na, sb / nb) AS va, greatest(sa / na, sb / nb) AS vb FROM e{k})"""


@query(f"""WITH {TRACKS}, {MEAN}, states AS MATERIALIZED (SELECT x - 4 AS x, 0.05 + x / 40 AS v, 1.0 / count(*) OVER (PARTITION BY contig, bin // 10) AS w FROM mean_track),
i AS (SELECT sum(w) AS w, sum(CASE WHEN abs(x) <= 1.5 * sqrt(v) THEN w ELSE 0 END) AS c, sum(w * greatest(x * x - v, 0)) AS m FROM states),
p0 AS MATERIALIZED (SELECT greatest(0.01, least(0.9999, c / w / 0.8663855974622838)) AS pi0, 0.5 AS wa, m / w * 0.25 AS va, m / w * 4 AS vb FROM i), {_em(0)}, {_em(1)}, {_em(2)}, {_em(3)}
SELECT round(pi0, 4) AS share, round(wa, 4) AS weight_a, round(va, 4) AS variance_a, round(vb, 4) AS variance_b, round(loglik, 3) AS loglik FROM p3, e3""")
def m10_slab_prior(spark, d):
    """Spike and two normal slabs after three steps, and their log-likelihood."""
    p = slab_prior.fit_prior(_states(spark, d), student=False, block=10, steps=3, tol=0.0, multipliers=(0.5, 2.0))
    row = tuple(float(v) for v in (round(p.share, 4), round(p.weight[0], 4), round(p.variance[0], 4), round(p.variance[1], 4), round(p.loglik, 3)))
    return spark.createDataFrame([row], "share double, weight_a double, variance_a double, variance_b double, loglik double")


@query(f"""WITH {TRACKS}, {MEAN}, y AS (SELECT contig, bin, x - 4 AS x, 0.05 + x / 40 AS v FROM mean_track), l AS (SELECT *, 0.6 / sqrt(v) * exp(-0.5 * x * x / v) AS a, 0.28 / sqrt(v + 0.5) * exp(-0.5 * x * x / (v + 0.5)) AS b, 0.12 / sqrt(v + 3) * exp(-0.5 * x * x / (v + 3)) AS c FROM y),
r AS (SELECT *, (b * 0.5 / (v + 0.5) + c * 3 / (v + 3)) * x / (a + b + c) AS m, (b * (power(0.5 / (v + 0.5) * x, 2) + 0.5 * v / (v + 0.5)) + c * (power(3 / (v + 3) * x, 2) + 3 * v / (v + 3))) / (a + b + c) AS s FROM l)
SELECT contig, bin, round(m, 4) AS shrunk, round(sqrt(greatest(s - m * m, 0)), 4) AS shrunk_sd, round(a / (a + b + c), 4) AS null_mass FROM r""")
def p21_posterior_moments(spark, d):
    """Posterior mean, standard deviation and spike mass of every state."""
    out = slab_prior.posterior(_states(spark, d), slab_prior.SlabPrior(0.6, (0.7, 0.3), (0.5, 3.0)))
    return out.select("contig", "bin", r4("shrunk").alias("shrunk"), r4("shrunk_sd").alias("shrunk_sd"), r4("null").alias("null_mass"))


# ---- wide peaks ---------------------------------------------------------------------------------------------------------
def _wide(spark, d):
    m = V.mean_track(spark, d)
    return m, intervals.runs(m.filter("x > 2").select("contig", "bin"), 2)


@query(f"""WITH {TRACKS}, {MEAN}, t AS (SELECT contig, bin, x, CASE WHEN bin - lag(bin) OVER (PARTITION BY contig ORDER BY bin) <= 3 THEN 0 ELSE 1 END AS n FROM mean_track WHERE x > 2),
i AS (SELECT contig, min(bin) AS peak, max(bin) AS hi FROM (SELECT *, sum(n) OVER (PARTITION BY contig ORDER BY bin) AS k FROM t) GROUP BY contig, k),
c AS MATERIALIZED (SELECT i.contig, peak, hi - peak + 1 AS n, bin - peak AS j, x FROM i JOIN mean_track m ON m.contig = i.contig AND m.bin BETWEEN peak AND hi),
q AS (SELECT contig, peak, quantile_cont(x, 0.25) AS base, quantile_cont(x, 0.5) AS mid, quantile_cont(x, 0.75) AS q3 FROM c GROUP BY ALL),
s AS (SELECT contig, peak, 1.4826 * quantile_cont(abs(x - mid), 0.5) AS mad FROM c JOIN q USING (contig, peak) GROUP BY ALL),
p AS MATERIALIZED (SELECT contig, peak, n, j, sum(base - x) OVER (PARTITION BY contig, peak ORDER BY j) AS upto, sum(base - x) OVER (PARTITION BY contig, peak ORDER BY j) - (base - x) AS before FROM c JOIN q USING (contig, peak) WHERE n >= 15),
b AS (SELECT contig, peak, arg_max({{'a': a, 'e': e, 'd': d}}, {{'d': round(d, 9), 'e': -e, 'a': -a}}) AS g FROM (SELECT x.contig, x.peak, x.j AS a, y.j AS e, y.upto - x.before AS d FROM p x JOIN p y ON x.contig = y.contig AND x.peak = y.peak AND x.j >= 5 AND y.j >= x.j + 4 AND y.j <= y.n - 6) GROUP BY ALL)
SELECT contig, peak, peak + g.a AS gap_first, peak + g.e AS gap_last, round(g.d, 4) AS deficit, round(g.d - 1.0, 4) AS gain, round(g.d / (CASE WHEN mad > 1e-12 THEN mad WHEN q3 - base > 1e-12 * 1.349 THEN (q3 - base) / 1.349 ELSE 1.0 END * sqrt(g.e - g.a + 1)), 4) AS z FROM b JOIN s USING (contig, peak) JOIN q USING (contig, peak)""")
def x5_best_gaps(spark, d):
    """The gap with the largest deficit in each wide run of the mean track."""
    m, peaks = _wide(spark, d)
    cells = peaks.select("contig", F.col("first_bin").alias("peak"), F.explode(F.sequence("first_bin", "last_bin")).alias("bin")).join(m, ["contig", "bin"]).withColumnRenamed("x", "score")
    least = peaks.select("contig", F.col("first_bin").alias("peak"), F.lit(5).cast("long").alias("least"))
    g = widths.best_gaps(cells, least, 0.5)
    return g.select("contig", "peak", "gap_first", "gap_last", r4("deficit").alias("deficit"), r4("gain").alias("gain"), r4("z").alias("z"))


@query()
def x4_x6_tamed_peaks(spark, d):
    """Width policy over all runs, then splitting and contraction of those of 30 bins or more; tests hold both against recursion."""
    m, peaks = _wide(spark, d)
    runs = peaks.select("contig", F.col("first_bin").alias("first"), F.col("last_bin").alias("last"))
    policy = widths.width_policy(runs.select((F.col("last") - F.col("first") + 1).alias("width")), least=30, peaks_needed=5)
    threshold = int(policy["threshold"] or 30)
    return widths.tame(runs, m.withColumnRenamed("x", "score"), threshold, 20, 3, 0.5, child=5).select("contig", (F.col("first") * WIDTH).alias("start"), ((F.col("last") + 1) * WIDTH).alias("end"), "how")


# ---- variance terms, process seed, fragment length, heterogeneity -------------------------------------------------------
def _sample_blocks(spark, d):
    t = V.tracks(spark, d).withColumn("block", F.floor(F.col("bin") / 8))
    return t.groupBy("sample", "contig", "block").agg(F.avg("x").alias("mean"), F.var_samp("x").alias("variance"), F.count(F.lit(1)).cast("double").alias("weight"), F.avg(F.col("bin") % 7 / 7).alias("gc"), F.avg(F.col("raw") / 100).alias("depth"))


@query()
def m2_sample_factors(spark, d):
    """Variance factors of the samples around one pooled trend; tests hold them against samples of known factors."""
    _, factors = variance_terms.pooled_trend(_sample_blocks(spark, d))
    return spark.createDataFrame([(s, round(f, 4)) for s, f in sorted(factors.items())], "sample string, factor double")


@query()
def m3_m5_covariate_variance(spark, d):
    """Added variance of every block by its covariates; tests hold the coefficients against the optimality conditions."""
    b = _sample_blocks(spark, d)
    terms = variance_terms.fit_covariates(b.withColumn("baseline", F.lit(0.02)), ["gc", "depth"], least=50)
    return b.select("sample", "contig", "block", r4(terms.variance(F.col("mean"), F.col("sample"))).alias("added"))


def _weighted(table: str, value: str, q: float) -> str:
    return f"(SELECT min(v) FROM (SELECT {value} AS v, sum(sum(w)) OVER (ORDER BY {value}) AS run, sum(sum(w)) OVER () AS total FROM {table} GROUP BY {value}) WHERE run >= {q} * total - 1e-9)"


@query(f"""WITH {TRACKS}, l AS (SELECT bin - lag(bin) OVER o AS step, x - lag(x) OVER o AS d, v + lag(v) OVER o AS s FROM (SELECT *, 0.05 + 0.2 / (1 + raw) AS v FROM tracks) WINDOW o AS (PARTITION BY contig, sample ORDER BY bin)),
t AS MATERIALIZED (SELECT d, s, 1 / s AS w FROM l WHERE step = 1), c AS MATERIALIZED (SELECT {_weighted("t", "d", 0.5)} AS centre, {_weighted("t", "s", 0.5)} AS mid, {_weighted("t", "w", 0.5)} AS wmid),
o AS (SELECT abs(d - centre) AS a, w FROM t, c), p AS MATERIALIZED (SELECT greatest(power(1.4826 * {_weighted("o", "a", 0.5)}, 2) - mid, 0.0001) AS prior, wmid FROM c),
g AS MATERIALIZED (SELECT i, exp(ln(0.0001) + i * (ln(20.0) - ln(0.0001)) / 40) AS q FROM (SELECT unnest(range(41)) AS i)),
k AS MATERIALIZED (SELECT i, q, sum(greatest(0.25, least(4.0, w / wmid)) * (-0.5 * ln(q + s) - 4.5 * ln(1 + d * d / (8 * (q + s))))) - 0.5 * power((ln(q) - ln(any_value(prior))) / 2, 2) AS post FROM g, t, p GROUP BY i, q),
m AS (SELECT i, q, post, sum(exp(post - top)) OVER (ORDER BY i) / sum(exp(post - top)) OVER () AS upto FROM k, (SELECT max(post) AS top FROM k))
SELECT (SELECT count(*) FROM t) AS transitions, round((SELECT prior FROM p), 5) AS prior, round(arg_max(q, post), 5) AS mode, round(min(q) FILTER (WHERE upto >= 0.5 - 1e-12), 5) AS median, round(min(q) FILTER (WHERE upto >= 0.05 - 1e-12), 5) AS low, round(min(q) FILTER (WHERE upto >= 0.95 - 1e-12), 5) AS high FROM m""")
def m9_process_seed(spark, d):
    """Grid posterior of the step variance from all neighbouring bins of all samples."""
    cells = V.tracks(spark, d).withColumn("v", 0.05 + 0.2 / (1 + F.col("raw")))
    p = process_seed.seed_posterior(process_seed.transitions(cells), 1e-4, cap=20.0, size=41)
    return spark.createDataFrame([(p["transitions"], *(round(float(p[k]), 5) for k in ("prior", "mode", "median", "low", "high")))], "transitions long, prior double, mode double, median double, low double, high double")


@query(f"""WITH {FRAGMENTS}, {CONTIGS}, grid AS (SELECT contig, size, unnest(range(size // 50)) AS chunk FROM contigs WHERE size >= 500),
n AS (SELECT contig, s // 50 AS chunk, count(*) AS n FROM fragments GROUP BY ALL), l AS MATERIALIZED (SELECT contig, size, list(coalesce(n, 0) ORDER BY chunk) AS l FROM grid LEFT JOIN n USING (contig, chunk) GROUP BY contig, size),
r AS (SELECT contig, size, len(l) AS k, chunk, list_sort([l[least(greatest(j, 0), len(l) - 1) + 1] FOR j IN range(chunk - 5, chunk + 6)])[6] AS level FROM l, LATERAL (SELECT unnest(range(len(l))) AS chunk)),
top AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY contig ORDER BY level DESC, chunk) <= 4),
b AS MATERIALIZED (SELECT DISTINCT contig, centre, least(greatest(centre * 50 + 25 - 250, 0), size - 500) AS lo FROM (SELECT contig, size, unnest(range(least(greatest(chunk - 5, 0), greatest(k - 11, 0)), least(least(greatest(chunk - 5, 0), greatest(k - 11, 0)) + 11, k))) AS centre FROM top)),
c AS (SELECT contig, centre, control AS rev, CASE WHEN control THEN e - 1 ELSE s END - lo AS p, count(*) AS k FROM b JOIN fragments USING (contig) WHERE s >= lo AND e <= lo + 500 AND e > s GROUP BY ALL),
v AS MATERIALIZED (SELECT contig, centre, list(f ORDER BY p) AS f, list(r ORDER BY p) AS r FROM (SELECT b.contig, b.centre, x.p, CAST(coalesce(sum(k) FILTER (WHERE NOT rev), 0) AS DOUBLE) AS f, CAST(coalesce(sum(k) FILTER (WHERE rev), 0) AS DOUBLE) AS r FROM b CROSS JOIN (SELECT unnest(range(500)) AS p) x LEFT JOIN c ON c.contig = b.contig AND c.centre = b.centre AND c.p = x.p GROUP BY ALL) GROUP BY ALL HAVING sum(f) >= 10 AND sum(r) >= 10),
z AS MATERIALIZED (SELECT contig, centre, [y - list_avg(f) FOR y IN f] AS f, [y - list_avg(r) FOR y IN r] AS r FROM v),
s AS (SELECT contig, centre, lag, round(list_dot_product(f[1 : 500 - lag], r[1 + lag : 500]), 6) AS score FROM z, (SELECT unnest(range(5, 81, 5)) AS lag))
SELECT contig, centre, CAST(arg_max(lag, {{'s': score, 'l': -lag}}) AS BIGINT) AS lag, round(max(score) + 1e-5, 3) AS score FROM s GROUP BY ALL""")
def a13_single_end_lags(spark, d):
    """Best lag between forward and reverse 5' ends in the densest blocks. A contig of these tables has one strand only, so the control
    column stands for it."""
    f = V.fragments(spark, d).select("contig", "start", "end", F.col("control").alias("reverse"))
    lags = fragment_length.best_lags(f, V.contigs(spark, d), 5, 80, 5, 500, 50, 4, 10)
    return lags.select("contig", "centre", "lag", F.round(F.round("score", 6) + 1e-5, 3).alias("score"))


_NOISE = "noise AS (SELECT contig, bin // 8 AS block, sample, var_samp(x) AS variance, 0.1 + avg(x) / 50 AS prior FROM tracks GROUP BY ALL HAVING var_samp(x) > 0)"


@query(f"""WITH {TRACKS}, {_NOISE}, s AS (SELECT contig, block, sample, 0.5 * (ln(variance) - ln(prior)) AS s, count(*) OVER (PARTITION BY contig, block) AS n FROM noise), e AS MATERIALIZED (SELECT contig, block, sample, s - avg(s) OVER (PARTITION BY contig, block) AS e FROM s WHERE n = (SELECT count(DISTINCT sample) FROM noise)),
o AS (SELECT max(abs(m)) AS statistic FROM (SELECT avg(e) AS m FROM e GROUP BY sample)), d AS (SELECT e, draw, row_number() OVER (PARTITION BY draw, contig, block ORDER BY {u(4, "draw", "contig", "block", "sample")}) AS r FROM e, (SELECT unnest(range(40)) AS draw)),
p AS (SELECT draw, max(abs(m)) AS m FROM (SELECT draw, r, avg(e) AS m FROM d GROUP BY draw, r) GROUP BY draw)
SELECT (SELECT count(*) FROM (SELECT DISTINCT contig, block FROM e)) AS blocks, round(statistic, 5) AS statistic, (SELECT count(*) FROM p WHERE p.m >= statistic - 1e-12) AS exceeding, round(((SELECT count(*) FROM p WHERE p.m >= statistic - 1e-12) + 1) / 41.0, 5) AS p FROM o""")
def a41_heterogeneity(spark, d):
    """Do the samples' block noises differ? Permutations within blocks."""
    t = V.tracks(spark, d).groupBy("contig", F.floor(F.col("bin") / 8).alias("block"), "sample").agg(F.var_samp("x").alias("variance"), (0.1 + F.avg("x") / 50).alias("prior"))
    _, one = heterogeneity.permutation_test(t, 40, 4)
    return one.select("blocks", F.round("statistic", 5).alias("statistic"), "exceeding", F.round("p", 5).alias("p"))


# ---- calibration by deleted blocks --------------------------------------------------------------------------------------
@query(f"""WITH {TRACKS}, b AS MATERIALIZED (SELECT DISTINCT contig, bin // 20 AS block, sample FROM tracks),
f AS (SELECT contig, block, (row_number() OVER (PARTITION BY contig ORDER BY {u(5, "contig", "block")}, block) - 1) % 5 AS fold FROM (SELECT DISTINCT contig, block FROM b)),
k AS (SELECT *, row_number() OVER (PARTITION BY contig, block ORDER BY u, sample) AS k, count(*) OVER (PARTITION BY contig, block) AS n FROM (SELECT *, {u(6, "contig", "block", "sample")} AS u FROM b))
SELECT contig, block, fold, sample FROM k JOIN f USING (contig, block) WHERE k < n AND (k = 1 OR u < 0.5)""")
def t9_deleted_folds(spark, d):
    """Folds of permuted blocks, and the samples deleted in each block: one at least, not all."""
    return calibration.fold_spec(V.tracks(spark, d), 20, 5, 5)


@query()
def m13_calibrated_states(spark, d):
    """Standard errors of the level calibrated by refits without deleted blocks; tests hold every refit against sequential code."""
    out, _ = calibration.calibrate(_cells(spark, d), consensus.Model((0.05,)), 20, folds=3, passes=4, replicates=16)
    return out.select("contig", "bin", r4("level").alias("level"), r4("se").alias("se"), r4("calibrated").alias("calibrated"))


# ---- peak scores ----------------------------------------------------------------------------------------------------------
@query(f"""WITH {_DRAWS}, tr AS MATERIALIZED (SELECT contig, -1 AS draw, bin, r AS v FROM e WHERE draw = 0 UNION ALL SELECT contig, draw, bin, v FROM nul),
y AS (SELECT contig, draw, bin, 1 AS sc, v AS y FROM tr UNION ALL SELECT contig, draw, bin, 3, avg(v) OVER (PARTITION BY contig, draw ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) FROM tr),
a AS (SELECT *, y - z AS x FROM y, (SELECT unnest([CAST(0.5 AS DOUBLE), 1.0]) AS z) WHERE y > z), b AS (SELECT *, CASE WHEN bin - lag(bin) OVER (PARTITION BY contig, draw, sc, z ORDER BY bin) = 1 THEN 0 ELSE 1 END AS n FROM a),
i AS (SELECT *, sum(n) OVER (PARTITION BY contig, draw, sc, z ORDER BY bin) AS k FROM b), s AS (SELECT contig, draw, min(bin) AS first, max(bin) AS last, sum(x) / sqrt(count(*)) AS adjusted FROM i GROUP BY contig, draw, sc, z, k),
cand AS MATERIALIZED (SELECT contig, draw, first, last, max(adjusted) AS adjusted FROM s GROUP BY ALL),
o AS MATERIALIZED (SELECT contig, first, last, adjusted FROM cand WHERE draw < 0), m AS MATERIALIZED (SELECT adjusted FROM cand WHERE draw >= 0),
f AS MATERIALIZED (SELECT DISTINCT adjusted, (SELECT count(*) FROM m WHERE m.adjusted >= o.adjusted) AS above, (SELECT count(*) FROM o o2 WHERE o2.adjusted >= o.adjusted) AS seen FROM o),
q AS (SELECT adjusted, (1 + above) / ((SELECT count(*) FROM m) + 1.0) AS p, min(least(1.0, (above / 6.0 + 1 / 7.0) / seen)) OVER (ORDER BY adjusted) AS q FROM f),
pk AS (SELECT DISTINCT contig, first, last FROM (SELECT contig, min(bin) AS first, max(bin) AS last FROM i WHERE draw < 0 AND sc = 1 AND z = 1.0 GROUP BY contig, k))
SELECT contig, first, last, round(adjusted, 4) AS adjusted, round(p, 5) AS p, round(greatest(p, q), 5) AS q FROM pk JOIN o USING (contig, first, last) JOIN q USING (adjusted)""")
def x13_peak_scores(spark, d):
    """Runs of the centred track scored by observed and replayed candidate segments at two scales and two thresholds."""
    m = V.mean_track(spark, d)
    mu = m.groupBy("contig").agg(F.avg("x").alias("mu"))
    track = peak_scores.staged(m.join(mu, "contig").select("contig", "bin", (F.col("x") - F.col("mu")).alias("y")), "track")
    null = peak_scores.staged(_draws(spark, d).select("contig", "draw", "bin", F.col("null").alias("y")), "null")
    called = intervals.runs(track.filter("y > 1.0").select("contig", "bin")).select("contig", F.col("first_bin").alias("first"), F.col("last_bin").alias("last"))
    out = peak_scores.score_peaks(called, track, null, "y", (1, 3), (0.5, 1.0), 6, metrics=("adjusted",))
    return out.select("contig", "first", "last", r4("adjusted").alias("adjusted"), F.round("p_adjusted", 5).alias("p"), F.round("q_adjusted", 5).alias("q"))
