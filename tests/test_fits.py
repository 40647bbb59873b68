"""Null centre, dependence span, segment factors, slab prior and width policies against plain sequential code."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from gridloom.operators import dependence as D
from gridloom.operators import fragment_length as L
from gridloom.operators import heterogeneity as H
from gridloom.operators import null_model as N
from gridloom.operators import process_seed as G
from gridloom.operators import segment_factors as S
from gridloom.operators import slab_prior as P
from gridloom.operators import statistics as Q
from gridloom.operators import variance_terms as T
from gridloom.operators import widths as W


def uniform(seed, *values):
    text = ":".join(str(v) for v in (seed, *values))
    return (int(hashlib.md5(text.encode()).hexdigest()[:8], 16) + 0.5) / 2**32


# ---- running sums and ranks --------------------------------------------------------------------------------------------
@pytest.mark.parametrize("cells", [3])
def test_cumulative(spark, cells):
    rng = np.random.default_rng(1)
    rows = [(k, float(v), int(w)) for k in ("a", "b") for v, w in zip(np.unique(np.round(rng.exponential(1e-3, 300), 6)), rng.integers(1, 9, 300), strict=False)]
    df = spark.createDataFrame(rows, "k string, v double, w long")
    for down in (False, True):
        got = {(r["k"], r["v"]): (r["s"], r["m"]) for r in Q.cumulative(df.withColumn("m0", df["w"]), ["k"], "v", {"s": "w"}, down, cells=cells).join(Q.cumulative(df, ["k"], "v", {"m": "w"}, down, "max", cells).select("k", "v", "m"), ["k", "v"]).collect()}
        for k, v, _ in rows:
            upto = [w for j, u, w in rows if j == k and (u >= v if down else u <= v)]
            assert got[k, v] == (sum(upto), max(upto))


def test_mid_ranks(spark):
    df = spark.createDataFrame([(x,) for x in (3.0, 1.0, 3.0, 2.0, 3.0)], "x double")
    got = sorted((r["x"], r["r"]) for r in Q.mid_ranks(df, "x", "r", descending=True).collect())
    assert got == [(1.0, 5.0), (2.0, 4.0), (3.0, 2.0), (3.0, 2.0), (3.0, 2.0)]


# ---- null centre -------------------------------------------------------------------------------------------------------
def plain_mode(v):
    v = list(v)
    if len(v) <= 2:
        return sum(v) / len(v)
    if len(v) == 3:
        return sum(v[:2]) / 2 if v[1] - v[0] <= v[2] - v[1] else sum(v[1:]) / 2
    w = math.ceil(len(v) / 2)
    best = min(range(len(v) - w + 1), key=lambda i: (v[i + w - 1] - v[i], i))
    return plain_mode(v[best : best + w])


@pytest.mark.parametrize("small", [64])
def test_half_sample_mode(spark, small):
    rng, rows, want = np.random.default_rng(2), [], {}
    for name, n in (("a", 501), ("b", 64), ("c", 3), ("d", 1), ("e", 200)):
        v = np.round(rng.gamma(2.0, 1.0, n), 1 if name == "e" else 6)
        rows += [(name, float(x)) for x in v] + [(name, None)]
        want[name] = plain_mode(sorted(v))
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {r["k"]: r["mode"] for r in N.half_sample_mode(df, ["k"], "v", small=small).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def plain_scale(v):
    v = np.asarray(v)
    mad = 1.4826 * np.median(np.abs(v - np.median(v)))
    iqr = (np.quantile(v, 0.75) - np.quantile(v, 0.25)) / 1.349 if len(v) >= 4 else 0.0
    return max(mad, iqr, np.std(v, ddof=1) if len(v) > 1 else 0.0, 1e-6)


def plain_null(z, bulk=0.6):
    z, least = np.asarray(z), max(16, math.ceil(0.05 * len(z)))
    low = z[z <= np.quantile(z, bulk, method="interpolated_inverted_cdf")]
    low = z if len(low) < least else low
    centre = plain_mode(sorted(low))
    radius = max(2.5 * plain_scale(low - centre), np.quantile(np.abs(low - centre), 0.5, method="interpolated_inverted_cdf"), 1e-6)
    far = np.abs(z - centre)
    reach = max(radius, np.sort(far)[least - 1]) if len(z) >= least else np.inf
    support = z[far <= reach] - centre
    return centre, plain_scale(support), len(support), radius


def test_null_centre(spark):
    rng, rows, want = np.random.default_rng(3), [], {}
    for name, n in (("a", 900), ("b", 40), ("c", 18), ("d", 9)):
        z = np.concatenate([rng.normal(1, 0.5, n - n // 5), rng.normal(6, 2, n // 5)])
        rows += [(name, float(x)) for x in z]
        want[name] = plain_null(z)
    got = {r["k"]: (r["centre"], r["scale"], r["support"], r["radius"]) for r in N.null_centre(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    for k, w in want.items():
        assert np.allclose(got[k], w, rtol=1e-9), k


# ---- dependence span ---------------------------------------------------------------------------------------------------
def test_correlation_against_sums():
    rng = np.random.default_rng(4)
    x = np.cumsum(rng.normal(size=(3, 120)), axis=1)
    x[rng.random(x.shape) < 0.1] = np.nan
    got, rows = D.pooled_correlation(x, 30, 20, 0.3), []
    for v in x:
        seen = np.isfinite(v)
        c = np.clip(v, *np.quantile(v[seen], [0.005, 0.995]))
        c = c - c[seen].mean()
        cov = [np.mean([c[i] * c[i + k] for i in range(120 - k) if seen[i] and seen[i + k]]) for k in range(31)]
        rows.append(np.array(cov[1:]) / cov[0])
    assert np.allclose(got, np.median(rows, axis=0), atol=1e-9)
    assert len(D.pooled_correlation(np.zeros((2, 50)), 10, 5, 0.3)) == 0


def test_crossing():
    r = np.array([0.9, 0.5, 0.05, 0.3, 0.05, 0.04, 0.03, 0.02])
    assert D.crossing(r, 0.1, 1, 2) == (5, False) and D.crossing(r, 0.1, 1, 1) == (3, False)
    assert D.crossing(np.full(8, 0.5), 0.1, 3, 2) == (6, True) and D.crossing(r[:2], 0.1, 3, 2) is None


def plain_survival(rows):
    alive, n, out = 1.0, len(rows), []
    for t in sorted({r for r, _ in rows}):
        d = sum(r == t and not c for r, c in rows)
        alive *= 1 - d / n
        n -= sum(r == t for r, _ in rows)
        out.append((t, d, alive))
    return out


def plain_quantile(rows, q):
    return next((t for t, d, s in plain_survival(rows) if d and 1 - s + 1e-12 >= q), None)


def test_dependence_span(spark):
    rng = np.random.default_rng(5)
    rows = [(c, int(w), round(float(rng.gamma(2, 3)), 1), float(r), bool(rng.random() < 0.2)) for c, n in (("a", 30), ("b", 12), ("c", 3)) for w, r in zip(sorted(rng.choice(40, n, replace=False)), rng.integers(2, 30, n), strict=True)]
    df = spark.createDataFrame(rows, "contig string, window long, score double, radius double, censored boolean").repartition(3)
    scores = [r[2] for r in rows]
    rank = {s: np.mean([i + 1 for i, v in enumerate(sorted(scores, reverse=True)) if v == s]) for s in scores}
    keyed = sorted((-math.log(uniform(9, c, w)) / (len(rows) - rank[s] + 1), c, w, r, z) for c, w, s, r, z in rows)[:25]
    got = D.sampled_windows(df, 25, 9).collect()
    assert sorted((r["contig"], r["window"]) for r in got) == sorted(k[1:3] for k in keyed)
    pairs = [k[3:] for k in keyed]
    curve = D.survival(D.sampled_windows(df, 25, 9), []).orderBy("radius").collect()
    assert np.allclose([(r["radius"], r["_d"], r["survival"]) for r in curve], plain_survival(pairs))
    one = D.dependence_span(df, 25, 0.75, 40, 3.0, 9).first()
    assert (one["windows"], one["censored"]) == (25, sum(z for _, z in pairs)) and one["median"] == plain_quantile(pairs, 0.5) and one["span"] == plain_quantile(pairs, 0.75)
    by = {}
    for _, c, w, r, z in sorted(keyed, key=lambda k: k[1:3]):
        by.setdefault(c, []).append((w, r, z))
    names, draws = sorted(by), {}
    for draw in range(40):
        for slot in range(len(names)):
            ws = by[names[min(int(uniform(9, draw, slot) * len(names)), len(names) - 1)]]
            n = len(ws)
            for step in range(n):
                to = min(int(uniform(11, draw, slot, step) * n), n - 1)
                if step == 0 or uniform(10, draw, slot, step) < 1 / 3.0:
                    first, since = to, step
                at = first + step - since
                if at >= n or ws[at][0] - ws[first][0] != at - first:
                    at = to
                draws.setdefault(draw, []).append(ws[at][1:])
    redrawn = D.bootstrap_radii(D.sampled_windows(df, 25, 9), 40, 3.0, 9).collect()
    assert sorted((r["draw"], r["radius"], r["censored"]) for r in redrawn) == sorted((k, *x) for k, v in draws.items() for x in v)
    medians = [m for m in (plain_quantile(v, 0.5) for v in draws.values()) if m is not None]
    assert one["resolved"] == len(medians) and np.allclose([one["low"], one["high"]], [min(np.quantile(medians, 0.05), one["median"]), max(np.quantile(medians, 0.95), one["median"])])


# ---- segment factors ---------------------------------------------------------------------------------------------------
def plain_poisson(u):
    k, total, term = 0, 0.0, math.exp(-1)
    while True:
        total += term
        if total > u:
            return k
        k += 1
        term /= k


def test_bootstrap_quantiles(spark):
    rng = np.random.default_rng(6)
    rows = [(k, round(float(rng.gamma(1, 1)), 2), float(rng.integers(1, 5)), int(rng.integers(0, 6))) for k in ("a", "b") for _ in range(120)]
    df = spark.createDataFrame(rows, "k string, ratio double, weight double, grp int").repartition(3)
    got = {(r["k"], r["replicate"]): r["quantile"] for r in S.bootstrap_quantiles(df, ["k"], "ratio", "weight", "grp", 0.9, 12, 5, cells=8).collect()}
    for k in ("a", "b"):
        for rep in range(13):
            drawn = sorted((v, w * (1 if rep == 0 else plain_poisson(uniform(5, rep, g)))) for j, v, w, g in rows if j == k)
            need, run = 0.9 * sum(w for _, w in drawn), 0.0
            for v, w in drawn:
                run += w
                if run >= need - 1e-9:
                    break
            assert got[k, rep] == v


def test_segment_factors(spark):
    rng = np.random.default_rng(7)
    rows = [(c, s, float(abs(rng.normal(0, 1 + 0.3 * s))), 1.0, f"{c}{s}{i % 5}") for c in ("a", "b") for s in range(4) for i in range(60)]
    df = spark.createDataFrame(rows, "contig string, segment long, ratio double, weight double, group string")
    got = S.segment_factors(df, 0.9, 1.645, replicates=16, seed=3).collect()
    assert len(got) == 8 and all(0 <= r["alpha"] <= 1 and r["factor"] >= 1 for r in got)
    raw = {r["contig"]: r for r in S.log_factors(df, ["contig"], 0.9, 1.645, 16, 3, 0.05, 20.0).collect()}
    w = {c: 1 / r["variance"] for c, r in raw.items()}
    genome = sum(w[c] * raw[c]["raw"] for c in raw) / sum(w.values())
    tau = max(0.0, sum(w[c] * ((raw[c]["raw"] - genome) ** 2 - raw[c]["variance"]) for c in raw) / sum(w.values()))
    contig = {c: (a := tau / (tau + r["variance"])) * r["raw"] + (1 - a) * genome for c, r in raw.items()}
    ws = [1 / r["variance"] for r in got]
    tau = max(0.0, sum(v * ((r["raw"] - contig[r["contig"]]) ** 2 - r["variance"]) for v, r in zip(ws, got, strict=True)) / sum(ws))
    for r in got:
        a = tau / (tau + r["variance"])
        assert abs(r["theta"] - (a * r["raw"] + (1 - a) * contig[r["contig"]])) < 1e-9


# ---- spike and slab ----------------------------------------------------------------------------------------------------
def slab_rows(seed, n=1200):
    rng = np.random.default_rng(seed)
    v = rng.uniform(0.2, 0.6, n)
    x = np.where(rng.random(n) < 0.7, 0.0, rng.normal(0, 2.5, n)) + rng.normal(size=n) * np.sqrt(v)
    return [("c", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, v, strict=True))]


def test_laguerre():
    nodes, weights = P.laguerre(12, -0.5)
    for power, want in ((0, 1.0), (1, 0.5), (2, 0.75), (3, 1.875)):  # moments of a gamma of shape 1/2
        assert abs((weights * nodes**power).sum() - want) < 1e-9


def test_expectation_and_posterior(spark):
    rows = slab_rows(1, 300)
    df = spark.createDataFrame(rows, "contig string, bin long, state double, variance double").repartition(3)
    prior = P.SlabPrior(0.6, (0.7, 0.3), (1.0, 6.0))
    got = P.expectation(P.weighted_rows(df, 10), prior)
    total = spike = loglik = 0.0
    mass, second, post = np.zeros(2), np.zeros(2), {}
    for _, i, x, v in rows:
        parts = [s * math.exp(-0.5 * x * x / (v + k)) / math.sqrt(2 * math.pi * (v + k)) for s, k in ((0.6, 0), (0.28, 1), (0.12, 6))]
        r = np.array(parts) / sum(parts)
        m = np.array([k / (k + v) * x for k in (1, 6)])
        s2 = m**2 + np.array([k * v / (k + v) for k in (1, 6)])
        total, spike, loglik = total + 0.1, spike + 0.1 * r[0], loglik + 0.1 * math.log(sum(parts))
        mass, second = mass + 0.1 * r[1:], second + 0.1 * r[1:] * s2
        mean = float(r[1:] @ m)
        post[i] = (mean, math.sqrt(float(r[1:] @ s2) - mean**2), r[0])
    assert np.allclose([got["total"], got["spike"], got["loglik"], *got["mass"], *got["second"]], [total, spike, loglik, *mass, *second])
    for r in P.posterior(df, prior).collect():
        assert np.allclose((r["shrunk"], r["shrunk_sd"], r["null"]), post[r["bin"]], atol=1e-9)


@pytest.mark.parametrize("student", [True, False])
def test_fit_prior(spark, student):
    df = spark.createDataFrame([*slab_rows(2), ("c", 5000, None, 1.0), ("c", 5001, 1.0, 0.0)], "contig string, bin long, state double, variance double").repartition(3)
    fits = [P.fit_prior(df, student=student, df=5.0, steps=k) for k in (1, 6)]
    assert fits[1].loglik > fits[0].loglik and 0.55 < fits[1].share < 0.9 and abs(sum(fits[1].weight) - 1) < 1e-9
    spread = sum(w * v for w, v in zip(fits[1].weight, fits[1].variance, strict=True))
    assert 2.0 < spread < 14.0
    with pytest.raises(ValueError, match="positive variance"):
        P.fit_prior(df.filter("bin = 5001"))


# ---- width policies ----------------------------------------------------------------------------------------------------
def plain_gap(s, least, split=0.25):
    n = len(s)
    if n < 3 * least:
        return None
    base = np.quantile(s, split)
    best = None
    for e in range(2 * least - 1, n - least):
        for a in range(least, e - least + 2):
            d = float((base - s[a : e + 1]).sum())
            if best is None or d > best[0] + 1e-9:
                best = (d, a, e)
    return best


def test_best_gaps(spark):
    rng, cells, want = np.random.default_rng(8), [], {}
    for k, n in enumerate((40, 25, 12, 8)):
        s = np.round(rng.normal(3, 1, n), 3)
        s[n // 3 : n // 2] -= 2.5
        cells += [("a", 100 * k, 100 * k + i, float(x)) for i, x in enumerate(s)]
        want[100 * k] = plain_gap(s, 3)
    df = spark.createDataFrame(cells, "contig string, peak long, bin long, score double").repartition(3)
    least = df.select("contig", "peak").distinct().selectExpr("contig", "peak", "3L AS least")
    got = {r["peak"]: r for r in W.best_gaps(df, least, 0.5).collect()}
    assert got.keys() == {p for p, w in want.items() if w}
    for p, w in want.items():
        if w:
            assert abs(got[p]["deficit"] - w[0]) < 1e-9 and (got[p]["gap_first"] - p, got[p]["gap_last"] - p) == w[1:]


def plain_core(s, cap, least, split=0.25):
    n, top = len(s), max(s)
    at = [i for i, x in enumerate(s) if x >= top - max(1e-12, abs(top) * 1e-12)]
    mid = float(np.median(at))
    c = int(np.argmin([abs(i - mid) for i in range(n)]))
    low = np.quantile(s, split)
    if top - low > 1e-12:
        keep = [x >= low + 0.5 * (top - low) for x in s]
        if keep[c]:
            a = b = c
            while a > 0 and keep[a - 1]:
                a -= 1
            while b + 1 < n and keep[b + 1]:
                b += 1
            if least <= b - a + 1 < min(cap, n):
                return a, b
    a = b = c
    while b - a + 2 < cap:
        ways = [(s[i], -abs(i - mid), d) for i, d in ((a - 1, -1), (b + 1, 1)) if 0 <= i < n]
        if not ways:
            break
        a, b = (a - 1, b) if max(ways)[2] < 0 else (a, b + 1)
    return (a, b) if least <= b - a + 1 < min(cap, n) else None


def test_cores(spark):
    rng, cells, want = np.random.default_rng(9), [], {}
    for k in range(12):
        n = int(rng.integers(6, 40))
        s = np.round(rng.normal(2, 1, n) + 5 * np.exp(-(((np.arange(n) - n / 2) / (1 + k)) ** 2)), 2) if k else np.full(n, 2.0)
        cells += [("a", 100 * k, 100 * k + i, float(x)) for i, x in enumerate(s)]
        want[100 * k] = plain_core(s.tolist(), 9, 3)
    got = {r["peak"]: (r["first"] - r["peak"], r["last"] - r["peak"]) for r in W.cores(spark.createDataFrame(cells, "contig string, peak long, bin long, score double"), 9, 3).collect()}
    assert got == {p: w for p, w in want.items() if w}


def plain_tame(s, a, b, threshold, cap, least, child, cost, level=0):
    """Recursive splitting of bins a..b, all gaps tried."""
    n, part = b - a + 1, s[a : b + 1]
    if n < threshold:
        return [(a, b, "kept" if level == 0 else "split")]
    scale = 1.4826 * np.median(np.abs(part - np.median(part)))
    found = plain_gap(part, child) if level < 8 else None
    if found and found[0] - 2 * cost > 0 and found[0] / (scale * math.sqrt(found[2] - found[1] + 1)) >= 2.0:
        left, right = (a, a + found[1] - 1), (a + found[2] + 1, b)
        return [x for c, d in (left, right) for x in plain_tame(s, c, d, threshold, cap, least, child, cost, level + 1)]
    core = plain_core(part.tolist(), cap, least)
    return [(a + core[0], a + core[1], "contracted")] if core else [(a, b, "kept" if level == 0 else "split")]


def test_tame(spark):
    rng = np.random.default_rng(10)
    s = rng.normal(5, 0.3, 211)
    s[28:36] -= 4.5
    s[110:118] -= 4.0
    peaks = spark.createDataFrame([("a", 0, 79), ("a", 90, 179), ("a", 200, 210)], "contig string, first long, last long")
    scores = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(s)], "contig string, bin long, score double")
    got = sorted((r["first"], r["last"], r["how"]) for r in W.tame(peaks, scores, 30, 20, 3, 0.5, child=5, share=0.0).collect())
    assert got == sorted(x for a, b in ((0, 79), (90, 179), (200, 210)) for x in plain_tame(s, a, b, 30, 20, 5, 5, 0.5))
    assert {h for _, _, h in got} == {"kept", "split", "contracted"}


def test_width_policy(spark):
    rng = np.random.default_rng(11)
    normal = np.round(np.exp(rng.normal(6, 0.3, 800))).astype(int)
    peaks = spark.createDataFrame([(int(w),) for w in (*normal, 9000, 9400, 30000)], "width long")
    told = W.width_policy(peaks)
    bulk = np.log(np.sort(np.array([*normal, 9000, 9400, 30000])))
    bulk = bulk[bulk <= np.quantile(bulk, 0.95)]
    assert abs(told["centre"] - np.median(bulk)) < 1e-9 and abs(told["scale"] - 1.4826 * np.median(np.abs(bulk - np.median(bulk)))) < 1e-9
    assert told["threshold"] == 7500.0 and told["tail"] == 3
    assert W.width_policy(peaks.limit(5))["threshold"] is None


# ---- variance terms, process seed, fragment length, heterogeneity -------------------------------------------------------
def test_nonnegative_solution():
    rng = np.random.default_rng(12)
    for _ in range(30):
        a, y = rng.normal(size=(30, 5)), rng.normal(size=30)
        b = T.nonnegative_solution(a.T @ a, a.T @ y, 0.3)
        slope = a.T @ y - (a.T @ a + 0.3 * np.eye(5)) @ b
        assert (b >= 0).all() and np.abs(slope[b > 0]).max(initial=0) < 1e-7 and slope[b == 0].max(initial=-1) < 1e-7


def test_fit_covariates(spark):
    rng = np.random.default_rng(13)
    rows = []
    for s in ("s0", "s1"):
        for i in range(300 if s == "s0" else 40):
            m, gc, rep = float(rng.gamma(2, 5)), float(rng.random()), float(rng.random())
            rows.append((s, m, 1.0 + 2.0 * gc * (2 if m > 8 else 1) + 0.0 * rep + 0.05 * float(rng.random()), 1.0, 1.0 + float(rng.random()), gc, rep))
    rows += [("s0", 1.0, 0.0, 1.0, 1.0, 0.1, 0.1), ("s0", 1.0, 2.0, 1.0, 1.0, None, 0.1)]
    df = spark.createDataFrame(rows, "sample string, mean double, variance double, baseline double, weight double, gc double, rep double").repartition(3)
    fit = T.fit_covariates(df, ["gc", "rep"], bins=3, ridge=0.5, least=100)
    assert fit.samples.keys() == {"s0"} and fit.blocks == {"s0": 300, "s1": 40} and len(fit.edges) == 2
    used = [r for r in rows if r[2] > 1e-12 and r[5] is not None]
    z = lambda m: math.copysign(math.log1p(abs(m)), m)
    for name, mine in (("pooled", fit.pooled), ("s0", fit.samples["s0"])):
        chosen = [r for r in used if name in ("pooled", r[0])]
        for b in range(3):
            part = [r for r in chosen if sum(e <= z(r[1]) for e in fit.edges) == b]
            x, y, w = np.array([r[5:7] for r in part]), np.array([max(r[2] - r[3], 0) for r in part]), np.array([r[4] for r in part])
            beta, slope = mine[:, b], x.T @ (w * y) - ((x.T * w) @ x + 0.5 * np.eye(2)) @ mine[:, b]
            assert (beta >= 0).all() and np.abs(slope[beta > 0]).max(initial=0) < 1e-6 and slope[beta == 0].max(initial=-1) < 1e-6
    got = df.select("sample", "mean", "gc", "rep", fit.variance(df["mean"], df["sample"]).alias("v")).collect()
    for r in got:
        b = sum(e <= z(r["mean"]) for e in fit.edges)
        table = fit.samples.get(r["sample"], fit.pooled)
        want = table[0, b] * r["gc"] + table[1, b] * r["rep"] if r["gc"] is not None else 0.0
        assert abs(r["v"] - want) < 1e-9


def test_pooled_trend(spark):
    rng = np.random.default_rng(14)
    rows = [(s, float(m), float(f * (0.5 + 0.2 * m) * rng.gamma(20, 1 / 20)), 1.0) for s, f in (("a", 1.0), ("b", 2.0), ("c", 4.0)) for m in rng.gamma(2, 4, 250)]
    trend, factors = T.pooled_trend(spark.createDataFrame(rows, "sample string, mean double, variance double, weight double"))
    assert abs(factors["b"] / factors["a"] - 2) < 0.2 and abs(factors["c"] / factors["a"] - 4) < 0.4
    assert abs(sum(math.log(v) for v in factors.values())) < 1e-9 and trend.edf > 1


def test_seed_posterior(spark):
    rng = np.random.default_rng(15)
    rows = [(float(d), float(s), float(1 / s)) for s in rng.uniform(0.05, 0.2, 400) for d in [rng.normal() * math.sqrt(0.3 + s)]]
    df = spark.createDataFrame(rows, "delta double, s double, weight double").repartition(3)
    got = G.seed_posterior(df, 1e-4, cap=50.0, size=61)
    grid = np.exp(np.linspace(math.log(1e-4), math.log(50.0), 61))
    w = np.array([r[2] for r in rows])
    order = lambda v, q: (lambda s, c: s[int(np.searchsorted(c, q * c[-1] - 1e-9))])(np.sort(v), np.cumsum(w[np.argsort(v)]))
    d, s = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    prior = max((1.4826 * order(np.abs(d - order(d, 0.5)), 0.5)) ** 2 - order(s, 0.5), 1e-4)
    use = np.clip(w / order(w, 0.5), 0.25, 4)
    post = np.array([(use * (-0.5 * np.log(q + s) - 4.5 * np.log1p(d * d / (8 * (q + s))))).sum() for q in grid]) - 0.5 * ((np.log(grid) - math.log(prior)) / 2.0) ** 2
    assert abs(got["prior"] - prior) < 1e-9 and got["mode"] == grid[int(post.argmax())] and 0.15 < got["median"] < 0.5 and got["low"] < got["median"] < got["high"]
    assert not G.seed_posterior(df.limit(9), 1e-4)["ok"]
    cells = spark.createDataFrame([("a", "s", 0, 1.0, 0.1), ("a", "s", 1, 3.0, 0.2), ("a", "s", 3, 9.0, 0.2)], "contig string, sample string, bin long, x double, v double")
    assert [(r["delta"], round(r["s"], 9)) for r in G.transitions(cells).collect()] == [(2.0, 0.3)]


def test_single_end_length(spark):
    rng = np.random.default_rng(16)
    reads = []
    for at in rng.choice(np.concatenate([np.arange(2000, 2600), np.arange(5200, 5500)]), 1500):
        n = 80 if rng.random() < 0.8 else int(rng.integers(60, 120))
        reads += [("a", int(at), int(at) + 20, False)] if rng.random() < 0.5 else [("a", int(at) + n - 20, int(at) + n, True)]
    df = spark.createDataFrame(reads, "contig string, start long, end long, reverse boolean").repartition(3)
    sizes = spark.createDataFrame([("a", 8000), ("tiny", 100)], "contig string, size long")
    lags = L.best_lags(df, sizes, 40, 150, step=1, block=600, chunk=50, top=8).collect()
    assert lags and all(r["score"] > 0 for r in lags)
    for r in lags[:6]:
        begin = min(max(r["centre"] * 50 + 25 - 300, 0), 8000 - 600)
        f, v = np.zeros(600), np.zeros(600)
        for _, a, b, rev in reads:
            if a >= begin and b <= begin + 600:
                (v if rev else f)[(b - 1 if rev else a) - begin] += 1
        f, v = f - f.mean(), v - v.mean()
        scores = [round(float((f[: 600 - k] * v[k:]).sum()), 9) for k in range(40, 151)]
        assert r["lag"] == 40 + int(np.argmax(scores))
    assert abs(L.single_end_length(df, sizes, 40, 150, step=1, block=600, chunk=50, top=8) - 79) <= 2
    assert L.single_end_length(df.filter("false"), sizes, 40, 150) == 147


def test_rolling_median(spark):
    v = [5, 1, 9, 2, 2, 8, 0]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "contig string, chunk long, n long")
    got = {r["chunk"]: r["level"] for r in L.rolling_median(df, 5).collect()}
    padded = [v[0]] * 2 + v + [v[-1]] * 2
    assert got == {i: sorted(padded[i : i + 5])[2] for i in range(7)}


def test_permutation_test(spark):
    rng = np.random.default_rng(17)
    rows = [("a", b, s, float(np.exp(rng.normal(0.5 if s == "s2" else 0.0, 0.6))), 1.0) for b in range(40) for s in ("s0", "s1", "s2") if not (b == 7 and s == "s1")]
    df = spark.createDataFrame(rows, "contig string, block long, sample string, variance double, prior double")
    effects, one = H.permutation_test(df, 30, 4)
    by = {}
    for _, b, s, v, _ in rows:
        by.setdefault(b, {})[s] = 0.5 * math.log(v)
    full = {b: {s: x - sum(m.values()) / 3 for s, x in m.items()} for b, m in by.items() if len(m) == 3}
    want = {s: np.mean([m[s] for m in full.values()]) for s in ("s0", "s1", "s2")}
    assert all(abs(r["effect"] - want[r["sample"]]) < 1e-12 for r in effects.collect())
    stat, over = max(map(abs, want.values())), 0
    for draw in range(30):
        sums = np.zeros(3)
        for b, m in full.items():
            sums += [m[s] for s in sorted(m, key=lambda s: uniform(4, draw, "a", b, s))]
        over += np.abs(sums / len(full)).max() >= stat - 1e-12
    r = one.first()
    assert (r["blocks"], r["exceeding"]) == (39, over) and abs(r["p"] - (over + 1) / 31) < 1e-12
