"""The background solver and the consensus fit against dense and sequential code."""

from __future__ import annotations

import math

import numpy as np
import pytest

from gridloom.operators import background as B
from gridloom.operators import consensus as C


def penalty_matrix(n, first, second):
    d1, d2 = np.diff(np.eye(n), axis=0), np.diff(np.eye(n), 2, axis=0) if n > 2 else np.zeros((0, n))
    return first * d1.T @ d1 + second * d2.T @ d2


def dense_background(w, r, first, second, zero_sum=False, extra=0.0, start=None, passes=5):
    n = len(w)

    def solve(weights):
        m = np.diag(weights) + penalty_matrix(n, first, second)
        g = np.linalg.solve(m, r)
        if zero_sum:
            u = np.linalg.solve(m, np.ones(n))
            g = g - g.sum() / u.sum() * u
        return g

    before = start < 0 if start is not None else None
    g = solve(w + extra * (before if before is not None else 0))
    for _ in range(passes if extra else 0):
        below = g < 0
        if not below.any() or (before is not None and (below == before).all()):
            break
        before, g = below, solve(w + extra * below)
    return g


@pytest.mark.parametrize("n", [1, 2, 3, 47, 48, 97, 333])
def test_stretch(n):
    rng = np.random.default_rng(n)
    w, r = rng.random(n), rng.normal(size=n)
    first, second = B.penalties(11)
    s = B.Stretch(w, r[:, None], first, second, True)
    system, right = s.condensed()
    end = np.linalg.solve(system[2:, 2:], right[2:])
    assert np.allclose(s.filled(np.concatenate([np.zeros_like(end), end]))[:, 0], dense_background(w, r, first, second), atol=1e-8)


@pytest.mark.parametrize(("tile", "zero_sum", "negative"), [(7, True, 1.0), (64, False, None)])
def test_background(spark, tile, zero_sum, negative):
    rng, cells, want = np.random.default_rng(5), [], {}
    for name, n in (("a", 300), ("b", 65), ("one", 1), ("dark", 20)):
        w = rng.random(n) * (rng.random(n) > 0.2) * (name != "dark")
        w[0] += name == "one"
        r = rng.normal(size=n) * 2 + np.sin(np.arange(n) / 30)
        cells += [(name, i, float(w[i]), float(r[i])) for i in range(n)]
        extra = negative * float(np.median(w[w > 0])) if negative and w.max() > 0 else 0.0
        want[name] = dense_background(w, r, *B.penalties(6), zero_sum, extra) if w.max() > 0 else np.zeros(n)
    df = spark.createDataFrame(cells, "contig string, bin long, weight double, rhs double").repartition(3)
    got = B.smooth_background(df, 6, 1.0, zero_sum, negative, tile).toPandas().sort_values("bin")
    assert len(got) == len(cells)
    for name, g in want.items():
        assert np.allclose(got[got.contig == name].background, g, atol=1e-8), name


def sequential_pass(x, v, g, lam, kap, model):
    """Filter and smoother bin by bin, then new multipliers."""
    m, n = x.shape
    d, step, q = model.size, model.step, np.diag(model.q)
    seen = ~np.isnan(x)
    z, u = np.where(seen, x - g, 0.0), np.where(seen, v + model.pad, 1.0)
    mean, cov, kept, nll = np.zeros(d), model.start_var * np.eye(d), [], 0.0
    for i in range(n):
        noise = q / kap[i]
        mp, pp = step @ mean, step @ cov @ step.T + noise
        rows = np.flatnonzero(seen[:, i])
        h = np.zeros((len(rows), d))
        h[:, 0] = 1.0
        s = h @ pp @ h.T + np.diag(u[rows, i] / lam[i])
        off = z[rows, i] - h @ mp
        gain = pp @ h.T @ np.linalg.inv(s) if len(rows) else np.zeros((d, 0))
        mean, cov = mp + gain @ off, pp - gain @ h @ pp
        if len(rows):
            nll += 0.5 * (len(rows) * math.log(2 * math.pi) + np.linalg.slogdet(s)[1] + off @ np.linalg.solve(s, off))
        kept.append((mean, cov, mp, pp, noise))
    ms, ps = kept[-1][:2]
    level, var, moved = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n - 1, -1, -1):
        mean, cov, mp, pp, noise = kept[i]
        if i < n - 1:
            back = cov @ step.T @ np.linalg.inv(kept[i + 1][3])
            lag = back @ ps  # covariance with the state behind
            w = ms - step @ (mean + back @ (ms - kept[i + 1][2]))
            here = cov + back @ (ps - kept[i + 1][3]) @ back.T
            second = np.outer(w, w) + ps + step @ here @ step.T - step @ lag - lag.T @ step.T
            moved[i + 1] = np.trace(np.linalg.inv(q) @ second)
            ms, ps = mean + back @ (ms - kept[i + 1][2]), here
        level[i], var[i] = ms[0], ps[0, 0]
    nll += 0.5 * model.nu * ((lam - np.log(lam)).sum() + (kap - np.log(kap))[1:].sum())
    r2 = np.where(seen, ((x - g - level) ** 2 + var) / (v + model.pad), 0.0).sum(0)
    lam = np.clip((model.nu + seen.sum(0)) / (model.nu + r2), *model.observation)
    kap = np.clip((model.nu + d) / (model.nu + np.maximum(moved, 0)), *model.process)
    kap[0] = 1.0
    return level, var, lam, kap, nll


def tracks(seed, n, m=3):
    rng = np.random.default_rng(seed)
    level = np.cumsum(rng.normal(size=n) * 0.3) + 4 * (np.arange(n) % 60 < 12)
    v = rng.uniform(0.3, 1.5, (m, n))
    x = level + 1.5 + np.sin(np.arange(n) / 25) + rng.normal(size=(m, n)) * np.sqrt(v)
    x[rng.random((m, n)) < 0.03] += 9
    x[rng.random((m, n)) < 0.05] = np.nan
    return x, v


def cells_of(spark, named):
    rows = [(c, i, f"s{j}", float(x[j, i]), float(v[j, i])) for c, (x, v) in named.items() for j in range(len(x)) for i in range(x.shape[1]) if not np.isnan(x[j, i])]
    return spark.createDataFrame(rows, "contig string, bin long, sample string, x double, v double").repartition(3)


@pytest.mark.parametrize(("q", "tile"), [((0.05,), 37), ((0.05, 0.001), 64)])
def test_robust_fit(spark, q, tile):
    model, named = C.Model(q, start_var=100.0), {"a": tracks(1, 210), "b": tracks(2, 90), "c": tracks(3, 3)}
    state, told = C.robust_fit(C.staged(C.packed(cells_of(spark, named), tile), "state"), model, passes=4, rtol=1e-12)
    got = state.toPandas().sort_values("tile")
    for name, (x, v) in named.items():
        n = x.shape[1]
        lam, kap, path = np.ones(n), np.ones(n), []
        for _ in range(4):
            level, var, lam, kap, nll = sequential_pass(x, v, np.zeros(n), lam, kap, model)
            path.append(nll)
        mine = got[got.contig == name]
        for column, want in (("level", level), ("var", var), ("lam", lam), ("kap", kap)):
            assert np.allclose(np.concatenate(mine[column].tolist()), want, rtol=1e-6, atol=1e-7), (name, column)
        assert np.allclose(told[name]["path"], path, rtol=1e-8)
        assert told[name]["passes"] == 4 and (name == "c" or min(lam) < 0.9)


def test_consensus_fit(spark):
    model, named = C.Model((0.05,), start_var=100.0), {"a": tracks(4, 150), "b": tracks(5, 60)}
    cells = cells_of(spark, named)
    out, history = C.consensus_fit(cells, model, span=10, outer=3, passes=2, tile=64)
    got = out.toPandas().sort_values("bin")
    for name, (x, v) in named.items():
        n = x.shape[1]
        lam, kap, g = np.ones(n), np.ones(n), np.zeros(n)
        for k in range(3):
            for _ in range(2):
                level, _, lam, kap, _ = sequential_pass(x, v, g, lam, kap, model)
            seen = ~np.isnan(x)
            inverse = np.where(seen, 1 / (v + model.pad), 0.0)
            w, r = lam * inverse.sum(0), lam * np.where(seen, (x - level) * inverse, 0.0).sum(0)
            g = dense_background(w, r, *B.penalties(10), False, float(np.median(w[w > 0])), g if k else None)
        mine = got[got.contig == name]
        assert np.allclose(mine.level, level, rtol=1e-6, atol=1e-6) and np.allclose(mine.background, g, rtol=1e-6, atol=1e-6)
    assert len(history) == 3 and history[-1]["shift"] < history[0]["shift"]


def test_plans_do_not_grow(spark):
    model = C.Model((0.05,))
    state = C.staged(C.packed(cells_of(spark, {"a": tracks(6, 50)}), 16), "state")
    sizes = []
    for _ in range(3):
        state = C.one_pass(state, model)
        sizes.append(len(state._jdf.queryExecution().toString().splitlines()))
    assert len(set(sizes)) == 1


def test_empty(spark):
    none = spark.createDataFrame([], "contig string, bin long, sample string, x double, v double")
    out, history = C.consensus_fit(none.unionByName(none), C.Model((0.05,)), span=10, outer=2)
    assert out.count() == 0 and len(history) == 1


def test_calibration(spark):
    from gridloom.operators import calibration

    model, named = C.Model((0.05,), start_var=100.0), {"a": tracks(7, 120, 4), "b": tracks(8, 61, 4)}
    cells = cells_of(spark, named)
    spec = calibration.fold_spec(cells, 10, 3, 5).collect()
    per = {}
    for r in spec:
        per.setdefault((r["contig"], r["block"]), []).append(r)
    assert len(per) == 12 + 7 and all(1 <= len(v) <= 3 and len({r["fold"] for r in v}) == 1 for v in per.values())
    assert sorted(r[0]["fold"] for k, r in per.items() if k[0] == "a") == [0] * 4 + [1] * 4 + [2] * 4
    out, factors = calibration.calibrate(cells, model, 10, segments=2, folds=3, passes=2, rtol=0.0, replicates=8, tile=32)
    got = out.toPandas().sort_values("bin")
    assert (got.calibrated >= got.se - 1e-12).all() and len(got) == 181 and factors.count() == 4
    ratios = {}
    for name, (x, v) in named.items():
        n = x.shape[1]

        def fit(z, n=n, v=v):
            lam, kap = np.ones(n), np.ones(n)
            for _ in range(2):
                level, var, lam, kap, _ = sequential_pass(z, v, np.zeros(n), lam, kap, model)
            return level, var

        level, var = fit(x)
        assert np.allclose(got[got.contig == name].level, level, atol=1e-6)
        for fold in range(3):
            z, held = x.copy(), np.zeros(n, dtype=bool)
            for (c, b), rows in per.items():
                if c == name and rows[0]["fold"] == fold:
                    held[b * 10 : b * 10 + 10] = True
                    for r in rows:
                        z[int(r["sample"][1:]), b * 10 : b * 10 + 10] = np.nan
            ratios[name, fold] = (fit(z), held)
    deleted = calibration.deleted_fits(cells, spark.createDataFrame(spec), 10, model, 2, 0.0, 32).toPandas().sort_values("bin")
    for (name, fold), ((level, var), _) in ratios.items():
        mine = deleted[(deleted.contig == name) & (deleted.fold == fold)]
        assert np.allclose(mine.level, level, atol=1e-6) and np.allclose(mine["var"], var, atol=1e-6)
