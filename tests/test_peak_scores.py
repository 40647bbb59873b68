"""Peak scoring with null replays against sequential code."""

from __future__ import annotations

import time

import numpy as np

from gridloom.operators import peak_scores as K


def segments(x, scales, thresholds, least=1):
    best = {}
    for s in scales:
        h = s // 2
        y = [float(np.mean(x[max(0, i - h) : i + h + 1])) for i in range(len(x))]
        for z in thresholds:
            i = 0
            while i < len(y):
                if y[i] > z:
                    j = i
                    while j + 1 < len(y) and y[j + 1] > z:
                        j += 1
                    e = [v - z for v in y[i : j + 1]]
                    if len(e) >= least:
                        best[i, j] = max(best.get((i, j), (-1,)), (sum(e) / len(e) ** 0.5, sum(e), max(e)))
                    i = j
                i += 1
    return best


def test_scores(spark):
    rng = np.random.default_rng(3)
    n, draws, scales, cuts = 3500, 12, (1, 5), (1.0, 1.5, 2.0, 2.5)
    x = np.round(rng.normal(size=n), 3)
    peaks = [(100 + 300 * k, 110 + 300 * k + k) for k in range(11)]
    for a, b in peaks:
        x[a : b + 1] += 4
    null = np.round(rng.normal(size=(draws, n)), 3)
    track = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "contig string, bin long, x double")
    replays = spark.createDataFrame([("a", d, i, float(v)) for d in range(draws) for i, v in enumerate(null[d])], "contig string, draw int, bin long, x double")
    called = spark.createDataFrame([("a", int(a), int(b)) for a, b in peaks], "contig string, first long, last long")
    start = time.time()
    got = {(r["first"], r["last"]): r for r in K.score_peaks(called, track, replays, "x", scales, cuts, draws).collect()}
    assert time.time() - start < 120 and len(got) == 11
    seen = segments(x, scales, cuts)
    for a, b in peaks:
        if (a, b) not in seen:
            options = []
            for z in cuts:
                e = np.maximum(x[a : b + 1] - z, 0)
                options.append((e.sum() / len(e) ** 0.5, e.sum(), e.max()))
            seen[a, b] = max(options)
    pool = [list(segments(null[d], scales, cuts).values()) for d in range(draws)]
    for at in peaks:
        for i, m in enumerate(K.METRICS):
            mine = seen[at][i]
            assert abs(got[at][m] - mine) < 1e-9
            flat = [s[i] for d in pool for s in d]
            p = (1 + sum(v >= mine - 1e-12 for v in flat)) / (len(flat) + 1)
            q = min(min(1.0, (sum(v >= s[i] - 1e-12 for v in flat) / draws + 1 / (draws + 1)) / sum(o[i] >= s[i] - 1e-12 for o in seen.values())) for s in seen.values() if s[i] <= mine + 1e-12)
            assert abs(got[at][f"p_{m}"] - p) < 1e-9 and abs(got[at][f"q_{m}"] - max(p, q)) < 1e-9
