"""Interval operators on small exact vectors and against sequential recursions."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import counting, intervals, scan, statistics, tiles
from gridloom.schema import REGIONS
from gridloom.sources import sinks, text

NINE = [("chr1", 5, 15, "A", 1), ("chr1", 9, 11, "A", 1), ("chr1", 12, 18, "B", 1), ("chr1", 18, 26, "B", 2), ("chr1", 22, 31, "A", 2), ("chr1", 33, 39, "A", 1)]


@pytest.mark.parametrize(
    ("mode", "values", "noise"),
    [
        ("coverage", [2, 5, 4, 3], [2, 5, 4, 3]),
        ("endpoints", [2, 6, 4, 4], [2, 8, 4, 6]),
        ("center", [0, 3, 4, 1], [0, 3, 4, 1]),
        ("fractional", [1.0, 2.5, 3.2777777, 1.2222222], [0.5, 1.625, 2.7052469, 1.0246914]),
    ],
)
def test_count_modes(spark, mode, values, noise):
    rows = spark.createDataFrame([(*r, "s") for r in NINE], "contig string, start long, end long, barcode string, count int, sample string")
    got = {r["bin"]: r for r in counting.count_bins(rows, 10, mode).collect()}
    for b in range(4):
        assert math.isclose(got[b]["value"] if b in got else 0, values[b], abs_tol=1e-6)
        assert math.isclose(got[b]["noise_mass"] if b in got else 0, noise[b], abs_tol=1e-6)


def test_signal_means(spark):
    rows = spark.createDataFrame([("chr1", 0, 25, 2.0, "s"), ("chr1", 25, 75, 6.0, "s"), ("chr1", 75, 100, 10.0, "s")], "contig string, start long, end long, value double, sample string")
    assert {r["bin"]: r["value"] for r in counting.mean_signal_bins(rows, 50).collect()} == {0: 4.0, 1: 8.0}


def test_covered_fraction(spark):
    regions = spark.createDataFrame([("chrA", 10, 40), ("chrA", 30, 60), ("chrA", 115, 130), ("chrB", 0, 10), ("chrA", 45, 75), ("chrA", 110, 120), ("chrB", 40, 85)], REGIONS)
    contigs = spark.createDataFrame([("chrA", 125), ("chrB", 70)], "contig string, size long")
    got = {(r["contig"], r["bin"]): round(r["fraction"], 6) for r in intervals.covered_fraction(regions, contigs, 50).collect()}
    assert got == {("chrA", 0): 0.8, ("chrA", 1): 0.5, ("chrA", 2): 0.6, ("chrB", 0): 0.4, ("chrB", 1): 1.0}


def test_masked_bins(spark):
    bins = spark.createDataFrame([("c", 0), ("c", 1), ("c", 2)], "contig string, bin long")
    got = intervals.masked_bins(bins, spark.createDataFrame([("c", 110, 120)], REGIONS), 100)
    assert {r["bin"]: r["masked"] for r in got.collect()} == {0: False, 1: True, 2: False}


@pytest.mark.parametrize("tile", [7, 10_000])
def test_merge_and_runs_do_not_depend_on_tiles(spark, tile):
    rng = np.random.default_rng(3)
    data = [("c", int(s), int(s + n)) for s, n in zip(rng.integers(0, 400, 60), rng.integers(1, 15, 60), strict=True)]
    merged, reach = [], None
    for _, s, e in sorted(data):
        if reach is None or s > reach:
            merged.append([s, e])
        merged[-1][1] = reach = max(merged[-1][1], e)
    got = intervals.merge_intervals(spark.createDataFrame(data, REGIONS), tile).collect()
    assert sorted((r["start"], r["end"]) for r in got) == [tuple(m) for m in merged]
    bins = sorted(set(rng.integers(0, 200, 90).tolist()))
    want = []
    for b in bins:
        if want and b - want[-1][1] <= 2:
            want[-1][1] = b
        else:
            want.append([b, b])
    got = intervals.runs(spark.createDataFrame([("c", b) for b in bins], "contig string, bin long"), 1, tile=tile).collect()
    assert sorted((r["first_bin"], r["last_bin"]) for r in got) == [tuple(w) for w in want]


def test_range_join(spark):
    rng = np.random.default_rng(4)
    make = lambda: sorted({("c", int(s), int(s + n)) for s, n in zip(rng.integers(0, 500, 40), rng.integers(1, 90, 40), strict=True)})
    a, b = make(), make()
    left, right = spark.createDataFrame(a, REGIONS), spark.createDataFrame(b, REGIONS)
    pairs = {(x, y) for x in a for y in b if x[1] < y[2] and x[2] > y[1]}
    got = intervals.range_join(left, right, 16).collect()
    assert len(got) == len(pairs) and {(("c", r["start"], r["end"]), ("c", r["r_start"], r["r_end"])) for r in got} == pairs
    hit = {x for x, _ in pairs}
    assert {tuple(r) for r in intervals.range_join(left, right, 16, "left_semi").select("contig", "start", "end").collect()} == hit
    assert {tuple(r) for r in intervals.range_join(left, right, 16, "left_anti").select("contig", "start", "end").collect()} == set(a) - hit


@pytest.mark.parametrize("tile", [13, 1000])
def test_level_smoother_equals_dense_solution(spark, tile):
    rng = np.random.default_rng(5)
    n, q = 60, 0.1
    info, weighted = rng.uniform(0, 2, n) * (rng.random(n) > 0.2), rng.normal(0, 1, n)
    weighted = weighted * (info > 0)
    precision = np.diag(info)
    precision[0, 0] += 1 / (1e6 + q)
    for i in range(n - 1):
        precision[i : i + 2, i : i + 2] += np.array([[1, -1], [-1, 1]]) / q
    cov = np.linalg.inv(precision)
    cells = spark.createDataFrame([("c", i, float(info[i]), float(weighted[i])) for i in range(n)], "contig string, bin long, info double, weighted double")
    got = sorted(tiles.smooth_level(cells, q, tile=tile).collect(), key=lambda r: r["bin"])
    assert np.allclose([r["level"] for r in got], cov @ weighted, atol=1e-6)
    assert np.allclose([r["variance"] for r in got], np.diag(cov), atol=1e-6)


@pytest.mark.parametrize("tile", [4, 1000])
def test_run_selection_is_optimal(spark, tile):
    rng = np.random.default_rng(6)
    score = rng.normal(0, 1, 12)
    best = max((sum(s - 0.1 for s, b in zip(score, bits, strict=True) if b) - 0.7 * sum(a != b for a, b in zip((0, *bits), bits, strict=False)), bits) for bits in np.ndindex(*[2] * 12))
    got = tiles.select_runs(spark.createDataFrame([("c", i, float(s)) for i, s in enumerate(score)], "contig string, bin long, score double"), 0.1, 0.7, tile).collect()
    assert tuple(int(r["selected"]) for r in sorted(got, key=lambda r: r["bin"])) == best[1]


def test_ema_windows_hold_tiles(spark):
    """No window over a contig's rows: what windows read is aggregated to one row per tile."""
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(9)], "contig string, bin long, x double")
    plan = scan.ema(rows, ["contig"], "bin", "x", 0.3, tile=4)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    below = [next(x for x in plan[i + 1 :] if "Project [" not in x) for i, line in enumerate(plan) if "Window [" in line]
    assert below and all("Aggregate [" in x for x in below)


@pytest.mark.parametrize("tile", [5, 1000])
def test_ema(spark, tile):
    x = np.random.default_rng(7).normal(0, 1, 30)
    f = [x[0]]
    for v in x[1:]:
        f.append(0.3 * v + 0.7 * f[-1])
    b = [f[-1]]
    for v in f[-2::-1]:
        b.append(0.3 * v + 0.7 * b[-1])
    rows = spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(x)], "contig string, bin long, x double")
    got = sorted(scan.ema(rows, ["contig"], "bin", "x", 0.3, tile=tile).collect(), key=lambda r: r["bin"])
    assert np.allclose([r["ema"] for r in got], b[::-1])


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.03, 0.9, 0.2]
    ranks = [sum(y <= x for y in p) for x in p]
    want = [min(1.0, min(y * 6 / r for y, r in zip(p, ranks, strict=True) if y >= x)) for x in p]
    got = statistics.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "k long, p double"), "p").collect()
    assert np.allclose([r["q"] for r in sorted(got, key=lambda r: r["k"])], want)


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "a.bedGraph").write_text("track x\n#c\nchr1\t0\t25\t2\nchr1 25 75 6\nbad line\nchr1\t9\t9\t1\n")
    rows = text.read_intervals(spark, str(tmp_path / "a.bedGraph"))
    assert [tuple(r) for r in rows.orderBy("start").collect()] == [("chr1", 0, 25, 2.0), ("chr1", 25, 75, 6.0)]
    (tmp_path / "f.tsv").write_text("chr1\t5\t15\tA\t0\nchr1\t9\t11\tB\n")
    assert sorted(r["count"] for r in text.read_fragments(spark, str(tmp_path / "f.tsv")).collect()) == [1, 1]
    contigs = spark.createDataFrame([("chr1", 60, 1)], "contig string, size long, ord int")
    assert [r["rule"] for r in sinks.track_violations(rows, contigs).collect()] == ["beyond contig"]
    assert [tuple(r) for r in sinks.track_lines(rows, contigs).collect()][0] == ("chr1", 0, 25, "2.0000")
    kinds = spark.createDataFrame([("x.bam",), ("y.bedGraph.gz",), ("z.fragments.tsv.gz",)], "p string").select(text.source_kind(F.col("p")).alias("k"))
    assert [r["k"] for r in kinds.collect()] == ["BAM", "BEDGRAPH", "FRAGMENTS"]


def test_entry_survives_without_training_data_operators():
    import __spark_entry__

    assert "flagship_peaks" in __spark_entry__.queries() and "flagship_peaks" in __spark_entry__.oracle_sql()


def test_stream_counts_equal_batch(spark, tmp_path):
    from gridloom.streaming.counts import stream_counts

    schema = "contig string, start long, end long, count int, sample string"
    rows = [("c", i, i + 7, 1 + i % 3, f"s{i % 2}") for i in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[k::4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = stream_counts(stream, 10).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    run.stop()
    want = counting.count_bins(spark.createDataFrame(rows, schema), 10)
    key = lambda r: (r["contig"], r["sample"], r["bin"])
    assert {key(r): round(r["value"], 6) for r in spark.table("counts").collect()} == {key(r): round(r["value"], 6) for r in want.collect()}


@pytest.mark.parametrize("tile", [7, 1000])
def test_level_trend_smoother(spark, tile):
    """Against the dense Gaussian posterior of the same state-space model."""
    from gridloom.operators import trend

    rng, n, ql, qt = np.random.default_rng(8), 25, 0.3, 0.05
    info = np.where(rng.random(n) < 0.2, 0.0, rng.uniform(0.5, 3, n))
    weighted = info * rng.normal(2, 1, n)
    step, precision = np.array([[1.0, 1.0], [0.0, 1.0]]), np.zeros((2 * n + 2, 2 * n + 2))
    precision[:2, :2] += np.eye(2) / 1e6
    for k in range(n):
        block = np.hstack([-step, np.eye(2)])
        precision[2 * k : 2 * k + 4, 2 * k : 2 * k + 4] += block.T @ np.diag([1 / ql, 1 / qt]) @ block
        precision[2 * k + 2, 2 * k + 2] += info[k]
    right = np.zeros(2 * n + 2)
    right[2::2] = weighted
    cov = np.linalg.inv(precision)
    mean = cov @ right
    rows = spark.createDataFrame([("c", k, float(info[k]), float(weighted[k])) for k in range(n)], "contig string, bin long, info double, weighted double")
    got = sorted(trend.smooth_level_trend(rows, ql, qt, tile=tile).collect(), key=lambda r: r["bin"])
    assert np.allclose([r["level"] for r in got], mean[2::2], atol=1e-5) and np.allclose([r["trend"] for r in got], mean[3::2], atol=1e-5)
    assert np.allclose([r["variance"] for r in got], np.diag(cov)[2::2], atol=1e-5)


def test_robust_level(spark):
    from gridloom.operators import trend

    rng, n, m, q = np.random.default_rng(9), 20, 3, 0.1
    x, r = rng.normal(0, 1, (n, m)), rng.uniform(0.5, 2, (n, m))
    x[4, 1] = 30.0
    w = np.ones((n, m))
    for turn in range(3):
        if turn:
            w = np.clip(9 / (8 + ((x - level[:, None]) ** 2 + var[:, None]) / r), 0.2, 5)
        diff = np.diff(np.eye(n), axis=0)
        precision = diff.T @ diff / q + np.diag((w / r).sum(axis=1))
        precision[0, 0] += 1 / (1e6 + q)
        cov = np.linalg.inv(precision)
        level, var = cov @ (w * x / r).sum(axis=1), np.diag(cov)
    rows = spark.createDataFrame([("c", i, f"s{j}", float(x[i, j]), float(r[i, j])) for i in range(n) for j in range(m)], "contig string, bin long, sample string, x double, r double")
    got = sorted(trend.robust_level(rows, q, rounds=2, tile=6).collect(), key=lambda r: r["bin"])
    assert np.allclose([r["level"] for r in got], level, atol=1e-6)


def test_budgeted_runs(spark):
    from gridloom.operators import tiles as t
    from gridloom.operators import trend

    rng = np.random.default_rng(10)
    rows = [(c, i, float(x)) for c in ("a", "b") for i, x in enumerate(np.convolve(rng.normal(0, 1, 60), np.ones(4) / 4, "same"))]
    table = spark.createDataFrame(rows, "contig string, bin long, score double")
    got = trend.budgeted_runs(table, 0.2, 0.3, tile=16).filter("selected").groupBy("contig").count().collect()
    most = {r["contig"]: r["count"] for r in got}
    assert set(most) == {"a", "b"} and all(0 < n <= 12 for n in most.values())
    x = [s for c, _, s in rows if c == "a"]
    lo, hi = min(x), max(x) + 0.3
    for _ in range(2):
        grid = [lo + (hi - lo) * k / 8 for k in range(1, 9)]
        fits = [p for p in grid if t.select_runs(table.filter("contig = 'a'"), p, 0.3).filter("selected").count() <= 12]
        lo, hi = fits[0] - (hi - lo) / 8, fits[0]
    assert t.select_runs(table.filter("contig = 'a'"), hi, 0.3).filter("selected").count() == most["a"]


def test_quantiles_and_models(spark):
    from gridloom.operators import models

    rng = np.random.default_rng(11)
    data = [("a", float(v)) for v in rng.normal(0, 1, 501)] + [("b", 0.0)] * 300 + [("b", float(v)) for v in rng.integers(0, 5, 200)] + [("c", 7.0), ("d", None)]
    got = {r["k"]: r for r in statistics.quantiles(spark.createDataFrame(data, "k string, v double"), ["k"], "v", {"q0": 0.0, "q1": 0.1, "q5": 0.5, "q99": 0.99, "q100": 1.0}).collect()}
    for k in "abc":
        v = [x for key, x in data if key == k]
        assert np.allclose([got[k][c] for c in ("q0", "q1", "q5", "q99", "q100")], np.quantile(v, [0, 0.1, 0.5, 0.99, 1]))
    assert [models.pac_index(n, 0.95, 0.05) for n in (59, 100, 200, 500, 58)] == [59, 99, 196, 484, None]
    for row, want in (((1.0, 100.0, 3.0, 5.0, 7.0), (2, 2, 4, 5, 5)), ((2.0, 4.0, 8.0, 16.0, 32.0), (5, 5, 12, 56 / 3, 56 / 3))):
        t = spark.createDataFrame([("c", i, v, i != 1) for i, v in enumerate(row)], "contig string, bin long, x double, ok boolean")
        assert np.allclose([r["m"] for r in models.sliding_mean(t, ["contig"], "bin", "x", "ok", 3, "m").orderBy("bin").collect()], want)
    bins = sorted(set(rng.integers(0, 400, 150).tolist()))
    want, last = [], -99
    for b in bins:
        if b >= last + 10:
            want.append(b)
            last = b
    for tile in (13, 64, 5000):
        t = spark.createDataFrame([("c", b) for b in bins], "contig string, bin long")
        assert [r["bin"] for r in scan.spaced(t, ["contig"], "bin", 10, tile).orderBy("bin").collect()] == want


def test_variance_trend(spark):
    """The spline against a dense penalised fit; degrees of freedom of a known prior are found again."""
    from gridloom.operators import variance

    rng = np.random.default_rng(12)
    mean = rng.gamma(2, 3, 400) - 1
    true = 0.3 + 0.5 * np.sign(mean) * np.log1p(abs(mean))
    local = np.exp(true) * rng.chisquare(8, 400) / 8
    table = spark.createDataFrame([(float(m), float(v)) for m, v in zip(mean, local, strict=True)] + [(1.0, 0.0), (None, 1.0)], "m double, v double")
    trend = variance.fit_trend(table, "m", "v", F.lit(1.0))
    z = np.sign(mean) * np.log1p(abs(mean))
    design = np.array([variance.basis_by_hand(x, trend.knots) for x in z])
    assert np.allclose(design.sum(axis=1), 1)
    rough = np.diff(np.eye(design.shape[1]), n=2, axis=0)
    want = np.linalg.solve(design.T @ design + trend.penalty * rough.T @ rough, design.T @ np.log(local))
    assert np.allclose(trend.coefficients, want, atol=1e-6)
    at = [r["y"] for r in table.filter("v > 0 AND m IS NOT NULL").select(trend.log_variance(F.signum("m") * F.log1p(F.abs("m"))).alias("y")).collect()]
    assert np.allclose(at, design @ want, atol=1e-6) and np.abs(at - true).max() < 0.6
    drawn = np.exp(0.2) * (rng.chisquare(10, 8000) / 10) / (rng.chisquare(12, 8000) / 12)
    found = variance.prior_strength(spark.createDataFrame([(float(v),) for v in drawn], "v double"), "v", F.lit(float(np.exp(0.2))), 10, winsor=0.0)
    assert 10 < found < 15 and variance.prior_strength(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v", F.lit(1.0), 10) == 500


def test_merge_repeated_intervals(spark):
    rows = [("c", 0, 2)] * 3 + [("c", 5, 6)] * 4 + [("c", 6, 9)] * 2 + [("c", 20, 21)] * 3
    got = intervals.merge_intervals(spark.createDataFrame(rows, "contig string, start long, end long").repartition(4)).collect()
    assert sorted((r["start"], r["end"]) for r in got) == [(0, 2), (5, 9), (20, 21)]


def test_merge_orders_one_row_per_start(spark, monkeypatch):
    """Piled-up intervals are gathered before anything is ordered; those that end before they start stay rows of their own."""
    ordered, inner = [], intervals.running

    def counted(df, *args, **kwargs):
        ordered.append(df.count())
        return inner(df, *args, **kwargs)

    monkeypatch.setattr(intervals, "running", counted)
    pile = spark.range(20_000).select(F.lit("c").alias("contig"), (F.col("id") % 40 * 3).alias("start"), (F.col("id") % 40 * 3 + 1 + F.col("id") % 7 % 2).alias("end"))
    odd = spark.createDataFrame([("c", 500, 490), ("c", 500, 490), ("c", 500, 510), ("c", 505, 501), ("c", 520, None), ("c", 530, None), ("c", 530, 540)], REGIONS)
    got = intervals.merge_intervals(pile.unionByName(odd.select("contig", "start", "end"))).collect()
    assert ordered == [45, 45]
    assert sorted((r["start"], r["end"]) for r in got if r["start"] < 500) == [(3 * i, 3 * i + 2) for i in range(40)]
    assert sorted(((r["start"], r["end"]) for r in got if r["start"] >= 500), key=str) == [(500, 490), (500, 490), (500, 510), (520, None), (530, 540)]
