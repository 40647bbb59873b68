"""Terms of the sample variance: a pooled trend with a factor per sample, and non-negative covariate terms by ridge regression.

What is solved on the driver is small whatever the number of blocks: Gram matrices of features times level bins come from one aggregate
for all samples; the active-set solver works on them alone."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.expr import signed_log1p
from gridloom.operators.statistics import weighted_quantile
from gridloom.operators.variance import Trend, fit_trend
from gridloom.staging import staged


def nonnegative_solution(gram: np.ndarray, right: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """Minimises b'(G + ridge I)b / 2 - r'b over b >= 0: the active-set method of Lawson and Hanson on the normal equations."""
    g, n = gram + ridge * np.eye(len(right)), len(right)
    b, free = np.zeros(n), np.zeros(n, dtype=bool)
    tol = 1e-10 * max(1.0, float(np.abs(right).max(initial=0.0)))
    for _ in range(6 * n + 1):
        slope = right - g @ b
        if free.all() or slope[~free].max(initial=-np.inf) <= tol:
            return b
        free[int(np.where(free, -np.inf, slope).argmax())] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(g[np.ix_(free, free)], right[free], rcond=None)[0]
            bad = free & (s <= 0)
            if not bad.any():
                b = s
                break
            step = float((b[bad] / (b[bad] - s[bad])).min())
            b = b + step * (s - b)
            free &= b > 1e-14
            b[~free] = 0.0
    return b


@dataclass
class CovariateTerms:
    """Coefficients (feature by level bin) pooled and per sample; samples with too few blocks use the pooled ones."""

    features: list[str]
    edges: list[float]
    pooled: np.ndarray
    samples: dict[str, np.ndarray]
    blocks: dict[str, int]

    def variance(self, mean: Column, sample: Column | None = None) -> Column:
        """The added variance at a mean level: coefficients of its bin times the covariates, never negative; null covariates add 0."""
        z = signed_log1p(mean)
        at = F.coalesce(F.size(F.filter(F.array(*(F.lit(e) for e in self.edges)), lambda e: e <= z)), F.lit(0)) if self.edges else F.lit(0)

        def dot(table: np.ndarray) -> Column:
            terms = (F.element_at(F.array(*(F.lit(float(c)) for c in row)), at + 1) * F.col(f) for f, row in zip(self.features, table, strict=True))
            return F.greatest(F.lit(0.0), F.coalesce(sum(terms, F.lit(0.0)), F.lit(0.0)))

        out = dot(self.pooled)
        if sample is not None and self.samples:
            cases = None
            for name, table in sorted(self.samples.items()):
                cases = F.when(sample == name, dot(table)) if cases is None else cases.when(sample == name, dot(table))
            out = cases.otherwise(out)
        return out


def fit_covariates(blocks: DataFrame, features: list[str], bins: int = 4, ridge: float = 1.0, least: int = 250) -> CovariateTerms:
    """``blocks``: sample, mean, variance, baseline, weight and the ``features``. The excess of the variance over the baseline is fitted by
    covariates, each with a coefficient per quantile bin of the level; samples with ``least`` blocks get their own. Blocks with a
    null covariate, no variance, baseline or weight do not count."""
    ok = (F.col("variance") > 1e-12) & (F.col("baseline") > 0) & (F.col("weight") > 0) & F.col("mean").isNotNull()
    for f in features:
        ok = ok & F.col(f).isNotNull()
    d = staged(blocks.filter(ok).select("sample", signed_log1p(F.col("mean")).alias("z"), F.greatest(F.col("variance") - F.col("baseline"), F.lit(0.0)).alias("y"), F.col("weight").cast("double").alias("w"), *(F.col(f).cast("double").alias(f) for f in features)), "blocks")
    edges = sorted({weighted_quantile(d, [], "z", "w", k / bins).first()["quantile"] for k in range(1, bins)}) if bins > 1 and not d.isEmpty() else []
    ends = d.agg(F.min("z").alias("a"), F.max("z").alias("b")).first()
    gap = max(((ends["b"] or 0.0) - (ends["a"] or 0.0)) * 1e-8, 1e-10)
    edges = [e for e in edges if ends["a"] + gap < e < ends["b"] - gap]
    level = F.size(F.filter(F.array(*(F.lit(e) for e in edges)), lambda e: e <= F.col("z"))) if edges else F.lit(0)
    d = d.withColumn("_b", level)
    sums = [F.sum(F.col("w") * F.col(f) * F.col(g)).alias(f"g{i}_{j}") for i, f in enumerate(features) for j, g in enumerate(features[: i + 1])]
    rows = d.groupBy("sample", "_b").agg(*sums, *(F.sum(F.col("w") * F.col(f) * F.col("y")).alias(f"r{i}") for i, f in enumerate(features)), F.count(F.lit(1)).alias("n")).collect()  # samples x bins
    k, m = len(features), len(edges) + 1

    def solve(chosen) -> np.ndarray:
        gram, right = np.zeros((k * m, k * m)), np.zeros(k * m)
        for r in chosen:  # bins do not mix: a block-diagonal system
            for i in range(k):
                right[i * m + r["_b"]] += r[f"r{i}"]
                for j in range(i + 1):
                    gram[i * m + r["_b"], j * m + r["_b"]] += r[f"g{i}_{j}"]
                    if i != j:
                        gram[j * m + r["_b"], i * m + r["_b"]] += r[f"g{i}_{j}"]
        return nonnegative_solution(gram, right, ridge).reshape(k, m)

    counts: dict[str, int] = {}
    for r in rows:
        counts[r["sample"]] = counts.get(r["sample"], 0) + r["n"]
    own = {s: solve([r for r in rows if r["sample"] == s]) for s, n in counts.items() if n >= least}
    return CovariateTerms(features, edges, solve(rows), own, counts)


def pooled_trend(blocks: DataFrame, rounds: int = 3, tol: float = 1e-3) -> tuple[Trend, dict[str, float]]:
    """One trend of log variance on the mean for all samples, and each sample's variance factor: the weighted median of its
    log residuals, less their weighted mean over samples; in turn, at most ``rounds`` times. ``blocks``: sample, mean, variance, weight."""
    d = staged(blocks.filter((F.col("variance") > 1e-12) & (F.col("weight") > 0) & F.col("mean").isNotNull()), "blocks")
    weights = {r["sample"]: r["w"] for r in d.groupBy("sample").agg(F.sum("weight").alias("w")).collect()}  # one row per sample
    logs = dict.fromkeys(weights, 0.0)

    def scaled() -> Column:
        table = F.create_map(*(F.lit(x) for s, v in sorted(logs.items()) for x in (s, math.exp(-v))))
        return F.col("variance") * F.element_at(table, F.col("sample"))

    trend = None
    for _ in range(rounds):
        trend = fit_trend(d.withColumn("_v", scaled()), "mean", "_v", F.col("weight"))
        off = d.withColumn("_r", F.log("variance") - trend.log_variance(signed_log1p(F.col("mean"))))
        new = {r["sample"]: r["quantile"] for r in weighted_quantile(off, ["sample"], "_r", "weight", 0.5).collect()}
        centre = sum(new[s] * weights[s] for s in new) / sum(weights.values())
        new = {s: v - centre for s, v in new.items()}
        moved = max((abs(new[s] - logs[s]) for s in new), default=0.0)
        logs = logs | new
        if moved <= tol:
            break
    trend = fit_trend(d.withColumn("_v", scaled()), "mean", "_v", F.col("weight"))
    return trend, {s: math.exp(v) for s, v in logs.items()}
