"""Variance model: penalised spline of log variance on the signed log mean, prior strength, and the blended variance.

The spline is quadratic with quantile knots. A row has three basis functions; their products are summed per pair of indices
in Spark, so what the driver solves for each penalty is a small banded system, whatever the number of blocks."""

from __future__ import annotations

import math
from itertools import pairwise

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.expr import signed_log1p
from gridloom.operators.statistics import quantiles


class Trend:
    """A fitted spline: clamped knots, coefficients, the chosen penalty and its effective degrees of freedom."""

    def __init__(self, knots: list[float], coefficients: np.ndarray, penalty: float, edf: float):
        self.knots, self.coefficients, self.penalty, self.edf = knots, coefficients, penalty, edf

    def log_variance(self, z: Column) -> Column:
        """The trend at ``z``, constant beyond the range it was fitted on; an expression without a join."""
        span, values = _basis(z, self.knots)
        at = F.array(*(F.lit(float(c)) for c in self.coefficients))
        return sum((F.element_at(at, span + k - 1) * v for k, v in enumerate(values)), F.lit(0.0))


def _basis(z: Column, knots: list[float]) -> tuple[Column, list[Column]]:
    """Number of the span of ``z`` (from 2) and the values of the three quadratic basis functions there."""
    inner = knots[2:-2]
    x = F.least(F.greatest(z, F.lit(inner[0])), F.lit(inner[-1]))
    span = F.least(F.size(F.filter(F.array(*(F.lit(k) for k in inner)), lambda k: k <= x)), F.lit(len(inner) - 1)) + 1
    table = F.array(*(F.lit(float(k)) for k in knots))
    t = lambda k: F.element_at(table, span + k + 1)
    low, high = (t(1) - x) / (t(1) - t(0)), (x - t(0)) / (t(1) - t(0))
    first = (t(1) - x) / (t(1) - t(-1)) * low
    last = (x - t(0)) / (t(2) - t(0)) * high
    return span, [first, 1 - first - last, last]


def fit_trend(blocks: DataFrame, mean: str, variance: str, weight: Column, segments: int = 8, penalties: tuple[float, ...] = tuple(10.0**k for k in range(-3, 5))) -> Trend:
    """Weighted penalised spline of ln(variance) on signed log1p of the mean; the penalty with the least generalised
    cross-validation score. Blocks without positive variance do not count."""
    d = blocks.filter((F.col(variance) > 0) & F.col(mean).isNotNull()).select(signed_log1p(F.col(mean)).alias("z"), F.log(variance).alias("y"), weight.cast("double").alias("w"))
    cut = quantiles(d, [], "z", {f"q{k}": k / segments for k in range(segments + 1)}).first()
    if cut is None:
        raise ValueError("no block has a positive variance")
    inner = sorted({cut[f"q{k}"] for k in range(segments + 1)})
    if len(inner) < 2:
        inner = [inner[0] - 0.5, inner[0] + 0.5]
    knots = [inner[0]] * 2 + inner + [inner[-1]] * 2
    span, values = _basis(F.col("z"), knots)
    terms = F.array(*(F.struct((span + k - 2).alias("i"), v.alias("v")) for k, v in enumerate(values)))
    rows = d.withColumn("_b", terms).select("y", "w", "_b", F.explode("_b").alias("p"))
    right = {r["i"]: (r["b"], r["n"]) for r in rows.groupBy(F.col("p.i").alias("i")).agg(F.sum(F.col("w") * F.col("p.v") * F.col("y")).alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    pairs = rows.select("w", "p", F.explode("_b").alias("q")).groupBy(F.col("p.i").alias("i"), F.col("q.i").alias("j")).agg(F.sum(F.col("w") * F.col("p.v") * F.col("q.v")).alias("g")).collect()
    total = d.agg(F.sum(F.col("w") * F.col("y") ** 2).alias("yy"), F.count(F.lit(1)).alias("n")).first()
    m = len(inner) + 1
    gram, vector = np.zeros((m, m)), np.zeros(m)
    for r in pairs:  # at most five per basis function
        gram[r["i"], r["j"]] = r["g"]
    for i, (b, _) in right.items():
        vector[i] = b
    rough = np.diff(np.eye(m), n=min(2, m - 1), axis=0)
    best = None
    for penalty in penalties:
        system = gram + penalty * rough.T @ rough + 1e-9 * np.eye(m)
        c = np.linalg.solve(system, vector)
        edf = float(np.trace(np.linalg.solve(system, gram)))
        rest = max(float(total["yy"] - 2 * c @ vector + c @ gram @ c), 0.0)
        score = total["n"] * rest / max(total["n"] - edf, 1.0) ** 2
        if best is None or score < best[0]:
            best = (score, penalty, c, edf)
    return Trend([float(k) for k in knots], best[2], best[1], best[3])


def trigamma(x: float) -> float:
    out = 0.0
    while x < 20:
        out, x = out + 1 / x**2, x + 1
    return out + 1 / x + 1 / (2 * x**2) + 1 / (6 * x**3) - 1 / (30 * x**5)


def inverse_trigamma(y: float) -> float:
    lo, hi = 1e-8, 1e8
    for _ in range(200):
        mid = math.sqrt(lo * hi)
        lo, hi = (mid, hi) if trigamma(mid) > y else (lo, mid)
    return math.sqrt(lo * hi)


def prior_strength(blocks: DataFrame, variance: str, prior: Column, nu_local: float, winsor: float = 0.05, least: float = 4.0) -> float:
    """Degrees of freedom of the prior: the spread of ln(local / prior), winsorised, beyond what ``nu_local`` explains."""
    d = blocks.filter(F.col(variance) > 0).select((F.log(variance) - F.log(prior)).alias("r"))
    cut = quantiles(d, [], "r", {"lo": winsor, "hi": 1 - winsor})
    spread = d.join(F.broadcast(cut), F.lit(True)).agg(F.var_samp(F.least(F.greatest("r", "lo"), F.col("hi")))).first()[0]
    cap = 50.0 * nu_local
    extra = (spread or 0.0) - trigamma(nu_local / 2)
    return min(cap, max(least, 2 * inverse_trigamma(extra))) if extra > 0 else cap


def basis_by_hand(z: float, knots: list[float]) -> list[float]:
    """The basis by the recursion of Cox and de Boor, for checks."""
    inner = knots[2:-2]
    z = min(max(z, inner[0]), inner[-1])
    values = [float(a <= z < b or (z == inner[-1] and b == inner[-1] and a < b)) for a, b in pairwise(knots)]
    for degree in (1, 2):
        values = [(0.0 if knots[i + degree] == knots[i] else (z - knots[i]) / (knots[i + degree] - knots[i]) * values[i]) + (0.0 if knots[i + degree + 1] == knots[i + 1] else (knots[i + degree + 1] - z) / (knots[i + degree + 1] - knots[i + 1]) * values[i + 1]) for i in range(len(values) - 1)]
    return values
