"""Seed of the process noise: a grid posterior of the step variance from deltas between neighbouring bins.

A delta of sampling variance s has a Student-t distribution of squared scale q + s. Tasks sum the log-likelihood of every q of the grid
over their rows; the prior is normal in log q around a robust guess. The driver holds the grid only."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.scan import previous
from gridloom.operators.statistics import weighted_quantile
from gridloom.staging import staged


def transitions(cells: DataFrame) -> DataFrame:
    """delta, s, weight of neighbouring bins of a sample. ``cells``: contig, sample, bin, x, v (variance)."""
    d = previous(cells, ["contig", "sample"], "bin", ["bin", "x", "v"]).filter(F.col("bin") == F.col("prev_bin") + 1)
    s = F.col("v") + F.col("prev_v")
    return d.select((F.col("x") - F.col("prev_x")).alias("delta"), s.alias("s"), (1 / F.greatest(s, F.lit(1e-12))).alias("weight"))


def _likelihood(grid: np.ndarray, nu: float, middle: float):
    def run(batches):
        total = np.zeros(len(grid))
        for batch in batches:
            d, s, w = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            w = np.clip(w / middle, 0.25, 4.0)
            for at in range(0, len(d), 4096):
                var = np.maximum(grid + s[at : at + 4096, None], 1e-300)
                total += (w[at : at + 4096, None] * (-0.5 * np.log(var) - 0.5 * (nu + 1) * np.log1p(d[at : at + 4096, None] ** 2 / (nu * var)))).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(grid)), pa.int32()), pa.array(total)], names=["i", "s"])

    return run


def seed_posterior(rows: DataFrame, floor: float, cap: float | None = None, nu: float = 8.0, level: float = 1e-4, least: int = 50, prior_sd: float = 2.0, size: int = 201) -> dict:
    """Mode, median, 5 % and 95 % points of q, and the prior's centre. ``rows``: delta, s, weight. Fewer than ``least`` transitions, or
    as many effective ones, give ok False. ``nu`` counts as 4 at least; weights go by their median, from 1/4 to 4."""
    d = staged(rows.filter(F.col("delta").isNotNull() & (F.col("s") >= 0) & (F.col("weight") > 0)), "deltas")
    told = d.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"), F.sum(F.col("weight") ** 2).alias("w2"), F.max(F.col("delta") ** 2).alias("top")).first()
    effective = told["w"] ** 2 / told["w2"] if told["n"] else 0.0
    if told["n"] < least or effective < least:
        return {"ok": False, "transitions": told["n"], "effective": effective}
    at = lambda table, column, q: weighted_quantile(table, [], column, "weight", q).first()["quantile"]
    centre, s = at(d, "delta", 0.5), at(d, "s", 0.5)
    spread = 1.4826 * at(d.withColumn("off", F.abs(F.col("delta") - centre)), "off", 0.5)
    high = at(d.withColumn("over", F.greatest(F.col("delta") ** 2 - F.col("s"), F.lit(0.0))), "over", 0.9)
    middle = max(at(d.withColumn("own", F.col("weight")), "own", 0.5), 1e-300)
    prior = max(spread**2 - s, floor, level)
    upper = max(cap, floor) if cap is not None else max(floor * 1e6, prior * 1e4, high * 100, s * 100, told["top"] * 10)
    grid = np.exp(np.linspace(math.log(floor), math.log(upper), size)) if upper > floor * (1 + 1e-10) else np.array([floor])
    sums = np.zeros(len(grid))
    for r in d.select("delta", "s", "weight").mapInArrow(_likelihood(grid, max(nu, 4.0), middle), "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        sums[r["i"]] = r["s"]
    sums -= 0.5 * ((np.log(grid) - math.log(max(prior, floor))) / max(prior_sd, 1e-6)) ** 2
    mass = np.exp(sums - sums.max())
    upto = np.cumsum(mass / mass.sum())
    point = lambda q: float(grid[min(int(np.searchsorted(upto, q - 1e-12)), len(grid) - 1)])
    return {"ok": True, "transitions": told["n"], "effective": effective, "prior": prior, "mode": float(grid[int(sums.argmax())]), "median": point(0.5), "low": point(0.05), "high": point(0.95)}
