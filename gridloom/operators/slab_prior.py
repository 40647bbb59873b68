"""Spike and slab prior of states: a point mass at 0 and normal slabs, or a Student t as a scale mixture of normals.

Every block of bins has weight 1, shared by its bins, so that dense correlated bins do not carry the fit. A step of
expectation-maximisation is one aggregate: tasks sum masses, second moments and the log-likelihood over their rows in Arrow batches
and send one row each. The driver holds the parameters only (a share and a few slabs). A Student-t step that lowers the penalised
objective is shortened along the log variance until it does not."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.staging import staged

FLOOR = 1e-12


@dataclass(frozen=True)
class SlabPrior:
    """``share`` of the spike; ``weight`` and ``variance`` of the slabs; how the fit ended."""

    share: float
    weight: tuple[float, ...]
    variance: tuple[float, ...]
    loglik: float = float("nan")
    steps: int = 0
    converged: bool = False


def laguerre(order: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights (of sum 1) of generalised Gauss-Laguerre quadrature, from the eigenvalues of its Jacobi matrix."""
    k = np.arange(order)
    matrix = np.diag(2 * k + 1 + alpha) + np.diag(np.sqrt(k[1:] * (k[1:] + alpha)), 1) + np.diag(np.sqrt(k[1:] * (k[1:] + alpha)), -1)
    nodes, vectors = np.linalg.eigh(matrix)
    return nodes, vectors[0] ** 2


def student_slabs(scale: float, df: float, order: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Variances, weights and multipliers of the normal slabs that make a t of ``df`` degrees of freedom with this scale (its standard
    deviation where it has one), sorted."""
    nodes, weights = laguerre(order, df / 2 - 1)
    multiplier = (df - 2 if df > 2 else df) / (2 * nodes)
    at = np.argsort(multiplier)
    return np.maximum(scale**2 * multiplier[at], floor), weights[at] / weights.sum(), multiplier[at]


def weighted_rows(states: DataFrame, block: int) -> DataFrame:
    """x, v, w of the usable rows (finite state, positive variance); the rows of a block of ``block`` bins share weight 1."""
    ok = F.col("state").isNotNull() & ~F.isnan("state") & (F.abs("state") < float("inf")) & (F.col("variance") > 0) & (F.col("variance") < float("inf"))
    d = states.filter(ok).select("contig", F.floor(F.col("bin") / block).alias("_block"), F.col("state").cast("double").alias("x"), F.col("variance").cast("double").alias("v"))
    share = d.groupBy("contig", "_block").agg((1.0 / F.count(F.lit(1))).alias("w"))
    return d.join(share, ["contig", "_block"]).select("x", "v", "w")


def _expectation(prior: SlabPrior):
    """Per task: total weight, spike mass, log-likelihood, then masses and second moments of the slabs."""

    def run(batches):
        s = np.concatenate([[0.0], prior.variance])
        log_share = np.log(np.concatenate([[prior.share], (1 - prior.share) * np.asarray(prior.weight)]))
        sums = np.zeros(3 + 2 * len(prior.variance))
        for batch in batches:
            x, v, w = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            total = v[:, None] + s
            logs = log_share - 0.5 * (np.log(2 * math.pi * total) + x[:, None] ** 2 / total)
            top = logs.max(1)
            part = np.exp(logs - top[:, None])
            whole = part.sum(1)
            r = part / whole[:, None] * w[:, None]
            gain = s[1:] / total[:, 1:]
            second = (gain * x[:, None]) ** 2 + gain * v[:, None]
            sums += np.concatenate([[w.sum(), r[:, 0].sum(), (w * (top + np.log(whole))).sum()], r[:, 1:].sum(0), (r[:, 1:] * second).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], names=["i", "s"])

    return run


def expectation(rows: DataFrame, prior: SlabPrior) -> dict:
    """total, spike, loglik, mass and second (one per slab) of the rows under a prior."""
    found = rows.mapInArrow(_expectation(prior), "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    sums, k = np.zeros(3 + 2 * len(prior.variance)), len(prior.variance)
    for r in found:
        sums[r["i"]] = r["s"]
    return {"total": sums[0], "spike": sums[1], "loglik": sums[2], "mass": sums[3 : 3 + k], "second": sums[3 + k :]}


def fit_prior(states: DataFrame, student: bool = True, df: float = 1.0, order: int = 12, block: int = 1, null_z: float = 1.5, shares: tuple[float, float] = (0.01, 1 - 1e-4), steps: int = 96, tol: float = 1e-5, multipliers: tuple[float, ...] = (0.25, 0.5, 1.0, 2.0, 4.0), spike_count: float | None = None, anchor_weight: float | None = None) -> SlabPrior:
    """The prior of ``states`` (contig, bin, state, variance). ``spike_count``: pseudo-rows of the spike (a tenth of the weight);
    ``anchor_weight``: of the moment variance in a Student-t scale (25, or a twentieth of the weight). No usable row: an error."""
    rows = staged(weighted_rows(states, block), "states")
    central = F.abs("x") <= null_z * F.sqrt("v")
    first = rows.agg(F.sum("w").alias("w"), F.sum(F.when(central, F.col("w")).otherwise(0.0)).alias("c"), F.sum(F.col("w") * F.greatest(F.col("x") ** 2 - F.col("v"), F.lit(0.0))).alias("m"), F.sum(F.col("w") * F.col("v")).alias("v")).first()
    if not first["w"]:
        raise ValueError("no state has a positive variance")
    moment = first["m"] / first["w"] if first["m"] / first["w"] > FLOOR else first["v"] / first["w"]
    spike = float(np.clip(0.1 * first["w"], 1e-6, 1e6)) if spike_count is None else spike_count
    held = max(25.0, 0.05 * first["w"]) if anchor_weight is None else anchor_weight
    low = max(4.0 * first["v"] / first["w"], FLOOR)
    share = float(np.clip(first["c"] / first["w"] / math.erf(null_z / math.sqrt(2)), *shares))
    if student:
        variance, weight, multiplier = student_slabs(math.sqrt(moment), df, order, low)
    else:
        variance, multiplier = moment * np.asarray(multipliers) ** 2, None
        weight = np.full(len(variance), 1 / len(variance))

    def objective(loglik: float, p: SlabPrior) -> float:
        out = loglik + spike * math.log(max(p.share, FLOOR))
        if student and held > 0:
            scale = max(float(np.mean(np.asarray(p.variance) / multiplier)), FLOOR)
            out -= 0.5 * held * (math.log(scale) + moment / scale)
        return out

    now = SlabPrior(share, tuple(weight.tolist()), tuple(variance.tolist()))
    sums = expectation(rows, now)
    for step in range(1, steps + 1):
        new_share = float(np.clip((sums["spike"] + spike) / (sums["total"] + spike), *shares))
        if student:
            scale = max((float((sums["second"] / multiplier).sum()) + held * moment) / (float(sums["mass"].sum()) + held), FLOOR)
            new = replace(now, share=new_share, variance=tuple(np.maximum(scale * multiplier, low).tolist()))
        else:
            live = sums["mass"] > FLOOR
            var = np.where(live, np.maximum(sums["second"] / np.where(live, sums["mass"], 1.0), FLOOR), now.variance)
            wt = np.maximum(sums["mass"] / max(float(sums["mass"].sum()), FLOOR), 1e-8)
            at = np.argsort(var)
            new = replace(now, share=new_share, variance=tuple(var[at].tolist()), weight=tuple((wt[at] / wt.sum()).tolist()))
        ahead = expectation(rows, new)
        if student and objective(ahead["loglik"], new) < objective(sums["loglik"], now) - max(tol, 1e-12):
            old = math.log(max(float(np.mean(np.asarray(now.variance) / multiplier)), FLOOR))
            to = math.log(max(float(np.mean(np.asarray(new.variance) / multiplier)), FLOOR))
            for k in range(1, 13):
                new = replace(new, variance=tuple(np.maximum(math.exp(old + 0.5**k * (to - old)) * multiplier, low).tolist()))
                ahead = expectation(rows, new)
                if objective(ahead["loglik"], new) >= objective(sums["loglik"], now) - max(tol, 1e-12):
                    break
            else:
                return replace(now, loglik=sums["loglik"], steps=step)
        moved = max(abs(new.share - now.share) / max(now.share, FLOOR), *(abs(a - b) / max(b, FLOOR) for a, b in zip((*new.variance, *new.weight), (*now.variance, *now.weight), strict=True)))
        now, sums = new, ahead
        if moved <= tol:
            return replace(now, loglik=sums["loglik"], steps=step, converged=True)
    return replace(now, loglik=sums["loglik"], steps=steps)


def posterior(states: DataFrame, prior: SlabPrior) -> DataFrame:
    """``states`` with ``shrunk`` (posterior mean), ``shrunk_sd`` (its standard deviation) and ``null`` (mass of the spike). Columns only."""
    x, v = F.col("state"), F.col("variance")
    parts = [(prior.share, 0.0), *(((1 - prior.share) * w, s) for w, s in zip(prior.weight, prior.variance, strict=True))]
    table = F.array(*(F.struct(F.lit(math.log(w)).alias("p"), F.lit(s).alias("s")) for w, s in parts))
    logs = F.transform(table, lambda c: c["p"] - 0.5 * (F.log(v + c["s"]) + x * x / (v + c["s"])))
    d = states.withColumn("_logs", logs).withColumn("_r", F.transform("_logs", lambda c: F.exp(c - F.array_max("_logs"))))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, c: s + c)
    gain = F.transform(table, lambda c: c["s"] / (v + c["s"]))
    d = d.withColumn("_sum", add(F.col("_r"))).withColumn("_m", add(F.zip_with("_r", gain, lambda r, g: r * g)) * x / F.col("_sum"))
    second = add(F.zip_with("_r", gain, lambda r, g: r * (g * g * x * x + g * v))) / F.col("_sum")
    sd = F.sqrt(F.greatest(second - F.col("_m") ** 2, F.lit(0.0)))
    return d.withColumn("shrunk", F.col("_m")).withColumn("shrunk_sd", sd).withColumn("null", F.col("_r")[0] / F.col("_sum")).drop("_logs", "_r", "_sum", "_m")
