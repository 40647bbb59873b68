"""Level-trend smoother over tiles (state: level and its slope), robust level weights, and run selection under a budget.

The same associative elements as the level smoother, as 2 x 2 matrices: (A, b, C, eta, J) over a stretch of bins. Tiles fold to
one element each, elements are composed per contig (one row per tile), and each tile replays its bins from its carried state;
the smoother goes backwards with affine maps of the state after."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import tiles
from gridloom.schema import TILE
from gridloom.staging import freed, staged

_STEP = np.array([[1.0, 1.0], [0.0, 1.0]])
_UNIT = np.eye(2)
_FLAT = ", ".join(f"{k}{i} double" for k, n in (("a", 4), ("b", 2), ("c", 4), ("e", 2), ("j", 4)) for i in range(n))
_SIZES = (("a", (2, 2)), ("b", (2,)), ("c", (2, 2)), ("e", (2,)), ("j", (2, 2)))


def _element(info: float, weighted: float, noise: np.ndarray) -> tuple:
    """One bin: step with ``noise``, then observe the level with information ``info`` and its weighted sum."""
    room = 1.0 + info * noise[0, 0]
    gain = noise[:, 0] / room
    keep = _UNIT - np.outer(gain * info, [1.0, 0.0])
    row = _STEP[0] / room
    return keep @ _STEP, gain * weighted, keep @ noise, row * weighted, np.outer(row, _STEP[0]) * info


def _compose(left: tuple, right: tuple) -> tuple:
    a1, b1, c1, e1, j1 = left
    a2, b2, c2, e2, j2 = right
    d = np.linalg.inv(_UNIT + c1 @ j2)
    return a2 @ d @ a1, a2 @ d @ (b1 + c1 @ e2) + b2, a2 @ d @ c1 @ a2.T + c2, a1.T @ d.T @ (e2 - j2 @ b1) + e1, a1.T @ d.T @ j2 @ a1 + j1


def _flat(parts, names: str) -> dict:
    return {f"{k}{i}": [float(v)] for k, x in zip(names, parts, strict=True) for i, v in enumerate(np.ravel(x))}


def _take(row, name: str, shape: tuple) -> np.ndarray:
    return np.array([getattr(row, f"{name}{i}") for i in range(int(np.prod(shape)))]).reshape(shape)


def smooth_level_trend(cells: DataFrame, q_level: float, q_trend: float, start_var: float = 1e6, tile: int = TILE) -> DataFrame:
    """contig, bin, level, trend, variance (of the level). ``cells``: contig, bin, info (sum of 1/R), weighted (sum of z/R),
    every bin present; the first bin's state steps from mean 0 and variance ``start_var``."""
    noise = np.diag([q_level, q_trend])
    d = cells.select("contig", "bin", F.col("info").cast("double"), F.col("weighted").cast("double")).withColumn("tile", F.floor(F.col("bin") / tile))
    head = "contig string, tile long"
    names = lambda pdf: {"contig": pdf["contig"].iloc[:1].tolist(), "tile": pdf["tile"].iloc[:1].tolist()}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        total = (_UNIT, np.zeros(2), np.zeros((2, 2)), np.zeros(2), np.zeros((2, 2)))
        for i, w in zip(pdf["info"], pdf["weighted"], strict=True):
            total = _compose(total, _element(i, w, noise))
        return pd.DataFrame({**names(pdf), **_flat(total, "abcej")})

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        m, p, out = np.zeros(2), start_var * _UNIT, []
        for row in pdf.sort_values("tile").itertuples(index=False):
            out.append(pd.DataFrame({"contig": [row.contig], "tile": [row.tile], **_flat((m, p), "mp")}))
            a, b, c, e, j = (_take(row, k, s) for k, s in _SIZES)
            g = np.linalg.inv(_UNIT + p @ j)
            m, p = a @ g @ (m + p @ e) + b, a @ g @ p @ a.T + c
        return pd.concat(out)

    def filtered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        first = next(pdf.itertuples(index=False))
        m, p, out = _take(first, "m", (2,)), _take(first, "p", (2, 2)), []
        for i, w in zip(pdf["info"], pdf["weighted"], strict=True):
            m, p = _STEP @ m, _STEP @ p @ _STEP.T + noise
            gain = p[:, 0] / (1.0 + i * p[0, 0])
            m, p = m + gain * (w - i * m[0]), p - np.outer(gain * i, p[0])
            out.append([*m, *p.ravel()])
        return pd.concat([pdf[["contig", "tile", "bin"]].reset_index(drop=True), pd.DataFrame(out, columns=["m0", "m1", "p0", "p1", "p2", "p3"])], axis=1)

    def back(m: np.ndarray, p: np.ndarray) -> tuple:
        """State here from the smoothed state after: gain, offset, noise."""
        ahead = _STEP @ p @ _STEP.T + noise
        g = p @ _STEP.T @ np.linalg.inv(ahead)
        return g, m - g @ _STEP @ m, p - g @ ahead @ g.T

    def states(pdf: pd.DataFrame):
        for row in pdf.sort_values("bin", ascending=False).itertuples(index=False):
            yield row.bin, _take(row, "m", (2,)), _take(row, "p", (2, 2))

    def back_fold(pdf: pd.DataFrame) -> pd.DataFrame:
        e, g, s, last = _UNIT, np.zeros(2), np.zeros((2, 2)), None
        for _, m, p in states(pdf):
            last = last or (m, p)
            k, o, v = back(m, p)
            e, g, s = k @ e, k @ g + o, k @ s @ k.T + v
        return pd.DataFrame({**names(pdf), **_flat((e, g, s, *last), "egsmp")})

    def back_carry(pdf: pd.DataFrame) -> pd.DataFrame:
        m, out = None, []
        for row in pdf.sort_values("tile", ascending=False).itertuples(index=False):
            if m is None:  # a predicted state that adds nothing to the last bin's own
                lm, lp = _take(row, "m", (2,)), _take(row, "p", (2, 2))
                m, v = _STEP @ lm, _STEP @ lp @ _STEP.T + noise
            out.append(pd.DataFrame({"contig": [row.contig], "tile": [row.tile], **_flat((m, v), "xv")}))
            e, g, s = _take(row, "e", (2, 2)), _take(row, "g", (2,)), _take(row, "s", (2, 2))
            m, v = e @ m + g, e @ v @ e.T + s
        return pd.concat(out)

    def smoothed(pdf: pd.DataFrame) -> pd.DataFrame:
        first = next(pdf.itertuples(index=False))
        x, v, out = _take(first, "x", (2,)), _take(first, "v", (2, 2)), []
        for at, m, p in states(pdf):
            k, o, s = back(m, p)
            x, v = k @ x + o, k @ v @ k.T + s
            out.append((first.contig, at, x[0], x[1], v[0, 0]))
        return pd.DataFrame(out, columns=["contig", "bin", "level", "trend", "variance"])

    flat = lambda **sizes: ", ".join(f"{k}{i} double" for k, n in sizes.items() for i in range(n))
    carried = d.groupBy("contig", "tile").applyInPandas(fold, f"{head}, {_FLAT}").groupBy("contig").applyInPandas(carry, f"{head}, {flat(m=2, p=4)}")
    f = d.join(carried, ["contig", "tile"]).groupBy("contig", "tile").applyInPandas(filtered, f"{head}, bin long, {flat(m=2, p=4)}")
    after = f.groupBy("contig", "tile").applyInPandas(back_fold, f"{head}, {flat(e=4, g=2, s=4, m=2, p=4)}").groupBy("contig").applyInPandas(back_carry, f"{head}, {flat(x=2, v=4)}")
    return f.join(after, ["contig", "tile"]).groupBy("contig", "tile").applyInPandas(smoothed, "contig string, bin long, level double, trend double, variance double")


def robust_level(cells: DataFrame, q: float, nu: float = 8.0, low: float = 0.2, high: float = 5.0, rounds: int = 3, tile: int = TILE) -> DataFrame:
    """Level smoother with Student-t precision multipliers: ``rounds`` times, cells get lambda = (nu + 1) / (nu + u), with u
    the squared residual and the level's variance over R, clipped. ``cells``: contig, bin, sample, x, r (variance)."""
    level, weighed = None, cells.withColumn("_w", F.lit(1.0))
    for _ in range(rounds + 1):  # each round reads the level that the one before has written
        if level is not None:
            u = (F.pow(F.col("x") - F.col("level"), 2) + F.col("variance")) / F.col("r")
            weighed = cells.join(level, ["contig", "bin"]).withColumn("_w", F.least(F.lit(high), F.greatest(F.lit(low), (nu + 1) / (nu + u)))).drop("level", "variance")
        before, level = level, staged(tiles.smooth_level(weighed.groupBy("contig", "bin").agg(F.sum(F.col("_w") / F.col("r")).alias("info"), F.sum(F.col("_w") * F.col("x") / F.col("r")).alias("weighted")), q, tile=tile), "level")
        freed(before)
    return level


def budgeted_runs(scores: DataFrame, share: float, switch: float, rounds: int = 2, steps: int = 8, tile: int = TILE) -> DataFrame:
    """Runs (contig, bin, selected) whose penalty is the least on a grid that keeps a contig's selected bins within ``share``.

    The penalty is bisected ``steps`` ways at a time: all candidates of a round are selections of one job, keyed by (contig,
    candidate), and only their counts are compared. Ends of the search are the contig's least and largest score."""
    scores = staged(scores.select("contig", "bin", "score"), "scores")
    ends = scores.groupBy("contig").agg(F.min("score").alias("_lo"), (F.max("score") + switch).alias("_hi"), F.floor(share * F.count(F.lit(1))).alias("_most"))
    for _ in range(rounds):
        tried = ends.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(steps)))).withColumn("_p", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_k") / steps)
        keyed = scores.join(tried, "contig").select(F.concat_ws("\x1f", "contig", F.col("_k").cast("string")).alias("contig"), "bin", (F.col("score") - F.col("_p")).alias("score"))
        counts = tiles.select_runs(keyed, 0.0, switch, tile).groupBy("contig").agg(F.count_if("selected").alias("_n"))
        counts = counts.select(F.split("contig", "\x1f")[0].alias("contig"), F.split("contig", "\x1f")[1].cast("int").alias("_k"), "_n")
        fits = counts.join(ends.select("contig", "_most"), "contig").filter("_n <= _most").groupBy("contig").agg(F.min("_k").alias("_k"))
        width = (F.col("_hi") - F.col("_lo")) / steps
        ends = staged(ends.join(fits, "contig").select("contig", (F.col("_lo") + width * (F.col("_k") - 1)).alias("_lo"), (F.col("_lo") + width * F.col("_k")).alias("_hi"), "_most"), "ends")
    shifted = scores.join(ends, "contig").select("contig", "bin", (F.col("score") - F.col("_hi")).alias("score"))
    return tiles.select_runs(shifted, 0.0, switch, tile)
