"""Local-level smoother over tiles: the scalar random-walk filter and its fixed-interval smoother as associative scans.

A filter element over a stretch of bins is (A, b, C, eta, J): the affine-Gaussian map from the state before the stretch to the
state after it, with the information that the stretch gives about the state before. Elements of tiles are composed per contig
(one row per tile), then every tile replays its bins from its carried mean and variance; the smoother does the same
backwards with affine maps. (Särkkä and García-Fernández, Temporal Parallelization of Bayesian Smoothers, 2021.)
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.schema import TILE


def _compose(left: tuple, right: tuple) -> tuple:
    a1, b1, c1, e1, j1 = left
    a2, b2, c2, e2, j2 = right
    d = 1.0 / (1.0 + c1 * j2)
    return (a2 * d * a1, a2 * d * (b1 + c1 * e2) + b2, a2 * d * c1 * a2 + c2, a1 * d * (e2 - j2 * b1) + e1, a1 * d * j2 * a1 + j1)


def _element(info: float, weighted: float, q: float) -> tuple:
    """One bin: predict with variance q, then observe with information ``info`` (0: nothing) and its weighted sum."""
    gain = q * info / (1.0 + q * info)
    return (1.0 - gain, q * weighted / (1.0 + q * info), q / (1.0 + q * info), weighted / (1.0 + q * info), info / (1.0 + q * info))


def smooth_level(cells: DataFrame, q: float, start_mean: float = 0.0, start_var: float = 1e6, tile: int = TILE) -> DataFrame:
    """contig, bin, level, variance. ``cells``: contig, bin, info (sum of 1/R), weighted (sum of z/R), every bin present."""
    d = cells.select("contig", "bin", F.col("info").cast("double"), F.col("weighted").cast("double")).withColumn("tile", F.floor(F.col("bin") / tile))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        total = (1.0, 0.0, 0.0, 0.0, 0.0)
        for i, w in zip(pdf["info"], pdf["weighted"], strict=True):
            total = _compose(total, _element(i, w, q))
        return pd.DataFrame({"contig": pdf["contig"].iloc[:1], "tile": pdf["tile"].iloc[:1], **{k: [v] for k, v in zip("abcej", total, strict=True)}})

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tile")
        m, p, out = start_mean, start_var, []
        for row in pdf[list("abcej")].itertuples(index=False):
            out.append((m, p))
            a, b, c, e, j = row
            g = 1.0 / (1.0 + p * j)
            m, p = a * g * (m + p * e) + b, a * g * p * a + c
        return pd.DataFrame({"contig": pdf["contig"], "tile": pdf["tile"], "m0": [x for x, _ in out], "p0": [x for _, x in out]})

    def filtered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        m, p = float(pdf["m0"].iloc[0]), float(pdf["p0"].iloc[0])
        means, variances = np.empty(len(pdf)), np.empty(len(pdf))
        for k, (i, w) in enumerate(zip(pdf["info"], pdf["weighted"], strict=True)):
            p += q
            v = 1.0 / (1.0 / p + i)
            m, p = v * (m / p + w), v
            means[k], variances[k] = m, p
        return pd.DataFrame({"contig": pdf["contig"], "tile": pdf["tile"], "bin": pdf["bin"], "m": means, "p": variances})

    def back_fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin", ascending=False)
        e, g, s = 1.0, 0.0, 0.0  # level before = e * level after + g, variance e^2 * variance after + s
        for m, p in zip(pdf["m"], pdf["p"], strict=True):
            k = p / (p + q)
            e, g, s = k * e, k * g + (1 - k) * m, k * k * s + k * q
        return pd.DataFrame({"contig": pdf["contig"].iloc[:1], "tile": pdf["tile"].iloc[:1], "e": [e], "g": [g], "s": [s], "last_m": [pdf["m"].iloc[0]], "last_p": [pdf["p"].iloc[0]]})

    def back_carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tile", ascending=False)
        m = v = None
        out = []
        for row in pdf.itertuples(index=False):
            first = m is None
            if first:  # the last bin's smoothed state is its filtered one: (p + q)-prediction that adds nothing
                m, v = row.last_m, row.last_p + q
            out.append((m, v))
            m, v = row.e * m + row.g, row.e * row.e * v + row.s
        return pd.DataFrame({"contig": pdf["contig"], "tile": pdf["tile"], "mn": [x for x, _ in out], "vn": [x for _, x in out]})

    def smoothed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin", ascending=False)
        x, v = float(pdf["mn"].iloc[0]), float(pdf["vn"].iloc[0])
        levels, variances = [], []
        for m, p in zip(pdf["m"], pdf["p"], strict=True):
            k = p / (p + q)
            x, v = k * x + (1 - k) * m, k * k * v + k * q
            levels.append(x)
            variances.append(v)
        return pd.DataFrame({"contig": pdf["contig"], "bin": pdf["bin"], "level": levels, "variance": variances})

    head = "contig string, tile long"
    carried = d.groupBy("contig", "tile").applyInPandas(fold, f"{head}, a double, b double, c double, e double, j double").groupBy("contig").applyInPandas(carry, f"{head}, m0 double, p0 double")
    f = d.join(carried, ["contig", "tile"]).groupBy("contig", "tile").applyInPandas(filtered, f"{head}, bin long, m double, p double")
    back = f.groupBy("contig", "tile").applyInPandas(back_fold, f"{head}, e double, g double, s double, last_m double, last_p double").groupBy("contig").applyInPandas(back_carry, f"{head}, mn double, vn double")
    return f.join(back, ["contig", "tile"]).groupBy("contig", "tile").applyInPandas(smoothed, "contig string, bin long, level double, variance double")


def select_runs(scores: DataFrame, penalty: float, switch: float, tile: int = TILE) -> DataFrame:
    """Bins (contig, bin, selected) that maximise sum(score - penalty) over selected bins minus ``switch`` per change of
    state, starting unselected. Ties prefer fewer selected bins. Tiles fold to 2x2 max-plus matrices of (value, -selected)."""
    d = scores.select("contig", "bin", F.col("score").cast("double")).withColumn("tile", F.floor(F.col("bin") / tile))

    def step(state: list[tuple], gain: float) -> tuple[list[tuple], list[int]]:
        out, came = [], []
        for now in (0, 1):
            paths = [(state[was][0] - (switch if was != now else 0.0) + (gain if now else 0.0), state[was][1] - now) for was in (0, 1)]
            best = 0 if paths[0] >= paths[1] else 1
            out.append(paths[best])
            came.append(best)
        return out, came

    never = (-np.inf, 0)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        cells = {}
        for was in (0, 1):
            state = [never, never]
            state[was] = (0.0, 0)
            for x in pdf["score"]:
                state, _ = step(state, x - penalty)
            for now in (0, 1):
                cells[f"v{was}{now}"], cells[f"n{was}{now}"] = [state[now][0]], [state[now][1]]
        return pd.DataFrame({"contig": pdf["contig"].iloc[:1], "tile": pdf["tile"].iloc[:1], **cells})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tile")
        rows = pdf.to_dict("records")
        state, starts, came = [(0.0, 0), never], [], []
        for r in rows:
            starts.append(state)
            after, back = [], []
            for now in (0, 1):
                paths = [(state[was][0] + r[f"v{was}{now}"], state[was][1] + r[f"n{was}{now}"]) for was in (0, 1)]
                best = 0 if paths[0] >= paths[1] else 1
                after.append(paths[best])
                back.append(best)
            came.append(back)
            state = after
        now = 0 if state[0] >= state[1] else 1
        ends = []
        for back in reversed(came):
            ends.append((back[now], now))
            now = back[now]
        ends.reverse()
        return pd.DataFrame({"contig": pdf["contig"], "tile": pdf["tile"], "enter": [a for a, _ in ends], "leave": [b for _, b in ends]})

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        state, came = [never, never], []
        state[int(pdf["enter"].iloc[0])] = (0.0, 0)
        for x in pdf["score"]:
            state, back = step(state, x - penalty)
            came.append(back)
        now, picked = int(pdf["leave"].iloc[0]), []
        for back in reversed(came):
            picked.append(bool(now))
            now = back[now]
        return pd.DataFrame({"contig": pdf["contig"], "bin": pdf["bin"], "selected": picked[::-1]})

    head = "contig string, tile long"
    cells = ", ".join(f"v{a}{b} double, n{a}{b} long" for a in (0, 1) for b in (0, 1))
    ends = d.groupBy("contig", "tile").applyInPandas(fold, f"{head}, {cells}").groupBy("contig").applyInPandas(chain, f"{head}, enter int, leave int")
    return d.join(ends, ["contig", "tile"]).groupBy("contig", "tile").applyInPandas(replay, "contig string, bin long, selected boolean")
