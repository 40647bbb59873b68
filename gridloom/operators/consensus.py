"""Consensus fit of many samples: x = background + level + noise, by robust smoothing alternated with the background solver.

Observation j of a bin has variance (v + pad) / lambda, the state (level, or level and trend) steps with variance q / kappa. A
pass smooths the state under the current multipliers and then sets

    lambda = (nu + m) / (nu + sum((x - g - level)^2 + var) / (v + pad)),    kappa = (nu + d) / (nu + trace(Q^-1 E[w w'])),

both clipped; w is the step's noise and m the bin's observations. A contig stops when its penalised negative log-likelihood
changes by less than ``rtol`` twice in a row. Around it, the background of the residuals is solved again and again until its
weighted shift and the likelihood stand still twice.

A tile is one row with arrays. Its bins are cut into blocks that are filtered and smoothed side by side (NumPy over all blocks
of a batch, one step per place in the block); blocks and tiles are joined by the associative filtering elements, so a pass is one
Spark job: fold every tile, carry the state forwards and the information backwards per contig (one row per tile), replay every
tile. Each pass writes a table and deletes the last one; its plan does not grow."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.background import penalties, solve_tiles
from gridloom.operators.statistics import quantiles
from gridloom.schema import TILE
from gridloom.staging import freed, small_join, staged

BLOCK = 64
#: Tiles that are worked on at a time.
TILES = 16


@dataclass(frozen=True)
class Model:
    """``q``: variance of the level's step, and of the trend's if there is one."""

    q: tuple[float, ...]
    nu: float = 8.0
    observation: tuple[float, float] = (0.25, 4.0)
    process: tuple[float, float] = (0.25, 4.0)
    start_var: float = 1e6
    pad: float = 1e-4

    @property
    def size(self) -> int:
        return len(self.q)

    @property
    def step(self) -> np.ndarray:
        return np.eye(1) if self.size == 1 else np.array([[1.0, 1.0], [0.0, 1.0]])


def _t(a: np.ndarray) -> np.ndarray:
    return np.swapaxes(a, -1, -2)


def _element(info, weighted, noise, step) -> tuple:
    """Step with ``noise`` (.., d, d), then observe the level: affine map of the state and information about it."""
    room = 1.0 + info * noise[:, 0, 0]
    gain = noise[:, :, :1] / room[:, None, None]
    keep = np.eye(len(step)) - gain * info[:, None, None] * np.eye(len(step))[:1]
    row = step[:1][None] / room[:, None, None]
    return keep @ step, gain * weighted[:, None, None], keep @ noise, _t(row) * weighted[:, None, None], _t(row) @ step[:1][None] * info[:, None, None]


def _compose(left: tuple, right: tuple) -> tuple:
    a1, b1, c1, e1, j1 = left
    a2, b2, c2, e2, j2 = right
    d = np.linalg.inv(np.eye(a1.shape[-1]) + c1 @ j2)
    back = _t(a1) @ _t(d)
    return a2 @ d @ a1, a2 @ d @ (b1 + c1 @ e2) + b2, a2 @ d @ c1 @ _t(a2) + c2, back @ (e2 - j2 @ b1) + e1, back @ j2 @ a1 + j1


def _ahead(element: tuple, e: np.ndarray, j: np.ndarray) -> tuple:
    """Information about the state before a stretch from that after it."""
    a, b, c, own, gained = element
    back = _t(a) @ _t(np.linalg.inv(np.eye(a.shape[-1]) + c @ j))
    return back @ (e - j @ b) + own, back @ j @ a + gained


def _after(element: tuple, m: np.ndarray, p: np.ndarray) -> tuple:
    """State after a stretch from that before it."""
    a, b, c, e, j = element
    g = a @ np.linalg.inv(np.eye(a.shape[-1]) + p @ j)
    return g @ (m + p @ e) + b, g @ p @ _t(a) + c


def _nothing(n: int, d: int) -> tuple:
    zero, none = np.zeros((n, d, d)), np.zeros((n, d, 1))
    return np.broadcast_to(np.eye(d), (n, d, d)), none, zero, none, zero


def _pick(keep: np.ndarray, new: tuple, old: tuple) -> tuple:
    return tuple(np.where(keep[:, None, None], n, o) for n, o in zip(new, old, strict=True))


class Batch:
    """Some tiles side by side, cut into blocks; arrays are (tile * block, place)."""

    def __init__(self, rows: list[dict], model: Model):
        self.rows, self.model, self.n = rows, model, [len(r["lam"]) for r in rows]
        self.blocks = -(-max(self.n) // BLOCK)
        shape = (len(rows), self.blocks * BLOCK)
        self.info, self.weighted, self.scale, self.mask = np.zeros(shape), np.zeros(shape), np.ones(shape), np.zeros(shape, dtype=bool)
        self.count, self.logs, self.square = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        for t, (r, n) in enumerate(zip(rows, self.n, strict=True)):
            x, v = (np.asarray(r[k], dtype=np.float64).reshape(-1, n) for k in ("x", "v"))
            seen, lam = ~np.isnan(x), np.asarray(r["lam"])
            z, u = np.where(seen, x - np.asarray(r["g"]), 0.0), np.where(seen, v + model.pad, 1.0)
            self.info[t, :n], self.weighted[t, :n] = lam * (seen / u).sum(0), lam * (z / u).sum(0)
            self.scale[t, :n], self.mask[t, :n] = 1.0 / np.asarray(r["kap"]), True
            self.count[t, :n], self.logs[t, :n], self.square[t, :n] = seen.sum(0), np.log(u).sum(0), lam * (z * z / u).sum(0)
        for name in ("info", "weighted", "scale", "mask", "count", "logs", "square"):
            setattr(self, name, getattr(self, name).reshape(-1, BLOCK))

    def _noise(self, place: int) -> np.ndarray:
        return self.scale[:, place, None, None] * np.diag(self.model.q)

    def _of_block(self, parts: tuple, k: int) -> tuple:
        return tuple(p.reshape(len(self.rows), self.blocks, *p.shape[1:])[:, k] for p in parts)

    def blocks_folded(self) -> tuple:
        total = _nothing(len(self.info), self.model.size)
        for i in range(BLOCK):
            total = _pick(self.mask[:, i], _compose(total, _element(self.info[:, i], self.weighted[:, i], self._noise(i), self.model.step)), total)
        return total

    def folded(self) -> list[list[float]]:
        blocks, total = self.blocks_folded(), _nothing(len(self.rows), self.model.size)
        for k in range(self.blocks):
            total = _compose(total, self._of_block(blocks, k))
        return np.concatenate([p.reshape(len(self.rows), -1) for p in total], axis=1).tolist()

    def replayed(self, m: np.ndarray, p: np.ndarray, e: np.ndarray, j: np.ndarray) -> dict:
        """Smoothed moments, moments of the step noise and the likelihood, from the state before and the information behind."""
        d, tiles, blocks = self.model.size, len(self.rows), self.blocks_folded()
        starts, ends = [], [(e, j)]
        for k in range(self.blocks):
            starts.append((m, p))
            m, p = _after(self._of_block(blocks, k), m, p)
        for k in range(self.blocks - 1, 0, -1):
            ends.append(_ahead(self._of_block(blocks, k), *ends[-1]))
        join = lambda parts: tuple(np.stack([x[i] for x in parts], axis=1).reshape(tiles * self.blocks, d, -1) for i in (0, 1))
        (m, p), (e, j) = join(starts), join(ends[::-1])
        step, kept, nll = self.model.step, [], np.zeros(len(m))
        for i in range(BLOCK):
            mp, pp = step @ m, step @ p @ step.T + self._noise(i)
            info, seen = self.info[:, i], self.mask[:, i]
            room, level = 1.0 + info * pp[:, 0, 0], mp[:, 0, 0]
            gain, off = pp[:, :, :1] / room[:, None, None], self.weighted[:, i] - info * level
            lam = self._lam(i)
            square = self.square[:, i] - 2 * level * self.weighted[:, i] + level**2 * info - off**2 * pp[:, 0, 0] / room
            nll += np.where(seen, 0.5 * (self.count[:, i] * math.log(2 * math.pi) + self.logs[:, i] - self.count[:, i] * np.log(lam) + np.log(room) + square), 0.0)
            m, p = _pick(seen, (mp + gain * off[:, None, None], pp - gain * info[:, None, None] @ pp[:, :1]), (m, p))
            kept.append((m, p, mp, pp))
        unit = np.eye(d)
        g = np.linalg.inv(unit + p @ j)
        ms, ps = g @ (m + p @ e), g @ p
        level, var, trend, moved = (np.zeros(self.info.shape) for _ in range(4))
        weigh = np.array([1.0 / q if q > 0 else 0.0 for q in self.model.q])
        for i in range(BLOCK - 1, -1, -1):
            m, p, mp, pp = kept[i]
            if i < BLOCK - 1:
                ahead = kept[i + 1]
                back = p @ step.T @ np.linalg.inv(ahead[3])
                ms, ps = _pick(self.mask[:, i + 1], (m + back @ (ms - ahead[2]), p + back @ (ps - ahead[3]) @ _t(back)), (ms, ps))
            level[:, i], var[:, i], trend[:, i] = ms[:, 0, 0], ps[:, 0, 0], ms[:, -1, 0]
            noise = self._noise(i)
            onto = noise @ np.linalg.inv(pp)
            mean = onto @ (ms - mp)
            moved[:, i] = np.einsum("k,bkk->b", weigh, mean @ _t(mean) + noise - onto @ (pp - ps) @ _t(onto))
        whole = lambda a: [a.reshape(tiles, -1)[t, :n] for t, n in enumerate(self.n)]
        return {"level": whole(level), "var": whole(var), "trend": whole(trend), "moved": whole(moved), "nll": nll.reshape(tiles, -1).sum(1)}

    def _lam(self, place: int) -> np.ndarray:
        if not hasattr(self, "_lams"):
            lam = np.ones((len(self.rows), self.blocks * BLOCK))
            for t, (r, n) in enumerate(zip(self.rows, self.n, strict=True)):
                lam[t, :n] = r["lam"]
            self._lams = lam.reshape(-1, BLOCK)
        return self._lams[:, place]


_STATE = {"contig": "string", "tile": "long", "x": "array<double>", "v": "array<double>", "g": "array<double>", "lam": "array<double>", "kap": "array<double>", "level": "array<double>", "trend": "array<double>", "var": "array<double>", "w": "array<double>", "rhs": "array<double>", "nll": "double"}
_KIND = ", ".join(f"{k} {v}" for k, v in _STATE.items())


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, TILES):
            part = batch.slice(at, TILES)
            names = part.schema.names
            yield [dict(zip(names, row, strict=True)) for row in zip(*(part[c].to_pylist() for c in names), strict=True)]


def _folding(model: Model):
    def run(batches):
        for rows in _slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([r["contig"] for r in rows], pa.string()), pa.array([r["tile"] for r in rows], pa.int64()), pa.array(Batch(rows, model).folded(), pa.list_(pa.float64()))], names=["contig", "tile", "el"])

    return run


def _carrying(model: Model):
    d = model.size

    def parts(flat) -> tuple:
        flat, at, out = np.asarray(flat), 0, []
        for shape in ((1, d, d), (1, d, 1), (1, d, d), (1, d, 1), (1, d, d)):
            size = int(np.prod(shape))
            out.append(flat[at : at + size].reshape(shape))
            at += size
        return tuple(out)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tile")
        elements = [parts(x) for x in pdf["el"]]
        m, p, starts = np.zeros((1, d, 1)), model.start_var * np.eye(d)[None], []
        e, j, ends = np.zeros((1, d, 1)), np.zeros((1, d, d)), []
        for x in elements:
            starts.append(np.concatenate([m.ravel(), p.ravel()]))
            m, p = _after(x, m, p)
        for x in reversed(elements):
            ends.append(np.concatenate([e.ravel(), j.ravel()]))
            e, j = _ahead(x, e, j)
        return pd.DataFrame({"contig": pdf["contig"], "tile": pdf["tile"], "carry": [np.concatenate(x).tolist() for x in zip(starts, reversed(ends), strict=True)]})

    return run


def _replaying(model: Model, done: frozenset):
    """New multipliers for contigs that are not ``done``; weights and right sides for the background."""
    d = model.size
    clip = lambda a, ends: np.clip(a, *ends)

    def run(batches):
        for rows in _slices(batches):
            carry = np.array([r["carry"] for r in rows])
            cuts = np.cumsum([d, d * d, d])
            m, p, e, j = (c.reshape(len(rows), d, -1) for c in np.split(carry, cuts, axis=1))
            got = Batch(rows, model).replayed(m, p, e, j)
            out = []
            for t, r in enumerate(rows):
                lam, kap, level = np.asarray(r["lam"]), np.asarray(r["kap"]), got["level"][t]
                x, v = (np.asarray(r[k]).reshape(-1, len(lam)) for k in ("x", "v"))
                seen, off = ~np.isnan(x), x - np.asarray(r["g"]) - level
                inverse = np.where(seen, 1.0 / (v + model.pad), 0.0)
                nll = got["nll"][t] + 0.5 * model.nu * (float((lam - np.log(lam)).sum()) + float((kap - np.log(kap))[r["tile"] == 0 :].sum()))
                if r["contig"] not in done:
                    u = np.where(seen, (off**2 + got["var"][t]) * inverse, 0.0).sum(0)
                    lam = clip((model.nu + seen.sum(0)) / (model.nu + u), model.observation)
                    kap = clip((model.nu + d) / (model.nu + np.maximum(got["moved"][t], 0.0)), model.process)
                    if r["tile"] == 0:
                        kap[0] = 1.0
                w = lam * inverse.sum(0)
                rhs = lam * np.where(seen, (x - level) * inverse, 0.0).sum(0)
                out.append((r["contig"], r["tile"], r["x"], r["v"], r["g"], lam, kap, level, got["trend"][t], got["var"][t], w, rhs, nll))
            columns = list(zip(*out, strict=True))
            kinds = [{"string": pa.string(), "long": pa.int64(), "double": pa.float64()}.get(k, pa.list_(pa.float64())) for k in _STATE.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=list(_STATE))

    return run


def packed(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """Tiles with unit multipliers and no background. ``cells``: contig, bin, sample, x, v; every tile of a contig needs some row, missing
    cells count as not observed. Arrays are sample by sample in order of the names (the samples are one array per row)."""
    ends = staged(cells.groupBy("contig").agg(F.max("bin").alias("_end")), "ends")
    d = small_join(cells, ends, ["contig"]).withColumn("tile", F.least(F.floor(F.col("bin") / tile), F.greatest(F.floor((F.col("_end") + 1) / tile), F.lit(1)) - 1))
    last = F.col("tile") == F.greatest(F.floor((F.col("_end") + 1) / tile), F.lit(1)) - 1
    size = F.when(last, F.col("_end") + 1 - F.col("tile") * tile).otherwise(F.lit(tile))
    names = sorted(r["sample"] for r in cells.select("sample").distinct().collect())  # as many as there are samples
    d = d.withColumn("_n", size)
    place = (F.array_position(F.array(*map(F.lit, names)), F.col("sample")) - 1) * F.col("_n") + F.col("bin") - F.col("tile") * tile
    rows = d.groupBy("contig", "tile").agg(F.map_from_entries(F.collect_list(F.struct(place.alias("k"), F.struct(F.col("x").cast("double").alias("x"), F.col("v").cast("double").alias("v"))))).alias("_at"), F.first("_n").alias("_n"))
    nan = F.lit(float("nan"))
    order = F.sequence(F.lit(0).cast("long"), F.lit(len(names)) * F.col("_n") - 1)
    one = lambda c: F.transform(order, lambda i: F.coalesce(F.element_at("_at", i)[c], nan))
    flat = lambda v: F.transform(F.sequence(F.lit(1), F.col("_n").cast("int")), lambda _: F.lit(v))
    zero = flat(0.0)
    return rows.select("contig", "tile", one("x").alias("x"), one("v").alias("v"), zero.alias("g"), flat(1.0).alias("lam"), flat(1.0).alias("kap"), zero.alias("level"), zero.alias("trend"), zero.alias("var"), zero.alias("w"), zero.alias("rhs"), F.lit(0.0).alias("nll"))


def one_pass(state: DataFrame, model: Model, done: frozenset = frozenset()) -> DataFrame:
    """The next generation of ``state``: smoothed under its multipliers, with new ones."""
    needed = state.select("contig", "tile", "x", "v", "g", "lam", "kap")
    carries = needed.mapInArrow(_folding(model), "contig string, tile long, el array<double>").groupBy("contig").applyInPandas(_carrying(model), "contig string, tile long, carry array<double>")
    carries = staged(carries, "carries")
    out = staged(small_join(needed, carries, ["contig", "tile"]).mapInArrow(_replaying(model, done), _KIND), "state")
    freed(carries)
    return out


def robust_fit(state: DataFrame, model: Model, passes: int = 50, rtol: float = 1e-4, patience: int = 2) -> tuple[DataFrame, dict[str, dict]]:
    """Passes until every contig's likelihood stands still; per contig the number of passes, the path and whether it converged.
    Each contig brings one number per pass to the driver."""
    told: dict[str, dict] = {}
    for k in range(passes):
        before, state = state, one_pass(state, model, frozenset(c for c, t in told.items() if t["converged"]))
        freed(before)
        for r in state.groupBy("contig").agg(F.sum("nll").alias("nll")).collect():
            t = told.setdefault(r["contig"], {"path": [], "stable": 0, "converged": False, "passes": 0})
            if t["converged"]:
                continue
            old, new = (t["path"][-1] if t["path"] else None), r["nll"]
            t["path"].append(new)
            t["passes"] = k + 1
            t["stable"] = t["stable"] + 1 if old is not None and abs(new - old) <= rtol * max(abs(old), abs(new), 1.0) else 0
            t["converged"] = t["stable"] >= patience
        if all(t["converged"] for t in told.values()):
            break
    return state, told


def consensus_fit(cells: DataFrame, model: Model, span: float, smoothness: float = 1.0, zero_sum: bool = False, negative: float | None = 1.0, outer: int = 32, least: int = 3, passes: int = 50, rtol: float = 1e-4, shift_tol: float = 1e-3, tile: int = TILE) -> tuple[DataFrame, list[dict]]:
    """contig, bin, level, trend, variance, background, lambda, kappa; and per outer pass its shift, likelihood and stops.

    ``span``: correlation length of the background in bins; ``negative``: further weight of negative background in medians of the
    contig's weights. Stops after at least ``least`` passes, two of which moved no contig's background by more than
    ``shift_tol`` (weighted root mean square, relative to the background's own or 1), with converged likelihoods."""
    first, second = penalties(span, smoothness)
    state, history, calm, last = staged(packed(cells, tile), "state"), [], 0, None
    for _ in range(outer):
        state, told = robust_fit(state, model, passes, rtol)
        total = sum(t["path"][-1] for t in told.values())
        extra = None
        if negative:
            weights = state.select("contig", F.explode("w").alias("w")).filter("w > 0")
            extra = staged(quantiles(weights, ["contig"], "w", {"extra": 0.5}).select("contig", (F.col("extra") * negative).alias("extra")), "extra")
        g = solve_tiles(state.select("contig", "tile", "w", "rhs"), first, second, zero_sum, extra, start=state.select("contig", "tile", "g") if history else None)
        both = state.drop("nll").join(g.withColumnRenamed("g", "_new"), ["contig", "tile"])
        rms = lambda c: F.sum(F.aggregate(F.zip_with("w", c, lambda w, v: w * v * v), F.lit(0.0), lambda a, v: a + v))
        moves = both.groupBy("contig").agg(rms(F.zip_with("g", "_new", lambda a, b: a - b)).alias("d"), rms(F.col("g")).alias("a"), rms(F.col("_new")).alias("b"), F.sum(F.aggregate("w", F.lit(0.0), lambda a, v: a + v)).alias("w")).filter("w > 0").collect()
        root = lambda v, w: math.sqrt(max(v, 0.0) / w)
        shift = max((root(r["d"], r["w"]) / max(root(r["a"], r["w"]), root(r["b"], r["w"]), 1.0) for r in moves), default=0.0)
        still = last is not None and abs(total - last) <= rtol * max(abs(total), abs(last), 1.0)
        calm = calm + 1 if shift <= shift_tol and still and all(t["converged"] for t in told.values()) else 0
        history.append({"shift": shift, "nll": total, "passes": max((t["passes"] for t in told.values()), default=0), "calm": calm})
        last, before = total, state
        state = staged(both.drop("g").withColumnRenamed("_new", "g").withColumn("nll", F.lit(0.0)).select(*_STATE), "state")
        freed(before, g, extra)
        if not told or (calm >= 2 and len(history) >= least):
            break
    zipped = F.arrays_zip("level", "trend", "var", "g", "lam", "kap")
    rows = state.select("contig", "tile", F.posexplode(zipped).alias("_i", "_c"))
    trend = F.col("_c.trend") if model.size > 1 else F.lit(0.0)
    return rows.select("contig", (F.col("tile") * tile + F.col("_i")).alias("bin"), F.col("_c.level").alias("level"), trend.alias("trend"), F.col("_c.var").alias("variance"), F.col("_c.g").alias("background"), F.col("_c.lam").alias("lambda"), F.col("_c.kap").alias("kappa")), history
