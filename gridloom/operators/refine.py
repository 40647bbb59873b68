"""Nested refinement of selected runs: every parent is solved again, with a least run length and one bin that must stay.

Inside a parent the bins are chosen that maximise sum(score - penalty) less a cost for each boundary inside the parent and for each
run; runs have at least ``least`` bins and the parent's strongest bin is in one of them. Ties prefer fewer bins. It is a chain of
``least + 1`` states (off, on for 1, 2, ... bins), so a stretch of bins is a max-plus matrix of (value, -bins) pairs: pieces of
parents fold side by side, are chained per parent (one row per piece), and replay from the states that the chain chose.
Children that gain replace their parent; they are parents of the next round until nothing splits or a contig's mask hardly moves."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.intervals import runs
from gridloom.operators.statistics import quantiles
from gridloom.schema import TILE
from gridloom.staging import freed, small_join, staged

#: Cost of a run's boundary that is the parent's own.
EDGE = 1e-12
#: Values that differ by less are equal.
TIE = 1e-9
#: Pieces that are worked on at a time.
PIECES = 256


def _best(value: np.ndarray, count: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest value, of (nearly) equal ones the smallest count, along ``axis``, and where."""
    top = value.max(axis=axis, keepdims=True)
    few = np.where(value >= top - TIE, count, np.iinfo(np.int64).max)
    at = few.argmin(axis=axis)
    pick = np.expand_dims(at, axis)
    return np.take_along_axis(value, pick, axis).squeeze(axis), np.take_along_axis(count, pick, axis).squeeze(axis), at


class Pieces:
    """Stretches of parents side by side. ``gain``: score less penalty; ``cost``: of a boundary before the bin; ``run``: of a run."""

    def __init__(self, gain: list[np.ndarray], cost: list[np.ndarray], must: list[np.ndarray], run: np.ndarray, least: int):
        self.order = sorted(range(len(gain)), key=lambda i: -len(gain[i]))
        self.gain, self.cost, self.must, self.run, self.least = gain, cost, must, run, least

    def _step(self, value: np.ndarray, count: np.ndarray, live: list[int], t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One bin. ``value``, ``count``: (piece, way, state); returns them after the bin, with the state each came from."""
        least, n = self.least, len(live)
        g, c = (np.array([a[i][t] for i in live])[:, None] for a in (self.gain, self.cost))
        forced = np.array([self.must[i][t] for i in live])[:, None]
        out_v, out_c = np.full_like(value[:n], -np.inf), np.zeros_like(count[:n])
        came = np.tile(np.arange(least + 1) - 1, (*out_v.shape[:2], 1))
        v, k = value[:n], count[:n]
        stay = _best(np.stack([v[:, :, 0], v[:, :, least] - c], axis=-1), np.stack([k[:, :, 0], k[:, :, least]], axis=-1), 2)
        out_v[:, :, 0], out_c[:, :, 0], came[:, :, 0] = np.where(forced, -np.inf, stay[0]), stay[1], np.where(stay[2] == 0, 0, least)
        out_v[:, :, 1:], out_c[:, :, 1:] = v[:, :, :-1] + g[:, :, None], k[:, :, :-1] + 1
        out_v[:, :, 1] += -c - self.run[live][:, None]
        on = _best(np.stack([out_v[:, :, least], v[:, :, least] + g], axis=-1), np.stack([out_c[:, :, least], k[:, :, least] + 1], axis=-1), 2)
        came[:, :, least] = np.where(on[2] == 0, came[:, :, least], least)
        out_v[:, :, least], out_c[:, :, least] = on[:2]
        return out_v, out_c, came

    def _walk(self, value: np.ndarray, count: np.ndarray, trace: bool):
        """Arrays in the order of ``self.order``."""
        value, count, traces, live = value.copy(), count.copy(), [], list(self.order)
        for t in range(len(self.gain[live[0]]) if live else 0):
            while len(self.gain[live[-1]]) <= t:
                live.pop()
            n = len(live)
            value[:n], count[:n], came = self._step(value, count, live, t)
            if trace:
                traces.append(came)
        return value, count, traces

    def folded(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Values and counts, state before by state after."""
        size = self.least + 1
        value = np.full((len(self.gain), size, size), -np.inf)
        value[:, range(size), range(size)] = 0.0
        value, count, _ = self._walk(value, np.zeros(value.shape, dtype=np.int64), False)
        out = [None] * len(self.gain)
        for k, i in enumerate(self.order):
            out[i] = (value[k], count[k])
        return out

    def masks(self, enter: np.ndarray, leave: np.ndarray) -> list[np.ndarray]:
        """Chosen bins of each piece between two states."""
        size = self.least + 1
        value = np.full((len(self.gain), 1, size), -np.inf)
        for k, i in enumerate(self.order):
            value[k, 0, enter[i]] = 0.0
        traces = self._walk(value, np.zeros(value.shape, dtype=np.int64), True)[2]
        out = [np.zeros(len(g), dtype=bool) for g in self.gain]
        state = np.array([leave[i] for i in self.order])
        for t in range(len(traces) - 1, -1, -1):
            n = len(traces[t])
            for k in np.flatnonzero(state[:n] > 0):
                out[self.order[k]][t] = True
            state[:n] = traces[t][np.arange(n), 0, state[:n]]
        return out


def _pieces(rows: list[dict], least: int) -> Pieces:
    gain, cost, must = [], [], []
    for r in rows:
        g = np.asarray(r["score"]) - r["penalty"] - r["floor"]
        c = np.full(len(g), r["cost"])
        if r["piece"] == 0 and len(c):
            c[0] = EDGE
        at = np.arange(len(g)) + r["first"] == r["must"]
        gain.append(g)
        cost.append(c)
        must.append(at)
    return Pieces(gain, cost, must, np.array([r["cost"] for r in rows]), least)


def _rows(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, PIECES):
            part = batch.slice(at, PIECES)
            names = part.schema.names
            yield [dict(zip(names, row, strict=True)) for row in zip(*(part[c].to_pylist() for c in names), strict=True)]


def _fold(least: int):
    def run(batches):
        for rows in _rows(batches):
            found = _pieces(rows, least).folded()
            yield pa.RecordBatch.from_arrays([pa.array([r["contig"] for r in rows], pa.string()), pa.array([r["region"] for r in rows], pa.int64()), pa.array([r["piece"] for r in rows], pa.int64()), pa.array([v.ravel().tolist() for v, _ in found], pa.list_(pa.float64())), pa.array([c.ravel().tolist() for _, c in found], pa.list_(pa.int64()))], names=["contig", "region", "piece", "v", "c"])

    return run


def _chained(least: int):
    size = least + 1

    def run(batches):
        """Pieces of a parent in order to the states between them and the parent's best value."""
        now, gathered = None, []

        def close():
            value, count, came = np.full(size, -np.inf), np.zeros(size, dtype=np.int64), []
            value[0] = 0.0
            for _, v, c in gathered:
                value, count, at = _best(value[:, None] + v, count[:, None] + c, 0)
                came.append(at)
            ends, sizes = np.array([value[0], value[least] - EDGE]), np.array([count[0], count[least]])
            best, _, last = _best(ends, sizes, 0)
            state, out = (0, least)[int(last)], []
            for at in reversed(came):
                out.append((int(at[state]), int(state)))
                state = at[state]
            return [(*now, piece, *ways, float(best)) for (piece, _, _), ways in zip(gathered, reversed(out), strict=True)]

        def batch_of(done):
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=["contig", "region", "piece", "enter", "leave", "best"])

        for batch in batches:
            done = []
            for contig, region, piece, v, c in zip(*(batch[k].to_pylist() for k in ("contig", "region", "piece", "v", "c")), strict=True):
                if now != (contig, region):
                    done += close() if gathered else []
                    now, gathered = (contig, region), []
                gathered.append((piece, np.array(v).reshape(size, size), np.array(c).reshape(size, size)))
            yield batch_of(done)
        yield batch_of(close() if gathered else [])

    return run


def _replay(least: int):
    def run(batches):
        for rows in _rows(batches):
            masks = _pieces(rows, least).masks(np.array([r["enter"] for r in rows]), np.array([r["leave"] for r in rows]))
            starts = [int((m & ~np.concatenate([[r["enter"] > 0], m[:-1]])).sum()) if len(m) else 0 for m, r in zip(masks, rows, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r["contig"] for r in rows], pa.string()), pa.array([r["region"] for r in rows], pa.int64()), pa.array([r["first"] for r in rows], pa.int64()), pa.array([m.tolist() for m in masks], pa.list_(pa.bool_())), pa.array(starts, pa.int64()), pa.array([r["best"] for r in rows], pa.float64())], names=["contig", "region", "first", "mask", "starts", "best"])

    return run


def solve_parents(cells: DataFrame, parents: DataFrame, least: int, tile: int = TILE) -> DataFrame:
    """contig, region, bin, score, raw, chosen, and per region runs, best (value), size, all (value of keeping it whole).
    ``cells``: contig, region (first bin), bin, score, raw; ``parents``: contig, region, penalty, floor, cost, must."""
    d = small_join(cells, parents, ["contig", "region"]).withColumn("piece", F.floor((F.col("bin") - F.col("region")) / tile))
    whole = ("contig", "region", "piece", "penalty", "floor", "cost", "must")
    listed = staged(d.groupBy(*whole).agg(F.array_sort(F.collect_list(F.struct("bin", "score"))).alias("_r")).select(*whole, F.col("_r")[0]["bin"].alias("first"), F.col("_r.score").alias("score")), "pieces")
    folded = listed.mapInArrow(_fold(least), "contig string, region long, piece long, v array<double>, c array<long>")
    ways = staged(folded.repartition("contig", "region").sortWithinPartitions("contig", "region", "piece").mapInArrow(_chained(least), "contig string, region long, piece long, enter int, leave int, best double"), "ways")
    done = staged(small_join(listed, ways, ["contig", "region", "piece"]).mapInArrow(_replay(least), "contig string, region long, first long, mask array<boolean>, starts long, best double"), "masks")
    per = done.groupBy("contig", "region").agg(F.sum("starts").alias("runs"), F.first("best").alias("best"), F.sum(F.size("mask")).alias("size"), F.sum(F.size(F.filter("mask", lambda m: m))).alias("kept"))
    kept_whole = d.groupBy("contig", "region").agg((F.sum(F.col("score") - F.col("penalty") - F.col("floor")) - 2 * EDGE - F.first("cost")).alias("all"))
    per = staged(per.join(kept_whole, ["contig", "region"]), "parents")
    flat = done.select("contig", "region", F.posexplode("mask").alias("_i", "chosen"), "first").select("contig", "region", (F.col("first") + F.col("_i")).alias("bin"), "chosen")
    out = staged(small_join(cells.join(flat, ["contig", "region", "bin"]), per, ["contig", "region"]), "solved")
    freed(listed, ways, done, per)
    return out


def refine_runs(scores: DataFrame, gamma: float, penalty: float, least: int = 5, scale: float = 0.75, rounds: int = 3, jaccard: float = 0.999, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Leaves (contig, first_bin, last_bin) and the hierarchy (layer, contig, region, size, decision, children, gain).

    ``scores``: contig, bin, score, raw, selected. Parents shorter than ``least`` stay. In the first round the penalty of a bin is
    ``penalty`` and (1 - ``scale``) of the interquartile range of the parent's positive scores; later ones have none but
    subtract the parent's lower quartile. A boundary inside a parent and a run cost a quarter of ``gamma``. A contig stops
    when nothing splits or the Jaccard index of its masks reaches ``jaccard``."""
    cost = max(0.25 * gamma, 1000 * EDGE)
    chosen = staged(scores.filter("selected").select("contig", "bin", "score", "raw"), "chosen")
    bounds = staged(runs(chosen.select("contig", "bin"), tile=tile), "runs")

    def with_region(rows: DataFrame, ends: DataFrame) -> DataFrame:
        places = ends.select("contig", F.col("first_bin").alias("region"), F.explode(F.sequence("first_bin", "last_bin")).alias("bin"))
        return rows.join(places, ["contig", "bin"])

    cells = staged(with_region(chosen, bounds), "cells")
    leaves, nodes = cells.select("contig", "region", "bin"), None
    for layer in range(rounds):
        sizes = cells.groupBy("contig", "region").agg(F.count(F.lit(1)).alias("size"), F.max_by("bin", F.struct("raw", -F.col("bin"))).alias("must"))
        sizes = staged(sizes, "sizes")
        short = sizes.filter(F.col("size") < least).select(F.lit(layer).alias("layer"), "contig", "region", "size", F.lit("skipped_short").alias("decision"), F.lit(1).cast("long").alias("children"), F.lit(0.0).alias("gain"))
        open_ = staged(small_join(cells, sizes.filter(F.col("size") >= least), ["contig", "region"]).select("contig", "region", "bin", "score", "raw", "must"), "open")
        if open_.isEmpty():
            nodes = short if nodes is None else nodes.unionByName(short)
            break
        if layer:
            cut = quantiles(open_, ["contig", "region"], "score", {"floor": 0.25}).withColumn("penalty", F.lit(0.0))
        else:
            spread = quantiles(open_.filter("score > 0"), ["contig", "region"], "score", {"_lo": 0.25, "_hi": 0.75})
            cut = open_.select("contig", "region").distinct().join(spread, ["contig", "region"], "left").select("contig", "region", F.lit(0.0).alias("floor"), (F.lit(max(penalty, 0.0)) + (1 - scale) * F.coalesce(F.col("_hi") - F.col("_lo"), F.lit(0.0))).alias("penalty"))
        parents = staged(cut.join(sizes.select("contig", "region", "must"), ["contig", "region"]).withColumn("cost", F.lit(cost)), "wanted")
        solved = solve_parents(open_.drop("must"), parents, least, tile)
        gain = F.col("best") - F.col("all")
        decision = F.when((F.col("runs") >= 2) & (gain > 0), "split").when((F.col("kept") < F.col("size")) & (gain > 0), "shrink").otherwise("keep_parent")
        told = staged(solved.groupBy("contig", "region").agg(F.first("size").alias("size"), F.first("runs").alias("runs"), F.first("kept").alias("kept"), F.first("best").alias("best"), F.first("all").alias("all")).select("contig", "region", "size", "runs", "kept", decision.alias("decision"), gain.alias("gain")), "told")
        rows = told.select(F.lit(layer).alias("layer"), "contig", "region", "size", "decision", F.when(F.col("decision").isin("split", "shrink"), F.col("runs")).otherwise(1).alias("children"), "gain").unionByName(short)
        nodes = rows if nodes is None else nodes.unionByName(rows)
        moved = told.filter(F.col("decision").isin("split", "shrink"))
        lost = small_join(solved.filter(~F.col("chosen")), staged(moved.select("contig", "region"), "moved"), ["contig", "region"]).select("contig", "bin")
        left = staged(leaves.select("contig", "bin").join(lost, ["contig", "bin"], "left_anti"), "leaves")
        before = leaves.groupBy("contig").agg(F.count(F.lit(1)).alias("_before"))
        still = left.groupBy("contig").agg(F.count(F.lit(1)).alias("_after")).join(before, "contig").filter(F.col("_after") < jaccard * F.col("_before")).select("contig")
        again = small_join(solved.filter("chosen").select("contig", "region", "bin", "score", "raw"), staged(moved.select("contig", "region"), "again"), ["contig", "region"]).drop("region")
        going = staged(again.join(staged(still, "still"), "contig"), "going")
        leaves = left
        if going.isEmpty():
            break
        ends = staged(runs(going.select("contig", "bin"), tile=tile), "runs")
        cells = staged(with_region(going, ends), "cells")
    return runs(leaves.select("contig", "bin"), tile=tile), nodes
