"""Penalised smooth background: (W + a D1'D1 + b D2'D2) g = rhs per contig, with first and second differences.

The system couples bins at most two apart, so two bins, a rim, separate what lies before from what lies behind. An energy term
belongs to the tile of its last bin. A tile is condensed to a 4 x 4 system of the rim before it and its own rim (it is cut into
blocks, whose insides are eliminated together as small dense systems); the rims are solved per contig, one row per tile; each
tile then fills in its bins from its two rims. Exact, whatever the tiles.

Constraints: the sum of g per contig is zero by one more right side, A^-1 1, and a multiplier; negative bins are penalised by
a further weight wherever the last solution was negative, until that set repeats (at most ``passes`` times per contig)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.statistics import quantiles
from gridloom.schema import TILE
from gridloom.staging import freed, small_join, staged

BLOCK = 48


def penalties(span: float, smoothness: float = 1.0) -> tuple[float, float]:
    """Weights of first and second differences for a correlation length of ``span`` bins."""
    span = max(2.0, float(span))
    return max(1.0, smoothness * span**2 / 4), max(1.0, smoothness * span**4 / 16)


class Stretch:
    """Consecutive bins of a contig as blocks whose insides are eliminated. ``opens``: nothing lies before the first bin."""

    def __init__(self, weight: np.ndarray, rhs: np.ndarray, first: float, second: float, opens: bool):
        n = len(weight)
        count = max(1, n // BLOCK)
        edges = np.arange(count + 1) * n // count
        sizes = np.diff(edges)
        wide = max(2, int(sizes.max()))
        self.sizes, self.pad, sides = sizes, wide - sizes, rhs.shape[1]
        matrix, right = np.zeros((count, wide + 2, wide + 2)), np.zeros((count, wide + 2, sides))
        block = np.repeat(np.arange(count), sizes)
        own = np.arange(n) - np.repeat(edges[:-1], sizes)  # place in the block
        at = own + 2 + self.pad[block]
        before = np.where(own >= 1, at - 1, 1)
        second_before = np.where(own >= 2, at - 2, np.where(own == 1, 1, 0))
        matrix[block, at, at] += weight
        right[block, at] = rhs
        for places, factors, penalty, start in (((before, at), (-1.0, 1.0), first, 1), ((second_before, before, at), (1.0, -2.0, 1.0), second, 2)):
            paid = np.where((np.arange(n) >= start) | (not opens), penalty, 0.0)
            for p, f in zip(places, factors, strict=True):
                for q, h in zip(places, factors, strict=True):
                    np.add.at(matrix, (block, p, q), paid * f * h)
        spare, place = np.nonzero(np.arange(wide)[None, :] < self.pad[:, None])  # bins that only fill a block up
        matrix[spare, place + 2, place + 2] = 1.0
        rims, inside = [0, 1, wide, wide + 1], np.arange(2, wide)
        self.inner = np.linalg.solve(matrix[:, inside][:, :, inside], np.concatenate([matrix[:, inside][:, :, rims], right[:, inside]], axis=2))
        cross = matrix[:, rims][:, :, inside]
        self.system = matrix[:, rims][:, :, rims] - cross @ self.inner[:, :, :4]
        self.right = right[:, rims] - cross @ self.inner[:, :, 4:]
        self.whole, self.side = np.zeros((2 * count + 2, 2 * count + 2)), np.zeros((2 * count + 2, sides))
        for k in range(count):
            self.whole[2 * k : 2 * k + 4, 2 * k : 2 * k + 4] += self.system[k]
            self.side[2 * k : 2 * k + 4] += self.right[k]
        self.ends = [0, 1, 2 * count, 2 * count + 1]
        self.middle = np.arange(2, 2 * count)

    def condensed(self) -> tuple[np.ndarray, np.ndarray]:
        """4 x 4 matrix and right sides of the rim before and the own rim."""
        if not len(self.middle):
            return self.whole, self.side
        m, e = self.middle, self.ends
        gone = np.linalg.solve(self.whole[np.ix_(m, m)], np.concatenate([self.whole[np.ix_(m, e)], self.side[m]], axis=1))
        cross = self.whole[np.ix_(e, m)]
        return self.whole[np.ix_(e, e)] - cross @ gone[:, :4], self.side[e] - cross @ gone[:, 4:]

    def filled(self, rims: np.ndarray) -> np.ndarray:
        """Values of all bins from those of the two rims (4 rows)."""
        m, e = self.middle, self.ends
        values = np.zeros_like(self.side)
        values[e] = rims
        if len(m):
            values[m] = np.linalg.solve(self.whole[np.ix_(m, m)], self.side[m] - self.whole[np.ix_(m, e)] @ rims)
        around = np.stack([values[2 * k : 2 * k + 4] for k in range(len(self.sizes))])
        inner = self.inner[:, :, 4:] - self.inner[:, :, :4] @ around
        blocks = np.concatenate([inner, around[:, 2:]], axis=1)
        return np.concatenate([b[p:] for b, p in zip(blocks, self.pad, strict=True)])


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rims of a contig, one row per tile: forward elimination, back substitution."""
    pdf = pdf.sort_values("tile")
    systems = [(np.array(s).reshape(4, 4), np.array(r).reshape(4, -1)) for s, r in zip(pdf["s"], pdf["r"], strict=True)]
    ahead = [(systems[0][0][2:, 2:], systems[0][1][2:])]
    for s, r in systems[1:]:
        a, b = ahead[-1]
        gone = np.linalg.solve(a + s[:2, :2], np.concatenate([s[:2, 2:], b + r[:2]], axis=1))
        ahead.append((s[2:, 2:] - s[2:, :2] @ gone[:, :2], r[2:] - s[2:, :2] @ gone[:, 2:]))
    rims = [np.linalg.solve(*ahead[-1])]
    for k in range(len(systems) - 1, 0, -1):
        (s, r), (a, b) = systems[k], ahead[k - 1]
        rims.append(np.linalg.solve(a + s[:2, :2], b + r[:2] - s[:2, 2:] @ rims[-1]))
    rims.append(np.zeros_like(rims[-1]))  # nothing lies before the first tile
    rims.reverse()
    return pd.DataFrame({"contig": pdf["contig"], "tile": pdf["tile"], "rims": [np.concatenate([a, b]).ravel().tolist() for a, b in zip(rims, rims[1:], strict=False)]})


def _arrays(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    return [np.asarray(v, dtype=np.float64) for v in batch[name].to_pylist()]


def _opened(batch, first: float, second: float):
    for tile, w, r in zip(batch["tile"].to_pylist(), _arrays(batch, "w"), _arrays(batch, "rhs"), strict=True):
        yield Stretch(w, np.column_stack([r, np.ones(len(r))]), first, second, tile == 0)


def _solve(tiles: DataFrame, first: float, second: float, zero_sum: bool) -> DataFrame:
    """contig, tile, g (array). ``tiles``: contig, tile, w, rhs (arrays of the tile's bins in order)."""

    def condense(batches):
        for batch in batches:
            found = [s.condensed() for s in _opened(batch, first, second)]
            yield pa.RecordBatch.from_arrays([batch["contig"], batch["tile"], pa.array([s.ravel().tolist() for s, _ in found], pa.list_(pa.float64())), pa.array([r.ravel().tolist() for _, r in found], pa.list_(pa.float64()))], names=["contig", "tile", "s", "r"])

    def fill(batches):
        for batch in batches:
            found = [s.filled(np.array(rims).reshape(4, -1)) for s, rims in zip(_opened(batch, first, second), batch["rims"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["contig"], batch["tile"], *(pa.array([f[:, i].tolist() for f in found], pa.list_(pa.float64())) for i in (0, 1))], names=["contig", "tile", "g", "unit"])

    rims = tiles.select("contig", "tile", "w", "rhs").mapInArrow(condense, "contig string, tile long, s array<double>, r array<double>").groupBy("contig").applyInPandas(_chain, "contig string, tile long, rims array<double>")
    rims = staged(rims, "rims")
    solved = small_join(tiles.select("contig", "tile", "w", "rhs"), rims, ["contig", "tile"]).mapInArrow(fill, "contig string, tile long, g array<double>, unit array<double>")
    if not zero_sum:
        return solved.drop("unit")
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    solved = staged(solved, "free")
    sums = staged(solved.groupBy("contig").agg((F.sum(add("g")) / F.sum(add("unit"))).alias("_mu")), "sums")
    return small_join(solved, sums, ["contig"]).select("contig", "tile", F.zip_with("g", "unit", lambda g, u: g - F.col("_mu") * u).alias("g"))


def tiled(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """contig, tile, w, rhs as arrays. ``cells``: contig, bin, weight, rhs, every bin from 0 present. The last tile of a contig takes
    the rest, so that none but an only one has fewer than two bins."""
    ends = staged(cells.groupBy("contig").agg(F.max("bin").alias("_end")), "ends")
    d = small_join(cells, ends, ["contig"]).withColumn("tile", F.least(F.floor(F.col("bin") / tile), F.greatest(F.floor((F.col("_end") + 1) / tile), F.lit(1)) - 1))
    rows = d.groupBy("contig", "tile").agg(F.array_sort(F.collect_list(F.struct("bin", F.col("weight").cast("double").alias("w"), F.col("rhs").cast("double").alias("r")))).alias("_rows"))
    return rows.select("contig", "tile", F.col("_rows.w").alias("w"), F.col("_rows.r").alias("rhs"))


def solve_tiles(tiles: DataFrame, first: float, second: float, zero_sum: bool = False, negative: DataFrame | None = None, passes: int = 5, start: DataFrame | None = None) -> DataFrame:
    """contig, tile, g. ``negative``: contig and the weight ``extra`` that negative bins get; ``start``: contig, tile, g whose
    negative bins are the first set. Contigs whose set repeats, or has become empty, keep their solution."""
    if negative is None:
        return staged(_solve(tiles, first, second, zero_sum), "background")
    flat = lambda g: F.transform(g, lambda v: v < 0)
    some = lambda c: F.exists(c, lambda v: v)

    def solved(with_sets: DataFrame) -> DataFrame:
        """``with_sets``: tiles, extra, neg (array). Its solution, and the set it was made with."""
        heavier = with_sets.select("contig", "tile", F.zip_with("w", "neg", lambda w, n: F.when(n, w + F.col("extra")).otherwise(w)).alias("w"), "rhs")
        return staged(_solve(heavier, first, second, zero_sum).join(with_sets.select("contig", "tile", "neg"), ["contig", "tile"]), "background")

    base = small_join(tiles, negative, ["contig"])
    if start is None:
        state = solved(base.withColumn("neg", F.transform("w", lambda _: F.lit(False))))
    else:
        state = solved(base.join(start.select("contig", "tile", flat("g").alias("neg")), ["contig", "tile"]))
    for k in range(passes):
        now = state.withColumn("_new", flat("g"))
        moves = now.groupBy("contig").agg(F.max(some("_new")).alias("_any"), F.max(F.col("_new") != F.col("neg")).alias("_moved"))
        going = staged(moves.filter("_any" if k == 0 and start is None else "_any AND _moved").select("contig"), "going")
        if going.isEmpty():
            break
        again = small_join(base, going, ["contig"]).join(now.select("contig", "tile", F.col("_new").alias("neg")), ["contig", "tile"])
        before, kept = state, small_join(state, going, ["contig"], "left_anti")
        state = staged(kept.unionByName(solved(again)), "background")
        freed(before, going)
    return state.drop("neg")


def smooth_background(cells: DataFrame, span: float, smoothness: float = 1.0, zero_sum: bool = False, negative: float | None = None, tile: int = TILE) -> DataFrame:
    """contig, bin, background of ``cells`` (contig, bin, weight, rhs). ``negative``: the weight of negative bins, in medians of the
    contig's positive weights. Contigs without a positive weight get 0."""
    first, second = penalties(span, smoothness)
    held = cells.groupBy("contig").agg(F.max("weight").alias("_most"))
    tiles = staged(tiled(cells, tile), "tiles")
    held = staged(held, "held")
    live = small_join(tiles, staged(held.filter("_most > 0").select("contig"), "live"), ["contig"])
    extra = None
    if negative:
        middle = quantiles(cells.filter("weight > 0"), ["contig"], "weight", {"extra": 0.5})
        extra = staged(middle.select("contig", (F.col("extra") * negative).alias("extra")), "extra")
    g = solve_tiles(live, first, second, zero_sum, extra)
    out = tiles.join(g, ["contig", "tile"], "left").select("contig", F.posexplode(F.coalesce("g", F.transform("w", lambda _: F.lit(0.0)))).alias("_i", "background"), "tile")
    return out.select("contig", (F.col("tile") * tile + F.col("_i")).alias("bin"), "background")
