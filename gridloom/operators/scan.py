"""Order-dependent work per (keys, tile) with exact carries: running sums and maxima, the row before, windows with halo,
affine recurrences. A contig is never one window partition, so a hot or long contig is many tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.schema import TILE


def with_tile(df: DataFrame, position: Column, tile: int = TILE) -> DataFrame:
    return df.withColumn("_tile", F.floor(position / tile))


def running(df: DataFrame, keys: list[str], order: list, value: Column, name: str, how: str = "sum", exclusive: bool = False, position: Column | None = None, tile: int = TILE) -> DataFrame:
    """Running sum or max of ``value`` in ``order`` within ``keys``; ``position`` must not decrease along ``order``."""
    agg: Callable = {"sum": F.sum, "max": F.max}[how]
    d = with_tile(df, position if position is not None else F.col(order[0]), tile).withColumn("_v", value)
    inside = Window.partitionBy(*keys, "_tile").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    before = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)  # one row per tile
    carry = d.groupBy(*keys, "_tile").agg(agg("_v").alias("_t")).select(*keys, "_tile", agg("_t").over(before).alias("_carry"))
    d = d.withColumn("_here", agg("_v").over(inside)).join(carry, [*keys, "_tile"])
    total = F.greatest("_here", "_carry") if how == "max" else F.when(F.col("_here").isNull() & F.col("_carry").isNull(), None).otherwise(F.coalesce("_here", F.lit(0)) + F.coalesce("_carry", F.lit(0)))
    return d.withColumn(name, total).drop("_tile", "_v", "_here", "_carry")


def previous(df: DataFrame, keys: list[str], order: str, columns: list[str], position: Column | None = None, tile: int = TILE) -> DataFrame:
    """``prev_<column>`` of the row before within ``keys``, also across tiles."""
    d = with_tile(df, position if position is not None else F.col(order), tile)
    inside, before = Window.partitionBy(*keys, "_tile").orderBy(order), Window.partitionBy(*keys).orderBy("_tile")
    last = d.groupBy(*keys, "_tile").agg(F.max_by(F.struct(*columns), order).alias("_last")).select(*keys, "_tile", F.lag("_last").over(before).alias("_before"))
    d = d.join(last, [*keys, "_tile"])
    first = F.row_number().over(inside) == 1
    for c in columns:
        d = d.withColumn(f"prev_{c}", F.when(first, F.col(f"_before.{c}")).otherwise(F.lag(c).over(inside)))
    return d.drop("_tile", "_before")


def halo_window(df: DataFrame, keys: list[str], position: str, left: int, right: int, outputs: dict[str, Callable[[Window], Column]], tile: int = TILE) -> DataFrame:
    """Columns over rows whose ``position`` is within [-left, +right]; each tile also sees its neighbours' rims."""
    p = F.col(position)
    d = df.withColumn("_own", F.floor(p / tile)).withColumn("_tile", F.explode(F.array_distinct(F.array(F.floor((p - right) / tile), F.floor(p / tile), F.floor((p + left) / tile)))))
    w = Window.partitionBy(*keys, "_tile").orderBy(position).rangeBetween(-left, right)
    for name, f in outputs.items():
        d = d.withColumn(name, f(w))
    return d.filter("_own = _tile").drop("_own", "_tile")


def affine(df: DataFrame, keys: list[str], position: str, a: Column, b: Column, name: str, reverse: bool = False, tile: int = TILE) -> DataFrame:
    """x[i] = a[i] * x[i-1] + b[i] along ``position`` (backwards if ``reverse``), x before the first row being 0.

    Tiles fold to one affine pair; the pairs are composed per key (one row per tile); each tile replays from its carry."""
    import pandas as pd

    d = with_tile(df.withColumn("_a", a.cast("double")).withColumn("_b", b.cast("double")), F.col(position), tile)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(position, ascending=not reverse)
        x, gain = 0.0, 1.0
        for u, v in zip(pdf["_a"].to_numpy(), pdf["_b"].to_numpy(), strict=True):
            x, gain = u * x + v, gain * u
        return pdf.iloc[:1][[*keys, "_tile"]].assign(_gain=gain, _end=x)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_tile", ascending=not reverse)
        x, starts = 0.0, []
        for gain, end in zip(pdf["_gain"].to_numpy(), pdf["_end"].to_numpy(), strict=True):
            starts.append(x)
            x = gain * x + end
        return pdf[[*keys, "_tile"]].assign(_start=starts)

    kinds, columns = {f.name: f.dataType.simpleString() for f in d.schema}, list(df.columns)
    head = ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, "_tile"])
    folded = d.select(*keys, "_tile", position, "_a", "_b").groupBy(*keys, "_tile").applyInPandas(fold, f"{head}, _gain double, _end double")
    starts = folded.groupBy(*keys).applyInPandas(chain, f"{head}, _start double")

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(position, ascending=not reverse)
        x, out = float(pdf["_start"].iloc[0]), []
        for u, v in zip(pdf["_a"].to_numpy(), pdf["_b"].to_numpy(), strict=True):
            x = u * x + v
            out.append(x)
        return pdf[columns].assign(**{name: out})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{name}` double"
    return d.join(starts, [*keys, "_tile"]).groupBy(*keys, "_tile").applyInPandas(replay, schema)


def spaced(df: DataFrame, keys: list[str], position: str, gap: int, tile: int = TILE) -> DataFrame:
    """Rows kept greedily from the first on, each at least ``gap`` positions after the last one kept (one row per position).

    A tile is folded for each of the ``gap`` ways in which it may be entered; these maps are chained per key (one row per
    tile); each tile then keeps its rows from the way it is entered."""
    import numpy as np
    import pandas as pd

    d = with_tile(df, F.col(position), tile)

    def walk(places: np.ndarray, first: int) -> list[int]:
        out, i = [], int(np.searchsorted(places, first))
        while i < len(places):
            out.append(i)
            i = int(np.searchsorted(places, places[i] + gap))
        return out

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        places, start = np.sort(pdf[position].to_numpy()), int(pdf["_tile"].iloc[0]) * tile
        ways = []
        for enter in range(gap):
            kept = walk(places, start + enter)
            ways.append(max(0, (int(places[kept[-1]]) + gap if kept else start + enter) - start - tile))
        return pdf.iloc[:1][[*keys, "_tile"]].assign(_ways=[ways])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, enter, before, out = pdf.sort_values("_tile"), 0, None, []
        for t, ways in zip(pdf["_tile"], pdf["_ways"], strict=True):
            enter = max(0, enter - (int(t) - before - 1) * tile) if before is not None else 0
            out.append(enter)
            enter, before = int(ways[enter]), int(t)
        return pdf[[*keys, "_tile"]].assign(_enter=out)

    kinds, columns = {f.name: f.dataType.simpleString() for f in d.schema}, list(df.columns)
    head = ", ".join(f"`{k}` {kinds[k]}" for k in [*keys, "_tile"])
    folded = d.select(*keys, "_tile", position).groupBy(*keys, "_tile").applyInPandas(fold, f"{head}, _ways array<long>")
    entered = folded.groupBy(*keys).applyInPandas(chain, f"{head}, _enter long")

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(position)
        return pdf.iloc[walk(pdf[position].to_numpy(), int(pdf["_tile"].iloc[0]) * tile + int(pdf["_enter"].iloc[0]))][columns]

    return d.join(entered, [*keys, "_tile"]).groupBy(*keys, "_tile").applyInPandas(keep, df.schema)


def ema(df: DataFrame, keys: list[str], position: str, value: str, alpha: float, name: str = "ema", tile: int = TILE) -> DataFrame:
    """Exponential smoothing forward, then backward; each pass starts at its first value."""
    whole, d = Window.partitionBy(*keys), with_tile(df, F.col(position), tile)  # one row per tile
    tiles = d.groupBy(*keys, "_tile").agg(F.min(position).alias("_lo"), F.max(position).alias("_hi"))
    edges = tiles.select(*keys, "_tile", F.min("_lo").over(whole).alias("_lo"), F.max("_hi").over(whole).alias("_hi"))
    d = d.join(edges, [*keys, "_tile"]).drop("_tile")
    for step, edge, rev, source in (("_fwd", "_lo", False, value), (name, "_hi", True, "_fwd")):
        start = F.col(position) == F.col(edge)
        d = affine(d, keys, position, F.when(start, 0.0).otherwise(1 - alpha), F.when(start, F.col(source)).otherwise(alpha * F.col(source)), step, rev, tile)
    return d.drop("_lo", "_hi", "_fwd")
