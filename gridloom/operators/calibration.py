"""Calibrated uncertainty by deleting blocks: how far states move when some samples of a block are left out, against how far they should.

Blocks of bins are dealt to folds in the order of their hashes, and in each block some of the samples, not all, are deleted. All
folds are refitted in one job, a fold's contigs being contigs of their own; the differences to the full fit over their standard
errors give the factors of segments, contigs and the genome, and the standard error of a bin never falls below the model's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import consensus
from gridloom.operators.models import delta_variance, uniform
from gridloom.operators.segment_factors import segment_factors
from gridloom.schema import TILE
from gridloom.staging import freed, small_join, staged

_SEP = "\x1f"


def fold_spec(cells: DataFrame, block: int, folds: int, seed: int) -> DataFrame:
    """contig, block, fold, sample for every deleted sample. Blocks of a contig are ranked by hash and dealt in turn; a sample is
    deleted where its hash is below one half, the lowest always, the highest never. One row per block and sample is ordered."""
    b = cells.select("contig", F.floor(F.col("bin") / block).alias("block"), "sample").distinct()
    ranked = b.select("contig", "block").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("contig").orderBy(uniform(seed, "contig", "block"), "block")))
    one = ranked.select("contig", "block", ((F.col("_r") - 1) % folds).alias("fold"))
    of_block = Window.partitionBy("contig", "block")
    d = b.withColumn("_u", uniform(seed + 1, "contig", "block", "sample")).withColumn("_k", F.row_number().over(of_block.orderBy("_u", "sample"))).withColumn("_n", F.count(F.lit(1)).over(of_block))
    chosen = d.filter((F.col("_k") < F.col("_n")) & ((F.col("_k") == 1) | (F.col("_u") < 0.5)))
    return chosen.join(one, ["contig", "block"]).select("contig", "block", "fold", "sample")


def _levels(state: DataFrame, tile: int) -> DataFrame:
    rows = state.select("contig", "tile", F.posexplode(F.arrays_zip("level", "var")).alias("_i", "_c"))
    return rows.select("contig", (F.col("tile") * tile + F.col("_i")).alias("bin"), F.col("_c.level").alias("level"), F.col("_c.var").alias("var"))


def deleted_fits(cells: DataFrame, spec: DataFrame, block: int, model: consensus.Model, passes: int, rtol: float, tile: int = TILE) -> DataFrame:
    """contig, fold, bin, level, var of the fit without the fold's deleted cells, for all folds at once. Every bin keeps a row, be it
    without an observation."""
    folds = staged(spec.select("contig", "fold").distinct(), "folds")
    d = small_join(cells.withColumn("block", F.floor(F.col("bin") / block)), folds, ["contig"])
    gone = spec.withColumn("_gone", F.lit(True))
    d = d.join(gone, ["contig", "block", "fold", "sample"], "left")
    x = F.when(F.col("_gone").isNull(), F.col("x")).otherwise(F.lit(float("nan")))
    named = d.select(F.concat_ws(_SEP, "contig", F.col("fold").cast("string")).alias("contig"), "bin", "sample", x.alias("x"), "v")
    state, _ = consensus.robust_fit(staged(consensus.packed(named, tile), "state"), model, passes, rtol)
    part = lambda i: F.split("contig", _SEP)[i]
    return _levels(state, tile).select(part(0).alias("contig"), part(1).cast("int").alias("fold"), "bin", "level", "var")


def calibrate(cells: DataFrame, model: consensus.Model, block: int, segments: int = 4, folds: int = 5, q: float = 0.9, z: float = 1.645, passes: int = 20, rtol: float = 1e-4, replicates: int = 32, seed: int = 5, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Calibrated states (contig, bin, level, se, calibrated) and the factors (contig, segment, ...). ``cells``: contig, bin, sample, x, v.
    A contig has ``segments`` segments of nearly equal length. A row of the factors is a bin of a held-out block."""
    spec = staged(fold_spec(cells, block, folds, seed), "spec")
    full, _ = consensus.robust_fit(staged(consensus.packed(cells, tile), "state"), model, passes, rtol)
    full = staged(_levels(full, tile), "full")
    without = staged(deleted_fits(cells, spec, block, model, passes, rtol, tile), "deleted")
    weight = 1 / (F.col("v") + model.pad)
    held = cells.withColumn("block", F.floor(F.col("bin") / block)).join(spec.withColumn("_gone", F.lit(True)), ["contig", "block", "sample"], "left")
    share = held.groupBy("contig", "bin").agg((F.sum(F.when(F.col("_gone"), weight).otherwise(0.0)) / F.sum(weight)).alias("_held"))
    places = spec.select("contig", "block", "fold").distinct()
    ends = staged(full.groupBy("contig").agg((F.max("bin") + 1).alias("_n")), "ends")
    with_segment = lambda d: small_join(d, ends, ["contig"]).withColumn("segment", F.floor(F.col("bin") * segments / F.col("_n")))
    both = full.withColumn("block", F.floor(F.col("bin") / block)).join(places, ["contig", "block"]).join(without.withColumnsRenamed({"level": "_level", "var": "_var"}), ["contig", "fold", "bin"]).join(share, ["contig", "bin"])
    variance, source = delta_variance(F.col("var"), F.col("_var"), F.col("_held"), 1e-9, 0.02, 0.98)
    rows = with_segment(both).withColumn("_d", variance).withColumn("_s", source).filter((F.col("_s") > 0) & (F.col("_d") > 0))
    rows = rows.select("contig", "segment", (F.abs(F.col("level") - F.col("_level")) / F.sqrt("_d")).alias("ratio"), F.lit(1.0).alias("weight"), F.concat_ws(":", "contig", F.col("fold").cast("string"), F.col("block").cast("string")).alias("group"))
    factors = staged(segment_factors(staged(rows, "rows"), q, z, replicates, seed), "factors")
    out = with_segment(full).join(F.broadcast(factors.select("contig", "segment", "factor")) if factors.count() <= 50_000 else factors.select("contig", "segment", "factor"), ["contig", "segment"], "left")
    se = F.sqrt("var")
    calibrated = F.greatest(F.sqrt(F.coalesce("factor", F.lit(1.0)) * F.col("var")), se)
    freed(without)
    return out.select("contig", "bin", "level", se.alias("se"), calibrated.alias("calibrated")), factors
