"""Do replicates differ in their noise? Permutations of block log standard deviations within blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.models import uniform
from gridloom.staging import staged


def complete_blocks(blocks: DataFrame, samples: int) -> DataFrame:
    """contig, block, sample, e: half the log ratio of variance and prior, less the block's mean, of blocks that have all samples."""
    ok = blocks.filter((F.col("variance") > 0) & (F.col("prior") > 0)).select("contig", "block", "sample", (0.5 * (F.log("variance") - F.log("prior"))).alias("_s"))
    whole = ok.groupBy("contig", "block").agg(F.count(F.lit(1)).alias("_n"), F.avg("_s").alias("_mu")).filter(F.col("_n") == samples)
    return ok.join(whole, ["contig", "block"]).select("contig", "block", "sample", (F.col("_s") - F.col("_mu")).alias("e"))


def permutation_test(blocks: DataFrame, draws: int = 200, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Effects (sample, effect: mean of e) and one row: blocks, statistic (largest absolute effect), exceeding draws, p. A draw gives each
    block's values to its samples in the order of their hashes."""
    samples = blocks.filter((F.col("variance") > 0) & (F.col("prior") > 0)).select("sample").distinct().count()
    e = staged(complete_blocks(blocks, samples), "effects")
    effects = e.groupBy("sample").agg(F.avg("e").alias("effect"))
    seen = staged(effects.agg(F.max(F.abs("effect")).alias("statistic")).join(F.broadcast(e.select("contig", "block").distinct().agg(F.count(F.lit(1)).alias("blocks"))), F.lit(True)), "seen")
    drawn = e.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_u", uniform(seed, "draw", "contig", "block", "sample"))
    place = F.row_number().over(Window.partitionBy("draw", "contig", "block").orderBy("_u"))  # as many rows as samples
    stats = drawn.withColumn("_r", place).groupBy("draw", "_r").agg(F.avg("e").alias("m")).groupBy("draw").agg(F.max(F.abs("m")).alias("m"))
    both = stats.join(F.broadcast(seen), F.lit(True))  # one row
    over = both.agg(F.first("blocks").alias("blocks"), F.first("statistic").alias("statistic"), F.count_if(F.col("m") >= F.col("statistic") - 1e-12).alias("exceeding"), F.count(F.lit(1)).alias("_d"))
    return effects, over.select("blocks", "statistic", "exceeding", ((F.col("exceeding") + 1) / (F.col("_d") + 1)).alias("p"))
