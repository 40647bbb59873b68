"""Fragment length of single-end reads: the lag at which reverse 5' ends follow forward ones, in dense blocks, median over blocks.

Chunks are ranked by the rolling median of their read counts; blocks lie around the chunks of the densest windows. Reads are counted
per position and strand before anything is grouped, so a block's group holds at most two counts per base, whatever the depth."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.scan import halo_window
from gridloom.operators.statistics import quantiles
from gridloom.staging import staged


def rolling_median(chunks: DataFrame, width: int) -> DataFrame:
    """contig, chunk, n, level: the median of ``width`` (odd) chunks around each; beyond the ends the end chunk repeats. Every chunk from 0."""
    half = width // 2
    ends = chunks.groupBy("contig").agg(F.max("chunk").alias("_end"), F.min_by("n", "chunk").alias("_a"), F.max_by("n", "chunk").alias("_b"))
    d = halo_window(chunks, ["contig"], "chunk", half, half, {"_near": lambda w: F.collect_list("n").over(w)}).join(ends, "contig")
    before, after = F.greatest(half - F.col("chunk"), F.lit(0)).cast("int"), F.greatest(F.col("chunk") + half - F.col("_end"), F.lit(0)).cast("int")
    whole = F.array_sort(F.concat("_near", F.array_repeat("_a", before), F.array_repeat("_b", after)))
    return d.select("contig", "chunk", "n", F.element_at(whole, half + 1).alias("level"))


def best_lags(reads: DataFrame, sizes: DataFrame, low: int, high: int, step: int = 5, block: int = 5000, chunk: int = 250, top: int = 1000, least: int = 10) -> DataFrame:
    """contig, centre, lag, score for each block with at least ``least`` reads of either strand. ``reads``: contig, start, end, reverse;
    ``sizes``: contig, size. The lag from ``low`` to ``high`` with the largest covariance of forward and reverse 5' ends."""
    high = min(high, block - 1)
    width = max(1, block // chunk) | 1
    counted = reads.groupBy("contig", F.floor(F.col("start") / chunk).alias("chunk")).agg(F.count(F.lit(1)).alias("n"))
    grid = sizes.filter(F.col("size") >= block).select("contig", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor(F.col("size") / chunk), F.lit(1)) - 1)).alias("chunk"))
    chunks = grid.join(counted, ["contig", "chunk"], "left").select("contig", "chunk", F.coalesce("n", F.lit(0)).alias("n"))
    ranked = rolling_median(staged(chunks, "chunks"), width).withColumn("_r", F.row_number().over(Window.partitionBy("contig").orderBy(F.desc("level"), "chunk"))).filter(F.col("_r") <= top)
    near = grid.groupBy("contig").agg(F.first("size").alias("size"), (F.max("chunk") + 1).alias("_n"))
    first = F.least(F.greatest(F.col("chunk") - width // 2, F.lit(0)), F.greatest(F.col("_n") - width, F.lit(0)))
    centres = ranked.join(near, "contig").select("contig", "size", F.explode(F.sequence(first, F.least(first + width, F.col("_n")) - 1)).alias("centre")).distinct()
    begin = F.greatest(F.col("centre") * chunk + chunk // 2 - block // 2, F.lit(0))
    begin = F.least(begin, F.col("size") - block)
    blocks = staged(centres.select("contig", "centre", begin.alias("from")).withColumn("_c", F.explode(F.sequence(F.floor(F.col("from") / chunk), F.floor((F.col("from") + block - 1) / chunk)))), "blocks")
    ends = reads.filter(F.col("end") > F.col("start")).groupBy("contig", "start", "end", "reverse").agg(F.count(F.lit(1)).alias("k"))
    inside = ends.withColumn("_c", F.floor(F.col("start") / chunk)).join(blocks, ["contig", "_c"]).filter((F.col("start") >= F.col("from")) & (F.col("end") <= F.col("from") + block))
    at = F.when(F.col("reverse"), F.col("end") - 1).otherwise(F.col("start")) - F.col("from")
    per = inside.groupBy("contig", "centre", "reverse", at.alias("at")).agg(F.sum("k").alias("k"))
    listed = per.groupBy("contig", "centre").agg(F.collect_list(F.struct("reverse", "at", "k")).alias("ends"))

    def run(batches):
        size = 1 << (2 * block - 1).bit_length()
        lags = np.arange(low, high + 1, step)
        for batch in batches:
            out = []
            for contig, centre, found in zip(*(batch[c].to_pylist() for c in ("contig", "centre", "ends")), strict=True):
                sides = np.zeros((2, block))
                for e in found:
                    sides[int(e["reverse"]), e["at"]] += e["k"]
                if len(lags) and sides.sum(1).min() >= least:
                    sides -= sides.mean(1, keepdims=True)
                    score = np.fft.irfft(np.conj(np.fft.rfft(sides[0], size)) * np.fft.rfft(sides[1], size), size)[lags]
                    best = int(np.round(score, 9).argmax())
                    out.append((contig, centre, int(lags[best]), float(score[best])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64(), pa.float64()))], names=["contig", "centre", "lag", "score"])

    return listed.mapInArrow(run, "contig string, centre long, lag long, score double").filter("lag > 0 AND score <> 0")


def single_end_length(reads: DataFrame, sizes: DataFrame, low: int, high: int, fallback: int = 147, **options) -> int:
    """Median of the blocks' lags; ``fallback`` if there is no block."""
    middle = quantiles(best_lags(reads, sizes, low, high, **options), [], "lag", {"m": 0.5}).first()
    return int(middle["m"]) if middle and middle["m"] is not None else fallback
