"""Interval operators: merge, runs, range joins by bucket, masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.scan import previous, running
from gridloom.operators.statistics import cumulative


def merge_intervals(regions: DataFrame, tile: int = 1 << 20) -> DataFrame:
    """Union of overlapping and touching intervals per contig.

    Of the intervals with one start only the longest can open or extend an island, so a tile holds no more rows than it has
    positions, however many intervals pile up. Those that end before they start, or nowhere, stand alone unless covered."""
    alone = F.coalesce(F.col("end") < F.col("start"), F.lit(False))
    d = regions.groupBy("contig", "start", F.when(alone, F.col("end")).alias("_back")).agg(F.max("end").alias("end"), F.count(F.lit(1)).alias("_n"))
    d = running(d, ["contig"], ["start", "end"], F.col("end"), "_reach", "max", exclusive=True, position=F.col("start"), tile=tile)
    copies = F.when(F.col("end") >= F.col("start"), F.lit(1)).otherwise(F.col("_n"))
    d = d.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("start") > F.col("_reach")), copies).otherwise(0))
    d = running(d, ["contig"], ["start", "end"], F.col("_new"), "_island", position=F.col("start"), tile=tile)
    d = d.groupBy("contig", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("_new").alias("_new"))
    return d.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_new"))).select("contig", "start", "end")


def runs(bins: DataFrame, gap: int = 0, extra: tuple = (), tile: int = 4096) -> DataFrame:
    """Runs of bins (contig, bin) that are at most ``gap`` missing bins apart: contig, first_bin, last_bin and aggregates."""
    d = previous(bins, ["contig"], "bin", ["bin"], tile=tile)
    d = d.withColumn("_new", (F.col("prev_bin").isNull() | (F.col("bin") - F.col("prev_bin") > gap + 1)).cast("int"))
    d = running(d, ["contig"], ["bin"], F.col("_new"), "_island", tile=tile)
    return d.groupBy("contig", "_island").agg(F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), *extra).drop("_island")


def overlap_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """contig, start, end (each distinct one of ``left``) and ``n``: how many intervals of ``right`` overlap it: those that start before
    its end less those that end by its start. Two running counts, so a pile-up costs no more than its rows."""
    spans = left.select("contig", "start", "end").distinct()

    def below(points: DataFrame, at: str, own: bool) -> DataFrame:
        """contig, ``at``, number of points below each value of ``at``, its own included or not."""
        asked = spans.select("contig", F.col(at).alias("_v"), F.lit(0).alias("_k"))
        per = asked.unionByName(points).groupBy("contig", "_v").agg(F.sum("_k").alias("_k"))
        run = cumulative(per, ["contig"], "_v", {"_c": "_k"})
        return run.select("contig", F.col("_v").alias(at), (F.col("_c") if own else F.col("_c") - F.col("_k")).alias(f"_{at}"))

    point = lambda c: right.select("contig", F.col(c).alias("_v"), F.lit(1).alias("_k"))
    out = spans.join(below(point("start"), "end", False), ["contig", "end"]).join(below(point("end"), "start", True), ["contig", "start"])
    return out.select("contig", "start", "end", (F.col("_end") - F.col("_start")).alias("n"))


def maximal_intervals(regions: DataFrame, tile: int = 1 << 20) -> DataFrame:
    """The intervals that lie in no other one: starts and ends both increase."""
    d = regions.groupBy("contig", "start").agg(F.max("end").alias("end"))
    d = running(d, ["contig"], ["start"], F.col("end"), "_reach", "max", exclusive=True, tile=tile)
    return d.filter(F.col("_reach").isNull() | (F.col("end") > F.col("_reach"))).drop("_reach")


def range_join(left: DataFrame, right: DataFrame, bucket: int, how: str = "inner") -> DataFrame:
    """Pairs of overlapping intervals of a contig (``start``/``end`` against ``r_start``/``r_end``); ``left_semi`` and
    ``left_anti`` keep left rows and make no pairs. For pairs both sides are dealt to coarse buckets; a pair is reported in
    the bucket of its overlap's start only, so no duplicates arise."""
    if how != "inner":
        return left.join(overlap_counts(left, right).filter("n > 0").drop("n"), ["contig", "start", "end"], how).select(*left.columns)
    deal = lambda s, e: F.sequence(F.floor(F.col(s) / bucket), F.floor((F.col(e) - 1) / bucket))
    r = right.select("contig", F.col("start").alias("r_start"), F.col("end").alias("r_end"), *(c for c in right.columns if c not in ("contig", "start", "end"))).withColumn("_b", F.explode(deal("r_start", "r_end")))
    hit = (F.col("start") < F.col("r_end")) & (F.col("end") > F.col("r_start"))
    dealt = left.withColumn("_b", F.explode(deal("start", "end")))
    return dealt.join(r, ["contig", "_b"]).filter(hit & (F.floor(F.greatest("start", "r_start") / bucket) == F.col("_b"))).drop("_b")


def masked_bins(bins: DataFrame, regions: DataFrame, width: int) -> DataFrame:
    """``bins`` (contig, bin) with ``masked``: some region overlaps the bin."""
    touched = regions.select("contig", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("bin")).distinct().withColumn("masked", F.lit(True))
    return bins.join(touched, ["contig", "bin"], "left").withColumn("masked", F.coalesce("masked", F.lit(False)))


def covered_fraction(regions: DataFrame, contigs: DataFrame, width: int) -> DataFrame:
    """contig, bin, fraction of the bin (a short last bin counts its own length) that regions cover."""
    m = merge_intervals(regions).join(F.broadcast(contigs.select("contig", "size")), "contig").withColumn("end", F.least("end", "size")).filter("end > start")
    m = m.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    part = F.least("end", (F.col("bin") + 1) * width) - F.greatest("start", F.col("bin") * width)
    return m.groupBy("contig", "bin").agg((F.sum(part) / F.min(F.least(F.col("size"), (F.col("bin") + 1) * width) - F.col("bin") * width)).alias("fraction"))
