"""Writers and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.scan import previous


def track_lines(track: DataFrame, contigs: DataFrame) -> DataFrame:
    """bedGraph lines (contig, start, end, value with 4 decimals) in contig order, range-partitioned for a parallel write."""
    rows = track.join(F.broadcast(contigs.select("contig", "ord")), "contig")  # one row per contig
    rows = rows.repartitionByRange("ord", "start").sortWithinPartitions("ord", "start")
    return rows.select("contig", "start", "end", F.format_string("%.4f", "value").alias("value"))


def write_track(track: DataFrame, contigs: DataFrame, path: str) -> None:
    track_lines(track, contigs).write.mode("overwrite").option("sep", "\t").csv(path)


def track_violations(track: DataFrame, contigs: DataFrame, keys: tuple[str, ...] = ("contig",)) -> DataFrame:
    """Rows that break a rule, with the rule: contig unknown, bounds, beyond the contig, overlap with the row before (in order
    of start and end). ``keys`` tell tracks and contigs apart."""
    order = track.withColumn("_order", F.struct("start", "end"))
    rows = previous(order, list(keys), "_order", ["end"], position=F.col("start"))
    rows = rows.join(contigs.select("contig", "size"), "contig", "left")
    rule = F.when(F.col("size").isNull(), "unknown contig").when((F.col("start") < 0) | (F.col("end") <= F.col("start")), "bounds").when(F.col("end") > F.col("size"), "beyond contig").when(F.col("start") < F.col("prev_end"), "overlap")
    return rows.withColumn("rule", rule).filter("rule IS NOT NULL").select(*keys, "start", "end", "rule")


def narrow_peak_lines(peaks: DataFrame) -> DataFrame:
    """Ten-column peak rows as text fields; missing p and q are -1."""
    minus = lambda c: F.when(F.col(c).isNull() | (F.col(c) <= 0), F.lit(-1.0)).otherwise(-F.log10(c))
    return peaks.select("contig", "start", "end", "name", "score", F.lit(".").alias("strand"), F.round("signal", 4).alias("signal"), F.round(minus("p"), 4).alias("p"), F.round(minus("q"), 4).alias("q"), "summit_offset")


def summary_rows(rows: DataFrame, *aggregates) -> DataFrame:
    """One row per contig and one for all (contig null)."""
    return rows.rollup("contig").agg(*aggregates)
