"""Readers of the text layouts. Every reader filters header lines and malformed rows by expressions; no inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fields(spark: SparkSession, path: str, least: int, sep: str = r"\s+") -> DataFrame:
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^(#|track\b|browser\b)") & (F.trim("value") != ""))
    return lines.select(F.split(F.trim("value"), sep).alias("f")).filter(F.size("f") >= least)


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """bedGraph: contig, start, end, value; rows without 4 fields or with end <= start go."""
    f = F.col("f")
    return _fields(spark, path, 4).select(f[0].alias("contig"), f[1].try_cast("long").alias("start"), f[2].try_cast("long").alias("end"), f[3].try_cast("double").alias("value")).filter("end > start AND value IS NOT NULL")


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    """contig, start, end, barcode and a count that is at least 1."""
    f = F.col("f")
    count = F.greatest(F.coalesce(F.try_element_at(f, F.lit(5)).try_cast("int"), F.lit(1)), F.lit(1))
    return _fields(spark, path, 4, "\t").select(f[0].alias("contig"), f[1].try_cast("long").alias("start"), f[2].try_cast("long").alias("end"), f[3].alias("barcode"), count.alias("count")).filter("end > start")


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """BED: the first three columns; # lines and empty regions go."""
    f = F.col("f")
    return _fields(spark, path, 3).select(f[0].alias("contig"), f[1].try_cast("long").alias("start"), f[2].try_cast("long").alias("end")).filter("end > start")


def read_repeats(spark: SparkSession, path: str) -> DataFrame:
    """17-column repeat annotation: contig, start and end are columns 6 to 8."""
    f = F.col("f")
    return _fields(spark, path, 8, "\t").select(f[5].alias("contig"), f[6].try_cast("long").alias("start"), f[7].try_cast("long").alias("end")).filter("end > start")


def read_contigs(spark: SparkSession, path: str, name: str = r"^chr[A-Za-z0-9]+$", exclude: tuple[str, ...] = ()) -> DataFrame:
    """contig, size, ord (rank of the name); names that do not match or are excluded go; a repeated name is an error."""
    f = F.col("f")
    rows = _fields(spark, path, 2).select(f[0].alias("contig"), f[1].try_cast("long").alias("size")).filter(F.col("contig").rlike(name) & ~F.col("contig").isin(list(exclude)) & (F.col("size") > 0))
    per = rows.groupBy("contig").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n"))
    checked = per.withColumn("size", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("repeated contig "), "contig")).cast("long")).otherwise(F.col("size")))
    from pyspark.sql import Window

    return checked.select("contig", "size", F.row_number().over(Window.orderBy("contig")).alias("ord"))


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path, 1, r"[,\s]+").select(F.col("f")[0].alias("barcode")).distinct()


def read_barcode_groups(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path, 2, r"[,\s]+").select(F.col("f")[0].alias("barcode"), F.col("f")[1].alias("grp")).distinct()


def source_kind(path: Column) -> Column:
    """BAM, FRAGMENTS or BEDGRAPH by extension; CRAM is an error."""
    low = F.lower(path)
    return (
        F.when(low.endswith(".cram"), F.raise_error(F.lit("CRAM sources are not supported")).cast("string"))
        .when(low.endswith(".bam"), "BAM")
        .when(low.rlike(r"(fragments|frags).*\.tsv(\.gz)?$|\.tsv(\.gz)?$"), "FRAGMENTS")
        .when(low.rlike(r"\.(bedgraph|bg|bdg)(\.gz)?$"), "BEDGRAPH")
    )
