"""Interval tables as views over the star-schema tables, as DataFrames and as the same SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 10
HOURS = 6

FRAGMENTS = """fragments AS (SELECT l_returnflag || l_linestatus AS contig, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) + 2000 AS s,
  CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) + 2000 + CAST(l_quantity AS BIGINT) AS e, CAST(l_partkey AS VARCHAR) AS barcode, l_linenumber AS c, 's' || (l_suppkey % 4) AS sample, l_suppkey % 8 >= 4 AS control,
  CASE WHEN l_linestatus = 'F' THEN 16 ELSE 0 END AS flag, CAST(round(l_discount * 100) AS INTEGER) * 6 AS mapq FROM lineitem)"""
REGIONS = """regions AS (SELECT ['AF', 'AO', 'NF', 'NO', 'RF', 'RO'][CAST((o_orderkey // 50) % 6 AS INTEGER) + 1] AS contig, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) + 2000 AS s,
  CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) + 2000 + 1 + o_custkey % 20 AS e FROM orders)"""
EVENTS = """ev AS (SELECT 'c' || (user_id % 3) AS contig, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600) AS BIGINT) AS s, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600) AS BIGINT) + 1 + user_id % 5 AS e, value, event_type AS sample FROM events)"""
CONTIGS = "contigs AS (SELECT contig, max(e) AS size FROM fragments GROUP BY contig)"
GRID = f"grid AS (SELECT contig, sample, unnest(range(0, (size - 1) // {WIDTH} + 1)) AS bin FROM contigs, (SELECT DISTINCT sample FROM fragments))"
COUNTS = f"""hits AS (SELECT contig, sample, c, s, e, unnest(range(s // {WIDTH}, (e - 1) // {WIDTH} + 1)) AS bin FROM fragments),
counts AS (SELECT contig, sample, bin, sum(c * (least(e, (bin + 1) * {WIDTH}) - greatest(s, bin * {WIDTH})) / CAST(e - s AS DOUBLE)) AS v FROM hits GROUP BY ALL)"""
TRACKS = f"{FRAGMENTS},\n{CONTIGS},\n{GRID},\n{COUNTS},\ntracks AS (SELECT g.contig, g.sample, g.bin, log2(coalesce(v, 0) + 1) AS x, coalesce(v, 0) AS raw FROM grid g LEFT JOIN counts USING (contig, sample, bin))"
MEAN = "mean_track AS (SELECT contig, bin, avg(x) AS x FROM tracks GROUP BY ALL)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _days(column: str):
    return (F.datediff(F.col(column), F.lit("1995-01-01").cast("date")) + 2000).cast("long")


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _table(spark, sf_dir, "lineitem").withColumn("start", _days("l_shipdate"))
    return f.select(F.concat("l_returnflag", "l_linestatus").alias("contig"), "start", (F.col("start") + F.col("l_quantity").cast("long")).alias("end"), F.col("l_partkey").cast("string").alias("barcode"), F.col("l_linenumber").alias("count"), F.concat(F.lit("s"), F.col("l_suppkey") % 4).alias("sample"), ((F.col("l_suppkey") % 8) >= 4).alias("control"), F.when(F.col("l_linestatus") == "F", 16).otherwise(0).alias("flag"), (F.round(F.col("l_discount") * 100).cast("int") * 6).alias("mapq"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").withColumn("start", _days("o_orderdate"))
    names = F.array(*(F.lit(x) for x in ("AF", "AO", "NF", "NO", "RF", "RO")))
    return o.select(F.element_at(names, (F.floor(F.col("o_orderkey") / 50) % 6 + 1).cast("int")).alias("contig"), "start", (F.col("start") + 1 + F.col("o_custkey") % 20).alias("end"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    hour = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3600)
    return e.select(F.concat(F.lit("c"), F.col("user_id") % 3).alias("contig"), hour.alias("start"), (hour + 1 + F.col("user_id") % 5).alias("end"), "value", F.col("event_type").alias("sample"))


def allow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").filter("p_size <= 25").select(F.col("p_partkey").cast("string").alias("barcode"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("barcode"), F.col("p_brand").alias("grp"))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragments(spark, sf_dir).groupBy("contig").agg(F.max("end").alias("size"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.functions.expr import transform_count
    from gridloom.operators.counting import count_bins, dense_grid

    f = fragments(spark, sf_dir)
    grid = dense_grid(count_bins(f, WIDTH), contigs(spark, sf_dir), f, WIDTH)
    return grid.select("contig", "sample", "bin", transform_count(F.col("value")).alias("x"), F.col("value").alias("raw"))


def mean_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).groupBy("contig", "bin").agg(F.avg("x").alias("x"))
