"""Helpers shared by the training-data operators: shared workspace tables, bounded broadcasts, text patterns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: A lookup table is broadcast only when it has been counted and has at most this many rows.
BROADCAST_ROWS = 50_000

#: A key is heavy when it holds more than 1/HEAVY_SHARE of all rows; so there are fewer than HEAVY_SHARE heavy keys.
HEAVY_SHARE = 2_000


def workspace(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{workspace(spark)}/gridloom-{uuid.uuid4().hex}/{label}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later jobs survive lost executors and skip the work."""
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._staged = path
    return table


def store_of(uri: str):
    """The pyarrow file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def freed(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more. Where pyarrow cannot reach the store, they stay."""
    import pyarrow as pa

    for table in tables:
        path = getattr(table, "_staged", None)
        if path and path.startswith(f"{workspace(table.sparkSession)}/gridloom-"):
            try:
                store, where = store_of(path)
                store.delete_dir(where)
            except (pa.ArrowInvalid, OSError):
                continue


def lookup_join(big: DataFrame, small: DataFrame, key: str, how: str = "left", salts: int = 32) -> DataFrame:
    """Join ``small`` (one row per ``key``, already staged; null keys match null) to ``big``.

    Broadcast when the counted size is at most BROADCAST_ROWS; else a salted shuffle join, so that a hot key is spread.
    """
    small = small.withColumnRenamed(key, "_k")
    same = big[key].eqNullSafe(F.col("_k"))
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), same, how).drop("_k")
    salted = big.withColumn("_s", F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    spread = small.withColumn("_s2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread, (salted[key].eqNullSafe(spread["_k"])) & (salted["_s"] == spread["_s2"]), how).drop("_k", "_s", "_s2")


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast; a missing one is null. Extra columns, whatever their names, are left behind."""
    have = set(df.columns)
    return df.select(*(df[f"`{c}`"].cast(kind).alias(c) if c in have else F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()))
