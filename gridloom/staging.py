"""Generations of intermediate tables in the shared folder, for operators that iterate: each pass reads one table and writes
the next, so plans stay small, lost executors cost their own tasks only, and older generations are deleted."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only when it has been counted and has at most this many rows.
BROADCAST_ROWS = 50_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, in local mode only, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read back."""
    path = f"{shared_folder(df.sparkSession)}/gridloom-{uuid.uuid4().hex}/{label}"
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._staged = path
    return table


def freed(*tables: DataFrame | None) -> None:
    """Delete staged tables that nothing reads any more, through the file system that Spark itself uses."""
    for table in tables:
        path = getattr(table, "_staged", None)
        if path:
            jvm = table.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def small_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join with a staged table of few columns: broadcast if its counted rows allow it, else shuffled."""
    return big.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, keys, how)
