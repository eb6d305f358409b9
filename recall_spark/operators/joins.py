"""Joins with sides of a checked size, and the folder for tables in between."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side with at most so many rows of a few short columns (about 100 MB) may be broadcast; above it the join shuffles.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; it is counted, unless a bound is known beforehand."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= most else df


_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which spark.checkpoint.dir names; unset, a temporary one on one machine only."""
    global _own_dir
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    _own_dir = _own_dir or tempfile.mkdtemp(prefix="recall-")
    return f"file://{_own_dir}"
