"""Capturing memories from transcripts as they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_spark.functions import text as tx
from recall_spark.sources import files as fl

LINES = "session_id string, line_no long, line string, at timestamp"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """New JSON files of lines, as they arrive."""
    return spark.readStream.schema(LINES).json(path)


def captured(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Turns without secrets and noise, each text once a session within the watermark."""
    turns = fl.transcript(stream.withWatermark("at", late), "at")
    out = turns.withColumn("text", tx.sanitised(tx.compressed(F.col("text")))).where("text <> ''").withColumn("checksum", tx.checksum(F.col("text")))
    return out.dropDuplicatesWithinWatermark(["session_id", "checksum"])


def activity(stream: DataFrame, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Turns of a role in each window of time."""
    turns = fl.transcript(stream.withWatermark("at", late), "at")
    return turns.groupBy(F.window("at", every), "role").agg(F.count("*").alias("n"))


def stored(turns: DataFrame, path: str, checkpoint: str):
    """Write captured turns as Parquet; the checkpoint makes a restart continue where it stopped."""
    return turns.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
