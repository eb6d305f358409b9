"""Edges of memories: what is reached from where, in how many steps, and what hangs together."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall_spark.operators.joins import shared_dir, small


class Rounds:
    """Tables that rounds write and read back, in the folder that driver and executors share: plans stay short, and lost
    executors don't matter. Old ones are deleted as rounds go on."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.folder, self.number = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, file_rows: int = 0) -> DataFrame:
        """df from a table of its own; file_rows: rows of a file at most, where they are long (a reader holds a file's)."""
        self.number += 1
        df.write.option("maxRecordsPerFile", file_rows).parquet(f"{self.folder}/{self.number}")
        out = self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.number}")
        out._number = self.number
        return out

    def read(self, numbers: list[int], like: DataFrame) -> DataFrame:
        """Tables that were kept, as one scan."""
        return self.spark.read.schema(like.schema).parquet(*(f"{self.folder}/{n}" for n in numbers))

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table._number}")
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def closure(edges: DataFrame, most: int | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """from_id, to_id, depth: all that is reached over edges (from_id, to_id), by the least number of steps, up to most steps.

    Each round goes on from the pairs that the round before found first, so cycles end; an id that reaches itself is given
    with the length of its shortest cycle. seeds (from_id): where to begin, else everywhere. Edges without an end don't count.
    The pairs can be as many as ids that reach one another, which is what is asked for."""
    rounds = Rounds(edges, "closure")
    steps = rounds.keep(edges.select("from_id", "to_id").where("from_id is not null and to_id is not null").distinct())
    first = steps if seeds is None else steps.join(small(seeds.select("from_id").distinct()), "from_id", "left_semi")
    new = rounds.keep(first.withColumn("depth", F.lit(1)))
    hop = steps.select(F.col("from_id").alias("to_id"), F.col("to_id").alias("next"))
    numbers = [new._number]
    while (most is None or len(numbers) < most) and new.limit(1).count():
        ahead = new.join(hop, "to_id").select("from_id", F.col("next").alias("to_id")).distinct()
        known = rounds.read(numbers, new).select("from_id", "to_id")
        new = rounds.keep(ahead.join(known, ["from_id", "to_id"], "left_anti").withColumn("depth", F.lit(len(numbers) + 1)))
        numbers.append(new._number)
    return rounds.read(numbers, new)


def components(edges: DataFrame) -> DataFrame:
    """id, component: the smallest id that is reached over edges (a, b) in either direction, for every id in them.

    Rounds of two steps, each an aggregation by id: neighbours larger than an id are tied to the smallest one it has, then
    all to the smallest of theirs (alternating large and small stars), until nothing changes. Edges never grow in number, and a
    hub is a row for each of its edges, not a list."""
    rounds = Rounds(edges, "components")
    now = rounds.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        # Large star: each larger neighbour of an id goes to the smallest of the id and its neighbours.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = rounds.keep(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        # Small star: an id and its smaller neighbours go to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small_star = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").unionByName(low.select("a", F.col("low").alias("b")))
        after = rounds.keep(small_star.distinct())
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        rounds.drop(now, large)
        now = after
        if tuple(state) == before:
            break
        before = tuple(state)
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
