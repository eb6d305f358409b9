"""From raw documents to a training mix: five operators in a row, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_spark.llm import decontamination, exact_dedup, language_id, mixing, near_dedup
from recall_spark.llm.common import documents, keyed, remainder, save, without


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without one (no text, or no letter in it) go, whether or not any language was learned."""
    rows = keyed(docs)
    found = language_id.examined(rows.select(F.col("_row").alias("doc_id"), "text", "lang"), remainder("doc_id", 3) == 1)
    return without(rows, found.where("not has_letter"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.without_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time that a document is used, with its place."""
    return mixing.mix(docs)


STAGES = [("language ID", language), ("exact dedup", exact), ("MinHash near-dedup", near), ("benchmark decontamination", benchmark), ("mixing sources to target weights", mixture)]
#: Languages and the place in the mix have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
