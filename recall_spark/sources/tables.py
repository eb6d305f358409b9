"""The memory tables, derived from documents, embeddings and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_spark.functions import text as tx
from recall_spark.operators.joins import small

#: Kinds of memories, and those that count as code, as lasting, and as recalled.
TYPES = ("code_snippet", "context", "summary", "relationship", "decision", "analysis", "conversation")
CODE = ("code_snippet", "relationship")
PERSISTENT = ("context", "summary", "decision", "analysis", "conversation")
RECALLED = ("decision", "analysis", "context", "conversation")
EPOCH = 1704067200  # 2024-01-01 00:00 UTC
AS_OF = 1707955200  # 2024-02-15 00:00 UTC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each memory; created_at in seconds."""
    i = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (i % 7 + 1).cast("int"))
    out = table(spark, sf_dir, "documents").select(
        i.alias("memory_id"), F.col("source").alias("repo_id"), F.col("source").alias("repo_name"),
            F.when(i % 4 != 0, "main").otherwise("dev").alias("branch_name"), kind.alias("content_type"), "text", F.col("lang").alias("language"),
        F.concat(F.lit("src/"), "lang", F.lit("/f"), (i % 25).cast("string"), F.lit(".txt")).alias("file_path"), (i % 100 + 1).alias("line_start"),
            (i % 100 + 10).alias("line_end"),
        F.when(i % 5 == 0, F.concat(F.lit("fn_"), (i % 13).cast("string"))).alias("function_name"),
            F.when(i % 5 == 1, F.concat(F.lit("Cls_"), (i % 11).cast("string"))).alias("class_name"),
        F.array(F.col("lang"), F.concat(F.lit("t"), (i % 3).cast("string")), F.concat(F.lit("g"), (i % 5).cast("string"))).alias("tags"),
            (F.lit(EPOCH) + i % 1000 * 3600).alias("created_at"), (kind.isin(*CODE) & (i % 3 == 1)).alias("stale"),
    )
    return out.withColumn("stale_reason", F.when(F.col("stale"), "File changed in commit abc12345"))


def derived(rows: DataFrame) -> DataFrame:
    """rows with checksum, token_count, one_line, detailed and chunk_type."""
    t = F.col("text")
    return rows.withColumns({"checksum": tx.checksum(t), "token_count": tx.tokens(t), "one_line": tx.one_line(t), "detailed": tx.detailed(t),
        "chunk_type": tx.chunk_type(F.col("function_name"), F.col("class_name"))})


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of memories, with their scope.

    Here the scope comes from another table: ids and scopes go to the embeddings, as long as they are few, not
    embeddings to them. A store writes the scope of a vector beside it."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("memory_id"), "embedding", "label")
    scopes = memories(spark, sf_dir).select("memory_id", "repo_id", "branch_name")
    return e.join(small(scopes, table(spark, sf_dir, "documents").count()), "memory_id")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("from_id"))
    step = F.explode(F.filter(F.array(F.when(F.col("from_id") % 2 == 0,
        F.struct((F.col("from_id") + 1).alias("to_id"), F.lit("depends_on").alias("relationship_type"))),
        F.when(F.col("from_id") % 3 == 0, F.struct((F.col("from_id") + 2).alias("to_id"), F.lit("related_to").alias("relationship_type")))),
        lambda x: x.isNotNull()))
    return ids.select("from_id", step.alias("e")).select("from_id", "e.to_id",
        "e.relationship_type").join(ids.select(F.col("from_id").alias("to_id")), "to_id", "left_semi").select("from_id", "to_id", "relationship_type")


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A skill for each conversation, by its first turn."""
    first = table(spark, sf_dir,
        "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("prompt")).where("trim(coalesce(prompt, '')) <> ''")
    intent = F.element_at(F.array(*map(F.lit, ("debugging", "coding", "general"))), (F.col("conv_id") % 3 + 1).cast("int"))
    return first.select(F.concat(F.lit("skill_"), F.lpad(F.col("conv_id").cast("string"), 9, "0")).alias("name"), intent.alias("intent"),
        (F.col("conv_id") * 7 % 10).cast("int").alias("priority"), "prompt").withColumn("token_count", tx.tokens(F.col("prompt")))
