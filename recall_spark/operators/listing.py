"""Filters, listings and statistics over memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERS = {"date": ("created_at desc", "memory_id"), "file": ("file_path", "created_at desc", "memory_id"),
    "type": ("content_type", "created_at desc", "memory_id")}


def has_tags(wanted: list[str]) -> Column:
    """All wanted tags; a tag asked for twice counts once."""
    return F.size(F.array_except(F.array(*map(F.lit, dict.fromkeys(wanted))), "tags")) == 0


def filtered(memories: DataFrame, *, repo: str | None = None, branch: str | None = None, cross_branch: bool = False, memory_id: int | None = None,
    path: str | None = None, content_type: str | None = None, language: str | None = None, function_name: str | None = None,
    class_name: str | None = None, tags: list[str] | None = None, include_stale: bool = False) -> DataFrame:
    """Rows that pass all given filters; cross_branch drops the branch from the scope. path is a prefix, without regard to case."""
    equal = {"repo_id": repo, "branch_name": None if cross_branch else branch, "memory_id": memory_id, "content_type": content_type,
        "language": language, "function_name": function_name, "class_name": class_name}
    for column, value in equal.items():
        if value is not None:
            memories = memories.where(F.col(column) == value)
    if path is not None:
        memories = memories.where(F.lower("file_path").startswith(path.lower()))
    if tags:
        memories = memories.where(has_tags(tags))
    return memories if include_stale else memories.where(~F.col("stale"))


def listed(memories: DataFrame, order: str = "date", limit: int = 100, offset: int = 0, **filters) -> DataFrame:
    rows = filtered(memories,
        **filters).orderBy(*(F.expr(c.removesuffix(" desc")).desc() if c.endswith(" desc") else F.col(c) for c in ORDERS[order]))
    return (rows.offset(offset) if offset else rows).limit(limit)


def by_ids(memories: DataFrame, ids: list) -> DataFrame:
    """The memories of an ordered list of ids, with their position (pos) in it; missing ones are skipped."""
    wanted = memories.sparkSession.createDataFrame(list(enumerate(ids)), f"pos int, memory_id {memories.schema['memory_id'].dataType.simpleString()}")
    return memories.join(F.broadcast(wanted), "memory_id")  # as long as the list


def rehydrated(memories: DataFrame, edges: DataFrame) -> DataFrame:
    """memories with depends_on and related_to, the sorted ids that they point to."""
    out = memories
    for kind in ("depends_on", "related_to"):
        to = edges.where(F.col("relationship_type") == kind).groupBy(F.col("from_id").alias("memory_id")).agg(F.array_sort(F.collect_set("to_id")).alias(kind))
        out = out.join(to, "memory_id", "left").withColumn(kind, F.coalesce(kind, F.array().cast(to.schema[kind].dataType)))
    return out


def retrieved(memories: DataFrame, repo: str, branch: str, memory_id: int) -> DataFrame:
    return filtered(memories, repo=repo, branch=branch, memory_id=memory_id, include_stale=True)


def by_repository(memories: DataFrame) -> DataFrame:
    counts = memories.groupBy("repo_id", "repo_name").agg(F.count("*").alias("n"), F.count_if("stale").alias("n_stale"))
    return counts.select(F.concat("repo_name", F.lit(" ("), "repo_id", F.lit(")")).alias("repository"), "n", "n_stale",
        (F.col("n") * 3 / 1024).alias("size_mb"))


def neighbours(edges: DataFrame, memories: DataFrame) -> DataFrame:
    """Edges with the type and file of what they point to."""
    to = memories.select(F.col("memory_id").alias("to_id"), F.col("content_type").alias("to_type"), F.col("file_path").alias("to_path"))
    return edges.join(to, "to_id").select("from_id", "to_id", "relationship_type", "to_type", "to_path")
