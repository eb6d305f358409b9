"""Indexing and syncing repositories: which files are chunked or skipped, and what a new commit changes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recall_spark.functions import text as tx
from recall_spark.operators import chunking
from recall_spark.sources import files as fl
from recall_spark.sources.tables import CODE


def name_matches(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a path's last part is matched, as a whole, by the last part of a glob with * and ?."""
    wild = {"*": "[^/]*", "?": "[^/]"}
    globs = ("".join(wild.get(c, re.escape(c)) for c in p.rsplit("/", 1)[-1]) for p in patterns)
    return path.rlike("(?:^|/)(?:" + "|".join(globs) + r")\z")


def outcomes(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """files (path, content, sha256, ...) with text and outcome: unchanged, binary, empty_chunks or indexed.

    A file is unchanged if known (path, sha256) has its hash. Null content counts as empty."""
    rows = fl.decoded(files.withColumn("content", F.coalesce("content", F.lit(b""))))
    same = F.lit(False)
    if known is not None:
        before = known.select(F.col("path").alias("_path"), F.col("sha256").alias("_sha256")).distinct()
        rows = rows.join(before, (F.col("path") == F.col("_path")) & (F.col("sha256") == F.col("_sha256")), "left")
        same = F.col("_path").isNotNull()
    kind = F.when(same, "unchanged").when(F.col("skip_reason").isNotNull(), F.col("skip_reason")).when(tx.stripped(F.col("text")) == "",
        "empty_chunks").otherwise("indexed")
    return rows.withColumn("outcome", kind).drop("skip_reason", "_path", "_sha256")


def chunks(found: DataFrame) -> DataFrame:
    """The chunks of the files that outcomes() says are indexed, each file chunked by its language."""
    todo = found.where("outcome = 'indexed'").select("path", "text", tx.language(F.col("path")).alias("language"))
    return chunking.chunked(todo).where("trim(chunk_text) <> ''").withColumn("tags", F.array(F.lit("indexed"), F.lit("repository")))


def rows_of(chunks: DataFrame, repo: str, branch: str, tags: tuple[str, ...] = ("indexed", "repository")) -> DataFrame:
    """Chunks as memories to be stored."""
    kind, name = F.col("kind"), F.col("name")
    return chunks.select(
        F.lit(repo).alias("repo_id"), F.lit(branch).alias("branch_name"), F.lit("code_snippet").alias("content_type"),
            F.col("chunk_text").alias("text"), "language", F.col("path").alias("file_path"), "line_start", "line_end",
        F.when(kind.isin("function", "method"), name).alias("function_name"), F.when(kind == "class", name).alias("class_name"), "docstring",
            "decorators", F.col("parent").alias("parent_class"), F.array(*map(F.lit, tags)).alias("tags"),
    )


def synced(memories: DataFrame, changed: DataFrame, patterns: tuple[str, ...], before: str, after: str) -> DataFrame:
    """A row for each repo_id and branch_name with changed files (path, still_there): files, and memories that turn stale."""
    scope = ["repo_id", "branch_name"]
    updated = F.coalesce(F.col("still_there") & name_matches(F.col("path"), patterns), F.lit(False))
    files = changed.groupBy(*scope).agg(F.count_if(updated).alias("files_updated"), F.count_if(~updated).alias("files_removed"))
    fresh = memories.where(F.col("content_type").isin(*CODE) & ~F.col("stale")).withColumn("path", F.col("file_path"))
    staled = fresh.join(changed.select(*scope, "path").distinct(), [*scope, "path"], "left_semi").groupBy(*scope).agg(F.count("*").alias("n"))
    return files.join(staled, scope, "left").select(*scope, F.lit(before[:8]).alias("from_commit"), F.lit(after[:8]).alias("to_commit"),
        "files_updated", "files_removed", F.coalesce("n", F.lit(0)).alias("memories_staled"))
