"""Change detection, staleness, retention, duplicates, clean-up, secrets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall_spark.functions import text as tx
from recall_spark.operators.joins import small
from recall_spark.sources.tables import CODE

DAY = 86_400


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, changed, removed) between two tables of path, sha256."""
    a, b = old.select("path", F.col("sha256").alias("before")), new.select("path", F.col("sha256").alias("after"))
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed")
    return a.join(b, "path", "full_outer").where(~F.col("before").eqNullSafe(F.col("after"))).select("path", kind.alias("change"))


def marked_stale(memories: DataFrame, changed: DataFrame, commit: str) -> DataFrame:
    """memories, where code of a changed path that was fresh turns stale."""
    hit = changed.select(F.col("path").alias("_changed")).distinct()
    rows = memories.join(hit, F.col("file_path") == F.col("_changed"), "left")
    turns = F.col("_changed").isNotNull() & F.col("content_type").isin(*CODE) & ~F.col("stale")
    return rows.withColumns({"stale": F.col("stale") | turns,
        "stale_reason": F.when(turns, F.lit(f"File changed in commit {commit[:8]}")).otherwise(F.col("stale_reason"))}).drop("_changed")


def expired(memories: DataFrame, as_of: int, conversation_days: int = 0, context_days: int = 0) -> DataFrame:
    """Conversations and contexts older than so many days, each kind by its own limit; 0 days: none of the kind."""
    old = F.lit(False)
    for kind, days in (("conversation", conversation_days), ("context", context_days)):
        if days > 0:
            old = old | ((F.col("content_type") == kind) & (F.col("created_at") < as_of - days * DAY))
    return memories.where(old)


def copies(memories: DataFrame) -> DataFrame:
    """Rows whose text an older row has; the oldest is taken by aggregation, so a text of any number of rows is no task's burden.

    Which join it takes is decided by the size that the aggregate turns out to have: nothing is counted beforehand."""
    sums = memories.withColumn("checksum", tx.checksum(F.col("text")))
    first = sums.groupBy("checksum").agg(F.min(F.struct("created_at", "memory_id")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return sums.join(first, "checksum").where(F.struct("created_at", "memory_id") > F.col("first")).drop("first", "n")


def cleanup(memories: DataFrame, as_of: int, days: int | None = None, content_type: str | None = None, stale_only: bool = False,
    dedup: bool = False) -> DataFrame:
    """memory_id, reason of what would go: by age, then stale, then copies; the first reason counts."""
    parts = []
    if days is not None:
        old = memories.where(F.col("created_at") < as_of - days * DAY)
        parts.append((old if content_type is None else old.where(F.col("content_type") == content_type)).select("memory_id", F.lit(1).alias("o"),
            F.lit("age").alias("reason")))
    if stale_only:
        parts.append(memories.where("stale").select("memory_id", F.lit(2).alias("o"), F.lit("stale").alias("reason")))
    if dedup:
        parts.append(copies(memories).select("memory_id", F.lit(3).alias("o"), F.lit("duplicate").alias("reason")))
    out = memories.select("memory_id", F.lit(0).alias("o"), F.lit("").alias("reason")).limit(0)
    for part in parts:
        out = out.unionByName(part)
    return out.groupBy("memory_id").agg(F.min_by("reason", "o").alias("reason"))


def last_commits(log: DataFrame) -> DataFrame:
    """repo_id, branch_name, commit of the latest event."""
    return log.groupBy("repo_id", "branch_name").agg(F.max_by("commit", F.struct("at", "commit")).alias("commit"))


def screened(memories: DataFrame, sanitise: bool = True) -> DataFrame:
    """memories with has_secrets, and with secrets replaced; without sanitise such rows are rejected."""
    rows = memories.withColumn("has_secrets", tx.has_secrets(F.col("text")))
    return rows.withColumn("text", tx.sanitised(F.col("text"))) if sanitise else rows.where(~F.col("has_secrets"))


def findings(memories: DataFrame) -> DataFrame:
    """memories, a row for each secret that a text holds, with its rule, begin and end; texts without any give none."""
    found = memories.where(tx.has_secrets(F.col("text"))).withColumn("_s", F.explode(tx.findings(F.col("text"))))
    return found.select(*memories.columns, "_s.rule", "_s.begin", "_s.end")


def current(log: DataFrame) -> DataFrame:
    """The newest version of each memory in an append-only log (memory_id, version, deleted, ...), without the deleted ones.

    Which version is newest is aggregated from ids alone. Ids go to the texts while they are few; otherwise both are
    dealt by id once, and nothing is sorted with its text. No two calls that write a memory share a version."""
    newest = log.groupBy("memory_id").agg(F.max("version").alias("version"),
        F.max_by("deleted", "version").alias("_gone")).where("not _gone").drop("_gone")
    return log.join(small(newest), ["memory_id", "version"], "left_semi")


def tracked(hashes: DataFrame) -> DataFrame:
    """repo_id, branch_name, files, last_version: how many files each index holds hashes of."""
    last = hashes.groupBy("repo_id", "branch_name").agg(F.max("version").alias("last_version"))
    return hashes.join(last, ["repo_id", "branch_name"]).where("version = last_version").groupBy("repo_id", "branch_name",
        "last_version").agg(F.countDistinct("path").alias("files"))


def needs_full_run(last_indexed_at: int | None, now: int, minutes: int) -> bool:
    """Whether hashes are older than so many minutes, so that the next run looks at all files; 0 minutes: never."""
    return last_indexed_at is None or (minutes > 0 and now - last_indexed_at > 60 * minutes)
