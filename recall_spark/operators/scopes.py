"""Which repository and branch a memory belongs to, by where its file lies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recall_spark.functions import text as tx
from recall_spark.operators.joins import small


def above(folder: Column) -> Column:
    """A folder and all folders that it lies in, from the root on; of a relative one, those that it names."""
    names = F.split(F.regexp_replace(folder, "(?<=[^/])/+$", ""), "/")
    paths = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, F.lit(1), i), "/"))
    return F.when(folder == "/", F.array(F.lit("/"))).otherwise(F.transform(paths, lambda p: F.when(p == "", "/").otherwise(p)))


def placed(rows: DataFrame, folders: DataFrame) -> DataFrame:
    """rows, where those without a repo_id get repo_id and branch_name of the deepest of folders (folder, repo_id, branch_name)
    that holds them: the folder in repo_path, if rows have that column, else that of an absolute file_path.

    Rows that no folder holds keep what they had. Distinct folders are matched, not rows; of equal folders the first
    repository counts."""
    given = F.col("repo_path") if "repo_path" in rows.columns else F.lit(None).cast("string")
    for column in ("repo_id", "branch_name"):
        if column not in rows.columns:
            rows = rows.withColumn(column, F.lit(None).cast("string"))
    asked = rows.withColumn("_folder", F.when(F.col("repo_id").isNull(), tx.scope_folder(given, F.col("file_path"))))
    levels = asked.where("_folder is not null").select("_folder").distinct().select("_folder", F.posexplode(above(F.col("_folder"))).alias("depth", "_at"))
    known = folders.groupBy(F.regexp_replace("folder", "(?<=[^/])/+$", "").alias("_at")).agg(F.min(F.struct("repo_id", "branch_name")).alias("_scope"))
    found = levels.join(small(known), "_at").groupBy("_folder").agg(F.max_by("_scope", "depth").alias("_scope"))
    out = asked.join(small(found), "_folder", "left")
    return out.withColumns({"branch_name": F.when(F.col("repo_id").isNull(), F.coalesce("_scope.branch_name", "branch_name")).otherwise(F.col("branch_name")),
        "repo_id": F.coalesce("repo_id", "_scope.repo_id")}).drop("_folder", "_scope", "repo_path")
