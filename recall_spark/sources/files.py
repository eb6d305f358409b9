"""Repository files, transcripts and skill files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recall_spark.functions import text as tx

#: Directories that are never indexed.
IGNORED = (
    "__pycache__", ".git", ".hg", ".svn", ".venv", "venv", "env", "node_modules", ".pytest_cache", ".mypy_cache",
    ".ruff_cache", "build", "dist", ".next", ".nuxt", "target", ".idea", ".vscode", ".coverage",
)
#: Files that are indexed where no patterns are given.
PATTERNS = ("**/*.py", "**/*.js", "**/*.ts", "**/*.go", "**/*.rs")


def glob_regex(pattern: str) -> str:
    """A glob over a whole relative path: ** is any number of folders, * and ? stay within one name."""
    out, at = "", 0
    for m in re.finditer(r"\*\*/|\*\*|\*|\?", pattern):
        out += re.escape(pattern[at : m.start()]) + {"**/": "(?:[^/]+/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}[m.group()]
        at = m.end()
    return out + re.escape(pattern[at:])


def repository(spark: SparkSession, root: str, patterns: tuple[str, ...] = PATTERNS, most: int | None = None,
    ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """path, content, sha256 of the files whose path a pattern matches, outside ignored directories.

    With most, only so many by path. Paths are listed first, without a byte of the files; only files that are wanted are
    opened. Their paths go through the driver, as all paths of a folder do that Spark reads."""
    base = re.escape("/" + re.sub("^[a-z]+:/*", "", root).strip("/") + "/")
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + base, "")
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("at"), relative.alias("path"))
    wanted = there.where(F.col("path").rlike("^(?:" + "|".join(map(glob_regex, patterns)) + r")\z")).where(~F.exists(F.split("path", "/"),
        lambda p: p.isin(*ignored))).orderBy("path")
    # Names with signs of a glob are escaped, as load() takes globs.
    paths = [re.sub(r"([\\\[\]{}*?])", r"\\\1", r["at"]) for r in (wanted.limit(most) if most is not None else wanted).collect()]
    if not paths:
        return spark.createDataFrame([], "path string, content binary, sha256 string")
    files = spark.read.format("binaryFile").load(paths)
    return files.select(relative.alias("path"), "content", F.sha2("content", 256).alias("sha256"))


def decoded(files: DataFrame) -> DataFrame:
    """files with text (null if not UTF-8) and skip_reason (`binary` then)."""
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return files.withColumn("text", text).withColumn("skip_reason", F.when(text.isNull(), "binary"))


def transcript(lines: DataFrame, *also: str) -> DataFrame:
    """session_id, line_no, role, text (and also these columns) of JSONL lines (session_id, line_no, line, ...); bad lines
    and other roles go.

    Content that is a JSON string is taken as it is; of a list of blocks the first text that is not blank, stripped."""
    row = F.try_parse_json("line")
    parsed = lines.withColumn("v", row).withColumn("role", F.try_variant_get("v", "$.role", "string")).where("role in ('user', 'assistant')")
    kind = F.coalesce(F.schema_of_variant(F.try_variant_get("v", "$.content", "variant")), F.lit("STRING"))
    blocks = F.try_variant_get("v", "$.content", "array<variant>")
    texts = F.transform(blocks,
        lambda b: F.when(F.try_variant_get(b, "$.type", "string") == "text", tx.stripped(F.try_variant_get(b, "$.text", "string"))))
    first = F.get(F.filter(texts, lambda t: F.coalesce(t, F.lit("")) != ""), 0)
    text = F.when(kind.startswith("ARRAY"), first).when(kind == "STRING", F.coalesce(F.try_variant_get("v", "$.content", "string"), F.lit("")))
    return parsed.select("session_id", "line_no", *also, "role", text.alias("text")).where("text is not null")


def last_lines(lines: DataFrame, most: int) -> DataFrame:
    """The last lines of each session, whatever they hold."""
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("line_no")))
    return lines.withColumn("back", back).where(F.col("back") <= most).drop("back")


def joined_turns(turns: DataFrame) -> DataFrame:
    """session_id, transcript: role-prefixed turns, parted by empty lines."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", F.concat_ws(": ", "role", "text").alias("turn"))))
    return turns.groupBy("session_id").agg(F.array_join(F.transform(ordered, lambda x: x["turn"]), "\n\n").alias("transcript"))


def tail(lines: DataFrame, most: int) -> DataFrame:
    """session_id, transcript of the turns among the last lines of each session."""
    return joined_turns(transcript(last_lines(lines, most)))


def skill_files(spark: SparkSession, root: str) -> DataFrame:
    """Skills from YAML files (name, intent, priority, prompt, tags, token_count), in the order of their files' names.

    A file that is no mapping, has no prompt or a priority that is no number gives none; what it lacks has defaults."""
    import pandas as pd

    def parse(frames):
        import yaml

        for frame in frames:
            rows = []
            for path, value in zip(frame["path"], frame["value"]):
                try:
                    d = yaml.safe_load(value)
                    if not isinstance(d, dict) or not str(d.get("prompt", "")).strip():
                        continue
                    stem = path.rsplit("/", 1)[-1].removesuffix(".yaml")
                    rows.append((str(d.get("name", stem)), str(d.get("intent", "general")), int(d.get("priority", 0)), str(d["prompt"]),
                        [str(t) for t in d.get("tags") or []]))
                except (yaml.YAMLError, ValueError, TypeError):
                    continue
            yield pd.DataFrame(rows, columns=["name", "intent", "priority", "prompt", "tags"])

    files = spark.read.text(f"{root}/*.yaml", wholetext=True).select("value", F.input_file_name().alias("path"))
    found = files.mapInPandas(parse, "name string, intent string, priority int, prompt string, tags array<string>")
    return found.withColumn("token_count", tx.tokens(F.col("prompt")))
