"""Capturing memories from sessions: replies of an extractor, prompts for it, session notes, and what was saved."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recall_spark.functions import text as tx
from recall_spark.operators import cells, graphs, search
from recall_spark.sources import files as fl

#: Similarity from which an item counts as stored already, and from which a memory is named as known.
COPY, KNOWN = 0.97, 0.85
#: Characters of a transcript that are searched for what is known.
QUERY_CHARS = 500
#: Types that an extractor may give; all others count as context.
EXTRACTED = ("decision", "analysis", "context", "conversation", "summary")
_ITEMS = "array<struct<type:string,content:string,tags:array<string>>>"


def items(reply: Column) -> Column:
    """The items of a reply: a JSON list, within a code fence or not; anything else, null too, gives none."""
    bare = tx.stripped(F.regexp_replace(tx.stripped(reply), r"^```(?:json)?|```$", ""))
    return F.coalesce(F.from_json(F.when(bare.startswith("["), bare), _ITEMS), F.expr(f"cast(array() as {_ITEMS})"))


def extracted(replies: DataFrame) -> DataFrame:
    """session_id, place, content_type, text, tags of the items in replies (session_id, reply); items without text go."""
    rows = replies.select("session_id", F.posexplode(items(F.col("reply"))).alias("place", "item"))
    kind = F.when(F.col("item.type").isin(*EXTRACTED), F.col("item.type")).otherwise("context")
    tags = F.filter(F.coalesce("item.tags", F.expr("cast(array() as array<string>)")), lambda t: t.isNotNull() & (t != ""))
    return rows.select("session_id", "place", kind.alias("content_type"), tx.stripped(F.col("item.content")).alias("text"),
        tags.alias("tags")).where("text <> ''")


def known_lines(hits: DataFrame, most: int = 5) -> DataFrame:
    """query_id and the lines of its first hits (rank, content_type, one_line), as a prompt lists them."""
    line = F.concat(F.lit("["), "content_type", F.lit("] "), "one_line")
    first = hits.where(F.col("rank") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("all"))
    return first.select("query_id", F.transform("all", lambda x: x["line"]).alias("known"))


def prompt(base: Column, known: Column, most: int = 20) -> Column:
    """base, with the stored lines that are not to be extracted again."""
    bullets = F.array_join(F.transform(F.slice(known, 1, most), lambda s: F.concat(F.lit("- "), s)), "\n")
    return F.when(F.size(known) > 0, F.concat(base, F.lit("\n\nAlready stored (do NOT re-extract these):\n"), bullets)).otherwise(base)


def to_extract(text: Column, hint: Column) -> Column:
    """What a caller without an extractor of its own is asked to do with a text; the hint may be null."""
    ask = "Find the facts in this text that are worth keeping and store each as a decision, analysis, context, conversation or summary.\n\n---\n"
    return F.concat(F.lit(ask), text, F.lit("\n---\n"), F.when(F.coalesce(hint, F.lit("")) != "", F.concat(F.lit("\nHint: "), hint)).otherwise(""))


def savings(rows: DataFrame, *by: str) -> DataFrame:
    """Tokens of text and of one_line, what is saved, and the mean share saved, for each group."""
    whole, short = tx.tokens(F.col("text")), tx.tokens(F.col("one_line"))
    return rows.groupBy(*by).agg(F.sum(whole).alias("tokens"), F.sum(short).alias("short_tokens"), F.sum(whole - short).alias("saved"),
        F.avg(F.when(whole > 0, 1 - short / whole)).alias("mean_share"))


def to_capture(lines: DataFrame, last: int = 200) -> DataFrame:
    """session_id, text: the compressed transcript of the last lines of each session; blank ones go."""
    text = tx.compressed(F.col("transcript"))
    return fl.tail(lines, last).select("session_id", text.alias("text")).where("text <> ''")


def known_for(sessions: DataFrame, vectors: DataFrame, memories: DataFrame, embed=search.embedded, scoped: tuple[str, ...] = (),
    most: int = 5) -> DataFrame:
    """session_id, known: lines of the memories most like the beginning of each session's text (and scoped columns)."""
    named = sessions.withColumn("query_id", F.xxhash64("session_id"))
    queries = embed(named.select(F.col("query_id").alias("memory_id"),
        F.left("text", F.lit(QUERY_CHARS)).alias("text"))).withColumnRenamed("memory_id", "query_id")
    if scoped:
        queries = queries.join(named.select("query_id", *scoped), "query_id")
    hits = cells.near(vectors, queries, KNOWN, most, scoped)
    lines = known_lines(search.with_memories(hits, memories, hits.count()).where("not stale"), most)
    return named.select("query_id", "session_id").join(lines, "query_id").select("session_id", "known")


#: What an extractor is told, before the lines that are known.
EXTRACT = "List what this conversation settles or explains as a JSON list of objects with type, content and tags."
Extractor = Callable[[list[tuple[str, str]]], list[str | None]]


def replies(sessions: DataFrame, extractor: Extractor | None = None, base: str = EXTRACT) -> DataFrame:
    """session_id, status, reply, error, prompt of sessions (session_id, text; and known, hint if they have them).

    extractor: gets (instructions, text) of a batch of sessions and gives their replies, None where it has none. Without an
    extractor, or where it has no reply or fails, status is passthrough or failed, and prompt is what the caller may ask a
    model of their own. If a batch fails, its sessions are tried one by one, so that one of them doesn't cost the others."""
    for column, kind in (("known", "array<string>"), ("hint", "string")):
        if column not in sessions.columns:
            sessions = sessions.withColumn(column, F.lit(None).cast(kind))
    known = F.coalesce("known", F.expr("cast(array() as array<string>)"))
    asked = F.when(F.coalesce("hint", F.lit("")) != "", F.concat(F.lit("Hint: "), "hint", F.lit("\n\n"), "text")).otherwise(F.col("text"))
    rows = sessions.select("session_id", prompt(F.lit(base), known).alias("told"), asked.alias("asked"), to_extract(F.col("text"), F.col("hint")).alias("prompt"))
    if extractor is None:
        return rows.select("session_id", F.lit("passthrough").alias("status"), F.lit(None).cast("string").alias("reply"), F.lit(None).cast("string").alias("error"), "prompt")

    def run(batches):
        for batch in batches:
            pairs = list(zip(batch.column("told").to_pylist(), batch.column("asked").to_pylist()))
            errors: list[str | None] = [None] * len(pairs)
            try:
                got = list(extractor(pairs))
                if len(got) != len(pairs):
                    raise ValueError(f"{len(got)} replies to {len(pairs)} sessions")
            except Exception:  # of the caller's code, whatever it is: rows are tried one by one
                got = []
                for i, pair in enumerate(pairs):
                    try:
                        got += extractor([pair])[:1] or [None]
                    except Exception as error:
                        errors[i] = f"{type(error).__name__}: {error}"
                        got.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("session_id"), batch.column("prompt"), pa.array(got, pa.string()), pa.array(errors, pa.string())], names=["session_id", "prompt", "reply", "error"])

    kind = rows.schema["session_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"session_id {kind}, prompt string, reply string, error string")
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("reply").isNull(), "passthrough").otherwise("extracted")
    return out.select("session_id", status.alias("status"), "reply", "error", F.when(status != "extracted", F.col("prompt")).alias("prompt"))


def captured(replied: DataFrame, vectors: DataFrame, embed=search.embedded, scoped: dict[str, str] | None = None) -> DataFrame:
    """The items of replies() that neither vectors (and in scoped, columns with their values) nor earlier items of their session are like."""
    found = extracted(replied.where("status = 'extracted'").select("session_id", "reply"))
    for column, value in (scoped or {}).items():
        found = found.withColumn(column, F.lit(value))
    return not_stored(found, vectors, embed, scoped=tuple(scoped or ()))


def not_stored(items: DataFrame, vectors: DataFrame, embed=search.embedded, least: float = COPY, scoped: tuple[str, ...] = ()) -> DataFrame:
    """The items (session_id, place, text, ... and scoped columns) that are no near copies, with their embeddings.

    An item is a copy of a stored vector, or of an earlier item of its session that is kept, as if items were stored one
    after another. Items without a usable embedding, as blank texts have, are kept. The result reads saved tables of the items and
    their copies, so that neither is made again."""
    named = items.withColumn("query_id", F.xxhash64(F.to_json(F.struct("session_id", "place"))))
    with_vectors = embed(named.select(F.col("query_id").alias("memory_id"), "text")).select(F.col("memory_id").alias("query_id"), "embedding")
    both = graphs.Rounds(items, "items").keep(named.join(with_vectors, "query_id"))
    copies = cells.near(vectors, both.select("query_id", "embedding", *scoped), least, 1, scoped).select("query_id")
    fresh = both.join(copies, "query_id", "left_anti")
    pairs = F.array_sort(F.collect_list(F.struct("place", "query_id", "embedding")))

    def distance(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d.cast("double"))

    def keep(done: Column, item: Column) -> Column:
        known = F.exists(done, lambda k: F.exp(-distance(k["embedding"], item["embedding"])) >= least) & F.exists(item["embedding"], lambda x: x != 0)
        return F.when(known, done).otherwise(F.concat(done, F.array(item)))

    kind = fresh.select(F.array(F.struct("place", "query_id", "embedding")).alias("k")).schema["k"].dataType.simpleString()
    kept = fresh.groupBy("session_id").agg(F.aggregate(pairs, F.expr(f"cast(array() as {kind})"), keep).alias("kept"))
    ids = kept.select(F.explode(F.col("kept.query_id")).alias("query_id"))
    return fresh.join(ids, "query_id", "left_semi").drop("query_id")


def stored_counts(found: DataFrame, stored: DataFrame) -> DataFrame:
    """session_id, extracted, stored: how many items a session gave, and how many of them were stored."""
    both = found.groupBy("session_id").agg(F.count("*").alias("extracted")).join(stored.groupBy("session_id").agg(F.count("*").alias("stored")),
        "session_id", "left")
    return both.select("session_id", "extracted", F.coalesce("stored", F.lit(0)).alias("stored"))


def stats(memories: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row on memories and vectors together."""
    a = memories.agg(F.count("*").alias("n_memories"), F.countDistinct("repo_id").alias("n_repos"), F.count_if("stale").alias("n_stale"))
    b = vectors.agg(F.count("*").alias("n_vectors"), F.max(F.size("embedding")).alias("dims"))
    both = a.unionByName(b, allowMissingColumns=True)
    out = both.agg(*(F.max(c).alias(c) for c in both.columns))
    return out.withColumn("size_mb", F.col("n_memories") * 3 / 1024.0)
