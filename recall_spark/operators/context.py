"""Context blocks for prompts, within token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recall_spark.functions import scoring as sc
from recall_spark.functions import text as tx
from recall_spark.operators.joins import small

#: Least similarity of what goes into a block, and of what is searched for it.
FLOOR, SEARCH_FLOOR = 0.25, 0.2
HEADER = "Relevant memories from previous sessions:\n"


def ranked(hits: DataFrame, intents: DataFrame, as_of: int, least: float = FLOOR) -> DataFrame:
    """hits with their composite score for the prompt's intent; age counts from as_of."""
    age = (F.lit(as_of) - F.col("created_at")) / 86400.0
    rows = hits.where(F.col("similarity") >= least).join(intents.select("query_id", "intent"), "query_id")
    return rows.withColumn("composite", sc.composite(F.col("similarity"), sc.type_priority(F.col("intent"), F.col("content_type")), sc.recency(age)))


def _packed(options: Column, budget: Column, stop_at_overflow: bool = False) -> Column:
    """Greedy filling: each element offers texts, the first that fits is taken; one that doesn't fit is skipped."""

    def step(done: Column, entry: Column) -> Column:
        fitting = F.filter(entry["texts"], lambda t: tx.tokens(t) <= budget - done["used"])
        chosen = F.get(fitting, 0)
        take = chosen.isNotNull() & ~done["full"]
        return F.struct(F.when(take, F.concat(done["entries"], F.array(chosen))).otherwise(done["entries"]).alias("entries"),
            (done["used"] + F.when(take, tx.tokens(chosen)).otherwise(0)).alias("used"),
            (done["full"] | (F.lit(stop_at_overflow) & chosen.isNull())).alias("full"))

    return F.aggregate(options,
        F.struct(F.expr("cast(array() as array<string>)").alias("entries"), F.lit(0).alias("used"), F.lit(False).alias("full")), step)


def entries() -> tuple[Column, Column, Column]:
    """A memory at length, in a line with its file, and in a line."""
    text, path = F.coalesce("text", F.lit("")), F.coalesce("file_path", F.lit(""))
    mark = F.concat(F.lit("- ["), "content_type", F.lit("] "))
    line = F.concat(mark, F.coalesce("one_line", F.lit("")))
    own = tx.stripped(text)
    full = F.when(tx.tokens(own) <= 300, own).when(F.coalesce("detailed", F.lit("")) != "",
        F.col("detailed")).otherwise(F.coalesce("one_line", F.lit("")))
    return F.concat(mark, full), F.when(path != "", F.concat(line, F.lit(" -- "), path)).otherwise(line), line


def adaptive(rows: DataFrame, prompts: DataFrame | None = None, base: int = 800, least: int = 200, most: int = 1200) -> DataFrame:
    """query_id, block, entries, used, budget of ranked rows (with one_line, detailed, text, file_path, content_type).

    Better hits are given at length. The best composite score sets the budget. prompts (query_id and, if skills come
    first, skill_tokens, which are taken off the budget): each gives a row, also without any hit (least tokens then)."""
    c = F.col("composite")
    full, medium, brief = entries()
    texts = F.when(c >= 0.75, F.array(full, medium, brief)).when(c >= 0.55, F.array(medium, brief)).when(c >= 0.4,
        F.array(brief)).otherwise(F.expr("cast(array() as array<string>)"))
    one = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-c).alias("o"), "rank", texts.alias("texts")))).alias("options"),
        F.max("composite").alias("best"))
    if prompts is not None:
        one = prompts.join(one, "query_id", "left")
    taken = F.coalesce("skill_tokens", F.lit(0)) if prompts is not None and "skill_tokens" in prompts.columns else F.lit(0)
    budget = F.when(F.col("best").isNull(), F.lit(least)).otherwise(F.greatest(sc.budget(F.col("best"), base, least, most) - taken, F.lit(0)))
    options = F.coalesce("options", F.expr("cast(array() as array<struct<o:double,rank:int,texts:array<string>>>)"))
    filled = one.withColumn("budget", budget).withColumn("p", _packed(options, F.col("budget")))
    return filled.select("query_id", F.when(F.size("p.entries") > 0, F.array_join("p.entries", "\n")).alias("block"),
        F.size("p.entries").alias("entries"), F.col("p.used").alias("used"), "budget")


def legacy(rows: DataFrame, persistent: tuple[str, ...], budget: int = 800, most_code: int = 3, least: float = FLOOR,
    prompts: DataFrame | None = None) -> DataFrame:
    """query_id, block, entries: lasting memories first, then a few lines of code until one doesn't fit. Each of prompts
    (query_id) gives a row, also without any hit."""
    rows = rows.where(F.col("similarity") >= least)
    keeps = F.col("content_type").isin(*persistent)
    line = F.coalesce("one_line", F.lit(""))
    text = F.coalesce("text", F.lit(""))
    lasting = F.concat(F.lit("- ["), "content_type", F.lit("] "), F.when(tx.tokens(text) <= 200, tx.stripped(text)).otherwise(line))
    span = F.concat(F.lit(":"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"))
    place = F.concat(F.coalesce("file_path", F.lit("")), F.coalesce(span, F.lit("")))
    code = F.concat(F.lit("- [code] "), line, F.when(place != "", F.concat(F.lit(" — "), place)).otherwise(""))
    ordered = F.array_sort(F.collect_list(F.struct("rank", keeps.alias("keeps"), F.array(F.when(keeps, lasting).otherwise(code)).alias("texts"))))
    rows = rows.groupBy("query_id").agg(ordered.alias("all"))
    first = _packed(F.filter("all", lambda x: x["keeps"]), F.lit(budget))
    rows = rows.withColumn("a", first).withColumn("b",
        _packed(F.slice(F.filter("all", lambda x: ~x["keeps"]), 1, most_code), F.lit(budget) - F.col("a.used"), True))
    entries = F.concat("a.entries", "b.entries")
    out = rows.select("query_id", F.when(F.size(entries) > 0, F.array_join(entries, "\n")).alias("block"), F.size(entries).alias("entries"))
    if prompts is None:
        return out
    return prompts.select("query_id").join(out, "query_id", "left").select("query_id", "block", F.coalesce("entries", F.lit(0)).alias("entries"))


def selected_skills(skills: DataFrame, budget: int) -> DataFrame:
    """intent, names, used, block: skills of an intent by priority, as many as fit, and their prompts."""

    def step(done: Column, s: Column) -> Column:
        ok = done["used"] + s["token_count"] <= budget
        return F.struct(F.when(ok,
            F.concat(done["chosen"],
            F.array(F.struct(s["name"].alias("name"), s["prompt"].alias("prompt"))))).otherwise(done["chosen"]).alias("chosen"),
            (done["used"] + F.when(ok, s["token_count"]).otherwise(0)).alias("used"))

    rows = skills.groupBy("intent").agg(F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("o"), "name", "token_count",
        tx.stripped(F.col("prompt")).alias("prompt")))).alias("s"))
    folded = F.aggregate("s", F.struct(F.expr("cast(array() as array<struct<name:string,prompt:string>>)").alias("chosen"), F.lit(0).alias("used")),
        step)
    out = rows.select("intent", folded.alias("f"))
    return out.select("intent", F.array_join(F.col("f.chosen.name"), ",").alias("names"), F.col("f.used").alias("used"),
        F.when(F.size("f.chosen") > 0, F.array_join(F.col("f.chosen.prompt"), "\n")).alias("block"))


def smart(hits: DataFrame, intents: DataFrame, skills: DataFrame | None, as_of: int, skill_budget: int = 300, **budgets: int) -> DataFrame:
    """query_id, intent, confidence, block, entries, used, budget for every prompt in intents (query_id, intent, confidence):
    the skills of its intent, an empty line, and the adaptive block of its hits, each if there is any."""
    prompts = intents.select("query_id", "intent", "confidence")
    chosen = prompts.withColumn("skill_block", F.lit(None).cast("string"))
    if skills is not None:
        blocks = selected_skills(skills, skill_budget).select("intent", F.col("block").alias("skill_block"))
        chosen = prompts.join(small(blocks), "intent", "left")
    chosen = chosen.withColumn("skill_tokens", F.coalesce(tx.tokens(F.col("skill_block")), F.lit(0)))
    built = adaptive(ranked(hits, intents, as_of), chosen.select("query_id", "skill_tokens"), **budgets)
    rows = chosen.join(built, "query_id")
    both = F.nullif(F.concat_ws("\n\n", "skill_block", "block"), F.lit(""))
    return rows.select("query_id", "intent", "confidence", both.alias("block"), "entries", "used", "budget")


def injected(blocks: DataFrame) -> DataFrame:
    """query_id, message, tokens: what goes before a prompt; null where there is no block."""
    message = F.when(F.col("block").isNotNull(), F.concat(F.lit(HEADER), "block"))
    return blocks.select("query_id", message.alias("message"), F.coalesce(tx.tokens(message), F.lit(0)).alias("tokens"))


def summary_lines(memories: DataFrame, budget: int) -> DataFrame:
    """file_path, place, line, running: one line for each memory under its file's header, while the running total fits."""
    memories = memories.withColumn("file_path", F.coalesce("file_path", F.lit("unknown")))
    files = memories.groupBy(F.col("repo_id").alias("_repo"), F.col("file_path").alias("_file")).agg(F.min("memory_id").alias("file_first"))
    # A line has a token at least, so lines after the first budget ones can't fit: they don't go through the sums.
    place = Window.partitionBy("repo_id").orderBy("file_first", "memory_id")
    slim = memories.select("repo_id", "file_path", "memory_id", "one_line")
    rows = slim.join(files, F.col("repo_id").eqNullSafe(F.col("_repo")) & (F.col("file_path") == F.col("_file"))).withColumn("place",
        F.row_number().over(place)).where(F.col("place") <= max(budget, 0))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("repo_id", "file_path").orderBy("place")))
    line = F.concat(F.when(F.col("nth") == 1, F.concat(F.lit("\n## "), "file_path", F.lit("\n"))).otherwise(""), F.lit("- "), "one_line", F.lit("\n"))
    rows = rows.withColumn("line", line).withColumn("tokens", tx.tokens(F.col("line")))
    running = rows.withColumn("running",
        F.sum("tokens").over(Window.partitionBy("repo_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    return running.where(F.col("running") <= budget).select("repo_id", "file_path", "memory_id", "line", "running")


def summarised(asked: DataFrame, memories: DataFrame, budget: int = 500, group_by: str = "file") -> DataFrame:
    """request_id, summary, token_count, memories_included for requests (request_id, ids: an ordered list of memory_id).

    Memories are taken in the order of ids, missing ones skipped, and grouped by file, type or none in the order in
    which groups come up. A header or line that would pass the budget still counts towards it; lines after it don't
    go in, and nothing after it fits. memories_included counts the ids asked for."""
    group = {"file": F.coalesce(F.nullif("file_path", F.lit("")), F.lit("unknown")), "type": F.col("content_type"), "none": F.lit("")}[group_by]
    wanted = asked.select("request_id", F.posexplode("ids").alias("pos", "memory_id"))
    rows = small(wanted).join(memories.select("memory_id", group.alias("of"), "one_line"), "memory_id")
    by_group = Window.partitionBy("request_id", "of")
    rows = rows.withColumn("first", F.min("pos").over(by_group)).withColumn("nth", F.row_number().over(by_group.orderBy("pos")))
    line, header = F.concat(F.lit("- "), "one_line", F.lit("\n")), F.concat(F.lit("\n## "), "of", F.lit("\n"))
    parts = F.array_compact(F.array(F.when((F.col("nth") == 1) & (F.lit(group_by) != "none"), header), line))
    pieces = rows.select("request_id", "first", "pos", F.posexplode(parts).alias("k", "piece")).withColumn("tokens", tx.tokens(F.col("piece")))
    order = Window.partitionBy("request_id").orderBy("first", "pos", "k").rowsBetween(Window.unboundedPreceding, 0)
    fitting = pieces.withColumn("running", F.sum("tokens").over(order)).where(F.col("running") <= budget)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "pos", "k", "piece"))), lambda p: p["piece"]), "")
    summaries = fitting.groupBy("request_id").agg(text.alias("summary"))
    out = asked.select("request_id", F.size("ids").alias("memories_included")).join(summaries, "request_id", "left").withColumn("summary",
        F.coalesce("summary", F.lit("")))
    return out.select("request_id", "summary", tx.tokens(F.col("summary")).alias("token_count"), "memories_included")
