"""Token counts from an exact histogram of encoded lengths.

Documents are encoded by a public tokenizer and counted by their number of tokens. The histogram, which is far
smaller than the corpus, answers by suffix sums how many documents and tokens lie at or above any length, hence
all quantiles and, for every context limit, how many tokens remain if longer documents are cut there.

Null and empty texts have 0 tokens and are counted. Null ids, repeated rows and extra columns do no harm.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recall_spark.functions.vocabulary import Vocabulary
from recall_spark.llm.common import only, save

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How this vocabulary splits text before merging bytes (fixed values).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPAN = 1024
_encodings: dict = {}


def encoding(vocabulary: str, pattern: str = PATTERN):
    """The tokenizer, loaded once in a process."""
    import tiktoken

    if vocabulary not in _encodings:
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encodings[vocabulary] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[vocabulary]


def lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens of each document. Runs of white space of any length are counted as the vocabulary's pattern splits them."""

    def run(batches):
        encoded = Vocabulary.at(vocabulary).encoded
        for batch in batches:
            n = [len(encoded(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")


def histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """n_tokens, n_docs, docs_from and tokens_from (at or above it), kept_tokens (if cut at it), rank (share below it).

    Sums over all lengths are made in two steps, over spans of lengths and within a span, so no task gets all rows."""
    counts = save(lengths(docs, vocabulary).groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "lengths")
    counts = counts.withColumn("span", F.floor(F.col("n_tokens") / SPAN))
    spans = counts.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    after = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spans = spans.select("span", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"), F.sum("d").over(total).alias("all_docs"),
        F.sum("t").over(total).alias("all_tokens"))
    own = Window.partitionBy("span").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.join(spans, "span").withColumn("docs_from", F.col("d_after") + F.sum("n_docs").over(own)).withColumn("tokens_from",
        F.col("t_after") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(own))
    return rows.select(
        "n_tokens",
        "n_docs",
        "docs_from",
        "tokens_from",
        (F.col("all_tokens") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens")).alias("kept_tokens"),
        ((F.col("all_docs") - F.col("docs_from")) / F.col("all_docs")).alias("rank"),
    )


def at_limits(histogram: DataFrame, limits: DataFrame) -> DataFrame:
    """limit, docs_cut, kept_tokens for any context limits (column limit), from the suffix sums alone.

    Documents longer than a limit are those at or above the next length that occurs: they keep limit tokens each, the
    others all of theirs. Limits and lengths are put in one order, in spans and within a span, as histogram() does."""
    asked = limits.select(F.col("limit").cast("long").alias("at")).where("at is not null").distinct()
    wanted = asked.select("at", F.lit(True).alias("asked"), F.lit(None).cast("struct<d:bigint,t:bigint>").alias("next"))
    known = histogram.select(F.col("n_tokens").alias("at"), F.lit(False).alias("asked"),
        F.struct(F.col("docs_from").cast("long").alias("d"), F.col("tokens_from").cast("long").alias("t")).alias("next"))
    rows = wanted.unionByName(known).withColumn("span", F.floor(F.col("at") / SPAN))
    firsts = rows.groupBy("span").agg(F.min_by("next", F.when(F.col("next").isNotNull(), F.col("at"))).alias("first"))
    beyond = firsts.select("span",
        F.first("first", ignorenulls=True).over(Window.orderBy("span").rowsBetween(1, Window.unboundedFollowing)).alias("beyond"))
    # A limit that is a length itself cuts only what is longer, so it goes behind that length.
    within = Window.partitionBy("span").orderBy("at", "asked").rowsBetween(1, Window.unboundedFollowing)
    found = rows.join(beyond, "span").withColumn("next", F.coalesce(F.first("next", ignorenulls=True).over(within), "beyond")).where("asked")
    total = histogram.agg(F.max("tokens_from").alias("total"))
    cut, rest = F.coalesce("next.d", F.lit(0)), F.coalesce("next.t", F.lit(0))
    return found.join(F.broadcast(total)).select(F.col("at").alias("limit"), cut.alias("docs_cut"),
        (F.coalesce("total", F.lit(0)) - rest + F.col("at") * cut).alias("kept_tokens"))  # total is one row


def quantile(histogram: DataFrame, q: float) -> int:
    """The smallest length that at least the share q of the documents do not exceed; 0 without documents."""
    total = histogram.agg(F.sum("n_docs")).first()[0] or 0
    row = histogram.where(F.lit(total) - F.col("docs_from") + F.col("n_docs") >= q * total).agg(F.min("n_tokens")).first()
    return row[0] or 0
