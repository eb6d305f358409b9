"""Mixing sources to target weights by temperature.

A source with n tokens gets the weight n^a / sum of n^a. The exponent a lies between 1 (in proportion) and 0 (all
alike) and is found by repeated section: the largest that reaches a target entropy, given as a share of the
largest possible one, then raised as far as needed for no source to be repeated more than max_repeats times. The
weights times a budget of tokens are realised in passes: each pass over a source is a permutation of its
documents, drawn by a keyed hash; the last pass ends where the source's budget is met, at the end of the document
that meets it. A row's mix_key lies in [0, 1): any beginning of the mix in its order holds the sources at their weights.

Sums over a source are made in hash buckets, the more of them the more documents it has: only the bucket in which its
budget ends is ordered by row.

A null source is a source of its own. Documents without words (null, empty, blank texts) have 0 tokens and go
along in full passes; sources without a token get none. Repeated rows of one doc_id are separate documents with
one place; those without an id have places by their texts. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recall_spark.llm import textarrays as ta
from recall_spark.llm.common import only, save, small

ENTROPY = 0.995
MAX_REPEATS = 4.0
#: Documents of a source in one bucket, about, and the most buckets of a source.
BUCKET_ROWS, MOST_BUCKETS = 1_000, 1 << 22
SEED = 42
_SECTIONS, _ROUNDS = 32, 5


def _counted(batches):
    for batch in batches:
        counts = [ta.word_spans(part)[3] for _, part in ta.slices(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("source"), batch.column("nameless"),
            pa.array(np.concatenate(counts) if counts else [], pa.int64())], names=["doc_id", "source", "nameless", "n_tokens"])


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source, nameless (a hash of the text where there is no doc_id), n_tokens; a token is a word here."""
    nameless = F.when(F.col("doc_id").isNull(), F.xxhash64("text"))
    rows = only(docs, "doc_id", "source", "text").withColumns({"source": F.col("source").cast("string"), "nameless": nameless})
    return rows.mapInArrow(_counted, "doc_id long, source string, nameless long, n_tokens long")


def exponent(sources: DataFrame, budget: float, entropy: float = ENTROPY, max_repeats: float = MAX_REPEATS) -> float:
    """The exponent for a table of sources (tokens > 0). Sums over sources are made by Spark, for all sections at once."""
    count, fewest = sources.agg(F.count("*"), F.min("tokens")).first()
    if not count or count == 1:
        return 1.0
    log_n = F.log("tokens")

    def section(low: float, high: float, ok) -> float:
        """The largest exponent that is ok, if smaller ones are; low if none is."""
        for _ in range(_ROUNDS):
            points = [low + (high - low) * i / _SECTIONS for i in range(_SECTIONS + 1)]
            sums = sources.agg(*(x for a in points for x in (F.sum(F.exp(a * log_n)), F.sum(F.exp(a * log_n) * log_n)))).first()
            good = [ok(a, sums[2 * i], sums[2 * i + 1]) for i, a in enumerate(points)]
            if all(good):
                return high
            first_bad = good.index(False)
            if not first_bad:
                return low
            low, high = points[first_bad - 1], points[first_bad]
        return low

    def even_enough(a: float, s: float, t: float) -> bool:
        return math.log(s) - a * t / s >= entropy * math.log(count) - 1e-12

    def repeated_too_much(a: float, s: float, t: float) -> bool:
        return budget * fewest ** (a - 1) / s > max_repeats

    a = section(0.0, 1.0, even_enough)
    limit = section(0.0, 1.0, repeated_too_much)
    # Below limit some source is repeated too often (at limit itself too, so step just above it).
    return round(min(1.0, max(a, limit + (1 / _SECTIONS**_ROUNDS if limit > 0 else 0))), 9)


def mix(docs: DataFrame, budget: int | None = None, entropy: float = ENTROPY, max_repeats: float = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """doc_id, source, n_tokens, weight, pass, mix_key: a row for each time that a document is used.

    A budget of more than max_repeats times all tokens can't be met by any weights: it is an error."""
    place = F.pmod(F.xxhash64("doc_id", "source", "pass", F.lit(seed), "nameless"), F.lit(1 << 53)) / float(1 << 53)
    rows = save(word_counts(docs), "tokens")
    sources = save(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).where("tokens > 0"), "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget is None else budget
    if total and budget > max_repeats * total:
        raise ValueError(f"{total} tokens, each at most {max_repeats} times, don't make a budget of {budget}")
    a = exponent(sources, budget, entropy, max_repeats)
    scale = sources.agg(F.sum(F.exp(a * F.log("tokens")))).first()[0] or 1.0
    plan = (
        sources.withColumn("weight", F.exp(a * F.log("tokens")) / scale)
        .withColumn("share", F.col("weight") * budget / F.col("tokens"))
        .withColumn("passes", F.floor("share").cast("int"))
        .withColumn("rest", F.col("weight") * budget - F.col("passes") * F.col("tokens"))
        .withColumn("buckets", F.least(F.ceil(F.col("docs") / BUCKET_ROWS), F.lit(MOST_BUCKETS)))
    )
    plan = save(plan, "plan")
    joined = rows.join(small(plan.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # The last pass: tokens before each bucket, then rows only in the bucket where the budget ends.
    last = joined.withColumn("pass", F.col("passes")).withColumn("place", place).withColumn("bucket", (F.col("place") * F.col("buckets")).cast("int"))
    sums = last.groupBy("source", "bucket", "rest").agg(F.sum("n_tokens").alias("own"))
    before = sums.withColumn("before", F.sum("own").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.withColumn("before", F.coalesce("before", F.lit(0)))
    edge = save(before.where("before < rest").groupBy(F.col("source").alias("of")).agg(F.max("bucket").alias("edge"),
        F.max_by("before", "bucket").alias("before")), "edge")
    last = last.join(small(edge), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    inside = last.where("bucket < edge")
    at_edge = last.where("bucket = edge").withColumn("run",
        F.coalesce(F.sum("n_tokens").over(Window.partitionBy("source").orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding,
        -1)), F.lit(0)))
    partial = inside.unionByName(at_edge.where("before + run < rest").drop("run"))
    full = joined.where("passes > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1))).withColumn("place", place)
    columns = ["doc_id", "source", "n_tokens", "weight", "pass",
        ((F.col("pass") + F.col("place")) / F.greatest("share",
        F.col("pass") + 1.0 * (F.col("pass") < F.col("passes")).cast("int"))).alias("mix_key")]
    return full.select(*columns).unionByName(partial.select(*columns)).withColumn("mix_key", F.least("mix_key", F.lit(1 - 1e-12)))
