"""Bounds that hold whatever repeats: training samples, long white space, budgets; sentences in the query."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recall_spark.llm import common, exact_dedup, mixing, quality, queries, token_counts, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("text", ["plain words {} here", "always the same text"])
def test_samples_of_repeated_ids(spark, monkeypatch, text):
    """One labelled id on very many rows: no more rows are learned from than asked, equal ones once, and others too."""
    many = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.format_string(text.replace("{}", "%d"), *([F.col("id")] if "{}" in text else [])).alias("text"))
    others = spark.range(2, 402).select(F.col("id").alias("doc_id"), F.format_string("other text number %d", F.col("id")).alias("text"))
    docs = many.unionByName(others)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 402)], "doc_id long, quality int, toxic int")
    taken = {}
    monkeypatch.setattr(quality, "train", lambda p, u, prior: taken.update(p=len(p), u=len(u)))
    quality.learn(docs, labels, F.lit(True), train_docs=300)
    assert 0 < taken["p"] <= 300 and 0 < taken["u"] <= 300 and (taken["p"] == 300 or "{}" not in text)
    rows = []
    monkeypatch.setattr(toxicity, "_descend", lambda found, n: rows.extend(found) or (np.zeros(n), 0.0))
    toxicity.learn(docs, labels, train_docs=300)
    assert len(rows) == 300 and (len({r["toxic"] for r in rows}) == 2 or "{}" in text)


def test_samples_without_ids(spark, monkeypatch):
    """Rows without an id are drawn by their texts: some of them, not all or none."""
    docs = spark.range(4_000).select(F.when(F.col("id") < 400, F.col("id")).alias("doc_id"), F.format_string("text %d", F.col("id")).alias("text"))
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    taken = {}
    monkeypatch.setattr(quality, "train", lambda p, u, prior: taken.update(p=len(p), u=len(u)))
    quality.learn(docs, labels, F.lit(True), train_docs=200)
    assert taken == {"p": 100, "u": 200}
    assert common.lowest(spark.range(0).select(F.col("id").alias("h")), 3) == -(1 << 63)
    assert common.lowest(spark.createDataFrame([(5,), (5,), (None,), (7,), (9,)], "h long"), 2) == 7


def test_long_white_space(spark):
    """A text of a million blanks is counted; runs among words count as they do in short texts."""
    texts = [" " * 1_000_000, "\n" * 1_000_000, "a" + " " * 30_000 + "b", "\t \n" * 40_000 + "end", "x" * 1_000_000, "word " * 10]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.lengths(docs).collect()}
    encode = token_counts.encoding(token_counts.VOCABULARY).encode_ordinary
    assert got[2] == len(encode(texts[2])) and got[3] == len(encode(texts[3])) and got[5] == len(encode(texts[5]))
    # No two blanks of this vocabulary are one token, so a run has as many as it is long.
    assert got[0] == 1_000_000 // (2_000 // len(encode(" " * 2_000))) and got[1] >= 1_000


def test_budgets_that_cannot_be_met(spark):
    docs = spark.createDataFrame([(i, "four words are here", f"s{i % 2}") for i in range(40)], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="160 tokens"):
        mixing.mix(docs, budget=641, max_repeats=4)
    rows = mixing.mix(docs, budget=640, max_repeats=4).groupBy("doc_id").count().collect()
    assert {r["count"] for r in rows} == {4} and len(rows) == 40
    assert mixing.mix(docs.limit(0), budget=100).count() == 0


def test_offending_sentences_of_the_query(spark):
    """The query gives sentences with its scores: those that offending() finds, and documents without any have low scores."""
    got = queries.op4_toxicity(spark, SF).collect()
    docs = common.documents(spark, SF)
    model = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet").where(common.remainder("doc_id", 3) != 1))
    places = {}
    for r in toxicity.offending(docs, model).collect():
        places.setdefault(r["doc_id"], []).append((r["begin"], r["end"]))
    assert {r["doc_id"]: [(s["begin"], s["end"]) for s in r["offending"]] for r in got if r["offending"]} == places and places
    score = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all(abs(r["score"] - score[r["doc_id"]]) < 1e-12 for r in got)


@pytest.mark.parametrize("most", [64 << 20, 1 << 15])
def test_bitmap_of_repeated_fingerprints(spark, monkeypatch, most):
    """Where they can't be listed, the same groups come out, texts are aggregated before they move, and nothing is joined by them."""
    rows = [(i, f"Text {i % 700 if i < 2_000 else i}" if i % 97 else None) for i in range(4_000)] + [(9_000 + i, "hot" * 50) for i in range(1_500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = sorted(map(tuple, exact_dedup.exact_groups(docs).collect()))
    monkeypatch.setattr(exact_dedup, "LISTED", 0)
    monkeypatch.setattr(exact_dedup, "BITMAP_BYTES", most)
    plans = []
    kept = exact_dedup.save
    monkeypatch.setattr(exact_dedup, "save", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or kept(df, name))
    assert sorted(map(tuple, exact_dedup.exact_groups(docs).collect())) == want
    plan = dict(plans)["groups"]
    assert "Join" not in plan and plan.count("Exchange") - plan.count("Exchange RoundRobin") - plan.count("Exchange REPARTITION") <= 2
    bits = exact_dedup.bitmap(spark.createDataFrame([(5,), (1 << 40,), (5,)], "fingerprint long"), 3)
    assert int(np.unpackbits(bits).sum()) == 2 and np.unpackbits(bits)[5] == 1
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0
