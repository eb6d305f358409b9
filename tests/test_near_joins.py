"""Joins of near vectors by boxes: few copies of a vector, none missed; the same hits as exact search."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from recall_spark import catalogue
from recall_spark.operators import capturing, cells, search

SF = "/root/testdata/sf0.001"


def spread(n, seed=3):
    """Vectors that spread in a few of many dimensions more than in the others, with near and equal ones."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 24)) * np.r_[2.0, 1.5, 1.2, np.full(21, 0.1)]
    x[n // 2 :] = x[: n - n // 2] + rng.normal(size=(n - n // 2, 24)) * 0.02
    x[: n // 20] = x[0]
    return x


def test_vectors_go_to_few_boxes(spark):
    """A vector goes to the boxes within the radius and to no other; old cells took nearly all of them (F1)."""
    x, radius = spread(3_000), 0.17
    boxes = cells.Boxes(x[::3], 32)
    p = boxes.projected(x)
    rows, where = boxes.within(p, radius)
    home = boxes.home(p)
    sent = set(zip(rows.tolist(), where.tolist()))
    assert {(i, int(h)) for i, h in enumerate(home)} <= sent and len(sent) < 4 * len(x)
    d = np.sqrt(((x[:, None, :] - x[None, :1_000, :]) ** 2).sum(2))
    for i, j in zip(*np.nonzero(d <= radius)):
        assert (int(i), int(home[j])) in sent
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None), (-2, [1.0, None]), (-3, [1.0])], "memory_id long, embedding array<double>")
    dealt = cells._placed(df, boxes, radius, onward=True).collect()
    assert len(dealt) < 2.5 * len(x) and {r["memory_id"] for r in dealt} == {*range(len(x)), -3}


@pytest.mark.parametrize("block,k,scoped", [(65_536, 1, ()), (700, 5, ()), (50, 3, ("repo", "branch"))])
def test_near_equals_exact_search(spark, monkeypatch, block, k, scoped):
    monkeypatch.setattr(cells, "BLOCK", block)
    x = spread(1_500)
    rows = [(i, v.tolist(), f"r{i % 3}", None if i % 2 else "b") for i, v in enumerate(x)]
    odd = [(9_001, None, "r1", "b"), (9_002, [1.0, 2.0], "r1", None), (9_003, [1.0, None], "r1", "b"), (9_004, [float("nan")] * 24, "r0", "b"), (9_005, [], "r0", "b")]
    v = spark.createDataFrame(rows + odd, "memory_id long, embedding array<double>, repo string, branch string")
    q = v.where("memory_id % 7 < 3 or memory_id > 9000").withColumnRenamed("memory_id", "query_id")
    exact = search.top_k(v, q, k, scoped).where("similarity >= 0.9").collect()
    got = cells.near(v, q, 0.9, k, scoped).collect()
    key = lambda r: (r["query_id"], r["rank"], r["memory_id"], round(r["similarity"], 8))
    assert sorted(map(key, got)) == sorted(map(key, exact)) and len(got) > 400
    assert cells.near(v.limit(0), q, 0.9, k, scoped).count() == cells.near(v, q.limit(0), 0.9, k, scoped).count() == 0


@pytest.fixture
def counted(spark, monkeypatch):
    """Vectors that count how often they are made, and searches in blocks of 20 queries."""
    monkeypatch.setattr(search, "QUERY_BLOCK", 20)
    made = spark.sparkContext.accumulator(0)

    def embed(texts):
        def run(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        return search.embedded(texts.select("memory_id", "text").mapInArrow(run, f"memory_id {texts.schema['memory_id'].dataType.simpleString()}, text string"))

    return embed, made


def test_items_and_stored_vectors_are_made_once(spark, counted):
    """Before, all stored vectors were made again for every block of items (F2, F3)."""
    embed, made = counted
    words = [f"w{i % 50} x{i % 7} y{i}" for i in range(400)]
    stored = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "memory_id long, text string")
    items = spark.createDataFrame([(f"s{i % 30}", i, w if i % 2 else f"{w} new thing {i * i}") for i, w in enumerate(words)], "session_id string, place int, text string")
    kept = capturing.not_stored(items, embed(stored), embed).select("place").collect()
    assert made.value <= 2 * (len(words) + 400)
    old, new = search.hashed(words).astype(float), search.hashed([r["text"] for r in items.orderBy("place").collect()]).astype(float)
    unlike = {i for i, v in enumerate(new) if math.exp(-((old - v) ** 2).sum(1).min()) < 0.97}
    assert {r["place"] for r in kept} <= unlike and 0 < len(kept) <= 200


def test_known_vectors_are_made_once(spark, counted):
    """Before, all stored vectors were made again for every block of sessions (F4)."""
    embed, made = counted
    words = [f"w{i % 50} x{i % 7} y{i}" for i in range(400)]
    memories = spark.createDataFrame([(i, w, "context", w, False) for i, w in enumerate(words)], "memory_id long, text string, content_type string, one_line string, stale boolean")
    sessions = spark.createDataFrame([(f"s{i}", w) for i, w in enumerate(words)], "session_id string, text string")
    known = {r["session_id"]: r["known"] for r in capturing.known_for(sessions, embed(memories.select("memory_id", "text")), memories, embed).collect()}
    assert made.value <= 2 * 800 and all(f"[context] {w}" in known[f"s{i}"] for i, w in enumerate(words))


def test_queries_of_many_cells_are_one_search(spark, tmp_path):
    """Before, a query took a place in a block for each cell that it asks for, so vectors were read once for every few queries (F5)."""
    x = spread(1_500)
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "memory_id long, embedding array<double>")
    index = cells.Cells.build(v, f"file://{tmp_path}/cells", 30)
    q = v.where("memory_id % 10 = 0").withColumnRenamed("memory_id", "query_id")
    found = index.top_k(q, 5, probes=20)
    assert found._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 1 and found.bound == 150 * 5
    want = {(int(i), n) for i in range(0, 1_500, 10) for n in np.lexsort((np.arange(1_500), np.round(((x - x[i]) ** 2).sum(1), 9)))[:5].tolist()}
    assert len({(r["query_id"], r["memory_id"]) for r in found.collect()} & want) >= 0.95 * len(want)


def test_sql_search_makes_no_pairs(spark):
    """Before, SQL joined every prompt with every vector of its scope, both vectors in each row (F6)."""
    df = catalogue.queries()["sql_nearest"](spark, SF)
    plan = df._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan and "squared_distance" not in plan and "zip_with" not in plan
    exact = search.top_k(catalogue.tb.vectors(spark, SF), catalogue._prompts(spark, SF), 3, ("repo_id", "branch_name"))
    assert {(r["query_id"], r["memory_id"], r["rank"]) for r in df.collect()} == {(r["query_id"], r["memory_id"], r["rank"]) for r in exact.collect()}


def shuffled(spark, what="shuffleWriteBytes"):
    """Bytes that all stages so far have written for others, or sent to the driver (resultSize)."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(getattr(stages.apply(i), what)() for i in range(stages.size()))


def brute_groups(x, least):
    """The least row that each hangs together with."""
    near = np.exp(-((x[:, None, :] - x[None, :, :]) ** 2).sum(2)) >= least
    top = np.arange(len(x))
    while True:
        new = np.where(near, top[None, :], len(x)).min(1)
        if (new == top).all():
            return top
        top = new


def test_near_vectors_move_once(spark, monkeypatch):
    """Before, a vector was sent to each box near it and to each block there: here 396 times the bytes of the vectors (F1 of round 4)."""
    monkeypatch.setattr(cells, "BLOCK", 128)
    monkeypatch.setattr(cells, "STORED", 64, raising=False)
    x = np.random.default_rng(8).normal(size=(4_000, 32)) * 0.04  # nearly all boxes lie within the radius of each
    v = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "memory_id long, embedding array<double>").repartition(4)
    m = spark.createDataFrame([(i, i) for i in range(len(x))], "memory_id long, created_at long")
    before = shuffled(spark)
    got = {r["memory_id"]: r["keep_id"] for r in cells.near_groups(m, v, 0.97).collect()}
    assert shuffled(spark) - before < 4 * x.nbytes
    top = brute_groups(x, 0.97)
    assert got == {i: t for i, t in enumerate(top.tolist()) if i != t} and 100 < len(got) < 3_900


@pytest.mark.parametrize("block,stored,kind", [(65_536, 8_192, "double"), (300, 100, "float"), (300, 7, "double")])
def test_crowds_and_odd_vectors(spark, monkeypatch, block, stored, kind):
    """Crowds in which all are near, chains from one to another, vectors of other widths; ones that are not finite hide none."""
    monkeypatch.setattr(cells, "BLOCK", block)
    monkeypatch.setattr(cells, "STORED", stored, raising=False)
    rng = np.random.default_rng(9)
    crowds = [c + rng.normal(size=(350, 12)) * 0.01 for c in rng.normal(size=(3, 12))]
    chain = np.linspace(crowds[0][0], crowds[1][0], 80)  # steps of less than the radius
    x = np.concatenate([*crowds, chain, rng.normal(size=(300, 12))]).astype(np.float32).astype(float)
    other = rng.normal(size=(40, 5)).repeat(2, 0) + np.tile([[0.0], [0.01]], (40, 1))
    other = other.astype(np.float32).astype(float)
    odd = [(9_000, [float("inf")] + [0.0] * 11), (9_001, [float("-inf")] + [0.0] * 11), (9_002, None), (9_003, [1.0, None]), (9_004, [float("nan")] * 12), (9_005, [])]
    rows = [(i, e.tolist()) for i, e in enumerate(x)] + [(5_000 + i, e.tolist()) for i, e in enumerate(other)] + odd
    v = spark.createDataFrame(rows, f"memory_id long, embedding array<{kind}>")
    m = spark.createDataFrame([(i, 7) for i, _ in rows], "memory_id long, created_at long")
    want = {i: t for i, t in enumerate(brute_groups(x, 0.97).tolist()) if i != t} | {5_000 + i: 5_000 + t for i, t in enumerate(brute_groups(other, 0.97).tolist()) if i != t}
    got = {r["memory_id"]: r["keep_id"] for r in cells.near_groups(m, v, 0.97).collect()}
    assert got == want and len(got) > 1_100


def test_equal_and_near_vectors_of_one_id(spark):
    """An id with two vectors, one of which another id has too, is joined by both; equal vectors hang on the smallest id."""
    one, two = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [("b", one), ("a", one), ("c", one), ("c", two), ("d", [0.0, 1.0, 0.01]), ("d", [0.0, 1.0, 0.01]), ("e", [5.0, 5.0, 5.0]), ("f", [])]
    edges = cells.near_edges(spark.createDataFrame(rows, "memory_id string, embedding array<float>"), 0.97)
    got = {tuple(sorted(r)) for r in edges.collect()}
    assert got - {("d", "d")} == {("a", "b"), ("a", "c"), ("c", "d")}


@pytest.mark.parametrize("equal", [False, True])
def test_samples_reach_the_driver_once(spark, equal):
    """Before, every task sent the driver as many vectors as the whole sample has, whatever the number of tasks (F1 of round 4)."""
    x = np.random.default_rng(11).normal(size=(8_000, 24))
    x = x[np.arange(len(x)) % 40] if equal else x
    v = spark.createDataFrame([(e.tolist(),) for e in x], "embedding array<double>").repartition(8)
    lowest = [r["embedding"] for r in v.orderBy(F.xxhash64("embedding")).limit(400).collect()]
    before = shuffled(spark, "resultSize")
    got = cells.sampled(v, 400)
    assert (got == np.unique(np.array(lowest), axis=0)).all() and (equal or shuffled(spark, "resultSize") - before < 3 * 400 * 24 * 8)
