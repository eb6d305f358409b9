"""Closures, components, search by cells and joins of near vectors, against brute force."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from recall_spark import catalogue
from recall_spark.operators import cells, graphs, search
from recall_spark.sources import tables as tb

SF = "/root/testdata/sf0.001"


def reached(edges, most=None, seeds=None):
    out = {}
    for s in {a for a, _ in edges if a is not None} if seeds is None else seeds:
        level, depth = {b for a, b in edges if a == s and b is not None}, 1
        while level and (most is None or depth <= most):
            for b in level:
                out.setdefault((s, b), depth)
            level = {b for a, b in edges if a in level and b is not None and (s, b) not in out}
            depth += 1
    return {(a, b, d) for (a, b), d in out.items()}


def test_closure(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 40, (45, 2))] + [(100, 101), (101, 102), (102, 100), (103, 103), (None, 4), (5, None)] + [(200 + i, 201 + i) for i in range(21)]
    df = spark.createDataFrame(edges + edges[:9], "from_id long, to_id long")
    assert {tuple(r) for r in graphs.closure(df).collect()} == reached(edges)
    assert {tuple(r) for r in graphs.closure(df, 2).collect()} == reached(edges, 2)
    seeds = spark.createDataFrame([(100,), (7,), (999,)], "from_id long")
    assert {tuple(r) for r in graphs.closure(df, None, seeds).collect()} == reached(edges, None, [100, 7])
    assert graphs.closure(df.limit(0)).count() == 0


def groups(pairs):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    return {(i, find(i)) for i in list(top)}


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2)) if a != b] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(1, 60)]
    got = {tuple(r) for r in graphs.components(spark.createDataFrame(pairs + pairs[:5], "a long, b long")).collect()}
    assert got == groups(pairs)
    words = spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "y"), ("z", "z")], "a string, b string")
    assert {tuple(r) for r in graphs.components(words).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    assert graphs.components(words.limit(0)).count() == 0


def test_recall_of_cells(spark, tmp_path):
    """Clustered and uniform vectors: enough of the nearest are found; all of them with all cells; vectors added later too."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    x = np.concatenate([centres[rng.integers(0, 30, 2_500)] + 0.3 * rng.normal(size=(2_500, 16)), rng.normal(size=(500, 16))])
    odd = [(-1, None, "r"), (-2, [1.0], "r"), (-3, [None] * 16, "r")]
    rows = [(i, v.tolist(), f"r{i % 3}") for i, v in enumerate(x)]
    schema = "memory_id long, embedding array<double>, repo_id string"
    v = spark.createDataFrame(rows[:2_900] + odd, schema)
    index = cells.Cells.build(v, f"file://{tmp_path}/index", cells=40)
    index.add(spark.createDataFrame(rows[2_900:], schema))
    again = cells.Cells(spark, f"file://{tmp_path}/index")
    assert again.probes == index.probes < 25 and (again.centres == index.centres).all() and again.vectors().count() == 3_003
    q = spark.createDataFrame([(i, (x[i] + 0.01).tolist(), f"r{i % 3}") for i in range(0, 3_000, 13)], "query_id long, embedding array<double>, repo_id string")
    whole = spark.createDataFrame(rows, schema)
    for k in (1, 5, 10, 50):
        assert again.recall(q, k) >= 0.9
    exact = {tuple(r) for r in search.top_k(whole, q, 7).select("query_id", "memory_id", "rank").collect()}
    assert {tuple(r) for r in again.top_k(q, 7, probes=40).select("query_id", "memory_id", "rank").collect()} == exact
    # Distances are exact whatever is searched, and scopes hold.
    near = again.top_k(q, 5, ("repo_id",)).collect()
    assert all(r["memory_id"] % 3 == r["query_id"] % 3 and abs(r["similarity"] - np.exp(-((x[r["memory_id"]] - x[r["query_id"]] - 0.01) ** 2).sum())) < 1e-8 for r in near)
    # Only the cells that are near are read.
    one = again.top_k(q.limit(1), 5, probes=2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+ IN \(\d+,\d+\)", plan)
    empty = cells.Cells.build(v.limit(0), f"file://{tmp_path}/none")
    assert empty.top_k(q, 3).count() == 0 and empty.recall(q.limit(0), 3) == 1.0


def test_search_approximate(spark):
    """At least 0.9 of what exact search finds for the same prompts."""
    prompts = catalogue._prompts(spark, SF)
    exact = {(r["query_id"], r["memory_id"]) for r in search.top_k(tb.vectors(spark, SF), prompts, 10).collect()}
    got = {(r["query_id"], r["memory_id"]) for r in catalogue.queries()["search_approximate"](spark, SF).collect()}
    assert len(got & exact) >= 0.9 * len(exact)


@pytest.mark.parametrize("least,cells_,block", [(0.97, 1, 2_048), (0.97, 9, 16), (0.85, 9, 2_048), (0.5, 4, 33)])
def test_near_groups(spark, monkeypatch, least, cells_, block):
    """No near pair is missed, wherever cells and blocks end; the oldest of a group stays; equal vectors are one."""
    monkeypatch.setattr(cells, "BLOCK", block)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 6))
    x = np.concatenate([base, base[rng.integers(0, 60, 140)] + rng.normal(size=(140, 6)) * rng.choice([0.02, 0.08, 0.2], 140)[:, None], np.repeat(base[:2], 40, axis=0)])
    rows = [(f"m{i:03d}", v.tolist(), int(1_000 - i % 37)) for i, v in enumerate(x)]
    v = spark.createDataFrame([r[:2] for r in rows] + [("n1", None), ("n2", [1.0])], "memory_id string, embedding array<double>")
    m = spark.createDataFrame([(i, t) for i, _, t in rows], "memory_id string, created_at long")
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    pairs = [(rows[a][0], rows[b][0]) for a, b in zip(*np.nonzero(np.exp(-d) >= least)) if a < b]
    members = {}
    for i, top in groups(pairs):
        members.setdefault(top, []).append(i)
    age = {i: (t, i) for i, _, t in rows}
    want = {(i, min(own, key=age.get)) for own in members.values() for i in own if i != min(own, key=age.get)}
    assert {tuple(r) for r in cells.near_groups(m, v, least, cells_).collect()} == want
    edges = cells.near_edges(v, least, cells.fitted(v, cells_))
    assert edges.count() < 4 * len(rows) * max(1, cells_)  # trees, not all pairs
    with pytest.raises(ValueError):
        cells.near_groups(m, v, 1.0)


def test_dedup_similar(spark):
    m = tb.memories(spark, SF).select("memory_id", "text", "created_at").collect()
    x = search.hashed([r["text"] for r in m]).astype(float)
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    pairs = [(m[a]["memory_id"], m[b]["memory_id"]) for a, b in zip(*np.nonzero(np.exp(-d) >= 0.97)) if a < b]
    members = {}
    for i, top in groups(pairs):
        members.setdefault(top, []).append(i)
    age = {r["memory_id"]: (r["created_at"], r["memory_id"]) for r in m}
    got = {tuple(r) for r in catalogue.queries()["dedup_similar"](spark, SF).collect()}
    assert got == {(i, min(own, key=age.get)) for own in members.values() for i in own if i != min(own, key=age.get)} and got
