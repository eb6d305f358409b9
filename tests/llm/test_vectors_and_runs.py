"""Exact top-k, whitening and periodic runs against brute force, and on nulls, odd values, ties, repeats and empty tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from recall_spark.llm import common, periodic, queries, topk, whitening

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def brute_top(rows, k, wanted):
    """By rows: (row number, vec_id, integers)."""
    out = []
    for r, i, x in rows:
        if not wanted(i):
            continue
        scores = sorted((-sum(a * b for a, b in zip(x, y)), j, s) for s, j, y in rows if s != r and len(y) == len(x))[:k]
        out += [(i, rank, j, -s) for rank, (s, j, _) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("block,first", [(16_384, 32), (7, 1), (64, 4)])
def test_top_k(spark, monkeypatch, block, first):
    """Ties, repeated rows and ids, zero queries, other lengths, unusable vectors, clashing columns."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "FIRST_DEPTH", first)
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.integers(-3, 4, 5)], 1, 2.0) for i in range(120)] + [(i, [0.0] * 5, 1, 2.0) for i in (120, 130)]
    rows += [(140, [1.0, 2.0], 1, 2.0), (150, [3.0, -1.0], 1, 2.0), (151, [0.5, 0.5], 1, 2.0), (3, [1.0] * 5, 1, 2.0), (10, [2.0] * 5, 1, 2.0), (10, [2.0] * 5, 1, 2.0)]
    odd = [(200, None, 1, 2.0), (210, [], 1, 2.0), (220, [1.0, None, 1.0, 1.0, 1.0], 1, 2.0), (230, [NAN] * 5, 1, 2.0), (240, [INF, 0.0, 0.0, 0.0, 0.0], 1, 2.0), (250, [1e300] * 5, 1, 2.0), (None, [1.0] * 5, 1, 2.0)]
    table = topk.quantised(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, row long, score double").repartition(3))
    kept = [(r["row"], r["vec_id"], r["x"]) for r in table.collect()]
    assert sorted((i, tuple(x)) for _, i, x in kept) == sorted((i, tuple(int(np.floor(256 * c)) for c in x)) for i, x, *_ in rows)
    got = sorted(tuple(r) for r in topk.nearest(table, table.where("vec_id % 10 = 0"), 4).collect())
    assert got == brute_top(kept, 4, lambda i: i % 10 == 0)
    assert topk.nearest(table.limit(0), table.limit(0)).count() == 0
    assert topk.nearest(table, table.where("vec_id < 0")).columns == ["query_id", "rank", "vec_id", "score"]


def test_top_k_in_blocks_of_queries(spark, monkeypatch):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    table = topk.quantised(v)
    whole = sorted(map(tuple, topk.nearest(table, table.where("vec_id % 7 = 0")).collect()))
    monkeypatch.setattr(topk, "QUERY_BLOCK", 11)
    assert sorted(map(tuple, topk.nearest(table, table.where("vec_id % 7 = 0")).collect())) == whole
    kept = [(r["row"], r["vec_id"], r["x"]) for r in table.collect()]
    assert whole == brute_top(kept, 5, lambda i: i % 7 == 0)


def test_threshold_stops_early():
    """Where a few components decide, few rows are scored; large integers stay exact."""
    rng = np.random.default_rng(2)
    x = (rng.pareto(1.5, (5_000, 8)) * 100).astype(np.int64)
    lists, none = topk.Lists(x, np.arange(5_000), np.arange(5_000)), (np.zeros(0, np.int64),) * 3
    query = np.array([9, 0, 0, 1, 0, 0, 0, 0])
    (scores, ids, _), scored = lists.best(query, -1, 5, none)
    assert scored < 1_000 and scores.tolist() == sorted((x @ query).tolist(), reverse=True)[:5] and (x[ids] @ query == scores).all()
    _, again = lists.best(query, -1, 5, (np.full(5, 10**9), np.arange(5), np.arange(5)))
    assert again <= 64  # known scores that the lists can't reach
    big = x + (1 << 29)
    lists = topk.Lists(big, np.arange(5_000), np.arange(5_000))
    assert lists.exact is np.int64
    assert lists.best(big[7], 7, 3, none)[0][0].tolist() == sorted((int(v) for i, v in enumerate(big @ big[7]) if i != 7), reverse=True)[:3]


def brute_white(vectors):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n = len(x)
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, x.sum(0))) for row in x]
    centred = x - x.mean(0)
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    return deviation, e / np.trace(cov), centred @ u / np.sqrt(e)


def same_white(got, vectors):
    deviation, explained, z = brute_white(vectors)
    k = len(explained)
    assert [r["deviation"] for r in got[::k]] == deviation and {r["n"] for r in got} == {len(vectors)}
    np.testing.assert_allclose([r["explained"] for r in got[:k]], explained, rtol=1e-9)
    out = np.array([r["whitened"] for r in got]).reshape(-1, k)
    sign = np.sign((out * z).sum(0))
    np.testing.assert_allclose(out, z * sign, atol=1e-6)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_whitening(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    got = queries.op12_embedding_whitening(spark, SF).orderBy("vec_id", "component").collect()
    assert [r["component"] for r in got[:8]] == list(range(1, 9))
    same_white(got, [r["embedding"] for r in rows])


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(c) for c in rng.normal(size=10) * np.arange(1, 11)], 1, 2) for i in range(200)]
    bad = [(900, None, 1, 2), (901, [], 1, 2), (902, [1.0] * 9 + [None], 1, 2), (903, [NAN] * 10, 1, 2), (904, [-INF] + [0.0] * 9, 1, 2), (905, [1.0, 2.0], 1, 2)]
    schema = "vec_id long, embedding array<float>, n long, component int"
    v = spark.createDataFrame(good + bad, schema).repartition(3)
    got = whitening.whitened(v, whitening.fit(v)).orderBy("vec_id", "component").collect()
    same_white(got, [np.array(g[1], np.float32) for g in good])
    none = v.where("vec_id >= 900 and vec_id < 905")
    assert whitening.whitened(none, whitening.fit(none)).count() == 0
    same = spark.createDataFrame([(i, [0.5, 0.25], 1, 2) for i in range(5)], schema)
    assert whitening.whitened(same, whitening.fit(same)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whitened(same, whitening.fit(same)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0], 1, 2) for i in range(9)], schema)
    assert {r["component"] for r in whitening.whitened(line, whitening.fit(line)).collect()} == {1}  # one direction only
    huge = spark.createDataFrame([(i, [1e6 * i, -1e6 * i * i, 3.0], 1, 2) for i in range(40)], schema)
    assert any(r["deviation"] is None for r in whitening.whitened(huge, whitening.fit(huge)).collect())


@pytest.mark.parametrize("kind", ["flat", "steep", "equal", "low rank"])
def test_lanczos(kind):
    """Breakdowns, restarts of a full basis, and eigenvalues that are equal."""
    rng = np.random.default_rng(6)
    d = 300
    u = np.linalg.qr(rng.normal(size=(d, d)))[0]
    e = {"flat": 1 + np.arange(d) / d, "steep": 2.0 ** -np.arange(d), "equal": np.repeat([5.0, 3.0, 1.0], 100), "low rank": np.r_[np.arange(3, 0, -1.0), np.zeros(d - 3)]}[kind]
    a = u * e @ u.T
    values, vectors, passes = whitening.lanczos(lambda v: a @ v, d, 8, block=8, widest=96)
    np.testing.assert_allclose(values, np.sort(e)[::-1][:8], atol=1e-12 * e.max())
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() < 1e-11 * e.max()
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-12
    assert passes < 100


def brute_runs(words):
    """Every lag, every stretch; the smallest period by trying all smaller ones."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if size >= max(12, 2 * q) and not any(all(words[t] == words[t + p] for t in range(i, i + size - p)) for p in range(1, q)):
                found[i, size] = q
            i = j + 1
    return sorted((s, size, p) for (s, size), p in found.items())


def library_runs(texts):
    numbers = {}
    ids = [np.array([numbers.setdefault((i, w), len(numbers)) for w in t], np.int64) for i, t in enumerate(texts)]
    counts = periodic.lag_counts(np.concatenate(ids), np.array([len(t) for t in texts]))
    for t, m in zip(texts, counts):
        assert m[1:].tolist() == [sum(a == b for a, b in zip(t, t[q:])) for q in range(1, len(t) // 2 + 1)]
    return [periodic.runs_of(i, m) for i, m in zip(ids, counts)]


def test_runs_of_words():
    rng = np.random.default_rng(8)
    texts = [[], ["a"], ["a"] * 11, ["a"] * 12, list("abc") * 4, list("abcdefghijk") * 2, list("aab") * 9 + ["c"] + list("aab") * 9]
    for kind in range(60):
        t = [str(v) for v in rng.integers(0, rng.integers(1, 6), rng.integers(1, 150))]
        if kind % 2:  # nested and neighbouring repeats
            unit = t[: rng.integers(1, 40)]
            t = t[:20] + unit * int(rng.integers(2, 9)) + unit[: len(unit) // 2] + t[20:40] * 2
        texts.append(t)
    texts.append((["a"] * 40 + ["b"]) * 5 + ["c"])
    texts.append([str(v) for v in rng.integers(0, 400, 90)] * 3 + [str(v) for v in rng.integers(0, 2, 100)])
    fib = ["a", "b"]
    while len(fib) < 300:
        fib.append(fib[-1] + fib[-2])
        if len(fib[-1]) > 300:
            break
    texts.append(list(fib[-1]))
    assert library_runs(texts) == [brute_runs(t) for t in texts]


def test_long_periods_and_long_texts():
    rng = np.random.default_rng(9)
    unit = [str(v) for v in rng.integers(0, 50, 3_000)]
    t = [str(v) for v in rng.integers(0, 50, 500)] + ["x"] + unit * 3 + unit[:700] + ["y"] + ["z"] * 400
    ids = np.unique(t, return_inverse=True)[1]
    got = periodic.runs_of(ids, periodic.lag_counts(ids, np.array([len(t)]))[0])
    assert (501, 9_700, 3_000) in got and (10_202, 400, 1) in got
    one = np.zeros(300_000, np.int64)
    assert periodic.runs_of(one, periodic.lag_counts(one, np.array([300_000]))[0]) == [(0, 300_000, 1)]
    two = np.tile(np.r_[np.zeros(20_000, np.int64), 1], 5)
    assert periodic.runs_of(two, periodic.lag_counts(two, np.array([len(two)]))[0])[:2] == [(0, 20_000, 1), (0, 100_005, 20_001)]


def test_periodic_query(spark):
    """The query against plain Python on whole texts, with the rewriting that it asks for."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000").collect()
    want = {}
    for r in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        gone = {i for s, size, p in runs for i in range(s + p, s + size)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        lines = "".join(f"{s},{size},{p}\n" for s, size, p in runs)
        want[r["doc_id"]] = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, SF).collect() if r["doc_id"] in want}
    assert got == want and any(v[0] for v in want.values())


def test_periodic_odd_rows(spark):
    rows = [(1, None, "r"), (2, "", "r"), (3, " \n\t\v\f\r ", "r"), (4, "a " * 200_000, "r"), (5, "é x\x1c b " * 6, "r"), (5, "é x\x1c b " * 6, "r"), (None, "q\t" * 12, "r"), (6, "w" * 300_000, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.find(docs).collect())
    assert got == [(0, 12, [(0, 12, 1)], "q"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 200_000, [(0, 200_000, 1)], "a"), *[(5, 12, [(0, 12, 2)], "é x\x1c b")] * 2, (6, 1, [], "w" * 300_000)]
    out = {r["doc_id"]: r for r in periodic.digest(periodic.find(docs)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (out[1]["n_runs"], out[1]["start"], out[1]["exponent_milli"], out[1]["runs_sha256"], out[1]["collapsed_sha256"]) == (0, None, None, empty, empty)
    assert (out[5]["start"], out[5]["length"], out[5]["period"], out[5]["exponent_milli"]) == (0, 12, 2, 6000)
    assert periodic.digest(periodic.find(docs.limit(0))).count() == 0


def test_rewriting_leaves_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, None)], "doc_id long, text string")
    assert [r["text"] for r in queries._made_periodic(docs).collect()] == ["a b c d", None]
    assert common.documents(spark, SF).count() == queries.op13_periodic_runs(spark, SF).count()
