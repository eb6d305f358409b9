"""Queries that SQL doesn't express, against plain Python on the smallest tables."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recall_spark import catalogue
from recall_spark.operators import capturing, chunking, context, listing, maintenance, search
from recall_spark.sources import tables as tb

SF = "/root/testdata/sf0.001"
#: Expected weights, by hand.
WEIGHTS = {
    "coding": {"code_snippet": 1.0, "context": 0.7, "decision": 0.4, "relationship": 0.2}, "debugging": {"analysis": 1.0, "code_snippet": 0.7, "context": 0.4, "conversation": 0.2},
    "architecture": {"decision": 1.0, "analysis": 0.7, "context": 0.4, "summary": 0.2}, "testing": {"code_snippet": 1.0, "analysis": 0.7, "context": 0.4, "decision": 0.2},
    "review": {"code_snippet": 1.0, "decision": 0.7, "context": 0.4, "analysis": 0.2}, "general": {"context": 1.0, "decision": 0.7, "conversation": 0.4, "summary": 0.2},
}


def tokens(t):
    return (len(t) + 3) // 4


def embed(text, n=64):
    v = np.zeros(n, np.float32)
    for w in (text or "").lower().split():
        h = zlib.crc32(w.encode())
        v[h % n] += 1.0 if h & 0x10000 else -1.0
    return v / max(np.linalg.norm(v), 1e-12)


@pytest.fixture(scope="module")
def memories(spark):
    return {r["memory_id"]: r.asDict() for r in tb.derived(tb.memories(spark, SF)).collect()}


@pytest.fixture(scope="module")
def vectors(spark):
    return {r["memory_id"]: r.asDict() for r in tb.vectors(spark, SF).collect()}


@pytest.fixture(scope="module")
def prompts(memories, vectors):
    """For each prompt its intent, confidence and the hits of its scope: memory, similarity; nearest first."""
    labels = {}
    for v in vectors.values():
        labels.setdefault(v["label"], []).append(np.array(v["embedding"], float))
    names = ("coding", "debugging", "architecture", "testing", "review", "general")
    means = {names[k]: np.mean(m, axis=0) for k, m in labels.items() if k < 6}
    out = {}
    for q in vectors.values():
        if q["memory_id"] % 20:
            continue
        x = np.array(q["embedding"], float)
        cos = {n: float(x @ means[n] / np.linalg.norm(x) / np.linalg.norm(means[n])) for n in names if n in means}
        best = max(cos, key=cos.get)
        confidence = min(max(cos[best], 0.0), 1.0)
        near = sorted((round(float(((np.array(v["embedding"], float) - x) ** 2).sum()), 9), i) for i, v in vectors.items() if (v["repo_id"], v["branch_name"]) == (q["repo_id"], q["branch_name"]))
        out[q["memory_id"]] = (best if confidence >= 0.3 else "general", confidence, [(memories[i], math.exp(-d)) for d, i in near[:20]])
    return out


def scored(prompt, least=0.25):
    intent, _, hits = prompt
    rows = []
    for rank, (m, similarity) in enumerate(hits, 1):
        if similarity < least or m["stale"]:
            continue
        age = (tb.AS_OF - m["created_at"]) / 86400
        rows.append((-(0.6 * similarity + 0.3 * WEIGHTS[intent].get(m["content_type"], 0.1) + 0.1 * max(0.3, math.exp(-age / 60))), rank, m))
    return sorted(rows, key=lambda r: r[:2])


def block_of(prompt, skill_tokens=0):
    """block, entries, used, budget: graduated entries, each in the fullest form that fits."""
    rows = scored(prompt)
    if not rows:
        return None, 0, 0, 200
    budget = max(200, min(1200, int(800 * (0.3 - rows[0][0] * 0.9)))) - skill_tokens
    if budget <= 0:
        return None, 0, 0, 0
    lines, used = [], 0
    for minus, _, m in rows:
        mark = f"- [{m['content_type']}] "
        text = m["text"].strip()
        full = mark + (text if tokens(text) <= 300 else m["detailed"] or m["one_line"])
        line = mark + m["one_line"]
        forms = [full, f"{line} -- {m['file_path']}", line][0 if -minus >= 0.75 else 1 if -minus >= 0.55 else 2 if -minus >= 0.4 else 3 :]
        fitting = [f for f in forms if used + tokens(f) <= budget]
        if fitting:
            lines.append(fitting[0])
            used += tokens(fitting[0])
    return "\n".join(lines) or None, len(lines), used, budget


def test_adaptive_block(spark, prompts):
    got = {r["query_id"]: (r["block"], r["entries"], r["used"], r["budget"]) for r in catalogue.queries()["adaptive_block"](spark, SF).collect()}
    assert got == {q: block_of(p) for q, p in prompts.items()}


def test_legacy_block(spark, prompts):
    want = {}
    for q, (_, _, hits) in prompts.items():
        fitting = [m for m, s in hits if s >= 0.25 and not m["stale"]]
        lines, used = [], 0
        for m in fitting:
            if m["content_type"] in ("code_snippet", "relationship"):
                continue
            entry = f"- [{m['content_type']}] " + (m["text"].strip() if tokens(m["text"]) <= 200 else m["one_line"])
            if used + tokens(entry) <= 800:
                lines.append(entry)
                used += tokens(entry)
        for m in [m for m in fitting if m["content_type"] in ("code_snippet", "relationship")][:3]:
            entry = f"- [code] {m['one_line']} — {m['file_path']}:{m['line_start']}-{m['line_end']}"
            if used + tokens(entry) > 800:
                break
            lines.append(entry)
            used += tokens(entry)
        want[q] = ("\n".join(lines) or None, len(lines))
    got = {r["query_id"]: (r["block"], r["entries"]) for r in catalogue.queries()["legacy_block"](spark, SF).collect()}
    assert got == want


def chosen_skills(spark, budget):
    out = {}
    for s in sorted(tb.skills(spark, SF).collect(), key=lambda s: (-s["priority"], s["name"])):
        names, used, texts = out.setdefault(s["intent"], ([], 0, []))
        if used + s["token_count"] <= budget:
            out[s["intent"]] = (names + [s["name"]], used + s["token_count"], texts + [s["prompt"].strip()])
    return out


def test_select_skills(spark):
    got = {r["intent"]: (r["names"], r["used"], r["block"]) for r in catalogue.queries()["select_skills"](spark, SF).collect()}
    assert got == {i: (",".join(n), u, "\n".join(t) or None) for i, (n, u, t) in chosen_skills(spark, 500).items()}


def test_smart_block_and_message(spark, prompts):
    skills = {i: "\n".join(t) for i, (_, _, t) in chosen_skills(spark, 300).items()}

    def too_old(m):
        days = {"conversation": 30, "context": 20}.get(m["content_type"])
        return days and m["created_at"] < tb.AS_OF - days * 86400

    want = {}
    for q, (intent, confidence, hits) in prompts.items():
        block, n, used, budget = block_of((intent, confidence, [(m | {"stale": m["stale"] or too_old(m)}, s) for m, s in hits]), tokens(skills.get(intent, "")))
        both = "\n\n".join(x for x in (skills.get(intent), block) if x) or None
        want[q] = (intent, both, n, used, budget)
    got = {r["query_id"]: (r["intent"], r["block"], r["entries"], r["used"], r["budget"]) for r in catalogue.queries()["smart_block"](spark, SF).collect()}
    assert got == want
    messages = {r["query_id"]: (r["message"], r["tokens"]) for r in catalogue.queries()["inject_message"](spark, SF).collect()}
    head = "Relevant memories from previous sessions:\n"
    assert messages == {q: (head + b, tokens(head + b)) if b else (None, 0) for q, (_, b, *_) in want.items()}


def test_blocks_of_incomplete_memories(spark):
    """Null texts, paths, lines and summaries; a prompt without hits; skills that leave no room."""
    rows = [(1, 1, 0.9, 0.8, "decision", None, "one", None, None, None, None), (1, 2, 0.9, 0.6, "context", "t" * 9, None, None, None, 1, 2), (1, 3, 0.9, 0.5, "code_snippet", "c", "code", None, None, None, None), (1, 4, 0.9, 0.45, "code_snippet", "c", "code2", None, "a.py", None, 3), (1, 5, 0.2, 0.9, "context", "far", "far", None, None, None, None)]
    df = spark.createDataFrame(rows, "query_id long, rank int, similarity double, composite double, content_type string, text string, one_line string, detailed string, file_path string, line_start int, line_end int")
    asked = spark.createDataFrame([(1, 0), (2, 0), (3, 5000)], "query_id long, skill_tokens int")
    both = df.unionByName(df.withColumn("query_id", F.lit(3).cast("long")))
    got = {r["query_id"]: (r["block"], r["entries"], r["budget"]) for r in context.adaptive(both.where("similarity >= 0.25"), asked).collect()}
    assert got == {1: ("- [decision] \n- [context] \n- [code_snippet] code\n- [code_snippet] code2", 4, 816), 2: (None, 0, 200), 3: (None, 0, 0)}
    legacy = context.legacy(df, tb.PERSISTENT).collect()
    assert [r["block"] for r in legacy] == ["- [decision] \n- [context] ttttttttt\n- [code] code\n- [code] code2 — a.py"]


def test_summaries_of_ids(spark):
    df = spark.createDataFrame([(1, "decision", "a.py", "x"), (2, "context", None, "y" * 80), (3, "decision", "a.py", "z")], "memory_id long, content_type string, file_path string, one_line string")
    asked = spark.createDataFrame([(1, [3, 2, 9, 1]), (2, []), (3, [9])], "request_id int, ids array<long>")

    def got(**options):
        return {r["request_id"]: (r["summary"], r["token_count"], r["memories_included"]) for r in context.summarised(asked, df, **options).collect()}

    y = "- " + "y" * 80 + "\n"
    assert got()[1] == ("\n## a.py\n- z\n- x\n\n## unknown\n" + y, tokens("\n## a.py\n- z\n- x\n\n## unknown\n" + y), 4) and got()[2] == ("", 0, 0) and got()[3] == ("", 0, 1)
    assert got(budget=15)[1][0] == "\n## a.py\n- z\n- x\n\n## unknown\n"
    assert got(group_by="type")[1][0] == "\n## decision\n- z\n- x\n\n## context\n" + y and got(group_by="none")[1][0] == "- z\n" + y + "- x\n"


def test_near_dup_capture(spark, vectors):
    want = {}
    for i, v in vectors.items():
        if i % 20 == 0:
            x = np.array(v["embedding"], np.float32).astype(float)
            x[0] *= 1.01
            d, j = min((round(float(((np.array(u["embedding"], float) - x) ** 2).sum()), 9), j) for j, u in vectors.items() if (u["repo_id"], u["branch_name"]) == (v["repo_id"], v["branch_name"]))
            if math.exp(-d) >= 0.97:
                want[i + 1_000_000_000] = j
    assert {r["query_id"]: r["memory_id"] for r in catalogue.queries()["near_dup_capture"](spark, SF).collect()} == want


def kept_items(items, stored):
    """Items as if they were stored one after another, session by session."""
    out = set()
    sessions = {}
    for session, place, text in sorted(items):
        v = embed(text).astype(float)
        near = [math.exp(-float(((v - u) ** 2).sum())) for u in stored]
        if near and max(near) >= 0.97 and v.any():
            continue
        if v.any() and any(math.exp(-float(((v - u) ** 2).sum())) >= 0.97 for u in sessions.get(session, [])):
            continue
        sessions.setdefault(session, []).append(v)
        out.add((session, place))
    return out


def test_capture_unstored(spark):
    turns = [(r["conv_id"], r["turn"], r["text"] or "") for r in tb.table(spark, SF, "conversations").collect()]
    stored = [embed(t).astype(float) for c, n, t in turns if c % 2 == 0 and n % 2 == 0]
    items = turns + [(c, n + 1_000_000, t) for c, n, t in turns]
    got = {(r["session_id"], r["place"]) for r in catalogue.queries()["capture_unstored"](spark, SF).collect()}
    assert got == kept_items(items, [v for v in stored if v.any()]) and 0 < len(got) < len(items)


def test_items_are_dropped_one_after_another(spark):
    items = [("s", 1, "use spark for joins"), ("s", 2, "use Spark for  joins"), ("s", 3, ""), ("s", 4, ""), ("t", 1, "use spark for joins"), ("t", 2, "something else"), ("t", 3, None)]
    df = spark.createDataFrame(items, "session_id string, place int, text string")
    stored = search.embedded(spark.createDataFrame([(1, "something else")], "memory_id long, text string"))
    got = {(r["session_id"], r["place"]) for r in capturing.not_stored(df, stored).collect()}
    assert got == {("s", 1), ("s", 3), ("s", 4), ("t", 1), ("t", 3)}
    assert capturing.not_stored(df, stored.limit(0)).count() == 6


def test_known_summaries(spark, memories):
    fresh = {i: m for i, m in memories.items() if not m["stale"]}
    vectors = {i: embed(m["text"]).astype(float) for i, m in fresh.items()}
    got = {r["session_id"]: r["known"] for r in catalogue.queries()["known_summaries"](spark, SF).collect()}
    for i, m in fresh.items():
        if i % 20:
            continue
        x = embed(m["text"][:500]).astype(float)  # the beginning is asked for, whole texts are stored
        near = sorted((round(float(((v - x) ** 2).sum()), 9), j) for j, v in vectors.items())[:5]
        lines = [f"[{memories[j]['content_type']}] {memories[j]['one_line']}" for d, j in near if math.exp(-d) >= 0.85]
        assert got.get(f"m{i}", "") == "\n".join(lines)


def test_search_of_awkward_vectors(spark):
    rows = [(1, [1.0, 0.0], "r", "m"), (2, None, "r", "m"), (3, [1.0], "r", "m"), (4, [None, 1.0], "r", "m"), (5, [0.0, 1.0], "r", "d"), (6, [1.0, 0.0], "r", "m"), (7, [], "r", "m"), (8, [0.9, 0.1], None, None)]
    v = spark.createDataFrame(rows, "memory_id long, embedding array<double>, repo_id string, branch_name string")
    q = v.select(F.col("memory_id").alias("query_id"), "embedding", "repo_id", "branch_name")
    got = {(r["query_id"], r["memory_id"], r["rank"]) for r in search.top_k(v, q, 2, ("repo_id", "branch_name")).collect()}
    assert got == {(1, 1, 1), (1, 6, 2), (6, 1, 1), (6, 6, 2), (3, 3, 1), (5, 5, 1), (8, 8, 1)}
    assert search.top_k(v, q.limit(0), 2).count() == 0 and search.top_k(v.limit(0), q, 2).count() == 0


def test_search_in_blocks(spark, vectors, monkeypatch):
    v = tb.vectors(spark, SF)
    q = v.select(F.col("memory_id").alias("query_id"), "embedding")
    whole = sorted((r["query_id"], r["memory_id"], r["rank"]) for r in search.top_k(v, q, 3).collect())
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    assert sorted((r["query_id"], r["memory_id"], r["rank"]) for r in search.top_k(v, q, 3).collect()) == whole
    with pytest.raises(ValueError):
        search.similar(v, q, v, 51)


def test_no_exchange_of_embeddings(spark):
    """Neither the search nor the join with memories sends vectors or texts through a shuffle."""
    plan = catalogue.queries()["search_similar"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    moved = re.findall(r"Exchange hashpartitioning\(([^)]*)", plan)
    assert "BroadcastHashJoin" in plan and all("query_id" in m for m in moved)


def test_phrase_centroids(spark, memories, tmp_path):
    """Of a table, against means by hand; texts are classified by them; kept ones are read again until phrases change."""
    phrases = {}
    names = ("coding", "debugging", "architecture", "testing", "review", "general")
    for r in spark.read.parquet(f"{SF}/conversations.parquet").where("role = 'user'").collect():
        if (r["text"] or "").strip(" "):
            phrases.setdefault(names[r["conv_id"] % 6], set()).add(r["text"])
    want = {}
    for intent, texts in phrases.items():
        mean = np.mean([embed(p).astype(float) for p in texts], axis=0)
        want[intent] = mean / np.linalg.norm(mean)
    got = {r["intent"]: r for r in catalogue.queries()["phrase_centroids"](spark, SF).collect()}
    assert set(got) == set(want) and all(np.allclose(r["centroid"], want[i], atol=1e-6) and r["place"] == names.index(i) for i, r in got.items())
    for r in catalogue.queries()["classify_texts"](spark, SF).collect():
        v = embed(memories[r["query_id"]]["text"]).astype(float)
        cos = {i: float(v @ c) for i, c in want.items()}
        best = max(cos.values())
        assert abs(r["confidence"] - max(0, best)) < 1e-5
        assert r["intent"] in ([i for i, c in cos.items() if c > best - 1e-6] if best > 0.3 + 1e-6 else ["general"] + ([max(cos, key=cos.get)] if best > 0.3 - 1e-6 else []))
    own = spark.createDataFrame([("debugging", "the parser is broken"), ("zeta", "count sheep"), ("alpha", "count cats"), ("debugging", None), ("none", "  "), ("debugging", "the parser is broken")], "intent string, text string")
    kept = search.phrase_centroids(own, f"file://{tmp_path}")
    assert {r["intent"]: r["place"] for r in kept.collect()} == {"debugging": 1, "alpha": 6, "zeta": 7}
    before = sorted(tmp_path.iterdir())
    again = search.phrase_centroids(own.orderBy("text"), f"file://{tmp_path}")
    assert sorted(tmp_path.iterdir()) == before and again.count() == 3
    search.phrase_centroids(own.limit(1), f"file://{tmp_path}")
    assert len(list(tmp_path.iterdir())) == 2
    queries = search.embedded(spark.createDataFrame([(1, "the parser is broken again"), (2, ""), (3, "zebra"), (4, "count sheep")], "memory_id long, text string")).withColumnRenamed("memory_id", "query_id")
    found = {r["query_id"]: r["intent"] for r in search.classified(queries, again).collect()}
    assert found == {1: "debugging", 2: "general", 3: "general", 4: "zeta"}


def test_many_scopes(spark):
    """A search over hundreds of scopes gives what one search a scope gives, without looking at others' vectors; ties and copies by id."""
    rng = np.random.default_rng(3)
    rows = [(f"m{i:04d}", [float(x) for x in rng.integers(0, 3, 4)], f"r{i % 40}" if i % 41 else None) for i in range(2_000)]
    v = spark.createDataFrame(rows, "memory_id string, embedding array<double>, repo_id string").repartition(5)
    q = spark.createDataFrame([(i, rows[i][1], rows[i][2]) for i in range(0, 2_000, 9)] + [(9_999, [1.0] * 4, "none")], "query_id long, embedding array<double>, repo_id string")
    got = {}
    for r in search.top_k(v, q, 4, ("repo_id",)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["memory_id"]))
    for i in range(0, 2_000, 9):
        near = sorted((sum((a - b) ** 2 for a, b in zip(rows[i][1], e)), m) for m, e, s in rows if s == rows[i][2])[:4]
        assert sorted(got[i]) == [(n, m) for n, (_, m) in enumerate(near, 1)]
    assert 9_999 not in got


def test_scopes_prune_partitions(spark, tmp_path):
    rows = [(i, [float(i), 1.0], f"r{i % 6}") for i in range(60)]
    spark.createDataFrame(rows, "memory_id long, embedding array<double>, repo_id string").write.partitionBy("repo_id").parquet(f"file://{tmp_path}/v")
    v = spark.read.parquet(f"file://{tmp_path}/v")
    q = spark.createDataFrame([(1, [3.0, 1.0], "r3")], "query_id long, embedding array<double>, repo_id string")
    found = search.top_k(v, q, 2, ("repo_id",))
    assert [r["memory_id"] for r in found.orderBy("rank").collect()] == [3, 9]
    assert re.search(r"PartitionFilters: \[[^\]]*r3", found._jdf.queryExecution().executedPlan().toString())


def test_hashed_embed(spark, memories):
    for r in catalogue.queries()["hashed_embed"](spark, SF).collect():
        assert np.allclose(r["embedding"], embed(memories[r["memory_id"]]["text"]), atol=1e-6)


def test_index_repository(spark, memories):
    chunks = catalogue.queries()["index_repository"](spark, SF)
    want = sorted((f"src/f{i}.md", *c[:3]) for i, m in memories.items() if i % 17 and i % 19 and i % 4 == 0 and m["text"].strip() for c in chunking.text_chunks(m["text"]) if c[0].strip(" "))
    assert sorted((r["path"], r["chunk_text"], r["line_start"], r["line_end"]) for r in chunks.collect()) == want
    assert all(r["tags"] == ["indexed", "repository"] for r in chunks.select("tags").collect())


def packed(text, most, overlap):
    """Text of chunks, by the rules in words: sentences, packed; two repeated if short; long ones by lines."""
    parts = re.split(r"([.!?]\s+)", text)
    sentences = [a + b for a, b in zip(parts[::2], parts[1::2] + [""])]
    out, pack = [], []
    for s in [s for s in sentences if s]:
        if tokens(s) > most:
            out += ["".join(pack)] if pack else []
            pack, lines = [], []
            for line in s.split("\n"):
                if lines and sum(map(tokens, lines)) + tokens(line) > most:
                    out.append("\n".join(lines))
                    lines = []
                lines.append(line)
            out.append("\n".join(lines))
            continue
        if pack and sum(map(tokens, pack[1:] if isinstance(pack[0], int) else pack)) + tokens(s) > most:
            out.append("".join(pack))
            two = "".join(pack[-2:])
            pack = pack[-2:] if tokens(two) <= overlap else []
        pack.append(s)
    return out + (["".join(pack)] if pack or not out else [])


@pytest.mark.parametrize("most,overlap", [(500, 50), (4, 0), (40, 0)])
def test_text_chunks_in_words(memories, most, overlap):
    texts = ["", "one", "A. b! c? d", "x" * 5000 + "\n" + "y" * 3000 + ". z. w", "a. " * 50 + "b" * 300 + "\n" * 9 + "end"]
    for text in texts + [m["text"] for m in memories.values()][:30]:
        if overlap:
            continue
        assert [c[0] for c in chunking.text_chunks(text, most, overlap)] == packed(text, most, -1)
    if overlap:
        text = "".join(f"Sentence number {i} of many. " for i in range(200))
        chunks = [c[0] for c in chunking.text_chunks(text, most, overlap)]
        assert all(b.startswith("".join(re.findall(r"[^.]+\. ", a)[-2:])) for a, b in zip(chunks, chunks[1:])) and all(tokens(c) <= most + 60 for c in chunks)
        lines = "line one. \nline two. \n" * 300
        spans = [(c[1], c[2]) for c in chunking.text_chunks(lines)]
        assert spans[0][0] == 1 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_filters_by_each_column(spark, memories):
    m = tb.memories(spark, SF)
    cases = [({"content_type": "summary"}, lambda x: x["content_type"] == "summary"), ({"language": "de"}, lambda x: x["language"] == "de"), ({"repo": "src1", "branch": "dev"}, lambda x: (x["repo_id"], x["branch_name"]) == ("src1", "dev")), ({"function_name": "fn_1"}, lambda x: x["function_name"] == "fn_1"), ({"class_name": "Cls_1"}, lambda x: x["class_name"] == "Cls_1"), ({"path": "SRC/EN/F2"}, lambda x: x["file_path"].lower().startswith("src/en/f2")), ({"tags": ["en"]}, lambda x: "en" in x["tags"])]
    for options, ok in cases:
        for stale in (False, True):
            got = {r["memory_id"] for r in listing.filtered(m, include_stale=stale, **options).collect()}
            assert got == {i for i, x in memories.items() if ok(x) and (stale or not x["stale"])}
    assert [r["pos"] for r in listing.by_ids(m, [5, -1, 3]).orderBy("pos").collect()] == [0, 2]


def test_full_run_by_age():
    assert maintenance.needs_full_run(None, 100, 5) and maintenance.needs_full_run(0, 301, 5) and not maintenance.needs_full_run(0, 300, 5) and not maintenance.needs_full_run(0, 10**9, 0)
