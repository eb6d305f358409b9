"""Capture as one job: transcript, compression, what is known, extractor, copies, store; and the same from a stream."""

import json
import re
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from recall_spark import catalogue
from recall_spark.operators import capturing, search
from recall_spark.plans.store import Store
from recall_spark.streaming import capture, sessions
from streams import T0, line, provider, put  # noqa: F401

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have this module
SF = "/root/testdata/sf0.001"


def reply(*contents):
    return json.dumps([{"type": "decision", "content": c, "tags": ["t"]} for c in contents])


def test_replies_by_row(spark):
    sessions_ = spark.createDataFrame([(1, "one", ["[decision] k"], "h"), (2, "boom", None, None), (3, "none", [], ""), (4, "four", None, None)], "session_id long, text string, known array<string>, hint string").coalesce(1)
    told = []

    def extractor(asked):
        if any(text == "boom" for _, text in asked):
            raise RuntimeError("no model")
        return [None if text == "none" else json.dumps([{"content": f"{told}|{text}"}]) for told, text in asked]

    got = {r["session_id"]: r for r in capturing.replies(sessions_, extractor, "Base").collect()}
    assert {i: r["status"] for i, r in got.items()} == {1: "extracted", 2: "failed", 3: "passthrough", 4: "extracted"}
    assert json.loads(got[1]["reply"])[0]["content"] == "Base\n\nAlready stored (do NOT re-extract these):\n- [decision] k|Hint: h\n\none" and json.loads(got[4]["reply"])[0]["content"] == "Base|four"
    assert got[2]["error"] == "RuntimeError: no model" and "boom" in got[2]["prompt"] and got[1]["prompt"] is None and not told
    # Too few replies are a failure of the batch, not of the rows.
    short = capturing.replies(sessions_, lambda asked: ["[]"] * (1 if len(asked) == 1 else 0)).collect()
    assert {r["status"] for r in short} == {"extracted"}
    none = capturing.replies(sessions_.drop("known", "hint")).collect()
    assert {(r["status"], r["reply"]) for r in none} == {("passthrough", None)} and all(r["prompt"].startswith("Find the facts") for r in none)
    assert capturing.replies(sessions_.limit(0), extractor).count() == 0


def test_whole_job(spark, tmp_path):
    rows = [("s", 0, "user", "we take spark for joins"), ("s", 1, "assistant", "<system-reminder>x</system-reminder>agreed"), ("t", 0, "user", "fail please"), ("u", 0, "assistant", "hello")]
    lines = spark.createDataFrame([(s, n, json.dumps({"role": r, "content": t})) for s, n, r, t in rows] + [("v", 0, "broken")], "session_id string, line_no long, line string")
    asked = []

    def extractor(pairs):
        asked.extend(pairs)
        if any("fail" in t for _, t in pairs):
            raise RuntimeError("down")
        return [reply("spark for joins is decided", "spark for joins is decided", "Spark for joins is decided") if "spark" in t else None for _, t in pairs]

    store = Store(spark, f"file://{tmp_path}/store")
    texts = capturing.to_capture(lines)
    got = {r["session_id"]: tuple(r)[1:] for r in store.capture_sessions(texts, "r", "main", 1, extractor).collect()}
    assert {s: (v[0], v[3], v[4]) for s, v in got.items()} == {"s": ("extracted", 3, 1), "t": ("failed", 0, 0), "u": ("passthrough", 0, 0)}
    assert got["t"][1] == "RuntimeError: down" and got["s"][2] is None and got["u"][2].startswith("Find the facts")
    assert [(r["content_type"], r["text"], r["tags"]) for r in store.memories().collect()] == [("decision", "spark for joins is decided", ["t"])]
    # Again: all is stored already; in another branch it is not.
    assert {r["session_id"]: r["stored"] for r in store.capture_sessions(texts, "r", "main", 2, extractor).collect()} == {"s": 0, "t": 0, "u": 0}
    assert store.capture_sessions(texts.where("session_id = 's'"), "r", "dev", 3, extractor).first()["stored"] == 1
    assert store.transactions().count() == 3
    # Without an extractor nothing is stored and each session has a prompt.
    assert {(r["status"], r["stored"]) for r in store.capture_sessions(texts, "q", "main", 4).collect()} == {("passthrough", 0)}


def test_what_is_known_reaches_the_extractor(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.create(spark.createDataFrame([("r", "main", "decision", "user: we take spark for joins")], "repo_id string, branch_name string, content_type string, text string"), 1)
    texts = spark.createDataFrame([("s", "user: we take spark for joins"), ("t", "something else entirely")], "session_id string, text string")
    out = store.capture_sessions(texts, "r", "main", 2, lambda asked: [reply(told.replace("\n", " ")) for told, _ in asked])
    assert {r["session_id"]: r["extracted"] for r in out.collect()} == {"s": 1, "t": 1}
    told = sorted(r["text"] for r in store.memories().where("version = 2").collect())
    assert [("Already stored" in t, "[decision] user: we take spark for joins" in t) for t in told] == [(False, False), (True, True)]


def test_stream_into_a_store(spark, tmp_path, provider, monkeypatch):  # noqa: F811
    put(tmp_path / "in", "0.json", [line("s", 0, 0, "we take spark for joins"), line("s", 1, 5, "well said", "assistant"), line("e", 0, 9, "quiet")])
    put(tmp_path / "in", "1.json", [line("s", 2, 60, "We take SPARK for joins"), line("z", 0, 20_000, "x")])
    put(tmp_path / "in", "2.json", [line("z", 1, 60_000, "y")])

    def extractor(pairs):
        return [reply(*[t.split(": ", 1)[1] for t in text.split("\n\n") if "spark" in t]) for _, text in pairs]

    store = Store(spark, f"file://{tmp_path}/store")

    def go():
        stream = spark.readStream.schema(capture.LINES).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
        return sessions.into_store(sessions.sessions(stream), store, "r", "main", f"file://{tmp_path}/ck", extractor)

    # The first try fails after it has written, before it is committed; the restart runs the batch again.
    whole = Store._commit
    monkeypatch.setattr(Store, "_commit", lambda self, operation: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception, match="lost"):
        go().awaitTermination(240)
    monkeypatch.setattr(Store, "_commit", whole)
    assert go().awaitTermination(240)
    note = "## Session — 2024-01-01 00:01 [main]\n\nwell said"
    assert sorted((r["content_type"], r["text"]) for r in store.memories().collect()) == [("conversation", note), ("decision", "we take spark for joins")]
    got = {r["session_id"]: (r["status"], r["extracted"], r["stored"]) for r in store._read("sessions").collect()}
    assert got == {f"s@{T0 * 1_000_000}": ("extracted", 1, 1), f"e@{(T0 + 9) * 1_000_000}": ("extracted", 0, 0), f"z@{(T0 + 20_000) * 1_000_000}": ("extracted", 0, 0)}
    # The stream's result is that of one batch over all lines.
    lines = spark.read.schema(capture.LINES).json(f"file://{tmp_path}/in").where("session_id <> 'z'")
    batch = Store(spark, f"file://{tmp_path}/batch")
    ends = sessions.in_batch(lines).where("kind = 'end'")
    batch.capture_sessions(ends.select("session_id", "text"), "r", "main", 1, extractor)
    batch.create(sessions.notes(ends, "main").select(F.lit("r").alias("repo_id"), F.lit("main").alias("branch_name"), F.lit("conversation").alias("content_type"), "text"), 2)
    assert sorted(r["memory_id"] for r in batch.memories().collect()) == sorted(r["memory_id"] for r in store.memories().collect())


def test_capture_queries(spark):
    """By plain Python: transcripts of whole conversations, the extractor by rows, and a fold against documents and earlier items."""
    turns = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        if r["role"] in ("user", "assistant"):
            turns.setdefault(str(r["conv_id"]), []).append((r["role"], r["text"] or ""))
    texts = {r["session_id"]: r["text"] for r in capturing.to_capture(catalogue._lines(spark, SF), 10**9).collect()}
    for s, t in texts.items():
        plain = "\n\n".join(f"{role}: {text}" for role, text in turns[s])
        assert re.sub(r"\s+", "", t) == re.sub(r"\s+|[▓░█▌▐]{3,}|\.{6,}|={5,}>?", "", plain) or "```" in plain
    status, items = {}, []
    for s, t in texts.items():
        said = [x.removeprefix("user: ").strip() for x in t.split("\n\n") if x.startswith("user: ")]
        status[s] = "failed" if len(t) % 5 == 0 else "extracted" if said and len(t) % 7 else "passthrough"
        items += [] if status[s] != "extracted" else [(s, n, x) for n, x in enumerate(said) if x]
    got = {r["session_id"]: r["status"] for r in catalogue.queries()["capture_replies"](spark, SF).collect()}
    assert got == status and len(set(status.values())) == 3
    stored = search.hashed([r["text"] for r in catalogue.tb.memories(spark, SF).where("not stale").collect()]).astype(float)
    want, kept = set(), {}
    for s, n, x in sorted(items):
        v = search.hashed([x])[0].astype(float)
        like = np.concatenate([stored, np.array(kept.get(s, [])).reshape(-1, 64)])
        if not v.any() or np.exp(-((like - v) ** 2).sum(1)).max() < 0.97:
            kept.setdefault(s, []).append(v)
            want.add((s, n, "decision", x, "said"))
    assert {tuple(r) for r in catalogue.queries()["capture_job"](spark, SF).collect()} == want
    assert {"capture_job", "capture_replies"} <= set(catalogue.queries())
