"""Sessions in a stream: late, repeated and similar turns over several batches and a restart, against the batch result."""

import json
import random

from pyspark.sql import functions as F

from recall_spark.operators import search
from recall_spark.streaming import capture, sessions
from streams import T0, line, provider, put  # noqa: F401

def run(spark, folder, out, checkpoint, **options):
    stream = spark.readStream.schema(capture.LINES).option("maxFilesPerTrigger", 1).json(f"file://{folder}")
    rows = sessions.sessions(stream, "10 minutes", **options)
    query = rows.writeStream.format("parquet").option("path", f"file://{out}").option("checkpointLocation", f"file://{checkpoint}").trigger(availableNow=True).start()
    assert query.awaitTermination(240)


def plain(df):
    return sorted(tuple(r) for r in df.select("session_id", "kind", "began", "at", F.coalesce("line_no", F.lit(-1)).alias("n"), F.coalesce("role", F.lit("")).alias("r"), "text", F.coalesce("note", F.lit("")).alias("note"), F.coalesce("turns", F.lit(-1)).alias("t")).collect())


def test_stream_equals_batch(spark, tmp_path, provider):
    rng = random.Random(5)
    rows = []
    for s in ("a", "b", "c"):
        second = rng.randint(0, 50)
        for n in range(25):
            second += rng.choice([1, 5, 20, 20, 400])
            text = rng.choice(["use spark for joins", "Use Spark for joins", f"a thought number {rng.randint(0, 9)}", "???", f"unlike anything {s} {n}"])
            rows.append((second, line(s, n, second, text, rng.choice(["user", "assistant"]))))
    rows.sort(key=lambda r: r[0] + rng.randint(-200, 200))  # late, within the watermark
    rows = [r for _, r in rows]
    again = rows + [r for i, r in enumerate(rows) if i % 9 == 0]
    for i in range(0, len(rows), 15):
        put(tmp_path / "in", f"{i:03d}.json", rows[i : i + 15] + rows[max(0, i - 3) : i])  # and some again
    run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "ck", gap_seconds=300, last=4)
    # A restart goes on from the checkpoint; turns far ahead end all sessions.
    put(tmp_path / "in", "900.json", [line("z", 0, 100_000, "far ahead")])
    put(tmp_path / "in", "901.json", [line("z", 1, 200_000, "farther ahead")])
    run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "ck", gap_seconds=300, last=4)
    got = [r for r in plain(spark.read.parquet(f"file://{tmp_path}/out")) if r[0] != "z"]
    put(tmp_path / "all", "0.json", again)
    lines = spark.read.schema(capture.LINES).json(f"file://{tmp_path}/all")
    want = plain(sessions.in_batch(lines, 300, last=4))
    assert got == want
    ends = [r for r in want if r[1] == "end"]
    assert len(ends) > 3 and len([r for r in want if r[1] == "item"]) < len(rows)
    # By hand: one fold over the turns in order.
    vectors = {r["line"]: search.hashed([json.loads(r["line"])["content"]])[0] for r in rows}
    items, kept, last = set(), {}, {}
    for r in sorted(rows, key=lambda r: (r["at"], r["line_no"])):
        s, v = r["session_id"], vectors[r["line"]]
        at = __import__("datetime").datetime.fromisoformat(r["at"]).timestamp()
        if s not in last or at - last[s] > 300:
            kept[s] = []
        last[s] = at
        if not any(2.718281828459045 ** -float(((v - k) ** 2).sum()) >= 0.97 for k in kept[s]):
            kept[s].append(v)
            items.add((s, r["line_no"]))
    assert {(r[0], r[4]) for r in want if r[1] == "item"} == items


def test_near_copies_across_batches_and_the_end(spark, tmp_path, provider):
    put(tmp_path / "in", "0.json", [line("s", 0, 0, "use spark for joins"), line("s", 2, 60, "done, see notes", "assistant"), line("s", 5, 90, "token = 'abcdefgh12'")])
    put(tmp_path / "in", "1.json", [line("s", 3, 30, "an earlier thought"), line("s", 4, 120, "Use SPARK for joins")])
    put(tmp_path / "in", "2.json", [line("t", 0, 5_000, "another session"), line(None, 0, 5_000, "no session")])
    put(tmp_path / "in", "3.json", [line("s", 9, 100, "too late, long after the watermark"), line("t", 1, 9_000, "use spark for joins")])
    put(tmp_path / "in", "4.json", [line("t", 2, 50_000, "x")])
    put(tmp_path / "in", "5.json", [line("t", 3, 90_000, "y")])
    run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "ck", last=2)
    out = spark.read.parquet(f"file://{tmp_path}/out")
    s = [r for r in plain(out) if r[0] == "s"]
    assert [(r[1], r[4], r[6]) for r in s if r[1] == "item"] == [("item", 0, "use spark for joins"), ("item", 3, "an earlier thought"), ("item", 2, "done, see notes"), ("item", 5, "[REDACTED]")]
    assert [(r[3], r[6], r[7], r[8]) for r in s if r[1] == "end"] == [((T0 + 120) * 1_000_000, "user: an earlier thought\n\nuser: [REDACTED]", "done, see notes", 4)]
    # The same words in another session are kept; after the gap a session begins anew.
    t = [(r[1], r[2] // 1_000_000 - T0) for r in plain(out) if r[0] == "t"]
    assert t == [("end", 5_000), ("end", 9_000), ("end", 50_000), ("item", 5_000), ("item", 9_000), ("item", 50_000)]
    assert [r["text"] for r in sessions.notes(out, "main").collect()] == ["## Session — 2024-01-01 00:02 [main]\n\ndone, see notes"]


def test_state_ends_with_the_session(spark, tmp_path, provider):
    for i in range(6):
        put(tmp_path / "in", f"{i}.json", [line(f"s{i}", 0, i * 10_000, "some words"), line(f"s{i}", 1, i * 10_000 + 5, "other words")])
    stream = spark.readStream.schema(capture.LINES).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    query = sessions.sessions(stream).writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    states = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in (json.loads(x.json) for x in query.recentProgress) if p["stateOperators"]]
    assert states[-1] <= 2 * max(states[:3])
