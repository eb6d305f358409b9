"""Sessions as they are written: turns in the order of their times, near copies across batches, and an end by a timer.

A turn waits in the state of its session until the watermark has passed its time, so turns that come late, within the
watermark, are taken in their order. A turn that is as good as one that is kept is dropped, in whatever batch that one came.
When nothing has come for the gap, in the time of the turns, a timer ends the session: its end is given out and its state is
deleted, so that state holds what is open, not what has been. Later turns of the same session begin another.
in_batch() gives the same rows for turns that are all there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from recall_spark.functions import text as tx
from recall_spark.operators import capturing, search
from recall_spark.plans.store import Store
from recall_spark.sources import files as fl

#: The state store that timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: kind is item (a turn that is kept) or end; of an end, text is the transcript of its last turns and note the last words of
#: the assistant, both null where there are none; turns counts what was kept. Times are microseconds since 1970.
SCHEMA = "session_id string, kind string, began long, at long, line_no long, role string, text string, note string, turns long"
_OPEN = "began long, ended long, note string, turns long"


def _turns(lines: DataFrame, late: str | None) -> DataFrame:
    """session_id, line_no, role, text, at, us of lines (session_id, line_no, line, at); noise and secrets taken out, blank ones gone."""
    timed = lines if late is None else lines.withWatermark("at", late)
    text = tx.sanitised(tx.compressed(F.col("text")))
    return fl.transcript(timed, "at").withColumn("text", text).where("text <> '' and session_id is not null").withColumn("us", F.unix_micros("at")).where("us is not null")


class _Session(StatefulProcessor):
    """State of one session; embed: texts to vectors."""

    def __init__(self, gap_us: int, least: float, last: int, embed: Callable[[list[str]], np.ndarray]):
        self.gap, self.least, self.last, self.embed = gap_us, least, last, embed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, line_no long, role string, text string")
        self.kept = handle.getListState("kept", "line_no long, vector array<float>")
        self.tail = handle.getListState("tail", "line_no long, turn string")
        self.open = handle.getValueState("open", _OPEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000  # Spark drops what an earlier watermark has passed; this one counts
        new = [(int(u), int(n), r, t) for frame in rows for u, n, r, t in zip(frame["us"], frame["line_no"], frame["role"], frame["text"]) if u > passed]
        if new:
            self.waiting.appendList(new)
        for ms in {-(-u // 1000) for u, *_ in new}:
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All turns up to the watermark have come: the first timer that expires takes them, however many are due.
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        waiting = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        due, rest = [w for w in waiting if w[0] <= until], [w for w in waiting if w[0] > until]
        state = self.open.get() if self.open.exists() else None
        kept = [(r[0], np.array(r[1], np.float32)) for r in self.kept.get()] if self.kept.exists() else []
        tail = [tuple(r) for r in self.tail.get()] if self.tail.exists() else []
        out: list[tuple] = []

        def ended():
            turns = "\n\n".join(t for _, t in sorted(tail)[-self.last :])
            out.append((key[0], "end", state[0], state[1], None, None, turns, state[2], state[3]))

        for (us, line, role, text), vector in zip(due, self.embed([w[3] for w in due]) if due else ()):
            if state is not None and us - state[1] > self.gap:
                ended()
                state, kept, tail = None, [], []
            new = all(line != k for k, _ in kept) and not (vector.any() and any(np.exp(-((v - vector).astype(np.float64) ** 2).sum()) >= self.least for _, v in kept))
            began, _, note, turns = state or (us, us, None, 0)
            if new:
                kept.append((line, vector))
                tail = sorted([*tail, (line, f"{role}: {text}")])[-self.last :]
                out.append((key[0], "item", began, us, line, role, text, None, None))
                note = text if role == "assistant" else note
            state = (began, us, note, turns + new)
        if state is not None and until > state[1] + self.gap:
            ended()
            state, kept, tail = None, [], []
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if state is None:
            for held in (self.open, self.kept, self.tail):
                held.clear()
        elif due:
            self.open.update(state)
            self.kept.put([(n, v.tolist()) for n, v in kept])
            self.tail.put(tail) if tail else self.tail.clear()
            self.handle.registerTimer((state[1] + self.gap) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=["session_id", "kind", "began", "at", "line_no", "role", "text", "note", "turns"]).astype({"line_no": "Int64", "turns": "Int64"})

    def close(self) -> None:
        pass


def sessions(lines: DataFrame, late: str = "10 minutes", gap_seconds: int = 1800, least: float = capturing.COPY, last: int = 200,
    embed: Callable[[list[str]], np.ndarray] = search.hashed) -> DataFrame:
    """Items and ends (SCHEMA) of a stream of lines (session_id, line_no, line, at). The session's state store has to be PROVIDER.

    A turn whose line was kept before is the same turn again. A turn without words is like no other. Turns that come after
    the watermark has passed them are dropped."""
    rows = _turns(lines, late).select(F.col("session_id").cast("string").alias("session_id"), "line_no", "role", "text", "us", "at")
    return rows.groupBy("session_id").transformWithStateInPandas(statefulProcessor=_Session(gap_seconds * 1_000_000, least, last, embed), outputStructType=SCHEMA, outputMode="Append", timeMode="EventTime")


def in_batch(lines: DataFrame, gap_seconds: int = 1800, least: float = capturing.COPY, last: int = 200, embed=search.embedded) -> DataFrame:
    """What sessions() gives for these lines once all have ended, by windows and one fold for each session."""
    rows = _turns(lines, None).withColumn("session_id", F.col("session_id").cast("string")).dropDuplicates(["session_id", "line_no", "us"])
    order = Window.partitionBy("session_id").orderBy("us", "line_no")
    apart = F.coalesce(F.col("us") - F.lag("us").over(order) > gap_seconds * 1_000_000, F.lit(True))
    rows = rows.withColumn("nth", F.sum(apart.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # A line that came twice, at two times, counts once a session.
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("session_id", "nth", "line_no").orderBy("us")))
    bounds = rows.groupBy("session_id", "nth").agg(F.min("us").alias("began"), F.max("us").alias("ended"))
    named = rows.where("again = 1").select(F.struct("session_id", "nth").alias("session_id"), F.struct("us", "line_no").alias("place"), "role", "text")
    items = capturing.not_stored(named, embed(named.select(F.lit(0).cast("long").alias("memory_id"), "text").limit(0)), embed, least)
    items = items.select("session_id.*", "place.*", "role", "text").join(bounds, ["session_id", "nth"])
    turn: Column = F.struct("line_no", F.concat_ws(": ", "role", "text").alias("turn"))
    ends = items.groupBy("session_id", "nth").agg(F.array_sort(F.collect_list(turn)).alias("tail"),
        F.max_by("text", F.when(F.col("role") == "assistant", F.struct("us", "line_no"))).alias("note"), F.count("*").alias("turns"))
    text = F.array_join(F.transform(F.slice("tail", F.greatest(F.size("tail") - last, F.lit(0)) + 1, last), lambda t: t["turn"]), "\n\n")
    ends = ends.join(bounds, ["session_id", "nth"]).select("session_id", F.lit("end").alias("kind"), "began", F.col("ended").alias("at"), F.lit(None).cast("long").alias("line_no"), F.lit(None).cast("string").alias("role"), text.alias("text"), "note", "turns")
    return items.select("session_id", F.lit("item").alias("kind"), "began", F.col("us").alias("at"), "line_no", "role", "text", F.lit(None).cast("string").alias("note"), F.lit(None).cast("long").alias("turns")).unionByName(ends)


def notes(ends: DataFrame, branch: str | None = None) -> DataFrame:
    """session_id, text: what is remembered of each session that has ended with words of the assistant."""
    at = F.timestamp_micros("at").cast("timestamp_ntz")
    return ends.where("kind = 'end' and note is not null").select("session_id", tx.session_note(F.lit(branch), F.col("note"), at).alias("text"))


def into_store(rows: DataFrame, store: Store, repo: str, branch: str, checkpoint: str, extractor: capturing.Extractor | None = None, name: str = "sessions"):
    """Capture each session of a stream (SCHEMA) that has ended: what the extractor finds in its transcript, and its note.

    A batch is one transaction named after it, so a batch that is run again after a failure is stored once."""

    def batch(df: DataFrame, number: int) -> None:
        operation = f"{name} {number}"
        if store.done(operation):
            return
        ends = df.where("kind = 'end' and text <> ''").withColumn("session_id", F.concat_ws("@", "session_id", "began")).persist()
        try:
            if ends.limit(1).count():
                version = store.next_version()
                with store.transaction(operation, version):
                    store.capture_sessions(ends.select("session_id", "text"), repo, branch, version, extractor)
                    kept = notes(ends, branch).select(F.lit(repo).alias("repo_id"), F.lit(branch).alias("branch_name"), F.lit("conversation").alias("content_type"), "text")
                    store.create(kept, version)
        finally:
            ends.unpersist()

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
