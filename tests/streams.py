"""Lines of transcripts as files for streams."""

import datetime
import json
import os

import pytest

from recall_spark.streaming import sessions

T0 = 1_704_067_200


def line(session, n, second, text, role="user"):
    return {"session_id": session, "line_no": n, "line": json.dumps({"role": role, "content": text}), "at": f"{second_text(second)}Z"}


def second_text(s):
    return datetime.datetime.fromtimestamp(T0 + s, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S")


@pytest.fixture
def provider(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, sessions.PROVIDER)
    yield
    spark.conf.set(key, before)


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))
    at = T0 + int(name.split(".")[0])  # files come in the order of their names
    os.utime(folder / name, (at, at))
