"""Files and transcripts as data sources: what is never opened, tails, and streams that go on from their offsets."""

import json
import os

import pytest
from pyspark.sql import functions as F

from recall_spark.operators import capturing
from recall_spark.sources import datasource as ds
from recall_spark.sources import files as fl


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    spark.dataSource.register(ds.RepositoryFiles)
    spark.dataSource.register(ds.Transcripts)


@pytest.fixture
def tree(tmp_path):
    for name in ("a.py", "src/b.py", "src/deep/c.go", "src/[x]{y}*.py", "node_modules/n.py", ".git/objects/o.py", "src/build/p.py", "d.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    with open(tmp_path / "src" / "huge.bin", "wb") as f:
        f.truncate(3 << 30)  # larger than a file may be that Spark reads whole
    return tmp_path


def test_repository_files(spark, tree):
    def paths(**options):
        return sorted(r["path"] for r in spark.read.format("repository_files").options(**options).load(str(tree)).select("path").collect())

    assert paths() == ["a.py", "src/[x]{y}*.py", "src/b.py", "src/deep/c.go"]
    assert paths(patterns="**/*.go,*.txt") == ["d.txt", "src/deep/c.go"] and paths(maxFiles="2") == ["a.py", "src/[x]{y}*.py"]
    assert paths(ignored="src,.git") == ["a.py", "node_modules/n.py"] and paths(patterns="none") == []
    got = spark.read.format("repository_files").option("partitionBytes", "5").load(f"file://{tree}")
    want = {(r["path"], r["sha256"]) for r in fl.repository(spark, f"file://{tree}").collect()}
    assert {(r["path"], r["sha256"]) for r in got.collect()} == want and len(want) == 4
    assert got.rdd.getNumPartitions() > 2 and all(r["content"].decode() == r["path"] for r in got.collect())
    big = spark.read.format("repository_files").option("patterns", "**/*.bin").load(str(tree)).collect()
    assert [(r["path"], r["length"], r["content"]) for r in big] == [("src/huge.bin", 3 << 30, None)]


def test_ignored_folders_are_not_listed(tree, monkeypatch):
    """Nothing in them is looked at, so a folder that can't be read does no harm."""
    seen = []
    whole = ds.fs.FileSelector
    monkeypatch.setattr(ds.fs, "FileSelector", lambda path, **k: seen.append(os.path.relpath(path, tree)) or whole(path, **k))
    assert len(list(ds.listed(str(tree), fl.IGNORED))) == 6
    assert sorted(seen) == [".", "src", "src/deep"]


def test_spark_opens_only_what_is_wanted(spark, tree):
    """The reader for Spark's own file systems lists first: a large file and ignored folders are never opened."""
    os.chmod(tree / ".git" / "objects" / "o.py", 0)
    found = fl.repository(spark, f"file://{tree}")
    assert sorted(r["path"] for r in found.collect()) == ["a.py", "src/[x]{y}*.py", "src/b.py", "src/deep/c.go"]
    assert len(found.inputFiles()) == 4 and fl.repository(spark, f"file://{tree}", ("nothing",)).count() == 0


def line(i, text="t"):
    return json.dumps({"role": "user", "content": f"{text}{i}"})


def test_tails(spark, tmp_path, monkeypatch):
    """The last lines are those of the whole file, and only its end is read."""
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.jsonl").write_text("\n".join(line(i, "é" * 300) for i in range(5_000)))
    (tmp_path / "sub" / "b.jsonl").write_text(line(0) + "\n" + line(1) + "\n\n")
    (tmp_path / "c.jsonl").write_text("")
    (tmp_path / "d.jsonl").write_text("\n")
    (tmp_path / "e.txt").write_text("no transcript")
    rows = spark.read.format("transcripts").option("lines", "3").load(str(tmp_path))
    got = {}
    for r in rows.orderBy("session_id", "line_no").collect():
        got.setdefault(r["session_id"], []).append((r["line_no"], r["line"]))
    assert got == {"a": [(-3, line(4_997, "é" * 300)), (-2, line(4_998, "é" * 300)), (-1, line(4_999, "é" * 300))], "sub/b": [(-2, line(0)), (-1, line(1))]}
    assert capturing.to_capture(rows, 2).where("session_id = 'sub/b'").first()["text"] == "user: t0\n\nuser: t1"
    whole = (tmp_path / "a.jsonl").read_text().split("\n")
    files = ds.fs.LocalFileSystem()
    for step in (7, 100, 1 << 16):
        monkeypatch.setattr(ds, "STEP", step)
        for most in (1, 2, 40):
            assert ds.last_lines(files, str(tmp_path / "a.jsonl"), most) == whole[-most:]


def test_stream_of_new_lines(spark, tmp_path):
    """Whole lines as they come, each once, over restarts; a line without its end waits; a file written anew begins anew."""
    (tmp_path / "in").mkdir()
    a, b = tmp_path / "in" / "a.jsonl", tmp_path / "in" / "b.jsonl"

    def run():
        rows = spark.readStream.format("transcripts").load(f"{tmp_path}/in")
        q = rows.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return [(r["session_id"], r["line_no"], r["line"]) for r in spark.read.parquet(f"file://{tmp_path}/out").orderBy("session_id", "line_no", "line").collect()]

    a.write_text("one\ntwo\nthr")
    assert run() == [("a", 0, "one"), ("a", 4, "two")]
    with open(a, "a") as f:
        f.write("ee\n")
    b.write_text("x" * 3_000_000 + "\n\nlast\n")
    got = run()
    assert got[:3] == [("a", 0, "one"), ("a", 4, "two"), ("a", 8, "three")] and [(s, n, len(x)) for s, n, x in got[3:]] == [("b", 0, 3_000_000), ("b", 3_000_001, 0), ("b", 3_000_002, 4)]
    assert run() == got
    a.write_text("new\n")
    assert ("a", 0, "new") in run() and len(run()) == len(got) + 1


def test_registered_for_sql(spark, tree):
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW repo USING repository_files OPTIONS (path '{tree}', patterns '**/*.go')")
    assert spark.sql("SELECT path, length(content) AS n FROM repo").first()[:] == ("src/deep/c.go", 13)
    assert spark.table("repo").where(F.col("sha256").isNull()).count() == 0
