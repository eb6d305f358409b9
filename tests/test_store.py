"""Writes of the store: whole or not at all, one call a version, and what is reported."""

import pytest
from pyspark.sql import functions as F

from recall_spark.functions import text as tx
from recall_spark.operators import maintenance, scopes
from recall_spark.plans import store as st

ROWS = "repo_id string, branch_name string, content_type string, text string, file_path string, depends_on array<string>"


@pytest.fixture
def store(spark, tmp_path):
    return st.Store(spark, f"file://{tmp_path}/store")


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([("r", "main", "code_snippet", "def f(): pass", "a.py", None), ("r", "main", "decision", "use spark", None, ["x1", "x2"]), ("r", "dev", "decision", "use spark", None, None)], ROWS)


class Broken(Exception):
    pass


def failing(monkeypatch, table, after=False):
    """Writes of this table fail, before or after its rows are there."""
    whole = st.Store._write

    def write(self, df, name):
        if name != table or after:
            whole(self, df, name)
        if name == table:
            raise Broken

    monkeypatch.setattr(st.Store, "_write", write)
    return lambda: monkeypatch.setattr(st.Store, "_write", whole)


def state(store):
    return (sorted(map(str, store.memories().select("memory_id", "text", "version", "stale", "deleted").collect())), sorted(map(str, store.vectors().select("memory_id", "repo_id").collect())), sorted(map(str, store.edges().collect())))


@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("table", ["vectors", "memories", "edges"])
def test_a_failed_write_leaves_nothing(store, rows, monkeypatch, table, after, tmp_path):
    mend = failing(monkeypatch, table, after)
    with pytest.raises(Broken):
        store.create(rows, 1)
    mend()
    assert store.transactions().count() == 0 and store.edges().count() == 0 and store._vectors().count() == 0
    assert not list((tmp_path / "store" / "_work").glob("*"))
    store.create(rows, 1)  # the same call, with the same version
    assert store.memories().count() == 3 and store.log().count() == 3 and store._vectors().count() == 3
    assert [tuple(r) for r in store.edges().select("to_id", "relationship_type").orderBy("to_id").collect()] == [("x1", "depends_on"), ("x2", "depends_on")]
    assert [tuple(r) for r in store.transactions().select("version", "operation").collect()] == [(1, "create")]


@pytest.mark.parametrize("fails", ["vectors", "edges", "commit"])
def test_a_failed_refresh_keeps_the_old(store, rows, monkeypatch, fails, spark):
    store.create(rows, 1)
    before = state(store)
    old = store.memories().where("branch_name = 'dev'").first()["memory_id"]
    change = spark.createDataFrame([(old, "use more spark")], "memory_id string, new_content string")
    if fails == "commit":
        whole = st.Store._commit
        monkeypatch.setattr(st.Store, "_commit", lambda self, operation: (_ for _ in ()).throw(Broken))
        mend = lambda: monkeypatch.setattr(st.Store, "_commit", whole)
    else:
        mend = failing(monkeypatch, fails)
    with pytest.raises(Broken):
        store.refresh(change, 2)
    mend()
    assert state(store) == before
    store.refresh(change, 2)
    assert sorted(r["text"] for r in store.memories().where("branch_name = 'dev'").collect()) == ["use more spark"]
    assert store.memories().count() == 3 and store.vectors().count() == 3


@pytest.mark.parametrize("fails", ["vectors", "edges", "changes", "hashes", "commits"])
def test_a_failed_index_run_is_repeated(spark, tmp_path, monkeypatch, fails):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def a():\n    return 1\n")
    store = st.Store(spark, f"file://{tmp_path}/store")
    mend = failing(monkeypatch, fails, True)
    with pytest.raises(Broken):
        store.index(f"file://{tmp_path}/src", "r", "main", 5, commit="c1")
    mend()
    assert store.last_commit("r", "main") is None and store.tracked_files().count() == 0
    assert [tuple(r) for r in store.index(f"file://{tmp_path}/src", "r", "main", 5, commit="c1").collect()] == [("a.py", "added", "indexed")]
    assert store.memories().count() == 1 and store.log().count() == 1 and store.last_commit("r", "main") == "c1" and store.tracked_files().first()["files"] == 1
    assert store.transactions().count() == 1  # all tables of a run are one transaction


def test_a_failed_capture_counts_nothing(store, spark, monkeypatch):
    items = spark.createDataFrame([("s", 0, "decision", "use spark for joins", ["a"])], "session_id string, place int, content_type string, text string, tags array<string>")
    mend = failing(monkeypatch, "memories")
    with pytest.raises(Broken):
        store.capture(items, "r", "main", 1)
    mend()
    assert [tuple(r) for r in store.capture(items, "r", "main", 1).collect()] == [("s", 1, 1)] and store._read("captures").count() == 1


def test_versions_are_taken_once(store, rows, spark, monkeypatch):
    store.create(rows, 4)
    for taken in (4, 3):
        with pytest.raises(st.VersionTaken):
            store.retag(store.memories(), ["t"], taken)
    # Another writer commits the version after this one has looked.
    other = st.Store(spark, store.path)
    whole = st.Store._commit

    def overtaken(self, operation):
        if self is store:
            other.retag(other.memories().where("branch_name = 'dev'"), ["other"], 5)
        whole(self, operation)

    monkeypatch.setattr(st.Store, "_commit", overtaken)
    with pytest.raises(st.VersionTaken):
        store.retag(store.memories(), ["mine"], 5)
    monkeypatch.setattr(st.Store, "_commit", whole)
    assert sorted(str(r["tags"]) for r in store.memories().collect()) == ["None", "None", "['other']"]
    store.retag(store.memories(), ["mine"], 6)
    assert {str(r["tags"]) for r in store.memories().collect()} == {"['mine']"}


def test_lost_processes_and_compaction(store, rows, monkeypatch, tmp_path, spark):
    store.create(rows, 1)
    mend = failing(monkeypatch, "edges")
    with pytest.raises(Broken):
        store.create(rows.withColumn("text", F.concat("text", F.lit("!"))), 2)
    mend()
    (tmp_path / "store" / "_work" / "left").mkdir(parents=True, exist_ok=True)
    store.tidy()
    assert not (tmp_path / "store" / "_work").exists()
    store.mark_indexed(spark.createDataFrame([("a.py", "1")], "path string, sha256 string"), "r", "main", 3)
    store.set_commit("r", "main", "c9", 4)
    store.delete(store.memories().where("branch_name = 'dev'"), 5, confirm=True)
    small = store.compact(f"file://{tmp_path}/small")
    assert small.log().count() == 2 and small._vectors().count() == 2 and small.edges().count() == 2
    assert small.last_commit("r", "main") == "c9" and small.tracked_files().first()["files"] == 1
    assert [tuple(r)[::2] for r in small.transactions().collect()] == [(5, "compact")]
    assert spark.read.parquet(f"file://{tmp_path}/small/memories").select("batch").distinct().count() == 1
    with pytest.raises(st.VersionTaken):
        store.compact(f"file://{tmp_path}/small")
    small.create(rows, 6)
    assert small.memories().count() == 3 and small.vectors().count() == 3


def test_rows_are_written_in_transactions_only(store, rows):
    with pytest.raises(RuntimeError):
        store._write(rows, "memories")


def test_audit(store, spark):
    store.audit("search", "r", "main", 7)
    store.audit("create", "r", "dev", 9)
    got = sorted(tuple(r) for r in spark.read.json(f"{store.path}/audit").select("ts", "tool", "repo", "branch").collect())
    assert got == [(7, "search", "r", "main"), (9, "create", "r", "dev")]


def test_report_of_secrets(spark, tmp_path):
    text = "é token: 'abcdefgh1' and AKIA" + "A1" * 8 + "\n\"API_KEY\" = \"0123456789\" bearer " + "x" * 20
    df = spark.createDataFrame([(1, text), (2, "nothing here"), (3, None), (4, ""), (5, "AKIA" + "B2" * 8)], "memory_id long, text string")
    got = [(r["memory_id"], r["rule"], (r["text"] or "")[r["begin"] : r["end"]]) for r in maintenance.findings(df).orderBy("memory_id", "begin").collect()]
    assert got == [(1, "assignment", "token: 'abcdefgh1'"), (1, "access key", "AKIA" + "A1" * 8), (1, "assignment", 'API_KEY" = "0123456789"'), (1, "bearer", "bearer " + "x" * 20), (5, "access key", "AKIA" + "B2" * 8)]
    assert [r["n"] for r in df.select(F.size(tx.findings(F.col("text"))).alias("n")).collect()][1:4] != [None]
    rows = spark.createDataFrame([("r", "main", "context", text, "p.txt"), ("r", "main", "context", "fine", None)], "repo_id string, branch_name string, content_type string, text string, file_path string")
    with pytest.raises(st.RejectedSecrets) as error:
        st.Store(spark, f"file://{tmp_path}/s", sanitise=False).create(rows, 1)
    assert {(r["rule"], r["file_path"]) for r in error.value.report} == {("assignment", "p.txt"), ("access key", "p.txt"), ("bearer", "p.txt")}
    assert "access key at 25-45" in str(error.value) and "A1A1" not in str(error.value)


def test_scope_from_folders(spark, tmp_path):
    folders = spark.createDataFrame([("/w/a", "ra", "main"), ("/w/a/sub/", "rs", "dev"), ("rel/x", "rr", "main"), ("/", "root", "main"), ("/w/a", "rz", "main")], "folder string, repo_id string, branch_name string")
    rows = [("/w/a/f.py", None, None, "ra"), ("/w/a/sub/deep/f.py", None, None, "rs"), ("/w/ab/f.py", None, None, "root"), ("/f.py", None, None, "root"), ("f.py", None, "rel/x/y", "rr"), ("f.py", None, None, None), (None, None, None, None), ("/w/a/f.py", "own", None, "own"), ("/w/a/f.py", None, "/w/a/sub", "rs")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "file_path string, repo_id string, repo_path string, want string, i int")
    got = scopes.placed(df, folders).orderBy("i").collect()
    assert [r["repo_id"] for r in got] == [r["want"] for r in got] and len(got) == len(rows)
    assert [r["branch_name"] for r in got[:3]] == ["main", "dev", "main"] and got[7]["branch_name"] is None
    store = st.Store(spark, f"file://{tmp_path}/s")
    memories = df.where("i < 4").select(F.lit("context").alias("content_type"), F.concat(F.lit("text "), "i").alias("text"), "file_path")
    store.create(memories, 1, folders)
    assert sorted((r["repo_id"], r["text"]) for r in store.memories().collect()) == [("ra", "text 0"), ("root", "text 2"), ("root", "text 3"), ("rs", "text 1")]
    with pytest.raises(ValueError):
        store.create(memories.withColumn("file_path", F.lit("no/where.py")), 2, folders.where("folder <> '/'"))


def test_a_store_without_memories(store, rows, spark):
    assert store.memories().count() == 0 and store.vectors().count() == 0 and store.rehydrated().count() == 0
    store.create(rows.limit(0), 1)
    store.delete(spark.createDataFrame([("x",)], "memory_id string"), 2, confirm=True)
    assert store.log().count() == 0 and store.next_version() == 3 and store.next_version(10) == 10
    with store.transaction("two calls", 3):
        store.create(rows.where("branch_name = 'dev'"), 3)
        store.set_commit("r", "dev", "c", 3)
    assert store.done("two calls") and not store.done("create ") and store.last_commit("r", "dev") == "c"
    assert set(store.log().columns) == set(st.Store(spark, store.path + "-none").log().columns)
