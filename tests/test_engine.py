"""The parts of the memory engine that SQL doesn't express."""

import pytest
from pyspark.sql import functions as F

from recall_spark.functions import text as tx
from recall_spark.operators import capturing, chunking, context, indexing, maintenance
from recall_spark.plans.store import Skills, Store
from recall_spark.sources import files as fl
from recall_spark.streaming import capture


def test_compression(spark):
    fence = "```py\n" + "\n".join(f"line{i}" for i in range(50)) + "\n```"
    cases = {"": "", "a\n\n\n\nb": "a\n\nb", "x<system-reminder>y</system-reminder>z": "xz", "p ░░░░ q": "p  q", "```\na\n```": "```\na\n```"}
    df = spark.createDataFrame([(k,) for k in [*cases, fence]], "t string").select("t", tx.compressed(F.col("t")).alias("c"))
    got = {r["t"]: r["c"] for r in df.collect()}
    assert {k: got[k] for k in cases} == cases
    noise = {
        "a\nassistant: <tool_use>x\ny</tool_use>b": "a\nb", "a<tool_result>\n</tool_result>b": "ab", "a<tool_use>open": "a<tool_use>open", "1 =====> 2 ==== 3 ...... 4 ..... █▌▐ 5": "1  2 ==== 3  4 .....  5",
        "Relevant memories from previous sessions:\n- [decision] a\n- [code] b — c\nrest": "rest", "Relevant memories from previous sessions:\nno list": "Relevant memories from previous sessions:\nno list",
    }
    df = spark.createDataFrame([(k,) for k in noise], "t string").select("t", tx.compressed(F.col("t")).alias("c"))
    assert {r["t"]: r["c"] for r in df.collect()} == noise
    assert "line0" in got[fence] and "line49" in got[fence] and "line25" not in got[fence] and "lines omitted" in got[fence]


def test_chunks_of_python_and_text():
    found = list(chunking.python_chunks("@deco\nclass A(B):\n    def f(self):\n        'doc'\n\ndef g(x):\n    return x\n"))
    assert [(c[3], c[4], c[5], c[6], c[7]) for c in found] == [("class", "A", "B", None, ["deco"]), ("function", "g", None, None, []), ("method", "f", None, "doc", [])]
    assert chunking.chunks_of("def broken(", "python")[0][3] == "text"
    assert [c[4] for c in chunking.chunks_of("package a\nfunc F(x int) int {\n  if x > 0 { return 1 }\n  return 2\n}\n", "go")] == ["F"]
    text = "One two three. " * 400 + "tail"
    parts = [c[0] for c in chunking.text_chunks(text)]
    assert parts[-1].endswith("tail") and all(chunking.tokens(p) <= chunking.MAX_TOKENS for p in parts)


def test_packing_skips_what_does_not_fit(spark):
    rows = [(1, 1, 0.9, 0.9, "a" * 400, "one", None, "p", "decision"), (1, 2, 0.8, 0.8, "b" * 4000, "two", None, "q", "decision"), (1, 3, 0.2, 0.2, "c", "three", None, "r", "decision")]
    df = spark.createDataFrame(rows, "query_id long, rank int, similarity double, composite double, text string, one_line string, detailed string, file_path string, content_type string")
    r = context.adaptive(df, base=100, least=108, most=108).collect()[0]
    assert r["entries"] == 2 and r["used"] == 108 and r["budget"] == 108  # the second only as its line
    r = context.adaptive(df).collect()[0]
    assert r["block"] == "- [decision] " + "a" * 400 + "\n- [decision] two" and r["budget"] == 800 * (0.3 + 0.9 * 0.9) // 1


def test_store_life_cycle(spark, tmp_path):
    """Write, search, mark stale, retag, refresh, link, expire and delete."""
    store = Store(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([("r", "main", "code_snippet", "def f(): pass", "a.py", None), ("r", "main", "decision", "use spark for all joins", None, ["x1"]), ("r", "dev", "decision", "use spark for all joins", None, None)], "repo_id string, branch_name string, content_type string, text string, file_path string, depends_on array<string>")
    store.create(rows, 1)
    assert store.vectors().count() == 3 and {(r["to_id"], r["relationship_type"]) for r in store.edges().collect()} == {("x1", "depends_on")}
    asked = spark.createDataFrame([(1, "use Spark for all joins", "r", "main"), (2, "use spark for all joins", "q", "main"), (3, "", "r", "main")], "query_id long, text string, repo_id string, branch_name string")
    found = store.search(asked, least=0.9).collect()
    assert [(r["query_id"], r["content_type"], r["branch_name"]) for r in found] == [(1, "decision", "main")]
    assert store.search(asked, least=0.9, cross_branch=True).count() == 2
    store.mark_stale(spark.createDataFrame([("a.py",)], "path string"), "abcdef1234", 2)
    assert {(r["content_type"], r["stale"]) for r in store.memories().collect()} == {("code_snippet", True), ("decision", False)}
    for bad in (rows.withColumn("content_type", F.lit("nonsense")), rows.withColumn("text", F.lit(" ")), rows.withColumn("text", F.lit(None).cast("string")), rows.withColumn("content_type", F.lit(None).cast("string"))):
        with pytest.raises(ValueError):
            store.create(bad, 3)
    assert store.memories().count() == 3
    on_main = store.memories().where("content_type = 'decision' and branch_name = 'main'")
    store.retag(on_main, ["x"], 4)
    assert store.memories().where("content_type = 'decision' and branch_name = 'main'").first()["tags"] == ["x"]
    old = on_main.first()["memory_id"]
    store.refresh(spark.createDataFrame([(old, "use broadcasts for small sides")], "memory_id string, new_content string"), 5)
    new = store.rehydrated().where("content_type = 'decision' and branch_name = 'main'").collect()
    assert [(r["text"], r["tags"], r["depends_on"], r["related_to"]) for r in new] == [("use broadcasts for small sides", ["x"], ["x1"], [])] and new[0]["memory_id"] != old
    assert store.search(asked, least=0.9).count() == 0 and old not in {r["memory_id"] for r in store.vectors().collect()}
    store.refresh(spark.createDataFrame([(new[0]["memory_id"], ["y", "z"])], "memory_id string, tags array<string>"), 6)
    assert store.memories().where(F.col("memory_id") == new[0]["memory_id"]).first()["tags"] == ["y", "z"]
    with pytest.raises(ValueError):
        store.refresh(spark.createDataFrame([(new[0]["memory_id"],)], "memory_id string"), 7)
    with pytest.raises(ValueError):
        store.delete(on_main, 7)
    store.delete(store.memories().where("content_type = 'decision'"), 7, confirm=True)
    assert store.memories().count() == 1 and store.vectors().count() == 1
    # Created anew, a deleted memory has its vector again, once.
    store.create(rows, 8)
    assert store.memories().count() == 3 and store.vectors().count() == 4 - 1
    assert store.compact(f"file://{tmp_path}/compact").memories().count() == 3


def test_names_that_look_like_numbers(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.create(spark.createDataFrame([("007", "1.0", "context", "one two")], "repo_id string, branch_name string, content_type string, text string"), 1)
    assert [(r["repo_id"], r["branch_name"]) for r in store.memories().collect()] == [("007", "1.0")]
    asked = spark.createDataFrame([(1, "one two", "007", "1.0"), (2, "one two", "7", "1.0")], "query_id long, text string, repo_id string, branch_name string")
    assert [r["query_id"] for r in store.search(asked).collect()] == [1]


def test_secrets_are_screened(spark, tmp_path):
    rows = spark.createDataFrame([("r", "main", "context", "the password = 'hunter2hunter2' is set")], "repo_id string, branch_name string, content_type string, text string")
    store = Store(spark, f"file://{tmp_path}/a")
    store.create(rows, 1)
    assert "hunter2" not in store.memories().first()["text"]
    with pytest.raises(ValueError):
        Store(spark, f"file://{tmp_path}/b", sanitise=False).create(rows, 1)


def test_capture_and_summaries(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    items = spark.createDataFrame([("s", 0, "decision", "use spark for joins", ["a"]), ("s", 1, "context", "use Spark for joins", []), ("t", 0, "summary", "all is well", [])], "session_id string, place int, content_type string, text string, tags array<string>")
    assert {tuple(r) for r in store.capture(items, "r", "main", 1).collect()} == {("s", 2, 1), ("t", 1, 1)}
    assert {tuple(r) for r in store.capture(items, "r", "main", 2).collect()} == {("s", 2, 0), ("t", 1, 0)}
    assert store.capture(items.where("session_id = 't'"), "r", "dev", 3).first()["stored"] == 1
    ids = [r["memory_id"] for r in store.memories().where("branch_name = 'main'").orderBy("text").collect()]
    asked = spark.createDataFrame([(1, ids, None), (2, None, "One. Two. " * 99)], "request_id int, ids array<string>, text string")
    got = {r["request_id"]: (r["summary"], r["memories_included"]) for r in store.summarise(asked, "r", "main", 4, budget=20).collect()}
    assert got == {1: ("\n## unknown\n- all is well\n- use spark for joins\n", 2), 2: ("One. Two. " * 7 + "One. Two.", 0)}
    assert store.memories().where("content_type = 'summary' and branch_name = 'main'").count() == 3
    with pytest.raises(ValueError):
        store.summarise(asked.where("request_id > 2").union(spark.createDataFrame([(3, None, "")], asked.schema)), "r", "main")
    store.expire(40 * 86_400, 5, context_days=1)
    assert store.memories().where("content_type = 'context'").count() == 0


def test_skills(spark, tmp_path):
    skills = Skills(spark, f"file://{tmp_path}/skills")
    assert skills.all().count() == 0 and skills.get("a") is None
    assert skills.create("my skill!", "coding", "Do it well.", 1, 3, ("t",)) == "myskill"
    skills.create("b_2", "coding", "x" * 400, 2)
    skills.create("myskill", "testing", "Do it better.", 3)
    assert [(r["name"], r["intent"], r["token_count"]) for r in skills.all().collect()] == [("b_2", "coding", 100), ("myskill", "testing", 4)]
    assert skills.delete("b_2", 4) and not skills.delete("b_2", 5) and skills.get("b_2") is None
    for name, prompt in (("!?", "x"), ("ok", " ")):
        with pytest.raises(ValueError):
            skills.create(name, "coding", prompt, 6)


def test_skill_files(spark, tmp_path):
    texts = {"a": "prompt: ' Be brief '\nintent: coding\npriority: '2'\ntags: [x, 1]", "b": "- no\n- mapping", "c": "prompt: '  '", "d": "prompt: [", "e": "prompt: p\npriority: high", "f": "prompt: q\nname: named\ntoken_count: 99"}
    for name, text in texts.items():
        (tmp_path / f"{name}.yaml").write_text(text)
    (tmp_path / "g.txt").write_text("prompt: not yaml")
    got = {tuple(map(str, r)) for r in fl.skill_files(spark, f"file://{tmp_path}").collect()}
    assert got == {("a", "coding", "2", " Be brief ", "['x', '1']", "3"), ("named", "general", "0", "q", "[]", "1")}


def test_incremental_index(spark, tmp_path):
    src = tmp_path / "src"
    for folder in ("node_modules", "vendor", ".hg"):
        (src / folder).mkdir(parents=True)
        (src / folder / "c.py").write_text("def c(): pass\n")
    (src / "a.py").write_text("def a():\n    return 1\n")
    (src / "b.py").write_text("class B:\n    pass\n")
    (src / "e.py").write_bytes(b"\xff\xfe")
    (src / "f.py").write_text(" \n")
    (src / "notes+.txt").write_text("no pattern")
    store = Store(spark, f"file://{tmp_path}/store")

    def run(version, **options):
        return {tuple(r) for r in store.index(f"file://{src}", "r", "main", version, **options).collect()}

    assert run(1, commit="c1") == {("a.py", "added", "indexed"), ("b.py", "added", "indexed"), ("e.py", "added", "binary"), ("f.py", "added", "empty_chunks"), ("vendor/c.py", "added", "indexed")}
    assert store.last_commit("r", "main") == "c1" and store.last_commit("r", "dev") is None
    assert [(r["repo_id"], r["files"]) for r in store.tracked_files().collect()] == [("r", 5)]
    assert run(2) == set()
    (src / "b.py").write_text("class B2:\n    pass\n")
    (src / "a.py").unlink()
    assert run(3) == {("a.py", "removed", None), ("b.py", "changed", "indexed")}
    assert {r["class_name"] for r in store.memories().collect()} == {None, "B", "B2"}
    # With a limit, files beyond it are neither indexed nor taken for removed.
    (src / "z.py").write_text("def z(): pass\n")
    assert run(4, most=2) == set() and store.tracked_files().first()["files"] == 4
    assert run(5) == {("z.py", "added", "indexed")}
    before = store.memories().where("version = 6").count()
    assert run(6, incremental=False) == set() and store.memories().where("version = 6").count() == 3 > before
    assert run(1000, full_after_minutes=5) == set() and store.memories().where("version = 1000").count() == 3
    store.clear_hashes("r", "main", 1001)
    assert store.tracked_files().first()["files"] == 0 and len(run(1002)) == 5
    (src / "z.py").unlink()
    for p in list(src.glob("*.py")) + list(src.glob("vendor/*")):
        p.unlink()
    assert {c for _, c, _ in run(1003)} == {"removed"} and run(1004) == set()


def test_sync_to_a_commit(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def a():\n    return 1\n")
    (src / "b.py").write_text("def b(): pass\n")
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.sync(f"file://{src}", ["a.py"], "r", "main", "c2", 1)["status"] == "never indexed"
    store.index(f"file://{src}", "r", "main", 10, commit="c" * 40)
    assert store.sync(f"file://{src}", ["a.py"], "r", "main", "c" * 40, 20)["status"] == "unchanged"
    assert store.sync(f"file://{src}", [], "r", "main", "d" * 40, 30)["status"] == "no files" and store.last_commit("r", "main") == "d" * 40
    (src / "a.py").write_text("def a2():\n    return 2\n")
    (src / "b.py").unlink()
    (src / "n.txt").write_text("new")
    got = store.sync(f"file://{src}", ["a.py", "b.py", "n.txt"], "r", "main", "e" * 40, 40)
    assert (got["status"], got["from_commit"], got["to_commit"]) == ("synced", "d" * 40, "e" * 40)
    assert (got["files_updated"], got["files_removed"], got["memories_staled"], got["chunks_created"]) == (1, 2, 2, 1) and store.last_commit("r", "main") == "e" * 40
    rows = {(r["function_name"], r["stale"], tuple(r["tags"]), r["stale_reason"]) for r in store.memories().collect()}
    assert rows == {("a", True, ("indexed", "repository"), "File changed in commit eeeeeeee"), ("b", True, ("indexed", "repository"), "File changed in commit eeeeeeee"), ("a2", False, ("indexed", "repository", "synced"), None)}
    assert store.index(f"file://{src}", "r", "main", 50).count() == 0


def test_files_by_patterns(spark, tmp_path):
    for name in ("a.py", "src/b.py", "src/deep/c.py", "src/x+y.go", "src/d.pyc", "other/e.go"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)

    def paths(*patterns, **options):
        return sorted(r["path"] for r in fl.repository(spark, f"file://{tmp_path}", patterns, **options).select("path").collect())

    assert paths("**/*.py") == ["a.py", "src/b.py", "src/deep/c.py"] and paths("*.py") == ["a.py"] and paths("src/*.py") == ["src/b.py"] and paths("src/**/*.py") == ["src/b.py", "src/deep/c.py"]
    assert paths("**/x+?.go") == ["src/x+y.go"] and paths("**", most=2) == ["a.py", "other/e.go"] and paths("**/*.py", ignored=("deep",)) == ["a.py", "src/b.py"]
    plan = fl.repository(spark, f"file://{tmp_path}", ("**",), most=2)._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange" in line and "content" in line for line in plan.splitlines())


def test_transcript_with_blocks(spark):
    rows = [
        '{"role":"user","content":"hi"}', "bad", '{"role":"assistant","content":[{"type":"tool","text":"no"},{"type":"text","text":" "},{"type":"text","text":" yo "},{"type":"text","text":"late"}]}', '{"role":"system","content":"no"}',
        '{"role":"user","content":"[x] buy milk"}', '{"role":"user","content":"[]"}', '{"role":"user","content":[]}', "", '{"role":"user"}', '{"role":"user","content":{"a":1}}', '{"role":"assistant","content":[{"type":"text","text":null}, "s", null, {"type":"text","text":"end"}]}',
    ]
    df = spark.createDataFrame([("s", i, r) for i, r in enumerate(rows)], "session_id string, line_no long, line string")
    assert fl.tail(df, 99).first()["transcript"] == "user: hi\n\nassistant: yo\n\nuser: [x] buy milk\n\nuser: []\n\nuser: \n\nassistant: end"
    # The last lines are counted before any of them is left out.
    assert fl.tail(df.where("line_no < 5"), 3).first()["transcript"] == "assistant: yo\n\nuser: [x] buy milk"
    assert capturing.to_capture(df, 1).first()["text"] == "assistant: end"


def test_stream_capture(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [f'{{"session_id":"s","line_no":{i},"line":"{{\\"role\\":\\"user\\",\\"content\\":\\"same\\"}}","at":"2024-01-01T00:00:0{i}Z"}}' for i in range(3)]
    (tmp_path / "in" / "a.json").write_text("\n".join(rows))
    q = capture.stored(capture.captured(capture.lines(spark, f"file://{tmp_path}/in")), f"file://{tmp_path}/out", f"file://{tmp_path}/ck")
    q.awaitTermination(120)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 1


def test_scope_folders(spark):
    rows = [("r", "/a/b.py", "r"), (None, "/a/b.py", "/a"), ("", "/b.py", "/"), (None, "a/b.py", None), (None, None, None)]
    df = spark.createDataFrame(rows, "r string, f string, want string")
    assert all(x["want"] == x["got"] for x in df.withColumn("got", tx.scope_folder(F.col("r"), F.col("f"))).collect())


def test_changes_and_empty_tables(spark):
    empty = spark.createDataFrame([], "path string, sha256 string")
    assert maintenance.changes(empty, empty).count() == 0
    one = spark.createDataFrame([("a", "1")], "path string, sha256 string")
    assert maintenance.changes(one, empty).first()["change"] == "removed"


def test_name_patterns(spark):
    df = spark.createDataFrame([("a/b.py",), ("b.pyc",), ("x.ts",), (None,)], "p string")
    got = [r[0] for r in df.select(indexing.name_matches(F.col("p"), ("src/*.py", "?.ts"))).collect()]
    assert got == [True, False, True, None]


def test_index_outcomes(spark):
    rows = [("a.md", b"text here.", "1"), ("b.md", b"\xff", "2"), ("c.md", b" \n", "3"), ("d.md", None, "4"), ("e.md", b"same", "5"), ("f.md", b"new", "7")]
    files = spark.createDataFrame(rows, "path string, content binary, sha256 string")
    known = spark.createDataFrame([("e.md", "5"), ("f.md", "6")], "path string, sha256 string")
    found = indexing.outcomes(files, known)
    assert {r["path"]: r["outcome"] for r in found.collect()} == {"a.md": "indexed", "b.md": "binary", "c.md": "empty_chunks", "d.md": "empty_chunks", "e.md": "unchanged", "f.md": "indexed"}
    assert {r["path"] for r in indexing.chunks(found).collect()} == {"a.md", "f.md"}
    assert indexing.outcomes(files.limit(0), known.limit(0)).count() == 0


def test_sync_counts(spark):
    rows = [("r", "main", "code_snippet", "a.py", False), ("r", "main", "decision", "a.py", False), ("r", "main", "relationship", "b.py", True), ("r", "dev", "code_snippet", "a.py", False)]
    memories = spark.createDataFrame(rows, "repo_id string, branch_name string, content_type string, file_path string, stale boolean")
    changed = spark.createDataFrame([("r", "main", "a.py", True), ("r", "main", "b.py", False), ("r", "main", "c.txt", True), ("r", "main", "d.py", None)], "repo_id string, branch_name string, path string, still_there boolean")
    got = [tuple(r) for r in indexing.synced(memories, changed, ("*.py",), "0123456789", "a" * 40).collect()]
    assert got == [("r", "main", "01234567", "aaaaaaaa", 1, 3, 1)]


def test_replies_of_an_extractor(spark):
    replies = ['[{"type":"decision","content":" a ","tags":["x",null,""]},{"type":"odd","content":"b"},{"type":"summary","content":"  "}]', '```\n[{"content":"c"}]\n```', '{"type":"decision","content":"no list"}', "not json", "", None]
    df = spark.createDataFrame(list(enumerate(replies)), "session_id long, reply string")
    got = {(r["session_id"], r["place"], r["content_type"], r["text"], tuple(r["tags"])) for r in capturing.extracted(df).collect()}
    assert got == {(0, 0, "decision", "a", ("x",)), (0, 1, "context", "b", ()), (1, 0, "context", "c", ())}


def test_prompt_lists_at_most_twenty(spark):
    df = spark.createDataFrame([([f"s{i}" for i in range(30)],), ([],)], "k array<string>")
    a, b = (r[0] for r in df.select(capturing.prompt(F.lit("base"), F.col("k"))).collect())
    assert a.startswith("base\n\n") and a.endswith("\n- s19") and b == "base"


def test_summary_keeps_memories_without_a_file(spark):
    df = spark.createDataFrame([("r", None, 1, "x"), ("r", "f", 2, "y"), ("r", "f", 3, "z" * 400)], "repo_id string, file_path string, memory_id long, one_line string")
    assert {r["memory_id"] for r in context.summary_lines(df, 20).collect()} == {1, 2}
