"""SQL functions against column functions on every document, table functions against chunked(), vocabularies by brute force."""

import pytest
from pyspark.sql import functions as F

from recall_spark import catalogue, sql
from recall_spark.functions import scoring as sc
from recall_spark.functions import text as tx
from recall_spark.functions import vocabulary as vo
from recall_spark.operators import chunking
from recall_spark.plans.store import Store
from recall_spark.sources import tables as tb

SF = "/root/testdata/sf0.001"
PATH = catalogue.VOCABULARY


@pytest.fixture(scope="module")
def session(spark):
    sql.functions(spark, PATH)
    assert "memories" in sql.views(spark, SF)
    return spark


def test_functions_equal_columns(session):
    """Also on null, blank and awkward texts."""
    odd = [None, "", " \n", "\u2003x.\u00a0", "a" * 120, "One. Two! " * 300, "No end " * 300, "p\n\nq" * 400, "token = 'abcdefgh12'", "\\d 'q' \"r\""]
    texts = session.table("memories").select("text").union(session.createDataFrame([(t,) for t in odd], "text string"))
    t = F.col("text")
    pairs = {
        "text_checksum(text)": tx.checksum(t), "path_id(text)": tx.path_id(t), "estimated_tokens(text)": tx.tokens(t), "fits_tokens(text, 50)": tx.fits(t, 50), "truncate_tokens(text, 60)": tx.truncated(t, 60),
        "one_line(text)": tx.one_line(t), "detailed_summary(text)": tx.detailed(t), "has_secrets(text)": tx.has_secrets(t),
    }
    for name, column in pairs.items():
        assert texts.where(~F.expr(name).eqNullSafe(column)).count() == 0, name
    paths = session.createDataFrame([(f"a/b{s}",) for s in [*tx.LANGUAGES, ".TXT", ".PY", "", ".tar.gz", "/"]] + [(None,), ("/f.py",), (".py",)], "p string")
    for name, column in {"file_language(p)": tx.language(F.col("p")), "file_chunker(file_language(p))": tx.chunker(tx.language(F.col("p"))), "is_code(p)": tx.is_code(F.col("p")), "scope_folder(null, p)": tx.scope_folder(F.lit(None).cast("string"), F.col("p")), "scope_folder('r', p)": tx.scope_folder(F.lit("r"), F.col("p")), "chunk_type(p, 'c')": tx.chunk_type(F.col("p"), F.lit("c"))}.items():
        assert paths.where(~F.expr(name).eqNullSafe(column)).count() == 0, name
    scores = session.range(60).select(F.element_at(F.array(*map(F.lit, [*sc.INTENTS, "odd"])), (F.col("id") % 7 + 1).cast("int")).alias("i"), F.element_at(F.array(*map(F.lit, [*tb.TYPES, "odd"])), (F.col("id") % 8 + 1).cast("int")).alias("c"), (F.col("id") / 59.0).alias("x"))
    for name, column in {"type_priority(i, c)": sc.type_priority(F.col("i"), F.col("c")), "recency(x * 300)": sc.recency(F.col("x") * 300), "composite_score(x, x / 2, 0.3)": sc.composite(F.col("x"), F.col("x") / 2, F.lit(0.3)), "vector_similarity(x)": sc.similarity(F.col("x")), "context_budget(x)": sc.budget(F.col("x"))}.items():
        assert scores.where(~F.expr(name).eqNullSafe(column)).count() == 0, name


def test_functions_stay_in_the_jvm(session):
    plan = session.sql("SELECT one_line(text), estimated_tokens(text), has_secrets(text) FROM memories WHERE text_checksum(text) > 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chunks_in_sql(session):
    """LATERAL chunks() over files of every kind equals chunked()."""
    files = [("a.py", "class A:\n    def f(self):\n        'doc'\n", "python"), ("b.go", "package b\nfunc F() {}\n", "go"), ("c.md", "One. Two. " * 900, None), ("d", None, "python"), ("e.py", "def broken(", "python"), ("f", "", None), ("g.rs", "struct S;", "rust")]
    df = session.createDataFrame(files, "path string, text string, language string")
    df.createOrReplaceTempView("some_files")
    got = session.sql("SELECT f.path, f.language, c.* FROM some_files f, LATERAL chunks(f.text, f.language) c")
    want = chunking.chunked(df)
    assert got.columns == want.columns and got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert session.sql("SELECT name FROM chunks('fn f() {}', 'rust')").first()[0] == "f"


def test_views_of_a_store(session, tmp_path):
    store = Store(session, f"file://{tmp_path}/s")
    store.create(session.createDataFrame([("r", "main", "decision", "use spark. always", ["x"])], "repo_id string, branch_name string, content_type string, text string, depends_on array<string>"), 1)
    assert {"memories", "memory_log", "transactions"} <= set(sql.views(session, store))
    row = session.sql("SELECT one_line(text) AS l, m.depends_on, e.to_id, t.operation FROM memories m JOIN edges e ON m.memory_id = e.from_id JOIN transactions t ON t.version = m.version").first()
    assert tuple(row) == ("use spark.", ["x"], "x", "create")
    assert session.sql("SELECT count(*) FROM vectors v JOIN memories m USING (memory_id) WHERE vector_similarity(squared_distance(v.embedding, v.embedding)) = 1").first()[0] == 1
    sql.views(session, SF)


def brute(v, text, budget):
    """Over all token ends, the longest beginning that is short enough."""
    ends, at, data = {0}, 0, text.encode()
    for t in v.encoded(text):
        at += len(v.encoding.decode_single_token_bytes(t))
        ends.add(at)
    fit = [e for e in ends if (e == len(data) or data[e] & 0xC0 != 0x80) and len(v.encoded(data[:e].decode())) <= budget]
    return data[: max(fit)].decode()


def test_truncation_is_maximal(session):
    v = vo.Vocabulary.at(PATH)
    docs = [r["text"] for r in session.table("memories").where("length(text) < 1500").collect()][:60]
    odd = ["", "a", "   ", "word   next", "x" * 60, "é" * 30, "日本語テキスト" * 5, "👩‍👩‍👧 emoji 👍🏽" * 4, "a\n\n\n  b\t\tc " * 6, "unbelievablyinterconnectedness " * 3, " \u00a0 x" * 9, "don't we'll 123456789 !!??"]
    for t in docs[:60] + odd:
        for budget in {0, 1, 2, 7, 30, len(v.encoded(t)) - 1, len(v.encoded(t))}:
            got = v.truncated(t, budget)
            assert got == (brute(v, t, budget) if budget > 0 else ""), (t[:80], budget)
    got = session.sql("SELECT text, vocabulary_tokens(text) AS n, truncate_vocabulary(text, 40) AS c FROM memories").collect()
    assert all(r["n"] == len(v.encoded(r["text"])) and len(v.encoded(r["c"])) <= 40 and r["text"].startswith(r["c"]) for r in got if r["text"] is not None)
    nulls = session.createDataFrame([(None,)], "t string")
    assert tuple(nulls.select(vo.counted(F.col("t"), PATH), vo.truncated(F.col("t"), 3, PATH), vo.counted(F.col("t"))).first()) == (None, None, None)
    assert session.range(1).select(vo.counted(F.lit("abcde")), vo.truncated(F.lit("abcdefghij"), 2)).first()[:] == (2, "abcdefgh")


def test_queries_without_sql(session):
    v = vo.Vocabulary.at(PATH)
    texts = {r["memory_id"]: r["text"] for r in session.table("memories").collect()}
    got = catalogue.queries()["vocabulary_tokens"](session, SF).collect()
    assert {r["memory_id"]: (r["tokens"], r["cut_length"]) for r in got} == {i: (len(v.encoded(t)), len(v.truncated(t, 100))) for i, t in texts.items()}
    chunks = {}
    for r in catalogue.queries()["sql_chunks"](session, SF).collect():
        chunks.setdefault(r["memory_id"], []).append((r["chunk_text"], r["line_start"], r["line_end"]))
    assert {i: sorted(c) for i, c in chunks.items()} == {i: sorted(c[:3] for c in chunking.text_chunks(t)) for i, t in texts.items()}


def test_long_blanks(monkeypatch):
    """Runs of white space of any length have the tokens that they have within a short text."""
    import regex

    v = vo.Vocabulary(PATH)
    plain = v.encoding.encode_ordinary
    v.long = regex.compile(f"[{vo.BLANK}]{{1,}}")
    monkeypatch.setattr(vo, "LONGEST", 0)
    for n in [*range(1, 60), 500, 2_000]:
        for blank in (" ", "\n", "\t", " \n", "\u3000", "\r\n", "\xa0 "):
            run = (blank * n)[:n]
            for t in (run, "a" + run, run + "b", "a" + run + "b c", "x." + run + "1", "a" + run + "'s" + run):
                assert v.encoded(t) == plain(t), (n, blank, t[:5])
    monkeypatch.setattr(vo, "LONGEST", 10_000)
    v = vo.Vocabulary(PATH)
    assert len(v.encoded(" " * 1_000_000)) > 1_000 and len(v.encoded("\n" * 1_000_000 + "x")) > 1_000 and len(v.encoded("y" * 1_000_000)) > 1_000
    assert v.truncated("a" + " " * 1_000_000, 5).startswith("a ")
