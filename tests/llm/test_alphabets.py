"""Automata of large alphabets: as edges they parse as tables do, in room that grows with what is learned."""

import numpy as np
from pyspark.sql import functions as F

from recall_spark.llm import language_id as li


def words(rng, letters, n, size=6):
    return " ".join("".join(rng.choice(letters, rng.integers(1, size))) for _ in range(n))


def test_edges_parse_as_tables(monkeypatch):
    rng = np.random.default_rng(2)
    latin, han = list("abcdefghij"), [chr(0x4E00 + i) for i in range(400)]
    texts = {"aa": [words(rng, latin, 300), words(rng, latin[:4], 90)], "hh": [words(rng, han, 700)], "mm": [words(rng, han[:50] + latin, 200), ""]}
    asked = [words(rng, latin, 400), words(rng, han, 500), words(rng, han[:60] + latin, 200), "Ω ∆ x", "", None, "12 !", words(rng, han[380:] + ["龥"], 900), "x" * 2_000]
    want = None
    for cells, alike in ((1 << 23, 10**9), (1 << 23, 5), (0, 10**9), (0, 5), (100_000, 5)):
        monkeypatch.setattr(li, "CELLS", cells)
        monkeypatch.setattr(li, "ALIKE", alike)
        model = li.Languages(texts)
        kinds = {type(t) for t in model.tables}
        assert kinds == ({li.Edges} if not cells else {li.Table} if cells > 1 << 20 else {li.Table, li.Edges})
        codes, sizes, _ = model.encode([(t or "").lower() for t in asked])
        got = (model.phrases(codes, sizes).tolist(), model.predict(asked)[0])
        want = want or got
        assert got == want
    assert want[1][:3] == ["aa", "hh", "mm"] and want[1][4:7] == ["und"] * 3


def test_room_of_a_large_alphabet():
    """3,000 letters: below 10 MB a language, also for the small alphabets beside it."""
    rng = np.random.default_rng(3)
    han = [chr(0x4E00 + i) for i in range(3_000)]
    model = li.Languages({"hh": [words(rng, han, 10_000)], "aa": [words(rng, list("abcdefghij"), 6_000)]})
    size = {n: sum(getattr(t, a).nbytes for a in ("table", "owner", "next", "begin") if hasattr(t, a)) for n, t in zip(model.names, model.tables)}
    assert size["hh"] < 10 << 20 and size["aa"] < 10 << 20
    assert model.predict([words(rng, han, 50), words(rng, list("abcdefghij"), 50)])[0] == ["hh", "aa"]


def test_more_languages_than_are_learned(spark, monkeypatch):
    monkeypatch.setattr(li, "LANGUAGES", 2)
    rows = [(i, f"{'abc'[i % 3] * 4} {'xyz'[i % 3]}{i}", "pqr"[i % 3]) for i in range(30)] + [(99, "aaaa x", "p"), (98, "bbbb y", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert li.learn(docs, F.lit(True)).names == ["p", "q"]
