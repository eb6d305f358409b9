"""Every query of the memory engine against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from recall_spark import catalogue
from recall_spark.operators import chunking

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, db, name):
    df = catalogue.queries()[name](spark, SF)
    result = db.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(str([plain(v) for v in r]) for r in result.fetchall())
    assert sorted(str([plain(v) for v in r]) for r in df.select(*columns).collect()) == want


def test_every_query_is_tested():
    """What has no SQL has a test against plain Python."""
    tests = "".join(p.read_text() for p in Path(__file__).parent.glob("*.py"))
    missing = [n for n in catalogue.queries() if n not in catalogue.oracle_sql() and f'"{n}"' not in tests]
    assert not missing


def test_chunk_text(spark):
    text = {str(r["doc_id"]): r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got: dict[str, list] = {}
    for r in catalogue.queries()["chunk_text"](spark, SF).collect():
        got.setdefault(r["path"], []).append((r["chunk_text"], r["line_start"], r["line_end"]))
    assert got == {i: [c[:3] for c in chunking.text_chunks(t)] for i, t in text.items()}
