"""The engine for SQL: views of memories, their functions, and chunkers as table functions.

Functions are SQL expressions, so the optimiser sees through them; only chunkers and vocabularies run Python. All belong to
the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_spark.functions import scoring as sc
from recall_spark.functions import text as tx
from recall_spark.functions import vocabulary
from recall_spark.operators import chunking, search
from recall_spark.plans.store import Store
from recall_spark.sources import tables as tb


def _text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _map(pairs: dict[str, str]) -> str:
    return f"map({', '.join(f'{_text(k)}, {_text(v)}' for k, v in pairs.items())})"


_STRIPPED = r"regexp_replace({0}, r'(?U)^\s+|\s+$', '')"
_PARTS = r"split(left(t, 4 * budget), r'[.!?]\s+', -1)"
_SENTENCE = _STRIPPED.format(r"regexp_extract(t, r'^[^.!?]+[.!?]', 0)")
_PRIORITIES = {f"{i}:{t}": w for i, types in sc.PRIORITY.items() for t, w in zip(types, sc.WEIGHTS)}
#: Name and arguments, type, and expression; later ones may use earlier ones.
FUNCTIONS = {
    "text_checksum(t STRING)": ("STRING", "sha2(t, 256)"),
    "path_id(path STRING)": ("STRING", "left(sha2(path, 256), 16)"),
    "estimated_tokens(t STRING)": ("INT", "CAST(floor((length(t) + 3) / 4) AS INT)"),
    "fits_tokens(t STRING, budget INT)": ("BOOLEAN", "estimated_tokens(t) <= budget"),
    "truncate_tokens(t STRING, budget INT)": ("STRING", f"CASE WHEN estimated_tokens(t) <= budget THEN t WHEN size({_PARTS}) > 1 THEN concat(array_join(slice({_PARTS}, 1, size({_PARTS}) - 1), '. '), '.') ELSE left(t, 4 * budget) END"),
    "one_line(t STRING)": ("STRING", f"CASE WHEN length({_SENTENCE}) BETWEEN 1 AND 100 THEN {_SENTENCE} WHEN length({_STRIPPED.format('t')}) <= 100 THEN {_STRIPPED.format('t')} ELSE concat({_STRIPPED.format('left(t, 97)')}, '...') END"),
    "detailed_summary(t STRING)": ("STRING", r"CASE WHEN estimated_tokens(t) > 200 THEN truncate_tokens(element_at(split(t, '\n\n'), 1), 500) END"),
    "chunk_type(function_name STRING, class_name STRING)": ("STRING", "CASE WHEN coalesce(function_name, '') <> '' THEN 'function' WHEN coalesce(class_name, '') <> '' THEN 'class' ELSE 'text' END"),
    "file_language(path STRING)": ("STRING", rf"{_map(tx.LANGUAGES)}[lower(regexp_extract(path, r'[^/](\.[^./]+)$', 1))]"),
    "file_chunker(language STRING)": ("STRING", f"coalesce({_map(tx.CHUNKERS)}[language], 'text')"),
    "is_code(path STRING)": ("BOOLEAN", "file_language(path) IS NOT NULL"),
    "scope_folder(repo_path STRING, file_path STRING)": ("STRING", "coalesce(nullif(repo_path, ''), CASE WHEN startswith(file_path, '/') THEN nullif(regexp_replace(file_path, '/[^/]*$', ''), '') END, CASE WHEN file_path RLIKE '^/[^/]*$' THEN '/' END)"),
    "has_secrets(t STRING)": ("BOOLEAN", "t RLIKE " + _text("|".join(f"(?:{p})" for _, p in tx.SECRETS))),
    "vector_similarity(distance DOUBLE)": ("DOUBLE", "exp(-distance)"),
    "squared_distance(a ARRAY<FLOAT>, b ARRAY<FLOAT>)": ("DOUBLE", "aggregate(zip_with(a, b, (x, y) -> (CAST(x AS DOUBLE) - y) * (CAST(x AS DOUBLE) - y)), 0D, (s, d) -> s + d)"),
    "type_priority(intent STRING, content_type STRING)": ("DOUBLE", f"coalesce(map({', '.join(f'{_text(k)}, {w}D' for k, w in _PRIORITIES.items())})[concat_ws(':', CASE WHEN intent IN ({', '.join(map(_text, sc.PRIORITY))}) THEN intent ELSE 'general' END, content_type)], {sc.OTHER}D)"),
    "recency(age_days DOUBLE)": ("DOUBLE", "greatest(0.3D, exp(-age_days / 60))"),
    "composite_score(similar DOUBLE, priority DOUBLE, recent DOUBLE)": ("DOUBLE", "0.6D * similar + 0.3D * priority + 0.1D * recent"),
    "context_budget(best DOUBLE)": ("INT", "least(greatest(CAST(800 * (0.3D + 0.9D * best) AS INT), 200), 1200)"),
}


class Chunks:
    """chunks(text, language): the chunks of a text, in order; none of a null text."""

    def eval(self, text: str, language: str):
        if text is not None:
            for chunk in chunking.chunks_of(text, language):
                yield *chunk[:-1], list(chunk[-1])


def functions(spark: SparkSession, vocabulary_path: str | None = None) -> None:
    """Register FUNCTIONS, the table function chunks, and vocabulary_tokens and truncate_vocabulary by a vocabulary, if one is given."""
    for name, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURNS {kind} RETURN {body}")
    spark.udtf.register("chunks", F.udtf(Chunks, returnType=chunking.SCHEMA.replace("path string, language string, ", ""), useArrow=True))
    if vocabulary_path is not None:
        path = vocabulary_path

        def count(t):
            import pandas as pd

            return pd.Series([None if x is None else len(vocabulary.Vocabulary.at(path).encoded(x)) for x in t], dtype="Int32")

        spark.udf.register("vocabulary_tokens", F.pandas_udf(count, "int", F.PandasUDFType.SCALAR))

        def cut(t, budget):
            import pandas as pd

            return pd.Series([None if x is None or pd.isna(b) else vocabulary.Vocabulary.at(path).truncated(x, int(b)) for x, b in zip(t, budget)], dtype="object")

        spark.udf.register("truncate_vocabulary", F.pandas_udf(cut, "string", F.PandasUDFType.SCALAR))


def nearest(spark: SparkSession, queries: str, k: int, scoped: tuple[str, ...] = (), name: str = "nearest", vectors: str = "vectors") -> None:
    """A temporary view of the k nearest vectors of each query: query_id, memory_id, similarity, rank, as search.top_k() gives them.

    queries: a SELECT of query_id, embedding and the columns in which both have to agree. A join in SQL would make a row with
    both vectors for every pair, and put a scope into one task."""
    search.top_k(spark.table(vectors), spark.sql(queries), k, scoped).createOrReplaceTempView(name)


def views(spark: SparkSession, source: str | Store) -> list[str]:
    """Temporary views of a store (memories, memory_log, vectors, edges, transactions) or of the tables in a folder
    (memories, vectors, edges, skills, and the tables themselves). Their names."""
    made: dict[str, DataFrame] = {}
    if isinstance(source, Store):
        made = {"memories": source.rehydrated(), "memory_log": source.log(), "vectors": source.vectors(), "edges": source.edges(), "transactions": source.transactions(),
            "captures": source._read("captures"), "capture_sessions": source._read("sessions"), "indexed_files": source._read("hashes")}
    else:
        made = {"memories": tb.memories(spark, source), "vectors": tb.vectors(spark, source), "edges": tb.edges(spark, source), "skills": tb.skills(spark, source)}
        made |= {name: tb.table(spark, source, name) for name in ("documents", "embeddings", "conversations")}
    for name, df in made.items():
        df.createOrReplaceTempView(name)
    return list(made)
