"""All registered queries of the memory engine with their SQL."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_spark import sql
from recall_spark.functions import scoring as sc
from recall_spark.functions import text as tx
from recall_spark.functions import vocabulary
from recall_spark.operators import capturing, cells, chunking, context, graphs, indexing, listing, maintenance, search
from recall_spark.operators.joins import shared_dir, small
from recall_spark.sources import files as fl
from recall_spark.sources import tables as tb

#: A public vocabulary, which executors can open.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

_TYPES = "[" + ", ".join(f"'{t}'" for t in tb.TYPES) + "]"
_MEMORIES = f"""memories AS (
  SELECT doc_id AS memory_id, source AS repo_id, source AS repo_name, CASE WHEN doc_id % 4 <> 0 THEN 'main' ELSE 'dev' END AS branch_name,
    ({_TYPES})[(doc_id % 7 + 1)::INT] AS content_type, text, lang AS language, 'src/' || lang || '/f' || (doc_id % 25) || '.txt' AS file_path,
    doc_id % 100 + 1 AS line_start, doc_id % 100 + 10 AS line_end, CASE WHEN doc_id % 5 = 0 THEN 'fn_' || (doc_id % 13) END AS function_name,
    CASE WHEN doc_id % 5 = 1 THEN 'Cls_' || (doc_id % 11) END AS class_name, [lang, 't' || (doc_id % 3), 'g' || (doc_id % 5)] AS tags,
    {tb.EPOCH} + doc_id % 1000 * 3600 AS created_at, doc_id % 7 IN (0, 3) AND doc_id % 3 = 1 AS stale FROM documents)"""
_TOKENS = "((length({0}) + 3) // 4)::INT"
_ONE_LINE = r"""CASE WHEN length(trim(regexp_extract(text, '^[^.!?]+[.!?]'), E' \n\t\r')) BETWEEN 1 AND 100 THEN trim(regexp_extract(text, '^[^.!?]+[.!?]'), E' \n\t\r')
  WHEN length(trim(text, E' \n\t\r')) <= 100 THEN trim(text, E' \n\t\r') ELSE trim(left(text, 97), E' \n\t\r') || '...' END"""
_VECTORS = "vectors AS (SELECT e.vec_id, e.embedding, e.label, m.repo_id, m.branch_name FROM embeddings e JOIN memories m ON e.vec_id = m.memory_id)"
_NEAREST = f"""{_VECTORS},
  d AS (SELECT q.vec_id AS query_id, v.vec_id AS memory_id, list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: (q.embedding[i]::DOUBLE - v.embedding[i]::DOUBLE) ^ 2)) AS distance
        FROM vectors v JOIN vectors q ON v.repo_id = q.repo_id AND v.branch_name = q.branch_name WHERE q.vec_id % 20 = 0),
  hits AS (SELECT query_id, memory_id, exp(-distance) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), memory_id) AS rank FROM d)"""


def _embedded_sql(source: str, name: str) -> str:
    """CTEs of hashed vectors for rows (id, text) of a table: name, with id and v, a list of 64 numbers in single precision."""
    byte = "('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT"
    crc = f"xor(list_reduce(list_transform(range(octet_length(encode(word))), lambda i: {byte}), lambda r, b: list_reduce(list_prepend(xor(r, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, _: xor(x >> 1, 3988292384 * (x & 1))), 4294967295::BIGINT), 4294967295)"
    return f"""{name}_w AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS word FROM {source}),
  {name}_h AS (SELECT word, {crc} AS h FROM (SELECT DISTINCT word FROM {name}_w)),
  {name}_x AS (SELECT id, h % 64 AS k, sum(CASE WHEN (h >> 16) & 1 = 1 THEN 1 ELSE -1 END)::DOUBLE AS x FROM {name}_w JOIN {name}_h USING (word) GROUP BY ALL),
  {name}_n AS (SELECT id, sqrt(sum(x * x)) AS n FROM {name}_x GROUP BY id),
  {name} AS (SELECT s.id, list(CASE WHEN coalesce(n, 0) > 0 THEN (coalesce(x, 0)::FLOAT / n::FLOAT)::FLOAT ELSE 0::FLOAT END ORDER BY r.k) AS v
    FROM {source} s CROSS JOIN range(64) r(k) LEFT JOIN {name}_x x ON x.id = s.id AND x.k = r.k LEFT JOIN {name}_n n ON n.id = s.id GROUP BY s.id)"""


def _apart_sql(a: str, b: str) -> str:
    """Squared distance of two lists."""
    return f"list_sum(list_transform(range(1, 65), lambda i: ({a}[i]::DOUBLE - {b}[i]::DOUBLE) ^ 2))"


#: Sources with a comment that holds a document, and braces where they don't count.
CODE = {
    "javascript": "export class NAME {\n  // }\n  run(a = f(1)) { /* TEXT */ return `}`; }\n}\nasync function go() { if (x) { y(); } }\n",
    "typescript": "interface NAME { a: string }\nclass C extends NAME {\n  private async run<T>(x: T): Promise<void> { /* TEXT */ '}' }\n}\nfunction go<T>(x: T): T { return x }\n",
    "go": "package a\ntype NAME struct { x int }\nfunc (n *NAME) Run() rune { /* TEXT */ return '}' }\nfunc Go(x int) (int, error) { return 1, nil }\n",
    "rust": "pub struct NAME;\npub trait T { fn sig(&self); }\nimpl<'a> T for NAME {\n  fn run(&self) { /* TEXT */ let c = '}'; }\n}\n",
    "java": "public class NAME {\n  @Override\n  public String run(int a) throws E { /* TEXT */ return \"}\"; }\n}\ninterface I { void k(); }\n",
    "c": "struct NAME { int a; };\nstatic int run(int a) { /* TEXT */ return a; }\nint proto(int);\n",
    "cpp": "class NAME : public B { int a; };\nint run(std::vector<int> v) { /* TEXT */ return 0; }\nint main() { }\n",
    "csharp": "namespace N { public sealed class NAME { public async Task<int> Run(int x) { /* TEXT */ return 1; } } interface I { void K(); } }\n",
    "svelte": "<script>\nfunction NAME() { /* TEXT */ }\n</script>\n<p>{ x }</p>\n<script lang=\"ts\">\ninterface I { }\n</script>\n",
    "python": "class NAME(Base):\n    \"\"\"TEXT\"\"\"\n    def f(self):\n        return 1\n\ndef g():\n    pass\n",
}
#: What is cut out of them, written by hand: language, kind, name, the chunk, its first line, and whether the document is before it.
CUTS = (
    ("javascript", "class", "NAME", "class NAME {\n  // }\n  run(a = f(1)) { /* TEXT */ return `}`; }\n}", 1, 0), ("javascript", "method", "run", "run(a = f(1)) { /* TEXT */ return `}`; }", 3, 0),
    ("javascript", "function", "go", "async function go() { if (x) { y(); } }", 5, 1), ("typescript", "class", "NAME", "interface NAME { a: string }", 1, 0),
    ("typescript", "class", "C", "class C extends NAME {\n  private async run<T>(x: T): Promise<void> { /* TEXT */ '}' }\n}", 2, 0), ("typescript", "method", "run", "private async run<T>(x: T): Promise<void> { /* TEXT */ '}' }", 3, 0),
    ("typescript", "function", "go", "function go<T>(x: T): T { return x }", 5, 1), ("go", "class", "NAME", "type NAME struct { x int }", 2, 0),
    ("go", "method", "Run", "func (n *NAME) Run() rune { /* TEXT */ return '}' }", 3, 0), ("go", "function", "Go", "func Go(x int) (int, error) { return 1, nil }", 4, 1),
    ("rust", "class", "NAME", "pub struct NAME;", 1, 0), ("rust", "class", "T", "pub trait T { fn sig(&self); }", 2, 0), ("rust", "class", "impl", "impl<'a> T for NAME {\n  fn run(&self) { /* TEXT */ let c = '}'; }\n}", 3, 0),
    ("rust", "function", "run", "fn run(&self) { /* TEXT */ let c = '}'; }", 4, 0), ("java", "class", "NAME", "public class NAME {\n  @Override\n  public String run(int a) throws E { /* TEXT */ return \"}\"; }\n}", 1, 0),
    ("java", "method", "run", "@Override\n  public String run(int a) throws E { /* TEXT */ return \"}\"; }", 2, 0), ("java", "class", "I", "interface I { void k(); }", 5, 1), ("java", "method", "k", "void k();", 5, 1),
    ("c", "class", "NAME", "struct NAME { int a; }", 1, 0), ("c", "function", "run", "static int run(int a) { /* TEXT */ return a; }", 2, 0), ("cpp", "class", "NAME", "class NAME : public B { int a; }", 1, 0),
    ("cpp", "function", "run", "int run(std::vector<int> v) { /* TEXT */ return 0; }", 2, 0), ("cpp", "function", "main", "int main() { }", 3, 1),
    ("csharp", "class", "NAME", "public sealed class NAME { public async Task<int> Run(int x) { /* TEXT */ return 1; } }", 1, 0), ("csharp", "method", "Run", "public async Task<int> Run(int x) { /* TEXT */ return 1; }", 1, 0),
    ("csharp", "class", "I", "interface I { void K(); }", 1, 1), ("csharp", "method", "K", "void K();", 1, 1), ("svelte", "function", "NAME", "function NAME() { /* TEXT */ }", 2, 0), ("svelte", "class", "I", "interface I { }", 6, 1),
    ("python", "class", "NAME", "class NAME(Base):\n    \"\"\"TEXT\"\"\"\n    def f(self):\n        return 1", 1, 0), ("python", "method", "f", "    def f(self):\n        return 1", 3, 1), ("python", "function", "g", "def g():\n    pass", 6, 1),
)
#: Signs that would end a comment or a docstring, or a line within it.
_ENDING = "*/\"\\\r\0"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _prompts(spark, d):
    """Every twentieth vector as a prompt in its repository and branch."""
    return tb.vectors(spark, d).where("memory_id % 20 = 0").select(F.col("memory_id").alias("query_id"), "embedding", "repo_id", "branch_name")


def _found(spark, d, k, least, **options):
    return search.similar(tb.vectors(spark, d), _prompts(spark, d), tb.memories(spark, d), k, least, **options)


@query(f"WITH {_MEMORIES}, {_NEAREST} SELECT query_id, memory_id, rank, round(similarity, 6) AS similarity, content_type FROM hits JOIN memories USING (memory_id) WHERE rank <= 5 AND similarity >= 0.2 AND NOT stale")
def search_similar(spark, d):
    return _found(spark, d, 5, 0.2).select("query_id", "memory_id", F.col("rank").cast("long").alias("rank"),
        F.round("similarity", 6).alias("similarity"), "content_type")


@query(f"WITH {_MEMORIES}, {_NEAREST} SELECT query_id, count(*) AS n, round(max(similarity), 6) AS best FROM hits JOIN memories USING (memory_id) WHERE rank <= 20 AND similarity >= 0.2 AND NOT stale GROUP BY query_id")
def search_multi(spark, d):
    return _found(spark, d, 20, 0.2).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.max("similarity"), 6).alias("best"))


@query(f"WITH {_MEMORIES}, {_NEAREST} SELECT query_id, memory_id FROM hits JOIN memories USING (memory_id) WHERE rank <= 50 AND NOT stale AND language = 'en' AND list_has_all(tags, ['t1'])")
def search_tags_lang(spark, d):
    return _found(spark, d, 50, 0.0, language="en", tags=["t1"]).select("query_id", "memory_id")


@query(f"WITH {_MEMORIES}, {_NEAREST} SELECT query_id, memory_id, stale FROM hits JOIN memories USING (memory_id) WHERE rank <= 10 AND content_type = 'code_snippet'")
def search_include_stale(spark, d):
    return _found(spark, d, 10, 0.0, content_type="code_snippet", include_stale=True).select("query_id", "memory_id", "stale")


_OTHER_SCOPES = """vectors AS (SELECT e.vec_id, e.embedding, m.repo_id, m.branch_name, content_type, stale FROM embeddings e JOIN memories m ON e.vec_id = m.memory_id),
  d AS (SELECT q.vec_id AS query_id, v.vec_id AS memory_id, v.branch_name, list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: (q.embedding[i]::DOUBLE - v.embedding[i]::DOUBLE) ^ 2)) AS distance
        FROM vectors v JOIN vectors q ON v.repo_id = q.repo_id AND ({scope}) WHERE q.vec_id % 20 = 0 AND ({first})),
  hits AS (SELECT query_id, memory_id, exp(-distance) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), memory_id) AS rank FROM d)"""


@query(f"WITH {_MEMORIES}, {_OTHER_SCOPES.format(scope='true', first='true')} SELECT query_id, memory_id, branch_name FROM hits JOIN memories USING (memory_id) WHERE rank <= 10 AND NOT stale")
def search_cross_branch(spark, d):
    return _found(spark, d, 10, 0.0, cross_branch=True).select("query_id", "memory_id", "branch_name")


@query(f"""WITH {_MEMORIES}, {_OTHER_SCOPES.format(scope='v.branch_name = q.branch_name', first="v.content_type = 'decision' AND NOT v.stale")} SELECT query_id, memory_id, rank FROM hits WHERE rank <= 5""")
def search_prefilter(spark, d):
    return _found(spark, d, 5, 0.0, content_type="decision", prefilter=True).select("query_id", "memory_id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_MEMORIES}, {_NEAREST}, r AS (SELECT query_id, memory_id, rank, content_type FROM hits JOIN memories USING (memory_id) WHERE rank <= 30 AND similarity >= 0.2 AND NOT stale AND content_type IN ('decision', 'analysis', 'context', 'conversation')) SELECT query_id, memory_id, content_type FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 10")
def recall_context(spark, d):
    from pyspark.sql import Window

    rows = _found(spark, d, 30, 0.2).where(F.col("content_type").isin(*tb.RECALLED))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("n <= 10").select("query_id", "memory_id",
        "content_type")


@query(f"WITH {_MEMORIES} SELECT memory_id, created_at FROM memories WHERE repo_id = 'src3' AND branch_name = 'main' AND content_type = 'decision' AND NOT stale ORDER BY created_at DESC, memory_id LIMIT 100")
def list_by_type_lang(spark, d):
    return listing.listed(tb.memories(spark, d), repo="src3", branch="main", content_type="decision").select("memory_id", "created_at")


@query(f"WITH {_MEMORIES} SELECT memory_id, language FROM memories WHERE NOT stale AND list_has_all(tags, ['en', 't1'])")
def list_by_tags_all(spark, d):
    return listing.filtered(tb.memories(spark, d), tags=["en", "t1", "t1"]).select("memory_id", "language")


@query(f"WITH {_MEMORIES} SELECT memory_id, file_path FROM memories WHERE NOT stale AND lower(file_path) LIKE 'src/en/f1%'")
def list_by_path_prefix(spark, d):
    return listing.filtered(tb.memories(spark, d), path="SRC/en/f1").select("memory_id", "file_path")


@query(f"WITH {_MEMORIES} SELECT memory_id, function_name AS symbol FROM memories WHERE function_name = 'fn_3' UNION ALL SELECT memory_id, class_name FROM memories WHERE class_name = 'Cls_4'")
def list_by_symbol(spark, d):
    m = tb.memories(spark, d)
    a = listing.filtered(m, function_name="fn_3", include_stale=True).select("memory_id", F.col("function_name").alias("symbol"))
    return a.union(listing.filtered(m, class_name="Cls_4", include_stale=True).select("memory_id", "class_name"))


@query(f"WITH {_MEMORIES} SELECT memory_id, branch_name FROM memories WHERE repo_id = 'src2' AND NOT stale")
def list_cross_branch(spark, d):
    return listing.filtered(tb.memories(spark, d), repo="src2", branch="main", cross_branch=True).select("memory_id", "branch_name")


@query(f"WITH {_MEMORIES} SELECT memory_id, file_path FROM memories WHERE NOT stale ORDER BY file_path, created_at DESC, memory_id LIMIT 20 OFFSET 40")
def list_page(spark, d):
    return listing.listed(tb.memories(spark, d), "file", 20, 40).select("memory_id", "file_path")


@query(f"WITH {_MEMORIES} SELECT memory_id, content_type, sha256(text) AS checksum FROM memories WHERE memory_id = 7 AND branch_name = 'main'")
def retrieve_by_id(spark, d):
    m = tb.memories(spark, d)
    return listing.filtered(m, memory_id=7, branch="main", include_stale=True).select("memory_id", "content_type",
        tx.checksum(F.col("text")).alias("checksum"))


@query(f"WITH {_MEMORIES} SELECT memory_id, created_at, content_type FROM memories WHERE NOT stale ORDER BY created_at DESC, memory_id LIMIT 10")
def recent_context(spark, d):
    return listing.listed(tb.memories(spark, d), limit=10).select("memory_id", "created_at", "content_type")


@query("SELECT doc_id AS memory_id, sha256(text) AS checksum, left(sha256(source), 16) AS path_hash FROM documents")
def scalar_checksum(spark, d):
    return tb.memories(spark, d).select("memory_id", tx.checksum(F.col("text")).alias("checksum"), tx.path_id(F.col("repo_id")).alias("path_hash"))


@query(f"SELECT doc_id AS memory_id, {_TOKENS.format('text')} AS tokens, {_TOKENS.format('text')} <= 200 AS fits FROM documents")
def scalar_tokens(spark, d):
    return tb.memories(spark, d).select("memory_id", tx.tokens(F.col("text")).alias("tokens"), tx.fits(F.col("text"), 200).alias("fits"))


@query(f"SELECT doc_id AS memory_id, {_ONE_LINE} AS one_line FROM documents")
def one_line(spark, d):
    return tb.memories(spark, d).select("memory_id", tx.one_line(F.col("text")).alias("one_line"))


_CUT = r"""CASE WHEN {tokens} <= {budget} THEN {x} WHEN len(regexp_split_to_array(left({x}, {chars}), '[.!?]\s+')) > 1
  THEN array_to_string(regexp_split_to_array(left({x}, {chars}), '[.!?]\s+')[1:-2], '. ') || '.' ELSE left({x}, {chars}) END"""


def _cut_sql(x: str, budget: int) -> str:
    return _CUT.format(x=x, tokens=_TOKENS.format(x), budget=budget, chars=4 * budget)


@query(f"SELECT memory_id, {_cut_sql('p', 500)} AS detailed FROM (SELECT doc_id AS memory_id, split_part(text, E'\\n\\n', 1) AS p, text FROM documents) WHERE {_TOKENS.format('text')} > 200")
def detailed_summary(spark, d):
    return tb.memories(spark, d).select("memory_id", tx.detailed(F.col("text")).alias("detailed")).where("detailed is not null")


@query(f"SELECT doc_id AS memory_id, {_cut_sql('text', 100)} AS cut FROM documents")
def truncate_tokens(spark, d):
    return tb.memories(spark, d).select("memory_id", tx.truncated(F.col("text"), 100).alias("cut"))


@query(f"WITH {_MEMORIES} SELECT memory_id, CASE WHEN function_name IS NOT NULL THEN 'function' WHEN class_name IS NOT NULL THEN 'class' ELSE 'text' END AS chunk_type FROM memories")
def chunk_type(spark, d):
    return tb.memories(spark, d).select("memory_id", tx.chunk_type(F.col("function_name"), F.col("class_name")).alias("chunk_type"))


_SUFFIXES = """('.py', 'python', 'python_ast'), ('.pyw', 'python', 'python_ast'), ('.pyx', 'python', 'python_ast'), ('.pyi', 'python', 'python_ast'), ('.js', 'javascript', 'tree_sitter'),
  ('.mjs', 'javascript', 'tree_sitter'), ('.cjs', 'javascript', 'tree_sitter'), ('.jsx', 'javascript', 'tree_sitter'), ('.ts', 'typescript', 'tree_sitter'), ('.mts', 'typescript', 'tree_sitter'),
  ('.cts', 'typescript', 'tree_sitter'), ('.tsx', 'typescript', 'tree_sitter'), ('.go', 'go', 'tree_sitter'), ('.rs', 'rust', 'tree_sitter'), ('.c', 'c', 'tree_sitter'), ('.h', 'c', 'tree_sitter'),
  ('.cpp', 'cpp', 'tree_sitter'), ('.cc', 'cpp', 'tree_sitter'), ('.cxx', 'cpp', 'tree_sitter'), ('.c++', 'cpp', 'tree_sitter'), ('.hpp', 'cpp', 'tree_sitter'), ('.hh', 'cpp', 'tree_sitter'),
  ('.hxx', 'cpp', 'tree_sitter'), ('.h++', 'cpp', 'tree_sitter'), ('.cs', 'csharp', 'tree_sitter'), ('.java', 'java', 'tree_sitter'), ('.kt', 'kotlin', 'text'), ('.kts', 'kotlin', 'text'),
  ('.scala', 'scala', 'text'), ('.rb', 'ruby', 'text'), ('.php', 'php', 'text'), ('.swift', 'swift', 'text'), ('.svelte', 'svelte', 'tree_sitter'), ('.vue', 'vue', 'text'), ('.md', 'markdown', 'text'),
  ('.markdown', 'markdown', 'text')"""


@query(f"""WITH x(suffix, language, chunker) AS (VALUES {_SUFFIXES}, ('.txt', NULL, 'text'), ('.json', NULL, 'text'), ('', NULL, 'text')),
  p AS (SELECT doc_id, x.*, 'src/a.b/f' || doc_id || CASE WHEN doc_id % 2 = 0 THEN upper(suffix) ELSE suffix END AS file_path FROM documents, x)
  SELECT file_path, language, chunker, language IS NOT NULL AS is_code FROM p""")
def detect_language(spark, d):
    suffixes = F.array(*map(F.lit, [*tx.LANGUAGES, ".txt", ".json", ""]))
    rows = tb.table(spark, d, "documents").select("doc_id", F.explode(suffixes).alias("s"))
    path = F.concat(F.lit("src/a.b/f"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, F.upper("s")).otherwise(F.col("s")))
    return rows.select(path.alias("file_path")).withColumns({"language": tx.language(F.col("file_path")),
        "is_code": tx.is_code(F.col("file_path"))}).withColumn("chunker", tx.chunker(F.col("language")))


@query("""SELECT doc_id AS memory_id, CASE WHEN doc_id % 3 = 0 THEN 'repo/' || source WHEN doc_id % 3 = 1 THEN '/src/' || lang END AS folder FROM documents""")
def scope_folder(spark, d):
    i = F.col("memory_id")
    given = F.when(i % 3 == 0, F.concat(F.lit("repo/"), "repo_id")).when(i % 6 == 1, "")
    path = F.concat(F.when(i % 3 == 2, "").otherwise("/"), F.lit("src/"), "language", F.lit("/f.py"))
    return tb.memories(spark, d).select("memory_id", tx.scope_folder(given, path).alias("folder"))


@query(f"""WITH x(suffix, language, chunker) AS (VALUES {_SUFFIXES}), f AS (SELECT ([suffix FOR suffix IN {[*tx.LANGUAGES, '.txt']}])[doc_id % {len(tx.LANGUAGES) + 1} + 1] AS suffix FROM documents)
  SELECT suffix, language, chunker, count(f.suffix) AS files FROM x LEFT JOIN f USING (suffix) GROUP BY ALL""")
def supported_languages(spark, d):
    """Known suffixes, and how many files of documents have each."""
    suffix = F.element_at(F.array(*map(F.lit, [*tx.LANGUAGES, ".txt"])), (F.col("doc_id") % (len(tx.LANGUAGES) + 1) + 1).cast("int"))
    return tx.supported(tb.table(spark, d, "documents").select(F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), F.upper(suffix)).alias("path")))


@query(f"WITH {_MEMORIES} SELECT memory_id, language, content_type FROM memories WHERE language = 'fr' AND NOT stale ORDER BY content_type, created_at DESC, memory_id LIMIT 50")
def list_by_language(spark, d):
    return listing.listed(tb.memories(spark, d), "type", 50, language="fr").select("memory_id", "language", "content_type")


@query(f"WITH {_MEMORIES} SELECT repo_name || ' (' || repo_id || ')' AS repository, count(*) AS n, count(*) FILTER (WHERE stale) AS n_stale, count(*) * 3 / 1024.0::DOUBLE AS size_mb FROM memories GROUP BY repo_id, repo_name")
def stats_by_repo(spark, d):
    return listing.by_repository(tb.memories(spark, d))


@query(f"WITH {_MEMORIES}, {_NEAREST} SELECT count(*) AS n_vectors, count(DISTINCT repo_id) AS n_repos, ceil(count(*) / 50000.0)::BIGINT AS shards FROM vectors")
def stats_vectors(spark, d):
    return tb.vectors(spark, d).agg(F.count("*").alias("n_vectors"), F.countDistinct("repo_id").alias("n_repos"),
        F.ceil(F.count("*") / 50000.0).cast("long").alias("shards"))


@query(f"WITH {_MEMORIES}, {_NEAREST} SELECT file_path, round(max(similarity), 6) AS best FROM hits JOIN memories USING (memory_id) WHERE rank <= 20 AND NOT stale GROUP BY file_path ORDER BY round(max(similarity), 6) DESC, file_path LIMIT 5")
def best_per_file(spark, d):
    return _found(spark, d, 20, 0.0).groupBy("file_path").agg(F.round(F.max("similarity"), 6).alias("best")).orderBy(F.desc("best"),
        "file_path").limit(5)


@query(f"WITH {_MEMORIES} SELECT memory_id, sha256(text) AS checksum FROM memories QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY created_at, memory_id) > 1")
def dedup_exact(spark, d):
    return maintenance.copies(tb.memories(spark, d)).select("memory_id", "checksum")


@query(f"""WITH {_MEMORIES}, r AS (SELECT memory_id, 1 AS o, 'age' AS reason FROM memories WHERE created_at < {tb.AS_OF} - 30 * 86400 AND content_type = 'conversation'
  UNION ALL SELECT memory_id, 2, 'stale' FROM memories WHERE stale
  UNION ALL SELECT memory_id, 3, 'duplicate' FROM (SELECT memory_id FROM memories QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY created_at, memory_id) > 1))
  SELECT memory_id, min_by(reason, o) AS reason FROM r GROUP BY memory_id""")
def cleanup_preview(spark, d):
    return maintenance.cleanup(tb.memories(spark, d), tb.AS_OF, 30, "conversation", True, True)


@query(f"WITH {_MEMORIES} SELECT memory_id, content_type FROM memories WHERE (content_type = 'conversation' AND created_at < {tb.AS_OF} - 30 * 86400) OR (content_type = 'context' AND created_at < {tb.AS_OF} - 20 * 86400)")
def ttl_expired(spark, d):
    return maintenance.expired(tb.memories(spark, d), tb.AS_OF, conversation_days=30, context_days=20).select("memory_id", "content_type")


def _hashes(spark, d):
    first = tb.memories(spark, d).groupBy(F.col("file_path").alias("path")).agg(F.min_by("text", "memory_id").alias("t"),
        F.min("memory_id").alias("i"))
    old = first.select("path", F.sha2("t", 256).alias("sha256"))
    new = first.where("i % 10 <> 1").select("path",
        F.when(F.col("i") % 4 == 0, F.sha2(F.concat("t", F.lit("!")), 256)).otherwise(F.sha2("t", 256)).alias("sha256"))
    return old, new.union(spark.sql("SELECT concat('new/f', id) AS path, sha2(cast(id AS string), 256) AS sha256 FROM range(3)"))


_HASHES = f"""{_MEMORIES}, f AS (SELECT file_path AS path, min_by(text, memory_id) AS t, min(memory_id) AS i FROM memories GROUP BY file_path),
  a AS (SELECT path, sha256(t) AS h FROM f), b AS (SELECT path, sha256(CASE WHEN i % 4 = 0 THEN t || '!' ELSE t END) AS h FROM f WHERE i % 10 <> 1 UNION ALL SELECT 'new/f' || i, sha256(i::VARCHAR) FROM range(3) r(i)),
  changed AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.h IS DISTINCT FROM b.h)"""


@query(f"WITH {_HASHES} SELECT path, change FROM changed")
def changed_files(spark, d):
    return maintenance.changes(*_hashes(spark, d))


@query(f"WITH {_HASHES} SELECT memory_id, stale OR (path IS NOT NULL AND content_type IN ('code_snippet', 'relationship')) AS stale, CASE WHEN stale THEN 'File changed in commit abc12345' WHEN path IS NOT NULL AND content_type IN ('code_snippet', 'relationship') THEN 'File changed in commit 0123abcd' END AS stale_reason FROM memories LEFT JOIN changed ON file_path = path")
def mark_stale(spark, d):
    return maintenance.marked_stale(tb.memories(spark, d), maintenance.changes(*_hashes(spark, d)), "0123abcdef").select("memory_id", "stale",
        "stale_reason")


@query(f"WITH {_MEMORIES} SELECT repo_id, branch_name, max_by('c' || memory_id, created_at * 1000000 + memory_id) AS commit FROM memories GROUP BY ALL")
def last_commit(spark, d):
    log = tb.memories(spark, d).select("repo_id", "branch_name", F.concat(F.lit("c"), F.col("memory_id").cast("string")).alias("commit"),
        (F.col("created_at") * 1000000 + F.col("memory_id")).alias("at"))
    return maintenance.last_commits(log)


_CENTROIDS = f"""{_MEMORIES}, {_NEAREST}, x AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM vectors, range(1, 65) r(i) WHERE label < 6 GROUP BY label, i),
  c AS (SELECT label, list(m / n ORDER BY i) AS centroid FROM x JOIN (SELECT label, sqrt(sum(m * m)) AS n FROM x GROUP BY label) USING (label) GROUP BY label)"""
_INTENTS = "['coding', 'debugging', 'architecture', 'testing', 'review', 'general']"


@query(f"WITH {_CENTROIDS} SELECT ({_INTENTS})[label + 1] AS intent, len(centroid)::INT AS dims, round(centroid[1], 6) AS first, round(centroid[64], 6) AS last FROM c")
def intent_centroids(spark, d):
    c = search.centroids(tb.vectors(spark, d), sc.INTENTS)
    return c.select("intent", F.size("centroid").alias("dims"), F.round(F.element_at("centroid", 1), 6).alias("first"),
        F.round(F.element_at("centroid", 64), 6).alias("last"))


def _phrases(spark, d):
    """What users said, as phrases of an intent for each conversation."""
    name = F.element_at(F.array(*map(F.lit, sc.INTENTS)), (F.col("conv_id") % 6 + 1).cast("int"))
    return tb.table(spark, d, "conversations").where("role = 'user'").select(name.alias("intent"), "text")


_PHRASE_CENTROIDS = f"""phrases AS (SELECT row_number() OVER () AS id, place, text FROM (SELECT DISTINCT conv_id % 6 AS place, text FROM conversations WHERE role = 'user' AND trim(coalesce(text, ''), ' ') <> '')), {_embedded_sql('phrases', 'pv')},
  pm AS (SELECT place, i, avg(v[i]::DOUBLE) AS m FROM phrases JOIN pv USING (id), range(1, 65) r(i) GROUP BY place, i),
  pc AS (SELECT place, list(m / n ORDER BY i) AS centroid FROM pm JOIN (SELECT place, sqrt(sum(m * m)) AS n FROM pm GROUP BY place) USING (place) GROUP BY place)"""


@query(f"WITH {_PHRASE_CENTROIDS} SELECT ({_INTENTS})[place + 1] AS intent, place::INT AS place, list_transform(centroid, lambda x: round(x, 6) + 0) AS centroid FROM pc")
def phrase_centroids(spark, d):
    found = search.phrase_centroids(_phrases(spark, d))
    return found.withColumn("centroid", F.transform("centroid", lambda x: F.round(x, 6) + 0.0))


@query(f"""WITH docs AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents), {_embedded_sql('docs', 'dv')}, {_PHRASE_CENTROIDS},
  x AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda e: e::DOUBLE * e::DOUBLE))) AS n FROM dv),
  s AS (SELECT id, place, CASE WHEN n > 0 THEN list_sum(list_transform(range(1, 65), lambda i: v[i]::DOUBLE * centroid[i])) / n ELSE 0 END AS score, n FROM x, pc),
  b AS (SELECT id, max_by(place, round(score, 12) * 1e6 - place * 1e-9) AS place, CASE WHEN any_value(n) > 0 THEN least(greatest(max(round(score, 12)), 0), 1) ELSE 0 END AS confidence, any_value(n) AS n FROM s GROUP BY id)
  SELECT id AS query_id, CASE WHEN n = 0 OR confidence < 0.3 THEN 'general' ELSE ({_INTENTS})[place + 1] END AS intent, round(confidence, 6) AS confidence FROM b""")
def classify_texts(spark, d):
    """Every document as a prompt: its text against the centroids of phrases."""
    prompts = search.embedded(tb.memories(spark, d).select("memory_id", "text")).withColumnRenamed("memory_id", "query_id")
    return search.classified(prompts, search.phrase_centroids(_phrases(spark, d))).withColumn("confidence", F.round("confidence", 6))


def _intents(spark, d, prompts=None):
    v = tb.vectors(spark, d)
    prompts = v.select(F.col("memory_id").alias("query_id"), "embedding") if prompts is None else prompts
    return search.classified(prompts, search.centroids(v, sc.INTENTS))


_CLASSIFIED = f"""{_CENTROIDS}, s AS (SELECT vec_id AS query_id, label, list_sum(list_transform(range(1, 65), lambda i: v.embedding[i]::DOUBLE * c.centroid[i])) / sqrt(list_sum(list_transform(v.embedding, lambda e: e::DOUBLE * e::DOUBLE))) AS score FROM (SELECT vec_id, embedding FROM vectors) v, c),
  best AS (SELECT query_id, ({_INTENTS})[max_by(label, round(score, 12) * 1e6 - label * 1e-9) + 1] AS intent, least(greatest(max(score), 0.0), 1.0) AS confidence FROM s GROUP BY query_id),
  intents AS (SELECT query_id, CASE WHEN confidence < 0.3 THEN 'general' ELSE intent END AS intent, confidence FROM best)"""


@query(f"WITH {_CLASSIFIED} SELECT query_id, intent, round(confidence, 6) AS confidence FROM intents")
def classify_intent(spark, d):
    return _intents(spark, d).select("query_id", "intent", F.round("confidence", 6).alias("confidence"))


_PRIORITIES = """p(intent, content_type, priority) AS (VALUES ('coding', 'code_snippet', 1.0), ('coding', 'context', 0.7), ('coding', 'decision', 0.4), ('coding', 'relationship', 0.2),
  ('debugging', 'analysis', 1.0), ('debugging', 'code_snippet', 0.7), ('debugging', 'context', 0.4), ('debugging', 'conversation', 0.2),
  ('architecture', 'decision', 1.0), ('architecture', 'analysis', 0.7), ('architecture', 'context', 0.4), ('architecture', 'summary', 0.2),
  ('testing', 'code_snippet', 1.0), ('testing', 'analysis', 0.7), ('testing', 'context', 0.4), ('testing', 'decision', 0.2),
  ('review', 'code_snippet', 1.0), ('review', 'decision', 0.7), ('review', 'context', 0.4), ('review', 'analysis', 0.2),
  ('general', 'context', 1.0), ('general', 'decision', 0.7), ('general', 'conversation', 0.4), ('general', 'summary', 0.2))"""


@query(f"WITH {_MEMORIES}, {_PRIORITIES} SELECT i.intent, m.content_type, coalesce(p.priority, 0.1)::DOUBLE AS priority, m.n FROM (SELECT content_type, count(*) AS n FROM memories GROUP BY content_type) m, (SELECT unnest({_INTENTS[:-1]}, 'unheard of']) AS intent) i LEFT JOIN p ON p.content_type = m.content_type AND p.intent = CASE WHEN i.intent = 'unheard of' THEN 'general' ELSE i.intent END")
def type_priority(spark, d):
    intents = spark.createDataFrame([(i,) for i in (*sc.INTENTS, "unheard of")], "intent string")
    counts = tb.memories(spark, d).groupBy("content_type").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(intents)).select("intent", "content_type",
        sc.type_priority(F.col("intent"), F.col("content_type")).alias("priority"), "n")


def _ranked(spark, d):
    return context.ranked(tb.derived(_found(spark, d, 20, context.SEARCH_FLOOR)), _intents(spark, d, _prompts(spark, d)), tb.AS_OF)


_COMPOSITES = f"""{_CLASSIFIED}, {_PRIORITIES}, scored AS (SELECT query_id, memory_id, 0.6 * similarity + 0.3 * coalesce(priority, 0.1)::DOUBLE + 0.1 * greatest(0.3, exp(-(({tb.AS_OF} - created_at) / 86400.0::DOUBLE) / 60)) AS composite
  FROM hits JOIN memories m USING (memory_id) JOIN intents i USING (query_id) LEFT JOIN p ON p.intent = i.intent AND p.content_type = m.content_type WHERE rank <= 20 AND similarity >= 0.25 AND NOT stale)"""


@query(f"WITH {_COMPOSITES} SELECT query_id, memory_id, round(composite, 6) AS composite FROM scored")
def composite_rank(spark, d):
    return _ranked(spark, d).select("query_id", "memory_id", F.round("composite", 6).alias("composite"))


@query(f"WITH {_COMPOSITES} SELECT vec_id AS query_id, CASE WHEN max(composite) IS NULL THEN 200 ELSE least(greatest(trunc(800 * (0.3 + 0.9 * max(composite)))::INT, 200), 1200) END AS budget FROM vectors LEFT JOIN scored ON vec_id = query_id WHERE vec_id % 20 = 0 GROUP BY vec_id")
def effective_budget(spark, d):
    return context.adaptive(_ranked(spark, d), _prompts(spark, d).select("query_id")).select("query_id", "budget")


def _entries_sql(rows: str, budgets: str, name: str) -> str:
    """CTEs that fill each prompt's budget from rows (query_id, memory_id, rank, composite): name, with query_id, lines and used."""
    own = "trim(text, E' \\n\\t\\r')"
    return f"""{name}_t AS (SELECT s.query_id, s.composite, s.rank, content_type, file_path, text, {_ONE_LINE} AS one_line, CASE WHEN {_TOKENS.format('text')} > 200 THEN {_cut_sql("split_part(text, E'\\n\\n', 1)", 500)} END AS detailed FROM {rows} s JOIN memories m USING (memory_id)),
  {name}_e AS (SELECT *, '- [' || content_type || '] ' || one_line AS brief, '- [' || content_type || '] ' || one_line || ' -- ' || file_path AS medium,
    '- [' || content_type || '] ' || CASE WHEN {_TOKENS.format(own)} <= 300 THEN {own} WHEN coalesce(detailed, '') <> '' THEN detailed ELSE one_line END AS whole FROM {name}_t),
  {name}_o AS (SELECT query_id, CASE WHEN composite >= 0.75 THEN [whole, medium, brief] WHEN composite >= 0.55 THEN [medium, brief] WHEN composite >= 0.4 THEN [brief] ELSE [] END AS texts, row_number() OVER (PARTITION BY query_id ORDER BY composite DESC, rank) AS place FROM {name}_e),
  {name}_r(query_id, place, used, lines) AS (SELECT query_id, 0::BIGINT, 0, []::VARCHAR[] FROM {budgets} UNION ALL
    SELECT query_id, o.place, used + CASE WHEN o.fit IS NULL THEN 0 ELSE {_TOKENS.format('o.fit')} END, CASE WHEN o.fit IS NULL THEN lines ELSE list_append(lines, o.fit) END
    FROM (SELECT r.query_id, o.place, r.used, r.lines, list_filter(o.texts, lambda t: {_TOKENS.format('t')} <= b.budget - r.used)[1] AS fit FROM {name}_r r JOIN {name}_o o ON o.query_id = r.query_id AND o.place = r.place + 1 JOIN {budgets} b ON b.query_id = r.query_id) o),
  {name} AS (SELECT query_id, lines, used FROM {name}_r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place DESC) = 1)"""


_SPENT = "least(greatest(trunc(800 * (0.3 + 0.9 * max(composite)))::INT, 200), 1200)"


@query(f"""WITH RECURSIVE {_COMPOSITES}, ranked AS (SELECT s.*, h.rank FROM scored s JOIN hits h USING (query_id, memory_id)),
  budgets AS (SELECT vec_id AS query_id, CASE WHEN max(composite) IS NULL THEN 200 ELSE {_SPENT} END AS budget FROM vectors LEFT JOIN scored ON vec_id = query_id WHERE vec_id % 20 = 0 GROUP BY vec_id),
  {_entries_sql('ranked', 'budgets', 'filled')}
  SELECT query_id, CASE WHEN len(lines) > 0 THEN array_to_string(lines, E'\\n') END AS block, len(lines)::INT AS entries, used, budget FROM filled JOIN budgets USING (query_id)""")
def adaptive_block(spark, d):
    return context.adaptive(_ranked(spark, d), _prompts(spark, d).select("query_id"))


@query(f"""WITH RECURSIVE {_MEMORIES}, {_NEAREST}, t AS (SELECT query_id, rank, content_type NOT IN ('code_snippet', 'relationship') AS lasts, m.*, {_ONE_LINE} AS one_line FROM hits JOIN memories m USING (memory_id) WHERE rank <= 20 AND similarity >= 0.25 AND NOT stale),
  e AS (SELECT *, row_number() OVER (PARTITION BY query_id, lasts ORDER BY rank) AS nth, CASE WHEN lasts THEN '- [' || content_type || '] ' || CASE WHEN {_TOKENS.format('text')} <= 200 THEN trim(text, E' \\n\\t\\r') ELSE one_line END
    ELSE '- [code] ' || one_line || ' — ' || file_path || ':' || line_start || '-' || line_end END AS line FROM t),
  o AS (SELECT query_id, lasts, line, {_TOKENS.format('line')} AS n, row_number() OVER (PARTITION BY query_id ORDER BY lasts DESC, nth) AS place FROM e WHERE lasts OR nth <= 3),
  r(query_id, place, used, closed, lines) AS (SELECT vec_id, 0::BIGINT, 0, false, []::VARCHAR[] FROM vectors WHERE vec_id % 20 = 0 UNION ALL
    SELECT r.query_id, o.place, CASE WHEN NOT closed AND used + n <= 800 THEN used + n ELSE used END, closed OR (NOT lasts AND used + n > 800), CASE WHEN NOT closed AND used + n <= 800 THEN list_append(lines, line) ELSE lines END
    FROM r JOIN o ON o.query_id = r.query_id AND o.place = r.place + 1)
  SELECT query_id, CASE WHEN len(lines) > 0 THEN array_to_string(lines, E'\\n') END AS block, len(lines)::INT AS entries FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place DESC) = 1""")
def legacy_block(spark, d):
    return context.legacy(_ranked(spark, d), tb.PERSISTENT, prompts=_prompts(spark, d))


def _smart(spark, d):
    m = tb.memories(spark, d)
    # What has expired takes no place among the nearest. Ids go to the vectors, as long as they are few.
    gone = small(maintenance.expired(m, tb.AS_OF, 30, 20).select("memory_id"))
    hits = search.similar(tb.vectors(spark, d).join(gone, "memory_id", "left_anti"), _prompts(spark, d), m, 20, context.SEARCH_FLOOR)
    return context.smart(tb.derived(hits), _intents(spark, d, _prompts(spark, d)), tb.skills(spark, d), tb.AS_OF)


def _skills_sql(budget: int) -> str:
    """CTEs that choose the skills of each intent: chosen, with intent, names, used and prompts."""
    return f"""skill_f AS (SELECT conv_id, min_by(text, turn) AS prompt FROM conversations GROUP BY conv_id),
  skill_s AS (SELECT 'skill_' || lpad(conv_id::VARCHAR, 9, '0') AS name, (['debugging', 'coding', 'general'])[conv_id % 3 + 1] AS intent, conv_id * 7 % 10 AS priority, trim(prompt, E' \\n\\t\\r') AS prompt, {_TOKENS.format('prompt')} AS n FROM skill_f WHERE trim(coalesce(prompt, '')) <> ''),
  skill_o AS (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY priority DESC, name) AS place FROM skill_s),
  skill_r(intent, place, used, names, prompts) AS (SELECT DISTINCT intent, 0::BIGINT, 0, []::VARCHAR[], []::VARCHAR[] FROM skill_o UNION ALL
    SELECT o.intent, o.place, CASE WHEN used + n <= {budget} THEN used + n ELSE used END, CASE WHEN used + n <= {budget} THEN list_append(names, name) ELSE names END, CASE WHEN used + n <= {budget} THEN list_append(prompts, prompt) ELSE prompts END
    FROM skill_r r JOIN skill_o o ON o.intent = r.intent AND o.place = r.place + 1),
  chosen AS (SELECT intent, names, used, CASE WHEN len(prompts) > 0 THEN array_to_string(prompts, E'\\n') END AS block FROM skill_r QUALIFY row_number() OVER (PARTITION BY intent ORDER BY place DESC) = 1)"""


# As _COMPOSITES, but what has expired takes no place among the nearest.
_SMART = f"""WITH RECURSIVE {_CLASSIFIED}, {_PRIORITIES}, {_skills_sql(300)},
  lasting AS (SELECT v.* FROM vectors v JOIN memories m ON v.vec_id = m.memory_id WHERE NOT ((content_type = 'conversation' AND created_at < {tb.AS_OF} - 30 * 86400) OR (content_type = 'context' AND created_at < {tb.AS_OF} - 20 * 86400))),
  near AS (SELECT q.vec_id AS query_id, v.vec_id AS memory_id, list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: (q.embedding[i]::DOUBLE - v.embedding[i]::DOUBLE) ^ 2)) AS distance
    FROM lasting v JOIN vectors q ON v.repo_id = q.repo_id AND v.branch_name = q.branch_name WHERE q.vec_id % 20 = 0),
  nearest AS (SELECT query_id, memory_id, exp(-distance) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), memory_id) AS rank FROM near),
  ranked AS (SELECT query_id, memory_id, rank, 0.6 * similarity + 0.3 * coalesce(priority, 0.1)::DOUBLE + 0.1 * greatest(0.3, exp(-(({tb.AS_OF} - created_at) / 86400.0::DOUBLE) / 60)) AS composite
    FROM nearest JOIN memories m USING (memory_id) JOIN intents i USING (query_id) LEFT JOIN p ON p.intent = i.intent AND p.content_type = m.content_type WHERE rank <= 20 AND similarity >= 0.25 AND NOT stale),
  asked AS (SELECT i.query_id, i.intent, i.confidence, c.block AS skill_block, coalesce({_TOKENS.format('c.block')}, 0) AS skill_tokens FROM intents i LEFT JOIN chosen c USING (intent) WHERE query_id % 20 = 0),
  budgets AS (SELECT query_id, CASE WHEN max(composite) IS NULL THEN 200 ELSE greatest({_SPENT} - any_value(skill_tokens), 0) END AS budget FROM asked LEFT JOIN ranked USING (query_id) GROUP BY query_id),
  {_entries_sql('ranked', 'budgets', 'filled')},
  smart AS (SELECT query_id, intent, confidence, nullif(concat_ws(E'\\n\\n', skill_block, CASE WHEN len(lines) > 0 THEN array_to_string(lines, E'\\n') END), '') AS block, len(lines)::INT AS entries, used, budget FROM filled JOIN budgets USING (query_id) JOIN asked USING (query_id))"""


@query(f"{_SMART} SELECT query_id, intent, round(confidence, 6) AS confidence, block, entries, used, budget FROM smart")
def smart_block(spark, d):
    return _smart(spark, d).withColumn("confidence", F.round("confidence", 6))


@query(f"{_SMART}, m AS (SELECT query_id, E'Relevant memories from previous sessions:\\n' || block AS message FROM smart) SELECT query_id, message, coalesce({_TOKENS.format('message')}, 0) AS tokens FROM m")
def inject_message(spark, d):
    return context.injected(_smart(spark, d))


@query(f"WITH RECURSIVE {_skills_sql(500)} SELECT intent, array_to_string(names, ',') AS names, used, block FROM chosen")
def select_skills(spark, d):
    return context.selected_skills(tb.skills(spark, d), 500)


def _requests(spark, d):
    """A list of ids for every twentieth memory: later ones first, one of them missing."""
    i = F.col("memory_id")
    return tb.memories(spark, d).where(i % 20 == 0).select(i.alias("request_id"),
        F.array(i + 3, i, i + 25, F.lit(-1).cast("long"), i + 1, i + 28).alias("ids"))


@query(f"""WITH {_MEMORIES}, r AS (SELECT memory_id AS request_id, unnest([memory_id + 3, memory_id, memory_id + 25, -1, memory_id + 1, memory_id + 28]) AS id, generate_subscripts([1, 2, 3, 4, 5, 6], 1) AS pos FROM memories WHERE memory_id % 20 = 0),
  j AS (SELECT request_id, pos, file_path AS f, {_ONE_LINE} AS one_line FROM r JOIN memories m ON m.memory_id = r.id),
  k AS (SELECT *, row_number() OVER (PARTITION BY request_id, f ORDER BY pos) AS nth, min(pos) OVER (PARTITION BY request_id, f) AS ff FROM j),
  l AS (SELECT request_id, ff, pos, 0 AS k, E'\\n## ' || f || E'\\n' AS piece FROM k WHERE nth = 1 UNION ALL SELECT request_id, ff, pos, 1, '- ' || one_line || E'\\n' FROM k),
  t AS (SELECT *, sum({_TOKENS.format('piece')}) OVER (PARTITION BY request_id ORDER BY ff, pos, k) AS running FROM l),
  s AS (SELECT request_id, string_agg(piece, '' ORDER BY ff, pos, k) AS summary FROM t WHERE running <= 60 GROUP BY request_id)
  SELECT memory_id AS request_id, coalesce(summary, '') AS summary, {_TOKENS.format("coalesce(summary, '')")} AS token_count, 6 AS memories_included FROM memories LEFT JOIN s ON memory_id = request_id WHERE memory_id % 20 = 0""")
def summarize_ids(spark, d):
    return context.summarised(_requests(spark, d), tb.derived(tb.memories(spark, d)), 60)


@query(f"""WITH {_MEMORIES}, m AS (SELECT repo_id, memory_id, file_path, {_ONE_LINE} AS one_line, row_number() OVER (PARTITION BY repo_id, file_path ORDER BY memory_id) AS nth, min(memory_id) OVER (PARTITION BY repo_id, file_path) AS ff FROM memories),
  l AS (SELECT *, CASE WHEN nth = 1 THEN E'\\n## ' || file_path || E'\\n' ELSE '' END || '- ' || one_line || E'\\n' AS line FROM m),
  r AS (SELECT *, sum({_TOKENS.format('line')}) OVER (PARTITION BY repo_id ORDER BY ff, nth, memory_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM l)
  SELECT repo_id, file_path, memory_id, line, running FROM r WHERE running <= 500""")
def summarize_by_file(spark, d):
    return context.summary_lines(tb.derived(tb.memories(spark, d)), 500)


@query(f"""WITH {_MEMORIES}, {_VECTORS},
  n AS (SELECT vec_id + 1000000000 AS query_id, list_prepend(embedding[1]::DOUBLE * 1.01::DOUBLE, list_transform(embedding[2:], lambda e: e::DOUBLE)) AS embedding, repo_id, branch_name FROM vectors WHERE vec_id % 20 = 0),
  d AS (SELECT query_id, v.vec_id AS memory_id, list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: (n.embedding[i] - v.embedding[i]::DOUBLE) ^ 2)) AS distance FROM n JOIN vectors v USING (repo_id, branch_name))
  SELECT query_id, memory_id, round(exp(-distance), 6) AS similarity FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), memory_id) = 1 AND exp(-distance) >= 0.97""")
def near_dup_capture(spark, d):
    v = tb.vectors(spark, d)
    first = F.transform("embedding", lambda x, i: F.when(i == 0, x * F.lit(1.01)).otherwise(x))
    new = v.where("memory_id % 20 = 0").select((F.col("memory_id") + 1_000_000_000).alias("query_id"), first.alias("embedding"), "repo_id",
        "branch_name")
    return search.near_copies(v, new, scoped=("repo_id", "branch_name")).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH RECURSIVE turns AS (SELECT conv_id, turn, coalesce(text, '') AS text, row_number() OVER (ORDER BY conv_id, turn) AS id FROM conversations), {_embedded_sql('turns', 'tv')},
  stored AS (SELECT DISTINCT v FROM turns JOIN tv USING (id) WHERE conv_id % 2 = 0 AND turn % 2 = 0),
  items AS (SELECT conv_id AS session_id, turn + k * 1000000 AS place, v FROM turns JOIN tv USING (id), (VALUES (0), (1)) x(k)),
  fresh AS (SELECT *, list_max(v) <> 0 OR list_min(v) <> 0 AS words FROM items i WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE exp(-{_apart_sql('s.v', 'i.v')}) >= 0.97)),
  o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY place) AS nth FROM fresh),
  r(session_id, nth, kept, places) AS (SELECT DISTINCT session_id, 0::BIGINT, []::FLOAT[][], []::BIGINT[] FROM o UNION ALL
    SELECT session_id, nth, CASE WHEN again THEN kept ELSE list_append(kept, v) END, CASE WHEN again THEN places ELSE list_append(places, place) END
    FROM (SELECT r.session_id, o.nth, r.kept, r.places, o.v, o.place, o.words AND len(list_filter(r.kept, lambda k: exp(-{_apart_sql('k', 'o.v')}) >= 0.97)) > 0 AS again FROM r JOIN o ON o.session_id = r.session_id AND o.nth = r.nth + 1)),
  l AS (SELECT session_id, places FROM r QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY nth DESC) = 1)
  SELECT session_id, unnest(places) AS place FROM l""")
def capture_unstored(spark, d):
    """Turns as items: those that no stored document and no earlier item of their conversation is like."""
    t = tb.table(spark, d, "conversations")
    items = t.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("place"), F.coalesce("text", F.lit("")).alias("text"))
    texts = items.unionByName(items.withColumn("place", F.col("place") + 1_000_000))
    stored = search.embedded(items.where("session_id % 2 = 0 and place % 2 = 0").select(F.xxhash64("session_id", "place").alias("memory_id"), "text"))
    return capturing.not_stored(texts, stored).select("session_id", "place")


def said(asked: list[tuple[str, str]]) -> list[str | None]:
    """An extractor without a model: each thing that the user said, by turns; for some lengths of text it breaks, for others it has no reply."""
    out: list[str | None] = []
    for _, text in asked:
        turns = [t.removeprefix("user: ") for t in text.split("\n\n") if t.startswith("user: ")]
        if len(text) % 5 == 0:
            raise ValueError("a text of a length that this extractor doesn't take")
        out.append(json.dumps([{"type": "decision", "content": t, "tags": ["said"]} for t in turns]) if turns and len(text) % 7 else None)
    return out


def _replies(spark, d):
    """Whole transcripts and what the extractor makes of them."""
    return capturing.replies(capturing.to_capture(_lines(spark, d), 1_000_000_000), said)


def _sessions_sql(last: int, name: str) -> str:
    """CTEs of compressed transcripts of the last lines of each conversation: name, with session_id and text."""
    noise = r"(?s:(assistant:\s*)?<tool_use>.*?</tool_use>|<tool_result>.*?</tool_result>)"
    return rf"""{name}_l AS (SELECT conv_id, turn, role, role || ': ' || coalesce(text, '') AS line FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= {last}),
  {name}_t AS (SELECT conv_id::VARCHAR AS session_id, string_agg(line, E'\n\n' ORDER BY turn) AS t FROM {name}_l WHERE role IN ('user', 'assistant') GROUP BY conv_id),
  {name}_c AS (SELECT session_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '{noise}', '', 'g'), '(?s:<system-reminder>.*?</system-reminder>)', '', 'g'), '[▓░█▌▐]{{3,}}|\.{{6,}}|={{5,}}>?', '', 'g'), '\n{{3,}}', E'\n\n', 'g'), E' \n\t\r') AS text FROM {name}_t),
  {name} AS (SELECT * FROM {name}_c WHERE text <> '')"""


_ASKED = f"""{_sessions_sql(1_000_000_000, 'whole')}, said AS (SELECT session_id, text, list_filter(string_split(text, E'\\n\\n'), lambda t: starts_with(t, 'user: ')) AS turns FROM whole),
  replied AS (SELECT *, CASE WHEN length(text) % 5 = 0 THEN 'failed' WHEN len(turns) > 0 AND length(text) % 7 <> 0 THEN 'extracted' ELSE 'passthrough' END AS status FROM said)"""


@query(f"""WITH {_ASKED} SELECT session_id, status, CASE WHEN status = 'failed' THEN 'ValueError: a text of a length that this extractor doesn''t take' END AS error, CASE WHEN status = 'extracted' THEN len(turns) ELSE 0 END::INT AS items,
  CASE WHEN status <> 'extracted' THEN sha256(E'Find the facts in this text that are worth keeping and store each as a decision, analysis, context, conversation or summary.\\n\\n---\\n' || text || E'\\n---\\n') END AS prompt_sha256 FROM replied""")
def capture_replies(spark, d):
    items = F.size(capturing.items(F.col("reply")))
    return _replies(spark, d).select("session_id", "status", "error", items.alias("items"), F.sha2("prompt", 256).alias("prompt_sha256"))


@query(f"""WITH RECURSIVE {_MEMORIES}, {_ASKED}, docs AS (SELECT memory_id AS id, coalesce(text, '') AS text FROM memories WHERE NOT stale), {_embedded_sql('docs', 'dv')}, stored AS (SELECT DISTINCT v FROM dv),
  things AS (SELECT session_id, generate_subscripts(turns, 1) - 1 AS place, trim(substr(unnest(turns), 7), E' \\n\\t\\r') AS text FROM replied WHERE status = 'extracted'),
  items AS (SELECT *, row_number() OVER (ORDER BY session_id, place) AS id FROM things WHERE text <> ''), {_embedded_sql('items', 'iv')},
  fresh AS (SELECT *, list_max(v) <> 0 OR list_min(v) <> 0 AS words FROM items JOIN iv i USING (id) WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE exp(-{_apart_sql('s.v', 'i.v')}) >= 0.97)),
  o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY place) AS nth FROM fresh),
  r(session_id, nth, kept, ids) AS (SELECT DISTINCT session_id, 0::BIGINT, []::FLOAT[][], []::BIGINT[] FROM o UNION ALL
    SELECT session_id, nth, CASE WHEN again THEN kept ELSE list_append(kept, v) END, CASE WHEN again THEN ids ELSE list_append(ids, id) END
    FROM (SELECT r.session_id, o.nth, r.kept, r.ids, o.v, o.id, o.words AND len(list_filter(r.kept, lambda k: exp(-{_apart_sql('k', 'o.v')}) >= 0.97)) > 0 AS again FROM r JOIN o ON o.session_id = r.session_id AND o.nth = r.nth + 1)),
  l AS (SELECT unnest(ids) AS id FROM (SELECT ids FROM r QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY nth DESC) = 1))
  SELECT session_id, place::INT AS place, 'decision' AS content_type, text, 'said' AS tags FROM items JOIN l USING (id)""")
def capture_job(spark, d):
    """From transcripts to what is stored: compressed, extracted, and compared with documents and with what a session said before."""
    m = tb.memories(spark, d).where("not stale")
    items = capturing.captured(_replies(spark, d), search.embedded(m.select("memory_id", "text")))
    return items.select("session_id", "place", "content_type", "text", F.array_join("tags", ",").alias("tags"))


@query(f"""WITH {_MEMORIES}, {_sessions_sql(50, 'late')}, m AS (SELECT * FROM memories WHERE NOT stale),
  asked AS (SELECT session_id AS id, left(text, 500) AS text FROM late UNION ALL SELECT 'm' || memory_id, left(text, 500) FROM m WHERE memory_id % 20 = 0), {_embedded_sql('asked', 'qv')},
  docs AS (SELECT memory_id AS id, coalesce(text, '') AS text FROM m), {_embedded_sql('docs', 'dv')},
  h AS (SELECT q.id AS session_id, d.id AS memory_id, {_apart_sql('q.v', 'd.v')} AS distance FROM qv q, dv d),
  n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY round(distance, 9), memory_id) AS rank FROM h QUALIFY rank <= 5),
  k AS (SELECT session_id, rank, '[' || content_type || '] ' || {_ONE_LINE} AS line FROM n JOIN m USING (memory_id) WHERE exp(-distance) >= 0.85)
  SELECT session_id, string_agg(line, E'\\n' ORDER BY rank) AS known FROM k GROUP BY session_id""")
def known_summaries(spark, d):
    """For each conversation, lines of the documents that are most like the beginning of its transcript."""
    sessions = capturing.to_capture(_lines(spark, d), 50)
    m = tb.derived(tb.memories(spark, d).where("not stale"))
    mixed = sessions.unionByName(m.where("memory_id % 20 = 0").select(F.concat(F.lit("m"), F.col("memory_id").cast("string")).alias("session_id"),
        "text"))
    return capturing.known_for(mixed, search.embedded(m.select("memory_id", "text")), m).select("session_id",
        F.array_join("known", "\n").alias("known"))


def _lines(spark, d):
    return tb.table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("line_no"),
        F.to_json(F.struct("role", F.col("text").alias("content"))).alias("line"))


@query("""WITH c AS (SELECT conv_id, turn, role, role || ': ' || coalesce(text, '') AS line FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3)
  SELECT conv_id::VARCHAR AS session_id, string_agg(line, E'\\n\\n' ORDER BY turn) AS transcript FROM c WHERE role IN ('user', 'assistant') GROUP BY conv_id""")
def transcript_tail(spark, d):
    return fl.tail(_lines(spark, d), 3)


@query(r"""SELECT conv_id, turn, trim(regexp_replace('A' || E'\n\n' || text || E'\n\nassistance: \n\nB', '\n{3,}', E'\n\n', 'g'), E' \n\t\r') AS text FROM conversations""")
def compress_basic(spark, d):
    noisy = F.concat(
        F.lit("A<system-reminder>x\ny</system-reminder>\n\n\n\n"), "text",
            F.lit("\n\n\n=====>\n\nassistance: █▌▐▓\nassistant: <tool_use>z\n</tool_use>"),
        F.lit("Relevant memories from previous sessions:\n- [decision] one\n- [code] two — a.py:1-2\n......\n<tool_result>r</tool_result>\nB"),
    )
    return tb.table(spark, d, "conversations").select("conv_id", "turn", tx.compressed(noisy).alias("text"))


@query(r"""SELECT doc_id AS memory_id, E'## Problem\n' || source || E'\n\n## Alternatives\n- ' || lang || E'\n- none\n\n## Chosen\n' || lang || E'\n\n## Rationale\n' || source || E'\n\n## Outcome\n' || CASE WHEN doc_id % 2 = 0 THEN 'done' ELSE 'TBD' END AS text FROM documents""")
def decision_markdown(spark, d):
    t = tb.table(spark, d, "documents")
    return t.select(F.col("doc_id").alias("memory_id"),
        tx.decision(F.col("source"), F.array(F.col("lang"), F.lit("none")), F.col("lang"), F.col("source"),
        F.when(F.col("doc_id") % 2 == 0, "done")).alias("text"))


@query("""SELECT d.doc_id AS memory_id, CASE WHEN d.doc_id % 2 = 0 AND a.doc_id IS NOT NULL THEN [a.doc_id] ELSE [] END AS depends_on, CASE WHEN d.doc_id % 3 = 0 AND b.doc_id IS NOT NULL THEN [b.doc_id] ELSE [] END AS related_to
  FROM documents d LEFT JOIN documents a ON a.doc_id = d.doc_id + 1 LEFT JOIN documents b ON b.doc_id = d.doc_id + 2""")
def rehydrated_edges(spark, d):
    return listing.rehydrated(tb.memories(spark, d), tb.edges(spark, d)).select("memory_id", "depends_on", "related_to")


@query(f"""WITH {_MEMORIES}, e AS (SELECT memory_id AS from_id, memory_id + 1 AS to_id, 'depends_on' AS relationship_type FROM memories WHERE memory_id % 2 = 0 UNION ALL SELECT memory_id, memory_id + 2, 'related_to' FROM memories WHERE memory_id % 3 = 0)
  SELECT from_id, to_id, relationship_type, content_type AS to_type, file_path AS to_path FROM e JOIN memories ON to_id = memory_id""")
def edges_1hop(spark, d):
    return listing.neighbours(tb.edges(spark, d), tb.memories(spark, d))


@query(f"""WITH RECURSIVE {_MEMORIES}, e AS (SELECT f.memory_id AS from_id, t.memory_id AS to_id FROM memories f JOIN memories t ON (f.memory_id % 2 = 0 AND t.memory_id = f.memory_id + 1) OR (f.memory_id % 3 = 0 AND t.memory_id = f.memory_id + 2)),
  c(from_id, to_id, depth) AS (SELECT from_id, to_id, 1 FROM e UNION SELECT c.from_id, e.to_id, depth + 1 FROM c JOIN e ON e.from_id = c.to_id)
  SELECT from_id, to_id, min(depth) AS depth FROM c GROUP BY from_id, to_id""")
def edges_closure(spark, d):
    return graphs.closure(tb.edges(spark, d))


@query(f"""WITH RECURSIVE docs AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents), {_embedded_sql('docs', 'dv')},
  v AS (SELECT v, list(id) AS ids, min(id) AS head FROM dv GROUP BY v), {_MEMORIES},
  p AS (SELECT a.head AS a, b.head AS b FROM v a JOIN v b ON a.head <> b.head WHERE exp(-{_apart_sql('a.v', 'b.v')}) >= 0.97),
  r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
  top AS (SELECT head, least(head, coalesce(min(b), head)) AS component FROM v LEFT JOIN r ON head = a GROUP BY head),
  g AS (SELECT unnest(ids) AS id, component FROM v JOIN top USING (head)), o AS (SELECT component, min_by(memory_id, [created_at, memory_id]) AS keep_id FROM g JOIN memories ON id = memory_id GROUP BY component)
  SELECT id AS memory_id, keep_id FROM g JOIN o USING (component) WHERE id <> keep_id""")
def dedup_similar(spark, d):
    """Every memory whose text is much like that of an older one, or hangs together with it over others."""
    m = tb.memories(spark, d)
    return cells.near_groups(m, search.embedded(m.select("memory_id", "text")), 0.97)


@query()
def search_approximate(spark, d):
    """Every twentieth vector against an index of all vectors by cells."""
    index = cells.Cells.build(tb.vectors(spark, d), f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}")
    return index.top_k(_prompts(spark, d), 10).withColumn("similarity", F.round("similarity", 6))


_SECRET = r"""(?i:(?:password|passwd|secret|token|api_?key)["'']?\s*[:=]\s*["''][^"''\s]{8,}["''])|AKIA[0-9A-Z]{16}|-----BEGIN [A-Z ]*PRIVATE KEY-----|(?i:bearer\s+[A-Za-z0-9._-]{20,})"""


@query(f"SELECT doc_id AS memory_id FROM documents WHERE regexp_matches(text, '{_SECRET}')")
def secrets_flag(spark, d):
    return tb.memories(spark, d).where(tx.has_secrets(F.col("text"))).select("memory_id")


@query(f"SELECT doc_id AS memory_id, regexp_replace(text, '{_SECRET}', '[REDACTED]', 'g') AS text FROM documents")
def secrets_sanitize(spark, d):
    return maintenance.screened(tb.memories(spark, d)).select("memory_id", "text")


_RULES = {"assignment": r"""(?i:(?:password|passwd|secret|token|api_?key)["'']?\s*[:=]\s*["''][^"''\s]{8,}["''])""", "access key": "AKIA[0-9A-Z]{16}", "private key": "-----BEGIN [A-Z ]*PRIVATE KEY-----", "bearer": r"(?i:bearer\s+[A-Za-z0-9._-]{20,})"}
_LENGTHS = "coalesce(list_sum(list_transform({0}, lambda x: length(x))), 0)"


@query("WITH f AS (" + " UNION ALL ".join(f"SELECT doc_id, '{rule}' AS rule, regexp_split_to_array(text, '{p}') AS parts, regexp_extract_all(text, '{p}') AS found FROM documents WHERE regexp_matches(text, '{p}')" for rule, p in _RULES.items()) + f""")
  SELECT doc_id AS memory_id, rule, ({_LENGTHS.format('parts[1:i]')} + {_LENGTHS.format('found[1:i - 1]')})::INT AS begin, ({_LENGTHS.format('parts[1:i]')} + {_LENGTHS.format('found[1:i]')})::INT AS "end"
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM f)""")
def secrets_report(spark, d):
    return maintenance.findings(tb.memories(spark, d)).select("memory_id", "rule", "begin", "end")


def _chunked_sql(source: str, name: str) -> str:
    """CTEs that cut the texts of rows (id, text) of a table: name, with id, chunk_text, line_start and line_end.

    Units are sentences, and the lines of sentences that are too long. Each step takes one, with what is packed so far, and
    gives the chunks that it ends."""
    n, size = "(length({0}) - length(replace({0}, E'\\n', '')))", _TOKENS
    tail = "array_to_string(pack[-2:], '')"
    return f"""{name}_s AS (SELECT id, generate_subscripts(s, 1) AS i, unnest(s) AS s FROM (SELECT id, regexp_extract_all(text, '(?s:.*?[.!?]\\s+|.+\\z)') AS s FROM {source})),
  {name}_l AS (SELECT id, i, 0 AS j, s AS t, false AS long, false AS opens, false AS ends FROM {name}_s WHERE {size.format('s')} <= {chunking.MAX_TOKENS} UNION ALL
    SELECT id, i, j, rows[j], true, j = 1, j = len(rows) FROM (SELECT id, i, rows, unnest(range(1, len(rows) + 1)) AS j FROM (SELECT id, i, string_split(s, E'\\n') AS rows FROM {name}_s WHERE {size.format('s')} > {chunking.MAX_TOKENS}))),
  {name}_u AS (SELECT *, {size.format('t')} AS n, row_number() OVER (PARTITION BY id ORDER BY i, j) AS place FROM {name}_l),
  {name}_r(id, place, pack, used, first, line, out) AS (SELECT id, 0::BIGINT, []::VARCHAR[], 0, 1, 1, []::STRUCT(t VARCHAR, a INT, b INT)[] FROM {source} UNION ALL
    SELECT id, place, CASE WHEN ends THEN [] WHEN opens OR (long AND full_) THEN [t] WHEN full_ THEN list_append(CASE WHEN kept <= {chunking.OVERLAP_TOKENS} THEN pack[-2:] ELSE [] END, t) ELSE list_append(pack, t) END,
      CASE WHEN ends THEN 0 WHEN opens OR (long AND full_) THEN n WHEN full_ THEN n + CASE WHEN kept <= {chunking.OVERLAP_TOKENS} THEN kept ELSE 0 END ELSE used + n END,
      CASE WHEN ends THEN line + 2 WHEN opens THEN CASE WHEN len(pack) > 0 THEN line + 1 ELSE first END WHEN full_ THEN CASE WHEN long THEN line + 1 ELSE line END ELSE first END,
      CASE WHEN long THEN line + 1 ELSE line + {n.format('t')} END,
      list_concat(CASE WHEN (opens AND len(pack) > 0) OR (full_ AND NOT opens) THEN [{{'t': CASE WHEN long AND NOT opens THEN array_to_string(pack, E'\\n') ELSE array_to_string(pack, '') END, 'a': first, 'b': line}}] ELSE [] END,
        CASE WHEN ends THEN [{{'t': CASE WHEN opens OR full_ THEN t ELSE array_to_string(list_append(pack, t), E'\\n') END, 'a': CASE WHEN (opens AND len(pack) > 0) OR (full_ AND NOT opens) THEN line + 1 ELSE first END, 'b': line + 1}}] ELSE [] END)
    FROM (SELECT u.*, r.pack, r.used, r.first, r.line, len(r.pack) > 0 AND r.used + u.n > {chunking.MAX_TOKENS} AS full_, {size.format(tail)} AS kept FROM {name}_r r JOIN {name}_u u ON u.id = r.id AND u.place = r.place + 1)),
  {name}_e AS (SELECT id, pack, first, line FROM {name}_r QUALIFY row_number() OVER (PARTITION BY id ORDER BY place DESC) = 1),
  {name} AS (SELECT id, o.t AS chunk_text, o.a AS line_start, o.b AS line_end FROM (SELECT id, unnest(out) AS o FROM {name}_r) UNION ALL
    SELECT id, array_to_string(pack, ''), first, line FROM {name}_e WHERE len(pack) > 0 UNION ALL SELECT id, '', 1, 1 FROM {source} WHERE text = '')"""


_DOCS = "docs AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL)"


@query(f"WITH RECURSIVE {_DOCS}, {_chunked_sql('docs', 'c')} SELECT id::VARCHAR AS path, chunk_text, line_start, line_end FROM c")
def chunk_text(spark, d):
    return chunking.chunked(tb.memories(spark, d).select(F.col("memory_id").cast("string").alias("path"), "text",
        F.lit("text").alias("language"))).select("path", "chunk_text", "line_start", "line_end")


@query(r"""WITH t AS (SELECT doc_id, 'class C' || doc_id AS c, '(Base):' || chr(10) AS b, '    def f(self):' || chr(10) || '        return 1' AS f, 'def g():' || chr(10) || '    return ' || '"'||'""' || translate(coalesce(text, ''), '*/"\' || chr(13), '') || '"'||'""' AS g FROM documents),
  x AS (SELECT doc_id, c || b || f AS chunk_text, 1 AS line_start, 'class' AS kind, substr(c, 7) AS name, 'Base' AS parent FROM t UNION ALL SELECT doc_id, f, 2, 'method', 'f', NULL FROM t UNION ALL SELECT doc_id, g, 5, 'function', 'g', NULL FROM t)
  SELECT doc_id::VARCHAR AS path, 'python' AS language, chunk_text, line_start, (line_start + length(chunk_text) - length(replace(chunk_text, chr(10), '')))::INT AS line_end, kind, name, parent, NULL::VARCHAR AS docstring, []::VARCHAR[] AS decorators FROM x""")
def chunk_python(spark, d):
    text = F.translate(F.coalesce("text", F.lit("")), _ENDING, "")
    code = F.concat(F.lit("class C"), F.col("memory_id").cast("string"), F.lit("(Base):\n    def f(self):\n        return 1\n\ndef g():\n    return \"\"\""), text, F.lit("\"\"\"\n"))
    return chunking.chunked(tb.memories(spark, d).select(F.col("memory_id").cast("string").alias("path"), code.alias("text"),
        F.lit("python").alias("language")))


@query(r"""SELECT conv_id, turn, E'x\n```' || E'\n' || array_to_string([text || i FOR i IN range(1, 6)], E'\n') || E'\n... 30 lines omitted ...\n' || array_to_string([text || i FOR i IN range(36, 41)], E'\n') || E'\n```\ny' AS text FROM (SELECT conv_id, turn, regexp_replace(text, '\n', ' ', 'g') AS text FROM conversations)""")
def code_fence_truncate(spark, d):
    line = F.regexp_replace("text", "\n", " ")
    fence = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(line, i.cast("string"))), "\n")
    return tb.table(spark, d, "conversations").select("conv_id", "turn",
        tx.fences_cut(F.concat(F.lit("x\n```py\n"), fence, F.lit("\n```\ny"))).alias("text"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_CUTS = ", ".join(f"({_quoted(lang)}, {_quoted(kind)}, {_quoted(name)}, {_quoted(chunk)}, {line}, {after})" for lang, kind, name, chunk, line, after in CUTS)


@query(f"""WITH c(language, kind, name, chunk, line, after) AS (VALUES {_CUTS}), t AS (SELECT doc_id, translate(coalesce(text, ''), '*/"\' || chr(13), '') AS t FROM documents),
  x AS (SELECT doc_id::VARCHAR AS path, language, kind, replace(name, 'NAME', 'N' || doc_id) AS name, replace(replace(chunk, 'NAME', 'N' || doc_id), 'TEXT', t) AS chunk, (line + after * (length(t) - length(replace(t, E'\\n', ''))))::INT AS line_start FROM t, c)
  SELECT path, language, kind, name, line_start, (line_start + length(chunk) - length(replace(chunk, E'\\n', '')))::INT AS line_end, sha256(chunk) AS chunk_sha256 FROM x""")
def chunk_code(spark, d):
    """A file in each language for every memory, with its text in a comment, cut by declarations."""
    text = F.translate(F.coalesce("text", F.lit("")), _ENDING, "")
    name = F.concat(F.lit("N"), F.col("memory_id").cast("string"))
    texts = F.create_map(*[x for lang, body in CODE.items() for x in (F.lit(lang), F.replace(F.replace(F.lit(body), F.lit("NAME"), name), F.lit("TEXT"), text))])
    files = tb.memories(spark, d).select(F.col("memory_id").cast("string").alias("path"), F.explode(texts).alias("language", "text"))
    return chunking.chunked(files).select("path", "language", "kind", "name", "line_start", "line_end", F.sha2("chunk_text", 256).alias("chunk_sha256"))


@query(f"WITH docs AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents), {_embedded_sql('docs', 'dv')} SELECT id AS memory_id, list_transform(v, lambda x: round(x::DOUBLE, 6) + 0) AS embedding FROM dv")
def hashed_embed(spark, d):
    found = search.embedded(tb.memories(spark, d))
    return found.withColumn("embedding", F.transform("embedding", lambda x: F.round(x.cast("double"), 6) + 0.0))


def _files(spark, d):
    """Files of memories, some not UTF-8 or blank, and the hashes that an earlier run left."""
    i = F.col("memory_id")
    content = F.when(i % 17 == 0, F.unhex(F.lit("FF"))).when(i % 19 == 0,
        F.encode(F.lit(" "), "UTF-8")).otherwise(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    path = F.concat(F.lit("src/f"), i.cast("string"), F.lit(".md"))
    m = tb.memories(spark, d)
    files = m.select("repo_id", path.alias("path"), content.alias("content")).withColumn("sha256", F.sha2("content", 256))
    return files, m.where("memory_id % 4 <> 0").select(path.alias("path"),
        F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("sha256"))


@query("""SELECT source AS repo_id, CASE WHEN doc_id % 17 = 0 THEN 'binary' WHEN doc_id % 19 = 0 THEN 'empty_chunks' WHEN doc_id % 4 <> 0 THEN 'unchanged'
  WHEN trim(coalesce(text, ''), E' \\n\\t\\r') = '' THEN 'empty_chunks' ELSE 'indexed' END AS outcome, count(*) AS n FROM documents GROUP BY ALL""")
def index_outcomes(spark, d):
    return indexing.outcomes(*_files(spark, d)).groupBy("repo_id", "outcome").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE docs AS (SELECT doc_id AS id, text FROM documents WHERE doc_id % 17 <> 0 AND doc_id % 19 <> 0 AND doc_id % 4 = 0 AND trim(coalesce(text, ''), E' \\n\\t\\r') <> ''), {_chunked_sql('docs', 'c')}
  SELECT 'src/f' || id || '.md' AS path, 'markdown' AS language, chunk_text, line_start, line_end, 'text' AS kind, NULL::VARCHAR AS name, NULL::VARCHAR AS parent, NULL::VARCHAR AS docstring, []::VARCHAR[] AS decorators, ['indexed', 'repository'] AS tags FROM c WHERE trim(chunk_text, ' ') <> ''""")
def index_repository(spark, d):
    return indexing.chunks(indexing.outcomes(*_files(spark, d)))


@query(f"""WITH {_MEMORIES}, c AS (SELECT repo_id, branch_name, file_path AS path, max(memory_id) % 2 = 1 AND regexp_matches(file_path, '/f(1[^/]*|2)\\.txt$') AS updated FROM memories WHERE memory_id % 3 = 0 GROUP BY repo_id, branch_name, file_path),
  s AS (SELECT m.repo_id, m.branch_name, count(*) AS n FROM memories m JOIN c ON m.repo_id = c.repo_id AND m.branch_name = c.branch_name AND m.file_path = c.path WHERE content_type IN ('code_snippet', 'relationship') AND NOT stale GROUP BY ALL)
  SELECT repo_id, branch_name, '01234567' AS from_commit, '89abcdef' AS to_commit, count(*) FILTER (WHERE updated) AS files_updated, count(*) FILTER (WHERE NOT updated) AS files_removed, coalesce(any_value(n), 0) AS memories_staled
  FROM c LEFT JOIN s USING (repo_id, branch_name) GROUP BY repo_id, branch_name""")
def sync_commits(spark, d):
    m = tb.memories(spark, d)
    changed = m.where("memory_id % 3 = 0").groupBy("repo_id", "branch_name",
        F.col("file_path").alias("path")).agg((F.max("memory_id") % 2 == 1).alias("still_there"))
    return indexing.synced(m, changed, ("f1*.txt", "src/x/f2.txt"), "0123456789", "89abcdef01")


@query("""SELECT conv_id::VARCHAR AS session_id, turn * 2 + k AS place, CASE WHEN role = 'user' AND k = 0 THEN 'decision' ELSE 'context' END AS content_type, trim(text, E' \\n\\t\\r') AS text, CASE WHEN k = 0 THEN role ELSE '' END AS tags
  FROM conversations, (VALUES (0), (1)) v(k) WHERE trim(text, E' \\n\\t\\r') <> ''""")
def capture_extracted(spark, d):
    t = tb.table(spark, d, "conversations")
    kind = F.when(F.col("role") == "user", "decision").otherwise("guess")
    first = F.struct(kind.alias("type"), F.concat(F.lit(" "), "text", F.lit("\n")).alias("content"), F.array(F.col("role"), F.lit("")).alias("tags"))
    second = F.struct(F.lit("nonsense").alias("type"), F.col("text").alias("content"), F.lit(None).cast("array<string>").alias("tags"))
    reply = F.concat(F.lit("```json\n"), F.to_json(F.array(first, second)), F.lit("\n```"))
    found = capturing.extracted(t.select(F.struct("conv_id", "turn").alias("session_id"), reply.alias("reply")))
    return found.select(F.col("session_id.conv_id").cast("string").alias("session_id"),
        (F.col("session_id.turn") * 2 + F.col("place")).alias("place"), "content_type", "text", F.array_join("tags", ",").alias("tags"))


@query(f"""WITH {_MEMORIES}, {_NEAREST}, k AS (SELECT query_id, string_agg('- [' || content_type || '] ' || {_ONE_LINE}, E'\\n' ORDER BY rank) AS lines FROM hits JOIN memories USING (memory_id) WHERE rank <= 5 AND similarity >= 0.25 AND NOT stale GROUP BY query_id)
  SELECT vec_id AS query_id, CASE WHEN lines IS NULL THEN 'Extract.' ELSE E'Extract.\\n\\nAlready stored (do NOT re-extract these):\\n' || lines END AS prompt FROM vectors LEFT JOIN k ON vec_id = query_id WHERE vec_id % 20 = 0""")
def enhanced_prompt(spark, d):
    known = capturing.known_lines(tb.derived(_found(spark, d, 5, 0.25)))
    return _prompts(spark, d).select("query_id").join(known, "query_id", "left").select("query_id",
        capturing.prompt(F.lit("Extract."), F.coalesce("known", F.expr("cast(array() as array<string>)"))).alias("prompt"))


@query("""SELECT conv_id, turn, E'Find the facts in this text that are worth keeping and store each as a decision, analysis, context, conversation or summary.\\n\\n---\\n' || text || E'\\n---\\n'
  || CASE WHEN role = 'user' THEN E'\\nHint: ' || role ELSE '' END AS prompt FROM conversations""")
def extraction_prompt(spark, d):
    hint = F.when(F.col("role") == "user", F.col("role"))
    return tb.table(spark, d, "conversations").select("conv_id", "turn", capturing.to_extract(F.col("text"), hint).alias("prompt"))


@query(f"""WITH {_MEMORIES}, m AS (SELECT content_type, {_TOKENS.format('text')} AS a, {_TOKENS.format('(' + _ONE_LINE + ')')} AS b FROM memories)
  SELECT content_type, sum(a)::BIGINT AS tokens, sum(b)::BIGINT AS short_tokens, sum(a - b)::BIGINT AS saved, round(avg(CASE WHEN a > 0 THEN 1 - b / a::DOUBLE END), 6) AS mean_share FROM m GROUP BY content_type""")
def token_savings(spark, d):
    return capturing.savings(tb.derived(tb.memories(spark, d)), "content_type").withColumn("mean_share", F.round("mean_share", 6))


@query(f"WITH {_MEMORIES}, {_NEAREST} SELECT count(*) AS n_memories, count(DISTINCT repo_id) AS n_repos, count(*) FILTER (WHERE stale) AS n_stale, (SELECT count(*) FROM vectors) AS n_vectors, (SELECT max(len(embedding))::INT FROM vectors) AS dims, count(*) * 3 / 1024.0::DOUBLE AS size_mb FROM memories")
def stats_composite(spark, d):
    return capturing.stats(tb.memories(spark, d), tb.vectors(spark, d))


@query(f"""SELECT conv_id, '## Session — ' || strftime(make_timestamp(({tb.EPOCH} + conv_id * 3660) * 1000000), '%Y-%m-%d %H:%M') || ' [' || CASE WHEN conv_id % 2 = 0 THEN 'main' ELSE 'unknown' END || E']\\n\\n' || arg_max(text, turn) AS note
  FROM conversations WHERE role = 'assistant' AND text IS NOT NULL GROUP BY conv_id""")
def session_notes(spark, d):
    last = tb.table(spark, d,
        "conversations").where("role = 'assistant' and text is not null").groupBy("conv_id").agg(F.max_by("text", "turn").alias("summary"))
    at = F.expr(f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {tb.EPOCH} + conv_id * 3660)")
    return last.select("conv_id", tx.session_note(F.when(F.col("conv_id") % 2 == 0, "main"), F.col("summary"), at).alias("note"))


def _in_sql(spark, d):
    sql.functions(spark, VOCABULARY)
    sql.views(spark, d)
    return spark


@query(f"WITH {_MEMORIES} SELECT memory_id, sha256(text) AS checksum, {_TOKENS.format('text')} AS tokens, {_ONE_LINE} AS one_line, {_cut_sql('text', 100)} AS cut FROM memories WHERE NOT stale")
def sql_scalars(spark, d):
    return _in_sql(spark, d).sql("SELECT memory_id, text_checksum(text) AS checksum, estimated_tokens(text) AS tokens, one_line(text) AS one_line, truncate_tokens(text, 100) AS cut FROM memories WHERE NOT stale")


@query(f"WITH {_MEMORIES} SELECT file_path, count(*) AS n, sum({_TOKENS.format('text')})::BIGINT AS tokens, max(created_at) AS newest FROM memories WHERE NOT stale AND list_has_all(tags, ['t1']) GROUP BY file_path HAVING count(*) > 1")
def sql_files(spark, d):
    return _in_sql(spark, d).sql("SELECT file_path, count(*) AS n, sum(estimated_tokens(text)) AS tokens, max(created_at) AS newest FROM memories WHERE NOT stale AND array_contains(tags, 't1') GROUP BY file_path HAVING count(*) > 1")


@query(f"WITH {_COMPOSITES} SELECT query_id, memory_id, round(composite, 6) AS composite FROM scored")
def sql_composite(spark, d):
    """Ranking in SQL over the hits of a search."""
    _in_sql(spark, d)
    _found(spark, d, 20, context.FLOOR).createOrReplaceTempView("hits")
    _intents(spark, d, _prompts(spark, d)).createOrReplaceTempView("intents")
    return spark.sql(f"""SELECT query_id, memory_id, round(composite_score(similarity, type_priority(intent, content_type), recency(({tb.AS_OF} - created_at) / 86400D)), 6) AS composite
        FROM hits JOIN intents USING (query_id)""")


@query(f"WITH {_MEMORIES}, {_NEAREST} SELECT query_id, memory_id, rank, round(similarity, 6) AS similarity FROM hits WHERE rank <= 3")
def sql_nearest(spark, d):
    """Exact search for SQL, within scopes."""
    _in_sql(spark, d)
    sql.nearest(spark, "SELECT memory_id AS query_id, embedding, repo_id, branch_name FROM vectors WHERE memory_id % 20 = 0", 3, ("repo_id", "branch_name"))
    return spark.sql("SELECT query_id, memory_id, CAST(rank AS BIGINT) AS rank, round(similarity, 6) AS similarity FROM nearest")


@query(f"WITH RECURSIVE {_DOCS}, {_chunked_sql('docs', 'c')} SELECT id AS memory_id, chunk_text, line_start, line_end FROM c")
def sql_chunks(spark, d):
    """Every document cut by the table function."""
    return _in_sql(spark, d).sql("SELECT m.memory_id, c.chunk_text, c.line_start, c.line_end FROM memories m, LATERAL chunks(m.text, 'text') c")


@query()
def vocabulary_tokens(spark, d):
    """Tokens of every document by a public vocabulary, and what is left of it within 100 of them."""
    t = F.col("text")
    cut = vocabulary.truncated(t, 100, VOCABULARY)
    return tb.memories(spark, d).select("memory_id", vocabulary.counted(t, VOCABULARY).alias("tokens"), F.length(cut).alias("cut_length"), F.sha2(cut, 256).alias("cut_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
