"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_spark.llm import decontamination, exact_dedup, language_id, mixing, near_dedup, periodic, pii, quality, secrets, token_counts, topk, toxicity, whitening
from recall_spark.llm.common import documents, remainder


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), _labels(spark, sf_dir))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.located(documents(spark, sf_dir), _labels(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.histogram(documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(documents(spark, sf_dir)))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir), remainder("doc_id", 3) == 1)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(documents(spark, sf_dir)))


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = topk.quantised(_embeddings(spark, sf_dir))
    return topk.nearest(table, table.where("vec_id % 50 = 0"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _embeddings(spark, sf_dir)
    return whitening.whitened(vectors, whitening.fit(vectors))


def _made_periodic(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text), where the words of about every tenth text repeat from some place on; a row without an id stays."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.expr("h div 10")
    rows = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, g % F.col("n")).cast("int"))
    rows = rows.withColumn("p", F.expr("int(1 + (n - a) div (3 + (h div 10) % 8))"))
    tail = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.expr("int((n - a) div p + 1)")))
    anew = F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), F.col("n") - F.col("a")))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(anew, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.find(_made_periodic(documents(spark, sf_dir))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_decontamination, op3_mixing, op4_toxicity, op5_token_counts, op6_exact_dedup, op7_pii, op8_language_id, op9_near_dedup, op10_secrets, op11_exact_top_k, op12_embedding_whitening, op13_periodic_runs)}


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_SETS = "list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)"

OP2 = f"""
WITH d AS (SELECT DISTINCT doc_id, unnest(s) AS s FROM (SELECT doc_id, {_SETS} AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents))),
     b AS (SELECT item_id, len(s) AS n_item, unnest(s) AS s FROM (SELECT item_id, {_SETS} AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)))
SELECT doc_id, item_id, n_item, count(*) AS n_found, count(*)::DOUBLE / n_item AS containment
FROM b JOIN d USING (s) GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 75 * n_item
"""

OP6 = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
     g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""

OP9 = f"""
WITH RECURSIVE s AS (SELECT doc_id, {_SETS} AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
  e AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM s),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.s = b.s AND a.doc_id <> b.doc_id
        WHERE 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
  r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m.low, s.doc_id)) AS component_id, s.doc_id <= coalesce(m.low, s.doc_id) AS kept
FROM s LEFT JOIN (SELECT a, min(b) AS low FROM r GROUP BY a) m ON s.doc_id = m.a
"""


OP11 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""

# crc32 bit by bit; pairs of equal words by lag, where a lag has enough of them; islands of pairs; the smallest period of each.
_CRC = "xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda r, b: list_reduce(list_prepend(xor(r, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, _: xor(x >> 1, 3988292384 * (x & 1))), 4294967295::BIGINT), 4294967295)"
OP13 = f"""
WITH d AS (SELECT doc_id, {_CRC} AS h, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
  e AS (SELECT *, len(w) AS n, (h // 10) AS g FROM d), f AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM e),
  k AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM f),
  t AS (SELECT doc_id, n, i, w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM k)),
  l AS (SELECT x.doc_id, x.n, y.i - x.i AS q, x.i FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
  m AS (SELECT doc_id, q FROM l GROUP BY doc_id, q HAVING count(*) >= greatest(q, 12 - q)),
  j AS (SELECT doc_id, n, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM l SEMI JOIN m USING (doc_id, q)),
  r AS (SELECT doc_id, min(i) AS start, count(*) + q AS length, q FROM j GROUP BY doc_id, q, island HAVING count(*) >= greatest(q, 12 - q)),
  u AS (SELECT doc_id, start, length, min(q) AS period FROM r GROUP BY ALL),
  s AS (SELECT doc_id, count(*) AS n_runs, max_by({{'start': start, 'length': length, 'period': period}}, [length, -start, -period]) AS best, sha256(string_agg(start || ',' || length || ',' || period || E'\n', '' ORDER BY start, period)) AS runs_sha256 FROM u GROUP BY doc_id),
  gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM u),
  c AS (SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY i)) AS collapsed_sha256 FROM t ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period, (1000 * best.length // best.period)::BIGINT AS exponent_milli,
  coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2, "op6_exact_dedup": OP6, "op9_near_dedup": OP9, "op11_exact_top_k": OP11, "op13_periodic_runs": OP13}
