"""Exact vector search: a batch of queries against all vectors, or those of their repositories and branches."""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recall_spark.functions.scoring import INTENTS
from recall_spark.operators.joins import small

#: Queries whose vectors are sent to the executors at once, and bytes of their vectors.
QUERY_BLOCK, QUERY_BYTES = 20_000, 16 << 20
#: Distances computed at once.
PAIRS = 1 << 22
#: Least cosine at which an intent is taken over `general`.
INTENT_FLOOR = 0.3

def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of this width as a matrix, and their rows; null, ragged and partly null ones are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == width)
    values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), width)
    whole = ~np.isnan(values).any(axis=1)
    return values[whole], rows[whole]


def _nearest(sent, k: int):
    """Each task keeps its own k nearest of each query, by rounded distance and id, so that little is shuffled.

    Rows have the number of their scope; a batch is decoded once and sorted by it, and only scopes that are asked are scored."""

    def run(batches):
        queries, groups = sent.value
        best: dict[int, list[list[tuple]]] = {width: [[] for _ in ids] for width, (ids, _) in queries.items()}
        for batch in batches:
            scopes = batch.column("_scope").to_numpy(zero_copy_only=False)
            ids = batch.column("memory_id")
            place = np.empty(batch.num_rows, np.int64)
            place[pc.sort_indices(ids).to_numpy()] = np.arange(batch.num_rows)
            for width in queries:
                rows, at = _matrix(batch.column("embedding"), width)
                order = np.argsort(scopes[at], kind="stable")
                rows, at = rows[order], at[order]
                names, first = np.unique(scopes[at], return_index=True)
                for scope, a, b in zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(at)]):
                    if (scope, width) in groups:
                        _merge(best[width], groups[scope, width], queries[width][1], rows[a:b], at[a:b], place, ids, k)
        found = [(q, i, d) for width, (names, _) in queries.items() for q, kept in zip(names.tolist(), best[width]) for d, i in kept]
        columns = list(zip(*found)) if found else [[], [], []]
        kind = batch.schema.field("memory_id").type if "batch" in locals() else pa.int64()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], kind), pa.array(columns[2], pa.float64())], names=["query_id", "memory_id", "distance"])

    return run


def _merge(best: list[list[tuple]], own: np.ndarray, matrix: np.ndarray, rows: np.ndarray, at: np.ndarray, place: np.ndarray, ids: pa.Array, k: int) -> None:
    """Put what is nearer than the k nearest so far into best, a list of (distance, id) for each query; own: the queries that are asked."""
    squares = (rows**2).sum(1)
    step = PAIRS // max(len(rows), 1) + 1
    for q0 in range(0, len(own), step):
        asked = own[q0 : q0 + step]
        part = matrix[asked]
        limit = np.array([best[q][-1][0] if len(best[q]) == k else np.inf for q in asked.tolist()])
        distance = np.maximum((part**2).sum(1)[:, None] + squares[None, :] - 2 * part @ rows.T, 0.0)
        if len(rows) > k and (open_ := np.flatnonzero(np.isinf(limit))).size:
            limit[open_] = np.partition(distance[open_], k - 1, axis=1)[:, k - 1]
        # Only what may be among the nearest is rounded.
        q, v = np.nonzero(distance <= limit[:, None] + 2e-9)
        if not len(q):
            continue
        distance = np.round(distance[q, v], 9)
        # Of those that are equally near, the k with the smallest ids.
        order = np.lexsort((place[at[v]], distance, q))
        q, v, distance = q[order], v[order], distance[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        q, v, distance = q[nth < k], v[nth < k], distance[nth < k]
        names = ids.take(pa.array(at[v])).to_pylist()
        new: dict[int, list[tuple]] = {}
        for i, d, name in zip(asked[q].tolist(), distance.tolist(), names):
            new.setdefault(i, []).append((d, name))
        for i, found in new.items():
            best[i] = sorted(best[i] + found)[:k]


def top_k(vectors: DataFrame, queries: DataFrame, k: int, scoped: tuple[str, ...] = (), places=None) -> DataFrame:
    """query_id, memory_id, similarity, rank: the k nearest vectors of each query, by squared distance (nine decimals), then id.

    The result's attribute bound is the most rows that it can have.
    scoped: columns, such as repo_id and branch_name, in which a vector and a query have to agree (null as null); vectors of
    other scopes are left out before they are decoded, whole partitions where vectors are stored by these columns. queries
    (query_id, embedding and these) are taken in blocks of bounded size; vectors are read once for each block, never shuffled.
    places: a column of vectors, and a function that gives the values of it in which each of a list of embeddings is searched.
    Queries and vectors that are null, partly null or of another length find nothing."""
    spark = vectors.sparkSession
    usable = queries.where(F.col("embedding").isNotNull() & ~F.exists("embedding",
        lambda x: x.isNull()) & (F.size("embedding") > 0)).select("query_id", "embedding", *scoped)
    kind = vectors.schema["memory_id"].dataType.simpleString()
    first = usable.limit(QUERY_BLOCK + 1).collect()
    count, width = len(first), max((len(r["embedding"]) for r in first), default=1)
    blocks = [first]
    if count > QUERY_BLOCK or count * width * 8 > QUERY_BYTES:
        count, width = usable.agg(F.count("*"), F.max(F.size("embedding"))).first()
        n = max(1, -(-count // QUERY_BLOCK), -(-count * width * 8 // QUERY_BYTES))
        blocks = (usable.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == block).collect() for block in range(n))
    parts = []
    for rows in blocks:
        groups: dict[tuple[tuple, int], list[int]] = {}
        sizes: dict[int, list] = {}
        wanted = places[1]([r["embedding"] for r in rows]) if places else None
        for place, r in enumerate(rows):  # not n, by which the blocks are still to be chosen
            own = sizes.setdefault(len(r["embedding"]), [])
            scope = tuple(r[c] for c in scoped)
            for s in [scope] if wanted is None else [(*scope, p) for p in wanted[place]]:
                groups.setdefault((s, len(r["embedding"])), []).append(len(own))
            own.append(r)
        if not groups:
            continue
        scopes = {s: i for i, s in enumerate(dict.fromkeys(s for s, _ in groups))}
        # A query's vector goes once, whatever the number of places that it asks for.
        sent = spark.sparkContext.broadcast(({width: (np.array([r["query_id"] for r in own], np.int64), np.array([r["embedding"] for r in own], np.float64)) for width, own in sizes.items()},
            {(scopes[s], width): np.array(own, np.int32) for (s, width), own in groups.items()}))
        agreed = (*scoped, places[0]) if places else scoped
        theirs = vectors.select("memory_id", "embedding", *agreed)
        if agreed:
            fields = ", ".join(f"_{c} {vectors.schema[c].dataType.simpleString()}" for c in agreed)
            asked = spark.createDataFrame([(*s, i) for s, i in scopes.items()], f"{fields}, _scope int")  # as many as the block has queries, or places, at most
            same = reduce(lambda a, b: a & b, (theirs[c].eqNullSafe(asked[f"_{c}"]) for c in agreed))
            for i, c in enumerate(agreed):  # literals prune partitions and row groups
                values = {s[i] for s in scopes}
                named = F.col(c).isin(*(x for x in values if x is not None))
                theirs = theirs.where(named | F.col(c).isNull() if None in values else named)
            theirs = theirs.join(F.broadcast(asked), same).select("memory_id", "embedding", "_scope")
        else:
            theirs = theirs.withColumn("_scope", F.lit(0))
        parts.append(theirs.mapInArrow(_nearest(sent, k), f"query_id long, memory_id {kind}, distance double"))
    if not parts:
        parts = [spark.createDataFrame([], f"query_id long, memory_id {kind}, distance double")]
    hits = reduce(DataFrame.union, parts)
    nearest = Window.partitionBy("query_id").orderBy("distance", "memory_id")
    found = hits.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "memory_id",
        F.exp(-F.col("distance")).alias("similarity"), "rank")
    found.bound = count * k
    return found


def with_memories(hits: DataFrame, memories: DataFrame, most: int) -> DataFrame:
    """hits with the columns of their memories. most: a bound of the number of hits, which are broadcast if they are few."""
    return small(hits, most).join(memories, "memory_id")


def similar(
    vectors: DataFrame, queries: DataFrame, memories: DataFrame, k: int = 5, least: float = 0.3, *, content_type: str | None = None,
        tags: list[str] | None = None, language: str | None = None,
    include_stale: bool = False, cross_branch: bool = False, prefilter: bool = False,
) -> DataFrame:
    """Hits of each query within its repo_id and branch_name, with their memories.

    Threshold and filters apply after the k nearest are chosen; with prefilter, only vectors of memories that pass are
    searched. cross_branch: all branches of the repository. k is 1 to 50 and least 0 to 1."""
    if not 1 <= k <= 50 or not 0 <= least <= 1:
        raise ValueError("k has to be 1 to 50, and the least similarity 0 to 1")

    def passing(rows: DataFrame) -> DataFrame:
        for column, value in (("content_type", content_type), ("language", language)):
            rows = rows if value is None else rows.where(F.col(column) == value)
        if tags:
            rows = rows.where(F.size(F.array_except(F.array(*map(F.lit, dict.fromkeys(tags))), "tags")) == 0)
        return rows if include_stale else rows.where(~F.col("stale"))

    if prefilter:
        vectors = vectors.join(small(passing(memories).select("memory_id")), "memory_id", "left_semi")
    scoped = ("repo_id",) if cross_branch else ("repo_id", "branch_name")
    hits = top_k(vectors, queries, k, scoped)
    return passing(with_memories(hits.where(F.col("similarity") >= least), memories, hits.bound))


def classified(queries: DataFrame, centroids: DataFrame, least: float = INTENT_FLOOR) -> DataFrame:
    """query_id, intent, confidence: the centroid (one of a handful) with the largest dot product; `general` below least.

    A query whose embedding is null or all zero is `general` with confidence 0."""
    unit = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.coalesce(F.sqrt(F.aggregate(unit, F.lit(0.0), lambda a, b: a + b * b)), F.lit(0.0))
    # Centroids go along as one array: a row for each query, not one for each pair.
    all_of_them = centroids.agg(F.array_sort(F.collect_list(F.struct("place", "intent", "centroid"))).alias("centroids"))
    scores = F.transform("centroids",
        lambda c: F.struct(F.round(F.when(F.col("norm") > 0,
        F.aggregate(F.zip_with(unit, c["centroid"], lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) / F.col("norm")).otherwise(0.0),
        12).alias("score"), (-c["place"]).alias("o"), c["intent"].alias("intent")))
    scored = queries.join(F.broadcast(all_of_them)).withColumn("norm", norm).withColumn("best", F.array_max(scores))  # one row
    confidence = F.when(F.col("norm") > 0, F.least(F.greatest(F.coalesce("best.score", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return scored.select("query_id",
        F.when((F.col("norm") == 0) | F.col("best").isNull() | (confidence < least), "general").otherwise(F.col("best.intent")).alias("intent"),
        confidence.alias("confidence"))


def _mean_directions(rows: DataFrame, by: str) -> DataFrame:
    """by, centroid: the normalised mean of the vectors of each group."""
    parts = rows.select(by, F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy(by,
        "pos").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("p"))
    plain = F.transform("p", lambda e: e["m"])
    norm = F.sqrt(F.aggregate(plain, F.lit(0.0), lambda a, b: a + b * b))
    return means.select(by, F.transform(plain, lambda x: F.when(norm > 0, x / norm).otherwise(x)).alias("centroid"))


def centroids(vectors: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """intent, place, centroid: the normalised mean of the vectors with each label below len(names)."""
    means = _mean_directions(vectors.where(F.col("label") < len(names)), "label")
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("label") + 1).cast("int"))
    return means.select(name.alias("intent"), F.col("label").cast("int").alias("place"), "centroid")


def phrase_centroids(phrases: DataFrame, path: str | None = None, embed=None) -> DataFrame:
    """intent, place, centroid: the normalised mean of the embedded phrases (intent, text) of each intent.

    Which of intents that fit equally well is taken goes by place: that of scoring.INTENTS, others after them by name.
    Phrases that are null or blank don't count; an intent without others has no centroid. With a path the centroids are kept
    there, under a hash of phrases and the embedding's name, and computed only once."""
    embed = embed or embedded
    rows = phrases.where("intent is not null and trim(coalesce(text, '')) <> ''").select("intent", "text")
    if path is not None:
        spark = phrases.sparkSession
        each = F.xxhash64("intent", "text").cast("decimal(38,0)")
        n, total, squares = rows.agg(F.count("*"), F.sum(each), F.sum(F.pmod(F.xxhash64("text", "intent"), F.lit(1 << 31)))).first()
        kept = f"{path.rstrip('/')}/{embed.__name__}-{n}-{total}-{squares}"
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{kept}/_SUCCESS")
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            phrase_centroids(phrases, None, embed).write.mode("overwrite").parquet(kept)
        return spark.read.parquet(kept)
    named = rows.withColumn("memory_id", F.xxhash64("intent", "text")).dropDuplicates(["memory_id"])
    vectors = embed(named.select("memory_id", "text")).join(named.select("memory_id", "intent"), "memory_id")
    means = _mean_directions(vectors, "intent")
    known = F.array_position(F.array(*map(F.lit, INTENTS)), F.col("intent")).cast("int")
    others = F.row_number().over(Window.partitionBy(F.when(known > 0, "known").otherwise("other")).orderBy("intent"))  # a row for each intent
    return means.select("intent", F.when(known > 0, known - 1).otherwise(F.lit(len(INTENTS) - 1) + others).alias("place"), "centroid")


def near_copies(vectors: DataFrame, new: DataFrame, least: float = 0.97, scoped: tuple[str, ...] = ()) -> DataFrame:
    """memory_id of stored vectors nearest to each new one (query_id), if at least so similar."""
    return top_k(vectors, new, 1, scoped).where(F.col("similarity") >= least).drop("rank")


def hashed(texts: list[str | None], dimensions: int = 64) -> np.ndarray:
    """A vector for each text: hashed words, signed, summed and normalised; zero for a text without words."""
    out = np.zeros((len(texts), dimensions), np.float32)
    for i, t in enumerate(texts):
        if words := (t or "").lower().split():
            h = np.array([zlib.crc32(w.encode()) for w in words])
            out[i] = np.bincount(h % dimensions, np.where(h & 0x10000, 1.0, -1.0), dimensions)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embedded(texts: DataFrame, dimensions: int = 64) -> DataFrame:
    """memory_id, embedding: the vectors of hashed(); needs no model."""
    kind = texts.schema["memory_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            flat = hashed(batch.column("text").to_pylist(), dimensions).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dimensions, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("memory_id"), lists], names=["memory_id", "embedding"])

    return texts.select("memory_id", "text").mapInArrow(run, f"memory_id {kind}, embedding array<float>")
