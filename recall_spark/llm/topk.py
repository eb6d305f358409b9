"""Exact top-k by inner product: the threshold algorithm over sorted lists of each dimension.

Vectors become integers once, in a saved table that also numbers the rows. Each task puts its vectors in blocks of bounded
size and sorts each block by every dimension. For a query the lists are followed from the end that its sign favours, all
dimensions to the same depth: what comes up is scored in full (random access), and no row that hasn't come up can score
more than the query times the values that come next. When that bound is below the k-th best score, the block is done. The
k-th best of earlier blocks of the task counts too, so that later blocks stop sooner. Queries go out in blocks of bounded
size; only k rows a query and task are shuffled, vectors never.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recall_spark.llm.common import only, save

#: Queries sent to the executors at once, and bytes of their components.
QUERY_BLOCK, QUERY_BYTES = 4_096, 16 << 20
#: Rows of a block of sorted lists at most, and its components at most.
BLOCK_ROWS, BLOCK_CELLS = 16_384, 1 << 21
#: Depth of the first round; it doubles from round to round.
FIRST_DEPTH = 32
_NONE = np.iinfo(np.int64).min
_HITS = "query_row long, vec_id long, row long, score long"


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """row, vec_id, x of vectors (vec_id, embedding), a saved table: x is floor(scale * component) as a double.

    Rows without a vec_id take no part, nor vectors that are null or empty, hold null or a component that isn't finite, or one
    so large that an inner product might not fit 64 bits (its square times the dimensions above 2^62)."""
    v = only(vectors, "vec_id", "embedding")
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale))
    least = F.sqrt(F.lit(float(1 << 62)) / F.size("embedding")) / scale
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < least)
    taken = v.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", fits))
    return save(taken.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")), "quantised")


class Lists:
    """A block of vectors of one length, sorted by each of their dimensions."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        # Doubles hold integers of 53 bits: inner products below that are exact in them, and faster.
        self.exact = np.float64 if float(np.abs(x).max(initial=0)) ** 2 * x.shape[1] < 2.0**50 else np.int64
        self.x = x.astype(self.exact)
        self.order = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T)
        self.values = np.take_along_axis(self.x.T, self.order, axis=1)

    def best(self, query: np.ndarray, own: int, k: int, known: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]:
        """The k best of known and this block as scores, ids and rows, best first; and how many rows were scored.

        Scores that are equal go by id, then row. Of fewer than k, all are kept."""
        n, found, scored = len(self.ids), known, 0
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        exact = self.exact if float(np.abs(query).max(initial=0)) * float(np.abs(self.x).max(initial=0)) * len(query) < 2.0**52 else np.int64
        q, seen, done, depth = query.astype(exact), np.zeros(n, bool), 0, min(n, FIRST_DEPTH)
        while True:
            new = np.zeros(n, bool)
            if len(up) + len(down):
                new[self.order[up, n - depth : n - done]] = True
                new[self.order[down, done:depth]] = True
            else:  # no list tells anything: all rows come up
                new[:], depth = True, n
            new &= ~seen
            seen |= new
            at = np.flatnonzero(new)
            scored += len(at)
            scores = (self.x[at].astype(exact) @ q).astype(np.int64)
            floor = found[0][-1] if len(found[0]) == k else _NONE
            good = (scores >= floor) & (self.rows[at] != own)
            if good.any():
                at = at[good]
                found = kept(np.concatenate([found[0], scores[good]]), np.concatenate([found[1], self.ids[at]]), np.concatenate([found[2], self.rows[at]]), k)
            if depth == n or seen.all():
                return found, scored
            bound = int(q[up] @ self.values[up, n - 1 - depth].astype(exact)) + int(q[down] @ self.values[down, depth].astype(exact))
            if len(found[0]) == k and bound < found[0][-1]:
                return found, scored
            done, depth = depth, min(n, 2 * depth)


def kept(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k by score (highest first), id and row."""
    if len(scores) > 4 * k:
        some = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids, rows = scores[some], ids[some], rows[some]
    first = np.lexsort((rows, ids, -scores))[:k]
    return scores[first], ids[first], rows[first]


def _blocks(batches):
    """Vectors of one length at a time as (x, ids, rows), as many as make a block."""
    held: dict[int, list] = {}
    for batch in batches:
        column = batch.column("x")
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        ids, rows = (batch.column(c).to_numpy() for c in ("vec_id", "row"))
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            values = column.take(pa.array(at)).flatten().to_numpy().reshape(len(at), size)
            most = max(1, min(BLOCK_ROWS, BLOCK_CELLS // size))
            parts = held.setdefault(size, [])
            for a in range(0, len(at), most):
                parts.append((values[a : a + most], ids[at[a : a + most]], rows[at[a : a + most]]))
                if sum(len(p[1]) for p in parts) >= most:
                    yield tuple(np.concatenate(p) for p in zip(*parts))
                    parts.clear()
        while sum(p[0].size for parts in held.values() for p in parts) > BLOCK_CELLS:  # many lengths
            yield tuple(np.concatenate(p) for p in zip(*held.pop(max(held, key=lambda s: sum(p[0].size for p in held[s])))))
    for parts in held.values():
        if parts:
            yield tuple(np.concatenate(p) for p in zip(*parts))


def _search(sent, k: int):
    def run(batches):
        owns, queries = sent.value
        nothing = (np.zeros(0, np.int64),) * 3
        best = [nothing] * len(queries)
        for x, ids, rows in _blocks(batches):
            lists = None
            for i, query in enumerate(queries):
                if len(query) == x.shape[1]:
                    lists = lists or Lists(x, ids, rows)
                    best[i], _ = lists.best(query, owns[i], k, best[i])
        scores, ids, rows = (np.concatenate(c) for c in zip(*best))
        of = np.repeat(np.array(owns, np.int64), [len(b[0]) for b in best])
        yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(ids), pa.array(rows), pa.array(scores)], names=["query_row", "vec_id", "row", "score"])

    return run


def nearest(table: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of quantised() with the highest inner product for each query,
    which is a row of that table too and no candidate of itself. Equal scores go by vec_id; fewer rows than k are all given.

    Vectors meet queries of their own length only. Rows that repeat a vec_id are rows of their own, as queries too."""
    spark = table.sparkSession
    count, size = queries.agg(F.count("*"), F.max(F.size("x"))).first()
    n = max(1, -(-count // QUERY_BLOCK), -(-count * (size or 0) * 8 // QUERY_BYTES))
    parts = []
    for block in range(n if count else 0):
        rows = queries.where(F.pmod(F.xxhash64("row"), F.lit(n)) == block).select("row", "x").collect()
        if rows:
            sent = spark.sparkContext.broadcast(([r["row"] for r in rows], [np.array(r["x"], np.int64) for r in rows]))
            hits = table.mapInArrow(_search(sent, k), _HITS)
            parts.append(hits if n == 1 else save(hits, "hits"))  # with many blocks each is done before the next is sent
    hits = parts[0] if len(parts) == 1 else spark.read.schema(_HITS).parquet(*(p._saved_at for p in parts)) if parts else spark.createDataFrame([], _HITS)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    first = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ids = queries.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"))
    return first.join(ids, "query_row").select("query_id", "rank", "vec_id", "score")
