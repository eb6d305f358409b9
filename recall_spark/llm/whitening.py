"""Embedding whitening by matrix-free block Lanczos: the covariance is never formed, only multiplied with blocks of vectors.

One pass counts the vectors and sums their dimensions exactly; one more sums squared deviations, whose total is the trace.
Then each step of the iteration is a pass that gives X'Xv for a block v, with X centred before it is multiplied: a task adds
up its part, parts are summed by position in Spark, and a matrix of dimensions x block comes to the driver. The new block is
orthogonalised twice against all earlier ones. Directions that vanish (an invariant subspace is found) are replaced by
random ones orthogonal to all before. Ritz pairs come from the whole basis with the products that are known, so residuals
are computed, not estimated; a basis that has grown too large is cut back to its best Ritz vectors.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall_spark.llm.common import only

#: Components; vectors multiplied in one pass; basis vectors kept at most (times components); passes at most.
COMPONENTS, BLOCK, WIDEST, PASSES = 8, 16, 12, 200
#: A Ritz pair has converged when its residual is below so many times the largest eigenvalue.
TOLERANCE = 1e-13
#: Directions and eigenvalues below so many times the largest count as zero.
VANISHED = 1e-10
SCALE, SHIFT = 1024, 100_000
#: Rows multiplied at once.
ROWS = 4_096


class Fit(NamedTuple):
    """n, sums of each dimension, mean, trace of the covariance, eigenvalues (falling), their unit vectors as columns, passes made."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    passes: int


def _whole(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Integers of the vectors of this width without null and non-finite entries, and their rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == width)
    c = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), width)
    good = np.isfinite(c).all(axis=1)
    return np.floor(SCALE * c[good]).astype(np.int64) + SHIFT, at[good]


def _summed(rows: DataFrame, width: int, kind: str, size: int, part) -> np.ndarray:
    """The sum of part(x) (size numbers) over all rows: each task adds up its own, Spark adds up the tasks' by position."""

    def run(batches):
        total = None
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                x, _ = _whole(batch.column("embedding").slice(a, ROWS), width)
                if len(x):
                    total = part(x) if total is None else total + part(x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["at", "part"])

    out = np.zeros(size, np.int64 if kind == "long" else np.float64)
    for at, value in rows.mapInArrow(run, f"at int, part {kind}").groupBy("at").agg(F.sum("part")).collect():  # size rows, whatever the input
        out[at] = value
    return out


def dimensions(vectors: DataFrame) -> int:
    """The commonest length of the usable vectors, the longer of equally common ones; 0 if there is none."""
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    sizes = vectors.where(F.forall("embedding", good) & (F.size("embedding") > 0)).groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"))
    row = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    return row["d"] if row else 0


def lanczos(times, d: int, k: int, block: int = BLOCK, widest: int = WIDEST * COMPONENTS, most: int = PASSES, seed: int = 3) -> tuple[np.ndarray, np.ndarray, int]:
    """The k largest eigenvalues of a symmetric d x d matrix and their vectors; times gives its product with a block of columns."""
    rng = np.random.default_rng(seed)
    k, widest = min(k, d), max(widest, 2 * k + 2 * block)
    basis, image, passes = np.zeros((d, 0)), np.zeros((d, 0)), 0
    new, scale = rng.standard_normal((d, min(block, d))), 0.0
    while True:
        new = _orthonormal(new, basis, VANISHED * max(scale, 0.0), min(block, d - basis.shape[1]), rng)
        if new.shape[1]:
            product = times(new)
            passes += 1
            basis, image = np.hstack([basis, new]), np.hstack([image, product])
        small = basis.T @ image
        theta, s = np.linalg.eigh((small + small.T) / 2)
        first = np.argsort(theta)[::-1]
        theta, s = theta[first], s[:, first]
        scale = max(abs(theta[0]), abs(theta[-1]))
        residual = np.linalg.norm(image @ s[:, :k] - basis @ s[:, :k] * theta[:k], axis=0)
        if basis.shape[1] == d or (basis.shape[1] >= k and (residual <= TOLERANCE * scale).all()):
            break
        if passes >= most:
            raise ArithmeticError(f"no convergence in {most} passes: residuals {residual}")
        new = product - basis @ (basis.T @ product)
        if basis.shape[1] + block > widest:  # thick restart: the best Ritz vectors, and the residual block to go on with
            keep = s[:, : k + block]
            basis, image = basis @ keep, image @ keep
    return theta[:k], basis @ s[:, :k], passes


def _orthonormal(new: np.ndarray, basis: np.ndarray, least: float, width: int, rng) -> np.ndarray:
    """width orthonormal columns, orthogonal to the basis: those of new, random ones for what vanishes."""
    kept = np.zeros((len(new), 0))
    columns = list(new.T)
    while kept.shape[1] < width:
        broken = not columns
        v = rng.standard_normal(len(new)) if broken else columns.pop(0)
        before, limit = np.linalg.norm(v), 0.0 if broken else least
        for _ in range(3):
            v = v - basis @ (basis.T @ v)
            v = v - kept @ (kept.T @ v)
        size = np.linalg.norm(v)
        if size > max(limit, 1e-12 * before):
            kept = np.hstack([kept, (v / size)[:, None]])
    return kept


def fit(vectors: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> Fit:
    """Sums, trace and leading components of vectors (embedding); null, partly null, non-finite ones and those of another
    length than most are left out. Components whose eigenvalue vanishes beside the trace don't count; of no vectors or only
    equal ones there are none."""
    rows = only(vectors, "embedding")
    d = dimensions(rows)
    if not d:
        return Fit(0, np.zeros(0, np.int64), np.zeros(0), 0.0, np.zeros(0), np.zeros((0, 0)), 0)
    sums = _summed(rows, d, "long", d + 1, lambda x: np.append(x.sum(axis=0), len(x)))
    n, sums = int(sums[-1]), sums[:-1]
    mean = np.array([int(s) / n for s in sums])
    trace = _summed(rows, d, "double", 1, lambda x: np.array([((x * n - sums).astype(np.float64) ** 2).sum()]))[0] / n / n / n
    if not trace > 0:
        return Fit(n, sums, mean, 0.0, np.zeros(0), np.zeros((d, 0)), 0)

    def times(v: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return (centred.T @ (centred @ v)).ravel()

        return _summed(rows, d, "double", v.size, part).reshape(v.shape) / n

    values, directions, passes = lanczos(times, d, components, block)
    there = values > VANISHED * trace
    return Fit(n, sums, mean, float(trace), values[there], directions[:, there], passes)


def whitened(vectors: DataFrame, fitted: Fit) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable vector and component.

    A deviation above 9.2e18, which 64 bits don't hold, is null. Rows that repeat a vec_id are rows of their own."""
    rows = only(vectors, "vec_id", "embedding")
    n, sums, mean, d, k = fitted.n, fitted.sums, fitted.mean, len(fitted.mean), len(fitted.values)
    if not k:
        return rows.limit(0).select(F.col("vec_id").cast("long"), F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"), *(F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")))
    project = fitted.vectors / np.sqrt(fitted.values)
    explained = fitted.values / fitted.trace

    def moments(x: np.ndarray) -> np.ndarray:
        z = (x - mean) @ project
        return np.append(z.T @ z, z.sum(axis=0))

    total = _summed(rows, d, "double", k * k + k, moments) / n
    error = float(np.abs(total[: k * k].reshape(k, k) - np.outer(total[k * k :], total[k * k :]) - np.eye(k)).max())

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                x, at = _whole(part.column("embedding"), d)
                if not len(x):
                    continue
                y = x * n - sums
                fits = (y.astype(np.float64) ** 2).sum(axis=1) < 9.2e18
                deviation = np.where(fits, (y * y).sum(axis=1), 0)
                ids = part.column("vec_id").take(pa.array(np.repeat(at, k)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n)), pa.array(np.repeat(deviation, k), mask=~np.repeat(fits, k)),
                    pa.array(((x - mean) @ project).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error))], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.withColumn("vec_id", F.col("vec_id").cast("long")).mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
