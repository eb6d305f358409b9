"""Vectors by the cells that they lie in: approximate search with exact distances, and joins of near vectors that miss none.

A cell is what lies nearest to a centre. Centres are fitted to a bounded sample, vectors are all indexed: stored by cell, so
that a search reads the cells it wants and nothing else. Joins of near vectors cut space into boxes (Boxes) along the axes in
which a sample spreads most. Queries meet vectors in the boxes that lie within the radius of a vector; where vectors meet one
another, each is stored once, with others of its box, and what is stored together is read together with what lies near.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recall_spark.operators import graphs, search
from recall_spark.operators.joins import shared_dir, small

#: Vectors that centres are fitted to, bytes of them at most, and rounds of the fit.
SAMPLE, SAMPLE_BYTES, ROUNDS = 20_000, 256 << 20, 12
#: Queries on which recall is measured to choose how many cells are searched.
TRIALS = 200
#: Values of a scope's column by which stored vectors are chosen before they are read.
SCOPES = 1_000
#: Rows of a group that one task compares, axes along which space is cut, rows of a piece of a group, and pairs compared at once.
BLOCK, AXES, PIECE, PAIRS = 65_536, 8, 1_024, 1 << 22
#: Vectors and bytes of them that are stored together, in one row; rows of a file of these; vectors of a strip; axes by which pairs are left out.
STORED, STORED_BYTES, FILE_ROWS, STRIP, FILTER = 8_192, 2 << 20, 8, 256, 16
#: Bytes of vectors that a task keeps decoded.
HELD_BYTES = 192 << 20


def fitted(vectors: DataFrame, cells: int, sample: int = SAMPLE, seed: int = 5) -> np.ndarray:
    """cells centres (fewer of fewer vectors) of a sample of vectors (embedding), always the same one: those of lowest hash."""
    x = sampled(vectors, sample)
    if not len(x):
        return np.zeros((0, 0))
    centres = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own = _distances(x, centres).argmin(1)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def sampled(vectors: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Different vectors (embedding) of the commonest width, those of lowest hash, sample of them and SAMPLE_BYTES at most."""
    good = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))
    width = good.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if width is None:
        return np.zeros((0, 0))
    most = max(1, min(sample, SAMPLE_BYTES // (8 * width["d"])))
    rows = good.where(F.size("embedding") == width["d"]).select(F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    # Each task sends the driver what may be among the lowest: few of its rows, if hashes are spread as those of different vectors are.
    share = (most + 6 * most**0.5 + 10) / width["n"]
    low = rows.where(F.xxhash64("e") < int(-(2**63) + 2**64 * share)) if share < 1 else rows
    x = [r["e"] for r in low.orderBy(F.xxhash64("e")).limit(most).collect()]
    if share < 1 and len(x) < most:
        x = [r["e"] for r in rows.orderBy(F.xxhash64("e")).limit(most).collect()]
    return np.unique(np.array(x), axis=0)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * x @ centres.T, 0.0)


def assigned(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """vectors with cell, the number of their nearest centre; those of another length, null or partly null have -1."""
    sent = vectors.sparkSession.sparkContext.broadcast(centres)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)

    def run(batches):
        own = sent.value
        for batch in batches:
            cell = np.full(batch.num_rows, -1, np.int32)
            if len(own):
                rows, at = search._matrix(batch.column("embedding"), own.shape[1])
                cell[at] = _distances(rows, own).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    return vectors.mapInArrow(run, f"{schema}, cell int")


class Cells:
    """An index at one path: centres, vectors by cell, and how many cells a search takes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        rows = spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()  # as many as the index has cells
        self.centres = np.array([r["centre"] for r in rows])
        self.probes = rows[0]["probes"] if rows else 0

    @staticmethod
    def build(vectors: DataFrame, path: str, cells: int | None = None, recall: float = 0.95, k: int = 50) -> "Cells":
        """Index vectors (memory_id, embedding, and such as repo_id). cells: about the root of their number by default, 4,096 at
        most. The number of cells that a search takes is the smallest at which a sample of vectors finds so much of its k nearest."""
        spark, path = vectors.sparkSession, path.rstrip("/")
        cells = cells or int(max(1, min(4_096, vectors.count() ** 0.5)))
        centres = fitted(vectors, cells)
        Cells._write(spark, centres, 0, f"{path}/centres")
        vectors.limit(0).withColumn("cell", F.lit(0)).write.mode("overwrite").parquet(f"{path}/schema")
        index = Cells(spark, path)
        index.add(vectors)
        index.probes = index._calibrated(recall, k)
        Cells._write(spark, centres, index.probes, f"{path}/centres")
        return index

    @staticmethod
    def _write(spark: SparkSession, centres: np.ndarray, probes: int, path: str) -> None:
        rows = spark.createDataFrame([(i, c.tolist(), probes) for i, c in enumerate(centres)], "cell int, centre array<double>, probes int")
        rows.coalesce(1).write.mode("overwrite").parquet(path)

    def add(self, vectors: DataFrame) -> None:
        """Index more vectors, in the cells there are. A cell that is large is written by several tasks."""
        assigned(vectors, self.centres).hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{self.path}/vectors")

    def vectors(self) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/schema").schema
        return self.spark.read.schema(schema).parquet(f"{self.path}/vectors")

    def _cells_of(self, queries: DataFrame, probes: int) -> DataFrame:
        """queries, a row for each of the nearest cells."""
        sent = self.spark.sparkContext.broadcast(self.centres)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)

        def run(batches):
            for batch in batches:
                if not len(sent.value):
                    continue
                rows, at = search._matrix(batch.column("embedding"), sent.value.shape[1])
                near = np.argsort(_distances(rows, sent.value), axis=1, kind="stable")[:, :probes]
                taken = batch.take(pa.array(np.repeat(at, near.shape[1])))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(near.ravel().astype(np.int32))], names=[*batch.schema.names, "cell"])

        return queries.mapInArrow(run, f"{schema}, cell int")

    def top_k(self, queries: DataFrame, k: int, scoped: tuple[str, ...] = (), probes: int | None = None) -> DataFrame:
        """query_id, memory_id, similarity, rank as search.top_k() gives them, of the nearest cells only: distances are exact, but
        a neighbour in a cell that isn't searched is missed. With as many probes as cells nothing is."""
        if not len(self.centres):
            return search.top_k(self.vectors(), queries.limit(0), k, scoped)

        def nearest(embeddings: list[list[float]]) -> list[list[int]]:
            out: list[list[int]] = [[] for _ in embeddings]
            own = [i for i, e in enumerate(embeddings) if len(e) == self.centres.shape[1]]
            for n in range(0, len(own), 1_000):
                part = own[n : n + 1_000]
                found = np.argsort(_distances(np.array([embeddings[i] for i in part], float), self.centres), axis=1, kind="stable")[:, : probes or self.probes]
                for i, cells in zip(part, found.tolist()):
                    out[i] = cells
            return out

        return search.top_k(self.vectors(), queries.select("query_id", "embedding", *scoped), k, scoped, ("cell", nearest))

    def recall(self, queries: DataFrame, k: int, probes: int | None = None) -> float:
        """The share of the k nearest, by exact search over all vectors, that top_k() finds for these queries."""
        exact = search.top_k(self.vectors(), queries, k).select("query_id", "memory_id")
        found = self.top_k(queries, k, probes=probes).select("query_id", "memory_id")
        hit, all_of_them = found.join(exact, ["query_id", "memory_id"], "left_semi").count(), exact.count()
        return hit / all_of_them if all_of_them else 1.0

    def _calibrated(self, recall: float, k: int) -> int:
        """The least number of probes for a recall: for each neighbour of a trial the rank of its cell among the trial's cells."""
        if not len(self.centres):
            return 0
        usable = self.vectors().where("cell >= 0")
        trials = usable.orderBy(F.xxhash64(F.col("memory_id").cast("string"), F.lit(11))).limit(TRIALS).select(F.xxhash64("memory_id").alias("query_id"), "embedding")
        exact = search.top_k(self.vectors(), trials, k)
        ranked = self._cells_of(trials, len(self.centres)).select("query_id", "cell")  # TRIALS x cells rows
        order = ranked.groupBy("query_id").agg(F.collect_list("cell").alias("cells"))
        where = small(exact.select("query_id", "memory_id"), TRIALS * k).join(usable.select("memory_id", "cell"), "memory_id")
        ranks = where.join(F.broadcast(order), "query_id").select(F.array_position("cells", F.col("cell")).alias("r")).orderBy("r").collect()  # TRIALS x k
        return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]["r"]) if ranks else 1


class Boxes:
    """Space, cut into boxes by planes at medians of a sample, along the AXES in which it spreads most.

    A projection on such axes brings no two vectors further apart, so vectors within a radius of each other are so in it.
    The same holds with what the axes leave of a vector as one more coordinate, its length (features)."""

    def __init__(self, sample: np.ndarray, boxes: int):
        sample = sample[np.isfinite(sample).all(1)]
        self.width, self.depth = sample.shape[1], max(0, int(np.ceil(np.log2(max(1, boxes)))))
        self.mean = sample.mean(0) if len(sample) else np.zeros(self.width)
        x = sample - self.mean
        self.more = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :FILTER] if len(x) else np.zeros((self.width, 0))
        self.axes = self.more[:, :AXES]
        self.axis, self.cut = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, np.inf)
        parts = {0: x @ self.axes}
        for node in range(2**self.depth - 1):
            p = parts.pop(node)
            if len(p) > 1 and p.shape[1]:
                a = self.axis[node] = int((p.max(0) - p.min(0)).argmax())
                self.cut[node] = np.median(p[:, a])
                right = p[:, a] > self.cut[node]
                parts[2 * node + 1], parts[2 * node + 2] = p[~right], p[right]
            else:
                parts[2 * node + 1], parts[2 * node + 2] = p, p[:0]

    def projected(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.axes

    def features(self, x: np.ndarray, axes: np.ndarray) -> np.ndarray:
        """x on some of the axes, and the length of the rest; nothing but that length for vectors of another width."""
        x = x - self.mean if x.shape[1] == self.width else x
        p = x @ axes if len(axes) == x.shape[1] else x[:, :0]
        rest = x - p @ axes.T if p.shape[1] else x
        return np.hstack([p, np.sqrt((rest**2).sum(1))[:, None]])

    def home(self, p: np.ndarray) -> np.ndarray:
        """The box that each projected vector lies in."""
        node = np.zeros(len(p), int)
        for _ in range(self.depth):
            node = 2 * node + 1 + (p[np.arange(len(p)), self.axis[node]] > self.cut[node])
        return node - (2**self.depth - 1)

    def within(self, p: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Projected vectors and the boxes that lie within a radius of them."""
        found = []
        most = (radius * (1 + 1e-9) + 1e-9 * (1 + np.abs(p).max(initial=0.0))) ** 2
        open_ = [(0, np.arange(len(p)), np.zeros_like(p))]
        while open_:
            node, rows, off = open_.pop()
            if not len(rows):
                continue
            if node >= len(self.cut):
                found.append((rows, np.full(len(rows), node - len(self.cut))))
                continue
            a = self.axis[node]
            side = p[rows, a] - self.cut[node]
            for child, beyond in ((2 * node + 1, side), (2 * node + 2, -side)):
                far = off.copy()
                far[:, a] = np.maximum(far[:, a], beyond)
                near = (far**2).sum(1) <= most
                open_.append((child, rows[near], far[near]))
        return (np.concatenate([r for r, _ in found]), np.concatenate([c for _, c in found])) if found else (np.zeros(0, int), np.zeros(0, int))


def _placed(df: DataFrame, boxes: Boxes, radius: float | None, onward: bool = False) -> DataFrame:
    """df, a row for each box that its embedding goes to: its own, or with a radius all within it; home: whether it lies there.

    onward: none that comes before its own, so that of two boxes one is sent to the other. Vectors of another width than the
    boxes' have a box for each width; those that are null, empty or partly null go."""
    sent = df.sparkSession.sparkContext.broadcast(boxes)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches):
        own = sent.value
        for batch in batches:
            sizes = batch.column("embedding").value_lengths()
            for width in (w for w in pc.unique(sizes).to_pylist() if w):
                x, at = search._matrix(batch.column("embedding"), width)
                if width != own.width:
                    r, cell, home = np.arange(len(x)), np.full(len(x), -width), np.full(len(x), -width)
                else:
                    p = own.projected(x)
                    home = own.home(p)
                    r, cell = (np.arange(len(x)), home) if radius is None else own.within(p, radius)
                    if onward:
                        r, cell = r[cell >= home[r]], cell[cell >= home[r]]
                taken = batch.take(pa.array(at[r]))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell.astype(np.int32)), pa.array(home[r] == cell)], names=[*batch.schema.names, "cell", "home"])

    return df.mapInArrow(run, f"{schema}, cell int, home boolean")


def _pieces(p: np.ndarray, most: int | None = None) -> list[np.ndarray]:
    """Rows of projected vectors in pieces of PIECE (or so many) at most, by halves along the axis in which each spreads most."""
    done, open_ = [], [np.arange(len(p))]
    while open_:
        rows = open_.pop()
        if len(rows) <= (most or PIECE):
            done.append(rows)
            continue
        own = p[rows]
        order = np.argpartition(own[:, (own.max(0) - own.min(0)).argmax()], len(rows) // 2) if p.shape[1] else np.arange(len(rows))
        open_ += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return done


def _near_pairs(x: np.ndarray, y: np.ndarray, boxes: Boxes, least: float):
    """i, j, distance of rows of x and y at least so similar, in parts; all of a row of x come one after another.

    What single precision leaves open is decided in double."""
    if not len(x) or not len(y):
        return
    radius2 = -np.log(least)
    same = x.shape[1] == boxes.width
    px, py = (boxes.projected(x), boxes.projected(y)) if same else (x[:, :0], y[:, :0])
    mean = boxes.mean if same else y.mean(0)
    x0, y0 = x - mean, y - mean
    sx, sy = (x0**2).sum(1), (y0**2).sum(1)
    top = max(sx.max(), sy.max())
    # Beside sums of products stand half the squares: one product gives half the squared distance, negative.
    kind = np.float32 if top < 1e30 else np.float64
    one = np.ones((max(len(x), len(y)), 1))
    a = np.hstack([x0, one[: len(x)], -sx[:, None] / 2]).astype(kind)
    b = np.hstack([y0, -sy[:, None] / 2, one[: len(y)]]).astype(kind)
    low = -(radius2 / 2 + 4 * (x.shape[1] + 4) * np.finfo(kind).eps * top)
    reach = (np.sqrt(radius2) * (1 + 1e-9) + 1e-9 * (1 + np.sqrt(top))) ** 2
    for piece in _pieces(px):
        own = px[piece]
        off = np.maximum(np.maximum(own.min(0) - py, py - own.max(0)), 0.0)
        near = np.flatnonzero((off**2).sum(1) <= reach)
        step = max(1, PAIRS // len(piece))
        for n in range(0, len(near), step):
            part = near[n : n + step]
            i, j = np.divmod(np.flatnonzero((a[piece] @ b[part].T).ravel() >= low), len(part))
            for m in range(0, len(i), 1 << 17):
                u, v = piece[i[m : m + (1 << 17)]], part[j[m : m + (1 << 17)]]
                d = ((x[u] - y[v]) ** 2).sum(1)
                good = np.exp(-d) >= least
                if good.any():
                    yield u[good], v[good], d[good]


def _same(embedding: str = "embedding"):
    """A hash of a vector, by which equal ones are one."""
    return F.sha2(F.to_binary(F.to_json(embedding), F.lit("utf-8")), 256)


class _Part:
    """Vectors that are compared with others, and the boxes around strips of them."""

    def __init__(self, x: np.ndarray, boxes: Boxes):
        self.x, exact = x, x.astype(np.float64)
        self.coarse, self.fine = (boxes.features(exact, axes) for axes in (boxes.axes, boxes.more))
        self.strips = _pieces(self.coarse, STRIP) if len(x) else []
        self.slack = 1e-9 * (1 + np.abs(self.coarse).max(initial=0.0))
        self.low, self.high = (np.array([f(self.coarse[rows], 0) for rows in self.strips]) for f in (np.min, np.max))
        self.strip = np.empty(len(x), int)
        for n, rows in enumerate(self.strips):
            self.strip[rows] = n


def _off(low: np.ndarray, high: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The squared distance of each row of p from a box."""
    return (np.maximum(np.maximum(low - p, p - high), 0.0) ** 2).sum(1)


def _candidates(a: _Part, b: _Part, reach: float, own: np.ndarray, near: np.ndarray):
    """u, v: rows of own and near whose features are within reach (squared), in parts; in single precision, with room for its errors."""
    # About a point amid them numbers are small, and so are errors.
    middle = a.fine[own].mean(0)
    p, q = a.fine[own] - middle, b.fine[near] - middle
    sp, sq = (p**2).sum(1), (q**2).sum(1)
    most = max(sp.max(), sq.max())
    kind = np.float32 if most < 1e30 else np.float64
    one = np.ones((max(len(p), len(q)), 1))
    # Beside sums of products stand half the squares: one product gives half the squared distance, negative.
    left = np.hstack([p, one[: len(p)], -sp[:, None] / 2]).astype(kind)
    right = np.hstack([q, -sq[:, None] / 2, one[: len(q)]]).astype(kind)
    low = -(reach / 2 + 4 * (p.shape[1] + 4) * np.finfo(kind).eps * most)
    step = max(1, PAIRS // len(own))
    for n in range(0, len(near), step):
        part = near[n : n + step]
        i, j = np.divmod(np.flatnonzero((left @ right[n : n + step].T).ravel() >= low), len(part))
        yield own[i], part[j]


def _ties(a: _Part, b: _Part, at: np.ndarray, bt: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """u, v: rows of a and b (or twice the same) at least so similar, each pair tying together what was apart; and at after that.

    at, bt: numbers of the rows; what has one number hangs together already, in both. Strips are left out by their boxes, pairs
    by their features, and what both leave is decided by whole vectors in double precision."""
    reach = (np.sqrt(-np.log(least)) * (1 + 1e-9) + a.slack + b.slack) ** 2
    names, number = np.unique(np.concatenate([at, bt]), return_inverse=True)
    top, at, bt = np.arange(len(names)), number[: len(at)], number[len(at) :]
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def tie(u, v):
        nonlocal top
        good = np.flatnonzero(np.exp(-((a.x[u].astype(np.float64) - b.x[v]) ** 2).sum(1)) >= least)
        tied = []
        for n, c, d in zip(good.tolist(), at[u[good]].tolist(), bt[v[good]].tolist()):
            while top[c] != c:
                c = top[c]
            while top[d] != d:
                d = top[d]
            if c != d:
                top[max(c, d)] = min(c, d)
                tied.append(n)
        if tied:
            out.append((u[tied], v[tied]))
            while not np.array_equal(up := top[top], top):
                top = up

    def apart(u, v):
        open_ = top[at[u]] != top[bt[v]]
        return u[open_], v[open_]

    for n, own in enumerate(a.strips):
        near = np.flatnonzero(b.strip >= n) if a is b else np.arange(len(b.x))
        tops = top[at[own]]
        if (tops == tops[0]).all():
            near = near[top[bt[near]] != tops[0]]
        near = near[_off(a.low[n], a.high[n], b.coarse[near]) <= reach]
        for u, v in _candidates(a, b, reach, own, near) if len(near) else ():
            u, v = apart(u, v)
            if len(u) > 1 << 13:  # in a crowd, one pair of each row ties nearly all
                for by in (0, 1):
                    first = np.unique((u, v)[by], return_index=True)[1]
                    tie(u[first], v[first])
                    u, v = apart(u, v)
            for m in range(0, len(u), 1 << 16):
                tie(*apart(u[m : m + (1 << 16)], v[m : m + (1 << 16)]))
    u, v = (np.concatenate([o[n] for o in out]) if out else np.zeros(0, int) for n in (0, 1))
    return u, v, names[top[at]]


def _stored(heads: DataFrame, boxes: Boxes, least: float) -> DataFrame:
    """Vectors (memory_id, embedding), each once, so many of a box together as STORED says.

    leaf, width: what they have in common. low, high: the box around them. ids, vectors (as bytes), tops: a number for each,
    shared by those of the leaf that hang together; links: pairs of the leaf that say so."""
    sent = heads.sparkSession.sparkContext.broadcast(boxes)
    kind, of = heads.schema["memory_id"].dataType.simpleString(), _bytes_of(heads)
    rows = _placed(heads.select("memory_id", "embedding"), boxes, None).drop("home")
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))  # a row for each box
    dealt = rows.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("memory_id"), F.col("blocks")).cast("int"))

    def leaf(key, table):
        cell, block, table = key[0].as_py(), key[1].as_py(), table.combine_chunks()
        width = sent.value.width if cell >= 0 else -cell
        x, at = search._matrix(table.column("embedding"), width)
        finite = np.isfinite(x).all(1)  # to others nothing is near
        x, ids = x[finite], table.column("memory_id").combine_chunks().take(pa.array(at[finite]))
        whole = _Part(x, sent.value)
        u, v, tops = _ties(whole, whole, np.arange(len(x)), np.arange(len(x)), least)
        parts = _pieces(whole.coarse, max(1, min(STORED, STORED_BYTES // (width * np.dtype(of).itemsize)))) if len(x) else []
        links = [{"a": a, "b": b} for a, b in zip(ids.take(pa.array(u)).to_pylist(), ids.take(pa.array(v)).to_pylist())]
        columns = {
            "leaf": pa.array([(cell << 31) + block for _ in parts], pa.int64()), "width": pa.array([width for _ in parts], pa.int32()), "part": pa.array(range(len(parts)), pa.int32()),
            "low": pa.array([whole.coarse[p].min(0) - whole.slack for p in parts], pa.list_(pa.float64())), "high": pa.array([whole.coarse[p].max(0) + whole.slack for p in parts], pa.list_(pa.float64())),
            "ids": pa.array([ids.take(pa.array(p)).to_pylist() for p in parts], pa.list_(ids.type)), "tops": pa.array([tops[p].astype(np.int32) for p in parts], pa.list_(pa.int32())),
            "vectors": pa.array([x[p].astype(of).tobytes() for p in parts], pa.binary()),
            "links": pa.array([links if n == 0 else [] for n in range(len(parts))], pa.list_(pa.struct([("a", ids.type), ("b", ids.type)]))),
        }
        return pa.table(columns)

    return dealt.groupBy("cell", "block").applyInArrow(leaf, "leaf long, width int, part int, low array<double>, high array<double>, "
        f"ids array<{kind}>, tops array<int>, vectors binary, links array<struct<a {kind}, b {kind}>>")


def _bytes_of(vectors: DataFrame) -> str:
    """How the numbers of vectors (embedding) are stored as bytes: all of them whole."""
    return "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"


def _met(stored: DataFrame, of: str, boxes: Boxes, least: float) -> DataFrame:
    """a, b: pairs of vectors from different leaves of _stored() at least so similar, one for each two groups of leaves that they tie.

    What is stored together is read from there with all that lies near: a Cartesian product of files, whose boxes are compared
    first. Nothing is shuffled or written, and a task holds the vectors of two files."""
    sent = stored.sparkSession.sparkContext.broadcast(boxes)
    kind = stored.schema["ids"].dataType.elementType.simpleString()
    a, b = (stored.select(*(F.col(c).alias(f"{c}_{side}") for c in stored.columns if c != "links")) for side in "ab")
    gap = lambda i: F.greatest(F.get("low_a", F.lit(i)) - F.get("high_b", F.lit(i)), F.get("low_b", F.lit(i)) - F.get("high_a", F.lit(i)), F.lit(0.0))
    apart = reduce(lambda x, y: x + y, (gap(i) * gap(i) for i in range(AXES + 1)))
    close = (F.col("width_a") == F.col("width_b")) & (F.col("leaf_a") < F.col("leaf_b")) & (apart <= -np.log(least) * (1 + 1e-8))
    pairs = a.join(b.hint("shuffle_replicate_nl"), close)

    def run(batches):
        known: dict[tuple, _Part] = {}
        held = 0
        for batch in batches:
            found: list[list[pa.Array]] = [[], []]
            for n in range(batch.num_rows):
                row = {name: batch.column(name)[n] for name in batch.schema.names}
                parts, tops = [], []
                for side in "ab":
                    key = row[f"leaf_{side}"].as_py(), row[f"part_{side}"].as_py()
                    if (part := known.get(key)) is None:
                        part = _Part(np.frombuffer(row[f"vectors_{side}"].as_buffer(), of).reshape(-1, row["width_a"].as_py()).copy(), sent.value)
                        if held < HELD_BYTES:  # files are gone through again and again, so what came first stays
                            known[key] = part
                            held += part.x.nbytes + part.coarse.nbytes + part.fine.nbytes
                    parts.append(part)
                    tops.append(row[f"tops_{side}"].values.to_numpy().astype(np.int64))
                u, v, _ = _ties(*parts, tops[0], tops[1] + tops[0].max() + 1, least)
                for side, rows, to in (("a", u, found[0]), ("b", v, found[1])):
                    to.append(row[f"ids_{side}"].values.take(pa.array(rows)))
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(f) for f in found], names=["a", "b"])

    return pairs.mapInArrow(run, f"a {kind}, b {kind}")


def near_edges(vectors: DataFrame, least: float, sample: np.ndarray | None = None, boxes: int | None = None) -> DataFrame:
    """a, b: edges that join all vectors (memory_id, embedding) at least so similar, directly or over others that are.

    Equal vectors are one, whatever their number. The others are dealt by boxes of space (about STORED vectors each by default),
    cut by a sample, of these vectors where none is given. Each is stored once, with others of its box; whoever lies near is
    compared where it is stored, so what goes to disk grows with the vectors, not with the boxes that a vector is near to.
    Tasks give a tree for each group they find, not its pairs. The result reads saved tables: its done() deletes them."""
    rounds = graphs.Rounds(vectors, "near")
    one = rounds.keep(vectors.where(F.col("embedding").isNotNull()).select("memory_id", "embedding", F.unhex(_same()).alias("same")))
    # All that are equal hang on the smallest id. Ids and hashes find them, without the vectors.
    repeated = rounds.keep(one.groupBy("same").agg(F.min("memory_id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n"))
    copies = rounds.keep(one.select("memory_id", "same").join(small(repeated), "same").where("memory_id <> head"))
    heads = rounds.keep(one.join(small(copies.select("memory_id", "same")), ["memory_id", "same"], "left_anti").drop("same"))
    rounds.drop(one, repeated)
    given = sampled(heads) if sample is None else sample
    space = Boxes(given, boxes or (len(given) if sample is not None else min(-(-heads.count() // STORED), 1 + len(given) // 16)))
    stored = rounds.keep(_stored(heads, space, least), FILE_ROWS)
    rounds.drop(heads)
    links = stored.select(F.explode("links").alias("link")).select("link.a", "link.b")
    equal = copies.select(F.col("memory_id").alias("a"), F.col("head").alias("b"))
    edges = equal.unionByName(links).unionByName(_met(stored, _bytes_of(vectors), space, least))
    edges.done = lambda: rounds.drop(copies, stored)
    return edges


def near_groups(memories: DataFrame, vectors: DataFrame, least: float, cells: int | None = None) -> DataFrame:
    """memory_id, keep_id, of each memory whose vector hangs together with that of an older one (created_at, then memory_id)
    over vectors at least so similar (exp of minus the squared distance, 0 to 1): all but the oldest of a group."""
    if not 0 < least < 1:
        raise ValueError("the least similarity has to lie between 0 and 1")
    edges = near_edges(vectors, least, boxes=cells)
    groups = graphs.components(edges)
    edges.done()
    dated = groups.join(memories.select(F.col("memory_id").alias("id"), "created_at"), "id")
    kept = dated.groupBy("component").agg(F.min(F.struct("created_at", "id")).alias("first"))
    return dated.join(small(kept), "component").where(F.col("id") != F.col("first.id")).select(F.col("id").alias("memory_id"), F.col("first.id").alias("keep_id"))


def near(vectors: DataFrame, queries: DataFrame, least: float, k: int = 1, scoped: tuple[str, ...] = ()) -> DataFrame:
    """query_id, memory_id, similarity, rank as search.top_k() gives them, of hits at least so similar only: for any number of queries.

    Vectors and queries are made once and dealt by boxes, in blocks of bounded size; of equal vectors of a scope the k of
    smallest ids count, and equal queries are one. The result reads a saved table of hits."""
    radius = float(np.sqrt(-np.log(least)))
    rounds = graphs.Rounds(vectors, "near")
    scope = F.to_json(F.struct(*scoped), {"ignoreNullFields": "false"}) if scoped else F.lit("")
    asked = rounds.keep(queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding", *scoped, scope.alias("scope"), _same().alias("same")))
    for c in scoped:  # literals prune partitions and row groups
        values = [r[0] for r in asked.select(c).distinct().limit(SCOPES + 1).collect()]
        if len(values) <= SCOPES:
            named = F.col(c).isin(*(x for x in values if x is not None))
            vectors = vectors.where(named | F.col(c).isNull() if None in values else named)
    kept = rounds.keep(vectors.where(F.col("embedding").isNotNull()).select("memory_id", "embedding", scope.alias("scope"), _same().alias("same")))
    equal = Window.partitionBy("scope", "same").orderBy("memory_id")
    stored = kept.withColumn("n", F.row_number().over(equal)).where(F.col("n") <= k).select("memory_id", "embedding", "scope")
    one = asked.groupBy("scope", "same").agg(F.first("embedding").alias("embedding"), F.min("query_id").alias("head"))
    space = Boxes(sampled(kept), 4 * max(kept.count(), asked.count()) // BLOCK)
    sent = vectors.sparkSession.sparkContext.broadcast(space)
    ours, theirs = _placed(one, space, None).drop("home"), _placed(stored, space, radius).drop("home")
    by = ["scope", "cell"]

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))

    sizes = rounds.keep(blocks(ours, "lows").join(blocks(theirs, "highs"), by))  # a row for each box and scope with both
    few = small(sizes)

    def dealt(df: DataFrame, name: str, own: str, other: str, other_name: str) -> DataFrame:
        rows = df.join(few, by).withColumn(own, F.pmod(F.xxhash64(name), F.col(f"{own}s")).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other_name) - 1))).drop("lows", "highs")

    left = dealt(ours, "head", "low", "high", "highs").groupBy(*by, "low", "high")
    right = dealt(theirs, "memory_id", "high", "low", "lows").groupBy(*by, "low", "high")
    kind, same = vectors.schema["memory_id"].dataType.simpleString(), "scope string, same string"

    def nearest(key, a, b):
        width = sent.value.width if key[1].as_py() >= 0 else -key[1].as_py()
        (x, ax), (y, ay) = (search._matrix(t.combine_chunks().column("embedding"), width) for t in (a, b))
        ids = b.column("memory_id").combine_chunks().take(pa.array(ay))
        place = np.empty(len(y), np.int64)
        place[pc.sort_indices(ids).to_numpy()] = np.arange(len(y))
        found, waiting = [], 0

        def cut(parts):
            q, v, d = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((place[v], d, q))
            q, v, d = q[order], v[order], d[order]
            first = np.arange(len(q)) - np.searchsorted(q, q) < k
            return q[first], v[first], d[first]

        for q, v, d in _near_pairs(x, y, sent.value, least):
            found.append((q, v, np.round(d, 9)))
            waiting += len(q)
            if waiting > PAIRS:
                found = [cut(found)]
                waiting = 0
        q, v, d = cut(found) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        rows = a.select(["scope", "same"]).take(pa.array(ax[q]))
        return pa.Table.from_arrays([*(c.combine_chunks() for c in rows.columns), ids.take(pa.array(v)), pa.array(d)], names=["scope", "same", "memory_id", "distance"])

    hits = left.cogroup(right).applyInArrow(nearest, f"{same}, memory_id {kind}, distance double")
    best = hits.withColumn("rank", F.row_number().over(Window.partitionBy("scope", "same").orderBy("distance", "memory_id"))).where(F.col("rank") <= k)
    out = rounds.keep(asked.select("query_id", "scope", "same").join(best, ["scope", "same"]).select("query_id", "memory_id", F.exp(-F.col("distance")).alias("similarity"), "rank"))
    rounds.drop(kept, asked, sizes)
    return out
