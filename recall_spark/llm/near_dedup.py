"""Near-duplicate documents by b-bit MinHash.

Each text gives the set of its distinct five-word shingles. 256 minima are taken; of all of them the two low
bits are kept, packed into bit planes, and bands of four of the first 128 give 32 keys. Texts with equal sets
are one class, stood for by its smallest id. Documents that share a key are candidates: their similarity is
estimated from the equal low bits, less the collisions expected of unequal minima, and what may reach the limit
is confirmed on the full shingle sets.

A key shared by n texts doesn't lead to n * n candidates: each is compared with the smallest id of its key, then
with TURNS other members unless already connected; then, of pairs that these links leave in different components,
those that share one of their rarest shingles, as all pairs at the limit do. Every pair that shares a key and can
reach the limit is hence compared or already connected, and no key is capped. A pair at similarity 0.75 shares none of the
32 keys with probability 5e-6, and lies below the margin of the estimate with probability 3e-6.

Nulls and empty or blank texts have no shingles and are linked with nothing. Rows with one doc_id are one node: what
one of their texts is linked with, all of them are. Rows with a null doc_id are kept and linked with nothing. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recall_spark.llm import textarrays as ta
from recall_spark.llm.common import discard, keyed, only, repeats, save, small, without

HASHES, BANDS, ROWS, BITS = 256, 32, 4, 2
PERCENT = 75
#: Standard errors that an estimate may lie below the limit.
MARGIN = 4.5
#: Members of a key, besides its smallest, that are compared with the rest before all components are.
TURNS = 1
#: A list of keys or digests is broadcast if it has at most so many rows (about 5 MB); of longer ones, those of more rows than HOT.
LISTED, HOT = 50_000, 1_000

_rng = np.random.Generator(np.random.PCG64(7))
_A = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_KEY = _rng.integers(1, 1 << 63, (BANDS, ROWS + 1), dtype=np.uint64) | np.uint64(1)

_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64())),
    ("bits", pa.list_(pa.int64()))])


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a non-empty set."""
    folded = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)[:, None]
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(folded), 512):
        h = folded[at : at + 512] * _A
        h += _B
        np.minimum(least, h.min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    return ta.mix((rows * _KEY[:, :ROWS]).sum(axis=1, dtype=np.uint64) + _KEY[:, ROWS]).view(np.int64)


def bit_planes(least: np.ndarray) -> np.ndarray:
    """BITS planes of HASHES bits each, as 64-bit numbers."""
    spread = ta.mix(least.astype(np.uint64) * _KEY[0, 0])
    return np.concatenate([np.packbits(((spread >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)).view(np.int64) for b in range(BITS)])


def _sketches(batches):
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        for at, part in ta.slices(texts):
            n, digests, keys, bits = [], [], [], []
            for s in ta.shingle_sets(part):
                n.append(len(s))
                if len(s):
                    least = minima(s)
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    keys.append(band_keys(least))
                    bits.append(bit_planes(least))
                else:
                    digests.append(None)
                    keys.append(None)
                    bits.append(None)
            yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(digests, pa.binary()),
                pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], schema=_SKETCH)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set, band keys and packed low bits of each document."""
    return only(docs, "doc_id", "text").mapInArrow(_sketches, "doc_id long, n_shingles long, digest binary, keys array<long>, bits array<long>")


def estimate(a: str, b: str) -> Column:
    """Similarity from two columns of bit planes, corrected for minima that differ and agree in their low bits."""
    words, chance = HASHES // 64, 0.5**BITS
    unequal = sum((F.bit_count(_any_bit(a, b, w, words)) for w in range(words)), F.lit(0))
    return ((1 - unequal / HASHES) - chance) / (1 - chance)


def _any_bit(a: str, b: str, word: int, words: int) -> Column:
    out = None
    for plane in range(BITS):
        i = plane * words + word
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        out = x if out is None else out.bitwiseOR(x)
    return out


def least_estimate(percent: int = PERCENT) -> float:
    chance, limit = 0.5**BITS, percent / 100
    agree = limit + (1 - limit) * chance
    return limit - MARGIN * math.sqrt(agree * (1 - agree) / HASHES) / (1 - chance)


def _confirmed(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            left, right = batch.column("text_a"), batch.column("text_b")
            keep = np.zeros(len(left), bool)
            for at, part in ta.slices(left):
                others = (s for _, other in ta.slices(right.slice(at, len(part))) for s in ta.shingle_sets(other))
                keep[at : at + len(part)] = [ta.jaccard_at_least(x, y, percent) for x, y in zip(ta.shingle_sets(part), others)]
            rows = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema=schema)
            yield rows.filter(pa.array(keep))

    return run


def confirm(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those pairs (a, b) whose full shingle sets reach the limit; only texts named in a pair are moved."""
    named = save(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "named")
    texts = only(docs, "doc_id", "text").join(small(named), F.col("doc_id") == F.col("id"), "left_semi")
    # Many pairs may have one b: they are dealt by b as long as they are ids only, then by a with the text of b.
    both = (
        pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )
    links = save(both.mapInArrow(_confirmed(percent), "a long, b long").distinct(), "links")
    discard(named, pairs)
    return links


def connected(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node in links (a, b), by minimum labels and pointer jumps."""
    edges = save(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = save(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "component"),
            "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        pulled = labels.join(near, "node").select("node", F.col("component").alias("before"), F.least("component", "near").alias("component"))
        jumps = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        after = save(pulled.join(jumps, "component", "left").select("node", "before",
            F.least("component", F.coalesce("far", "component")).alias("component")), "labels")
        discard(labels)
        labels = after
        if not labels.where("component < before").limit(1).count():
            discard(edges)
            return labels


def _with_partner(rows: DataFrame, least: float) -> DataFrame:
    """rep, component of the rows (key, rep, component, bits, settled) that have a likely partner in another component.

    Settled rows of a key are in one component, so at least one of two partners is not settled. The semi-join stops
    at the first partner and gives no pairs."""
    other = rows.select(F.col("key").alias("k"), F.col("component").alias("c"), F.col("bits").alias("bits_b"), F.col("settled").alias("s"))
    on = (F.col("key") == F.col("k")) & (F.col("component") != F.col("c")) & (estimate("bits", "bits_b") >= least)
    parts = rows.where("not settled").join(other, on, "left_semi").unionByName(rows.where("settled").join(other.where("not s"), on, "left_semi"))
    return save(parts.select("rep", "component").distinct(), "apart")


def _shingles(batches):
    for batch in batches:
        for at, part in ta.slices(batch.column("text")):
            sets = list(ta.shingle_sets(part))
            of = batch.column("doc_id").slice(at, len(part)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([of, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["rep", "shingles"])


def by_rare_shingles(rows: DataFrame, docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Two tables that are saved on the way, then pairs (a, b) of rows (rep, component) from different components that may reach the limit; none is missed.

    In a common order of shingles, here by how many rows have them, two sets of similarity t share one of their
    first n - t n + 1: what a text shares with none costs no pair, however many texts are somewhat like it."""
    texts = only(docs, "doc_id", "text").join(small(rows.select(F.col("rep").alias("id"))), F.col("doc_id") == F.col("id"), "left_semi")
    sets = save(texts.mapInArrow(_shingles, "rep long, shingles array<long>"), "sets")
    each = sets.select("rep", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("often"))
    order = Window.partitionBy("rep").orderBy("often", "shingle")
    first = each.join(often, "shingle").withColumn("nth", F.row_number().over(order))
    first = first.where((F.col("nth") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) & (F.col("often") > 1))
    first = save(first.join(rows, "rep").select("rep", "component", "n", "nth", "shingle"), "first")
    a, b = (first.select("shingle", F.col("rep").alias(x), F.col("component").alias(f"c{x}"), F.col("n").alias(f"n{x}"),
        (F.col("n") - F.col("nth") + 1).alias(f"left_{x}")) for x in "ab")
    # With the first shingle that they share, no more can be common than either has left.
    room = (100 + percent) * F.least("left_a", "left_b") >= percent * (F.col("na") + F.col("nb"))
    close = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & room
    return sets, first, a.join(b.withColumnRenamed("shingle", "same"), (F.col("shingle") == F.col("same")) & close).select("a", "b").distinct()


def looked_up(rows: DataFrame, listed: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with a saved table (key, n: its number of rows, ...). No task gets all rows of one key, or those that
    have none: what belongs to keys of many rows is sent to the rows, only the others are dealt by key."""
    if listed.count() <= LISTED:
        return rows.join(F.broadcast(listed), key, how)
    hot = small(listed.where(F.col("n") > HOT).withColumn("hot", F.lit(True)))
    first = rows.join(hot, key, "left")
    rest = first.where("hot is null").select(*rows.columns)
    out = first.where("hot").drop("hot").unionByName(rest.where(F.col(key).isNotNull()).join(listed.where(F.col("n") <= HOT), key, how))
    return out.unionByName(rest.where(F.col(key).isNull()), allowMissingColumns=True) if how == "left" else out


def components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of documents whose doc_id is neither null nor repeated."""
    found = save(sketch(docs), "sketch")
    # Most texts stand for themselves: only the digests of several documents are looked up.
    classes = save(found.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1"),
        "classes")
    rep = F.when(F.col("digest").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep")
    member = save(looked_up(found, classes, "digest", "left").select("doc_id", "n_shingles", rep), "member")
    reps = save(found.join(member.where("doc_id = rep").select("rep"), F.col("doc_id") == F.col("rep")).select("rep", "keys", "bits"), "reps")
    by_key = reps.select("rep", F.explode("keys").alias("key"))
    hubs = save(by_key.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1"), "hubs")
    shared = save(looked_up(by_key, hubs, "key"), "shared")
    discard(found, classes, hubs)
    least = least_estimate(percent)
    bits_a = reps.select(F.col("rep").alias("a"), F.col("bits").alias("bits_a"))
    bits_b = reps.select(F.col("rep").alias("b"), F.col("bits").alias("bits_b"))

    def likely(pairs: DataFrame) -> DataFrame:
        return save(pairs.join(bits_a, "a").join(bits_b, "b").where(estimate("bits_a", "bits_b") >= least).select("a", "b"), "pairs")

    def at_keys(label: DataFrame) -> DataFrame:
        own = label.select(F.col("node").alias("rep"), "component")
        return shared.where("n > 2").join(own, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))

    found_links = [confirm(likely(shared.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()), docs, percent)]
    label = connected(found_links[0])
    for turn in range(TURNS):
        # Another member of each key that holds several components is compared with those outside its own.
        at = at_keys(label)
        mixed = at.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"),
            F.min_by(F.struct("rep", "component"), F.xxhash64("rep", "key", F.lit(turn))).alias("next")).where("low < high")
        mixed = save(mixed, "mixed")
        pairs = looked_up(at, mixed, "key").where("component <> next.component").select(F.col("rep").alias("a"),
            F.col("next.rep").alias("b")).distinct()
        found_links.append(confirm(likely(pairs), docs, percent))
        discard(label, mixed)
        label = connected(reduce(DataFrame.union, found_links))
    # What is still apart is compared with all other components that share a key.
    at = at_keys(label)
    mixed = at.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"),
        F.min(F.struct("rep", "component"))["component"].alias("hub_component")).where("low < high").drop("low", "high")
    mixed = save(mixed, "mixed")
    open_rows = save(looked_up(at, mixed, "key").join(reps.select("rep", "bits"), "rep").select("key", "rep", "component", "bits",
        (F.col("component") == F.col("hub_component")).alias("settled")), "open")
    apart = _with_partner(open_rows, least)
    sets, first, pairs = by_rare_shingles(apart, docs, percent)
    found_links.append(confirm(likely(pairs), docs, percent))
    discard(label)
    label = connected(reduce(DataFrame.union, found_links))
    discard(reps, shared, mixed, open_rows, apart, sets, first, *found_links)
    return member.join(label, member["rep"] == label["node"], "left").select("doc_id", "n_shingles",
        F.coalesce("component", "rep", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    rows = only(docs, "doc_id", "text")
    if not repeats(rows):
        found = components(rows, percent)
    else:
        # Rows are nodes, in the order of their ids; those of one id are joined afterwards.
        numbered = keyed(rows)
        named = numbered.where("doc_id is not null")
        by_row = save(components(named.select(F.col("_row").alias("doc_id"), "text"), percent).join(named.select("_row", F.col("doc_id").alias("id")),
            F.col("doc_id") == F.col("_row")).select("id", "n_shingles", "component_id"), "by-row")
        least = by_row.groupBy("id").agg(F.min("component_id").alias("a"), F.max("component_id").alias("high")).where("a < high")
        one = connected(by_row.join(least, "id").where("component_id <> a").select("a", F.col("component_id").alias("b")).distinct())
        joined = by_row.join(one.select(F.col("node").alias("component_id"), "component"), "component_id", "left").withColumn("component",
            F.coalesce("component", "component_id"))
        found = joined.join(named.select(F.col("_row").alias("component"), F.col("doc_id").alias("top")),
            "component").select(F.col("id").alias("doc_id"), "n_shingles", F.col("top").alias("component_id"))
        nameless = sketch(numbered.where("doc_id is null")).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
        found = found.unionByName(nameless)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of docs of each component, that of the smallest doc_id; rows are told apart whatever their ids are."""
    rows = keyed(docs)
    return without(rows, components(rows.select(F.col("_row").alias("doc_id"), "text"), percent).where("doc_id <> component_id"))
