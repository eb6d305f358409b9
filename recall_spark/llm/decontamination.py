"""Benchmark decontamination: MinHash containment search for short items inside long documents.

A short item and a long document have a tiny Jaccard similarity however well the item is contained, so both
sides are partitioned by size. Items of up to 8 distinct shingles need no sketch: a document that holds one to the
limit holds one of any few of its shingles, one more than may lack, so that looking these up misses none. Larger
items fall in classes of up to 16, 32, ... distinct shingles. For a class of up
to u shingles a document is a row of overlapping windows of 2u shingles, one beginning every u, so that any
passage of u shingles lies wholly in one window of comparable size. Windows and items get 64 minima; a window
that shares one with an item of its class makes the document a candidate for it. All candidates are verified
by exact containment of the item's shingles in the whole document. An item of the class' smallest size,
contained to 0.75 in one passage, is missed with probability below 1e-5.

The items are the query set: they are taken in blocks of about ITEM_BLOCK items and ITEM_BYTES of text at most, whose
sketches (768 bytes an item) and shingle sets (8 bytes a word), some 160 MB together, go to the executors, and every
document is searched in place, without a shuffle. A larger benchmark means a pass over the documents for each block.

Null, empty and blank items are contained in nothing; null texts count as empty. Items of fewer than five words
are one shingle of all their words and are looked up exactly, with runs of that many words. Items and documents
that are repeated give repeated results once (a result is distinct). Extra columns are ignored; a null id is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall_spark.llm import textarrays as ta
from recall_spark.llm.common import keyed, only, without

HASHES = 64
LEAST_BLOCK = 8
PERCENT = 75
ITEM_BLOCK = 100_000
ITEM_BYTES = 64 << 20
_FILTER_BITS = 22

_rng = np.random.Generator(np.random.PCG64(11))
_A = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_SLOT = np.arange(HASHES, dtype=np.uint64) << np.uint64(32)
_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_item", pa.int64()), ("n_found", pa.int64())])


def block_minima(shingles: np.ndarray, block: int) -> np.ndarray:
    """Minima of consecutive blocks, a row for each; the last block may be shorter."""
    folded = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    n = -(-len(folded) // block)
    padded = np.concatenate([folded, np.repeat(folded[-1:], n * block - len(folded))])
    out = np.empty((n, HASHES), np.uint32)
    step = max(1, 4096 // block)
    for at in range(0, n, step):
        h = padded[at * block : (at + step) * block, None] * _A
        h += _B
        out[at : at + step] = h.reshape(-1, block, HASHES).min(axis=1)
    return out


def size_class(n: int) -> int:
    return max(LEAST_BLOCK, 1 << (max(n, 1) - 1).bit_length())


class ItemIndex:
    """Sketches and shingle sets of one block of items, by size class; what is sent to the executors."""

    def __init__(self, ids: list, texts: list, percent: int):
        self.percent, self.ids, self.sets, self.short, self.classes = percent, [], [], {}, {}
        column = ta.normalised(pa.array(texts, pa.large_string()))
        words, counts = ta.word_hashes(column)
        at, keys, owners, looked_up = 0, {}, {}, ([], [])
        for item, n in zip(ids, counts):
            own, at = words[at : at + n], at + n
            if not n:
                continue
            number = len(self.ids)
            self.ids.append(item)
            s = np.unique(ta.shingle_hashes(own, np.array([n]))[0])
            self.sets.append(s)
            if n < ta.WIDTH:
                self.short.setdefault(int(n), {}).setdefault(int(s[0]), []).append(number)
                continue
            if len(s) <= LEAST_BLOCK:
                some = s[: len(s) - max(1, -(-percent * len(s) // 100)) + 1]
                looked_up[0].extend(some.tolist())
                looked_up[1].extend([number] * len(some))
                continue
            u = size_class(len(s))
            keys.setdefault(u,
                []).append(block_minima(s, 1 << 30 if len(s) > 4096 else len(s)).min(axis=0) if len(s) <= 4096 else block_minima(s, 4096).min(axis=0))
            owners.setdefault(u, []).append(number)
        shingles = np.array(looked_up[0], np.uint64)
        order = np.argsort(shingles, kind="stable")
        self.some, self.some_of = shingles[order], np.array(looked_up[1], np.int32)[order]
        for u, rows in keys.items():
            flat = (np.array(rows, np.uint32).astype(np.uint64) | _SLOT).ravel()
            order = np.argsort(flat, kind="stable")
            seen = np.zeros(1 << _FILTER_BITS, bool)
            seen[self._hash(flat)] = True
            self.classes[u] = (flat[order], np.repeat(np.array(owners[u], np.int32), HASHES)[order], np.packbits(seen))

    @staticmethod
    def _hash(keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(32)) * np.uint64(0x9E3779B1)) & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)

    def unpacked(self) -> dict:
        return {u: (flat, owners, np.unpackbits(seen).astype(bool)) for u, (flat, owners, seen) in self.classes.items()}

    def candidates(self, shingles: np.ndarray, classes: dict) -> set[int]:
        """Small items of which a shingle was looked up, and those that share a minimum with a window of their class."""
        found: set[int] = set()
        if len(self.some) and len(shingles):
            low, high = np.searchsorted(self.some, shingles, "left"), np.searchsorted(self.some, shingles, "right")
            for a, b in {(a, b) for a, b in zip(low[low < high].tolist(), high[low < high].tolist())}:
                found.update(self.some_of[a:b].tolist())
        if not len(shingles) or not classes:
            return found
        least, rows = LEAST_BLOCK, block_minima(shingles, LEAST_BLOCK)
        for u in sorted(classes):
            while least < u:
                rows = np.minimum(rows[::2], np.concatenate([rows[1::2], rows[-1:]])[: len(rows[::2])]) if len(rows) > 1 else rows
                least *= 2
            windows = np.minimum(rows, np.concatenate([rows[1:], rows[-1:]]))
            flat, owners, seen = classes[u]
            keys = (windows.astype(np.uint64) | _SLOT).ravel()
            keys = keys[seen[self._hash(keys)]]
            low, high = np.searchsorted(flat, keys, "left"), np.searchsorted(flat, keys, "right")
            for a, b in {(a, b) for a, b in zip(low.tolist(), high.tolist()) if a < b}:
                found.update(owners[a:b].tolist())
        return found

    def search(self, words: np.ndarray, classes: dict):
        """(item number, its shingles, those found) for each contained item, in one document's words."""
        count = np.array([len(words)])
        whole = ta.shingle_hashes(words, count)[0]
        close = self.candidates(whole, classes)
        if close:
            have = np.unique(whole)
            for i in sorted(close):
                s = self.sets[i]
                at = np.minimum(np.searchsorted(have, s), len(have) - 1)
                n = int(np.count_nonzero(have[at] == s))
                if 100 * n >= self.percent * len(s):
                    yield i, len(s), n
        for width, wanted in self.short.items():
            if len(words) >= width:
                runs = ta.shingle_hashes(words, count, width)[0] if len(words) > width else ta.shingle_hashes(words, count)[0]
                for h in np.unique(runs).tolist():
                    for i in wanted.get(h, ()):
                        yield i, 1, 1


def _searched(sent):
    def run(batches):
        index = sent.value
        classes = index.unpacked()
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            docs, items, sizes, hits = [], [], [], []
            for at, part in ta.slices(texts):
                words, counts = ta.word_hashes(part)
                end = np.cumsum(counts)
                for k, (a, b) in enumerate(zip(end - counts, end)):
                    for i, size, n in index.search(words[a:b], classes) if b > a else ():
                        docs.append(at + k)
                        items.append(index.ids[i])
                        sizes.append(size)
                        hits.append(n)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()).take(pa.array(docs, pa.int64())), pa.array(items, pa.int64()),
                pa.array(sizes, pa.int64()), pa.array(hits, pa.int64())], schema=_FOUND)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, item_block: int = ITEM_BLOCK,
    item_bytes: int = ITEM_BYTES) -> DataFrame:
    """doc_id, item_id, n_item, n_found, containment: each document and item whose shingles it holds to percent."""
    spark = docs.sparkSession
    items = only(benchmark, "item_id", "text").where("text is not null").distinct()
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // item_block), -(-size // item_bytes))
    whole = only(docs, "doc_id", "text")
    parts = []
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        sent = spark.sparkContext.broadcast(ItemIndex([r["item_id"] for r in rows], [r["text"] for r in rows], percent))
        parts.append(whole.mapInArrow(_searched(sent), "doc_id long, item_id long, n_item long, n_found long"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.distinct().withColumn("containment", F.col("n_found") / F.col("n_item"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without the rows that contain a benchmark item, whatever their ids are."""
    rows = keyed(docs)
    return without(rows, contaminated(rows.select(F.col("_row").alias("doc_id"), "text"), benchmark, percent))
