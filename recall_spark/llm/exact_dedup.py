"""Exact duplicates by counting quotient filters.

A document's fingerprint has 48 bits: the high ones (the quotient) name a slot, the low ones (the remainder) are
stored. Each partition builds its own filter, in blocks of slots: which slots are occupied, how long their runs are,
the sorted remainders and a counter for each. The blocks of all partitions merge without loss, because runs of
sorted remainders merge like sorted lists and counters add. Fingerprints counted once belong to unique
documents; the others route their documents to verification, which groups by the normalised text itself, so
colliding fingerprints do no harm. A partition sends one counter per fingerprint and one row per text, however
many copies it holds. Where the repeated fingerprints are too many to be listed on every executor, a bitmap of them
goes there, of bounded size: texts of fingerprints that it lacks, which are unique, still don't move.

Texts are equal when identical after lower-casing A-Z; null counts as empty, so null and empty texts are one
group. The largest doc_id of a group stays. Rows that repeat a doc_id and its text are flagged alike; a null
doc_id is smaller than all others. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall_spark.llm import textarrays as ta
from recall_spark.llm.common import BROADCAST_ROWS, discard, keyed, only, save, small, without

FINGERPRINT_BITS = 48
#: Fingerprints expected in one block of the merged filter, at most: about 2 MB of numbers for a task.
BLOCK_FINGERPRINTS = 1 << 17
#: Least number of blocks, which are merged side by side, as a power of two.
LEAST_BLOCKS = 5
#: Rows of a hash and two numbers that may be broadcast (about 16 MB).
GROUP_ROWS = 160_000
#: Repeated fingerprints that are listed on every executor; above that a bitmap with so many bits for each, so many bytes at most.
LISTED, BITS_EACH, BITMAP_BYTES = BROADCAST_ROWS, 16, 64 << 20
#: Bits of a bitmap that are set by one task, as a power of two.
_PART_BITS = 18
_DIGEST = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.int64()), ("sha", pa.binary())])
_TEXT = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.int64()), ("norm", pa.large_string())])


def _digests(batches):
    for batch in batches:
        texts = [t.as_buffer() for t in ta.normalised(batch.column("text"))]
        prints = [xxhash.xxh3_64_intdigest(t) >> (64 - FINGERPRINT_BITS) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(prints, pa.int64()),
            pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], schema=_DIGEST)


def _texts(batches):
    for batch in batches:
        texts = ta.normalised(batch.column("text"))
        prints = [xxhash.xxh3_64_intdigest(t.as_buffer()) >> (64 - FINGERPRINT_BITS) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(prints, pa.int64()), texts], schema=_TEXT)


def bitmap(prints: DataFrame, count: int) -> np.ndarray:
    """Bits (packed) of which that of each fingerprint is set; their number is a power of two. Parts are made side by side."""
    bits = 1 << min((BITMAP_BYTES * 8).bit_length() - 1, max(_PART_BITS, (count * BITS_EACH - 1).bit_length()))

    def part(key, table):
        own = np.zeros(1 << _PART_BITS, bool)
        own[table["fingerprint"].to_numpy() & ((1 << _PART_BITS) - 1)] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "body": pa.array([np.packbits(own).tobytes()], pa.binary())})

    # The lowest bits of a fingerprint are its place: they are as good as a hash of it.
    placed = prints.select("fingerprint", F.shiftright(F.col("fingerprint").bitwiseAND(bits - 1), _PART_BITS).alias("part"))
    out = np.zeros(bits >> 3, np.uint8)
    size = 1 << (_PART_BITS - 3)
    for r in placed.groupBy("part").applyInArrow(part, "part long, body binary").collect():  # BITMAP_BYTES at most
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["body"], np.uint8)
    return out


def _suspected(sent):
    """_texts() of the rows whose fingerprint's bit is set."""

    def run(batches):
        bits = sent.value
        mask = len(bits) * 8 - 1
        for batch in _texts(batches):
            at = batch.column("fingerprint").to_numpy() & mask
            yield batch.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1))

    return run


_WIDTHS = (np.uint8, np.uint16, np.uint32, np.uint64)


def _packed(values: np.ndarray) -> tuple[int, bytes]:
    """Numbers in the narrowest width that holds them all, and which width it is."""
    top = int(values.max())
    width = next(i for i, t in enumerate(_WIDTHS) if top <= np.iinfo(t).max)
    return width, values.astype(_WIDTHS[width]).tobytes()


class Layout:
    """How fingerprints split in block, slot (together the quotient) and remainder, for about n fingerprints.

    A block of one partition's filter holds a few fingerprints or many. Its occupied slots are stored as gaps from one
    to the next, then the size of each run (unless all are 1), the remainders of the runs, sorted within a run, and
    their counts (unless all are 1): a few bytes a fingerprint, however sparse the block is."""

    def __init__(self, n: int):
        self.quotient_bits = min(FINGERPRINT_BITS - 8, max(4, max(n, 1).bit_length()))
        self.slot_bits = max(0, min(self.quotient_bits - LEAST_BLOCKS, BLOCK_FINGERPRINTS.bit_length() - 1))
        self.remainder_bits = FINGERPRINT_BITS - self.quotient_bits

    def encode(self, prints: np.ndarray, counts: np.ndarray):
        """Blocks (number, bytes) of the filter with these sorted distinct fingerprints."""
        quotient = prints >> self.remainder_bits
        blocks, first = np.unique(quotient >> self.slot_bits, return_index=True)
        for block, a, b in zip(blocks.tolist(), first, [*first[1:], len(prints)]):
            slots, sizes = np.unique(quotient[a:b] & ((1 << self.slot_bits) - 1), return_counts=True)
            gap_width, gaps = _packed(np.diff(slots, prepend=0))
            size_width, runs = _packed(sizes) if len(slots) < b - a else (0, b"")
            rest_width, rests = _packed(prints[a:b] & ((1 << self.remainder_bits) - 1))
            count_width, counters = _packed(counts[a:b]) if counts[a:b].max() > 1 else (0, b"")
            widths = gap_width | size_width << 2 | rest_width << 4 | count_width << 6
            yield block, _HEAD.pack(widths, bool(runs) | bool(counters) << 1, len(slots),
                b - a if runs else 0)[: _HEAD.size if runs else _HEAD_SHORT.size] + gaps + runs + rests + counters

    def decode(self, block: int, body: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The sorted fingerprints of a block and their counts: the k-th run belongs to the k-th occupied slot."""
        widths, has, slots = _HEAD_SHORT.unpack_from(body)
        n, at = (int.from_bytes(body[_HEAD_SHORT.size : _HEAD.size], "little"), _HEAD.size) if has & 1 else (slots, _HEAD_SHORT.size)

        def numbers(place: int, count: int) -> np.ndarray:
            nonlocal at
            kind = np.dtype(_WIDTHS[widths >> place & 3])
            out = np.frombuffer(body, kind, count, at).astype(np.int64)
            at += count * kind.itemsize
            return out

        slot = np.cumsum(numbers(0, slots))
        if has & 1:
            slot = np.repeat(slot, numbers(2, slots))
        rest = numbers(4, n)
        counts = numbers(6, n) if has & 2 else np.ones(n, np.int64)
        return (((np.int64(block) << self.slot_bits) | slot) << self.remainder_bits) | rest, counts


_HEAD, _HEAD_SHORT = struct.Struct("<BBII"), struct.Struct("<BBI")


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted lists of fingerprints as one (the stable sort merges runs that are sorted already); counts of equal ones add."""
    prints, counts = np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(prints, kind="stable")
    prints = prints[order]
    first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1]))
    return prints[first], np.add.reduceat(counts[order], first)


def quotient_filter(digests: DataFrame, layout: Layout) -> DataFrame:
    """The blocks of a counting quotient filter for each partition of the column fingerprint."""

    def build(batches):
        found = [batch.column("fingerprint").to_numpy(zero_copy_only=False) for batch in batches]
        rows = list(layout.encode(*np.unique(np.concatenate(found), return_counts=True))) if sum(map(len, found)) else []
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
            names=["block", "body"])

    return digests.select("fingerprint").mapInArrow(build, "block long, body binary")


def merged(blocks: DataFrame, layout: Layout) -> DataFrame:
    """fingerprint, n of the merged filter. A block holds about BLOCK_FINGERPRINTS fingerprints however many rows there are."""

    def merge(table: pa.Table) -> pa.Table:
        prints, counts = _merged([layout.decode(block, body) for block, body in zip(table["block"].to_pylist(), table["body"].to_pylist())])
        return pa.table({"fingerprint": prints, "n": counts})

    return blocks.groupBy("block").applyInArrow(merge, "fingerprint long, n long")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = only(docs, "doc_id", "text")
    digests = save(rows.mapInArrow(_digests, "doc_id long, fingerprint long, sha binary"), "digests")
    layout = Layout(digests.count())
    repeated = save(merged(quotient_filter(digests, layout), layout).where("n > 1").select("fingerprint"), "repeated")
    count = repeated.count()
    if count <= LISTED:
        routed = rows.mapInArrow(_texts, "doc_id long, fingerprint long, norm string").join(F.broadcast(repeated), "fingerprint", "left_semi")
    else:  # unique texts that share a bit are groups of one, which are left out below
        sent = rows.sparkSession.sparkContext.broadcast(bitmap(repeated, count))
        routed = rows.mapInArrow(_suspected(sent), "doc_id long, fingerprint long, norm string")
    groups = routed.groupBy("fingerprint", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = save(groups.select(F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"), "keep_id", "group_size").where("group_size > 1"),
        "groups")
    discard(repeated)
    return digests.join(small(groups, most=GROUP_ROWS), "sha", "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.coalesce("keep_id", "doc_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """One row of docs of each text, that of the largest doc_id; rows are told apart whatever their ids are."""
    rows = keyed(docs)
    return without(rows, exact_groups(rows.select(F.col("_row").alias("doc_id"), "text")).where("not kept"))
