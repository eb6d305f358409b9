"""Word and shingle hashes of many texts at once, as numpy arrays over Arrow's buffers.

Texts are lower-cased (A-Z only); words are runs of bytes other than space and \\t \\n \\v \\f \\r.
Hashes have 64 bits, so that unequal words or shingles practically never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, 1 << 16, dtype=np.uint64) | np.uint64(1)
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads each bit over all 64 (the finaliser of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def plain(column) -> pa.Array:
    """Arrow texts, null as empty, in buffers of their own that begin with the first text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return column.take(pa.array(np.arange(len(column), dtype=np.int64)))


def normalised(column) -> pa.Array:
    """Arrow texts, null as empty, A-Z in lower case."""
    return pc.ascii_lower(plain(column))


def slices(texts, lower: bool = True, size: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive parts of about size bytes of a column, normalised, each with the index of its first text.

    Only one part at a time is copied, however large the batch is."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    n, at = len(texts), 0
    while at < n:
        before = int(ends[at - 1]) if at else 0
        to = min(n, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
        part = texts.slice(at, to - at)
        yield at, normalised(part) if lower else plain(part)
        at = to


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in a row, and where each text begins, with the total at the end."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, first byte and end of each word, and the number of words in each text."""
    data, offsets = bytes_of(texts)
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = inside[begins]
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[ends] = inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return data, start, end, np.diff(np.searchsorted(start, offsets))


def byte_terms(values: np.ndarray, places: np.ndarray | int) -> np.ndarray:
    """What bytes add to the hash of their run at these places, of which no two are alike, however long a run is."""
    if isinstance(places, int):
        return _BYTE[values] * _PLACE[places]
    if not len(places) or places.max() < len(_PLACE):
        return _BYTE[values] * _PLACE[places]
    factors = _PLACE[np.minimum(places, len(_PLACE) - 1)]
    far = np.flatnonzero(places >= len(_PLACE))
    factors[far] = mix(places[far].astype(np.uint64)) | np.uint64(1)
    return _BYTE[values] * factors


def run_sums(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The sum of byte_terms() over all bytes of each run; runs are not empty."""
    if not len(start):
        return np.zeros(0, np.uint64)
    within = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(within, size)
    return np.add.reduceat(byte_terms(data[place + np.repeat(start, size)], place), within)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and the number of words in each text."""
    data, start, end, counts = word_spans(texts)
    if not len(start):
        return np.zeros(0, np.uint64), counts
    size = end - start
    return mix(run_sums(data, start, size) + size.astype(np.uint64)), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each run of width words, and the number of runs in each text; fewer words are one run."""
    runs = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    if not len(words):
        return np.zeros(0, np.uint64), runs
    begin = np.cumsum(counts) - counts
    at = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(begin, runs)
    sizes = np.repeat(np.minimum(counts, width), runs)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    total = sizes.astype(np.uint64) * _STEP[63]
    for j in range(width):
        part = padded[at + j] * _STEP[j]
        total += part if sizes.min(initial=width) > j else np.where(sizes > j, part, np.uint64(0))
    return mix(total), runs


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles."""
    hashes, runs = shingle_hashes(*word_hashes(texts), width)
    ends = np.cumsum(runs)
    for a, b in zip(ends - runs, ends):
        yield np.unique(hashes[a:b])


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for two sorted sets; empty sets are like nothing."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    common = int(np.count_nonzero(b[at] == a))
    return 100 * common >= percent * (len(a) + len(b) - common)
