"""Periodic runs in the words of a text: matches are counted for every lag, and only lags with enough of them are scanned.

A run is a stretch of words with smallest period q and a length of at least 12 and 2q that no neighbour extends. It has
max(q, 12 - q) matches in a row between words q apart, so a lag with fewer matches in the whole text can't have one. The
matches of all lags are counted exactly: words that are frequent in a text by the autocorrelation of their places (FFT),
rare ones by the differences of their places. Lags are scanned from the smallest on. A run of period q explains its matches
at multiples of q, and these are taken off: no run of such a lag shares one (else it had the period q). Long lags are
scanned at every (q / 16)-th word first, since islands of q matches can't lie between, and in full only where those match.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recall_spark.llm.common import only
from recall_spark.llm.textarrays import bytes_of, slices

#: Words of a run at least.
LEAST = 12
#: Points at which an island of matches is looked for before it is scanned in full.
POINTS = 16
_SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def lag_counts(ids: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """For each text the number of equal words at each lag up to half its words; index 0 is unused.

    ids: numbers of the words of all texts in a row; no two texts share one."""
    half = sizes // 2
    begin, at = np.cumsum(sizes) - sizes, np.cumsum(half + 1) - (half + 1)
    total = np.zeros(int((half + 1).sum()), np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(ids, kind="stable")
    new = np.ones(len(ids), bool)
    new[1:] = np.diff(ids[order]) != 0
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(ids)))
    owner = text[order[first]] if len(ids) else np.zeros(0, np.int64)
    heavy = count.astype(np.float64) ** 2 > sizes[owner] * np.log2(sizes[owner] + 2.0)
    # Frequent words: one transform a word, one back a text.
    for t in np.unique(owner[heavy]).tolist():
        n, width = int(sizes[t]), 1 << int(sizes[t] + half[t]).bit_length()
        power = np.zeros(width // 2 + 1)
        for word in np.flatnonzero(heavy & (owner == t)).tolist():
            there = np.zeros(width)
            there[order[first[word] : first[word] + count[word]] - begin[t]] = 1
            wave = np.fft.rfft(there)
            power += wave.real**2 + wave.imag**2
        total[at[t] : at[t] + half[t] + 1] += np.rint(np.fft.irfft(power, width)[: half[t] + 1]).astype(np.int64)
    # Rare words: places k apart in the list of a word's places, for k = 1, 2, ... while any word has so many.
    light = np.repeat(~heavy, count)
    place, after = order[light], (np.repeat(first + count, count) - np.arange(len(ids)) - 1)[light]
    owner, left, k = np.repeat(owner, count)[light], np.arange(int(light.sum())), 0
    pending: list[np.ndarray] = []
    while len(left):
        k += 1
        left = left[after[left] >= k]
        lag = place[left + k] - place[left]
        near = lag <= half[owner[left]]
        left, lag = left[near], lag[near]
        pending.append(at[owner[left]] + lag)
        if not len(left) or sum(map(len, pending)) > len(total):
            total += np.bincount(np.concatenate(pending), minlength=len(total))
            pending = []
    return [total[a : a + h + 1] for a, h in zip(at.tolist(), half.tolist())]


def _islands(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches of at least so many matches."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    a, b = edge[::2], edge[1::2]
    long = b - a >= least
    return a[long], b[long]


def runs_of(ids: np.ndarray, matches: np.ndarray) -> list[tuple[int, int, int]]:
    """start, length, period of all runs of a text, by start, then period."""
    n = len(ids)
    lags = np.arange(len(matches))
    needed = np.maximum(lags, LEAST - lags)
    left = matches.copy()
    found: dict[tuple[int, int], int] = {}
    for q in (np.flatnonzero(matches[1:] >= needed[1:]) + 1).tolist():
        need = int(needed[q])
        if left[q] < need:
            continue
        step = max(1, need // POINTS)
        a, b = _islands(ids[: n - q : step] == ids[q:n:step], need // step)
        if step > 1 and len(a):
            # What a shorter period explains is known; of runs that explain a lag none lies within another.
            known = np.array(sorted((s, s + size) for (s, size), p in found.items() if size > q and q % p == 0), np.int64).reshape(-1, 2)
            if len(known):
                mine = np.searchsorted(known[:, 0], a * step, "right") - 1
                fresh = (mine < 0) | (known[mine, 1] <= (b - 1) * step + q)
                a, b = a[fresh], b[fresh]
            spans = []
            for lo, hi in zip(np.maximum(0, (a - 1) * step + 1).tolist(), np.minimum(n - q, b * step).tolist()):
                u, v = _islands(ids[lo:hi] == ids[lo + q : hi + q], need)
                spans += zip((u + lo).tolist(), (v + lo).tolist())
        else:
            spans = zip(a.tolist(), b.tolist())
        for u, v in spans:
            size = v - u + q
            if (u, size) not in found:
                found[u, size] = q
                times = lags[2 * q : size : q]
                left[times] -= size - times
    return sorted((s, size, p) for (s, size), p in found.items())


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by one space, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, size, period in runs:
        edge[start + period] += 1
        edge[start + size] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist())


def _find(batches):
    for batch in batches:
        doc_ids = batch.column("doc_id")
        for at, texts in slices(batch.column("text"), lower=False):
            data, offsets = bytes_of(texts)
            words, parts, base = [], [], 0
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                own = data[a:b].tobytes().split()  # at space, \t, \n, \v, \f and \r
                number: dict[bytes, int] = {}
                parts.append(np.fromiter((number.setdefault(w, len(number)) for w in own), np.int64, len(own)) + base)
                words.append(own)
                base += len(number)
            sizes = np.array([len(w) for w in words], np.int64)
            runs = [runs_of(p, m) for p, m in zip(parts, lag_counts(np.concatenate(parts), sizes))]
            ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
            flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
            items = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([doc_ids.slice(at, len(texts)), pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends), items),
                pa.array([collapsed(w, r).decode(errors="replace") for w, r in zip(words, runs)], pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed text of each row of docs (doc_id, text).

    Words are compared whole and as they are. A null or blank text has no words, no runs and collapses to nothing. Rows that
    repeat an id, or have none, are rows of their own; other columns of docs don't matter."""
    return only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(_find, _SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (the first of equal ones; nulls where there is none), and hashes of runs and collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines: Column = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    rows = found.withColumn("best", best)
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.length div -best.p").alias("exponent_milli"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
