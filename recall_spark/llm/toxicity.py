"""Toxicity by multiple-instance learning.

A document is a bag of sentences; only the bag is labelled. A sentence has the score sigmoid(b + sum of w over
its features), and a document is toxic if any sentence is: its score is the noisy-or, one less the product of
(1 - sentence score). Weights are found by descending the likelihood of the document labels through the
noisy-or, which then tells the offending sentences apart. Features are words and their beginnings of 3 to 8
bytes, so that inflected forms share evidence.

At most TRAIN_DOCS labelled rows, those whose hash of id and text is lowest, are learned from. Features are counted there
by document, and those that speak for toxicity are kept (FEATURES at most).

Null and empty texts score as documents without a sentence: 0. One row per input row; null labels are not
learned from, two labels of one document count as toxic if either is; null ids and extra columns do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall_spark.llm import textarrays as ta
from recall_spark.llm.common import discard, lowest, only, remainder, save, share

TRAIN_DOCS = 12_000
FEATURES = 400
LEAST_LIFT = 4.0
BEGINNINGS = range(3, 9)
_FILTER_BITS = 22

_WORD = np.zeros(256, bool)
_WORD[128:] = True
_WORD[[*range(48, 58), *range(97, 123)]] = True
_END = np.zeros(256, bool)
_END[[10, 33, 46, 63]] = True


def features(texts: pa.Array):
    """Per word: document, sentence and its row of feature hashes (0: none); the data and offsets they come from."""
    data, offsets = ta.bytes_of(texts)
    inside = _WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[ends] = inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = end - start
    doc = np.searchsorted(offsets, start, "right") - 1
    # A sentence ends at each mark and at the end of its document.
    stops = np.flatnonzero(_END[data])
    sentence = np.searchsorted(stops, start) + doc
    hashes = np.zeros((len(start), len(BEGINNINGS) + 1), np.uint64)
    h, padded = np.zeros(len(start), np.uint64), np.concatenate([data, np.zeros(8, np.uint8)])
    for j in range(8):
        more = size > j
        h += np.where(more, ta.byte_terms(padded[start + j], j), np.uint64(0))
        if j + 1 in BEGINNINGS:
            hashes[:, j + 1 - BEGINNINGS[0]] = np.where(more, ta.mix(h + np.uint64(j + 1)), np.uint64(0))
    longer = np.flatnonzero(size > 8)
    h[longer] = ta.run_sums(data, start[longer], size[longer])
    hashes[:, -1] = ta.mix(h + size.astype(np.uint64) + np.uint64(1000))
    return doc, sentence, hashes, data, offsets


class Lookup:
    """Numbers for a bounded set of feature hashes."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(np.asarray(hashes, np.uint64))
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[(self.hashes & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of hashes that hold known features, and their numbers."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row, column = np.nonzero(self.seen[(hashes & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
        values = hashes[row, column]
        at = np.minimum(np.searchsorted(self.hashes, values), len(self.hashes) - 1)
        ok = self.hashes[at] == values
        return row[ok], at[ok]


class NoisyOr:
    """The learned sentence model."""

    def __init__(self, lookup: Lookup, weights: np.ndarray, bias: float):
        self.lookup, self.weights, self.bias = lookup, weights, bias

    def sentences(self, texts: pa.Array):
        """Sentence numbers, their documents and logits, the first word's and last word's number; words' features."""
        doc, sentence, hashes, data, offsets = features(texts)
        numbers, first = np.unique(sentence, return_index=True)
        logits = np.full(len(numbers), self.bias)
        row, feature = self.lookup.find(hashes)
        if len(row):
            pairs = np.unique(np.stack([np.searchsorted(numbers, sentence[row]), feature]), axis=1)
            np.add.at(logits, pairs[0], self.weights[pairs[1]])
        return numbers, doc[first], logits, data, offsets

    def score(self, texts: pa.Array) -> np.ndarray:
        _, doc, logits, _, _ = self.sentences(texts)
        return -np.expm1(-np.bincount(doc, np.logaddexp(0, logits), len(texts)))


def _counted(batches):
    """Documents with each feature, by label, counted within the partition."""
    for batch in batches:
        texts, toxic = batch.column("text"), batch.column("toxic").to_numpy(zero_copy_only=False)
        found = {0: [], 1: []}
        for at, part in ta.slices(texts):
            doc, _, hashes, _, _ = features(part)
            ends = np.searchsorted(doc, np.arange(len(part) + 1))
            for k in range(len(part)):
                found[int(toxic[at + k])].append(np.unique(hashes[ends[k] : ends[k + 1]]))
        for label, sets in found.items():
            if sets:
                values, n = np.unique(np.concatenate(sets), return_counts=True)
                values, n = values[values != 0], n[values != 0]
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(np.full(len(n), label, np.int32)),
                    pa.array(n, pa.int64())], names=["feature", "toxic", "n"])


def _hits(sent):
    def run(batches):
        lookup = sent.value
        for batch in batches:
            texts, toxic = batch.column("text"), batch.column("toxic").to_pylist()
            for at, part in ta.slices(texts):
                doc, sentence, hashes, _, _ = features(part)
                row, feature = lookup.find(hashes)
                count = np.bincount(doc[np.unique(sentence, return_index=True)[1]], minlength=len(part))
                where = doc[row]
                bags = [np.unique(np.stack([sentence[row[where == k]], feature[where == k]]), axis=1) for k in range(len(part))]
                yield pa.RecordBatch.from_arrays([pa.array(toxic[at : at + len(part)], pa.int32()), pa.array(count, pa.int64()),
                    pa.array([b[0].tolist() for b in bags], pa.list_(pa.int64())), pa.array([b[1].tolist() for b in bags], pa.list_(pa.int64()))],
                    names=["toxic", "n_sentences", "sentence", "feature"])

    return run


def _descend(rows: list, n_features: int, rounds: int = 400, rate: float = 0.1, shrink: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that make the labels likely under the noisy-or (Adam on the whole sample)."""
    y = np.array([r["toxic"] for r in rows], float)
    bag, key, feature = [], [], []
    n = 0
    for i, r in enumerate(rows):
        numbers = {s: n + j for j, s in enumerate(dict.fromkeys(r["sentence"]))}
        bag += [i] * len(numbers)
        key += [numbers[s] for s in r["sentence"]]
        feature += r["feature"]
        n += len(numbers)
    bag, key, feature = np.array(bag, int), np.array(key, int), np.array(feature, int)
    plain = np.array([r["n_sentences"] for r in rows], float) - np.bincount(bag, minlength=len(rows))
    w = np.zeros(n_features + 1)
    w[-1] = -5.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = w[-1] + np.bincount(key, w[feature], n)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-w[-1]))
        total = np.bincount(bag, np.logaddexp(0, z), len(rows)) + plain * np.logaddexp(0, w[-1])
        pull = np.where(y == 1, -1 / np.expm1(np.clip(total, 1e-9, 500)), 1.0) / len(rows)
        dz = p * pull[bag]
        g = np.append(np.bincount(feature, dz[key], n_features), dz.sum() + (p0 * pull * plain).sum())
        g[:-1] += shrink * w[:-1] / max(1, n_features)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-12)
    return w[:-1], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> NoisyOr:
    """The sentence model from the labels (doc_id, toxic) of documents; labels are those to learn from only.

    train_docs labelled rows are learned from at most; rows that repeat an id and its text count once."""
    marks = only(labels, "doc_id",
        "toxic").where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = marks.count()
    drawn = F.broadcast(marks.where(share("doc_id", 4 * train_docs, n)))  # at most about 4 * train_docs ids
    labelled = only(docs, "doc_id", "text").join(drawn, "doc_id").withColumn("h", F.xxhash64("doc_id", "text", F.lit(17)))
    hashes = save(labelled.select("h"), "sample-hashes")
    least = lowest(hashes, train_docs)
    discard(hashes)
    sample = save(labelled.where(F.col("h") <= least).dropDuplicates(["h"]).select("text", "toxic"), "toxic-sample")
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    lookup = Lookup(np.zeros(0, np.uint64))
    if bad:
        counts = sample.mapInArrow(_counted,
            "feature long, toxic int, n long").groupBy("feature").agg(F.sum(F.col("n") * F.col("toxic")).alias("bad"),
            F.sum(F.col("n") * (1 - F.col("toxic"))).alias("good"))
        share_bad, share_good = (F.col("bad") + 0.5) / (bad + 1), (F.col("good") + 0.5) / (good + 1)
        chosen = counts.where((F.col("bad") >= max(2, bad // 200)) & (share_bad >= LEAST_LIFT * share_good)).orderBy((share_bad - share_good).desc(),
            "feature").limit(FEATURES)
        lookup = Lookup(np.array([r["feature"] for r in chosen.collect()], np.int64).view(np.uint64))
    rows = sample.mapInArrow(_hits(docs.sparkSession.sparkContext.broadcast(lookup)),
        "toxic int, n_sentences long, sentence array<long>, feature array<long>").collect()
    discard(sample)
    if not rows:
        return NoisyOr(lookup, np.zeros(0), -20.0)
    return NoisyOr(lookup, *_descend(rows, len(lookup.hashes)))


def _scored(sent):
    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            scores = [sent.value.score(part) for _, part in ta.slices(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()),
                pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["doc_id", "score"])

    return run


def _located(sent, least: float):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for at, part in ta.slices(texts):
                doc, begin, end, score = _places(*sent.value.sentences(part), least)
                yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()).take(pa.array(doc + at)), pa.array(begin),
                    pa.array(end), pa.array(score)], names=["doc_id", "begin", "end", "score"])

    return run


def _places(numbers, doc, logits, data, offsets, least: float):
    """Document, begin, end (code points) and score of each sentence with such a score at least."""
    score = 1 / (1 + np.exp(-logits))
    bad = np.flatnonzero(score >= least)
    stops = np.flatnonzero(_END[data])
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    gap = numbers[bad] - doc[bad]  # marks before the sentence
    begin = np.maximum(offsets[doc[bad]], np.where(gap > 0, np.append(stops, 0)[gap - 1] + 1, 0))
    end = np.minimum(offsets[doc[bad] + 1], np.append(stops, len(data))[gap])
    base = points[offsets[doc[bad]]]
    return doc[bad], points[begin] - base, points[end] - base, score[bad]


def _marked(sent, least: float):
    """Scores and places of one pass."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id").cast(pa.int64()), batch.column("text")
            for at, part in ta.slices(texts):
                found = sent.value.sentences(part)
                scores = -np.expm1(-np.bincount(found[1], np.logaddexp(0, found[2]), len(part)))
                doc, begin, end, own = _places(*found, least)
                spans = pa.StructArray.from_arrays([pa.array(begin), pa.array(end), pa.array(own)], names=["begin", "end", "score"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(part) + 1)).astype(np.int32)), spans)
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(part)), pa.array(scores), lists], names=["doc_id", "score", "offending"])

    return run


def marked(docs: DataFrame, model: NoisyOr, least: float = 0.5) -> DataFrame:
    """doc_id, score, offending: the sentences (begin, end, score; in order) that make a document toxic, as offending() has them."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return only(docs, "doc_id", "text").mapInArrow(_marked(sent, least), "doc_id long, score double, offending array<struct<begin:long,end:long,score:double>>")


def score(docs: DataFrame, model: NoisyOr) -> DataFrame:
    """doc_id, score of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return only(docs, "doc_id", "text").mapInArrow(_scored(sent), "doc_id long, score double")


def offending(docs: DataFrame, model: NoisyOr, least: float = 0.5) -> DataFrame:
    """doc_id, begin, end (code points, end exclusive, without the mark that ends it), score of each toxic sentence."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return only(docs, "doc_id", "text").mapInArrow(_located(sent, least), "doc_id long, begin long, end long, score double")


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted; rows whose crc32 modulo 3 is 1 are held out."""
    return located(docs, labels, least).drop("offending")


def located(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """What classify() gives, with the offending sentences of each document."""
    model = learn(docs, labels.where(remainder("doc_id", 3) != 1))
    return marked(docs, model).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score",
        (F.col("score") >= least).cast("int").alias("predicted"), "offending")
