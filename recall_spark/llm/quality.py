"""Quality by positive-unlabelled learning.

Trusted positives (labels.quality = 1) and unlabelled web text train a scorer; no document is taken as bad. With
the class prior p, the risk is p E_pos[l(g)] + max(0, E_unl[l(-g)] - p E_pos[l(-g)]): the second part stands for
the unseen negatives and must not fall below zero (the non-negative estimator), else it is ascended. l is the
logistic loss, so that sigmoid(g) is a posterior. The prior is estimated from the two samples alone: no set of
texts can hold fewer unlabelled than p times its share of positives, and the best bin of a held-back half's
scores comes close to that bound.

A text is described by shares and rates of characters, words and lines, each cut at quantiles of the sample, and
g is a sum of one weight for each bin. At most TRAIN_DOCS positives and as many unlabelled documents, drawn by a
hash of their id, are learned from.

Null and empty texts have all features 0 and are scored by them. Without a positive every score is 0.5. One row
per input row; null ids and extra columns do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recall_spark.llm import textarrays as ta
from recall_spark.llm.common import discard, lowest, only, remainder, save, share

TRAIN_DOCS = 10_000
#: Where features are cut; a value at a cut falls below it, so that none (0) and a little are told apart.
QUANTILES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.94, 0.97, 0.99)
NAMES = ("log words", "word length", "upper case", "exclamation", "bar", "marks", "stops", "digits", "doubled marks", "next word equal",
    "next two equal", "distinct words", "capital words", "lines a word")


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _class("abcdefghijklmnopqrstuvwxyz")
_LETTER[128:] = True
_DIGIT, _BANG, _BAR, _STOP, _LINE = _class("0123456789"), _class("!"), _class("|"), _class(".,;:?"), _class("\n")
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK &= ~(_LETTER | _DIGIT | _STOP | _BANG | _BAR)
_ANY_MARK = _MARK | _BANG | _BAR | _STOP


def describe(texts: pa.Array) -> np.ndarray:
    """A row of features for each text; texts keep their case."""
    data, offsets = ta.bytes_of(texts)
    n = np.diff(offsets)
    _, start, end, counts = ta.word_spans(texts)

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    def per_word(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        ends = np.cumsum(counts)
        return (total[ends] - total[ends - counts]).astype(float)

    words, _ = ta.word_hashes(texts)
    first_of_text = np.zeros(len(words) + 1, bool)
    first_of_text[np.cumsum(counts) - counts] = True
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & ~first_of_text[1 : len(words)]
    thrice = again.copy()
    thrice[1:] &= again[:-1]
    ends = np.cumsum(counts)
    distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(ends - counts, ends)], float)
    doubled = np.zeros(len(data), bool)
    doubled[1:] = (data[1:] == data[:-1]) & _ANY_MARK[data[1:]]
    letters, size, total = np.maximum(per_text(_LETTER[data]), 1), np.maximum(n, 1), np.maximum(counts, 1)
    capital = _UPPER[data[start]] & _UPPER[data[np.minimum(start + 1, end - 1)]] & (end - start > 1) if len(start) else np.zeros(0, bool)
    return np.stack([
        np.log1p(counts), per_word(end - start) / total, per_text(_UPPER[data]) / letters, per_text(_BANG[data]) / size, per_text(_BAR[data]) / size,
        per_text(_MARK[data]) / size, per_text(_STOP[data]) / size, per_text(_DIGIT[data]) / size, per_text(doubled) / size, per_word(again) / total,
            per_word(thrice) / total,
        distinct / total, per_word(capital) / total, per_text(_LINE[data]) / total,
    ], axis=1)


class Scorer:
    """Cuts of the features and a weight for each bin."""

    def __init__(self, sample: np.ndarray):
        self.cuts = [np.unique(np.quantile(column, QUANTILES)) for column in sample.T]
        self.first = np.cumsum([0, *(len(c) + 1 for c in self.cuts)])
        self.weights, self.bias, self.prior = np.zeros(self.first[-1]), 0.0, float("nan")

    def bins(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x, "left") + at for c, x, at in zip(self.cuts, rows.T, self.first)], axis=1)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        return self.weights[bins].sum(axis=1) + self.bias

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.2, shrink: float = 1e-5) -> None:
        """Adam on the non-negative risk."""
        w, n = np.append(self.weights, self.bias), self.first[-1]
        m, v = np.zeros_like(w), np.zeros_like(w)

        def slope(bins: np.ndarray, each: np.ndarray) -> np.ndarray:
            return np.append(np.bincount(bins.ravel(), np.repeat(each, bins.shape[1]), n), each.sum()) / len(bins)

        for t in range(1, rounds + 1):
            gp, gu = w[positive].sum(axis=1) + w[-1], w[unlabelled].sum(axis=1) + w[-1]
            rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            of_rest = slope(unlabelled, 1 / (1 + np.exp(-gu))) - prior * slope(positive, 1 / (1 + np.exp(-gp)))
            g = -of_rest if rest < 0 else of_rest - prior * slope(positive, 1 / (1 + np.exp(gp)))
            g[:-1] += shrink * w[:-1]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-12)
        self.weights, self.bias = w[:-1], float(w[-1])

    def score(self, texts: pa.Array) -> np.ndarray:
        if np.isnan(self.prior):
            return np.full(len(texts), 0.5)
        return 1 / (1 + np.exp(-self.raw(self.bins(describe(texts)))))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, least_share: float = 0.5) -> float:
    """The smallest ratio of unlabelled to positive shares above a score, over cuts that hold enough positives."""
    cuts = np.quantile(positive, np.linspace(0, 1 - least_share, 60))
    p = 1 - np.searchsorted(np.sort(positive), cuts, "left") / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts, "left") / len(unlabelled)
    return float(np.clip((u / p).min(), 0.01, 0.99))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Scorer:
    """A scorer from the features of positives and of unlabelled texts."""
    scorer = Scorer(np.concatenate([positive, unlabelled]))
    bp, bu = scorer.bins(positive), scorer.bins(unlabelled)
    if prior is None:
        ranking = Scorer(np.concatenate([positive, unlabelled]))
        ranking.fit(bp[::2], bu[::2], 0.5)
        prior = estimated_prior(ranking.raw(bp[1::2]), ranking.raw(bu[1::2])) if len(bp) > 1 and len(bu) > 1 else 0.5
    scorer.fit(bp, bu, prior)
    scorer.prior = prior
    return scorer


def _described(batches):
    for batch in batches:
        rows = [describe(part) for _, part in ta.slices(batch.column("text"), lower=False)]
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column("positive"), batch.column("h"),
                pa.array(np.concatenate(rows).tolist(), pa.list_(pa.float64()))], names=["positive", "h", "features"])


def learn(docs: DataFrame, labels: DataFrame, usable, train_docs: int = TRAIN_DOCS, prior: float | None = None) -> Scorer:
    """A scorer from labels (doc_id, quality = 1) and the text of documents, of the rows where usable holds.

    train_docs rows with such a label and as many of all rows are learned from at most: those whose hash of id and text is
    lowest. Rows that repeat an id and its text count once, those that have no id are told apart by their texts."""
    trusted = only(labels, "doc_id",
        "quality").where("quality = 1 and doc_id is not null").where(usable).select(F.col("doc_id").alias("id")).distinct()
    n_trusted = trusted.count()
    rows = only(docs, "doc_id", "text").where(usable)
    n_rows = rows.select("doc_id").count()
    if not n_trusted or not n_rows:
        return Scorer(np.zeros((1, len(NAMES))))
    drawn = F.broadcast(trusted.where(share("id", 4 * train_docs, n_trusted)))  # at most about 4 * train_docs ids
    h, web_h = F.xxhash64("doc_id", "text", F.lit(17)), F.xxhash64("doc_id", "text", F.lit(23))
    both = rows.join(drawn, rows["doc_id"] == F.col("id"), "left").withColumns({"h": F.when(F.col("id").isNotNull(), h), "web_h": web_h})
    some = F.lit(True) if 4 * train_docs >= n_rows else F.col("web_h") < F.lit((1 << 64) * 4 * train_docs // n_rows - (1 << 63))
    hashes = save(both.select("h", F.when(some, F.col("web_h")).alias("web_h")).where("h is not null or web_h is not null"), "sample-hashes")
    least, web_least = lowest(hashes, train_docs), lowest(hashes.select(F.col("web_h").alias("h")), train_docs)
    discard(hashes)
    use = both.select("text", F.explode(F.array_compact(F.array(F.when(F.col("h") <= least, F.struct(F.lit(1).alias("positive"), "h")),
        F.when(some & (F.col("web_h") <= web_least), F.struct(F.lit(0).alias("positive"), F.col("web_h").alias("h")))))).alias("use"))
    described = use.select("text", "use.positive", "use.h").mapInArrow(_described, "positive int, h long, features array<double>")
    found = described.dropDuplicates(["positive", "h"]).collect()  # 2 * train_docs rows at most
    positive = np.array([r["features"] for r in found if r["positive"] == 1])
    unlabelled = np.array([r["features"] for r in found if r["positive"] == 0])
    if not len(positive) or not len(unlabelled):
        return Scorer(np.zeros((1, len(NAMES))))
    return train(positive[np.lexsort(positive.T)], unlabelled[np.lexsort(unlabelled.T)], prior)


def _scored(sent):
    def run(batches):
        for batch in batches:
            scores = [sent.value.score(part) for _, part in ta.slices(batch.column("text"), lower=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()),
                pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, score of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)
    return only(docs, "doc_id", "text").mapInArrow(_scored(sent), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted; rows whose crc32 modulo 5 is 0 are held out."""
    scorer = learn(docs, labels, remainder("doc_id", 5) != 0)
    return score(docs, scorer).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= least).cast("int").alias("predicted"))
