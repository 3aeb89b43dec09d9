"""Operator 1: a quality classifier by Bradley-Terry pairwise ranking.

Labelled documents make preference pairs (one of quality 1 is preferred over one of quality 0). A document's
score is linear in its features; the chance that it is preferred is the logistic function of the difference
of scores, so fitting is logistic regression without intercept on feature differences. Documents at or above
a quantile of the scores of *all* labelled preferred documents are kept.

Only the fit uses a bounded sample: at most ``max_labelled`` labelled documents, the smallest by hash in each
class, and all pairs of them; the loss, its gradient and its curvature over all pairs come from matrix products over
blocks, so no pair is held. The threshold counts every labelled document; every document is scored on its whole text,
however long.

Defined results: a document without words (NULL, empty or blank) has no score and is rejected. A document
labelled more than once counts by its lowest label; NULL labels are ignored, labels without a document too.
Without both classes the weights are 0 and every document with words is kept. Ties with the threshold are
kept. Repeated rows are scored alike. Ids of any type will do. An empty table gives no rows. Further columns pass
through ``keep_good`` untouched, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import quoted, table, unused
from graphloom.llm.tokens import Slice, slices
from graphloom.storage import materialise

MAX_LABELLED = 20_000
QUANTILE = 0.0005

#: Classes of bytes whose shares are features; what is in none of them (mostly lower-case letters) is class 0.
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".", b",;:", b"!", b"?", b"|", b"*#", b"$%&", b"'\"()[]{}<>/\\-_=+~^`@", bytes(range(0x80, 0xC0)), bytes(range(0xC0, 0x100))]
_CLASS = np.zeros(256, np.int64)
for _k, _bytes in enumerate(_CLASSES):
    _CLASS[list(_bytes)] = _k + 1
N_CLASSES = len(_CLASSES) + 1
N_FEATURES = N_CLASSES + 4


def features(s: Slice) -> np.ndarray:
    """A row for each document: shares of byte classes, log of words, word length, repeats next to each other, share of distinct words."""
    size = np.diff(s.offsets)
    counts = np.bincount(np.repeat(np.arange(s.docs), size) * N_CLASSES + _CLASS[s.buf], minlength=s.docs * N_CLASSES).reshape(s.docs, N_CLASSES)
    out = np.zeros((s.docs, N_FEATURES))
    out[:, :N_CLASSES] = counts / np.maximum(size, 1)[:, None]
    words = np.bincount(s.doc, minlength=s.docs)
    per = np.maximum(words, 1)
    out[:, N_CLASSES] = np.log1p(words)
    out[:, N_CLASSES + 1] = np.bincount(s.doc, weights=s.ends - s.starts, minlength=s.docs) / per
    again = (s.hashes[1:] == s.hashes[:-1]) & (s.doc[1:] == s.doc[:-1])
    out[:, N_CLASSES + 2] = np.bincount(s.doc[1:][again], minlength=s.docs) / per
    order = np.lexsort((s.hashes, s.doc))
    h, d = s.hashes[order], s.doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    out[:, N_CLASSES + 3] = np.bincount(d[new], minlength=s.docs) / per
    out[words == 0] = np.nan
    return out


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights


def fit(good: np.ndarray, bad: np.ndarray, ridge: float = 1e-3, steps: int = 50, block: int = 512) -> Ranker:
    """Newton's method on the mean logistic loss of preferred-minus-other feature differences, with a ridge.

    With p[i, j] the chance that the model gives to the wrong order of pair (i, j), gradient and curvature are sums over
    rows and columns of p and p * (1 - p), and products of these with the features.
    """
    both = np.concatenate([good, bad]).reshape(-1, N_FEATURES)
    if not len(both):
        return Ranker(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES))
    mean, scale = both.mean(0), both.std(0)
    scale[scale < 1e-12] = 1.0
    w = np.zeros(N_FEATURES)
    if not len(good) or not len(bad):
        return Ranker(mean, scale, w)
    x, y, n = (good - mean) / scale, (bad - mean) / scale, len(good) * len(bad)
    for _ in range(steps):
        sx, sy = np.clip(x @ w, -250, 250), np.clip(y @ w, -250, 250)
        gradient, curvature, columns, by_column = np.zeros(N_FEATURES), np.zeros((N_FEATURES, N_FEATURES)), np.zeros(len(y)), np.zeros(len(y))
        for at in range(0, len(x), block):
            part = x[at : at + block]
            p = 1 / (1 + np.exp(sx[at : at + block, None] - sy[None, :]))
            gradient += p.sum(1) @ part
            columns += p.sum(0)
            p *= 1 - p
            mixed = part.T @ (p @ y)
            curvature += (part * p.sum(1)[:, None]).T @ part - mixed - mixed.T
            by_column += p.sum(0)
        gradient -= columns @ y
        curvature += (y * by_column[:, None]).T @ y
        step = np.linalg.solve(curvature / n + ridge * np.eye(N_FEATURES), gradient / n - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return Ranker(mean, scale, w)


def feature_column(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def extract(text: pa.Array) -> pa.Array:
        rows = [features(s) for s in slices(text)]
        flat = np.concatenate(rows) if rows else np.zeros((0, N_FEATURES))
        return pa.ListArray.from_arrays(np.arange(0, flat.size + 1, N_FEATURES, dtype=np.int32), pa.array(flat.ravel()))

    return extract(text)


def clean_labels(labels: DataFrame) -> DataFrame:
    return labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") > 0).alias("preferred"))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Ranker:
    """Fits on at most max_labelled documents; that bound holds what is broadcast and what is collected."""
    known = clean_labels(labels)
    parts = [known.filter(F.col("preferred") == good).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled // 2) for good in (True, False)]
    sample = parts[0].unionByName(parts[1])
    seen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("preferred", feature_column(F.col("text")).alias("x")).toPandas()
    x = np.array(seen["x"].tolist(), dtype=float).reshape(-1, N_FEATURES)
    whole = ~np.isnan(x).any(axis=1)
    preferred = seen["preferred"].to_numpy(bool)
    # in a fixed order, so that the pairs don't depend on how tasks ran
    good, bad = (part[np.lexsort(part.T)] for part in (x[whole & preferred], x[whole & ~preferred]))
    return fit(good, bad)


def score_column(ranker: Ranker, text: Column) -> Column:
    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        rows = [ranker.score(features(s)) for s in slices(text)]
        return pa.array(np.concatenate(rows) if rows else np.zeros(0), from_pandas=True)

    return score(text)


def threshold(scores: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> float:
    """The quantile of the scores of all labelled preferred documents; -inf if there is none.

    A sketch of fixed size goes to the driver. Its error is 1/50000 of the rank range.
    """
    rated = scores.select("doc_id", "score").join(clean_labels(labels).filter("preferred"), "doc_id")
    found = rated.agg(F.percentile_approx("score", F.lit(quantile), F.lit(50_000)).alias("q")).first()["q"]
    return -np.inf if found is None else found


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The rows of docs whose score reaches the threshold, all their columns as they were.

    Texts are never shuffled: they are scored once for the threshold (ids and scores are kept of that pass),
    and once more, within the scan, to filter.
    """
    ranker = train(docs, labels)
    scores = docs.select("doc_id", score_column(ranker, F.col("text")).alias("score"))
    least = threshold(scores, labels, quantile)
    (name,) = unused(docs, "_score")
    return docs.withColumn(name, score_column(ranker, F.col("text"))).filter(quoted(name) >= F.lit(float(least))).drop(name)


def op1_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and score of the documents that are kept."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ranker = train(docs, labels)
    scores = materialise(docs.select("doc_id", score_column(ranker, F.col("text")).alias("score")), "quality-scores")
    return scores.filter(F.col("score") >= F.lit(float(threshold(scores, labels))))
