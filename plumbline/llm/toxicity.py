"""Toxicity by two class-conditional Kneser-Ney bigram models.

One model is fitted on toxic, one on ordinary documents. Both interpolate their bigrams with their own
continuation counts and these with continuation counts of both classes together, so an expression
that is rare or unseen in one class falls back to shared counts and says little; a pair that was seen
once is discounted as a whole. A document's evidence is the difference of the two log-likelihoods,
normalised by length: over the whole text, over the best run of `RUN` words and over the `BEST`
strongest words, since a few insults in a long text vanish in the mean. A logistic map of these
features, fitted on documents that the models in question have not seen, gives the score.

The models are a classifier on a bounded sample of labelled rows: at most `max_docs` documents of each
class and `max_chars` characters of each class, in the order of a digest of doc_id. The share of toxic
labels is counted over all learnable rows. Scoring reads every text as a whole, one by one.

Defined results: a null or empty text, or one without a letter or digit, has zero evidence and gets the
score of that. Rows are scored one by one, so repeated rows and null ids are kept (null ids: held_out is
false). Labels that are null, or whose doc_id is null, are ignored; contradicting labels of one document
both count. With no label of one class the score is the share of toxic labels (0 without any).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import crc_mod, give_back, own_names

TOKEN = re.compile(r"[^\W_]+")
RUN = 10
BEST = 2
STEM, OWN = 4, 3
DISCOUNT = 0.75
FOLDS = 3
N_FEATURES = 5


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


class KneserNey:
    """Counts of both classes as sorted arrays; words of fewer than OWN occurrences count as their stem, id 0 is all else."""

    def __init__(self, docs: list[list[str]], labels: np.ndarray):
        seen: dict[str, int] = {}
        for d in docs:
            for w in d:
                seen[w] = seen.get(w, 0) + 1
        stems: dict[str, int] = {}
        for w, n in seen.items():
            if n < OWN:
                stems[w[:STEM] + "*"] = stems.get(w[:STEM] + "*", 0) + n
        self.ids = {w: i + 1 for i, w in enumerate(sorted([w for w, n in seen.items() if n >= OWN] + [w for w, n in stems.items() if n >= OWN]))}
        self.size = len(self.ids) + 1
        keys = [[], []]
        for d, y in zip(docs, labels):
            x = self._number(d)
            keys[y].append(x[:-1] * self.size + x[1:])
        pairs = [np.unique(np.concatenate(k), return_counts=True) for k in keys]
        self.keys = np.unique(np.concatenate([p[0] for p in pairs]))
        self.counts = np.zeros((2, len(self.keys)))
        self.context, self.spread, self.after = np.zeros((2, self.size)), np.zeros((2, self.size)), np.zeros((2, self.size))
        for y, (k, n) in enumerate(pairs):
            self.counts[y][np.searchsorted(self.keys, k)] = np.where(n > 1, n - DISCOUNT, 0)
            left, right = k // self.size, k % self.size
            self.context[y] = np.bincount(left, n, self.size)
            self.spread[y] = np.bincount(left, np.where(n > 1, DISCOUNT, 1), self.size)
            self.after[y] = np.bincount(right, minlength=self.size)
        again = self.counts.any(axis=0)
        shared = np.bincount(self.keys % self.size, minlength=self.size) + 0.5
        shared /= shared.sum()
        for y in (0, 1):
            n, kinds = self.after[y].sum(), (self.after[y] > 0).sum()
            self.after[y] = (np.maximum(self.after[y] - DISCOUNT, 0) + DISCOUNT * max(kinds, 1) * shared) / max(n, 1)
        self.keys, self.counts = self.keys[again], self.counts[:, again]
        if not len(self.keys):
            self.keys, self.counts = np.array([-1]), np.zeros((2, 1))

    def _number(self, words: list[str]) -> np.ndarray:
        """Ids with the unknown word in front, as the context of the first word."""
        get = self.ids.get
        return np.fromiter((0, *[get(w) or get(w[:STEM] + "*", 0) for w in words]), np.int64, len(words) + 1)

    def evidence(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """log p(word | previous, toxic) - log p(word | previous, ordinary) for each word, and the same without the previous word."""
        x = self._number(words)
        v, w = x[:-1], x[1:]
        key = v * self.size + w
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[at] == key
        p = np.empty((2, len(w)))
        for y in (0, 1):
            n = self.context[y][v]
            p[y] = np.where(n > 0, (np.where(known, self.counts[y][at], 0) + self.spread[y][v] * self.after[y][w]) / np.maximum(n, 1), self.after[y][w])
        return np.log(p[1] / p[0]), np.log(self.after[1][w] / self.after[0][w])

    def features(self, text: str | None) -> tuple[float, ...]:
        words = tokens(text)
        if not words:
            return (0.0,) * N_FEATURES
        pairs, single = self.evidence(words)
        c = np.concatenate(([0.0], np.cumsum(single)))
        runs = (c[RUN:] - c[:-RUN]) / RUN if len(single) >= RUN else (c[-1:] / RUN)
        best = np.partition(single, -BEST)[-BEST:].sum() / BEST if len(single) > BEST else single.sum() / BEST
        return float(pairs.mean()), float(single.mean()), float(runs.max()), float(best), float(np.log1p(len(single)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


class Model:
    def __init__(self, texts: list[str], labels: list[int], share: float):
        self.share, y = share, np.array(labels, int)
        self.lm = None
        if not 0 < y.sum() < len(y):
            return
        docs = [tokens(t) for t in texts]
        fold, x = np.arange(len(y)) % FOLDS, np.zeros((len(y), N_FEATURES))
        for f in range(FOLDS if min(y.sum(), len(y) - y.sum()) >= 2 * FOLDS else 0):
            part = KneserNey([d for d, k in zip(docs, fold) if k != f], y[fold != f])
            for i in np.flatnonzero(fold == f):
                x[i] = part.features(texts[i])
        self.lm = KneserNey(docs, y)
        if not x.any():
            x = np.array([self.lm.features(t) for t in texts])
        self.w = _logistic(x, y)
        # the sample holds the classes in other shares than all labels do
        sampled = y.mean()
        self.w[0] += np.log(share / (1 - share)) - np.log(sampled / (1 - sampled)) if 0 < share < 1 else 0

    def score(self, text: str | None) -> float:
        if self.lm is None:
            return self.share
        z = self.w[0] + float(np.dot(self.w[1:], self.lm.features(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(documents: DataFrame, labels: DataFrame, max_docs: int = 2000, max_chars: int = 12_000_000) -> Model:
    """Fits on a bounded sample of the rows of labels whose crc32(doc_id) mod 5 is not 0: of each class at most max_docs rows and max_chars characters, and no text of more than a tenth of these."""
    rows = labels.where("doc_id is not null and toxic is not null").where(crc_mod("doc_id", 5) != 0).select("doc_id", (F.col("toxic") != 0).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    picked = None
    for y in (0, 1):
        some = rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
        picked = some if picked is None else picked.union(some)
    texts = documents.where("text is not null").select(F.col("doc_id").alias("id"), "text").where(F.length("text") <= max_chars // 10)
    found = texts.join(F.broadcast(picked.distinct()), F.col("id") == F.col("doc_id")).select("text", "y", F.xxhash64("id").alias("key"), "id", F.length("text").alias("n"))
    order = W.partitionBy("y").orderBy("key", "id", F.xxhash64("text"), "n")
    # rows that share a doc_id count one by one, so what comes to the driver is bounded
    found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= max_docs).withColumn("upto", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).where(F.col("upto") <= max_chars)
    sample = found.select("text", "y", "place").orderBy("y", "place").collect()
    return Model([r["text"] for r in sample], [r["y"] for r in sample], share)


def score(documents: DataFrame, model: Model, column: str = "toxic_score") -> DataFrame:
    """The documents' columns and toxic_score, or whatever column is called; one of that name is replaced."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the sample's

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype="float64")
        give_back()

    return documents.withColumn(column, scored("text"))


def without_toxic(documents: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The documents that score below the limit, with their columns as they were."""
    (column,) = own_names(documents, "toxic_score")
    return score(documents, model, column).where(F.col(column) < limit).drop(column)


def query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    rows = score(documents.select("doc_id", "text"), fit(documents, labels))
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), F.col("toxic_score").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
