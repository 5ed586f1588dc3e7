"""Language of code-switched text by a linear-chain conditional random field over words.

A word's features are its character n-grams (1 to 4) between boundary marks, so those that touch a
mark are its affixes, and its entry in a lexicon of frequent words. Weights of features and of
transitions between labels are learned together by the gradient of the sequence likelihood, on runs of
words from labelled documents: half of the runs come from one document, half are spliced from documents
of different languages, so that switching is learned as well. A document's words get their label
probabilities by forward-backward over its whole sequence; the document has the label with the largest
mean probability, which is its score.

The field is a classifier on a bounded sample: at most `max_docs` documents of each language, of each
`max_words` words, and `steps` gradient steps. Scores of a word depend on the word alone, so workers keep
them for words seen before.

Defined results: a null text, or one without a letter, is `und` with score 0. Rows are labelled one by
one, so repeated rows and null ids are kept (null ids: held_out is false). Without any labelled document
everything is `und`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import crc_mod, own_names

TOKEN = re.compile(r"[^\W\d_]+")
N_GRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 18
#: Occurrences in the sample that bring a word into the lexicon.
LEXICON = 5
CACHE = 300_000
#: Words whose sequences are run together.
TOGETHER = 300_000
UNKNOWN = "und"


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return TOKEN.findall(text.lower()) if text else []


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the n-grams of all words, word after word, and where each word begins."""
    marked = [f"\x02{w}\x03" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.repeat(np.cumsum(lengths), lengths)
    place = np.arange(len(codes))
    word = np.repeat(np.arange(len(words)), lengths)
    found, of = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(N_GRAMS) + 1):
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.concatenate([codes[n - 1 :], np.zeros(n - 1, np.uint64)]) + np.uint64(n)
        ok = place + n <= ends
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        found.append((mixed[ok] >> np.uint64(46)).astype(np.int64) % BUCKETS)
        of.append(word[ok])
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return np.concatenate(found)[order], np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(words)))[:-1]]).astype(np.int64)


def forward_backward(local: np.ndarray, step: np.ndarray, start: np.ndarray, lengths: np.ndarray, messages: bool = False):
    """Label probabilities of each word. local: positive label weights of the words, sequence after sequence; step: positive transition weights.

    messages: also what comes to a word from its left with its own weights, and from its right with its own weights, each scaled.

    Sequences run side by side, longest first, so that place t holds those with more than t words.
    """
    order = np.argsort(-lengths, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
    sizes = lengths[order]
    longest = int(sizes[0])
    alive = np.searchsorted(-sizes, -np.arange(longest), side="left")  # sequences with more than t words
    begins = np.concatenate([[0], np.cumsum(alive)])
    at = np.empty(begins[-1], np.int64)
    for t in range(longest):
        at[begins[t] : begins[t + 1]] = offsets[: alive[t]] + t
    b = local[at]
    forward = np.empty_like(b)
    ahead, behind = (np.empty_like(b), np.empty_like(b)) if messages else (None, None)
    a = None
    for t in range(longest):
        n, rows = alive[t], slice(begins[t], begins[t + 1])
        a = (start if t == 0 else a[:n] @ step) * b[rows]
        a = a / a.sum(axis=1, keepdims=True)
        forward[rows] = a
    after = np.ones((alive[-1], b.shape[1]), b.dtype)
    for t in range(longest - 1, -1, -1):
        n, rows = alive[t], slice(begins[t], begins[t + 1])
        if n > len(after):
            after = np.concatenate([after, np.ones((n - len(after), b.shape[1]), b.dtype)])
        p = forward[rows] * after
        if messages:
            ahead[rows], behind[rows] = forward[rows], b[rows] * after
        forward[rows] = p / p.sum(axis=1, keepdims=True)
        after = (b[rows] * after) @ step.T
        after = after / after.sum(axis=1, keepdims=True)
    out = np.empty_like(forward)
    out[at] = forward
    if not messages:
        return out
    left, right = np.empty_like(forward), np.empty_like(forward)
    left[at], right[at] = ahead, behind
    return out, left, right


def positive(scores: np.ndarray) -> np.ndarray:
    if not scores.size:
        return scores
    return np.exp(scores - scores.max(axis=-1, keepdims=True)) + 1e-12


class Field:
    """Learned weights: of the feature buckets and lexicon words by label, of transitions, and of the first label."""

    def __init__(self, labels: list[str], lexicon: dict[str, int]):
        k = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.weights = np.zeros((BUCKETS + len(lexicon), k), np.float32)
        self.step, self.start = np.zeros((k, k)), np.zeros(k)

    def scores(self, words: list[str]) -> np.ndarray:
        found, begins = features(words)
        out = np.add.reduceat(self.weights[found], begins, axis=0)
        for i, w in enumerate(words):
            if (j := self.lexicon.get(w)) is not None:
                out[i] += self.weights[BUCKETS + j]
        return out

    def fit(self, runs: list[tuple[list[str], list[int]]], steps: int, rate: float = 0.3, ridge: float = 1e-5, batch: int = 256, seed: int = 3) -> Field:
        names = sorted({w for r, _ in runs for w in r})
        number = {w: i for i, w in enumerate(names)}
        found, begins = features(names)
        word = np.repeat(np.arange(len(names)), np.diff(np.append(begins, len(found))))
        extra = [(i, BUCKETS + self.lexicon[w]) for w, i in number.items() if w in self.lexicon]
        if extra:
            word, found = np.concatenate([word, [e[0] for e in extra]]), np.concatenate([found, [e[1] for e in extra]])
            order = np.argsort(word, kind="stable")
            word, found = word[order], found[order]
            begins = np.searchsorted(word, np.arange(len(names)))
        k, size, random = len(self.labels), len(self.weights), np.random.default_rng(seed)
        squares = [np.full(x.shape, 1e-3) for x in (self.weights, self.step, self.start)]
        for _ in range(steps):
            some = [runs[i] for i in random.choice(len(runs), min(batch, len(runs)), replace=False)]
            x = np.array([number[w] for r, _ in some for w in r])
            y = np.array([c for _, r in some for c in r])
            lengths = np.array([len(r) for r, _ in some])
            local = positive(np.add.reduceat(self.weights[found], begins, axis=0)[x].astype(np.float64))
            step, start = positive(self.step.ravel()).reshape(k, k), positive(self.start)
            p, ahead, behind = forward_backward(local, step, start, lengths, True)
            error = p.copy()
            error[np.arange(len(y)), y] -= 1
            by_word = np.stack([np.bincount(x, error[:, c], len(names)) for c in range(k)], axis=1)
            g = np.stack([np.bincount(found, by_word[word, c], size) for c in range(k)], axis=1) / len(y)
            first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            inner = np.ones(len(y), bool)
            inner[first] = False
            left, right = np.flatnonzero(inner) - 1, np.flatnonzero(inner)
            # probabilities of the pairs of neighbours
            joint = ahead[left][:, :, None] * step * behind[right][:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            seen = np.bincount(y[left] * k + y[right], minlength=k * k).reshape(k, k)
            g_step = (joint.sum(axis=0) - seen) / len(y)
            g_start = (p[first].sum(axis=0) - np.bincount(y[first], minlength=k)) / len(y)
            for w, d, s in zip((self.weights, self.step, self.start), (g, g_step, g_start), squares):
                d = d + ridge * w
                s += d * d
                w -= (rate * d / np.sqrt(s)).astype(w.dtype)
        return self


class Labeller:
    """Word scores seen before, kept by a worker."""

    def __init__(self, field: Field):
        self.field, k = field, len(field.labels)
        self.step, self.start = positive(field.step.ravel()).reshape(k, k).astype(np.float32), positive(field.start).astype(np.float32)
        self.number: dict[str, int] = {}
        self.local = np.empty((0, k), np.float32)

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [(UNKNOWN, 0.0)] * len(texts)
        words = [(i, tokens(t)) for i, t in enumerate(texts)] if self.field.labels else []
        words = sorted(((i, w) for i, w in words if w and any(c.isalpha() for c in texts[i])), key=lambda x: -len(x[1]))
        some, n = [], 0
        for item in [*words, None]:
            if item is None or (some and n + len(item[1]) > TOGETHER):
                if some:
                    for (i, _), row in zip(some, self._means([w for _, w in some])):
                        c = int(row.argmax())
                        out[i] = (self.field.labels[c], min(1.0, float(row[c])))
                some, n = [], 0
            if item is not None:
                some.append(item)
                n += len(item[1])
        return out

    def _means(self, sequences: list[list[str]]) -> np.ndarray:
        fresh = list({w for s in sequences for w in s} - self.number.keys())
        if fresh:
            if len(self.number) + len(fresh) > CACHE:
                fresh = list({w for s in sequences for w in s})
                self.number, self.local = {}, self.local[:0]
            new = [positive(self.field.scores(fresh[i : i + 20_000])) for i in range(0, len(fresh), 20_000)]
            self.number.update((w, len(self.local) + i) for i, w in enumerate(fresh))
            self.local = np.concatenate([self.local, *new])
        get = self.number.__getitem__
        lengths = np.array([len(s) for s in sequences])
        at = np.fromiter((get(w) for s in sequences for w in s), np.int64, int(lengths.sum()))
        p = forward_backward(self.local[at], self.step, self.start, lengths)
        return np.add.reduceat(p.astype(np.float64), np.concatenate([[0], np.cumsum(lengths)[:-1]]), axis=0) / lengths[:, None]


def training_runs(rows: list[tuple[str, str]], labels: list[str], max_words: int, length: int = 40, seed: int = 5) -> list[tuple[list[str], list[int]]]:
    """Runs of words with their labels: pieces of one document, and as many spliced from several."""
    random = np.random.default_rng(seed)
    docs: list[tuple[int, list[str]]] = [(labels.index(lang), w) for lang, text in rows if (w := tokens(text)[:max_words])]
    by = [[w for c, w in docs if c == k] for k in range(len(labels))]
    plain = [(w[i : i + length], [c] * len(w[i : i + length])) for c, w in docs for i in range(0, len(w), length)]
    spliced = []
    for _ in plain:
        words, own = [], []
        while len(words) < length:
            c = int(random.integers(len(labels)))
            if by[c]:
                w = by[c][int(random.integers(len(by[c])))]
                i, n = int(random.integers(len(w))), int(random.geometric(1 / 10))
                words += w[i : i + n]
                own += [c] * len(w[i : i + n])
        spliced.append((words, own))
    return plain + spliced


def fit(documents: DataFrame, max_docs: int = 250, max_words: int = 300, read_chars: int = 6000, steps: int = 120, max_langs: int = 100) -> Field:
    """Fits on a bounded sample of the documents whose crc32(doc_id) mod 4 is not 2, in the order of a digest of doc_id: at most max_docs rows of a language, of each the first max_words words within the first read_chars characters. Of more than max_langs languages the most frequent are learned (of equal ones, those that come first)."""
    rows = documents.where("doc_id is not null and lang is not null and text is not null").where(crc_mod("doc_id", 4) != 2)
    most = [r["lang"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()]
    rows = rows.where(F.col("lang").isin(most)) if most else rows.limit(0)
    first = lambda d: d.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("key", "doc_id"))).where(F.col("n") <= max_docs)
    picked = first(rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("key"))).select(F.col("doc_id").alias("picked_id")).distinct()
    found = rows.join(F.broadcast(picked), F.col("doc_id") == F.col("picked_id")).select("doc_id", "lang", F.substring("text", 1, read_chars).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    sample = sorted((r["lang"], r["text"]) for r in first(found).select("lang", "text").collect())
    labels = sorted({lang for lang, _ in sample})
    counts = Counter(w for _, t in sample for w in tokens(t)[:max_words])
    field = Field(labels, {w: i for i, w in enumerate(sorted(w for w, n in counts.items() if n >= LEXICON))})
    runs = training_runs(sample, labels, max_words) if labels else []
    return field.fit(runs, steps) if runs else Field([], {})


def label(documents: DataFrame, field: Field) -> DataFrame:
    """The documents' columns, lang_pred and lang_score; columns of those names are replaced."""
    shared = documents.sparkSession.sparkContext.broadcast(field)  # bounded by BUCKETS and the sample

    @F.pandas_udf("lang string, score double")
    def labelled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Labeller(shared.value)
        for texts in batches:
            yield pd.DataFrame([x for i in range(0, len(texts), 1000) for x in own(list(texts[i : i + 1000]))], columns=["lang", "score"])

    (own,) = own_names(documents, "lang_crf")
    rows = documents.withColumn(own, labelled("text"))
    return rows.withColumn("lang_pred", F.col(f"{own}.lang")).withColumn("lang_score", F.col(f"{own}.score")).drop(own)


def label_words(documents: DataFrame, field: Field) -> DataFrame:
    """doc_id, place, word and lang of each word: where a text switches."""
    shared = documents.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = shared.value
        k = len(field.labels)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                if k and (words := tokens(text)):
                    local = positive(field.scores(words).astype(np.float64))
                    p = forward_backward(local, positive(field.step.ravel()).reshape(k, k), positive(field.start), np.array([len(words)]))
                    yield pd.DataFrame({"doc_id": pd.array([doc_id] * len(words), "Int64"), "place": range(len(words)), "word": words, "lang": [field.labels[c] for c in p.argmax(axis=1)]})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, place int, word string, lang string")


def query(documents: DataFrame) -> DataFrame:
    rows = label(documents.select("doc_id", "text"), fit(documents))
    return rows.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
