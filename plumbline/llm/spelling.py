"""Spelling variants by a bidirectional FM-index and search schemes with one error.

Two words are near if one inserted, deleted or replaced character makes one of the other. Then either
the first half of the shorter one is a prefix of both, or the rest is a suffix of both. So words are dealt
to shards by (length of the shorter one, half that must agree); a word takes part as the shorter and as the
longer one. Each shard joins its words by delimiters, builds the index of that text and of its reverse, and
searches its words by two schemes: the delimited first half is matched exactly and extended to the right
with one error up to the closing delimiter; the delimited second half is matched exactly and extended to
the left. A step narrows the intervals of suffix ranks in both indexes at once, for all words of a shard together.
The place of the error, taken at the first difference, says which half must agree, so each pair is found
in one shard only.

A half that very many words share is no single task: where more than HOT words have it, the open half is
halved again, and what was outside the error must agree too, until at most HOT words are left or the
error's place is fixed, where the alphabet bounds the words. Nothing is capped.

Words' counts are summed before they are shuffled. A form's count is ten times as large, so forms are followed
by doubling in at most five steps.

Defined results: null and empty texts have no words; a null doc_id counts as the empty text in the digest. Of equal
counts the word that comes first in code-point order wins. An empty table gives an empty one; other columns
are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.shared import written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT, TIMES, DELETE_ONE_OF = 7, 2, 10, 31
#: Words with one half in common that a task takes before the half is cut further, and places of a shard, about.
HOT, SHARD = 5_000, 20_000
#: Words that a worker counts before it gives them back.
KEPT = 300_000


# ---- words


def runs(doc_id: int | None, text: str | None) -> Iterator[tuple[str, int]]:
    """The words of a text with their counts, one character deleted where the digest says so."""
    if not text:
        return
    lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes know A to Z only
    head = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
    for run, n in Counter(RUN.findall(lower)).items():
        if len(run) < LEAST_LENGTH:
            continue
        h = zlib.crc32(run.encode(), head)
        if h % DELETE_ONE_OF == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < LEAST_LENGTH:
                continue
        yield run, n


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, int] = {}

    def given() -> pd.DataFrame:
        out = pd.DataFrame({"word": list(counts), "n": list(counts.values())}).astype({"word": object, "n": "int64"})
        counts.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            for word, n in runs(None if pd.isna(doc_id) else int(doc_id), text):
                counts[word] = counts.get(word, 0) + n
            if len(counts) >= KEPT:
                yield given()
    yield given()


def words(documents: DataFrame) -> DataFrame:
    """word and n: words of LEAST_LENGTH or more that occur LEAST_COUNT times or more."""
    counted = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ---- index and search


class Index:
    """Rank tables of a text and of its reverse. An interval is (low, high, low in the reverse)."""

    def __init__(self, found: list[str]):
        text = np.array([ord(c) for c in "\n" + "\n".join(found) + "\n"], np.int32)
        self.alphabet, self.text = np.unique(text, return_inverse=True)
        self.n, self.size = len(text), len(self.alphabet)
        self.word_at = np.cumsum(text == 10) - 1  # the word that a delimiter opens
        self.less = np.append(0, np.cumsum(np.bincount(self.text, minlength=self.size)))[:-1]
        self.order, self.below = self._ranks(self.text)
        self.back = self._ranks(self.text[::-1])[1]

    def _ranks(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix order by doubling; and, before each rank, how many letters are smaller than each letter (a column more than letters)."""
        n, rank, step = len(text), text.astype(np.int64), 1
        while True:
            key = rank * (n + 1)
            key[: n - step] += rank[step:] + 1
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.append(0, np.cumsum(ordered[1:] != ordered[:-1]))
            if rank[order[-1]] == n - 1:
                break
            step *= 2
        below = np.zeros((n + 1, self.size + 1), np.int32)
        below[np.arange(1, n + 1), text[order - 1] + 1] = 1  # the letter before a suffix; before the first, the last
        np.cumsum(below, axis=0, out=below)
        np.cumsum(below, axis=1, out=below)
        return order, below

    def step(self, iv: np.ndarray, letter: np.ndarray, left: bool) -> np.ndarray:
        """(m, 3) intervals, each by one letter more on that side. On the right the two indexes change places."""
        below = self.below if left else self.back
        low, other = (iv[:, 0], iv[:, 2]) if left else (iv[:, 2], iv[:, 0])
        high = low + iv[:, 1] - iv[:, 0]
        first, last = below[low, letter], below[high, letter]
        before = below[low, letter + 1] - first  # occurrences of the letter before the interval
        found = below[high, letter + 1] - last - before
        new, beside = self.less[letter] + before, other + last - first
        out = np.empty_like(iv)
        out[:, 0], out[:, 2] = (new, beside) if left else (beside, new)
        out[:, 1] = out[:, 0] + found
        return out

    def letters(self, iv: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, letter) of all letters that stand on that side of the intervals' places."""
        below = self.below if left else self.back
        low = iv[:, 0] if left else iv[:, 2]
        return np.nonzero(np.diff(below[low + iv[:, 1] - iv[:, 0]] - below[low], axis=1))


def search(index: Index, query: np.ndarray, start: np.ndarray, stop: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query number, word number) of words that one error beside the exact half makes of a query; some come more than once.

    query: (m, width) letters of delimited words, filled with -1 behind; [start, stop) is the exact half with its
    delimiter. left: the error is left of it, and the exact half is matched to the right first.
    """
    m, width = query.shape
    number = np.arange(m)
    iv = np.tile(np.array([0, index.n, 0]), (m, 1))
    # the exact half
    for i in range(int((stop - start).max(initial=0))):
        at = start + i if left else stop - 1 - i
        on = (start + i < stop) & (iv[:, 1] > iv[:, 0])
        iv[on] = index.step(iv[on], query[number[on], at[on]], not left)
    length = (query >= 0).sum(axis=1)
    # states: query, place of the next letter, interval, error made
    place = start - 1 if left else stop
    sign = -1 if left else 1
    live = iv[:, 1] > iv[:, 0]
    q, place, iv, made = number[live], place[live], iv[live], np.zeros(int(live.sum()), bool)
    out_q, out_word = [], []
    while True:
        over = (place < 0) | (place >= length[q])
        done = over & made
        out_q.append(q[done])  # the interval is one delimited word, and its rank tells where that begins
        out_word.append(index.word_at[index.order[iv[done, 0]]])
        # without an error, an interval of one place holds the query's own word alone
        go = ~over & (made | (iv[:, 1] - iv[:, 0] > 1))
        q, place, iv, made = q[go], place[go], iv[go], made[go]
        if not len(q):
            return np.concatenate(out_q), np.concatenate(out_word)
        letter = query[q, place]
        free = np.flatnonzero(~made)
        r, c = index.letters(iv[free], left)
        r = free[r]
        r, c = r[c != 0], c[c != 0]  # a delimiter is neither inserted, replaced nor deleted
        inner = free[letter[free] != 0]
        other = (c != letter[r]) & (letter[r] != 0)
        every = np.arange(len(q))
        by = np.concatenate([every, r, r[other]])  # the letter itself, one inserted before it, another in its place
        stepped = index.step(iv[by], np.concatenate([letter, c, c[other]]), left)
        to = np.concatenate([place + sign, place[r], place[r[other]] + sign])
        error = np.concatenate([made, np.ones(len(by) - len(every), bool)])
        full = stepped[:, 1] > stepped[:, 0]
        by, stepped, to, error = by[full], stepped[full], to[full], error[full]
        q, place, iv, made = np.concatenate([q[by], q[inner]]), np.concatenate([to, place[inner] + sign]), np.concatenate([stepped, iv[inner]]), np.concatenate([error, np.ones(len(inner), bool)])


def _first_difference(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def near_in_shard(shard: pd.DataFrame) -> pd.DataFrame:
    """word, n_near, n and near of what a shard's places (word, n, key, short, at, open) have near each other.

    A pair counts where both words have the key and their first difference lies in its open part.
    """
    shard = shard[shard.duplicated("key", keep=False)]
    out: list[tuple] = []
    if len(shard):
        found = sorted(set(shard["word"]))
        counts = dict(zip(shard["word"], shard["n"]))
        index = Index(found)
        keys: dict[str, dict] = {}
        for w, key, short, at, wide in shard[["word", "key", "short", "at", "open"]].itertuples(index=False):
            keys.setdefault(w, {})[key] = (short, at, wide)
        code = {chr(c): i for i, c in enumerate(index.alphabet)}
        pairs: set[tuple[str, str]] = set()
        # exact halves differ with the length of the shorter word; equal tasks are searched once
        tasks: dict[tuple[bool, str, int, int], None] = {}
        for w, own in keys.items():
            for short, at, wide in own.values():
                longer = len(w) - short  # 0 or 1
                before, behind = at, len(w) - at - wide - longer
                left = behind > before  # the longer exact part leads
                tasks[(left, w, *((at + wide + longer + 1, len(w) + 2) if left else (0, at + 1)))] = None
        for left in (False, True):
            wanted = [t[1:] for t in tasks if t[0] == left]
            for i in range(0, len(wanted), 2_000):
                part = wanted[i : i + 2_000]
                query = np.full((len(part), max(len(w) for w, _, _ in part) + 2), -1, np.int64)
                for k, (w, _, _) in enumerate(part):
                    query[k, : len(w) + 2] = [0, *[code[c] for c in w], 0]
                q, word = search(index, query, np.array([s for _, s, _ in part]), np.array([e for _, _, e in part]), left)
                pairs.update((part[a][0], found[b]) for a, b in zip(q.tolist(), word.tolist()))
        near: dict[str, list] = {}
        for a, b in pairs:
            if a == b:
                continue
            at, mine, theirs = _first_difference(a, b), keys[a], keys[b]
            short = min(len(a), len(b))
            if any(k in theirs and mine[k][0] == short and mine[k][1] <= at and (at < mine[k][1] + mine[k][2] or at == short == mine[k][1] + mine[k][2]) for k in mine):
                best = near.setdefault(a, [0, 0, ""])
                best[0] += 1
                if (-counts[b], b) < (-best[1], best[2]) or not best[1]:
                    best[1:] = counts[b], b
        out = [(w, *x) for w, x in near.items()]
    return pd.DataFrame(out, columns=["word", "n_near", "form_n", "near"]).astype({"word": object, "n_near": "int64", "form_n": "int64", "near": object})


def _places(rows: DataFrame) -> DataFrame:
    """The key of a place: length of the shorter word, open part, and what stands before and behind it."""
    longer = F.length("word") - F.col("short")
    before = F.substring(F.col("word"), F.lit(1), F.col("at"))
    behind = F.substring(F.col("word"), F.col("at") + F.col("open") + longer + 1, F.length("word"))
    return rows.withColumn("key", F.concat_ws("\n", F.col("short"), F.col("at"), F.col("open"), before, behind))


def places(vocabulary: DataFrame, hot: int = HOT) -> DataFrame:
    """word, n, short, at, open and key: each word as the shorter and as the longer one, with either half open."""
    shorts = F.explode(F.array_compact(F.array(F.length("word"), F.when(F.length("word") > LEAST_LENGTH, F.length("word") - 1)))).alias("short")
    half = F.expr("short div 2")
    rows = vocabulary.select("word", "n", shorts)
    rows = rows.select("word", "n", "short", F.explode(F.array(F.struct(F.lit(0).alias("at"), half.alias("open")), F.struct(half.alias("at"), (F.col("short") - half).alias("open")))).alias("p")).select("word", "n", "short", "p.at", "p.open")
    out, rows = None, _places(rows)
    while True:
        frequent = rows.where("open > 1").groupBy("key").count().where(F.col("count") > hot).select("key")
        if frequent.isEmpty():
            return rows if out is None else out.union(rows)
        # such keys are few: each has more than `hot` of the rows
        frequent = written(frequent)
        kept = rows.join(frequent, "key", "left_anti").select(rows.columns)
        out = kept if out is None else out.union(kept)
        first = F.expr("open div 2")
        parts = F.explode(F.array(F.struct(F.col("at").alias("at"), first.alias("open")), F.struct((F.col("at") + first).alias("at"), (F.col("open") - first).alias("open")))).alias("p")
        rows = written(_places(rows.join(frequent, "key", "left_semi").select("word", "n", "short", parts).select("word", "n", "short", "p.at", "p.open")))


def near_words(vocabulary: DataFrame, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """word, n_near, form_n and near: how many words are near it, and the most frequent of them."""
    found = places(vocabulary, hot)
    shards = vocabulary.count() * 4 // shard + 1
    rows = found.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInPandas(near_in_shard, "word string, n_near long, form_n long, near string")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("near"))).alias("best")
    return rows.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.m")).alias("form_n"), F.col("best.near").alias("near"))


def variants(documents: DataFrame, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """word, form, root, n, n_near and form_n."""
    vocabulary = written(words(documents))
    near = near_words(vocabulary, hot, shard).withColumnRenamed("word", "of")
    takes = F.col("form_n") >= TIMES * F.col("n")
    rows = vocabulary.join(near, F.col("word") == F.col("of"), "left")
    rows = written(rows.select("word", F.when(takes, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("form_n")).alias("form_n")))
    root = written(rows.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        above = root.select(F.col("word").alias("root"), F.col("root").alias("up"))
        moved = written(root.join(above, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("on")))
        root = moved.select("word", "root")
        if moved.where("on").isEmpty():
            break
    return rows.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(documents: DataFrame) -> DataFrame:
    return variants(documents)
