"""Repeated passages of lines, by winnowing over line hashes.

A document is the sequence of hashes of its non-blank lines, taken without outer white space. Windows
are the shortest runs of lines with at least min_words words (Unicode white space splits words), from
each line forwards and from each line backwards. Of each window the line with the least hash is selected,
the rightmost of equal ones; a line that is the minimum of many windows is one fingerprint. A run of that
many words that occurs twice holds a whole window, whose minimum is selected at both places, hence the
fingerprint is guaranteed. Positions are joined by fingerprint: where a fingerprint occurs once, nothing
repeats. The windows around the others are compared as a whole (128-bit digests), each with its first
occurrence. A match so grows both ways, by the windows that end and that begin at its lines, up to the
last line that both places share; the later of two equal runs is deleted. "First" is by doc_id, then by
the place in the document.

Nothing of a fingerprint or window is gathered: counts and first positions are aggregated, and a very
frequent line or passage is dealt to several tasks where positions are joined.

Defined results: null texts stay null; empty texts and texts with too few words never change. Rows with
a null doc_id come last in order. Rows that share doc_id and text are one document that is repeated:
they change alike and don't delete each other. Blank lines between two deleted lines go
with them; others stay. Extra columns are kept; a column named lines_runs is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import give_back, own_names, slices, spread_join
from plumbline.shared import written

MIN_WORDS = 50


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def line_hashes(text: str | None) -> tuple[list[int], list[int], list[int]]:
    """Hashes of the non-blank lines, their numbers in the text and their words."""
    hashes, numbers, words = [], [], []
    for number, line in enumerate(text.split("\n") if text else ()):
        n = len(line.split())
        if n:
            hashes.append(xxhash.xxh64_intdigest(line.strip().encode("utf-8", "surrogatepass")))
            numbers.append(number)
            words.append(n)
    return hashes, numbers, words


def windows(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """(first, last) of the shortest runs with min_words words that begin, and that end, at each line, in order."""
    out, end, total = set(), 0, 0
    for start in range(len(words)):
        while end < len(words) and total < min_words:
            total += words[end]
            end += 1
        if total < min_words:
            break
        out.add((start, end - 1))
        total -= words[start]
    start = total = 0
    for end in range(len(words)):
        total += words[end]
        while total - words[start] >= min_words:
            total -= words[start]
            start += 1
        if total >= min_words:
            out.add((start, end))
    return sorted(out)


def winnowed(hashes: list[int], spans: list[tuple[int, int]]) -> dict[int, list[tuple[int, int]]]:
    """Selected lines, each with the windows of which it is the rightmost minimum. Both ends of the windows never fall."""
    out: dict[int, list[tuple[int, int]]] = {}
    falling: list[int] = []  # lines that may be a minimum: from the left ever larger hashes
    head = next_line = 0
    for start, end in spans:
        while next_line <= end:
            while len(falling) > head and hashes[falling[-1]] >= hashes[next_line]:
                falling.pop()
            falling.append(next_line)
            next_line += 1
        while falling[head] < start:
            head += 1
        out.setdefault(falling[head], []).append((start, end))
    return out


PICKS = "doc_id long, text_hash long, key long, firsts array<int>, lasts array<int>, nexts array<int>, digests array<binary>"


def _picks(min_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                hashes, numbers, words = line_hashes(text)
                if sum(words) < min_words:
                    continue
                own = _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")))
                numbers.append(numbers[-1] + 1)
                raw = b"".join(h.to_bytes(8, "little") for h in hashes)
                for at, spans in winnowed(hashes, windows(words, min_words)).items():
                    rows.append((doc_id, own, _signed(hashes[at]), [numbers[a] for a, _ in spans], [numbers[b] for _, b in spans], [numbers[b + 1] for _, b in spans], [xxhash.xxh3_128_digest(raw[8 * a : 8 * b + 8]) for a, b in spans]))
            yield pd.DataFrame(rows, columns=["doc_id", "text_hash", "key", "firsts", "lasts", "nexts", "digests"]).astype({"doc_id": "Int64"})
        give_back()

    return run


@F.pandas_udf(T.LongType())
def _text_hash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for text in batches:
        yield pd.Series([_signed(xxhash.xxh64_intdigest((t or "").encode("utf-8", "surrogatepass"))) for t in text], dtype="int64")
    give_back()


def fingerprints(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, key and the windows (first and last line, digest) of each selected line; next: the line after a window that isn't blank."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    return rows.mapInPandas(_picks(min_words), PICKS)


def repeated_runs(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash and runs ("first-last" line numbers, joined by commas) of each document with later repeats."""
    positions = written(fingerprints(documents, min_words))
    shared = positions.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    again = spread_join(positions, shared, "key", ("doc_id", "text_hash", "firsts"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("text"))
    marks = written(again.select(place.alias("doc"), F.explode(F.arrays_zip("firsts", "lasts", "nexts", "digests")).alias("w")).select("doc", F.col("w.firsts").alias("first"), F.col("w.lasts").alias("last"), F.col("w.nexts").alias("next"), F.col("w.digests").alias("digest")))
    origin = marks.groupBy("digest").agg(F.min(F.struct("doc", "first")).alias("origin"), F.count("*").alias("n")).where("n > 1").select("digest", "origin")
    hits = spread_join(marks, origin, "digest", ("doc", "first")).where(F.struct("doc", "first") != F.col("origin"))
    # a document's repeated windows with no line between them are one run; they are as many as its lines, about
    order = W.partitionBy("doc").orderBy("first", "last")
    reach = F.max("next").over(order.rowsBetween(W.unboundedPreceding, -1))
    placed = hits.select("doc", "first", "last", F.when(reach >= F.col("first"), 0).otherwise(1).alias("begins"))
    placed = placed.withColumn("run", F.sum("begins").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    runs = placed.groupBy("doc", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    named = F.transform(F.array_sort(F.collect_list(F.struct("first", "last"))), lambda r: F.format_string("%d-%d", r["first"], r["last"]))
    return runs.groupBy("doc").agg(F.array_join(named, ",").alias("runs")).select(F.col("doc.id").alias("doc_id"), F.col("doc.text").alias("text_hash"), "runs")


def _dead(runs: str | None) -> set[int]:
    return {i for run in (runs or "").split(",") if run for a, b in [run.split("-")] for i in range(int(a), int(b) + 1)}


@F.pandas_udf(T.StringType())
def _without(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, runs in batches:
        out = []
        for t, r in zip(text, runs):
            if t is not None and r:
                dead = _dead(r)
                t = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in dead)
            out.append(t)
        yield pd.Series(out, dtype=object)
    give_back()


@F.pandas_udf(T.LongType())
def _count(runs: pd.Series) -> pd.Series:
    return pd.Series([len(_dead(r)) for r in runs], dtype="int64")


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS, drop_emptied: bool = False) -> DataFrame:
    """The documents' columns with later repeated runs out of text, and lines_runs (null: unchanged).

    drop_emptied: a document of which no word is left goes; others that had none to begin with stay.
    """
    documents = documents.drop("lines_runs")
    own, hashed, of = own_names(documents, "lines_own", "lines_hash", "lines_id")
    runs = repeated_runs(documents, min_words).select(F.col("doc_id").alias(of), F.col("text_hash").alias(hashed), F.col("runs").alias("lines_runs"))
    keyed = documents.withColumn(own, _text_hash("text"))
    rows = keyed.join(runs, keyed["doc_id"].cast("long").eqNullSafe(F.col(of)) & (F.col(own) == F.col(hashed)), "left").drop(of, hashed, own)
    rows = rows.withColumn("text", _without("text", "lines_runs"))
    return rows.where("lines_runs is null or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'") if drop_emptied else rows


def query(documents: DataFrame) -> DataFrame:
    rows = dedup_lines(documents.select("doc_id", "text"))
    return rows.select("doc_id", _count("lines_runs").alias("n_deleted"), F.col("lines_runs").alias("deleted_runs"), "text")
