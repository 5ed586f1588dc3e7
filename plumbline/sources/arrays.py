"""JSON arrays of records, read in parts.

One file is one array, on one line or many, and of any size. Spark cuts it into splits at closing braces; no split needs to
know where a record begins. A split is summed up for both cases, that it begins within a string or not: whether it ends
within one, and by how much it is deeper then. Composing these sums along a file tells how each split really begins.
Then each split gives back its whole records, and the piece before its first border and behind its last one; the
pieces of neighbours are joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.shared import written

#: Splits whose beginnings go to every task at once.
SENT = 100_000
_STRING, _REST = re.compile(r'"(?:[^"\\]|\\.)*"', re.S), re.compile(r'(?:[^"\\]|\\.)*"', re.S)
_PIECE = "file string, start long, part int, text string"


def _advance(text: str, inside: bool) -> tuple[bool, int]:
    """Is the end within a string, and how much deeper is it?"""
    if inside:
        end = _REST.match(text)
        if not end:
            return True, 0
        text = text[end.end() :]
    bare = _STRING.sub("", text)
    before, quote, _ = bare.partition('"')
    return bool(quote), before.count("{") + before.count("[") - before.count("}") - before.count("]")


def _begin(text: str) -> int:
    """Where the first record begins in text that is outside of records."""
    return text.find("{")


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found: dict[tuple, list] = {}
    for rows in batches:
        for file, start, text in zip(rows["file"], rows["start"], rows["value"]):
            ends = found.setdefault((file, start), [False, 0, True, 0])
            for i in (0, 2):
                ends[i], deeper = _advance(text + "}", ends[i])
                ends[i + 1] += deeper
    yield pd.DataFrame([(*k, *v) for k, v in found.items()], columns=["file", "start", "out", "deeper_out", "in", "deeper_in"])


def _beginnings(rows: pd.DataFrame) -> pd.DataFrame:
    """How each split of a file begins."""
    inside, depth, out = False, 0, []
    for r in rows.sort_values("start").itertuples(index=False):
        out.append((r[0], r[1], inside, depth))
        inside, depth = (r[4], depth + r[5]) if inside else (r[2], depth + r[3])
    return pd.DataFrame(out, columns=["file", "start", "inside", "depth"])


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole records (part 1), and what a split has of the record before its first border (0) and behind its last (2)."""
    state: dict[tuple, list] = {}  # inside a string, depth, the open record's text, does it begin here
    for rows in batches:
        out = []
        for file, start, text, inside, depth in zip(rows["file"], rows["start"], rows["value"], rows["inside"], rows["depth"]):
            s = state.setdefault((file, start), [bool(inside), int(depth), [] if depth > 1 or inside else None, False])
            text += "}"
            ends_in, deeper = _advance(text, s[0])
            if s[2] is None:
                at = _begin(text)
                if at < 0 or text[at:] == "":
                    s[0], s[1] = ends_in, s[1] + deeper
                    continue
                s[2], s[3], text = [], True, text[at:]
            s[2].append(text)
            s[0], s[1] = ends_in, s[1] + deeper
            if not s[0] and s[1] == 1:
                out.append((file, start, 1 if s[3] else 0, "".join(s[2])))
                s[2] = None
        yield pd.DataFrame(out, columns=["file", "start", "part", "text"])
    left = [(file, start, 2 if s[3] else 3, "".join(s[2])) for (file, start), s in state.items() if s[2]]  # 3: no border at all
    yield pd.DataFrame(left, columns=["file", "start", "part", "text"])


def _joined(rows: pd.DataFrame) -> pd.DataFrame:
    """Records that lie in several splits of a file, from their pieces."""
    out, now = [], []
    for start, part, text in rows.sort_values(["start", "part"])[["start", "part", "text"]].itertuples(index=False):
        if part == 2:
            now = [text]
        else:
            now.append(text)
            if part == 0:
                out.append((rows["file"].iloc[0], start, 1, "".join(now)))
                now = []
    return pd.DataFrame(out, columns=["file", "start", "part", "text"])


def scan_array(spark: SparkSession, path: str) -> DataFrame:
    """text: each record of the arrays at path, as it is written there."""
    lines = spark.read.option("lineSep", "}").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    begins = lines.mapInPandas(_sums, "file string, start long, out boolean, deeper_out long, in boolean, deeper_in long").groupBy("file").applyInPandas(_beginnings, "file string, start long, inside boolean, depth long")
    begins = spark.createDataFrame(begins.toPandas(), "file string, start long, inside boolean, depth long")  # a row for each split
    out = None
    groups = begins.count() // SENT + 1
    for g in range(groups):
        own = begins.where(F.pmod(F.xxhash64("file"), F.lit(groups)) == g)
        # the splits' own order must stay, so the small side goes to the rows
        pieces = lines.join(F.broadcast(own), ["file", "start"]).select("file", "start", "value", "inside", "depth").mapInPandas(_pieces, _PIECE)
        out = pieces if out is None else out.union(pieces)
    out = written(out)  # so that splits are cut once, for whole records and for pieces
    joined = out.where("part <> 1").groupBy("file").applyInPandas(_joined, _PIECE)
    return out.where("part = 1").union(joined).select("text")
