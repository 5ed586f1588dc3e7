"""Alignment of two tokenizers' tokens, document by document, by an associative fragment monoid.

Tokens of A and of B cover the bytes of space+text. The byte offsets where both have a token end cut
them into groups. A range of bytes knows the tokens that end in it, which gives a fragment:

    before   the tokens up to its first common end (an open prefix: tokens may have come earlier)
    groups   what lies between its common ends (closed)
    after    the tokens behind its last common end (an open suffix)

or, without a common end, tokens alone. Joining two neighbours closes the left one's suffix with the right
one's prefix; this is associative, so ranges may be composed in any tree. Texts of more than `chunk` bytes
are cut into ranges of so many bytes wherever these fall, also inside a token; the ranges go to
different tasks, and fragments are composed `FAN` at a time until one is left. Other texts are one
range.

A range is encoded unit by unit: a unit begins at spaces or line ends that follow anything but white space, and at
usual punctuation that follows a letter. Neither tokenizer has a token over such a place (A's words end there; no
piece of B has a space mark or punctuation behind a letter, or a line end). So units give the very tokens of
the whole text, and units seen before are looked up. A range without such a place goes on to the next one.

The count of an id pair needs a table of all pairs. Two tokens that end together are suffixes of one another,
so there are at most as many pairs as both vocabularies have bytes (`most_pairs`, about 600,000 for the
two used here, whatever the corpus): that table goes to every task.

Defined results: texts that are null or empty, or whose joined tokens differ from space+text, have no tokens:
zeros and an empty digest. Rows are told apart, not ids: repeated rows and null ids each give a row. Other
columns are not read. An empty table gives an empty one.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import give_back, slices
from plumbline.shared import rows_at_a_time, written

MARK = "▁"
#: Texts of more bytes are cut into ranges of so many.
CHUNK = 32_768
#: Fragments that one task composes.
FAN = 8
#: Units whose tokens a worker keeps.
CACHE = 200_000
#: Rows that go into Python at a time, and texts that are encoded at a time.
ROWS, AT_ONCE = 500, 64
PUNCTUATION = ".,!?;:#$%&*)"
#: Where units begin.
CUT = re.compile(rf"(?=[ \n])(?<=\S)|(?=[{PUNCTUATION}])(?<=[A-Za-zÀ-ÖØ-öø-ɏА-я])")
#: Text for which all libraries agree on what is a letter; and the usual split into words, a fixed value.
LATIN = re.compile("[\\t\\n\\r -~\u00a1-\u024f]+")
WORDS_OF_A = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RESULT = "n_a long, n_b long, n_groups long"
FRAGMENT = f"key long, doc_id long, no int, whole boolean, {RESULT}, n_best long, count_sum long, ended boolean, before_a string, before_b string, groups string, after_a string, after_b string"


# ---- the monoid


def compose(parts: list[tuple]) -> tuple:
    """The fragment of neighbouring fragments (ended, before_a, before_b, groups, after_a, after_b), in order."""
    join = lambda x, y: f"{x},{y}" if x and y else x or y
    ended, before, groups, after = False, ("", ""), [], ("", "")
    for has_end, a, b, closed, later_a, later_b in parts:
        a, b = join(after[0], a), join(after[1], b)
        if not has_end:
            after = (a, b)
            continue
        if ended:
            groups.append(f"{a}|{b}")
        else:
            ended, before = True, (a, b)
        if closed:
            groups.append(closed)
        after = (later_a, later_b)
    return (ended, *before, ";".join(groups), *after) if ended else (False, *after, "", "", "")


def fragment(a: list[int], a_ends: np.ndarray, b: list[int], b_ends: np.ndarray) -> tuple[tuple, list[tuple[int, int]]]:
    """The fragment of tokens with their ends, and the id pairs that end together."""
    common = np.intersect1d(a_ends, b_ends)
    at_a, at_b = np.searchsorted(a_ends, common) + 1, np.searchsorted(b_ends, common) + 1
    text_a, text_b = list(map(str, a)), list(map(str, b))
    cuts_a, cuts_b = [0, *at_a.tolist(), len(a)], [0, *at_b.tolist(), len(b)]
    parts = [(",".join(text_a[i:j]), ",".join(text_b[k:m])) for i, j, k, m in zip(cuts_a, cuts_a[1:], cuts_b, cuts_b[1:])]
    links = [(a[i - 1], b[j - 1]) for i, j in zip(at_a.tolist(), at_b.tolist())]
    if not links:
        return (False, *parts[0], "", "", ""), links
    return (True, *parts[0], ";".join(f"{x}|{y}" for x, y in parts[1:-1]), *parts[-1]), links


# ---- the tokenizers


def _byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _plain_encoder(spec: dict):
    """A faster encoder of the same vocabulary for Latin text, where the file is merges in the order of their ids and the usual split into words; else None."""
    import tiktoken

    vocabulary, merges, letters = spec["model"]["vocab"], spec["model"]["merges"], _byte_alphabet()
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
    before = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex") or [vocabulary.get(t) for t in made] != list(range(256, 256 + len(made))):
        return None
    ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if i < 256 + len(made)}
    return tiktoken.Encoding("plain", pat_str=WORDS_OF_A, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Pair:
    """Both tokenizers, the bytes of their tokens, and the units seen so far."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.path_a = path_a
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        self.plain = _plain_encoder(spec)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters, size = _byte_alphabet(), self.b.get_piece_size()
        found = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.bytes_a: list[bytes] = [b""] * (max(found.values()) + 1)
        for token, i in found.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(size)]
        if any(MARK in p.lstrip(MARK) or "\n" in p or CUT.search(p) for p in pieces):
            raise ValueError("a piece holds a place where units begin; texts can't be encoded by units")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.mark = self.b.piece_to_id(MARK)
        self.sizes_a, self.sizes_b, self.size_b = list(map(len, self.bytes_a)), list(map(len, self.bytes_b)), size
        self.names = np.array([[f"{i}{behind}" for i in range(max(size, len(self.bytes_a)))] for behind in (",", "|", ";", "")], dtype=object)
        self.known: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        self.void: set[str] = set()

    @cached_property
    def a(self):
        """Loaded for the first unit that the plain encoder doesn't take."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path_a)
        out.encode_special_tokens = True
        return out

    def most_pairs(self) -> int:
        """No two tokens end together but where one is a suffix of the other."""
        return sum(map(len, self.bytes_a)) + sum(map(len, self.bytes_b))

    def ids(self, units: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of A and B of each unit, as they are within a text."""
        plain = self.plain
        if plain is None:
            found_a = [x.ids for x in self.a.encode_batch_fast(units, add_special_tokens=False)]
        else:
            others = [u for u in units if not LATIN.fullmatch(u)]
            known = dict(zip(others, [x.ids for x in self.a.encode_batch_fast(others, add_special_tokens=False)])) if others else {}
            found_a = [known[u] if u in known else plain(u) for u in units]
        # encoding puts a mark in front, of a line end too; other units are encoded behind a line end
        found_b = self.b.encode([u[1:] if u[0] == " " else u if u[0] == "\n" else "\n" + u for u in units], num_threads=1)
        for unit, a, b in zip(units, found_a, found_b):
            yield a, [self.mark] if unit == " " else b if unit[0] == " " else b[1 if unit[0] == "\n" else 2 :]

    def ends(self, a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum([self.sizes_a[i] for i in a]), np.cumsum([self.sizes_b[i] for i in b])

    def covers(self, unit: str, a: list[int], b: list[int]) -> bool:
        raw = unit.encode("utf-8", "surrogatepass")
        return b"".join([self.bytes_a[i] for i in a]) == raw == b"".join([self.bytes_b[i] for i in b])

    def forget(self) -> None:
        self.known, self.older, self.void = {}, {}, set()

    def learn(self, units: set[str]) -> None:
        """Keeps groups, packed counts and links of these units; notes those that their tokens don't cover. Units of the last but one generation go."""
        if len(self.known) + len(units) > CACHE // 2:
            self.known, self.older, self.void = {}, self.known, set()
        new = units.difference(self.known, self.void)
        again = new & self.older.keys()
        for unit in again:
            self.known[unit] = self.older[unit]
        new = list(new - again)
        found = list(self.ids(new))
        raws = [u.encode("utf-8", "surrogatepass") for u in new]
        if not self._fit(found, raws):
            fits = [self.covers(u, a, b) for u, (a, b) in zip(new, found)]
            self.void.update(u for u, fit in zip(new, fits) if not fit)
            new, found, raws = ([x for x, fit in zip(xs, fits) if fit] for xs in (new, found, raws))
        if new:
            self.known.update(zip(new, self._aligned(found, raws)))

    def _fit(self, found: list, raws: list[bytes]) -> bool:
        """Do the tokens of all units cover them?"""
        for side, of, sizes in ((0, self.bytes_a, self.sizes_a), (1, self.bytes_b, self.sizes_b)):
            ids = list(chain.from_iterable([x[side] for x in found]))
            ends = np.append(0, np.cumsum(np.take(sizes, ids)))[np.cumsum([len(x[side]) for x in found])] if ids else np.empty(0, np.int64)
            if b"".join([of[i] for i in ids]) != b"".join(raws) or not np.array_equal(ends, np.cumsum(list(map(len, raws)))):
                return False
        return True

    def _aligned(self, found: list, raws: list[bytes]) -> Iterator[tuple]:
        """Groups, counts and links of units, aligned as one text; units end together, so none shares a group with the next."""
        all_a, all_b = (np.array(list(chain.from_iterable([x[side] for x in found]))) for side in (0, 1))
        ends_a, ends_b = np.cumsum(np.take(self.sizes_a, all_a)), np.cumsum(np.take(self.sizes_b, all_b))
        unit_ends = np.cumsum(list(map(len, raws)))
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        unit = np.searchsorted(unit_ends, common)
        closes = common == unit_ends[unit]
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        last_a, last_b = ends_a == common[group_a], ends_b == common[group_b]
        # what follows an id: a comma within a side, a bar between sides, a semicolon between groups, nothing at the end
        behind = np.concatenate([np.where(last_a, 1, 0), np.where(last_b, np.where(closes[group_b], 3, 2), 0)])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        written_ids = self.names[behind[order], np.concatenate([all_a, all_b])[order]].tolist()
        links = (all_a[last_a] * self.size_b + all_b[last_b]).astype(np.int32).tobytes()
        at = link = 0
        for (a, b), n in zip(found, np.bincount(unit, minlength=len(raws)).tolist()):
            end = at + len(a) + len(b)
            yield "".join(written_ids[at:end]), len(a) << 80 | len(b) << 40 | n, links[link : link + 4 * n]
            at, link = end, link + 4 * n

    def units_of(self, units: list[str]) -> tuple | None:
        """Groups, counts and links of units that make up a text or a range of it; None if their tokens don't cover them."""
        if self.void and not self.void.isdisjoint(units):
            return None
        if not units:
            return "", (0, 0, 0), np.empty(0, np.int32)
        groups, counts, links = zip(*map(self.known.__getitem__, units))
        n = sum(counts)
        return ";".join(groups), (n >> 80, n >> 40 & (1 << 40) - 1, n & (1 << 40) - 1), np.frombuffer(b"".join(links), np.int32)


@lru_cache(1)
def pair_of(path_a: str, path_b: str) -> Pair:
    """A worker's own, for all its tasks."""
    return Pair(path_a, path_b)


def let_go() -> None:
    """Tokenizers and tables that this worker keeps of stages that encode go; those that follow don't need them."""
    if pair_of.cache_info().currsize:
        pair_of.cache_clear()
        give_back()


# ---- Spark


def _short(path_a: str, path_b: str, keep_groups: bool):
    """Texts of one range each: all that is known without the corpus, and the links. Arrow batches are taken in small parts, so that few texts are held twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(path_a, path_b)
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(i, AT_ONCE)
                texts = [CUT.split(" " + t) if t else [] for t in part.column("text").to_pylist()]
                gc.disable()  # units are many small objects, and none of them is in a cycle
                try:
                    rows, at = [], 0
                    while at < len(texts):  # as many texts at a time as the table of units takes
                        units, start = set(), at
                        while at < len(texts) and (at == start or len(units) < CACHE // 4):
                            units.update(texts[at])
                            at += 1
                        pair.learn(units)
                        for found in texts[start:at]:
                            got = pair.units_of(found) if found else None
                            groups, counts, links = got or ("", (0, 0, 0), np.empty(0, np.int32))
                            rows.append((*counts, hashlib.sha256(groups.encode()).hexdigest() if got else "", groups if keep_groups else None, links))
                finally:
                    gc.enable()
                *numbers, digests, groups, links = zip(*rows)
                ends = np.append(0, np.cumsum(list(map(len, links)))).astype(np.int32)
                columns = [part.column("doc_id"), *[pa.array(x, pa.int64()) for x in numbers], pa.array(digests, pa.string()), pa.array(groups, pa.string()), pa.ListArray.from_arrays(ends, np.concatenate(links))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "groups", "links"])
        give_back()

    return run


def cut(text: str, chunk: int) -> list[tuple[str, int, int]]:
    """Ranges of the bytes of space+text: the units that a range touches, and its bytes (from, to] therein."""
    text = " " + text
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    byte_of = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    starts = np.append(0, np.fromiter((m.start() for m in CUT.finditer(text)), np.int64))
    places = np.append(byte_of[starts], len(raw))  # bytes where units begin, and the end
    chars = np.append(starts, len(text))
    bounds, reached = [0], 0
    for end in range(chunk, len(raw), chunk):
        before = int(np.searchsorted(places, end, "right")) - 1
        if before >= reached and end > bounds[-1]:  # so that no unit is in more than two ranges
            bounds.append(end)
            reached = int(np.searchsorted(places, end, "left"))
    bounds.append(len(raw))
    out = []
    for low, high in zip(bounds, bounds[1:]):
        first, last = int(np.searchsorted(places, low, "right")) - 1, int(np.searchsorted(places, high, "left"))
        out.append((text[chars[first] : chars[last]], low - int(places[first]), high - int(places[first])))
    return out


def _cut(chunk: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slices(batches, 8):
            rows = [(key, doc_id, no, *part) for key, doc_id, text in zip(batch["key"], batch["doc_id"], batch["text"]) for no, part in enumerate(cut(text, chunk))]
            yield pd.DataFrame(rows, columns=["key", "doc_id", "no", "part", "low", "high"]).astype({"doc_id": "Int64"})

    return run


def _ranges(path_a: str, path_b: str):
    """Fragment and links of each range of a long text."""

    def of(pair: Pair, part: str, low: int, high: int) -> tuple:
        units = CUT.split(part)
        size = len(part.encode("utf-8", "surrogatepass"))
        edge = [low > 0, high < size]  # first and last unit lie in the range only in part
        inner = units[edge[0] : len(units) - edge[1]] if len(units) > 1 or not any(edge) else []
        pair.learn(set(inner))
        got = pair.units_of(inner)
        pieces, counts, links = [], [0, 0, 0], []
        ok = got is not None

        def partly(unit: str, start: int) -> None:
            nonlocal ok
            ((a, b),) = pair.ids([unit])
            ok = ok and pair.covers(unit, a, b)
            a_ends, b_ends = pair.ends(a, b)
            in_a, in_b = ((start + e > low) & (start + e <= high) for e in (a_ends, b_ends))
            a, b = list(np.asarray(a)[in_a].tolist()), list(np.asarray(b)[in_b].tolist())
            piece, found = fragment(a, a_ends[in_a], b, b_ends[in_b])
            pieces.append(piece)
            links.extend(x * pair.size_b + y for x, y in found)
            for i, n in enumerate((len(a), len(b), len(found))):
                counts[i] += n

        if edge[0]:
            partly(units[0], 0)
        if got and inner:
            first, _, rest = got[0].partition(";")
            a, _, b = first.partition("|")
            pieces.append((True, a, b, rest, "", ""))
            links.extend(got[2].tolist())
            counts = [x + y for x, y in zip(counts, got[1])]
        if edge[1] and (len(units) > 1 or not edge[0]):
            partly(units[-1], size - len(units[-1].encode("utf-8", "surrogatepass")))
        return (ok, *counts, *compose(pieces), np.array(links, np.int32))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = pair_of(path_a, path_b)
        for batch in slices(batches, 32):
            rows = [(key, doc_id, no, *of(pair, part, low, high)) for key, doc_id, no, part, low, high in batch[["key", "doc_id", "no", "part", "low", "high"]].itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["key", "doc_id", "no", "whole", "n_a", "n_b", "n_groups", "ended", "before_a", "before_b", "groups", "after_a", "after_b", "links"]).astype({"doc_id": "Int64"})
        pair.forget()
        give_back()

    return run


def _composed(rows: pd.DataFrame) -> pd.DataFrame:
    """One fragment for up to FAN neighbours."""
    let_go()
    rows = rows.sort_values("no")
    parts = rows[["ended", "before_a", "before_b", "groups", "after_a", "after_b"]].itertuples(index=False, name=None)
    sums = [int(rows[c].sum()) for c in ("n_a", "n_b", "n_groups", "n_best", "count_sum")]
    out = (rows["key"].iloc[0], rows["doc_id"].iloc[0], int(rows["no"].iloc[0]) // FAN, bool(rows["whole"].all()), *sums, *compose(list(parts)))
    return pd.DataFrame([out], columns=[c.split()[0] for c in FRAGMENT.split(", ")]).astype({"doc_id": "Int64"})


def _weighed(table):
    """links -> n_best and count_sum, by the table of pairs."""

    @F.pandas_udf("n_best long, count_sum long")
    def run(links: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        let_go()
        codes, counts, best = table.value
        for batch in links:
            out = []
            for x in batch:
                at = np.searchsorted(codes, x)
                out.append((int(best[at].sum()), int(counts[at].sum())))
            yield pd.DataFrame(out, columns=["n_best", "count_sum"])

    return run


def align(documents: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK, keep_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for, groups."""
    with rows_at_a_time(documents.sparkSession, ROWS) as spark:
        docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        long = F.coalesce(F.octet_length("text") > chunk, F.lit(False))
        short = written(docs.where(~long).mapInArrow(_short(path_a, path_b, keep_groups), f"doc_id long, {RESULT}, groups_sha256 string, groups string, links array<int>"), spark)
        cuts = written(docs.where(long).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text").mapInPandas(_cut(chunk), "key long, doc_id long, no int, part string, low long, high long"), spark)
    ranges = written(
        cuts.repartition("key", "no").mapInPandas(
            _ranges(path_a, path_b), f"key long, doc_id long, no int, whole boolean, {RESULT}, ended boolean, before_a string, before_b string, groups string, after_a string, after_b string, links array<int>"
        )
    )
    void = ranges.where(~F.col("whole")).select("key").distinct()  # texts that their tokens don't cover

    size_b = pair_of(path_a, path_b).size_b
    links = short.select(F.explode("links").alias("code")).union(ranges.join(void, "key", "left_anti").select(F.explode("links")))
    pairs = links.groupBy("code").agg(F.count("*").alias("n"))
    pairs = written(pairs)
    most = pairs.groupBy((F.col("code") % size_b).alias("b")).agg(F.max("n").alias("most"))
    found = pairs.join(most, F.col("code") % size_b == F.col("b")).select("code", "n", (F.col("n") == F.col("most")).alias("best")).toPandas().sort_values("code")  # at most most_pairs() rows
    # a code that only void texts have finds another's place, or the one behind all; figures of such texts become zero
    table = spark.sparkContext.broadcast((found["code"].to_numpy(np.int32), np.append(found["n"].to_numpy(np.int64), 0), np.append(found["best"].to_numpy(bool), False)))
    weighed = _weighed(table)
    out = [*("doc_id", "n_a", "n_b", "n_groups"), F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256", *(["groups"] if keep_groups else [])]
    rows = short.withColumn("w", weighed("links")).select("*", "w.*").select(*out)

    parts = ranges.withColumn("w", weighed("links")).select("*", "w.*").select(*[c.split()[0] for c in FRAGMENT.split(", ")])
    most_ranges = cuts.agg(F.max("no")).first()[0]
    if most_ranges is None:
        return rows
    while most_ranges is not None:
        parts = parts.groupBy("key", F.expr(f"no div {FAN}").alias("_to")).applyInPandas(_composed, FRAGMENT)
        most_ranges = most_ranges // FAN or None
    whole = F.concat(F.col("before_a"), F.lit("|"), F.col("before_b"), F.when(F.col("groups") != "", F.concat(F.lit(";"), "groups")).otherwise(""))
    zero = lambda c: F.when(F.col("whole"), F.col(c)).otherwise(0).alias(c)
    parts = parts.withColumn("groups", F.when(F.col("whole"), whole).otherwise("")).withColumn("groups_sha256", F.when(F.col("whole"), F.sha2(F.col("groups").cast("binary"), 256)).otherwise(""))
    parts = parts.select("doc_id", *[zero(c) for c in ("n_a", "n_b", "n_groups", "n_best", "count_sum")], "groups_sha256", "groups")
    return rows.union(parts.select(*out))


def query(documents: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    import public_tokenizers

    return align(documents, path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model"))
