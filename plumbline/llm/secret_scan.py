"""Secrets: fixed patterns, and credential-context values that are hard to guess.

Patterns give base spans: assignments to a credential name (`assign`), access keys (`access`) and long
hexadecimal runs (`hex`). Values behind a credential word, a separator and perhaps a quote, behind `bearer`, or
before the @ of a url are judged by the cheapest way to guess them: dynamic programming over the value
finds the segmentation of least cost into

    words        of the corpus, as they are, in capitals or with digits and signs for letters (a word that makes up
                 1/g of all words is among the g most frequent ones, so it costs log2 g bits), or usual passwords
    dates        years, and days with or without separators
    repeats      blocks of up to LONGEST_BLOCK characters, from where their run begins: the block and how often
    walks        three or more neighbouring keys, or neighbouring letters or digits: the first, and a bit or so a turn
    brute force  runs of one class of characters: log2 of the class's size for each

where each segment also costs its kind. Values of GUESSES guesses or more are added as spans `guess`.

Words are counted over the whole corpus but outside such values, so a secret that is copied a thousand times is no
word. Only the pieces of values meet the counts, in a join; each distinct value is judged once, and a
value that very many rows have is dealt to several tasks on its way back.

Defined results: null and empty texts have no spans. Offsets count code points, ends are exclusive. Rows are told
apart, not ids. An empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log2

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slices, spread_join
from plumbline.shared import written

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run of fewer holds no later one that is long enough
HEX = re.compile(r"[0-9a-f]{24,}")
#: Words that announce a credential.
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|login|(?:api|access|private|client|secret)[_\x20-]?(?:key|secret|token|id)?)["']?\x20*(?:[:=]+>?|->)\x20*(?:bearer\x20+|basic\x20+)?["'`]?"""
    r"""([!#-&*+\--:=?-_a-~]{6,})|(?<![A-Za-z])bearer\x20+([A-Za-z0-9+/_.=~-]{6,})|://[^\s/:@]+:([^\s/@]{6,})@""",
    re.IGNORECASE | re.ASCII,
)
KINDS = ("assign", "access", "hex", "guess")
LEAST_VALUE = 6
#: Values that take fewer guesses are left alone.
GUESSES = 10**10

#: Words of the corpus are so long.
SHORTEST_WORD, LONGEST_WORD = 3, 20
LONGEST_BLOCK = 8
KIND_BITS = log2(5)
#: Usual passwords and placeholders; fixed values.
USUAL = (
    "password passwd secret token admin root user login welcome letmein master monkey dragon shadow sunshine princess football baseball superman batman trustno hello freedom whatever ninja "
    "changeme change default example sample test testing demo dummy guest public private none null undefined todo your here insert enter value key apikey redacted hidden"
).split()
#: Small letters, capitals, digits, and all other characters.
CLASS_BITS = (log2(26), log2(26), log2(10), log2(33))
LEET = str.maketrans("430157@$!", "aeolstasi")
WORD = re.compile(rf"(?<!\w)[a-z]{{{SHORTEST_WORD},{LONGEST_WORD}}}(?!\w)")
YEAR = r"(?:19|20)\d\d"
DAY, MONTH = r"(?:0?[1-9]|[12]\d|3[01])", r"(?:0?[1-9]|1[0-2])"
DATES = (
    (re.compile(YEAR), log2(120)),
    (re.compile(rf"{YEAR}{MONTH}{DAY}|{DAY}{MONTH}{YEAR}|{MONTH}{DAY}{YEAR}"), log2(120 * 366)),
    (re.compile(rf"{YEAR}([-/.]){MONTH}\1{DAY}|{DAY}([-/.]){MONTH}\2{YEAR}|{MONTH}([-/.]){DAY}\3{YEAR}"), log2(120 * 366 * 3)),
)
DATE_LENGTHS = (4, 6, 7, 8, 9, 10)


# ---- cost of a value


@lru_cache
def _keys() -> tuple[dict[str, dict[str, int]], int]:
    """The direction from a character to each neighbour: keys around it, and the next letter or digit; and how many keys."""
    rows, at = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm"), {}
    for y, row in enumerate(rows):
        for x, c in enumerate(row):
            at[c] = (2 * x + y, y)  # each row is shifted by half a key
    beside = {(2, 0): 0, (-2, 0): 1, (1, 1): 2, (-1, 1): 3, (1, -1): 4, (-1, -1): 5}
    out: dict[str, dict[str, int]] = {c: {} for c in at}
    for c, (x, y) in at.items():
        for d, (v, w) in at.items():
            if (v - x, w - y) in beside:
                out[c][d] = beside[v - x, w - y]
    for run in ("abcdefghijklmnopqrstuvwxyz", "0123456789"):
        for c, d in zip(run, run[1:]):
            out[c].setdefault(d, 6)
            out[d].setdefault(c, 7)
    return out, len(at)


def class_of(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


def word_bits(piece: str, words: dict[str, float]) -> float | None:
    """Bits of a word as it is written; words: bits of a word in small letters."""
    low = piece.lower()
    plain, best = low.translate(LEET), None
    for form, signs in ((low, 0), (plain, sum(x != y for x, y in zip(low, plain)))):
        bits = words.get(form)
        if bits is not None:
            upper = sum(c.isupper() for c in piece)
            case = 0 if not upper else 1 if upper == len(piece) or (upper == 1 and piece[0].isupper()) else len(piece)
            bits += case + (signs + 1 if signs else 0)
            best = bits if best is None else min(best, bits)
    return best


def date_bits(piece: str) -> float | None:
    return min((bits for pattern, bits in DATES if pattern.fullmatch(piece)), default=None)


def guess_bits(value: str, words: dict[str, float], repeats: bool = True) -> float:
    """log2 of the guesses of the cheapest segmentation."""
    n, low = len(value), value.lower()
    neighbours, n_keys = _keys()
    best, brute = [0.0] * (n + 1), [0.0] * (n + 1)
    inf = float("inf")
    one = two = many = inf  # walks of one, two, and three or more keys that end here
    same = [0] * (LONGEST_BLOCK + 1)  # how many characters in a row equal the one a block before them
    blocks: dict[str, float] = {}
    for j in range(1, n + 1):
        c, kind = value[j - 1], class_of(value[j - 1])
        new = best[j - 1] + KIND_BITS
        cost = brute[j] = (min(new, brute[j - 1]) if j > 1 and class_of(value[j - 2]) == kind else new) + CLASS_BITS[kind]
        turn = neighbours.get(low[j - 2], {}).get(low[j - 1]) if j > 1 else None
        if turn is None:
            two = many = inf
        else:
            before = neighbours.get(low[j - 3], {}).get(low[j - 2]) if j > 2 else None
            step = 1.0 if turn == before else 3.0
            two, many = one + 3.0, min(two, many) + step
        one = new + log2(n_keys) if low[j - 1] in neighbours else inf
        cost = min(cost, many)
        for size in range(SHORTEST_WORD, min(LONGEST_WORD, j) + 1):
            bits = word_bits(value[j - size : j], words)
            if bits is not None:
                cost = min(cost, best[j - size] + KIND_BITS + bits)
        if kind == 2:
            for size in DATE_LENGTHS:
                if size <= j and value[j - size].isdigit() and (bits := date_bits(value[j - size : j])) is not None:
                    cost = min(cost, best[j - size] + KIND_BITS + bits)
        if repeats:
            for p in range(1, min(LONGEST_BLOCK, j - 1) + 1):
                same[p] = same[p] + 1 if c == value[j - 1 - p] else 0
                times = same[p] // p + 1
                if times > 1:
                    start = j - times * p
                    block = value[start : start + p]
                    if block not in blocks:
                        blocks[block] = guess_bits(block, words, False)
                    cost = min(cost, best[start] + KIND_BITS + blocks[block] + log2(times))
        best[j] = cost
    return best[n]


def pieces(value: str) -> set[str]:
    """What of a value may be a word of the corpus."""
    low, out = value.lower(), set()
    for text in {low, low.translate(LEET)}:
        for run in re.finditer("[a-z]+", text):
            at, end = run.span()
            for i in range(at, end - SHORTEST_WORD + 1):
                out.update(text[i:k] for k in range(i + SHORTEST_WORD, min(i + LONGEST_WORD, end) + 1))
    return out


# ---- texts


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, value) behind credential words; punctuation that ends a sentence is no part of a value."""
    out = []
    for m in CONTEXT.finditer(text):
        value = m[m.lastindex]
        kept = value.rstrip(".!?:#*$%&|")
        if len(kept) >= LEAST_VALUE:
            out.append((m.start(m.lastindex), m.start(m.lastindex) + len(kept), kept))
    return out


def _found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in slices(batches):
        rows = []
        for key, doc_id, text in zip(batch["key"], batch["doc_id"], batch["text"]):
            base = base_spans(text) if text else []
            kinds = Counter(kind for _, kind, _ in base)
            rows.append((key, doc_id, kinds[0], kinds[1], kinds[2], [{"start": s, "kind": k, "end": e} for s, k, e in base], [{"start": s, "end": e, "value": v} for s, e, v in candidates(text or "")]))
        yield pd.DataFrame(rows, columns=["key", "doc_id", "n_assign", "n_access", "n_hex", "base", "found"]).astype({"doc_id": "Int64"})


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of the words outside values."""
    counts: Counter = Counter()

    def given() -> pd.DataFrame:
        out = pd.DataFrame({"piece": list(counts), "n": list(counts.values())}).astype({"piece": object, "n": "int64"})
        counts.clear()
        return out

    for batch in slices(batches):
        for text in batch["text"]:
            if text:
                for start, end, _ in reversed(candidates(text)):
                    text = text[:start] + " 0 " + text[end:]
                counts.update(WORD.findall(text.lower()))
        if len(counts) >= 300_000:
            yield given()
    yield given()


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in slices(batches, 100):
        rows = [(v, p) for v in batch["value"] for p in pieces(v)]
        yield pd.DataFrame(rows, columns=["value", "piece"]).astype(object)


def _bits(total: float):
    log_total = log2(max(total, 1))

    @F.pandas_udf("double")
    def run(values: pd.Series, known: pd.Series) -> pd.Series:
        out = []
        for value, words in zip(values, known):
            bits = {w: log2(len(USUAL)) for w in USUAL}
            for w in words if words is not None else ():
                bits[w["piece"]] = min(bits.get(w["piece"], 1e9), log_total - log2(w["n"]))
            out.append(guess_bits(value, bits))
        return pd.Series(out, dtype="float64")

    return run


def judged(values: DataFrame, documents: DataFrame) -> DataFrame:
    """value (distinct) and bits, its cost by the words of the documents."""
    counts = written(documents.select("text").mapInPandas(_words, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 1
    known = values.mapInPandas(_pieces, "value string, piece string").join(counts, "piece").groupBy("value").agg(F.collect_list(F.struct("piece", "n")).alias("known"))  # bounded by a value's length
    return values.join(known, "value", "left").select("value", _bits(float(total))("value", "known").alias("bits"))


def scan(documents: DataFrame, guesses: float = GUESSES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex and arrays of (start, kind, end): base, and all spans."""
    docs = documents.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    span = "array<struct<start:int,kind:int,end:int>>"
    found = written(docs.mapInPandas(_found, f"key long, doc_id long, n_assign long, n_access long, n_hex long, base {span}, found array<struct<start:int,end:int,value:string>>"))
    each = found.where(F.size("found") > 0).select("key", F.inline("found"))
    hard = judged(each.select("value").distinct(), documents).where(F.col("bits") >= log2(guesses)).select("value")
    added = spread_join(each, hard, "value", ("key", "start")).groupBy("key").agg(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end")).alias("added"))  # a text's own
    rows = found.join(added, "key", "left")
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", "base", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(span)))).alias("spans"))


def as_text(spans: str):
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def query(documents: DataFrame, guesses: float = GUESSES) -> DataFrame:
    rows = scan(documents, guesses)
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(as_text("base").cast("binary"), 256).alias("base_sha256"), as_text("spans").alias("spans"))
