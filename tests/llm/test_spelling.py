"""Spelling variants against plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}
    form, near_of = {}, {}
    for w in counts:
        near_of[w] = [x for x in counts if near(w, x)]
        best = min(near_of[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n, len(near_of[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def vocabulary(seed, n=400):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        w = "".join(rng.choice("abé") for _ in range(rng.randint(7, 10)))
        out.add(w)
        i = rng.randrange(len(w))
        out.update({w[:i] + rng.choice("abÿ") + w[i:], w[:i] + w[i + 1 :] if len(w) > 7 else w, w[:i] + "z" + w[i + 1 :]})
    return sorted(out)


@pytest.mark.parametrize("hot,shard", [(spelling.HOT, spelling.SHARD), (3, 200), (40, 10_000)])
def test_near_words_equal_all_comparisons(spark, hot, shard):
    found = vocabulary(hot)
    counts = {w: 2 + (zlib.crc32(w.encode()) % 5) for w in found}
    got = {r["word"]: (r["n_near"], r["form_n"], r["near"]) for r in spelling.near_words(spark.createDataFrame(list(counts.items()), "word string, n long"), hot, shard).collect()}
    want = {}
    for w in found:
        them = [x for x in found if near(w, x)]
        if them:
            best = min(them, key=lambda x: (-counts[x], x))
            want[w] = (len(them), counts[best], best)
    assert got == want


def test_hot_halves_are_cut_until_they_fit(spark):
    words = [f"abcdefg{chr(97 + i)}{chr(97 + j)}mnopqr" for i in range(20) for j in range(20)]
    rows = spelling.places(spark.createDataFrame([(w, 2) for w in words], "word string, n long"), 25)
    assert rows.where("open > 1").groupBy("key").count().agg({"count": "max"}).first()[0] <= 25
    assert rows.groupBy("word").count().agg({"count": "min"}).first()[0] >= 4


def test_intervals_hold_the_places_of_a_pattern():
    index = spelling.Index(["banana", "bandana", "ananas"])
    text = "\nbanana\nbandana\nananas\n"
    code = {chr(c): i for i, c in enumerate(index.alphabet)}
    for pattern in ("ana", "ban", "a", "nd", "s\n", "\nan"):
        want = {m.start() for m in re.finditer(f"(?={re.escape(pattern)})", text)}
        for first in range(1, len(pattern)):  # letters from the middle to the left, then to the right
            iv = np.array([[0, index.n, 0]])
            for c in reversed(pattern[:first]):
                iv = index.step(iv, np.array([code[c]]), True)
            for c in pattern[first:]:
                iv = index.step(iv, np.array([code[c]]), False)
            assert {int(x) for x in index.order[iv[0, 0] : iv[0, 1]]} == want


def test_variants_equal_a_plain_version(spark):
    rng = random.Random(11)
    base = ["Thanering", "éçhelleaux", "straße÷x", "wondering", "abcdefghijklmnop", "reading", "short", "ÀÉÎÕÜÿÿ"]
    rows = []
    for i in range(400):
        text = " ".join(rng.choice(base) if rng.random() < 0.9 else rng.choice(base)[:-1] + rng.choice("xyz") for _ in range(20))
        rows.append((i, text.upper() if i % 50 == 0 else text, "fr"))
    rows += [(None, "thanering wondering", None), (7, None, None), (8, "", None), (7, "reading reading", None), (9, "a" * 3000 + " " + "a" * 3000 + " " + "a" * 2999 + " " + "a" * 2999, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(df).collect()}
    assert got == plain([r[:2] for r in rows])
    assert any(x[0] and x[1] != x[0] for x in got.values()) or any(x[0] for x in got.values())


def test_chains_of_forms_end_in_the_last(spark):
    counts = [("aaaaaaa", 3), ("aaaaaab", 40), ("aaaaabb", 500), ("aaaabbb", 6000)]
    text = " ".join(f"{w} " * n for w, n in counts)
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.variants(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    want = plain([(1, text)])
    assert got == {w: x[:2] for w, x in want.items()} and got["aaaaaaa"][1] == "aaaabbb"


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
