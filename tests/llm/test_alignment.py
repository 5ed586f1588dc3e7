"""Token alignment against a plain alignment of whole texts."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from plumbline.llm import token_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "\n", "a", " a ", "foo  bar", "foo \n bar\n\nbaz \n", "tab\tand hard space ", "a▁b c", "<|endoftext|> <s> </s> <unk> <0x41>",
    "中文没有空格的句子。" * 30, "emoji 👩‍👩‍👧 and é é \u0000 nul", "x" * 700 + " y", "a\x1c b\x1f\nc", "\r\n\r\nline\r\n", "\ta\n\tb", "Don't  we're\n 'll 12345 $$$ ---\n", "﻿bom", "word\u0085next \u0085 \n",
]


def tokens(text):
    """Whole-text ids and byte ends of both, or None."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not text:
        return None
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = {chr(x): x for x in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    for x in range(256):
        if x not in shown.values():
            shown[chr(256 + len([c for c in shown if ord(c) >= 256]))] = x
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw_a = [bytes(shown[c] for c in a.id_to_token(i)) for i in ids_a]
    raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    raw = (" " + text).encode()
    return (ids_a, raw_a, ids_b, raw_b) if b"".join(raw_a) == raw == b"".join(raw_b) else None


def plain(texts):
    groups, links = [], []
    for text in texts:
        found, out, pairs = tokens(text), [], []
        if found:
            ends = []
            for ids, raw in (found[:2], found[2:]):
                at, here = 0, {}
                for i, r in zip(ids, raw):
                    at += len(r)
                    here[at] = i
                ends.append((here, at))
            common = sorted(ends[0][0].keys() & ends[1][0].keys())
            last = 0
            for end in common:
                out.append("|".join(",".join(str(i) for e, i in here.items() if last < e <= end) for here, _ in ends))
                pairs.append((ends[0][0][end], ends[1][0][end]))
                last = end
        groups.append((found, out))
        links.append(pairs)
    count = Counter(p for x in links for p in x)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return [
        (len(f[0]) if f else 0, len(f[2]) if f else 0, len(g), len(p), sum(count[x] == most[x[1]] for x in p), sum(count[x] for x in p), hashlib.sha256(";".join(g).encode()).hexdigest() if f else "")
        for (f, g), p in zip(groups, links)
    ]


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    bits = ["the", "tion", "Ärger", "été", " ", "  ", "\n", "\t", " ", "123", "...", "$$", "👍", "中", "'s", "é", "\r", "x" * 40, " a", "\n\n"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [7, 64, ta.CHUNK])
def test_alignment_equals_whole_texts(spark, chunk):
    texts = ODD + odd_texts(60)
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = {r["doc_id"]: r for r in ta.align(df, A, B, chunk, keep_groups=True).collect()}
    for (i, text, _), want in zip(rows, plain(texts)):
        r = got[i]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) == want, repr(text)
        assert r["groups_sha256"] == (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "")


def test_composition_is_associative():
    import numpy as np

    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(2, 20)
        cut_a, cut_b = (np.array(sorted({n, *rng.sample(range(1, n + 1), rng.randint(1, n))})) for _ in "ab")
        a, b = [rng.randint(0, 99) for _ in cut_a], [rng.randint(0, 99) for _ in cut_b]
        bounds = [0, *sorted(rng.sample(range(1, n), rng.randint(0, n - 1))), n]
        parts = []
        for low, high in zip(bounds, bounds[1:]):
            in_a, in_b = (cut_a > low) & (cut_a <= high), (cut_b > low) & (cut_b <= high)
            parts.append(ta.fragment(np.array(a)[in_a].tolist(), cut_a[in_a], np.array(b)[in_b].tolist(), cut_b[in_b])[0])
        whole = ta.fragment(a, cut_a, b, cut_b)[0]
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            parts[i : i + 2] = [ta.compose(parts[i : i + 2])]
        assert ta.compose(parts) == whole


def test_ranges_lie_anywhere_and_touch_a_unit_twice_at_most():
    text = " ".join("word" * (i % 7) + "é" for i in range(400)) + " " + "z" * 500
    for chunk in (5, 16, 100):
        parts = ta.cut(text, chunk)
        assert sum(high - low for _, low, high in parts) == len((" " + text).encode())
        assert sum(len(p) for p, _, _ in parts) <= 2 * len(text) + 2
    assert any(low > 0 for _, low, _ in ta.cut(text, 16))


def test_pairs_are_suffixes(spark):
    pair = ta.Pair(A, B)
    assert pair.most_pairs() < 1_000_000
    for unit in (" thanering", " été", "\n中文"):
        ((a, b),) = pair.ids([unit])
        a_ends, b_ends = pair.ends(a, b)
        for x, y in ta.fragment(a, a_ends, b, b_ends)[1]:
            short, long = sorted((pair.bytes_a[x], pair.bytes_b[y]), key=len)
            assert long.endswith(short)


def test_empty_table_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert ta.align(spark.createDataFrame([], schema), A, B).collect() == []
    rows = ta.align(spark.createDataFrame([(None, "two words"), (1, "two words"), (1, "two words"), (1, None)], schema), A, B).collect()
    assert len(rows) == 4 and {r["n_links"] for r in rows} == {0, 2} and {r["count_sum"] for r in rows} == {0, 6}


def test_workers_keep_no_tables_for_stages_that_do_not_encode():
    import pandas as pd

    text = "Some words, cut anywhere. " * 40
    parts = pd.DataFrame([(0, 1, no, *part) for no, part in enumerate(ta.cut(text, 64))], columns=["key", "doc_id", "no", "part", "low", "high"])
    (found,) = ta._ranges(A, B)(iter([parts]))
    pair = ta.pair_of(A, B)
    assert not pair.known and not pair.older and not pair.void
    whole = ta._composed(found.drop(columns="links").assign(n_best=0, count_sum=0))
    assert whole["n_b"][0] == len(tokens(text)[2]) and ta.pair_of.cache_info().currsize == 0
    assert ta.pair_of(A, B) is not pair  # made again for tasks that encode


def test_few_texts_go_into_python_at_a_time(spark, monkeypatch):
    sizes = spark.sparkContext.accumulator(0)
    short = ta._short

    def watched(*args):
        def run(batches):
            def seen():
                for b in batches:
                    sizes.add(b.num_rows > ta.ROWS)
                    yield b

            return short(*args)(seen())

        return run

    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    monkeypatch.setattr(ta, "_short", watched)
    before = spark.conf.get(conf)
    got = ta.query(spark.range(0, 1300, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), "id").alias("text")))
    assert got.count() == 1300 and sizes.value == 0 and spark.conf.get(conf) == before
