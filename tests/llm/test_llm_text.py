"""Dealt operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from plumbline.llm import components, line_dedup, mixing, near_dedup, piece_bpe, quality_ledger, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def odd(spark):
    """Nulls in any column, empty and very long texts, ties and repeated rows, clashing names."""
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    rows = [(1, None, "a"), (2, "", None), (3, " \n\t ", "a"), (None, "one two three", "b"), (5, long, "a"), (6, long, "a"), (7, "x", "b"), (7, "x", "b"), (8, "é " * 60, None)]
    df = frame(spark, rows)
    names = ["toxic_score", "lines_runs", "id", "leader", "u", "v", "words", "mix_pass", "whole", "cut", "fail_bits", "bands", "text_hash", "node"]
    return df, df.select("*", *[F.lit(1).alias(n) for n in names])


def near_copies(n, seed, words=80):
    r = random.Random(seed)
    base = [f"{r.choice('abcdefgh')}{r.randrange(4000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_ledger_boundaries_policies_and_ablation(spark):
    words = lambda n: " ".join(f"u{i}" for i in range(n))
    texts = [words(49), words(50), " ".join(["a b c"] * 30), words(60) + " " + "# " * 19, words(60) + "\n" + words(60), None, ""]
    rows = quality_ledger.judge(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    assert [r["base_failed"] for r in rows] == [True, False, True, False, True, True, True]
    assert rows[2]["n_repeat_words"] == 90 and rows[4]["n_dup_lines"] == 1 and rows[3]["n_symbols"] == 19
    assert [r["kept"] for r in rows][:2] == [False, True]
    ledger = quality_ledger.ledger(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    got = {r["rule"]: r for r in quality_ledger.ablation(ledger, quality_ledger.STRICT).collect()}
    kept = quality_ledger.apply_policy(ledger, quality_ledger.STRICT).where("kept").count()
    for rule in quality_ledger.BITS:
        without = quality_ledger.Policy("w", tuple(r for r in quality_ledger.BITS if r != rule))
        assert got[rule]["n_kept_without"] == quality_ledger.apply_policy(ledger, without).where("kept").count() >= kept


def test_components_long_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(5, 5), (None, 3), (1, 0)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)}


def compared(rows, percent=85, words=5):
    """component_id by doc_id, by comparing all pairs of string shingles."""
    sets = {}
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc_id] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    ids = sorted(i for i in sets if i is not None)
    out = {i: i for i in ids}
    linked = [(a, b) for a, b in combinations(ids, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            if out[a] != out[b]:
                out[a] = out[b] = min(out[a], out[b])
                changed = True
    return out


def test_buckets_with_several_groups_lose_no_link(spark, monkeypatch):
    """All documents in one bucket: chains whose ends are far from the centre, strangers, and a group of its own."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    r = random.Random(21)
    word = lambda: f"w{r.getrandbits(60)}"
    chains = []
    for _ in range(4):
        now = [word() for _ in range(120)]
        for _ in range(14):  # each a step from the one before, the last far from the first
            chains.append(list(now))
            at = r.randrange(110)
            now[at : at + 3] = [word() for _ in range(3)]
    chains += [[word() for _ in range(100)] for _ in range(15)]
    r.shuffle(chains)
    rows = [(i, " ".join(w)) for i, w in enumerate(chains)]
    want = compared(rows)
    df = frame(spark, [(i, t, "s") for i, t in rows])
    texts = df.select("doc_id", "text")
    member = spark.range(1, len(rows)).select("id", F.lit(1).cast("long").alias("bucket"), F.lit(0).cast("long").alias("leader"), F.lit(len(rows)).cast("long").alias("size"))
    edges = spark.createDataFrame([(0, i) for i in want if i and want[i] == 0 and i % 2], "u long, v long")
    found = components.components(edges)
    got = components.components(near_dedup._between(texts, near_dedup.signatures(df).withColumnRenamed("doc_id", "id"), member, found, 85).union(edges)).collect()
    assert {r["node"]: r["component"] for r in got} == {i: c for i, c in want.items() if list(want.values()).count(c) > 1}
    assert len(set(want.values())) > 15


def test_rows_that_share_a_doc_id_are_one_node(spark):
    a, b = near_copies(1, 5)[0], near_copies(1, 6)[0]
    got = near_dedup.near_duplicates(frame(spark, [(3, a, "s"), (7, a, "s"), (7, b, "s"), (9, b, "s"), (None, b, "s")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (3, 3, True), (7, 3, False), (7, 3, False), (9, 3, False)]


def test_large_groups_of_copies_are_dealt_to_several_tasks(spark):
    r = random.Random(31)
    base = [f"w{r.getrandbits(50)}" for _ in range(400)]
    rows = [(i, " ".join([*base[:200], f"x{i}", *base[200:]]), "s") for i in range(1500)] + [(2000 + i, " ".join(base), "s") for i in range(600)]
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert {x["component_id"] for x in got} == {0} and sum(x["kept"] for x in got) == 1


def test_near_duplicates_match_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    extra = near_copies(150, 1) + near_copies(60, 2, 40) + ["A b", "a B", "only one"] + near_copies(3, 3, 200) * 3
    rows += [(10_000 + i, t) for i, t in enumerate(extra)] + [(20_000, None), (20_001, "")]
    got = near_dedup.near_duplicates(frame(spark, [(i, t, "s") for i, t in rows])).collect()
    want = compared(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == len(rows)
    assert len({v for k, v in want.items() if k >= 10_000}) > 3


def test_near_stage_of_the_pipeline_drops_pairs_from_80_percent(spark):
    import corpus_pipeline

    r, rows = random.Random(80), []
    for n, changes in [(200, 4), (185, 4), (180, 3)] * 40:  # similarity 0.815, 0.801 and 0.843
        words = [f"w{r.getrandbits(60)}" for _ in range(n)]
        other = [f"v{r.getrandbits(60)}" if k % 40 == 20 and k // 40 < changes else w for k, w in enumerate(words)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    want = compared(rows, 80)
    assert all(want[i] == i - i % 2 for i in want) and set(compared(rows[:60], 85).values()) == set(range(60))
    kept = corpus_pipeline.near(spark, frame(spark, [(i, t, "s") for i, t in rows]), "")
    assert {x["doc_id"] for x in kept.collect()} == set(want.values())
    assert near_dedup.banding(85) == (20, 5) and near_dedup.sift(85) == 70
    assert (1 - 0.8 ** near_dedup.banding(80)[1]) ** near_dedup.banding(80)[0] < 1e-5


def without_later_runs(rows, min_words=50):
    """Texts by doc_id: every pair of places whose common lines have min_words words loses them at the later place."""
    docs = sorted((d, [(n, x.strip()) for n, x in enumerate(t.split("\n")) if x.split()], t) for d, t in rows)
    places = {}
    out = {}
    for d, lines, t in docs:
        dead = set()
        for s, (_, line) in enumerate(lines):
            for other, s0 in places.get(line, []):
                n = 0
                while s + n < len(lines) and s0 + n < len(other) and lines[s + n][1] == other[s0 + n][1]:
                    n += 1
                if sum(len(x.split()) for _, x in lines[s : s + n]) >= min_words:
                    dead |= set(range(s, s + n))
            places.setdefault(line, []).append((lines, s))
        # blank lines between two deleted lines go with them
        gone = {n for i in dead for n in range(lines[i][0], lines[i + 1][0] if i + 1 in dead else lines[i][0] + 1)}
        out[d] = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone)
    return out


def test_winnowing_selects_minima_of_windows():
    r = random.Random(8)
    for _ in range(200):
        words = [r.choice((1, 5, 20, 49, 50, 80)) for _ in range(r.randrange(1, 40))]
        hashes = [r.randrange(12) for _ in words]
        spans = line_dedup.windows(words, 50)
        want = {(s, e) for s in range(len(words)) for e in range(s, len(words)) if sum(words[s : e + 1]) >= 50 and (sum(words[s:e]) < 50 or sum(words[s + 1 : e + 1]) < 50)}
        assert set(spans) == want
        got = line_dedup.winnowed(hashes, spans)
        assert sorted(x for v in got.values() for x in v) == spans
        for at, some in got.items():
            assert all(s <= at <= e and hashes[at] == min(hashes[s : e + 1]) and at == max(i for i in range(s, e + 1) if hashes[i] == hashes[at]) for s, e in some)


def test_line_dedup_matches_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    r = random.Random(5)
    pool = [" ".join(f"p{r.randrange(900)}" for _ in range(n)) for n in (3, 7, 20, 30, 60, 55, 1, 25)]
    rows = [(d["doc_id"], d["text"]) for d in docs.collect()]
    rows += [(5000 + i, "\n".join(r.choice([*pool, f"own {i} {r.random()}", ""]) for _ in range(r.randrange(1, 14)))) for i in range(300)]
    df = frame(spark, [(i, t, "s") for i, t in rows])
    got = {d["doc_id"]: d["text"] for d in line_dedup.dedup_lines(df).collect()}
    want = without_later_runs(rows)
    assert got == want and sum(got[i] != t for i, t in rows) > 30
    selected = line_dedup.fingerprints(df).select(F.count("*").alias("n"), F.sum(F.size("digests")).alias("windows")).first()
    assert selected["n"] < selected["windows"]


def test_frequent_passages_are_dealt_to_several_tasks(spark):
    passage = [" ".join(f"v{j}x{i}" for i in range(30)) for j in range(3)]
    rows = [(i, "\n".join([f"own {i}", *passage, f"end {i}"]), "s") for i in range(2500)]
    got = {d["doc_id"]: d["text"] for d in line_dedup.dedup_lines(frame(spark, rows).repartition(16)).collect()}
    assert got == {i: t if i == 0 else f"own {i}\nend {i}" for i, t, _ in rows}


def test_line_dedup_leaves_short_repeats_and_first_copies(spark):
    passage = " ".join(f"q{i}" for i in range(51))
    rows = [(1, f"a\n{passage}\nb"), (2, f"c\n{passage}\nb\nd"), (3, "a\nb"), (4, passage)]
    got = line_dedup.dedup_lines(frame(spark, [(i, t, "s") for i, t in rows]), drop_emptied=True)
    assert {d["doc_id"]: d["text"] for d in got.collect()} == {1: rows[0][1], 2: "c\nd", 3: "a\nb"}


def kneser_ney(docs, labels):
    """log p(word | previous) of both classes by plain dictionaries, for words of the model's vocabulary."""
    d, pairs = 0.75, [{}, {}]
    for words, y in zip(docs, labels):
        for v, w in zip(["", *words[:-1]], words):
            pairs[y][v, w] = pairs[y].get((v, w), 0) + 1
    vocabulary = {"", *(w for words in docs for w in words)}
    both = {}
    for v, w in {*pairs[0], *pairs[1]}:
        both[w] = both.get(w, 0) + 1
    total = sum(both.get(w, 0) + 0.5 for w in vocabulary)

    def log_p(y, v, w):
        before = sum(1 for _, x in pairs[y] if x == w)
        kinds = len({x for _, x in pairs[y]})
        after = (max(before - d, 0) + d * max(kinds, 1) * (both.get(w, 0) + 0.5) / total) / max(len(pairs[y]), 1)
        follow = {x: n for (u, x), n in pairs[y].items() if u == v}
        if not follow:
            return math.log(after)
        count = follow.get(w, 0)
        spread = sum(d if n > 1 else 1 for n in follow.values())
        return math.log(((count - d if count > 1 else 0) + spread * after) / sum(follow.values()))

    return log_p


def test_likelihoods_equal_those_of_plain_dictionaries():
    r = random.Random(12)
    words = ["ann", "bob", "cat", "dog", "eel"]
    docs = [[r.choice(words[: 4 + i % 2]) for _ in range(r.randrange(3, 12))] for i in range(40)]
    labels = [i % 2 for i in range(40)]
    model, log_p = toxicity.KneserNey(docs, toxicity.np.array(labels)), kneser_ney(docs, labels)
    assert model.size == len(words) + 1
    for text in (["ann", "bob", "bob"], ["eel", "eel", "dog", "cat", "ann"]):
        pairs, _ = model.evidence(text)
        want = [log_p(1, v, w) - log_p(0, v, w) for v, w in zip(["", *text[:-1]], text)]
        assert list(pairs) == pytest.approx(want)


def test_columns_of_the_operators_names_are_kept(spark):
    rows = [(i, " ".join(f"w{i * j}" for j in range(60)), "s") for i in range(40)]
    df = frame(spark, rows).select("*", *[F.lit(7).alias(n) for n in ("toxic_score", "gone_id", "mix_source", "lines_own", "lang_crf", "spread_key", "node")])
    model = toxicity.fit(df, df.select("doc_id", (F.col("doc_id") % 2).alias("toxic")))
    for got in (toxicity.without_toxic(df, model, 2.0), near_dedup.drop_near_duplicates(df), line_dedup.dedup_lines(df).drop("lines_runs"), mixing.mix(df).select(*df.columns)):
        assert got.columns == df.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.query(docs, labels).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
    ranks = rows["score"].rank()
    pos, neg = (rows["toxic"] == 1).sum(), (rows["toxic"] == 0).sum()
    auc = (ranks[rows["toxic"] == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)
    precision = rows[rows["predicted"] == 1]["toxic"].mean()
    assert auc > 0.85 and precision > 0.9, (auc, precision)


def test_toxicity_without_labels(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.query(docs, none).agg(F.max("score")).first()[0] == 0


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_path())


def test_codec_equals_the_library(library):
    codec = piece_bpe.Codec(piece_bpe.load_vocabulary(piece_bpe.default_path()))
    r = random.Random(11)
    letters = "aaeeiittnnsshhrrdlou     \n▁éüßñ.,-0123456789\x00<>\t日本語😀𝔘ABCDE"
    texts = ["", " ", "  a ", "▁", " ▁a", "<s>", "<0x0A>", "\n\n x", "a" * 3000, "the" * 500, "   " * 50, "‍�", "hello world " * 3]
    texts += ["".join(r.choice(letters) for _ in range(r.randrange(1, 60))) for _ in range(4000)]
    texts += [" ".join("".join(r.choice("aeitn\n\x00é") for _ in range(r.randrange(1, 5))) for _ in range(9)) + r.choice(["", " ", "\n"]) for _ in range(2000)]
    texts += ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300)) for _ in range(200)]
    for t in texts:
        ids = library.encode(t)
        assert codec.encode(t) == ids, t
        assert codec.decode(ids) == library.decode(ids), t
        want = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        assert codec.digest(t) == (len(ids), *want), t


def test_decode_of_broken_bytes(library):
    codec = piece_bpe.Codec(piece_bpe.load_vocabulary(piece_bpe.default_path()))
    for ids in ([200, 300], [228, 187, 300, 12], [259, 259], [28705, 228], [230, 151], [243, 160, 151, 155, 155]):
        assert codec.decode(ids) == library.decode(ids), ids


def test_digests_over_documents(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in piece_bpe.query(docs).collect():
        ids = library.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_encode_then_decode(spark, library):
    df = frame(spark, [(1, "Hello  world", "s"), (2, None, "s"), (3, "", "s")])
    rows = piece_bpe.decode(piece_bpe.encode(df, piece_bpe.default_path()), piece_bpe.default_path()).orderBy("doc_id").collect()
    assert [r["piece_text"] for r in rows] == ["Hello  world", "", ""] and rows[0]["piece_ids"] == library.encode("Hello  world")


def mix_rows():
    return [(i, "w " * (1 + i % 5), "hot" if i % 3 else f"s{i % 4}") for i in range(300)]


def test_words_are_counted_as_runs(spark):
    texts = [None, "", " ", "a", " a", "a ", "a  b\tc\n\x0bd\x1ce\x85f", "\u00a0", "x" * 5000 + " y"]
    got = frame(spark, [(i, t, "s") for i, t in enumerate(texts)]).select("doc_id", mixing.n_tokens(F.col("text")).alias("n")).orderBy("doc_id").collect()
    assert [r["n"] for r in got] == [len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for t in texts]


def test_mixing_limit_and_entropy(spark):
    ledger = mixing.counted(frame(spark, mix_rows()))
    p = {r["source"]: r for r in mixing.plan(ledger, repetition_limit=2.0).collect()}
    assert max(r["passes"] for r in p.values()) == pytest.approx(2, abs=1e-6) and p["hot"]["passes"] == 1
    assert abs(sum(r["weight"] for r in p.values()) - 1) < 1e-9
    for target in (0.9, 0.8):
        w = [r["weight"] for r in mixing.plan(ledger, target_entropy=target, repetition_limit=None).collect()]
        assert -sum(x * math.log(x) for x in w) / math.log(len(w)) == pytest.approx(target, abs=1e-6)
    # the exponent against plain bisection, with a budget
    t = {r["source"]: r["tokens"] for r in mixing.source_totals(ledger).collect()}
    low, high, budget = 0.0, 1.0, 0.7 * sum(t.values())
    for _ in range(40):
        tau = (low + high) / 2
        z = sum((n / max(t.values())) ** tau for n in t.values())
        low, high = (low, tau) if max(budget * (n / max(t.values())) ** tau / z / n for n in t.values()) <= 1.2 * (1 + 1e-12) else (tau, high)
    assert mixing.solve_exponent(mixing.source_totals(ledger), repetition_limit=1.2, budget=budget) == pytest.approx(high, abs=1e-11)


@pytest.mark.parametrize("budget", [0.5, 3.2])
def test_mixing_deals_a_budget_into_permuted_blocks(spark, monkeypatch, budget):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 100)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 16)
    df = frame(spark, mix_rows()).withColumn("mix_source", F.lit(1))
    ledger = mixing.counted(df)
    total = sum(1 + i % 5 for i in range(300))
    plan = {r["source"]: r for r in mixing.plan(ledger, repetition_limit=9.0, budget=total * budget).collect()}
    got = mixing.mix(df, repetition_limit=9.0, budget=total * budget).withColumn("n", mixing.n_tokens(F.col("text"))).collect()
    words = {i: (len(t.split()), s) for i, t, s in mix_rows()}
    key = lambda d, p: hashlib.md5(f"7:{p}:{d}".encode()).hexdigest()
    want = []
    for s, r in plan.items():
        ids, left = [d for d, (_, x) in words.items() if x == s], total * budget * r["weight"]
        for p in range(1, 20):
            for d in sorted(ids, key=lambda d: key(d, p)):
                if left > 1e-6:
                    want.append((d, p))
                    left -= words[d][0]
        assert 0 <= sum(x["n"] for x in got if x["source"] == s) - total * budget * r["weight"] < 6
    assert sorted((r["doc_id"], r["mix_pass"]) for r in got) == sorted(want)
    blocks = {}
    for r in got:
        blocks.setdefault(r["mix_block"], []).append(r)
    assert sorted(blocks) == list(range(len(blocks))) and len(blocks) == math.ceil(total * budget / 100)
    for rows in blocks.values():
        rows.sort(key=lambda r: r["mix_place"])
        assert [r["mix_place"] for r in rows] == list(range(1, len(rows) + 1)) and [r["mix_key"] for r in rows] == sorted(key(r["doc_id"], r["mix_pass"]) for r in rows)
    share = {k: sum(r["n"] for r in rows if r["source"] == "hot") / sum(r["n"] for r in rows) for k, rows in blocks.items()}
    assert abs(sum(share.values()) / len(share) - plan["hot"]["weight"]) < 0.1


def test_mixing_keeps_every_document_by_default(spark):
    df = frame(spark, mix_rows())
    assert mixing.mix(df).select("doc_id").distinct().count() == 300


@pytest.mark.parametrize("apply", [
    lambda d: quality_ledger.query(d), lambda d: near_dedup.query(d), lambda d: line_dedup.query(d), lambda d: mixing.query(d), lambda d: piece_bpe.query(d),
    lambda d: toxicity.query(d, d.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))),
])
def test_odd_rows(spark, apply):
    plain, wide = odd(spark)
    a, b = apply(plain), apply(wide)
    key = lambda rows: sorted(map(str, rows))
    assert key(a.collect()) == key(b.collect())
    assert a.count() >= plain.count()
    assert apply(plain.limit(0)).count() == 0


def test_odd_rows_near_dedup_and_lines(spark):
    plain, _ = odd(spark)
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.query(plain).collect()}
    assert {(5, 5, True), (6, 5, False), (None, None, True), (7, 7, True), (1, 1, True)} <= got
    texts = [(r["doc_id"], r["text"]) for r in line_dedup.query(plain).collect()]
    assert (6, "") in texts and texts.count((7, "x")) == 2 and (1, None) in texts


def test_frequent_words_are_encoded_once(monkeypatch):
    """Words that don't recur push those that do out of what a worker keeps only when these haven't been asked for."""
    monkeypatch.setattr(piece_bpe, "CACHE", 60)
    codec = piece_bpe.Codec(piece_bpe.load_vocabulary(piece_bpe.default_path()))
    made, word = [], codec.word
    monkeypatch.setattr(codec, "word", lambda w: made.append(w) or word(w))
    for i in range(100):
        codec.digest(f"often {' '.join(f'w{i}x{k}' for k in range(9))}")
    assert made.count("▁often") == 1 and len(made) == 901


def test_workers_give_arrows_memory_back(monkeypatch):
    from plumbline.llm import common

    asked = []
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: type("Pool", (), {"release_unused": lambda self: asked.append(1)})())
    common.give_back()
    assert asked == [1]
