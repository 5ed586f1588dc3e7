"""Operators that are jobs of their own: postings in blocks, array parts, dialects, keyed upserts, state, lifetimes, flows, windows."""

import datetime as dt
import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import attribution, cost, generic_probes, intervals, places, postings, probes, retrieval
from plumbline.sources import arrays, io
from plumbline.streaming import streams

DAY = dt.date(2024, 1, 1)


def words(rng, n, size=60):
    return " ".join(f"w{rng.randrange(size)}{'s' * rng.randrange(2)}ter" for _ in range(n))


def chunked(spark, n=1500, seed=1):
    rng = random.Random(seed)
    rows = [(i // 3, i % 3 + 1, f"head {words(rng, 2)}", words(rng, rng.randint(1, 30)) + f"\nTotal sales\n{i} | label {i % 9}", i % 3 == 0 and i % 2 == 0) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id int, chunk_no long, header string, text string, is_preamble boolean")


ODD = ["", None, "第十二条 董事会 Ratios ladies boxes gas", "İstanbul KELVIN K", "a|b | Net sales | 营业收入\n- x", "tabs\tand\x0blines\x85next end", "İ ß ǅ ﬁ"]


def test_tokens_of_a_text_equal_those_of_a_column(spark):
    rows = [(i, t, f"Head {i}") for i, t in enumerate(ODD)]
    for r in spark.createDataFrame(rows, "i int, t string, h string").select("t", "h", retrieval.tokens(F.col("t")).alias("a"), retrieval.field_tokens(F.col("h"), F.col("t")).alias("f")).collect():
        assert postings.tokens(r["t"]) == r["a"]
        assert postings.field_tokens(r["h"], r["t"]) == r["f"]


@pytest.mark.parametrize("sent", [postings.SENT, 4])
def test_best_units_equal_all_scores_in_order(spark, sent, monkeypatch):
    rng = random.Random(3)
    units = postings.units(chunked(spark))
    queries = spark.createDataFrame([(q, words(rng, 6) + (" nothing known" if q == 4 else "")) for q in range(12)] + [(99, "zzz")], "query_id int, text string")
    named = spark.createDataFrame([(q, d) for q in (2, 5) for d in range(q, 400, 7)], "query_id int, doc_id int")
    monkeypatch.setattr(postings, "SENT", sent)  # of 4, queries go in groups and documents are joined
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["chunk_no"], r["score"]) for r in postings.top_units(postings.index(units), queries, 7, named, units).collect()}
    scores = retrieval.bm25(units, queries).collect()
    inside = {(r["query_id"], r["doc_id"]) for r in named.collect()}
    want = {}
    for q in {r["query_id"] for r in scores}:
        mine = sorted((-round(r["score"], 6), r["doc_id"], r["chunk_no"]) for r in scores if r["query_id"] == q and (q not in (2, 5) or (q, r["doc_id"]) in inside))
        want |= {(q, i + 1): (d, c, -s) for i, (s, d, c) in enumerate(mine[:7])}
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert all(got[k][2] == pytest.approx(want[k][2], abs=2e-6) for k in want)


def test_blocks_that_cannot_reach_the_kth_score_are_skipped():
    rng = random.Random(5)
    blocks = []
    for b in range(40):
        texts = [["common"] * rng.randint(1, 3) + [f"x{rng.randrange(50)}"] + (["rare"] if b == 7 and u < 5 else []) for u in range(64)]
        held = {}
        for u, text in enumerate(texts):
            for token, n in Counter(text).items():
                held.setdefault(token, []).append((u, n))
        names = sorted(held)
        part = [float(postings.share(np.array(n), np.array(len(texts[u])), 3.0)) for t in names for u, n in held[t]]
        starts = np.cumsum([0, *[len(held[t]) for t in names]])
        block = {"docs": np.arange(64) + 64 * b, "chunks": np.ones(64, int)}
        for c in postings.CHANNELS:
            block |= {f"{c}_tokens": names if c == "body" else [], f"{c}_starts": starts, f"{c}_at": np.array([u for t in names for u, _ in held[t]]), f"{c}_part": np.array(part), f"{c}_largest": np.maximum.reduceat(part, starts[:-1])}
        blocks.append(block)
    wanted = {("body", "common"): (np.array([0]), np.array([0.1])), ("body", "rare"): (np.array([0]), np.array([5.0]))}
    lazy, all_of = postings.Search(1, wanted, 5, {}), postings.Search(1, wanted, 5, {})
    for block in sorted(blocks, key=lambda x: -lazy.bound(x)[0].max()):
        lazy.add(block)
    for block in blocks:
        all_of.floor[:] = -np.inf
        all_of.add(block)
    assert lazy.best == all_of.best and lazy.skipped == 39 and all_of.skipped == 0


def test_nearest_vectors_in_groups_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)] + [(90, [0.0] * 4), (91, None)]
    vectors, queries = spark.createDataFrame(v, "id int, v array<double>"), spark.createDataFrame([v[0], v[7], (90, [0.0] * 4)], "query_id int, q array<double>")
    monkeypatch.setattr(retrieval, "AT_ONCE", 1)
    got = {(r["query_id"], r["rank"]): r["id"] for r in retrieval.cosine(vectors, queries, 5).collect()}
    unit = {i: np.array(x) / np.linalg.norm(x) for i, x in v[:60]}
    want = {(q, n + 1): i for q in (0, 7) for n, i in enumerate(sorted(unit, key=lambda i: (-round(float(unit[i] @ unit[q]), 6), i))[:5])}
    assert got == want
    assert retrieval.cosine(vectors, queries.limit(0), 5).count() == 0


def test_recall_takes_every_k_from_the_least_rank(spark):
    contexts = spark.createDataFrame([(1, 1, "Revenue was $1,577.00 in"), (1, 5, "fiscal year two"), (2, 1, "nothing"), (3, 9, "net\n income  rose")], "q_id int, rank int, text string")
    evidence = spark.createDataFrame([(1, "revenue fiscal year 9", "1577.00"), (2, "", None), (3, "net x", "Net Income"), (4, "a", "b")], "q_id int, text string, answer string")
    got = {(r["q_id"], r["k"]): (r["coverage"], r["hit"], r["answered"]) for r in retrieval.recall(evidence, contexts, threshold=0.75).collect()}
    assert got[1, 4] == (0.25, False, True) and got[1, 8] == (0.75, True, True)
    assert got[2, 16] == (0.0, False, None)
    assert got[3, 8] == (0.0, False, False) and got[3, 16] == (0.5, False, True)
    assert not any(q == 4 for q, _ in got)


def test_citations_and_facts(spark):
    reply = "依据【strict_csrc_035 · 第八十二条】第（三）项, 条款 3.2 与第四十七条 and 【x】"
    c = spark.range(1).select(retrieval.citations(F.lit(reply)).alias("c")).first()["c"]
    assert c == ["strict_csrc_035 · 第八十二条", "x", "第四十七条", "3.2"]

    def used(cited, units):
        a = spark.createDataFrame([(1, x) for x in cited], "q_id int, citation string")
        b = spark.createDataFrame([(1, i, *u) for i, u in enumerate(units)], "q_id int, rank int, doc_id string, header string")
        return {r["rank"] for r in retrieval.match_citations(a, b).collect()}

    assert used(["第八十条", "第六条"], [("a", "第四十七条"), ("a", "第八十条")]) == {1}
    assert used(["strict_035·第四十七条"], [("strict_035", "第 四十七条"), ("other", "第四十七条")]) == {0}
    assert used(["第六条"], [("a", "第六条"), ("b", "第六条"), ("b", "第七条")]) == {0, 1}
    assert used(["a · "], [("a", "h")]) == set()
    facts = spark.createDataFrame([(1, "【036 · 第六条】独立性\n 【035·第四十七条·x】担保\n无前缀的行\n【a|b】")], "q_id int, text string")
    rows = [(r["doc_id"], r["header"], r["chars"]) for r in retrieval.fact_lines(facts).orderBy("line_no").collect()]
    assert rows == [("036", "第六条", 14), ("035", "第四十七条·x", 16), (None, None, 5), (None, None, 5)]
    flags = spark.createDataFrame([("第十二条", "a"), ("第十二条 x", "a"), ("h", "1" + "a" * 24), ("h", "1" + "a" * 25), ("h", "")], "h string, t string").select(retrieval.is_verbatim(F.col("h"), F.col("t")).alias("v"))
    assert [r["v"] for r in flags.collect()] == [True, False, True, False, False]


# ---- cost


def compacted(spark, tool, payload, cap, policy="cap", code="ok"):
    calls = spark.createDataFrame([(1, 1, 1, tool, payload, code, policy)], "task int, turn int, call int, tool string, payload string, result_code string, policy string")
    return cost.compact(calls, spark.createDataFrame([(tool, cap)] if cap else [], "tool string, cap int")).first()


def test_parts_beyond_a_cap_become_one_line(spark):
    many = "\n".join(f"src/mod{i:02d}.py" for i in range(40))
    r = compacted(spark, "list_files", many, 2)
    assert r["text"].startswith("src/mod00.py\nsrc/mod01.py\n") and "src/mod02.py" not in r["text"] and f"-- 38 path ({38 * 12} chars omitted) --" in r["text"]
    assert (r["n_segments"], r["n_kept"], r["n_mapped"], r["applied"]) == (40, 2, 40, True) and r["text"].count("omitted") == 1
    two = compacted(spark, "list_files", "src/a.py\nsrc/b.py", 1)
    assert two["text"] == "src/a.py\nsrc/b.py" and not two["applied"]
    body = "".join(f"def f{i}():\n    x{i} = {i}\n\n\n" for i in range(20))
    r = compacted(spark, "read_file", f"```python\n{body}\n```", 3)
    assert r["text"].startswith("```python\n") and r["text"].rstrip().endswith("```") and "def f2()" in r["text"] and "def f5()" not in r["text"] and r["applied"]
    for code in ("error", "not_found"):
        assert compacted(spark, "list_files", many, 2, code=code)["text"] == many
    assert not compacted(spark, "list_files", many, 0)["applied"]


def test_kinds_left_out_get_lines_of_their_own():
    parts = [{"kind": k, "text": t} for k, t in (("a", "one"), ("b", "two"), ("b", "three"), ("c", "four"), ("a", "gone"))]
    text, kept, mapped = cost._without("<one> two, three; four.", parts, 1)
    assert text == "<one> , ; -- 2 b (8 chars omitted) --\n-- 1 c (4 chars omitted) --\n." and (kept, mapped) == (1, 4)
    assert cost._without("same same", [{"kind": "a", "text": "same"}, {"kind": "a", "text": "same"}], 1) == ("same -- 1 a (4 chars omitted) --\n", 1, 2)


def test_head_and_hint(spark):
    long = "x" * 700
    assert compacted(spark, "web", long, 0, "head")["text"] == "x" * 500 + "\n... 200 chars omitted (kept the first 500 of 700) ...\n"
    assert compacted(spark, "web", "short", 0, "head")["text"] == "short"
    hint = compacted(spark, "list_files", "a.py\nb.py", 0, "hint")
    assert hint["text"] == "list_files: ok, 9 chars, 2 items (content omitted; call again with a narrower argument if needed)" and hint["applied"] and hint["n_segments"] == 2


def test_a_task_of_many_turns_has_a_row_for_each_token(spark):
    n = 10_000
    texts = spark.range(n).select(F.lit(1).alias("task"), F.col("id").cast("int").alias("turn"), F.concat(F.lit("always_here turn_"), F.format_string("%05d", "id"), F.lit(" half_"), F.format_string("%05d", F.floor(F.col("id") / 2))).alias("text"))
    lives = cost.lifetimes(texts)
    total = 1 + n + n // 2 + n  # the numbers in them are tokens too
    assert lives.count() == total
    sizes = {r["turn"]: (r["before"], r["after"]) for r in cost.context_sizes(texts, lives).where("turn in (0, 1, 9999)").collect()}
    assert sizes == {0: (0, total - 1), 1: (4, total - 4), 9999: (total - 2, 0)}


def test_tokens_within_texts_equal_a_search(spark):
    rng = random.Random(2)
    tokens = [(rng.randrange(3), "".join(rng.choice("abc_") for _ in range(rng.randint(5, 9)))) for _ in range(120)]
    texts = [(rng.randrange(3), i, "".join(rng.choice("abc_ ") for _ in range(rng.randint(0, 200))), f"t{i % 4}") for i in range(150)]
    found = cost.tokens_in(spark.createDataFrame(tokens, "task int, token string"), spark.createDataFrame(texts, "task int, id int, text string, to_tool string"))
    got = Counter((r["task"], r["token"], r["id"]) for r in found.collect())
    assert got == Counter({(a, t, i) for a, t in tokens for b, i, x, _ in texts if a == b and t in x}) and got


def test_flow_is_by_substring_and_samples_are_the_first(spark):
    parts = spark.createDataFrame([(1, 1, 1, "find", 0, "hit", "alpha_one beta_two tiny"), (1, 1, 1, "find", 1, "hit", "gamma_three"), (1, 3, 1, "find", 0, "hit", "alpha_one")], "task int, turn int, call int, tool string, seg int, kind string, text string")
    calls = spark.createDataFrame([(1, 1, 1, "find", "alpha_one"), (1, 2, 1, "read", '{"p": "src/ALPHA_ONE.py"}'), (1, 3, 1, "read", "xgamma_threex beta"), (2, 9, 1, "read", "beta_two")], "task int, turn int, call int, tool string, args string")
    got = [(r["from_tool"], r["to_tool"], r["token_hits"], r["segments"], r["samples"]) for r in cost.tool_flow(parts, calls).collect()]
    assert got == [("find", "read", 2, 2, ["alpha_one", "gamma_three"])]


def test_flow_counts_all_tokens_of_a_part(spark):
    text = " ".join(f"token_{i:04}" for i in range(1000))  # numbers of four digits tell nothing
    parts = spark.createDataFrame([(1, 1, 1, "find", 0, "hit", text)], "task int, turn int, call int, tool string, seg int, kind string, text string")
    calls = spark.createDataFrame([(1, 2, 2, "read", text)], "task int, turn int, call int, tool string, args string")
    r = cost.tool_flow(parts, calls).first()
    assert (r["token_hits"], r["segments"], r["samples"]) == (1000, 1, [f"token_{i:04}" for i in range(8)])


def test_paired_p_and_resolution(spark):
    a = spark.createDataFrame([(i, 10) for i in range(6)], "task int, v int")
    b = spark.createDataFrame([(i, 9 if i < 5 else 11) for i in range(6)], "task int, v int")
    r = cost.paired(a, b, "v").first()
    assert r["p"] == pytest.approx(14 / 64) and r["p_one_sided"] == pytest.approx(7 / 64) and r["resolution"] == pytest.approx(2 / 64)
    same = cost.paired(a, a, "v").first()
    assert (same["p"], same["p_one_sided"], same["resolution"]) == (1.0, 1.0, 1.0)
    other = cost.paired(b, a, "v").first()
    assert other["p_one_sided"] == pytest.approx(63 / 64)


def test_offered_list_is_told_by_its_length(spark):
    lists = {"a": ['{"name": "x"}', '{"name": "yy"}'], "b": ['{"name": "x"}']}
    rows = [(n, json.loads(d)["name"], i, d) for n, ds in lists.items() for i, d in enumerate(ds)]
    size = len(json.dumps([json.loads(d) for d in lists["a"]]))
    turns = spark.createDataFrame([(1, 1, size), (1, 2, size)], "task int, turn int, tools_chars long")
    of = cost.offered(spark.createDataFrame(rows, "name string, tool string, pos int, definition string"), turns)
    assert {r["tool"] for r in of.collect()} == {"x", "yy"}
    r = cost.uncalled_tools(of, spark.createDataFrame([("x",)], "tool string"), turns).first()
    assert (r["tools"], r["names"], r["saving"]) == (1, "yy", 2 * len(lists["a"][1]))


# ---- intervals and windows


def test_each_overlap_is_reported_once(spark):
    rng = random.Random(7)
    span = lambda: (lambda a, n: (DAY + dt.timedelta(a), DAY + dt.timedelta(a + n)))(rng.randrange(2000), rng.choice((0, 1, 31, 32, 400, -1)))
    a = [(i, "hot" if i % 4 else "b", *span()) for i in range(150)]
    b = [(i, "hot" if i % 5 else "c", *span()) for i in range(150)]
    x = spark.createDataFrame(a, "i int, s string, lo date, hi date")
    y = spark.createDataFrame(b, "j int, r string, l date, h date")
    got = Counter((r["i"], r["j"]) for r in intervals.overlapping(x, y, {"s": "r"}, ("lo", "hi"), ("l", "h")).collect())
    assert got == Counter((p[0], q[0]) for p in a for q in b if p[1] == q[1] and p[2] <= p[3] and q[2] <= q[3] and p[2] <= q[3] and q[2] <= p[3])


@pytest.mark.parametrize("sent", [attribution.SENT, 3])
def test_counts_by_window_equal_plain_ratios(spark, sent, monkeypatch):
    rng = random.Random(4)
    rows = [(f"E{e}", DAY + dt.timedelta(d), None if rng.random() < 0.05 else rng.choice((0.0, 10.0, 10.0 * rng.random(), 90.0 * (d > 60)))) for e in range(9) for d in range(90) if rng.random() < 0.9]
    sector = {f"E{e}": ("s1", "s2", "")[e % 3] for e in range(8)}
    windows = [(f"E{i % 9}", DAY + dt.timedelta(a), DAY + dt.timedelta(a + n)) for i, (a, n) in enumerate([(60, 10), (61, 3), (40, 1), (0, 5), (70, 19), (95, 3)])]
    findings = spark.createDataFrame([("p", "t", s, "m", a, b) for s, a, b in windows], "probe string, table_name string, symbol string, metric string, start date, end date")
    series = spark.createDataFrame(rows, "symbol string, date date, volume double")
    monkeypatch.setattr(attribution, "SENT", sent)
    got = {r["symbol"]: (r["n"], r["n_ge2"], r["n_ge5"], r["sector_peers"]) for r in attribution.co_movement(findings, series, spark.createDataFrame(list(sector.items()), "symbol string, sector string")).collect()}

    def ratio(e, a, b):
        mine = sorted((d, v) for s, d, v in rows if s == e)
        i = next((k for k, (d, _) in enumerate(mine) if d >= a), len(mine))
        here, past = [v for d, v in mine[i:] if d <= b and v is not None], [v for _, v in mine[i - 30 : i] if v is not None] if i >= 30 else []
        return sum(here) / len(here) / (sum(past) / len(past)) if here and past and sum(past) > 0 else None

    want = {}
    for s, a, b in windows:
        r = {e: ratio(e, a, b) for e in sorted({x[0] for x in rows})}
        r = {e: x for e, x in r.items() if x is not None}
        if r:
            peers = sum(x >= 2 and e != s and sector.get(s) and sector.get(e) == sector.get(s) for e, x in r.items())
            want[s] = (len(r), sum(x >= 2 for x in r.values()), sum(x >= 5 for x in r.values()), peers)
    assert got == want and any(x[1] for x in want.values())


def test_failed_loads_by_symbol_or_for_all(spark):
    runs = [("r1", "t", '{"symbol": "A"}', "failed", 2), ("r2", "t", '{"symbol": "A"}', "failed", 1), ("r3", "t", "{broken", "failed", 3), ("r4", "t", '{"symbol": "B"}', "success", 0), ("r5", "u", None, "failed", 0)]
    f = spark.createDataFrame([("p", t, s, "m", DAY, DAY) for t, s in (("t", "A"), ("t", "B"), ("u", "C"), ("v", "A"))], "probe string, table_name string, symbol string, metric string, start date, end date")
    got = {(r["table_name"], r["symbol"]): r["run_id"] for r in attribution.failed_loads(f, spark.createDataFrame(runs, "run_id string, target_table string, params string, status string, started_at int")).collect()}
    assert got == {("t", "A"): "r2", ("t", "B"): "r3", ("u", "C"): "r5"}


@pytest.mark.parametrize("size", [places.RANGE, 40])
def test_places_in_ranges(spark, size, monkeypatch):
    monkeypatch.setattr(places, "RANGE", size)
    rng = random.Random(size)
    rows = [(k, rng.randrange(90) / 4) for k in ("a", "b", None) for _ in range(300)]
    got = {(r["k"], r["v"]): (r["c"], r["first"], r["last"], r["n"]) for r in places.ranked(spark.createDataFrame(rows, "k string, x double"), "x", ("k",)).collect()}
    for k in ("a", "b", None):
        v = sorted(x for n, x in rows if n == k)
        assert {x: t for (n, x), t in got.items() if n == k} == {x: (v.count(x), v.index(x), v.index(x) + v.count(x) - 1, len(v)) for x in set(v)}


def test_a_probe_without_its_column_is_named(spark):
    s = spark.createDataFrame([("A", DAY, 1.0)], "symbol string, date date, volume double")
    rows = probes.union(depth=lambda: probes.history_depth(s), lost=lambda: probes.history_depth(s.drop("date"))).collect()
    assert [(r["probe"], r["metric"]) for r in rows] == [("history_depth", "history_trading_days"), ("skipped", "lost::column_missing::date")]
    with pytest.raises(ValueError):
        probes.union(bad=lambda: int("x"))


def test_kinds_of_all_strings_in_one_pass(spark):
    df = spark.createDataFrame([(str(i), f"2024-01-{i % 28 + 1:02d}", f"c{i % 3}", f"free {i}", None) for i in range(60)], "a string, b string, c string, d string, e string")
    assert {r["column"]: r["kind"] for r in generic_probes.infer(df).collect()} == {"a": "numeric", "b": "datetime", "c": "categorical", "d": "text", "e": "text"}


# ---- sources and streams


def test_an_array_is_read_in_parts(spark, tmp_path):
    rng = random.Random(8)
    texts = ["plain", 'quote " and brace } {', "back\\slash", "]}[{", "é" * 40, '\\"}', "", "line\nend"]
    records = [{"id": i, "query": rng.choice(texts) * rng.randint(1, 5), "answers": json.dumps([{"name": "t", "arguments": {"a": rng.choice(texts)}}]), "tools": None if i % 4 else "[]", "extra": {"x": [1, {"y": {}}]}} for i in range(300)]
    (tmp_path / "one.json").write_text(json.dumps(records))
    (tmp_path / "two.json").write_text(json.dumps([r | {"id": r["id"] + 1000} for r in records], indent=1, ensure_ascii=False) + "\n")
    (tmp_path / "none.json").write_text("[]")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700b", "5k", "64m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            got = sorted(json.loads(r["text"])["id"] for r in arrays.scan_array(spark, str(tmp_path)).collect())
            assert got == sorted([*range(300), *range(1000, 1300)]), size
            rows = {r["id"]: r for r in io.scan_tool_calls(spark, str(tmp_path)).collect()}
            assert rows[7]["query"] == records[7]["query"] and rows[1007]["answers"][0]["name"] == "t" and rows[7]["tools"] == []
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_dialects():
    lines = lambda rows, d, q: [d.join(f"{q}{c}{q}" if d in c else c for c in r) for r in rows]
    rows = [["id", "name", "x"], *[[str(i), f"n{i}", f"{i}.5"] for i in range(9)]]
    for d in io.DELIMITERS:
        for q in io.QUOTES:
            assert io.sniff(lines([[*r[:1], f"{r[1]}{d} z", r[2]] for r in rows], d, q)) == io.Dialect(d, q, True)
        assert io.sniff(lines(rows[1:], d, '"')) == io.Dialect(d, '"', False)
    assert io.sniff([]) == io.Dialect() and io.sniff(["one", "two"]) == io.Dialect()


def test_counts_are_observed(spark, tmp_path):
    t = spark.createDataFrame([(str(i), "t") for i in range(7)], "run_id string, task string")
    assert io.sink_traces(t, f"{tmp_path}/a") == 7
    good = io.tracked(spark, "s", "t", lambda note: note(t).write.parquet(f"{tmp_path}/b")).first()
    bad = io.tracked(spark, "s", "t", lambda note: note(t.select(F.raise_error(F.lit("no")).alias("x"))).write.parquet(f"{tmp_path}/c")).first()
    assert (good["status"], good["rows_written"]) == ("success", 7) and (bad["status"], bad["rows_written"]) == ("failed", 0) and bad["error"]


def test_a_batch_rewrites_its_buckets_only_and_twice_is_once(spark, tmp_path):
    path = f"{tmp_path}/target"
    schema = "k int, v string, at int"
    rows = spark.createDataFrame([(i, "old", i) for i in range(100)], schema)
    streams.upsert_batch(rows, 0, path, ["k"], "at", 8)
    files = lambda: {str(f.parent.name): sorted(x.name for x in f.parent.glob("*.parquet")) for f in (tmp_path / "target").glob("*/*.parquet")}
    before = files()
    one = spark.createDataFrame([(5, "newer", 2), (5, "new", 1)], schema)
    for _ in range(2):
        streams.upsert_batch(one, 1, path, ["k"], "at", 8)
        got = {r["k"]: r["v"] for r in spark.read.parquet(path).collect()}
        assert got == {i: "newer" if i == 5 else "old" for i in range(100)} and spark.read.parquet(path).count() == 100
    after = files()
    assert before.keys() == after.keys() and sum(before[b] != after[b] for b in before) == 1
    # interrupted while buckets were exchanged: the stage brings it to its end
    bucket = next(b for b in before if before[b] != after[b])
    for f in (tmp_path / "target" / bucket).iterdir():
        f.unlink()
    streams.upsert_batch(one, 1, path, ["k"], "at", 8)
    assert spark.read.parquet(path).count() == 100
    streams.upsert_batch(spark.createDataFrame([(None, "n", 1), (200, "x", 1)], schema), 2, path, ["k"], "at", 8)
    streams.upsert_batch(spark.createDataFrame([(None, "m", 1)], schema), 3, path, ["k"], "at", 8)
    assert spark.read.parquet(path).where("k is null").collect()[0]["v"] == "m" and spark.read.parquet(path).count() == 102


def test_memory_in_a_stream_equals_the_batch_after_a_restart(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"f{rng.randrange(4)}", rng.choice("abc"), rng.choice(("real", "false")), 0.9, i) for i in range(60)]
    rows = [(f, c, "real" if c == "a" else "false", p, i) for f, c, _, p, i in rows]
    df = spark.createDataFrame(rows, "fingerprint string, root_cause string, label string, confidence double, asof long")
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = {}
        for low, high in ((0, 30), (30, 60)):  # the second run begins from the checkpoint
            df.where(f"asof >= {low} and asof < {high}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            seen = []
            q = streams.memory(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")).writeStream.outputMode("update").foreachBatch(lambda b, n: seen.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
            streams.to_end(q, 120)
            got |= {(r["fingerprint"], r["root_cause"]): (r["status"], r["weight"], r["hits"]) for r in seen}
            want = {(r["fingerprint"], r["root_cause"]): (r["status"], r["weight"], r["hits"]) for r in attribution.memory(df.where(f"asof < {high}")).collect()}
            assert got == want
    finally:
        spark.conf.unset(key)


# ---- the registry


def test_every_plan_can_be_built(spark, small):
    from plumbline import catalog

    broken = {}
    for name, query in catalog.queries().items():
        try:
            assert query(spark, small).columns
        except Exception as e:  # noqa: BLE001  all of them are told at once
            broken[name] = repr(e)[:200]
    assert not broken
