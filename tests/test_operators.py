"""Boundaries and invariants of the operators, on rows worked by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.operators import attribution, badges, cost, intervals, metrics, postings, prepare, probes, questions, retrieval, traces
from plumbline.operators import trading_calendar as cal
from plumbline.sources import io
from plumbline.streaming import streams

DAY = dt.date(2024, 1, 1)


def series(spark, rows):
    """rows: (symbol, day number, close, volume)."""
    return spark.createDataFrame([(s, DAY + dt.timedelta(d), float(c), None if v is None else float(v)) for s, d, c, v in rows], "symbol string, date date, close double, volume double")


def days(spark, n=200):
    return cal.numbered(spark.createDataFrame([(DAY + dt.timedelta(i),) for i in range(n) if (DAY + dt.timedelta(i)).weekday() < 5], "date date"))


def test_golden_prices_and_changes(spark):
    s = series(spark, [("A", 1, 100, 1), ("A", 2, 110, 1), ("A", 3, 121, 1), ("B", 1, 70, 1), ("B", 2, 72, 1)])
    assert {r["symbol"]: r["value"] for r in metrics.latest(s, "close").collect()} == {"A": 121.0, "B": 72.0}
    a, b = F.lit(DAY + dt.timedelta(1)), F.lit(DAY + dt.timedelta(3))
    checked = metrics.verify(metrics.pct_change(s, a, b), metrics.midpoint_change(s, a, b), ["symbol"], 0.1)
    assert {(r["symbol"], r["value"], r["status"]) for r in checked.collect()} == {("A", 21.0, "verified"), ("B", 2.8571, "verified")}


def test_staleness_counts_trading_days_before_asof(spark):
    s = series(spark, [("A", 0, 1, 1), ("B", 3, 1, 1), ("C", 4, 1, 1)])  # Monday, Thursday, Friday
    asof = F.lit(DAY + dt.timedelta(7))  # the next Monday expects Friday
    got = {r["symbol"]: (r["value"], r["severity"]) for r in probes.freshness(s, days(spark), asof).collect()}
    assert got == {"A": (4.0, "P0"), "B": (1.0, "P1")}


def test_completeness_collapses_over_weekends(spark):
    s = series(spark, [("A", 0, 1, 1), ("A", 2, 1, 1), ("A", 8, 1, 1)])
    got = {(str(r["start"]), str(r["end"]), r["value"]) for r in probes.completeness(s, days(spark), F.lit(DAY + dt.timedelta(8))).collect()}
    assert got == {("2024-01-02", "2024-01-02", 1.0), ("2024-01-04", "2024-01-08", 3.0)}


def test_drift_needs_forty_rows_and_more_than_five(spark):
    base = [("A", i, 1, 10) for i in range(30)]
    assert probes.volume_drift(series(spark, base + [("A", 30 + i, 1, 60) for i in range(9)])).count() == 0
    assert probes.volume_drift(series(spark, base + [("A", 30 + i, 1, 50) for i in range(10)])).count() == 0
    hit = probes.volume_drift(series(spark, base + [("A", 30 + i, 1, 51) for i in range(10)])).collect()
    assert [(str(h["start"]), str(h["end"]), h["value"]) for h in hit] == [("2024-01-31", "2024-02-09", 5.1)]


def test_history_depth_boundary(spark):
    s = series(spark, [("A", i, 1, 1) for i in range(29)] + [("B", i, 1, 1) for i in range(30)])
    assert [r["symbol"] for r in probes.history_depth(s).collect()] == ["A"]


def test_nan_is_no_hit(spark):
    s = series(spark, [("A", 0, float("nan"), 1)]).withColumn("pct_chg", F.lit(float("nan"))).withColumn("high", F.lit(1.0)).withColumn("low", F.lit(1.0))
    assert probes.validity(probes.clean(s)).count() == 0


def test_suspension_covers_a_gap_from_nine_tenths_on(spark):
    gap = lambda s, a, b: ("completeness", "daily", s, "missing_trading_days", DAY + dt.timedelta(a), DAY + dt.timedelta(b), 1.0, 1.0, "P1")
    f = spark.createDataFrame([gap("A", 0, 11), gap("B", 0, 11), gap("C", 5, 6)], "probe string, table_name string, symbol string, metric string, start date, end date, value double, threshold double, severity string")
    h = spark.createDataFrame([("A", DAY, DAY + dt.timedelta(10)), ("B", DAY, DAY + dt.timedelta(9))], "symbol string, begin_date date, end_date date")
    runs = spark.createDataFrame([], "run_id string, target_table string, params string, status string, started_at timestamp")
    c = days(spark)
    got = {r["symbol"]: (r["root_cause"], r["suppressed"]) for r in attribution.gaps(f, c, cal.expanded(h, c), runs).collect()}
    assert got == {"A": ("benign_suspension", True), "B": ("missing_rows", False), "C": ("benign_non_trading_day", True)}


def test_merge_hits_touching_and_nested(spark):
    rows = [("A", 1, 10, 1.0), ("A", 2, 4, 9.0), ("A", 11, 12, 2.0), ("A", 14, 15, 3.0)]
    got = sorted(tuple(r) for r in intervals.merge_hits(spark.createDataFrame(rows, "k string, lo int, hi int, value double"), ["k"]).collect())
    assert got == [("A", 1, 12, 1.0), ("A", 14, 15, 3.0)]


def test_as_of_takes_the_same_day_and_nothing_later(spark):
    s = series(spark, [("A", 1, 5, 1), ("A", 3, 7, 1)])
    q = spark.createDataFrame([(i, "A", DAY + dt.timedelta(i)) for i in range(5)], "q_id int, symbol string, end date")
    assert [r["value"] for r in questions.prices(q, s).orderBy("q_id").collect()] == [None, 5.0, 5.0, 7.0, 7.0]


def test_upsert_twice_is_once(spark):
    t = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    b = spark.createDataFrame([(1, "c"), (None, "d"), (2, "e")], "k int, v string")
    once = io.upsert(t, b, ["k"])
    assert sorted(map(str, once.collect())) == sorted(map(str, io.upsert(once, b, ["k"]).collect())) and once.count() == 3


def test_badges_worst_wins_and_health(spark):
    cols = spark.createDataFrame([("t", c) for c in "abcd"], "table_name string, column string")
    f = spark.createDataFrame([("t", "a", "m", "x", "P0", False), ("t", "a", "n", "x", "OK", True), ("t", "b", "m", "x", "P1", False), ("t", "c", "m", "x", "OK", True)], "table_name string, column string, metric string, root_cause string, severity string, suppressed boolean")
    b = badges.board(f, cols)
    assert {r["column"]: r["level"] for r in b.collect()} == {"a": "unusable", "b": "caution", "c": "verified", "d": "baseline"}
    assert badges.health(b).first()["health"] == 62.5 and badges.health(b.limit(0)).first()["health"] == 100.0


def test_kappa_and_sign_test(spark):
    k = lambda rows: badges.kappa(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()["kappa"]
    assert k([("x", "x"), ("y", "y")]) == 1.0 and k([("x", "x")]) is None and k([("x", "y"), ("y", "x")]) == -1.0
    p = spark.range(1).select(cost.binomial_two_sided(F.lit(1), F.lit(6)).alias("p"), cost.binomial_two_sided(F.lit(0), F.lit(0)).alias("q"), cost.binomial_two_sided(F.lit(3), F.lit(6)).alias("r")).first()
    assert p["p"] == pytest.approx(14 / 64) and p["q"] == 1.0 and p["r"] == 1.0


def test_misplaced_default(spark):
    rows = [("f", 1, "permitivity", "default is 8.854e-12", None), ("f", 1, "charge", "", "8.854e-12"), ("f", 1, "distance", "", "0.000000000008854"), ("g", 1, "x", "default is 3", None)]
    p = spark.createDataFrame(rows, "name string, spec_no int, param string, description string, default string")
    assert [(r["param"], r["holders"]) for r in traces.misplaced_defaults(p).collect()] == [("permitivity", "charge/distance")]


def test_any_spec_that_explains_a_call_is_enough(spark):
    p = spark.createDataFrame([("t", 1, "a", "", None), ("t", 2, "b", "", None)], "name string, spec_no int, param string, description string, default string")
    c = spark.createDataFrame([(1, 1, "t", {"b": "1"}), (2, 1, "t", {"c": "1"}), (3, 1, "u", {"c": "1"})], "record int, pos int, name string, arguments map<string,string>")
    got = {r["record"]: r["issues"] for r in traces.best_issues(c, p).collect()}
    assert got == {1: [], 2: ["missing:a", "unknown:c"], 3: ["not_found:u"]}


def pieces_of(lines, cap):
    out, now = [], []
    for line in lines:
        if len(line) > cap:
            out += ["\n".join(now)] if now else []
            out += [line[i : i + cap] for i in range(0, len(line), cap)]
            now = []
        else:
            if now and sum(map(len, now)) + len(line) > cap:
                out.append("\n".join(now))
                now = now[-2:]
            now = [*now, line]
    if now and out and len("\n".join(now)) < cap // 4:
        out[-1] += "\n" + "\n".join(now)
    elif now:
        out.append("\n".join(now))
    return out


def test_long_blocks_are_split_as_by_a_fold(spark):
    import random

    r = random.Random(4)
    cases = [["x" * r.choice((0, 1, 9, 40, 90, 130, 450)) + str(i) for i in range(r.randrange(1, 30))] for _ in range(60)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, l array<string>").select("i", retrieval.split_long(F.col("l"), 200).alias("p"))
    assert {x["i"]: x["p"] for x in df.collect()} == {i: pieces_of(c, 200) for i, c in enumerate(cases)}
    assert any(len(p) > 1 for p in (pieces_of(c, 200) for c in cases))
    text = "# Title\nfirst\n## One \n" + "\n".join(["a" * 150] * 3) + "\n## Empty\n\n## Two\r\nlast\n"
    got = [tuple(x) for x in retrieval.chunks(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "only")], "doc_id int, text string"), 200).orderBy("doc_id", "chunk_no").collect()]
    a = "a" * 150
    assert got == [(1, 1, "Title", "first", True), *[(1, n + 2, "One", f"（{n + 1}/{len(p)}）\n{x}", False) for p in [pieces_of([a] * 3, 200)] for n, x in enumerate(p)], (1, 2 + len(pieces_of([a] * 3, 200)), "Two", "last", False)]


def test_flattened_tables(spark):
    cells = "\n\n".join(f"c{i}" for i in range(10))
    texts = {"This is a sentence.\n" + cells + "\n\nAnother one.": "This is a sentence.\n| c0 | c1 | c2 | c3 | c4 | c5 | c6 | c7 |\n| c8 | c9 |\n\nAnother one.", "a\nb\nc": "a\n\nb\n\nc", "": "", "\n\nx y\n\nEnd.\n": "\n\nx y\n\nEnd.\n", "第一条。\na": "第一条。\na"}
    d = spark.createDataFrame([*[(i, t) for i, t in enumerate(texts)], (99, None)], "doc_id int, text string")
    got = {r["doc_id"]: r["text"] for r in retrieval.rebuilt_tables(d).collect()}
    assert got == {**dict(enumerate(texts.values())), 99: ""}


def test_expansion_fields_and_scores(spark):
    q = {"net  Sales of eps?": "net  Sales of eps? revenue revenues total revenue net revenues earnings per share diluted eps", "epsilon": "epsilon", "R&D": "R&D research and development"}
    got = {r["q"]: r["e"] for r in spark.createDataFrame([(x,) for x in q], "q string").select("q", retrieval.expand(F.col("q")).alias("e")).collect()}
    assert got == q
    f = spark.range(1).select(retrieval.field_tokens(F.lit("Head"), F.lit("Total net sales\n12 | 2018 x | a long sentence that is surely no label since it has too many characters\n营业收入")).alias("f")).first()["f"]
    assert f == ["head", "total", "net", "sal", "2018", "x", "营业", "业收", "收入"]
    import math

    chunked = spark.createDataFrame([(1, 1, "t", "pre revenue", True), (1, 2, "a", "red red blue", False), (1, 3, "b", "green", False), (2, 1, "c", "red", True)], "doc_id int, chunk_no long, header string, text string, is_preamble boolean")
    scores = {(r["doc_id"], r["chunk_no"]): r["score"] for r in retrieval.bm25(postings.units(chunked), spark.createDataFrame([(1, "red")], "query_id int, text string")).collect()}
    body, field = [["red", "red", "blue"], ["green"], ["red"]], [["a", "red", "red", "blue"], ["b", "green"], ["c", "red"]]

    def okapi(docs, token):
        n, mean = len(docs), sum(map(len, docs)) / len(docs)
        raw = {t: math.log((n - sum(t in d for d in docs) + 0.5) / (sum(t in d for d in docs) + 0.5)) for t in {t for d in docs for t in d}}
        idf = raw[token] if raw[token] >= 0 else 0.25 * sum(raw.values()) / len(raw)
        return [idf * d.count(token) * 2.5 / (d.count(token) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for d in docs]

    want = [b + 2 * f for b, f in zip(okapi(body, "red"), okapi(field, "red"))]
    assert scores == {(1, 2): pytest.approx(want[0]), (2, 1): pytest.approx(want[2])}


def test_segments_by_tool(spark):
    fence = "```python\nimport x\n\n@deco\n# note\ndef one():\n    pass\nclass Two:\n    pass\n```"
    rows = [("list_files", "a.py\n\n b/c.py", "ok"), ("read_file", fence, "ok"), ("read_file", "```\nintro\n# A\nx\n## B\ny\n```", "ok"), ("read_file", "File not found", "ok"), ("search_code", "2 hits\n### a\nx\n### b", "ok"), ("search_code", "No hits", "ok"), ("get_signature", "# m.py\n\ndef f(a)", "ok"), ("web", "anything", "ok"), ("list_files", "No files", "error")]
    df = spark.createDataFrame([(1, i, 0, t, p, c) for i, (t, p, c) in enumerate(rows)], "task int, turn int, call int, tool string, payload string, result_code string")
    got = [(r["turn"], r["kind"], r["text"]) for r in cost.segments(df).orderBy("turn", "seg").collect()]
    assert got == [
        (0, "path", "a.py"), (0, "path", "b/c.py"), (1, "block", "@deco\n# note\ndef one():\n    pass"), (1, "block", "class Two:\n    pass"), (2, "section", "A\nx\n"), (2, "section", "B\ny"),
        (4, "header", "2 hits"), (4, "hit", "### a\nx"), (4, "hit", "### b"), (6, "header", "# m.py"), (6, "sig", "def f(a)"),
    ]
    t = spark.range(1).select(cost.value_tokens(F.lit("See a.b.c, src/x/y.py:12 and 1234567 Def ::")).alias("t")).first()["t"]
    assert t == ["12", "1234567", "a.b.c", "and", "def", "see", "src/x/y.py:12"]
    texts = spark.createDataFrame([(1, 0, "beta_two src"), (1, 1, "alpha_one beta_two src 12345 123456"), (1, 2, "alpha_one")], "task int, turn int, text string")
    parts = spark.createDataFrame([(1, 1, 1, "t", 0, "k", "alpha_one beta_two src 12345 123456")], "task int, turn int, call int, tool string, seg int, kind string, text string")
    r = cost.hit_split(cost.judged(cost.records(parts, cost.lifetimes(texts)))).first()
    assert [x["token"] for x in r["tokens"]] == ["123456", "alpha_one"] and r["n_preexisting"] == 1 and r["n_indistinct"] == 2
    assert r["hits"] == 1 and r["verdict"] == "referenced" and r["sample_arguments"] == ["alpha_one"]


def test_percentiles_by_ranges(spark):
    import random

    r = random.Random(6)
    rows = [(k, float(r.choice((r.randrange(20), r.random() * 1e6)))) for k in "ab" for _ in range(301)] + [("c", 5.0)]
    got = {x["k"]: (x["p10"], x["p50"], x["p90"]) for x in cost.nearest_index(spark.createDataFrame(rows, "k string, v double"), "v", (0.1, 0.5, 0.9), ("k",)).collect()}
    for k in "abc":
        v = sorted(x for n, x in rows if n == k)
        assert got[k] == tuple(v[round(q * (len(v) - 1))] for q in (0.1, 0.5, 0.9))


def test_tokens_and_masks(spark):
    r = spark.createDataFrame([("第十二条 Companies discuss classes 投资基金",)], "t string").select(retrieval.tokens(F.col("t")).alias("x")).first()["x"]
    assert r == ["第十二条", "company", "discuss", "classe", "第十", "十二", "二条", "条投", "投资", "资基", "基金"]
    texts = {
        "call 13912345678 or a.b@c.org": ("call 139******78 or a.b****rg", 2), "a13912345678b 13912345678": ("a13912345678b 139******78", 1), "123456789012345678": ("123*************78", 1),
        "110101199003071234 110101199013071234": ("110*************34 110*************34", 2), "1234 5678 9012 3456 78 1234-5678-9012-3456": ("123*****************78 1234-5678-9012-3456", 1), "手机13912345678": ("手机13912345678", 0),
    }
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", retrieval.masked(F.col("t")).alias("m")).collect()
    assert {r["t"]: (r["m"]["text"], r["m"]["hits"]) for r in got} == texts


def test_question_slots_and_guard(spark):
    names = spark.createDataFrame([("中芯国际", "688981"), ("Acme", "S01")], "name string, symbol string")
    texts = {
        "600519 在 2025 年 9 月 4 日的收盘价": ("600519", "price", None, None, "2025-09-04"), "中芯国际2025年9月5日到9月1日涨了多少": ("688981", "change", "2025-09-01", "2025-09-05", None),
        "from 1997-02-03 to 1997-01-02 Acme average": ("S01", "aggregate", "1997-01-02", "1997-02-03", None), "9月4日多少钱": (None, "price", None, None, None), "2025 年 2 月的日均成交量": (None, "aggregate", "2025-02-01", "2025-02-28", None),
        "2025-2-30": (None, "price", None, None, None), "": (None, "price", None, None, None),
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "q_id int, text string")
    got = {r["q_id"]: (r["symbol"], r["intent"], *[str(r[c]) if r[c] else None for c in ("start", "end", "as_of")]) for r in questions.slots(df, names).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())
    day = lambda d: F.to_date(F.lit(d))
    series = spark.createDataFrame([("A", f"2025-{m:02d}-{d:02d}", float(m * 100 + d), 10.0 * d) for m, d in ((1, 2), (1, 3), (1, 6), (3, 10), (3, 11))], "symbol string, date string, close double, volume double").withColumn("date", F.to_date("date"))
    asked = spark.createDataFrame([(1, "A", "change", "2025-01-02", "2025-01-06"), (2, "A", "change", "2025-01-10", "2025-02-20"), (3, "A", "aggregate", "2025-01-03", "2025-03-10"), (4, "B", "change", "2025-01-03", "2025-03-10")], "q_id int, symbol string, intent string, start string, end string")
    asked = asked.withColumn("start", F.to_date("start")).withColumn("end", F.to_date("end"))
    changed = {r["q_id"]: (r["value"], str(r["first"]), str(r["last"]), r["rows"]) for r in questions.changes(asked, series).collect()}
    assert changed[1] == (round((106 / 102 - 1) * 100, 4), "2025-01-02", "2025-01-06", 3) and changed[2] == (round((106 / 310 - 1) * 100, 4), "2025-01-10", "2025-02-20", 0) and changed[4][0] is None and changed[4][3] == 0
    assert {r["q_id"]: (r["rows"], r["value"]) for r in questions.aggregates(asked, series).collect()}[3] == (3, round((30 + 60 + 100) / 3, 2))
    halts = spark.createDataFrame([("A", "2025-01-08", "2025-03-05")], "symbol string, begin_date string, end_date string").select("symbol", F.to_date("begin_date").alias("begin_date"), F.to_date("end_date").alias("end_date"))
    calendar = spark.sql("select explode(sequence(date'2025-01-01', date'2025-04-01')) as date").withColumn("day_no", F.datediff("date", day("2024-12-31")))
    flags = {r["q_id"]: (r["flag"], r["level"]) for r in questions.guarded(asked, halts, calendar, questions.spans(asked, series).select("q_id", "used", "rows")).collect()}
    assert flags == {1: ("none", "baseline"), 2: ("gap_span", "unusable"), 3: ("calendar_mismatch", "caution"), 4: ("none", "baseline")}


def test_plain_text_and_blocks(spark):
    df = spark.createDataFrame([(1, "<p>a &lt; b</p><script>x<y</script>&amp;lt;")], "doc_id int, text string")
    assert df.select(prepare.plain_text(F.col("text")).alias("t")).first()["t"] == "a < b &lt;"
    b = prepare.blocks(spark.createDataFrame([(1, "pre\n## A\nx\n## B")], "doc_id int, text string"), "^## ").orderBy("block").collect()
    assert [(r["header"], r["body"]) for r in b] == [(None, "pre"), ("## A", "## A\nx"), ("## B", "## B")]


def test_streamed_tally(spark, tmp_path):
    df = spark.createDataFrame([("t", "p", 3), ("t", "p", 1), ("u", "q", 2)], "tool string, param string, record long")
    df.write.parquet(f"{tmp_path}/in")
    q = streams.tally(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("tal").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("tal").collect()} == {("t", "p", 2, 1), ("u", "q", 1, 2)}


def test_verdict_counts_sum_to_samples(spark, small):
    import __spark_entry__ as entry

    q = entry.queries()
    n = q["q115_trace_diagnosis"](spark, small).count()
    assert q["q117_trace_summary"](spark, small).where("part = 'category'").agg(F.sum("n")).first()[0] == n == q["q116_verdicts"](spark, small).count()


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())
    numbers = {int(n[1:4]) for n in entry.queries() if n[0] == "q"}
    assert numbers == set(range(1, 178))


def test_streams_are_waited_for_to_the_end():
    from plumbline.streaming import streams

    class Slow:
        limits, stopped = [], False

        def awaitTermination(self, timeout=None):
            self.limits.append(timeout)
            return None if timeout is None else False

        def stop(self):
            self.stopped = True

    q = Slow()
    streams.to_end(q)
    assert q.limits == [None] and not q.stopped
    with pytest.raises(TimeoutError):
        streams.to_end(q, 1)
    assert q.stopped
