"""What must not grow with the input: sides that go to every task, and the work of a single row."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import cost, postings, questions, retrieval, traces


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_names_are_looked_up_without_pieces_of_texts(spark):
    texts = spark.createDataFrame([(1, "Acme and Ace rose"), (2, "Z"), (3, None), (4, "S07 Acme")], "q_id int, text string")
    names = spark.createDataFrame([("Acme", "S02"), ("Ace", "S01"), ("Z", "S09"), ("", "S00"), ("rose", None)], "name string, symbol string")
    got = questions.slots(texts, names)
    assert {r["q_id"]: r["symbol"] for r in got.collect()} == {1: "S01", 2: "S09", 3: None, 4: "S07"}
    plan = planned(got)
    assert "Join" not in plan and "Generate" not in plan and "Exchange" not in plan


def test_pieces_of_texts_are_never_sent_to_every_task(spark, tmp_path):
    spark.createDataFrame([(1, 1, "alpha_one beta_two"), (1, 2, "alpha_one")], "task int, id int, text string").write.parquet(str(tmp_path / "texts"))
    texts = spark.read.parquet(str(tmp_path / "texts"))  # so small that a join by estimates would send what is made of them
    found = cost.tokens_in(texts.select("task", F.lit("alpha_one").alias("token")), texts)
    assert "BroadcastHashJoin" not in planned(found)
    assert sorted(r["id"] for r in found.collect()) == [1, 2]


@pytest.mark.parametrize("n, k", [(7, 2), (40, 20), (1001, 470), (2_000_000, 999_000), (2_000_000, 700_000)])
def test_the_sign_test_of_many_pairs_ends(spark, n, k):
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)
    want = min(1.0, 2 * math.fsum(math.exp(log(i)) for i in range(max(0, k - 60_000), k + 1)))
    row = spark.range(1).select(cost.binomial_two_sided(F.lit(k) + F.col("id"), F.lit(n) + F.col("id")).alias("p"), cost.binomial_one_sided(F.lit(k) + F.col("id"), F.lit(n) + F.col("id")).alias("q")).first()
    assert row["p"] == pytest.approx(want, rel=1e-7, abs=1e-12) and (row["q"] == pytest.approx(want / 2, rel=1e-7, abs=1e-12) or 2 * k >= n)


def test_scores_are_made_where_the_blocks_are(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 8)  # so that documents lie across blocks
    rows = [(d, c, f"head {d}", " ".join(f"w{(d * 7 + c * i) % 23}" for i in range(1, 9)), False) for d in range(9) for c in range(1, 6)]
    units = postings.units(spark.createDataFrame(rows, "doc_id int, chunk_no long, header string, text string, is_preamble boolean").coalesce(1))
    queries = spark.createDataFrame([(q, f"w{q} w{q + 5} w{q + 9} zz") for q in range(6)] + [(9, "zz")], "query_id int, text string")
    index, plain = postings.index(units), retrieval.bm25(units, queries)
    got = postings.scores(index, queries)
    assert "Exchange" not in planned(got)
    key = lambda df: {(r["query_id"], r["doc_id"], r["chunk_no"]): r["score"] for r in df.collect()}
    assert key(got) == pytest.approx(key(plain)) and got.count() == plain.count()
    docs = lambda df: {(r["query_id"], r["doc_id"]): r["score"] for r in df.collect()}
    summed = postings.document_scores(index, queries)
    want = docs(retrieval.document_scores(plain.withColumn("score", F.round("score", 6))))
    assert docs(summed) == pytest.approx(want) and summed.count() == len(want)


def test_tasks_take_few_units_and_blocks_at_a_time(spark):
    rows = [(d, 1, "h", f"word {d}", False) for d in range(1000)]
    units = postings.units(spark.createDataFrame(rows, "doc_id int, chunk_no long, header string, text string, is_preamble boolean").coalesce(1))
    sizes = units.mapInPandas(lambda batches: (b.head(1).assign(n=len(b))[["n"]] for b in batches), "n long").collect()
    assert max(r["n"] for r in sizes) <= postings.BLOCK and sum(r["n"] for r in sizes) == 1000


def test_chunks_are_made_once_for_units(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for rows in batches:
            made.add(len(rows))
            yield rows

    rows = [(d, c, "h", f"word {d}", c == 1) for d in range(50) for c in range(1, 3 if d % 2 else 2)]
    schema = "doc_id int, chunk_no long, header string, text string, is_preamble boolean"
    units = postings.units(spark.createDataFrame(rows, schema).mapInPandas(counted, schema))
    got = {(r["doc_id"], r["chunk_no"]) for r in units.collect()}
    assert got == {(d, 2 if d % 2 else 1) for d in range(50)} and made.value == len(rows)


def test_blocks_end_with_documents(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 8)
    rows = [(d, c, "h", f"word {d}", False) for d in range(40) for c in range(1, 2 + (20 if d == 7 else d % 6))]
    units = postings.units(spark.createDataFrame(rows, "doc_id int, chunk_no long, header string, text string, is_preamble boolean").coalesce(1))
    blocks = [r["docs"] for r in postings.index(units).read(spark).collect()]
    assert sum(map(len, blocks)) == len(rows) and max(map(len, blocks)) <= 8
    assert [d for d in range(40) if sum(d in b for b in blocks) != 1] == [7]


def test_best_documents_are_those_of_all(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 8)
    rows = [(d, c, f"head {d % 5}", " ".join(f"w{(d % 11 * 7 + c * i) % 23}" for i in range(1, 9)), False) for d in range(120) for c in range(1, 2 + (30 if d == 9 else d % 4))]
    units = postings.units(spark.createDataFrame(rows, "doc_id int, chunk_no long, header string, text string, is_preamble boolean").coalesce(2))
    queries = spark.createDataFrame([(q, f"w{q} w{q + 5} w{q + 9} zz") for q in range(6)], "query_id int, text string")
    index = postings.index(units)
    ranked = lambda df: {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in retrieval.top(df.withColumn("score", F.round("score", 4)), 5, ["query_id"], "doc_id").collect()}
    all_of, few = postings.document_scores(index, queries), postings.document_scores(index, queries, k=5, places=4)
    assert ranked(few) == ranked(all_of) and few.count() < all_of.count() / 2


def test_documents_that_many_queries_name_meet_blocks(spark, monkeypatch):
    rows = [(d, c, "h", f"a{d % 3} b{c} c", False) for d in range(60) for c in range(1, 4)]
    index = postings.index(postings.units(spark.createDataFrame(rows, "doc_id int, chunk_no long, header string, text string, is_preamble boolean")))
    queries = spark.createDataFrame([(q, f"a{q % 3} b1 c") for q in range(4)], "query_id int, text string")
    named = spark.createDataFrame([(q, d) for q in (0, 2) for d in range(q, 60, 4)], "query_id int, doc_id int")
    best = lambda: sorted(tuple(r) for r in postings.top_units(index, queries, 6, named).collect())
    sent = best()
    monkeypatch.setattr(postings, "SENT", 10)
    assert best() == sent and len(sent) == 24


def test_chunks_equal_blocks_by_hand(spark):
    texts = ["", None, "title", "# Title \n\n intro \r\n## A \nx\x0by\n## \n## B\n \n##C\n## D\u2028z\x85\n\n", "\n## only\nbody", "t\x1cp\n## \u3000H\u3000\n\u2003b\u2003"]
    got = {}
    for r in retrieval.chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r["doc_id"], []).append((r["chunk_no"], r["header"], r["text"], r["is_preamble"]))
    assert got == {3: [(1, "Title", "intro", True), (2, "A", "x\ny", False), (3, "B", "##C", False), (4, "D", "z", False)], 4: [(1, "only", "body", False)], 5: [(1, "t", "p", True), (2, "H", "b", False)]}


def test_words_and_rounding_of_many_equal_those_of_one(spark):
    rng = random.Random(4)
    texts = ["", "ladies", "gasses boxes ss sses", "İstanbul KELVIN K"] + ["".join(rng.choice("aeisxyz1 \n.SEI|Éß") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    assert postings.spaced(texts).to_pylist() == [" ".join(postings.tokens(t)) for t in texts]
    words = [" ".join(rng.choice(["a", "abcdefgh", "abcdefghi", "第一条", "营业"]) for _ in range(rng.randint(0, 5))) for _ in range(200)]
    codes, names = postings.numbered(words)
    assert [names[i] for i in codes] == " ".join(words).split() and len(set(names)) == len(names)
    values = [0.0, 0.00005, 1.00005, 2.5, -0.00005, -3.00015, 1e300, 123456789.00005] + [round(rng.uniform(-50, 50), rng.randint(3, 16)) for _ in range(2000)]
    want = [r["v"] for r in spark.createDataFrame(list(enumerate(values)), "i int, v double").select("i", F.round("v", 4).alias("v")).orderBy("i").collect()]
    assert postings.half_up(np.array(values), 4).tolist() == want


def test_holders_of_a_default_are_listed_once(spark, tmp_path):
    rows = [("t", 1, f"c{i}", f"default is {i % 2}.0", None) for i in range(6)] + [("t", 1, f"h{i}", "a size", str(i % 2)) for i in range(4)] + [("t", 1, "c0", "again", "0"), ("t", 1, "alone", "default 7", None), ("t", 1, "alone", "itself", "7")]
    spark.createDataFrame(rows, "name string, spec_no int, param string, description string, default string").write.parquet(str(tmp_path / "params"))
    got = traces.misplaced_defaults(spark.read.parquet(str(tmp_path / "params")))
    plan = planned(got)
    want = {f"c{i}": "/".join(h for h in (["c0"] if i % 2 == 0 and i else []) + [f"h{i % 2}", f"h{i % 2 + 2}"]) for i in range(6)}
    assert {r["param"]: r["holders"] for r in got.collect()} == want
    assert plan.index("Join") < plan.index("Exchange")  # pairs of a claim and a holder are never dealt


def test_parts_of_a_long_payload_are_found_in_its_length(spark):
    n, start = 8000, time.monotonic()
    file = "```py\n" + "\n".join(f"# on {i}\n@x\ndef f{i}():\n    pass" for i in range(n)) + "\n```"
    hits = "\n".join(f"### {i}\nfound" for i in range(n))
    calls = spark.createDataFrame([(1, 1, 1, "read_file", "ok", file), (1, 2, 2, "search_code", "ok", hits)], "task int, turn int, call int, tool string, result_code string, payload string")
    got = cost.segments(calls).groupBy("turn").agg(F.count("*").alias("n"), F.max_by("text", "seg").alias("text"), F.min_by("text", "seg").alias("first")).orderBy("turn").collect()
    assert [(r["n"], r["text"]) for r in got] == [(n, f"# on {n - 1}\n@x\ndef f{n - 1}():\n    pass"), (n, f"### {n - 1}\nfound")]
    assert got[0]["first"] == "# on 0\n@x\ndef f0():\n    pass\n# on 1\n@x" and time.monotonic() - start < 40


def test_payloads_are_compacted_where_they_are(spark, tmp_path):
    spark.createDataFrame([(1, 1, 1, "list_files", "ok", "a.py\nb.py" * 40, "cap")], "task int, turn int, call int, tool string, result_code string, payload string, policy string").write.parquet(str(tmp_path / "calls"))
    plan = planned(cost.compact(spark.read.parquet(str(tmp_path / "calls")), spark.createDataFrame([("list_files", 2)], "tool string, cap int")))
    assert "Exchange hashpartitioning" not in plan and plan.count("FileScan") == 1


def test_parts_are_made_once_for_their_records(spark, tmp_path):
    spark.createDataFrame([(1, 1, 1, "list_files", "ok", "src/alpha.py\nb")], "task int, turn int, call int, tool string, result_code string, payload string").write.parquet(str(tmp_path / "calls"))
    texts = spark.createDataFrame([(1, 1, "x"), (1, 2, "see src/alpha.py")], "task int, turn int, text string")
    got = cost.judged(cost.records(cost.segments(spark.read.parquet(str(tmp_path / "calls"))), cost.lifetimes(texts)))
    assert [(r["seg"], r["chars"], r["n_indistinct"], r["verdict"]) for r in got.orderBy("seg").collect()] == [(0, 12, 0, "referenced"), (1, 1, 1, "unverifiable")]
    assert planned(got).count("FileScan") == 1


def test_tables_are_rebuilt_in_the_length_of_a_segment(spark):
    n, start = 12_000, time.monotonic()
    docs = spark.createDataFrame([(1, "\n" * n + "\n\n".join(f"c{i}" for i in range(n)))], "doc_id int, text string")
    text = retrieval.rebuilt_tables(docs).first()["text"]
    assert text.count("|") == n + n // 8 and text.strip().startswith("| c0 | c1 |") and time.monotonic() - start < 40


def test_both_premises_come_from_one_pass_over_calls(spark, tmp_path):
    rows = [(1, 1, "t", {"a": "1"}), (1, 2, "t", {"a": "1"}), (2, 1, "t", {"z": "1"}), (3, 1, "u", {}), (4, 1, "t", {"b": "1"})]
    spark.createDataFrame(rows, "record int, pos int, name string, arguments map<string,string>").write.parquet(str(tmp_path / "calls"))
    params = spark.createDataFrame([("t", 1, "a", "the a", None), ("t", 2, "b", "the b", None)], "name string, spec_no int, param string, description string, default string")
    calls = spark.read.parquet(str(tmp_path / "calls"))
    got = traces.premise_sensitivity(calls, params)
    assert planned(got).count("FileScan") == 1
    assert {r["verdict"]: (r["strict"], r["lenient"], r["difference"]) for r in got.collect()} == {"review": (1, 1, 0), "discard": (1, 0, -1), "not_failure": (1, 1, 0), "positive": (1, 1, 0), "schema_defect": (0, 1, 1)}
    assert sorted((r["record"], r["pos"], r["issues"]) for r in traces.best_issues(calls, params).collect()) == [(1, 1, []), (1, 2, []), (2, 1, ["missing:a", "unknown:z"]), (3, 1, ["not_found:u"]), (4, 1, [])]


def test_files_of_tool_calls_do_not_grow_in_number_with_their_records(spark, tmp_path, monkeypatch):
    from plumbline.plans import source_queries
    from plumbline.plans.registry import QUERIES

    spark.range(150_000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey")).write.parquet(str(tmp_path / "orders.parquet"))
    files, scan = [], source_queries.io.scan_tool_calls
    monkeypatch.setattr(source_queries.io, "scan_tool_calls", lambda s, path: files.extend(s.read.text(path).inputFiles()) or scan(s, path))
    got = QUERIES["q007_tool_call_scan"](spark, str(tmp_path))
    assert len(files) == 16
    assert got.agg(F.count("*"), F.sum("answers"), F.count_if(F.col("tool") == F.concat(F.lit("t"), (F.col("id") % 7 % 6).cast("string")))).first()[:] == (150_000, 120_000, 120_000)


def test_quartiles_need_the_single_values_of_few_rows(spark, tmp_path, monkeypatch):
    import random

    import numpy as np

    from plumbline.operators import generic_probes, places

    r = random.Random(5)
    rows = [(i, "a", r.uniform(-50, 1000) * 3 ** r.randint(0, 9)) for i in range(20_000)] + [(i, "b", float(r.choice([-3, 0, 0, 1, 2, 900]))) for i in range(3_000)]
    rows += [(i, "c", x) for i, x in enumerate([-math.inf, math.inf, math.nan, None, -0.0, 0.0, 5e-324, -1e308] + [float(x) for x in range(-12, 13)])] + [(1, None, 1e9), (2, "few", 1.0)]
    spark.createDataFrame(rows, "t int, g string, v double").write.parquet(str(tmp_path / "rows"))
    table = spark.read.parquet(str(tmp_path / "rows"))
    spec = generic_probes.Spec("x", (generic_probes.Declared("v", "numeric"),), group="g", outliers=0.0)
    counts = []
    for module in (generic_probes, places):
        monkeypatch.setattr(module, "written", lambda df, w=module.written: (counts.append((out := w(df)).count()), out)[1])

    def share(g):
        v = np.array([x for _, h, x in rows if h == g and x is not None and not math.isnan(x)])
        low, high = np.quantile(v, [0.25, 0.75])
        return float(np.mean((v < low - 1.5 * (high - low)) | (v > high + 1.5 * (high - low))))

    for g in ("a", "b", "c"):
        assert generic_probes.outliers(table.where(F.col("g") == g), spec).first()["value"] == pytest.approx(share(g), abs=1e-12)
    assert generic_probes.outliers(table, spec).first()["value"] == pytest.approx(max(map(share, "abc")), abs=1e-12)
    assert max(counts) < 6_000


def test_members_of_a_small_bucket_are_sent_once(spark, monkeypatch):
    from plumbline.llm import near_dedup

    # a chain: each text is near the next one, and the ends are not near
    words = [f"w{i}" for i in range(400)]
    texts = [(n, " ".join(words[n * 9 : n * 9 + 200])) for n in range(12)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    made = []
    monkeypatch.setattr(near_dedup, "_blocks", lambda *a: made.append(a))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, 80).collect()}
    assert set(got.values()) == {0} and not made
