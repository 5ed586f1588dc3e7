"""Queries over scans, sinks, loads, preparation and streams. What is written goes to the shared folder and is read again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from plumbline.operators import intervals, prepare
from plumbline.plans.inputs import SERIES, series
from plumbline.plans.registry import query
from plumbline.shared import shared_folder
from plumbline.sources import io
from plumbline.streaming import streams


# The same table in four dialects; names hold the delimiter, and one file has no header.
CSV = {"comma": (",", '"', True), "semicolon": (";", '"', True), "tab,no_header": ("\t", '"', False), "bar,single": ("|", "'", True)}


@query("q001_csv_scan", " UNION ALL ".join(f"SELECT s_suppkey, s_name || '{d} x' AS s_name, round(s_acctbal, 2) AS s_acctbal, 'csv:supplier:{n}' AS source FROM supplier" for n, (d, _, _) in CSV.items()))
def _(t):
    out = []
    for delimiter, quote, header in CSV.values():
        path = shared_folder(t.spark)
        rows = t.supplier.select("s_suppkey", F.concat("s_name", F.lit(f"{delimiter} x")).alias("s_name"), "s_acctbal")
        rows.write.option("header", header).option("sep", delimiter).option("quote", quote).csv(path)
        out.append(io.scan_csv_sniffed(t.spark, path, "s_suppkey long, s_name string, s_acctbal double", label="supplier").select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("s_acctbal"), "source"))
    return reduce(lambda a, b: a.union(b), out)


@query("q002_snapshot_with_seeds", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'nation', count(*) + 1 FROM nation UNION ALL SELECT 'customer', count(*) FROM customer")
def _(t):
    s = io.snapshot(t.spark, t.folder, {"orders": "", "nation": "", "customer": ""})
    seed = s["nation"].limit(1).withColumn("n_nationkey", F.lit(-1).cast(s["nation"].schema["n_nationkey"].dataType))
    s["nation"] = io.with_seeds(s["nation"], seed.unionByName(s["nation"]), ["n_nationkey"])
    return _counts(s)


def _counts(s):
    return reduce(lambda a, b: a.union(b), [d.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, d in s.items()])


@query("q003_missing_table_fallback", "SELECT 'events' AS name, count(*) AS n FROM events UNION ALL SELECT 'no_such_table', 0")
def _(t):
    return _counts(io.snapshot(t.spark, t.folder, {"events": "event_id long", "no_such_table": "a int"}))


@query("q004_point_in_time_cut", "SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-02' UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-02' UNION ALL SELECT 'nation', count(*) FROM nation")
def _(t):
    return _counts(io.cut({"orders": t.orders, "lineitem": t.lineitem, "nation": t.nation}, {"orders": "o_orderdate", "lineitem": "l_shipdate"}, F.to_date(F.lit("1998-01-01"))))


def traces(t):
    c = t.conversations
    step = F.struct(F.col("turn").cast("int").alias("seq"), F.col("role").alias("name"), F.create_map(F.lit("text"), F.col("text")).alias("arguments"), F.lit("ok").alias("status"))
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("turn"), F.to_json(step).alias("s")))).alias("x"))
    return g.select(F.col("conv_id").cast("string").alias("run_id"), F.lit("task").alias("task"), F.transform("x", lambda x: F.from_json(x["s"], io.STEP)).alias("steps"))


@query("q005_trace_scan", "SELECT conv_id::VARCHAR AS run_id, turn::INT AS seq, role AS name, md5(text) AS text, '1' AS schema_version FROM conversations")
def _(t):
    path = shared_folder(t.spark)
    io.sink_traces(traces(t), path)
    s = io.scan_traces(t.spark, path).select("run_id", "schema_version", F.explode("steps").alias("s"))
    return s.select("run_id", F.col("s.seq").alias("seq"), F.col("s.name").alias("name"), F.md5(F.col("s.arguments")["text"]).alias("text"), "schema_version")


@query("q006_trace_sink", "SELECT count(DISTINCT conv_id) AS lines, count(DISTINCT conv_id) AS told FROM conversations")
def _(t):
    path = shared_folder(t.spark)
    told = io.sink_traces(traces(t), path)
    return t.spark.read.text(path).agg(F.count("*").alias("lines"), F.lit(told).cast("long").alias("told"))


@query("q007_tool_call_scan", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END AS answers, CASE WHEN o_orderkey % 5 <> 0 THEN 't' || (o_custkey % 6) END AS tool FROM orders")
def _(t):
    path = shared_folder(t.spark)
    answers = F.when(F.col("o_orderkey") % 5 == 0, "{broken").otherwise(F.concat(F.lit('[{"name":"t'), (F.col("o_custkey") % 6).cast("string"), F.lit('","arguments":{"a":1}}]')))
    record = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.lit("q").alias("query"), answers.alias("answers"), F.lit(None).cast("string").alias("tools")))
    parts = max(16, -(-t.orders.count() // 100_000))  # files grow to about 100,000 records before there are more of them
    files = t.orders.groupBy(F.pmod("o_orderkey", F.lit(parts)).alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ","), F.lit("]")).alias("value"))
    files.write.partitionBy("part").text(path)
    return io.scan_tool_calls(t.spark, f"{path}/*").select("id", F.size("answers").alias("answers"), F.get("answers", F.lit(0))["name"].alias("tool"))


def bundle(t):
    """Runs (some twice, the later line counts) and spans, as JSON lines in one file for each kind."""
    path = shared_folder(t.spark)
    c = t.conversations
    call = F.struct(F.lit("read").alias("name"), F.concat(F.lit('{"b":"x","a":"'), F.col("turn").cast("string"), F.lit('"}')).alias("arguments"), F.length("text").alias("payload_chars"))
    turn = F.struct((F.col("turn") + 1).alias("turn"), F.length("text").alias("prompt_tokens"), F.array(call).alias("tool_calls"))
    runs = c.groupBy(F.col("conv_id").cast("string").alias("task")).agg(F.sort_array(F.collect_list(turn)).alias("turns")).withColumn("final_answer", F.lit("new"))
    runs.write.json(f"{path}/z")
    runs.where("task like '%7'").withColumn("final_answer", F.lit("old")).write.json(f"{path}/a")
    a = F.create_map(F.lit("gen_ai.usage.input_tokens"), F.length("text").cast("string"), F.lit("gen_ai.request.model"), F.col("role"))
    c.select(F.when(F.col("role") == "assistant", "gen_ai.chat").otherwise("gen_ai.tool.call").alias("name"), F.col("conv_id").cast("string").alias("trace_id"), a.alias("attributes")).write.json(f"{path}/s")
    return io.scan_bundle(t.spark, f"{path}/*")


@query("q008_run_span_scan", "SELECT 'run' AS kind, 'new' AS what, count(DISTINCT conv_id) AS n FROM conversations UNION ALL SELECT 'span', CASE WHEN role = 'assistant' THEN 'gen_ai.chat' ELSE 'gen_ai.tool.call' END, count(*) FROM conversations GROUP BY 2")
def _(t):
    runs, spans = bundle(t)
    return runs.groupBy(F.lit("run").alias("kind"), F.col("final_answer").alias("what")).agg(F.count("*").alias("n")).union(spans.groupBy(F.lit("span"), "name").agg(F.count("*")))


@query("q009_run_flatten", """SELECT conv_id::VARCHAR AS task, (turn + 1)::INT AS turn, 1 AS call_no, 'read' AS tool, substr(sha256('{"a":"' || turn || '","b":"x"}'), 1, 16) AS args_hash, 'ok' AS result_code, length(text)::BIGINT AS payload_chars FROM conversations""")
def _(t):
    return io.flat_calls(bundle(t)[0])


@query("q010_span_flatten", "SELECT conv_id::VARCHAR AS trace_id, role AS model, length(text)::BIGINT AS input_tokens FROM conversations WHERE role = 'assistant'")
def _(t):
    return io.span_records(bundle(t)[1])[0].select("trace_id", "model", "input_tokens")


@query("q011_document_scan", "SELECT 'good' AS part, count(*) FILTER (item_id % 4 <> 0) AS n, sum(1 + length('# T' || item_id || chr(10) || text)) FILTER (item_id % 4 <> 0)::BIGINT AS chars FROM benchmark UNION ALL SELECT 'rejected', count(*) FILTER (item_id % 4 = 0), sum(1 + length(text)) FILTER (item_id % 4 = 0)::BIGINT FROM benchmark")
def _(t):
    path = shared_folder(t.spark)
    text = F.when(F.col("item_id") % 4 == 0, F.col("text")).otherwise(F.concat(F.lit("# T"), F.col("item_id").cast("string"), F.lit("\n"), F.col("text")))
    t.benchmark.select("item_id", text.alias("value")).write.partitionBy("item_id").text(path)
    good, bad = io.scan_documents(t.spark, f"{path}/*")
    f = lambda d, n: d.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).select(F.lit(n).alias("part"), "n", "chars")
    return f(good, "good").union(f(bad, "rejected"))


@query("q012_question_validation", "SELECT o_orderkey // 2 AS qid, concat_ws(',', CASE WHEN count(*) OVER (PARTITION BY o_orderkey // 2) > 1 THEN 'duplicate' END, CASE WHEN o_custkey % 3 = 0 THEN 'options' END, CASE WHEN o_custkey % 5 = 0 THEN 'gold' END) AS reasons FROM orders")
def _(t):
    o = t.orders
    options = F.when(F.col("o_custkey") % 3 == 0, F.create_map(F.lit("A"), F.lit("x"))).otherwise(F.create_map(F.lit("A"), F.lit("x"), F.lit("B"), F.lit("y")))
    q = o.select(F.floor(F.col("o_orderkey") / 2).alias("qid"), options.alias("options"), F.when(F.col("o_custkey") % 5 == 0, "a").otherwise("AB").alias("gold"), F.array(F.lit("d")).alias("doc_ids"))
    good, bad, _ = io.checked_questions(q, t.spark.createDataFrame([("d",)], "doc_id string"))
    return good.select("qid", F.lit("").alias("reasons")).unionByName(bad.select("qid", "reasons"))


@query("q013_keyed_upsert", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN -1.0 ELSE o_totalprice END AS price FROM orders UNION ALL SELECT -o_orderkey - 1, 0.0 FROM orders WHERE o_orderkey % 100 = 0")
def _(t):
    o = t.orders.select("o_orderkey", F.col("o_totalprice").alias("price"))
    batch = o.where("o_orderkey % 10 = 0").withColumn("price", F.lit(-1.0)).unionByName(o.where("o_orderkey % 100 = 0").select((-F.col("o_orderkey") - 1).alias("o_orderkey"), F.lit(0.0).alias("price")))
    return io.upsert(io.upsert(o, batch, ["o_orderkey"]), batch, ["o_orderkey"])


@query("q014_incremental_start", "WITH l AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS last FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1) SELECT o_orderkey FROM orders LEFT JOIN l USING (o_custkey) WHERE CAST(o_orderdate AS DATE) >= coalesce(last + 1, DATE '1999-01-01')")
def _(t):
    o = t.orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    return io.increments(o, o.where("day < '1998-01-01'"), "o_custkey", "day", F.to_date(F.lit("1999-01-01"))).select("o_orderkey")


@query("q015_run_lineage", "SELECT 'success' AS status, count(*) AS rows_written FROM orders UNION ALL SELECT 'failed', 0")
def _(t):
    load = lambda rows: lambda note: note(rows()).write.parquet(shared_folder(t.spark))
    good = io.tracked(t.spark, "table", "orders", load(lambda: t.orders.select("o_orderkey")))
    return good.unionByName(io.tracked(t.spark, "table", "none", load(lambda: t.orders.select("no_such_column")))).select("status", "rows_written")


# Two days of signals; the second run of the second day has other values for some keys.
@query("q016_signal_history", "WITH s AS (SELECT '2024-01-0' || (1 + o_orderkey % 2) AS \"asof\", o_custkey AS finding_key, o_orderpriority AS metric, max(o_orderkey) AS value FROM orders GROUP BY 1, 2, 3) SELECT \"asof\", finding_key, metric, CASE WHEN \"asof\" = '2024-01-02' AND finding_key % 3 = 0 THEN -value ELSE value END AS value FROM s")
def _(t):
    s = t.orders.groupBy(F.concat(F.lit("2024-01-0"), (1 + F.col("o_orderkey") % 2).cast("string")).alias("asof"), F.col("o_custkey").alias("finding_key"), F.col("o_orderpriority").alias("metric")).agg(F.max("o_orderkey").alias("value"))
    again = s.where("asof = '2024-01-02' and finding_key % 3 = 0").withColumn("value", -F.col("value"))
    return io.record_signals(io.record_signals(s.limit(0), s), again.unionByName(again))


VERDICTS = "CASE o_orderkey % 6 WHEN 0 THEN 'positive' WHEN 1 THEN 'review' WHEN 2 THEN 'discard' WHEN 3 THEN 'not_failure' WHEN 4 THEN 'schema_defect' ELSE 'odd' END"


def samples(t):
    return t.orders.select(F.col("o_orderkey").alias("record"), F.lit(2).alias("n_calls"), F.expr(VERDICTS).alias("verdict"))


@query("q017_verdict_sink", f"SELECT {VERDICTS} AS verdict, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    path = shared_folder(t.spark)
    rest = io.sink_parts(samples(t), path)
    back = t.spark.read.schema("record long, n_calls int, verdict string").json(path)
    return back.groupBy("verdict").agg(F.count("*").alias("n")).union(rest.groupBy("verdict").agg(F.count("*")))


@query("q018_export_manifest", f"WITH v AS (SELECT o_orderkey AS record, {VERDICTS} AS verdict FROM orders) SELECT count(*) AS samples, count(*) * 2 AS calls, " + ", ".join(f"count(*) FILTER (verdict = '{p}') AS {p}" for p in io.PARTS) + ", (sum(('0x' || substr(sha256(record || '|' || verdict), 1, 12))::BIGINT))::VARCHAR AS fingerprint, 'r1' AS rules FROM v")
def _(t):
    return io.export_manifest(samples(t), "r1")


@query("q019_question_runs_to_traces", "SELECT conv_id::VARCHAR AS trace_id, length(text)::VARCHAR AS tokens FROM conversations")
def _(t):
    rows = t.conversations.groupBy(F.col("conv_id").alias("q_id")).agg(F.lit("A").alias("answer"), F.sort_array(F.collect_list(F.struct("turn", F.length("text").alias("tokens")))).alias("details"))
    return io.runs_to_traces(rows)[1].select("trace_id", F.col("attributes")["gen_ai.usage.input_tokens"].alias("tokens"))


# Preparation.
@query("q020_column_map", "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day FROM orders", "day")
def _(t):
    return prepare.mapped(t.orders, {"o_orderkey": "id", "o_orderdate": "day", "no_such": "x"}, "day")


@query("q021_daily_change", f"WITH s AS ({SERIES}), p AS (SELECT symbol, date, round(100 * (close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1), 4) AS c FROM s) SELECT symbol, date, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY date) = 1 THEN 0 ELSE c END AS pct_chg FROM p WHERE date >= DATE '1998-01-01'", "date")
def _(t):
    return prepare.daily_change(series(t), "symbol", "date", "close", F.to_date(F.lit("1998-01-01"))).select("symbol", "date", "pct_chg")


BOARDS = [("ECONOMY", "star"), ("SMALL", "chinext"), ("STANDARD", "chinext")]


@query("q022_board_classes", "SELECT p_partkey, CASE WHEN p_type LIKE 'ECONOMY%' THEN 'star' WHEN p_type LIKE 'SMALL%' OR p_type LIKE 'STANDARD%' THEN 'chinext' ELSE 'main' END AS board FROM part")
def _(t):
    return t.part.select("p_partkey", prepare.classify(F.col("p_type"), BOARDS, "main").alias("board"))


@query("q023_price_limits", "SELECT p_partkey::VARCHAR AS symbol, CASE WHEN p_partkey % 2 = 0 AND (p_type LIKE 'ECONOMY%' OR p_type LIKE 'SMALL%' OR p_type LIKE 'STANDARD%') THEN 0.2 ELSE 0.1 END::DOUBLE AS price_limit FROM part")
def _(t):
    u = t.part.where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("symbol"), prepare.classify(F.col("p_type"), BOARDS, "main").alias("board"))
    return prepare.price_limits(t.part.select(F.col("p_partkey").cast("string").alias("symbol")), u).withColumn("price_limit", F.col("price_limit").cast("double"))


@query("q024_dividend_events", "SELECT o_custkey::VARCHAR AS symbol, CAST(o_orderdate AS DATE) AS date, 'ex_rights' AS kind, min(printf('%.2f per share', o_orderkey % 100 / 4.0)) AS detail FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1, 2", "date")
def _(t):
    return prepare.dividend_events(t.orders.select(F.col("o_custkey").cast("string").alias("symbol"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("ex_date"), (F.col("o_orderkey") % 100 / 4.0).alias("amount")))


@query("q025_listing_backfill", "WITH f AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS first FROM orders GROUP BY 1), u AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN DATE '1998-01-01' END AS d FROM customer) SELECT c_custkey, CASE WHEN first IS NOT NULL AND (d IS NULL OR d > first) THEN first ELSE d END AS list_date, coalesce(first IS NOT NULL AND (d IS NULL OR d > first), false) AS changed FROM u LEFT JOIN f ON c_custkey = o_custkey", "list_date")
def _(t):
    u = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.to_date(F.lit("1998-01-01"))).alias("list_date"))
    o = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.to_date("o_orderdate").alias("day"))
    return prepare.backfill_first(u, o, "c_custkey", "day", "list_date")


def servers(t):
    p, n = t.part, F.col("p_partkey")
    schema = lambda k: F.when(n % 4 == k, F.lit("{}"))
    tool = F.struct(F.when(n % 7 == 0, " ").otherwise(F.col("p_name")).alias("name"), schema(0).alias("input_schema"), schema(1).alias("inputSchema"), schema(2).alias("parameters"))
    return p.groupBy(F.col("p_brand").alias("server")).agg(F.array_agg(tool).alias("tools"))


DIALECT = "CASE p_partkey % 4 WHEN 0 THEN 'input_schema' WHEN 1 THEN 'inputSchema' WHEN 2 THEN 'parameters' ELSE 'none' END"


@query("q027_tool_shapes", f"SELECT p_brand AS server, CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS name, {DIALECT} AS dialect, count(*) AS n FROM part GROUP BY 1, 2, 3")
def _(t):
    tools = servers(t).select("server", F.explode("tools").alias("t")).select("server", "t.*")
    return prepare.tool_shape(tools).groupBy("server", "name", "dialect").agg(F.count("*").alias("n"))


@query("q028_tool_corpus", f"SELECT {DIALECT} AS dialect, count(*) AS n, count(*) FILTER (p_partkey % 7 = 0) AS nameless FROM part GROUP BY 1")
def _(t):
    tools = servers(t).select("server", F.posexplode("tools").alias("pos", "t")).select("server", "pos", "t.*")
    return prepare.tool_shape(tools).groupBy("dialect").agg(F.count("*").alias("n"), F.count_if(F.col("name").isNull()).alias("nameless"))


@query("q029_html_to_text", r"""WITH x AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS h FROM pages)
SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))) AS text FROM x""")
def _(t):
    return t.pages.select("page_id", F.md5(prepare.plain_text(F.col("html"))).alias("text"))


@query("q030_filing_windows", "WITH n AS (SELECT DISTINCT 'C' || (o_custkey % 50) || '_' || year(o_orderdate) || '_10K' AS doc_name, 'C' || (o_custkey % 50) AS company, year(o_orderdate)::INT AS y FROM orders), f AS (SELECT 'C' || (o_custkey % 50) AS company, CAST(o_orderdate AS DATE) AS d, o_orderkey FROM orders) SELECT doc_name, o_orderkey AS filing FROM n JOIN f USING (company) WHERE d BETWEEN make_date(y, 6, 1) AND make_date(y + 1, 5, 31)")
def _(t):
    c = F.concat(F.lit("C"), (F.col("o_custkey") % 50).cast("string"))
    names = t.orders.select(F.concat_ws("_", c, F.year("o_orderdate").cast("string"), F.lit("10K")).alias("doc_name")).distinct()
    filings = t.orders.select(c.alias("company"), F.lit("10K").alias("form"), F.to_date("o_orderdate").alias("report_date"), F.col("o_orderkey").alias("filing"))
    return prepare.filing_windows(names, filings).select("doc_name", "filing")


@query("q031_article_split", "WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, len(list_filter(l, lambda x: regexp_matches(x, '^[A-E]'))) + CASE WHEN regexp_matches(l[1], '^[A-E]') THEN 0 ELSE 1 END AS blocks FROM d")
def _(t):
    return prepare.blocks(t.documents.select("doc_id", "text"), "^[A-E]").groupBy("doc_id").agg(F.count("*").alias("blocks"))


@query("q032_run_log", "SELECT o_custkey::VARCHAR AS file, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS run, o_orderkey::VARCHAR AS findings, CASE WHEN o_orderkey % 2 = 0 THEN '9.5' END AS health FROM (SELECT DISTINCT o_custkey, o_orderkey FROM orders)")
def _(t):
    o = t.orders.select("o_custkey", "o_orderkey").distinct()
    lines = o.select(F.col("o_custkey").cast("string").alias("file"), F.explode(F.array(F.struct((F.col("o_orderkey") * 2).alias("line_no"), F.lit("== run").alias("line")), F.struct((F.col("o_orderkey") * 2 + 1).alias("line_no"), F.concat(F.lit("findings="), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ", health=9.5").otherwise("")).alias("line")))).alias("x")).select("file", "x.*")
    return prepare.run_log(lines).select("file", F.col("run").cast("int").alias("run"), "findings", "health")


@query("q033_run_lengths", "WITH c AS (SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1)::INT AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM c) SELECT user_id, run::BIGINT AS run, any_value(event_type) AS event_type, count(*) AS length FROM g GROUP BY 1, 2")
def _(t):
    return intervals.run_lengths(t.events.select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type").drop("first_place")


# Streams: a run over all that is there equals the batch result.
def _stream(t, df, parts=4):
    path = shared_folder(t.spark)
    df.repartition(parts, "event_id").write.parquet(path)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path), shared_folder(t.spark)


@query("s01_stream_upsert", "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def _(t):
    rows, out = _stream(t, t.events.select("user_id", "event_id", "value"), 1)
    streams.to_end(streams.sink_upsert(rows, out, ["user_id"], f"{out}-check", "event_id"))
    return t.spark.read.parquet(out).select("user_id", "event_id", "value")


@query("s02_stream_windows", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t):
    rows, out = _stream(t, t.events.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts")))
    fresh = streams.increments(rows, ["event_id"], "ts", "60 days")
    q = fresh.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-check").trigger(availableNow=True).start()
    streams.to_end(q)
    return t.spark.read.schema("event_id long, event_type string").parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@query("s03_stream_verdicts", "SELECT CASE WHEN event_type = 'error' THEN 'discard' ELSE 'positive' END AS verdict, count(*) AS n FROM events GROUP BY 1")
def _(t):
    rows, out = _stream(t, t.events.select("event_id", "event_type"))
    v = rows.select("event_id", F.when(F.col("event_type") == "error", "discard").otherwise("positive").alias("verdict"))
    streams.to_end(streams.sink_verdicts(v, out, f"{out}-check"))
    return t.spark.read.schema("event_id long, verdict string").json(out).groupBy("verdict").agg(F.count("*").alias("n"))
