"""Queries over traces (events of a user on a day) and tool calls (orders)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import traces as tr
from plumbline.plans.registry import query

TRACES = """st AS (SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS trace_id, event_id AS seq, CASE WHEN event_type = 'signup' THEN 'parse_query' ELSE event_type END AS name, props, strftime(ts, '%Y-%m-%d') AS day,
CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'error' WHEN event_type = 'view' AND event_id % 5 = 0 THEN 'degraded' ELSE 'ok' END AS status,
CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN CASE event_id % 4 WHEN 0 THEN 'call timed out' WHEN 1 THEN 'unknown tool: x' WHEN 2 THEN 'invalid param k' ELSE 'boom' END WHEN event_type = 'view' AND event_id % 5 = 0 THEN 'range lacks start/end' END AS error,
CASE WHEN event_id % 6 = 0 THEN '2020-02-02' ELSE strftime(ts, '%Y-%m-%d') END AS as_of FROM events),
tr AS (SELECT trace_id, any_value(day) AS day, min(seq) AS k, CASE min(seq) % 11 WHEN 0 THEN 'aborted:slot_incomplete:as_of' WHEN 1 THEN 'aborted:no symbol' ELSE '' END AS err, CASE WHEN min(seq) % 4 = 0 THEN 'how many rows' ELSE 'rows on ' || any_value(day) END AS task FROM st GROUP BY 1)"""


def traces(t):
    e = t.events
    day = F.date_format("ts", "yyyy-MM-dd")
    n = F.col("event_id")
    bad, soft = (F.col("event_type") == "error") & (n % 3 == 0), (F.col("event_type") == "view") & (n % 5 == 0)
    error = F.when(bad, F.when(n % 4 == 0, "call timed out").when(n % 4 == 1, "unknown tool: x").when(n % 4 == 2, "invalid param k").otherwise("boom")).when(soft, "range lacks start/end")
    result = F.create_map(F.lit("as_of"), F.when(n % 6 == 0, "2020-02-02").otherwise(day), F.lit("symbol"), F.col("event_type"))
    name = F.when(F.col("event_type") == "signup", "parse_query").otherwise(F.col("event_type"))
    s = F.struct(n.alias("seq"), name.alias("name"), F.from_json("props", "map<string,string>").alias("arguments"), result.alias("result"), F.when(bad, "error").when(soft, "degraded").otherwise("ok").alias("status"), error.alias("error"))
    g = e.groupBy(F.concat_ws("-", F.col("user_id").cast("string"), day).alias("trace_id")).agg(F.array_sort(F.collect_list(s), lambda a, b: (a["seq"] - b["seq"]).cast("int")).alias("steps"), F.min(day).alias("day"), F.min("event_id").alias("k"))
    k = F.col("k")
    outcome = F.struct(
        F.when(k % 11 == 0, "aborted:slot_incomplete:as_of").when(k % 11 == 1, "aborted:no symbol").otherwise("").alias("error"), (k % 13 != 0).alias("matches"), (k % 2 == 0).alias("correct"), F.lit(False).alias("should_refuse"), F.lit(False).alias("refused"), (k % 17 != 0).alias("usable"), F.lit("BASELINE").alias("badge"),
    )
    return g.select("trace_id", F.when(k % 4 == 0, "how many rows").otherwise(F.concat(F.lit("rows on "), F.col("day"))).alias("task"), "steps", outcome.alias("outcome"), F.create_map(F.lit("as_of"), F.col("day"), F.lit("symbol"), F.lit("signup")).alias("golden"), (k % 2).cast("string").alias("parser"))


@query("q106_degraded_steps", f"WITH {TRACES} SELECT trace_id, count(*) AS n, string_agg(name, ',' ORDER BY seq) AS names FROM st WHERE status = 'degraded' GROUP BY 1")
def _(t):
    return traces(t).select("trace_id", tr.degraded(F.col("steps")).alias("d")).where("d.n > 0").select("trace_id", F.col("d.n").cast("long").alias("n"), "d.names")


@query("q107_aborts", f"WITH {TRACES} SELECT trace_id, substr(err, 9) AS code FROM tr WHERE err LIKE 'aborted:%'")
def _(t):
    return traces(t).select("trace_id", tr.aborted(F.col("outcome.error")).alias("code")).where("code is not null")


STORM = "sto AS (SELECT trace_id, max(n) AS worst, max(calls) AS by_name FROM (SELECT trace_id, name, max(n) AS n, sum(n)::BIGINT AS calls FROM (SELECT trace_id, name, props, count(*) AS n FROM st GROUP BY ALL) GROUP BY 1, 2) GROUP BY 1 HAVING max(n) >= 2)"


@query("q108_retry_storms", f"WITH {TRACES}, {STORM} SELECT * FROM sto")
def _(t):
    return tr.retry_storms(traces(t))


LOOSE = """fp AS (SELECT trace_id, arg_min(as_of, seq) AS value FROM st WHERE name = 'parse_query' GROUP BY 1), ug AS (SELECT fp.trace_id, 'as_of' AS slot, value, CASE WHEN NOT regexp_matches(task, '[0-9]') THEN 'unverifiable' WHEN contains(task, value) THEN 'grounded'
WHEN (day(value::DATE) = 1 OR value::DATE = last_day(value::DATE)) AND contains(task, substr(value, 1, 7)) THEN 'grounded' ELSE 'ungrounded' END AS state FROM fp JOIN tr USING (trace_id))"""


@query("q109_ungrounded_slots", f"WITH {TRACES}, {LOOSE} SELECT * FROM ug")
def _(t):
    return tr.ungrounded(traces(t))


@query("q110_silent_mismatches", f"WITH {TRACES}, f AS (SELECT trace_id, arg_min(as_of, seq) AS a FROM st WHERE name = 'parse_query' GROUP BY 1) SELECT tr.trace_id, CASE WHEN f.a IS NULL THEN 'symbol,as_of' WHEN f.a <> day THEN 'as_of' ELSE '' END AS slots FROM tr LEFT JOIN f USING (trace_id) WHERE k % 13 = 0")
def _(t):
    return tr.mismatches(traces(t))


DIAG = f"""{TRACES}, {STORM}, {LOOSE}, e AS (SELECT trace_id, string_agg(error, ' ') FILTER (status = 'error') AS text, count(*) FILTER (status = 'degraded') AS soft FROM st GROUP BY 1),
dg AS (SELECT tr.trace_id, CASE WHEN err LIKE '%as_of' THEN 'abort_as_of' WHEN err LIKE 'aborted:%' THEN 'abort_symbol' WHEN contains(text, 'timed out') THEN 'env_timeout' WHEN contains(text, 'unknown tool') THEN 'tool_missing' WHEN contains(text, 'invalid') THEN 'param_error' WHEN text IS NOT NULL THEN 'step_error'
WHEN worst >= 2 THEN 'retry_loop' WHEN state = 'ungrounded' THEN 'hallucinated_date' WHEN k % 13 = 0 THEN 'parse_mismatch' WHEN soft > 0 AND k % 2 = 0 THEN 'lucky_guess' WHEN soft > 0 AND task = 'how many rows' THEN 'degrade_month_expansion' WHEN soft > 0 THEN 'degrade_missing_slots'
WHEN k % 17 = 0 THEN 'guard_flagged' ELSE 'ok' END AS category, (k % 2)::VARCHAR AS parser FROM tr JOIN e USING (trace_id) LEFT JOIN sto USING (trace_id) LEFT JOIN ug USING (trace_id)),
ds AS (SELECT *, CASE WHEN category IN ('ok', 'guard_flagged') THEN 'ok' WHEN category IN ('hallucinated_date', 'parse_mismatch') THEN 'silent' ELSE 'loud' END AS severity FROM dg)"""
VERDICT = "CASE " + " ".join(f"WHEN category = '{c}' THEN '{v}'" for c, v in tr.VERDICTS.items()) + " ELSE 'review' END"


def diagnosed(t):
    x = traces(t)
    return tr.diagnose(x).join(x.select("trace_id", "parser"), "trace_id")


@query("q115_trace_diagnosis", f"WITH {DIAG} SELECT trace_id, category, severity FROM ds")
def _(t):
    return tr.diagnose(traces(t))


@query("q116_verdicts", f"WITH {DIAG} SELECT trace_id, {VERDICT} AS verdict FROM ds")
def _(t):
    return tr.with_verdict(tr.diagnose(traces(t))).select("trace_id", "verdict")


@query("q117_trace_summary", f"""WITH {DIAG}, u AS (SELECT 'category' AS part, category AS name, severity FROM ds UNION ALL SELECT 'severity', severity, severity FROM ds UNION ALL SELECT 'parser', parser, severity FROM ds)
SELECT part, name, count(*) AS n, count(*) FILTER (severity = 'silent') AS silent, count(*) FILTER (severity = 'loud') AS loud FROM u GROUP BY 1, 2""")
def _(t):
    return tr.summary(diagnosed(t))


# Tool calls: two for each order. Specs that stand fixed, and one tool for each part brand, whose parameters and defaults come from its parts.
PARAMS = (
    ("t0", 1, "a", "the amount", None), ("t0", 1, "b", "the unit", "1"), ("t1", 1, "perm", "permittivity, default is 8.85e-12", None), ("t1", 1, "charge", "the charge", "8.85e-12"), ("t1", 1, "dist", "distance", "0.00000000000885"),
    ("t2", 1, "limit", "Rows to return. Defaults to 10", None), ("t2", 1, "a", "返回条数，缺省 10", None), ("t3", 1, "note", "Optional remark", None), ("t3", 1, "x", "可选的备注", None), ("t4", 1, "x", "the x, 0 if omitted", None), ("t4", 2, "y", "the y", None),
)
PARAM_SQL = "pa AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {s}, '{p}', '{d}', {f"'{v}'" if v else 'CAST(NULL AS VARCHAR)'})" for n, s, p, d, v in PARAMS) + ") AS x(name, spec_no, param, description, dflt))"
# Each part is a parameter of its brand's tool; every third says in words which default it has, the others have one.
BRAND_SQL = """bp AS (SELECT p_brand AS name, 1 AS spec_no, 'p' || p_partkey AS param, CASE WHEN p_partkey % 3 = 0 THEN 'size, default is ' || p_size || '.0' ELSE p_type END AS description, CASE WHEN p_partkey % 3 <> 0 THEN p_size::VARCHAR END AS dflt FROM part)"""


def brand_params(t):
    third = F.col("p_partkey") % 3 == 0
    size = F.col("p_size").cast("string")
    return t.part.select(F.col("p_brand").alias("name"), F.lit(1).alias("spec_no"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("param"), F.when(third, F.concat(F.lit("size, default is "), size, F.lit(".0"))).otherwise(F.col("p_type")).alias("description"), F.when(~third, size).alias("default"))


CALLS = """ca AS (SELECT o_orderkey AS record, pos, 't' || (CASE WHEN pos = 2 AND o_orderkey % 9 = 0 THEN o_custkey ELSE o_custkey + pos - 1 END) % 6 AS name,
CASE (CASE WHEN pos = 2 AND o_orderkey % 9 = 0 THEN o_orderkey ELSE o_orderkey + pos - 1 END) % 4 WHEN 0 THEN ['a'] WHEN 1 THEN ['x'] WHEN 2 THEN ['a', 'y'] ELSE ['limit', 'perm'] END AS keys FROM orders, (VALUES (1), (2)) AS p(pos))"""


def params(t):
    return t.spark.createDataFrame(list(PARAMS), "name string, spec_no int, param string, description string, default string")


def calls(t):
    pos = F.explode(F.array(F.lit(1), F.lit(2))).alias("pos")
    o = t.orders.select("o_orderkey", "o_custkey", pos)
    same = (F.col("pos") == 2) & (F.col("o_orderkey") % 9 == 0)
    shift = F.when(same, 0).otherwise(F.col("pos") - 1)
    keys, k = lambda *x: F.array(*[F.lit(v) for v in x]), (F.col("o_orderkey") + shift) % 4
    names = F.when(k == 0, keys("a")).when(k == 1, keys("x")).when(k == 2, keys("a", "y")).otherwise(keys("limit", "perm"))
    arguments = F.map_from_arrays(names, F.transform(names, lambda x: F.lit("1")))
    return o.select(F.col("o_orderkey").alias("record"), "pos", F.concat(F.lit("t"), ((F.col("o_custkey") + shift) % 6).cast("string")).alias("name"), arguments.alias("arguments"))


@query("q111_misplaced_defaults", f"""WITH {PARAM_SQL}, {BRAND_SQL}, al AS (SELECT * FROM pa UNION ALL SELECT * FROM bp), w AS (SELECT *, regexp_extract(lower(description), 'default\\s*(?:is|value\\s+is|=|:)?\\s*([-+]?[0-9]*\\.?[0-9]+(?:[eE][-+]?[0-9]+)?)', 1) AS claimed FROM al WHERE dflt IS NULL)
SELECT w.name, w.spec_no, w.param, w.claimed, string_agg(DISTINCT h.param, '/' ORDER BY h.param) AS holders FROM w JOIN al h ON h.name = w.name AND h.spec_no = w.spec_no AND h.param <> w.param AND h.dflt IS NOT NULL AND try_cast(h.dflt AS DOUBLE) = try_cast(w.claimed AS DOUBLE) WHERE w.claimed <> '' GROUP BY 1, 2, 3, 4""")
def _(t):
    return tr.misplaced_defaults(params(t).unionByName(brand_params(t)))


ISSUES = """iss AS (SELECT record, pos, spec_no, CASE WHEN pa.param = 'perm' THEN 'misplaced' WHEN regexp_matches(lower(description), 'default|默认值|缺省') THEN 'contradiction_value' WHEN regexp_matches(lower(description), 'optional|可选|if not provided') THEN 'contradiction_optional' ELSE 'missing' END AS kind, param FROM ca JOIN pa USING (name) WHERE dflt IS NULL AND NOT list_contains(keys, param)
UNION ALL SELECT record, pos, spec_no, 'unknown', k FROM (SELECT record, pos, name, unnest(keys) AS k FROM ca) c JOIN (SELECT DISTINCT name, spec_no FROM pa) s USING (name) WHERE NOT EXISTS (SELECT 1 FROM pa WHERE pa.name = c.name AND pa.spec_no = s.spec_no AND pa.param = k))"""


@query("q112_call_check_one_spec", f"WITH {PARAM_SQL}, {CALLS}, {ISSUES} SELECT * FROM iss")
def _(t):
    return tr.call_issues(calls(t), params(t))


BEST = """ni AS (SELECT ca.record, ca.pos, ca.name, ca.keys, s.spec_no, CASE WHEN s.spec_no IS NULL THEN 1 ELSE count(iss.kind) END AS n, CASE WHEN s.spec_no IS NULL THEN 'not_found:' || ca.name ELSE coalesce(string_agg(iss.kind || ':' || iss.param, '; ' ORDER BY iss.kind || ':' || iss.param), '') END AS issues
FROM ca LEFT JOIN (SELECT DISTINCT name, spec_no FROM pa) s ON s.name = ca.name LEFT JOIN iss ON iss.record = ca.record AND iss.pos = ca.pos AND iss.spec_no = s.spec_no GROUP BY ca.record, ca.pos, ca.name, ca.keys, s.spec_no),
be AS (SELECT record, pos, name, any_value(keys) AS keys, arg_min(issues, n * 10 + coalesce(spec_no, 0)) AS issues FROM ni GROUP BY 1, 2, 3)"""
CHECKED = f"WITH {PARAM_SQL}, {CALLS}, {ISSUES}, {BEST}, ste AS (SELECT record, pos, name, CASE WHEN issues <> '' THEN issues WHEN row_number() OVER (PARTITION BY record, name, keys ORDER BY pos) > 1 THEN 'duplicate call' END AS error FROM be)"


@query("q113_call_check_best_spec", f"WITH {PARAM_SQL}, {CALLS}, {ISSUES}, {BEST} SELECT record, pos, name, issues FROM be")
def _(t):
    return tr.best_issues(calls(t), params(t)).withColumn("issues", F.array_join("issues", "; "))


@query("q114_record_to_trace", f"{CHECKED} SELECT record, pos, name, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status, error FROM ste")
def _(t):
    return tr.record_steps(calls(t), params(t))


@query("q118_training_examples", """SELECT o_orderkey AS record, '{"id":' || o_orderkey || ',"messages":[{"role":"user","content":"order ' || o_orderkey || '"},{"role":"assistant","content":"","tool_calls":[{"type":"function","function":{"name":"t' || (o_custkey % 6) || '","arguments":"{\\"a\\":\\"' || o_custkey || '\\",\\"b\\":\\"x\\"}"}}]}],"tools":"[]"}' AS example FROM orders""")
def _(t):
    answers = F.array(F.struct(F.concat(F.lit("t"), (F.col("o_custkey") % 6).cast("string")).alias("name"), F.create_map(F.lit("b"), F.lit("x"), F.lit("a"), F.col("o_custkey").cast("string")).alias("arguments")))
    return t.orders.select(F.col("o_orderkey").alias("record"), tr.training_example(F.col("o_orderkey"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), answers, F.lit("[]")).alias("example"))


@query("q119_tool_defect_tally", f"""{CHECKED}, i AS (SELECT record, name, unnest(string_split(error, '; ')) AS issue FROM ste), k AS (SELECT string_split(issue, ':')[1] AS kind, name AS tool, string_split(issue, ':')[2] AS param, record, issue FROM i WHERE issue LIKE 'misplaced%' OR issue LIKE 'contradiction%')
SELECT kind, tool, param, count(*) AS hits, arg_min(issue, record) AS first_detail, array_to_string(list_sort(list(DISTINCT record))[1:3], ',') AS samples FROM k GROUP BY 1, 2, 3""")
def _(t):
    return tr.defect_tally(tr.record_steps(calls(t), params(t))).withColumn("samples", F.array_join("samples", ","))


FILTERED = """fl AS (SELECT record, count(*) AS n_calls, bool_or(error LIKE '%misplaced%' OR error LIKE '%contradiction%') AS sch, bool_or(error LIKE 'not_found%') AS nf, bool_or(error LIKE '%missing%') AS mi, bool_or(error LIKE '%unknown%') AS un, bool_or(error = 'duplicate call') AS du FROM ste GROUP BY 1),
ve AS (SELECT record, n_calls, CASE WHEN sch THEN 'schema_defect' WHEN nf THEN 'not_failure' WHEN mi OR un THEN 'discard' WHEN du THEN 'review' ELSE 'positive' END AS verdict, CASE WHEN sch OR mi THEN 'schema_defect' WHEN nf THEN 'not_failure' WHEN un THEN 'discard' WHEN du THEN 'review' ELSE 'positive' END AS lenient FROM fl)"""


@query("q120_trust_filter", f"{CHECKED}, {FILTERED} SELECT record, n_calls, verdict FROM ve")
def _(t):
    return tr.filtered(calls(t), params(t)).drop("kinds")


@query("q121_premise_sensitivity", f"""{CHECKED}, {FILTERED}, u AS (SELECT verdict, 1 AS s, 0 AS l FROM ve UNION ALL SELECT lenient, 0, 1 FROM ve) SELECT verdict, sum(s)::BIGINT AS strict, sum(l)::BIGINT AS lenient, (sum(l) - sum(s))::BIGINT AS difference FROM u GROUP BY 1""")
def _(t):
    return tr.premise_sensitivity(calls(t), params(t))
