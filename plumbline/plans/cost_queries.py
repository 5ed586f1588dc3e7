"""Queries over the cost of conversations (assistant turns as tool output, later turns as references) and of events (runs of users in arms)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import cost
from plumbline.plans.registry import query
from plumbline.shared import written

STOP = "(" + ", ".join(f"'{w}'" for w in cost.STOPWORDS) + ")"


def toks(x):
    return f"list_sort(list_distinct(list_filter(list_transform(list_concat(regexp_extract_all(coalesce({x}, ''), '{cost.IDENTIFIER}'), regexp_extract_all(coalesce({x}, ''), '[0-9]+(?:\\.[0-9]+)?')), lambda w: lower(w)), lambda w: regexp_matches(w, '[^._:/<>-]'))))"


def dist(x):
    return f"list_filter({x}, lambda w: NOT list_contains([{STOP[1:-1]}], w) AND length(w) >= CASE WHEN regexp_matches(w, '^[0-9]+$') THEN 6 ELSE 5 END)"


# Tool outputs of four shapes: paths, a file of definitions in a fence, hits under headings, and one that no rule knows.
CALLS = """ca AS (SELECT conv_id AS task, turn, turn AS call, CASE length(text) % 4 WHEN 0 THEN 'list_files' WHEN 1 THEN 'read_file' WHEN 2 THEN 'search_code' ELSE 'other' END AS tool, 'k' || (length(text) % 4) AS args, CASE WHEN conv_id % 13 = 0 THEN 'error' ELSE 'ok' END AS result_code,
  CASE length(text) % 4 WHEN 1 THEN '```py' || chr(10) || replace(text, chr(10), chr(10) || 'def ') || chr(10) || '```' WHEN 2 THEN replace(text, chr(10), chr(10) || '### ') ELSE text END AS payload FROM conversations WHERE role = 'assistant'),
tu AS (SELECT conv_id AS task, turn, length(text) AS chars, length(text) // 4 AS prompt_tokens, 100 AS tools_chars FROM conversations)"""


def calls(t):
    m = F.length("text") % 4
    tool = F.when(m == 0, "list_files").when(m == 1, "read_file").when(m == 2, "search_code").otherwise("other")
    payload = F.when(m == 1, F.concat(F.lit("```py\n"), F.replace("text", F.lit("\n"), F.lit("\ndef ")), F.lit("\n```"))).when(m == 2, F.replace("text", F.lit("\n"), F.lit("\n### "))).otherwise(F.col("text"))
    rows = t.conversations.where("role = 'assistant'")
    return rows.select(F.col("conv_id").alias("task"), "turn", F.col("turn").alias("call"), tool.alias("tool"), F.concat(F.lit("k"), m.cast("string")).alias("args"), F.when(F.col("conv_id") % 13 == 0, "error").otherwise("ok").alias("result_code"), payload.alias("payload"))


def turns(t):
    return t.conversations.select(F.col("conv_id").alias("task"), "turn", F.length("text").alias("chars"), F.floor(F.length("text") / 4).alias("prompt_tokens"), F.lit(100).alias("tools_chars"))


def texts(t):
    return t.conversations.select(F.col("conv_id").alias("task"), "turn", "text")


@query("q122_value_tokens", f"SELECT conv_id, turn, array_to_string({toks('text')}, ' ') AS tokens, len({dist(toks('text'))}) AS distinctive FROM conversations")
def _(t):
    k = cost.value_tokens(F.col("text"))
    return t.conversations.select("conv_id", "turn", F.array_join(k, " ").alias("tokens"), F.size(cost.distinctive(k)).cast("long").alias("distinctive"))


SEGS = """sl AS (SELECT task, turn, call, tool, string_split(payload, chr(10)) AS l FROM ca WHERE result_code = 'ok' AND payload <> ''), si AS (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM sl),
sk AS (SELECT task, turn, call, tool, i, l, CASE tool WHEN 'list_files' THEN 'path' WHEN 'read_file' THEN CASE WHEN len(l) = 3 THEN 'whole' ELSE 'block' END WHEN 'search_code' THEN CASE WHEN i = 1 THEN 'header' ELSE 'hit' END END AS kind FROM si
  WHERE CASE tool WHEN 'list_files' THEN trim(l[i]) <> '' WHEN 'read_file' THEN i < len(l) AND (len(l) = 3 AND i = 2 AND trim(l[2]) <> '' OR i > 2) WHEN 'search_code' THEN len(l) > 1 AND (i > 1 OR trim(l[1]) <> '') END),
sg AS (SELECT task, turn, call, tool, kind, row_number() OVER (PARTITION BY task, turn ORDER BY i) - 1 AS seg, CASE tool WHEN 'list_files' THEN trim(l[i]) ELSE l[i] END AS text FROM sk)"""
CTX = f"""tk AS (SELECT conv_id AS task, turn, unnest({toks('text')}) AS w FROM conversations), cx AS (SELECT task, turn, (SELECT list_distinct(list(w)) FROM tk WHERE tk.task = c.task AND tk.turn < c.turn) AS before, (SELECT list_distinct(list(w)) FROM tk WHERE tk.task = c.task AND tk.turn > c.turn) AS after FROM (SELECT DISTINCT conv_id AS task, turn FROM conversations) c)"""
RECORDS = f"""re AS (SELECT sg.*, length(text) AS chars, {toks('text')} AS tk0, coalesce(before, []) AS before, coalesce(after, []) AS after FROM sg JOIN cx USING (task, turn)),
rd AS (SELECT *, {dist('tk0')} AS telling FROM re), rc AS (SELECT *, list_sort(list_filter(telling, lambda w: NOT list_contains(before, w)))[1:120] AS tokens, len(list_filter(telling, lambda w: list_contains(before, w))) AS n_preexisting, len(tk0) - len(telling) AS n_indistinct FROM rd),
ju AS (SELECT *, len(list_intersect(tokens, after)) AS hits, CASE WHEN len(tokens) = 0 THEN 'unverifiable' WHEN len(list_intersect(tokens, after)) >= 1 THEN 'referenced' ELSE 'not_referenced_this_run' END AS verdict FROM rc)"""
BASE = f"WITH {CALLS}, {SEGS}, {CTX}, {RECORDS}"


def records(t):
    return cost.records(cost.segments(calls(t)), cost.lifetimes(texts(t)))


def judged(t):
    return cost.judged(records(t))


@query("q123_field_records", f"{BASE} SELECT task, turn, seg::INT AS seg, chars, array_to_string(tokens, ' ') AS tokens, n_preexisting, n_indistinct FROM rc")
def _(t):
    return records(t).select("task", "turn", "seg", F.col("chars").cast("long").alias("chars"), F.array_join("tokens.token", " ").alias("tokens"), *[F.col(c).cast("long").alias(c) for c in ("n_preexisting", "n_indistinct")])


@query("q124_payload_segments", f"WITH {CALLS}, {SEGS} SELECT task, turn, seg::INT AS seg, tool, kind, text FROM sg")
def _(t):
    return cost.segments(calls(t)).drop("call")


@query("q125_reference_verdicts", f"{BASE} SELECT task, turn, seg::INT AS seg, hits, verdict FROM ju")
def _(t):
    return judged(t).select("task", "turn", "seg", F.col("hits").cast("long").alias("hits"), "verdict")


@query("q126_before_after_context", f"WITH {CTX} SELECT task, turn, len(coalesce(before, [])) AS before, len(coalesce(after, [])) AS after FROM cx")
def _(t):
    return cost.context_sizes(texts(t), cost.lifetimes(texts(t)))


LAST = f"an AS (SELECT task, {toks('arg_max(text, turn)')} AS answer FROM (SELECT conv_id AS task, turn, text FROM conversations) GROUP BY 1)"


@query("q127_hit_split", f"{BASE}, {LAST} SELECT task, turn, seg::INT AS seg, len(list_intersect(tokens, after)) AS in_arguments, len(list_filter(list_intersect(tokens, answer), lambda w: NOT list_contains(after, w))) AS only_in_answer FROM rc JOIN an USING (task)")
def _(t):
    return cost.hit_split(records(t)).select("task", "turn", "seg", F.col("in_arguments").cast("long").alias("in_arguments"), F.col("only_in_answer").cast("long").alias("only_in_answer"))


# Tokens within payloads of later calls of the task, whether they are words there or not.
@query("q128_tool_flow", f"""WITH {CALLS}, {SEGS}, a AS (SELECT task, turn, call, seg, tool, unnest({dist(toks('text'))}) AS w FROM sg), b AS (SELECT task, turn, tool, lower(payload) AS args FROM ca),
h AS (SELECT DISTINCT a.tool AS from_tool, b.tool AS to_tool, a.task, a.turn, a.call, a.seg, w FROM a JOIN b ON a.task = b.task AND b.turn > a.turn AND contains(b.args, w)), f AS (SELECT from_tool, to_tool, w, min((task, turn, call, seg)) AS pos FROM h GROUP BY 1, 2, 3),
s AS (SELECT from_tool, to_tool, string_agg(w, ' ' ORDER BY pos, w) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY from_tool, to_tool ORDER BY pos, w) AS r FROM f) WHERE r <= 8 GROUP BY 1, 2)
SELECT from_tool, to_tool, count(*) AS token_hits, count(DISTINCT (task, turn, call, seg)) AS segments, any_value(samples) AS samples FROM h JOIN s USING (from_tool, to_tool) GROUP BY 1, 2""")
def _(t):
    return cost.tool_flow(cost.segments(calls(t)), calls(t).withColumn("args", F.col("payload"))).withColumn("samples", F.array_join("samples", " "))


STATES = ("referenced", "not_referenced_this_run", "unverifiable")


@query("q129_per_tool", f"{BASE}, k AS (SELECT tool, result_code, count(*) AS n FROM ca GROUP BY 1, 2), x AS (SELECT tool, count(*) AS calls, sum(length(payload))::BIGINT AS payload_chars, count(*) FILTER (result_code = 'ok') AS ok FROM ca GROUP BY 1), c AS (SELECT tool, string_agg(result_code || '=' || n, ',' ORDER BY result_code) AS codes FROM k GROUP BY 1), y AS (SELECT tool, count(*) AS segments, sum(chars)::BIGINT AS segment_chars, count(DISTINCT (task, turn)) AS calls_with_segments, "
  + ", ".join(f"count(*) FILTER (verdict = '{v}') AS {v.removesuffix('_this_run')}, coalesce(sum(chars) FILTER (verdict = '{v}'), 0)::BIGINT AS {v.removesuffix('_this_run')}_chars" for v in STATES)
  + " FROM ju GROUP BY 1) SELECT x.*, codes, coalesce(segments, 0) AS segments, coalesce(segment_chars, 0) AS segment_chars, coalesce(calls_with_segments, 0) AS calls_with_segments, greatest(0, calls - coalesce(calls_with_segments, 0)) AS calls_no_shape, " + ", ".join(f"coalesce({v.removesuffix('_this_run')}{e}, 0) AS {v.removesuffix('_this_run')}{e}" for v in STATES for e in ("", "_chars")) + " FROM x JOIN c USING (tool) LEFT JOIN y USING (tool)")
def _(t):
    return cost.per_tool(calls(t), judged(t)).withColumn("codes", F.array_join(F.transform(F.map_entries("codes"), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))


@query("q130_chars_per_token", f"WITH {CALLS}, r AS (SELECT prompt_tokens / chars AS r, row_number() OVER (ORDER BY prompt_tokens / chars) - 1 AS i, count(*) OVER () AS n FROM tu WHERE prompt_tokens > 0 AND chars > 0) SELECT round((SELECT sum(prompt_tokens) / sum(chars) FROM tu WHERE prompt_tokens > 0), 6) AS total, max(n) AS turns, " + ", ".join(f"round(max(r) FILTER (i = round_even({q} * (n - 1), 0)), 6) AS p{int(q * 100)}" for q in (0.1, 0.5, 0.9)) + " FROM r")
def _(t):
    r = cost.chars_per_token(turns(t))
    return r.select(F.round("total", 6).alias("total"), "turns", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p90")])


# Lists of tools from brands and types of parts, their definitions a part's; turns say how long the list was that they carried: the one of size 7.
LISTS = """tl AS (SELECT 's' || p_size AS name, p_type AS tool, '{"name": "' || p_type || '", "n": ' || count(*) || '}' AS definition FROM part WHERE p_size IN (5, 7, 9) GROUP BY p_size, p_type),
td AS (SELECT * FROM tl UNION ALL SELECT DISTINCT name, 'read_file', '{"name": "read_file"}' FROM tl), sz AS (SELECT name, sum(length(definition)) + 2 * count(*) AS chars FROM td GROUP BY 1),
tn AS (SELECT tu.* REPLACE ((SELECT chars FROM sz WHERE name = 's7') AS tools_chars) FROM tu), of AS (SELECT * FROM td WHERE name = (SELECT min(name) FROM sz WHERE chars IN (SELECT tools_chars FROM tn)))"""


def lists(t):
    p = t.part.where("p_size in (5, 7, 9)").groupBy(F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("name"), F.col("p_type").alias("tool")).agg(F.count("*").alias("n"))
    rows = p.select("name", "tool", F.concat(F.lit('{"name": "'), "tool", F.lit('", "n": '), F.col("n").cast("string"), F.lit("}")).alias("definition"))
    return rows.unionByName(p.select("name", F.lit("read_file").alias("tool"), F.lit('{"name": "read_file"}').alias("definition")).distinct())


@query("q131_uncalled_tools", f"WITH {CALLS}, {LISTS}, i AS (SELECT * FROM of WHERE tool NOT IN (SELECT tool FROM ca)) SELECT count(*) AS tools, coalesce(sum(length(definition)), 0)::BIGINT AS chars, coalesce(string_agg(tool, ',' ORDER BY tool), '') AS names, (SELECT count(*) FROM tu) AS turns, (coalesce(sum(length(definition)), 0) * (SELECT count(*) FROM tu))::BIGINT AS saving FROM i")
def _(t):
    size = lists(t).where("name = 's7'").agg((F.sum(F.length("definition")) + 2 * F.count("*")).alias("tools_chars"))
    carried = turns(t).drop("tools_chars").crossJoin(F.broadcast(size))  # one row
    return cost.uncalled_tools(cost.offered(lists(t), carried), calls(t), turns(t))


LEFT = "lf AS (SELECT ju.*, greatest(0, (SELECT max(turn) FROM tu WHERE tu.task = ju.task) - turn) AS rest FROM ju)"


@query("q132_large_unreferenced", f"{BASE}, {LEFT} SELECT tool, kind, count(*) AS segments, sum(chars * rest)::BIGINT AS saving FROM lf WHERE chars >= 200 AND verdict = 'not_referenced_this_run' AND rest > 0 GROUP BY 1, 2")
def _(t):
    return cost.large_unreferenced(judged(t), turns(t))


@query("q133_many_small", f"{BASE}, {LEFT} SELECT tool, kind, count(*) AS segments, sum(chars)::BIGINT AS chars, sum(chars * rest)::BIGINT AS saving FROM lf WHERE chars < 200 AND verdict = 'not_referenced_this_run' AND rest > 0 GROUP BY 1, 2 HAVING count(*) >= 2 AND sum(chars) >= 2000")
def _(t):
    return cost.many_small(judged(t), turns(t))


@query("q134_repeated_calls", f"WITH {CALLS}, r AS (SELECT *, row_number() OVER (PARTITION BY task, tool, args ORDER BY turn) AS n FROM ca) SELECT tool, count(*) AS calls, sum(length(payload) * greatest(0, (SELECT max(turn) FROM tu WHERE tu.task = r.task) - turn))::BIGINT AS saving FROM r WHERE n > 1 AND result_code = 'ok' GROUP BY 1")
def _(t):
    return cost.repeated_calls(calls(t), turns(t))


# Arms: users' event counts and sums in even and odd events.
ARMS = "ar AS (SELECT user_id AS task, event_id % 2 AS arm, count(*) AS tokens, sum(value) AS v FROM events WHERE NOT (user_id % 10 = 3 AND event_id % 2 = 1) GROUP BY 1, 2), aa AS (SELECT * FROM ar WHERE arm = 0), bb AS (SELECT * FROM ar WHERE arm = 1)"


def arm(t, k):
    e = t.events.where(F.col("event_id") % 2 == k).where(~((F.col("user_id") % 10 == 3) & (F.col("event_id") % 2 == 1)))
    return e.groupBy(F.col("user_id").alias("task")).agg(F.count("*").alias("tokens"), F.sum("value").alias("v"))


def sign_p(k, n):
    """The exact test through a recursion over binomial terms."""
    return f"CASE WHEN {n} = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least({k}, {n} - {k}) + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2))))) END"


@query("q135_paired_arms", f"WITH {ARMS}, j AS (SELECT aa.tokens AS a, bb.tokens AS b FROM aa FULL JOIN bb USING (task)) SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS pairs, (sum(a) FILTER (b IS NOT NULL))::BIGINT AS before, (sum(b) FILTER (a IS NOT NULL))::BIGINT AS after, count(*) FILTER (b < a) AS cheaper, count(*) FILTER (b > a) AS dearer, count(*) FILTER (a = b) AS equal, count(*) FILTER (a IS NULL OR b IS NULL) AS unpaired FROM j")
def _(t):
    return cost.paired(arm(t, 0), arm(t, 1), "tokens").drop("p", "p_one_sided", "resolution")


GRADED = "gr AS (SELECT 'a' || (o_orderkey % 3) AS arm, o_custkey AS task, sum(o_orderkey % 100)::BIGINT AS tokens, bool_or(o_orderstatus = 'F') AS hit, bool_or(o_orderstatus = 'O') AS clean FROM orders GROUP BY 1, 2)"


def graded(t):
    return t.orders.groupBy(F.concat(F.lit("a"), (F.col("o_orderkey") % 3).cast("string")).alias("arm"), F.col("o_custkey").alias("task")).agg(F.sum(F.col("o_orderkey") % 100).alias("tokens"), F.bool_or(F.col("o_orderstatus") == "F").alias("hit"), F.bool_or(F.col("o_orderstatus") == "O").alias("clean"))


# Users' tokens in both arms, and orders' customers whose two graded runs disagree.
@query("q136_sign_test", f"WITH {ARMS}, {GRADED}, j AS (SELECT 'sign' AS test, count(*) FILTER (bb.tokens < aa.tokens) AS a, count(*) FILTER (bb.tokens > aa.tokens) AS b FROM aa JOIN bb USING (task) UNION ALL SELECT 'mcnemar ' || tier, a, b FROM (SELECT 'hit' AS tier, count(*) FILTER (x.hit AND NOT y.hit) AS a, count(*) FILTER (NOT x.hit AND y.hit) AS b FROM gr x JOIN gr y USING (task) WHERE x.arm = 'a0' AND y.arm = 'a1' UNION ALL SELECT 'clean', count(*) FILTER (x.clean AND NOT y.clean), count(*) FILTER (NOT x.clean AND y.clean) FROM gr x JOIN gr y USING (task) WHERE x.arm = 'a0' AND y.arm = 'a1'))"
  f" SELECT test, a, a + b AS n, round({sign_p('a', '(a + b)')}, 6) AS p, round(CASE WHEN a + b = 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(0, b + 1), lambda i: exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - (a + b) * ln(2))))) END, 6) AS p_one_sided, CASE WHEN a + b = 0 THEN 1.0 ELSE pow(2.0, 1 - (a + b)) END AS resolution FROM j")
def _(t):
    p = cost.paired(arm(t, 0), arm(t, 1), "tokens").select(F.lit("sign").alias("test"), F.col("cheaper").alias("a"), F.col("dearer").alias("b"), "p", "p_one_sided", "resolution")
    q = cost.discordant(graded(t), "a0", "a1").select(F.concat(F.lit("mcnemar "), "tier"), F.col("only_a"), F.col("only_b"), "p", "p_one_sided", "resolution")
    return p.union(q).select("test", "a", (F.col("a") + F.col("b")).alias("n"), F.round("p", 6).alias("p"), F.round("p_one_sided", 6).alias("p_one_sided"), "resolution")


@query("q137_payload_drift", f"WITH {CALLS}, f AS (SELECT task, tool, args, arg_min(length(payload), turn) AS n FROM ca GROUP BY 1, 2, 3), b AS (SELECT task, tool, args, n + CASE WHEN task % 5 = 0 THEN 1 ELSE 0 END AS n FROM f WHERE task % 7 <> 0 UNION ALL SELECT task + 1000000, tool, args, n FROM f WHERE task % 11 = 0), j AS (SELECT f.n AS x, b.n AS y FROM f FULL JOIN b USING (task, tool, args)) SELECT CASE WHEN x IS NULL THEN 'only_b' WHEN y IS NULL THEN 'only_a' WHEN x = y THEN 'shared' ELSE 'drifted' END AS state, count(*) AS n FROM j GROUP BY 1")
def _(t):
    a = calls(t)
    b = a.withColumn("payload", F.when(F.col("task") % 5 == 0, F.concat("payload", F.lit("+"))).otherwise(F.col("payload")))
    moved = a.where("task % 11 = 0").withColumn("task", F.col("task") + 1000000)
    return cost.payload_drift(a, b.where("task % 7 <> 0").unionByName(moved))


@query("q138_two_by_two", """WITH c AS (SELECT user_id AS task, event_id % 2 AS x, event_id // 2 % 2 AS y, count(*) AS v FROM events GROUP BY ALL), d AS (SELECT task, (max(v) FILTER (x = 1 AND y = 1) - max(v) FILTER (x = 1 AND y = 0)) - (max(v) FILTER (x = 0 AND y = 1) - max(v) FILTER (x = 0 AND y = 0)) AS d FROM c GROUP BY 1)
SELECT count(d) AS n, round(avg(d), 6) AS mean, median(d)::DOUBLE AS median, count(*) FILTER (d > 0) AS positive, count(*) FILTER (d < 0) AS negative FROM d""")
def _(t):
    c = t.events.groupBy(F.col("user_id").alias("task"), (F.col("event_id") % 2).alias("x"), (F.floor(F.col("event_id") / 2) % 2).alias("y")).agg(F.count("*").alias("v"))
    return cost.interaction(c, "v").drop("p").withColumn("mean", F.round("mean", 6))


@query("q139_arm_table", f"WITH {GRADED}, j AS (SELECT x.hit AS xh, y.hit AS yh, x.clean AS xc, y.clean AS yc FROM gr x JOIN gr y USING (task) WHERE x.arm = 'a0' AND y.arm = 'a1') SELECT 'hit' AS tier, count(*) FILTER (xh AND NOT yh) AS only_a, count(*) FILTER (NOT xh AND yh) AS only_b FROM j UNION ALL SELECT 'clean', count(*) FILTER (xc AND NOT yc), count(*) FILTER (NOT xc AND yc) FROM j")
def _(t):
    return cost.discordant(graded(t), "a0", "a1").drop("p", "p_one_sided", "resolution")


@query("q140_setup_comparison", "SELECT o_orderkey AS key, unnest(['status', 'priority']) AS field, unnest([CASE WHEN o_orderkey % 5 = 0 THEN 'unverified' ELSE 'equal' END, CASE WHEN o_orderkey % 5 = 0 THEN 'unverified' WHEN o_orderkey % 4 = 0 THEN 'mismatch' ELSE 'equal' END]) AS state FROM orders")
def _(t):
    a = t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    b = a.where("key % 5 <> 0").withColumn("priority", F.when(F.col("key") % 4 == 0, "x").otherwise(F.col("priority")))
    return cost.compare_setups(a, b, ["status", "priority"])


@query("q141_noise_floor", f"WITH {ARMS}, j AS (SELECT aa.tokens::DOUBLE AS a, bb.tokens::DOUBLE AS b FROM aa JOIN bb USING (task)) SELECT 'tokens' AS metric, sum(a) AS total_a, sum(b) AS total_b, median(b - a) AS median, round(avg(b - a), 6) AS mean, min(b - a) AS least, max(b - a) AS most, count(*) FILTER (b > a) AS larger, count(*) FILTER (b < a) AS smaller, count(*) FILTER (a = b) AS same, round(sum(b) / sum(a), 6) AS ratio FROM j")
def _(t):
    return cost.noise_floor(arm(t, 0), arm(t, 1), ["tokens"]).drop("p").withColumn("mean", F.round("mean", 6)).withColumn("ratio", F.round("ratio", 6))


# Each tool but search has a cap; parts beyond it lie behind one another, so one line stands for them where the last of them ended.
COMPACT = f"""{CALLS}, {SEGS}, po AS (SELECT *, CASE turn % 4 WHEN 0 THEN 'head' WHEN 1 THEN 'cap' WHEN 2 THEN 'hint' ELSE 'cap' END AS policy, CASE tool WHEN 'list_files' THEN 2 WHEN 'read_file' THEN 1 END AS cap FROM ca),
ns AS (SELECT task, turn, count(*) AS n FROM sg GROUP BY 1, 2), pl AS (SELECT po.*, coalesce(n, 0) AS n FROM po LEFT JOIN ns USING (task, turn)),
li AS (SELECT task, turn, cap, n, i, l[i] AS line FROM (SELECT *, string_split(payload, chr(10)) AS l, unnest(range(1, len(string_split(payload, chr(10))) + 1)) AS i FROM pl WHERE policy = 'cap' AND cap > 0 AND n > 0)),
sn AS (SELECT sk.task, sk.turn, i, kind, row_number() OVER (PARTITION BY sk.task, sk.turn ORDER BY i) AS seg, CASE tool WHEN 'list_files' THEN trim(l[i]) ELSE l[i] END AS text FROM sk),
om AS (SELECT li.*, seg, kind, text, sum(length(text)) FILTER (seg > cap AND text <> '') OVER (PARTITION BY li.task, li.turn) AS omitted, max(seg) FILTER (text <> '') OVER (PARTITION BY li.task, li.turn) AS final FROM li LEFT JOIN sn USING (task, turn, i)),
nl AS (SELECT task, turn, i, CASE WHEN seg IS NULL OR seg <= cap OR text = '' THEN line WHEN seg = final THEN replace(line, text, '-- ' || (count(*) FILTER (seg > cap AND text <> '') OVER (PARTITION BY task, turn)) || ' ' || kind || ' (' || omitted || ' chars omitted) --' || chr(10)) ELSE replace(line, text, '') END AS line FROM om),
cp AS (SELECT task, turn, string_agg(line, chr(10) ORDER BY i) AS capped FROM nl GROUP BY 1, 2),
rs AS (SELECT pl.*, CASE WHEN policy = 'head' AND length(payload) > 500 THEN substr(payload, 1, 500) || chr(10) || '... ' || (length(payload) - 500) || ' chars omitted (kept the first 500 of ' || length(payload) || ') ...' || chr(10)
  WHEN policy = 'hint' THEN tool || ': ' || result_code || ', ' || length(payload) || ' chars, ' || n || ' items (content omitted; call again with a narrower argument if needed)' WHEN policy = 'cap' AND length(capped) < length(payload) THEN capped END AS shorter FROM pl LEFT JOIN cp USING (task, turn))"""


def compacted(t):
    m = F.col("turn") % 4
    c = calls(t).withColumn("policy", F.when(m == 0, "head").when(m == 2, "hint").otherwise("cap"))
    return cost.compact(c, t.spark.createDataFrame([("list_files", 2), ("read_file", 1)], "tool string, cap int"))


@query("q144_payload_compaction", f"WITH {COMPACT} SELECT task, turn, coalesce(shorter, payload) AS compact, shorter IS NOT NULL AS applied, length(payload) AS chars_before, length(coalesce(shorter, payload)) AS chars_after FROM rs")
def _(t):
    return compacted(t).select("task", "turn", F.col("text").alias("compact"), "applied", *[F.col(c).cast("long").alias(c) for c in ("chars_before", "chars_after")])


@query("q142_context_bill", f"WITH {COMPACT}, k AS (SELECT tool, result_code, count(*) AS n FROM ca GROUP BY 1, 2), c AS (SELECT tool, string_agg(result_code || '=' || n, ',' ORDER BY result_code) AS codes FROM k GROUP BY 1) SELECT 'all' AS tool, count(*) AS calls, sum(length(payload))::BIGINT AS payload_chars, sum(length(coalesce(shorter, payload)))::BIGINT AS compacted_chars, NULL AS codes, NULL::DOUBLE AS avg_chars, (SELECT count(*) FROM tu) AS turns, (SELECT sum(prompt_tokens)::BIGINT FROM tu) AS tokens, (SELECT sum(tools_chars)::BIGINT FROM tu) AS definition_chars FROM rs UNION ALL SELECT tool, count(*), sum(length(payload))::BIGINT, NULL, any_value(codes), round_even(sum(length(payload)) / count(*), 1), NULL, NULL, NULL FROM ca JOIN c USING (tool) GROUP BY 1")
def _(t):
    whole = cost.bill(turns(t), compacted(t), F.col("chars_before"), F.col("chars_after")).withColumn("tool", F.lit("all")).drop("saved_chars")
    tools = cost.tool_bill(calls(t)).withColumn("codes", F.array_join(F.transform(F.map_entries("codes"), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))
    return whole.unionByName(tools, allowMissingColumns=True)


@query("q143_reference_profile", f"{BASE}, n AS (SELECT tool, count(*) FILTER (verdict = 'referenced') AS n FROM ju WHERE verdict <> 'unverifiable' GROUP BY tool, task, turn), p AS (SELECT tool, n, row_number() OVER (PARTITION BY tool ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY tool) AS m FROM n), q AS (SELECT tool, any_value(m) AS calls, max(n) FILTER (i = round_even(0.5 * (m - 1), 0)) AS p50, max(n) FILTER (i = round_even(0.9 * (m - 1), 0)) AS p90, max(n) AS most FROM p GROUP BY 1), f AS (SELECT tool, kind, round(avg((verdict = 'referenced')::INT), 6) AS rate, count(*) AS n, count(*) FILTER (verdict = 'referenced') AS n_ref, sum(chars)::BIGINT AS chars, coalesce(sum(chars) FILTER (verdict = 'referenced'), 0)::BIGINT AS chars_ref FROM ju WHERE verdict <> 'unverifiable' GROUP BY 1, 2) SELECT q.*, greatest(1, p90) AS cap, kind, rate, n, n_ref, chars, chars_ref FROM q LEFT JOIN f USING (tool)")
def _(t):
    j = written(judged(t).select("tool", "kind", "task", "turn", "chars", "verdict"))
    return cost.caps(j).join(cost.reference_profile(j).withColumn("rate", F.round("rate", 6)), "tool", "left")


GRADE = "CASE WHEN regexp_replace(lower(text), '\\s+', '', 'g') = '' THEN 'empty' WHEN conv_id % 17 = 0 THEN 'leaked' WHEN conv_id % 7 = 0 THEN 'no_lookup' WHEN NOT (contains(regexp_replace(lower(text), '\\s+', '', 'g'), 'the') OR contains(regexp_replace(lower(text), '\\s+', '', 'g'), 'der')) OR NOT contains(regexp_replace(lower(text), '\\s+', '', 'g'), 'in') THEN 'missing_fact' ELSE 'ok' END"


def grades(t):
    groups = F.array(F.array(F.lit("T he"), F.lit("DER")), F.array(F.lit("in")))
    g = cost.grade(F.col("text"), groups, F.when(F.col("conv_id") % 7 == 0, 0).otherwise(1), F.col("conv_id") % 17 == 0)
    return t.conversations.select("conv_id", "turn", F.col("role").alias("arm"), g.alias("grade"))


@query("q145_answer_grading", f"SELECT conv_id, turn, role AS arm, {GRADE} AS grade FROM conversations")
def _(t):
    return grades(t)


@query("q146_grade_tiers", f"WITH g AS (SELECT role AS arm, {GRADE} AS grade FROM conversations) SELECT arm, " + ", ".join(f"count(*) FILTER (grade = '{x}') AS {x}" for x in ("ok", "missing_fact", "no_lookup", "leaked", "empty")) + " FROM g GROUP BY 1")
def _(t):
    return cost.tiers(grades(t))


def files(t):
    return t.documents.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), "text")


@query("q147_leak_scan", "SELECT 'd/' || doc_id AS path, CASE WHEN length(text) > 20000 THEN 'skipped' WHEN text LIKE '%@mail%' OR text LIKE '%Licensed%' THEN 'leak' ELSE 'clean' END AS state, CASE WHEN length(text) <= 20000 THEN concat_ws(',', CASE WHEN text LIKE '%@mail%' THEN 'mail' END, CASE WHEN text LIKE '%Licensed%' THEN 'license' END) END AS patterns FROM documents")
def _(t):
    return cost.leak_scan(files(t), {"mail": "@mail", "license": "Licensed"}, 20_000)


@query("q148_corpus_manifest", "WITH f AS (SELECT 'd/' || doc_id AS path, length(replace(text, chr(13) || chr(10), chr(10))) AS chars, sha256(replace(text, chr(13) || chr(10), chr(10))) AS digest FROM documents) SELECT path, chars::INT AS chars, digest FROM f")
def _(t):
    return cost.manifest(files(t))


@query("q149_manifest_diff", "SELECT 'd/' || doc_id AS path, CASE doc_id % 9 WHEN 0 THEN 'removed' WHEN 1 THEN 'changed' END AS state FROM documents WHERE doc_id % 9 IN (0, 1) UNION ALL SELECT 'e/' || doc_id, 'added' FROM documents WHERE doc_id % 9 = 2")
def _(t):
    a = files(t).withColumn("k", F.substring("path", 3, 99).cast("long") % 9)
    b = a.where("k <> 0").withColumn("text", F.when(F.col("k") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    more = a.where("k = 2").withColumn("path", F.replace("path", F.lit("d/"), F.lit("e/")))
    return cost.manifest_diff(cost.manifest(a), cost.manifest(b.unionByName(more)))
