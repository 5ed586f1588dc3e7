"""Queries over findings: metrics, attribution, badges, evaluation, questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import attribution as at
from plumbline.operators import badges, metrics, probes, questions
from plumbline.operators import trading_calendar as cal
from plumbline.operators.intervals import overlapping
from plumbline.plans.inputs import ASOF, SERIES, series, suspensions
from plumbline.plans.registry import query
from plumbline.shared import written
from plumbline.plans.series_queries import COMPLETE, DEPTH, DRIFT, DRIFT_CTE, FAULTY, FRESH, ISLANDS, NULLED, RAW, SHORT, UNIQUE, VALID, D, S, calendar, day, faulty, generic_probes, later_day, limits, nulled, outlier_sql, raw, shift_sql, short

ONE = "1998-06-15"
LO, HI = "1997-03-03", "1999-10-29"


@query("q059_row_count_metric", f"WITH s AS ({SERIES}) SELECT count(*) AS value, count(*) >= 3000 AS ok FROM s WHERE date = DATE '{ONE}'")
def _(t):
    return metrics.row_count(series(t), F.to_date(F.lit(ONE)))


@query("q060_null_rate_metric", f"WITH s AS ({SERIES}), {NULLED} SELECT round(count(*) FILTER (volume IS NULL) / count(*), 6) AS value, count(*) FILTER (volume IS NULL) / count(*) <= 0.02 AS ok FROM z WHERE date = DATE '{ONE}'")
def _(t):
    return metrics.null_rate(nulled(t), "volume", F.to_date(F.lit(ONE))).withColumn("value", F.round("value", 6))


@query("q061_distinct_entities_metric", f"WITH s AS ({SERIES}) SELECT count(DISTINCT symbol) AS value FROM s WHERE date = DATE '{ONE}'")
def _(t):
    return metrics.distinct_entities(series(t), F.to_date(F.lit(ONE)))


@query("q062_lag_days_metric", f"WITH s AS ({SERIES}) SELECT (DATE '{ASOF}' - max(date))::INT AS value FROM s WHERE date <= DATE '{ASOF}'")
def _(t):
    return metrics.lag_days(series(t), day())


@query("q063_latest_value_metric", f"WITH s AS ({SERIES}) SELECT symbol, round(arg_max(close, date), 3) AS value, max(date) AS date FROM s GROUP BY 1", "date")
def _(t):
    return metrics.latest(series(t), "close").withColumn("value", F.round("value", 3))


CHANGE = f"SELECT symbol, round((arg_max(close, date) FILTER (date <= DATE '{HI}') / arg_min(close, date) FILTER (date >= DATE '{LO}') - 1) * 100, 2) AS value FROM s GROUP BY 1"


@query("q064_change_metric", f"WITH s AS ({SERIES}) {CHANGE}")
def _(t):
    return metrics.pct_change(series(t), F.to_date(F.lit(LO)), F.to_date(F.lit(HI))).withColumn("value", F.round("value", 2))


@query("q065_cross_check", f"WITH s AS ({SERIES}), a AS ({CHANGE}) SELECT symbol, CASE WHEN symbol = 'S02' THEN 'not_verifiable' WHEN symbol < 'S04' THEN 'mismatch' ELSE 'verified' END AS status FROM a")
def _(t):
    a = metrics.pct_change(series(t), F.to_date(F.lit(LO)), F.to_date(F.lit(HI)))
    off = F.when(F.col("symbol") == "S02", None).when(F.col("symbol") < "S04", F.col("value") + 1).otherwise(F.col("value"))
    return metrics.verify(a, metrics.midpoint_change(series(t), F.to_date(F.lit(LO)), F.to_date(F.lit(HI))).withColumn("value", off), ["symbol"], 0.1).select("symbol", "status")


@query("q066_midpoint_product", f"WITH s AS ({SERIES}) SELECT symbol, round((arg_max(close, date) / arg_min(close, date) - 1) * 100, 2) AS value FROM s WHERE date BETWEEN DATE '{LO}' AND DATE '{HI}' GROUP BY 1")
def _(t):
    return metrics.midpoint_change(series(t), F.to_date(F.lit(LO)), F.to_date(F.lit(HI))).withColumn("value", F.round("value", 2))


RUNS = (("r1", "daily", '{"symbol": "S04"}', "failed", "2001-01-01 00:00:00"), ("r2", "daily", '{"symbol": "S04"}', "failed", "2000-01-01 00:00:00"), ("r3", "raw", "{}", "failed", "2001-01-02 00:00:00"), ("r4", "daily", '{"symbol": "S09"}', "success", "2001-01-03 00:00:00"), ("r5", "daily", '{"symbol": "S13"}', "failed", "2001-02-03 00:00:00"))
RUN_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', '{d}', TIMESTAMP '{e}')" for a, b, c, d, e in RUNS) + ") AS r(run_id, target_table, params, status, started_at)"


def loads(t):
    return t.spark.createDataFrame(list(RUNS), "run_id string, target_table string, params string, status string, started_at string").withColumn("started_at", F.to_timestamp("started_at"))


def gap_findings(t):
    return probes.freshness(series(t), calendar(t), day()).unionByName(probes.completeness(series(t), calendar(t), day()))


KEYED = 'probe, table_name, symbol, metric, start, "end"'
GAPS = f"""f0 AS ({FRESH} UNION ALL {COMPLETE}), h AS (SELECT DISTINCT halt.symbol, c.date FROM halt JOIN c ON c.date BETWEEN begin_date AND coalesce(end_date, begin_date)), runs AS ({RUN_SQL}),
n AS (SELECT f0.*, (SELECT count(*) FROM c WHERE c.date BETWEEN start AND "end") AS days, (SELECT count(*) FROM h WHERE h.symbol = f0.symbol AND h.date BETWEEN start AND "end") AS hit,
(SELECT arg_min(run_id, started_at) FROM runs WHERE status = 'failed' AND target_table = table_name AND coalesce(json_extract_string(params, '$.symbol'), symbol) = symbol) AS run_id FROM f0),
gap AS (SELECT *, CASE WHEN days > 0 AND hit / days >= 0.9 THEN 'benign_suspension' WHEN days = 0 THEN 'benign_non_trading_day' WHEN run_id IS NOT NULL THEN 'upstream_outage' WHEN probe = 'freshness' THEN 'upstream_stale' ELSE 'missing_rows' END AS root_cause FROM n)"""
GAP_OUT = f"""SELECT {KEYED}, root_cause, CASE root_cause WHEN 'upstream_outage' THEN 'P0' WHEN 'upstream_stale' THEN CASE WHEN value >= 2 THEN 'P0' ELSE 'P1' END WHEN 'missing_rows' THEN severity ELSE 'OK' END AS severity,
CASE root_cause WHEN 'upstream_outage' THEN 0.9 WHEN 'upstream_stale' THEN 0.8 WHEN 'missing_rows' THEN 0.75 ELSE 0.95 END::DOUBLE AS confidence, root_cause LIKE 'benign%' AS suppressed FROM gap"""


def gap_diagnoses(t):
    return at.gaps(gap_findings(t), calendar(t), cal.expanded(suspensions(t), calendar(t)), loads(t))


@query("q067_gap_attribution", f"WITH {S}, {ISLANDS}, {GAPS} {GAP_OUT}", "start end")
def _(t):
    return gap_diagnoses(t).drop("value")


@query("q068_failed_load_lookup", f"WITH {S}, {ISLANDS}, {GAPS} SELECT {KEYED}, run_id FROM gap WHERE run_id IS NOT NULL", "start end")
def _(t):
    return at.failed_loads(gap_findings(t), loads(t))


LISTED = "listed AS (SELECT symbol, CASE WHEN symbol < 'S02' THEN min(date) END AS list_date FROM d GROUP BY 1)"


def listed(t):
    return short(t).groupBy("symbol").agg(F.min("date").alias("list_date")).withColumn("list_date", F.when(F.col("symbol") < "S02", F.col("list_date")))


DEPTH_CTE = f"""{SHORT}, {LISTED}, f1 AS ({DEPTH}), e1 AS (SELECT f1.*, list_date, (SELECT count(*) FROM c WHERE c.date BETWEEN list_date AND DATE '{ASOF}') AS expected FROM f1 LEFT JOIN listed USING (symbol)),
dep AS (SELECT *, CASE WHEN list_date IS NOT NULL AND expected > 0 AND value / expected >= 0.9 AND expected <= 30 THEN 'benign_new_listing' ELSE 'missing_rows' END AS root_cause FROM e1)"""


@query("q069_history_depth_attribution", f"WITH {S}, {DEPTH_CTE} SELECT symbol, value::DOUBLE AS value, root_cause, CASE WHEN root_cause = 'missing_rows' THEN 'P1' ELSE 'OK' END AS severity FROM dep")
def _(t):
    return at.depth(probes.history_depth(short(t)), calendar(t), listed(t), day()).select("symbol", "value", "root_cause", "severity")


RIGHTS = "ev AS (SELECT symbol, date, 'ex_rights' AS kind FROM s WHERE symbol < 'S10' AND dayofyear(date) = 99)"


def events(t):
    return series(t).where((F.col("symbol") < "S10") & (F.dayofyear("date") == 99)).select("symbol", "date", F.lit("ex_rights").alias("kind"))


VALID_CTE = f"""f2 AS ({VALID}), val AS (SELECT *, CASE WHEN metric = 'pct_chg_out_of_limit' AND EXISTS (SELECT 1 FROM ev WHERE ev.symbol = f2.symbol AND ev.date BETWEEN start AND "end") THEN 'benign_corporate_action' ELSE 'value_out_of_range' END AS root_cause FROM f2)"""


@query("q070_validity_attribution", f"WITH {S}, {FAULTY}, {RIGHTS}, {VALID_CTE} SELECT {KEYED}, root_cause, root_cause LIKE 'benign%' AS suppressed FROM val", "start end")
def _(t):
    return at.validity(probes.validity(faulty(t), limits(t)), events(t)).drop("value", "severity", "confidence")


@query("q071_event_in_window", f'WITH {S}, {FAULTY}, {RIGHTS}, f2 AS ({VALID}) SELECT {KEYED} FROM f2 WHERE EXISTS (SELECT 1 FROM ev WHERE ev.symbol = f2.symbol AND ev.date BETWEEN start AND "end")', "start end")
def _(t):
    return at.has_event(probes.validity(faulty(t), limits(t)), events(t), "ex_rights")


@query("q072_constant_attribution", f"WITH raw AS ({RAW}) SELECT symbol, value::DOUBLE AS value, 'duplicate_write' AS root_cause, 'P0' AS severity, 0.95::DOUBLE AS confidence FROM ({UNIQUE})")
def _(t):
    return at.constant(probes.uniqueness({"raw": raw(t)})).select("symbol", "value", "root_cause", "severity", "confidence")


SECTORS = "sec AS (SELECT DISTINCT symbol, 'sector' || (substr(symbol, 2)::INT % 5) AS sector FROM s)"


def sectors(t):
    return series(t).select("symbol").distinct().withColumn("sector", F.concat(F.lit("sector"), (F.substring("symbol", 2, 2).cast("int") % 5).cast("string")))


#: What an entity does in each month, and in the 30 rows before.
RATIO = """pl AS (SELECT symbol, date, volume, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS past FROM s),
ra AS (SELECT f3.probe, f3.table_name, f3.symbol, f3.metric, f3.start, f3."end", pl.symbol AS entity, avg(volume) AS wm, CASE WHEN min(i) > 30 THEN arg_min(past, i) END AS past FROM f3 JOIN pl ON pl.date BETWEEN start AND "end" GROUP BY ALL)"""
F3 = f"f3 AS ({DRIFT})"


def drifts(t):
    return probes.volume_drift(series(t), 1.5, 0.67)


@query("q074_window_volume_ratio", f"WITH {S}, {DRIFT_CTE}, {F3}, {RATIO} SELECT {KEYED}, round(wm, 4) AS window_mean, round(wm / past, 4) AS ratio FROM ra WHERE entity = symbol", "start end")
def _(t):
    return at.window_ratios(drifts(t), series(t)).select(*at.KEY, F.round("window_mean", 4).alias("window_mean"), F.round("ratio", 4).alias("ratio"))


MOVED = """co AS (SELECT ra.probe, ra.table_name, ra.symbol, ra.metric, ra.start, ra."end", count(*) AS n, count(*) FILTER (wm / past >= 2) AS n_ge2, count(*) FILTER (wm / past >= 2 AND o.sector = p.sector AND entity <> ra.symbol) AS sector_peers
FROM ra LEFT JOIN sec o ON o.symbol = ra.symbol LEFT JOIN sec p ON p.symbol = entity WHERE past > 0 GROUP BY ALL)"""


@query("q075_co_movement", f"WITH {S}, {DRIFT_CTE}, {F3}, {RATIO}, {SECTORS}, {MOVED} SELECT {KEYED}, n, n_ge2, sector_peers FROM co", "start end")
def _(t):
    return at.co_movement(drifts(t), series(t), sectors(t)).select(*at.KEY, "n", "n_ge2", "sector_peers")


@query("q073_drift_attribution", f"""WITH {S}, {DRIFT_CTE}, {F3}, {RATIO}, {SECTORS}, {MOVED} SELECT {KEYED}, CASE WHEN n_ge2 >= 0.5 * n OR sector_peers >= 2 THEN 'benign_market_event' ELSE 'distribution_drift' END AS root_cause,
CASE WHEN n_ge2 >= 0.5 * n THEN 0.9 WHEN sector_peers >= 2 THEN 0.85 ELSE 0.8 END::DOUBLE AS confidence FROM f3 LEFT JOIN co USING ({KEYED})""", "start end")
def _(t):
    return at.drift(drifts(t), at.co_movement(drifts(t), series(t), sectors(t))).select(*at.KEY, "root_cause", "confidence")


INDUSTRY = (("BUILDING", "materials"), ("MACHINERY", "industry"), ("AUTOMOBILE", "industry"))


@query("q076_sector_map", "SELECT c_custkey::VARCHAR AS symbol, CASE c_mktsegment WHEN 'BUILDING' THEN 'materials' WHEN 'MACHINERY' THEN 'industry' WHEN 'AUTOMOBILE' THEN 'industry' ELSE coalesce(c_mktsegment, '') END AS sector FROM customer")
def _(t):
    u = t.customer.select(F.col("c_custkey").cast("string").alias("symbol"), F.col("c_mktsegment").alias("industry"))
    return at.sector_of(u, t.spark.createDataFrame(list(INDUSTRY), "industry string, sector string"))


RULES = (("null_rate", "missing_values", 0.7), ("duplicate_keys", "duplicate_write", 0.9), ("outlier_rate", "heavy_tail", 0.5), ("stale_days", "upstream_stale", 0.8))


def rules(t):
    return t.spark.createDataFrame(list(RULES), "prefix string, root_cause string, confidence double")


@query("q077_generic_attribution", """WITH m AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'null_rate::value' WHEN 1 THEN 'duplicate_keys' WHEN 2 THEN 'outlier_rate::x' WHEN 3 THEN 'stale_days' ELSE 'odd::y' END AS metric FROM events)
SELECT event_id, metric, CASE event_id % 5 WHEN 0 THEN 'missing_values' WHEN 1 THEN 'duplicate_write' WHEN 2 THEN 'heavy_tail' WHEN 3 THEN 'upstream_stale' ELSE 'unknown' END AS root_cause, CASE event_id % 5 WHEN 0 THEN 0.7 WHEN 1 THEN 0.9 WHEN 2 THEN 0.5 WHEN 3 THEN 0.8 ELSE 0.3 END::DOUBLE AS confidence FROM m""")
def _(t):
    m = F.col("event_id") % 5
    f = t.events.select("event_id", F.when(m == 0, "null_rate::value").when(m == 1, "duplicate_keys").when(m == 2, "outlier_rate::x").when(m == 3, "stale_days").otherwise("odd::y").alias("metric"))
    return at.generic(f, rules(t))


@query("q079_volume_amount_shift", f"""WITH {S}, {DRIFT_CTE}, {F3}, pl AS (SELECT symbol, date, volume / nullif(amount, 0) AS v, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, avg(volume / nullif(amount, 0)) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS past FROM s)
SELECT f3.probe, f3.table_name, f3.symbol, f3.metric, f3.start, f3."end", round(avg(v) / CASE WHEN min(i) > 30 THEN arg_min(past, i) END, 3) AS ratio FROM f3 JOIN pl ON pl.symbol = f3.symbol AND pl.date BETWEEN start AND "end" GROUP BY ALL""", "start end")
def _(t):
    s = series(t).withColumn("per", F.col("volume") / F.nullif("amount", F.lit(0.0)))
    return at.window_ratios(drifts(t), s, "per").select(*at.KEY, F.round("ratio", 3).alias("ratio"))


@query("q078_evidence_features", f"""WITH {S}, {DRIFT_CTE}, {F3}, {RATIO}, {RIGHTS} SELECT {KEYED}, "end" >= DATE '{ASOF}' AS at_tail, (SELECT count(*) FROM s WHERE s.symbol = f3.symbol AND s.date BETWEEN start AND "end") AS days_present, (SELECT count(*) FROM c WHERE c.date BETWEEN start AND "end") AS days_expected,
least(30, (SELECT count(*) FROM ra WHERE ra.symbol = f3.symbol AND ra.start = f3.start AND ra."end" = f3."end" AND entity <> f3.symbol AND wm / past > 1.5)) AS peers, EXISTS (SELECT 1 FROM ev WHERE ev.symbol = f3.symbol AND ev.date BETWEEN start AND "end") AS ex_rights FROM f3""", "start end")
def _(t):
    d = drifts(t)
    peers = at.peers_moved(d, series(t))
    s = series(t).select(F.col("symbol").alias("x"), "date")
    present = overlapping(d.select(*at.KEY), s, {"symbol": "x"}, ("start", "end"), ("date", "date")).groupBy(*at.KEY).agg(F.count("*").alias("days_present"))
    ev = at.has_event(d, events(t), "ex_rights").withColumn("ex_rights", F.lit(True))
    rows = cal.trading_days_between(d.select(*at.KEY), calendar(t), "start", "end", "days_expected")
    rows = rows.join(peers, at.KEY, "left").join(present, at.KEY, "left").join(ev, at.KEY, "left")
    return rows.select(*at.KEY, (F.col("end") >= day()).alias("at_tail"), F.coalesce("days_present", F.lit(0)).alias("days_present"), "days_expected", F.coalesce("peers", F.lit(0)).alias("peers"), F.coalesce("ex_rights", F.lit(False)).alias("ex_rights"))


BUCKET = "CASE WHEN value < 0 THEN '<0' WHEN value < 1 THEN '<1' WHEN value < 2 THEN '<2' WHEN value < 5 THEN '<5' WHEN value < 8 THEN '<8' WHEN value < 20 THEN '<20' WHEN value < 100 THEN '<100' ELSE '>=100' END"
PRINTED = f"""probe || '|' || metric || '|' || {BUCKET} || '|' || CASE WHEN "end" >= DATE '{ASOF}' THEN 'tail' ELSE 'inner' END"""


@query("q080_shape_fingerprint", f"WITH {S}, {ISLANDS} SELECT fingerprint, count(*) AS n FROM (SELECT {PRINTED} AS fingerprint FROM ({FRESH} UNION ALL {COMPLETE})) GROUP BY 1")
def _(t):
    return gap_findings(t).select(at.fingerprint(day()).alias("fingerprint")).groupBy("fingerprint").agg(F.count("*").alias("n"))


#: Observations: users as shapes, event types as causes; some are labelled false alarms.
OBS = """o AS (SELECT 'u' || user_id || '.' || (event_id % 8) AS fingerprint, event_type AS root_cause, CASE WHEN event_type = 'view' THEN 'false_alarm' ELSE 'real' END AS label, round(0.5 + (event_id % 50) / 100.0, 2)::DOUBLE AS confidence, event_id AS "asof" FROM events)"""


def observations(t):
    return t.events.select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("."), (F.col("event_id") % 8).cast("string")).alias("fingerprint"), F.col("event_type").alias("root_cause"), F.when(F.col("event_type") == "view", "false_alarm").otherwise("real").alias("label"), F.round(0.5 + (F.col("event_id") % 50) / 100.0, 2).alias("confidence"), F.col("event_id").alias("asof"))


MEMORY = f"""{OBS}, n AS (SELECT *, row_number() OVER (PARTITION BY fingerprint, root_cause ORDER BY "asof") AS nth FROM o),
m AS (SELECT fingerprint, root_cause, any_value(label) AS label, count(*) AS hits, max(confidence) AS confidence, min("asof") AS created_asof, min("asof") FILTER (nth = 2) AS confirmed_asof, max("asof") AS updated_asof FROM n GROUP BY 1, 2),
mem AS (SELECT fingerprint, root_cause, label, CASE WHEN confirmed_asof IS NULL THEN 'pending' ELSE 'confirmed' END AS status, confidence, pow(0.5, (SELECT count(*) FROM o WHERE o.fingerprint = m.fingerprint AND o.label <> m.label AND o."asof" > m.confirmed_asof)) AS weight, hits, created_asof, confirmed_asof, updated_asof FROM m)"""


@query("q081_experience_memory", f"WITH {MEMORY} SELECT * REPLACE (round(weight, 12) AS weight) FROM mem")
def _(t):
    return at.memory(observations(t)).withColumn("weight", F.round("weight", 12))




@query("q082_experience_recall", f"""WITH {MEMORY}, f AS (SELECT * FROM mem WHERE status = 'confirmed' AND created_asof <= 5000 AND confidence >= 0.6 AND weight >= 0.5)
SELECT fingerprint, root_cause, hits, row_number() OVER (PARTITION BY fingerprint ORDER BY hits DESC, root_cause) AS rank, 'own' AS scope FROM f QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY hits DESC, root_cause) <= 5
UNION ALL SELECT fingerprint, root_cause, hits, row_number() OVER (ORDER BY hits DESC, fingerprint, root_cause), 'any' FROM f QUALIFY row_number() OVER (ORDER BY hits DESC, fingerprint, root_cause) <= 3""")
def _(t):
    return at.recall(at.memory(observations(t)), F.lit(5000)).select("fingerprint", "root_cause", "hits", "rank", "scope")


@query("q083_memory_pruning", f"""WITH {MEMORY} SELECT fingerprint, root_cause, status FROM mem WHERE status = 'confirmed' QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY updated_asof DESC, root_cause) <= 2
UNION ALL SELECT fingerprint, root_cause, status FROM (SELECT * FROM mem WHERE status = 'pending' ORDER BY updated_asof DESC, fingerprint, root_cause LIMIT 50)""")
def _(t):
    return at.prune(at.memory(observations(t)), confirmed=2).select("fingerprint", "root_cause", "status")


@query("q084_recent_signals", "SELECT event_id, CAST(ts AS DATE) AS asof FROM events WHERE CAST(ts AS DATE) >= (SELECT max(CAST(ts AS DATE)) FROM events) - 5", "asof")
def _(t):
    return at.recent_signals(t.events.select("event_id", F.to_date("ts").alias("asof")), 5)


@query("q085_alert_day_presence", f"""WITH {S}, {ISLANDS}, dd AS (SELECT DISTINCT date FROM m), u AS (SELECT DISTINCT symbol FROM s)
SELECT dd.date, (SELECT count(*) FROM s WHERE s.date = dd.date) AS present, la.symbol FROM dd LEFT JOIN (SELECT d2.date, u.symbol FROM dd d2 CROSS JOIN u WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.symbol = u.symbol AND s.date = d2.date)) la ON la.date = dd.date""", "date")
def _(t):
    s = series(t)
    first = s.groupBy("symbol").agg(F.min("date").alias("first"))
    days = first.join(F.broadcast(calendar(t)), (F.col("date") >= F.col("first")) & (F.col("date") <= day())).select("symbol", "date").join(s.select("symbol", "date"), ["symbol", "date"], "left_anti")
    return at.present_on(days, s, s)


# Badges.
COLUMNS = ("date", "close", "high", "low", "volume", "amount", "pct_chg")
NAMED = (("non_positive_close", "close"), ("high_lt_low", "high"), ("high_lt_low", "low"), ("non_positive_volume", "volume"), ("pct_chg_out_of_limit", "pct_chg"), ("volume_recent_over_history", "volume"))
NAMED_SQL = "nm AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in NAMED) + ') AS x(metric, "column")), cols AS (SELECT * FROM (VALUES ' + ", ".join(f"('{c}')" for c in COLUMNS) + ') AS x("column"))'


def columns(t):
    return t.spark.createDataFrame([("daily", c) for c in COLUMNS], "table_name string, column string")


def named(t):
    return t.spark.createDataFrame(list(NAMED), "metric string, column string")


def diagnoses(t):
    return gap_diagnoses(t).unionByName(at.validity(probes.validity(faulty(t), limits(t)), events(t)))


ALL = f"""al AS (SELECT {KEYED}, root_cause, severity, suppressed FROM ({GAP_OUT}) UNION ALL SELECT {KEYED}, root_cause, CASE WHEN root_cause LIKE 'benign%' THEN 'OK' ELSE 'P0' END, root_cause LIKE 'benign%' FROM val)"""
BASE = f"WITH {S}, {ISLANDS}, {GAPS}, {FAULTY}, {RIGHTS}, {VALID_CTE}, {ALL}, {NAMED_SQL}"
TOUCHED = """tc AS (SELECT al.*, nm."column" FROM al JOIN nm USING (metric) UNION ALL SELECT al.*, cols."column" FROM al CROSS JOIN cols WHERE metric NOT IN (SELECT metric FROM nm))"""


@query("q086_finding_columns", f'{BASE}, {TOUCHED} SELECT "column", metric, count(*) AS n FROM tc GROUP BY ALL')
def _(t):
    return badges.finding_columns(diagnoses(t), columns(t), named(t)).groupBy("column", "metric").agg(F.count("*").alias("n"))


BOARD = """bd AS (SELECT cols."column", CASE WHEN bool_or(NOT suppressed AND severity = 'P0') THEN 'unusable' WHEN bool_or(NOT suppressed) THEN 'caution' WHEN bool_or(suppressed) THEN 'verified' ELSE 'baseline' END AS level, count(tc.metric) AS findings FROM cols LEFT JOIN tc ON tc."column" = cols."column" GROUP BY 1)"""


def board(t):
    return badges.board(badges.finding_columns(diagnoses(t), columns(t), named(t)), columns(t))


@query("q087_column_badge", f'{BASE}, {TOUCHED}, {BOARD} SELECT "column", level, findings FROM bd')
def _(t):
    return board(t).select("column", "level", "findings")


@query("q089_health_score", f"""{BASE}, {TOUCHED}, {BOARD} SELECT round(100 * avg(CASE level WHEN 'unusable' THEN 0 WHEN 'caution' THEN 0.5 ELSE 1 END), 1)::DOUBLE AS health, count(*) AS badges FROM bd""")
def _(t):
    return badges.health(board(t))


@query("q090_inspection_summary", f"""{BASE} SELECT 'total' AS part, 'findings' AS name, count(*) AS n FROM al UNION ALL SELECT 'total', 'alerts', count(*) FILTER (NOT suppressed) FROM al UNION ALL SELECT 'total', 'suppressed', count(*) FILTER (suppressed) FROM al
UNION ALL SELECT 'severity', severity, count(*) FROM al WHERE NOT suppressed GROUP BY severity UNION ALL SELECT 'root_cause', root_cause, count(*) FROM al WHERE NOT suppressed GROUP BY root_cause""")
def _(t):
    return badges.summary(diagnoses(t))


@query("q091_alert_merge", f"""{BASE}, a AS (SELECT *, CASE severity WHEN 'P0' THEN 3 WHEN 'P1' THEN 2 WHEN 'P2' THEN 1 ELSE 0 END AS penalty FROM al WHERE NOT suppressed)
SELECT symbol, root_cause, any_value(penalty) AS penalty, arg_min(metric, (start, "end", metric)) AS metric, min(start) AS start, count(*) AS merged FROM a GROUP BY table_name, symbol, root_cause""", "start")
def _(t):
    return badges.merge_alerts(diagnoses(t).where(~F.col("suppressed"))).select("symbol", "root_cause", "penalty", "metric", "start", "merged")


@query("q092_board_comparison", f"""{BASE}, {TOUCHED}, {BOARD} SELECT "column", level AS domain_level, CASE WHEN "column" IN ('date', 'close') THEN NULL ELSE 'baseline' END AS generic_level FROM bd UNION ALL SELECT 'symbol', NULL, 'baseline'""")
def _(t):
    g = columns(t).where("column not in ('date', 'close')").union(t.spark.createDataFrame([("daily", "symbol")], "table_name string, column string")).withColumn("level", F.lit("baseline"))
    return badges.compare_boards(board(t), g).drop("table_name")


LABELS = ((1, "S04", "daily", "1996-01-01", "1996-06-30", "upstream_outage", "P0", True), (2, "S03", "event", "1997-02-03", "1997-02-14", "benign_suspension", "OK", False), (3, "S13", "daily", "1999-01-01", "1999-03-31", "missing_rows", "P1", True), (4, "S99", "daily", "1999-01-01", "1999-03-31", "missing_rows", "P1", True))
LABEL_SQL = "lb AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{s}', '{t}', DATE '{a}', DATE '{b}', '{c}', '{v}', {str(f).lower()})" for i, s, t, a, b, c, v, f in LABELS) + ") AS x(label_id, l_symbol, l_table, l_start, l_end, expected_cause, expected_severity, fault))"


def labels(t):
    x = t.spark.createDataFrame(list(LABELS), "label_id int, symbol string, table_name string, start string, end string, expected_cause string, expected_severity string, fault boolean")
    return x.withColumn("start", F.to_date("start")).withColumn("end", F.to_date("end"))


MATCHED = """mt AS (SELECT al.*, lb.label_id, expected_cause, expected_severity, fault FROM al JOIN lb ON symbol = l_symbol AND (l_table = 'event' OR l_table = table_name) AND start <= l_end AND l_start <= "end")"""


@query("q093_label_matching", f'{BASE}, {LABEL_SQL}, {MATCHED} SELECT label_id, metric, start, "end", root_cause FROM mt', "start end")
def _(t):
    return badges.matches(diagnoses(t), labels(t)).select("label_id", "metric", "start", "end", "root_cause")


@query("q094_detection_metrics", f"""{BASE}, {LABEL_SQL}, {MATCHED}, b AS (SELECT label_id, bool_or(NOT suppressed) AS seen, bool_or(root_cause = expected_cause) AS ok, bool_or(root_cause = expected_cause AND severity = expected_severity) AS sev, bool_and(suppressed) AS quiet FROM mt GROUP BY 1),
l AS (SELECT lb.label_id, fault, b.* EXCLUDE (label_id) FROM lb LEFT JOIN b USING (label_id)), p AS (SELECT al.suppressed, EXISTS (SELECT 1 FROM mt WHERE mt.fault AND mt.symbol = al.symbol AND mt.metric = al.metric AND mt.start = al.start AND mt."end" = al."end") AS hit FROM al)
SELECT round(avg(coalesce(seen, false)::INT) FILTER (fault), 6) AS fault_recall, round(avg(coalesce(ok, false)::INT) FILTER (fault), 6) AS cause_accuracy, round(avg(coalesce(sev, false)::INT) FILTER (fault), 6) AS severity_accuracy, round(avg(coalesce(quiet, true)::INT) FILTER (NOT fault), 6) AS benign_suppression,
(SELECT round(avg(hit::INT) FILTER (NOT suppressed), 6) FROM p) AS alert_precision, (SELECT round(avg(hit::INT), 6) FROM p) AS naive_precision FROM l""")
def _(t):
    d = badges.detection(diagnoses(t), labels(t))
    return d.select(*[F.round(c, 6).alias(c) for c in d.columns])


@query("q095_cohen_kappa", """WITH c AS (SELECT o_orderstatus AS a, CASE WHEN o_orderkey % 3 = 0 THEN 'F' ELSE o_orderstatus END AS b FROM orders), n AS (SELECT count(*)::DOUBLE AS t, count(*) FILTER (a = b) / count(*) AS po FROM c),
e AS (SELECT sum(x.n::DOUBLE * y.n) AS s FROM (SELECT a, count(*) AS n FROM c GROUP BY 1) x JOIN (SELECT b, count(*) AS n FROM c GROUP BY 1) y ON x.a = y.b) SELECT round((po - s / (t * t)) / (1 - s / (t * t)), 6) AS kappa, t::BIGINT AS n FROM n, e""")
def _(t):
    c = t.orders.select(F.col("o_orderstatus").alias("a"), F.when(F.col("o_orderkey") % 3 == 0, "F").otherwise(F.col("o_orderstatus")).alias("b"))
    return badges.kappa(c, "a", "b").withColumn("kappa", F.round("kappa", 6))


@query("q096_replay_comparison", f"""{BASE} SELECT symbol, start, "end", root_cause = CASE WHEN symbol < 'S05' THEN 'missing_rows' ELSE root_cause END AS ok FROM al WHERE probe = 'completeness' AND root_cause IS NOT NULL""", "start end")
def _(t):
    d = diagnoses(t).where("probe = 'completeness'")
    want = F.when(F.col("symbol") < "S05", "missing_rows").otherwise(F.col("root_cause"))
    expected = d.select("probe", "symbol", "start", "end", want.alias("want_cause"), F.col("suppressed").alias("want_suppressed"))
    return badges.replay(expected, d).select("symbol", "start", "end", "ok")


@query("q097_market_facts", f"""WITH s AS ({SERIES}), {FAULTY}, a AS (SELECT s.symbol, s.date, s.amount, x.close, x.pct_chg FROM s JOIN x USING (symbol, date) WHERE s.date = (SELECT max(date) FROM s))
SELECT 'pct_chg' AS fact, row_number() OVER (ORDER BY pct_chg DESC, symbol) AS rank, symbol, round(pct_chg::DOUBLE, 2) AS value, round(close::DOUBLE, 2) AS close FROM a WHERE pct_chg IS NOT NULL QUALIFY rank <= 3
UNION ALL SELECT 'amount', row_number() OVER (ORDER BY amount DESC, symbol) AS r, symbol, round(amount::DOUBLE, 2), NULL FROM a WHERE amount IS NOT NULL QUALIFY r <= 3
UNION ALL SELECT 'symbols', 1, NULL, count(DISTINCT symbol)::DOUBLE, NULL FROM a UNION ALL SELECT 'days', 1, NULL, count(DISTINCT date)::DOUBLE, NULL FROM s""")
def _(t):
    return badges.market_facts(faulty(t)).withColumn("value", F.round("value", 2)).withColumn("close", F.round("close", 2))


@query("q098_cited_number_review", r"""WITH d AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'total ' || o_custkey || '.5 [badge:orders.total]' WHEN 1 THEN 'total ' || o_custkey || '.5' WHEN 2 THEN 'on 1998-01-02 we had ' || o_custkey || ' rows' ELSE 'share ' || o_custkey || '% [badge:orders.none]' END AS line FROM orders)
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'passed' WHEN 1 THEN 'missing_citation' WHEN 2 THEN 'no_number' ELSE 'invalid_citation' END AS state, CASE o_orderkey % 4 WHEN 1 THEN 'total ***' WHEN 3 THEN 'share *** [badge:orders.none]' ELSE line END AS reviewed FROM d""")
def _(t):
    m, c = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    line = F.when(m == 0, F.concat(F.lit("total "), c, F.lit(".5 [badge:orders.total]"))).when(m == 1, F.concat(F.lit("total "), c, F.lit(".5"))).when(m == 2, F.concat(F.lit("on 1998-01-02 we had "), c, F.lit(" rows"))).otherwise(F.concat(F.lit("share "), c, F.lit("% [badge:orders.none]")))
    b = t.spark.createDataFrame([("orders", "total", "verified"), ("orders", "bad", "unusable")], "table_name string, column string, level string")
    return badges.reviewed(t.orders.select("o_orderkey", line.alias("line")), b).drop("line")


# Questions: three for each order, over the series.
Q = """q AS (SELECT o_orderkey AS q_id, printf('S%02d', o_custkey % 25) AS symbol, CASE o_orderkey % 3 WHEN 0 THEN 'price' WHEN 1 THEN 'change' ELSE 'aggregate' END AS intent, CAST(o_orderdate AS DATE) AS start, CAST(o_orderdate AS DATE) + (o_orderkey % 20)::INT AS "end" FROM orders)"""


def asked(t):
    m = F.col("o_orderkey") % 3
    return t.orders.select(F.col("o_orderkey").alias("q_id"), F.format_string("S%02d", F.col("o_custkey") % 25).alias("symbol"), F.when(m == 0, "price").when(m == 1, "change").otherwise("aggregate").alias("intent"), F.to_date("o_orderdate").alias("start"), F.expr("date_add(to_date(o_orderdate), cast(o_orderkey % 20 as int))").alias("end"))


@query("q099_as_of_price", f'WITH s AS ({SERIES}), {Q} SELECT q_id, q.symbol, s.date AS used, s.close AS value FROM q ASOF LEFT JOIN s ON q.symbol = s.symbol AND s.date <= q."end"', "used")
def _(t):
    return questions.prices(asked(t), series(t)).select("q_id", "symbol", "used", "value")


SPAN = """fs AS (SELECT q_id, s.close AS a FROM q ASOF LEFT JOIN s ON q.symbol = s.symbol AND s.date >= q.start), ls AS (SELECT q_id, s.close AS b FROM q ASOF LEFT JOIN s ON q.symbol = s.symbol AND s.date <= q."end"),
sp AS (SELECT q.q_id, q.symbol, any_value(a) AS a, any_value(b) AS b, coalesce(min(date), any_value(start)) AS first, coalesce(max(date), any_value("end")) AS last, count(date) AS rows, avg(volume) AS v FROM q JOIN fs USING (q_id) JOIN ls USING (q_id) LEFT JOIN s ON s.symbol = q.symbol AND s.date BETWEEN start AND "end" GROUP BY 1, 2)"""


@query("q100_range_change", f"WITH s AS ({SERIES}), {Q}, {SPAN} SELECT q_id, symbol, round((b / a - 1) * 100, 4) AS value, first, last, rows FROM sp", "first last")
def _(t):
    return questions.changes(asked(t), series(t))


@query("q101_range_aggregate", f"WITH s AS ({SERIES}), {Q}, {SPAN} SELECT q_id, symbol, rows, round(v, 2) AS value FROM sp")
def _(t):
    return questions.aggregates(asked(t), series(t))


GUARD = f"""WITH {S}, {Q}, {SPAN}, us AS (SELECT q_id, s.date AS used FROM q ASOF LEFT JOIN s ON q.symbol = s.symbol AND s.date <= q."end"),
g AS (SELECT q.q_id, intent, coalesce(used, (SELECT min(begin_date) FROM halt WHERE halt.symbol = q.symbol AND begin_date <= "end" AND "end" <= coalesce(end_date, begin_date))) AS used, "end", rows, EXISTS (SELECT 1 FROM halt WHERE halt.symbol = q.symbol AND begin_date <= "end" AND CASE WHEN intent = 'price' THEN "end" ELSE start END <= coalesce(end_date, begin_date)) AS hit FROM q JOIN us USING (q_id) JOIN sp USING (q_id)),
gd AS (SELECT q_id, intent, used, "end", CASE WHEN NOT hit THEN 'none' WHEN intent = 'change' AND rows <= 1 THEN 'gap_span' WHEN intent = 'price' THEN 'stale_price' WHEN intent = 'aggregate' THEN 'calendar_mismatch' ELSE 'suspended_window' END AS flag FROM g)"""


def answered(t):
    q, s = asked(t), series(t)
    spans = questions.spans(q, s)  # the last price on or before the end of a range is that of its day
    return questions.guarded(q, suspensions(t), calendar(t), spans.select("q_id", "used", "rows"))


@query("q102_answer_guard", f"""{GUARD} SELECT q_id, intent, flag, CASE flag WHEN 'none' THEN 'baseline' WHEN 'gap_span' THEN 'unusable' ELSE 'caution' END AS level, CASE WHEN flag = 'stale_price' THEN (SELECT count(*) FROM c WHERE c.date > used AND c.date <= "end") END AS lag FROM gd""")
def _(t):
    return answered(t)


# A message names the flag and the lag; questions of every fifth order want "1 days", all others the kind of trap if there is one.
@query("q103_trap_evaluation", f"""{GUARD}, ms AS (SELECT q_id, flag, flag || ': ' || coalesce((CASE WHEN flag = 'stale_price' THEN (SELECT count(*) FROM c WHERE c.date > used AND c.date <= "end") END)::VARCHAR, 'no') || ' days' AS message FROM gd),
e AS (SELECT flag <> 'none' AS got, q_id % 7 = 0 OR flag <> 'none' AS trap, CASE WHEN q_id % 7 <> 0 AND flag = 'none' THEN NOT (flag <> 'none') WHEN q_id % 5 = 0 THEN contains(message, '1 days') AND contains(message, 'price') ELSE contains(message, '_') END AS fine FROM ms),
n AS (SELECT count(*) FILTER (got AND trap) AS tp, count(*) FILTER (got AND NOT trap) AS fp, count(*) FILTER (NOT got AND trap) AS fn, count(*) FILTER (NOT got AND NOT trap) AS tn, count(*) FILTER (fine) AS "right", round(avg(fine::INT), 6) AS correction FROM e)
SELECT tp, fp, fn, tn, "right", correction, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(tp / nullif(tp + fp, 0), 6) AS precision FROM n""")
def _(t):
    a = written(answered(t).withColumn("message", F.concat("flag", F.lit(": "), F.coalesce(F.col("lag").cast("string"), F.lit("no")), F.lit(" days"))))
    trap = (F.col("q_id") % 7 == 0) | (F.col("flag") != "none")
    must = F.when(~trap, F.expr("array()").cast("array<string>")).when(F.col("q_id") % 5 == 0, F.array(F.lit("1 days"), F.lit("price"))).otherwise(F.array(F.lit("_")))
    return questions.trap_scores(a, a.select("q_id", trap.alias("trap"), must.alias("must_mention")))


# Question texts of six forms; names stand in texts too.
TEXTS = """tx AS (SELECT o_orderkey AS q_id, o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders)"""
SLOTS = """sl AS (SELECT q_id, CASE WHEN q_id % 3 = 1 THEN 'S01' ELSE printf('S%02d', o_custkey % 25) END AS symbol, CASE q_id % 3 WHEN 0 THEN 'price' WHEN 1 THEN 'change' ELSE 'aggregate' END AS intent,
CASE q_id % 6 WHEN 1 THEN date_trunc('month', d)::DATE WHEN 4 THEN d WHEN 2 THEN least(d, DATE '1997-01-02') WHEN 5 THEN least(d, make_date(year(d), 2, 3)) END AS start,
CASE q_id % 6 WHEN 1 THEN last_day(d) WHEN 4 THEN (d + INTERVAL 40 DAY)::DATE WHEN 2 THEN greatest(d, DATE '1997-01-02') WHEN 5 THEN greatest(d, make_date(year(d), 2, 3)) END AS "end", CASE WHEN q_id % 3 = 0 OR q_id % 6 = 5 AND month(d) = 2 AND day(d) = 3 THEN d END AS as_of FROM tx),
s2 AS (SELECT * REPLACE (CASE WHEN q_id % 6 IN (2, 5) AND start = "end" THEN NULL ELSE start END AS start, CASE WHEN q_id % 6 IN (2, 5) AND start = "end" THEN NULL ELSE "end" END AS "end", CASE WHEN q_id % 6 = 2 AND start = "end" THEN start ELSE as_of END AS as_of) FROM sl)"""


def parsed(t):
    code, m = F.format_string("S%02d", F.col("o_custkey") % 25), F.col("o_orderkey") % 6
    han = lambda d: F.concat(F.year(d), F.lit("年"), F.month(d), F.lit(" 月 "), F.dayofmonth(d), F.lit("日"))
    day, later = F.col("o_orderdate"), F.date_add("o_orderdate", 40)
    text = (
        F.when(m == 0, F.concat(F.lit("Price of "), code, F.lit(" on "), F.date_format(day, "yyyy-M-d"))).when(m == 1, F.concat(F.lit("What change had Acme in "), F.date_format(day, "yyyy-MM"), F.lit("?")))
        .when(m == 2, F.concat(F.lit("average volume of "), code, F.lit(" from "), F.date_format(day, "yyyy-MM-dd"), F.lit(" to 1997-01-02"))).when(m == 3, F.concat(code, F.lit(" "), han(day), F.lit("的收盘价是多少")))
        .when(m == 4, F.concat(F.lit("Acme从"), F.date_format(later, "yyyy-MM-dd"), F.lit("往回到"), F.date_format(day, "yyyy-M-dd"), F.lit("涨了多少"))).otherwise(F.concat(code, F.lit(" "), han(day), F.lit("到2月3日的日均成交量")))
    )
    return questions.slots(t.orders.select(F.col("o_orderkey").alias("q_id"), text.alias("text")), t.spark.createDataFrame([("Acme", "S01"), ("Zenith", "S02")], "name string, symbol string"))


@query("q104_rule_slots", f"WITH {TEXTS}, {SLOTS} SELECT * FROM s2", "start end as_of")
def _(t):
    return parsed(t)


@query("q105_slot_diff", f"WITH {TEXTS}, {SLOTS}, {Q} SELECT q_id, s2.symbol = q.symbol AS symbol_ok, s2.intent = q.intent AS intent_ok, s2.start IS NOT DISTINCT FROM q.start AS start_ok FROM s2 JOIN q USING (q_id)")
def _(t):
    return questions.slot_diff(parsed(t), asked(t), ["symbol", "intent", "start"])


# The flagship: may the columns of lineitem be quoted? Every finding of every probe is computed from the rows; a P0 makes unusable, any other caution.
NUMBERS = ("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
LINE_COLUMNS = (*NUMBERS, "l_shipdate", "l_returnflag")
_rate = lambda c, kind: f"avg((try_cast({c} AS {kind}) IS NULL)::INT) FILTER ({c} IS NOT NULL)"
BOARD = f"""WITH cols AS (SELECT unnest({list(LINE_COLUMNS)}) AS "column"), li AS (SELECT * REPLACE (CASE WHEN l_orderkey % 5 = 0 AND l_returnflag = 'N' THEN l_extendedprice * 40 ELSE l_extendedprice END AS l_extendedprice, CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity) FROM lineitem),
one AS ({" UNION ALL ".join(f"SELECT '{c}' AS column, 'P1' AS severity FROM li HAVING avg(({c} IS NULL)::INT) > 0" for c in LINE_COLUMNS)} UNION ALL {" UNION ALL ".join(f"SELECT '{c}', 'P1' FROM li HAVING {_rate(c, 'DOUBLE')} > 0.01" for c in NUMBERS)}
  UNION ALL SELECT 'l_shipdate', 'P1' FROM li HAVING {_rate('l_shipdate', 'TIMESTAMP')} > 0.01 UNION ALL SELECT '*', 'P0' FROM (SELECT count(*) AS n FROM li GROUP BY l_orderkey, l_linenumber) HAVING sum(n - 1) > 0
  UNION ALL SELECT '*', 'P1' FROM li HAVING floor(epoch(TIMESTAMP '2002-06-29' - max(l_shipdate::TIMESTAMP)) / 86400) > 7 UNION ALL SELECT '*', 'P2' FROM li HAVING floor(epoch(TIMESTAMP '2002-06-29' - max(l_shipdate::TIMESTAMP)) / 86400) < 0),
ol AS (WITH {{outliers}}), sh AS (WITH {{shifts}}), al AS (SELECT * FROM one UNION ALL SELECT "column", severity FROM ol UNION ALL SELECT "column", severity FROM sh)
SELECT 'lineitem' AS table_name, cols."column", CASE WHEN bool_or(severity = 'P0') THEN 'unusable' WHEN count(severity) > 0 THEN 'caution' ELSE 'baseline' END AS level FROM cols LEFT JOIN al ON al.column = cols."column" OR al.column = '*' GROUP BY ALL""".replace(
    "{outliers}", outlier_sql("li", "l_returnflag", NUMBERS, 0.05)).replace("{shifts}", shift_sql("li", "l_returnflag", "l_shipdate", NUMBERS))


@query("q088_badge_board", BOARD)
def _(t):
    spec = generic_probes.Spec("lineitem", tuple(D(c, k, False) for c, k in (("l_orderkey", "numeric"), ("l_linenumber", "numeric"), ("l_extendedprice", "numeric"), ("l_quantity", "numeric"), ("l_shipdate", "datetime"), ("l_returnflag", "text"))), ("l_orderkey", "l_linenumber"), "l_shipdate", "l_returnflag")
    price = F.when((F.col("l_orderkey") % 5 == 0) & (F.col("l_returnflag") == "N"), F.col("l_extendedprice") * 40).otherwise(F.col("l_extendedprice"))
    rows = t.lineitem.withColumns({"l_extendedprice": price, "l_quantity": F.when(F.col("l_linenumber") % 7 != 0, F.col("l_quantity"))}).select(*[c.name for c in spec.columns])
    found = at.generic(generic_probes.run(rows, spec, later_day()), rules(t)).withColumn("table_name", F.lit("lineitem")).withColumn("suppressed", F.lit(False))
    observed = t.spark.createDataFrame([("lineitem", c.name) for c in spec.columns], "table_name string, column string")
    every = found.where(F.col("column") == "*").drop("column").join(F.broadcast(observed), "table_name")
    return badges.board(found.where(F.col("column") != "*").unionByName(every), observed).select("table_name", "column", "level")
