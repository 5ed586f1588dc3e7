"""Queries over the daily series: calendar, probes, metrics, attribution, badges."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import attribution, badges, generic_probes, intervals, probes
from plumbline.operators import trading_calendar as cal
from plumbline.plans.inputs import ASOF, CALENDAR, HOLIDAYS, SERIES, SUSPENSION_SQL, series, suspensions
from plumbline.plans.registry import query



def day():
    return F.to_date(F.lit(ASOF))


S = f"s AS ({SERIES}), c AS ({CALENDAR}), halt AS ({SUSPENSION_SQL})"


def calendar(t):
    span = t.lineitem.agg(F.to_date(F.min("l_shipdate")).alias("lo"), F.to_date(F.max("l_shipdate")).alias("hi"))
    return cal.weekdays(span, HOLIDAYS)


@query("q034_trading_day_test", f"WITH {S} SELECT d AS date, d IN (SELECT date FROM c) AS is_trading_day FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)", "date")
def _(t):
    return cal.is_trading_day(t.orders.select(F.to_date("o_orderdate").alias("date")).distinct(), calendar(t))


@query("q035_calendar_with_observed", f"WITH {S}, u AS (SELECT date FROM c UNION SELECT date FROM s) SELECT date, row_number() OVER (ORDER BY date) AS day_no FROM u", "date")
def _(t):
    return cal.with_observed(calendar(t), series(t))


@query("q036_trading_days_in_range", f"WITH {S}, r AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + (o_orderkey % 40)::INT AS b FROM orders) SELECT o_orderkey, (SELECT count(*) FROM c WHERE c.date BETWEEN a AND b) AS trading_days FROM r")
def _(t):
    rows = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("a")).withColumn("b", F.expr("date_add(a, cast(o_orderkey % 40 as int))"))
    return cal.trading_days_between(rows, calendar(t), "a", "b").select("o_orderkey", "trading_days")


@query("q037_previous_next_trading_day", f"WITH {S}, d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem) SELECT day, coalesce((SELECT max(date) FROM c WHERE c.date < day), day - 1) AS previous, coalesce((SELECT min(date) FROM c WHERE c.date > day), day + 1) AS next FROM d", "day previous next")
def _(t):
    days = t.lineitem.select(F.to_date("l_shipdate").alias("day")).distinct()
    return days.join(F.broadcast(cal.day_numbers(calendar(t))), "day").select("day", "previous", "next")


@query("q038_staleness", f"WITH {S}, l AS (SELECT symbol, max(date) AS last FROM s GROUP BY 1), e AS (SELECT max(date) AS expected FROM c WHERE date < DATE '{ASOF}') SELECT symbol, last, (SELECT count(*) FROM c WHERE c.date > last AND c.date <= expected) AS lag_days FROM l, e", "last")
def _(t):
    return cal.staleness(series(t).groupBy("symbol").agg(F.max("date").alias("last")), calendar(t), "last", day()).select("symbol", "last", "lag_days")


@query("q039_suspension_days", f"WITH {S} SELECT DISTINCT halt.symbol, c.date FROM halt JOIN c ON c.date BETWEEN begin_date AND coalesce(end_date, begin_date)", "date")
def _(t):
    return cal.expanded(suspensions(t), calendar(t)).select("symbol", "date")


WINDOWS = "w AS (SELECT symbol, date_trunc('month', date)::DATE AS a, last_day(date) AS b FROM s GROUP BY ALL)"


@query("q040_window_coverage", f"""WITH {S}, {WINDOWS}, h AS (SELECT DISTINCT halt.symbol, c.date FROM halt JOIN c ON c.date BETWEEN begin_date AND coalesce(end_date, begin_date)),
n AS (SELECT symbol, a, b, (SELECT count(*) FROM c WHERE c.date BETWEEN a AND b) AS days, (SELECT count(*) FROM h WHERE h.symbol = w.symbol AND h.date BETWEEN a AND b) AS hit FROM w)
SELECT symbol, a AS start, round(CASE WHEN days > 0 THEN hit / days ELSE 0 END, 6) AS coverage FROM n""", "start")
def _(t):
    w = series(t).select("symbol", F.trunc("date", "month").alias("start"), F.last_day("date").alias("end")).distinct()
    out = cal.coverage(w, calendar(t), cal.expanded(suspensions(t), calendar(t)), ["symbol", "start", "end"])
    return out.select("symbol", "start", F.round("coverage", 6).alias("coverage"))


MISSING = f"f AS (SELECT symbol, min(date) AS first FROM s GROUP BY 1), m AS (SELECT f.symbol, c.date, c.day_no FROM f JOIN c ON c.date >= first AND c.date <= DATE '{ASOF}' ANTI JOIN s ON s.symbol = f.symbol AND s.date = c.date)"
ISLANDS = f"{MISSING}, i AS (SELECT symbol, date, day_no - row_number() OVER (PARTITION BY symbol ORDER BY day_no) AS g FROM m)"


@query("q041_gap_collapse", f'WITH {S}, {ISLANDS} SELECT symbol, min(date) AS start, max(date) AS "end", count(*) AS days FROM i GROUP BY symbol, g', "start end")
def _(t):
    s = series(t)
    first = s.groupBy("symbol").agg(F.min("date").alias("first"))
    expected = first.join(F.broadcast(calendar(t)), (F.col("date") >= F.col("first")) & (F.col("date") <= day())).select("symbol", "date", "day_no")
    return cal.collapse(expected.join(s.select("symbol", "date"), ["symbol", "date"], "left_anti")).drop("sample")


def flat(findings):
    return findings.drop("evidence").withColumn("value", F.round("value", 4))


def shaped(select: str) -> str:
    return f'SELECT probe, table_name, symbol, metric, start, "end", round(value::DOUBLE, 4) AS value, threshold::DOUBLE AS threshold, severity FROM ({select})'


FRESH = f"""SELECT 'freshness' AS probe, 'daily' AS table_name, symbol, 'stale_trading_days' AS metric, last AS start, DATE '{ASOF}' AS "end", lag AS value, 2 AS threshold, CASE WHEN lag >= 2 THEN 'P0' ELSE 'P1' END AS severity
FROM (SELECT symbol, last, (SELECT count(*) FROM c WHERE c.date > last AND c.date <= (SELECT max(date) FROM c WHERE date < DATE '{ASOF}')) AS lag FROM (SELECT symbol, max(date) AS last FROM s GROUP BY 1)) WHERE lag >= 1"""
COMPLETE = """SELECT 'completeness' AS probe, 'daily' AS table_name, symbol, 'missing_trading_days' AS metric, min(date) AS start, max(date) AS "end", count(*) AS value, 1 AS threshold, 'P1' AS severity FROM i GROUP BY symbol, g"""


@query("q042_freshness_probe", f"WITH {S} {shaped(FRESH)}", "start end")
def _(t):
    return flat(probes.freshness(series(t), calendar(t), day()))


@query("q043_completeness_probe", f"WITH {S}, {ISLANDS} {shaped(COMPLETE)}", "start end")
def _(t):
    return flat(probes.completeness(series(t), calendar(t), day()))


RAW = "SELECT printf('S%02d', l_suppkey % 25) AS symbol, CAST(l_shipdate AS DATE) AS date FROM lineitem"
UNIQUE = """SELECT 'uniqueness' AS probe, 'raw' AS table_name, symbol, 'duplicate_keys' AS metric, min(date) AS start, max(date) AS "end", count(*) AS value, 1 AS threshold, 'P0' AS severity FROM (SELECT symbol, date FROM raw GROUP BY ALL HAVING count(*) > 1) GROUP BY symbol"""


def raw(t):
    return t.lineitem.select(F.format_string("S%02d", F.col("l_suppkey") % 25).alias("symbol"), F.to_date("l_shipdate").alias("date"))


@query("q044_uniqueness_probe", f"WITH raw AS ({RAW}) {shaped(UNIQUE)}", "start end")
def _(t):
    return flat(probes.uniqueness({"raw": raw(t), "daily": series(t)}))


#: The series with a daily change, limits of 20 percent for some symbols, and faults of known places.
FAULTY = f"""x AS (SELECT symbol, date, close, high, low, volume, round(100 * (close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1), 4) AS pct_chg FROM s),
y AS (SELECT symbol, date, CASE WHEN dayofyear(date) = 77 THEN -close ELSE close END AS close, high, CASE WHEN dayofyear(date) = 99 THEN high + 1 ELSE low END AS low, CASE WHEN dayofyear(date) = 111 THEN 0 ELSE volume END AS volume, pct_chg FROM x)"""


def faulty(t):
    from pyspark.sql import Window as W

    s, d = series(t), F.dayofyear("date")
    s = s.withColumn("pct_chg", F.round(100 * (F.col("close") / F.lag("close").over(W.partitionBy("symbol").orderBy("date")) - 1), 4))
    return s.withColumn("close", F.when(d == 77, -F.col("close")).otherwise(F.col("close"))).withColumn("low", F.when(d == 99, F.col("high") + 1).otherwise(F.col("low"))).withColumn("volume", F.when(d == 111, 0.0).otherwise(F.col("volume")))


def limits(t):
    return series(t).select("symbol").distinct().where("symbol < 'S05'").withColumn("price_limit", F.lit(0.2))


VALID = """SELECT 'validity' AS probe, 'daily' AS table_name, symbol, metric, min(date) AS start, max(date) AS "end", count(*) AS value, 1 AS threshold, 'P0' AS severity FROM (
SELECT symbol, date, 'non_positive_close' AS metric FROM y WHERE close <= 0 UNION ALL SELECT symbol, date, 'high_lt_low' FROM y WHERE high < low UNION ALL SELECT symbol, date, 'non_positive_volume' FROM y WHERE volume <= 0
UNION ALL SELECT symbol, date, 'pct_chg_out_of_limit' FROM y WHERE abs(pct_chg) > CASE WHEN symbol < 'S05' THEN 20.0 ELSE 10.0 END + 1e-6) GROUP BY symbol, metric"""


@query("q045_validity_probe", f"WITH {S}, {FAULTY} {shaped(VALID)}", "start end")
def _(t):
    return flat(probes.validity(faulty(t), limits(t)))


PLACES = "p AS (SELECT symbol, date, volume, row_number() OVER w AS i, avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS a, avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 39 PRECEDING AND 10 PRECEDING) AS b FROM s WINDOW w AS (PARTITION BY symbol ORDER BY date))"
MERGED = """k AS (SELECT *, coalesce(max(hi) OVER (PARTITION BY symbol ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 < lo, true)::INT AS b FROM h),
g AS (SELECT *, sum(b) OVER (PARTITION BY symbol ORDER BY lo) AS part FROM k), mg AS (SELECT symbol, min(lo) AS lo, max(hi) AS hi, arg_min(v, lo) AS v FROM g GROUP BY symbol, part)"""
DRIFT = """SELECT 'drift' AS probe, 'daily' AS table_name, mg.symbol, 'volume_recent_over_history' AS metric, p1.date AS start, p2.date AS "end", v AS value, 1.5 AS threshold, 'P1' AS severity FROM mg JOIN p p1 ON p1.symbol = mg.symbol AND p1.i = lo JOIN p p2 ON p2.symbol = mg.symbol AND p2.i = hi"""
DRIFT_CTE = f"{PLACES}, h AS (SELECT symbol, i - 9 AS lo, i AS hi, round(a / b, 4) AS v FROM p WHERE i >= 40 AND (a / b > 1.5 OR a / b < 0.67)), {MERGED}"


@query("q046_volume_drift_probe", f"WITH {S}, {DRIFT_CTE} {shaped(DRIFT)}", "start end")
def _(t):
    return flat(probes.volume_drift(series(t), 1.5, 0.67))


#: Market values that jump by a factor of 1000 for some symbols from a day on.
MV = "v AS (SELECT symbol, date, close * CASE WHEN symbol < 'S06' AND date >= DATE '1999-03-01' THEN 1000 ELSE 1 END AS total_mv FROM s)"


def market_values(t):
    return series(t).select("symbol", "date", (F.col("close") * F.when((F.col("symbol") < "S06") & (F.col("date") >= F.lit("1999-03-01")), 1000).otherwise(1)).alias("total_mv"))


@query("q047_unit_shift_probe", f"""WITH {S}, {MV}, p AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, count(*) OVER (PARTITION BY symbol) AS n, max(date) OVER (PARTITION BY symbol) AS last,
avg(total_mv) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS a, avg(total_mv) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS b FROM v),
h AS (SELECT * FROM p WHERE n >= 40 AND i > 30 AND i <= n - 4 AND (b / a >= 100 OR b / a <= 0.01) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i) = 1)
{shaped("SELECT 'drift' AS probe, 'valuation' AS table_name, symbol, 'total_mv_level_shift' AS metric, date AS start, last AS " + '"end"' + ", b / a AS value, 100 AS threshold, 'P0' AS severity FROM h")}""", "start end")
def _(t):
    return flat(probes.unit_shift(market_values(t), "total_mv"))


@query("q048_sliding_hit_merge", f"WITH {S}, {DRIFT_CTE} SELECT symbol, lo, hi, v AS value FROM mg")
def _(t):
    from pyspark.sql import Window as W

    w = W.partitionBy("symbol").orderBy("date")
    a, b = F.avg("volume").over(w.rowsBetween(-9, 0)), F.avg("volume").over(w.rowsBetween(-39, -10))
    p = series(t).select("symbol", F.row_number().over(w).cast("long").alias("hi"), (a / b).alias("r")).where("hi >= 40 and (r > 1.5 or r < 0.67)")
    return intervals.merge_hits(p.select("symbol", (F.col("hi") - 9).alias("lo"), "hi", F.round("r", 4).alias("value")), ["symbol"])


NULLED = "z AS (SELECT symbol, date, CASE WHEN month(date) IN (4, 5, 6) AND year(date) % 2 = 0 AND symbol < 'S09' THEN NULL ELSE volume END AS volume, CASE WHEN month(date) = 9 AND day(date) > 2 THEN NULL ELSE amount END AS amount FROM s)"


def nulled(t):
    v = F.when(~(F.month("date").isin(4, 5, 6) & (F.year("date") % 2 == 0) & (F.col("symbol") < "S09")), F.col("volume"))
    a = F.when(~((F.month("date") == 9) & (F.dayofmonth("date") > 2)), F.col("amount"))
    return series(t).withColumn("volume", v).withColumn("amount", a)


@query("q049_null_sweep_probe", f"""WITH {S}, {NULLED}, u AS (SELECT symbol, date, 'volume' AS name, (volume IS NULL)::INT AS gone FROM z UNION ALL SELECT symbol, date, 'amount', (amount IS NULL)::INT FROM z),
p AS (SELECT symbol, name, date, row_number() OVER w AS i, avg(gone) OVER (w ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS a, avg(gone) OVER (w ROWS BETWEEN 59 PRECEDING AND 15 PRECEDING) AS b FROM u WINDOW w AS (PARTITION BY symbol, name ORDER BY date)),
h AS (SELECT symbol, name, i - 14 AS lo, i AS hi, round(a, 4) AS v FROM p WHERE i >= 60 AND a > 0.5 AND a - b > 0.3),
k AS (SELECT *, coalesce(max(hi) OVER (PARTITION BY symbol, name ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 < lo, true)::INT AS b FROM h), g AS (SELECT *, sum(b) OVER (PARTITION BY symbol, name ORDER BY lo) AS part FROM k),
mg AS (SELECT symbol, name, min(lo) AS lo, max(hi) AS hi, arg_min(v, lo) AS v FROM g GROUP BY symbol, name, part)
{shaped("SELECT 'null_sweep' AS probe, 'daily' AS table_name, mg.symbol, 'null_rate::' || mg.name AS metric, p1.date AS start, p2.date AS " + '"end"' + ", v AS value, 0.5 AS threshold, 'P1' AS severity FROM mg JOIN p p1 ON p1.symbol = mg.symbol AND p1.name = mg.name AND p1.i = lo JOIN p p2 ON p2.symbol = mg.symbol AND p2.name = mg.name AND p2.i = hi")}""", "start end")
def _(t):
    return flat(probes.null_sweep(nulled(t), ["volume", "amount"]))


SHORT = "d AS (SELECT * FROM s WHERE date >= CASE WHEN symbol < 'S04' THEN DATE '2001-10-15' ELSE DATE '1990-01-01' END)"
DEPTH = """SELECT 'history_depth' AS probe, 'daily' AS table_name, symbol, 'history_trading_days' AS metric, min(date) AS start, max(date) AS "end", count(*) AS value, 30 AS threshold, 'P2' AS severity FROM d GROUP BY symbol HAVING count(*) < 30"""


def short(t):
    return series(t).where("date >= case when symbol < 'S04' then date '2001-10-15' else date '1990-01-01' end")


@query("q050_history_depth_probe", f"WITH {S}, {SHORT} {shaped(DEPTH)}", "start end")
def _(t):
    return flat(probes.history_depth(short(t)))


@query("q051_probe_union", f"WITH {S}, {ISLANDS}, {SHORT}, {FAULTY}, raw AS ({RAW}) " + " UNION ALL ".join([*[shaped(x) for x in (FRESH, COMPLETE, UNIQUE, VALID, DEPTH)], shaped("SELECT 'skipped' AS probe, '' AS table_name, NULL::VARCHAR AS symbol, 'no_close::column_missing::close' AS metric, NULL::DATE AS start, NULL::DATE AS \"end\", NULL::DOUBLE AS value, NULL::DOUBLE AS threshold, 'P2' AS severity")]), "start end")
def _(t):
    s = series(t)
    return flat(probes.union(fresh=lambda: probes.freshness(s, calendar(t), day()), complete=lambda: probes.completeness(s, calendar(t), day()), unique=lambda: probes.uniqueness({"raw": raw(t)}), valid=lambda: probes.validity(faulty(t), limits(t)), depth=lambda: probes.history_depth(short(t)), no_close=lambda: probes.unit_shift(s.drop("close"), "close")))


# Generic probes.
D = generic_probes.Declared
LINEITEM = generic_probes.Spec("lineitem", (D("l_orderkey", "numeric", False), D("l_linenumber", "numeric", False), D("l_extendedprice", "numeric"), D("l_quantity", "numeric"), D("l_shipdate", "datetime", False), D("l_comment", "text"), D("l_returnflag", "numeric")), ("l_orderkey", "l_linenumber"), "l_shipdate", "l_returnflag", outliers=0.001)


def later_day():
    return F.to_date(F.lit("2002-06-29"))


@query("q052_schema_conformance", """SELECT * FROM (VALUES ('schema', 'l_comment', 'column_missing', 1.0::DOUBLE, 1.0::DOUBLE, 'P1'), ('schema', 'l_discount', 'column_extra', 1.0, 1.0, 'P2'), ('schema', 'l_linestatus', 'column_extra', 1.0, 1.0, 'P2'), ('schema', 'l_partkey', 'column_extra', 1.0, 1.0, 'P2'),
('schema', 'l_suppkey', 'column_extra', 1.0, 1.0, 'P2'), ('schema', 'l_tax', 'column_extra', 1.0, 1.0, 'P2')) AS x(probe, "column", metric, value, threshold, severity)
UNION ALL SELECT 'schema', 'l_returnflag', 'type_mismatch::l_returnflag', avg((try_cast(l_returnflag AS DOUBLE) IS NULL)::INT), 0.01, 'P1' FROM lineitem""")
def _(t):
    return generic_probes.conformance(t.lineitem, LINEITEM)


NULLY = "SELECT event_id, user_id, ts, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, CASE WHEN event_id % 50 = 0 THEN NULL ELSE event_type END AS event_type FROM events"
EVENTS = generic_probes.Spec("events", (D("event_id", "numeric", False), D("value", "numeric", False), D("event_type", "categorical", True, 0.01), D("user_id", "numeric", True)), ("event_id",), "ts", "event_type", fresh_days=3, outliers=0.01)


def nully(t):
    return t.events.select("event_id", "user_id", "ts", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 50 != 0, F.col("event_type")).alias("event_type"))


@query("q053_null_completeness", f"""WITH e AS ({NULLY}) SELECT 'completeness' AS probe, 'value' AS "column", 'null_rate::value' AS metric, round(avg((value IS NULL)::INT), 6) AS value, 0.0::DOUBLE AS threshold, 'P1' AS severity FROM e
UNION ALL SELECT 'completeness', 'event_type', 'null_rate::event_type', round(avg((event_type IS NULL)::INT), 6), 0.01, 'P2' FROM e""")
def _(t):
    return generic_probes.nulls(nully(t), EVENTS).withColumn("value", F.round("value", 6))


@query("q054_key_uniqueness", """SELECT 'uniqueness' AS probe, '*' AS "column", 'duplicate_keys' AS metric, sum(n - 1)::DOUBLE AS value, 0.0::DOUBLE AS threshold, 'P0' AS severity FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def _(t):
    return generic_probes.key_uniqueness(t.lineitem, LINEITEM)


@query("q055_freshness_and_future", """SELECT 'freshness' AS probe, '*' AS "column", 'stale_days' AS metric, floor(epoch(TIMESTAMP '2002-06-29' - max(l_shipdate)) / 86400)::DOUBLE AS value, 7.0::DOUBLE AS threshold, 'P1' AS severity FROM lineitem
UNION ALL SELECT 'freshness', '*', 'future_timestamps', -floor(epoch(TIMESTAMP '2000-01-01' - max(ts)) / 86400), 0.0, 'P2' FROM events""")
def _(t):
    return generic_probes.freshness(t.lineitem, LINEITEM, later_day()).union(generic_probes.freshness(t.events, EVENTS, F.to_date(F.lit("2000-01-01"))))


def outlier_sql(table, group, columns, least):
    parts = [f"SELECT {group} AS g, '{c}' AS name, {c}::DOUBLE AS v FROM {table} WHERE {c} IS NOT NULL AND {group} IS NOT NULL" for c in columns]
    return f"""x AS ({" UNION ALL ".join(parts)}), q AS (SELECT g, name, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM x GROUP BY ALL HAVING count(*) >= 20),
r AS (SELECT name, max(rate) AS rate FROM (SELECT g, name, avg(((v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)) AND b > a)::INT) AS rate FROM x JOIN q USING (g, name) GROUP BY ALL) GROUP BY name)
SELECT 'outlier' AS probe, name AS "column", 'outlier_rate::' || name AS metric, round(rate, 6) AS value, {least}::DOUBLE AS threshold, 'P2' AS severity FROM r WHERE rate > {least}"""


@query("q056_iqr_outlier_rate", f"WITH e AS ({NULLY}), {outlier_sql('e', 'event_type', ['event_id', 'value', 'user_id'], 0.01)}")
def _(t):
    return generic_probes.outliers(nully(t), EVENTS).withColumn("value", F.round("value", 6))


SHIFTY = "SELECT event_id, ts, event_type, CASE WHEN event_type = 'click' AND ts >= TIMESTAMP '2024-01-25' THEN value * 20 ELSE value END AS value FROM events"
SHIFT = generic_probes.Spec("events", (D("event_id", "numeric"), D("value", "numeric")), ("event_id",), "ts", "event_type")


def shift_sql(table, group, time, columns):
    parts = [f"SELECT {group} AS g, '{c}' AS name, {time} AS ts, {c}::DOUBLE AS v FROM {table} WHERE {c} IS NOT NULL AND {group} IS NOT NULL AND {time} IS NOT NULL" for c in columns]
    return f"""sx AS ({" UNION ALL ".join(parts)}), sp AS (SELECT *, count(*) OVER (PARTITION BY g, name) AS n, row_number() OVER (PARTITION BY g, name ORDER BY ts, v) AS i FROM sx),
sm AS (SELECT g, name, avg(v) FILTER (i > floor(n * 0.8)) / avg(v) FILTER (i <= floor(n * 0.8)) AS r FROM sp WHERE n >= 25 GROUP BY g, name HAVING avg(v) FILTER (i <= floor(n * 0.8)) > 0 AND any_value(floor(n * 0.8)) >= 20)
SELECT 'outlier' AS probe, name AS "column", 'level_shift::' || name AS metric, round(arg_max(r, greatest(r, 1 / r)), 3) AS value, 3.0::DOUBLE AS threshold, 'P1' AS severity FROM sm WHERE r >= 3 OR r <= 1.0 / 3 GROUP BY name"""


@query("q057_level_shift", f"WITH e AS ({SHIFTY}), {shift_sql('e', 'event_type', 'ts', ['value', 'event_id'])}")
def _(t):
    e = t.events.select("event_id", "ts", "event_type", F.when((F.col("event_type") == "click") & (F.col("ts") >= F.lit("2024-01-25").cast("timestamp")), F.col("value") * 20).otherwise(F.col("value")).alias("value"))
    return generic_probes.level_shift(e, SHIFT).withColumn("value", F.round("value", 3))


@query("q058_skipped_checks", "SELECT p.probe, p.reason, n AS rows FROM (VALUES ('uniqueness', 'no declared key'), ('freshness', 'no time column'), ('level_shift', 'no time column')) AS p(probe, reason), (SELECT count(*) AS n FROM documents)")
def _(t):
    spec = generic_probes.Spec("documents", (D("doc_id", "numeric"),))
    return generic_probes.skipped(t.spark, spec).crossJoin(t.documents.agg(F.count("*").alias("rows")))  # one row


@query("q026_kind_inference", """SELECT * FROM (VALUES ('event_id', 'numeric'), ('ts', 'datetime'), ('user_id', 'numeric'), ('event_type', 'categorical'), ('value', 'numeric')) AS x("column", kind)
UNION ALL SELECT 'props', CASE WHEN count(DISTINCT props) <= greatest(20, count(props) / 10.0) THEN 'categorical' ELSE 'text' END FROM events""")
def _(t):
    return generic_probes.infer(t.events)
