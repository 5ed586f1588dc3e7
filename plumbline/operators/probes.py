"""Probes of a daily series: a table in, findings out.

A finding is a flat row: probe, table_name, symbol, metric, start, end, value, threshold, severity,
evidence (map). All windows of a symbol share one shuffle if the series is partitioned by symbol first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators import trading_calendar as cal
from plumbline.operators.intervals import merge_hits

FINDING = ["probe", "table_name", "symbol", "metric", "start", "end", "value", "threshold", "severity", "evidence"]


def _finding(rows: DataFrame, probe: str, table: str, metric: Column, value: Column, threshold: Column, severity: Column, evidence: dict[str, Column] | None = None) -> DataFrame:
    pairs = [x for k, v in (evidence or {}).items() for x in (F.lit(k), v.cast("string"))]
    return rows.select(
        F.lit(probe).alias("probe"), F.lit(table).alias("table_name"), "symbol", metric.alias("metric"), F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"),
        value.cast("double").alias("value"), threshold.cast("double").alias("threshold"), severity.alias("severity"), (F.create_map(*pairs) if pairs else F.expr("map()").cast("map<string,string>")).alias("evidence"),
    )


def clean(rows: DataFrame) -> DataFrame:
    """NaN becomes null, so that comparisons with it are not true."""
    kinds = dict(rows.dtypes)
    return rows.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in rows.columns])


def freshness(series: DataFrame, calendar: DataFrame, asof: Column, table: str = "daily") -> DataFrame:
    """Trading days that a symbol's last date is behind; 2 and more are P0."""
    last = series.groupBy("symbol").agg(F.max("date").alias("start"))
    lag = cal.staleness(last, calendar, "start", asof).where("lag_days >= 1").withColumn("end", asof)
    return _finding(lag, "freshness", table, F.lit("stale_trading_days"), F.col("lag_days"), F.lit(2), F.when(F.col("lag_days") >= 2, "P0").otherwise("P1"), {"last": F.col("start")})


def completeness(series: DataFrame, calendar: DataFrame, asof: Column, listed: DataFrame | None = None, table: str = "daily") -> DataFrame:
    """Runs of trading days without a row, from the listing date (or the first row) to asof."""
    first = series.groupBy("symbol").agg(F.min("date").alias("first"))
    if listed is not None:
        first = first.join(listed.select("symbol", "list_date"), "symbol", "left").withColumn("first", F.coalesce("list_date", "first"))
    expected = first.join(F.broadcast(calendar), (F.col("date") >= F.col("first")) & (F.col("date") <= asof)).select("symbol", "date", "day_no")
    missing = expected.join(series.select("symbol", "date").distinct(), ["symbol", "date"], "left_anti")
    return _finding(cal.collapse(missing), "completeness", table, F.lit("missing_trading_days"), F.col("days"), F.lit(1), F.lit("P1"), {"missing": F.array_join("sample", ",")})


def uniqueness(tables: dict[str, DataFrame]) -> DataFrame:
    """Keys (symbol, date) with more than one row, in each table."""
    out = []
    for name, rows in tables.items():
        twice = rows.groupBy("symbol", "date").agg(F.count("*").alias("n")).where("n > 1")
        keys = twice.groupBy("symbol").agg(F.count("*").alias("keys"), F.min("date").alias("start"), F.max("date").alias("end"))
        out.append(_finding(keys, "uniqueness", name, F.lit("duplicate_keys"), F.col("keys"), F.lit(1), F.lit("P0")))
    return reduce(DataFrame.unionByName, out)


def validity(series: DataFrame, limits: DataFrame | None = None, table: str = "daily") -> DataFrame:
    """Rows that break a rule, one finding for each symbol and rule."""
    rows = series if limits is None else series.join(limits.select("symbol", "price_limit"), "symbol", "left")
    limit = (F.lit(0.10) if limits is None else F.coalesce("price_limit", F.lit(0.10))) * 100
    rules = {"non_positive_close": F.col("close") <= 0, "pct_chg_out_of_limit": F.abs("pct_chg") > limit + 1e-6, "high_lt_low": F.col("high") < F.col("low"), "non_positive_volume": F.col("volume") <= 0}
    broken = F.explode(F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull()))
    hits = rows.select("symbol", "date", broken.alias("metric")).groupBy("symbol", "metric").agg(F.count("*").alias("n"), F.min("date").alias("start"), F.max("date").alias("end"))
    return _finding(hits, "validity", table, F.col("metric"), F.col("n"), F.lit(1), F.lit("P0"))


def _dated(hits: DataFrame, places: DataFrame) -> DataFrame:
    low = places.select("symbol", F.col("place").alias("lo"), F.col("date").alias("start"))
    high = places.select("symbol", F.col("place").alias("hi"), F.col("date").alias("end"))
    return hits.join(low, ["symbol", "lo"]).join(high, ["symbol", "hi"])


def volume_drift(series: DataFrame, up: float = 5.0, down: float = 0.2, table: str = "daily") -> DataFrame:
    """Mean of 10 rows over the mean of the 30 rows before, at each row from the 40th on; overlapping hits are merged."""
    w = W.partitionBy("symbol").orderBy("date")
    rows = series.select("symbol", "date", F.col("volume").cast("double").alias("volume"), F.row_number().over(w).alias("place"))
    recent, history = F.avg("volume").over(w.rowsBetween(-9, 0)), F.avg("volume").over(w.rowsBetween(-39, -10))
    ratio = F.when(history > 0, recent / history)
    hits = rows.withColumn("ratio", ratio).where((F.col("place") >= 40) & ((F.col("ratio") > up) | (F.col("ratio") < down)))
    merged = merge_hits(hits.select("symbol", (F.col("place") - 9).alias("lo"), F.col("place").alias("hi"), F.bround("ratio", 4).alias("value")), ["symbol"])
    return _finding(_dated(merged, rows), "drift", table, F.lit("volume_recent_over_history"), F.col("value"), F.lit(up), F.lit("P1"))


def unit_shift(values: DataFrame, column: str, up: float = 100.0, down: float = 0.01, table: str = "valuation") -> DataFrame:
    """The first row at which the mean of the next 5 is far from the mean of the 30 before."""
    w = W.partitionBy("symbol").orderBy("date")
    v = F.col(column).cast("double")
    rows = values.select("symbol", "date", F.row_number().over(w).alias("place"), F.count("*").over(W.partitionBy("symbol")).alias("n"), F.avg(v).over(w.rowsBetween(-30, -1)).alias("before"), F.avg(v).over(w.rowsBetween(0, 4)).alias("after"), F.max("date").over(W.partitionBy("symbol")).alias("end"))
    rows = rows.where((F.col("n") >= 40) & (F.col("place") > 30) & (F.col("place") <= F.col("n") - 4) & (F.col("before") > 0) & (F.col("after") > 0)).withColumn("ratio", F.col("after") / F.col("before"))
    hits = rows.where((F.col("ratio") >= up) | (F.col("ratio") <= down))
    first = hits.groupBy("symbol").agg(F.min(F.struct("place", F.col("date").alias("start"), "end", "ratio")).alias("h")).select("symbol", "h.start", "h.end", "h.ratio")
    return _finding(first, "drift", table, F.lit(f"{column}_level_shift"), F.bround("ratio", 6), F.lit(up), F.lit("P0"))


def null_sweep(series: DataFrame, columns: list[str], table: str = "daily") -> DataFrame:
    """Runs of 15 rows of which more than half are null, and 0.3 more than of the 45 rows before."""
    w = W.partitionBy("symbol", "name").orderBy("date")
    names = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).isNull().cast("double").alias("gone")) for c in columns]))
    rows = series.select("symbol", "date", names.alias("x")).select("symbol", "date", "x.name", "x.gone").withColumn("place", F.row_number().over(w))
    rate, past = F.avg("gone").over(w.rowsBetween(-14, 0)), F.avg("gone").over(w.rowsBetween(-59, -15))
    hits = rows.withColumn("rate", rate).withColumn("past", past).where((F.col("place") >= 60) & (F.col("rate") > 0.5) & (F.col("rate") - F.col("past") > 0.3))
    merged = merge_hits(hits.select("symbol", "name", (F.col("place") - 14).alias("lo"), F.col("place").alias("hi"), F.bround("rate", 4).alias("value")), ["symbol", "name"])
    dated = _dated(merged, rows.where(F.col("name") == columns[0]))
    return _finding(dated, "null_sweep", table, F.concat(F.lit("null_rate::"), F.col("name")), F.col("value"), F.lit(0.5), F.lit("P1"))


def history_depth(series: DataFrame, least: int = 30, table: str = "daily") -> DataFrame:
    rows = series.groupBy("symbol").agg(F.count("*").alias("n"), F.min("date").alias("start"), F.max("date").alias("end")).where(F.col("n") < least)
    return _finding(rows, "history_depth", table, F.lit("history_trading_days"), F.col("n"), F.lit(least), F.lit("P2"))


def union(**plans) -> DataFrame:
    """All findings of named probes (functions without arguments). One whose plan lacks a column gives a finding `skipped` that names it and says why; any other error is raised."""
    from pyspark.errors import AnalysisException
    from pyspark.sql import SparkSession

    out, lacking = [], []
    for name, plan in plans.items():
        try:
            out.append(plan())
        except AnalysisException as e:
            if not str(e.getCondition()).startswith("UNRESOLVED_COLUMN"):
                raise
            lacking.append((name, str((e.getMessageParameters() or {}).get("objectName", "")).strip("`")))
    if lacking:
        rows = SparkSession.getActiveSession().createDataFrame(lacking, "table_name string, symbol string").withColumn("start", F.lit(None)).withColumn("end", F.lit(None))
        out.append(_skipped(rows))
    return reduce(DataFrame.unionByName, out)


def _skipped(rows: DataFrame) -> DataFrame:
    """Findings for probes (table_name) that lack a column (symbol)."""
    found = _finding(rows.withColumnRenamed("table_name", "_of"), "skipped", "", F.concat_ws("::", "_of", F.concat(F.lit("column_missing::"), F.col("symbol"))), F.lit(None), F.lit(None), F.lit("P2"))
    return found.withColumn("symbol", F.lit(None).cast("string"))
