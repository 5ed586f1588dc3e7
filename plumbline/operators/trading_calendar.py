"""Trading calendars as DataFrames: date and a dense day_no, so that ranges are subtractions.

A calendar has one row for each trading day; its size is bounded by the span of days, never by the data,
so broadcasting it is safe.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators.intervals import islands, overlapping


def numbered(days: DataFrame) -> DataFrame:
    """date, day_no (from 1) of distinct days. All days of a calendar fit one task: some 25,000 in a century."""
    return days.select("date").where("date is not null").distinct().withColumn("day_no", F.row_number().over(W.orderBy("date")).cast("long"))


def weekdays(span: DataFrame, holidays: Iterable[str] = (), extra: Iterable[str] = ()) -> DataFrame:
    """Weekdays between span.lo and span.hi without holidays, and the extra trading days."""
    spark = span.sparkSession
    dates = lambda x: spark.createDataFrame([(d,) for d in x], "d string").select(F.to_date("d").alias("date"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("date")).where(F.weekday("date") < 5)
    return numbered(days.join(F.broadcast(dates(holidays)), "date", "left_anti").union(dates(extra)))


def with_observed(calendar: DataFrame, observed: DataFrame) -> DataFrame:
    """The calendar and every date that the data has."""
    return numbered(calendar.select("date").union(observed.select("date")))


def is_trading_day(rows: DataFrame, calendar: DataFrame, day: str = "date") -> DataFrame:
    c = F.broadcast(calendar.select(F.col("date").alias("cal_date")))
    return rows.join(c, F.col(day) == F.col("cal_date"), "left").withColumn("is_trading_day", F.col("cal_date").isNotNull()).drop("cal_date")


def day_numbers(calendar: DataFrame) -> DataFrame:
    """For every calendar date (day) of the span: trading days up to it (upto), and the trading days before and after it."""
    span = calendar.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = span.select(F.explode(F.sequence(F.date_sub("lo", 1), F.date_add("hi", 366))).alias("day"))
    w = W.orderBy("day")
    known = days.join(calendar, days["day"] == calendar["date"], "left")
    known = known.withColumn("upto", F.coalesce(F.last("day_no", True).over(w), F.lit(0)))
    before = F.last("date", True).over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.first("date", True).over(w.rowsBetween(1, W.unboundedFollowing))
    return known.select("day", "upto", F.coalesce(before, F.date_sub("day", 1)).alias("previous"), F.coalesce(after, F.date_add("day", 1)).alias("next"))


def trading_days_between(rows: DataFrame, calendar: DataFrame, start: str, end: str, name: str = "trading_days") -> DataFrame:
    """Adds the number of trading days in the closed range."""
    n = F.broadcast(day_numbers(calendar).select("day", "upto"))
    low = n.select(F.col("day").alias("low_day"), F.col("upto").alias("low_upto"))
    high = n.select(F.col("day").alias("high_day"), F.col("upto").alias("high_upto"))
    out = rows.join(low, F.date_sub(F.col(start), 1) == F.col("low_day"), "left").join(high, F.col(end) == F.col("high_day"), "left")
    return out.withColumn(name, F.greatest(F.lit(0), F.coalesce("high_upto", F.lit(0)) - F.coalesce("low_upto", F.lit(0)))).drop("low_day", "low_upto", "high_day", "high_upto")


def staleness(rows: DataFrame, calendar: DataFrame, last: str, asof: Column) -> DataFrame:
    """Trading days in (last, the trading day before asof]."""
    n = F.broadcast(day_numbers(calendar))
    expected = n.where(F.col("day") == asof).select(F.col("previous").alias("expected_date"))
    rows = rows.crossJoin(F.broadcast(expected))  # one row: asof is one day
    rows = trading_days_between(rows.withColumn("after_last", F.date_add(F.col(last), 1)), calendar, "after_last", "expected_date", "lag_days")
    return rows.drop("after_last")


def expanded(intervals: DataFrame, calendar: DataFrame) -> DataFrame:
    """Trading days of each interval; without an end it is one day."""
    days = intervals.select("symbol", F.explode(F.sequence("begin_date", F.coalesce("end_date", "begin_date"))).alias("date"))
    return days.join(F.broadcast(calendar.select("date")), "date", "left_semi").distinct()


def coverage(windows: DataFrame, calendar: DataFrame, days: DataFrame, keys: list[str]) -> DataFrame:
    """Share of a window's trading days that are in days (symbol, date); 0 without a trading day. keys name a window."""
    total = trading_days_between(windows, calendar, "start", "end", "window_days")
    d = days.select(F.col("symbol").alias("d_symbol"), F.col("date").alias("d_date"))
    hit = overlapping(windows.select(*keys), d, {"symbol": "d_symbol"}, ("start", "end"), ("d_date", "d_date")).groupBy(*keys).agg(F.count("*").alias("covered_days"))
    out = total.join(hit, keys, "left").withColumn("covered_days", F.coalesce("covered_days", F.lit(0)))
    return out.withColumn("coverage", F.when(F.col("window_days") > 0, F.col("covered_days") / F.col("window_days")).otherwise(0.0))


def collapse(missing: DataFrame) -> DataFrame:
    """symbol, start, end, days of runs of missing days (symbol, date, day_no) that follow each other in the calendar."""
    return islands(missing, ["symbol"], "day_no").groupBy("symbol", "island").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("days"), F.slice(F.array_sort(F.collect_list("date")), 1, 10).alias("sample")).drop("island")
