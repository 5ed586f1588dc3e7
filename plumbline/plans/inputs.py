"""Inputs that the queries derive from the tables, each beside the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASOF = "2001-11-09"

#: A daily series for each of 25 entities.
SERIES = """SELECT printf('S%02d', l_suppkey % 25) AS symbol, CAST(l_shipdate AS DATE) AS date, round(avg(l_extendedprice), 4) AS close,
  max(l_extendedprice) AS high, min(l_extendedprice) AS low, sum(l_quantity) AS volume, round(sum(l_extendedprice), 2) AS amount FROM lineitem GROUP BY 1, 2"""


def series(t) -> DataFrame:
    price = F.col("l_extendedprice")
    return (
        t.lineitem.groupBy(F.format_string("S%02d", F.col("l_suppkey") % 25).alias("symbol"), F.to_date("l_shipdate").alias("date"))
        .agg(F.round(F.avg(price), 4).alias("close"), F.max(price).alias("high"), F.min(price).alias("low"), F.sum("l_quantity").alias("volume"), F.round(F.sum(price), 2).alias("amount"))
    )


#: Holidays that the calendar leaves out.
HOLIDAYS = ("1996-01-01", "1997-01-01", "1998-01-01", "1999-01-01", "2000-12-25")
CALENDAR = f"""SELECT date, row_number() OVER (ORDER BY date) AS day_no FROM (SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS d
  FROM (SELECT CAST(min(l_shipdate) AS DATE) AS lo, CAST(max(l_shipdate) AS DATE) AS hi FROM lineitem)))
  WHERE isodow(date) <= 5 AND date NOT IN ({", ".join(f"DATE '{d}'" for d in HOLIDAYS)})"""

#: Suspensions of some entities, (symbol, begin, end); a null end is one day.
SUSPENSIONS = (("S03", "1997-02-03", "1997-02-14"), ("S07", "1998-06-01", "1998-06-30"), ("S11", "1999-03-10", None), ("S19", "2000-05-02", "2000-05-12"))
SUSPENSION_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{s}', DATE '{a}', {f"DATE '{b}'" if b else 'CAST(NULL AS DATE)'})" for s, a, b in SUSPENSIONS) + ") AS x(symbol, begin_date, end_date)"


def suspensions(t) -> DataFrame:
    rows = t.spark.createDataFrame([tuple(x) for x in SUSPENSIONS], "symbol string, begin_date string, end_date string")
    return rows.select("symbol", F.to_date("begin_date").alias("begin_date"), F.to_date("end_date").alias("end_date"))
