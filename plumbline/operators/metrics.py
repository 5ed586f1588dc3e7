"""Trusted metrics: each is a DataFrame function, and has a second formula that it is checked against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def row_count(series: DataFrame, day: Column, least: int = 3000) -> DataFrame:
    return series.where(F.col("date") == day).agg(F.count("*").alias("value")).withColumn("ok", F.col("value") >= least)


def null_rate(series: DataFrame, column: str, day: Column, most: float = 0.02) -> DataFrame:
    out = series.where(F.col("date") == day).agg((F.count_if(F.col(column).isNull()) / F.nullif(F.count("*"), F.lit(0))).alias("value"))
    return out.withColumn("ok", F.col("value") <= most)


def distinct_entities(series: DataFrame, day: Column) -> DataFrame:
    return series.where(F.col("date") == day).agg(F.count_distinct("symbol").alias("value"))


def lag_days(series: DataFrame, asof: Column) -> DataFrame:
    return series.where(F.col("date") <= asof).agg(F.datediff(asof, F.max("date")).alias("value"))


def latest(series: DataFrame, column: str, asof: Column | None = None) -> DataFrame:
    """The value of the latest row of every entity."""
    rows = series if asof is None else series.where(F.col("date") <= asof)
    return rows.groupBy("symbol").agg(F.max_by(column, "date").alias("value"), F.max("date").alias("date"))


def pct_change(series: DataFrame, start: Column, end: Column) -> DataFrame:
    """First close on or after start to last close on or before end, in percent."""
    first = F.min_by("close", F.when(F.col("date") >= start, F.col("date")))
    last = F.max_by("close", F.when(F.col("date") <= end, F.col("date")))
    return series.groupBy("symbol").agg(first.alias("s"), last.alias("e")).select("symbol", F.round((F.col("e") / F.col("s") - 1) * 100, 4).alias("value"))


def midpoint_change(series: DataFrame, start: Column, end: Column) -> DataFrame:
    """The same as a product of two returns, split at the middle row of the range."""
    rows = series.where(F.col("date").between(start, end))
    w = W.partitionBy("symbol")
    placed = rows.withColumn("i", F.row_number().over(w.orderBy("date"))).withColumn("n", F.count("*").over(w))
    pick = lambda when: F.max(F.when(when, F.col("close")))
    out = placed.groupBy("symbol").agg(pick(F.col("i") == 1).alias("a"), pick(F.col("i") == F.floor(F.col("n") / 2) + 1).alias("m"), pick(F.col("i") == F.col("n")).alias("b"))
    return out.select("symbol", F.round((F.col("m") / F.col("a") * F.col("b") / F.col("m") - 1) * 100, 4).alias("value"))


def verify(main: DataFrame, second: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """verified, mismatch, or not_verifiable where either value is missing."""
    other = second.select(*keys, F.col("value").alias("second_value"))
    status = F.when(F.col("value").isNull() | F.col("second_value").isNull(), "not_verifiable").when(F.abs(F.col("value") - F.col("second_value")) <= tolerance, "verified").otherwise("mismatch")
    return main.join(other, keys, "full_outer").withColumn("status", status)


def bound(spark, sql: str, parameters: dict) -> DataFrame:
    """A metric written as SQL with named parameters; they are bound, never pasted in."""
    return spark.sql(sql, args=parameters)
