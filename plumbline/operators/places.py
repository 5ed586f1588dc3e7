"""Exact places in the order of a column, without a task that orders a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.shared import written

#: Distinct values that one task brings into order, about.
RANGE = 1_000_000


def ranked(rows: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, v, c, first, last, n: each distinct value with its count, its first and last place (from 0) and the rows of its key; null values don't count."""
    k = [F.col(c) for c in keys]
    return placed(rows.where(F.col(value).isNotNull()).groupBy(*k, F.col(value).alias("v")).agg(F.count("*").alias("c")), keys)


def placed(counts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The same from counted values (keys, v, c; each once).

    More than RANGE values are cut into ranges of about that many; places then follow from sums over ranges and from sums
    within a range, so no task orders a key that is larger.
    """
    counts = written(counts)
    ranges = counts.count() // RANGE + 1
    k = [F.col(c) for c in keys] or [F.lit(0)]
    whole = W.partitionBy(*k)
    if ranges == 1:
        last = F.sum("c").over(whole.orderBy("v")) - 1
        return counts.withColumn("last", last).withColumn("n", F.sum("c").over(whole)).select(*keys, "v", "c", (F.col("last") - F.col("c") + 1).alias("first"), "last", "n")
    dealt = written(counts.repartitionByRange(ranges, *keys, "v").withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "_range").agg(F.sum("c").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(whole.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    sums = sums.select(*[F.col(c).alias(f"_s{i}") for i, c in enumerate(keys)], F.col("_range").alias("_of"), before.alias("_before"), F.sum("_sum").over(whole).alias("n"))
    joined = dealt.join(sums, [F.col("_range") == F.col("_of"), *[F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(keys)]])
    upto = F.col("_before") + F.sum("c").over(W.partitionBy(*k, "_range").orderBy("v"))
    return joined.withColumn("last", upto - 1).select(*keys, "v", "c", (F.col("last") - F.col("c") + 1).alias("first"), "last", "n")


def value_at(place: Column) -> Column:
    """An aggregate over rows of `ranked`: the value at a place."""
    return F.max(F.when(place.between(F.col("first"), F.col("last")), F.col("v")))


def quantile(share: float) -> Column:
    """An aggregate over rows of `ranked`: the quantile, linear between neighbours."""
    at = share * (F.first("n") - 1)
    low = share * (F.col("n") - 1)
    a, b = value_at(F.floor(low)), value_at(F.ceil(low))
    return a + (b - a) * (at - F.floor(at))
