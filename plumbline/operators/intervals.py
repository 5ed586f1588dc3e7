"""Islands, merges and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Adds island: equal for rows whose numbers follow each other without a gap."""
    return rows.withColumn("island", F.col(number) - F.row_number().over(W.partitionBy(*keys).orderBy(number)))


def merge_hits(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Merges [lo, hi] that overlap or touch (lo <= an earlier hi + 1); keeps the value of the first."""
    w = W.partitionBy(*keys).orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1))
    begun = hits.withColumn("begins", (reach.isNull() | (F.col("lo") > reach + 1)).cast("int"))
    begun = begun.withColumn("part", F.sum("begins").over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = begun.groupBy(*keys, "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min_by("value", F.struct("lo", "hi")).alias("value"))
    return out.drop("part")


def run_lengths(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """keys, run, value, length, first and last position of runs of equal neighbours (null equals null)."""
    w = W.partitionBy(*keys).orderBy(*order)
    place = F.row_number().over(w)
    changed = rows.withColumn("place", place).withColumn("changes", F.when(F.col("place") == 1, 1).otherwise((~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("int")))
    runs = changed.withColumn("run", F.sum("changes").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run").agg(F.first(value).alias(value), F.count("*").alias("length"), F.min("place").alias("first_place"))


def overlapping(a: DataFrame, b: DataFrame, on: dict[str, str], a_span: tuple[str, str], b_span: tuple[str, str], width: int = 32) -> DataFrame:
    """Rows of a beside rows of b whose date spans share a day, each pair once; on: columns of a and of b that must be equal. Names of a and b must differ.

    Spans are dealt to buckets of `width` days, so that a key's rows meet only within a bucket; a pair counts in the
    first bucket that both have. A span that ends before it begins shares no day.
    """
    number = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / width).cast("int")

    def dealt(df: DataFrame, lo: str, hi: str, name: str) -> DataFrame:
        rows = df.where(F.col(lo) <= F.col(hi)).withColumn(f"{name}_from", number(F.col(lo)))
        return rows.withColumn(name, F.explode(F.sequence(f"{name}_from", number(F.col(hi)))))

    x, y = dealt(a, *a_span, "_bucket_a"), dealt(b, *b_span, "_bucket_b")
    equal = [F.col(i) == F.col(j) for i, j in on.items()]
    met = x.join(y, [*equal, F.col("_bucket_a") == F.col("_bucket_b")])
    once = F.col("_bucket_a") == F.greatest("_bucket_a_from", "_bucket_b_from")
    shares = (F.col(a_span[0]) <= F.col(b_span[1])) & (F.col(b_span[0]) <= F.col(a_span[1]))
    return met.where(once & shares).select(*a.columns, *b.columns)


def as_of(questions: DataFrame, facts: DataFrame, key: str, day: str, at: str, values: list[str], after: bool = False, width: int = 32) -> DataFrame:
    """For each question the values of the latest fact on or before its day (after: the first on or after it), without a many-to-many join.

    Both sides are put into one order per key and bucket of `width` days: facts before questions of the
    same day, and the last fact is carried on. What a bucket begins with is carried over a table that
    has one row for each key and bucket, so that no task orders all of a key.
    """
    fact = F.struct(at, *values)
    number = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01")) / width).cast("int")
    order = (lambda c: F.desc(c)) if after else (lambda c: F.asc(c))
    q = questions.withColumn("_q", F.lit(1)).withColumn("_day", F.col(day)).withColumn("_fact", F.lit(None).cast(facts.select(fact.alias("s")).schema["s"].dataType)).withColumn("_bucket", number(day))
    f = facts.select(F.col(key), F.lit(0).alias("_q"), F.col(at).alias("_day"), fact.alias("_fact"), number(at).alias("_bucket"))
    both = q.unionByName(f, allowMissingColumns=True)
    best = (F.min_by if after else F.max_by)("_fact", F.when(F.col("_q") == 0, F.col("_day")))
    edges = both.groupBy(key, "_bucket").agg(best.alias("_edge"))
    before = F.last("_edge", True).over(W.partitionBy(key).orderBy(order("_bucket")).rowsBetween(W.unboundedPreceding, -1))
    edges = edges.select(F.col(key).alias("_k"), F.col("_bucket").alias("_b"), before.alias("_before"))
    both = both.join(edges, F.col(key).eqNullSafe(F.col("_k")) & F.col("_bucket").eqNullSafe(F.col("_b")))
    carried = F.last("_fact", True).over(W.partitionBy(key, "_bucket").orderBy(order("_day"), "_q").rowsBetween(W.unboundedPreceding, 0))
    out = both.withColumn("_found", F.coalesce(carried, "_before")).where("_q = 1")
    return out.select(*questions.columns, *[F.col(f"_found.{c}").alias(f"found_{c}") for c in [at, *values]])


def running(rows: DataFrame, key: str, at: str, sums: dict[str, Column], width: int = 32) -> DataFrame:
    """Adds sums of an expression over a key's rows up to each day, by buckets of `width` days, so that no task orders all of a key."""
    b = rows.withColumn("_bucket", F.floor(F.datediff(F.col(at), F.lit("1970-01-01")) / width).cast("int"))
    inside = W.partitionBy(key, "_bucket").orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = b.groupBy(key, "_bucket").agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    totals = totals.select(F.col(key).alias("_k"), F.col("_bucket").alias("_b"), *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_t_{n}") for n in sums])
    out = b.join(totals, F.col(key).eqNullSafe(F.col("_k")) & F.col("_bucket").eqNullSafe(F.col("_b")))
    return out.select(*rows.columns, *[(F.sum(e).over(inside) + F.col(f"_t_{n}")).alias(n) for n, e in sums.items()])
