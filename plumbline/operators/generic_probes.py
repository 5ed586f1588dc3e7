"""Probes of any declared table. The declaration is driver-side configuration that makes expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.places import placed, quantile, ranked
from plumbline.shared import written


@dataclass(frozen=True)
class Declared:
    name: str
    kind: str = "text"  # numeric, datetime, categorical, text
    nullable: bool = True
    tolerance: float = 0.05


@dataclass(frozen=True)
class Spec:
    table: str
    columns: tuple[Declared, ...]
    key: tuple[str, ...] = ()
    time: str | None = None
    group: str | None = None
    fresh_days: int = 7
    outliers: float = 0.05
    declared: bool = True


SHAPE = "probe string, column string, metric string, value double, threshold double, severity string"


def _rows(stats: DataFrame, found: list[tuple[str, str, str, Column, Column, Column, Column]]) -> DataFrame:
    """One row of stats becomes the findings (probe, column, metric, value, threshold, severity) whose condition holds."""
    items = [F.struct(F.lit(p).alias("probe"), F.lit(c).alias("column"), F.lit(m).alias("metric"), v.cast("double").alias("value"), t.cast("double").alias("threshold"), s.alias("severity"), F.coalesce(when, F.lit(False)).alias("hit")) for p, c, m, v, t, s, when in found]
    if not items:
        return stats.sparkSession.createDataFrame([], SHAPE)
    return stats.select(F.explode(F.array(*items)).alias("x")).where("x.hit").select("x.probe", "x.column", "x.metric", "x.value", "x.threshold", "x.severity")


def _columns(rows: DataFrame, spec: Spec) -> DataFrame:
    """Missing and extra columns."""
    names, have = [c.name for c in spec.columns], set(rows.columns)
    fixed = [("schema", n, "column_missing", 1.0, 1.0, "P1") for n in sorted(set(names) - have)] + [("schema", n, "column_extra", 1.0, 1.0, "P2") for n in sorted(have - set(names))]
    return rows.sparkSession.createDataFrame(fixed if spec.declared else [], SHAPE)


# What one pass over the rows can tell: aggregates, and the findings that follow from them.


def _kinds(rows: DataFrame, spec: Spec) -> tuple[list, list]:
    typed = [c for c in spec.columns if spec.declared and c.name in rows.columns and c.kind in ("numeric", "datetime")]
    parsed = {"numeric": lambda c: F.expr(f"try_cast(`{c}` as double)"), "datetime": lambda c: F.expr(f"try_cast(`{c}` as timestamp)")}
    rates = [F.avg(F.when(F.col(c.name).isNotNull(), parsed[c.kind](c.name).isNull().cast("double"))).alias(f"kind_{i}") for i, c in enumerate(typed)]
    return rates, [("schema", c.name, f"type_mismatch::{c.name}", F.col(f"kind_{i}"), F.lit(0.01), F.lit("P1"), F.col(f"kind_{i}") > 0.01) for i, c in enumerate(typed)]


def _null_rates(rows: DataFrame, spec: Spec) -> tuple[list, list]:
    have, found = [c for c in spec.columns if c.name in rows.columns], []
    for i, c in enumerate(have):
        rate, strict = F.col(f"null_{i}"), not c.nullable
        found.append(("completeness", c.name, f"null_rate::{c.name}", rate, F.lit(0.0 if strict else c.tolerance), F.lit("P1" if strict else "P2"), rate > (0 if strict else c.tolerance)))
    return [F.avg(F.col(c.name).isNull().cast("double")).alias(f"null_{i}") for i, c in enumerate(have)], found


def _age(rows: DataFrame, spec: Spec, asof: Column) -> tuple[list, list]:
    if not spec.time or spec.time not in rows.columns:
        return [], []
    stale = F.floor((F.unix_timestamp(asof.cast("timestamp")) - F.unix_timestamp("latest")) / 86400)
    return [F.max(F.expr(f"try_cast(`{spec.time}` as timestamp)")).alias("latest")], [
        ("freshness", "*", "stale_days", stale, F.lit(spec.fresh_days), F.lit("P1"), stale > spec.fresh_days),
        ("freshness", "*", "future_timestamps", -stale, F.lit(0), F.lit("P2"), stale < 0),
    ]


def _told(rows: DataFrame, *parts: tuple[list, list]) -> DataFrame:
    aggregates, found = [x for p in parts for x in p[0]], [x for p in parts for x in p[1]]
    return _rows(rows.agg(*aggregates), found) if aggregates else rows.sparkSession.createDataFrame([], SHAPE)


def conformance(rows: DataFrame, spec: Spec) -> DataFrame:
    """Missing and extra columns, and declared kinds that more than 1 percent of the values don't parse as."""
    return _columns(rows, spec).union(_told(rows, _kinds(rows, spec)))


def nulls(rows: DataFrame, spec: Spec) -> DataFrame:
    """Null rates, all columns in one pass."""
    return _told(rows, _null_rates(rows, spec))


def freshness(rows: DataFrame, spec: Spec, asof: Column) -> DataFrame:
    """Days since the latest time, and times in the future."""
    return _told(rows, _age(rows, spec, asof))


def key_uniqueness(rows: DataFrame, spec: Spec) -> DataFrame:
    """Surplus rows over distinct keys; null is a value."""
    if not spec.key or not set(spec.key) <= set(rows.columns):
        return rows.sparkSession.createDataFrame([], SHAPE)
    stats = rows.groupBy(*spec.key).agg(F.count("*").alias("n")).where("n > 1").agg(F.sum(F.col("n") - 1).alias("surplus"))
    return _rows(stats, [("uniqueness", "*", "duplicate_keys", F.col("surplus"), F.lit(0), F.lit("P0"), F.col("surplus") > 0)])


def _names(rows: DataFrame, spec: Spec) -> list[str]:
    return [c.name for c in spec.columns if c.kind == "numeric" and c.name in rows.columns]


def _wide(rows: DataFrame, spec: Spec) -> DataFrame:
    """grp, ts and the declared numbers n0, n1, ... of each row with a group; what isn't a number is null."""
    group = F.col(spec.group).cast("string") if spec.group and spec.group in rows.columns else F.lit("")
    ts = F.expr(f"try_cast(`{spec.time}` as timestamp)") if spec.time and spec.time in rows.columns else F.lit(None).cast("timestamp")
    number = lambda n: F.nullif(F.expr(f"try_cast(`{n}` as double)"), F.lit(float("nan")))
    return rows.select(group.alias("grp"), ts.alias("ts"), *[number(n).alias(f"n{i}") for i, n in enumerate(_names(rows, spec))]).where("grp is not null")


def _long(wide: DataFrame, names: list[str], *more: str) -> DataFrame:
    """grp, name, value of each number, and more columns of its row."""
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"n{i}").alias("value")) for i, n in enumerate(names)]))
    return wide.select("grp", *more, values.alias("x")).select("grp", *more, "x.name", "x.value").where("value is not null")


def _numeric(rows: DataFrame, spec: Spec) -> DataFrame:
    return _long(_wide(rows, spec), _names(rows, spec))


def _octave(value: Column) -> Column:
    """A whole number that never falls as the value rises: 256 for each doubling of its size."""
    size = F.floor(F.least(F.log2(F.abs(value)), F.lit(1025.0)) * 256) + 300_000
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size).cast("long")


def outliers(rows: DataFrame, spec: Spec, fence: float = 1.5, least: int = 20) -> DataFrame:
    """Share outside Tukey's fences in the worst group; exact, linear quartiles.

    Rows are counted by octaves of their values first; only the values of the octaves that hold a quartile's neighbours are
    counted and brought into order, so single values are shuffled for few rows. The share outside is summed where the rows are.
    """
    keys = ("grp", "name")
    x = _numeric(rows, spec).withColumn("octave", _octave(F.col("value")))
    octaves = placed(x.groupBy(*keys, F.col("octave").alias("v")).agg(F.count("*").alias("c")), keys).where(F.col("n") >= least)
    places = [of(share * (F.col("n") - 1)) for share in (0.25, 0.75) for of in (F.floor, F.ceil)]
    held = reduce(Column.__or__, [p.between(F.col("first"), F.col("last")) for p in places])
    wanted = written(octaves.where(held).select(*keys, F.col("v").alias("octave"), F.col("first").alias("below"), F.col("n").alias("whole")))
    within = placed(x.join(wanted.select(*keys, "octave"), [*keys, "octave"]).groupBy(*keys, "octave", F.col("value").alias("v")).agg(F.count("*").alias("c")), (*keys, "octave"))
    counts = within.join(wanted, [*keys, "octave"]).select(*keys, "v", (F.col("first") + F.col("below")).alias("first"), (F.col("last") + F.col("below")).alias("last"), F.col("whole").alias("n"))
    q = written(counts.groupBy(*keys).agg(quantile(0.25).alias("q1"), quantile(0.75).alias("q3")))
    width = F.col("q3") - F.col("q1")
    outside = ((F.col("value") < F.col("q1") - fence * width) | (F.col("value") > F.col("q3") + fence * width)) & (width > 0)
    worst = x.join(q, list(keys)).groupBy(*keys).agg((F.count_if(outside) / F.count("*")).alias("rate")).groupBy("name").agg(F.max("rate").alias("rate"))
    hit = worst.where(F.col("rate") > spec.outliers)
    return hit.select(F.lit("outlier").alias("probe"), F.col("name").alias("column"), F.concat(F.lit("outlier_rate::"), F.col("name")).alias("metric"), F.col("rate").alias("value"), F.lit(spec.outliers).alias("threshold"), F.lit("P2").alias("severity"))


def level_shift(rows: DataFrame, spec: Spec, up: float = 3.0, recent: float = 0.2, history: int = 20) -> DataFrame:
    """Mean of the latest fifth over the mean of the rows before, in the worst group.

    Rows are summed by time once, all columns in one row; the edge and what lies before and behind it come from these sums, and
    only the rows of the edge's own time are looked at again: the old ones among them are those with the smallest values.
    """
    names = _names(rows, spec)
    if not spec.time or spec.time not in rows.columns or not names:
        return rows.sparkSession.createDataFrame([], SHAPE)
    keys = ("grp", "name")
    wide = _wide(rows, spec).where("ts is not null").withColumn("t", F.unix_micros("ts"))
    sums = wide.groupBy("grp", "t").agg(*[x for i in range(len(names)) for x in (F.count(f"n{i}").alias(f"c{i}"), F.sum(f"n{i}").alias(f"s{i}"))])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"c{i}").alias("c"), F.col(f"s{i}").alias("s")) for i, n in enumerate(names)]))
    times = written(sums.select("grp", "t", each.alias("x")).select("grp", "x.name", "t", "x.c", "x.s").where("c > 0"))
    cut = F.floor(F.col("n") * (1 - recent))
    edge = placed(times.select(*keys, F.col("t").alias("v"), "c"), keys).where(F.col("n") >= history + 5).where((cut > F.col("first")) & (cut <= F.col("last") + 1))
    edge = written(edge.select(*keys, F.col("v").alias("edge"), "n", cut.alias("cut"), (cut - F.col("first")).alias("old_here")))
    apart = times.join(edge, list(keys)).groupBy(*keys).agg(F.first("n").alias("rows"), F.first("cut").alias("cut"), F.sum(F.when(F.col("t") < F.col("edge"), F.col("s")).otherwise(0.0)).alias("before"), F.sum(F.when(F.col("t") > F.col("edge"), F.col("s")).otherwise(0.0)).alias("after"))
    there = _long(wide.join(edge.select("grp", F.col("edge").alias("t")).distinct(), ["grp", "t"], "left_semi"), names, "t")
    there = there.join(edge.select(*keys, F.col("edge").alias("t")), [*keys, "t"])
    here = ranked(there, "value", keys).join(edge.select(*keys, "old_here"), list(keys))
    olds = F.greatest(F.lit(0), F.least(F.col("c"), F.col("old_here") - F.col("first")))
    here = here.groupBy(*keys).agg(F.sum(F.col("v") * olds).alias("old_edge"), F.sum(F.col("v") * (F.col("c") - olds)).alias("new_edge"))
    means = apart.join(here, list(keys)).select(*keys, "cut", ((F.col("after") + F.col("new_edge")) / F.nullif(F.col("rows") - F.col("cut"), F.lit(0))).alias("new"), ((F.col("before") + F.col("old_edge")) / F.nullif(F.col("cut"), F.lit(0))).alias("old"))
    ratio = means.where((F.col("cut") >= history) & (F.col("old") > 0)).withColumn("ratio", F.col("new") / F.col("old")).where((F.col("ratio") >= up) | (F.col("ratio") <= 1 / up))
    away = F.greatest("ratio", F.when(F.col("ratio") != 0, 1 / F.col("ratio")).otherwise(F.lit(float("inf"))))
    worst = ratio.groupBy("name").agg(F.max_by("ratio", away).alias("ratio"))
    return worst.select(F.lit("outlier").alias("probe"), F.col("name").alias("column"), F.concat(F.lit("level_shift::"), F.col("name")).alias("metric"), F.bround("ratio", 4).alias("value"), F.lit(up).alias("threshold"), F.lit("P1").alias("severity"))


def skipped(spark, spec: Spec) -> DataFrame:
    """Checks that couldn't run, and why."""
    out = []
    if not spec.declared:
        out.append(("schema", "no declared schema"))
    if not spec.key:
        out.append(("uniqueness", "no declared key"))
    if not spec.time:
        out += [("freshness", "no time column"), ("level_shift", "no time column")]
    return spark.createDataFrame(out, "probe string, reason string")


def run(rows: DataFrame, spec: Spec, asof: Column) -> DataFrame:
    """All generic findings; kinds, nulls and freshness by one pass. Rows are read several times: a caller writes what is costly to make."""
    parts = [_columns(rows, spec), _told(rows, _kinds(rows, spec), _null_rates(rows, spec), _age(rows, spec, asof)), key_uniqueness(rows, spec), *([outliers(rows, spec), level_shift(rows, spec)] if _names(rows, spec) else [])]
    return reduce(DataFrame.unionByName, parts)


def infer(rows: DataFrame, sample: int = 50) -> DataFrame:
    """column, kind: from the type, for strings from a sample of non-null values (a heuristic of a fixed, stated size)."""
    fixed, strings = [], []
    for name, kind in rows.dtypes:
        if kind in ("double", "float", "int", "bigint", "smallint", "tinyint") or kind.startswith("decimal"):
            fixed.append((name, "numeric"))
        elif kind in ("timestamp", "timestamp_ntz", "date"):
            fixed.append((name, "datetime"))
        elif kind == "string":
            strings.append(name)
        else:
            fixed.append((name, "text"))
    out = rows.sparkSession.createDataFrame(fixed, "column string, kind string")
    if not strings:
        return out
    parses = {"num": lambda v: F.expr(f"try_cast({v} as double)").isNotNull(), "day": lambda v: F.expr(f"try_cast({v} as timestamp)").isNotNull() & F.expr(f"length({v}) >= 8")}
    whole = rows.agg(*[x for i, c in enumerate(strings) for x in (F.count_distinct(c).alias(f"kinds_{i}"), F.count(c).alias(f"all_{i}"))])
    heads = reduce(DataFrame.unionByName, [rows.where(F.col(c).isNotNull()).select(F.lit(i).alias("i"), F.col(c).alias("v")).limit(sample) for i, c in enumerate(strings)])
    told = heads.groupBy("i").agg(F.count("*").alias("n"), *[F.avg(of("v").cast("double")).alias(name) for name, of in parses.items()])
    totals = whole.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), F.col(f"kinds_{i}").alias("kinds"), F.col(f"all_{i}").alias("all")) for i, c in enumerate(strings)])).alias("x")).select("x.*")
    kind = F.when(F.coalesce("n", F.lit(0)) == 0, "text").when(F.col("num") >= 0.9, "numeric").when(F.col("day") >= 0.9, "datetime").when(F.col("kinds") <= F.greatest(F.lit(20), F.col("all") / 10), "categorical").otherwise("text")
    return out.union(totals.join(told, "i", "left").select("column", kind.alias("kind")))
