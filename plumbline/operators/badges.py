"""From diagnosed findings to statements about columns, to alerts and to scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators.intervals import overlapping

# Weights of levels and penalties of severities.
WEIGHT = {"verified": 1.0, "baseline": 1.0, "caution": 0.5, "unusable": 0.0}
PENALTY = {"P0": 3, "P1": 2, "P2": 1}


def _map(column: Column, values: dict, other) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def finding_columns(findings: DataFrame, columns: DataFrame, named: DataFrame) -> DataFrame:
    """A row for each finding and column it touches: named (metric, column), else every column of its table (columns: table_name, column)."""
    m = F.broadcast(named.select(F.col("metric").alias("m_metric"), F.col("column").alias("m_column")))
    by_name = findings.join(m, F.split("metric", "::")[0] == F.col("m_metric"), "left")
    explicit = F.when(F.col("metric").contains("::"), F.element_at(F.split("metric", "::"), 2)).otherwise(F.col("m_column"))
    known = by_name.withColumn("named", explicit).drop("m_metric", "m_column")
    return known.where("named is not null").withColumn("column", F.col("named")).drop("named").unionByName(known.where("named is null").drop("named").join(F.broadcast(columns), "table_name"))


def board(touched: DataFrame, columns: DataFrame, most: int = 6) -> DataFrame:
    """table_name, column, level, findings and evidence of every observed column. touched has severity and suppressed."""
    active = ~F.col("suppressed")
    g = touched.groupBy("table_name", "column").agg(
        F.bool_or(active & (F.col("severity") == "P0")).alias("p0"), F.bool_or(active).alias("active"), F.bool_or("suppressed").alias("cleared"), F.count("*").alias("findings"),
        F.slice(F.array_sort(F.collect_set(F.concat_ws(":", "metric", "root_cause"))), 1, most).alias("evidence"),
    )
    out = columns.join(g, ["table_name", "column"], "left")
    level = F.when(F.col("p0"), "unusable").when(F.col("active"), "caution").when(F.col("cleared"), "verified").otherwise("baseline")
    return out.select("table_name", "column", level.alias("level"), F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("evidence", F.expr("array()").cast("array<string>")).alias("evidence"))


def health(badges: DataFrame) -> DataFrame:
    return badges.agg(F.coalesce(F.bround(100 * F.avg(_map(F.col("level"), WEIGHT, 0.0)), 1), F.lit(100.0)).alias("health"), F.count("*").alias("badges"))


def summary(diagnoses: DataFrame) -> DataFrame:
    """Counts of all findings, alerts and suppressed ones, by severity and by cause, as (part, name, n)."""
    alert = ~F.col("suppressed")
    total = diagnoses.agg(F.count("*").alias("findings"), F.count_if(alert).alias("alerts"), F.count_if("suppressed").alias("suppressed"))
    flat = total.select(F.explode(F.array(*[F.struct(F.lit("total").alias("part"), F.lit(c).alias("name"), F.col(c).alias("n")) for c in total.columns])).alias("x")).select("x.*")
    by = diagnoses.where(alert).groupingSets([["severity"], ["root_cause"]], "severity", "root_cause").agg(F.count("*").alias("n"), F.grouping("severity").alias("g"))
    return flat.union(by.select(F.when(F.col("g") == 0, "severity").otherwise("root_cause"), F.when(F.col("g") == 0, F.col("severity")).otherwise(F.col("root_cause")), "n"))


def merge_alerts(alerts: DataFrame) -> DataFrame:
    """One alert for each table, symbol and cause: the head has the largest penalty, other windows are counted and listed."""
    w = W.partitionBy("table_name", "symbol", "root_cause").orderBy(F.desc("penalty"), "start", "end", "metric")
    rows = alerts.withColumn("penalty", _map(F.col("severity"), PENALTY, 0)).withColumn("r", F.row_number().over(w))
    head = F.max_by(F.struct("metric", "start", "end", "severity", "penalty"), -F.col("r"))
    out = rows.groupBy("table_name", "symbol", "root_cause").agg(head.alias("h"), F.count("*").alias("merged"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("r") > 1, F.concat_ws("..", F.col("start").cast("string"), F.col("end").cast("string"))))), ",").alias("others"))
    return out.select("table_name", "symbol", "root_cause", "h.*", "merged", "others")


def compare_boards(domain: DataFrame, generic: DataFrame) -> DataFrame:
    a = domain.select("table_name", "column", F.col("level").alias("domain_level"))
    return a.join(generic.select("table_name", "column", F.col("level").alias("generic_level")), ["table_name", "column"], "full_outer")


def matches(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """Findings that overlap a label of the same symbol and table (labels of table 'event' match any)."""
    l = labels.select("label_id", F.col("symbol").alias("l_symbol"), F.col("table_name").alias("l_table"), F.col("start").alias("l_start"), F.col("end").alias("l_end"), "expected_cause", "expected_severity", "fault")
    met = overlapping(findings, l, {"symbol": "l_symbol"}, ("start", "end"), ("l_start", "l_end"))
    return met.where((F.col("l_table") == "event") | (F.col("table_name") == F.col("l_table")))


def detection(diagnoses: DataFrame, labels: DataFrame) -> DataFrame:
    """Recall of faults, accuracy of causes and severities, suppression of benign events, precision of alerts."""
    m = matches(diagnoses, labels)
    by = m.groupBy("label_id").agg(F.bool_or(~F.col("suppressed")).alias("seen"), F.bool_or(F.col("root_cause") == F.col("expected_cause")).alias("cause_ok"), F.bool_or((F.col("root_cause") == F.col("expected_cause")) & (F.col("severity") == F.col("expected_severity"))).alias("severity_ok"), F.bool_and("suppressed").alias("all_quiet"))
    l = labels.select("label_id", "fault").join(by, "label_id", "left")
    rate = lambda c, when: F.avg(F.when(when, F.coalesce(c, F.lit(False)).cast("double")))
    sums = l.agg(rate(F.col("seen"), F.col("fault")).alias("fault_recall"), rate(F.col("cause_ok"), F.col("fault")).alias("cause_accuracy"), rate(F.col("severity_ok"), F.col("fault")).alias("severity_accuracy"), rate(F.coalesce("all_quiet", F.lit(True)), ~F.col("fault")).alias("benign_suppression"))
    keys = ["table_name", "symbol", "metric", "start", "end"]
    true = m.where("fault").select(*keys).distinct().withColumn("hit", F.lit(True))
    p = diagnoses.join(true, keys, "left").agg(F.avg(F.when(~F.col("suppressed"), F.coalesce("hit", F.lit(False)).cast("double"))).alias("alert_precision"), F.avg(F.coalesce("hit", F.lit(False)).cast("double")).alias("naive_precision"))
    return sums.crossJoin(p)  # one row each


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa; null without rows or when chance agreement is 1."""
    c = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    n = c.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a").eqNullSafe(F.col("b")), F.col("n")).otherwise(0)).alias("same"))
    left, right = c.groupBy("a").agg(F.sum("n").alias("na")), c.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = left.join(right, F.col("a").eqNullSafe(F.col("b"))).agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("chance"))
    po, pe = F.col("same") / F.col("total"), F.coalesce("chance", F.lit(0.0)) / (F.col("total") * F.col("total"))
    return n.crossJoin(chance).select(F.when((F.col("total") > 0) & (pe != 1), (po - pe) / (1 - pe)).alias("kappa"), F.col("total").alias("n"))


def replay(expected: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Each expected (probe, symbol, start, end) beside what was found."""
    d = diagnoses.select("probe", "symbol", "start", "end", F.col("root_cause").alias("got_cause"), F.col("suppressed").alias("got_suppressed"))
    out = expected.join(d, ["probe", "symbol", "start", "end"], "left")
    return out.withColumn("ok", F.coalesce((F.col("got_cause") == F.col("want_cause")) & (F.col("got_suppressed") == F.col("want_suppressed")), F.lit(False)))


def market_facts(series: DataFrame, top: int = 3) -> DataFrame:
    """fact, rank, symbol, value, close: the best of the latest day by change (with their close) and by amount, how many entities it has (symbols), and how many days there are (days)."""
    day = series.agg(F.max("date").alias("date"))
    last = series.join(F.broadcast(day), "date")  # one row

    def best(column: str, close: Column) -> DataFrame:
        rows = last.where(F.col(column).isNotNull()).orderBy(F.desc(column), "symbol").limit(top)
        return rows.select(F.lit(column).alias("fact"), F.row_number().over(W.orderBy(F.desc(column), "symbol")).alias("rank"), "symbol", F.col(column).cast("double").alias("value"), close.cast("double").alias("close"))

    one = lambda df, name, n: df.agg(n.cast("double").alias("value")).select(F.lit(name).alias("fact"), F.lit(1).alias("rank"), F.lit(None).cast("string").alias("symbol"), "value", F.lit(None).cast("double").alias("close"))
    return best("pct_chg", F.col("close")).unionByName(best("amount", F.lit(None))).unionByName(one(last, "symbols", F.count_distinct("symbol"))).unionByName(one(series, "days", F.count_distinct("date")))


def reviewed(drafts: DataFrame, badges: DataFrame) -> DataFrame:
    """Numbers of a draft line pass with a valid citation [badge:table.column] and are masked otherwise; dates and bare integers pass."""
    cited = F.regexp_extract("line", r"\[badge:([A-Za-z_]+\.[A-Za-z_]+)\]", 1)
    b = F.broadcast(badges.select(F.concat_ws(".", "table_name", "column").alias("b_name"), F.col("level").alias("b_level")))
    rows = drafts.withColumn("cites", cited).join(b, F.col("cites") == F.col("b_name"), "left")
    number = r"(?<![\d\-.])\d+\.\d+%?(?![\d\-])|(?<![\d\-.])\d+%"
    fine = F.col("b_level").isin("verified", "baseline", "caution")
    n = F.regexp_count("line", F.lit(number))
    state = F.when(n == 0, "no_number").when(F.col("cites") == "", "missing_citation").when(F.coalesce(fine, F.lit(False)), "passed").otherwise("invalid_citation")
    masked = F.when(state.isin("missing_citation", "invalid_citation"), F.regexp_replace("line", number, "***")).otherwise(F.col("line"))
    return rows.select(*drafts.columns, state.alias("state"), masked.alias("reviewed"))
