"""Attribution: findings joined to calendar, events, loads and the cross-section; the first rule that holds wins.

Findings carry their key columns (probe, table_name, symbol, metric, start, end). Two metrics on one window
are two findings: the metric is part of the key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators import trading_calendar as cal
from plumbline.operators.intervals import as_of, overlapping
from plumbline.shared import written

KEY = ["probe", "table_name", "symbol", "metric", "start", "end"]
# Causes that clear a finding.
BENIGN = ("benign_suspension", "benign_non_trading_day", "benign_new_listing", "benign_corporate_action", "benign_market_event")


def failed_loads(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """key, run_id of the first failed load of the table that names the symbol or no symbol (also by broken parameters).

    Only the first load of each table and symbol counts, so a finding meets two rows at most.
    """
    failed = runs.where("status = 'failed'").select("run_id", "started_at", F.col("target_table").alias("table_name"), F.get_json_object("params", "$.symbol").alias("symbol"))
    first = failed.groupBy("table_name", "symbol").agg(F.min(F.struct("started_at", "run_id")).alias("first"))
    own = first.where("symbol is not null").withColumnRenamed("first", "own")
    every = first.where("symbol is null").select("table_name", F.col("first").alias("every"))
    hit = findings.select(*KEY).distinct().join(own, ["table_name", "symbol"], "left").join(every, "table_name", "left")
    return hit.select(*KEY, F.least("own", "every")["run_id"].alias("run_id")).where("run_id is not null")


def has_event(findings: DataFrame, events: DataFrame, kind: str) -> DataFrame:
    """Keys of findings with an event of the kind in their window."""
    e = events.where(F.col("kind") == kind).select(F.col("symbol").alias("e_symbol"), F.col("date").alias("e_date")).distinct()
    return overlapping(findings.select(*KEY), e, {"symbol": "e_symbol"}, ("start", "end"), ("e_date", "e_date")).select(*KEY).distinct()


def gaps(findings: DataFrame, calendar: DataFrame, halted: DataFrame, runs: DataFrame) -> DataFrame:
    """Freshness and completeness findings: suspension, no trading day, failed load, stale, missing rows."""
    covered = cal.coverage(findings.select(*KEY, "value", "severity"), calendar, halted, KEY)
    rows = covered.join(failed_loads(findings, runs), KEY, "left")
    cause = (
        F.when(F.col("coverage") >= 0.9, "benign_suspension").when(F.col("window_days") == 0, "benign_non_trading_day").when(F.col("run_id").isNotNull(), "upstream_outage")
        .when(F.col("probe") == "freshness", "upstream_stale").otherwise("missing_rows")
    )
    return _diagnosed(rows.withColumn("root_cause", cause), {"upstream_outage": F.lit("P0"), "upstream_stale": F.when(F.col("value") >= 2, "P0").otherwise("P1"), "missing_rows": F.col("severity")}, {"benign_suspension": 0.95, "benign_non_trading_day": 0.95, "upstream_outage": 0.9, "upstream_stale": 0.8, "missing_rows": 0.75})


def depth(findings: DataFrame, calendar: DataFrame, listed: DataFrame, asof: Column, least: int = 30) -> DataFrame:
    rows = findings.select(*KEY, "value", "severity").join(listed.select("symbol", "list_date"), "symbol", "left")
    rows = cal.trading_days_between(rows.withColumn("asof", asof), calendar, "list_date", "asof", "expected")
    fresh = F.col("list_date").isNotNull() & (F.col("expected") > 0) & (F.col("value") / F.col("expected") >= 0.9) & (F.col("expected") <= least)
    return _diagnosed(rows.withColumn("root_cause", F.when(fresh, "benign_new_listing").otherwise("missing_rows")), {"missing_rows": F.lit("P1")}, {"benign_new_listing": 0.9, "missing_rows": 0.6})


def validity(findings: DataFrame, events: DataFrame) -> DataFrame:
    hit = has_event(findings.where("metric = 'pct_chg_out_of_limit'"), events, "ex_rights").withColumn("event", F.lit(True))
    rows = findings.select(*KEY, "value", "severity").join(hit, KEY, "left")
    return _diagnosed(rows.withColumn("root_cause", F.when(F.col("event"), "benign_corporate_action").otherwise("value_out_of_range")), {"value_out_of_range": F.lit("P0")}, {"benign_corporate_action": 0.9, "value_out_of_range": 0.85})


def constant(findings: DataFrame) -> DataFrame:
    """Duplicates and null sweeps have one cause each."""
    rows = findings.where("probe in ('uniqueness', 'null_sweep')").select(*KEY, "value", "severity").withColumn("root_cause", F.when(F.col("probe") == "uniqueness", "duplicate_write").otherwise("schema_null_sweep"))
    return _diagnosed(rows, {"duplicate_write": F.lit("P0"), "schema_null_sweep": F.lit("P1")}, {"duplicate_write": 0.95, "schema_null_sweep": 0.85})


def drift(findings: DataFrame, moved: DataFrame) -> DataFrame:
    """moved: what co_movement returns."""
    rows = findings.select(*KEY, "value", "severity").join(moved.select(*KEY, "market_hit", "sector_hit"), KEY, "left")
    cause = F.when(F.col("metric").endswith("_level_shift"), "unit_shift").when(F.col("market_hit"), "market").when(F.col("sector_hit"), "sector").otherwise("distribution_drift")
    rows = rows.withColumn("why", cause).withColumn("root_cause", F.when(F.col("why").isin("market", "sector"), "benign_market_event").otherwise(F.col("why")))
    out = _diagnosed(rows, {"unit_shift": F.lit("P0"), "distribution_drift": F.lit("P1")}, {"unit_shift": 0.9, "benign_market_event": 0.9, "distribution_drift": 0.8}, keep=["why"])
    return out.withColumn("confidence", F.when(F.col("why") == "sector", 0.85).otherwise(F.col("confidence"))).drop("why")


def _diagnosed(rows: DataFrame, severity: dict[str, Column], confidence: dict[str, float], keep: list[str] | None = None) -> DataFrame:
    level, sure = F.lit("OK"), F.lit(None).cast("double")
    for name, value in severity.items():
        level = F.when(F.col("root_cause") == name, value).otherwise(level)
    for name, value in confidence.items():
        sure = F.when(F.col("root_cause") == name, F.lit(value)).otherwise(sure)
    return rows.select(*KEY, "value", "root_cause", level.alias("severity"), sure.alias("confidence"), F.col("root_cause").isin(*BENIGN).alias("suppressed"), *(keep or []))


def window_ratios(findings: DataFrame, series: DataFrame, value: str = "volume") -> DataFrame:
    """Of each finding with rows of its entity in its window: mean in the window over the mean of the 30 rows before.

    Running sums over an entity's rows (one a day) make any mean a difference of two of them. A window
    meets its entity's first row on or after its start and last on or before its end, found by ordered
    passes, once for all findings of the window.
    """
    w = W.partitionBy("entity").orderBy("date")
    s = series.select(F.col("symbol").alias("entity"), "date", F.col(value).cast("double").alias("v"))
    s = s.withColumn("place", F.row_number().over(w)).withColumn("sum", F.sum(F.coalesce("v", F.lit(0.0))).over(w)).withColumn("n", F.count("v").over(w))
    back = lambda c, k: F.coalesce(F.lag(c, k).over(w), F.lit(0))
    past = (back("sum", 1) - back("sum", PAST + 1)) / F.nullif(back("n", 1) - back("n", PAST + 1), F.lit(0))
    s = s.withColumn("past", F.when(F.col("place") > PAST, past)).withColumn("sum0", back("sum", 1).cast("double")).withColumn("n0", back("n", 1))
    s = written(s.select("entity", "date", "past", "sum0", "n0", "sum", "n"))
    f = findings.select(*KEY).distinct()
    windows = f.select(F.col("symbol").alias("entity"), "start", "end").distinct()
    low = as_of(windows, s, "entity", "start", "date", ["past", "sum0", "n0"], after=True)
    low = low.select("entity", "start", "end", *[F.col(f"found_{c}").alias(f"a_{c}") for c in ("date", "past", "sum0", "n0")])
    edges = as_of(low, s, "entity", "end", "date", ["sum", "n"]).where("a_date <= end and found_date >= start")
    mean = (F.col("found_sum") - F.col("a_sum0")) / F.nullif(F.col("found_n") - F.col("a_n0"), F.lit(0))
    edges = edges.select(F.col("entity").alias("symbol"), "start", "end", mean.alias("window_mean"), F.col("a_past").alias("past_mean"), F.when(F.col("a_past") > 0, mean / F.col("a_past")).alias("ratio"))
    return f.join(edges, ["symbol", "start", "end"]).select(*KEY, "window_mean", "past_mean", "ratio")


#: Rows before a window that make its past; windows that go to every task at once; rows of entities in a task, about.
PAST, SENT, TASK_ROWS = 30, 100_000, 500_000
THRESHOLDS = (1.5, 2.0, 3.0, 5.0)


def _counted(shared):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Of the task's entities, by window and sector: how many have a ratio, how many reach each threshold, and the largest."""
        begin, end = shared.value
        sums: dict[str, np.ndarray] = {}
        top: dict[str, np.ndarray] = {}
        for (sector, _), own in rows.sort_values(["entity", "day"]).groupby(["sector", "entity"], sort=True):
            day, v = own["day"].to_numpy(), own["v"].to_numpy(float)
            total, n = np.append(0, np.cumsum(np.nan_to_num(v))), np.append(0, np.cumsum(~np.isnan(v)))
            i, j = np.searchsorted(day, begin, "left"), np.searchsorted(day, end, "right")
            at = np.flatnonzero((i < j) & (i >= PAST))
            i, j = i[at], j[at]
            with np.errstate(divide="ignore", invalid="ignore"):
                mean, past = (total[j] - total[i]) / (n[j] - n[i]), (total[i] - total[i - PAST]) / (n[i] - n[i - PAST])
                ratio = np.where(past > 0, mean / past, np.nan)
            some = ~np.isnan(ratio)
            at, ratio = at[some], ratio[some]
            counts = sums.setdefault(sector, np.zeros((len(begin), 1 + len(THRESHOLDS)), np.int64))
            counts[at, 0] += 1
            for k, least in enumerate(THRESHOLDS):
                counts[at, k + 1] += (ratio > least) if least == THRESHOLDS[0] else (ratio >= least)
            best = top.setdefault(sector, np.full(len(begin), -np.inf))
            best[at] = np.maximum(best[at], ratio)
        out = []
        for sector, counts in sums.items():
            for k in np.flatnonzero(counts[:, 0]):
                out.append((int(begin[k]), int(end[k]), sector, *counts[k].tolist(), float(top[sector][k])))
        return pd.DataFrame(out, columns=[c.split()[0] for c in COUNTS.split(", ")])

    return run


COUNTS = "first long, last long, sector string, n long, over_1_5 long, ge_2 long, ge_3 long, ge_5 long, largest double"


def window_counts(findings: DataFrame, series: DataFrame, sectors: DataFrame | None = None, value: str = "volume") -> DataFrame:
    """start, end, sector ('' where unknown), n, over_1_5, ge_2, ge_3, ge_5, largest: of the entities of a sector with a ratio in a window, how many reach each threshold.

    Entities stay together (an entity has one row a day) and meet the distinct windows, SENT of them at a time, within
    a task, which gives back its counts by window and sector; no row for an entity and a window is made.
    """
    spark = series.sparkSession
    number = lambda c: F.datediff(c, F.lit("1970-01-01")).cast("long")
    windows = written(findings.select(number(F.col("start")).alias("first"), number(F.col("end")).alias("last")).distinct())
    s = series.select(F.col("symbol").alias("entity"), number(F.col("date")).alias("day"), F.col(value).cast("double").alias("v"))
    named = sectors.select(F.col("symbol").alias("entity"), F.coalesce("sector", F.lit("")).alias("sector")) if sectors is not None else s.select("entity").distinct().withColumn("sector", F.lit(""))
    s = s.join(named, "entity", "left").na.fill("", ["sector"])
    s = s.withColumn("task", F.pmod(F.xxhash64("entity"), F.lit(s.count() // TASK_ROWS + 1)))
    groups = windows.count() // SENT + 1
    parts = None
    for g in range(groups):
        own = windows.where(F.pmod(F.xxhash64("first", "last"), F.lit(groups)) == g).toPandas()  # about SENT rows
        shared = spark.sparkContext.broadcast((own["first"].to_numpy(np.int64), own["last"].to_numpy(np.int64)))
        found = s.groupBy("task").applyInPandas(_counted(shared), COUNTS)
        parts = found if parts is None else parts.union(found)
    day = lambda c: F.date_add(F.lit("1970-01-01").cast("date"), F.col(c).cast("int"))
    sums = [F.sum(c).alias(c) for c in ("n", "over_1_5", "ge_2", "ge_3", "ge_5")]
    return parts.groupBy("first", "last", "sector").agg(*sums, F.max("largest").alias("largest")).select(day("first").alias("start"), day("last").alias("end"), "sector", "n", "over_1_5", "ge_2", "ge_3", "ge_5", "largest")


def co_movement(findings: DataFrame, series: DataFrame, sectors: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Of each finding: entities with a ratio, those that doubled, peers of the sector that doubled, the largest index ratio.

    From counts by window and sector; what the finding's own entity adds to its sector is taken off.
    """
    f = findings.select(*KEY).distinct()
    counts = written(window_counts(f, series, sectors))
    total = counts.groupBy("start", "end").agg(*[F.sum(c).alias(a) for c, a in (("n", "n"), ("ge_2", "n_ge2"), ("ge_3", "n_ge3"), ("ge_5", "n_ge5"))])
    peers = counts.where("sector <> ''").select("start", "end", "sector", F.col("ge_2").alias("_peers"))
    own = window_ratios(f, series).select(*KEY, (F.col("ratio") >= 2).alias("_own"))
    rows = f.join(total, ["start", "end"]).join(sectors.select("symbol", "sector"), "symbol", "left").join(peers, ["start", "end", "sector"], "left").join(own, KEY, "left")
    out = rows.select(*KEY, "n", "n_ge2", "n_ge3", "n_ge5", F.coalesce(F.col("_peers") - F.coalesce("_own", F.lit(False)).cast("int"), F.lit(0)).alias("sector_peers"))
    if index is not None:
        top = window_counts(f, index).groupBy("start", "end").agg(F.max("largest").alias("index_ratio"))
        out = out.join(top, ["start", "end"], "left").select(*out.columns, "index_ratio")
    else:
        out = out.withColumn("index_ratio", F.lit(None).cast("double"))
    market = (F.col("n_ge2") >= 0.5 * F.col("n")) | F.coalesce(F.col("index_ratio") >= 1.5, F.lit(False))
    return out.withColumn("market_hit", market).withColumn("sector_hit", F.col("sector_peers") >= 2)


def peers_moved(findings: DataFrame, series: DataFrame, most: int = 30) -> DataFrame:
    """key, peers: other entities whose ratio in the window is over 1.5, at most `most`."""
    f = findings.select(*KEY).distinct()
    total = window_counts(f, series).select("start", "end", "over_1_5")
    own = window_ratios(f, series).select(*KEY, (F.col("ratio") > 1.5).alias("_own"))
    rows = f.join(total, ["start", "end"]).join(own, KEY, "left")
    return rows.select(*KEY, F.least(F.lit(most), F.col("over_1_5") - F.coalesce("_own", F.lit(False)).cast("int")).alias("peers"))


def sector_of(universe: DataFrame, industries: DataFrame) -> DataFrame:
    """symbol, sector: the mapped one, else the industry itself, else ''."""
    m = F.broadcast(industries.select(F.col("industry").alias("m_industry"), F.col("sector").alias("m_sector")))
    return universe.join(m, F.col("industry") == F.col("m_industry"), "left").select("symbol", F.coalesce("m_sector", "industry", F.lit("")).alias("sector"))


def generic(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Cause by the prefix of the metric; an unknown metric stays, with confidence 0.3. Nothing is benign."""
    r = F.broadcast(rules.select(F.col("prefix").alias("r_prefix"), F.col("root_cause").alias("r_cause"), F.col("confidence").alias("r_conf")))
    out = findings.join(r, F.split("metric", "::")[0] == F.col("r_prefix"), "left")
    return out.withColumn("root_cause", F.coalesce("r_cause", F.lit("unknown"))).withColumn("confidence", F.coalesce("r_conf", F.lit(0.3))).drop("r_prefix", "r_cause", "r_conf")


def bucket(value: Column) -> Column:
    """Shape of a value for fingerprints."""
    out = F.lit(">=100")
    for edge in (100, 20, 8, 5, 2, 1, 0):
        out = F.when(value < edge, f"<{edge}").otherwise(out)
    return out


def fingerprint(asof: Column, extra: Column | None = None) -> Column:
    tail = F.when(F.col("end") >= asof, "tail").otherwise("inner")
    parts = ["probe", "metric", bucket(F.col("value")), tail]
    return F.concat_ws("|", *parts, *([F.array_join(F.array_sort(extra), "|")] if extra is not None else []))


def memory(observed: DataFrame) -> DataFrame:
    """Experience after all observations (fingerprint, root_cause, label, confidence, asof), a row for each fingerprint and cause.

    The first observation is pending, the second confirms (largest confidence, hits counted); each later
    observation of a fingerprint halves the weight of its confirmed rows with the other label.
    """
    w = W.partitionBy("fingerprint").orderBy("asof", "root_cause")
    o = observed.withColumn("at", F.row_number().over(w))
    o = o.withColumn("nth", F.row_number().over(W.partitionBy("fingerprint", "root_cause").orderBy("at")))
    rows = o.groupBy("fingerprint", "root_cause").agg(
        F.count("*").alias("hits"), F.max("confidence").alias("confidence"), F.max_by("label", "at").alias("label"), F.min("asof").alias("created_asof"),
        F.min(F.when(F.col("nth") == 2, F.col("asof"))).alias("confirmed_asof"), F.min(F.when(F.col("nth") == 2, F.col("at"))).alias("confirmed_at"), F.max("asof").alias("updated_asof"),
    )
    seen = o.select("fingerprint", F.col("label").alias("o_label"), F.col("at").alias("o_at"))
    later = rows.where("confirmed_at is not null").join(seen, "fingerprint").where("o_at > confirmed_at and o_label <> label")
    halved = later.groupBy("fingerprint", "root_cause").agg(F.count("*").alias("against"))
    out = rows.join(halved, ["fingerprint", "root_cause"], "left")
    status = F.when(F.col("confirmed_at").isNotNull(), "confirmed").otherwise("pending")
    return out.select("fingerprint", "root_cause", "label", status.alias("status"), "confidence", F.pow(F.lit(0.5), F.coalesce("against", F.lit(0))).alias("weight"), "hits", "created_asof", "confirmed_asof", "updated_asof")


def recall(mem: DataFrame, asof: Column, per: int = 5, others: int = 3) -> DataFrame:
    """Usable experience: the best of each fingerprint, and the best of all as lessons for others."""
    fine = mem.where((F.col("status") == "confirmed") & (F.col("created_asof") <= asof) & (F.col("confidence") >= 0.6) & (F.col("weight") >= 0.5))
    own = fine.withColumn("rank", F.row_number().over(W.partitionBy("fingerprint").orderBy(F.desc("hits"), "root_cause"))).where(F.col("rank") <= per).withColumn("scope", F.lit("own"))
    top = fine.orderBy(F.desc("hits"), "fingerprint", "root_cause").limit(others)
    return own.unionByName(top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("hits"), "fingerprint", "root_cause"))).withColumn("scope", F.lit("any")))


def prune(mem: DataFrame, confirmed: int = 5, pending: int = 50) -> DataFrame:
    """The newest confirmed rows of each fingerprint and the newest pending rows of all."""
    c = mem.where("status = 'confirmed'").withColumn("r", F.row_number().over(W.partitionBy("fingerprint").orderBy(F.desc("updated_asof"), "root_cause"))).where(F.col("r") <= confirmed)
    p = mem.where("status = 'pending'").orderBy(F.desc("updated_asof"), "fingerprint", "root_cause").limit(pending)
    return c.drop("r").unionByName(p)


def recent_signals(signals: DataFrame, days: int, asof: Column | None = None) -> DataFrame:
    anchor = signals.agg(F.max("asof").alias("anchor"))
    rows = signals.crossJoin(F.broadcast(anchor))  # one row
    at = asof if asof is not None else F.col("anchor")
    return rows.where(F.col("asof").between(F.date_sub(at, days), at)).drop("anchor")


def present_on(days: DataFrame, universe: DataFrame, series: DataFrame) -> DataFrame:
    """date, present, symbol: how many entities have a row on a day, with a row for each entity that lacks one (a null symbol where none does)."""
    d, have = days.select("date").distinct(), series.select("symbol", "date").distinct()
    known = universe.select("symbol").distinct()
    present = have.join(known, "symbol", "left_semi").groupBy("date").agg(F.count("*").alias("present"))
    lacking = d.crossJoin(known).join(have, ["symbol", "date"], "left_anti")  # days asked for x the declared universe
    return d.join(present, "date", "left").join(lacking, "date", "left").select("date", F.coalesce("present", F.lit(0)).alias("present"), "symbol")
