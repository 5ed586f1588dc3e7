"""Structured questions over a daily series, a row of answer for each, and the guard over answers.

A question: q_id, symbol, intent (price, change, aggregate), start, end. Prices and the ends of ranges are
found by ordered passes over questions and prices together (see intervals.as_of), and counts and sums of a
range are differences of running sums, so a question never meets all rows of its range.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import trading_calendar as cal
from plumbline.operators.intervals import as_of, overlapping, running
from plumbline.shared import written

# Words that tell what is asked for; a price if there are none.
AGGREGATE_WORDS = ("日均", "平均", "多少天", "成交量", "成交额", "有成交", "多少个交易日", "average", "how many")
CHANGE_WORDS = ("涨", "跌", "change", "rise")


def prices(questions: DataFrame, series: DataFrame) -> DataFrame:
    """The latest close on or before the day, with the day that is used."""
    out = as_of(questions.select("q_id", "symbol", "end"), series, "symbol", "end", "date", ["close"])
    return out.select("q_id", "symbol", "end", F.col("found_date").alias("used"), F.col("found_close").alias("value"))


def spans(questions: DataFrame, series: DataFrame) -> DataFrame:
    """q_id, symbol, start, end; a: the first close on or after start, b: the last on or before end, of the day used; first and last day, number of rows and sum of volume between."""
    s = written(running(series.select("symbol", "date", "close", "volume"), "symbol", "date", {"n": F.lit(1), "v": F.coalesce("volume", F.lit(0.0)), "nv": F.when(F.col("volume").isNotNull(), 1).otherwise(0)}))
    values = ["close", "volume", "n", "v", "nv"]
    low = as_of(questions.select("q_id", "symbol", "start", "end"), s, "symbol", "start", "date", values, after=True)
    low = low.select("q_id", "symbol", "start", "end", *[F.col(f"found_{c}").alias(f"low_{c}") for c in ["date", *values]])
    out = as_of(low, s, "symbol", "end", "date", values)
    some = F.coalesce((F.col("low_date") <= F.col("end")) & (F.col("found_date") >= F.col("start")) & (F.col("low_date") <= F.col("found_date")), F.lit(False))
    known = F.col("low_volume").isNotNull().cast("int")
    return out.select(
        "q_id", "symbol", "start", "end", F.col("low_close").alias("a"), F.col("found_close").alias("b"), F.when(some, F.col("low_date")).alias("first"), F.when(some, F.col("found_date")).alias("last"), F.col("found_date").alias("used"),
        F.when(some, F.col("found_n") - F.col("low_n") + 1).otherwise(0).alias("rows"), F.when(some, F.col("found_v") - F.col("low_v") + F.coalesce("low_volume", F.lit(0.0))).alias("volume"),
        F.when(some, F.col("found_nv") - F.col("low_nv") + known).otherwise(0).alias("with_volume"),
    )


def changes(questions: DataFrame, series: DataFrame) -> DataFrame:
    """Percent from the first close on or after start to the last on or before end; first and last days of the range that have rows (without any: start and end), and how many."""
    return spans(questions, series).select("q_id", "symbol", F.round((F.col("b") / F.col("a") - 1) * 100, 4).alias("value"), F.coalesce("first", "start").alias("first"), F.coalesce("last", "end").alias("last"), "rows")


def aggregates(questions: DataFrame, series: DataFrame) -> DataFrame:
    return spans(questions, series).select("q_id", "symbol", "rows", F.when(F.col("with_volume") > 0, F.round(F.col("volume") / F.col("with_volume"), 2)).alias("value"))


def guarded(questions: DataFrame, suspensions: DataFrame, calendar: DataFrame, used: DataFrame) -> DataFrame:
    """q_id, flag and level. used: q_id, used (the day of the price) and rows of the range.

    A change over a range with one price at most is a gap; a price on a suspended day is stale; an aggregate
    over suspended days misses some of the calendar; other changes that touch a suspension are warned of.
    """
    h = suspensions.select(F.col("symbol").alias("h_symbol"), F.col("begin_date").alias("h_start"), F.coalesce("end_date", "begin_date").alias("h_end"))
    low = F.when(F.col("intent") == "price", F.col("end")).otherwise(F.col("start"))
    hit = overlapping(questions.select("q_id", "symbol", low.alias("low"), "end"), h, {"symbol": "h_symbol"}, ("low", "end"), ("h_start", "h_end")).groupBy("q_id").agg(F.count("*").alias("overlaps"), F.min("h_start").alias("from"), F.max("h_end").alias("to"))
    rows = questions.join(hit, "q_id", "left").join(used, "q_id", "left")
    rows = cal.trading_days_between(rows.withColumn("after", F.date_add(F.coalesce("used", "from"), 1)), calendar, "after", "end", "lag")
    touched = F.col("overlaps").isNotNull()
    flag = (
        F.when(touched & (F.col("intent") == "change") & (F.coalesce("rows", F.lit(0)) <= 1), "gap_span").when(touched & (F.col("intent") == "price"), "stale_price")
        .when(touched & (F.col("intent") == "aggregate"), "calendar_mismatch").when(touched, "suspended_window").otherwise("none")
    )
    level = F.when(flag == "gap_span", "unusable").when(flag == "none", "baseline").otherwise("caution")
    return rows.select("q_id", "intent", flag.alias("flag"), level.alias("level"), F.when(flag == "stale_price", F.col("lag")).alias("lag"))


def trap_scores(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """tp, fp, fn, tn of flagged (answers: q_id, flag, message) against expected (q_id, trap, must_mention), with recall, specificity and precision, and how many say all that they must.

    An answer that must mention nothing is right if it isn't flagged.
    """
    j = expected.join(answers, "q_id", "left")
    got = F.coalesce(F.col("flag") != "none", F.lit(False))
    must = F.coalesce("must_mention", F.expr("array()").cast("array<string>"))
    said = F.forall(must, lambda m: F.contains(F.coalesce("message", F.lit("")), m))
    right = F.when(F.size(must) > 0, said).otherwise(~got)
    out = j.agg(F.count_if(got & F.col("trap")).alias("tp"), F.count_if(got & ~F.col("trap")).alias("fp"), F.count_if(~got & F.col("trap")).alias("fn"), F.count_if(~got & ~F.col("trap")).alias("tn"), F.count_if(right).alias("right"), F.round(F.avg(right.cast("double")), 6).alias("correction"))
    rate = lambda a, b: F.round(F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0)), 6)
    return out.withColumn("recall", rate("tp", "fn")).withColumn("specificity", rate("tn", "fp")).withColumn("precision", rate("tp", "fp"))


def _day(text: Column, pattern: str, year: Column | None = None) -> Column:
    """The date in the groups of a pattern: year, month, day, or month and day of a given year; null if there is none such."""
    group = lambda i: F.regexp_extract(text, pattern, i)
    y, m, d = (group(1), group(2), group(3)) if year is None else (year.cast("string"), group(1), group(2))
    return F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")


def named(text: Column, names: DataFrame) -> Column:
    """The smallest symbol of a name that the text holds; names (name, symbol) are a small table that goes to every task.

    A text meets the names by each two characters in it, which names begin with, and is neither exploded nor dealt.
    """
    beginning: dict[str, list[tuple[str, str]]] = {}
    for name, symbol in names.where("name <> '' and symbol is not null").select("name", "symbol").distinct().collect():
        beginning.setdefault(name[:2], []).append((name, symbol))
    shared = names.sparkSession.sparkContext.broadcast(beginning)

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        known = shared.value

        def smallest(t: str | None) -> str | None:
            pieces = {t[i : i + n] for i in range(len(t)) for n in (1, 2)} & known.keys() if t else ()
            return min((symbol for p in pieces for name, symbol in known[p] if name in t), default=None)

        return texts.map(smallest)

    return of(text)


def slots(texts: DataFrame, names: DataFrame) -> DataFrame:
    """q_id, symbol, intent, start, end and as_of of question texts.

    symbol: a code (six digits, or like S07) or a known name. Dates: year, month and day; month and day
    take the year of the first such; year-month-day with hyphens. They are sorted: of two and more the
    first and last are start and end, one alone is as_of. Without any, a month is a range.
    """
    full, partial, iso, month, iso_month = r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", r"(?<!\d)(\d{1,2})\s*月\s*(\d{1,2})\s*日", r"(\d{4})-(\d{1,2})-(\d{1,2})", r"(\d{4})\s*年\s*(\d{1,2})\s*月", r"(\d{4})-(\d{2})(?!-?\d)"
    t = texts.select("q_id", F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("code", F.regexp_extract("text", r"(?U)\b(\d{6}|S\d{2})\b", 1))
    found = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(0))
    t = t.withColumn("whole", F.transform(found(full), lambda x: _day(x, full)))
    year = F.year(F.get("whole", F.lit(0)))
    t = t.withColumn("bare", F.when(year.isNotNull(), F.transform(found(partial), lambda x: _day(x, partial, year))))
    t = t.withColumn("days", F.array_sort(F.array_distinct(F.array_compact(F.concat("whole", F.coalesce("bare", F.expr("cast(array() as array<date>)")), F.transform(found(iso), lambda x: _day(x, iso)))))))
    first = F.when(F.size("days") == 0, F.coalesce(*[F.concat_ws("-", F.regexp_extract("text", p, 1), F.lpad(F.regexp_extract("text", p, 2), 2, "0"), F.lit("01")).try_cast("date") for p in (month, iso_month)]))
    t = t.withColumn("month", first)
    t = t.withColumn("named", named(F.when(F.col("code") == "", F.col("text")), names))
    holds = lambda words: F.lower("text").rlike("|".join(words))
    intent = F.when(holds(AGGREGATE_WORDS), "aggregate").when(holds(CHANGE_WORDS), "change").otherwise("price")
    several = F.size("days") > 1
    return t.select(
        "q_id", F.coalesce(F.nullif("code", F.lit("")), F.col("named")).alias("symbol"), intent.alias("intent"), F.when(several, F.get("days", F.lit(0))).otherwise(F.col("month")).alias("start"),
        F.when(several, F.element_at("days", -1)).otherwise(F.last_day("month")).alias("end"), F.when(F.size("days") == 1, F.get("days", F.lit(0))).alias("as_of"),
    )


def slot_diff(got: DataFrame, gold: DataFrame, names: list[str]) -> DataFrame:
    """For each question and slot whether both sides agree; two nulls agree."""
    g = gold.select("q_id", *[F.col(c).alias(f"gold_{c}") for c in names])
    return got.join(g, "q_id").select("q_id", *[F.col(c).eqNullSafe(F.col(f"gold_{c}")).alias(f"{c}_ok") for c in names])
