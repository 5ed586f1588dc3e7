"""Projections, normalisation and reference data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators.intervals import overlapping

from plumbline.operators.intervals import run_lengths


def mapped(rows: DataFrame, names: dict[str, str], date: str | None = None) -> DataFrame:
    """The mapped columns that exist, under their new names; one of them cast to a date."""
    out = rows.select(*[F.col(a).alias(b) for a, b in names.items() if a in rows.columns])
    return out.withColumn(date, F.to_date(date)) if date in out.columns else out


def daily_change(rows: DataFrame, key: str, day: str, value: str, start: Column | None = None) -> DataFrame:
    """pct_chg over the full history, then rows from start on; the first kept row of a key has 0."""
    w = W.partitionBy(key).orderBy(day)
    out = rows.withColumn("pct_chg", F.round(100 * (F.col(value) / F.nullif(F.lag(value).over(w), F.lit(0.0)) - 1), 4))
    out = out if start is None else out.where(F.col(day) >= start)
    return out.withColumn("pct_chg", F.when(F.row_number().over(w) == 1, 0.0).otherwise(F.col("pct_chg")))


def classify(code: Column, prefixes: list[tuple[str, str]], other: str) -> Column:
    """The class of the first prefix that fits."""
    out = F.lit(other)
    for prefix, name in reversed(prefixes):
        out = F.when(code.startswith(prefix), name).otherwise(out)
    return out


def price_limits(symbols: DataFrame, universe: DataFrame, wide: tuple[str, ...] = ("star", "chinext")) -> DataFrame:
    u = universe.select(F.col("symbol").alias("u_symbol"), "board")
    return symbols.join(u, F.col("symbol") == F.col("u_symbol"), "left").select("symbol", F.when(F.col("board").isin(*wide), 0.20).otherwise(0.10).alias("price_limit"))


def dividend_events(rows: DataFrame) -> DataFrame:
    """Rows with a day become ex_rights events, once for each symbol and day."""
    out = rows.where("ex_date is not null").select("symbol", F.to_date("ex_date").alias("date"), F.lit("ex_rights").alias("kind"), F.format_string("%.2f per share", F.col("amount").cast("double")).alias("detail"))
    return out.groupBy("symbol", "date", "kind").agg(F.min("detail").alias("detail"))


def backfill_first(universe: DataFrame, rows: DataFrame, key: str, day: str, column: str) -> DataFrame:
    """column becomes the first day that rows have where it is null or later; changed tells which."""
    first = rows.groupBy(key).agg(F.min(day).alias("_first"))
    out = universe.join(first, key, "left")
    new = F.when(F.col("_first").isNotNull() & (F.col(column).isNull() | (F.col(column) > F.col("_first"))), F.col("_first")).otherwise(F.col(column))
    return out.withColumn("changed", ~new.eqNullSafe(F.col(column))).withColumn(column, new).drop("_first")


def tool_shape(raw: DataFrame) -> DataFrame:
    """name, schema and dialect of tool definitions whose schema stands under one of three keys; nameless ones have a null name."""
    key = F.when(F.col("input_schema").isNotNull(), "input_schema").when(F.col("inputSchema").isNotNull(), "inputSchema").when(F.col("parameters").isNotNull(), "parameters").otherwise("none")
    return raw.select(F.col("server"), F.nullif(F.trim("name"), F.lit("")).alias("name"), F.coalesce("input_schema", "inputSchema", "parameters").alias("schema"), key.alias("dialect"))


def tool_corpus(servers: DataFrame) -> DataFrame:
    """server, pos, name, dialect of all tools of servers (server, tools array)."""
    t = servers.select("server", F.posexplode("tools").alias("pos", "tool")).select("server", "pos", "tool.*")
    return tool_shape(t).join(t.select("server", "pos", "name"), ["server", "name"])


def plain_text(html: Column) -> Column:
    """Tags to spaces, the common entities, folded white space."""
    out = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " "), r"<[^>]*>", " ")
    for name, value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(value))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def sections(text: Column, size: int = 2400) -> Column:
    """Pieces of the size, in order."""
    n = F.ceil(F.length(text) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def filing_windows(names: DataFrame, filings: DataFrame) -> DataFrame:
    """COMPANY_YEAR_FORM names beside the filings of the form reported in the window of that year."""
    p = names.select("doc_name", F.regexp_extract("doc_name", r"^(.+)_(\d{4})(?:Q\d)?_([0-9A-Z]+)$", 1).alias("company"), F.expr(r"try_cast(regexp_extract(doc_name, '^(.+)_(\\d{4})(?:Q\\d)?_([0-9A-Z]+)$', 2) as int)").alias("year"), F.regexp_extract("doc_name", r"^(.+)_(\d{4})(?:Q\d)?_([0-9A-Z]+)$", 3).alias("form"))
    p = p.where("year is not null").withColumn("lo", F.make_date("year", F.lit(6), F.lit(1))).withColumn("hi", F.make_date(F.col("year") + 1, F.lit(5), F.lit(31)))
    f = filings.select(F.col("company").alias("f_company"), F.col("form").alias("f_form"), "report_date", "filing")
    return overlapping(p, f, {"company": "f_company", "form": "f_form"}, ("lo", "hi"), ("report_date", "report_date"), width=366).select("doc_name", "company", "year", "form", "report_date", "filing")


def blocks(docs: DataFrame, start: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, block, header, body: a text is cut before each line that matches start; block 0 is what stands before the first."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line"))
    w = W.partitionBy(key).orderBy("pos")
    lines = lines.withColumn("block", F.sum(F.col("line").rlike(start).cast("int")).over(w))
    g = lines.groupBy(key, "block").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("x"))
    body = F.array_join(F.transform("x", lambda s: s["line"]), "\n")
    return g.select(key, "block", F.when(F.col("block") > 0, F.col("x")[0]["line"]).alias("header"), body.alias("body"))


def run_log(lines: DataFrame) -> DataFrame:
    """One row for each run of a log (file, line_no, line): what the lines after a start mark say; missing stays null."""
    w = W.partitionBy("file").orderBy("line_no")
    l = lines.withColumn("run", F.sum(F.col("line").startswith("== run").cast("int")).over(w)).where("run > 0")
    pick = lambda name: F.max(F.nullif(F.regexp_extract("line", rf"\b{name}=([^\s,]+)", 1), F.lit("")))
    return l.groupBy("file", "run").agg(*[pick(c).alias(c) for c in ("asof", "symbols", "findings", "alerts", "suppressed", "health", "seconds")])


__all__ = ["backfill_first", "blocks", "classify", "daily_change", "dividend_events", "filing_windows", "mapped", "plain_text", "price_limits", "run_lengths", "run_log", "sections", "tool_corpus", "tool_shape"]
