"""Checks of agent traces and tool calls, and the filter of training samples.

Two inputs. Traces: trace_id, task, outcome (struct), golden (map), steps (array of struct seq, name,
arguments (map), result (map), status, error). Tool calls: record, pos, name, arguments (map), beside
tools: record or null (known to all), name, spec_no, params (map name -> struct description, default).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Words by which a description says that a value has a default, or may be left out.
CLAIMS_VALUE = ("default", "默认值", "缺省")
CLAIMS_OPTIONAL = ("optional", "可选", "if not provided")
CLAIMED_NUMBER = r"default\s*(?:is|value\s+is|=|:)?\s*([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)"
# What becomes of a sample, by category.
VERDICTS = {
    "ok": "positive", "guard_flagged": "positive", "lucky_guess": "review", "degrade_month_expansion": "review", "degrade_missing_slots": "review", "abort_symbol": "not_failure", "abort_as_of": "not_failure", "abort_range": "not_failure",
    "env_timeout": "not_failure", "tool_missing": "not_failure", "param_error": "discard", "retry_loop": "discard", "step_error": "review", "schema_contradiction": "schema_defect", "hallucinated_date": "discard", "parse_mismatch": "discard",
}


def canonical(arguments: Column) -> Column:
    """A map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(arguments))))


def degraded(steps: Column) -> Column:
    """Count, names and errors of degraded steps."""
    d = F.filter(steps, lambda s: s["status"] == "degraded")
    return F.struct(F.size(d).alias("n"), F.array_join(F.transform(d, lambda s: s["name"]), ",").alias("names"), F.array_join(F.transform(d, lambda s: F.coalesce(s["error"], F.lit(""))), "; ").alias("errors"))


def aborted(error: Column) -> Column:
    """The code after aborted:, null when the run did not abort."""
    return F.when(error.startswith("aborted:"), F.expr("substring(outcome.error, 9)"))


def retry_storms(traces: DataFrame, threshold: int = 2) -> DataFrame:
    """trace_id, worst (most equal calls in a row of arguments) and by_name (most calls of one tool), for traces that repeat a call."""
    s = traces.select("trace_id", F.explode("steps").alias("s")).select("trace_id", "s.name", canonical(F.col("s.arguments")).alias("args"))
    same = s.groupBy("trace_id", "name", "args").agg(F.count("*").alias("n"))
    return same.groupBy("trace_id", "name").agg(F.max("n").alias("worst"), F.sum("n").alias("calls")).groupBy("trace_id").agg(F.max("worst").alias("worst"), F.max("calls").alias("by_name")).where(F.col("worst") >= threshold)


def first_parse(steps: Column) -> Column:
    return F.get(F.filter(steps, lambda s: s["name"] == "parse_query"), F.lit(0))


def ungrounded(traces: DataFrame, slots: tuple[str, ...] = ("as_of", "start", "end")) -> DataFrame:
    """trace_id, slot, value, state of date slots of the first parse: grounded, ungrounded, or unverifiable in a text without digits.

    Ends of a month are grounded in a text that names the month.
    """
    p = traces.select("trace_id", "task", first_parse(F.col("steps"))["result"].alias("r"))
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("slot"), F.col("r")[n].alias("value")) for n in slots])).alias("x")
    rows = p.select("trace_id", "task", pairs).select("trace_id", "task", "x.slot", "x.value").where("value is not null")
    day = F.to_date("value")
    edge = (F.dayofmonth(day) == 1) | (day == F.last_day(day))
    state = F.when(~F.col("task").rlike(r"\d"), "unverifiable").when(F.expr("contains(task, value)"), "grounded").when(edge & F.expr("contains(task, substring(value, 1, 7))"), "grounded").otherwise("ungrounded")
    return rows.select("trace_id", "slot", "value", state.alias("state"))


def mismatches(traces: DataFrame, slots: tuple[str, ...] = ("symbol", "intent", "as_of", "start", "end")) -> DataFrame:
    """trace_id, slots that differ from gold where the outcome says so; null without gold."""
    r = first_parse(F.col("steps"))["result"]
    differ = F.filter(F.array(*[F.when(~r[n].eqNullSafe(F.col("golden")[n]), F.lit(n)) for n in slots]), lambda x: x.isNotNull())
    return traces.where("outcome.matches = false").select("trace_id", F.when(F.col("golden").isNotNull(), F.array_join(differ, ",")).alias("slots"))


def misplaced_defaults(params: DataFrame) -> DataFrame:
    """name, spec_no, param, claimed, holders: the number that a description calls its default stands at other parameters of the tool.

    params: name, spec_no, param, description, default (null: none).
    """
    key = ["name", "spec_no", "_value"]
    a = params.where("default is null and param is not null").withColumn("claimed", F.nullif(F.regexp_extract(F.lower("description"), CLAIMED_NUMBER, 1), F.lit(""))).where("claimed is not null")
    a = a.select("name", "spec_no", "param", "claimed").distinct().withColumn("_value", F.expr("try_cast(claimed as double)"))
    # holders of a number are listed once, not once for each that claims it, so only lists and claims are dealt
    b = params.where("default is not null").withColumn("_value", F.expr("try_cast(default as double)")).where("_value is not null").groupBy(*key).agg(F.sort_array(F.collect_set("param")).alias("_all"))
    j = a.join(b, key).where(F.size("_all") > F.array_contains("_all", F.col("param")).cast("int"))
    others = F.when(F.array_contains("_all", F.col("param")), F.array_remove("_all", F.col("param"))).otherwise(F.col("_all"))
    return j.select("name", "spec_no", "param", "claimed", F.array_join(others, "/").alias("holders"))


def claim(description: Column) -> Column:
    """value, optional or '': how strongly a description says that the parameter may be left out."""
    low = F.lower(F.coalesce(description, F.lit("")))
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))
    return F.when(has(CLAIMS_VALUE), "value").when(has(CLAIMS_OPTIONAL), "optional").otherwise("")


def _required(params: DataFrame) -> DataFrame:
    """name, spec_no, param and kind, what its absence from a call is: of each that has no default."""
    wrong = misplaced_defaults(params).select("name", "spec_no", "param").distinct().withColumn("misplaced", F.lit(True))
    said = claim(F.col("description"))
    kind = F.when(F.col("misplaced"), "misplaced").when(said == "value", "contradiction_value").when(said == "optional", "contradiction_optional").otherwise("missing")
    return params.where("default is null").join(wrong, ["name", "spec_no", "param"], "left").select("name", "spec_no", "param", kind.alias("kind"))


def call_issues(calls: DataFrame, params: DataFrame) -> DataFrame:
    """record, pos, spec_no, kind, param: what is wrong with a call under each spec of its tool.

    Required is what has no default. In order of evidence: misplaced, contradiction_value,
    contradiction_optional (the schema contradicts itself), missing (the call lacks it), unknown (not in the spec).
    """
    required = calls.join(_required(params), "name").where(~F.array_contains(F.map_keys("arguments"), F.col("param")))
    lacking = required.select("record", "pos", "spec_no", "kind", "param")
    names = params.groupBy("name", "spec_no").agg(F.collect_set("param").alias("known"))
    extra = calls.join(names, "name").select("record", "pos", "spec_no", F.lit("unknown").alias("kind"), F.explode(F.array_except(F.map_keys("arguments"), "known")).alias("param"))
    return lacking.union(extra)


#: Parameters whose specs go to every task at once; of more, calls are dealt by tool.
FEW = 100_000


def _judged(calls: DataFrame, params: DataFrame) -> DataFrame:
    """The calls with issues (sorted kind:param): under the spec with the fewest; a tool without a spec is one issue. A call stays one row: it meets all specs of its tool at once."""
    required = _required(params).groupBy("name", "spec_no").agg(F.collect_list(F.struct("kind", "param")).alias("required"))
    known = params.groupBy("name", "spec_no").agg(F.collect_set("param").alias("known"))
    specs = known.join(required, ["name", "spec_no"], "left").groupBy("name").agg(F.collect_list(F.struct("spec_no", "required", "known")).alias("_specs"))
    specs = F.broadcast(specs) if len(params.select("name").limit(FEW + 1).collect()) <= FEW else specs
    empty, keys = F.expr("array()").cast("array<string>"), F.map_keys("arguments")

    def issues(s: Column) -> Column:
        lacking = F.transform(F.filter(s["required"], lambda r: ~F.array_contains(keys, r["param"])), lambda r: F.concat_ws(":", r["kind"], r["param"]))
        extra = F.transform(F.array_except(keys, s["known"]), lambda k: F.concat_ws(":", F.lit("unknown"), k))
        return F.sort_array(F.concat(F.coalesce(lacking, empty), F.coalesce(extra, empty)))

    of = F.transform("_specs", lambda s: _sized(s["spec_no"], issues(s)))
    fewest = F.when(F.col("_specs").isNull(), F.array(F.concat(F.lit("not_found:"), F.col("name")))).otherwise(F.array_min(of)["issues"])
    return calls.join(specs, "name", "left").withColumn("issues", fewest).drop("_specs")


def _sized(spec_no: Column, issues: Column) -> Column:
    """Ordered by the number of issues, then by the spec."""
    return F.transform(F.array(issues), lambda x: F.struct(F.size(x).alias("n"), F.coalesce(spec_no, F.lit(0)).alias("spec_no"), x.alias("issues")))[0]


def best_issues(calls: DataFrame, params: DataFrame) -> DataFrame:
    """record, pos, name, issues (sorted kind:param): under the spec with the fewest; a tool without a spec is one issue."""
    return _judged(calls, params).select("record", "pos", "name", "issues")


def record_steps(calls: DataFrame, params: DataFrame) -> DataFrame:
    """record, pos, name, status, error: issues of each call, or that it repeats an earlier one."""
    rows = _judged(calls, params)
    rows = rows.withColumn("again", F.row_number().over(W.partitionBy("record", "name", canonical(F.col("arguments"))).orderBy("pos")))
    error = F.when(F.size("issues") > 0, F.array_join("issues", "; ")).when(F.col("again") > 1, "duplicate call")
    return rows.select("record", "pos", "name", F.when(error.isNotNull(), "error").otherwise("ok").alias("status"), error.alias("error"))


def diagnose(traces: DataFrame) -> DataFrame:
    """trace_id, category, severity: the first of the ordered rules that holds.

    Typed issues are told by their kind, so an unknown argument is a parameter error and no missing tool.
    """
    failed = F.filter("steps", lambda s: s["status"] == "error")
    text = F.lower(F.array_join(F.transform(failed, lambda s: F.coalesce(s["error"], F.lit(""))), " "))
    flat = F.regexp_replace(text, r"[\s_\-'\":()]+", "")
    error = F.coalesce(F.col("outcome.error"), F.lit(""))
    storms = retry_storms(traces).select("trace_id", F.lit(True).alias("storm"))
    loose = ungrounded(traces).where("state = 'ungrounded'").select("trace_id").distinct().withColumn("loose", F.lit(True))
    rows = traces.join(storms, "trace_id", "left").join(loose, "trace_id", "left")
    d = F.filter("steps", lambda s: s["status"] == "degraded")
    reasons = F.array_join(F.transform(d, lambda s: F.coalesce(s["error"], F.lit(""))), " ")
    is_in = lambda *words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(flat, w))
    category = (
        F.when(error.startswith("aborted:") & error.contains("slot_incomplete:as_of"), "abort_as_of").when(error.startswith("aborted:") & error.contains("slot_incomplete:range"), "abort_range").when(error.startswith("aborted:"), "abort_symbol")
        .when(text.contains("misplaced:") | text.contains("contradiction_"), "schema_contradiction")
        .when((F.size(failed) > 0) & is_in("timeout", "timedout"), "env_timeout").when((F.size(failed) > 0) & is_in("unknownargument"), "param_error").when((F.size(failed) > 0) & is_in("notfound", "nosuchtool", "unknowntool"), "tool_missing")
        .when((F.size(failed) > 0) & is_in("param", "invalid", "argument", "outofrange", "missing", "unknown"), "param_error").when(F.size(failed) > 0, "step_error")
        .when(F.col("storm"), "retry_loop").when(F.col("loose"), "hallucinated_date").when(F.col("outcome.should_refuse") & ~F.coalesce("outcome.refused", F.lit(False)), "hallucinated_date").when(~F.col("outcome.matches"), "parse_mismatch")
        .when((F.size(d) > 0) & F.coalesce("outcome.correct", F.lit(False)), "lucky_guess").when((F.size(d) > 0) & reasons.contains("lacks start/end") & ~F.col("task").rlike(r"\d{4}-\d{2}-\d{2}"), "degrade_month_expansion").when(F.size(d) > 0, "degrade_missing_slots")
        .when(~F.col("outcome.usable") | (F.coalesce("outcome.badge", F.lit("BASELINE")) != "BASELINE"), "guard_flagged").otherwise("ok")
    )
    silent = F.col("category").isin("hallucinated_date", "parse_mismatch")
    severity = F.when(F.col("category").isin("ok", "guard_flagged"), "ok").when(silent, "silent").otherwise("loud")
    return rows.select("trace_id", category.alias("category")).withColumn("severity", severity)


def with_verdict(diagnoses: DataFrame) -> DataFrame:
    """Unknown categories are reviewed."""
    out = F.lit("review")
    for category, verdict in VERDICTS.items():
        out = F.when(F.col("category") == category, verdict).otherwise(out)
    return diagnoses.withColumn("verdict", out)


def summary(diagnoses: DataFrame, parser: str = "parser") -> DataFrame:
    """part (category, severity, parser), name, n, silent, loud."""
    g = diagnoses.groupingSets([["category"], ["severity"], [parser]], "category", "severity", parser).agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "silent").alias("silent"), F.count_if(F.col("severity") == "loud").alias("loud"), F.grouping_id().alias("g"))
    part = F.when(F.col("g") == 3, "category").when(F.col("g") == 5, "severity").otherwise("parser")
    return g.select(part.alias("part"), F.coalesce("category", "severity", parser).alias("name"), "n", "silent", "loud")


def training_example(record: Column, query: Column, answers: Column, tools: Column) -> Column:
    """The messages of a sample as JSON; answers is an array of struct name, arguments (map)."""
    calls = F.transform(answers, lambda a: F.struct(F.lit("function").alias("type"), F.struct(a["name"].alias("name"), canonical(a["arguments"]).alias("arguments")).alias("function")))
    user = F.struct(F.lit("user").alias("role"), query.alias("content"), F.lit(None).cast("array<struct<type:string,function:struct<name:string,arguments:string>>>").alias("tool_calls"))
    said = F.struct(F.lit("assistant").alias("role"), F.lit("").alias("content"), calls.alias("tool_calls"))
    return F.to_json(F.struct(record.alias("id"), F.array(user, said).alias("messages"), tools.alias("tools")))


def defect_tally(steps: DataFrame, samples: int = 3) -> DataFrame:
    """kind, tool, param, hits, first_detail and samples (up to three distinct records, the smallest) of schema-side issues, most hits first by sorting on read."""
    x = steps.where("status = 'error'").select("record", "name", F.explode(F.split("error", "; ")).alias("issue"))
    x = x.withColumn("kind", F.split("issue", ":")[0]).withColumn("param", F.split("issue", ":")[1]).where(F.col("kind").isin("misplaced", "contradiction_value", "contradiction_optional"))
    key = ["kind", "name", "param"]
    each = x.groupBy(*key, "record").agg(F.count("*").alias("n"), F.min("issue").alias("issue"))
    total = each.groupBy(*key).agg(F.sum("n").alias("hits"), F.min_by("issue", "record").alias("first_detail"))
    first = each.withColumn("r", F.row_number().over(W.partitionBy(*key).orderBy("record"))).where(F.col("r") <= samples).groupBy(*key).agg(F.array_sort(F.collect_list("record")).alias("samples"))
    return total.join(first, key).withColumnRenamed("name", "tool")


def _issue_kinds(calls: DataFrame, params: DataFrame) -> DataFrame:
    """record, n_calls and the distinct kinds of issues of its calls."""
    s = record_steps(calls, params)
    kinds = F.array_sort(F.array_distinct(F.transform(F.split("error", "; "), lambda x: F.split(x, ":")[0])))
    x = s.withColumn("kinds", F.when(F.col("error").isNotNull(), kinds).otherwise(F.expr("array()").cast("array<string>")))
    return x.groupBy("record").agg(F.count("*").alias("n_calls"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("kinds"))


def _verdict(strict: bool) -> Column:
    has = lambda *k: F.arrays_overlap("kinds", F.array(*[F.lit(v) for v in k]))
    schema_side = has("misplaced", "contradiction_value", "contradiction_optional") if strict else has("misplaced", "contradiction_value", "contradiction_optional", "missing")
    return F.when(schema_side, "schema_defect").when(has("not_found"), "not_failure").when(has("missing", "unknown"), "discard").when(has("duplicate call"), "review").otherwise("positive")


def filtered(calls: DataFrame, params: DataFrame, strict: bool = True) -> DataFrame:
    """record, n_calls, verdict, issue kinds: the whole filter of a corpus. strict: a missing parameter counts as the call's fault."""
    return _issue_kinds(calls, params).select("record", "n_calls", _verdict(strict).alias("verdict"), F.array_join("kinds", ",").alias("kinds"))


def premise_sensitivity(calls: DataFrame, params: DataFrame) -> DataFrame:
    """verdict, strict, lenient, difference: the same corpus under two premises, from one pass."""
    each = _issue_kinds(calls, params).groupBy("kinds").agg(F.count("*").alias("n"))
    both = each.select("n", F.explode(F.array(*[F.struct(_verdict(x).alias("verdict"), F.lit(x).alias("strict")) for x in (True, False)])).alias("x"))
    of = lambda x: F.coalesce(F.sum(F.when(F.col("x.strict") == x, F.col("n"))), F.lit(0))
    return both.groupBy("x.verdict").agg(of(True).alias("strict"), of(False).alias("lenient")).withColumn("difference", F.col("lenient") - F.col("strict"))
