"""Scans, sinks and loads."""

from __future__ import annotations

import csv
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.sources.arrays import scan_array

STEP = "struct<seq:int,name:string,arguments:map<string,string>,result:map<string,string>,status:string,error:string,latency_ms:double>"
TRACE = f"schema_version string, run_id string, agent string, parser string, task string, steps array<{STEP}>, outcome map<string,string>, golden map<string,string>"
CALL = "struct<name:string,arguments:map<string,string>>"
FIELD = "struct<name:string,kind:string,chars:bigint>"
TURN = f"struct<turn:int,prompt_tokens:bigint,completion_tokens:bigint,messages_chars:bigint,tools_chars:bigint,tool_calls:array<struct<name:string,arguments:string,args_hash:string,result_code:string,payload_chars:bigint,fields:array<{FIELD}>>>>"
BUNDLE = f"task string, final_answer string, turns array<{TURN}>, name string, trace_id string, attributes map<string,string>"
# The five parts of a filtered corpus.
PARTS = ("positive", "review", "discard", "not_failure", "schema_defect")


def scan_csv(spark: SparkSession, path: str, schema: str, delimiter: str = ",", label: str | None = None) -> DataFrame:
    """Lenient: what doesn't parse is null and the line stands in _corrupt; source labels the rows."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("header", True).option("sep", delimiter).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    return rows.withColumn("source", F.lit(f"csv:{label or path.rstrip('/').rsplit('/', 1)[-1]}"))


#: Lines by which a dialect is told, and what is tried.
HEAD_LINES, DELIMITERS, QUOTES = 200, (",", ";", "\t", "|"), ('"', "'")


@dataclass(frozen=True)
class Dialect:
    delimiter: str = ","
    quote: str = '"'
    header: bool = True

    def label(self) -> str:
        name = {"\t": "tab", ",": "comma", ";": "semicolon", "|": "bar"}[self.delimiter]
        return f"{name}{'' if self.quote == QUOTES[0] else ',single'}{'' if self.header else ',no_header'}"


def _cells(line: str, delimiter: str, quote: str) -> list[str]:
    return next(csv.reader([line], delimiter=delimiter, quotechar=quote), [])


def sniff(lines: list[str]) -> Dialect:
    """The dialect that cuts lines most evenly: the largest share of lines with the usual number of cells, then the fewest quotes left in cells, then the most cells.

    The first line is a header if it has no number where most other lines have one, or if no column has any.
    """
    best = None
    for delimiter in DELIMITERS:
        for quote in QUOTES:
            rows = [_cells(x, delimiter, quote) for x in lines if x.strip()]
            (usual, often), = Counter(map(len, rows)).most_common(1) or [(0, 0)]
            if usual > 1:
                left = sum(q in c for r in rows for c in r for q in QUOTES)
                score = (often / len(rows), -left, usual)
                if best is None or score > best[0]:
                    best = (score, delimiter, quote, [r for r in rows if len(r) == usual])
    if best is None:
        return Dialect()
    _, delimiter, quote, rows = best
    number = re.compile(r"\s*[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?\s*")
    numeric = [[bool(number.fullmatch(c)) for c in r] for r in rows]
    columns = [i for i in range(len(rows[0])) if 2 * sum(r[i] for r in numeric[1:]) > len(numeric) - 1]
    return Dialect(delimiter, quote, not any(numeric[0][i] for i in columns))


def scan_csv_sniffed(spark: SparkSession, path: str, schema: str, label: str | None = None) -> DataFrame:
    """As scan_csv; where the default parse of the first lines doesn't give the declared number of columns, the dialect is told from them. All rows are read then; source says what was found."""
    lines = [r[0] for r in spark.read.text(path).limit(HEAD_LINES).collect()]
    columns = len(StructType.fromDDL(schema).fields)
    fine = lines and all(len(_cells(x, ",", '"')) == columns for x in lines if x.strip())
    found = Dialect() if fine else sniff(lines)
    rows = spark.read.schema(f"{schema}, _corrupt string").option("header", found.header).option("sep", found.delimiter).option("quote", found.quote).option("enforceSchema", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    return rows.withColumn("source", F.lit(f"csv:{label or path.rstrip('/').rsplit('/', 1)[-1]}:{found.label()}"))


def snapshot(spark: SparkSession, folder: str, tables: dict[str, str]) -> dict[str, DataFrame]:
    """Named Parquet tables; a table that can't be read becomes an empty one with the declared columns."""
    from pyspark.errors import AnalysisException

    out = {}
    for name, schema in tables.items():
        try:
            out[name] = spark.read.parquet(f"{folder}/{name}.parquet")
        except AnalysisException:
            out[name] = spark.createDataFrame([], schema)
    return out


def with_seeds(table: DataFrame, seeds: DataFrame, keys: list[str]) -> DataFrame:
    """The table and those seed rows whose key it lacks."""
    return table.unionByName(seeds.join(table.select(*keys).distinct(), keys, "left_anti"))


def cut(tables: dict[str, DataFrame], days: dict[str, str], asof: Column) -> dict[str, DataFrame]:
    """Rows up to asof, by the day column of each table; tables without one stay whole. The filter reaches the scan."""
    return {n: d.where(F.to_date(days[n]) <= asof) if n in days else d for n, d in tables.items()}


def scan_traces(spark: SparkSession, path: str) -> DataFrame:
    """One trace a line; missing parts get defaults, blank lines are passed over."""
    t = spark.read.schema(TRACE).json(path).where("run_id is not null or task is not null")
    return t.withColumn("steps", F.coalesce("steps", F.expr(f"cast(array() as array<{STEP}>)"))).withColumn("schema_version", F.coalesce("schema_version", F.lit("1")))


def observed(df: DataFrame) -> tuple[DataFrame, Observation]:
    """df, and what tells its number of rows once it was written, without another pass."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def sink_traces(traces: DataFrame, path: str) -> int:
    """One JSON object a line, without null fields; how many were written."""
    rows, seen = observed(traces)
    rows.write.mode("overwrite").option("ignoreNullFields", True).json(path)
    return seen.get["rows"]


def scan_tool_calls(spark: SparkSession, path: str) -> DataFrame:
    """id, query, answers, tools, tools_json of JSON arrays of records whose answers and tools are JSON texts; broken or null texts are empty lists. A file is read in as many parts as it has splits."""
    r = scan_array(spark, path).select(F.from_json("text", "id bigint, query string, answers string, tools string").alias("r")).select("r.*")
    a = F.coalesce(F.from_json("answers", f"array<{CALL}>"), F.expr(f"cast(array() as array<{CALL}>)"))
    n = F.coalesce(F.from_json("tools", "array<struct<name:string,description:string>>"), F.expr("cast(array() as array<struct<name:string,description:string>>)"))
    return r.select("id", "query", a.alias("answers"), n.alias("tools"), F.col("tools").alias("tools_json"))


def scan_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Runs and spans of one folder, told apart by content; of runs with one task the last line of the last file counts."""
    raw = spark.read.schema(BUNDLE).json(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")).withColumn("_at", F.monotonically_increasing_id())
    runs = raw.where("turns is not null").withColumn("_n", F.row_number().over(W.partitionBy("task").orderBy(F.desc("_file"), F.desc("_start"), F.desc("_at")))).where("_n = 1")
    return runs.select("task", "final_answer", "turns"), raw.where("turns is null and attributes is not null").select("name", "trace_id", "attributes")


def args_hash(arguments: Column) -> Column:
    return F.substring(F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.from_json(arguments, "map<string,string>"))))), 256), 1, 16)


def flat_turns(runs: DataFrame) -> DataFrame:
    t = runs.select("task", F.posexplode("turns").alias("i", "t"))
    return t.select("task", F.coalesce("t.turn", F.col("i") + 1).alias("turn"), *[F.coalesce(f"t.{c}", F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens", "messages_chars", "tools_chars")])


def flat_calls(runs: DataFrame) -> DataFrame:
    t = runs.select("task", F.posexplode("turns").alias("i", "t")).select("task", F.coalesce("t.turn", F.col("i") + 1).alias("turn"), F.posexplode("t.tool_calls").alias("c", "call"))
    return t.select("task", "turn", (F.col("c") + 1).alias("call_no"), F.col("call.name").alias("tool"), F.coalesce("call.args_hash", args_hash(F.col("call.arguments"))).alias("args_hash"), F.coalesce("call.result_code", F.lit("ok")).alias("result_code"), F.coalesce("call.payload_chars", F.lit(0)).alias("payload_chars"))


def span_records(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Model calls and tool calls of flat spans."""
    a = F.col("attributes")
    chats = spans.where("name = 'gen_ai.chat'").select("trace_id", a["gen_ai.request.model"].alias("model"), a["gen_ai.usage.input_tokens"].cast("long").alias("input_tokens"), a["gen_ai.usage.output_tokens"].cast("long").alias("output_tokens"))
    tools = spans.where("name = 'gen_ai.tool.call'").select("trace_id", a["gen_ai.tool.name"].alias("tool"), a["payload_chars"].cast("long").alias("payload_chars"))
    return chats, tools


def scan_documents(spark: SparkSession, path: str, max_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """doc_id, title, text of files <doc_id>.md that begin with "# title", and the rejected ones. A cut text says so at its end."""
    d = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[a-z]+)?$", 1).alias("file"), F.col("value").alias("text"))
    title = F.regexp_extract("text", r"^# (.+)", 1)
    if max_chars is not None:
        d = d.withColumn("text", F.when(F.length("text") > max_chars, F.concat(F.substring("text", 1, max_chars), F.lit("\n[cut]"))).otherwise(F.col("text")))
    d = d.withColumn("title", title)
    return d.where("title <> ''"), d.where("title = ''")


def checked_questions(questions: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Good questions, rejected ones with their reasons, and document ids that the corpus lacks (questions: qid, options map, gold, doc_ids)."""
    n = F.count("*").over(W.partitionBy("qid"))
    reasons = F.filter(F.array(F.when(n > 1, F.lit("duplicate")), F.when(F.size("options") < 2, F.lit("options")), F.when(~F.coalesce(F.col("gold"), F.lit("")).rlike("^[A-D]+$"), F.lit("gold"))), lambda x: x.isNotNull())
    q = questions.withColumn("reasons", F.array_join(reasons, ","))
    missing = questions.select(F.explode("doc_ids").alias("doc_id")).distinct().join(documents.select("doc_id"), "doc_id", "left_anti")
    return q.where("reasons = ''").drop("reasons"), q.where("reasons <> ''"), missing


def upsert(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the batch replace those of the target with the same key; null keys match null. Twice is once."""
    k = batch.select(*[F.col(c).alias(f"_{c}") for c in keys]).distinct()
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    return target.join(k, on, "left_anti").unionByName(batch.dropDuplicates(keys))


def increments(batch: DataFrame, target: DataFrame, key: str, day: str, default: Column) -> DataFrame:
    """Rows of the batch after the last day that the target has for their key, or from default on."""
    last = target.groupBy(key).agg(F.max(day).alias("_last"))
    return batch.join(last, key, "left").where(F.col(day) >= F.coalesce(F.date_add("_last", 1), default)).drop("_last")


def tracked(spark: SparkSession, source: str, table: str, load) -> DataFrame:
    """One row on a load: status, rows and error (2000 characters at most). load(note) writes note(df) for what it loads; the rows are those that were written. A failed load has none."""
    seen: list[Observation] = []

    def note(df: DataFrame) -> DataFrame:
        rows, watched = observed(df)
        seen.append(watched)
        return rows

    try:
        load(note)
        rows, status, error = sum(s.get["rows"] for s in seen), "success", None
    except Exception as e:  # noqa: BLE001  the log takes any failure
        rows, status, error = 0, "failed", str(e)[:2000]
    return spark.createDataFrame([(source, table, status, rows, error)], "source string, target_table string, status string, rows_written long, error string")


def record_signals(history: DataFrame, signals: DataFrame) -> DataFrame:
    """History with the signals of (asof, finding_key, metric) replaced; repeats inside the batch count once."""
    return upsert(history, signals, ["asof", "finding_key", "metric"])


def sink_parts(samples: DataFrame, path: str) -> DataFrame:
    """Writes JSON by verdict and returns the rows of unknown verdicts."""
    known = F.coalesce(F.col("verdict").isin(*PARTS), F.lit(False))
    samples.where(known).write.mode("overwrite").partitionBy("verdict").json(path)
    return samples.where(~known)


def export_manifest(samples: DataFrame, rules: str) -> DataFrame:
    """One row: samples, calls, counts by verdict, rules version and a fingerprint of the data (an order-free sum of row digests)."""
    parts = [F.count_if(F.col("verdict") == p).alias(p) for p in PARTS]
    piece = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("record").cast("string"), "verdict"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return samples.agg(F.count("*").alias("samples"), F.sum("n_calls").alias("calls"), *parts, F.sum(piece).cast("string").alias("fingerprint")).withColumn("rules", F.lit(rules))


def runs_to_traces(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Run records and chat spans of question rows (q_id, answer, details array<struct<turn,tokens>>): two views of one scan."""
    runs = rows.select(F.col("q_id").cast("string").alias("task"), F.col("answer").alias("final_answer"), F.transform("details", lambda d: F.struct(d["turn"].alias("turn"), d["tokens"].alias("prompt_tokens"))).alias("turns"))
    d = rows.select("q_id", F.explode("details").alias("d"))
    spans = d.select(F.lit("gen_ai.chat").alias("name"), F.col("q_id").cast("string").alias("trace_id"), F.create_map(F.lit("gen_ai.usage.input_tokens"), F.col("d.tokens").cast("string")).alias("attributes"))
    return runs, spans
