"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps the measurements and one bit for
each failed rule; a policy is a versioned mask, so a changed policy or an ablation never reads the
texts again: both are bitwise work on the ledger, and an ablation first counts the distinct masks
(2^rules at most) and then works on those counts.

Defined results: a null or empty text has no words and fails the base rules. Rows are judged one by
one, so repeated rows and null ids are kept as they are. Columns of the input that are not asked for
are ignored, whatever their names. Only built-in functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import GAP, let

SYMBOLS = r"[#*$%&|<>]"

#: Bit of each rule. Ledgers are stored, so a bit never changes its meaning.
BITS = {"few_words": 0, "repeated_windows": 1, "symbols": 2, "repeated_lines": 3, "word_length": 4}


@dataclass(frozen=True)
class Policy:
    """A named set of rules that reject a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << BITS[rule] for rule in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
STRICT = Policy("strict-1", tuple(BITS))


def _measures(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, GAP), lambda w: w != "")

    def measured(w: Column) -> Column:
        n = F.size(w)
        # hash and position of each window of three words, equal hashes side by side
        windows = F.when(n >= 3, F.array_sort(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("p"))))).otherwise(F.expr("array()").cast("array<struct<h:bigint,p:int>>"))

        def covered(s: Column) -> Column:
            last = F.size(s) - 1
            twice = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(s, i + 1)["h"] == x["h"])))
            places = F.array_sort(F.transform(twice, lambda x: x["p"]))
            start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("at"))
            return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["at"])).alias("n"), p.alias("at")), lambda a: a["n"])

        return F.struct(n.cast("bigint").alias("n_words"), let(windows, covered).alias("n_repeat_words"))

    lines = F.filter(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, GAP, "") != "")
    return F.struct(
        let(words, measured).alias("w"),
        F.length(F.regexp_replace(text, GAP, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup"), F.size(x).cast("bigint").alias("all"))).alias("lines"),
    )


def ledger(documents: DataFrame, max_symbols_pct: int = 30, max_dup_lines_pct: int = 50, word_length: tuple[int, int] = (2, 15), min_words: int = 50, max_repeat_pct: int = 50) -> DataFrame:
    """doc_id, the measurements and fail_bits, one row for each document.

    Thresholds: a document fails `symbols` with more than max_symbols_pct symbols for 100 words,
    `repeated_lines` with more than that share of repeated lines, `word_length` with a mean number of
    code points outside the two bounds.
    """
    m = documents.select(F.col("doc_id"), _measures(F.col("text")).alias("m")).select(
        "doc_id",
        F.col("m.w.n_words").alias("n_words"),
        F.col("m.word_chars").alias("word_chars"),
        F.col("m.n_symbols").alias("n_symbols"),
        F.col("m.lines.dup").alias("n_dup_lines"),
        F.col("m.w.n_repeat_words").alias("n_repeat_words"),
        F.col("m.lines.all").alias("n_lines"),
    )
    n = F.col("n_words")
    failed = {
        "few_words": n < min_words,
        "repeated_windows": 100 * F.col("n_repeat_words") > max_repeat_pct * n,
        "symbols": 100 * F.col("n_symbols") > max_symbols_pct * n,
        "repeated_lines": 100 * F.col("n_dup_lines") > max_dup_lines_pct * F.col("n_lines"),
        "word_length": (F.col("word_chars") < word_length[0] * n) | (F.col("word_chars") > word_length[1] * n),
    }
    bits = F.lit(0).cast("bigint")
    for rule, bit in BITS.items():
        bits = bits.bitwiseOR(F.when(failed[rule], F.lit(1 << bit)).otherwise(0).cast("bigint"))
    return m.withColumn("fail_bits", bits)


def failing(policy: Policy) -> Column:
    """The bits of a ledger row that count under the policy; 0: the document is kept."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("bigint"))


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    return rows.withColumn("policy", F.lit(policy.version)).withColumn("kept", failing(policy) == 0)


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents that fail it, that fail it alone, and those kept without it."""
    masks = rows.groupBy(failing(policy).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << BITS[r]).cast("bigint").alias("bit")) for r in policy.rules])).alias("r")
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    others = F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) != 0
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    return masks.select("bits", "n", rules).groupBy(F.col("r.rule").alias("rule")).agg(total(hit).alias("n_failed"), total(hit & ~others).alias("n_failed_alone"), total(~others).alias("n_kept_without"))


def judge(documents: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """The ledger with base_failed and the verdict of the policy."""
    rows = apply_policy(ledger(documents), policy)
    base_failed = failing(BASE) != 0
    return rows.withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & F.col("kept"))


#: DuckDB SQL for the query's rows.
ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
tri AS (SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM tri) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT i + d) AS n FROM rep, (VALUES (0), (1), (2)) AS o(d) GROUP BY rid),
ln AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
m AS (
  SELECT t.doc_id, len(w.ws)::BIGINT AS n_words, length(regexp_replace(t.text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t.text) - length(regexp_replace(t.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ln.l) - len(list_distinct(ln.l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ln.l)::BIGINT AS n_lines
  FROM t JOIN w USING (rid) JOIN ln USING (rid) LEFT JOIN cov USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
     + CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
     + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, fail_bits = 0 AS kept, fail_bits FROM f
"""


def query(documents: DataFrame) -> DataFrame:
    return judge(documents).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")
