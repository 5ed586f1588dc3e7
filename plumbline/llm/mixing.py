"""Mixing sources to target weights by temperature.

Token shares of the sources are raised to an exponent tau in [0, 1]; tau is bisected until the mixture
has the asked entropy or just keeps to the repetition limit. The weights are then realised within a
token budget: a source gets whole passes over its documents and one last part of a pass. Each pass is
a permutation by a seeded digest, and the last part is the beginning of its permutation, up to the
document with which the source's share of the budget is full.

The mixture is dealt into blocks of about BLOCK_TOKENS tokens. A document's block follows from its place
in the passes of its source, so every block holds the sources at their weights, and the order within a
block is the order of the digests. Blocks are what is shuffled; they don't grow with the data.

Words are counted once: what is needed of a document (source, doc_id, tokens) is written as a narrow
table, from which totals and cuts are taken. The cut of the last part is found without ordering a source
in one task: digests fall into ranges, the tokens of the ranges are summed, and only the one range that
holds the cut is ordered. What reaches the documents is one row for each source.

Defined results: null is a source of its own. Null and empty texts have no tokens; they share in every
whole pass and in the last part if their digest lies before the cut. A source without tokens gets one
pass. Rows that share a doc_id and source have one digest and enter together. An empty table gives an
empty one. Extra columns are kept in `mix`; a column named mix_pass, mix_block, mix_place or mix_key is
replaced. Only built-in functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import checkpointed, own_names
from plumbline.shared import written

#: Sources up to which their table goes to every task; more are joined by source.
SMALL = 20_000
#: Documents in a range of digests, about; tokens and documents of a block of the mixture, about.
RANGE_ROWS, BLOCK_TOKENS, BLOCK_ROWS = 4096, 1 << 20, 1 << 16
DIGEST_SPACE = float(1 << 32)
#: Bisections that one aggregate over the sources decides.
BITS = 5


def n_tokens(text: Column) -> Column:
    """Words of the text: each, with the white space before it, becomes one character; a last word is added so that all is covered."""
    return (F.length(F.regexp_replace(F.concat(F.coalesce(text, F.lit("")), F.lit(" .")), r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", ".")) - 1).cast("bigint")


def digest(seed: int, doc_id: Column, pass_no: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), pass_no.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _sized(sources: DataFrame) -> DataFrame:
    return F.broadcast(sources) if sources.count() <= SMALL else sources


def _share(key: Column) -> Column:
    """Where a digest lies in [0, 1)."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / DIGEST_SPACE


def counted(documents: DataFrame) -> DataFrame:
    """source, doc_id and n_tokens, written once."""
    return written(documents.select("source", "doc_id", n_tokens(F.col("text")).alias("n_tokens")))


def source_totals(ledger: DataFrame) -> DataFrame:
    """source, its documents and its tokens."""
    return ledger.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))


def solve_exponent(totals: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = None, budget: float | None = None, steps: int = 40) -> float:
    """The smallest tau in [0, 1], by bisection, that meets what is asked; one aggregate decides BITS steps.

    target_entropy: share of the largest possible entropy, reached from above as tau grows.
    repetition_limit: most passes over any source. Without a budget the largest source counts as passed
    once. If even tau = 1 exceeds the limit, tau is 1.
    """
    rows = totals.where("tokens > 0").select(F.col("tokens").cast("double").alias("t"))
    n, top, least = rows.agg(F.count("*"), F.max("t"), F.min("t")).first()
    if not n or top == least or (target_entropy is None and repetition_limit is None):
        return 1.0

    def within(taus: list[float]) -> list[bool]:
        tried = rows.withColumn("tau", F.explode(F.array(*[F.lit(x) for x in taus]))).withColumn("p", F.pow(F.col("t") / top, F.col("tau")))
        found = {r["tau"]: r for r in tried.groupBy("tau").agg(F.sum("p").alias("z"), F.max(F.col("p") / F.col("t")).alias("most"), F.sum(F.col("p") * F.log("p")).alias("s")).collect()}  # one row for each exponent tried
        out = []
        for z, most, s in ((found[x]["z"], found[x]["most"], found[x]["s"]) for x in taus):
            fine = target_entropy is None or (math.log(z) - s / z) / math.log(n) <= target_entropy
            out.append(fine and (repetition_limit is None or (budget / z if budget is not None else top) * most <= repetition_limit * (1 + 1e-12)))
        return out

    at_zero, at_one = within([0.0, 1.0])
    if at_zero or not at_one:
        return 0.0 if at_zero else 1.0
    low, high = 0.0, 1.0
    for _ in range(steps // BITS):
        points = [low + (high - low) * i / (1 << BITS) for i in range(1, 1 << BITS)]
        fine = within(points)
        first = fine.index(True) if True in fine else len(points)
        low, high = ([low, *points])[first], ([*points, high])[first]
    return high


def plan(ledger: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = 2.0, budget: float | None = None, epochs: float | None = None, seed: int = 7) -> DataFrame:
    """One row for each source: tokens, weight, passes, whole passes, the digest up to which the last pass goes, and the blocks of the whole mixture.

    budget: tokens of the mixture; epochs: the same in multiples of all tokens. Without either it is the
    smallest with which the source that is repeated least is passed once as a whole.
    """
    totals = checkpointed(source_totals(ledger))
    total = totals.agg(F.sum("tokens")).first()[0] or 0
    if budget is None and epochs is not None:
        budget = epochs * total
    tau = solve_exponent(totals, target_entropy, repetition_limit, budget)
    t = F.col("tokens").cast("double")
    sources = totals.withColumn("weight", F.lit(0.0)).withColumn("passes", F.lit(1.0))
    if total:
        top = float(totals.agg(F.max("tokens")).first()[0])
        z = totals.where("tokens > 0").agg(F.sum(F.pow(t / top, F.lit(tau)))).first()[0]
        sources = totals.withColumn("weight", F.when(t > 0, F.pow(t / top, F.lit(tau)) / z).otherwise(0.0))
        sources = sources.withColumn("passes", F.when(t > 0, F.round(F.lit(float(budget if budget is not None else top * z)) * F.col("weight") / t, 9)).otherwise(1.0))
    sources = sources.withColumn("whole", F.floor("passes").cast("int"))
    sources = checkpointed(sources.withColumn("left", (F.col("passes") - F.col("whole")) * t).withColumn("ranges", F.ceil(F.col("docs") / RANGE_ROWS)))
    sizes = sources.agg(F.sum(F.col("passes") * t), F.sum(F.col("passes") * F.col("docs"))).first()
    blocks = max(1, math.ceil((sizes[0] or 0) / BLOCK_TOKENS), math.ceil((sizes[1] or 0) / BLOCK_ROWS))
    cuts = _cuts(ledger, sources, seed)
    return sources.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source").withColumn("tau", F.lit(tau)).withColumn("blocks", F.lit(blocks).cast("bigint"))


def _cuts(ledger: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """The last digest of the last part of a pass, for each source that has one."""
    s = sources.where("left > 0").select(F.col("source").alias("cut_source"), "whole", "left", "ranges")
    keyed = ledger.join(_sized(s), F.col("source").eqNullSafe(F.col("cut_source"))).withColumn("key", digest(seed, F.col("doc_id"), F.col("whole") + 1))
    keyed = keyed.select("cut_source", "left", "key", F.col("n_tokens").alias("n"), F.floor(_share(F.col("key")) * F.col("ranges")).alias("range"))
    sums = keyed.groupBy("cut_source", "left", "range").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(W.partitionBy("cut_source").orderBy("range"))
    edge = sums.withColumn("before", upto - F.col("n")).where((F.col("before") < F.col("left")) & (F.col("before") + F.col("n") >= F.col("left")))
    edge = edge.select(F.col("cut_source").alias("es"), F.col("range").alias("er"), "before")
    inside = keyed.join(_sized(edge), F.col("cut_source").eqNullSafe(F.col("es")) & (F.col("range") == F.col("er")))
    start = F.col("before") + F.coalesce(F.sum("n").over(W.partitionBy("cut_source").orderBy("key").rangeBetween(W.unboundedPreceding, W.currentRow)), F.lit(0)) - F.sum("n").over(W.partitionBy("cut_source", "key"))
    return inside.withColumn("start", start).where("start < left").groupBy("cut_source").agg(F.max("key").alias("cut"))


def mix(documents: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = 2.0, budget: float | None = None, epochs: float | None = None, seed: int = 7, ledger: DataFrame | None = None) -> DataFrame:
    """The documents' columns, with mix_pass (from 1), mix_block (from 0), mix_place (from 1, in the block) and mix_key; a row for each time a document is passed.

    ledger: source, doc_id and n_tokens of the documents, where they are counted already.
    """
    p = plan(counted(documents) if ledger is None else ledger, target_entropy, repetition_limit, budget, epochs, seed)
    source, whole, cut, passes, blocks, last, n = own_names(documents, "mix_source", "mix_whole", "mix_cut", "mix_passes", "mix_blocks", "mix_last", "mix_n")
    p = checkpointed(p.select(F.col("source").alias(source), F.col("whole").alias(whole), F.col("cut").alias(cut), F.greatest("passes", F.lit(1e-9)).alias(passes), F.col("blocks").alias(blocks)))
    kept = documents.drop("mix_pass", "mix_block", "mix_place", "mix_key")
    joined = kept.join(_sized(p), F.col("source").eqNullSafe(F.col(source)))
    # the digest of the last part is reused as the key of that pass
    joined = joined.withColumn(last, F.when(F.col(cut).isNotNull(), digest(seed, F.col("doc_id"), F.col(whole) + 1)))
    joined = joined.withColumn(n, F.col(whole) + F.when(F.col(last) <= F.col(cut), 1).otherwise(0)).where(F.col(n) > 0)
    rows = joined.withColumn("mix_pass", F.explode(F.sequence(F.lit(1), F.col(n))))
    rows = rows.withColumn("mix_key", F.when(F.col("mix_pass") > F.col(whole), F.col(last)).otherwise(digest(seed, F.col("doc_id"), F.col("mix_pass"))))
    at = F.floor((F.col("mix_pass") - 1 + _share(F.col("mix_key"))) / F.col(passes) * F.col(blocks)).cast("bigint")
    rows = rows.withColumn("mix_block", F.least(at, F.col(blocks) - 1)).drop(source, whole, cut, passes, blocks, last, n)
    return rows.withColumn("mix_place", F.row_number().over(W.partitionBy("mix_block").orderBy("mix_key")))


def query(documents: DataFrame) -> DataFrame:
    """A mixture of as many tokens as the documents hold, in which no source is passed more than twice."""
    ledger = counted(documents)
    return mix(ledger, epochs=1.0, ledger=ledger).select("doc_id", "source", "n_tokens", "mix_pass", "mix_block", "mix_place", "mix_key")


#: DuckDB SQL for the query's rows.
ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM documents),
s AS (SELECT source, sum(n)::DOUBLE AS t, count(*) AS docs FROM t GROUP BY source),
g AS (SELECT list(t ORDER BY t) AS ts, max(t) AS top, min(t) AS low, sum(t) AS total FROM s WHERE t > 0),
b(step, low, high) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT step + 1, CASE WHEN fine THEN low ELSE mid END, CASE WHEN fine THEN mid ELSE high END FROM (
    SELECT step, b.low, high, (b.low + high) / 2 AS mid,
      total / list_sum(list_transform(ts, lambda x: pow(x / top, (b.low + high) / 2))) * list_max(list_transform(ts, lambda x: pow(x / top, (b.low + high) / 2) / x)) <= 2.0 * (1 + 1e-12) AS fine
    FROM b, g WHERE step < 40)),
tau AS (SELECT CASE WHEN top IS NULL OR top = low THEN 1.0 WHEN total / len(ts) / low <= 2.0 * (1 + 1e-12) THEN 0.0 ELSE (SELECT high FROM b WHERE step = 40) END AS tau FROM g),
z AS (SELECT list_sum(list_transform(ts, lambda x: pow(x / top, tau))) AS z FROM g, tau),
p AS (SELECT source, s.t, docs, CASE WHEN s.t > 0 THEN round(total * (pow(s.t / top, tau) / z) / s.t, 9) ELSE 1.0 END AS passes FROM s, g, tau, z),
n AS (SELECT greatest(1, ceil(sum(passes * t) / 1048576), ceil(sum(passes * docs) / 65536))::BIGINT AS blocks FROM p),
q AS (SELECT source, passes, floor(passes)::INT AS whole, (passes - floor(passes)) * t AS rest FROM p),
a AS (SELECT t.doc_id, t.source, n, passes, whole, rest, md5('7:' || (whole + 1) || ':' || coalesce(doc_id::VARCHAR, '')) AS k FROM t JOIN q ON t.source IS NOT DISTINCT FROM q.source),
c AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY k RANGE UNBOUNDED PRECEDING) - sum(n) OVER (PARTITION BY source, k) AS before FROM a),
d AS (SELECT doc_id, source, n, passes, unnest(range(1, (whole + 1 + CASE WHEN rest > 0 AND before < rest THEN 1 ELSE 0 END)::BIGINT)) AS p FROM c),
e AS (SELECT *, md5('7:' || p || ':' || coalesce(doc_id::VARCHAR, '')) AS k FROM d),
f AS (SELECT *, least(floor((p - 1 + ('0x' || substr(k, 1, 8))::BIGINT::DOUBLE / 4294967296.0) / greatest(passes, 1e-9) * blocks)::BIGINT, blocks - 1) AS block FROM e, n)
SELECT doc_id, source, n AS n_tokens, p::INT AS mix_pass, block AS mix_block, row_number() OVER (PARTITION BY block ORDER BY k)::INT AS mix_place, k AS mix_key FROM f
"""
