"""A training-data pipeline over documents: five stages, each written as Parquet and read again.

toxicity      documents that the model rejects (score of 0.5 or more) go
line_dedup    later repeats of passages are cut out of the texts; a document that is nothing else goes
near_dedup    of each group of near duplicates (similarity of 0.80 or more) one document stays, the one
              with the smallest doc_id
mixing        sources are passed so often as their weights ask, in permuted blocks; every document is passed
              at least once
encoding      each text is encoded and decoded; digests of both

Every stage but the last gives back the columns of documents, also those that are named like a column that it makes
itself, with their values. Null and empty texts, null ids, repeated rows and empty tables go through every stage; what
each does with them is stated in the operators' modules.

SQL can't express the stages (a fitted model, extended matches, connected components), so ORACLE_SQL is
None. Tests hold every operator against a brute-force version, and the chain against the same rules in
plain Python on a small table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import line_dedup, mixing, near_dedup, piece_bpe
from plumbline.llm import toxicity as tox
from plumbline.llm.common import own_names, table
from plumbline.shared import written

ORACLE_SQL = None


def kept(docs: DataFrame, made: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stage gives, with the columns of docs alone; those that are named like one that the stage makes keep their values."""
    own = [c for c in docs.columns if c.lower() in made]
    away = dict(zip(own, own_names(docs, *[f"{c}_" for c in own])))
    rows = stage(docs.withColumnsRenamed(away))
    return rows.select(*[F.col(f"`{away.get(c, c)}`").alias(c) for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tox.without_toxic(docs, tox.fit(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = kept(docs, ("lines_runs",), lambda d: line_dedup.dedup_lines(d, drop_emptied=True))
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs, percent=80).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept(docs, ("mix_pass", "mix_block", "mix_place", "mix_key"), mixing.mix)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_bpe.query(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", lines), ("near_dedup", near), ("mixing", mix), ("encoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what a stage returns is written beside the checkpoints and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
