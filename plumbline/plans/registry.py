"""Names the queries, hands them their tables and keeps the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def _dates_as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) if kind == "date" else F.col(f"`{c}`") for c, kind in df.dtypes])


def query(name: str, sql: str | None = None, dates: str = ""):
    """Registers f(tables) under a name. dates: columns of the SQL that are dates; both sides give them as text."""

    def add(f):
        QUERIES[name] = lambda spark, folder: _dates_as_text(f(Tables(spark, folder)))
        if sql is not None:
            text = ", ".join(f'CAST("{d}" AS VARCHAR) AS "{d}"' for d in dates.split())
            ORACLES[name] = f"SELECT * REPLACE ({text}) FROM ({sql})" if dates else sql
        return f

    return add
