"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.shared import checkpoint_folder

#: Words are maximal runs of anything but space and the characters 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder that the cluster names; sets one of its own only in local mode (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(spark))


def checkpointed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df by its checkpoint; rows: about how many narrow rows it has, where known, so that few rows make few files."""
    ensure_checkpoint_dir(df.sparkSession)
    return (df if rows is None else df.coalesce(rows // 500_000 + 1)).checkpoint(eager=True)


def crc_mod(column: str, divisor: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def slices(batches: Iterator[pd.DataFrame], rows: int = 1000) -> Iterator[pd.DataFrame]:
    """The batches in parts of at most so many rows, so that what is made of them stays small in a worker."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.iloc[i : i + rows]


def give_back() -> None:
    """Hands memory that is free in this worker back to the system, so that it stays small while it waits for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()  # Arrow keeps what batches were in, apart from the C library
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library that Linux has, as a rule
    if trim is not None:
        trim(0)


def own_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of df is called so (names don't differ by case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def spread_join(big: DataFrame, small: DataFrame, on: str, by: tuple[str, ...], how: str = "inner", counted: DataFrame | None = None, rows: int | None = None, least: int = 256, shares: int = 100_000) -> DataFrame:
    """big joined with small, where `on` is unique in small but may be very frequent in big.

    A key that has more than `least` rows and more than one in `shares` of all rows of big is dealt to
    several tasks, by a digest of the columns `by`; its row of small goes to each. There are at most
    `shares` such keys, so their table may be sent to every task. counted: rows with the keys of big,
    where big itself isn't cheap to read twice; rows: how many, where known.
    """
    counted = big if counted is None else counted
    rows = counted.count() if rows is None else rows
    if rows <= least:
        return big.join(small, on, how)
    limit = max(least, rows // shares)
    key, deals, deal = own_names(big, "spread_key", "spread_deals", "spread_deal")
    hot = counted.groupBy(F.col(on).alias(key)).agg(F.count("*").alias(deals)).where(F.col(deals) > limit).withColumn(deals, F.ceil(F.col(deals) / limit).cast("int"))
    found = hot.collect()  # at most `shares` rows
    if not found:
        return big.join(small, on, how)
    hot = big.sparkSession.createDataFrame(found, hot.schema)
    dealt = big.join(F.broadcast(hot), F.col(on) == F.col(key), "left").withColumn(deal, F.pmod(F.xxhash64(*by), F.coalesce(deals, F.lit(1))).cast("int")).drop(key, deals)
    held = small.join(F.broadcast(hot), F.col(on) == F.col(key), "left").withColumn(deal, F.explode(F.sequence(F.lit(0), F.coalesce(deals, F.lit(1)) - 1))).drop(key, deals)
    return dealt.join(held, [on, deal], how).drop(deal)
