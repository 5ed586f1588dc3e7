"""A folder that driver and executors share, for what a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a new local one only in local mode (tests)."""
    if base := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the checkpoint folder."""
    return f"{checkpoint_folder(spark)}/written-{uuid.uuid4()}"


def written(df: DataFrame, into: SparkSession | None = None) -> DataFrame:
    """df written to the shared folder and read again (by the session `into`, else by its own), so that several uses share one computation."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return (into or df.sparkSession).read.schema(df.schema).parquet(path)


#: What tells how many rows tasks take at a time, into Python and from files.
BATCHES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")


@contextmanager
def rows_at_a_time(spark: SparkSession, rows: int) -> Iterator[SparkSession]:
    """Within, tasks of jobs that this session runs take so many rows at a time; gives a session whose tasks always do, and else has this one's number of partitions."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    before = {c: spark.conf.get(c) for c in BATCHES}
    try:
        for c in BATCHES:
            own.conf.set(c, rows)
            spark.conf.set(c, rows)
        yield own
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)
