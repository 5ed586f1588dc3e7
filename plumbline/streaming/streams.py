"""Streaming forms of the append-shaped operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from plumbline.sources.io import TRACE, upsert


def stream_traces(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Traces as files are appended."""
    return spark.readStream.schema(TRACE).option("maxFilesPerTrigger", max_files).json(path)


def sink_verdicts(verdicts: DataFrame, path: str, checkpoint: str):
    """Appends by verdict until all available input is done."""
    return verdicts.writeStream.partitionBy("verdict").format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def increments(rows: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """Rows without replays: a key counts once within the watermark."""
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


class _Files:
    """What there is at a path of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.system = self.path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def there(self) -> bool:
        return self.system.exists(self.path)

    def remove(self) -> None:
        self.system.delete(self.path, True)


def upsert_batch(batch: DataFrame, number: int, path: str, keys: list[str], order: str, buckets: int) -> None:
    """Upserts a micro-batch into a Parquet folder of key buckets: only buckets that it touches are rewritten.

    Their new content is staged under the batch's number first. A batch that comes again with a stage takes that, so one that was
    interrupted while buckets were exchanged is brought to its end, and one that was done changes nothing.
    """
    spark, stage = batch.sparkSession, f"{path}-stage/{number}"
    if not _Files(spark, f"{stage}/_SUCCESS").there():
        rest = [c for c in batch.columns if c not in keys]
        newest = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*").select(batch.columns)
        newest = newest.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        merged = newest
        if _Files(spark, path).there():
            touched = [r[0] for r in newest.select("_bucket").distinct().collect()]  # at most `buckets`
            old = spark.read.schema(newest.schema).parquet(path).where(F.col("_bucket").isin(touched))
            merged = upsert(old, newest, keys)
        merged.write.mode("overwrite").partitionBy("_bucket").parquet(stage)
    staged = spark.read.parquet(stage)
    staged.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)
    _Files(spark, f"{path}-stage/{number - 2}").remove()  # the one before may still be asked for


def sink_upsert(rows: DataFrame, path: str, keys: list[str], checkpoint: str, order: str, buckets: int = 16):
    """Each micro-batch is upserted by key; the later row of a key in a batch counts."""
    return rows.writeStream.foreachBatch(lambda batch, number: upsert_batch(batch, number, path, keys, order, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tally(issues: DataFrame) -> DataFrame:
    """Running counts by tool and parameter; for update mode."""
    return issues.groupBy("tool", "param").agg(F.count("*").alias("hits"), F.min("record").alias("first_record"))


MEMORY = "fingerprint string, root_cause string, label string, status string, weight double, hits long"


class _Experience(StatefulProcessor):
    """Per fingerprint a map from cause to its label, hits and weight, in the state store; one entry is read or written at a time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.causes = handle.getMapState("causes", "root_cause string", "label string, hits long, weight double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        touched = set()
        for r in pd.concat(list(rows)).sort_values(["asof", "root_cause"]).itertuples(index=False):
            for (cause,), (label, hits, weight) in list(self.causes.iterator()):
                if hits >= 2 and label != r.label:
                    self.causes.updateValue((cause,), (label, hits, weight / 2))
                    touched.add(cause)
            known = (r.root_cause,)
            label, hits, weight = self.causes.getValue(known) if self.causes.containsKey(known) else (r.label, 0, 1.0)
            self.causes.updateValue(known, (label, hits + 1, weight))
            touched.add(r.root_cause)
        out = [(key[0], cause, *self.causes.getValue((cause,))) for cause in sorted(touched)]
        yield pd.DataFrame([(f, c, label, "confirmed" if hits >= 2 else "pending", weight, hits) for f, c, label, hits, weight in out], columns=[c.split()[0] for c in MEMORY.split(", ")])

    def close(self) -> None:
        pass


def memory(observations: DataFrame) -> DataFrame:
    """Experience as state per fingerprint: pending, confirmed by the second sight, halved by each later sight of another label.

    Gives the entries that a micro-batch changed. Inside one, observations are taken in order of (asof, root_cause). Needs the
    RocksDB state store.
    """
    return observations.groupBy("fingerprint").transformWithStateInPandas(_Experience(), MEMORY, "Update", "None")


def to_end(query, seconds: int | None = None, done: Callable[[], None] | None = None) -> None:
    """Waits until all is written; with a limit, a query that takes longer is stopped and an error raised."""
    if seconds is None:
        query.awaitTermination()
    elif not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"the stream took longer than {seconds} seconds")
    if done:
        done()
