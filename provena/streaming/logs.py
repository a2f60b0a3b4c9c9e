"""Structured Streaming over the append-only logs: evidence, memory, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream; each trigger takes a bounded number of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def fresh(rows: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Each key once, with state kept only as long as rows may be late."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def rates(rows: DataFrame, time: str, by: list[str], window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(by, start, calls, total) by tumbling window, once the watermark has passed it."""
    counted = rows.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count("*").alias("calls"), F.sum("value").alias("total"))
    return counted.select(*by, F.col("window.start").alias("start"), "calls", "total")


def latest(rows: DataFrame, keys: list[str], time: str) -> DataFrame:
    """The newest value of each key: complete mode, or update mode into a keyed sink."""
    return rows.groupBy(*keys).agg(F.max_by("value", time).alias("value"), F.max(time).alias("at"), F.count("*").alias("readings"))


def run_once(df: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Everything there is now, appended to Parquet files in ``folder`` and read again."""
    q = df.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def upsert_into(folder: str, keys: list[str], time: str):
    """A foreachBatch sink: each batch's newest rows by key are a folder of their epoch, written again if the epoch is repeated; ``merged`` reads them."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.groupBy(*keys).agg(F.max_by("value", time).alias("value"), F.max(time).alias(time)).write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")

    return put


def merged(spark: SparkSession, folder: str, keys: list[str], time: str) -> DataFrame:
    """The newest value of each key over all epochs that ``upsert_into`` wrote."""
    return spark.read.parquet(folder).groupBy(*keys).agg(F.max_by("value", time).alias("value"), F.max(time).alias(time))
