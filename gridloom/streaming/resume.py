"""Exactly-once shard streams: a file stream that remembers its place, and an idempotent sink by shard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_shards(spark: SparkSession, source: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream over Parquet shards, a bounded number of files a micro-batch, with each row's shard."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    return rows.withColumn("shard", F.element_at(F.split(F.input_file_name(), "/"), -1))


def write_once(stream: DataFrame, out: str, checkpoint: str):
    """Process what is there and stop; a batch overwrites only the folders of its own shards, so a replay repeats nothing.

    That holds even where the stream's checkpoint is lost, since folders are named by shard and not by batch.
    """

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(out)

    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def running_accuracy(stream: DataFrame, out: str, checkpoint: str, reset: str = "epoch"):
    """A running count and accuracy of (epoch, label, pred) by epoch, which starts anew with each; the whole state is one row an epoch.

    Each micro-batch replaces the rows of the epochs that it changed under ``out``.
    """
    right = (F.col("label") == F.col("pred")).cast("double")
    totals = stream.groupBy(reset).agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"))

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(reset).parquet(out)

    query = totals.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def bounded(stream: DataFrame, quota: int, place: str = "place") -> DataFrame:
    """Rows of a stream whose place in their consumer's order is below a quota: an epoch of bounded length."""
    if quota < 1:
        raise ValueError("a quota is positive")
    return stream.where(F.col(place) < quota)
