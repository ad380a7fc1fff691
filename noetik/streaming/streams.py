"""Structured Streaming forms of sync, duplicate suppression and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of event files, with ts as a timestamp that a watermark can hold."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, size: str, late: str, *by: str, slide: str | None = None) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide or size), *by).agg(F.count("*").alias("n"))


def activity(events: DataFrame, gap: str, late: str, key: str = "user_id") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))


def without_duplicates(events: DataFrame, late: str, key: list[str]) -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def upsert(stream: DataFrame, path: str, key: list[str], order: str, checkpoint: str) -> StreamingQuery:
    """Append the newest row of each key of each batch; a batch that comes again writes the same files once more."""

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
        newest.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, key: list[str], order: str) -> DataFrame:
    """The newest row of each key over all appended batches, by event time and never by arrival."""
    rows = spark.read.parquet(path)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order), F.desc("batch")))).where("_n = 1").drop("_n", "batch")
