"""The model's tables as views over stored Parquet tables; only the columns a query uses are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sources(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("source_id"), F.col("source").alias("creator_id"), F.col("lang").alias("collection_id"), F.col("text").alias("body"), F.col("n_chars")
    )


def entities(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("canonical_name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("entity_type"), F.col("p_size").alias("size")
    )


def claims(spark: SparkSession, folder: str) -> DataFrame:
    """One claim for each order line: the quantity and the unit price of an entity, with its source and its time."""
    unit = F.round(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100  # SQL rounds the scaled double, F.round(x, 2) its decimal digits
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("source_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("entity_id"), F.col("l_suppkey").alias("attributed_to"),
        F.col("l_quantity").alias("quantity"), unit.alias("price"), F.col("l_discount").alias("confidence"), F.col("l_returnflag").alias("claim_kind"),
        F.col("l_linestatus").alias("run_status"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("valid_from_ms"),
    )


def saves(spark: SparkSession, folder: str) -> DataFrame:
    """Events as user states: event_type is the state, ts its time."""
    return table(spark, folder, "events").select("event_id", "user_id", F.col("event_type").alias("state"), F.col("ts").cast("timestamp").alias("ts"), "value", "props")


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations")


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    """A unit for each line of a source, with its offsets."""
    lines = sources(spark, folder).select("source_id", F.posexplode(F.split("body", "\n")).alias("ordinal", "raw_text"))
    return lines.withColumn("length", F.length("raw_text").cast("long"))
