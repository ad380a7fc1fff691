"""Rows in relation to their neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def changes(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before, the first included; a value that comes back is a change."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_p", F.lag(value).over(w)).withColumn("_r", F.row_number().over(w)).where((F.col("_r") == 1) | ~F.col("_p").eqNullSafe(F.col(value))).drop("_p", "_r")


def cap(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def ranked(df: DataFrame, by: list[str], order: list[Column], into: str = "rank") -> DataFrame:
    return df.withColumn(into, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def ranked_wide(df: DataFrame, by: list[str], order: list[Column], into: str = "rank") -> DataFrame:
    """ranked() for groups too large for one task: rows are dealt by ranges of the order, ranked inside each range, and
    moved up by the rows of the group in the ranges before. The ranges are stored, so that both passes see the same."""
    dealt = cut(df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_p", F.spark_partition_id()))
    counts = dealt.groupBy("_p", *by).agg(F.count("*").alias("_c"))
    before = counts.withColumn("_b", F.sum("_c").over(Window.partitionBy(*by).orderBy("_p")) - F.col("_c")).drop("_c")
    inside = dealt.withColumn("_i", F.row_number().over(Window.partitionBy("_p", *by).orderBy(*order)))
    return inside.join(before, ["_p", *by]).withColumn(into, F.col("_i") + F.col("_b")).drop("_p", "_i", "_b")


def chunked(df: DataFrame, key: str, order: list[str], length: str, budget: int) -> DataFrame:
    """df with the number of its chunk: a new one whenever the length before a row passes a multiple of the budget."""
    before = F.coalesce(F.sum(length).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_b", F.floor(before / budget)).withColumn("chunk", F.dense_rank().over(Window.partitionBy(key).orderBy("_b"))).drop("_b")


def share(df: DataFrame, by: list[str], within: list[str]) -> DataFrame:
    counted = df.groupBy(*within, *by).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*within)))


def sessions(df: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """df with the number of its session; a gap of at least the limit begins a new one."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    new = (F.col(ts).cast("double") - F.lag(F.col(ts).cast("double")).over(w) >= gap_seconds).cast("int")
    return df.withColumn("_s", F.coalesce(new, F.lit(1))).withColumn("session", F.sum("_s").over(w)).drop("_s")
