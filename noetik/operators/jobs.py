"""Job queue, state machines and inventory sync as append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enqueue(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """New jobs whose dedupe key no queued or running job holds, one for each key."""
    active = jobs.where(F.col("status").isin("queued", "running")).select("dedupe_key")
    first = Window.partitionBy("dedupe_key").orderBy("id")
    return new.join(active, "dedupe_key", "left_anti").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def stale(jobs: DataFrame, now_ms: int, lease_ms: int) -> DataFrame:
    return jobs.where((F.col("status") == "running") & (F.col("locked_at_ms") + lease_ms < now_ms))


def claim(jobs: DataFrame, worker: str, now_ms: int, lease_ms: int, n: int) -> DataFrame:
    """The next n jobs as rows to append: queued ones that are due, and running ones whose lease is over, which count one
    attempt more. One writer asks at a time; Spark is no lock manager."""
    over = (F.col("status") == "running") & (F.col("locked_at_ms") + lease_ms < now_ms)
    due = jobs.where((F.col("available_at_ms") <= now_ms) & ((F.col("status") == "queued") | over))
    first = due.orderBy(F.desc("priority"), "available_at_ms", "job_id").limit(n)
    return first.select("job_id", F.lit(worker).alias("worker"), F.lit(now_ms).cast("long").alias("locked_at_ms"), F.when(F.col("status") == "running", 1).otherwise(0).alias("attempt"))


def backoff(attempt: Column, base_ms: int, most_ms: int) -> Column:
    return F.least(F.lit(base_ms) * F.pow(F.lit(2), attempt), F.lit(most_ms)).cast("long")


def bad_transitions(df: DataFrame, key: str, order: list[str], state: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """Rows whose state may not follow the one before."""
    moved = df.withColumn("before", F.lag(state).over(Window.partitionBy(key).orderBy(*order))).where("before is not null")
    pairs = df.sparkSession.createDataFrame(allowed, f"before string, {state} string")
    return moved.join(F.broadcast(pairs), ["before", state], "left_anti")  # the table of states


def sync(current: DataFrame, incoming: DataFrame, key: str, value: str) -> DataFrame:
    """key, change: new, changed or missing; equal rows are left out, so a second sync changes nothing."""
    both = current.select(key, F.col(value).alias("_o"), F.lit(True).alias("_c")).join(incoming.select(key, F.col(value).alias("_n"), F.lit(True).alias("_i")), key, "full")
    change = F.when(F.col("_c").isNull(), "new").when(F.col("_i").isNull(), "missing").when(~F.col("_o").eqNullSafe(F.col("_n")), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def key_duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def all_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(F.coalesce(*[F.col(c).cast("string") for c in columns]).isNull())


def manifest(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and an order-free digest, to compare a projection with its rebuild."""
    return df.agg(F.count("*").alias("n_rows"), F.sum(F.crc32(F.concat_ws("|", *columns).cast("binary"))).alias("digest"))


def backup(tables: dict[str, DataFrame], path: str) -> None:
    """Each table and, once all are written, a manifest with its rows and digest; a folder without one is no backup."""
    done = []
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
        m = manifest(df.sparkSession.read.parquet(f"{path}/{name}"), df.columns).first()
        done.append((name, m["n_rows"], m["digest"]))
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame(done, "name string, n_rows long, digest long").coalesce(1).write.parquet(f"{path}/manifest")


def restore(spark, path: str) -> dict[str, DataFrame]:
    """The tables of a backup, each checked against the manifest."""
    out = {}
    for r in spark.read.parquet(f"{path}/manifest").collect():  # a row for each table
        df = spark.read.parquet(f"{path}/{r['name']}")
        m = manifest(df, df.columns).first()
        if (m["n_rows"], m["digest"]) != (r["n_rows"], r["digest"]):
            raise ValueError(f"{r['name']} is not what was backed up")
        out[r["name"]] = df
    return out
