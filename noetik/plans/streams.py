"""Queries that run as streams over events, in several runs from one checkpoint."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import checkpoint_folder
from ..sources import tables as T
from ..streaming import stateful, streams
from .registry import query

RUNS = 3
#: Events arrive k minutes after their time, k from their props.
ARRIVALS = "SELECT event_id, user_id, event_type, epoch_us(ts) AS at_us, epoch_us(ts) + 60000000 * CAST(json_extract_string(props, '$.k') AS BIGINT) AS arrived_us FROM events"


def arrivals(s, d):
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    at = F.unix_micros("ts")
    return T.saves(s, d).select("event_id", F.col("user_id").alias("key"), "ts", F.col("state").alias("event_type"), at.alias("at_us"), (at + 60_000_000 * k).alias("arrived_us"))


def replay(s, d, start, mode: str = "append", repeat: bool = False) -> str:
    """Run a stream over events in RUNS parts by arrival, each a run that goes on from the checkpoint of the one before.
    start(stream) gives the stream's result. With repeat a tenth of the rows arrives again in the last part."""
    rows, home = arrivals(s, d), f"{checkpoint_folder(s)}/stream-{uuid.uuid4().hex}"
    low, high = rows.agg(F.min("arrived_us"), F.max("arrived_us")).first()
    step = max(1, ((high or 0) - (low or 0)) // RUNS + 1)
    for k in range(RUNS):
        part = rows.where(F.floor((F.col("arrived_us") - F.lit(low)) / step) == k) if low is not None else rows
        if repeat and k == RUNS - 1:
            part = part.unionByName(rows.where("event_id % 10 = 0"))
        part.write.mode("append").parquet(f"{home}/in")
        stream = s.readStream.schema(rows.schema).parquet(f"{home}/in")
        stateful.keep(start(stream), f"{home}/out", f"{home}/checkpoint", mode).awaitTermination()
    return f"{home}/out"


@query("late_snapshots", f"SELECT user_id, event_id, newest - at_us AS behind_us FROM (SELECT *, max(at_us) OVER (PARTITION BY user_id ORDER BY arrived_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM ({ARRIVALS})) WHERE newest > at_us")
def _(s, d):
    """Events that arrive after a later one of the same user."""
    out = replay(s, d, stateful.late_rows)
    return s.read.parquet(out).select(F.col("key").alias("user_id"), "event_id", "behind_us")


@query("stream_sessions", f"SELECT user_id, min(at_us) AS begin_us, max(at_us) AS end_us, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY at_us, event_id) AS session FROM (SELECT *, CASE WHEN at_us - lag(at_us) OVER (PARTITION BY user_id ORDER BY at_us, event_id) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM ({ARRIVALS}))) GROUP BY user_id, session")
def _(s, d):
    """Sessions of each user, whatever order events arrive in."""
    out = replay(s, d, lambda stream: stateful.sessions(stream, 1800, "3 hours"), "update")
    found = stateful.newest(s.read.parquet(out), ["key", "begin_us"]).where("n > 0")
    return found.select(F.col("key").alias("user_id"), "begin_us", "end_us", "n")


@query("stream_distinct", f"SELECT event_type, count(*) AS n FROM ({ARRIVALS}) GROUP BY event_type")
def _(s, d):
    """Events counted once, though a tenth of them arrives again."""
    out = replay(s, d, lambda stream: streams.without_duplicates(stream, "400 days", ["event_id"]).select("event_id", "event_type"), repeat=True)
    return s.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@query("stream_sync", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY user_id")
def _(s, d):
    """The last state of each user, from batches that are merged as they come."""
    best = lambda stream: stream.select("key", "event_id", "event_type", "at_us")
    rows = s.read.parquet(replay(s, d, best))
    return rows.groupBy(F.col("key").alias("user_id")).agg(F.max_by("event_type", F.struct("at_us", "event_id")).alias("state"))
