"""Streams with state of their own: changes that come late, and sessions with timers.

State is kept for each key. What a key's rows of one batch need is held at once, so a batch is bounded by the files that a
trigger takes. Sinks write a folder for each batch and overwrite it when the batch comes again, so a restart from the
checkpoint neither loses nor repeats rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LateRows(StatefulProcessor):
    """Rows whose time is before that of a row that has arrived earlier. Rows: event_id, at_us, arrived_us."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "at_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows).sort_values(["arrived_us", "event_id"])
        before = self.newest.get()[0] if self.newest.exists() else None
        reached = batch["at_us"].cummax().shift(1)
        if before is not None:
            reached = reached.fillna(before).clip(lower=before)
        late = batch[batch["at_us"] < reached]
        newest = int(batch["at_us"].max())
        self.newest.update((newest if before is None else max(newest, before),))
        if len(late):
            yield pd.DataFrame({"key": key[0], "event_id": late["event_id"], "behind_us": (reached[late.index] - late["at_us"]).astype("int64")})

    def close(self) -> None:
        pass


class Sessions(StatefulProcessor):
    """Sessions of a key: a gap of at least gap_us begins a new one, whatever order rows come in. Each batch gives the
    sessions that it changes, and n = 0 for those that another one has taken in. Once the watermark is a gap past the end of
    sessions a timer closes them, and their state goes. A key has a timer for its earliest end only, which sets the next: a
    timer of its own for each session costs a call each, there and back. Rows: at_us."""

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "begin_us long, end_us long, n long")

    def wait(self, found) -> None:
        """Wake up when the earliest of some sessions, which are in order and apart, can be closed."""
        self.handle.registerTimer((found[0][1] + self.gap) // 1000 + 1)

    @staticmethod
    def rows(key, found) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *f) for f in found], columns=["key", "begin_us", "end_us", "n", "closed"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = [tuple(map(int, x)) for x in self.open.get()]
        single = [(int(t), int(t), 1) for part in rows for t in part["at_us"]]
        merged: list[tuple[int, int, int]] = []
        for begin, end, n in sorted(known + single):
            if merged and begin - merged[-1][1] < self.gap:
                last = merged.pop()
                merged.append((last[0], max(last[1], end), last[2] + n))
            else:
                merged.append((begin, end, n))
        self.open.put(merged)
        old, begins = set(known), {m[0] for m in merged}
        if not known or merged[0][1] < known[0][1]:  # else the timer that is set comes in time
            self.wait(merged)
        out = [(*m, False) for m in merged if m not in old] + [(b, e, 0, False) for b, e, _ in known if b not in begins]
        if out:
            yield self.rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        known = [tuple(map(int, x)) for x in self.open.get()]
        done = [m for m in known if m[1] + self.gap <= now]
        left = known[len(done) :]
        if left:
            if done:
                self.open.put(left)
            self.wait(left)
        elif done:
            self.open.clear()
        if done:
            yield self.rows(key, [(*m, True) for m in done])

    def close(self) -> None:
        pass


def stateful(spark: SparkSession) -> None:
    """State in a store that can hold several states of a key."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def late_rows(events: DataFrame) -> DataFrame:
    """key, event_id, behind_us. events: key, event_id, at_us, arrived_us."""
    stateful(events.sparkSession)
    return events.groupBy("key").transformWithStateInPandas(LateRows(), f"key {dict(events.dtypes)['key']}, event_id long, behind_us long", "Append", "None")


def sessions(events: DataFrame, gap_seconds: int, late: str) -> DataFrame:
    """key, begin_us, end_us, n, closed, as the sessions change. events: key, ts (of the watermark), at_us."""
    stateful(events.sparkSession)
    shape = f"key {dict(events.dtypes)['key']}, begin_us long, end_us long, n long, closed boolean"
    return events.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(Sessions(gap_seconds * 1_000_000), shape, "Update", "EventTime")


def keep(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Each batch as a folder of a table; a batch that comes again replaces its folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(rows: DataFrame, key: list[str]) -> DataFrame:
    """The last state of each key over all batches; within one the closed row."""
    order = Window.partitionBy(*key).orderBy(F.desc("batch"), F.desc("closed"))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
