"""Stateful streams: restarts, timers, late rows."""

import random

import pytest

from noetik.streaming import stateful

SHAPE = "event_id long, key long, ts timestamp, at_us long, arrived_us long"
BASE = 1_700_000_000_000_000


def write(spark, folder, rows):
    df = spark.createDataFrame(rows, "event_id long, key long, at_us long, arrived_us long").selectExpr("event_id", "key", "timestamp_micros(at_us) AS ts", "at_us", "arrived_us")
    df.coalesce(1).write.mode("append").parquet(folder)


def late(rows):
    newest, out = {}, set()
    for e, k, at, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        if k in newest and at < newest[k]:
            out.add((k, e, newest[k] - at))
        newest[k] = max(at, newest.get(k, at))
    return out


def sessions(rows, gap):
    by, out = {}, set()
    for _, k, at, _ in rows:
        by.setdefault(k, []).append(at)
    for k, times in by.items():
        run = []
        for t in sorted(times):
            if run and t - run[-1] >= gap:
                out.add((k, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        out.add((k, run[0], run[-1], len(run)))
    return out


@pytest.fixture
def rows():
    rng = random.Random(4)
    out = []
    for e in range(300):
        at = BASE + rng.randrange(40_000) * 1_000_000
        out.append((e, rng.randrange(6), at, at + rng.randrange(7200) * 1_000_000))
    return sorted(out, key=lambda r: (r[3], r[0]))


def test_late_rows_after_a_failed_batch(spark, tmp_path, rows):
    """A batch whose sink fails comes again after the restart; nothing is lost, nothing twice."""
    home, failed = str(tmp_path), []

    def start(fail):
        stream = stateful.late_rows(spark.readStream.schema(SHAPE).parquet(f"{home}/in"))

        def sink(batch, number):
            batch.write.mode("overwrite").parquet(f"{home}/out/batch={number}")
            if fail:
                failed.append(number)
                raise OSError("the executor is gone")

        return stream.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()

    for k in range(4):
        write(spark, f"{home}/in", rows[75 * k : 75 * (k + 1)])
        if k in (1, 3):
            with pytest.raises(Exception, match="the executor is gone"):
                start(True).awaitTermination()
        start(False).awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(f"{home}/out").drop("batch").collect()]
    assert failed and len(got) == len(set(got)) and set(got) == late(rows) and len(got) > 50


def test_sessions_close_by_timers(spark, tmp_path, rows):
    home, gap = str(tmp_path), 600
    for k in range(5):
        # the last part moves the watermark past all sessions
        part = rows[75 * k : 75 * (k + 1)] if k < 4 else [(9999, 99, BASE + 10**12, BASE + 10**12)]
        write(spark, f"{home}/in", part)
        stream = stateful.sessions(spark.readStream.schema(SHAPE).parquet(f"{home}/in"), gap, "3 hours")
        stateful.keep(stream, f"{home}/out", f"{home}/checkpoint", "update").awaitTermination()
    found = stateful.newest(spark.read.parquet(f"{home}/out"), ["key", "begin_us"]).where("n > 0").collect()
    assert {(r.key, r.begin_us, r.end_us, r.n) for r in found if r.key != 99} == sessions(rows, gap * 1_000_000)
    assert all(r.closed for r in found if r.key != 99)
