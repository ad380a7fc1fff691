import pytest
from pyspark.sql import functions as F

from noetik.functions import text as X
from noetik.operators import filters, jobs, joins, policy, postings, windows
from noetik.streaming import streams


def test_plans_with_unknown_parts_are_rejected(spark):
    df = spark.range(3)
    for bad in ({"id": {"drop": 1}}, {"nope": {"eq": 1}}):
        with pytest.raises(filters.RejectedPlan):
            filters.search(df, bad)


def test_a_missing_state_is_not_the_state(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    states = spark.createDataFrame([(1, "visited"), (2, "wanted")], "k int, state string")
    assert {r.k for r in filters.in_state(filters.with_state(df, states, "k"), "visited", negate=True).collect()} == {2, 3}


def test_range_claims(spark):
    df = spark.createDataFrame([(70, 90), (90, 120), (140, 160)], "lo int, hi int")
    assert [r.m for r in df.select(filters.range_match(F.col("lo"), F.col("hi"), 100).alias("m")).collect()] == ["full", "partial", None]


def test_merge_chains_and_cycles(spark):
    m = spark.createDataFrame([("b", "a"), ("a", "c"), ("x", "y"), ("y", "x")], "id string, merged_into string")
    assert {r.id: r.canonical for r in joins.merge_closure(m).collect()} == {"b": "c", "a": "c", "x": None, "y": None}


def test_long_chains_and_odd_cycles(spark):
    chain = [(k, k + 1) for k in range(1, 150)]
    cycles = [(1001, 1002), (1002, 1003), (1003, 1001), (1004, 1001), (1005, 1005)]
    got = {r.id: r.canonical for r in joins.merge_closure(spark.createDataFrame(chain + cycles, "id long, merged_into long")).collect()}
    assert got == {k: 150 for k, _ in chain} | {k: None for k, _ in cycles}


def test_a_hash_that_comes_back_is_a_change(spark):
    df = spark.createDataFrame([("s", 1, "A"), ("s", 2, "A"), ("s", 3, "B"), ("s", 4, "A")], "k string, t int, h string")
    assert [r.t for r in windows.changes(df, "k", ["t"], "h").orderBy("t").collect()] == [1, 3, 4]


def test_second_sync_changes_nothing(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert jobs.sync(df, df, "k", "v").isEmpty()


def test_a_source_rule_wins(spark):
    sources = spark.createDataFrame([(123, "x", "c", "t"), (124, "x", "c", "t")], "source_id long, creator_id string, collection_id string, title string")
    rules = spark.createDataFrame([(1, "creator", "x", "metadata_only", 9, 1), (2, "source_always", "123", "process", 0, 1)], "rule_id int, kind string, target string, action string, priority int, created_at_ms int")
    assert {r.source_id: (r.action, r.rule_id) for r in policy.decide(sources, rules).collect()} == {123: ("process", 2), 124: ("metadata_only", 1)}


def test_han_bigrams(spark):
    df = spark.createDataFrame([("旺角日料 ok 茶",)], "t string")
    assert df.select(X.cjk_bigrams(F.col("t"))).first()[0] == ["旺角", "角日", "日料", "茶"]


def test_phrases_are_found_wherever_they_are_cut(spark, tmp_path):
    texts = {1: "a lengthy passage that runs unbrokenly on.", 2: "passage", 3: "lengthy unbroken", 4: "--a lengthy passage--", 5: None, 6: "", 7: "xlengthy passages"}
    phrases = {1: "a lengthy passage that runs unbroken", 2: "engthy passage that", 3: "unbroken", 4: "lengthy passage", 5: "--", 6: "", 7: None, 8: ". lengthy", 9: "a lengthy passage"}
    docs = spark.createDataFrame(list(texts.items()), "doc int, body string")
    index = postings.PostingsIndex(spark, str(tmp_path / "i"))
    index.update(docs, "doc", F.col("body"))
    got = index.phrases(spark.createDataFrame(list(phrases.items()), "pid int, p string"), docs).collect()
    want = sorted((i, k) for i, t in texts.items() for k, p in phrases.items() if t is not None and p is not None and p in t)
    assert sorted((r.doc, r.pid) for r in got) == want


def test_overlaps_count_once(spark):
    a = spark.createDataFrame([(1, 1, 0, 100), (1, 2, 90, 95)], "k int, a int, ls long, le long")
    b = spark.createDataFrame([(1, 7, 50, 250), (1, 8, 101, 102)], "k int, b int, rs long, re long")
    assert {(r.a, r.b) for r in joins.overlapping(a, b, ["k"], 30).collect()} == {(1, 7), (2, 7)} and joins.overlapping(a, b, ["k"], 30).count() == 2


def test_stream_windows_and_upsert(spark, tmp_path):
    events = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(events).schema
    folder = tmp_path / "in"
    spark.read.parquet(events).write.parquet(str(folder))
    stream = streams.read_events(spark, str(folder), schema)
    q = streams.window_counts(stream, "1 hour", "10 minutes", "event_type").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == spark.read.parquet(events).count()
    streams.upsert(stream, str(tmp_path / "out"), ["user_id"], "ts", str(tmp_path / "cp")).awaitTermination()
    now = streams.current(spark, str(tmp_path / "out"), ["user_id"], "ts")
    assert now.count() == spark.read.parquet(events).select("user_id").distinct().count()
