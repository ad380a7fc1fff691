"""Providers, questions, vectors, streams and joins against plain computations."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from noetik import providers
from noetik.functions import text as X
from noetik.operators import answers, jobs, joins, policy, search, vectors
from noetik.plans import catalog
from noetik.streaming import streams


def test_a_failed_row_does_not_fail_its_batch(spark):
    capture = providers.FakeCapture({"k": [{"external_id": "a"}, {"external_id": "b", "fail": "retryable"}, {"external_id": "c", "fail": "terminal"}]})
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4), (None, 5)], "id string, error int")
    got = providers.call(df, "id", lambda x: json.dumps(capture.fetch_source(x)), "detail")
    assert got.columns == ["id", "detail", "error"]
    assert {r.id: (r.detail is not None, r.error) for r in got.collect()} == {"a": (True, None), "b": (False, "retryable"), "c": (False, "terminal"), "d": (False, "terminal"), None: (False, None)}
    assert capture.health() == "ok" and providers.FakeCapture(down=True).health() == "down"
    assert capture.list_collections() == [{"external_id": "k", "n": 3}] and capture.acquire_media("a") == "media/a"


def test_structured_results_are_checked(spark):
    model = providers.Registry(extraction_model=providers.FakeModel()).get("extraction_model")
    df = spark.createDataFrame([("one two three four",), ("BROKEN",), ("",)], "text string")
    out = providers.structured(providers.call(df, "text", model.extract), "result", "title string, n_words int").collect()
    assert {r.text: (r.title, r.n_words, r.invalid) for r in out} == {"one two three four": ("one two three", 4, False), "BROKEN": (None, None, True), "": ("", 0, False)}
    odd = spark.createDataFrame([('{"title": "x"}',), ("7",), (None,)], "result string")
    assert [r.invalid for r in providers.structured(odd, "result", "title string, n_words int").collect()] == [True, True, True]
    with pytest.raises(ValueError):
        providers.Registry(nobody=1)
    with pytest.raises(KeyError):
        providers.Registry().get("answer_model")


def test_capture_source(spark, tmp_path):
    (tmp_path / "food.jsonl").write_text('{"external_id": "1", "title": "Noodles"}\n\n{"external_id": "2"}\n')
    (tmp_path / "tools.jsonl").write_text('{"external_id": "3", "title": "Kit"}\n')
    spark.dataSource.register(providers.CaptureSource)
    rows = spark.read.format("capture").option("path", str(tmp_path)).load().collect()
    assert {tuple(r) for r in rows} == {("food", "1", "Noodles"), ("food", "2", None), ("tools", "3", "Kit")}


def test_questions_become_requests():
    r = answers.parse("Find my saved cheap restaurants in Mong Kok under HKD 100 that I have not visited", ("Mong Kok",))
    assert (r.intents, r.scope, r.entity_types) == (["find"], "personal_required", ["restaurant"])
    assert r.constraints == {"city": "Mong Kok", "price_max": 100} and r.user_state == {"visited": False} and r.semantic == ["cheap"]
    assert answers.shape(r) == "mixed"
    assert answers.shape(answers.parse("What is MCP in general?")) == "general"
    assert answers.parse("综合我收藏过的 Agent 视频，它们共同提到了哪些趋势？").intents[0] in ("find", "synthesize")
    assert answers.shape(answers.parse("how long is the second one?")) == "follow_up"
    assert answers.shape(answers.parse("routes under 10")) == "structured" and answers.shape(answers.parse("something calm")) == "semantic"
    assert answers.parse("anything").constraints == {}


def test_index_keeps_versions_apart(spark, tmp_path):
    index = vectors.VectorIndex(spark, str(tmp_path / "index"))
    row = lambda *x: spark.createDataFrame(list(x), "object_type string, object_id long, vector array<double>, content_hash string")
    index.rebuild(row(("a", 1, [1.0, 0.0], "h1"), ("a", 2, [0.0, 1.0], "h2"), ("b", 1, [1.0, 1.0], "h3")))
    before = index.read()
    index.upsert(row(("a", 1, [0.0, 2.0], "h9"), ("b", 7, [3.0, 0.0], "h7")))
    assert before.count() == 3 and index.read().count() == 4
    index.delete(spark.createDataFrame([("a", 2)], "object_type string, object_id long"))
    assert [r.object_id for r in index.search([0.0, 1.0], 1, ["a"]).collect()] == [1]
    objects = spark.createDataFrame([("a", 1, "h9"), ("b", 1, "new"), ("c", 5, "x")], "object_type string, object_id long, content_hash string")
    assert {(r.object_type, r.object_id) for r in index.stale(objects).collect()} == {("b", 1), ("c", 5)}


def test_near_classes(spark):
    base = list(range(40))
    sets = {1: base, 2: base, 3: [*base[:-2], 100, 101], 4: base[:30], 5: [], 6: [], 7: [200], 8: base[::-1], 9: [*base[:-1], 7000]}
    for k in range(300):  # a hot token whose sets are not alike
        sets[1000 + k] = [5000, *range(10_000 + 7 * k, 10_000 + 7 * k + 5)]
    df = spark.createDataFrame([(k, [int(x) for x in v]) for k, v in sets.items()], "id long, tokens array<long>")
    got = {r.id: (r.class_id, r.n_links) for r in joins.near_classes(df, 80).collect()}
    classes = {}
    for k, v in sets.items():
        classes.setdefault(frozenset(v) if v else k, []).append(k)
    reps = {min(ids): s for s, ids in classes.items()}
    for s, ids in classes.items():
        n = 0 if isinstance(s, int) else sum(1 for o in reps.values() if not isinstance(o, int) and o != s and 5 * len(s & o) >= 4 * len(s | o))
        assert {got[i] for i in ids} == {(min(ids), n)}


@pytest.mark.parametrize("most", [10_000, 0])
def test_keyword_rules(spark, monkeypatch, most):
    """Few rules and many give the same decisions, as substrings and as words."""
    monkeypatch.setattr(policy, "MOST_KEYWORDS", most)
    titles = {1: "A Movie Clip", 2: None, 3: "", 4: "movie", 5: "clip of the clip", 6: "Été ÉTÉ"}
    sources = spark.createDataFrame([(k, t, "c", "k") for k, t in titles.items()], "source_id int, title string, creator_id string, collection_id string")
    targets = {1: "ovie cl", 2: "CLIP", 3: "clip", 4: "", 5: "été", 6: None, 7: "nothing"}
    rules = spark.createDataFrame([(k, "keyword", t, "metadata_only", k, 1) for k, t in targets.items()], "rule_id int, kind string, target string, action string, priority int, created_at_ms int")
    got = {(r.source_id, r.rule_id) for r in policy.matches(sources, rules, substrings=True).collect()}
    assert got == {(s, k) for s, t in titles.items() for k, x in targets.items() if t is not None and x is not None and x.lower() in t.lower()}
    got = {(r.source_id, r.rule_id) for r in policy.matches(sources, rules).where("rule_id <> 4").collect()}
    assert got == {(1, 3), (5, 3), (6, 5)}
    assert {r.source_id: r.rule_id for r in policy.decide(sources, rules, substrings=True).collect()} == {1: 4, 2: None, 3: 4, 4: 4, 5: 4, 6: 5}


def test_expired_leases_are_claimed_once_more(spark):
    rows = spark.createDataFrame([(1, "running", 1, 0, 10, "w"), (2, "running", 1, 0, 95, "w"), (3, "queued", 0, 0, None, None), (4, "queued", 9, 999, None, None)], "job_id int, status string, priority int, available_at_ms int, locked_at_ms int, worker string")
    assert [(r.job_id, r.attempt) for r in jobs.claim(rows, "x", 100, 50, 9).orderBy("job_id").collect()] == [(1, 1), (3, 0)]


def test_json_and_shingles(spark):
    df = spark.createDataFrame([('{"a": 1}', "a b c"), ('{"a": 1', "a"), ('"a": 1}', ""), ("[1]", None), (None, "a b c d")], "j string, t string")
    assert [r.ok for r in df.select(X.is_json(F.col("j")).alias("ok")).collect()] == [True, False, False, True, False]
    assert [r.n for r in df.select(F.size(X.shingles(F.col("t"), 2)).alias("n")).collect()] == [2, 1, 0, 0, 3]


def test_fields_add_up(spark):
    docs = spark.createDataFrame([(1, "x y", "z"), (2, "z", "x x"), (3, "", "q")], "id int, title string, body string")
    score = lambda c: {r.doc: r.score for r in search.bm25(docs, "id", F.col(c), ["x"]).collect()}
    title, body = score("title"), score("body")
    got = {r.doc: r.score for r in search.fields(docs, "id", {"title": (F.col("title"), 2.0), "body": (F.col("body"), 1.0)}, ["x"]).collect()}
    assert got == pytest.approx({k: 2 * title.get(k, 0) + body.get(k, 0) for k in {*title, *body}})


def test_streams_drop_repeats_and_find_sessions(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.unionByName(events.limit(100)).write.parquet(str(tmp_path / "in"))
    stream = streams.read_events(spark, str(tmp_path / "in"), events.schema)
    once = streams.without_duplicates(stream, "100 days", ["event_id"])
    once.writeStream.format("memory").queryName("once").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == events.count()
    found = streams.activity(stream.where("event_id >= 0").dropDuplicates(["event_id"]), "30 minutes", "100 days")
    found.writeStream.outputMode("complete").format("memory").queryName("found").trigger(availableNow=True).start().awaitTermination()
    want = catalog.queries()["sessions"](spark, "/root/testdata/sf0.001")
    assert sorted(r.n for r in spark.table("found").collect()) == sorted(r.n for r in want.collect())
