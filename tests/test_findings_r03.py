"""What the findings of round 3 name, on rows that failed before."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import spark_partition_id
from test_catalog import TABLES, rows

from noetik.functions import text
from noetik.llm import wavelet
from noetik.operators import edit_distance, evidence, joins, mentions, postings, quantized, revisions, wiki
from noetik.plans import catalog
from noetik.streaming import stateful

SF = "/root/testdata/sf0.001"


def same(spark, folder, name):
    """A query's rows on a folder, which must be those of its SQL."""
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for t in TABLES.split():
        found = folder / f"{t}.parquet"
        db.execute(f"create view {t} as select * from '{found if found.exists() else f'{SF}/{t}.parquet'}'")
    got = rows(catalog.queries()[name](spark, str(folder)).toPandas())
    assert got == rows(db.execute(catalog.oracle_sql()[name]).df())
    return got[1]


def given(folder, **tables):
    """A folder of the small tables, some of them replaced by SQL over them."""
    db = duckdb.connect()
    for t in TABLES.split():
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        if t not in tables:
            (folder / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    for t, sql in tables.items():
        db.execute(f"copy ({sql}) to '{folder}/{t}.parquet' (format parquet)")
    return folder


@pytest.mark.parametrize("name", ["bad_ranges", "claim_evidence"])
def test_prices_on_the_edge_of_a_cent(spark, tmp_path, name):
    """Prices of a half cent above a bound, as quotients of each quantity."""
    edge = "SELECT * REPLACE (CAST(q AS DOUBLE) AS l_quantity, round(bound * q, 2) AS l_extendedprice) FROM (SELECT * FROM lineitem LIMIT 5), (SELECT unnest(range(2, 51)) AS q), (SELECT unnest([1500.005, 2000.005]) AS bound)"
    folder = given(tmp_path, lineitem=f"SELECT * EXCLUDE (q, bound) FROM ({edge})")
    assert same(spark, folder, name)


def test_every_semantic_rule_of_a_source(spark, tmp_path):
    """Four rules name the label of these sources."""
    folder = given(tmp_path, documents="SELECT * REPLACE (doc_id * 40 + 1 AS doc_id, 'de' AS lang) FROM documents")
    found = same(spark, folder, "policy_pass_b_model")
    assert len(found) > len({r[2] for r in found})


def joined(df):
    """The rows that the largest join of a plan gave."""
    df.collect()

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        children = node.children()
        below = max((walk(children.apply(k)) for k in range(children.size())), default=0)
        return max(below, node.metrics().apply("numOutputRows").value()) if "Join" in kind else below

    return walk(df._jdf.queryExecution().executedPlan())


def test_a_word_of_every_page(spark):
    """A source meets the first pages of a word, not all of them."""
    sources = spark.range(300).selectExpr("id as source_id", "'some common words' as title")
    pages = spark.range(400).selectExpr("id as page_id", "if(id % 50 = 7, id, null) as entity_id", "if(id % 2 = 0, 'even', 'odd') as domain", "concat('slug-', id) as slug", "'common' as title", "'words' as summary")
    claims = spark.createDataFrame([(1, 107), (1, 57), (2, 7)], "source_id long, entity_id long")
    labels = spark.createDataFrame([(1, "odd"), (3, "odd"), (4, "slug-300")], "source_id long, label string")
    routed = wiki.route(sources, pages, claims, labels)
    got = {}
    for r in routed.collect():
        got.setdefault(r.source_id, set()).add((r.step, r.page_id))
    assert got[1] == {(1, 57), (1, 107), (2, 1)} and got[2] == {(1, 7), (3, 0), (3, 1)} and got[3] == {(2, 1), (2, 3), (2, 5)} and got[4] == {(2, 300), (3, 0), (3, 1)} and got[5] == {(3, 0), (3, 1), (3, 2)}
    assert joined(routed) <= 300 * 2 * 3


def test_questions_times_shards_are_no_rows(spark, tmp_path, monkeypatch):
    """A word of every document and every question."""
    monkeypatch.setattr(postings, "SHARD", 4)
    index = postings.PostingsIndex(spark, str(tmp_path / "i"))
    index.update(spark.range(300).selectExpr("id as doc", "'same words' as text"))
    top = index.top(spark.range(200).selectExpr("id as qid", "'the same' as text"), 3)
    assert {(r.qid, r.doc, r["rank"]) for r in top.collect()} == {(q, d, d + 1) for q in range(200) for d in range(3)}
    assert joined(top) <= 300


def test_linked_mentions_meet_no_like_names(spark, monkeypatch):
    """Of 60 mentions all but two have an equal name of their type."""
    seen = []
    plain = evidence.near_strings
    monkeypatch.setattr(evidence, "near_strings", lambda left, right, d: (seen.append(left.distinct().count()), plain(left, right, d))[1])
    names = spark.range(60).selectExpr("cast(id as int) as entity_id", "if(id % 2 = 0, 'tool', 'place') as entity_type", "concat('part ', 1000 + id) as name", "cast(null as int) as merged_into")
    said = spark.range(60).selectExpr("cast(id as int) as mention_id", "if(id in (7, 9), 'prat ', 'PART ') || (1000 + id) as mention_text", "if(id % 2 = 0, 'tool', 'place') as type_hint", "cast(id as int) as truth")
    got = evidence.resolve(said, names, names.limit(0).select("entity_id", "name").withColumnRenamed("name", "alias")).collect()
    assert {r.mention_id: (r.entity_id, r.band) for r in got} == {k: (k, "candidate" if k in (7, 9) else "auto") for k in range(60)} and seen == [2]


def test_rests_are_spread(spark, monkeypatch):
    """Names of one begin: few bytes, many pairs, which are not left to one task."""
    monkeypatch.setattr(edit_distance, "SHARE", 20)
    names = spark.range(400).selectExpr("id", "format_string('Supplier#%09d', id) as name")
    found = edit_distance.near_strings(names, names, 1, ordered=True)
    assert found.count() == sum(1 for a in range(400) for k in (1, 10, 100) for d in range(1, 10) if a // k % 10 + d < 10 and a + d * k < 400)


@pytest.mark.parametrize("name", ["resolve_score", "alias_match"])
def test_pairs_of_equal_names_are_scored_once(spark, tmp_path, monkeypatch, name):
    """Parts of two names of one brand and type, some without a name or a key: rows of the joins are lists, not pairs."""
    monkeypatch.setattr(joins, "LIST", 16)
    monkeypatch.setattr(joins, "SIDE", 100)
    part = "SELECT * REPLACE (CAST(k AS BIGINT) AS p_partkey, CASE WHEN k % 50 = 7 THEN NULL WHEN k % 3 = 0 THEN 'red bolt' ELSE 'blue ring' END AS p_name, CASE WHEN k % 40 = 9 THEN NULL ELSE 'b' END AS p_brand, 't' AS p_type) FROM (SELECT * FROM part LIMIT 1), (SELECT unnest(range(400)) AS k)"
    folder = given(tmp_path, part=part)
    assert len(same(spark, folder, name)) > 40000
    assert joined(catalog.queries()[name](spark, str(folder))) < 4000


@pytest.mark.parametrize("name", ["wiki_support", "lint_support"])
def test_rows_without_a_target_are_dealt(spark, name):
    """Statements without a claim and evidence: of the partitions before the last join none holds most of the rows."""
    for k, v in {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}.items():
        spark.conf.set(k, v)
    try:
        statements = spark.range(2000).selectExpr("id as statement_id", "id * 2 as revision_id")
        supports = spark.range(2000).selectExpr("id as statement_id", "if(id % 100 = 1, id, null) as claim_id", "if(id % 100 = 2, id, null) as evidence_id", "cast(null as bigint) as source_id")
        claims = spark.range(2000).selectExpr("id as claim_id", "id as source_id", "'explicit' as provenance")
        proof, proven = spark.range(2000).selectExpr("id as claim_id", "id as evidence_id"), spark.range(2000).selectExpr("id as evidence_id", "id as source_id")
        run = wiki.support if name == "wiki_support" else evidence.lint_support
        out = run(statements, supports, claims, proof, proven)
        assert out.count() == (2000 if name == "wiki_support" else 1960)
        most = max(r["count"] for r in out.groupBy(spark_partition_id()).count().collect())
    finally:
        for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(k)
    assert most < 800


def test_batches_are_bounded_in_bytes(spark):
    """Texts and blocks of vectors go to Python by bytes, not by 10,000 rows, also where no other operator has asked for it."""
    size, pairs = "spark.sql.execution.arrow.maxBytesPerBatch", spark.createDataFrame([(1, "a\nb", "a")], "k int, old string, new string")
    vectors = spark.range(40).selectExpr("id", "array(cast(id as double), 1.0D) as v")
    for run in (lambda: revisions.differences(pairs, ["k"]), lambda: quantized.exact(vectors, vectors, 40, 2), lambda: quantized.Codes(vectors)):
        spark.conf.unset(size)
        run()
        assert spark.conf.get(size) == "8m"


def test_index_stores_and_deals_no_arrays_of_tokens(spark, tmp_path):
    """Odd white space, marks and letters; documents keep no list of their terms, and counts follow changes without it."""
    texts = [None, "", " ", "a", "A b  b\tc", "É é_É 12³ ½x", "ǅ İi ſ", "a b　c", "--a--", "don't é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    each = docs.select("doc", text.tokens(F.col("text")).alias("t"), text.spaced(F.col("text")).alias("s")).collect()
    assert all((r.s is None) == (r.t is None) and (r.s is None or r.s == " ".join(r.t)) for r in each)
    index = postings.PostingsIndex(spark, str(tmp_path / "i"))
    index.update(docs)
    assert set(index.of(index.version()["segments"][0]).columns) == {"doc", "dl", "shard"}
    index.update(spark.createDataFrame([(4, "b z"), (20, "a z")], "doc long, text string"), deleted=spark.createDataFrame([(3,)], "doc long"))
    held = [set(r.t or []) for r in each if r.doc not in (3, 4)] + [{"b", "z"}, {"a", "z"}]
    want = {t: sum(t in h for h in held) for t in set().union(*held)}
    assert {r.term: r.df for r in index.document_counts().collect()} == want


def shuffled(df):
    """The rows that the largest shuffle of a plan wrote."""
    df.collect()

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        children = node.children()
        below = max((walk(children.apply(k)) for k in range(children.size())), default=0)
        return max(below, node.metrics().apply("shuffleRecordsWritten").value()) if kind == "ShuffleExchangeExec" else below

    return walk(df._jdf.queryExecution().executedPlan())


def test_postings_of_no_phrase_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Many words in the documents, few in the phrases."""
    monkeypatch.setattr(postings, "SHARD", 4)
    docs = spark.range(200).selectExpr("id as doc", "concat('head the of and rare', id % 20, ' some more words of ', array_join(transform(sequence(0, 30), k -> concat('w', id * 31 + k)), ' ')) as body")
    index = postings.PostingsIndex(spark, str(tmp_path / "i"))
    index.update(docs, text=F.col("body"))
    phrases = spark.createDataFrame([(k, f"d the of and rare{k} some more words o") for k in range(3)] + [(9, "the and of rare1 some")], "pid long, p string")
    found = index.phrases(phrases, docs)
    assert {(r.pid, r.doc) for r in found.collect()} == {(d % 20, d) for d in range(200) if d % 20 < 3}
    assert shuffled(found) < 1000  # of some 7,500 rows of postings


def test_links_of_clusters_are_stars(spark, monkeypatch):
    """Vectors of three tight bundles in cells of 64, some of them zero, null or equal: fewer links than pairs, the same clusters."""
    monkeypatch.setattr(quantized, "CELL", 64)
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(3, 8))
    rows = [(k, (middle[k % 3] + 0.05 * rng.normal(size=8)).tolist()) for k in range(240)] + [(300, [0.0] * 8), (301, None), (302, middle[0].tolist()), (303, middle[0].tolist())]
    given = quantized.usable(spark.createDataFrame(rows, "k long, e array<double>"), "k", "e")
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in rows if v and any(v)}
    want = {(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= 0.9} - {(a, 303) for a in unit if a != 302}
    every = [(r.a, r.b) for r in quantized.similar(given, 0.9).collect()]
    assert len(every) == len(set(every)) and set(every) == want
    links = quantized.similar(given, 0.9, clusters=True)
    assert links.count() < len(want) / 4
    got = {}
    for name, edges in (("all", spark.createDataFrame(every, "a long, b long")), ("stars", links)):
        got[name] = {(r.id, r.component) for r in joins.components(edges).collect()}
    assert got["all"] == got["stars"] and len(got["all"]) == 242


def test_planes_that_hardly_shrink_stay_as_they_are():
    """Bytes of five bits shrink to about 0.65: not worth the time; those of two bits to less than a half."""
    some = np.random.default_rng(1)
    for values, whole in ((32, True), (4, False)):
        plane = some.integers(0, values, 3 * wavelet.BLOCK).astype(np.uint8).tobytes()
        assert (b"".join(wavelet.blocks_of(plane)) == plane) is whole


def test_claims_of_every_quantity_around_their_bound(spark, tmp_path):
    """Prices of each cent around the bound of claim_evidence for each quantity, with their joins."""
    near = "SELECT * REPLACE (CAST(q AS DOUBLE) AS l_quantity, round(bound * q * 100 + k) / 100 AS l_extendedprice) FROM (SELECT * FROM lineitem LIMIT 1), (SELECT unnest(range(1, 51)) AS q), (SELECT unnest([1500.0, 1500.005]) AS bound), (SELECT unnest(range(-30, 31)) AS k)"
    folder = given(tmp_path, lineitem=f"SELECT * EXCLUDE (q, bound, k) FROM ({near})")
    assert 1000 < len(same(spark, folder, "claim_evidence")) < 5000


def moved(spark, run) -> int:
    """The bytes that all stages of a run write to shuffles."""
    context = spark.sparkContext._jsc.sc()

    def stages():
        context.listenerBus().waitUntilEmpty()
        found = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(found.apply(k).stageId(), found.apply(k).attemptId()): found.apply(k).shuffleWriteBytes() for k in range(found.size())}

    before = stages()
    run()
    return sum(n for k, n in stages().items() if k not in before)


def test_sets_are_shuffled_once(spark):
    """Tokens go by token once, and those of no other set no further: 14 bytes each, and 41 before."""
    sets = spark.range(400).selectExpr("id", "transform(sequence(1, 200), k -> xxhash64(id, k)) as tokens")
    most = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(most, "-1")  # as for large tables
    try:
        assert moved(spark, lambda: joins.near_classes(sets, 80).collect()) < 20 * 400 * 200
    finally:
        spark.conf.unset(most)


def test_copies_that_are_too_many_to_send(spark, monkeypatch):
    """Both ways of leaving copies out give the same classes and links."""
    sets = spark.range(60).selectExpr("id", "transform(sequence(1, 20), k -> xxhash64(id div 3 div 2, if(k = 20, id div 3, k))) as tokens")
    few = sorted(joins.near_classes(sets, 80).collect())
    monkeypatch.setattr(joins, "MOST_COPIES", 0)
    assert sorted(joins.near_classes(sets, 80).collect()) == few == [(k, k // 3 * 3, 1) for k in range(60)]


def test_texts_are_read_once_for_many_names(spark, monkeypatch):
    """A dictionary that is too large to send whole; texts were read once for each of its parts."""
    monkeypatch.setattr(mentions, "MOST_CHARACTERS", 50)
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    texts = spark.range(40).selectExpr("id", "concat('Name#', id, ' is not name#', id + 1, 'x') as text").mapInArrow(count, "id long, text string")
    found = mentions.mentions(texts, spark.range(100).selectExpr("concat('name#', id) as name")).collect()
    assert {(r.id, r.start, r.name) for r in found} == {(k, 0, f"name#{k}") for k in range(40)} and len(found) == 40
    assert read.value == 40


class Handle:
    """A key's state and timers, and the calls that set these."""

    def __init__(self):
        self.held, self.timers, self.calls = [], set(), 0

    def getListState(self, *_):
        return self

    def get(self):
        return iter(self.held)

    def put(self, rows):
        self.held = list(rows)

    def clear(self):
        self.held = []

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def getCurrentWatermarkInMs(self):
        return self.now


def test_a_key_has_one_timer_for_its_sessions(spark):
    """100 sessions in two batches took a timer each; all are closed by the watermark, in parts and at last."""
    handle, process = Handle(), stateful.Sessions(60_000_000)
    process.init(handle)
    times = [k * 100_000_000 for k in range(100)]
    for part in (times[1::2], times[::2]):
        list(process.handleInputRows((7,), iter([pd.DataFrame({"at_us": part})]), handle))
    assert handle.calls == 2
    closed = []
    for handle.now in (3_000_000, 5_000_000, 20_000_000):
        for at in sorted(t for t in handle.timers if t < handle.now):
            handle.timers.discard(at)
            closed += [tuple(r) for f in process.handleExpiredTimer((7,), handle, None) for r in f.to_numpy().tolist()]
    assert sorted(closed) == [(7, t, t, 1, True) for t in times] and not handle.held
    assert handle.calls < 6
