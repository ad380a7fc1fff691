"""Plans by the shape of questions."""

import pytest
from pyspark.sql import functions as F

from noetik.operators import answers, diversity
from noetik.operators.postings import PostingsIndex
from noetik.plans import asking, catalog
from noetik.sources import tables as T

SF = "/root/testdata/sf0.001"
TEXTS = [
    "", "find noodles", "What is it in general?", "compare the tools I saved", "something cheap under 30", "routes under $ 10", "the second one", "a second-hand thing", "第二个是什么", "综合我的收藏", "my collection and general knowledge under 5",
    "not yet visited and cheap", "newest of the last 20 days", "nothing of the kind", "generally the first", "unvisited", "thirdly", "便宜 不超过 50",
]


def test_shapes_are_those_of_parsed_requests(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, text string")
    got = {r.k: (r["shape"], r.n) for r in df.select("k", answers.shapes(F.col("text")).alias("shape"), answers.ordinal(F.col("text")).alias("n")).collect()}
    assert got == {k: (answers.shape(r), r.reference) for k, r in ((k, answers.parse(t)) for k, t in enumerate(TEXTS))}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    docs = {1: "ring of fire", 2: "ring ring", 3: "blue ring bolt", 4: "bolt", 5: "a ring in water"}
    index = PostingsIndex(spark, str(tmp_path_factory.mktemp("asking") / "i"))
    index.update(spark.createDataFrame(list(docs.items()), "doc long, text string"))
    return index


def test_each_plan_is_followed(spark, small):
    asked = [(1, 0, "ring"), (1, 2, "and the second?"), (1, 4, "the third of them"), (2, 0, "ring in general"), (2, 2, "the first one"), (3, 0, "ring under 9"), (4, 0, "compare ring bolt"), (5, 0, None), (6, 0, "second"), (6, 2, "bolt")]
    q = spark.createDataFrame([(f"{c}:{t}", c, t, x) for c, t, x in asked], "qid string, conv int, turn int, text string")
    vectors = spark.createDataFrame([(d, [float(d % 2), 1.0]) for d in range(1, 6)], "doc long, vector array<double>")
    facts = spark.createDataFrame([(d, 2 if d != 3 else 0, d) for d in range(1, 6)], "doc long, depth int, saved_at int")
    got = {}
    for r in sorted(answers.planned(q, small, vectors, facts, 3).collect(), key=lambda r: r.place):
        got.setdefault((r.qid, r.plan), []).append(r.doc)
    top = lambda text, k: [r.doc for r in sorted(small.top(spark.createDataFrame([(0, text)], "qid int, text string"), k).collect(), key=lambda r: r["rank"])]
    plain = top("ring", 3)
    assert got[("1:0", "semantic")] == plain and got[("1:2", "follow_up")] == [plain[1]] and got[("1:4", "follow_up")] == [plain[2]]
    assert got[("3:0", "structured")] == [5, 2, 1] and ("2:0", "general") not in got and ("2:2", "follow_up") not in got and ("6:0", "follow_up") not in got
    varied = diversity.diversify(small.top(spark.createDataFrame([("x", "compare ring bolt")], "qid string, text string"), 6), vectors, 5).orderBy("place").collect()
    assert got[("4:0", "mixed")] == [r.doc for r in varied] and set(got) == {("1:0", "semantic"), ("1:2", "follow_up"), ("1:4", "follow_up"), ("3:0", "structured"), ("4:0", "mixed"), ("6:2", "semantic")}


def test_planned_answers(spark):
    rows = catalog.queries()["planned_answers"](spark, SF).collect()
    plans = {r.plan for r in rows}
    turns = {r.qid: r.plan for r in catalog.queries()["question_shapes"](spark, SF).collect()}
    assert plans <= {"semantic", "structured", "mixed", "follow_up"} and {"semantic", "mixed"} <= plans and set(turns.values()) >= plans
    assert all(turns[r.qid] == r.plan for r in rows) and len({(r.qid, r.doc) for r in rows}) == len(rows)
    assert T.messages(spark, SF).where("role = 'user'").count() == len(turns) and asking.worded(spark, SF).count() == len(turns)
