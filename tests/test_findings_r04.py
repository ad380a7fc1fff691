"""What the findings of round 4 name, on rows that failed before."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_findings_r03 import joined
from test_names import levenshtein

from noetik.operators import diversity, evidence, nearest, postings


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_first_of_like_strings(distance):
    rng = random.Random(distance)
    words = lambda n: pa.array(sorted({"".join(rng.choices("ab😀", k=rng.randrange(8))) for _ in range(n)}, key=lambda x: rng.random()))
    asked, known = words(80), words(60)
    want = [next((i for i, k in enumerate(known.to_pylist()) if levenshtein(a, k) <= distance), len(known)) for a in asked.to_pylist()]
    assert nearest.least(asked, known, distance).tolist() == want


def test_wrong_hashes_are_seen(monkeypatch):
    """Weights that are all one make anagrams equal."""
    plain = nearest.weights
    monkeypatch.setattr(nearest, "weights", lambda n, turn: plain(n, turn) if turn else np.ones(n, np.uint64))
    assert nearest.least(pa.array(["abcdef"]), pa.array(["fedcba", "abcdxx", "abcdef"]), 2).tolist() == [1]


def test_like_names_are_no_pairs(spark, monkeypatch):
    """Numbered names, of which each is like many; some mentions and names are long, some have no type."""
    monkeypatch.setattr(nearest, "BLOCK", 500)
    monkeypatch.setattr(nearest, "LONG", 12)
    names = spark.range(1500).selectExpr("cast(id as int) as entity_id", "case when id % 50 = 3 then null when id % 2 = 0 then 'tool' else 'place' end as entity_type", "concat(if(id % 100 = 4, 'a longer kind of ', ''), 'part ', 1000 + id) as name", "cast(null as int) as merged_into")
    said = spark.range(400).selectExpr("cast(id as int) as mention_id", "concat(if(id % 10 = 4, 'a longer kind of ', ''), 'part x', 1000 + id) as mention_text", "if(id % 2 = 0, 'tool', 'place') as type_hint", "cast(id as int) as truth")
    out = evidence.resolve(said, names, names.limit(0).select("entity_id", "name").withColumnRenamed("name", "alias"))
    held = names.where("entity_type is not null").collect()
    want = {m.mention_id: min((n.entity_id for n in held if n.entity_type == m.type_hint and levenshtein(m.mention_text, n.name) <= 2), default=None) for m in said.collect()}
    assert {r.mention_id: r.entity_id for r in out.collect()} == want and len(set(want.values())) > 20
    assert joined(out) <= 1500


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    old, postings.SHARD = postings.SHARD, 4
    index = postings.PostingsIndex(spark, str(tmp_path_factory.mktemp("index") / "i"))
    index.update(spark.range(300).selectExpr("id as doc", "concat('same words w', id % 7) as text"))
    postings.SHARD = old
    return index


def test_lists_of_a_chunk_are_one_row(spark, small, monkeypatch):
    """Of 600 questions each block gives a row for a chunk, not for a result."""
    seen, plain = [], postings.PostingsIndex.in_blocks

    def watched(self, *a):
        seen.append(plain(self, *a).cache())
        return seen[-1]

    monkeypatch.setattr(postings.PostingsIndex, "in_blocks", watched)
    asked = spark.range(600).selectExpr("id as qid", "concat('the same w', id % 7) as text")
    got = {(r.qid, r.doc, r["rank"]) for r in small.top(asked, 3).collect()}
    assert got == {(q, q % 7 + 7 * (d - 1), d) for q in range(600) for d in (1, 2, 3)}
    report = small.top(asked, 3, report=True).collect()
    assert len(report) == 600 and all(r.read_shards <= r.shards and r.read_blocks <= r.blocks for r in report)
    assert [x.count() <= 3 * postings.LEAST_BLOCKS for x in seen] == [True] * 4


def test_turns_and_chunks_give_the_same(spark, small, monkeypatch):
    asked = spark.range(50).selectExpr("cast(id as string) as qid", "if(id % 9 = 8, 'nowhere', concat('same w', id % 7)) as text")
    rows = lambda: (sorted(map(tuple, small.top(asked, 4).collect())), sorted(map(tuple, small.top(asked, 4, report=True).collect())))
    want = rows()
    monkeypatch.setattr(postings, "RESULTS", 40)
    monkeypatch.setattr(postings, "CHUNK", 3)
    assert rows() == want and len(want[1]) == 45


def test_vectors_go_as_they_are(spark):
    """Single precision is not widened before it is shuffled."""
    candidates = spark.createDataFrame([(1, 1, 2.0, 1), (1, 2, 2.0, 2), (1, 3, 1.0, 3)], "qid long, doc long, score double, rank int")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "doc long, vector array<float>")
    out = diversity.diversify(candidates, vectors, 2)
    assert {r.place: r.doc for r in out.collect()} == {1: 1, 2: 2}
    assert "array<double>" not in out._jdf.queryExecution().optimizedPlan().toString()
