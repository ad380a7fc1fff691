"""Revisions, integrity, diversity and relaxed filters against plain computations."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noetik.operators import diversity, integrity, relaxed, revisions
from noetik.plans import catalog
from noetik.session import written

SF = "/root/testdata/sf0.001"


def common(a, b):
    """The length of a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def apply(old, hunks):
    out, at = [], 0
    for h in hunks:
        out += old[at : h["at"]] + h["lines"]
        at = h["at"] + h["gone"]
    return out + old[at:]


lines = st.lists(st.sampled_from("abcde"), max_size=14)


@settings(max_examples=400, deadline=None)
@given(lines, lines)
def test_scripts_are_shortest_and_give_the_newer_text(a, b):
    hunks, kept = revisions.script(a, b)
    assert apply(a, hunks) == b and kept == common(a, b)
    assert sum(h["gone"] for h in hunks) == len(a) - kept and sum(len(h["lines"]) for h in hunks) == len(b) - kept
    pairs = revisions.matched(a, b)
    assert len(pairs) == kept and all(a[i] == b[j] for i, j in pairs)
    assert all(x < y and z < w for (x, z), (y, w) in zip(pairs, pairs[1:], strict=False))


def test_applied_texts(spark):
    rng = random.Random(4)
    text = lambda: "\n".join(rng.choice(["a", "b", "c", "", "long line"]) for _ in range(rng.randrange(12)))
    rows = [(k, text(), text()) for k in range(60)] + [(100, None, "x\ny"), (101, "x", None), (102, None, None), (103, "", "\n"), (104, "a\r\nb", "a\nb"), (105, "line\n" * 3000, "line\n" * 2999 + "end")]
    df = spark.createDataFrame(rows, "k int, old string, new string")
    found = revisions.differences(df, ["k"])
    got = df.join(found, "k").select("k", "new", "inserted", "deleted", "kept", revisions.applied(F.col("old"), F.col("hunks")).alias("made")).collect()
    split = lambda t: [] if t is None else t.split("\n")
    old = {k: split(o) for k, o, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r.made == r.new and (r.deleted + r.kept, r.inserted + r.kept) == (len(old[r.k]), len(split(r.new)))
        if r.k != 105:
            assert r.kept == common(old[r.k], split(r.new))
    assert revisions.differences(df.limit(0), ["k"]).collect() == []


def test_revision_query(spark):
    docs, by = spark.read.parquet(f"{SF}/documents.parquet").collect(), {}
    for r in sorted(docs, key=lambda r: r.doc_id):
        if r.source is not None:
            by.setdefault(r.source, []).append((r.text or "").split("\n") if r.text is not None else [])
    want = {(s, v + 1): common(t[v - 1], t[v]) for s, t in by.items() for v in range(1, len(t))}
    got = {(r.source, r.version): r.kept for r in catalog.queries()["revision_diff"](spark, SF).collect()}
    assert got == want and any(got.values())


@pytest.fixture
def copies(spark):
    rng = random.Random(8)
    rows = {k: (k, rng.choice(["x", "y", None]), rng.randrange(9)) for k in [*range(-500, 3000, 3), 10**9]}
    return rows, lambda x, *more: spark.createDataFrame([*x.values(), *more], "id long, a string, b int")


def located(one, other):
    build = lambda df: written(integrity.tree(df, "id", ["a", "b"]))[0]
    leaves, seen = integrity.differing_leaves(build(one), build(other))
    return {(r.id, r.change) for r in integrity.changed(one, other, leaves, "id", ["a", "b"]).collect()}, leaves, seen


def test_equal_trees_end_at_the_root(copies):
    rows, table = copies
    found, leaves, seen = located(table(rows), table(dict(reversed(rows.items()))).repartition(7))
    assert (found, leaves, seen) == (set(), None, [0])


def test_changes_are_found_in_their_ranges(copies, monkeypatch):
    rows, table = copies
    other = dict(rows)
    del other[-500], other[1000]
    other[10**9] = (10**9, "changed", 1)
    other[4] = (4, *((None, 1) if rows[4][1:] != (None, 1) else ("x", 1)))
    other[2000] = (2000, "new", 1)
    want = {(-500, "missing"), (1000, "missing"), (10**9, "changed"), (4, "changed"), (2000, "extra")}
    want = {x for x in want if not (x == (1000, "missing") and 1000 not in rows)}
    found, leaves, seen = located(table(rows), table(other))
    assert found == want and leaves.count() <= 5 and seen[-1] == leaves.count() and max(seen) <= 5
    monkeypatch.setattr(integrity, "MOST_RANGES", 1)
    assert located(table(rows), table(other))[0] == want
    assert located(table(rows, (None, "q", 1)), table(rows, (None, "r", 1)))[0] == {(None, "changed")}
    assert located(table(rows), table({}))[0] == {(k, "missing") for k in rows} and located(table({}), table({}))[2] == [0]


def test_swapped_cells_are_a_difference(spark):
    df = spark.createDataFrame([(1, "x", "y")], "id long, a string, b string")
    turned = spark.createDataFrame([(1, "y", "x")], "id long, a string, b string")
    null = [spark.createDataFrame([x], "id long, a string, b string") for x in ((1, None, "x"), (1, "x", None))]
    assert located(df, turned)[0] == {(1, "changed")} and located(*null)[0] == {(1, "changed")}


def plain_mmr(c, k, weight):
    """c: (rank, doc, score, vector)."""
    def like(v, w):
        n = max(len(v or []), len(w or []))
        v, w = (np.array([y or 0.0 for y in x or []] + [0.0] * (n - len(x or []))) for x in (v, w))
        return float(v @ w / np.sqrt((v @ v) * (w @ w))) if v.any() and w.any() else 0.0

    most, out, left = max(x[2] for x in c), [], sorted(c)
    while left and len(out) < k:
        gain = lambda x: round(weight * x[2] / most - (1 - weight) * max((like(x[3], y[3]) for y in out), default=0), 9)
        best = max(gain(x) for x in left)
        chosen = next(x for x in left if gain(x) == best)
        out.append(chosen)
        left.remove(chosen)
    return [x[1] for x in out]


@pytest.mark.parametrize("weight", [0.0, 0.5, 0.7, 1.0])
def test_marginal_relevance(spark, weight):
    rng = random.Random(5)
    vectors = {d: rng.choice([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [rng.random(), rng.random(), rng.random()]]) for d in range(30)} | {30: None, 31: [0.0, 0.0]}
    lists = {q: [(n, d, 10.0 - (n // 2) * 0.7) for n, d in enumerate(rng.sample(range(34), rng.randrange(1, 15)), 1)] for q in range(25)}
    df = spark.createDataFrame([(f"q{q}", d, s, n) for q, c in lists.items() for n, d, s in c], "qid string, doc long, score double, rank int")
    got = {}
    for r in sorted(diversity.diversify(df, spark.createDataFrame(list(vectors.items()), "doc long, vector array<double>"), 6, weight).collect(), key=lambda r: r.place):
        got.setdefault(r.qid, []).append(r.doc)
    assert got == {f"q{q}": plain_mmr([(n, d, s, vectors.get(d)) for n, d, s in c], 6, weight) for q, c in lists.items()}
    assert diversity.diversify(df.limit(0), spark.createDataFrame([], "doc long, vector array<double>"), 3).collect() == []


def test_relaxed_filters(spark):
    docs = [("a b", "x", 1), ("a", "y", 2), ("a a", "x", 0), (None, "x", 1), ("c", None, None), ("hot " * 3, "y", 2)]
    questions = [(1, "a", "x", 1), (2, "a", "z", 1), (3, "b", "x", 2), (4, "nothing", "x", 0), (5, None, "x", 0), (6, "c", "x", 0), (7, "hot", "x", 3), (1_000, "a", None, 0)]
    table = spark.createDataFrame(docs, "text string, kind string, depth int")
    tests = {"kind": F.col("kind") == F.col("wanted"), "depth": F.col("depth") >= F.col("least")}
    counts = relaxed.lattice(spark.createDataFrame(questions, "qid int, term string, wanted string, least int"), table, F.col("text"), ["kind", "depth"], tests)
    got = {r.qid: (r.n_kind_and_depth, r.n_kind, r.n_depth, r.n_any) for r in counts.collect()}

    def plain(term, wanted, least):
        held = [(k, p) for t, k, p in docs if term is not None and term in (t or "").split()]
        a, b = (lambda k: k is not None and k == wanted), (lambda p: p is not None and p >= least)
        return sum(a(k) and b(p) for k, p in held), sum(a(k) for k, _ in held), sum(b(p) for _, p in held), len(held)

    assert got == {q: plain(*x) for q, *x in questions}
    why = {r.qid: r.reason for r in relaxed.reason(counts, ["kind", "depth"], {"kind": "other_kind", "depth": "shallow"}).collect()}
    assert why == {1: "found", 2: "other_kind", 3: "shallow", 4: "absent", 5: "absent", 6: "too_narrow", 7: "too_narrow", 1_000: "other_kind"}
