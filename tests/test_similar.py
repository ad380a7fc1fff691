"""Approximate search, similarity joins and components against plain computations."""

import random

import numpy as np
import pytest

from noetik.operators import joins, quantized
from noetik.plans import catalog


def components(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def found(spark, edges):
    rows = joins.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len({r.id for r in rows}) == len(rows)
    return {r.id: r.component for r in rows}


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed, monkeypatch):
    monkeypatch.setattr(joins, "HOT", 7)
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, k) for k in range(1001, 1100)] + [(5000, 5000), (0, 0), (7, 3), (3, 7)]
    assert found(spark, [*edges, (None, 3), (4, None)]) == components(edges)


def test_a_long_chain(spark):
    names = list(range(10_001))
    random.Random(1).shuffle(names)
    assert set(found(spark, list(zip(names, names[1:], strict=False))).values()) == {0}


def test_no_edges(spark):
    assert found(spark, []) == {} and found(spark, [(3, 3)]) == {3: 3}


def vectors(spark, rows):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "k long, e array<double>")
    return quantized.usable(df, "k", "e")


@pytest.mark.parametrize("cell", [20, 4096])
def test_similar(spark, cell, monkeypatch):
    monkeypatch.setattr(quantized, "CELL", cell)
    monkeypatch.setattr(quantized, "TILE", 300)
    rng = np.random.default_rng(cell)
    centres = rng.normal(size=(8, 5))
    rows = {i: (centres[i % 8] + rng.normal(size=5) * 0.2).tolist() for i in range(160)}
    rows |= {500 + i: rows[0] for i in range(40)}
    rows |= {700: [0, 0, 0, 0, 0], 701: [0, 0, 0, 0, 0], 702: [1.0], 703: [2.0, 0.0], 704: [float("nan")], 705: None, 706: [None]}
    pairs = [(r.a, r.b) for r in quantized.similar(vectors(spark, rows.items()), 0.97).collect()]
    assert len(set(pairs)) == len(pairs) and all(a < b for a, b in pairs)
    usable = {i: np.pad(np.array(v, float), (0, 5 - len(v))) for i, v in rows.items() if i < 704}
    like = lambda v, w: (v @ w) / np.sqrt((v @ v) * (w @ w)) if v.any() and w.any() else 0
    links = [(a, b) for a in usable for b in usable if a < b and like(usable[a], usable[b]) >= 0.97]
    assert set(pairs) - {(700, 701)} <= set(links) and len(pairs) < len(links)  # equal vectors are classes
    want = components(links)
    got = components(p for p in pairs if p != (700, 701))
    assert got == want


def test_near_search(spark, monkeypatch):
    monkeypatch.setattr(quantized, "BLOCK", 300)
    monkeypatch.setattr(quantized, "ASKED", 16)
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    v = np.array([r.embedding for r in rows], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    ids, hits, near, exact = np.array([r.vec_id for r in rows]), 0, {}, {}
    for r in catalog.queries()["ann_search"](spark, sf).collect():
        near.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    for r in catalog.queries()["ann_exact"](spark, sf).collect():
        exact.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    for q in np.flatnonzero(ids % 50 == 0):
        score = np.round(v @ v[q], 6)
        want = sorted(zip((-score).tolist(), ids.tolist(), strict=True))[:10]
        assert [i for _, i, _ in sorted(exact[ids[q]])] == [i for _, i in want]
        own = sorted(near[ids[q]])
        assert [n for n, _, _ in own] == list(range(1, 11)) and all(abs(s - score[np.flatnonzero(ids == i)[0]]) < 2e-6 for _, i, s in own)
        hits += len({i for _, i, _ in own} & {i for _, i in want})
    assert hits >= 0.9 * 10 * (ids % 50 == 0).sum()
    codes = quantized.Codes(quantized.usable(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding"))
    assert codes.share(10) < 0.2


def test_few_and_odd_vectors(spark):
    rows = vectors(spark, [(1, [1, 0, 0]), (2, [0, 1]), (3, [0, 0, 0]), (4, None), (5, [1, 1, 0])])
    asked = rows.where("id in (1, 3)")
    for got in (quantized.Codes(rows).top(asked, 2, 2), quantized.exact(rows, asked, 2, 2)):
        assert {(r.query_id, r.id, round(r.score, 3), r["rank"]) for r in got.collect()} == {(1, 1, 1.0, 1), (1, 5, 0.707, 2), (3, 1, 0.0, 1), (3, 2, 0.0, 2)}
    none = rows.limit(0)
    assert quantized.Codes(none).top(none, 0, 2).collect() == [] and quantized.similar(none, 0.5).collect() == []
