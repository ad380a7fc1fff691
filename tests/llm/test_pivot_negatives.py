"""Hard negatives against all scores."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from noetik.llm import pivot_negatives, queries

SF = "/root/testdata/sf0.001"


def score(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def brute(rows, anchors, positives=5, negatives=10, low=30, high=90):
    order = lambda f: (-f[0], f[1] is None, f[1] or 0)
    out = []
    for i, label, v in rows:
        if i is None or not anchors(i):
            continue
        found = sorted(((score(v, w), j) for j, k, w in rows if k == label and j != i), key=order)[:positives]
        others = sorted(((score(v, w), j) for j, k, w in rows if k != label), key=order)
        for s, j in found:
            near = [x for x in others if low * s <= 100 * x[0] <= high * s][:negatives]
            out += [(i, j, r + 1, n, s, t) for r, (t, n) in enumerate(near)]
    return out


def mined(spark, rows, anchors, **how):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, label int, vector array<long>, block string, key int")
    return [tuple(r) for r in pivot_negatives.mine(df, anchors, **how).collect()]


key = lambda r: tuple((x is None, x or 0) for x in r)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(pivot_negatives, "ROWS", 60)
    monkeypatch.setattr(pivot_negatives, "ANCHORS", 7)
    monkeypatch.setattr(pivot_negatives, "LEAST_ROWS", 30)
    monkeypatch.setattr(pivot_negatives, "TILE", 200)


@pytest.mark.parametrize("seed", range(4))
def test_all_scores(spark, small_blocks, seed):
    rng = random.Random(seed)
    centre = [[rng.randint(-30, 30) for _ in range(6)] for _ in range(5)]
    vector = lambda: [x + rng.randint(-9, 9) for x in rng.choice(centre)] if seed % 2 else [rng.randint(-3, 3) for _ in range(6)]
    rows = [(i, rng.choice([0, 0, 0, 1, 2]), vector()) for i in range(300)]
    rows += [(1000 + i, rng.randint(0, 2), centre[0]) for i in range(150)]  # many equal vectors
    rng.shuffle(rows)
    got = mined(spark, rows, F.col("vec_id") % 10 == 0)
    assert got and sorted(got) == sorted(brute(rows, lambda i: i % 10 == 0))


def test_nulls_repeats_and_lengths(spark):
    rows = [(0, 1, [5, 5]), (0, 1, [5, 5]), (10, 1, [4]), (None, 1, [3, 3, 9]), (None, 0, [2, 2]), (3, 0, [2, 2]), (3, 0, [2, 2]), (4, 2, []), (20, 3, [1, 1]), (6, 2, [3, 4]), (7, 2, [-9, 1])]
    got = mined(spark, [*rows, (8, None, [1, 1]), (9, 1, None), (11, 1, [1, None])], F.col("vec_id") % 10 == 0)
    assert got and sorted(got, key=key) == sorted(brute(rows, lambda i: i % 10 == 0), key=key)
    assert mined(spark, [], F.col("vec_id") % 10 == 0) == [] and mined(spark, rows, F.lit(False)) == []
    got = mined(spark, rows, F.col("vec_id") % 10 == 0, positives=2, negatives=1, low=10, high=50)
    assert sorted(got, key=key) == sorted(brute(rows, lambda i: i % 10 == 0, 2, 1, 10, 50), key=key)


@pytest.mark.parametrize("size", [1, 5000, 3_000_000, 1 << 29])
def test_scores_stay_exact(spark, size):
    rng = random.Random(size)
    rows = [(i, i % 2, [rng.randint(-size, size) for _ in range(4)]) for i in range(60)]
    assert sorted(mined(spark, rows, F.col("vec_id") % 10 == 0)) == sorted(brute(rows, lambda i: i % 10 == 0))


def test_brackets_hold_and_leave_rows_out(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 0, (rng.integers(-2, 3, 8) + (200 if i % 2 else -200)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, label long, vector array<long>").withColumn("anchor", F.lit(True))
    shape, n, _ = pivot_negatives.shape_of(df)
    table = df.drop("anchor").toArrow()
    own, block = (pivot_negatives.Block(shape, *pivot_negatives.packed(shape, table, x)) for x in (True, False))
    low, high = pivot_negatives.bracket(shape, own, block, slice(0, n), slice(0, n))
    exact = own.vectors @ block.vectors.T
    assert (low <= exact).all() and (exact <= high).all() and (pivot_negatives.reach(shape, own, block)[:, None] >= exact).all()
    assert (high < 0).mean() > 0.4  # half of the rows can't have a score above zero


def test_query(spark):
    rows = []
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect():
        v = r.embedding
        if r.label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            rows.append((r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [int(np.floor(256.0 * x)) for x in v]))
    got = [tuple(r) for r in queries.queries()["op13_pivot_negatives"](spark, SF).collect()]
    assert got and sorted(got) == sorted(brute(rows, lambda i: i % 100 == 0))


def test_components_that_are_no_numbers(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1, [1.0, nan]), (2, 1, [inf]), (3, 1, [-inf, 0.0]), (4, 1, [None]), (5, None, [1.0]), (6, 1, None), (7, 9, [0.5, -0.001]), (None, 2, [1.0])]
    got = pivot_negatives.scaled(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()
    assert sorted(map(tuple, got), key=key) == [(7, 0, [128, -1]), (None, 2, [256])]
