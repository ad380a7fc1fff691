"""The least value among the strings within an edit distance, without a row for each pair of them.

Two strings are within the distance if and only if some characters taken out of both and some made blank leave the same of
them, as many in all as the distance allows. So a block of strings is met with another one way of taking out and blanking
after the other, on arrays of hashes; like strings are found whether a key is frequent or not, and only the least value
of each is kept. What is found is compared as strings; where a hash was wrong, the block is done again with other weights.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship
from .edit_distance import near_strings

BLOCK = 65_536  # strings of a key in a block
LONG = 64  # characters; ways grow with the square, and longer strings have segments that few share
MOST_TASKS = 8192


def weights(size: int, turn: int) -> np.ndarray:
    return np.random.default_rng(turn).integers(1, 2**63, size, np.uint64) * np.uint64(2) + np.uint64(1)


class Strings:
    """Strings of one length as rows of characters, with what their hashes are made of."""

    def __init__(self, rows: np.ndarray, codes: np.ndarray, w: np.ndarray, distance: int):
        self.rows, self.codes, self.w, self.size = rows, codes, w, codes.shape[1]
        columns = np.ascontiguousarray(codes.T).astype(np.uint64)
        self.columns, self.sums = columns, []
        for shift in range(distance + 1):  # sums of characters that come so many places earlier
            sums = np.zeros((self.size + 1, len(rows)), np.uint64)
            for k in range(self.size):
                sums[k + 1] = sums[k] + (columns[k] * w[k - shift] if k >= shift else 0)
            self.sums.append(sums)

    def hashes(self, out: tuple[int, ...], blank: tuple[int, ...]) -> np.ndarray:
        """Of the strings without the characters at `out`, blank at places of what is left."""
        total, begin = np.zeros(len(self.rows), np.uint64), 0
        for shift, end in enumerate((*out, self.size)):
            total += self.sums[shift][end] - self.sums[shift][begin]
            begin = end + 1
        left = [k for k in range(self.size) if k not in out] if blank else []
        for place in blank:
            total -= self.columns[left[place]] * self.w[place]
        return total


def by_length(names: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """length: rows, characters."""
    texts = names.to_pylist()
    size, out = np.array([len(x) for x in texts], np.int64), {}
    for m in np.unique(size).tolist():
        rows = np.flatnonzero(size == m)
        out[m] = rows, np.frombuffer("".join(texts[i] for i in rows).encode("utf-32-le"), np.uint32).reshape(len(rows), m)
    return out


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Edit distances of rows of characters."""
    row = [np.full(len(x), j) for j in range(y.shape[1] + 1)]
    for i in range(x.shape[1]):
        new = [np.full(len(x), i + 1)]
        for j in range(y.shape[1]):
            new.append(np.minimum(np.minimum(row[j + 1], new[j]) + 1, row[j] + (x[:, i] != y[:, j])))
        row = new
    return row[-1]


def least(asked: pa.Array, known: pa.Array, distance: int) -> np.ndarray:
    """For each distinct string asked the place of the first known one within the distance, or their number."""
    some, others = by_length(asked), by_length(known)
    w_size = max([*some, *others], default=0) + 1
    for turn in range(1000):
        w = weights(w_size, turn)
        best = np.full(len(asked), len(known))
        made = {n: Strings(*x, w, distance) for n, x in others.items()}
        for m, x in some.items():
            mine = Strings(*x, w, distance)
            for n in range(m - distance, m + distance + 1):
                if n in made:
                    _meet(mine, made[n], distance, best)
        if all(_right(x, y, best, distance) for x in some.values() for y in others.values()):
            return best
    raise RuntimeError("hashes stay wrong")


def _meet(mine: Strings, theirs: Strings, distance: int, best: np.ndarray) -> None:
    m, n = mine.size, theirs.size
    for q in range(max(0, n - m), distance + 1):
        p = m - n + q
        if p < 0 or p + q > distance or p > m or q > n:
            continue
        for blank in combinations(range(m - p), min(distance - p - q, m - p)):
            for out in combinations(range(m), p):
                plain = mine.hashes(out, blank)
                order = np.argsort(plain)
                plain = plain[order]
                new = np.append(True, plain[1:] != plain[:-1])
                found = np.full(len(plain), np.iinfo(np.int64).max)
                for cut_out in combinations(range(n), q):
                    other = theirs.hashes(cut_out, blank)
                    at = np.minimum(np.searchsorted(plain, other), len(plain) - 1)
                    hit = plain[at] == other
                    np.minimum.at(found, at[hit], theirs.rows[hit])
                first = np.maximum.accumulate(np.where(new, np.arange(len(plain)), 0))
                rows = mine.rows[order]
                best[rows] = np.minimum(best[rows], found[first])


def _right(x, y, best: np.ndarray, distance: int) -> bool:
    """Whether what is best of strings of one length, among those of another, is within the distance."""
    (rows, codes), (others, known) = x, y
    at = np.searchsorted(others, best[rows])
    met = (at < len(others)) & (others[np.minimum(at, len(others) - 1)] == best[rows])
    return bool((distances(codes[met], known[at[met]]) <= distance).all())


def nearest(asked: DataFrame, known: DataFrame, distance: int) -> DataFrame:
    """key, name, value: for each key and name asked (key, name) the least value of the strings of the same key (key, name,
    value) within the distance, where there is one. Nulls are in no pair."""
    asked = cut(asked.where("key is not null and name is not null").select("key", "name").distinct())
    known = cut(known.where("key is not null and name is not null and value is not null").groupBy("key", "name").agg(F.min("value").alias("value")))
    ship(asked.sparkSession)
    length = F.length("name")
    mine, theirs = asked.where(length <= LONG), known.where(length <= LONG + distance)
    blocks = lambda df, c: df.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias(c))
    both = cut(blocks(mine, "ps").join(blocks(theirs, "qs"), "key"))  # a row a key
    pairs = both.agg(F.coalesce(F.sum(F.col("ps") * F.col("qs")), F.lit(0))).first()[0]
    tasks = min(MOST_TASKS, max(8, 2 * pairs))
    part = lambda c: F.pmod(F.xxhash64("name"), F.col(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = mine.join(both, "key").select("key", part("ps").alias("p"), every("qs").alias("q"), "name").repartition(tasks, "key", "p", "q")
    right = theirs.join(both, "key").select("key", every("ps").alias("p"), part("qs").alias("q"), "name", "value").repartition(tasks, "key", "p", "q")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("value")
        best = least(a["name"].combine_chunks(), b["name"].combine_chunks(), distance) if a.num_rows and b.num_rows else np.zeros(0, np.int64)
        rows = np.flatnonzero(best < b.num_rows)
        a = a.take(pa.array(rows, pa.int64()))
        return pa.table({"key": a["key"], "name": a["name"], "value": b["value"].take(pa.array(best[rows], pa.int64()))})

    kinds = dict(known.dtypes)
    found = left.groupBy("key", "p", "q").cogroup(right.groupBy("key", "p", "q")).applyInArrow(run, f"key {kinds['key']}, name string, value {kinds['value']}")
    more = asked.where(length > LONG)
    if not more.isEmpty():
        theirs = known.where(length > LONG - distance)
        near = near_strings(more.select("name"), theirs.select("name"), distance).select(F.col("a").alias("name"), F.col("b").alias("of"))
        found = found.unionByName(more.join(near, "name").join(theirs.select("key", F.col("name").alias("of"), "value"), ["key", "of"]).select("key", "name", "value"))
    return found.groupBy("key", "name").agg(F.min("value").alias("value"))
