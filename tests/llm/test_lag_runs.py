"""Periodic runs against a search of every period."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from noetik.llm import lag_runs, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(words):
    """Every maximal stretch of smallest period q with at least max(6, 4 * q) words: start, length, period."""
    out, n, seen = [], len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j - i + q, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(texts):
    numbers, ends, names = lag_runs.words_of(pa.array(texts, pa.string()))
    runs = lag_runs.find(numbers, ends)
    got = collections.defaultdict(list)
    for t, *r in runs.tolist():
        got[t].append(tuple(r))
    return got, lag_runs.collapsed(numbers, ends, names, runs).to_pylist()


def check(texts):
    got, kept = found(texts)
    for k, t in enumerate(texts):
        words = WORD.findall(t or "")
        runs = brute(words)
        assert got[k] == runs, t
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert kept[k] == " ".join(w for i, w in enumerate(words) if i not in dropped)


words = st.lists(st.sampled_from("ab"), max_size=60) | st.lists(st.sampled_from("aabc"), max_size=60)
periodic = st.builds(lambda a, b, n, c: a + b * n + c, words, st.lists(st.sampled_from("abcd"), min_size=1, max_size=9), st.integers(1, 12), words)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.builds(lambda w, s: s.join(w), words | periodic, st.sampled_from([" ", "\n", " \t ", "\r\n"])) | st.none(), max_size=5))
def test_short_texts(texts):
    check(texts)


@pytest.mark.parametrize("seed", range(6))
def test_long_texts_use_transforms(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(lag_runs, "CELLS", 1 << rng.choice([7, 12, 21]))
    calls, own = [], lag_runs.frequent
    monkeypatch.setattr(lag_runs, "frequent", lambda *a: (calls.append(1), own(*a)))
    texts = []
    for _ in range(4):
        out = []
        while len(out) < 1500:
            size = rng.choice([1, 2, 3, 7, 40, 90, 250])
            pool = rng.choice(["ab", "the of x y z".split(), [f"w{k}" for k in range(300)], ["a"] * 9 + ["b"]])
            out += [rng.choice(pool) for _ in range(size)] * rng.choice([1, 1, 2, 4, 5, 9])
        texts.append(" ".join(out))
    check(texts)
    assert calls


def test_spaces_nulls_and_borders():
    check(["a a a", "a a a a a a", None, "", " \n ", "a a a", "\x0ba\x0ca a a a\x1ca a a a a a ", "a a a a a a\xa0a", "é é é é é é", "x"])
    check([])
    check([None])


def test_nested_runs():
    inner = "a a a a a a a b ".split()
    check([" ".join(inner * 6), " ".join((["c", *inner * 5, "d"]) * 4), " ".join((["a", "b"] * 20 + ["c"]) * 5)])


def test_one_word_repeated_is_cheap():
    text = "same " * 300_000
    got, kept = found([text, "a b " * 150_000])
    assert got[0] == [(0, 300_000, 1)] and got[1] == [(0, 300_000, 2)] and kept == ["same", "a b"]


def test_rows_and_other_columns(spark):
    rows = [(1, "x x x x x x x", 1), (1, "x x x x x x x", 2), (None, "y " * 9, 3), (4, None, 4), (5, "z", 5)]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id int, text string, runs int, collapsed string")
    got = lag_runs.periodic(docs)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    seen = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()))
    assert seen == [(0, 9, [(0, 9, 1)], "y"), (1, 7, [(0, 7, 1)], "x"), (1, 7, [(0, 7, 1)], "x"), (4, 0, [], ""), (5, 1, [], "z")]
    assert lag_runs.periodic(docs.limit(0)).collect() == []
    digests = lag_runs.digest(lag_runs.periodic(lag_runs.planted(docs))).collect()
    assert len(digests) == 5 and all(r.runs_sha256 and r.collapsed_sha256 for r in digests)


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.queries()["op12_lag_runs"](spark, SF).collect()}
    assert set(got) == set(texts)
    planted = 0
    for i, t in texts.items():
        words, h = WORD.findall(t or ""), zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
            planted += 1
        runs = brute(words)
        s, m, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        dropped = {k for x, y, z in runs for k in range(x + z, x + y)}
        want = (len(runs), s, m, q, 1000 * m // q if q else None, hashlib.sha256("".join(f"{x},{y},{z}\n" for x, y, z in runs).encode()).hexdigest(),
                hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in dropped).encode()).hexdigest())
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == want, i
    assert planted and any(r.n_runs for r in got.values())
    assert np.all([r.n_runs >= 0 for r in got.values()])
