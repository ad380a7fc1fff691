"""The stored index against plain computations: ranked questions, phrases, changes and versions."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from noetik.operators import postings, segments

WORDS = re.compile(r"[^\W_]+")


def tokens(text):
    return WORDS.findall((text or "").lower())


def ranked(docs, questions, k):
    held = {i: tokens(t) for i, t in docs.items()}
    n, mean = len(held), sum(map(len, held.values())) / max(len(held), 1)
    df = collections.Counter(w for t in held.values() for w in set(t))
    out = {}
    for q, text in questions.items():
        found = []
        for i, t in held.items():
            tf = collections.Counter(t)
            hits = [w for w in set(tokens(text)) if w in tf]
            if hits:
                score = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in hits)
                found.append((round(score, 6), i))
        out[q] = sorted(found, key=lambda x: (-x[0], x[1]))[:k]
    return {q: r for q, r in out.items() if r}


def tops(index, df, k, number=None):
    out = collections.defaultdict(list)
    for r in sorted(index.top(df, k, number).collect(), key=lambda r: r["rank"]):
        out[r.qid].append((r.score, r.doc))
    return out


def close(got, want):
    assert set(got) == set(want)
    for q in want:
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in want[q]], abs=2e-6)
        rounded = lambda x: {(round(s, 4), i) for s, i in x if round(s, 4) > round(x[-1][0], 4)}
        assert rounded(got[q]) == rounded(want[q])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    text = lambda n: " ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(400)], k=n))
    docs = {i: text(rng.choice([3, 20, 21, 22, 60, 300])) for i in range(900)}
    docs |= {900: None, 901: "", 902: "!!", 903: "w0", 904: "w0 w0"}
    questions = {q: text(rng.choice([1, 2, 4, 8])) for q in range(60)} | {100: "", 101: None, 102: "nowhere", 103: "W0 w0, w399!"}
    return docs, questions


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory, corpus):
    old, postings.SHARD = postings.SHARD, 16
    index = postings.PostingsIndex(spark, str(tmp_path_factory.mktemp("index") / "text"))
    index.update(spark.createDataFrame(list(corpus[0].items()), "id long, text string"), "id")
    postings.SHARD = old
    return index


def asked(spark, questions):
    return spark.createDataFrame(list(questions.items()), "qid long, text string")


def test_many_questions(spark, built, corpus):
    docs, questions = corpus
    for k in (1, 10, 2000):
        close(tops(built, asked(spark, questions), k), ranked(docs, questions, k))


def test_blocks_are_skipped(spark, built, corpus):
    rows = built.top(asked(spark, corpus[1]), 3, report=True).collect()
    assert sum(r.read_shards for r in rows) < 0.7 * sum(r.shards for r in rows) and sum(r.read_blocks for r in rows) < 0.8 * sum(r.blocks for r in rows)


def test_no_group_is_larger_than_a_shard(built):
    version = built.version()
    most = built.table(version, "postings").agg(F.max(F.size("docs"))).first()[0]
    assert most <= 4 * 16 and version["shards"] > 50


def test_salted_terms(spark, built, corpus, monkeypatch):
    version = built.version() | {"shards": 2000}
    plain, questions = built.version(), asked(spark, corpus[1])
    rows = lambda v: sorted(map(tuple, built.bounds(built.asked(questions, plain), v).select("qid", "seg", "shard", "blocks").collect()))
    assert rows(version) == rows(plain)


def test_phrases_by_position(spark, tmp_path):
    docs = {1: "a b c d a b c", 2: "a b x c", 3: "b c d", 4: "xa b cy", 5: "a  b, c!", 6: "a b a b a c", 7: None, 8: "?? !", 9: "c b a", 10: "the a b c d e"}
    index = postings.PostingsIndex(spark, str(tmp_path / "i"))
    index.update(spark.createDataFrame(list(docs.items()), "doc long, text string"))
    phrases = {1: "a b c", 2: "a b", 3: "c", 4: "b a", 5: "a b a", 6: "zz top q", 7: "!", 8: "a b c d e", 9: "b c", 10: "", 11: "a b a b a"}
    df = spark.createDataFrame(list(phrases.items()), "pid long, p string")
    inside = lambda p, t: any(t[i : i + len(p)] == p for i in range(len(t) - len(p) + 1)) and bool(p)
    want = {(p, i) for p, x in phrases.items() for i, t in docs.items() if inside(tokens(x), tokens(t))}
    assert {tuple(r) for r in index.phrases(df).collect()} == want
    body = spark.createDataFrame(list(docs.items()), "doc long, body string")
    want = {(p, i) for p, x in phrases.items() for i, t in docs.items() if t is not None and x in t}
    assert {tuple(r) for r in index.phrases(df, body).collect()} == want


def test_changes_are_a_rebuild(spark, tmp_path, corpus):
    docs, questions = dict(corpus[0]), corpus[1]
    index = postings.PostingsIndex(spark, str(tmp_path / "i"))
    table = lambda rows: spark.createDataFrame(list(rows.items()), "doc long, text string")
    index.update(table(docs))
    before, first = dict(docs), index.version()
    rng, sizes = random.Random(1), []
    for step in range(3):
        new = {rng.randrange(1200): f"w{rng.randrange(400)} changed {step} w1" for _ in range(20)}
        gone = [rng.randrange(1200) for _ in range(15)]
        gone = [i for i in gone if i not in new]
        index.update(table(new), deleted=spark.createDataFrame([(i,) for i in gone], "doc long"))
        docs = {i: t for i, t in (docs | new).items() if i not in gone}
        sizes.append(index.size(index.version()["segments"][-1]))
    assert max(sizes) < 0.5 * index.size(first["segments"][0])
    want = {(w, i): c for i, t in docs.items() for w, c in collections.Counter(tokens(t)).items()}

    def whole(number=None):
        version = index.version(number)
        assert (version["n"], version["length"]) == (len(docs), sum(len(tokens(t)) for t in docs.values()))
        assert {(r.term, r.doc): r.tf for r in index.postings(version).collect()} == want
        assert {r.term: r.df for r in index.document_counts(version).collect()} == collections.Counter(w for w, _ in want)
        close(tops(index, asked(spark, questions), 5), ranked(docs, questions, 5))

    whole()
    changed = index.version()
    index.compact()
    assert len(index.version()["segments"]) == 1
    whole()
    # a reader of the first version still sees it
    assert {r.doc for r in index.read(first["number"]).select("doc").collect()} == set(before)
    close(tops(index, asked(spark, questions), 5, first["number"]), ranked(before, questions, 5))
    index.vacuum()
    whole()
    with pytest.raises(KeyError):
        index.version(changed["number"])
    index.update(table({5000: "w1 again"}))
    docs[5000] = "w1 again"
    want |= {("w1", 5000): 1, ("again", 5000): 1}
    whole()


def test_writers_do_not_overwrite_each_other(spark, tmp_path):
    store = segments.Segments(spark, str(tmp_path / "s"), ["id"])
    rows = lambda *x: spark.createDataFrame([(i, v) for i, v in x], "id int, v string")
    with pytest.raises(KeyError):
        store.read()
    store.update(rows((1, "a"), (2, "b")))
    base = store.version()
    store.update(rows((2, "c")), rows((1, "")))
    with pytest.raises(segments.Conflict):
        store.commit(base, base["segments"])
    assert [tuple(r) for r in store.read().collect()] == [(2, "c")] and store.read(1).count() == 2
    for bad in (rows((1, "x"), (1, "y")), rows((None, "x"))):
        with pytest.raises(ValueError):
            store.update(bad)
    store.update(rows().limit(0), rows((2, "")))
    assert store.read().count() == 0
    store.update(rows((2, "d")))
    store.compact()
    assert [tuple(r) for r in store.read().collect()] == [(2, "d")]
