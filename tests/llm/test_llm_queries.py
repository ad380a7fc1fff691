"""The registered queries and the pipeline's stages over a small folder, against plain computations."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from noetik.llm import queries
from noetik.llm import winnow as winnow_module

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACED = re.compile("[^\x20\x09-\x0d]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def remainder(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def rows(spark):
    done = {}

    def of(name, column="doc_id"):
        if name not in done:
            done[name] = {r[column]: r for r in queries.queries()[name](spark, SF).collect()}
        return done[name]

    return of


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.execute(queries.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == sorted(want.fetchall())


def test_language_model(texts, rows):
    tokens = {i: [*SPACED.findall(lower(t)), None] for i, t in texts.items()}
    counts = collections.Counter(w for i, t in tokens.items() if remainder(i, 10) for w in t)
    n, v, got = sum(counts.values()), len(counts), rows("op1_lm_automaton")
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (remainder(i, 10) == 0, len(t), sum(counts[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_quality(spark, texts, rows):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = rows("op2_quality_gbt")
    assert set(got) == set(texts)
    assert all(r.held_out == (remainder(i, 5) == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(r.predicted, labels[i]) for i, r in got.items() if r.held_out and labels.get(i) is not None]
    assert sum(a == b for a, b in held) >= 0.8 * len(held)


@pytest.fixture(scope="module")
def ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    return {i: t.encode(x or "", add_special_tokens=False).ids for i, x in texts.items()}


def test_token_files(ids, rows):
    start, got = 0, rows("op3_wavelet")
    for i in sorted(ids):
        x = np.array([*ids[i], 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(x), zlib.crc32(x.tobytes()))
        start += len(x)


def test_pages(spark, rows):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = rows("op4_html_consensus", "page_id")
    assert {i: r.url for i, r in got.items()} == {i: r.url for i, r in pages.items()}
    for i, p in pages.items():
        article = re.search("<article>(.*?)</article>", p.html, re.S)[1]
        assert got[i].n_chars == len(got[i].text) and "<" not in re.sub("&lt;", "", got[i].text)
        import html

        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", re.sub("<br>", " ", b)))).strip() for b in re.split("</?(?:p|h1|h2|div|article|ul|li|section|table|tr|td)[^>]*>", re.sub("(?s)<(script|style).*?</\\1>|<!--.*?-->", "", article))]
        assert got[i].text == "\n".join(b for b in blocks if b), i


def test_fingerprints(texts, rows):
    got, order = rows("op5_spotsigs"), sorted(texts, reverse=True)
    for at, i in enumerate(order):
        t, nxt = texts[i] or "", texts[order[(at + 1) % len(order)]] or ""
        want = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(want.encode()).hexdigest())
        cut = lambda s: {s[k : k + 8] for k in range(0, len(s), 8)}
        a, b, c = cut(got[i].fingerprint), cut(got[i].edited_fingerprint), cut(got[order[(at + 1) % len(order)]].fingerprint)
        assert math.isclose(got[i].near_edited, len(a & b) / len(a | b)) and math.isclose(got[i].near_next, len(a & c) / len(a | c))


def test_licences(texts, rows):
    base = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for i, t in texts.items():
        w, r = WORD.findall(lower(t)), rows("op7_license_index")[i]
        at = {v: [k for k in range(len(w)) if w[k : k + len(p.split())] == p.split()] for p, v in base.items()}
        every, own = sum(at.values(), []), sorted(v for v, x in at.items() if x)
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(every), ",".join(own)) and set(own) <= set(r.labels.split(","))
        assert (r.first_word, r.last_word) == ((min(every), max(every)) if every else (None, None)) and 0 <= r.score <= 1


def test_sequences(spark, ids):
    pieces = queries.queries()["op8_packing"](spark, SF).collect()
    parts, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        x = [*ids[r.doc_id], 1]
        assert r.doc_tokens == len(x) and r.ids_crc32 == zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes())
        parts[r.doc_id].append((r.start, r.length))
        bins[r.sequence_id].append((r.offset, r.length))
    gapless = lambda some: [a for a, _ in sorted(some)] == [sum(n for _, n in sorted(some)[:k]) for k in range(len(some))]
    assert all(gapless(x) and sum(n for _, n in x) == len(ids[i]) + 1 for i, x in parts.items()) and set(parts) == set(ids)
    assert all(gapless(x) and sum(n for _, n in x) <= 2048 for x in bins.values())


ROWS = [
    (1, "one two three four five six seven eight nine ten eleven twelve " * 3, "en", "a", 5), (2, "totally other words stand in this text of its own kind and nothing else at all " * 2, "en", "a", 5),
    (2, "one two three four five six seven eight nine ten eleven twelve " * 3, "en", "b", 5), (3, None, "en", "a", 0), (4, "", None, None, None), (None, "rows without an id are rows too and this one has a good many words", "en", "a", 1),
    (5, "exactly the same row of words that stands here two times in this table", "en", "a", 1), (5, "exactly the same row of words that stands here two times in this table", "en", "a", 1),
]


@pytest.fixture
def stage_docs(spark):
    return spark.createDataFrame([(*r, "clash", 0.5) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long, node string, score double")


def kept(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


def test_near_duplicate_stage(spark, stage_docs):
    import corpus_pipeline

    got = corpus_pipeline.near_duplicates(spark, stage_docs, SF)
    want = collections.Counter([(r[0], r[1]) for k, r in enumerate(ROWS) if k not in (2, 7)])
    assert kept(got) == want and got.columns == corpus_pipeline.COLUMNS
    assert corpus_pipeline.near_duplicates(spark, stage_docs.limit(0), SF).collect() == []


def test_other_stages_keep_rows_apart(spark, stage_docs, tmp_path):
    import corpus_pipeline

    passage = ROWS[1][1]
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.decontamination(spark, stage_docs, str(tmp_path))
    assert kept(out) == collections.Counter([(r[0], r[1]) for k, r in enumerate(ROWS) if k != 1]) and out.columns == corpus_pipeline.COLUMNS
    scored = corpus_pipeline.quality(spark, stage_docs, str(tmp_path))
    assert scored.columns == corpus_pipeline.COLUMNS and scored.count() in (0, len(ROWS))
    cut = corpus_pipeline.repeated_passages(spark, stage_docs, str(tmp_path)).collect()
    assert len(cut) == len(ROWS) and all(r.n_chars == len(r.text) for r in cut)
    assert sum(len(r.text) for r in cut) < sum(len(r[1] or "") for r in ROWS)
    packed = corpus_pipeline.pack(spark, stage_docs, str(tmp_path)).collect()
    assert collections.Counter(r.doc_id for r in packed if r.start == 0) == collections.Counter(r[0] for r in ROWS)
    for stage in (corpus_pipeline.decontamination, corpus_pipeline.quality, corpus_pipeline.repeated_passages, corpus_pipeline.pack):
        assert stage(spark, stage_docs.limit(0), str(tmp_path)).collect() == []


def test_clean_documents_stay(spark):
    """A document goes only for the reason its stage has."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = winnow_module.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
    clean = {r.doc_id for r in found.where(f"not ({winnow_module.CONTAMINATED})").collect()}
    assert {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, SF).select("doc_id").collect()} == clean
    groups = queries.tensor_minhash.near_duplicates(docs, 5).select("component_id").distinct().count()
    assert corpus_pipeline.near_duplicates(spark, docs, SF).count() == groups
    assert docs.where(F.col("doc_id").isNull()).isEmpty()
