"""Forced-boundary encoding against the tokenizers library."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from noetik.llm import forced_split, queries

SF = "/root/testdata/sf0.001"
ODD = ["a", "b'", "'", "'s", "'ll", "don't", " ", "  ", "\n", "\r\n", "\t", " ", "　", " ", "\u0085", "\x1c", "é", "日本", "ñ", "“", "—", "😀", "́", "12", "!!", "!'s", ".", "<|endoftext|>", "<|endof", "|>", "\x00"]


@pytest.fixture(scope="module")
def made():
    return forced_split.ForcedSplitter(queries.vocabulary())


def same(made, texts):
    ids, ends = made.encode(pa.array(texts, pa.string()))
    want = made.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [e.ids for e in want]
    assert made.decode(ids, ends).to_pylist() == made.tokenizer.decode_batch([e.ids for e in want], skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(ODD), max_size=20).map("".join), st.text(max_size=30)), max_size=6))
def test_ids_of_odd_texts(made, texts):
    same(made, texts)


def test_long_and_short_slices(made, monkeypatch):
    texts = ["".join(ODD) * 40, None, "", "x" * 5000, " " * 3000 + "y", "'" * 700, "<|endoftext|>" * 60, "日本語" * 900, "end"]
    same(made, texts)
    for size in (7, 64, 1000):
        monkeypatch.setattr(forced_split, "SLICE", size)
        same(made, texts)
    same(made, [])


def test_cache_of_bounded_size(made, monkeypatch):
    monkeypatch.setattr(forced_split, "KEPT", 20)
    for k in range(8):
        same(made, [" ".join(f"word{i}x" for i in range(k, k + 60))] * 2)
    assert len(made.young) <= 20 + 3 * 60 and len(made.old) <= 20 + 3 * 60


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50_300), max_size=12), max_size=5))
def test_decoding_of_any_ids(made, rows):
    flat = np.array([i for r in rows for i in r], "<u4")
    got = made.decode(flat, np.cumsum([len(r) for r in rows], dtype=np.int64)).to_pylist()
    assert got == made.tokenizer.decode_batch(rows, skip_special_tokens=False)


def test_cuts_are_never_inside_a_token(made):
    assert made.never.sum() > 60_000
    data = np.frombuffer("The end. It's 3 o'clock!".encode(), np.uint8)
    assert {3, 7, 8} <= set(made.cuts(data).tolist()) and 11 in made.cuts(data)


def test_other_tokenizers_are_refused(tmp_path):
    from tokenizers import Tokenizer, models

    Tokenizer(models.BPE()).save(str(tmp_path / "t.json"))
    with pytest.raises(ValueError, match="byte-level"):
        forced_split.ForcedSplitter(str(tmp_path / "t.json"))


def test_rows_nulls_and_other_columns(spark, made):
    rows = [(1, "same text", "x"), (1, "same text", "y"), (None, None, None), (2, "", "z"), (3, "long " * 200_000, "w")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id int, text string, ids string, n_tokens int")
    got = forced_split.encode(docs, queries.vocabulary(), decoded=True)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    key = lambda r: (r[0] is None, r[0] or 0)
    for r, (i, t, _) in zip(sorted(got.collect(), key=key), sorted(rows, key=key), strict=True):
        want = made.tokenizer.encode(t or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) == (i, len(want), np.array(want, "<u4").tobytes(), t or "")
    back = forced_split.decode(got.select("doc_id", "ids"), queries.vocabulary()).collect()
    assert sorted((r.text for r in back)) == sorted(t or "" for _, t, _ in rows)
    assert forced_split.encode(docs.limit(0), queries.vocabulary()).collect() == []


def test_query(spark, made):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.queries()["op11_forced_split"](spark, SF).collect()
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        ids = made.tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        back = made.tokenizer.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
