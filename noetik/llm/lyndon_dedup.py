"""Removal of byte strings that occur earlier in the corpus, with suffix arrays by linear grouping.

Every window of LENGTH bytes belongs to one K-gram inside it, the one of least hash, so equal windows belong to equal
K-grams at equal places. Runs of neighbouring windows with one K-gram form a stretch of text.

1. Blocks of documents send their distinct K-gram hashes to buckets and learn which occur twice.
2. Each block sends the stretches of those K-grams, equal ones once: the earliest stands for all, the rest is repeated.
3. A bucket builds the suffix array of its distinct stretches. Neighbours that share LENGTH bytes are equal windows; of
   each run all but the earliest occurrence are repeated.
4. Blocks learn their repeated windows and take out the bytes that those cover.

A K-gram of more than HEAVY different stretches, such as a line that stands between ever different texts, would make one
bucket as large as the corpus. Its windows are sent one by one, by 128-bit hashes of their bytes, each once a block, and
spread over all buckets; equal hashes are equal windows there.

So the suffix array sees only text that can repeat, a copied passage costs one entry for each block that holds it, and
nothing is compared across documents but through buckets. The three passes over the blocks read one shuffle.

Null text: no bytes. Texts under LENGTH bytes lose nothing. Rows of one id are one after another in the order of their
texts; ids order the rows, null first. An empty table gives no rows. Columns to carry must not be named like those given.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import jvm, suffix_groups

LENGTH, K = 100, 32
BLOCK_BYTES = 4 << 20
CHUNK = 1 << 18
SPREAD = 16  # buckets of stretches for each block
HEAVY = 1 << 14
STRETCH = "bucket int, block int, meta binary, data binary, copies binary, windows binary"
SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("meta", pa.binary()), ("data", pa.binary()), ("copies", pa.binary()), ("windows", pa.binary())])
ROW = np.dtype([("key", "<u8"), ("doc", "<i8"), ("pos", "<i8"), ("n", "<i8"), ("block", "<i8")])
SPAN = np.dtype([("doc", "<i8"), ("pos", "<i8"), ("n", "<i8")])
ONE = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("doc", "<i8"), ("pos", "<i8")])
_table = B.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * np.uint64(0xA0761D6478BD642F) + right
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xE7037ED1A0B428DB)
    x ^= x >> np.uint64(29)
    return x


def stretches(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """key, start, windows and digest of the stretches of concatenated texts (uint8), which end at ends."""
    out = []
    with np.errstate(over="ignore"):
        for at in range(0, max(len(text) - LENGTH + 1, 0), CHUNK):
            part = text[at : at + CHUNK + LENGTH - 1]
            n = len(part) - LENGTH + 1
            h, step, by = _table[part], 1, {}
            while step < 64:
                h = _join(h[:-step], h[step:])
                step *= 2
                by[step] = h
            order = (by[K] & ~np.uint64(0xFFFFFF)) | np.arange(len(by[K]), dtype=np.uint64)
            low, width, span = order, 1, LENGTH - K + 1
            while 2 * width <= span:
                low = np.minimum(low[:-width], low[width:])
                width *= 2
            low = np.minimum(low[:n], low[span - width : span - width + n])
            place = (low & np.uint64(0xFFFFFF)).astype(np.int64)
            starts = np.arange(at, at + n)
            doc = np.searchsorted(ends, starts, side="right")
            valid = starts + LENGTH <= ends[doc]
            fresh = valid.copy()
            fresh[1:] &= (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | ~valid[:-1]
            first = np.flatnonzero(fresh)
            last = valid.copy()
            last[:-1] &= fresh[1:] | ~valid[1:]
            last = np.flatnonzero(last)
            whole = lambda p: _join(_join(by[64][p], by[32][p + 64]), by[4][p + 96])
            count = last - first + 1
            out.append((by[K][place[first]], first + at, count, _join(_join(whole(first), whole(last)), count.astype(np.uint64))))
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.uint64 if k in (0, 3) else np.int64) for k in range(4))


class Block:
    """A block's texts in the order of the corpus."""

    def __init__(self, table: pa.Table):
        texts, ids = B.column_bytes(table, "text"), table.column("doc_id").fill_null(np.iinfo(np.int64).min).to_pylist()
        self.order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
        self.ids = np.array([ids[k] for k in self.order], np.int64)
        self.texts = [texts[k] for k in self.order]
        self.ends = np.cumsum([len(t) for t in self.texts])
        # rows of one id count as one text, one row after the other
        same = np.concatenate([[0], np.cumsum(self.ids[1:] != self.ids[:-1])])
        begin = self.ends - [len(t) for t in self.texts]
        self.base = begin - begin[np.searchsorted(same, same)]
        self.begin = begin
        self.text = b"".join(self.texts)
        self.key, self.start, self.count, self.digest = stretches(np.frombuffer(self.text, np.uint8), self.ends)

    def address(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The id and the place in its text of places in the block."""
        doc = np.searchsorted(self.ends, start, side="right")
        return self.ids[doc], start - self.begin[doc] + self.base[doc]


def _keys(table: pa.Table, n: int) -> pa.Table:
    """A block's K-grams, with how many different stretches each has, or 2 if it has one of several."""
    block = Block(table)
    order = np.lexsort((block.digest, block.key))
    key, digest = block.key[order], block.digest[order]
    fresh = np.append(True, key[1:] != key[:-1])[: len(key)]
    other = fresh.copy()
    other[1:] |= digest[1:] != digest[:-1]
    first = np.flatnonzero(fresh)
    counts = np.append(first[1:], len(key)) - first if len(key) else first
    kinds = np.add.reduceat(other, first, dtype=np.int64) if len(key) else first
    out = B.to_buckets(table.column("block")[0].as_py(), 0, key[first], np.maximum(np.minimum(counts, 2), kinds), n)
    del block
    B.trim()
    return out


def _spans(doc: np.ndarray, pos: np.ndarray, n: np.ndarray | int) -> bytes:
    out = np.zeros(len(doc), SPAN)
    out["doc"], out["pos"], out["n"] = doc, pos, n
    return out.tobytes()


def _windows(block: Block, heavy: np.ndarray, number: int, many: int) -> list[dict]:
    """The windows of some stretches one by one: of equal ones the first, the rest as repeated."""
    count = block.count[heavy]
    p = np.repeat(block.start[heavy] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    text = block.text
    h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(text[x : x + LENGTH]) for x in p.tolist()]), "<u8").reshape(-1, 2)
    order = np.lexsort((p, h[:, 1], h[:, 0]))
    p, h = p[order], h[order]
    again = np.append(False, (h[1:] == h[:-1]).all(1))[: len(p)]
    doc, pos = block.address(p)
    bucket = B.bucket_of(h[:, 0], many)
    out, begin = [], 0
    for end in B.runs(bucket).tolist():
        new, old = begin + np.flatnonzero(~again[begin:end]), begin + np.flatnonzero(again[begin:end])
        one = np.zeros(len(new), ONE)
        one["h1"], one["h2"], one["doc"], one["pos"] = h[new, 0], h[new, 1], doc[new], pos[new]
        out.append({"bucket": int(bucket[begin]), "block": number, "meta": b"", "data": b"", "copies": _spans(doc[old], pos[old], 1), "windows": one.tobytes()})
        begin = end
    return out


def _stretches(left: pa.Table, right: pa.Table, n: int, most: int) -> pa.Table:
    if not left.num_rows or not right.num_rows:
        return SENT.empty_table()
    block, number = Block(left), left.column("block")[0].as_py()
    keys, total = np.unique(block.key), B.answered(right, 0)
    at = np.searchsorted(keys, block.key)
    heavy = np.flatnonzero((total > most)[at])
    own = np.flatnonzero(((total > 1) & (total <= most))[at])
    _, first, which = np.unique(block.digest[own], return_index=True, return_inverse=True)
    copy = np.ones(len(own), bool)
    copy[first] = False
    # equal digests are equal bytes, or else a stretch of its own
    start, size = block.start[own], block.count[own] + LENGTH - 1
    copies = np.flatnonzero(copy)
    for k, x, y, many in zip(copies.tolist(), start[copies].tolist(), start[first[which[copies]]].tolist(), size[copies].tolist(), strict=True):
        copy[k] = block.text[x : x + many] == block.text[y : y + many]
    by = own[np.argsort(block.key[own], kind="stable")]
    is_copy = np.zeros(len(block.key), bool)
    is_copy[own[copy]] = True
    doc, pos = block.address(block.start)
    bucket = B.bucket_of(block.key[by], SPREAD * n)
    ends, out = B.runs(bucket), []
    for b, some in zip(bucket[ends - 1].tolist(), np.split(by, ends[:-1]), strict=True) if len(by) else ():
        new, old = some[~is_copy[some]], some[is_copy[some]]
        meta = np.zeros(len(new), ROW)
        meta["doc"], meta["pos"], meta["n"], meta["key"], meta["block"] = doc[new], pos[new], block.count[new], block.key[new], number
        data = b"".join([block.text[s : s + c + LENGTH - 1] for s, c in zip(block.start[new].tolist(), block.count[new].tolist(), strict=True)])
        out.append({"bucket": b, "block": number, "meta": meta.tobytes(), "data": data, "copies": _spans(doc[old], pos[old], block.count[old]), "windows": b""})
    if len(heavy):
        out += _windows(block, heavy, number, SPREAD * n)
    del block
    B.trim()
    return pa.Table.from_pylist(out, schema=SENT)


TO_SORT = "block int, windows binary, meta binary, text binary"


def _to_sort(key: tuple, table: pa.Table) -> pa.Table:
    """One row with the distinct stretches of a bucket, the earliest of each, where one K-gram has several; a row for
    each block with the windows that are repeated already."""
    rows = table.select(["block", "meta", "data", "copies", "windows"]).to_pylist()
    meta = np.concatenate([np.frombuffer(r["meta"], ROW) for r in rows])
    size = meta["n"] + LENGTH - 1
    begin = np.cumsum(size) - size
    raw = b"".join(r["data"] for r in rows)
    spans: dict[int, list[bytes]] = {}
    for r in rows:
        spans.setdefault(r["block"], []).append(r["copies"])
    known: set[bytes] = set()
    keep, kinds, repeated = [], {}, []
    for k in np.lexsort((meta["pos"], meta["doc"], meta["key"])).tolist():
        s = raw[begin[k] : begin[k] + size[k]]
        if s in known:
            repeated.append(k)
        else:
            known.add(s)
            keep.append(k)
            kinds[meta["key"][k]] = kinds.get(meta["key"][k], 0) + 1
    again = meta[repeated]
    for b in np.unique(again["block"]):
        own = again[again["block"] == b]
        spans[int(b)].append(_spans(own["doc"], own["pos"], own["n"]))
    one = np.concatenate([np.frombuffer(r["windows"], ONE) for r in rows])
    if len(one):
        of = np.repeat([r["block"] for r in rows], [len(r["windows"]) // ONE.itemsize for r in rows])
        order = np.lexsort((one["pos"], one["doc"], one["h2"], one["h1"]))
        one, of = one[order], of[order]
        same = np.append(False, (one["h1"][1:] == one["h1"][:-1]) & (one["h2"][1:] == one["h2"][:-1]))
        for b in np.unique(of[same]):
            own = one[same & (of == b)]
            spans[int(b)].append(_spans(own["doc"], own["pos"], 1))
    keep = [k for k in keep if kinds[meta["key"][k]] > 1]
    out = [{"block": b, "windows": b"".join(x)} for b, x in spans.items() if any(x)]
    if keep:
        out.append({"meta": meta[keep].tobytes(), "text": b"".join([raw[begin[k] : begin[k] + size[k]] for k in keep])})
    B.trim()
    return pa.Table.from_pylist(out, schema=pa.schema([("block", pa.int32()), ("windows", pa.binary()), ("meta", pa.binary()), ("text", pa.binary())]))


def _cut(left: pa.Table, right: pa.Table) -> pa.Table:
    """Each text's bytes that stay, and its removed runs."""
    texts, ids = B.column_bytes(left, "text"), left.column("doc_id").fill_null(np.iinfo(np.int64).min).to_pylist()
    order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
    sorted_ids = np.array([ids[k] for k in order], np.int64)
    sizes = np.array([len(texts[k]) for k in order], np.int64)
    begin = np.cumsum(sizes) - sizes
    edge = np.zeros(int(sizes.sum()) + 1, np.int32)
    for x in right.column("windows").to_pylist():
        w = np.frombuffer(x, SPAN)
        at = begin[np.searchsorted(sorted_ids, w["doc"])] + w["pos"]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + w["n"] + LENGTH - 1, -1)
    gone = np.cumsum(edge[:-1]) > 0
    out = [None] * len(ids)
    for k, b, n in zip(order, begin.tolist(), sizes.tolist(), strict=True):
        g = gone[b : b + n]
        removed = int(g.sum())
        text = texts[k] if not removed else np.frombuffer(texts[k], np.uint8)[~g].tobytes()
        out[k] = (n, removed, int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()), text)
    n, removed, runs, kept = zip(*out, strict=True) if out else ((), (), (), ())
    B.trim()
    return pa.table({"doc_id": left.column("doc_id"), "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept": pa.array(kept, pa.binary())})


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, carry: tuple[str, ...] = (), heavy: int = HEAVY, as_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay; with digest their SHA-256; as text without the
    characters that a cut has split) and the columns to carry of every row."""
    spark = docs.sparkSession
    jvm.register(spark, "noetik_repeated_windows", suffix_groups.CLASS, suffix_groups.SOURCE, "array<struct<block:int,windows:binary>>")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carry)
    n = B.block_count(own, size=BLOCK_BYTES)
    blocks = own.withColumn("block", B.block_of("doc_id", n)).repartition(n, "block")

    def keys(table: pa.Table) -> pa.Table:
        B.fresh()
        return _keys(table, n)

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        return _stretches(left, right, n, heavy)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out = _cut(left, right)
        if digest:
            out = out.set_column(4, "kept", pa.array([hashlib.sha256(x).hexdigest() for x in out.column("kept").to_pylist()], pa.string()))
        if as_text:
            out = out.set_column(4, "kept", pa.array([x.decode("utf-8", "ignore") for x in out.column("kept").to_pylist()], pa.string()))
        for c in carry:
            out = out.append_column(c, left.column(c))
        return out

    kinds = dict(own.dtypes)
    answers = blocks.groupBy("block").applyInArrow(keys, B.SENT_SQL).groupBy("bucket").applyInArrow(B.answer, B.ANSWER_SQL).withColumn("block", F.col("block").cast("int"))
    sent = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(send, STRETCH)
    to_sort = sent.groupBy("bucket").applyInArrow(_to_sort, TO_SORT)
    sorted_out = F.expr(f"CASE WHEN text IS NULL THEN array(named_struct('block', block, 'windows', windows)) ELSE noetik_repeated_windows(text, meta, {LENGTH}) END")
    found = to_sort.select(F.inline(sorted_out))
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(cut, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if digest or as_text else 'binary'}" + "".join(f", {c} {kinds[c]}" for c in carry))
