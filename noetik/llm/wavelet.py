"""Token ids in succinct shard files: a wavelet matrix with rank and select support.

A shard covers a range of document ids. Its file holds the bit planes of all its ids, from the highest bit down; in
each plane, the ids whose bit is 0 go before those whose bit is 1 to the next plane. A plane is cut into blocks of
BLOCK bytes, deflated one by one where that makes the plane smaller, with a directory of where each block begins and how
many ones stand before it. So access(i), count(id, i, j) and select(id, k) work on the compressed file: each inflates a
few blocks of each plane. decode() gives whole ranges.

File: the magic number, then as little-endian integers bits and counts (ids, documents, documents without an id), then
the documents' ids and the positions where each begins, then of each plane its zeros, its directory and its blocks.
Files are written by Spark as one row of a Parquet table each, so that writing is atomic, lives in any store that Spark
reaches and survives lost executors.

Null text: empty, so the end token only. A null id stays null; such documents come first. Repeated ids stay rows of
their own, in the order of their ids. An empty table gives no files and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from .tokens import encoder

MAGIC = b"WVMX0002"
SHARD_BYTES = 8 << 20
BLOCK = 4096  # bytes of a plane
SHRINK = 0.5  # the share of its size that makes deflating a plane worth the time
QUANTILES = 2000  # of ids that reach the driver


def blocks_of(plane: bytes) -> list[bytes]:
    """A plane's blocks as they are stored: all as they are if neither the first nor the middle one shrinks to SHRINK."""
    raw = [plane[i : i + BLOCK] for i in range(0, len(plane), BLOCK)]
    if raw and all(len(zlib.compress(b, 1)) > SHRINK * len(b) for b in (raw[0], raw[len(raw) // 2])):
        return raw
    return [z if len(z := zlib.compress(b, 1)) < len(b) else b for b in raw]


def encode(ids: np.ndarray, docs: np.ndarray, starts: np.ndarray, n_null: int = 0) -> bytes:
    """A file image. The first n_null documents have no id."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    out = [MAGIC, struct.pack("<IIII", bits, len(ids), len(docs), n_null), docs.astype("<i8").tobytes(), starts.astype("<u4").tobytes()]
    seq = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    for level in range(bits - 1, -1, -1):
        bit = (seq & seq.dtype.type(1 << level)) != 0
        packed = np.packbits(bit, bitorder="little")
        stored = blocks_of(packed.tobytes())
        ones = np.add.reduceat(np.bitwise_count(packed).astype(np.uint32), np.arange(0, len(packed), BLOCK)) if len(packed) else np.zeros(0, np.uint32)
        sizes = np.array([len(b) for b in stored], np.uint32)
        out += [struct.pack("<II", len(bit) - int(ones.sum()), len(stored)), (np.cumsum(ones) - ones).astype("<u4").tobytes(), np.append(0, np.cumsum(sizes)).astype("<u4").tobytes(), *stored]
        if level:
            seq = np.concatenate([seq.take(np.flatnonzero(~bit)), seq.take(np.flatnonzero(bit))])
    return b"".join(out)


class WaveletMatrix:
    """A file's reader. KEPT blocks stay inflated."""

    KEPT = 256

    def __init__(self, image: bytes):
        assert image[:8] == MAGIC, "not a token file"
        self.image = image
        self.bits, self.n, n_docs, self.n_null = struct.unpack_from("<IIII", image, 8)
        at = 24
        self.docs = np.frombuffer(image, "<i8", n_docs, at)
        at += 8 * n_docs
        self.starts = np.frombuffer(image, "<u4", n_docs, at).astype(np.int64)
        at += 4 * n_docs
        self.zeros, self.ones, self.begin = [], [], []
        for _ in range(self.bits):
            zeros, n = struct.unpack_from("<II", image, at)
            self.zeros.append(zeros)
            self.ones.append(np.frombuffer(image, "<u4", n, at + 8))
            places = np.frombuffer(image, "<u4", n + 1, at + 8 + 4 * n).astype(np.int64)
            at += 8 + 4 * n + 4 * (n + 1)
            self.begin.append(places + at)
            at += int(places[-1])
        self.inflated: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def stored(self, level: int, block: int) -> bytes:
        """A block's bytes."""
        i, j = self.begin[level][block : block + 2]
        want = min(BLOCK, (self.n + 7) // 8 - block * BLOCK)
        return self.image[i:j] if j - i == want else zlib.decompress(self.image[i:j])

    def block(self, level: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """A block's words of 64 bits, and the ones before each."""
        if (got := self.inflated.get((level, block))) is None:
            if len(self.inflated) >= self.KEPT:
                self.inflated.clear()
            data = self.stored(level, block)
            words = np.frombuffer(data + bytes(-len(data) % 8), "<u8")
            got = words, np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)
            self.inflated[level, block] = got
        return got

    def bit(self, level: int, i: int) -> int:
        words, _ = self.block(level, i // (8 * BLOCK))
        i %= 8 * BLOCK
        return int(words[i >> 6] >> np.uint64(i & 63)) & 1

    def rank1(self, level: int, i: int) -> int:
        """Ones before position i."""
        if i >= self.n:
            return self.n - self.zeros[level]
        words, ones = self.block(level, i // (8 * BLOCK))
        before = int(self.ones[level][i // (8 * BLOCK)])
        i %= 8 * BLOCK
        return before + int(ones[i >> 6]) + (int(words[i >> 6]) & (1 << (i & 63)) - 1).bit_count()

    def access(self, i: int) -> int:
        out = 0
        for level in range(self.bits):
            b = self.bit(level, i)
            out = out << 1 | b
            i = self.zeros[level] + self.rank1(level, i) if b else i - self.rank1(level, i)
        return out

    def count(self, token: int, i: int, j: int) -> int:
        """Occurrences of token at positions from i to before j."""
        for level in range(self.bits):
            ri, rj = self.rank1(level, i), self.rank1(level, j)
            i, j = (self.zeros[level] + ri, self.zeros[level] + rj) if token >> (self.bits - 1 - level) & 1 else (i - ri, j - rj)
        return max(0, j - i) if token >> self.bits == 0 else 0

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of token, or -1."""
        if k >= self.count(token, 0, self.n):
            return -1
        begin = 0
        for level in range(self.bits):
            r = self.rank1(level, begin)
            begin = self.zeros[level] + r if token >> (self.bits - 1 - level) & 1 else begin - r
        i = begin + k
        for level in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - level) & 1
            want = i - self.zeros[level] if one else i
            low, high = 0, self.n
            while low < high:  # the least position before which there are want + 1 such bits
                mid = (low + high) // 2
                r = self.rank1(level, mid + 1)
                low, high = (mid + 1, high) if (r if one else mid + 1 - r) <= want else (low, mid)
            i = low
        return i

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        seq = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            plane = b"".join([self.stored(level, b) for b in range(len(self.ones[level]))])
            bit = np.unpackbits(np.frombuffer(plane, np.uint8), count=self.n, bitorder="little").view(bool)
            out = np.empty(self.n, kind)
            seq[self.zeros[level] :] |= kind(1 << (self.bits - 1 - level))
            out[np.flatnonzero(~bit)], out[np.flatnonzero(bit)] = seq[: self.zeros[level]], seq[self.zeros[level] :]
            seq = out
        return seq.astype(np.uint32)


def shards_of(docs: DataFrame, id_col: str, size: int):
    """A function from ids (numpy) to shards of about size bytes of text, ascending: quantiles of all ids, at most
    QUANTILES of them, each cut into parts of equal width. Null ids are in the first shard."""
    at = F.array(*[F.lit(k / QUANTILES) for k in range(QUANTILES + 1)])
    got = docs.agg(F.percentile_approx(F.col(id_col), at, F.lit(20 * QUANTILES)).alias("at"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n = max(B.LEAST_BLOCKS, -(-int(got["bytes"] or 0) // size))
    coarse = min(n, QUANTILES)
    quantiles = np.array(got["at"] or [0], np.int64)
    bounds = np.unique(quantiles[np.arange(coarse + 1) * (len(quantiles) - 1) // coarse])
    parts = -(-n // coarse)
    width = np.maximum(1, -(-(np.append(bounds[1:], bounds[-1] + 1) - bounds) // parts))

    def shard(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
        k = np.clip(np.searchsorted(bounds, ids, side="right") - 1, 0, len(bounds) - 1)
        return np.where(null, 0, k * parts + np.clip((ids - bounds[k]) // width[k], 0, parts - 1)).astype(np.int64)

    return shard


FILES = "shard long, n_docs long, n_tokens long, file binary"


def write(docs: DataFrame, path: str, vocabulary: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenise where the texts are read, send the ids to their shards, write each shard's file."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shard = shards_of(own, "doc_id", SHARD_BYTES)
    tail = int(end).to_bytes(4, "little")

    def tokens(batches):
        coder = encoder(vocabulary)
        for b in batches:
            ids = [np.frombuffer(x + tail, "<u4") for x in coder.encode(b.column(1))]
            # two bytes an id, or four and one more that tells
            small = [x.astype("<u2").tobytes() if x.max() < 65536 else x.tobytes() + b"\0" for x in ids]
            at = shard(b.column(0).fill_null(0).to_numpy(), b.column(0).is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(0), pa.array(small, pa.binary())], ["shard", "doc_id", "ids"])

    def files(table: pa.Table) -> pa.Table:
        docs, ids = table.column("doc_id").to_pylist(), table.column("ids").to_pylist()
        order = sorted(range(len(docs)), key=lambda k: (docs[k] is not None, docs[k] or 0, ids[k]))
        found = [np.frombuffer(ids[k][:-1], "<u4") if len(ids[k]) % 2 else np.frombuffer(ids[k], "<u2") for k in order]
        sizes = np.array([len(x) for x in found])
        image = encode(np.concatenate(found), np.array([docs[k] or 0 for k in order], np.int64), np.cumsum(sizes) - sizes, sum(d is None for d in docs))
        out = pa.table({"shard": table.column("shard")[:1], "n_docs": [len(docs)], "n_tokens": [int(sizes.sum())], "file": pa.array([image], pa.binary())})
        B.trim()
        return out

    own.mapInArrow(tokens, "shard long, doc_id long, ids binary").groupBy("shard").applyInArrow(files, FILES).write.mode("overwrite").parquet(path)


def read(spark, path: str) -> DataFrame:
    """Per document, from the files alone: start, n_tokens and the CRC-32 of its ids. The ids before a shard are running
    totals over groups of shards and inside each group."""
    files = spark.read.schema(FILES).parquet(path)
    totals = files.select("shard", "n_tokens", F.floor(F.col("shard") / QUANTILES).alias("part"))
    of_parts = totals.groupBy("part").agg(F.sum("n_tokens").alias("all"))
    of_parts = of_parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("earlier"))  # a row for QUANTILES shards
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    before = totals.withColumn("inside", inside).join(of_parts, "part").select("shard", (F.col("inside") + F.col("earlier")).alias("before"))

    def rows(batches):
        for b in batches:
            for image, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                m = WaveletMatrix(image)
                ids, ends = m.decode().astype("<u4"), np.append(m.starts[1:], m.n)
                crc = [zlib.crc32(ids[i:j]) for i, j in zip(m.starts.tolist(), ends.tolist(), strict=True)]
                docs = pa.array(m.docs, mask=np.arange(len(m.docs)) < m.n_null)
                yield pa.RecordBatch.from_arrays([docs, pa.array(m.starts + base), pa.array(ends - m.starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.join(before, "shard").select("file", "before").mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")
