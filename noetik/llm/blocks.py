"""Blocks: bounded slices of a corpus, and hashed keys exchanged between them.

A block holds about BLOCK_BYTES of text, either dealt by the hash of the document id (block_of) or cut from the rows as
they are read and stored once, compressed (stored). Keys go from blocks to buckets as packed arrays, one row for each
block and each bucket that it has keys for, after each block has made its keys distinct; a key that is frequent
everywhere therefore costs one entry a block. Rows are cut out of sorted arrays by numpy, so no step runs once for
every bucket, and there are never more rows than keys.

A key is KEY_BYTES low bytes of a 64-bit hash beside its bucket, which is a range of the whole hash. Different keys
that agree in both are one key: with v keys in n buckets about v * v / (n * 2**57) pairs of them.
"""

from __future__ import annotations

import contextlib
import ctypes
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

BLOCK_BYTES = 8 << 20
LEAST_BLOCKS = 16
KEY_BYTES = 7  # of each key, beside its bucket


def trim() -> None:
    """Return freed memory to the system: workers live on and wait beside those of later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def fresh() -> None:
    """For a worker's next task: drop what earlier ones of another operator kept, and return it."""
    kept = sys.modules.get(f"{__package__}.tokens")
    if kept:
        kept._encoders.clear()
    trim()


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def block_count(docs: DataFrame, text: str = "text", size: int = BLOCK_BYTES) -> int:
    return max(LEAST_BLOCKS, -(-text_bytes(docs, text) // size))


def block_of(key: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (Stafford's variant 13)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each key: n equal ranges of 64-bit keys, n below 2**32."""
    n, half = np.uint64(n), np.uint64(32)
    low = ((keys & np.uint64(0xFFFFFFFF)) * n) >> half
    return ((keys >> half) * n + low) >> half


def runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours ends."""
    return np.append(np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)) if len(values) else np.zeros(0, np.int64)


def pack_keys(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).ravel()


def unpack_keys(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = data.reshape(-1, KEY_BYTES)
    return out.view("<u8").ravel()


def cells(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column: data (bytes) cut at ends."""
    offsets = np.zeros(len(ends) + 1, np.int32)
    offsets[1:] = ends
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def cell_bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's bytes in one array, and where each cell ends."""
    whole = pa.concat_arrays([c for c in column.chunks if len(c)] or [pa.array([], pa.binary())])
    offsets = np.frombuffer(whole.buffers()[1], np.int32, len(whole) + 1, 4 * whole.offset) if len(whole) else np.zeros(1, np.int32)
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[1:].astype(np.int64) - offsets[0]


def packed_counts(counts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Counts cut at ends: a byte each, and eight more for those from 255 on."""
    large = counts >= 255
    many = np.append(0, np.cumsum(large))[ends]
    return cells(np.minimum(counts, 255).astype(np.uint8), ends), cells(counts[large].astype("<u8").view(np.uint8), 8 * many)


def unpacked_counts(table: pa.Table) -> np.ndarray:
    """All counts of a table's rows, one after the other."""
    out = cell_bytes(table.column("counts"))[0].astype(np.int64)
    out[out == 255] = cell_bytes(table.column("more"))[0].view("<u8")
    return out


def column_bytes(table: pa.Table, name: str) -> list[bytes]:
    """A string column's UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in table.column(name).cast(pa.binary()).to_pylist()]


SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("n_order", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("more", pa.binary())])
SENT_SQL = "bucket int, block long, n_order int, keys binary, counts binary, more binary"
ANSWER = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("n_order", pa.int32()), ("counts", pa.binary()), ("more", pa.binary())])
ANSWER_SQL = "block long, bucket int, n_order int, counts binary, more binary"


def to_buckets(block: int, order: int, keys: np.ndarray, counts: np.ndarray, n: int) -> pa.Table:
    """Sorted distinct keys of a block with their counts, a row for each bucket that has some."""
    bucket = bucket_of(keys, n)
    ends = runs(bucket)
    few, more = packed_counts(counts, ends)
    column = lambda v, kind: pa.array(np.full(len(ends), v), kind)
    return pa.table([pa.array(bucket[ends - 1].astype(np.int32)), column(block, pa.int64()), column(order, pa.int32()), cells(pack_keys(keys), KEY_BYTES * ends), few, more], schema=SENT)


def gathered(table: pa.Table):
    """For each order of a bucket: its rows, where each one's keys end, each key's place among the distinct ones, these
    and their totals."""
    for k in sorted(pc.unique(table.column("n_order")).to_pylist()):
        own = table.filter(pc.equal(table.column("n_order"), k))
        data, ends = cell_bytes(own.column("keys"))
        distinct, inverse = np.unique(unpack_keys(data), return_inverse=True)
        total = np.bincount(inverse, unpacked_counts(own), len(distinct)).astype(np.int64)
        yield k, own, ends // KEY_BYTES, inverse, distinct, total


def answer(key: tuple, table: pa.Table) -> pa.Table:
    """For each block, the totals of its keys, in their order."""
    out = []
    for _, own, ends, inverse, _, total in gathered(table):
        few, more = packed_counts(total[inverse], ends)
        out.append(pa.table([own.column("block"), own.column("bucket"), own.column("n_order"), few, more], schema=ANSWER))
    out = pa.concat_tables(out)
    trim()
    return out


def answered(table: pa.Table, order: int) -> np.ndarray:
    """The totals of a block's keys of one order, in their order, from all buckets' answers."""
    own = table.filter(pc.equal(table.column("n_order"), order))
    return unpacked_counts(own.take(pc.sort_indices(own.column("bucket"))))


def stored(docs: DataFrame, size: int = BLOCK_BYTES, text: str = "text") -> DataFrame:
    """block, data: rows as they are read, in blocks of about size bytes of text, each a compressed Arrow stream; cut in
    the shared folder, so that a block stays the same in every pass and after the loss of an executor."""

    def cut_out(batches):
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        task, k, held, n = TaskContext.get().partitionId(), 0, [], 0

        def block():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=options) as out:
                for b in held:
                    out.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + k]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "data"])

        for b in batches:
            sums, begin = np.cumsum(pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
            while begin < len(b):
                before = int(sums[begin - 1]) if begin else 0
                end = max(int(np.searchsorted(sums, before + size - n, side="right")), begin + (not held))
                if end > begin:
                    held.append(b.slice(begin, end - begin))
                    n += int(sums[end - 1]) - before
                begin = end
                if begin < len(b):
                    yield block()
                    held, k, n = [], k + 1, 0
        if held:
            yield block()

    return cut(docs.mapInArrow(cut_out, "block long, data binary"))


def rows_of(data: bytes) -> pa.Table:
    """A stored block's rows."""
    return pa.ipc.open_stream(data).read_all()
