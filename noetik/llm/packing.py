"""Packing token sequences into windows by minimum bin slack.

Every document is cut into full windows and one rest. Rests are packed by their lengths alone: the longest remaining
rest seeds a window, and a subset-sum dynamic programme over the remaining lengths, with the reachable sums as the bits
of one integer, picks the multiset that fills the window closest to capacity; backtracking gives how many of each
length it takes, and the same choice is used as often as the counts allow. Each input partition packs its own rests,
HELD of them at a time, so nothing is shuffled and memory is bounded; that leaves a few windows of HELD rests less full.

Null text: empty, so the end token only, which makes one piece. Repeated ids and null ids are packed as documents of
their own. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from .tokens import encoder

WINDOW = 2048
SEQUENCES = 1 << 33  # sequence ids of one partition
HELD = 16_384


def closest_fill(counts: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, int]]:
    """(length, how many) with the largest sum up to room. lengths: those of counts, descending."""
    full, mask = 1 << room, (1 << room + 1) - 1
    reach, steps = 1, []
    for x in lengths:
        if x > room or not counts[x]:
            continue
        left, chunk = min(counts[x], room // x), 1
        steps.append((x, reach))
        while left:  # copies in powers of two
            take = min(chunk, left)
            reach |= (reach << x * take) & mask
            left -= take
            chunk *= 2
        if reach & full:
            break
    total, out = reach.bit_length() - 1, []
    for x, before in reversed(steps):
        n = 0
        while not before >> total & 1:
            total -= x
            n += 1
        if n:
            out.append((x, n))
    return out


def pack(lengths: np.ndarray, window: int = WINDOW) -> list[list[int]]:
    """Windows as lists of indices of lengths, each of which is from 1 to window."""
    where: dict[int, list[int]] = defaultdict(list)
    for k in range(len(lengths) - 1, -1, -1):
        where[int(lengths[k])].append(k)
    counts = {x: len(v) for x, v in where.items()}
    order = sorted(counts, reverse=True)
    out = []
    while order:
        seed = order[0]
        counts[seed] -= 1
        choice = closest_fill(counts, order, window - seed)
        counts[seed] += 1
        need = defaultdict(int, {seed: 1})
        for x, n in choice:
            need[x] += n
        for _ in range(min(counts[x] // n for x, n in need.items())):
            out.append([where[x].pop() for x, n in need.items() for _ in range(n)])
        for x in need:
            counts[x] = len(where[x])
        order = [x for x in order if counts[x]]
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, vocabulary: str, end: int = 1, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a piece. with_ids: also its token ids."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tail = int(end).to_bytes(4, "little")
    schema = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])
    schema = schema.append(pa.field("ids", pa.binary())) if with_ids else schema

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def packed(rests: list[tuple], sequence: int) -> tuple[pa.RecordBatch, int]:
        out = []
        for members in pack(np.array([r[2] for r in rests], np.int64), window):
            offset = 0
            for k in members:
                out.append((*rests[k][:5], sequence, offset, *rests[k][5:]))
                offset += rests[k][2]
            sequence += 1
        return made(out), sequence

    def rows(batches):
        coder = encoder(vocabulary)
        sequence = TaskContext.get().partitionId() * SEQUENCES
        rests: list[tuple] = []
        for b in batches:
            full = []
            for doc, ids in zip(b.column(0).to_pylist(), coder.encode(b.column(1)), strict=True):
                ids += tail
                n = len(ids) // 4
                for start in range(0, n, window):
                    part = ids[4 * start : 4 * (start + window)]
                    piece = (doc, start, len(part) // 4, zlib.crc32(part), n)
                    if len(part) == 4 * window:
                        full.append((*piece, sequence, 0, *([part] if with_ids else [])))
                        sequence += 1
                    else:
                        rests.append((*piece, *([part] if with_ids else [])))
            if full:
                yield made(full)
            while len(rests) >= HELD:
                batch, sequence = packed(rests[:HELD], sequence)
                rests = rests[HELD:]
                yield batch
        if rests:
            yield packed(rests, sequence)[0]

    return own.mapInArrow(rows, PIECES + ", ids binary" * with_ids)
