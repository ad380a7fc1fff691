"""Blocks of vectors: approximate search through product-quantised codes, and exact similarity joins in cells.

Approximate search. Each vector is normed, cut into PIECES pieces and stored as one byte for each, the nearest of 256
centres of the piece. The centres are fitted on at most SAMPLE vectors, those of the lowest hashes; every vector is
coded and every code is scanned. A query adds up one table entry for each piece; its best candidates are scored again
with their vectors. So a query reads a code for each vector and a vector for each candidate.

Similarity join. Vectors go to the cell of their nearest pivot. If two normed vectors are at most r apart, the one lies
at most 2 r farther from the other's pivot than from its own (triangle inequality), so each also visits the cells within
that reach, of two cells those of the greater number the other, and a cell's own vectors meet its visitors in blocks. Nothing
is lost at any size; vectors without structure visit most cells, as no exact bound tells them apart.

Null ids or vectors, and vectors with a null or non-finite component, take no part; shorter vectors are filled with zeros. A
zero vector has likeness 0 to all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, ship

PIECES, CENTRES, ROUNDS, SAMPLE = 16, 256, 6, 8192
BLOCK, ASKED = 16384, 512  # rows and queries of a block
TILE = 1 << 22  # scores that are held at a time
CELL, CELL_BYTES = 16384, 1 << 26  # vectors of a cell, on average, and what they may take
MOST_PIVOTS = 1024


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id, v of the rows that take part."""
    known = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & known).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v"))


def matrix(column, width: int) -> np.ndarray:
    """Normed rows of a list column."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    many = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    x, row = np.zeros((len(many), width)), np.repeat(np.arange(len(many)), many)
    x[row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)] = lists.flatten().to_numpy(zero_copy_only=False)
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def sampled(rows: DataFrame, most: int, width: int) -> np.ndarray:
    got = rows.orderBy(F.xxhash64("id"), "id").limit(most).select("v").toArrow()  # at most `most` rows
    return matrix(got.column("v"), width)


def width_of(rows: DataFrame) -> tuple[int, int]:
    r = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    return r[0], -(-(r[1] or 1) // PIECES) * PIECES


def nearest_centres(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2 * (x @ centres.T), axis=1)


def fit(sample: np.ndarray) -> np.ndarray:
    """Centres of each piece: pieces, centres, components."""
    rng, size = np.random.default_rng(7), sample.shape[1] // PIECES
    out = np.zeros((PIECES, CENTRES, size))
    for p in range(PIECES):
        x = sample[:, p * size : (p + 1) * size]
        if not len(x):
            continue
        c = x[rng.choice(len(x), CENTRES, replace=len(x) < CENTRES)].copy()
        for _ in range(ROUNDS):
            own = nearest_centres(x, c)
            many = np.bincount(own, minlength=CENTRES)
            total = np.stack([np.bincount(own, x[:, k], CENTRES) for k in range(size)], axis=1)
            c[many > 0] = total[many > 0] / many[many > 0, None]
        out[p] = c
    return out


def codes_of(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    size = centres.shape[2]
    return np.stack([nearest_centres(x[:, p * size : (p + 1) * size], centres[p]) for p in range(PIECES)], axis=1).astype(np.uint8)


def blocks_of(rows: DataFrame, size: int, n: int, make, columns: str) -> DataFrame:
    """Rows (id, v) in numbered blocks of about size rows, each as make(table) gives it."""
    ship(rows.sparkSession)
    many = max(1, -(-n // size))
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(many)).cast("int")

    def pack(key, table):
        return pa.Table.from_pylist([{"block": key[0].as_py()} | make(table)], pa.schema([("block", pa.int32()), *((c.split()[0], pa.binary()) for c in columns.split(", "))]))

    return cut(rows.withColumn("block", number).groupBy("block").applyInArrow(pack, f"block int, {columns}")), many


def each_row(batches) -> Iterator[list[pa.Buffer]]:
    """The buffers of each row of binary columns. Batches are bounded in bytes by ship(), and no row is copied."""
    for b in batches:
        for k in range(b.num_rows):
            yield [c[k].as_buffer() for c in b.columns]


def ids_of(table) -> bytes:
    return table.column("id").to_numpy().astype(np.int64).tobytes()


def wanted(k: int, n: int) -> int:
    """Candidates of a query that are scored again: 20 for each result, but no more than a tenth of all where that is many."""
    return max(k, min(20 * k, n // 10), min(n, 40))


class Codes:
    """The codes of a table of vectors (id, v)."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.n, self.width = width_of(rows)
        self.centres = centres = fit(sampled(rows, SAMPLE, self.width))
        width = self.width
        make = lambda table: {"ids": ids_of(table), "codes": codes_of(matrix(table.column("v"), width), centres).tobytes()}
        self.blocks, self.many = blocks_of(rows, BLOCK, self.n, make, "ids binary, codes binary")

    def share(self, k: int) -> float:
        """What part of the vectors' bytes (of 4-byte components) a query reads."""
        return (self.n * PIECES + wanted(k, self.n) * self.width * 4) / max(1, self.n * self.width * 4)

    def candidates(self, queries: DataFrame, n_queries: int, k: int) -> DataFrame:
        """query_id, id: the wanted number of each query (id, v) by their codes."""
        width, centres, take = self.width, self.centres, wanted(k, self.n)
        make = lambda table: {"q_ids": ids_of(table), "q": matrix(table.column("v"), width).tobytes()}
        asked, _ = blocks_of(queries, ASKED, n_queries, make, "q_ids binary, q binary")
        side = asked.select("q_ids", "q", F.explode(F.sequence(F.lit(0), F.lit(self.many - 1))).alias("block"))

        def scan(batches) -> Iterator[pa.RecordBatch]:
            for ids, codes, q_ids, q in each_row(batches):
                ids, codes = np.frombuffer(ids, np.int64), np.frombuffer(codes, np.uint8).reshape(-1, PIECES)
                q_ids, q = np.frombuffer(q_ids, np.int64), np.frombuffer(q, np.float64).reshape(-1, width)
                step = max(1, TILE // max(1, len(ids)))
                for i in range(0, len(q), step):
                    part = q[i : i + step].reshape(-1, PIECES, centres.shape[2])
                    score = np.zeros((len(part), len(ids)))
                    for p in range(PIECES):
                        score += (part[:, p] @ centres[p].T)[:, codes[:, p]]
                    few = min(take, len(ids))
                    at = np.argpartition(score, len(ids) - few, axis=1)[:, len(ids) - few :]
                    found = np.take_along_axis(score, at, axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids[i : i + step], few)), pa.array(ids[at.ravel()]), pa.array(found.ravel())], ["query_id", "id", "near"])

        met = self.blocks.join(side, "block").select("ids", "codes", "q_ids", "q").mapInArrow(scan, "query_id long, id long, near double")
        order = Window.partitionBy("query_id").orderBy(F.desc("near"), "id")
        return met.withColumn("n", F.row_number().over(order)).where(F.col("n") <= take).select("query_id", "id")

    def top(self, queries: DataFrame, n_queries: int, k: int) -> DataFrame:
        """query_id, id, score, rank: the first k by cosine among the candidates, ties by id."""
        found = self.candidates(queries, n_queries, k).join(self.rows, "id").join(queries.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
        return ranked(found.select("query_id", "id", F.round(cosine(F.col("q"), F.col("v")), 6).alias("score")), k)


def cosine(a, b):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.coalesce(p * q, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact(rows: DataFrame, queries: DataFrame, n_queries: int, k: int) -> DataFrame:
    """query_id, id, score, rank: the first k of all rows, by every score, in blocks."""
    n, width = width_of(rows)
    make = lambda a, b: lambda table: {a: ids_of(table), b: matrix(table.column("v"), width).tobytes()}
    blocks, many = blocks_of(rows, BLOCK, n, make("ids", "x"), "ids binary, x binary")
    asked, _ = blocks_of(queries, ASKED, n_queries, make("q_ids", "q"), "q_ids binary, q binary")
    side = asked.select("q_ids", "q", F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("block"))

    def scan(batches):
        for ids, x, q_ids, q in each_row(batches):
            ids, x = np.frombuffer(ids, np.int64), np.frombuffer(x, np.float64).reshape(-1, width)
            q_ids, q = np.frombuffer(q_ids, np.int64), np.frombuffer(q, np.float64).reshape(-1, width)
            step = max(1, TILE // max(1, len(ids)))
            for i in range(0, len(q), step):
                score = np.round(q[i : i + step] @ x.T, 6)
                few = min(k, len(ids))
                least = np.partition(score, len(ids) - few, axis=1)[:, len(ids) - few, None]
                a, j = np.nonzero(score >= least)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[i : i + step][a]), pa.array(ids[j]), pa.array(score[a, j])], ["query_id", "id", "score"])

    return ranked(blocks.join(side, "block").select("ids", "x", "q_ids", "q").mapInArrow(scan, "query_id long, id long, score double"), k)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) as links of each id to the smallest that it reaches over them: no more than ids, and the same clusters."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    least = np.arange(len(ids))
    while True:
        low = np.minimum(least[x], least[y])
        now = least.copy()
        for at in (x, y, least[x], least[y]):
            np.minimum.at(now, at, low)
        now = now[now]
        if np.array_equal(now, least):
            break
        least = now
    use = least != np.arange(len(ids))
    return ids[least[use]], ids[use]


def similar(rows: DataFrame, least: float, clusters: bool = False) -> DataFrame:
    """a, b (a < b) of the rows (id, v) whose cosine is at least `least` (above 0). Equal vectors are paired with the
    smallest id that has theirs only, so a group of copies gives no more pairs than rows. With clusters the links that two
    blocks find are given as stars, which connect the same ids.

    A row is shuffled to its home cell only. The blocks of a cell send what is within reach to cells of smaller numbers, so
    two vectors meet once."""
    same = cut(rows.groupBy("v").agg(F.min("id").alias("id"), F.collect_list("id").alias("all")))
    copies = same.select(F.col("id").alias("a"), F.explode("all").alias("b")).where("a <> b")
    single = same.select("id", "v")
    n, width = width_of(single)
    ship(rows.sparkSession)
    size = max(1, min(CELL, CELL_BYTES // (8 * width)))
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-7
    pivots = sampled(single, max(1, min(MOST_PIVOTS, n // size)), width)

    def far_of(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))

    def deal(batches):
        for b in batches:
            x = matrix(b.column(1), width)
            home = np.where(x.any(axis=1), np.argmin(far_of(x), axis=1), -1)  # zero vectors are like none
            use = pa.array(np.flatnonzero(home >= 0))
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)).take(use), b.column(0).cast(pa.int64()).take(use), b.column(1).take(use)], ["cell", "id", "v"])

    dealt = single.mapInArrow(deal, "cell int, id long, v array<double>").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // size)))).cast("int"))

    def pack(key, table):
        x = matrix(table.column("v"), width)
        out = {"cell": key[0].as_py(), "part": key[1].as_py(), "ids": ids_of(table), "x": x.tobytes()}
        return pa.Table.from_pylist([out], pa.schema([("cell", pa.int32()), ("part", pa.int32()), ("ids", pa.binary()), ("x", pa.binary())]))

    packed = cut(dealt.groupBy("cell", "part").applyInArrow(pack, "cell int, part int, ids binary, x binary"))

    def send(batches):
        for b in batches:
            for k in range(b.num_rows):
                home, part, ids, x = b.column(0)[k].as_py(), b.column(1)[k].as_py(), b.column(2)[k].as_py(), b.column(3)[k].as_buffer()
                x = np.frombuffer(x, np.float64).reshape(-1, width)
                far, ids = far_of(x), np.frombuffer(ids, np.int64)
                near = far <= far[:, home, None] + 2 * reach
                near[:, home] = True
                for cell in range(home + 1):
                    if len(some := np.flatnonzero(near[:, cell])):
                        yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in ((cell, pa.int32()), (home, pa.int32()), (part, pa.int32()), (ids[some].tobytes(), pa.binary()), (x[some].tobytes(), pa.binary()))], ["cell", "home", "q_part", "q_ids", "q"])

    sent = packed.mapInArrow(send, "cell int, home int, q_part int, q_ids binary, q binary")
    met = packed.join(sent, "cell").where("home > cell or part <= q_part")

    def compare(batches):
        for b in batches:
            same = b.column(0).to_pylist()
            for alike, (ids, x, q_ids, q) in zip(same, each_row([b.select(["ids", "x", "q_ids", "q"])]), strict=True):
                ids, x = np.frombuffer(ids, np.int64), np.frombuffer(x, np.float64).reshape(-1, width)
                q_ids, q = np.frombuffer(q_ids, np.int64), np.frombuffer(q, np.float64).reshape(-1, width)
                step = max(1, TILE // max(1, len(ids)))
                for i in range(0, len(q), step):
                    a, j = np.nonzero(q[i : i + step] @ x.T >= least - 1e-12)
                    a, j = q_ids[i : i + step][a], ids[j]
                    if alike:  # a block with itself
                        a, j = a[a < j], j[a < j]
                    a, j = np.minimum(a, j), np.maximum(a, j)
                    if clusters:
                        a, j = stars(a, j)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(j)], ["a", "b"])

    linked = met.select(F.expr("home = cell and part = q_part").alias("alike"), "ids", "x", "q_ids", "q").mapInArrow(compare, "a long, b long")
    return linked.unionByName(copies.select(F.col("a").cast("long"), F.col("b").cast("long")))
