"""Hard negatives through a pivot table.

An integer vector x gets one more component, sqrt(M - |x|^2), where M is the largest squared norm; an anchor q gets 0.
Then |q - x|^2 = |q|^2 + M - 2 * (q, x): a larger inner product is a smaller Euclidean distance. For each row the
distances to PIVOTS pivots are stored beside its vector. By the triangle inequality the distance of q and x lies between
the largest difference and the smallest sum of their distances to a pivot, which brackets the inner product. Rows whose
bracket can't reach an anchor's threshold (of whole blocks at once, by each pivot's range in the block) are left out; the
others are checked exactly. The brackets are widened by more than the rounding of floating-point numbers, so they lose nothing.

An anchor's threshold is the score of its k-th best row among the anchors of its own block, found exactly. It is a lower
bound of the k-th best of all rows, so that a block passes on few rows at most.

Rows and anchors are packed into blocks of bounded size; each block of anchors meets each block of rows once for the
positives and once for the negatives. What blocks pass on, at most k rows for each list, is ranked by a window.

Scores are exact: in single or double precision while no sum can leave the integers that these hold, else as integers of
any size (a score beyond 64 bits raises). A row without label, vector or a component takes no part. Vectors of different
lengths are compared as if zeros stood behind the shorter one. Repeated ids are rows of their own, but a row with an
anchor's id is no positive of it. A null id is no anchor and comes last among ties. Equal vectors tie by id. An anchor
without positives, or a positive without negatives, gives no row; so does an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .blocks import trim

PIVOTS, SAMPLE = 8, 512  # pivots are chosen far apart from a sample of so many rows; they decide speed alone
ROWS, ANCHORS = 16384, 2048  # of a block
LEAST_ROWS, LEAST_BLOCKS = 256, 16  # blocks are smaller when there would be fewer than LEAST_BLOCKS
TILE = 1 << 20  # pairs that are looked at together
FEW = 12  # pairs are checked one by one where less than one of FEW survives
NONE, ANY = np.iinfo(np.int64).max, np.iinfo(np.int64).min  # as a threshold
PACKED = "ids binary, no_id binary, labels binary, vectors binary, distances binary, more binary"


class Shape:
    """What all blocks share: components, the largest size of one, the largest squared norm and the pivots."""

    def __init__(self, size: int, most: int, norm: float, pivots: np.ndarray):
        self.size, self.norm = size, norm
        self.kind = next((k for k in (np.int16, np.int32) if most <= np.iinfo(k).max), np.int64)
        whole = most * most * max(size, 1)
        self.exact = np.float32 if whole < 1 << 24 else np.float64 if whole < 1 << 53 else object
        self.pivots, self.above = pivots.astype(np.float64), self.lift(pivots.astype(np.float64))
        self.slack = 1 + 1e-9 * self.norm

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.norm - (x * x).sum(axis=1), 0))

    def distances(self, x: np.ndarray, above: np.ndarray) -> np.ndarray:
        """To each pivot, of vectors whose added component is above."""
        square = (x * x).sum(axis=1) + above * above
        both = square[:, None] + self.norm - 2 * (x @ self.pivots.T + above[:, None] * self.above)
        return np.sqrt(np.maximum(both, 0))


class Block:
    """Rows with their vectors and pivot distances, by label."""

    def __init__(self, shape: Shape, ids, no_id, labels, vectors, distances, more=b""):
        self.ids, self.no_id, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(no_id, bool), np.frombuffer(labels, np.int64)
        self.vectors = np.frombuffer(vectors, shape.kind).reshape(-1, shape.size).astype(shape.exact)
        self.distances = np.frombuffer(distances, np.float64).reshape(-1, len(shape.pivots))
        self.more = more

    def __len__(self):
        return len(self.ids)


def packed(shape: Shape, table: pa.Table, anchors: bool) -> tuple:
    """A block's columns, from rows of vec_id, label and vector; rows go by label."""
    table = table.take(pc.sort_indices(table.column("label")))
    lists = table.column("vector").combine_chunks()
    x = np.zeros((len(table), shape.size), np.int64)
    many = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(many)), many)
    x[row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)] = lists.flatten().to_numpy(zero_copy_only=False)
    wide = x.astype(np.float64)
    distances = shape.distances(wide, np.zeros(len(x)) if anchors else shape.lift(wide))
    ids = table.column("vec_id")
    return (
        pc.fill_null(ids, 0).to_numpy().astype(np.int64).tobytes(), pc.is_null(ids).to_numpy().tobytes(),
        table.column("label").to_numpy().astype(np.int64).tobytes(), x.astype(shape.kind).tobytes(), distances.tobytes(),
    )


def bracket(shape: Shape, anchors: Block, rows: Block, a: slice, r: slice) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product that the pivot distances allow, for each anchor of a and row of r."""
    p, q = anchors.distances[a], rows.distances[r]
    apart, sum_ = np.abs(p[:, :1] - q[:, 0]), p[:, :1] + q[:, 0]
    for k in range(1, p.shape[1]):
        np.maximum(apart, np.abs(p[:, k : k + 1] - q[:, k]), out=apart)
        np.minimum(sum_, p[:, k : k + 1] + q[:, k], out=sum_)
    base = ((anchors.vectors[a].astype(np.float64) ** 2).sum(axis=1) + shape.norm)[:, None]
    return (base - sum_ * sum_) / 2 - shape.slack, (base - apart * apart) / 2 + shape.slack


def reach(shape: Shape, anchors: Block, rows: Block) -> np.ndarray:
    """For each anchor an upper bound of its score with any row of the block, from each pivot's range in the block."""
    low, high = rows.distances.min(axis=0), rows.distances.max(axis=0)
    apart = np.maximum(np.maximum(low - anchors.distances, anchors.distances - high), 0).max(axis=1)
    return ((anchors.vectors.astype(np.float64) ** 2).sum(axis=1) + shape.norm - apart * apart) / 2 + shape.slack


def scores(anchors: Block, rows: Block, a: slice, r: slice, alive: np.ndarray) -> np.ndarray:
    """Exact scores of the pairs that are alive; of others any number."""
    if alive.sum() * FEW < alive.size:
        i, j = np.nonzero(alive)
        out = np.zeros(alive.shape, np.int64)
        out[i, j] = (anchors.vectors[a][i] * rows.vectors[r][j]).sum(axis=1)
        return out
    return (anchors.vectors[a] @ rows.vectors[r].T).astype(np.int64)


def best(score: np.ndarray, alive: np.ndarray, rows: Block, r: slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each anchor its first k rows that are alive: anchors and places of rows, by anchor and rank."""
    many = alive.sum(axis=1)
    if (dense := np.flatnonzero(many > 4 * k)).size:
        own = np.where(alive[dense], score[dense], np.iinfo(np.int64).min)
        alive = alive.copy()
        alive[dense] &= own >= np.partition(own, -k, axis=1)[:, -k, None]
    i, j = np.nonzero(alive)
    order = np.lexsort((rows.ids[r][j], rows.no_id[r][j], -score[i, j], i))
    i, j = i[order], j[order]
    first = np.searchsorted(i, i)
    use = np.arange(len(i)) - first < k
    return i[use], j[use]


def tiles(anchors: slice, rows: slice) -> Iterator[tuple[slice, slice]]:
    step = max(1, TILE // max(1, rows.stop - rows.start))
    for i in range(anchors.start, anchors.stop, step):
        yield slice(i, min(i + step, anchors.stop)), rows


def own_label(block: Block, label: int) -> slice:
    return slice(*(int(np.searchsorted(block.labels, label, side=s)) for s in ("left", "right")))


def positives_of(shape: Shape, anchors: Block, rows: Block, least: np.ndarray, k: int) -> Iterator[tuple]:
    """Anchors, places of rows and scores of the first k rows of each anchor's label with at least its threshold."""
    far = reach(shape, anchors, rows) < least
    for label in np.unique(anchors.labels):
        a, r = own_label(anchors, label), own_label(rows, label)
        if r.start == r.stop or far[a].all():
            continue
        for part, r in tiles(a, r):
            floor = least[part][:, None]
            alive = ~far[part][:, None] & ((rows.ids[r] != anchors.ids[part][:, None]) | rows.no_id[r])
            if (floor > ANY).any():
                alive &= bracket(shape, anchors, rows, part, r)[1] >= floor
            if not alive.any():
                continue
            score = scores(anchors, rows, part, r, alive)
            i, j = best(score, alive & (score >= floor), rows, r, k)
            yield part.start + i, r.start + j, score[i, j]


def negatives_of(shape: Shape, anchors: Block, rows: Block, least: np.ndarray, most: np.ndarray, k: int) -> Iterator[tuple]:
    """Anchors, numbers of positives, places of rows and scores of the first k rows of other labels for each positive,
    with scores from least to most (anchors by positives; NONE to ANY: there is no such positive)."""
    floor, cap = least.min(axis=1), most.max(axis=1)
    far = reach(shape, anchors, rows) < floor
    for part, r in tiles(slice(0, len(anchors)), slice(0, len(rows))):
        if far[part].all():
            continue
        low, high = bracket(shape, anchors, rows, part, r)
        alive = ~far[part][:, None] & (rows.labels[r] != anchors.labels[part][:, None]) & (high >= floor[part][:, None]) & (low <= cap[part][:, None])
        if not alive.any():
            continue
        score = scores(anchors, rows, part, r, alive)
        for p in range(least.shape[1]):
            i, j = best(score, alive & (score >= least[part, p, None]) & (score <= most[part, p, None]), rows, r, k)
            yield part.start + i, np.full(len(i), p), r.start + j, score[i, j]


def lowest(anchor: np.ndarray, score: np.ndarray, n: int, k: int) -> np.ndarray:
    """Of n lists the score of the k-th entry, where there are so many; else ANY."""
    out = np.full(n, ANY)
    ends = np.searchsorted(anchor, np.arange(n), side="right")
    full = ends - np.searchsorted(anchor, np.arange(n)) >= k
    out[full] = score[ends[full] - 1]
    return out


def gathered(parts: list[tuple], columns: int) -> list[np.ndarray]:
    return [np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in range(columns)]


def shape_of(rows: DataFrame) -> tuple[Shape, int, int]:
    """The shape and the numbers of rows and of anchors."""
    value = lambda v: v.cast("double")
    got = rows.agg(
        F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.max(F.size("vector")).alias("size"),
        F.max(F.aggregate("vector", F.lit(0.0), lambda s, v: F.greatest(s, F.abs(value(v))))).alias("most"),
        F.max(F.aggregate("vector", F.lit(0.0), lambda s, v: s + value(v) * value(v))).alias("norm"),
    ).first()
    sample = [r.vector for r in rows.select("vector").orderBy(F.xxhash64("vec_id", "vector")).limit(SAMPLE).collect()]  # SAMPLE rows at most
    size = got["size"] or 0
    x = np.array([[*v, *[0] * (size - len(v))] for v in sample], np.float64).reshape(len(sample), size)
    given = size, int(got["most"] or 0), got["norm"] or 0.0
    shape = Shape(*given, np.zeros((1, size)))
    # each next pivot is the row farthest from those before
    chosen, above, near = [], shape.lift(x), np.full(len(x), np.inf)
    for _ in range(min(PIVOTS, len(x))):
        chosen.append(int(np.argmax(near)))
        step = ((x - x[chosen[-1]]) ** 2).sum(axis=1) + (above - above[chosen[-1]]) ** 2
        near = np.minimum(near, step)
    return Shape(*given, x[chosen] if chosen else np.zeros((1, size))), got.n, got.anchors


def block_number(n: int, most: int) -> tuple[Column, int]:
    blocks = max(min(LEAST_BLOCKS, -(-n // LEAST_ROWS)), -(-n // most), 1)
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int"), blocks


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its first
    `positives` rows of the same label the first `negatives` rows of other labels that score from low to high hundredths
    of the positive's score. rows: vec_id, label, vector (integers); other columns are ignored. Higher scores come first,
    ties by smaller vec_id."""
    rows = rows.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), F.col("vector").cast("array<bigint>"), (F.coalesce(anchor, F.lit(False)) & F.col("vec_id").isNotNull()).alias("anchor"))
    rows = rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda v: v.isNotNull()))
    shape, n, n_anchors = shape_of(rows)
    number, n_blocks = block_number(n, ROWS)
    group, _ = block_number(100 * n_anchors, 100 * ANCHORS)

    def pack_rows(key, table):
        out = (key[0].as_py(), *packed(shape, table, False), b"")
        return pa.Table.from_pylist([dict(zip(("block", *names), out, strict=True))], schema)

    names = [c.split()[0] for c in PACKED.split(", ")]
    schema = pa.schema([("block", pa.int32()), *((c, pa.binary()) for c in names)])
    blocks = cut(rows.select("vec_id", "label", "vector", number.alias("block")).groupBy("block").applyInArrow(pack_rows, f"block int, {PACKED}"))

    def pack_anchors(key, table):
        """more: each anchor's key and its threshold, from the anchors of the block."""
        own, of_rows = (Block(shape, *packed(shape, table, x)) for x in (True, False))
        parts = gathered(list(positives_of(shape, own, of_rows, np.full(len(own), ANY), positives)), 3)
        keys = table.take(pc.sort_indices(table.column("label"))).column("key").to_numpy().astype(np.int64)
        more = keys.tobytes() + lowest(parts[0], parts[2], len(own), positives).tobytes()
        out = (key[0].as_py(), *packed(shape, table, True), more)
        return pa.Table.from_pylist([dict(zip(("block", *names), out, strict=True))], schema)

    anchors = cut(rows.where("anchor").select("vec_id", "label", "vector", group.alias("block"), F.monotonically_increasing_id().alias("key")))

    def met(side: DataFrame) -> DataFrame:
        """Each block of anchors beside each block of rows."""
        side = side.select(*(F.col(c).alias(f"a_{c}") for c in names), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
        return blocks.join(side, "block").select(*names, *(f"a_{c}" for c in names))

    def pairs(batches):
        for b in batches:
            for r in b.to_pylist():
                yield Block(shape, *(r[f"a_{c}"] for c in names)), Block(shape, *(r[c] for c in names))
            trim()

    def find_positives(batches):
        for own, block in pairs(batches):
            keys, least = np.frombuffer(own.more, np.int64).reshape(2, len(own))
            a, r, s = gathered(list(positives_of(shape, own, block, least, positives)), 3)
            yield pa.RecordBatch.from_arrays([pa.array(keys[a]), pa.array(block.ids[r], mask=block.no_id[r]), pa.array(s)], ["key", "positive_id", "score"])

    seen = met(anchors.groupBy("block").applyInArrow(pack_anchors, f"block int, {PACKED}")).mapInArrow(find_positives, "key long, positive_id long, score long")
    order = Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("positive_id").asc_nulls_last())
    lists = seen.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    lists = lists.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "score"))).alias("positives"))

    def pack_pairs(key, table):
        """more: each anchor's positives, whether they have an id, their scores, and the least and greatest score of their negatives."""
        table = table.take(pc.sort_indices(table.column("label")))
        lists = table.column("positives").to_pylist()
        ids, null, score = np.zeros((len(lists), positives), np.int64), np.zeros((len(lists), positives), np.int64), np.zeros((len(lists), positives), np.int64)
        least, most = np.full(ids.shape, NONE), np.full(ids.shape, ANY)
        for i, found in enumerate(lists):
            for k, p in enumerate(found):
                ids[i, k], null[i, k], score[i, k] = p["positive_id"] or 0, p["positive_id"] is None, p["score"]
                least[i, k], most[i, k] = -(-low * p["score"] // 100), high * p["score"] // 100
        own, of_rows = (Block(shape, *packed(shape, table, x)) for x in (True, False))
        a, p, _, s = gathered(list(negatives_of(shape, own, of_rows, least, most, negatives)), 4)
        by = np.lexsort((-s, p, a))
        floor = lowest((a * positives + p)[by], s[by], ids.size, negatives).reshape(ids.shape)
        keys = np.repeat(table.column("key").to_numpy().astype(np.int64)[:, None], positives, axis=1)
        more = b"".join(x.tobytes() for x in (keys, ids, null, score, np.maximum(least, floor), most))
        out = (key[0].as_py(), *packed(shape, table, True), more)
        return pa.Table.from_pylist([dict(zip(("block", *names), out, strict=True))], schema)

    def find_negatives(batches):
        for own, block in pairs(batches):
            keys, ids, null, score, least, most = np.frombuffer(own.more, np.int64).reshape(6, len(own), positives)
            a, p, r, s = gathered(list(negatives_of(shape, own, block, least, most, negatives)), 4)
            out = [
                pa.array(keys[a, p]), pa.array(own.ids[a]), pa.array(p.astype(np.int32)), pa.array(ids[a, p], mask=null[a, p] == 1),
                pa.array(score[a, p]), pa.array(block.ids[r], mask=block.no_id[r]), pa.array(s),
            ]
            yield pa.RecordBatch.from_arrays(out, ["key", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"])

    side = anchors.join(lists, "key").groupBy("block").applyInArrow(pack_pairs, f"block int, {PACKED}")
    seen = met(side).mapInArrow(find_negatives, "key long, anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("key", "place").orderBy(F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last())
    seen = seen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return seen.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def scaled(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, vector by the contract's rule; rows without label or with a vector that is null or holds a null or
    non-finite component are left out."""
    known = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & known)
    return rows.select("vec_id", label.alias("label"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("vector"))
