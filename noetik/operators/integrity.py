"""Hash trees over key ranges: where a table and its projection differ, without comparing all rows.

A leaf covers WIDTH neighbouring integer keys; a node of a higher level covers FANOUT nodes below it, up to one root.
Each holds the number of its rows and three digests of their 64-bit hashes: the sum, the exclusive or, and the sum of
hashes of the hashes. Trees are compared from the root down: a level is read only for the children of nodes that differ,
so equal trees end at the root, and rows are read in the ranges of leaves that differ and nowhere else.

Rows without a key share a leaf of their own, number null. Keys may repeat; rows count as often as they come.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

WIDTH, FANOUT = 64, 16
MOST_RANGES = 200  # of leaves that go to the scan as ranges


def tree(rows: DataFrame, key: str, columns: list[str], width: int = WIDTH) -> DataFrame:
    """level (0: leaves), node, n and digests of every node that has rows. Cells are hashed by column with their kind, so
    that two swapped cells are a difference."""
    row = F.xxhash64(F.lit(key), key, *[x for c in columns for x in (F.lit(c), F.col(c).isNull(), F.col(c))])
    leaves = rows.select(F.floor(F.col(key) / width).alias("node"), row.alias("h"))
    wide = lambda c: c.cast("decimal(38,0)")
    level = cut(leaves.groupBy("node").agg(F.count("*").alias("n"), F.sum(wide(F.col("h"))).alias("total"), F.bit_xor("h").alias("mixed"), F.sum(wide(F.xxhash64("h"))).alias("again")))
    low, high = level.agg(F.min("node"), F.max("node")).first()
    out, depth = [level.withColumn("level", F.lit(0))], 0
    low, high = low or 0, high or 0
    while (low, high) not in ((0, 0), (-1, -1), (-1, 0)) or depth == 0:
        depth += 1
        low, high = low // FANOUT, high // FANOUT
        above = out[0].where("node is not null").groupBy(F.floor(F.col("node") / (FANOUT**depth)).alias("node"))
        out.append(above.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.bit_xor("mixed").alias("mixed"), F.sum("again").alias("again")).withColumn("level", F.lit(depth)))
    root = out[0].agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.bit_xor("mixed").alias("mixed"), F.sum("again").alias("again")).withColumn("level", F.lit(-1)).withColumn("node", F.lit(0).cast("long"))
    return reduce(lambda a, b: a.unionByName(b), [*out, root.where("n > 0")])


DIGESTS = ["n", "total", "mixed", "again"]


def _differ(a: DataFrame, b: DataFrame) -> DataFrame:
    side = lambda df, p: df.select("node", F.struct(*DIGESTS).alias(p))
    x, y = side(a, "x"), side(b, "y").withColumnRenamed("node", "other")
    met = x.join(y, F.col("node").eqNullSafe(F.col("other")), "full").where(~F.col("x").eqNullSafe(F.col("y")))
    return met.select(F.coalesce("node", "other").alias("node"))


def differing_leaves(a: DataFrame, b: DataFrame) -> tuple[DataFrame | None, list[int]]:
    """The leaves in which two trees (stored tables) differ, and how many nodes differ on each level read, from the root
    down; no leaves, and one number, for equal trees."""
    of = lambda t, k: t.where(F.col("level") == k)
    seen = [_differ(of(a, -1), of(b, -1)).count()]
    if not seen[0]:
        return None, seen
    top = max(r[0] or 0 for r in (t.agg(F.max("level")).first() for t in (a, b)))
    at = _differ(of(a, top), of(b, top))
    seen.append(at.count())
    for level in range(top - 1, -1, -1):
        below = F.explode(F.transform(F.sequence(F.lit(0), F.lit(FANOUT - 1)), lambda k: F.col("node") * FANOUT + k)).alias("node")
        children = at.select(below)
        if level == 0:  # rows without a key have no node above
            children = children.unionByName(a.sparkSession.createDataFrame([(None,)], "node long"))
        pick = lambda t: of(t, level).join(children.withColumnRenamed("node", "c"), F.col("node").eqNullSafe(F.col("c")), "left_semi")  # noqa: B023, E731
        at = _differ(pick(a), pick(b))
        seen.append(at.count())
    return at, seen


def rows_of(rows: DataFrame, key: str, leaves: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of some leaves. Few leaves reach the scan as ranges of the key; many are joined."""
    some = [r.node for r in leaves.limit(MOST_RANGES + 1).collect()]  # bounded
    if len(some) <= MOST_RANGES:
        tests = [F.col(key).isNull() if n is None else F.col(key).between(n * width, (n + 1) * width - 1) for n in some]
        return rows.where(reduce(lambda x, y: x | y, tests, F.lit(False)))
    return rows.withColumn("_leaf", F.floor(F.col(key) / width)).join(leaves.select(F.col("node").alias("_n")), F.col("_leaf").eqNullSafe(F.col("_n")), "left_semi").drop("_leaf")


def changed(a: DataFrame, b: DataFrame, leaves: DataFrame | None, key: str, columns: list[str], width: int = WIDTH) -> DataFrame:
    """key, change (missing in b, extra in b, changed) of the rows that differ in the leaves; keys are taken as unique."""
    if leaves is None:
        return a.limit(0).select(key, F.lit("").alias("change"))
    side = lambda df, p: rows_of(df, key, leaves, width).select(F.col(key).alias(f"_{p}"), F.struct(*columns).alias(p), F.lit(True).alias(f"in_{p}"))
    met = side(a, "x").join(side(b, "y"), F.col("_x").eqNullSafe(F.col("_y")), "full")
    change = F.when(F.col("in_y").isNull(), "missing").when(F.col("in_x").isNull(), "extra").when(~F.col("x").eqNullSafe(F.col("y")), "changed")
    return met.select(F.coalesce("_x", "_y").alias(key), change.alias("change")).where("change is not null")
