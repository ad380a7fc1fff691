"""Words of texts as DataFrame expressions, for the operators that run no Python on executors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Least and most longs of a bit table that drops keys which cannot match before any row is made of them.
TABLE, MOST_TABLE = 1024, 16384


def lowered(text: Column) -> Column:
    """Lower-case A-Z and no other letter; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(text: Column) -> Column:
    """Runs of a-z, 0-9 and characters from U+0080 on, after lowered()."""
    return F.filter(F.split(lowered(text), BETWEEN), lambda w: w != "")


def bits_of(keys: DataFrame, key: str, n: int = 0) -> list[int]:
    """Longs in which the bits of all keys are set: about 16 bits for each of n keys, within TABLE and MOST_TABLE. More
    keys set more bits; then more keys that cannot match pass, and the join drops them."""
    size = TABLE
    while size < MOST_TABLE and 4 * size < n:
        size *= 2
    slot, bit = (F.shiftrightunsigned(F.col(key), 6).bitwiseAND(size - 1)).alias("slot"), F.col(key).bitwiseAND(63).cast("int")
    rows = keys.select(slot, bit.alias("bit")).groupBy("slot").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).collect()  # at most size rows
    out = [0] * size
    for r in rows:
        out[r.slot] = r.bits
    return out


def maybe(table: Column, size: int, key: Column) -> Column:
    """False if key is not in the table of so many longs."""
    bits = F.get(table, F.shiftrightunsigned(key, 6).bitwiseAND(size - 1).cast("int"))
    return F.getbit(bits, key.bitwiseAND(63).cast("int")) == 1


def literal(values: list[int]) -> Column:
    return F.expr("array(" + ",".join(f"{v}L" if v > -(2**63) else "(-9223372036854775807L - 1L)" for v in values) + ")")


def slices(docs: DataFrame, id_col: str, n: int, most: int = 256) -> Column:
    """The number of the slice an integer id falls in, ascending with it: quantiles, and beyond `most` of them parts
    of equal width inside each. A null id goes to slice -1."""
    coarse = min(n, most)
    got = docs.agg(F.percentile_approx(F.col(id_col), F.array(*[F.lit(k / coarse) for k in range(coarse + 1)]), F.lit(20_000))).first()[0]
    bounds = sorted(set(got or []))
    parts = math.ceil(n / most)
    key = F.col(id_col)

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            if parts == 1:
                return F.lit(lo)
            low, high = bounds[lo], bounds[min(lo + 1, len(bounds) - 1)]
            part = F.floor((key - low) / F.lit(max(1.0, (high - low + 1) / parts))).cast("int")
            return F.lit(lo * parts) + F.greatest(F.lit(0), F.least(F.lit(parts - 1), part))
        mid = (lo + hi + 1) // 2
        return F.when(key < bounds[mid], tree(lo, mid - 1)).otherwise(tree(mid, hi))

    return F.when(key.isNull(), F.lit(-1)).otherwise(tree(0, max(0, len(bounds) - 2))) if bounds else F.lit(-1)
