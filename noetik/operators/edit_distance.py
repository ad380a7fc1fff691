"""Pairs of strings within an edit distance, by a segment index.

A string of more than `distance` characters is cut into distance + 1 segments. A string within the distance of it holds
one of them, near the segment's place: how near depends on the segment's number and on the difference of both lengths.
So strings are joined by length, number and text of a segment, and then verified.

Two cases go another way, on the strings that are left of both when up to `distance` characters are taken out; two
strings within the distance share one of these. Strings of at most `distance` characters can't be cut; they and their
partners are short. And a segment that more than HOT strings have (a common begin of names, say) would pair all of them:
what has or meets such a segment is joined by the strings left instead, which only like strings share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

HOT = 64
SHARE = 500  # strings whose rests go to one task: few bytes, but many pairs


def variants(name: Column, distance: int) -> Column:
    """What is left of a string when up to `distance` characters are taken out."""
    one = lambda x: F.when(F.length(x) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))).otherwise(F.array().cast("array<string>"))
    level, out = F.array(name), [F.array(name)]
    for _ in range(distance):
        level = F.array_distinct(F.flatten(F.transform(level, one)))
        out.append(level)
    return F.array_distinct(F.flatten(F.array(*out)))


def segments(length: Column, number: Column, distance: int) -> tuple[Column, Column]:
    """The place (from 1) and the size of a segment (numbers from 1) of strings of a length."""
    base, more = F.floor(length / (distance + 1)).cast("int"), length % (distance + 1)
    # the last segments have one character more where the length can't be divided
    first = F.lit(distance + 1) - more
    size = base + F.when(number > first, 1).otherwise(0)
    return 1 + (number - 1) * base + F.greatest(number - 1 - first, F.lit(0)), size


def near_strings(left: DataFrame, right: DataFrame, distance: int, ordered: bool = False) -> DataFrame:
    """a, b, distance: the pairs of a distinct string `name` of left and one of right within the distance, equal ones
    too; ordered: those with a < b only. Nulls are in no pair."""
    asked = cut(left.where("name is not null").select(F.col("name").alias("a")).distinct().withColumn("m", F.length("a")))
    known = cut(right.where("name is not null").select(F.col("name").alias("b")).distinct().withColumn("n", F.length("b")))
    numbers = F.explode(F.sequence(F.lit(1), F.lit(distance + 1)))
    # the index: a row for each segment of the strings of right that can be cut
    place, size = segments(F.col("n"), F.col("i"), distance)
    index = known.where(F.col("n") > distance).withColumn("i", numbers).withColumn("segment", F.substring("b", place, size))
    hot = index.groupBy("n", "i", "segment").agg(F.count("*").alias("many")).where(F.col("many") > HOT).select("n", "i", "segment", F.lit(True).alias("hot"))
    index = cut(index.join(hot, ["n", "i", "segment"], "left"))
    # the probes: for each length in reach, the substrings that can be its segments
    lengths = F.explode(F.sequence(F.greatest(F.col("m") - distance, F.lit(distance + 1)), F.greatest(F.col("m") + distance, F.lit(distance + 1))))
    probes = asked.withColumn("n", lengths).where(F.abs(F.col("m") - F.col("n")) <= distance).withColumn("i", numbers)
    longer, i, rest = F.col("m") - F.col("n"), F.col("i"), F.lit(distance + 1) - F.col("i")
    low = F.greatest(F.lit(1), place - (i - 1), place + longer - rest)
    high = F.least(F.col("m") - size + 1, place + (i - 1), place + longer + rest)
    probes = probes.withColumn("low", low).withColumn("high", high).where("high >= low")
    probes = probes.select("a", "n", "i", F.explode(F.array_distinct(F.transform(F.sequence("low", "high"), lambda k: F.substring(F.col("a"), k, size)))).alias("segment"))
    near = F.levenshtein("a", "b", distance) >= 0
    near = F.when(F.col("a") < F.col("b"), near).otherwise(False) if ordered else near
    found = probes.join(index.where("hot is null").select("b", "n", "i", "segment"), ["n", "i", "segment"]).where(near).select("a", "b")
    # what meets by frequent segments only, and short strings
    met_a = cut(probes.join(hot, ["n", "i", "segment"], "left_semi").select("a").distinct())
    met_b = index.where("hot").select("b").distinct()
    tasks = max(1, -(-met_a.count() // SHARE))
    left_over = lambda df, c: df.repartition(tasks).select(c, F.explode(variants(F.col(c), distance)).alias("left")).repartition(tasks, "left")
    by_rest = left_over(met_a, "a").join(left_over(met_b, "b"), "left").where(near).select("a", "b")
    short = left_over(asked.where(F.col("m") <= 2 * distance), "a").join(left_over(known.where(F.col("n") <= distance), "b"), "left").where(near).select("a", "b")
    return found.unionByName(by_rest).unionByName(short).distinct().select("a", "b", F.levenshtein("a", "b").alias("distance"))


def near_names(names: DataFrame, distance: int) -> DataFrame:
    """a, b, n_a, n_b, distance: pairs of different names within the distance, each by the smallest id that has it, with
    the number of ids. names: id, name. Ids of one name are one class; membership is the name itself."""
    classes = cut(names.where("name is not null").groupBy("name").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    pairs = near_strings(classes, classes, distance, ordered=True)
    side = lambda c: classes.select(F.col("name").alias(c), F.col("id").alias(f"id_{c}"), F.col("n").alias(f"n_{c}"))
    out = pairs.join(side("a"), "a").join(side("b"), "b")
    swap = F.col("id_a") > F.col("id_b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return out.select(pick("id_a", "id_b").alias("a"), pick("id_b", "id_a").alias("b"), pick("n_a", "n_b").alias("n_a"), pick("n_b", "n_a").alias("n_b"), "distance")
