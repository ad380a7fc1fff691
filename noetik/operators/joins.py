"""Joins that a plain equi join does not express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, discard, written

HOT = 4096  # edges of a node that go to one task
LIST = 256  # ids of equal rows that are paired at once
SIDE = 2048  # rows of a key on one side of a block
PAIRS = 8_000_000  # of a task
MOST_TASKS = 8192
SALTS = 4096  # parts of the rows without a key
MOST_COPIES = 1_000_000  # ids of copies that are sent to every task


def overlapping(left: DataFrame, right: DataFrame, key: list[str], width: int) -> DataFrame:
    """Pairs of equal key whose intervals [ls, le] and [rs, re] meet. Both are dealt to slots of `width`, so that only
    neighbours meet; a pair counts in the slot where it begins to overlap."""
    slots = lambda df, s, e: df.withColumn("slot", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width))))
    met = slots(left, "ls", "le").join(slots(right, "rs", "re"), [*key, "slot"])
    return met.where("ls <= re and rs <= le").where(F.floor(F.greatest("ls", "rs") / width) == F.col("slot")).drop("slot")


def pairs_of(rows: DataFrame, key: list[str], value: str, score: Callable[[Column, Column], Column]) -> DataFrame:
    """a, b, score: all pairs a < b of the ids (id) of equal key, none of which is null, with the score of their values,
    which must be symmetric.

    Ids of equal key and value are lists; two lists are scored once, and their ids are paired after it. The lists of a
    frequent key are dealt to blocks by the counted size, and a task gets pairs of blocks by their counted number."""
    given = rows.where(" and ".join(f"{c} is not null" for c in ("id", *key)))
    packed = given.select("id", F.struct(*key).alias("key"), F.struct(value).alias("of"))  # nulls in a struct are equal
    counts = cut(packed.groupBy("key", "of").agg(F.count("*").alias("n")))
    whole = counts.groupBy("key").agg(F.sum("n").alias("n"))
    pairs = whole.agg(F.sum(F.col("n").cast("double") * F.col("n") / 2)).first()[0] or 0.0
    tasks = min(MOST_TASKS, max(8, int(pairs // PAIRS)))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / LIST)).alias("part")
    lists = packed.join(counts, ["key", "of"]).select("key", "of", "id", part).groupBy("key", "of", "part").agg(F.collect_list("id").alias("ids"))
    blocks = whole.select("key", F.ceil(F.col("n") / SIDE).alias("blocks"))
    dealt = cut(lists.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("of", "part"), F.col("blocks"))))
    side = lambda own, other, least, most, c: dealt.select("key", F.col("own").alias(own), F.explode(F.sequence(least, most)).alias(other), F.struct("of", "part").alias(f"list_{c}"), F.col("ids").alias(f"ids_{c}")).repartition(tasks, "key", "p", "q")
    met = side("p", "q", F.col("own"), F.col("blocks") - 1, "x").join(side("q", "p", F.lit(0).cast("long"), F.col("own"), "y"), ["key", "p", "q"])
    met = met.where("p < q or list_x <= list_y")  # a pair of lists of one block meets once
    scored = met.select("ids_x", "ids_y", (F.col("list_x") == F.col("list_y")).alias("same"), score(F.col(f"list_x.of.{value}"), F.col(f"list_y.of.{value}")).alias("score"))
    each = scored.select("same", "score", F.explode("ids_x").alias("x"), "ids_y").select("same", "score", "x", F.explode("ids_y").alias("y"))
    return each.where("x < y or (x > y and not same)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")


def optional(left: DataFrame, right: DataFrame, key: str, own: str) -> DataFrame:
    """left with what right has of its key, if anything. Rows of left without a key would all go to one task; they are
    dealt by their column `own`."""
    dealt = left.withColumn("_salt", F.when(F.col(key).isNull(), F.pmod(F.xxhash64(own), F.lit(SALTS))).otherwise(0))
    # 0 for every key, but no literal, which would leave the salt out of the join's keys
    return dealt.join(right.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(1))), [key, "_salt"], "left").drop("_salt")


def latest_before(asked: DataFrame, facts: DataFrame, key: str, at: str, carried: list[str]) -> DataFrame:
    """For each asked row the last fact of its key at or before its time: one shuffle, no pairs."""
    fact = facts.select(key, at, F.struct(*carried).alias("fact"), F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in asked.dtypes if c not in (key, at)])
    ask = asked.withColumn("fact", F.lit(None).cast(fact.schema["fact"].dataType)).withColumn("kind", F.lit(1))
    w = Window.partitionBy(key).orderBy(at, "kind", *[F.col(f"fact.{c}") for c in carried]).rowsBetween(Window.unboundedPreceding, 0)
    out = fact.unionByName(ask).withColumn("found", F.last("fact", ignorenulls=True).over(w)).where("kind = 1")
    return out.select(*asked.columns, *[F.col(f"found.{c}").alias(c) for c in carried])


def merge_closure(merges: DataFrame) -> DataFrame:
    """id, canonical: the end of each chain (id, merged_into), by pointer doubling; null on a cycle. Each turn ends some
    chain as long as one is open, so once their number stays, what is open runs into cycles."""
    inner = merges.select(F.col("id").alias("canonical"), F.lit(True).alias("inner")).distinct()
    now = merges.select("id", F.col("merged_into").alias("canonical"))
    opened, before = now.join(inner, "canonical").count(), None
    while opened and opened != before:
        nxt = now.select(F.col("id").alias("canonical"), F.col("canonical").alias("next"))
        now = cut(now.join(nxt, "canonical", "left").select("id", F.coalesce("next", "canonical").alias("canonical")))
        opened, before = now.join(inner, "canonical").count(), opened
    ends = now.join(inner, "canonical", "left")
    return ends.select("id", F.when(F.col("inner").isNull(), F.col("canonical")).alias("canonical"))


def hops(edges: DataFrame, start: DataFrame, n: int) -> DataFrame:
    """id, hop: what is reached from start (id) over edges (a, b) in up to n hops, by the least number of hops."""
    seen = front = start.select("id", F.lit(0).alias("hop"))
    for k in range(1, n + 1):
        front = front.join(edges, front.id == edges.a).select(F.col("b").alias("id"), F.lit(k).alias("hop")).distinct().join(seen, "id", "left_anti")
        seen = seen.unionByName(front)
    return seen


def run_diff(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, change (added, removed, changed) of the rows of two runs that differ."""
    both = old.select(*key, F.col(value).alias("o"), F.lit(True).alias("in_old")).join(new.select(*key, F.col(value).alias("n"), F.lit(True).alias("in_new")), key, "full")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("o").eqNullSafe(F.col("n")), "changed")
    return both.select(*key, change.alias("change")).where("change is not null")


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """id, component: the smallest id that can be reached over edges (a, b), in either direction, of every id in an edge.

    Large stars and small stars take turns: each node's larger neighbours move to its smallest one, then its smaller
    neighbours and itself do, until nothing changes; the edges then are stars around the smallest ids. Edges grow by no
    round, a smallest neighbour is an aggregate, and the edges of a node of more than HOT neighbours are dealt to parts.
    Rows with a null are left out; an id that only meets itself is its own component."""
    edges = cut(edges.where("a is not null and b is not null").select("a", "b"))  # read twice
    alone = edges.where("a = b").select(F.col("a").alias("id"))
    now, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def star(nodes: DataFrame, emit) -> DataFrame:
        """nodes: u, v. Each edge beside the smallest of u and its neighbours."""
        least = nodes.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.ceil(F.count("*") / HOT).cast("int").alias("parts"))
        wide = least.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("u", "part", "m")
        dealt = nodes.join(least.where("parts > 1").select("u", "parts"), "u", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")))
        return emit(dealt.join(wide, ["u", "part"]))

    seen = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, lambda x: x.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        small = star(large, lambda x: x.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(x.select("u", F.col("m").alias("v")))).where("u <> v").distinct()
        (now, path), before = written(small), path
        discard(now.sparkSession, before)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    found = now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
    return found.unionByName(alone.distinct().join(found, "id", "left_anti").select("id", F.col("id").alias("component")))


def near_classes(sets: DataFrame, percent: int) -> DataFrame:
    """id, class_id, n_links of every row (id, tokens as hashes): equal sets are one class, named by its smallest id, and
    links are counted between classes of at least that exact Jaccard similarity. A class keeps the tokens that another one
    has too, and falls out if they are too few for any link. Only the rarest tokens of the others, as many as the threshold
    needs, are joined, and the pairs of a frequent one are spread by both its sides. A row without tokens is a class of
    its own. No copy is paired with a copy. The tokens are written once, and shuffled once, by token."""
    key = F.sha2(F.array_join(F.transform(F.array_sort("tokens"), lambda t: t.cast("string")), ","), 256)
    keyed, _ = written(sets.select("id", key.alias("key"), F.size("tokens").alias("n"), "tokens"))
    some = keyed.where("n > 0")
    classes = some.groupBy("key").agg(F.min("id").alias("class_id"))
    members = cut(some.select("id", "key").join(classes, "key").select("id", "class_id"))
    copies = members.where("id <> class_id").select("id")
    few = copies.limit(MOST_COPIES + 1).count() <= MOST_COPIES  # many are left out by a shuffle of the sets
    each = some.join(F.broadcast(copies) if few else copies.hint("merge"), "id", "left_anti").select(F.col("id").alias("class_id"), "n", F.explode("tokens").alias("t"))
    # tokens of one class alone come first in its order; they take places but meet nothing
    shared = each.withColumn("df", F.count("*").over(Window.partitionBy("t"))).where("df > 1")
    ranked = shared.groupBy("class_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("r"))
    spare = F.size("r") - F.ceil(F.col("n") * percent / 100)
    ranked = cut(ranked.where(spare >= 0).select("class_id", "n", (spare + 1).cast("int").alias("places"), F.col("r.t").alias("tokens")))
    prefix = ranked.select("class_id", "n", F.explode(F.slice("tokens", F.lit(1), F.col("places"))).alias("t"))
    hot = prefix.groupBy("t").agg(F.ceil(F.count("*") / 256).cast("int").alias("parts"), F.count("*").alias("df")).where("df > 1").drop("df")
    dealt = prefix.join(hot, "t").withColumn("own", F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int"))
    side = lambda c, p, q: dealt.select(F.col("class_id").alias(c), F.col("n").alias(f"n{c}"), "t", F.col("own").alias(p), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(q))
    near = F.least("na", "nb") * 100 >= percent * F.greatest("na", "nb")
    pairs = side("a", "p", "q").join(side("b", "q", "p"), ["t", "p", "q"]).where("a < b").where(near).select("a", "b").distinct()
    full = lambda c: ranked.select(F.col("class_id").alias(c), F.col("n").alias(f"n{c}"), F.col("tokens").alias(f"t{c}"))
    common = F.size(F.array_intersect("ta", "tb"))  # all that both hold is shared
    linked = pairs.join(full("a"), "a").join(full("b"), "b").where(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select(F.explode(F.array("a", "b")).alias("class_id"))
    counts = linked.groupBy("class_id").agg(F.count("*").alias("n_links"))
    out = members.join(counts, "class_id", "left").select("id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return out.unionByName(keyed.where("n = 0").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def exists(df: DataFrame, other: DataFrame, key: str | list[str]) -> DataFrame:
    return df.join(other, key, "left_semi")


def missing(df: DataFrame, other: DataFrame, key: str | list[str]) -> DataFrame:
    return df.join(other, key, "left_anti")
