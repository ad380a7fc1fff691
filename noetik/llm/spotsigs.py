"""SpotSigs fingerprints, in DataFrame expressions only.

A signature is an anchor with the CHAIN content words that follow it within REACH words; a fingerprint is the set of a
text's signatures as 32-bit hashes, written as sorted hex. Anchors are common words, and beside them every content word
whose hash is a multiple of SPARE, so that texts with few common words have signatures too, and a small edit changes few
of them whatever the text. A text too short for any chain has one signature of all its words, so equal texts always have
equal fingerprints. Words are hashed once, with a bit that says common; all that follows works on numbers. Sets are
compared by Jaccard similarity: pairs whose sizes alone keep it below the threshold are pruned.

near_duplicates() partitions sets by length, so that similar sets are in the same or in neighbouring partitions, and
joins on the rarest signatures only as far as the threshold demands; equal sets are compared once.

Null text: empty. Repeated ids and ties are ordered by the hash of their texts; a null id comes last in descending order.
The next document of a single one is itself. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import blocks as B
from . import words as W

CHAIN, REACH, SPARE = 2, 8, 4
#: Common words of English, German, French and Spanish.
ANCHORS = """
a an and are as at be by for from has have he in is it not of on or that the this to was were which will with you
aber als auch auf aus bei das dem den der des die ein eine einen er es für hat im ist mit nach nicht sich sie sind und von wie zu zum
au aux avec ce ces dans de du elle en est et il la le les leur mais ne nous ou par pas plus pour qui que se son sur un une
al como con cuando del el era esta este fue ha las lo los más muy no para pero por porque si sin su sus todo una uno y
""".split()


def coded(w: Column) -> Column:
    """Words as numbers: even for content words, odd for common ones."""
    return F.transform(w, lambda x: F.xxhash64(x).bitwiseAND(-2) + F.when(x.isin(ANCHORS), 1).otherwise(0))


def signatures(c: Column) -> Column:
    """The set of 32-bit signature hashes of an array of coded words."""

    def at(x, i):
        near = F.filter(F.slice(c, i + 2, REACH), lambda y: y.bitwiseAND(1) == 0)
        anchor = (x.bitwiseAND(1) == 1) | (F.pmod(F.shiftright(x, 1), F.lit(SPARE)) == 0)
        # through an array of one, so that the words near are looked up once
        return F.when(anchor, F.get(F.transform(F.array(near), lambda n: F.when(F.size(n) >= CHAIN, F.hash(x, *[F.get(n, F.lit(j)) for j in range(CHAIN)]))), F.lit(0)))

    return F.array_distinct(F.array_compact(F.transform(c, at)))


def fingerprinted(df: DataFrame, text: str, into: str) -> DataFrame:
    """df with a column more: the sorted set."""
    c, s = f"{into}_codes", f"{into}_set"
    out = df.withColumn(c, coded(W.words(F.col(text)))).withColumn(s, signatures(F.col(c)))
    return out.withColumn(into, F.when(F.size(s) == 0, F.array(F.hash(c))).otherwise(F.array_sort(s))).drop(c, s)


def written(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), "")


def likeness(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Jaccard similarity of two sets; 0 without a look at them if their sizes keep it below the threshold."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(small >= threshold * large, common / (small + large - common)).otherwise(0.0)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs a < b of class representatives (the smallest id with a set) of at least that likeness, and members, which
    has each row's representative: (pairs, members)."""
    own = fingerprinted(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "sig").select("id", "sig").withColumn("key", F.sha2(F.to_json("sig"), 256))
    own = cut(own)
    classes = own.groupBy("key").agg(F.min("id").alias("rep"))
    sets = own.join(classes, (own.key == classes.key) & (own.id == classes.rep), "left_semi").dropDuplicates(["key"])
    sets = sets.withColumn("part", F.floor(F.log(F.size("sig")) / F.lit(-math.log(threshold))).cast("int"))
    each = sets.select("id", "part", F.size("sig").alias("n"), F.explode("sig").alias("g"))
    common = each.groupBy("g").agg(F.count("*").alias("df"))
    ranked = each.join(common, "g").withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("df", "g")))
    prefix = ranked.where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).select("id", "part", "n", "g")
    left = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "g", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part"))
    right = prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "g", "part")
    pairs = left.join(right, ["g", "part"]).where("a < b").where(F.least("na", "nb") >= threshold * F.greatest("na", "nb")).select("a", "b").distinct()
    side = lambda c: sets.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}"))
    scored = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("likeness", likeness(F.col("sig_a"), F.col("sig_b"), threshold))
    members = own.join(classes, "key").select("id", "rep")
    return scored.where(F.col("likeness") >= threshold).select("a", "b", "likeness"), members


def with_next(docs: DataFrame, carried: list[str], n: int) -> DataFrame:
    """docs (doc_id, text, ...) with next_<c> of the next document, in descending order of doc_id; the last one's next is
    the first. Documents are dealt to slices of ids; each slice also gets the first document of the slice below."""
    docs = docs.withColumn("slice", W.slices(docs, "doc_id", n)).withColumn("tie", F.xxhash64("text"))
    tops = docs.groupBy("slice").agg(F.max("doc_id").alias("top"))
    order = Window.orderBy("slice")
    tops = tops.select("top", "slice", F.lead("slice").over(order).alias("above"), F.min("slice").over(Window.partitionBy()).alias("lowest"))
    tops = F.broadcast(tops.select(F.col("slice"), F.col("top"), F.coalesce("above", "lowest").alias("goes")))  # a row for each slice
    copies = docs.join(tops, (docs.slice == tops.slice) & docs.doc_id.eqNullSafe(tops.top)).select(*[docs[c] for c in docs.columns if c != "slice"], F.col("goes").alias("slice"), F.lit(True).alias("copy"))
    every = docs.withColumn("copy", F.lit(False)).unionByName(copies)
    w = Window.partitionBy("slice").orderBy("copy", F.desc("doc_id"), "tie", "text")
    return every.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried]).where("not copy").drop("slice", "tie", "copy")


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fingerprints of every text, of its edited text and their likeness to it and to the next document's."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = B.block_count(own)
    own = with_next(fingerprinted(own, "text", "sig"), ["text", "sig"], n)
    own = own.withColumn("n_chars", F.length("text").cast("long")).withColumn("third", F.floor(F.col("n_chars") / 3).cast("int"))
    own = own.withColumn("changed", F.concat(F.expr("substring(text, 1, cast(n_chars as int) - third)"), F.expr("substring(next_text, 1, third)"))).drop("text", "next_text")
    own = fingerprinted(own, "changed", "changed_sig")
    return own.select(
        "doc_id", "n_chars", F.sha2(F.col("changed").cast("binary"), 256).alias("edited_sha256"), written(F.col("sig")).alias("fingerprint"),
        written(F.col("changed_sig")).alias("edited_fingerprint"), likeness(F.col("sig"), F.col("changed_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
