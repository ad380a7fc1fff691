"""Benchmark decontamination by winnowing, in DataFrame expressions only.

Every text is a sequence of word hashes. Of the K-gram hashes in each window of SPAN - K + 1, the least is kept, on
both sides, so two texts that share SPAN words share a kept K-gram at the same place of the shared run. Kept K-grams
carry their neighbourhood; where test and training meet, the match is extended to both sides and counts if it reaches
SPAN words. The neighbourhood is as long as an extension can matter, since each window of SPAN words has a kept K-gram
of its own. An item of fewer than SPAN words is one window, looked up at every place by the hash of all its words.

A table of bits drops document K-grams that no item has before rows are made of them. Whole and short items are
broadcast only if their counted rows are at most MOST_BROADCAST; else the join shuffles.

Null or wordless text: n_words 0, no hit. Wordless items match nothing. Repeated items and repeated documents each
count once, every row by itself; an id that occurs with several texts is an item with the windows of all of them. A null
item_id's windows count as hits, but it is not among the items. A null doc_id is kept. An empty table of documents gives
no rows; without items nothing is hit. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import words as W

SPAN, K = 13, 4
REACH = SPAN - K
MOST_BROADCAST = 200_000


def grams(h: Column, k: int) -> Column:
    """Hashes of all runs of k word hashes."""
    return F.transform(F.slice(h, 1, F.greatest(F.size(h) - (k - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)]))


def minima(g: Column) -> Column:
    """The least of each full window; of all if there is no full window."""
    w = SPAN - K + 1
    n = F.greatest(F.size(g) - (w - 1), F.least(F.size(g), F.lit(1)))
    return F.transform(F.slice(g, 1, n), lambda x, i: F.array_min(F.slice(g, i + 1, w)))


def kept(g: Column, least: Column, also: list[int] | None = None) -> Column:
    """Places and hashes of the K-grams that are the least of a window they are in."""
    w = SPAN - K + 1

    def wanted(s: Column) -> Column:
        first = F.greatest(s["p"] - (w - 1), F.lit(0))
        # least is named twice, so that the optimizer keeps it as a column and never puts its expression into this one,
        # where it would run again for every place
        is_least = F.array_contains(F.slice(least, first + 1, F.least(s["p"] - first + 1, F.size(least))), s["f"])
        return is_least if also is None else W.maybe(W.literal(also), len(also), s["f"]) & is_least

    return F.filter(F.transform(g, lambda f, i: F.struct(i.alias("p"), f.alias("f"))), wanted)


def whole_at(h: Column, n: int, table: list[int]) -> Column:
    """Places and hashes of runs of n words that are in the table."""
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - n, F.lit(0))), lambda i: F.struct(i.alias("p"), F.xxhash64(F.slice(h, i + 1, n)).alias("f")))
    return F.filter(runs, lambda s: W.maybe(W.literal(table), len(table), s["f"]))


def around(h: Column, p: Column) -> Column:
    return F.transform(F.sequence(F.lit(-REACH), F.lit(K + REACH - 1)), lambda j: F.get(h, p + j))


def hashed(df: DataFrame, text: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.transform(W.words(F.col(text)), lambda w: F.xxhash64(w)).alias("h"))


def run(equal: Column) -> Column:
    """How many true values an array begins with."""
    at = F.array_position(equal, False)
    return F.when(at == 0, F.size(equal).cast("long")).otherwise(at - 1)


def spans(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """row, doc_id, text_hash, n_words and, where an item's window occurs, item_id, s, e (the words from s to before e)."""
    tests = hashed(items, item_text, F.col(item_col).cast("string").alias("item_id")).where("size(h) > 0").distinct()
    whole = tests.where(F.size("h") >= SPAN).withColumn("g", grams(F.col("h"), K)).withColumn("m", minima(F.col("g")))
    whole = whole.select("item_id", "h", F.explode(kept(F.col("g"), F.col("m"))).alias("s")).select("item_id", F.col("s.f").alias("f"), around(F.col("h"), F.col("s.p")).alias("theirs")).distinct()
    short = tests.where(F.size("h") < SPAN).select("item_id", F.size("h").alias("n"), F.xxhash64("h").alias("f"))
    sizes = {r.n: r["count"] for r in short.groupBy("n").count().orderBy("n").collect()}  # at most SPAN - 1 rows
    n_rows = whole.count()
    counted = lambda df, n: F.broadcast(df) if n <= MOST_BROADCAST else df

    texts = hashed(docs, text_col, F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"))
    texts = texts.withColumn("g", grams(F.col("h"), K)).withColumn("m", minima(F.col("g")))
    found = kept(F.col("g"), F.col("m"), W.bits_of(whole, "f", n_rows))
    texts = texts.withColumn("hits", F.transform(found, lambda s: F.struct(s["p"].alias("p"), s["f"].alias("f"), around(F.col("h"), s["p"]).alias("ours"))))
    for n, many in sizes.items():
        texts = texts.withColumn(f"short{n}", whole_at(F.col("h"), n, W.bits_of(short.where(F.col("n") == n), "f", many)))
    base = ["row", "doc_id", "text_hash", "n_words"]
    # one pass over the texts, stored, so that a row keeps its number in every branch below
    texts = cut(texts.select("row", "doc_id", "text_hash", F.size("h").cast("long").alias("n_words"), "hits", *[f"short{n}" for n in sizes]))
    rows = texts.select(*base, F.explode_outer("hits").alias("x")).select(*base, "x.p", "x.f", "x.ours")
    joined = rows.join(counted(whole, n_rows), "f", "left")
    equal = F.zip_with("ours", "theirs", lambda a, b: F.coalesce(a == b, F.lit(False)))
    joined = joined.withColumn("eq", equal)
    left = run(F.reverse(F.slice("eq", 1, REACH)))
    right = run(F.slice("eq", REACH + K + 1, REACH))
    core = F.forall(F.slice("eq", REACH + 1, K), lambda x: x)
    joined = joined.withColumn("l", left).withColumn("r", right)
    good = core & (F.col("l") + F.col("r") + K >= SPAN)
    out = joined.select(*base, *[F.when(good, c).alias(n) for n, c in (("item_id", F.col("item_id")), ("s", F.col("p") - F.col("l")), ("e", F.col("p") + K + F.col("r")))])
    for n, many in sizes.items():
        at = texts.select(*base, F.explode(f"short{n}").alias("x")).select(*base, "x.p", "x.f")
        own = short.where(F.col("n") == n).select("f", "item_id")
        out = out.unionByName(at.join(counted(own, many), "f").select(*base, "item_id", F.col("p").cast("long").alias("s"), (F.col("p") + n).cast("long").alias("e")))
    return out


def union_size(ranges: Column) -> Column:
    """Places covered by an array of (s, e)."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(x["s"], a["end"]))).alias("n"), F.greatest(a["end"], x["e"]).alias("end"))
    return F.aggregate(F.array_sort(ranges), zero, step, lambda a: a["n"])


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), n_words, n_hit, items (sorted ids) of every row of docs."""
    found = spans(docs, items, id_col, text_col, item_col, item_text)
    ranges = F.collect_set(F.when(F.col("s").isNotNull(), F.struct("s", "e")))
    out = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"), F.first("n_words").alias("n_words"), ranges.alias("ranges"), F.array_sort(F.collect_set("item_id")).alias("items"))
    return out.select("doc_id", "text_hash", "n_words", union_size(F.col("ranges")).alias("n_hit"), "items")


#: Of contamination()'s rows, those that benchmark passages cover to a twentieth or more.
CONTAMINATED = "n_hit > 0 and 20 * n_hit >= n_words"


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        F.expr(CONTAMINATED).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(list_slice(w, s, s + least(13, len(w)) - 1), ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, m, s, array_to_string(list_slice(w, s, s + m - 1), ' ') AS g
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
hit AS (SELECT doc_id, dw.m, s, item_id FROM dw JOIN iw USING (m, g)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""
