"""Full text, vectors and fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B, RRF = 1.2, 0.75, 60


def postings(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """term, doc, tf."""
    return docs.select(F.col(id_col).alias("doc"), F.explode(tokens(text)).alias("term")).groupBy("term", "doc").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, id_col: str, text: Column, query: list[str]) -> DataFrame:
    """doc, score of the documents with a query term. Lengths come from arrays, so only query terms make rows."""
    sized = docs.select(F.col(id_col).alias("doc"), tokens(text).alias("w")).select("doc", F.size("w").alias("dl"), F.filter("w", lambda x: x.isin(query)).alias("hits"))
    stats = sized.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = sized.select("doc", "dl", F.explode("hits").alias("term")).groupBy("doc", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats)).groupBy("doc").agg(F.sum(part).alias("score"))  # a row for each query term; one row


def fields(docs: DataFrame, id_col: str, weighted: dict[str, tuple[Column, float]], query: list[str]) -> DataFrame:
    """doc, score: the weighted sum of the scores of a document's fields, {name: (text, weight)}."""
    parts = [bm25(docs, id_col, text, query).select("doc", (F.lit(w) * F.col("score")).alias("score")) for text, w in weighted.values()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("doc").agg(F.sum("score").alias("score"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest by cosine; filters belong below, on vectors."""
    score = cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    return vectors.select(id_col, F.round(score, 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def reciprocal_rank(lists: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(surface, object_id, rank) fused to (object_id, score, surfaces); an absent surface weighs 0."""
    weight = F.create_map(*[F.lit(x) for p in weights.items() for x in p])[F.col("surface")]
    return lists.groupBy("object_id").agg(F.sum(F.coalesce(weight, F.lit(0.0)) / (RRF + F.col("rank"))).alias("score"), F.array_join(F.array_sort(F.collect_set("surface")), ",").alias("surfaces"))


def linear(lists: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(surface, object_id, score) fused by scores scaled to 0..1 inside each surface."""
    bounds = lists.groupBy("surface").agg(F.min("score").alias("low"), F.max("score").alias("high"))
    weight = F.create_map(*[F.lit(x) for p in weights.items() for x in p])[F.col("surface")]
    v = weight * F.when(F.col("high") == F.col("low"), 1.0).otherwise((F.col("score") - F.col("low")) / (F.col("high") - F.col("low")))
    return lists.join(F.broadcast(bounds), "surface").groupBy("object_id").agg(F.sum(v).alias("score"))  # a row for each surface


def feature_score(weights: dict[str, float]) -> Column:
    return sum((F.lit(w) * F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
