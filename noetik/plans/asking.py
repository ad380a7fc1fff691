"""Questions answered by the plan of their shape; keys between tables; stale vectors; labels by rules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answers as A
from ..operators.vectors import VectorIndex
from ..session import checkpoint_folder
from ..sources import tables as T
from .ranked import text_index
from .registry import query

#: User turns, worded by their conversation: a comparison, a bound, an ordinal, general knowledge, or as they are.
WORDED = """SELECT conv_id || ':' || turn AS qid, conv_id AS conv, turn, CASE WHEN conv_id % 6 = 0 THEN 'Compare ' || text WHEN conv_id % 6 = 1 THEN text || ' under $50' WHEN conv_id % 6 = 2 AND turn > 1 THEN 'What about the second of these?'
WHEN conv_id % 6 = 3 AND turn > 1 THEN text || ' in general' WHEN conv_id % 6 = 4 THEN 'something cheap of the last 30 days: ' || text ELSE text END AS text FROM conversations WHERE role = 'user'"""


def worded(s, d):
    t = T.messages(s, d).where("role = 'user'")
    of = lambda k: F.col("conv_id") % 6 == k
    text = (
        F.when(of(0), F.concat(F.lit("Compare "), "text")).when(of(1), F.concat("text", F.lit(" under $50"))).when(of(2) & (F.col("turn") > 1), F.lit("What about the second of these?"))
        .when(of(3) & (F.col("turn") > 1), F.concat("text", F.lit(" in general"))).when(of(4), F.concat(F.lit("something cheap of the last 30 days: "), "text")).otherwise(F.col("text"))
    )
    return t.select(F.concat_ws(":", "conv_id", "turn").alias("qid"), F.col("conv_id").alias("conv"), "turn", text.alias("text"))


LOW = "lower(coalesce(text, ''))"
TEST = lambda p: f"regexp_matches({LOW}, '{p}')"
EXACT = f"({TEST(A.BOUND)} OR {TEST(A.WITHIN)} OR {TEST(A.UNSEEN)})"


@query("question_shapes", f"SELECT qid, CASE WHEN NOT {TEST(A.HYBRID)} AND {TEST(A.GENERAL)} THEN 'general' WHEN {TEST(A.ORDINAL)} THEN 'follow_up' WHEN {TEST(A.INTENTS['synthesize'])} THEN 'mixed' WHEN {EXACT} AND {TEST('|'.join(A.SEMANTIC.values()))} THEN 'mixed' WHEN {EXACT} THEN 'structured' ELSE 'semantic' END AS plan FROM ({WORDED})")
def _(s, d):
    return worded(s, d).select("qid", A.shapes(F.col("text")).alias("plan"))


@query("planned_answers")
def _(s, d):
    """Every user turn's results, by the plan of its shape."""
    quality = T.table(s, d, "labels").select(F.col("doc_id").alias("doc"), F.when(F.col("quality") == 1, 2).otherwise(0).alias("depth"))
    facts = quality.withColumn("saved_at", F.col("doc"))
    vectors = T.table(s, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    return A.planned(worded(s, d), text_index(s, d), vectors, facts)


#: Child table, its column, parent table, its key.
KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"), ("embeddings", "vec_id", "documents", "doc_id"),
]


@query("fk_violations", " UNION ALL ".join(f"SELECT '{c}.{k}' AS child, count(*) AS n_rows, count(*) FILTER ({k} IS NULL) AS n_null, count(*) FILTER ({k} IS NOT NULL AND {k} NOT IN (SELECT {pk} FROM {p} WHERE {pk} IS NOT NULL)) AS n_orphans FROM {c}" for c, k, p, pk in KEYS))
def _(s, d):
    """Of each foreign key its rows, nulls and rows without a parent."""
    out = None
    for c, k, p, pk in KEYS:
        known = T.table(s, d, p).select(F.col(pk).alias("_parent")).distinct()
        met = T.table(s, d, c).select(k).join(known, F.col(k) == F.col("_parent"), "left")
        row = met.agg(F.lit(f"{c}.{k}").alias("child"), F.count("*").alias("n_rows"), F.count_if(F.col(k).isNull()).alias("n_null"), F.count_if(F.col(k).isNotNull() & F.col("_parent").isNull()).alias("n_orphans"))
        out = row if out is None else out.unionByName(row)
    return out


@query("vec_stale", "SELECT doc_id AS object_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) OR doc_id % 9 = 4")
def _(s, d):
    """Documents whose vector is missing or was made of other content."""
    index = VectorIndex(s, f"{checkpoint_folder(s)}/vectors-{uuid.uuid4().hex}")
    docs = T.table(s, d, "documents").select("doc_id", "text")
    hashed = X.content_hash(F.coalesce("text", F.lit("")))
    vectors = T.table(s, d, "embeddings").join(docs, F.col("vec_id") == F.col("doc_id"))
    index.rebuild(vectors.select(F.lit("source").alias("object_type"), F.col("doc_id").alias("object_id"), F.col("embedding").alias("vector"), hashed.alias("content_hash")))
    now = F.when(F.col("doc_id") % 9 == 4, F.concat(F.coalesce("text", F.lit("")), F.lit(" edited"))).otherwise(F.col("text"))
    objects = docs.withColumn("text", now).select(F.lit("source").alias("object_type"), F.col("doc_id").alias("object_id"), hashed.alias("content_hash"))
    return index.stale(objects).select("object_id")


#: Labels of sources by rules over their text: a label has a pattern, and a document may have several.
LABELS = {"licensed": "license|copyright", "contact": "[a-z0-9._+-]+@[a-z0-9-]+[.][a-z]+", "linked": "https?://", "priced": "[$€][0-9]", "dated": "[0-9]{4}-[0-9]{2}-[0-9]{2}", "tabular": "[|].*[|]", "long": ""}


@query("multi_labels", "SELECT doc_id AS source_id, " + "concat_ws(',', " + ", ".join(f"CASE WHEN {'length(text) >= 20000' if n == 'long' else TEST(p)} THEN '{n}' END" for n, p in sorted(LABELS.items())) + ") AS labels FROM documents")
def _(s, d):
    low = F.lower(F.coalesce("body", F.lit("")))
    tests = {n: F.length("body") >= 20000 if n == "long" else low.rlike(p) for n, p in sorted(LABELS.items())}
    return T.sources(s, d).select("source_id", F.concat_ws(",", *(F.when(t, F.lit(n)) for n, t in tests.items())).alias("labels"))
