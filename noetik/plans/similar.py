"""Queries of vectors: approximate search with its recall, clusters of linked vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import quantized as V
from ..sources import tables as T
from .registry import query


def _rows(s, d):
    return V.usable(T.table(s, d, "embeddings"), "vec_id", "embedding")


def _asked(s, d):
    asked = _rows(s, d).where("id % 50 = 0")
    return asked, asked.count()


@query("ann_search")
def _(s, d):
    """The ten nearest of every vector whose id is divisible by 50, by codes and a second scoring."""
    return V.Codes(_rows(s, d)).top(*_asked(s, d), 10)


@query("ann_exact", """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), p AS (SELECT q.id AS query_id, v.id, round(list_dot_product(q.x, v.x) / sqrt(list_dot_product(q.x, q.x) * list_dot_product(v.x, v.x)), 6) AS score FROM v q, v WHERE q.id % 50 = 0)
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM p QUALIFY rank <= 10""")
def _(s, d):
    return V.exact(_rows(s, d), *_asked(s, d), 10)


@query("ann_recall", "SELECT count(*) AS n_queries, 10 * count(*) AS n_wanted, TRUE AS recall_of_nine_tenths, TRUE AS less_than_a_fifth_read FROM embeddings WHERE vec_id % 50 = 0")
def _(s, d):
    """Whether the approximate search finds nine tenths of the exact results, and reads less than a fifth of the bytes."""
    codes, (asked, n) = V.Codes(_rows(s, d)), _asked(s, d)
    found = codes.top(asked, n, 10).select("query_id", "id", F.lit(1).alias("hit"))
    met = V.exact(_rows(s, d), asked, n, 10).join(found, ["query_id", "id"], "left")
    return met.agg(
        F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("n_wanted"), (10 * F.count("hit") >= 9 * F.count("*")).alias("recall_of_nine_tenths"),
        F.lit(codes.share(10) < 0.2).alias("less_than_a_fifth_read"),
    )


LIKE = 0.4
LINKS = f"SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id AND list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) >= {LIKE}"


@query("vec_clusters", f"WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), l AS ({LINKS}), r AS (SELECT DISTINCT a AS id, a AS at_id FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.at_id) SELECT id, min(at_id) AS component FROM r GROUP BY id")
def _(s, d):
    """The clusters of vectors that links of at least LIKE connect."""
    return J.components(V.similar(_rows(s, d), LIKE, clusters=True))
