"""Queries of the wiki, vectors, extraction and evaluation on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answers as A
from ..operators import evidence as V
from ..operators import joins as J
from ..operators import search as S
from ..operators import vectors as I
from ..session import checkpoint_folder
from ..sources import tables as T
from .registry import query
from .retrieval import BM25, QUERY, TOKENS


ASKS = [
    "我之前收藏过哪些香港徒步路线？", "我收藏的那个西贡路线大概要走多久？", "综合我收藏过的 Agent 视频，它们共同提到了哪些趋势？", "根据我收藏的香港地点，帮我排一个周六行程。", "MCP 是什么？", "结合我的收藏和你的知识，给我做学习路线。",
    "Find my saved noodle places", "What do people in general say about MCP?", "Plan a trip from my collection", "compare the tools I saved", "hello there",
]
ASKED = "(SELECT * FROM (VALUES " + ", ".join(f"({k}, '{t}')" for k, t in enumerate(ASKS)) + ") AS v(id, text))"
SCOPE_SQL = f"CASE WHEN regexp_matches(lower(text), '{A.HYBRID}') THEN 'hybrid' WHEN regexp_matches(lower(text), '{A.GENERAL}') THEN 'general' WHEN regexp_matches(lower(text), '{A.PERSONAL}') THEN 'personal_required' ELSE 'personal_first' END"
INTENT_SQL = "CASE WHEN NOT (" + " OR ".join(f"regexp_matches(lower(text), '{p}')" for p in A.INTENTS.values()) + ") THEN 'answer' ELSE concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{n}' END" for n, p in sorted(A.INTENTS.items())) + ") END"
EVERY_ASK = f"SELECT 'ask' AS origin, CAST(id AS VARCHAR) AS id, text FROM {ASKED} UNION ALL SELECT 'turn', conv_id || ':' || turn, text FROM conversations WHERE role = 'user'"


def _asks(s, d):
    asks = s.createDataFrame(list(enumerate(ASKS)), "id int, text string").select(F.lit("ask").alias("origin"), F.col("id").cast("string").alias("id"), "text")
    return asks.unionByName(T.messages(s, d).where("role = 'user'").select(F.lit("turn").alias("origin"), F.concat_ws(":", "conv_id", "turn").alias("id"), "text"))


@query("intent_rules", f"SELECT origin, id, {INTENT_SQL} AS intents FROM ({EVERY_ASK})")
def _(s, d):
    return _asks(s, d).select("origin", "id", A.intents(F.col("text")).alias("intents"))


@query("scope_model", f"SELECT origin, id, {SCOPE_SQL} AS scope FROM ({EVERY_ASK})")
def _(s, d):
    return _asks(s, d).select("origin", "id", A.scope(F.col("text")).alias("scope"))


WHOLE = BM25.replace("round(sum(", "(sum(").replace("), 6) AS score", ")) AS score")
TITLED = WHOLE.replace(f"{TOKENS} AS w", TOKENS.replace("lower(text)", "lower(split_part(text, chr(10), 1))") + " AS w")


@query("bm25_fields", f"SELECT doc, round(sum(score), 5) AS score FROM (SELECT doc, 2.0 * score AS score FROM ({TITLED}) UNION ALL SELECT doc, score FROM ({WHOLE})) GROUP BY doc")
def _(s, d):
    docs = T.table(s, d, "documents")
    fields = {"title": (F.substring_index("text", "\n", 1), 2.0), "body": (F.col("text"), 1.0)}
    return S.fields(docs, "doc_id", fields, QUERY).select("doc", F.round("score", 5).alias("score"))


PART_TEXT = "concat_ws(' ', p_name, p_brand, p_type)"
CANDIDATES = BM25.replace("doc_id AS doc", "p_partkey AS doc").replace("FROM documents", "FROM part").replace("lower(text)", f"lower({PART_TEXT})").replace("('the', 'of', 'anent')", "('cold', 'widget', 'economy')")


@query("wiki_candidates", f"SELECT doc AS page_id, score FROM ({CANDIDATES}) ORDER BY score DESC, doc LIMIT 50")
def _(s, d):
    found = S.bm25(T.table(s, d, "part"), "p_partkey", F.concat_ws(" ", "p_name", "p_brand", "p_type"), ["cold", "widget", "economy"])
    return found.select(F.col("doc").alias("page_id"), F.round("score", 6).alias("score")).orderBy(F.desc("score"), "page_id").limit(50)


def _index(s, d):
    index = I.VectorIndex(s, f"{checkpoint_folder(s)}/vectors-{uuid.uuid4().hex}")
    e = T.table(s, d, "embeddings")
    index.rebuild(e.select(F.concat(F.lit("topic"), "label").alias("object_type"), F.col("vec_id").alias("object_id"), F.col("embedding").alias("vector"), F.col("vec_id").cast("string").alias("content_hash")))
    return index


@query("vec_rebuild", "SELECT 'topic' || label AS object_type, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids, round(sum(CAST(embedding[1] AS DOUBLE)), 5) AS first FROM embeddings GROUP BY label")
def _(s, d):
    return _index(s, d).read().groupBy("object_type").agg(F.count("*").alias("n"), F.sum("object_id").alias("ids"), F.round(F.sum(F.get("vector", F.lit(0)).cast("double")), 5).alias("first"))


@query("vec_upsert", "SELECT vec_id AS object_id, 'topic' || label AS object_type, round(CASE WHEN vec_id % 5 = 0 THEN -1 ELSE 1 END * CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings WHERE vec_id % 7 <> 0 UNION ALL SELECT 1000000000 + vec_id, 'topic' || label, round(CAST(embedding[1] AS DOUBLE), 6) FROM embeddings WHERE vec_id % 50 = 3")
def _(s, d):
    index, e = _index(s, d), T.table(s, d, "embeddings")
    row = lambda df, key, vector: df.select(F.concat(F.lit("topic"), "label").alias("object_type"), key.alias("object_id"), vector.alias("vector"), F.lit("new").alias("content_hash"))
    turned = row(e.where("vec_id % 5 = 0"), F.col("vec_id"), F.transform("embedding", lambda x: -x))
    added = row(e.where("vec_id % 50 = 3"), F.col("vec_id") + 1000000000, F.col("embedding"))
    index.upsert(turned.unionByName(added))
    index.delete(index.read().where("object_id % 7 = 0 and object_id < 1000000000"))
    return index.read().select("object_id", "object_type", F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first"))


PATTERNS = {"url": "https?://[A-Za-z0-9./_-]+", "email": "[A-Za-z0-9._+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+", "date": "[0-9]{4}-[0-9]{2}-[0-9]{2}", "price": "[$€][0-9]+([.][0-9]+)?", "phone": "[+][0-9][0-9 -]{7,14}[0-9]", "version": "version [0-9]+([.][0-9]+)*"}


@query("extract_rules", "WITH l AS (SELECT doc_id AS source_id, unnest(range(len(string_split(text, chr(10))))) AS ordinal, unnest(string_split(text, chr(10))) AS raw FROM documents) SELECT source_id, ordinal, predicate, value_text, 'explicit_source_statement' AS provenance_type FROM (" + " UNION ALL ".join(f"SELECT source_id, ordinal, '{n}' AS predicate, unnest(regexp_extract_all(raw, '{p}', 0)) AS value_text FROM l" for n, p in PATTERNS.items()) + ")")
def _(s, d):
    return V.extract(T.evidence(s, d), PATTERNS).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("resurface", "WITH e AS (SELECT * FROM events), w AS (SELECT max(ts) AS now FROM e), r AS (SELECT event_type, count(*) FILTER (ts > now - INTERVAL 7 DAY) AS recent, count(*) AS n FROM e, w GROUP BY event_type), u AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS state FROM e GROUP BY user_id) SELECT 'topic' AS card, event_type AS subject, 'seen ' || recent || ' times in 7 days' AS reason FROM r WHERE recent * 30 >= n * 7 UNION ALL SELECT 'unfinished', CAST(user_id AS VARCHAR), 'last state is ' || state FROM u WHERE state IN ('view', 'signup')")
def _(s, d):
    return V.resurface(T.saves(s, d), 7, 30, ["view", "signup"])


@query("search_all_types", "SELECT doc_type, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM (SELECT 'source' AS doc_type, length(text) AS size FROM documents UNION ALL SELECT 'entity', length(p_name) FROM part UNION ALL SELECT 'page', length(html) FROM pages UNION ALL SELECT 'message', length(text) FROM conversations UNION ALL SELECT 'claim', length(CAST(l_partkey AS VARCHAR) || ' quantity ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)) FROM lineitem UNION ALL SELECT 'annotation', length(event_type) FROM events) GROUP BY doc_type")
def _(s, d):
    from .retrieval import unified

    return unified(s, d).groupBy("doc_type").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


@query("near_dups_documents", f"""WITH w AS (SELECT doc_id AS id, {TOKENS} AS w FROM documents), k AS (SELECT id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))) AS t FROM w WHERE len(w) > 0),
r AS (SELECT t, min(id) AS class_id FROM k GROUP BY t), x AS (SELECT class_id, len(t) AS n, unnest(t) AS g FROM r), p AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.g = b.g AND a.class_id <> b.class_id GROUP BY 1, 2),
l AS (SELECT a, count(*) AS n FROM p WHERE 5 * c >= 4 * (na + nb - c) GROUP BY a) SELECT k.id, r.class_id, coalesce(l.n, 0) AS n_links FROM k JOIN r USING (t) LEFT JOIN l ON l.a = r.class_id UNION ALL SELECT id, id, 0 FROM w WHERE len(w) = 0 OR w IS NULL""")
def _(s, d):
    return J.near_classes(T.table(s, d, "documents").select(F.col("doc_id").alias("id"), X.shingles(F.col("text"), 5).alias("tokens")), 80)


@query("is_json", "SELECT event_id, json_valid(props) AS ok, json_valid(substr(props, 2)) AS cut FROM events")
def _(s, d):
    return T.table(s, d, "events").select("event_id", X.is_json(F.col("props")).alias("ok"), X.is_json(F.expr("substring(props, 2)")).alias("cut"))


BIGRAMS = "list_distinct(list_transform(range(1, greatest(length({0}) - 1, 1) + 1), lambda i: substr({0}, i, 2)))"


@query("fuzzy_names", f"SELECT a.p_partkey AS a, b.p_partkey AS b, round(len(list_intersect({BIGRAMS.format('a.p_name')}, {BIGRAMS.format('b.p_name')})) / len(list_distinct(list_concat({BIGRAMS.format('a.p_name')}, {BIGRAMS.format('b.p_name')}))), 6) AS likeness FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def _(s, d):
    e = T.entities(s, d)
    x, y = (e.select((F.col("entity_id") - k).alias("a"), F.col("canonical_name").alias(f"n{k}")) for k in (0, 1))
    return x.join(y, "a").select("a", (F.col("a") + 1).alias("b"), F.round(X.fuzzy(F.col("n0"), F.col("n1")), 6).alias("likeness"))
