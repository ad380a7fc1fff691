"""Structured, full-text, vector and fused retrieval over stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import filters as P
from ..operators import jobs as Q
from ..operators import joins as J
from ..operators import postings as R
from ..operators import search as S
from ..operators import windows as W
from ..session import checkpoint_folder, discard
from ..sources import tables as T
from .ranked import text_index
from .registry import query

CLAIM = "SELECT l_orderkey AS source_id, l_linenumber AS ordinal, l_partkey AS entity_id, l_suppkey AS attributed_to, l_quantity AS quantity, round(l_extendedprice / l_quantity, 2) AS price, l_discount AS confidence, l_returnflag AS claim_kind, l_linestatus AS run_status, epoch_ms(l_shipdate) AS valid_from_ms FROM lineitem"
TOKENS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
LINES = "SELECT doc_id AS source_id, unnest(range(len(string_split(text, chr(10))))) AS ordinal, unnest(string_split(text, chr(10))) AS raw_text FROM documents"


@query("scan_documents", "SELECT doc_id AS source_id, source AS creator_id, lang AS collection_id, n_chars FROM documents")
def _(s, d):
    return T.sources(s, d).drop("body")


@query("sync_collections", "SELECT lang AS collection_id, count(*) AS n_sources FROM documents GROUP BY lang")
def _(s, d):
    return T.sources(s, d).groupBy("collection_id").agg(F.count("*").alias("n_sources"))


@query("sync_sources", "SELECT doc_id AS source_id, lang AS collection_id FROM documents WHERE lang = 'en'")
def _(s, d):
    return P.search(T.sources(s, d), {"collection_id": {"eq": "en"}}).select("source_id", "collection_id")


@query("pages_text", r"SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script.*?</script>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS n FROM pages")
def _(s, d):
    bare = F.regexp_replace(F.regexp_replace("html", "(?s)<script.*?</script>", " "), "<[^>]*>", " ")
    return T.table(s, d, "pages").select("page_id", F.length(F.trim(F.regexp_replace(bare, r"\s+", " "))).cast("long").alias("n"))


@query("search_sources", "SELECT doc_id AS source_id, n_chars FROM documents WHERE source IN ('src1', 'src2') AND n_chars >= 500 AND lower(text) LIKE '%the%'")
def _(s, d):
    return P.search(T.sources(s, d), {"creator_id": {"in": ["src1", "src2"]}, "n_chars": {"ge": 500}}, "the", ("body",)).select("source_id", "n_chars")


@query("search_entities", f"SELECT p_partkey AS entity_id, p_name AS canonical_name FROM part WHERE p_size BETWEEN 10 AND 20 AND p_partkey IN (SELECT entity_id FROM ({CLAIM}) WHERE quantity >= 45)")
def _(s, d):
    wanted = P.search(T.claims(s, d), {"quantity": {"ge": 45}}).select("entity_id")
    return J.exists(P.search(T.entities(s, d), {"size": {"between": (10, 20)}}), wanted, "entity_id").select("entity_id", "canonical_name")


@query("claim_price_le", f"SELECT source_id, ordinal, entity_id, CASE WHEN price + 50 <= 1100 THEN 'full' ELSE 'partial' END AS range_match FROM ({CLAIM}) WHERE price <= 1100")
def _(s, d):
    c = T.claims(s, d).withColumn("range_match", P.range_match(F.col("price"), F.col("price") + 50, 1100))
    return c.where("range_match is not null").select("source_id", "ordinal", "entity_id", "range_match")


STATE = "SELECT user_id, event_type AS state FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1"


def _states(s, d):
    return W.latest(T.saves(s, d), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "state")


@query("not_visited", f"SELECT c_custkey AS user_id, state FROM customer LEFT JOIN ({STATE}) ON c_custkey = user_id WHERE state IS DISTINCT FROM 'purchase'")
def _(s, d):
    users = T.table(s, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return P.in_state(P.with_state(users, _states(s, d), "user_id"), "purchase", negate=True)


@query("with_state", f"SELECT c_custkey AS user_id, coalesce(state, 'none') AS state FROM customer LEFT JOIN ({STATE}) ON c_custkey = user_id")
def _(s, d):
    return P.with_state(T.table(s, d, "customer").select(F.col("c_custkey").alias("user_id")), _states(s, d), "user_id", "none")


@query("state_latest", STATE)
def _(s, d):
    return _states(s, d)


@query("current_run", f"SELECT source_id, max(ordinal) AS run FROM ({CLAIM}) WHERE run_status = 'F' GROUP BY source_id")
def _(s, d):
    done = T.claims(s, d).where("run_status = 'F'")
    return W.latest(done, ["source_id"], [F.desc("ordinal")]).select("source_id", F.col("ordinal").alias("run"))


@query("policy_visible", "SELECT doc_id AS source_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def _(s, d):
    return P.visible(T.sources(s, d), _decisions(s, d), "source_id").select("source_id")


def _decisions(s, d):
    return T.table(s, d, "labels").select(F.col("doc_id").alias("source_id"), F.when(F.col("quality") == 0, "metadata_only").otherwise("process").alias("action"))


@query("skipped_sources", "SELECT doc_id AS source_id, source AS creator_id, 'metadata_only' AS action FROM documents JOIN labels USING (doc_id) WHERE quality = 0")
def _(s, d):
    return P.skipped(T.sources(s, d), _decisions(s, d), "source_id").select("source_id", "creator_id", "action")


@query("saved_between", "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12'")
def _(s, d):
    return P.search(T.saves(s, d), {"ts": {"between": (F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-12").cast("timestamp"))}}).select("event_id", "user_id")


@query("label_filter", "SELECT doc_id AS source_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(s, d):
    return J.exists(T.sources(s, d), T.table(s, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("source_id")), "source_id").select("source_id")


@query("claim_valid_at", f"SELECT source_id, ordinal FROM ({CLAIM}) WHERE valid_from_ms <= 820454400000 AND valid_from_ms + 2592000000 > 820454400000")
def _(s, d):
    return P.valid_at(T.claims(s, d).withColumn("valid_to_ms", F.col("valid_from_ms") + 2592000000), 820454400000).select("source_id", "ordinal")


@query("page_catalog", "SELECT page_id, url, length(html) AS size FROM pages")
def _(s, d):
    return T.table(s, d, "pages").select("page_id", "url", F.length("html").cast("long").alias("size"))


@query("get_source", "SELECT doc_id AS source_id, source AS creator_id, text AS body FROM documents WHERE doc_id = 17")
def _(s, d):
    return P.search(T.sources(s, d), {"source_id": {"eq": 17}}).select("source_id", "creator_id", "body")


@query("browse", "SELECT doc_id AS source_id, n_chars FROM documents WHERE lang = 'fr' ORDER BY n_chars DESC, doc_id LIMIT 25")
def _(s, d):
    return P.search(T.sources(s, d), {"collection_id": {"eq": "fr"}}).select("source_id", "n_chars").orderBy(F.desc("n_chars"), "source_id").limit(25)


@query("claim_evidence", f"SELECT source_id, ordinal, p_name AS entity, s_name AS creator, o_orderpriority AS origin FROM ({CLAIM}) JOIN part ON p_partkey = entity_id JOIN supplier ON s_suppkey = attributed_to JOIN orders ON o_orderkey = source_id WHERE price > 1500")
def _(s, d):
    c = P.search(T.claims(s, d), {"price": {"ge": 1500}}).where("price > 1500")
    out = c.join(T.table(s, d, "part"), F.col("p_partkey") == F.col("entity_id")).join(T.table(s, d, "supplier"), F.col("s_suppkey") == F.col("attributed_to")).join(T.table(s, d, "orders"), F.col("o_orderkey") == F.col("source_id"))
    return out.select("source_id", "ordinal", F.col("p_name").alias("entity"), F.col("s_name").alias("creator"), F.col("o_orderpriority").alias("origin"))


CHUNKS = f"SELECT *, dense_rank() OVER (PARTITION BY source_id ORDER BY b) AS chunk FROM (SELECT *, floor(coalesce(sum(length(raw_text)) OVER (PARTITION BY source_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 800.0) AS b FROM ({LINES}))"


@query("chunk_build", f"SELECT source_id, chunk, count(*) AS n_units, CAST(sum(length(raw_text)) AS BIGINT) AS size, min(ordinal) AS first_unit, max(ordinal) AS last_unit FROM ({CHUNKS}) GROUP BY source_id, chunk")
def _(s, d):
    c = W.chunked(T.evidence(s, d), "source_id", ["ordinal"], "length", 800)
    return c.groupBy("source_id", F.col("chunk").cast("long").alias("chunk")).agg(F.count("*").alias("n_units"), F.sum("length").alias("size"), F.min("ordinal").cast("long").alias("first_unit"), F.max("ordinal").cast("long").alias("last_unit"))


@query("chunk_evidence", f"SELECT source_id, chunk, ordinal FROM ({CHUNKS})")
def _(s, d):
    return W.chunked(T.evidence(s, d), "source_id", ["ordinal"], "length", 800).select("source_id", F.col("chunk").cast("long").alias("chunk"), F.col("ordinal").cast("long").alias("ordinal"))


@query("evidence_context", f"SELECT source_id, ordinal, coalesce(length(lag(raw_text) OVER w), -1) AS before_n, coalesce(length(lead(raw_text) OVER w), -1) AS after_n FROM ({LINES}) WINDOW w AS (PARTITION BY source_id ORDER BY ordinal)")
def _(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("source_id").orderBy("ordinal")
    e = T.evidence(s, d)
    return e.select("source_id", F.col("ordinal").cast("long").alias("ordinal"), F.coalesce(F.lag("length").over(w), F.lit(-1)).cast("long").alias("before_n"), F.coalesce(F.lead("length").over(w), F.lit(-1)).cast("long").alias("after_n"))


@query("evidence_split", f"SELECT source_id, count(*) AS n FROM ({LINES}) GROUP BY source_id")
def _(s, d):
    return T.evidence(s, d).groupBy("source_id").agg(F.count("*").alias("n"))


@query("entity_context", f"SELECT p_partkey AS entity_id, p_name AS canonical_name, coalesce(n_claims, 0) AS n_claims, coalesce(n_sources, 0) AS n_sources FROM part LEFT JOIN (SELECT entity_id, count(*) AS n_claims, count(DISTINCT source_id) AS n_sources FROM ({CLAIM}) GROUP BY entity_id) ON entity_id = p_partkey")
def _(s, d):
    c = T.claims(s, d).groupBy("entity_id").agg(F.count("*").alias("n_claims"), F.count_distinct("source_id").alias("n_sources"))
    return T.entities(s, d).join(c, "entity_id", "left").select("entity_id", "canonical_name", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("n_claims", "n_sources")])


@query("source_context", f"SELECT o_orderkey AS source_id, o_orderstatus AS status, count(entity_id) AS n_claims, count(DISTINCT entity_id) AS n_entities FROM orders LEFT JOIN ({CLAIM}) ON source_id = o_orderkey GROUP BY ALL")
def _(s, d):
    c = T.claims(s, d).groupBy("source_id").agg(F.count("*").alias("n_claims"), F.count_distinct("entity_id").alias("n_entities"))
    o = T.table(s, d, "orders").select(F.col("o_orderkey").alias("source_id"), F.col("o_orderstatus").alias("status"))
    return o.join(c, "source_id", "left").select("source_id", "status", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("n_claims", "n_entities")])


@query("membership", "SELECT source, lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY source, lang")
def _(s, d):
    gone = T.table(s, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("source_id"))
    return J.missing(T.sources(s, d), gone, "source_id").groupBy(F.col("creator_id").alias("source"), F.col("collection_id").alias("lang")).agg(F.count("*").alias("n"))


@query("entity_semi", f"SELECT p_partkey AS entity_id FROM part WHERE EXISTS (SELECT 1 FROM ({CLAIM}) WHERE entity_id = p_partkey AND quantity = 50)")
def _(s, d):
    return J.exists(T.entities(s, d), T.claims(s, d).where("quantity = 50"), "entity_id").select("entity_id")


@query("orphans", "SELECT p_partkey AS entity_id FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 40)")
def _(s, d):
    return J.missing(T.entities(s, d).select("entity_id"), T.claims(s, d).where("quantity >= 40").select("entity_id"), "entity_id")


@query("alias_match", "SELECT a.p_partkey AS entity_id, b.p_partkey AS other_id FROM part a JOIN part b ON lower(a.p_name) = lower(b.p_name) AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey")
def _(s, d):
    e = T.entities(s, d).select(F.col("entity_id").alias("id"), "brand", X.normalize_name(F.col("canonical_name")).alias("name"))
    return J.pairs_of(e, ["name", "brand"], "name", lambda x, y: F.lit(None)).select(F.col("a").alias("entity_id"), F.col("b").alias("other_id"))


@query("strong_id", "SELECT page_id, count(*) OVER (PARTITION BY regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^(www|m)\\.', '')) AS same_site FROM pages")
def _(s, d):
    p = T.table(s, d, "pages").select("page_id", X.url_domain(F.col("url")).alias("site"))
    return p.join(p.groupBy("site").agg(F.count("*").alias("same_site")), "site").select("page_id", "same_site")


@query("range_overlap", "WITH e AS (SELECT user_id, event_id, epoch_ms(ts) // 1000 AS ls, epoch_ms(ts) // 1000 + 900 AS le FROM events) SELECT a.event_id AS a, b.event_id AS b FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.ls <= b.le AND b.ls <= a.le")
def _(s, d):
    e = T.saves(s, d).select("user_id", "event_id", F.col("ts").cast("long").alias("ls")).withColumn("le", F.col("ls") + 900)
    r = e.select("user_id", F.col("event_id").alias("b"), F.col("ls").alias("rs"), F.col("le").alias("re"))
    return J.overlapping(e.withColumnRenamed("event_id", "a"), r, ["user_id"], 3600).where("a < b").select("a", "b")


@query("snapshot_at", "WITH o AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), f AS (SELECT user_id, ts, event_id AS fact_id FROM events WHERE event_type = 'view') SELECT o.event_id, max_by(f.fact_id, (f.ts, f.fact_id)) AS fact_id FROM o LEFT JOIN f ON f.user_id = o.user_id AND f.ts <= o.ts GROUP BY o.event_id")
def _(s, d):
    e = T.saves(s, d)
    asked = e.where("state = 'error'").select("event_id", "user_id", "ts")
    facts = e.where("state = 'view'").select("user_id", "ts", F.col("event_id").alias("fact_id"))
    return J.latest_before(asked, facts, "user_id", "ts", ["fact_id"]).select("event_id", "fact_id")


@query("relation_hops_all", "WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem), h AS (SELECT CAST(1 AS BIGINT) AS id, 0 AS hop UNION SELECT e.b, h.hop + 1 FROM h JOIN e ON e.a = h.id WHERE h.hop < 2) SELECT id, min(hop) AS hop FROM h GROUP BY id")
def _(s, d):
    return J.hops(T.claims(s, d).select(F.col("attributed_to").alias("a"), F.col("entity_id").alias("b")).distinct(), s.range(1, 2).select("id"), 2)


@query("run_diff", f"WITH o AS (SELECT source_id, max(quantity) AS v FROM ({CLAIM}) WHERE run_status = 'F' GROUP BY 1), n AS (SELECT source_id, max(quantity) AS v FROM ({CLAIM}) WHERE run_status = 'O' GROUP BY 1) SELECT source_id, CASE WHEN o.v IS NULL THEN 'added' WHEN n.v IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n USING (source_id) WHERE o.v IS DISTINCT FROM n.v")
def _(s, d):
    c = T.claims(s, d)
    run = lambda k: c.where(F.col("run_status") == k).groupBy("source_id").agg(F.max("quantity").alias("v"))
    return J.run_diff(run("F"), run("O"), ["source_id"], "v")


@query("latest_per_key", "SELECT o_custkey AS user_id, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS source_id FROM orders GROUP BY o_custkey")
def _(s, d):
    return W.latest(T.table(s, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("source_id"))


@query("snapshot_changes", "SELECT event_id, user_id, event_type AS state FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type")
def _(s, d):
    return W.changes(T.saves(s, d), "user_id", ["ts", "event_id"], "state").select("event_id", "user_id", "state")


@query("diversity_cap", "SELECT doc_id AS source_id, source AS creator_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 3")
def _(s, d):
    return W.cap(T.sources(s, d), ["creator_id"], [F.desc("n_chars"), F.col("source_id")], 3).select("source_id", "creator_id")


@query("diversify", "SELECT doc_id AS source_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 2) WHERE k <= 5")
def _(s, d):
    order = [F.desc("n_chars"), F.col("source_id")]
    return W.cap(W.cap(T.sources(s, d), ["creator_id"], order, 2), ["collection_id"], order, 5).select("source_id")


@query("surface_rank", "SELECT doc_id AS source_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents")
def _(s, d):
    rows = T.sources(s, d).select("source_id", "collection_id", "n_chars")
    return W.ranked_wide(rows, ["collection_id"], [F.desc("n_chars"), F.col("source_id")]).select("source_id", F.col("rank").cast("long").alias("rank"))


@query("revisions", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS revision_no FROM events")
def _(s, d):
    return W.ranked(T.saves(s, d), ["user_id", "state"], [F.col("ts"), F.col("event_id")], "revision_no").select("event_id", "user_id", F.col("revision_no").cast("long").alias("revision_no"))


@query("dominance", "SELECT lang, source, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM documents GROUP BY lang, source")
def _(s, d):
    return W.share(T.sources(s, d).select(F.col("collection_id").alias("lang"), F.col("creator_id").alias("source")), ["source"], ["lang"]).withColumn("share", F.round("share", 6))


@query("status_counts", "SELECT o_orderstatus AS status, o_orderpriority AS level, count(*) AS n FROM orders GROUP BY ALL")
def _(s, d):
    return T.table(s, d, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("level")).agg(F.count("*").alias("n"))


@query("storage_usage", "SELECT source AS asset_class, CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) AS n FROM documents GROUP BY source")
def _(s, d):
    return T.sources(s, d).groupBy(F.col("creator_id").alias("asset_class")).agg(F.sum(F.octet_length("body")).cast("long").alias("bytes"), F.count("*").alias("n"))


@query("entity_support", f"SELECT entity_id, count(DISTINCT source_id) AS n_sources, count(DISTINCT attributed_to) AS n_creators FROM ({CLAIM}) GROUP BY entity_id")
def _(s, d):
    return T.claims(s, d).groupBy("entity_id").agg(F.count_distinct("source_id").alias("n_sources"), F.count_distinct("attributed_to").alias("n_creators"))


@query("claim_conflicts", f"SELECT entity_id, claim_kind, count(DISTINCT quantity) AS n_values, count(DISTINCT source_id) AS n_sources, string_agg(DISTINCT CAST(CAST(quantity AS BIGINT) AS VARCHAR), ',' ORDER BY CAST(CAST(quantity AS BIGINT) AS VARCHAR)) AS vals FROM ({CLAIM}) GROUP BY entity_id, claim_kind HAVING count(DISTINCT quantity) > 1 AND count(DISTINCT source_id) > 1")
def _(s, d):
    # distinct values and distinct sources apart, each combined before its shuffle
    kind, c = ["entity_id", "claim_kind"], T.claims(s, d)
    vals = c.groupBy(*kind, "quantity").agg(F.lit(1)).groupBy(*kind).agg(F.count("*").alias("n_values"), F.array_join(F.array_sort(F.collect_set(F.col("quantity").cast("long").cast("string"))), ",").alias("vals"))
    by = c.groupBy(*kind, "source_id").agg(F.lit(1)).groupBy(*kind).agg(F.count("*").alias("n_sources"))
    c = vals.join(by, kind)
    return c.where("n_values > 1 and n_sources > 1")


@query("topic_burst", "SELECT event_type AS topic, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS recent, count(*) FILTER (ts < TIMESTAMP '2024-01-24') AS before FROM events GROUP BY event_type")
def _(s, d):
    recent = F.col("ts") >= F.lit("2024-01-24").cast("timestamp")
    return T.saves(s, d).groupBy(F.col("state").alias("topic")).agg(F.count_if(recent).alias("recent"), F.count_if(~recent).alias("before"))


@query("suggest_rules", "SELECT source AS creator_id, count(*) AS n_skipped FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY source HAVING count(*) >= 2")
def _(s, d):
    return P.skipped(T.sources(s, d), _decisions(s, d), "source_id").groupBy("creator_id").agg(F.count("*").alias("n_skipped")).where("n_skipped >= 2")


@query("coverage", f"SELECT source_id, bool_or(claim_kind = 'A') AS caption, bool_or(claim_kind = 'N') AS transcript, bool_or(claim_kind = 'R') AS ocr FROM ({CLAIM}) GROUP BY source_id")
def _(s, d):
    return T.claims(s, d).groupBy("source_id").agg(*[F.bool_or(F.col("claim_kind") == k).alias(n) for k, n in (("A", "caption"), ("N", "transcript"), ("R", "ocr"))])


@query("common_claims", f"SELECT entity_id, quantity, count(DISTINCT source_id) AS n_sources, string_agg(DISTINCT lpad(CAST(attributed_to AS VARCHAR), 9, '0'), ',' ORDER BY lpad(CAST(attributed_to AS VARCHAR), 9, '0')) AS creators FROM ({CLAIM}) GROUP BY entity_id, quantity HAVING count(DISTINCT source_id) >= 3")
def _(s, d):
    name = F.lpad(F.col("attributed_to").cast("string"), 9, "0")
    return T.claims(s, d).groupBy("entity_id", "quantity").agg(F.count_distinct("source_id").alias("n_sources"), F.array_join(F.array_sort(F.collect_set(name)), ",").alias("creators")).where("n_sources >= 3")


@query("aliases_list", "SELECT p_brand AS brand, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS aliases FROM part GROUP BY p_brand")
def _(s, d):
    return T.entities(s, d).groupBy("brand").agg(F.array_join(F.array_sort(F.collect_set("entity_type")), "|").alias("aliases"))


@query("term_stats_documents", f"WITH t AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term")
def _(s, d):
    return S.postings(T.table(s, d, "documents"), "doc_id", F.col("text")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("fts_rebuild_documents", f"WITH t AS (SELECT doc_id AS doc, unnest({TOKENS}) AS term FROM documents) SELECT term, doc, count(*) AS tf FROM t GROUP BY term, doc")
def _(s, d):
    return S.postings(T.table(s, d, "documents"), "doc_id", F.col("text"))


QUERY = ["the", "of", "anent"]
BM25 = f"""WITH w AS (SELECT doc_id AS doc, {TOKENS} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM w),
tf AS (SELECT doc, dl, term, count(*) AS tf FROM (SELECT doc, len(w) AS dl, unnest(w) AS term FROM w) WHERE term IN ('the', 'of', 'anent') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM tf JOIN df USING (term), st GROUP BY doc"""


@query("bm25", BM25)
def _(s, d):
    return text_index(s, d).scores(QUERY)


@query("topk", f"SELECT * FROM ({BM25}) ORDER BY score DESC, doc LIMIT 10")
def _(s, d):
    return text_index(s, d).scores(QUERY).orderBy(F.desc("score"), "doc").limit(10)


@query("phrase_whole", "SELECT doc_id, item_id FROM documents JOIN benchmark ON contains(lower(documents.text), lower(benchmark.text))")
def _(s, d):
    docs = T.table(s, d, "documents").select(F.col("doc_id").alias("doc"), F.lower("text").alias("body"))
    found = text_index(s, d).phrases(T.table(s, d, "benchmark").select(F.col("item_id").alias("pid"), F.lower("text").alias("p")), docs)
    return found.select(F.col("doc").alias("doc_id"), F.col("pid").alias("item_id"))


@query("bm25_index", BM25)
def _(s, d):
    return text_index(s, d).scores(QUERY)


@query("rebuild_projection", f"WITH t AS (SELECT doc_id AS doc, unnest({TOKENS}) AS term FROM documents) SELECT count(*) AS n_rows, TRUE AS equal FROM (SELECT term, doc FROM t GROUP BY term, doc)")
def _(s, d):
    first, again = text_index(s, d), R.PostingsIndex(s, f"{checkpoint_folder(s)}/text-{uuid.uuid4().hex}")
    again.update(T.table(s, d, "documents"), "doc_id")
    first, second = first.digest(), again.digest()
    discard(s, again.path)
    return s.createDataFrame([(second[0], first == second)], "n_rows long, equal boolean")


@query("backup_restore", "SELECT 'labels' AS name, count(*) AS n_rows, TRUE AS whole FROM labels UNION ALL SELECT 'part', count(*), TRUE FROM part")
def _(s, d):
    path = f"{checkpoint_folder(s)}/backup-{uuid.uuid4().hex}"
    Q.backup({n: T.table(s, d, n) for n in ("labels", "part")}, path)
    restored = Q.restore(s, path)
    return s.createDataFrame([(n, df.count(), True) for n, df in restored.items()], "name string, n_rows long, whole boolean")


@query("name_lookup", "SELECT p_partkey AS entity_id, p_name AS canonical_name FROM part WHERE lower(p_brand) LIKE 'brand#1%'")
def _(s, d):
    return P.search(T.entities(s, d), {"brand": {"starts": "brand#1"}}).select("entity_id", "canonical_name")


def _query_vector(s, d):
    return [float(x) for x in T.table(s, d, "embeddings").where("vec_id = 0").first()["embedding"]]


VEC = "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) SELECT vec_id, round(list_dot_product(x, e) / sqrt(list_dot_product(x, x) * list_dot_product(e, e)), 6) AS score FROM v, q"


@query("cosine_topk", f"{VEC} ORDER BY score DESC, vec_id LIMIT 20")
def _(s, d):
    return S.nearest(T.table(s, d, "embeddings"), _query_vector(s, d), 20)


@query("cosine_filtered", f"{VEC} WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 10")
def _(s, d):
    return S.nearest(P.search(T.table(s, d, "embeddings"), {"label": {"eq": 3}}), _query_vector(s, d), 10)


@query("centroids", "SELECT label, component, count(*) AS n, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM (SELECT label, unnest(range(len(embedding))) AS component, unnest(embedding) AS x FROM embeddings) GROUP BY label, component")
def _(s, d):
    each = T.table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("component", "x"))
    return each.groupBy("label", "component").agg(F.count("*").alias("n"), F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


SURFACES = f"""SELECT 'fts' AS surface, doc AS object_id, score FROM ({BM25}) UNION ALL SELECT 'metadata', doc_id, CAST(n_chars AS DOUBLE) FROM documents WHERE lang = 'en'"""


def _surfaces(s, d):
    fts = text_index(s, d).scores(QUERY).select(F.lit("fts").alias("surface"), F.col("doc").alias("object_id"), "score")
    meta = P.search(T.sources(s, d), {"collection_id": {"eq": "en"}}).select(F.lit("metadata").alias("surface"), F.col("source_id").alias("object_id"), F.col("n_chars").cast("double").alias("score"))
    return fts.unionByName(meta)


@query("union_candidates", SURFACES)
def _(s, d):
    return _surfaces(s, d)


RANKED = f"SELECT surface, object_id, row_number() OVER (PARTITION BY surface ORDER BY score DESC, object_id) AS rank FROM ({SURFACES})"


@query("rrf", f"SELECT object_id, round(sum(CASE surface WHEN 'fts' THEN 1.0 ELSE 0.5 END / (60 + rank)), 8) AS score FROM ({RANKED}) GROUP BY object_id")
def _(s, d):
    lists = W.ranked_wide(_surfaces(s, d), ["surface"], [F.desc("score"), F.col("object_id")])
    return S.reciprocal_rank(lists, {"fts": 1.0, "metadata": 0.5}).select("object_id", F.round("score", 8).alias("score"))


@query("fusion_explain", f"SELECT object_id, string_agg(DISTINCT surface, ',' ORDER BY surface) AS surfaces FROM ({SURFACES}) GROUP BY object_id")
def _(s, d):
    return _surfaces(s, d).groupBy("object_id").agg(F.array_join(F.array_sort(F.collect_set("surface")), ",").alias("surfaces"))


@query("weighted_fusion", f"SELECT object_id, round(sum(CASE surface WHEN 'fts' THEN 0.7 ELSE 0.3 END * v), 6) AS score FROM (SELECT surface, object_id, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS v FROM ({SURFACES}) WINDOW w AS (PARTITION BY surface)) GROUP BY object_id")
def _(s, d):
    return S.linear(_surfaces(s, d), {"fts": 0.7, "metadata": 0.3}).select("object_id", F.round("score", 6).alias("score"))


@query("rerank", "SELECT doc_id AS source_id, round(0.6 * coalesce(quality, 0) + 0.4 * least(n_chars / 5000.0, 1.0), 6) AS score FROM documents LEFT JOIN labels USING (doc_id)")
def _(s, d):
    q = T.table(s, d, "labels").select(F.col("doc_id").alias("source_id"), "quality")
    f = T.sources(s, d).join(q, "source_id", "left").withColumn("size", F.least(F.col("n_chars") / 5000.0, F.lit(1.0)))
    return f.select("source_id", F.round(S.feature_score({"quality": 0.6, "size": 0.4}), 6).alias("score"))


@query("intersect_constraints", "SELECT doc_id AS source_id FROM documents WHERE lang = 'en' AND n_chars > 1000 INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def _(s, d):
    good = T.table(s, d, "labels").where("quality = 1").select(F.col("doc_id").alias("source_id"))
    return T.sources(s, d).where("collection_id = 'en' and n_chars > 1000").select("source_id").intersect(good)


@query("saved_not_visited", "SELECT DISTINCT user_id FROM events WHERE event_type = 'view' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100")
def _(s, d):
    e = T.saves(s, d)
    return J.missing(e.where("state = 'view'").select("user_id").distinct(), e.where("state = 'purchase' and value > 100").select("user_id"), "user_id")


@query("search_documents", "SELECT 'source' AS doc_type, CAST(doc_id AS VARCHAR) AS object_id, length(text) AS size FROM documents UNION ALL SELECT 'entity', CAST(p_partkey AS VARCHAR), length(p_name) FROM part UNION ALL SELECT 'page', CAST(page_id AS VARCHAR), length(html) FROM pages UNION ALL SELECT 'message', conv_id || ':' || turn, length(text) FROM conversations")
def _(s, d):
    return unified(s, d).where("doc_type not in ('claim', 'annotation')")


def unified(s, d):
    """doc_type, object_id, size of all six types of objects."""
    shape = lambda kind, key, body: [F.lit(kind).alias("doc_type"), key.cast("string").alias("object_id"), F.length(body).cast("long").alias("size")]
    out = T.sources(s, d).select(*shape("source", F.col("source_id"), "body"))
    out = out.unionByName(T.entities(s, d).select(*shape("entity", F.col("entity_id"), "canonical_name")))
    out = out.unionByName(T.table(s, d, "pages").select(*shape("page", F.col("page_id"), "html")))
    out = out.unionByName(T.messages(s, d).select(*shape("message", F.concat_ws(":", "conv_id", "turn"), "text")))
    said = F.concat_ws(" ", F.col("entity_id"), F.lit("quantity"), F.col("quantity").cast("long"))
    out = out.unionByName(T.claims(s, d).withColumn("said", said).select(*shape("claim", F.concat_ws(":", "source_id", "ordinal"), "said")))
    return out.unionByName(T.saves(s, d).select(*shape("annotation", F.col("event_id"), "state")))


@query("dedupe_hash", "SELECT sha256(text) AS content_hash, min(doc_id) AS source_id FROM documents GROUP BY 1")
def _(s, d):
    return T.sources(s, d).groupBy(X.content_hash(F.col("body")).alias("content_hash")).agg(F.min("source_id").alias("source_id"))


@query("sort_recent", "SELECT o_orderkey AS source_id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def _(s, d):
    return T.table(s, d, "orders").orderBy(F.desc_nulls_last("o_orderdate"), "o_orderkey").select(F.col("o_orderkey").alias("source_id")).limit(50)


@query("priority_score", "SELECT o_orderkey AS source_id, round(CASE o_orderpriority WHEN '1-URGENT' THEN 3.0 WHEN '2-HIGH' THEN 2.0 ELSE 1.0 END + o_totalprice / 1000000.0, 8) AS score FROM orders")
def _(s, d):
    p = F.when(F.col("o_orderpriority") == "1-URGENT", 3.0).when(F.col("o_orderpriority") == "2-HIGH", 2.0).otherwise(1.0)
    return T.table(s, d, "orders").select(F.col("o_orderkey").alias("source_id"), F.round(p + F.col("o_totalprice") / 1000000.0, 8).alias("score"))
