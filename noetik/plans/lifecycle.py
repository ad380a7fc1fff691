"""Policy, processing, entity resolution, jobs, page quality, integrity and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import jobs as Q
from ..operators import joins as J
from ..operators import policy as L
from ..operators import windows as W
from ..sources import tables as T
from .registry import query
from .retrieval import CLAIM, LINES, VEC, _query_vector

#: Rules by creator, collection, source and label, as rows.
RULES = [
    (1, "creator", "src0", "metadata_only", 0, 10), (2, "collection", "de", "metadata_only", 5, 20), (3, "source_always", "7", "process", 0, 30),
    (4, "source_exclude", "8", "metadata_only", 0, 40), (5, "semantic", "toxic", "metadata_only", 0, 50), (6, "keyword", "license", "process", 0, 60),
]
RULE_SQL = "(VALUES " + ", ".join(map(str, RULES)) + ") r(rule_id, kind, target, action, priority, created_at_ms)"
DECIDED = rf"""SELECT doc_id AS source_id, coalesce(action, 'process') AS action, rule_id, coalesce(kind, 'default') AS reason FROM documents LEFT JOIN (
SELECT * FROM (SELECT doc_id AS did, r.*, row_number() OVER (PARTITION BY doc_id ORDER BY CASE kind WHEN 'source_always' THEN 1 WHEN 'source_exclude' THEN 2 WHEN 'creator' THEN 4 WHEN 'collection' THEN 4 WHEN 'semantic' THEN 5 ELSE 6 END, priority DESC, action = 'metadata_only' DESC, created_at_ms DESC, rule_id) AS n
FROM documents LEFT JOIN labels l USING (doc_id), {RULE_SQL} WHERE (kind LIKE 'source%' AND target = CAST(doc_id AS VARCHAR)) OR (kind = 'creator' AND target = source) OR (kind = 'collection' AND target = lang) OR (kind = 'semantic' AND l.toxic = 1)
OR (kind = 'keyword' AND list_contains(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), target))) WHERE n = 1) ON did = doc_id"""


def _rules(s, kinds=None):
    rules = s.createDataFrame(RULES, "rule_id int, kind string, target string, action string, priority int, created_at_ms int")
    return rules.where(F.col("kind").isin(kinds)) if kinds else rules


def _decided(s, d, kinds=None):
    sources = T.sources(s, d).select("source_id", "creator_id", "collection_id", F.col("body").alias("title"))
    labels = T.table(s, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("source_id"), F.lit("toxic").alias("label"))
    return L.decide(sources, _rules(s, kinds), labels)


@query("policy_winner_whole", DECIDED)
def _(s, d):
    return _decided(s, d)


@query("policy_pass_a_whole", f"SELECT action, count(*) AS n FROM ({DECIDED}) WHERE reason <> 'semantic' GROUP BY action")
def _(s, d):
    return _decided(s, d).where("reason <> 'semantic'").groupBy("action").agg(F.count("*").alias("n"))


@query("policy_pass_b_whole", f"SELECT source_id FROM ({DECIDED}) WHERE reason = 'semantic'")
def _(s, d):
    return _decided(s, d).where("reason = 'semantic'").select("source_id")


@query("override_whole", f"SELECT source_id, CASE WHEN source_id % 100 = 3 THEN 'process' ELSE action END AS action, CASE WHEN source_id % 100 = 3 THEN 'manual_override' ELSE reason END AS reason FROM ({DECIDED})")
def _(s, d):
    once = T.sources(s, d).where("source_id % 100 = 3").select("source_id", F.lit("process").alias("action"))
    return L.with_overrides(_decided(s, d), once).select("source_id", "action", "reason")


@query("policy_match", "SELECT doc_id AS source_id, 1 AS rule_id FROM documents WHERE source = 'src0' UNION ALL SELECT doc_id, 2 FROM documents WHERE lang = 'de'")
def _(s, d):
    sources = T.sources(s, d).select("source_id", "creator_id", "collection_id", F.lit("").alias("title"))
    return L.matches(sources, _rules(s, ["creator", "collection"])).select("source_id", "rule_id")


@query("policy_decision_whole", f"SELECT reason, action, count(*) AS n FROM ({DECIDED}) GROUP BY ALL")
def _(s, d):
    return _decided(s, d).groupBy("reason", "action").agg(F.count("*").alias("n"))


@query("policy_diff", "SELECT doc_id AS source_id, 'process' AS old_action, 'metadata_only' AS new_action FROM documents WHERE (source = 'src0' OR lang = 'de') AND source <> 'src0'")
def _(s, d):
    return L.reevaluate(_decided(s, d, ["creator"]), _decided(s, d, ["creator", "collection"]))


@query("escalation", "SELECT doc_id AS source_id, CASE WHEN contains(lower(text), 'license') THEN 3 WHEN n_chars > 3000 THEN 2 ELSE 1 END AS level, concat_ws(',', CASE WHEN n_chars > 3000 THEN 'level2' END, CASE WHEN contains(lower(text), 'license') THEN 'level3' END) AS reasons FROM documents")
def _(s, d):
    level, why = L.level({2: F.col("n_chars") > 3000, 3: F.lower("body").contains("license")})
    return T.sources(s, d).select("source_id", level.alias("level"), why.alias("reasons"))


@query("triage_rules", "SELECT doc_id AS source_id, n_chars < 200 AS short, contains(text, '|') AS tabular FROM documents")
def _(s, d):
    return T.sources(s, d).select("source_id", (F.col("n_chars") < 200).alias("short"), F.col("body").contains("|").alias("tabular"))


@query("sync_upsert", "WITH o AS (SELECT o_orderkey AS id, o_totalprice AS v FROM orders WHERE o_orderkey % 7 <> 0), n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 11 <> 0) SELECT id, CASE WHEN o.v IS NULL THEN 'new' WHEN n.v IS NULL THEN 'missing' ELSE 'changed' END AS change FROM o FULL JOIN n USING (id) WHERE o.v IS DISTINCT FROM n.v")
def _(s, d):
    o = T.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    new = o.where("id % 11 <> 0").withColumn("v", F.when(F.col("id") % 5 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return Q.sync(o.where("id % 7 <> 0"), new, "id", "v")


@query("sync_missing", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 11 = 0")
def _(s, d):
    o = T.table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    return Q.sync(o, o.where("id % 11 <> 0"), "id", "v").where("change = 'missing'").select("id")


@query("evidence_reuse", f"SELECT source_id, ordinal FROM ({LINES}) WHERE sha256(raw_text) NOT IN (SELECT sha256(raw_text) FROM ({LINES}) WHERE source_id < 500) AND source_id >= 500")
def _(s, d):
    e = T.evidence(s, d).withColumn("h", X.content_hash(F.col("raw_text")))
    return J.missing(e.where("source_id >= 500"), e.where("source_id < 500"), "h").select("source_id", F.col("ordinal").cast("long").alias("ordinal"))


@query("label_dist", "SELECT 'quality' AS label, quality AS value, count(*) AS n FROM labels GROUP BY quality UNION ALL SELECT 'toxic', toxic, count(*) FROM labels GROUP BY toxic")
def _(s, d):
    long = T.table(s, d, "labels").select(F.expr("stack(2, 'quality', quality, 'toxic', toxic) AS (label, value)"))
    return long.groupBy("label", "value").agg(F.count("*").alias("n"))


@query("quality_check", f"SELECT 'empty' AS finding, count(*) AS n FROM ({LINES}) WHERE trim(raw_text) = '' UNION ALL SELECT 'long', count(*) FROM ({LINES}) WHERE length(raw_text) > 2000")
def _(s, d):
    e = T.evidence(s, d)
    return e.where(F.trim("raw_text") == "").agg(F.lit("empty").alias("finding"), F.count("*").alias("n")).unionByName(e.where("length > 2000").agg(F.lit("long").alias("finding"), F.count("*").alias("n")))


@query("run_promote", f"SELECT source_id, max(ordinal) AS current_run FROM ({CLAIM}) WHERE run_status = 'F' GROUP BY source_id")
def _(s, d):
    return T.claims(s, d).where("run_status = 'F'").groupBy("source_id").agg(F.max("ordinal").alias("current_run"))


@query("coverage_gap", f"SELECT source_id FROM ({CLAIM}) GROUP BY source_id HAVING NOT bool_or(claim_kind = 'R')")
def _(s, d):
    return T.claims(s, d).groupBy("source_id").agg(F.bool_or(F.col("claim_kind") == "R").alias("has")).where("not has").select("source_id")


@query("cache_expiry", "SELECT event_id FROM events WHERE event_type = 'view' AND epoch_us(ts) // 1000 + 604800000 < 1706000000000")
def _(s, d):
    return T.saves(s, d).where("state = 'view'").where(F.unix_millis("ts") + 604800000 < 1706000000000).select("event_id")


@query("import_queue", "SELECT o_orderkey AS source_id, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS place FROM orders ORDER BY place LIMIT 100")
def _(s, d):
    first = T.table(s, d, "orders").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(100)
    w = Window.orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey")  # over the limited rows
    return first.select(F.col("o_orderkey").alias("source_id"), F.row_number().over(w).cast("long").alias("place"))


@query("next_jobs", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 20")
def _(s, d):
    return T.table(s, d, "orders").where("o_orderstatus = 'O'").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(20).select(F.col("o_orderkey").alias("id"))


@query("budget_cap", "SELECT event_id FROM (SELECT event_id, sum(round(value)) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events) WHERE spent <= 500")
def _(s, d):
    e = T.saves(s, d).select("event_id", F.to_date("ts").alias("day"), F.round("value").alias("cost"))
    return L.budgeted(e, "day", [F.col("event_id")], "cost", 500).select("event_id")


@query("resolve_band", "WITH m AS (SELECT p_type, count(*) AS n FROM part GROUP BY p_type) SELECT p_partkey AS entity_id, CASE WHEN n = 1 THEN 'auto' WHEN p_size >= 25 THEN 'candidate' ELSE 'provisional' END AS band FROM part JOIN m USING (p_type)")
def _(s, d):
    e = T.entities(s, d)
    m = e.groupBy("entity_type").agg(F.count("*").alias("n"))
    score = F.when(F.col("n") == 1, 0.95).otherwise(F.when(F.col("size") >= 25, 0.7).otherwise(0.3))
    return e.join(m, "entity_type").select("entity_id", L.resolution(score, F.col("n") == 1, F.col("n")).alias("band"))


@query("resolve_candidates", "SELECT p_brand AS brand, p_type AS entity_type, min(p_partkey) AS entity_id, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1")
def _(s, d):
    return T.entities(s, d).groupBy("brand", "entity_type").agg(F.min("entity_id").alias("entity_id"), F.count("*").alias("n")).where("n > 1")


@query("resolve_score", "SELECT a.p_partkey AS a, b.p_partkey AS b, levenshtein(a.p_name, b.p_name) AS distance FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey")
def _(s, d):
    e = T.entities(s, d).select(F.col("entity_id").alias("id"), "brand", "entity_type", "canonical_name")
    return J.pairs_of(e, ["brand", "entity_type"], "canonical_name", lambda x, y: F.levenshtein(x, y).cast("long")).withColumnRenamed("score", "distance")


@query("merge_closure_all", "WITH RECURSIVE m AS (SELECT p_partkey AS id, p_partkey // 2 AS up FROM part WHERE p_partkey >= 2), c AS (SELECT id, up FROM m UNION ALL SELECT c.id, m.up FROM c JOIN m ON m.id = c.up) SELECT id, min(up) AS canonical FROM c GROUP BY id")
def _(s, d):
    merges = T.entities(s, d).where("entity_id >= 2").select(F.col("entity_id").alias("id"), F.expr("entity_id div 2").alias("merged_into"))  # 1 is the root
    return J.merge_closure(merges)


@query("lifecycle", "SELECT event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p = 'signup' AND event_type = 'signup'")
def _(s, d):
    e = T.saves(s, d)
    kinds = ["click", "error", "purchase", "signup", "view"]
    allowed = [(a, b) for a in kinds for b in kinds if not a == b == "signup"]
    return Q.bad_transitions(e, "user_id", ["ts", "event_id"], "state", allowed).select("event_id")


@query("bad_transitions", "SELECT event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p = 'error' AND event_type = 'purchase'")
def _(s, d):
    kinds = ["click", "error", "purchase", "signup", "view"]
    allowed = [(a, b) for a in kinds for b in kinds if (a, b) != ("error", "purchase")]
    return Q.bad_transitions(T.saves(s, d), "user_id", ["ts", "event_id"], "state", allowed).select("event_id")


def _jobs(s, d):
    o = T.table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "queued").otherwise("running").alias("status"), F.col("o_custkey").alias("dedupe_key"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("locked_at_ms"), (F.col("o_orderkey") % 4).alias("attempt"))


@query("job_dedupe", "SELECT c_custkey AS dedupe_key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'F')")
def _(s, d):
    new = T.table(s, d, "customer").select(F.col("c_custkey").alias("dedupe_key"), F.col("c_custkey").alias("id"))
    return Q.enqueue(_jobs(s, d), new).select("dedupe_key")


@query("stale_jobs", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus NOT IN ('F', 'O') AND epoch_ms(o_orderdate) + 86400000 < 820454400000")
def _(s, d):
    return Q.stale(_jobs(s, d), 820454400000, 86400000).select("id")


@query("job_backoff", "SELECT o_orderkey AS id, CAST(least(1000 * pow(2, o_orderkey % 4), 5000) AS BIGINT) AS wait_ms FROM orders")
def _(s, d):
    return _jobs(s, d).select("id", Q.backoff(F.col("attempt"), 1000, 5000).alias("wait_ms"))


@query("job_events", "SELECT event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY event_type")
def _(s, d):
    return T.saves(s, d).groupBy(F.col("state").alias("event_type")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("partial_run", f"SELECT source_id, count(*) FILTER (run_status = 'F') AS done, count(*) FILTER (run_status <> 'F') AS failed FROM ({CLAIM}) GROUP BY source_id HAVING count(*) FILTER (run_status = 'F') > 0 AND count(*) FILTER (run_status <> 'F') > 0")
def _(s, d):
    done = F.col("run_status") == "F"
    return T.claims(s, d).groupBy("source_id").agg(F.count_if(done).alias("done"), F.count_if(~done).alias("failed")).where("done > 0 and failed > 0")


@query("tumbling", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 AS start_s, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(s, d):
    return T.saves(s, d).groupBy(F.window("ts", "1 hour").alias("w"), F.col("state").alias("event_type")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("long").alias("start_s"), "event_type", "n")


@query("sliding", "SELECT b AS start_s, count(*) AS n FROM (SELECT unnest([epoch_us(ts) // 1000000 // 1800 * 1800 - 1800, epoch_us(ts) // 1000000 // 1800 * 1800]) AS b FROM events) GROUP BY b")
def _(s, d):
    return T.saves(s, d).groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("long").alias("start_s"), "n")


@query("sessions", "SELECT user_id, session, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 1800000000 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL")
def _(s, d):
    return W.sessions(T.saves(s, d), "user_id", "ts", 1800).groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query("key_dups", "SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def _(s, d):
    return Q.key_duplicates(T.table(s, d, "documents"), ["text"])


@query("fk_orphans", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(s, d):
    return J.missing(T.table(s, d, "documents").select("doc_id"), T.table(s, d, "labels"), "doc_id")


@query("null_checks", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality, toxic) IS NULL")
def _(s, d):
    return Q.all_null(T.table(s, d, "documents").select("doc_id").join(T.table(s, d, "labels"), "doc_id", "left"), ["quality", "toxic"]).select("doc_id")


@query("purge_plan", "SELECT 'lineitem' AS dependent, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 1) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey = 1")
def _(s, d):
    gone = T.table(s, d, "orders").where("o_custkey = 1").select(F.col("o_orderkey").alias("l_orderkey"))
    n = lambda df, name: df.agg(F.lit(name).alias("dependent"), F.count("*").alias("n"))
    return n(J.exists(T.table(s, d, "lineitem"), gone, "l_orderkey"), "lineitem").unionByName(n(gone, "orders"))


@query("integrity", "SELECT count(*) AS n_rows, count(DISTINCT sha256(text)) AS n_texts FROM documents")
def _(s, d):
    return T.sources(s, d).agg(F.count("*").alias("n_rows"), F.count_distinct(X.content_hash(F.col("body"))).alias("n_texts"))


@query("stale_vectors", "SELECT vec_id FROM embeddings LEFT JOIN labels ON doc_id = vec_id WHERE quality IS DISTINCT FROM 1")
def _(s, d):
    l = T.table(s, d, "labels").select(F.col("doc_id").alias("vec_id"), "quality")  # noqa: E741
    return T.table(s, d, "embeddings").select("vec_id").join(l, "vec_id", "left").where(~F.col("quality").eqNullSafe(1)).select("vec_id")


@query("dirty_pages", "SELECT p_partkey AS page_id, count(*) AS n_new FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY p_partkey HAVING count(*) >= 3")
def _(s, d):
    c = T.claims(s, d).where("valid_from_ms >= 883612800000").groupBy(F.col("entity_id").alias("page_id")).agg(F.count("*").alias("n_new")).where("n_new >= 3")
    return J.exists(c, T.entities(s, d).select(F.col("entity_id").alias("page_id")), "page_id")


@query("wiki_map", "SELECT p_brand AS page_type, count(*) AS n, min(p_partkey) AS first_page FROM part GROUP BY p_brand")
def _(s, d):
    return T.entities(s, d).groupBy(F.col("brand").alias("page_type")).agg(F.count("*").alias("n"), F.min("entity_id").alias("first_page"))


@query("lint_structural", "SELECT 'short' AS finding, CAST(doc_id AS VARCHAR) AS object_id FROM documents WHERE n_chars < 50 UNION ALL SELECT 'broken_link', CAST(page_id AS VARCHAR) FROM pages WHERE NOT contains(html, '</body>')")
def _(s, d):
    short = T.sources(s, d).where("n_chars < 50").select(F.lit("short").alias("finding"), F.col("source_id").cast("string").alias("object_id"))
    broken = T.table(s, d, "pages").where(~F.col("html").contains("</body>")).select(F.lit("broken_link").alias("finding"), F.col("page_id").cast("string").alias("object_id"))
    return short.unionByName(broken)


@query("lint_provenance", f"SELECT entity_id FROM ({CLAIM}) GROUP BY entity_id HAVING max(confidence) < 0.09")
def _(s, d):
    return T.claims(s, d).groupBy("entity_id").agg(F.max("confidence").alias("m")).where("m < 0.09").select("entity_id")


@query("lint_consistency", "SELECT a.doc_id AS a, min(b.doc_id) AS b FROM documents a JOIN documents b ON sha256(a.text) = sha256(b.text) AND b.doc_id < a.doc_id GROUP BY a.doc_id")
def _(s, d):
    h = T.sources(s, d).select("source_id", X.content_hash(F.col("body")).alias("h"))
    first = h.groupBy("h").agg(F.min("source_id").alias("b"))
    return h.join(first, "h").where("source_id > b").select(F.col("source_id").alias("a"), "b")


@query("lint_quality", f"SELECT source_id FROM (SELECT source_id, count(*) AS n, count(DISTINCT raw_text) AS k FROM ({LINES}) GROUP BY source_id) WHERE n > k")
def _(s, d):
    return T.evidence(s, d).groupBy("source_id").agg(F.count("*").alias("n"), F.count_distinct("raw_text").alias("k")).where("n > k").select("source_id")


@query("rule_stats", "SELECT o_orderpriority AS rule, count(*) FILTER (o_orderstatus = 'F') AS passed, count(*) FILTER (o_orderstatus <> 'F') AS failed, CASE WHEN count(*) FILTER (o_orderstatus <> 'F') = 0 THEN 'closed' ELSE 'monitoring' END AS state FROM orders GROUP BY o_orderpriority")
def _(s, d):
    ok = F.col("o_orderstatus") == "F"
    r = T.table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("rule")).agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"))
    return r.withColumn("state", F.when(F.col("failed") == 0, "closed").otherwise("monitoring"))


@query("recall_at_k", f"WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) AS k FROM ({VEC})), t AS (SELECT vec_id FROM embeddings WHERE label = (SELECT label FROM embeddings WHERE vec_id = 0)) SELECT round(count(*) / 20.0, 6) AS precision_at_20 FROM r JOIN t USING (vec_id) WHERE k <= 20")
def _(s, d):
    from ..operators import search as S

    e = T.table(s, d, "embeddings")
    top = S.nearest(e, _query_vector(s, d), 20)
    label = e.where("vec_id = 0").select("label")
    return top.join(e.join(label, "label", "left_semi"), "vec_id", "left_semi").agg(F.round(F.count("*") / 20.0, 6).alias("precision_at_20"))


@query("usage", "SELECT event_type AS stage, count(*) AS n, min(round(value, 2)) AS least, max(round(value, 2)) AS most FROM events GROUP BY event_type")
def _(s, d):
    return T.saves(s, d).groupBy(F.col("state").alias("stage")).agg(F.count("*").alias("n"), F.min(F.round("value", 2)).alias("least"), F.max(F.round("value", 2)).alias("most"))


@query("manifest", "SELECT count(*) AS n_rows, CAST(sum(l_orderkey) AS BIGINT) AS digest FROM lineitem")
def _(s, d):
    return T.table(s, d, "lineitem").agg(F.count("*").alias("n_rows"), F.sum("l_orderkey").alias("digest"))
