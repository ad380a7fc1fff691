"""Scalar functions on stored text, conversations and evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import joins as J
from ..operators import windows as W
from ..sources import tables as T
from .registry import query
from .retrieval import CLAIM, LINES, TOKENS


def scalar(name: str, sql: str, column, of: str = "documents", key: str = "doc_id"):
    @query(name, f"SELECT {key}, {sql} AS v FROM {of}")
    def _(s, d):
        return T.table(s, d, of).select(key, column().alias("v"))


scalar("normalize_name", r"trim(regexp_replace(lower(p_name), '\s+', ' ', 'g'))", lambda: X.normalize_name(F.col("p_name")), "part", "p_partkey")
scalar("normalize_text", r"md5(trim(regexp_replace(text, '\s+', ' ', 'g')))", lambda: F.md5(X.normalize_text(F.col("text")).cast("binary")))
scalar("slugify", "regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')", lambda: X.slugify(F.col("p_type")), "part", "p_partkey")
scalar("content_hash", "sha256(text)", lambda: X.content_hash(F.col("text")))
scalar("keyword_match", "contains(lower(text), 'license') OR contains(lower(text), 'token')", lambda: X.keyword_match(F.col("text"), ["license", "Token"]))
scalar("hashtags", r"array_to_string(regexp_extract_all(text, '#([\p{L}\p{N}_]+)', 1), ',')", lambda: F.array_join(X.hashtags(F.col("text")), ","))
scalar("wiki_links", "array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))), ',')", lambda: F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))), ","), "pages", "page_id")
scalar("json_field", "CAST(json_extract_string(props, '$.k') AS BIGINT)", lambda: F.get_json_object("props", "$.k").cast("long"), "events", "event_id")
scalar("epoch_ms", "epoch_us(ts) // 1000", lambda: F.unix_millis(F.col("ts").cast("timestamp")), "events", "event_id")
scalar("format_checks", r"regexp_matches(text, '\$ ?[0-9]+(\.[0-9]{2})?') OR regexp_matches(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}')", lambda: F.col("text").rlike(r"\$ ?[0-9]+(\.[0-9]{2})?") | F.col("text").rlike("[0-9]{4}-[0-9]{2}-[0-9]{2}"))
scalar("url_domain", r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^(www|m)\.', '')", lambda: X.url_domain(F.col("url")), "pages", "page_id")
scalar("tokenize", f"len({TOKENS})", lambda: F.size(X.tokens(F.col("text"))).cast("long"))
scalar("snippet", "CASE WHEN instr(lower(text), 'token') > 0 THEN substr(text, greatest(instr(lower(text), 'token') - 20, 1), 45) END", lambda: X.snippet(F.col("text"), "token", 20))
scalar("provenance_rank", "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END", lambda: X.provenance_rank(F.when(F.col("o_orderstatus") == "F", "statement").when(F.col("o_orderstatus") == "O", "visual_observation")), "orders", "o_orderkey")
scalar("profile_route", "CASE WHEN p_type LIKE '%BRASS' THEN 'tool_review' WHEN p_type LIKE '%TIN' THEN 'travel_guide' ELSE 'default' END", lambda: F.when(F.col("p_type").endswith("BRASS"), "tool_review").when(F.col("p_type").endswith("TIN"), "travel_guide").otherwise("default"), "part", "p_partkey")
scalar("entity_profile", "concat_ws(' | ', p_name, p_brand, p_type)", lambda: F.concat_ws(" | ", "p_name", "p_brand", "p_type"), "part", "p_partkey")
scalar("stable_id", "'src_' || substr(sha256(concat_ws('|', source, CAST(doc_id AS VARCHAR))), 1, 16)", lambda: X.stable_id("src_", F.col("source"), F.col("doc_id")))


@query("scope_rules", r"SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '(^|[^a-z])(my|saved|i)([^a-z]|$)') THEN 'personal' ELSE 'hybrid' END AS scope FROM conversations")
def _(s, d):
    mine = F.lower("text").rlike("(^|[^a-z])(my|saved|i)([^a-z]|$)")
    return T.messages(s, d).select("conv_id", "turn", F.when(mine, "personal").otherwise("hybrid").alias("scope"))


@query("intents", "SELECT conv_id, turn, contains(text, '?') AS answer, regexp_matches(lower(text), 'find|search|show') AS find, length(text) > 400 AS synthesize FROM conversations WHERE role = 'user'")
def _(s, d):
    t = F.col("text")
    return T.messages(s, d).where("role = 'user'").select("conv_id", "turn", t.contains("?").alias("answer"), F.lower(t).rlike("find|search|show").alias("find"), (F.length(t) > 400).alias("synthesize"))


@query("bad_ranges", f"SELECT source_id, ordinal FROM ({CLAIM}) WHERE price > 2000 OR quantity < 2")
def _(s, d):
    return T.claims(s, d).where("price > 2000 or quantity < 2").select("source_id", "ordinal")


@query("turn_pairs", "SELECT conv_id, turn, text AS asked, answer FROM (SELECT *, lead(text) OVER w AS answer, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'")
def _(s, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    m = T.messages(s, d).withColumn("answer", F.lead("text").over(w)).withColumn("next_role", F.lead("role").over(w))
    return m.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("asked"), "answer")


@query("followup", "SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def _(s, d):
    return W.latest(T.messages(s, d).where("role = 'assistant'"), ["conv_id"], [F.desc("turn")]).select("conv_id", "turn")


@query("followup_nth", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'assistant') WHERE n = 2")
def _(s, d):
    return W.ranked(T.messages(s, d).where("role = 'assistant'"), ["conv_id"], [F.col("turn")], "n").where("n = 2").select("conv_id", "turn")


@query("evidence_packet", f"SELECT entity_id, count(*) AS n, string_agg(source_id || ':' || ordinal, ',' ORDER BY source_id, ordinal) AS packet FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, source_id, ordinal) AS k FROM ({CLAIM})) WHERE k <= 5 GROUP BY entity_id")
def _(s, d):
    c = W.cap(T.claims(s, d), ["entity_id"], [F.desc("confidence"), F.col("source_id"), F.col("ordinal")], 5)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("source_id", "ordinal"))), lambda x: F.concat_ws(":", x["source_id"], x["ordinal"]))
    return c.groupBy("entity_id").agg(F.count("*").alias("n"), F.array_join(ids, ",").alias("packet"))


@query("citations", f"SELECT source_id, min(CASE WHEN claim_kind = 'A' THEN 1 WHEN claim_kind = 'N' THEN 2 ELSE 3 END) AS tier FROM ({CLAIM}) GROUP BY source_id")
def _(s, d):
    tier = F.when(F.col("claim_kind") == "A", 1).when(F.col("claim_kind") == "N", 2).otherwise(3)
    return W.latest(T.claims(s, d).withColumn("tier", tier), ["source_id"], [F.col("tier"), F.col("ordinal")]).select("source_id", "tier")


@query("bad_citations", f"SELECT source_id, ordinal FROM ({CLAIM}) WHERE source_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def _(s, d):
    good = T.table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("source_id"))
    return J.missing(T.claims(s, d), good, "source_id").select("source_id", "ordinal")


@query("plan_mixed", f"SELECT entity_id, count(*) AS n FROM ({CLAIM}) WHERE price <= 1500 AND entity_id IN (SELECT p_partkey FROM part WHERE p_size < 10) AND source_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY entity_id ORDER BY n DESC, entity_id LIMIT 20")
def _(s, d):
    c = J.exists(T.claims(s, d).where("price <= 1500"), T.entities(s, d).where("size < 10"), "entity_id")
    c = J.exists(c, T.table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("source_id")), "source_id")
    return c.groupBy("entity_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_id").limit(20)


@query("opinion_vs_self", f"SELECT entity_id, count(*) FILTER (claim_kind = 'A') AS creator_claims, count(*) FILTER (claim_kind <> 'A') AS own_notes FROM ({CLAIM}) GROUP BY entity_id")
def _(s, d):
    return T.claims(s, d).groupBy("entity_id").agg(F.count_if(F.col("claim_kind") == "A").alias("creator_claims"), F.count_if(F.col("claim_kind") != "A").alias("own_notes"))


@query("digest", f"SELECT source_id, source_id || ': ' || count(*) || ' lines' AS digest FROM ({LINES}) GROUP BY source_id")
def _(s, d):
    return T.evidence(s, d).groupBy("source_id").agg(F.count("*").alias("n")).select("source_id", F.concat(F.col("source_id").cast("string"), F.lit(": "), F.col("n").cast("string"), F.lit(" lines")).alias("digest"))
