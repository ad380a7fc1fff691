"""The model's tables, derived from the given ones.

Documents are sources, orders and order lines are claims, parts are entities and pages, events are snapshots, evidence,
frames, states and findings, user turns are questions. What the given tables lack (failures, deletions, stale versions,
wrong links) follows from ids, so that each kind of row is there at every size. Every table is made of whole given tables
and grows with them. The text of each is SQL that Spark and other engines read alike; {name} is a given table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CLAIM = "l_orderkey * 10 + l_linenumber"
GIVEN = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
TABLES = {
    "sources": """SELECT doc_id AS source_id, source AS creator_id, lang AS collection_id, text AS title, doc_id * 1000 AS saved_at_ms, CASE WHEN doc_id % 13 = 0 THEN 'unavailable' ELSE 'available' END AS availability,
        CASE WHEN doc_id % 17 = 0 THEN doc_id * 1000 + 7 END AS locally_deleted_at_ms FROM {documents}""",
    "incoming": "SELECT doc_id AS source_id, lang AS collection_id FROM {documents} WHERE doc_id % 7 <> 3 UNION ALL SELECT doc_id + 1000000000, lang FROM {documents} WHERE doc_id % 50 = 0",
    "snapshots": "SELECT event_id AS snapshot_id, user_id AS source_id, event_id + event_id * 7919 % 997 AS fetched_at_ms, event_id AS arrival, event_type AS content_hash FROM {events}",
    "runs": """SELECT doc_id * 2 AS run_id, doc_id AS source_id, 'completed' AS status, doc_id % 100 AS finished_at_ms FROM {documents} UNION ALL
        SELECT doc_id * 2 + 1, doc_id, CASE doc_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'running' END, CASE WHEN doc_id % 3 <> 2 THEN doc_id % 50 * 3 END FROM {documents}""",
    "evidence": """SELECT event_id AS evidence_id, user_id AS source_id, CASE event_id % 6 WHEN 0 THEN 'caption' WHEN 1 THEN 'transcript' WHEN 2 THEN 'native_subtitle' WHEN 3 THEN 'ocr' WHEN 4 THEN 'keyframe' ELSE 'visual_observation' END AS kind,
        CASE WHEN event_id % 6 <> 0 THEN event_id % 1000 * 1000 END AS start_ms, CASE WHEN event_id % 6 <> 0 THEN event_id % 1000 * 1000 + (event_id % 7 - 1) * 2000 END AS end_ms,
        CASE WHEN event_id % 6 <> 4 THEN event_type || ' ' || CAST(event_id AS STRING) END AS text FROM {events}""",
    "run_evidence": "SELECT user_id * 2 AS run_id, event_id AS evidence_id FROM {events} WHERE event_id % 6 <> user_id % 6 UNION ALL SELECT user_id * 2 + 1, event_id FROM {events} WHERE event_id % 5 = 0",
    "chunks": "SELECT DISTINCT user_id * 1000 + CAST(floor(event_id % 1000 / 30.0) AS BIGINT) AS chunk_id, user_id AS source_id, CAST(floor(event_id % 1000 / 30.0) AS BIGINT) * 30000 AS start_ms, CAST(floor(event_id % 1000 / 30.0) AS BIGINT) * 30000 + 30000 AS end_ms FROM {events}",
    "rules": """SELECT n_nationkey AS rule_id, CASE n_nationkey % 5 WHEN 0 THEN 'creator' WHEN 1 THEN 'collection' WHEN 2 THEN 'source_always' WHEN 3 THEN 'keyword' ELSE 'semantic' END AS kind,
        CASE n_nationkey % 5 WHEN 0 THEN 'src' || CAST(n_nationkey AS STRING) WHEN 1 THEN CASE n_nationkey WHEN 1 THEN 'en' WHEN 6 THEN 'DE' WHEN 11 THEN 'fr' ELSE 'es' END WHEN 2 THEN CAST(n_nationkey * 3 AS STRING)
        WHEN 3 THEN CASE n_nationkey WHEN 3 THEN 'LICENSE' WHEN 8 THEN 'http' WHEN 13 THEN 'the the' ELSE 'einheit ' END ELSE CASE n_nationkey WHEN 4 THEN 'toxic' ELSE 'economy' END END AS target,
        CASE WHEN n_nationkey % 2 = 0 THEN 'metadata_only' ELSE 'process' END AS action, n_regionkey AS priority, n_nationkey * 10 AS created_at_ms, n_nationkey % 7 <> 6 AS is_enabled FROM {nation}""",
    "labels_of": "SELECT doc_id AS source_id, 'toxic' AS label FROM {labels} WHERE toxic = 1 UNION ALL SELECT doc_id, 'good' FROM {labels} WHERE quality = 1 UNION ALL SELECT doc_id, 'economy' FROM {documents} WHERE doc_id % 40 = 1",
    "rule_versions": "SELECT o_custkey AS rule_id, o_orderkey AS version, CASE WHEN o_orderstatus = 'F' THEN 'process' ELSE 'metadata_only' END AS action, o_orderstatus = 'P' AS is_deleted, o_orderkey AS at_ms FROM {orders}",
    "claims": f"""SELECT {CLAIM} AS claim_id, l_orderkey AS source_id, l_partkey AS entity_id, 'quantity' AS predicate, l_quantity AS value_number, CASE WHEN l_linenumber % 2 = 0 THEN 'HKD' END AS currency,
        CASE l_returnflag WHEN 'A' THEN 'explicit_source_statement' WHEN 'N' THEN 'on_screen_text' ELSE 'model_inference' END AS provenance FROM {{lineitem}}""",
    "claim_evidence": f"SELECT {CLAIM} AS claim_id, (l_orderkey * 7 + l_linenumber) % 20000 AS evidence_id FROM {{lineitem}} WHERE l_linenumber % 3 <> 0",
    "entities": """SELECT p_partkey AS entity_id, lower(p_type) AS entity_type, p_name || ' ' || p_brand AS name, CASE WHEN p_partkey % 100 = 57 THEN p_partkey + 1 WHEN p_partkey % 100 = 58 THEN p_partkey - 1 WHEN p_partkey % 10 IN (3, 4) THEN p_partkey - 1 END AS merged_into FROM {part}""",
    "aliases": "SELECT p_partkey AS entity_id, p_name || '  ' || p_brand AS alias FROM {part} UNION ALL SELECT p_partkey, upper(p_name) || ' ' || p_brand FROM {part} WHERE p_partkey % 5 = 0 UNION ALL SELECT p_partkey, 'part ' || CAST(p_partkey AS STRING) FROM {part}",
    "mentions": """SELECT p_partkey AS mention_id, p_partkey % 100 AS source_id, CASE p_partkey % 4 WHEN 0 THEN '  ' || upper(p_name) || ' ' || p_brand WHEN 1 THEN 'prat ' || CAST(p_partkey AS STRING) WHEN 2 THEN 'nothing like ' || p_type ELSE 'PART   ' || CAST(p_partkey AS STRING) END AS mention_text,
        lower(p_type) AS type_hint, CASE WHEN p_partkey % 4 <> 2 THEN p_partkey END AS truth FROM {part} UNION ALL
        SELECT 1000000000 + p_partkey, p_partkey % 100, 'part ' || CAST(p_partkey AS STRING), lower(p_type), p_partkey - p_partkey % 10 % 2 FROM {part} WHERE p_partkey % 3 = 0""",
    "states": "SELECT user_id AS entity_id, CASE user_id % 3 WHEN 0 THEN 'restaurant' WHEN 1 THEN 'tool' ELSE 'place' END AS entity_type, event_type AS state, event_id AS at_ms FROM {events}",
    "allowed": "SELECT DISTINCT CASE user_id % 3 WHEN 0 THEN 'restaurant' WHEN 1 THEN 'tool' ELSE 'place' END AS entity_type, event_type AS old, CASE user_id % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'click' ELSE 'purchase' END AS new FROM {events}",
    "said": "SELECT DISTINCT user_id AS entity_id, 'using' AS state, CAST(1000000000 AS BIGINT) AS at_ms FROM {events} WHERE user_id % 3 = 1",
    "pages": """SELECT p_partkey AS page_id, CASE p_partkey % 3 WHEN 0 THEN 'entity' WHEN 1 THEN 'concept' ELSE 'topic' END AS family, CASE WHEN p_partkey % 97 = 5 THEN 'Part ' ELSE 'part-' END || CAST(p_partkey AS STRING) AS slug, p_name AS title,
        CASE WHEN p_partkey % 3 = 0 THEN p_partkey END AS entity_id, lower(p_type) AS domain, 'A ' || p_name || ' of ' || p_brand AS summary, p_size * 100 + 40 AS size FROM {part} UNION ALL
        SELECT 1000000000 + item_id, 'synthesis', 'item-' || CAST(item_id AS STRING), text, NULL, 'text', text, 5000 FROM {benchmark}""",
    "revisions": "SELECT p_partkey * 2 AS revision_id, p_partkey AS page_id, 1 AS revision_no, p_partkey AS at_ms FROM {part} WHERE p_partkey % 11 <> 0 UNION ALL SELECT p_partkey * 2 + 1, p_partkey, 2, p_partkey + 5 FROM {part} WHERE p_partkey % 11 <> 0 AND p_partkey % 3 <> 0",
    "statements": f"SELECT {CLAIM} AS statement_id, l_partkey * 2 + l_linenumber % 2 AS revision_id, 'Quantity ' || CAST(CAST(l_quantity AS BIGINT) AS STRING) AS text FROM {{lineitem}}",
    "supports": f"""SELECT {CLAIM} AS statement_id, CASE WHEN l_linenumber % 4 = 0 THEN {CLAIM} + CASE WHEN l_orderkey % 9 = 0 THEN 1000000000 ELSE 0 END END AS claim_id, CASE WHEN l_linenumber % 4 = 1 THEN l_orderkey % 20000 END AS evidence_id,
        CASE WHEN l_linenumber % 4 = 2 THEN l_orderkey END AS source_id FROM {{lineitem}}""",
    "context": "SELECT DISTINCT l_orderkey AS source_id, l_partkey AS page_id FROM {lineitem} WHERE l_linenumber <= 2",
    "mutations": f"""SELECT {CLAIM} AS mutation_id, l_orderkey AS source_id, CASE l_linenumber % 5 WHEN 0 THEN 'create_page' WHEN 1 THEN 'update_page' WHEN 2 THEN 'add_link' WHEN 3 THEN 'drop_page' ELSE CASE WHEN l_orderkey % 2 = 0 THEN 'no_change' ELSE 'mark_conflict' END END AS operation,
        CASE WHEN l_linenumber % 5 <> 0 OR l_orderkey % 3 = 0 THEN l_partkey END AS page_id, 1 + l_orderkey % 2 AS base_revision, CASE WHEN l_orderkey % 8 <> 0 THEN {CLAIM} END AS claim_id FROM {{lineitem}}""",
    "findings": "SELECT event_type AS finding_type, user_id AS page_id, CASE event_id % 4 WHEN 2 THEN 'repair' WHEN 3 THEN 'closed' ELSE 'open' END AS event, event_id AS at_ms FROM {events}",
    "thresholds": "SELECT CASE r_regionkey WHEN 0 THEN 'new_sources' WHEN 1 THEN 'dirty_pages' ELSE 'open_findings' END AS counter, r_regionkey * 100 + 5 AS threshold FROM {region} WHERE r_regionkey < 3",
    "links": "SELECT DISTINCT l_partkey AS page_id, CASE WHEN l_orderkey % 20 = 7 THEN 'nowhere-' ELSE 'part-' END || CAST(l_suppkey AS STRING) AS to_slug FROM {lineitem}",
    "questions": "SELECT conv_id * 100 + turn AS question_id, CASE conv_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'es' END AS collection_id, CAST(turn % 3 AS INT) AS level FROM {conversations} WHERE role = 'user'",
    "levels": "SELECT doc_id AS source_id, doc_id % 4 AS achieved_level, CASE WHEN doc_id % 5 = 0 THEN 'metadata_only' ELSE 'process' END AS action FROM {documents}",
    "expected": "SELECT conv_id * 100 + turn AS question_id, (conv_id * 7 + turn) % 200 AS source_id FROM {conversations} WHERE role = 'user' UNION ALL SELECT conv_id * 100 + turn, (conv_id * 3 + turn) % 100 + 200 FROM {conversations} WHERE role = 'user' AND conv_id % 3 <> 0",
    "answers": "SELECT conv_id * 100 + turn AS question_id, (conv_id * 7 + turn) % 200 AS source_id, 1 + conv_id % 3 AS place FROM {conversations} WHERE role = 'user' UNION ALL SELECT conv_id * 100 + turn, (conv_id * 3 + turn) % 100 + 200, 1 + conv_id % 4 FROM {conversations} WHERE role = 'user' AND conv_id % 2 = 0",
    "cited": "SELECT event_id % 60 * 100 AS question_id, user_id AS source_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN event_id + 1 ELSE event_id END AS evidence_id, event_id AS place FROM {events}",
    "frames": "SELECT event_id AS frame_id, user_id AS source_id, event_id * 10 AS at_ms, CAST(event_id * 31 % 100 AS DOUBLE) / 100 AS sharpness, event_type AS look, event_id % 7 = 0 AS scene_change FROM {events}",
    "assets": """SELECT page_id AS asset_id, page_id * 7 % 1500 AS source_id, CASE page_id % 3 WHEN 0 THEN 'pinned' ELSE 'cache' END AS class, CASE page_id % 20 WHEN 3 THEN '/abs/' WHEN 4 THEN 'page/../' ELSE 'page/' END || CAST(page_id AS STRING) || '.html' AS object_key,
        length(html) AS bytes, page_id AS created_at_ms FROM {pages}""",
    "settings": "SELECT CASE event_id % 9 WHEN 0 THEN 'api_key_' WHEN 1 THEN 'oauth_token_' ELSE 'theme_' END || CAST(user_id AS STRING) AS name, event_type AS value, event_id AS at_ms FROM {events}",
    "jobs": """SELECT event_id AS job_id, CASE event_id % 3 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' ELSE 'succeeded' END AS status, event_id % 10 AS priority, event_id % 2000 AS available_at_ms, CASE WHEN event_id % 3 <> 0 THEN event_id % 1000 END AS locked_at_ms,
        CASE WHEN event_id % 3 <> 0 THEN 'w' || CAST(user_id AS STRING) END AS worker FROM {events}""",
    "metrics": "SELECT event_type AS stage, 'm' || CAST(user_id % 5 AS STRING) AS model, event_id % 1000 AS tokens_in, event_id % 300 AS tokens_out, event_id % 7 AS cost, event_id % 5000 AS latency_ms FROM {events}",
    "bodies": "SELECT p_partkey AS id, CASE WHEN p_partkey % 7 <> 0 THEN 'see [[part-' || CAST(p_partkey + 1 AS STRING) || ']], [[' || p_name || '|the ' || p_name || ']] and [[' || p_brand || ']]' ELSE 'no link of ' || p_name END AS body FROM {part}",
}


def sql(name: str) -> str:
    """A table's SQL over views with the given tables' names."""
    text = TABLES[name]
    for g in GIVEN:
        text = text.replace("{" + g + "}", g)
    return text


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    used = [g for g in GIVEN if "{" + g + "}" in TABLES[name]]
    return spark.sql(TABLES[name], **{g: spark.read.parquet(f"{folder}/{g}.parquet") for g in used})
