"""Small model tables as SQL values, which Spark and the SQL oracles read alike.

The driver's tables have no runs, rules, merges, wiki pages or late snapshots; these rows hold each case that their
operators must tell apart. Times are epoch milliseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    # 2 and 3 are one creator's; 5 is gone upstream; 6 is deleted here; 8 was never processed
    "sources": """(1, 'c1', 'k1', 'Mong Kok noodle guide', 1000, 'available', NULL), (2, 'c2', 'k1', 'Movie clip one', 2000, 'available', NULL), (3, 'c2', 'k2', 'Agent tools REVIEW', 3000, 'available', NULL),
        (4, 'c3', 'k2', 'Hiking Sai Kung', 4000, 'available', NULL), (5, 'c3', 'k1', 'Old talk', 5000, 'available', NULL), (6, 'c4', 'k1', 'Deleted one', 6000, 'available', 7000),
        (7, 'c4', 'k2', 'Variety show clip', 7000, 'available', NULL), (8, 'c5', 'k2', 'Quiet post', 8000, 'available', NULL)
        |source_id, creator_id, collection_id, title, saved_at_ms, availability, locally_deleted_at_ms""",
    "incoming": """(1, 'k1'), (2, 'k1'), (3, 'k2'), (4, 'k2'), (7, 'k2'), (8, 'k2'), (9, 'k1')|source_id, collection_id""",
    # source 4's hash goes a, b, a; source 3's middle snapshot arrives after its last one
    "snapshots": """(1, 1, 100, 1, 'a'), (2, 4, 100, 2, 'a'), (3, 4, 200, 3, 'b'), (4, 4, 300, 4, 'a'), (5, 3, 100, 5, 'x'), (6, 3, 300, 6, 'z'), (7, 3, 200, 7, 'y'), (8, 1, 200, 8, 'a')
        |snapshot_id, source_id, fetched_at_ms, arrival, content_hash""",
    # a failed newer run never becomes current; of two that end together the larger id does
    "runs": """(1, 1, 'completed', 10), (2, 1, 'completed', 20), (3, 1, 'failed', 30), (4, 3, 'completed', 15), (5, 3, 'completed', 15), (6, 4, 'failed', 40), (7, 7, 'completed', 5), (8, 2, 'running', NULL)
        |run_id, source_id, status, finished_at_ms""",
    "evidence": """(1, 1, 'caption', NULL, NULL, 'cheap noodles'), (2, 1, 'transcript', 12000, 19000, 'the noodles cost 40'), (3, 1, 'transcript', 20000, 30000, 'open until ten'), (4, 1, 'ocr', 21000, 21000, 'HKD 40'),
        (5, 3, 'native_subtitle', 0, 4000, 'a tool for agents'), (6, 3, 'keyframe', 1000, 1000, NULL), (7, 4, 'visual_observation', 500, 900, 'a trail'), (8, 7, 'caption', NULL, NULL, 'clip'), (9, 1, 'transcript', 50000, 40000, 'bad range')
        |evidence_id, source_id, kind, start_ms, end_ms, text""",
    "run_evidence": """(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (2, 4), (3, 1), (4, 5), (5, 5), (5, 6), (6, 7), (7, 8)|run_id, evidence_id""",
    "chunks": """(1, 1, 12000, 30000), (2, 1, 30000, 60000), (3, 3, 0, 5000)|chunk_id, source_id, start_ms, end_ms""",
    "rules": """(1, 'creator', 'c2', 'metadata_only', 0, 10, TRUE), (2, 'source_always', '3', 'process', 0, 20, TRUE), (3, 'collection', 'k2', 'metadata_only', 0, 30, TRUE), (4, 'semantic', 'variety_clip', 'metadata_only', 0, 40, TRUE),
        (5, 'keyword', 'CLIP', 'metadata_only', 0, 50, TRUE), (6, 'keyword', 'noodle', 'process', 5, 60, FALSE), (7, 'creator', 'c4', 'process', 0, 70, TRUE), (8, 'keyword', 'guide', 'process', 1, 80, TRUE), (9, 'keyword', 'mong', 'metadata_only', 1, 90, TRUE)
        |rule_id, kind, target, action, priority, created_at_ms, is_enabled""",
    "labels_of": """(7, 'variety_clip'), (1, 'food'), (4, 'variety_clip'), (5, 'variety_clip')|source_id, label""",
    "rule_versions": """(1, 1, 'metadata_only', FALSE, 10), (1, 2, 'process', FALSE, 20), (2, 1, 'process', FALSE, 10), (2, 2, 'process', TRUE, 30), (3, 1, 'metadata_only', FALSE, 15)|rule_id, version, action, is_deleted, at_ms""",
    "claims": """(1, 1, 1, 'price', 40, 'HKD', 'explicit_source_statement'), (2, 3, 1, 'price', 55, 'HKD', 'model_inference'), (3, 3, 2, 'url', NULL, NULL, 'on_screen_text'), (4, 4, 3, 'length_km', 9, NULL, 'visual_observation'), (5, 1, 1, 'price', 40, 'HKD', 'on_screen_text'), (6, 9, 4, 'price', 3, 'HKD', 'explicit_source_statement')
        |claim_id, source_id, entity_id, predicate, value_number, currency, provenance""",
    "claim_evidence": """(1, 2), (3, 6), (4, 7), (5, 4), (2, 99)|claim_id, evidence_id""",
    "entities": """(1, 'restaurant', 'Noodle  House', NULL), (2, 'tool', 'AgentKit', NULL), (3, 'place', 'Sai Kung trail', NULL), (4, 'restaurant', 'Noodle House MK', 1), (5, 'restaurant', 'Old Noodle House', 4), (6, 'tool', 'Loop A', 7), (7, 'tool', 'Loop B', 6)
        |entity_id, entity_type, name, merged_into""",
    "aliases": """(1, 'Noodle House'), (1, 'ＮＯＯＤＬＥ　House'), (2, 'Agent Kit'), (2, 'agentkit'), (3, 'Sai Kung'), (1, 'noodle house')|entity_id, alias""",
    "mentions": """(1, 1, '  NOODLE house ', 'restaurant', 1), (2, 3, 'AgentKit', 'tool', 2), (3, 4, 'sai kung', 'place', 3), (4, 3, 'agentkit', 'restaurant', 2), (5, 1, 'Noodle Hause', 'restaurant', 1), (6, 4, 'unknown', 'place', NULL)
        |mention_id, source_id, mention_text, type_hint, truth""",
    "states": """(1, 'restaurant', 'saved', 1), (1, 'restaurant', 'visited', 2), (2, 'tool', 'saved', 1), (2, 'tool', 'visited', 2), (3, 'place', 'visited', 1), (3, 'place', 'saved', 2), (2, 'tool', 'tried', 3)|entity_id, entity_type, state, at_ms""",
    "allowed": """('restaurant', 'saved', 'visited'), ('restaurant', 'visited', 'saved'), ('tool', 'saved', 'tried'), ('tool', 'tried', 'using'), ('place', 'saved', 'visited')|entity_type, old, new""",
    "pages": """(1, 'entity', 'noodle-house', 'Noodle House', 1, 'food', 'A noodle shop in Mong Kok', 900), (2, 'entity', 'Agent Kit', 'AgentKit', 2, 'tools', 'Tool for agents', 400), (3, 'concept', 'agents', 'Agents', NULL, 'tools', 'What agents are', 1200),
        (4, 'topic', 'hiking', 'Hiking', NULL, 'travel', 'Trails and hikes of Sai Kung', 800), (5, 'synthesis', 'cheap-eats', 'Cheap eats', NULL, 'food', 'Cheap noodle places', 1500), (6, 'concept', 'cinema', 'Cinema', NULL, 'film', 'On films', 300)
        |page_id, family, slug, title, entity_id, domain, summary, size""",
    "revisions": """(1, 1, 1, 10), (2, 1, 2, 20), (3, 2, 1, 10), (4, 3, 1, 30), (5, 4, 1, 5), (6, 5, 1, 50), (7, 5, 2, 60)|revision_id, page_id, revision_no, at_ms""",
    "statements": """(1, 2, 'Noodles cost 40'), (2, 2, 'Open until ten'), (3, 3, 'Runs agents'), (4, 4, 'Agents plan'), (5, 7, 'All are cheap'), (6, 1, 'An old one')|statement_id, revision_id, text""",
    "supports": """(1, 1, NULL, NULL), (2, NULL, 3, NULL), (3, 3, NULL, NULL), (4, NULL, NULL, 3), (5, 2, NULL, NULL), (6, NULL, 77, NULL)|statement_id, claim_id, evidence_id, source_id""",
    "context": """(1, 1), (1, 5), (3, 2)|source_id, page_id""",
    "mutations": """(1, 1, 'update_page', 1, 2, 1), (2, 1, 'update_page', 4, 1, 1), (3, 1, 'create_page', NULL, NULL, 1), (4, 3, 'update_page', 2, 1, NULL), (5, 1, 'mark_conflict', 5, 1, 2), (6, 3, 'drop_page', 2, 1, 3), (7, 3, 'add_link', 2, 1, 3), (8, 1, 'no_change', 1, 2, NULL)
        |mutation_id, source_id, operation, page_id, base_revision, claim_id""",
    "findings": """('unsupported_statement', 1, 'open', 10), ('unsupported_statement', 1, 'repair', 20), ('unsupported_statement', 1, 'open', 30), ('broken_link', 2, 'open', 5), ('broken_link', 2, 'repair', 6), ('broken_link', 2, 'closed', 7), ('orphan', 6, 'open', 9)|finding_type, page_id, event, at_ms""",
    "thresholds": """('new_sources', 5), ('dirty_pages', 4), ('open_findings', 2)|counter, threshold""",
    "links": """(1, 'cheap-eats'), (1, 'Agent Kit'), (2, 'agents'), (3, 'nowhere'), (4, 'hiking'), (5, 'noodle-house')|page_id, to_slug""",
    # a question's wanted sources, what was cited, and whether an empty answer was right
    "questions": """(1, 'noodle', 'k1', 2), (2, 'clip', 'k2', 1), (3, 'hiking', 'k1', 1), (4, 'nothing', 'k1', 1), (5, 'quiet', 'k2', 2)|question_id, term, collection_id, level""",
    "levels": """(1, 2, 'process'), (2, 0, 'metadata_only'), (3, 2, 'process'), (4, 2, 'process'), (5, 1, 'process'), (7, 0, 'metadata_only'), (8, 1, 'process')|source_id, achieved_level, action""",
    "expected": """(1, 1), (1, 3), (2, 7), (3, 4), (5, 8)|question_id, source_id""",
    "answers": """(1, 1, 1), (1, 4, 2), (1, 3, 3), (2, 2, 1), (3, 4, 1), (5, 8, 1)|question_id, source_id, place""",
    "cited": """(1, 1, 2, 1), (1, 3, 6, 2), (2, 2, 77, 1), (3, 4, 7, 1), (3, 4, NULL, 2), (1, 3, 5, 3)|question_id, source_id, evidence_id, place""",
    "frames": """(1, 1, 0, 0.9, 'h1', FALSE), (2, 1, 400, 0.8, 'h1', FALSE), (3, 1, 900, 0.2, 'h2', FALSE), (4, 1, 1500, 0.7, 'h3', TRUE), (5, 1, 2600, 0.6, 'h3', FALSE), (6, 1, 4000, 0.9, 'h4', FALSE), (7, 3, 0, 0.5, 'h1', FALSE), (8, 3, 5000, 0.1, 'h5', TRUE)|frame_id, source_id, at_ms, sharpness, look, scene_change""",
    "assets": """(1, 1, 'cache', 'video/1.mp4', 900, 10), (2, 1, 'pinned', 'frame/1.png', 20, 10), (3, 3, 'cache', '/abs/3.mp4', 500, 20), (4, 4, 'cache', 'video/../4.mp4', 10, 30), (5, 9, 'pinned', 'frame/9.png', 5, 40)|asset_id, source_id, class, object_key, bytes, created_at_ms""",
    "settings": """('language', 'en', 1), ('language', 'zh', 2), ('api_key', 'sk-1', 1), ('budget', '5', 1), ('oauth_token', 'x', 3)|name, value, at_ms""",
    "jobs": """(1, 'queued', 1, 10, NULL, NULL), (2, 'running', 5, 10, 90, 'w1'), (3, 'running', 4, 10, 10, 'w2'), (4, 'queued', 9, 500, NULL, NULL), (5, 'queued', 3, 20, NULL, NULL), (6, 'succeeded', 9, 1, 1, 'w1')|job_id, status, priority, available_at_ms, locked_at_ms, worker""",
    "metrics": """('extract', 'm1', 100, 20, 5, 300), ('extract', 'm1', 300, 40, 9, 500), ('extract', 'm2', 50, 10, 1, 100), ('answer', 'm1', 900, 200, 40, 2500), ('answer', 'm1', 100, 90, 10, 1500)|stage, model, tokens_in, tokens_out, cost, latency_ms""",
    "mind": """(1, 'saved', 1, 900), (2, 'saved', 2, 900), (3, 'using', 2, 100), (4, 'done', 1, 950)|entity_id, state, topic, at_ms""",
}


TABLES["said"] = "(2, 'using', 9)|entity_id, state, at_ms"
TABLES["bodies"] = "(1, 'see [[Noodle House]] and [[agents|the agents]]'), (2, 'no link'), (3, '[[a]][[b]] [[a]]')|id, body"


def sql(name: str) -> str:
    """The table as a subquery of either engine."""
    rows, columns = TABLES[name].rsplit("|", 1)
    return f"(SELECT * FROM (VALUES {rows.strip()}) AS v({columns}))"


def table(spark: SparkSession, name: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {sql(name)}")
