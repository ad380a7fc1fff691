"""Plans on the model's tables, each with SQL that gives the same rows whatever the tables hold.

A plan takes t(name), which gives a table; in its SQL {name} stands for one. The tests run the cases on small tables whose
rows hold what the specification tells apart; catalog.py registers them over the tables that derived.py makes.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import answers as A
from ..operators import evaluate as E
from ..operators import evidence as V
from ..operators import jobs as Q
from ..operators import joins as J
from ..operators import policy as L
from ..operators import wiki as K
from ..operators import windows as W

CASES: dict[str, tuple[Callable, str]] = {}


def case(name: str, sql: str):
    def keep(f):
        CASES[name] = f, sql
        return f

    return keep


WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000"
NARROW = ("".join(map(chr, range(0x21, 0x7F))) + " ").replace("'", "''")


ENABLED = "SELECT * FROM {rules} WHERE is_enabled"
DECIDE = """SELECT source_id, action, rule_id, kind FROM (SELECT s.source_id, r.action, r.rule_id, r.kind, row_number() OVER (PARTITION BY s.source_id ORDER BY CASE r.kind WHEN 'source_always' THEN 1 WHEN 'source_exclude' THEN 2
 WHEN 'creator' THEN 4 WHEN 'collection' THEN 4 WHEN 'semantic' THEN 5 ELSE 6 END, r.priority DESC, CASE WHEN r.action = 'metadata_only' THEN 0 ELSE 1 END, r.created_at_ms DESC, r.rule_id) AS n
 FROM {sources} s, (%s) r WHERE (r.kind = 'source_always' AND r.target = CAST(s.source_id AS VARCHAR)) OR (r.kind = 'creator' AND r.target = s.creator_id) OR (r.kind = 'collection' AND r.target = s.collection_id)
 OR (r.kind = 'keyword' AND contains(lower(s.title), lower(r.target))) OR (r.kind = 'semantic' AND EXISTS (SELECT 1 FROM {labels_of} l WHERE l.source_id = s.source_id AND l.label = r.target))) WHERE n = 1"""
PASS_A = f"SELECT s.source_id, coalesce(w.action, 'process') AS action, w.rule_id, coalesce(w.kind, 'default') AS reason FROM {{sources}} s LEFT JOIN ({DECIDE % (ENABLED + " AND kind <> 'semantic'")}) w USING (source_id)"


def _rules(t):
    return t("rules").where("is_enabled").drop("is_enabled")


@case("policy_model", (f"SELECT s.source_id, coalesce(w.action, 'process') AS action, w.rule_id, coalesce(w.kind, 'default') AS reason FROM {{sources}} s LEFT JOIN ({DECIDE % ENABLED}) w USING (source_id)"))
def _(t):
    sources, labels = [t(n) for n in ("sources", "labels_of")]
    return L.decide(sources, _rules(t), labels, substrings=True)


@case("policy_pass_a_model", (PASS_A))
def _(t):
    return L.pass_a(t("sources"), _rules(t))


@case("policy_pass_b_model", (f"SELECT a.source_id, 'metadata_only' AS action, r.rule_id, 'semantic' AS reason FROM ({PASS_A}) a JOIN {{labels_of}} l USING (source_id) JOIN (SELECT rule_id, target FROM {{rules}} WHERE is_enabled AND kind = 'semantic') r ON r.target = l.label WHERE a.reason = 'default' OR (a.reason = 'keyword' AND a.action = 'process')"))
def _(t):
    sources, labels = [t(n) for n in ("sources", "labels_of")]
    return L.pass_b(sources, _rules(t), labels)


@case("rule_crud", ("SELECT rule_id, version, action, at_ms FROM {rule_versions} v WHERE version = (SELECT max(version) FROM {rule_versions} w WHERE w.rule_id = v.rule_id) AND NOT is_deleted"))
def _(t):
    return L.current_rules(t("rule_versions"))



@case("sync_missing_model", ("SELECT s.source_id, 'unavailable' AS availability, s.collection_id, FALSE AS is_present FROM {sources} s WHERE NOT EXISTS (SELECT 1 FROM {incoming} i WHERE i.source_id = s.source_id) AND s.locally_deleted_at_ms IS NULL"))
def _(t):
    sources, incoming = [t(n) for n in ("sources", "incoming")]
    return V.mark_missing(sources, incoming)


@case("snapshots_model", ("SELECT snapshot_id, source_id, fetched_at_ms FROM (SELECT *, lag(content_hash) OVER (PARTITION BY source_id ORDER BY fetched_at_ms, snapshot_id) AS p FROM {snapshots}) WHERE p IS DISTINCT FROM content_hash"))
def _(t):
    return W.changes(t("snapshots"), "source_id", ["fetched_at_ms", "snapshot_id"], "content_hash").select("snapshot_id", "source_id", "fetched_at_ms")


@case("late_snapshots_model", ("SELECT a.snapshot_id, a.source_id, a.fetched_at_ms FROM {snapshots} a WHERE EXISTS (SELECT 1 FROM {snapshots} b WHERE b.source_id = a.source_id AND b.arrival < a.arrival AND b.fetched_at_ms > a.fetched_at_ms)"))
def _(t):
    return V.late(t("snapshots"), "source_id", "arrival", "fetched_at_ms").select("snapshot_id", "source_id", "fetched_at_ms")


CURRENT = "(SELECT source_id, max(run_id) AS run_id FROM {runs} r WHERE status = 'completed' AND finished_at_ms = (SELECT max(finished_at_ms) FROM {runs} x WHERE x.source_id = r.source_id AND x.status = 'completed') GROUP BY source_id)"


@case("current_run_model", (f"SELECT source_id, run_id FROM {CURRENT}"))
def _(t):
    return V.current_runs(t("runs"))


@case("coverage_model", (f"SELECT c.source_id, bool_or(kind = 'caption') AS caption, bool_or(kind IN ('transcript', 'native_subtitle')) AS transcript, bool_or(kind = 'ocr') AS ocr, bool_or(kind IN ('keyframe', 'visual_observation')) AS vision FROM {CURRENT} c JOIN {{run_evidence}} r USING (run_id) JOIN {{evidence}} e USING (evidence_id) GROUP BY c.source_id"))
def _(t):
    runs, linked, evidence = [t(n) for n in ("runs", "run_evidence", "evidence")]
    return V.coverage(V.current_runs(runs), linked, evidence)


@case("chunk_span", ("SELECT c.chunk_id, e.evidence_id FROM {chunks} c JOIN {evidence} e ON e.source_id = c.source_id AND e.start_ms < c.end_ms AND e.end_ms >= c.start_ms AND e.start_ms <= e.end_ms"))
def _(t):
    chunks, evidence = [t(n) for n in ("chunks", "evidence")]
    return V.in_span(chunks, evidence, 60_000)


@case("bad_ranges_model", ("SELECT evidence_id FROM {evidence} WHERE end_ms < start_ms"))
def _(t):
    return t("evidence").where("end_ms < start_ms").select("evidence_id")


@case("keyframes", ("SELECT frame_id, source_id FROM (SELECT *, lag(look) OVER (PARTITION BY source_id ORDER BY at_ms, frame_id) AS p, lag(at_ms) OVER (PARTITION BY source_id ORDER BY at_ms, frame_id) AS t FROM {frames} WHERE sharpness >= 0.4) WHERE p IS DISTINCT FROM look AND (scene_change OR t IS NULL OR at_ms - t >= 1000)"))
def _(t):
    return V.keyframes(t("frames"), 0.4, 1000).select("frame_id", "source_id")


@case("asset_inventory", ("SELECT class, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (starts_with(object_key, '/') OR contains(object_key, '..')) AS bad_keys, count(*) FILTER (source_id NOT IN (SELECT source_id FROM {sources})) AS orphans FROM {assets} GROUP BY class"))
def _(t):
    assets, sources = [t(n) for n in ("assets", "sources")]
    return V.inventory(assets, sources)


@case("app_settings", ("SELECT name, value FROM {settings} a WHERE at_ms = (SELECT max(at_ms) FROM {settings} b WHERE b.name = a.name) AND NOT regexp_matches(name, 'key|token|secret|password')"))
def _(t):
    return V.settings(t("settings"))


@case("usage_model", ("SELECT stage, model, count(*) AS n, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(sum(cost) AS BIGINT) AS cost, round(avg(latency_ms), 6) AS mean_ms, max(latency_ms) AS most_ms FROM {metrics} GROUP BY stage, model"))
def _(t):
    return V.usage(t("metrics"))


@case("claim_job", ("SELECT job_id, 'w9' AS worker, CAST(1000 AS BIGINT) AS locked_at_ms, attempt FROM (SELECT *, CASE WHEN status = 'running' THEN 1 ELSE 0 END AS attempt, row_number() OVER (ORDER BY priority DESC, available_at_ms, job_id) AS n FROM {jobs} WHERE available_at_ms <= 1000 AND (status = 'queued' OR (status = 'running' AND locked_at_ms + 950 < 1000))) WHERE n <= 2"))
def _(t):
    return Q.claim(t("jobs"), "w9", 1000, 950, 2).select("job_id", "worker", "locked_at_ms", "attempt")



ALIAS = "(SELECT DISTINCT entity_id, NORM(name) AS norm FROM (SELECT entity_id, alias AS name FROM {aliases} UNION ALL SELECT entity_id, name FROM {entities}))"
CANON = "(WITH RECURSIVE c AS (SELECT entity_id AS id, entity_id AS pos, 0 AS hop FROM {entities} UNION ALL SELECT c.id, e.merged_into, hop + 1 FROM c JOIN {entities} e ON e.entity_id = c.pos WHERE e.merged_into IS NOT NULL AND hop < 20) SELECT id, max(pos) AS canonical FROM c JOIN {entities} e ON e.entity_id = c.pos WHERE e.merged_into IS NULL GROUP BY id)"
RESOLVED = f"""SELECT mention_id, CASE WHEN n_strong = 1 THEN strong WHEN n_strong IS NULL AND fuzzy IS NOT NULL THEN fuzzy END AS entity_id, CASE WHEN n_strong = 1 THEN 'auto' WHEN n_strong > 1 THEN 'disputed' WHEN fuzzy IS NOT NULL THEN 'candidate' ELSE 'provisional' END AS band, truth
 FROM (SELECT mention_id, type_hint, truth, NORM(mention_text) AS norm FROM {{mentions}}) m
 LEFT JOIN (SELECT norm, entity_type, count(DISTINCT canonical) AS n_strong, min(canonical) AS strong FROM {ALIAS} a JOIN {CANON} c ON c.id = a.entity_id JOIN {{entities}} e ON e.entity_id = c.canonical GROUP BY norm, entity_type) s ON s.norm = m.norm AND s.entity_type = m.type_hint
 LEFT JOIN (SELECT x.mention_id, min(c.canonical) AS fuzzy FROM (SELECT mention_id, type_hint, NORM(mention_text) AS norm FROM {{mentions}}) x, {ALIAS} a JOIN {CANON} c ON c.id = a.entity_id JOIN {{entities}} e ON e.entity_id = c.canonical
   WHERE e.entity_type = x.type_hint AND levenshtein(x.norm, a.norm) <= 2 GROUP BY x.mention_id) f USING (mention_id)"""


@case("mention_norm", ("SELECT mention_id, mention_text, NORM(mention_text) AS normalized_text FROM {mentions}"))
def _(t):
    return t("mentions").select("mention_id", "mention_text", X.normalize_name(F.col("mention_text")).alias("normalized_text"))


def _resolved(t):
    return V.resolve(*[t(n) for n in ("mentions", "entities", "aliases")])


@case("resolve_model", (f"SELECT mention_id, entity_id, band FROM ({RESOLVED})"))
def _(t):
    return _resolved(t).select("mention_id", "entity_id", "band")


@case("pair_f1", (f"WITH r AS (SELECT * FROM ({RESOLVED})), p AS (SELECT a.entity_id = b.entity_id AS linked, a.truth = b.truth AS alike FROM r a JOIN r b ON a.mention_id < b.mention_id), t AS (SELECT count(*) FILTER (linked AND alike) AS tp, count(*) FILTER (linked) AS said, count(*) FILTER (alike) AS wanted FROM p) SELECT tp, said - tp AS fp, wanted - tp AS fn, round(2.0 * tp / (said + wanted), 6) AS f1 FROM t"))
def _(t):
    return E.pair_f1(_resolved(t))


@case("lifecycle_model", ("SELECT entity_id, at_ms, state FROM (SELECT *, lag(state) OVER (PARTITION BY entity_id ORDER BY at_ms) AS p FROM {states}) s WHERE p IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {allowed} a WHERE a.entity_type = s.entity_type AND a.old = p AND a.new = s.state)"))
def _(t):
    states, allowed = [t(n) for n in ("states", "allowed")]
    return V.bad_lifecycle(states, allowed).select("entity_id", "at_ms", "state")


@case("update_state", ("SELECT entity_id, state, at_ms FROM (SELECT entity_id, state, at_ms FROM {states} UNION ALL SELECT entity_id, state, at_ms FROM {said}) x WHERE at_ms = (SELECT max(at_ms) FROM (SELECT entity_id, at_ms FROM {states} UNION ALL SELECT entity_id, at_ms FROM {said}) y WHERE y.entity_id = x.entity_id)"))
def _(t):
    states = t("states").select("entity_id", "state", "at_ms")
    return W.latest(V.append(states, t("said")), ["entity_id"], [F.desc("at_ms")])



PAGE_CURRENT = "(SELECT page_id, max(revision_no) AS revision_no FROM {revisions} GROUP BY page_id)"
ROUTED = r"""(SELECT source_id, page_id, step FROM (SELECT source_id, page_id, min(step) AS step, row_number() OVER (PARTITION BY source_id ORDER BY min(step), page_id) AS n FROM (
 SELECT source_id, page_id, 1 AS step FROM {claims} c JOIN {pages} p ON p.entity_id = c.entity_id UNION ALL SELECT source_id, page_id, 2 FROM {labels_of} l JOIN {pages} p ON l.label = p.domain OR l.label = p.slug
 UNION ALL SELECT source_id, page_id, 3 FROM (SELECT source_id, unnest(string_split_regex(lower(title), '[^\p{L}\p{N}]+')) AS w FROM {sources}) a JOIN (SELECT page_id, unnest(string_split_regex(lower(title || ' ' || summary), '[^\p{L}\p{N}]+')) AS w FROM {pages}) b USING (w) WHERE length(w) >= 4)
 GROUP BY source_id, page_id) WHERE n <= 3)"""


@case("wiki_support", ("SELECT st.statement_id, st.revision_id, CASE WHEN c.claim_id IS NOT NULL THEN 'claim' WHEN e.evidence_id IS NOT NULL THEN 'evidence' WHEN su.source_id IS NOT NULL THEN 'source' ELSE 'unsupported' END AS kind, coalesce(e.evidence_id, x.ev) AS evidence_id, coalesce(su.source_id, e.source_id, c.source_id) AS source_id FROM {statements} st LEFT JOIN {supports} su USING (statement_id) LEFT JOIN {claims} c ON c.claim_id = su.claim_id LEFT JOIN {evidence} e ON e.evidence_id = su.evidence_id LEFT JOIN (SELECT claim_id, min(evidence_id) AS ev FROM {claim_evidence} WHERE evidence_id IN (SELECT evidence_id FROM {evidence}) GROUP BY claim_id) x ON x.claim_id = c.claim_id"))
def _(t):
    return K.support(*[t(n) for n in ("statements", "supports", "claims", "claim_evidence", "evidence")])


LEDGER = "SELECT finding_type, page_id, count(*) FILTER (event = 'open') AS occurrence_count, count(*) FILTER (event = 'repair') AS repair_attempts, min(at_ms) FILTER (event = 'open') AS first_seen_at_ms, max(at_ms) FILTER (event = 'open') AS last_seen_at_ms, CASE max_by(event, at_ms) WHEN 'closed' THEN 'closed' WHEN 'repair' THEN 'monitoring' ELSE 'open' END AS status FROM {findings} GROUP BY finding_type, page_id"


@case("ledger_report", (LEDGER))
def _(t):
    return K.ledger(t("findings"))


@case("maint_triggers", (f"WITH c AS (SELECT 'new_sources' AS counter, count(*) AS value FROM {{sources}} WHERE source_id NOT IN (SELECT source_id FROM {{context}}) UNION ALL SELECT 'dirty_pages', count(DISTINCT p.page_id) FROM {{pages}} p JOIN {{claims}} c ON c.entity_id = p.entity_id WHERE (c.source_id, p.page_id) NOT IN (SELECT (source_id, page_id) FROM {{context}}) UNION ALL SELECT 'open_findings', count(*) FROM ({LEDGER}) WHERE status <> 'closed') SELECT counter, value, threshold, value >= threshold AS fired FROM {{thresholds}} JOIN c USING (counter)"))
def _(t):
    sources, context, pages, claims = [t(n) for n in ("sources", "context", "pages", "claims")]
    count = lambda df, name: df.agg(F.lit(name).alias("counter"), F.count("*").alias("value"))
    new = J.missing(sources, context, "source_id")
    dirty = J.missing(claims.join(pages, "entity_id").select("source_id", "page_id"), context, ["source_id", "page_id"]).select("page_id").distinct()
    open_ = K.ledger(t("findings")).where("status <> 'closed'")
    return K.triggers(count(new, "new_sources").unionByName(count(dirty, "dirty_pages")).unionByName(count(open_, "open_findings")), t("thresholds"))


@case("wiki_route", (f"SELECT * FROM {ROUTED}"))
def _(t):
    return K.route(*[t(n) for n in ("sources", "pages", "claims", "labels_of")])


def _pruned(t):
    return K.prune(K.route(*[t(n) for n in ("sources", "pages", "claims", "labels_of")]), t("pages"), 1)


PRUNED = f"(SELECT source_id, page_id, n <= 1 AS loaded, CASE WHEN n <= 1 THEN size ELSE length(summary) END AS size FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY step, page_id) AS n FROM {ROUTED}) JOIN {{pages}} USING (page_id))"


@case("wiki_prune", (f"SELECT * FROM {PRUNED}"))
def _(t):
    return _pruned(t)


@case("prune_ratio", (f"SELECT source_id, CAST(sum(size) AS BIGINT) AS after, round(1 - sum(size) / (SELECT sum(size) FROM {{pages}}), 6) AS saved FROM {PRUNED} GROUP BY source_id"))
def _(t):
    whole = t("pages").agg(F.sum("size").alias("whole"))
    return _pruned(t).groupBy("source_id").agg(F.sum("size").alias("after")).join(F.broadcast(whole)).select("source_id", "after", F.round(1 - F.col("after") / F.col("whole"), 6).alias("saved"))  # one row


@case("wiki_guard", (f"SELECT mu.mutation_id, CASE WHEN operation NOT IN ('create_page', 'update_page', 'add_link', 'remove_stale_link', 'mark_conflict', 'create_synthesis_candidate', 'no_change') THEN 'unknown_operation' WHEN operation = 'no_change' THEN 'no_change' WHEN c.claim_id IS NULL THEN 'no_claim' WHEN operation = 'create_page' THEN CASE WHEN mu.page_id IS NULL THEN 'applied' ELSE 'page_exists' END WHEN x.page_id IS NULL THEN 'unseen_page' WHEN v.revision_no IS DISTINCT FROM mu.base_revision THEN 'stale_revision' ELSE 'applied' END AS verdict FROM {{mutations}} mu LEFT JOIN {{claims}} c USING (claim_id) LEFT JOIN {{context}} x ON x.source_id = mu.source_id AND x.page_id = mu.page_id LEFT JOIN {PAGE_CURRENT} v ON v.page_id = mu.page_id"))
def _(t):
    return K.guard(*[t(n) for n in ("mutations", "context", "revisions", "claims")])


@case("wiki_index", (f"SELECT 'L0' AS level, 'pages' AS key, CAST(count(*) AS VARCHAR) AS value FROM {{pages}} UNION ALL SELECT 'L1', family, CAST(count(*) AS VARCHAR) FROM {{pages}} GROUP BY family UNION ALL SELECT 'L2', family || '/' || domain, CAST(count(*) AS VARCHAR) FROM {{pages}} GROUP BY family, domain UNION ALL SELECT 'L3', slug, concat_ws(' r', title, CAST(revision_no AS VARCHAR)) FROM {{pages}} LEFT JOIN {PAGE_CURRENT} USING (page_id) UNION ALL SELECT 'L4', p.slug, string_agg(l.to_slug, ',' ORDER BY l.to_slug) FROM {{links}} l JOIN {{pages}} p USING (page_id) WHERE l.to_slug IN (SELECT slug FROM {{pages}}) GROUP BY p.slug"))
def _(t):
    return K.page_map(*[t(n) for n in ("pages", "links", "revisions")])


@case("sufficiency", ("SELECT q.question_id, count(c.place) AS found, coalesce(bool_and(c.evidence_id IS NOT NULL) FILTER (c.place IS NOT NULL), FALSE) AS proven, coalesce(bool_or(l.achieved_level >= q.level), FALSE) AS covered, coalesce(bool_and(c.evidence_id IS NOT NULL) FILTER (c.place IS NOT NULL), FALSE) AND coalesce(bool_or(l.achieved_level >= q.level), FALSE) AS sufficient FROM {questions} q LEFT JOIN {cited} c USING (question_id) LEFT JOIN {levels} l ON l.source_id = c.source_id GROUP BY q.question_id"))
def _(t):
    questions, cited, levels = [t(n) for n in ("questions", "cited", "levels")]
    found = cited.join(questions.select("question_id", "level"), "question_id").join(levels.select("source_id", "achieved_level"), "source_id", "left")
    return K.sufficient(questions, found)


@case("autofix", ("SELECT 'slug' AS kind, page_id AS object_id, slug AS before, regexp_replace(regexp_replace(lower(slug), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS after FROM {pages} WHERE slug <> regexp_replace(regexp_replace(lower(slug), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') UNION ALL SELECT 'alias', entity_id, alias, NULL FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, NORM(alias) ORDER BY alias) AS n FROM {aliases}) WHERE n > 1"))
def _(t):
    return K.autofix(*[t(n) for n in ("pages", "aliases")])


@case("lint_links", ("SELECT 'broken_link' AS finding, l.page_id, l.to_slug AS detail FROM {links} l WHERE l.to_slug NOT IN (SELECT slug FROM {pages}) UNION ALL SELECT 'orphan', p.page_id, p.slug FROM {pages} p WHERE p.slug NOT IN (SELECT to_slug FROM {links}) UNION ALL SELECT 'bad_slug', p.page_id, p.slug FROM {pages} p WHERE NOT regexp_full_match(p.slug, '[a-z0-9]+(-[a-z0-9]+)*') UNION ALL SELECT 'no_revision', p.page_id, p.slug FROM {pages} p WHERE p.page_id NOT IN (SELECT page_id FROM {revisions})"))
def _(t):
    pages, links, revisions = [t(n) for n in ("pages", "links", "revisions")]
    row = lambda df, finding, detail: df.select(F.lit(finding).alias("finding"), "page_id", F.col(detail).alias("detail"))
    out = row(J.missing(links, pages.select(F.col("slug").alias("to_slug")), "to_slug"), "broken_link", "to_slug")
    out = out.unionByName(row(J.missing(pages, links.select(F.col("to_slug").alias("slug")), "slug"), "orphan", "slug"))
    out = out.unionByName(row(pages.where(~F.col("slug").rlike("^[a-z0-9]+(-[a-z0-9]+)*$")), "bad_slug", "slug"))
    return out.unionByName(row(J.missing(pages, revisions, "page_id"), "no_revision", "slug"))


@case("lint_support", ("SELECT st.statement_id, CASE WHEN c.claim_id IS NULL AND su.claim_id IS NOT NULL THEN 'stale_claim' WHEN c.provenance = 'model_inference' THEN 'inference_as_statement' WHEN c.claim_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {claim_evidence} ce JOIN {evidence} e USING (evidence_id) WHERE ce.claim_id = c.claim_id) THEN 'claim_without_evidence' ELSE 'unsupported' END AS finding FROM {statements} st LEFT JOIN {supports} su USING (statement_id) LEFT JOIN {claims} c ON c.claim_id = su.claim_id WHERE (su.claim_id IS NOT NULL AND (c.claim_id IS NULL OR c.provenance = 'model_inference' OR NOT EXISTS (SELECT 1 FROM {claim_evidence} ce JOIN {evidence} e USING (evidence_id) WHERE ce.claim_id = c.claim_id))) OR (su.claim_id IS NULL AND su.source_id IS NULL AND (su.evidence_id IS NULL OR su.evidence_id NOT IN (SELECT evidence_id FROM {evidence})))"))
def _(t):
    return V.lint_support(*[t(n) for n in ("statements", "supports", "claims", "claim_evidence", "evidence")])


@case("md_export", (f"SELECT page_id, concat('---', chr(10), 'id: ', page_id, chr(10), 'family: ', family, chr(10), 'revision: ', coalesce(CAST(revision_no AS VARCHAR), '0'), chr(10), '---', chr(10), '# ', title, chr(10), coalesce(body, '')) AS markdown FROM {{pages}} LEFT JOIN {PAGE_CURRENT} USING (page_id) LEFT JOIN (SELECT r.page_id, string_agg('- ' || st.text, chr(10) ORDER BY st.statement_id, st.text) AS body FROM {{statements}} st JOIN {{revisions}} r USING (revision_id) JOIN {PAGE_CURRENT} c ON c.page_id = r.page_id AND c.revision_no = r.revision_no GROUP BY r.page_id) USING (page_id)"))
def _(t):
    return V.markdown(*[t(n) for n in ("pages", "revisions", "statements")])



@case("citations_model", ("SELECT question_id, source_id, tier, evidence_id FROM (SELECT c.question_id, c.source_id, e.evidence_id, CASE WHEN e.evidence_id IS NOT NULL AND e.start_ms IS NOT NULL THEN 1 WHEN e.evidence_id IS NOT NULL THEN 2 ELSE 3 END AS tier, row_number() OVER (PARTITION BY c.question_id, c.source_id ORDER BY CASE WHEN e.evidence_id IS NOT NULL AND e.start_ms IS NOT NULL THEN 1 WHEN e.evidence_id IS NOT NULL THEN 2 ELSE 3 END, c.place) AS n FROM {cited} c LEFT JOIN {evidence} e ON e.evidence_id = c.evidence_id AND e.source_id = c.source_id) WHERE n = 1"))
def _(t):
    return A.citations(*[t(n) for n in ("cited", "evidence")])


REASONS = """(SELECT question_id, CASE WHEN max(ok) = 1 THEN 'found' WHEN max(skip) = 1 THEN 'skipped' WHEN max(shallow) = 1 THEN 'shallow' WHEN count(sid) > 0 THEN 'too_narrow' ELSE 'absent' END AS reason FROM (SELECT q.question_id, s.source_id AS sid,
 CASE WHEN s.collection_id = q.collection_id AND coalesce(l.action, 'process') <> 'metadata_only' AND coalesce(l.achieved_level, 0) >= q.level THEN 1 ELSE 0 END AS ok, CASE WHEN s.collection_id = q.collection_id AND l.action = 'metadata_only' THEN 1 ELSE 0 END AS skip,
 CASE WHEN s.collection_id = q.collection_id AND coalesce(l.action, 'process') <> 'metadata_only' AND coalesce(l.achieved_level, 0) < q.level THEN 1 ELSE 0 END AS shallow
 FROM {questions} q LEFT JOIN {sources} s ON contains(lower(s.title), lower(q.term)) AND s.locally_deleted_at_ms IS NULL LEFT JOIN {levels} l ON l.source_id = s.source_id) GROUP BY question_id)"""


@case("no_result_model", (f"SELECT * FROM {REASONS}"))
def _(t):
    return A.diagnose(*[t(n) for n in ("questions", "sources", "levels")])


@case("answer_extractive", ("SELECT question_id, string_agg(e.text || ' [' || c.source_id || CASE WHEN e.start_ms IS NOT NULL THEN '@' || e.start_ms ELSE '' END || ']', '; ' ORDER BY c.place) AS answer FROM {cited} c JOIN {evidence} e ON e.evidence_id = c.evidence_id AND e.source_id = c.source_id WHERE e.text IS NOT NULL GROUP BY question_id"))
def _(t):
    return A.extractive(*[t(n) for n in ("cited", "evidence")])


@case("recall_model", ("SELECT x.question_id, round(count(a.place) / count(*), 6) AS recall FROM {expected} x LEFT JOIN {answers} a ON a.question_id = x.question_id AND a.source_id = x.source_id AND a.place <= 2 GROUP BY x.question_id"))
def _(t):
    return E.recall_at_k(*[t(n) for n in ("expected", "answers")], 2)


@case("citation_rate", ("SELECT c.question_id, count(*) AS n, round(count(e.evidence_id) / count(*), 6) AS rate FROM {cited} c LEFT JOIN {evidence} e ON e.evidence_id = c.evidence_id AND e.source_id = c.source_id GROUP BY c.question_id"))
def _(t):
    return E.citation_rate(*[t(n) for n in ("cited", "evidence")])


@case("no_result_rate", (f"SELECT CASE WHEN reason = 'found' AND w THEN 'true_result' WHEN reason = 'found' THEN 'false_result' WHEN w THEN 'false_no_result' ELSE 'true_no_result' END AS outcome, count(*) AS n FROM (SELECT question_id, reason, question_id IN (SELECT question_id FROM {{expected}}) AS w FROM {REASONS}) GROUP BY 1"))
def _(t):
    questions, expected = [t(n) for n in ("questions", "expected")]
    return E.no_result_rate(questions, expected, A.diagnose(*[t(n) for n in ("questions", "sources", "levels")]))



@case("markdown_links", "SELECT id, array_to_string(regexp_extract_all(body, '\\[\\[([^\\]|]+)', 1), ',') AS links FROM {bodies}")
def _(t):
    return t("bodies").select("id", F.array_join(X.wiki_links(F.col("body")), ",").alias("links"))


def filled(text: str, tables: dict[str, str]) -> str:
    """SQL with each {name} as the table's subquery, and NORM(x) as a normalised name."""
    for name, sql in tables.items():
        text = text.replace("{" + name + "}", f"({sql})")
    return re.sub(r"NORM\((\w+)\)", lambda x: rf"trim(regexp_replace(lower(translate({x[1]}, '{WIDE}', '{NARROW}')), '\s+', ' ', 'g'))", text)
