"""Wiki pages: routing, pruning, guarded mutation, support, ledger, triggers, sufficiency, fixes and the page map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import joins as J
from . import windows as W

OPERATIONS = ["create_page", "update_page", "add_link", "remove_stale_link", "mark_conflict", "create_synthesis_candidate", "no_change"]


def current(revisions: DataFrame) -> DataFrame:
    """The revision of largest number of each page."""
    return W.latest(revisions, ["page_id"], [F.desc("revision_no"), F.desc("revision_id")])


def support(statements: DataFrame, supports: DataFrame, claims: DataFrame, claim_evidence: DataFrame, evidence: DataFrame) -> DataFrame:
    """statement_id, kind, evidence_id, source_id: what each statement rests on, of three optional targets. A target that
    does not exist is none."""
    real = evidence.select("evidence_id", F.col("evidence_id").alias("e"), F.col("source_id").alias("e_source"))
    first = claim_evidence.join(real, "evidence_id", "left_semi").groupBy("claim_id").agg(F.min("evidence_id").alias("c_evidence"))
    of_claims = claims.select("claim_id", F.col("source_id").alias("c_source")).join(first, "claim_id", "left")
    out = J.optional(J.optional(statements.join(supports, "statement_id", "left"), of_claims, "claim_id", "statement_id"), real, "evidence_id", "statement_id")
    kind = F.when(F.col("c_source").isNotNull(), "claim").when(F.col("e").isNotNull(), "evidence").when(F.col("source_id").isNotNull(), "source").otherwise("unsupported")
    return out.select("statement_id", "revision_id", kind.alias("kind"), F.coalesce("e", "c_evidence").alias("evidence_id"), F.coalesce("source_id", "e_source", "c_source").alias("source_id"))


def ledger(events: DataFrame) -> DataFrame:
    """Each finding's occurrences, repairs, first and last time and status; a repair leaves it monitored, not closed."""
    is_open = F.col("event") == "open"
    last = F.max_by("event", "at_ms")
    return events.groupBy("finding_type", "page_id").agg(
        F.count_if(is_open).alias("occurrence_count"), F.count_if(F.col("event") == "repair").alias("repair_attempts"), F.min(F.when(is_open, F.col("at_ms"))).alias("first_seen_at_ms"),
        F.max(F.when(is_open, F.col("at_ms"))).alias("last_seen_at_ms"), F.when(last == "closed", "closed").when(last == "repair", "monitoring").otherwise("open").alias("status"),
    )


def triggers(counters: DataFrame, thresholds: DataFrame) -> DataFrame:
    """counter, value, threshold, fired: thresholds are a table of configuration."""
    return thresholds.join(counters, "counter", "left").select("counter", F.coalesce("value", F.lit(0)).cast("long").alias("value"), "threshold", (F.coalesce("value", F.lit(0)) >= F.col("threshold")).alias("fired"))


def terms(column: Column, least: int = 4) -> Column:
    return F.filter(X.tokens(column), lambda w: F.length(w) >= least)


def route(sources: DataFrame, pages: DataFrame, claims: DataFrame, labels: DataFrame, semantic: DataFrame | None = None, model: DataFrame | None = None, k: int = 3) -> DataFrame:
    """source_id, page_id, step: candidate pages in five steps, the surest first, at most k of a source. Steps four and
    five are tables (source_id, page_id) of a provider, which may be absent.

    Of an entity, a topic or a word only the first k pages by id are joined, so that a frequent one costs k rows a source.
    That loses none: a page after k others of its key is behind all of them, which an earlier step can only move up."""
    first = lambda df, key: W.cap(df.where(F.col(key).isNotNull()).select(key, "page_id").distinct(), [key], [F.col("page_id")], k)
    exact = claims.select("source_id", "entity_id").join(first(pages, "entity_id"), "entity_id").select("source_id", "page_id", F.lit(1).alias("step"))
    topics = first(pages.select("page_id", F.explode(F.array("domain", "slug")).alias("topic")), "topic")
    topic = labels.select("source_id", F.col("label").alias("topic")).join(topics, "topic")
    words = first(pages.select("page_id", F.explode(F.array_distinct(terms(F.concat_ws(" ", "title", "summary")))).alias("word")), "word")
    found = sources.select("source_id", F.explode(F.array_distinct(terms(F.col("title")))).alias("word")).join(words, "word")
    every = exact.unionByName(topic.select("source_id", "page_id", F.lit(2).alias("step"))).unionByName(found.select("source_id", "page_id", F.lit(3).alias("step")))
    for step, given in ((4, semantic), (5, model)):
        if given is not None:
            every = every.unionByName(given.select("source_id", "page_id", F.lit(step).alias("step")))
    best = every.groupBy("source_id", "page_id").agg(F.min("step").alias("step"))
    return W.cap(best, ["source_id"], [F.col("step"), F.col("page_id")], k)


def prune(routed: DataFrame, pages: DataFrame, bodies: int) -> DataFrame:
    """source_id, page_id, loaded, size: all pages of the domains of a source's candidates (L1), of these the candidates
    (L2) by their summaries, and the bodies of the first few only (L3)."""
    of = pages.select("page_id", F.length("summary").alias("brief"), F.col("size").alias("whole"))
    first = W.ranked(routed, ["source_id"], [F.col("step"), F.col("page_id")], "place")
    return first.join(of, "page_id").select("source_id", "page_id", (F.col("place") <= bodies).alias("loaded"), F.when(F.col("place") <= bodies, F.col("whole")).otherwise(F.col("brief")).cast("long").alias("size"))


def guard(mutations: DataFrame, context: DataFrame, revisions: DataFrame, claims: DataFrame) -> DataFrame:
    """mutation_id, verdict: applied, or why a proposal is rejected. Only pages that the proposer has seen may change, on
    their current revision, and each change names a claim that exists."""
    seen = context.select("source_id", "page_id", F.lit(True).alias("seen"))
    now = current(revisions).select("page_id", F.col("revision_no").alias("now"))
    real = claims.select("claim_id", F.lit(True).alias("justified"))
    m = mutations.join(seen, ["source_id", "page_id"], "left").join(now, "page_id", "left").join(real, "claim_id", "left")
    verdict = (
        F.when(~F.col("operation").isin(OPERATIONS), "unknown_operation").when(F.col("operation") == "no_change", "no_change")
        .when(F.col("justified").isNull(), "no_claim").when(F.col("operation") == "create_page", F.when(F.col("page_id").isNull(), "applied").otherwise("page_exists"))
        .when(F.col("seen").isNull(), "unseen_page").when(~F.col("now").eqNullSafe(F.col("base_revision")), "stale_revision").otherwise("applied")
    )
    return m.select("mutation_id", verdict.alias("verdict"))


def sufficient(questions: DataFrame, found: DataFrame) -> DataFrame:
    """question_id, found, proven, covered, sufficient: whether reading may stop. found: question_id, evidence_id (null
    without provenance), level, wanted level of the source."""
    of = found.groupBy("question_id").agg(F.count("*").alias("n"), F.bool_and(F.col("evidence_id").isNotNull()).alias("proven"), F.bool_or(F.col("achieved_level") >= F.col("level")).alias("covered"))
    out = questions.select("question_id").join(of, "question_id", "left")
    known = lambda c: F.coalesce(c, F.lit(False))
    return out.select("question_id", F.coalesce("n", F.lit(0)).alias("found"), known("proven").alias("proven"), known("covered").alias("covered"), (known("proven") & known("covered")).alias("sufficient"))


def autofix(pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """kind, object_id, before, after: what code may mend by itself, as rows for the ledger; only rows that change."""
    slug = X.slugify(F.col("slug"))
    slugs = pages.where(slug != F.col("slug")).select(F.lit("slug").alias("kind"), F.col("page_id").alias("object_id"), F.col("slug").alias("before"), slug.alias("after"))
    norm = X.normalize_name(F.col("alias"))
    ranked = W.ranked(aliases.withColumn("norm", norm), ["entity_id", "norm"], [F.col("alias")], "n")
    repeated = ranked.where("n > 1").select(F.lit("alias").alias("kind"), F.col("entity_id").alias("object_id"), F.col("alias").alias("before"), F.lit(None).cast("string").alias("after"))
    return slugs.unionByName(repeated)


def page_map(pages: DataFrame, links: DataFrame, revisions: DataFrame) -> DataFrame:
    """level, key, value: L0 counts all pages, L1 those of a family, L2 of a domain in it, L3 gives each page's title and
    current revision, L4 its links that lead to a page."""
    rows = lambda df, level, key, value: df.select(F.lit(level).alias("level"), key.alias("key"), value.cast("string").alias("value"))
    k, v = F.col("key"), F.col("value")
    out = rows(pages.agg(F.count("*").alias("value")), "L0", F.lit("pages"), v)
    out = out.unionByName(rows(pages.groupBy(F.col("family").alias("key")).agg(F.count("*").alias("value")), "L1", k, v))
    out = out.unionByName(rows(pages.groupBy(F.concat_ws("/", "family", "domain").alias("key")).agg(F.count("*").alias("value")), "L2", k, v))
    titled = pages.join(current(revisions).select("page_id", "revision_no"), "page_id", "left")
    out = out.unionByName(rows(titled, "L3", F.col("slug"), F.concat_ws(" r", "title", "revision_no")))
    kept = links.join(pages.select(F.col("slug").alias("to_slug")), "to_slug", "left_semi").join(pages.select("page_id", "slug"), "page_id")
    return out.unionByName(rows(kept.groupBy("slug").agg(F.array_join(F.array_sort(F.collect_set("to_slug")), ",").alias("value")), "L4", F.col("slug"), v))
