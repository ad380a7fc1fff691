"""Sources, runs, evidence, entities and cards over the model's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import joins as J
from . import windows as W
from .nearest import nearest as near_strings
from .wiki import current


def mark_missing(sources: DataFrame, incoming: DataFrame) -> DataFrame:
    """What the next version of the sources and memberships says of those that are gone upstream; no row is deleted."""
    gone = sources.where("locally_deleted_at_ms is null").join(incoming.select("source_id"), "source_id", "left_anti")
    return gone.select("source_id", F.lit("unavailable").alias("availability"), "collection_id", F.lit(False).alias("is_present"))


def late(snapshots: DataFrame, key: str, arrival: str, at: str) -> DataFrame:
    """Rows that arrive after one of a later time."""
    before = Window.partitionBy(key).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    return snapshots.withColumn("_m", F.max(at).over(before)).where(F.col("_m") > F.col(at)).drop("_m")


def current_runs(runs: DataFrame) -> DataFrame:
    """source_id, run_id: the completed run that ended last, of those that ended together the one of largest id."""
    return W.latest(runs.where("status = 'completed'"), ["source_id"], [F.desc("finished_at_ms"), F.desc("run_id")]).select("source_id", "run_id")


#: Kinds of evidence of each modality.
MODALITIES = {"caption": ["caption"], "transcript": ["transcript", "native_subtitle"], "ocr": ["ocr"], "vision": ["keyframe", "visual_observation"]}


def coverage(runs: DataFrame, linked: DataFrame, evidence: DataFrame) -> DataFrame:
    """source_id and a boolean for each modality of the evidence that the source's current run used."""
    used = runs.join(linked, "run_id").join(evidence.select("evidence_id", "kind"), "evidence_id")
    return used.groupBy("source_id").agg(*[F.bool_or(F.col("kind").isin(k)).alias(n) for n, k in MODALITIES.items()])


def in_span(chunks: DataFrame, evidence: DataFrame, width: int) -> DataFrame:
    """chunk_id, evidence_id of evidence whose time meets the chunk's, which ends before its end. Bad ranges meet none."""
    spans = evidence.where("start_ms <= end_ms").select("source_id", "evidence_id", F.col("start_ms").alias("rs"), F.col("end_ms").alias("re"))
    return J.overlapping(chunks.select("source_id", "chunk_id", F.col("start_ms").alias("ls"), (F.col("end_ms") - 1).alias("le")), spans, ["source_id"], width).select("chunk_id", "evidence_id")


def keyframes(frames: DataFrame, sharp: float, gap_ms: int) -> DataFrame:
    """Sharp frames that begin a scene or come a gap after the one before, without those that look like it."""
    w = Window.partitionBy("source_id").orderBy("at_ms", "frame_id")
    near = frames.where(F.col("sharpness") >= sharp).withColumn("_l", F.lag("look").over(w)).withColumn("_t", F.lag("at_ms").over(w))
    return near.where(~F.col("_l").eqNullSafe(F.col("look")) & (F.col("scene_change") | F.col("_t").isNull() | (F.col("at_ms") - F.col("_t") >= gap_ms))).drop("_l", "_t")


def inventory(assets: DataFrame, sources: DataFrame) -> DataFrame:
    """Of each class of asset its number, bytes, keys that are not relative, and assets of no source."""
    known = assets.join(sources.select("source_id", F.lit(1).alias("_s")), "source_id", "left")
    bad = F.col("object_key").startswith("/") | F.col("object_key").contains("..")
    return known.groupBy("class").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.count_if(bad).alias("bad_keys"), F.count_if(F.col("_s").isNull()).alias("orphans"))


def settings(rows: DataFrame) -> DataFrame:
    """The last value of each setting; names that sound like secrets are never given out."""
    return W.latest(rows.where(~F.col("name").rlike("key|token|secret|password")), ["name"], [F.desc("at_ms")]).select("name", "value")


def usage(metrics: DataFrame) -> DataFrame:
    add = lambda c: F.sum(c).alias(c)
    return metrics.groupBy("stage", "model").agg(F.count("*").alias("n"), add("tokens_in"), add("tokens_out"), add("cost"), F.round(F.avg("latency_ms"), 6).alias("mean_ms"), F.max("latency_ms").alias("most_ms"))


def append(rows: DataFrame, new: DataFrame) -> DataFrame:
    """History with new rows; nothing is overwritten, the latest row is the state."""
    return rows.unionByName(new)


def bad_lifecycle(states: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows whose state may not follow the one before, by the entity's type."""
    moved = states.withColumn("old", F.lag("state").over(Window.partitionBy("entity_id").orderBy("at_ms"))).where("old is not null")
    return moved.join(allowed.withColumnRenamed("new", "state"), ["entity_type", "old", "state"], "left_anti")


def resolve(mentions: DataFrame, entities: DataFrame, aliases: DataFrame, distance: int = 2) -> DataFrame:
    """mention_id, entity_id, band, truth. An equal name or alias of one entity of the hinted type links; of several it is
    disputed; a name within a small distance is a candidate at most. Merged entities stand for the end of their chain.
    Of like names of the hinted type the least entity is kept (nearest.py), so pairs of like names are no rows, and only
    those of mentions without an equal name are looked for."""
    ends = J.merge_closure(entities.where("merged_into is not null").select(F.col("entity_id").alias("id"), "merged_into")).select(F.col("id").alias("entity_id"), "canonical", F.lit(True).alias("merged"))
    names = aliases.select("entity_id", F.col("alias").alias("name")).unionByName(entities.select("entity_id", "name"))
    names = names.select("entity_id", X.normalize_name(F.col("name")).alias("norm")).distinct()
    names = names.join(ends, "entity_id", "left").withColumn("canonical", F.when(F.col("merged"), F.col("canonical")).otherwise(F.col("entity_id"))).where("canonical is not null")
    known = names.select("norm", "canonical").distinct().join(entities.select(F.col("entity_id").alias("canonical"), F.col("entity_type").alias("type_hint")), "canonical")
    asked = mentions.select("mention_id", "type_hint", "truth", X.normalize_name(F.col("mention_text")).alias("norm"))
    strong = known.groupBy("norm", "type_hint").agg(F.count_distinct("canonical").alias("n_strong"), F.min("canonical").alias("strong"))
    # a name that links or is disputed needs no likeness
    open_ = asked.join(strong, ["norm", "type_hint"], "left_anti")
    fuzzy = near_strings(open_.select(F.col("type_hint").alias("key"), F.col("norm").alias("name")), known.select(F.col("type_hint").alias("key"), F.col("norm").alias("name"), F.col("canonical").alias("value")), distance)
    fuzzy = fuzzy.select(F.col("key").alias("type_hint"), F.col("name").alias("norm"), F.col("value").alias("fuzzy"))
    out = asked.join(strong, ["norm", "type_hint"], "left").join(fuzzy, ["norm", "type_hint"], "left")
    entity = F.when(F.col("n_strong") == 1, F.col("strong")).when(F.col("n_strong").isNull(), F.col("fuzzy"))
    band = F.when(F.col("n_strong") == 1, "auto").when(F.col("n_strong") > 1, "disputed").when(F.col("fuzzy").isNotNull(), "candidate").otherwise("provisional")
    return out.select("mention_id", entity.alias("entity_id"), band.alias("band"), "truth")


def lint_support(statements: DataFrame, supports: DataFrame, claims: DataFrame, claim_evidence: DataFrame, evidence: DataFrame) -> DataFrame:
    """statement_id, finding: statements that nothing supports, and claims that are gone, inferred or without evidence."""
    real = evidence.select("evidence_id", F.lit(True).alias("e"))
    proven = claim_evidence.join(real, "evidence_id").select("claim_id", F.lit(True).alias("proven")).distinct()
    known = claims.select("claim_id", "provenance", F.lit(True).alias("c")).join(proven, "claim_id", "left")
    all_ = J.optional(J.optional(statements.select("statement_id").join(supports, "statement_id", "left"), known, "claim_id", "statement_id"), real, "evidence_id", "statement_id")
    claimed = F.col("claim_id").isNotNull()
    finding = (
        F.when(claimed & F.col("c").isNull(), "stale_claim").when(claimed & (F.col("provenance") == "model_inference"), "inference_as_statement").when(claimed & F.col("proven").isNull(), "claim_without_evidence")
        .when(~claimed & F.col("source_id").isNull() & F.col("e").isNull(), "unsupported")
    )
    return all_.select("statement_id", finding.alias("finding")).where("finding is not null")


def markdown(pages: DataFrame, revisions: DataFrame, statements: DataFrame) -> DataFrame:
    """page_id, markdown: front matter with ids, the title, the current revision's statements."""
    now = current(revisions).select("page_id", "revision_no", "revision_id")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("statement_id", "text"))), lambda x: F.concat(F.lit("- "), x["text"]))
    body = statements.join(now.select("revision_id", "page_id"), "revision_id").groupBy("page_id").agg(F.array_join(lines, "\n").alias("body"))
    whole = pages.join(now.drop("revision_id"), "page_id", "left").join(body, "page_id", "left")
    number = F.coalesce(F.col("revision_no").cast("string"), F.lit("0"))
    head = F.concat(F.lit("---\nid: "), F.col("page_id").cast("string"), F.lit("\nfamily: "), F.col("family"), F.lit("\nrevision: "), number, F.lit("\n---\n# "), F.col("title"), F.lit("\n"))
    return whole.select("page_id", F.concat(head, F.coalesce("body", F.lit(""))).alias("markdown"))


def extract(evidence: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """source_id, ordinal, predicate, value_text, provenance_type: a claim with its evidence for each match of a pattern;
    what is not written is not claimed."""
    def claimed(name: str, pattern: str):
        return F.transform(F.regexp_extract_all("raw_text", F.lit(pattern), 0), lambda v: F.struct(F.lit(name).alias("predicate"), v.alias("value_text")))

    found = [claimed(n, p) for n, p in patterns.items()]
    every = reduce(lambda a, b: F.concat(a, b), found)
    out = evidence.select("source_id", "ordinal", F.explode(every).alias("x")).select("source_id", "ordinal", "x.predicate", "x.value_text")
    return out.withColumn("provenance_type", F.lit("explicit_source_statement"))


def resurface(saves: DataFrame, days: int, usual_days: int, unfinished: list[str]) -> DataFrame:
    """card, subject, reason: topics of more than their usual share of the last days, and what users left unfinished."""
    now = saves.agg(F.max("ts").alias("now"))
    recent = F.count_if(F.col("ts") > F.col("now") - F.expr(f"INTERVAL {days} DAYS"))
    topics = saves.join(F.broadcast(now)).groupBy("state").agg(recent.alias("recent"), F.count("*").alias("n")).where(F.col("recent") * usual_days >= F.col("n") * days)  # one row
    topics = topics.select(F.lit("topic").alias("card"), F.col("state").alias("subject"), F.concat(F.lit("seen "), F.col("recent").cast("string"), F.lit(f" times in {days} days")).alias("reason"))
    last = saves.groupBy("user_id").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state")).where(F.col("state").isin(unfinished))
    return topics.unionByName(last.select(F.lit("unfinished").alias("card"), F.col("user_id").cast("string").alias("subject"), F.concat(F.lit("last state is "), F.col("state")).alias("reason")))
