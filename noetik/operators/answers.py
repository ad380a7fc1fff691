"""Questions: scope, intents, the structured request, the plan's shape, citations, diagnosis and extractive answers."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import windows as W

#: Wordings of the four intents and of the scopes.
INTENTS = {
    "find": "find|search|show me|which .* saved|did i save|找一下|收藏过哪些|存过",
    "answer": "how long|what |when |how much|多久|什么|多少",
    "synthesize": "compare|in common|trends|which .* best|综合|共同|哪些.*最",
    "act": "plan|schedule|itinerary|make me|计划|行程|排一个",
}
PERSONAL = "my saved|i saved|my collection|did i save|我收藏的|我之前存过|我的收藏|我之前收藏|我收藏过|我是不是存过"
GENERAL = "in general|generally|not my collection|一般来说|不看我的收藏"
HYBRID = "(my collection|我.*收藏).*(your knowledge|general knowledge|你的知识|你的通用知识)"


def intents(text: Column) -> Column:
    """The intents of a question, sorted and comma-joined; a question of none is one to answer."""
    low = F.lower(text)
    some = F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(n)) for n, p in INTENTS.items()]))), ",")
    return F.when(some == "", "answer").otherwise(some)


def scope(text: Column) -> Column:
    """hybrid, general, personal_required, or personal_first where the question says nothing."""
    low = F.lower(text)
    return F.when(low.rlike(HYBRID), "hybrid").when(low.rlike(GENERAL), "general").when(low.rlike(PERSONAL), "personal_required").otherwise("personal_first")


@dataclass
class Request:
    """A parsed question; what is not said stays empty."""

    intents: list[str]
    scope: str
    entity_types: list[str] = field(default_factory=list)
    constraints: dict[str, object] = field(default_factory=dict)
    user_state: dict[str, bool] = field(default_factory=dict)
    semantic: list[str] = field(default_factory=list)
    sort: list[str] = field(default_factory=lambda: ["relevance"])
    reference: int | None = None  # the n-th result of the turn before


ENTITY_TYPES = {"restaurant": "restaurant|餐厅|日料", "place": "place|route|hike|trail|路线|地点", "tool": "tool|app|工具", "concept": "concept|what is|是什么"}
ORDINALS = {"first": 1, "second": 2, "third": 3, "第一": 1, "第二": 2, "第三": 3}
SEMANTIC = {"cheap": "cheap|便宜", "suitable_for_date": "for a date|约会", "beginner": "beginner|新手"}


def parse(text: str, cities: tuple[str, ...] = ()) -> Request:
    """A question as a request. cities: the known names of places."""
    low = text.lower()
    found = [n for n, p in INTENTS.items() if re.search(p, low)] or ["answer"]
    where = "hybrid" if re.search(HYBRID, low) else "general" if re.search(GENERAL, low) else "personal_required" if re.search(PERSONAL, low) else "personal_first"
    out = Request(found, where, [n for n, p in ENTITY_TYPES.items() if re.search(p, low)])
    for city in cities:
        if city.lower() in low:
            out.constraints["city"] = city
    if m := re.search(r"(?:under|below|less than|at most|不超过)\s*(?:hkd|usd|\$)?\s*(\d+)", low):
        out.constraints["price_max"] = int(m[1])
    if m := re.search(r"last (\d+) days", low):
        out.constraints["saved_within_days"] = int(m[1])
    if re.search("not (?:yet )?(?:visited|been)|unvisited|没去过", low):
        out.user_state["visited"] = False
    out.semantic = [n for n, p in SEMANTIC.items() if re.search(p, low)]
    if re.search("newest|latest|most recent|最近", low):
        out.sort = ["saved_at_desc"]
    out.reference = next((n for w, n in ORDINALS.items() if re.search(rf"(?:\b|(?<=[^a-z])){w}", low)), None)
    return out


def shape(request: Request) -> str:
    """Which plan a request asks for: none of the collection, follow_up, structured, semantic or mixed."""
    if request.scope == "general":
        return "general"
    if request.reference is not None:
        return "follow_up"
    exact = bool(request.constraints or request.user_state)
    if "synthesize" in request.intents:
        return "mixed"
    return "mixed" if exact and request.semantic else "structured" if exact else "semantic"


def _any(patterns) -> str:
    return "|".join(patterns)


NEWEST, UNSEEN = "newest|latest|most recent|最近", "not (?:yet )?(?:visited|been)|unvisited|没去过"
BOUND, WITHIN = r"(?:under|below|less than|at most|不超过)\s*(?:hkd|usd|\$)?\s*\d+", r"last \d+ days"
ORDINAL = r"(?:\b|[^a-z])(" + _any(ORDINALS) + ")"


def shapes(text: Column) -> Column:
    """shape(parse(text)) of questions that name no place, as an expression."""
    low = F.lower(F.coalesce(text, F.lit("")))
    general = ~low.rlike(HYBRID) & low.rlike(GENERAL)
    exact = low.rlike(BOUND) | low.rlike(WITHIN) | low.rlike(UNSEEN)
    mixed = F.when(exact & low.rlike(_any(SEMANTIC.values())), "mixed").when(exact, "structured").otherwise("semantic")
    return F.when(general, "general").when(low.rlike(ORDINAL), "follow_up").when(low.rlike(INTENTS["synthesize"]), "mixed").otherwise(mixed)


def ordinal(text: Column) -> Column:
    """The number of the result that a question refers to, null for none; the first of ORDINALS that it holds."""
    low, out = F.lower(text), F.lit(None).cast("int")
    for word, n in reversed(ORDINALS.items()):
        out = F.when(low.rlike(rf"(?:\b|[^a-z]){word}"), n).otherwise(out)
    return out


def planned(questions: DataFrame, index, vectors: DataFrame, facts: DataFrame, k: int = 10) -> DataFrame:
    """qid, plan, doc, place: each question answered by the plan of its shape. questions: qid, conv, turn, text; facts: doc,
    depth, saved_at; vectors: doc, vector.

    semantic: the first k by the text index. structured: of 4 k candidates those of depth 2, newest first. mixed: of the
    2 k first five by marginal relevance. follow_up: the result that it names of the last earlier question of the
    conversation that is none itself; nothing where there is none. general: nothing of the collection."""
    from . import diversity

    q = cut(questions.withColumn("plan", shapes(F.col("text"))))
    of = lambda *plans: q.where(F.col("plan").isin(*plans)).select("qid", "text")
    top = lambda df, n: index.top(df, n)
    plain = top(of("semantic"), k).select("qid", "doc", F.col("rank").alias("place"))
    deep = top(of("structured"), 4 * k).join(facts.where("depth = 2"), "doc")
    deep = W.ranked(deep, ["qid"], [F.desc("saved_at"), F.col("doc")], "place").where(F.col("place") <= k).select("qid", "doc", "place")
    varied = diversity.diversify(top(of("mixed"), 2 * k), vectors, 5)
    found = cut(plain.unionByName(deep).unionByName(varied))
    asked = q.where("plan = 'follow_up'").select("qid", "conv", "turn", ordinal(F.col("text")).alias("n"))
    before = q.where("plan not in ('follow_up', 'general')").select("conv", F.col("turn").alias("t"), F.col("qid").alias("of"))
    last = W.latest(asked.join(before, "conv").where("t < turn"), ["qid"], [F.desc("t")])  # both sides are a conversation's turns
    named = last.join(found.withColumnRenamed("qid", "of"), "of").where("place = n").select("qid", "doc", F.lit(1).alias("place"))
    return found.unionByName(named).join(q.select("qid", "plan"), "qid").select("qid", "plan", "doc", F.col("place").cast("int").alias("place"))


def tier(evidence_id: Column, start_ms: Column) -> Column:
    """1: evidence with its time, 2: evidence, 3: the source only."""
    return F.when(evidence_id.isNotNull() & start_ms.isNotNull(), 1).when(evidence_id.isNotNull(), 2).otherwise(3)


def citations(cited: DataFrame, evidence: DataFrame) -> DataFrame:
    """question_id, source_id, tier, evidence_id: the most precise citation of each source in an answer. Evidence that
    does not exist, or is another source's, does not count."""
    real = evidence.select(F.col("evidence_id").alias("e"), F.col("source_id").alias("of"), "start_ms")
    met = cited.join(real, (F.col("evidence_id") == F.col("e")) & (F.col("source_id") == F.col("of")), "left").withColumn("tier", tier(F.col("e"), F.col("start_ms")))
    return W.latest(met, ["question_id", "source_id"], [F.col("tier"), F.col("place")]).select("question_id", "source_id", "tier", F.col("e").alias("evidence_id"))


def diagnose(questions: DataFrame, sources: DataFrame, levels: DataFrame) -> DataFrame:
    """question_id, reason: found, or the first true of skipped, shallow, too_narrow, else absent. A source matches by
    its title; constraints are the collection and the level."""
    s = sources.where("locally_deleted_at_ms is null").join(levels, "source_id", "left")
    q = questions.select("question_id", F.lower("term").alias("term"), F.col("collection_id").alias("wanted"), "level")
    met = s.join(F.broadcast(q), F.lower("title").contains(F.col("term")), "inner")  # a substring has no key; questions are a request's few
    inside, skip, deep = F.col("collection_id") == F.col("wanted"), F.coalesce("action", F.lit("process")) == "metadata_only", F.coalesce("achieved_level", F.lit(0)) >= F.col("level")
    of = met.groupBy("question_id").agg(F.bool_or(inside & ~skip & deep).alias("ok"), F.bool_or(inside & skip).alias("skip"), F.bool_or(inside & ~skip & ~deep).alias("shallow"), F.count("*").alias("n"))
    reason = F.when(F.col("ok"), "found").when(F.col("skip"), "skipped").when(F.col("shallow"), "shallow").when(F.col("n") > 0, "too_narrow").otherwise("absent")
    return q.join(of, "question_id", "left").select("question_id", reason.alias("reason"))


def extractive(cited: DataFrame, evidence: DataFrame) -> DataFrame:
    """question_id, answer: the cited evidence in order, each line with its source and time; no text of anyone else."""
    real = evidence.select("evidence_id", F.col("source_id").alias("of"), "text", "start_ms")
    met = cited.join(real, "evidence_id").where("source_id = of and text is not null")
    at = F.when(F.col("start_ms").isNotNull(), F.concat(F.lit("@"), F.col("start_ms").cast("string"))).otherwise("")
    line = F.struct("place", F.concat(F.col("text"), F.lit(" ["), F.col("source_id").cast("string"), at, F.lit("]")).alias("line"))
    return met.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "; ").alias("answer"))
