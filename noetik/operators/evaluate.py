"""Evaluation against labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_at_k(expected: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """question_id, recall: the share of a question's wanted sources among its first k."""
    top = ranked.where(F.col("place") <= k).select("question_id", "source_id", F.lit(1).alias("hit")).distinct()
    return expected.join(top, ["question_id", "source_id"], "left").groupBy("question_id").agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


def pair_f1(resolved: DataFrame) -> DataFrame:
    """tp, fp, fn, f1 over pairs of mentions, from counts of (entity_id, truth), so that no pair is a row. A mention
    without an entity, or without a truth, is in no pair of that kind."""
    pairs = F.col("n") * (F.col("n") - 1) / 2
    total = lambda df: df.agg(F.coalesce(F.sum(pairs), F.lit(0.0)).alias("pairs"))
    of = lambda *by: total(resolved.where(" and ".join(f"{c} is not null" for c in by)).groupBy(*by).agg(F.count("*").alias("n")))
    both, said, true = of("entity_id", "truth"), of("entity_id"), of("truth")
    kinds = both.withColumn("kind", F.lit("tp")).unionByName(said.withColumn("kind", F.lit("said"))).unionByName(true.withColumn("kind", F.lit("true")))
    at = lambda k: F.max(F.when(F.col("kind") == k, F.col("pairs")))
    got = kinds.agg(at("tp").alias("tp"), at("said").alias("said"), at("true").alias("true"))
    return got.select(F.col("tp").cast("long").alias("tp"), (F.col("said") - F.col("tp")).cast("long").alias("fp"), (F.col("true") - F.col("tp")).cast("long").alias("fn"), F.round(2 * F.col("tp") / (F.col("said") + F.col("true")), 6).alias("f1"))


def citation_rate(cited: DataFrame, evidence: DataFrame) -> DataFrame:
    """question_id, n, rate: the share of an answer's citations whose evidence exists and is the cited source's."""
    real = evidence.select("evidence_id", "source_id", F.lit(1).alias("good"))
    return cited.join(real, ["evidence_id", "source_id"], "left").groupBy("question_id").agg(F.count("*").alias("n"), F.round(F.count("good") / F.count("*"), 6).alias("rate"))


def no_result_rate(questions: DataFrame, expected: DataFrame, reasons: DataFrame) -> DataFrame:
    """outcome, n: whether a question was found, against whether it has a wanted source."""
    wanted = expected.select("question_id").distinct().withColumn("wanted", F.lit(True))
    both = questions.select("question_id").join(wanted, "question_id", "left").join(reasons, "question_id", "left")
    found, has = F.col("reason") == "found", F.col("wanted").isNotNull()
    outcome = F.when(found & has, "true_result").when(found, "false_result").when(has, "false_no_result").otherwise("true_no_result")
    return both.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
