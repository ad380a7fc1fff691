"""The cases over tables that are derived from the given ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..sources import derived
from .cases import CASES, filled
from .registry import query
from .upkeep import RELAXED, missing_reasons

#: These ask for substrings of titles, which have no key: they are for a request's few questions (see upkeep.py for all).
FEW = {"no_result_model", "no_result_rate"}
TABLES = {n: derived.sql(n) for n in derived.TABLES}


def _over(plan):
    return lambda s, d: plan(lambda name: derived.table(s, d, name))


for name, (plan, sql) in CASES.items():
    if name not in FEW:
        query(name, filled(sql, TABLES))(_over(plan))


WANTED = "SELECT conv_id || ':' || turn FROM conversations WHERE role = 'user' AND (conv_id * 7 + turn) % 3 = 0"


@query("no_result_rate", f"SELECT CASE WHEN n_language_and_depth > 0 AND w THEN 'true_result' WHEN n_language_and_depth > 0 THEN 'false_result' WHEN w THEN 'false_no_result' ELSE 'true_no_result' END AS outcome, count(*) AS n FROM (SELECT *, qid IN ({WANTED}) AS w FROM ({RELAXED})) GROUP BY 1")
def _(s, d):
    """Whether each user turn was found, against whether it has a wanted source."""
    reasons = missing_reasons(s, d).withColumnRenamed("qid", "question_id")
    turns = s.read.parquet(f"{d}/conversations.parquet").where("role = 'user'")
    wanted = turns.where((F.col("conv_id") * 7 + F.col("turn")) % 3 == 0).select(F.concat_ws(":", "conv_id", "turn").alias("question_id"))
    return E.no_result_rate(reasons.select("question_id"), wanted, reasons)
