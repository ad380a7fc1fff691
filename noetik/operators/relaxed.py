"""Why a question has no result: the counts of all relaxations of its filters, from one scan.

Documents are first counted by token and by what the filters look at (a few values each), for the tokens that questions
ask for. A question then adds up, for each subset of its filters, the counts that satisfy the subset: the lattice from
all filters to none. So a frequent token makes as many rows as there are combinations of filter values, not documents.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens


def lattice(questions: DataFrame, docs: DataFrame, text: Column, facets: list[str], tests: dict[str, Column]) -> DataFrame:
    """qid and a column for each subset of the tests: how many documents hold the question's term and pass them.

    questions: qid, term and what the tests read; docs: the facets, columns of few values. A test is a condition on facets
    and columns of the question; null is no pass. Columns are n_ and the tests' names joined by _and_, n_any for none."""
    asked = questions.select("term").where("term is not null").distinct()
    each = docs.select(*facets, F.explode(F.array_distinct(tokens(text))).alias("term"))
    counted = each.join(asked, "term", "left_semi").groupBy("term", *facets).agg(F.count("*").alias("_n"))
    met = questions.join(counted, "term", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    passed = {n: F.coalesce(c, F.lit(False)) for n, c in tests.items()}
    out = []
    for k in range(len(tests), -1, -1):
        for some in combinations(tests, k):
            all_ = F.lit(True)
            for n in some:
                all_ = all_ & passed[n]
            out.append(F.sum(F.when(all_, F.col("_n")).otherwise(0)).alias("n_" + ("_and_".join(some) or "any")))
    return met.groupBy("qid").agg(*out)


def reason(counts: DataFrame, tests: list[str], words: dict[str, str]) -> DataFrame:
    """qid, reason: found; else the word of the first test whose removal alone gives results; too_narrow where only
    several removals do; absent where nothing matches."""
    n = lambda some: F.col("n_" + ("_and_".join(some) or "any"))
    out = F.when(n(tests) > 0, "found")
    for t in tests:
        out = out.when(n([x for x in tests if x != t]) > 0, words[t])
    return counts.withColumn("reason", out.when(n([]) > 0, "too_narrow").otherwise("absent"))
