"""Queries of revisions, integrity, diversity and missing results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import diversity, integrity, relaxed, revisions
from ..operators import windows as W
from ..session import checkpoint_folder, written
from ..sources import tables as T
from .ranked import questions, text_index
from .registry import query

# revisions: the documents of a source, by id, are taken as versions of one page


def versions(s, d):
    """source, version, old, new of every document but a source's first."""
    docs = T.table(s, d, "documents")
    numbered = W.ranked_wide(docs.where("source is not null").select("source", "doc_id"), ["source"], [F.col("doc_id")], "version")
    text = docs.select("doc_id", "text")
    new = numbered.join(text.withColumnRenamed("text", "new"), "doc_id").select("source", "version", "new")
    old = numbered.join(text.withColumnRenamed("text", "old"), "doc_id").select("source", (F.col("version") + 1).alias("version"), "old")
    return new.join(old, ["source", "version"])


VERSIONS = "SELECT source, version, old, new FROM (SELECT source, text AS new, lag(text) OVER w AS old, row_number() OVER w AS version FROM documents WHERE source IS NOT NULL WINDOW w AS (PARTITION BY source ORDER BY doc_id)) WHERE version > 1"


@query("revision_diff")
def _(s, d):
    """Lines inserted, deleted and kept from each version to the next, by the shortest script."""
    return revisions.differences(versions(s, d), ["source", "version"]).select("source", "version", "inserted", "deleted", "kept", F.size("hunks").alias("hunks"))


@query("revision_apply", f"SELECT source, version, len(string_split(old, chr(10))) AS old_lines, len(string_split(new, chr(10))) AS new_lines, sha256(new) AS text_sha256 FROM ({VERSIONS}) WHERE old IS NOT NULL AND new IS NOT NULL")
def _(s, d):
    """The newer text made from the older one and the script."""
    pairs, _ = written(versions(s, d).where("old is not null and new is not null"))
    found = pairs.join(revisions.differences(pairs, ["source", "version"]), ["source", "version"])
    made = revisions.applied(F.col("old"), F.col("hunks"))
    return found.select("source", "version", (F.col("kept") + F.col("deleted")).alias("old_lines"), (F.col("kept") + F.col("inserted")).alias("new_lines"), X.content_hash(made).alias("text_sha256"))


# integrity


COLUMNS = ["text", "lang", "source", "n_chars"]


def _projection(s, d, damaged: bool):
    """A stored copy of documents; damaged: some texts are cut, two columns are swapped, rows are gone or doubled in number."""
    docs = T.table(s, d, "documents").select("doc_id", *COLUMNS)
    if damaged:
        swap = F.col("doc_id") % 211 == 7
        docs = docs.where("doc_id % 199 <> 3").withColumn("text", F.when(F.col("doc_id") % 197 == 5, F.concat(F.coalesce("text", F.lit("")), F.lit("."))).otherwise(F.col("text")))
        docs = docs.select("doc_id", "text", F.when(swap, F.col("source")).otherwise(F.col("lang")).alias("lang"), F.when(swap, F.col("lang")).otherwise(F.col("source")).alias("source"), "n_chars")
        more = docs.where("doc_id % 193 = 2").withColumn("doc_id", F.col("doc_id") + 1_000_000_000)
        docs = docs.unionByName(more)
    path = f"{checkpoint_folder(s)}/projection-{uuid.uuid4().hex}"
    docs.write.parquet(path)
    return s.read.parquet(path)


def _tree(df):
    return written(integrity.tree(df, "doc_id", COLUMNS))[0]


@query("integrity_damage", "SELECT doc_id, 'missing' AS change FROM documents WHERE doc_id % 199 = 3 UNION ALL SELECT doc_id, 'changed' FROM documents WHERE doc_id % 199 <> 3 AND (doc_id % 197 = 5 OR (doc_id % 211 = 7 AND lang IS DISTINCT FROM source)) UNION ALL SELECT doc_id + 1000000000, 'extra' FROM documents WHERE doc_id % 199 <> 3 AND doc_id % 193 = 2")
def _(s, d):
    docs, copy = T.table(s, d, "documents"), _projection(s, d, True)
    leaves, _ = integrity.differing_leaves(_tree(docs), _tree(copy))
    return integrity.changed(docs, copy, leaves, "doc_id", COLUMNS)


@query("integrity_equal", "SELECT count(*) AS n_rows, 1 AS levels_read, 0 AS nodes_that_differ FROM documents")
def _(s, d):
    """A rebuilt projection has the table's tree, which is seen at the root."""
    one, other = _tree(T.table(s, d, "documents")), _tree(_projection(s, d, False))
    _, seen = integrity.differing_leaves(one, other)
    n = one.where("level = -1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    return n.select("n_rows", F.lit(len(seen)).alias("levels_read"), F.lit(sum(seen)).alias("nodes_that_differ"))


# diversity


@query("mmr")
def _(s, d):
    """Of each question's first 20 documents the five of highest marginal relevance."""
    vectors = T.table(s, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    return diversity.diversify(text_index(s, d).top(questions(s, d), 20), vectors, 5)


# missing results


def asked(s, d):
    """A request for each user turn: its longest word, the language and the depth it wants."""
    turns = T.messages(s, d).where("role = 'user'")
    longest = F.array_max(F.transform(X.tokens(F.col("text")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    wanted = F.element_at(F.array(*map(F.lit, ["en", "de", "fr", "es"])), (F.col("conv_id") % 4 + 1).cast("int"))
    return turns.select(F.concat_ws(":", "conv_id", "turn").alias("qid"), longest.alias("term"), wanted.alias("wanted_lang"), (F.col("turn") % 3).alias("wanted_depth"))


TOKENS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
ASKED = f"SELECT conv_id || ':' || turn AS qid, list_max(list_transform({TOKENS}, lambda w: {{'n': length(w), 'w': w}})).w AS term, (['en', 'de', 'fr', 'es'])[conv_id % 4 + 1] AS wanted_lang, turn % 3 AS wanted_depth FROM conversations WHERE role = 'user'"
FACETED = f"SELECT lang, CASE WHEN quality = 1 THEN 2 WHEN quality = 0 THEN 0 ELSE 1 END AS depth, list_distinct({TOKENS}) AS w FROM documents LEFT JOIN labels USING (doc_id)"
RELAXED = f"""WITH q AS ({ASKED}), t AS (SELECT lang, depth, unnest(w) AS term FROM ({FACETED})) SELECT qid, count(*) FILTER (lang = wanted_lang AND depth >= wanted_depth) AS n_language_and_depth,
count(*) FILTER (lang = wanted_lang) AS n_language, count(*) FILTER (depth >= wanted_depth) AS n_depth, count(t.term) AS n_any FROM q LEFT JOIN t USING (term) GROUP BY qid"""


def _relaxed(s, d):
    """Depth: 2 for documents labelled good, 0 for those labelled bad, 1 for others."""
    quality = T.table(s, d, "labels").select("doc_id", "quality")
    docs = T.table(s, d, "documents").select("doc_id", "lang", "text").join(quality, "doc_id", "left")
    docs = docs.withColumn("depth", F.when(F.col("quality") == 1, 2).when(F.col("quality") == 0, 0).otherwise(1))
    tests = {"language": F.col("lang") == F.col("wanted_lang"), "depth": F.col("depth") >= F.col("wanted_depth")}
    return relaxed.lattice(asked(s, d), docs, F.col("text"), ["lang", "depth"], tests)


@query("relaxations", RELAXED)
def _(s, d):
    return _relaxed(s, d)


def missing_reasons(s, d):
    """qid, reason of every user turn."""
    return relaxed.reason(_relaxed(s, d), ["language", "depth"], {"language": "other_language", "depth": "not_deep_enough"}).select("qid", "reason")


@query("no_result_reason", f"SELECT qid, CASE WHEN n_language_and_depth > 0 THEN 'found' WHEN n_depth > 0 THEN 'other_language' WHEN n_language > 0 THEN 'not_deep_enough' WHEN n_any > 0 THEN 'too_narrow' ELSE 'absent' END AS reason FROM ({RELAXED})")
def _(s, d):
    return missing_reasons(s, d)
