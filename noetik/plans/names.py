"""Queries of names: like names, mentions in texts, profiles of what is said."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edit_distance as N
from ..operators import mentions as M
from ..sources import tables as T
from .registry import query


def near_sql(table: str, key: str, name: str) -> str:
    return f"""WITH k AS (SELECT {name} AS name, min({key}) AS id, count(*) AS n FROM {table} WHERE {name} IS NOT NULL GROUP BY 1)
SELECT a.id AS a, b.id AS b, a.n AS n_a, b.n AS n_b, CAST(levenshtein(a.name, b.name) AS INTEGER) AS distance FROM k a JOIN k b ON a.id < b.id WHERE levenshtein(a.name, b.name) <= 2"""


@query("near_part_names", near_sql("part", "p_partkey", "p_name"))
def _(s, d):
    return N.near_names(T.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), 2)


@query("near_supplier_names", near_sql("supplier", "s_suppkey", "s_name"))
def _(s, d):
    return N.near_names(T.table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), 2)


#: Orders as notes: the customer, the date, and a line for each part.
NOTES = """SELECT 'order' || o_orderkey AS id, 'Saved by ' || c_name || ' on ' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || ':' || chr(10) || lines AS text FROM orders JOIN customer ON c_custkey = o_custkey JOIN (
SELECT l_orderkey, string_agg(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' x ' || p_name || ' at $' || CAST(CAST(round(p_retailprice * 100) AS BIGINT) // 100 AS VARCHAR) || '.' || lpad(CAST(CAST(round(p_retailprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0') || ' from ' || s_name || '.', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) AS lines
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_orderkey) ON l_orderkey = o_orderkey"""


def notes(s, d):
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    price = F.concat(F.expr("cast(round(p_retailprice * 100) as bigint) div 100").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    said = F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(" x "), F.col("p_name"), F.lit(" at $"), price, F.lit(" from "), F.col("s_name"), F.lit("."))
    lines = T.table(s, d, "lineitem").join(T.table(s, d, "part"), F.col("p_partkey") == F.col("l_partkey")).join(T.table(s, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    lines = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", said.alias("said")))).alias("r"))
    of = T.table(s, d, "orders").join(T.table(s, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    head = F.concat(F.lit("Saved by "), F.col("c_name"), F.lit(" on "), F.col("o_orderdate").cast("date").cast("string"), F.lit(":\n"))
    return of.select(F.concat(F.lit("order"), F.col("o_orderkey")).alias("id"), F.concat(head, F.array_join("r.said", "\n")).alias("text"))


NAMED = "SELECT 'part' AS kind, p_partkey AS entity_id, p_name AS name FROM part UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name FROM customer"


def named(s, d):
    of = lambda t, kind, key, name: T.table(s, d, t).select(F.lit(kind).alias("kind"), F.col(key).alias("entity_id"), F.col(name).alias("name"))
    return of("part", "part", "p_partkey", "p_name").unionByName(of("supplier", "supplier", "s_suppkey", "s_name")).unionByName(of("customer", "customer", "c_custkey", "c_name"))


def told(s, d):
    """All texts in which names are looked for: documents, and orders as notes."""
    return T.table(s, d, "documents").select(F.concat(F.lit("doc"), F.col("doc_id")).alias("id"), "text").unionByName(notes(s, d))


FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The names have one word or two with a space between; # is a letter of them.
MENTIONS = rf"""WITH t AS (SELECT id, {FOLD.format("text")} AS text FROM (SELECT 'doc' || doc_id AS id, text FROM documents UNION ALL {NOTES}) WHERE text IS NOT NULL),
e AS (SELECT {FOLD.format("name")} AS name, kind, min(entity_id) AS entity_id, count(*) AS n_entities FROM ({NAMED}) GROUP BY 1, 2),
p AS (SELECT id, regexp_extract_all(text, '[\p{{L}}\p{{N}}#]+') AS w, string_split_regex(text, '[\p{{L}}\p{{N}}#]+') AS g FROM t),
u AS (SELECT id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS w, unnest(g[1:len(w)]) AS g FROM p),
q AS (SELECT id, k, w, sum(length(g)) OVER b + sum(length(w)) OVER b - length(w) AS start, lead(w) OVER o AS w2, lead(g) OVER o AS g2 FROM u WINDOW o AS (PARTITION BY id ORDER BY k), b AS (PARTITION BY id ORDER BY k ROWS UNBOUNDED PRECEDING)),
c AS (SELECT id, start, w AS name FROM q UNION ALL SELECT id, start, w || ' ' || w2 FROM q WHERE g2 = ' ')
SELECT id, CAST(start AS BIGINT) AS start, CAST(start + length(name) AS BIGINT) AS "end", name, kind, entity_id, n_entities FROM c JOIN e USING (name)"""


@query("mentions", MENTIONS)
def _(s, d):
    return M.linked(M.mentions(told(s, d), named(s, d)), named(s, d))


VALUE = lambda f: f"CASE WHEN regexp_matches(text, '{f[0]}') THEN TRY_CAST(regexp_extract(text, '{f[0]}', 1) AS {f[1]}) END" if f[1] != "date" else f"CAST({VALUE((f[0], 'DATE'))} AS VARCHAR)"


@query("profiles", "SELECT id, " + ", ".join(f'{VALUE(f)} AS "{n}"' for n, f in M.PROFILES["restaurant_guide"].items()) + f" FROM (SELECT 'doc' || doc_id AS id, text FROM documents UNION ALL {NOTES})")
def _(s, d):
    return M.profile(told(s, d), F.col("text"), M.PROFILES["restaurant_guide"]).drop("text").withColumn("date", F.col("date").cast("string"))
