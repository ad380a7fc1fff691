"""Queries of the stored text index: many questions at once, phrases, changes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.postings import PostingsIndex
from ..session import checkpoint_folder, discard
from ..sources import tables as T
from .registry import query

TOKENS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_kept: dict[tuple, PostingsIndex] = {}


def text_index(s, d) -> PostingsIndex:
    """The index of a folder's documents, which is built once in an application and again when the files have changed."""
    docs = T.table(s, d, "documents")
    path = s._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    files = path.getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
    key = (s.sparkContext.applicationId, *sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in files.listStatus(path)))
    if key not in _kept or not _kept[key].versions():
        index = PostingsIndex(s, f"{checkpoint_folder(s)}/text-{uuid.uuid4().hex}")
        index.update(docs, "doc_id")
        _kept[key] = index
    return _kept[key]


def questions(s, d):
    """qid, text of every user turn."""
    return T.messages(s, d).where("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("qid"), "text")


def ranked_sql(docs: str, k: int = 10) -> str:
    """The first k documents of every user turn."""
    return f"""WITH w AS (SELECT doc_id AS doc, {TOKENS} AS w FROM {docs}), st AS (SELECT count(*) AS n, avg(coalesce(len(w), 0)) AS a FROM w),
a AS (SELECT DISTINCT conv_id || ':' || turn AS qid, unnest({TOKENS}) AS term FROM conversations WHERE role = 'user'),
tf AS (SELECT doc, dl, term, count(*) AS tf FROM (SELECT doc, len(w) AS dl, unnest(w) AS term FROM w) WHERE term IN (SELECT term FROM a) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT qid, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM a JOIN tf USING (term) JOIN df USING (term), st GROUP BY qid, doc)
SELECT qid, doc, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS INTEGER) AS rank FROM s QUALIFY rank <= {k}"""


@query("ranked_questions", ranked_sql("documents"))
def _(s, d):
    return text_index(s, d).top(questions(s, d), 10)


@query("ranked_blocks")
def _(s, d):
    """How much of the index the questions read."""
    return text_index(s, d).top(questions(s, d), 10, report=True)


#: A later state of documents: every fifth has more words, every seventh is gone, some are new.
CHANGED = """(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN coalesce(text, '') || ' of a later version' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0
UNION ALL SELECT 1000000000 + doc_id, text FROM documents WHERE doc_id % 50 = 3)"""


def changed_index(s, d, compact: bool) -> PostingsIndex:
    """An index of documents to which the changes were brought in two steps."""
    docs = T.table(s, d, "documents").select("doc_id", "text")
    index = PostingsIndex(s, f"{checkpoint_folder(s)}/text-{uuid.uuid4().hex}")
    index.update(docs, "doc_id")
    later = docs.where("doc_id % 5 = 0").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" of a later version")))
    index.update(later.unionByName(docs.where("doc_id % 50 = 3").withColumn("doc_id", F.col("doc_id") + 1000000000)), "doc_id")
    gone = docs.where("doc_id % 7 = 0").select(F.col("doc_id").alias("doc"))
    index.update(docs.limit(0), "doc_id", deleted=gone)
    if compact:
        index.compact()
        index.vacuum()
    return index


@query("index_changes", f"WITH t AS (SELECT doc_id AS doc, unnest({TOKENS}) AS term FROM {CHANGED}) SELECT term, doc, count(*) AS tf FROM t GROUP BY term, doc")
def _(s, d):
    return changed_index(s, d, False).postings()


@query("index_compacted", ranked_sql(CHANGED))
def _(s, d):
    return changed_index(s, d, True).top(questions(s, d), 10)


@query("index_bytes")
def _(s, d):
    """Bytes of each segment: the whole, the changed documents, the deletion."""
    index = changed_index(s, d, False)
    out = [(k, index.size(name)) for k, name in enumerate(index.version()["segments"])]
    discard(s, index.path)
    return s.createDataFrame(out, "segment long, bytes long")
