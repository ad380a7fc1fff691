"""Order by marginal relevance: each next result is relevant and unlike those before it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def order(relevance: np.ndarray, like: np.ndarray, k: int, weight: float) -> list[int]:
    """Greedy places: the highest weight * relevance - (1 - weight) * greatest likeness to what is chosen; ties by place.
    Relevance is divided by its greatest value."""
    most = relevance.max(initial=0)
    relevance = relevance / most if most > 0 else relevance * 0.0
    near, left, out = np.full(len(relevance), -np.inf), np.ones(len(relevance), bool), []
    for _ in range(min(k, len(relevance))):
        gain = np.round(weight * relevance - (1 - weight) * np.where(np.isfinite(near), near, 0), 9)
        gain[~left] = -np.inf
        best = int(np.argmax(gain))
        out.append(best)
        left[best] = False
        near = np.maximum(near, like[best])
    return out


def diversify(candidates: DataFrame, vectors: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """qid, doc, place: the first k of each question's candidates (qid, doc, score, rank: a counted few of each question)
    by marginal relevance. vectors: doc, vector; a document without one is like nothing."""
    met = candidates.join(vectors.select("doc", "vector"), "doc", "left")  # as they are stored, as one goes with each candidate
    lists = met.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "doc", "score", "vector"))).alias("c"))
    kinds = dict(candidates.dtypes)

    def run(batches):
        for b in batches:
            qids, docs, places = [], [], []
            for q, c in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                width = max((len(x["vector"] or []) for x in c), default=0)
                v = np.array([[y or 0.0 for y in x["vector"] or []] + [0.0] * (width - len(x["vector"] or [])) for x in c]).reshape(len(c), width)
                size = np.sqrt((v * v).sum(axis=1, keepdims=True))
                v = np.divide(v, size, out=np.zeros_like(v), where=size > 0)
                for place, i in enumerate(order(np.array([x["score"] for x in c]), v @ v.T, k, weight), 1):
                    qids.append(q)
                    docs.append(c[i]["doc"])
                    places.append(place)
            doc_type = b.schema.field("c").type.value_type.field("doc").type
            yield pa.RecordBatch.from_arrays([pa.array([q.as_py() for q in qids], b.column(0).type), pa.array(docs, doc_type), pa.array(places, pa.int32())], ["qid", "doc", "place"])

    return lists.mapInArrow(run, f"qid {kinds['qid']}, doc {kinds['doc']}, place int")
