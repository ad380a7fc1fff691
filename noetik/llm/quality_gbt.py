"""Quality classifier: histogram gradient-boosted trees over document statistics.

Training reads at most MAX_LABELS labelled rows (the lowest hashes of their ids, so the sample does not depend on
partitions); only their statistics reach the driver. The trees are complete and flattened into arrays, so a batch of
documents walks all trees at once in numpy. Scoring is one pass without a shuffle.

Null text counts as empty. A label of null is no label, nor is one of a null id; of several labels of one id the
smallest counts, and of several rows of one id one is learnt from. Every row is scored by itself. A corpus with no label,
or with one class only, scores every text with that class's share (0.5 without labels). An empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import fresh

MAX_LABELS = 20_000
DIM = 26
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
UPPER, DIGIT, SPACE = (np.isin(np.arange(256), x) for x in ([*range(65, 91)], [*range(48, 58)], [*range(9, 14), 32]))
MARK = ~(LETTER | DIGIT | SPACE)
PLAIN_MARK = np.isin(np.arange(256), [ord(c) for c in ".,;:'\"-()?"])
ENDS = re.compile(rb"[.?!][\s\"')]*(?:\s|$)")


def statistics(text: bytes) -> list[float]:
    """DIM numbers of a whole text."""
    n = len(text)
    words = text.split()
    w = len(words)
    if not w:
        return [0.0] * DIM
    h = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), np.int64, w)
    kinds: dict[bytes, int] = {}
    for x in words:
        kinds[x] = kinds.get(x, 0) + 1
    pairs = len(set(zip(words, words[1:])))  # noqa: B905
    same = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    p = h[h > 0] / n
    marks = int(h[MARK].sum())
    bare = sum(map(bytes.isalpha, words))
    upper = sum(map(bytes.isupper, words))
    ends = len(ENDS.findall(text))
    return [
        np.log1p(n), np.log1p(w), lengths.mean(), lengths.std(), lengths.max(),
        h[LETTER].sum() / n, h[UPPER].sum() / n, h[DIGIT].sum() / n, marks / n, (marks - h[PLAIN_MARK].sum()) / n,
        h[SPACE].sum() / n, h[ord("|")] / w, h[ord("!")] / w, h[128:].sum() / n, len(kinds) / w, max(kinds.values()) / w,
        pairs / max(w - 1, 1), same / w, len(lines) / w, len(set(lines)) / max(len(lines), 1), max(map(len, lines)) / n,
        float(-(p * np.log2(p)).sum()), bare / w, upper / w, ends / w, np.log1p(w / (ends + 1)),
    ]


@dataclass
class Trees:
    """feature, cut: (trees, 2**depth - 1) in level order; leaf: (trees, 2**depth)."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    bias: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        trees, depth = np.arange(len(self.feature)), int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        out = np.full(len(x), self.bias)
        for at in range(0, len(x), 512):
            part = x[at : at + 512]
            node = np.zeros((len(part), len(trees)), np.int64)
            rows = np.arange(len(part))[:, None]
            for _ in range(depth):
                node = 2 * node + 1 + (part[rows, self.feature[trees, node]] > self.cut[trees, node])
            if len(trees):
                out[at : at + 512] += self.leaf[trees, node - (self.leaf.shape[1] - 1)].sum(1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, least: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss; splits are sought in histograms of quantile bins."""
    mean = y.mean() if len(y) else 0.5
    bias = float(np.log(np.clip(mean, 1e-6, 1 - 1e-6) / (1 - np.clip(mean, 1e-6, 1 - 1e-6))))
    if not len(y) or mean in (0, 1):
        return Trees(np.zeros((0, 2**depth - 1), int), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)), bias)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    flat = binned + np.arange(x.shape[1]) * bins
    raw, feature, cut, leaf = np.full(len(y), bias), [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        fs, cs = np.zeros(2**depth - 1, int), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            base, width = 2**level - 1, 2**level
            at = ((node - base)[:, None] * x.shape[1] * bins + flat).ravel()
            shape = (width, x.shape[1], bins)
            gs, hs = (np.bincount(at, np.repeat(v, x.shape[1]), np.prod(shape)).reshape(shape).cumsum(2) for v in (g, h))
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain[(hs < least) | (ht - hs < least)] = -1
            for f, e in enumerate(edges):
                gain[:, f, len(e) :] = -1
            best = gain.reshape(width, -1).argmax(1)
            for k, b in enumerate(best):
                if gain.reshape(width, -1)[k, b] > 1e-9:
                    fs[base + k], cs[base + k] = b // bins, edges[b // bins][b % bins]
            node = 2 * node + 1 + (x[np.arange(len(y)), fs[node]] > cs[node])
        at = node - (2**depth - 1)
        value = -rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + ridge)
        raw += value[at]
        feature.append(fs), cut.append(cs), leaf.append(value)
    return Trees(np.array(feature), np.array(cut), np.array(leaf), bias)


def table_statistics(batch: pa.RecordBatch, text: str) -> np.ndarray:
    texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
    return np.array([statistics(t or b"") for t in texts], float).reshape(len(texts), DIM)


def learn(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELS) -> Trees:
    """Trees for the labelled documents; labels holds the rows that may be learnt from."""
    sample = (
        labels.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("y")).where("id is not null and y is not null")
        .groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most)
    )
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("id", "y", "text")

    def rows(batches):
        for b in batches:
            x = table_statistics(b, "text")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["id", "y", "x"])

    # of several rows of one id one is learnt from, so at most `most` rows reach the driver
    each = joined.mapInArrow(rows, f"id {dict(joined.dtypes)['id']}, y double, x array<double>")
    got = each.groupBy("id").agg(F.min(F.struct("y", "x")).alias("r")).select("r.y", "r.x").toArrow()
    y = np.array(got.column("y").to_pylist(), float)
    x = np.array(got.column("x").to_pylist(), float).reshape(len(y), DIM)
    by = np.lexsort((*x.T, y))  # the order of rows never matters
    return fit(x[by], y[by])


def score(docs: DataFrame, model: Trees, into: str = "score", text_col: str = "text") -> DataFrame:
    """docs with a column more, the probability of label 1. A column of docs with the name of the new one is replaced."""
    if into == text_col:
        raise ValueError("the score cannot replace the text that it is made of")
    docs = docs.drop(*[c for c in docs.columns if c.lower() == into.lower()])

    def rows(batches):
        fresh()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.probability(table_statistics(b, text_col)))], [*b.schema.names, into])

    return docs.mapInArrow(rows, T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())]))
