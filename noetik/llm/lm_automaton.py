"""Language-model scoring with a weighted backoff automaton.

Model: n-grams with Dirichlet smoothing, p(w|h) = (c(hw) + mu * p(w|h')) / (c(h) + mu), where h' is h without its
first word. As an automaton: each seen history is a state, each seen continuation an arc with its full log10
probability, and every state has one failure arc to h' with weight log10(mu / (c(h) + mu)). The root has an arc for
every word: absolute discounting, whose freed mass belongs to the unknown word, so each distribution sums to 1.
mu is estimated for each order so that the expected mass of new continuations equals the share of n-grams seen once.

Scale: the whole model never meets in one place. Blocks of documents, stored once as they are read, send their distinct
n-gram keys to buckets, which add up training counts over the whole corpus and send back only the counts, in the order
of the keys. Each block builds the part of the automaton that its own texts can reach and traverses its documents from
left to right in lock step. Texts are never shuffled by key, so no source, host or copy group makes a block larger.

Words are told apart by 64-bit hashes, of which blocks send 56 bits beside the bucket (see blocks.py): n_known and
base_score are those of the words unless two words agree in all of that, a chance of about v * v / 2**61 for v words.

Null or empty text: only the end token. Repeated ids: each row is scored by itself. A null id is kept. Extra columns are
ignored, whatever their names. An empty table gives no rows; without training rows every word is unknown and N is 0.
"""

from __future__ import annotations

import pickle
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B

BOS, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
STEP = np.uint64(0xA0761D6478BD642F)
BINS = 64
BLOCK_BYTES = 4 << 20


def words_of(text: bytes) -> list[bytes]:
    """Lower-case A-Z, then words between the six ASCII white spaces."""
    return text.lower().split()


class Grams:
    """All n-grams of some documents: per order, distinct keys, and for each token its n-gram's place among them.

    Tokens: a start mark, the words, an end mark. An n-gram that would begin before the start mark does not exist (-1).
    """

    def __init__(self, texts: list[bytes], order: int):
        vocabulary: dict = defaultdict()
        vocabulary.default_factory = vocabulary.__len__
        vocabulary[None], vocabulary[0] = 0, 1  # start, end
        ids, lengths = [], []
        for text in texts:
            w = words_of(text)
            ids.append(0)
            ids += map(vocabulary.__getitem__, w)
            ids.append(1)
            lengths.append(len(w) + 2)
        hashes = np.array([BOS, END, *(xxhash.xxh3_64_intdigest(w) for w in list(vocabulary)[2:])], np.uint64)
        token = np.array(ids, np.int64)
        self.lengths = np.array(lengths, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        place = np.arange(len(token)) - np.repeat(self.starts, self.lengths)
        self.doc = np.repeat(np.arange(len(texts)), self.lengths)
        with np.errstate(over="ignore"):
            self.hash = [hashes[token]]
            for _ in range(order - 1):
                h = np.empty_like(self.hash[0])
                h[0] = 0
                h[1:] = B.mix(self.hash[-1][:-1] * STEP + self.hash[0][1:])
                self.hash.append(h)
        self.exists = [place >= k for k in range(order)]

        self._unique: dict[int, tuple] = {}

    def unique(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys of order k + 1, the first token of each, and every token's place among them (-1: none)."""
        if k in self._unique:
            return self._unique[k]
        here = np.flatnonzero(self.exists[k])
        keys, first, inverse = np.unique(self.hash[k][here], return_index=True, return_inverse=True)
        every = np.full(len(self.doc), -1)
        every[here] = inverse
        self._unique[k] = keys, here[first], every
        return self._unique[k]

    def distinct(self, k: int, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of order k + 1 and their counts in training documents."""
        keys, _, every = self.unique(k)
        here = self.exists[k]
        return keys, np.bincount(every[here], train[self.doc[here]], len(keys)).astype(np.int64)


class Automaton:
    """States, arcs and failure arcs for the n-grams of a block, from their counts in the whole corpus."""

    def __init__(self, grams: Grams, counts: list[np.ndarray], model: dict):
        order = len(counts)
        at = [grams.unique(k)[1:] for k in range(order)]  # of each order: the first token of each distinct n-gram, and every token's n-gram
        self.word, self.counts, n_words = at[0][1], counts[0], len(at[0][0])
        root_p = unigram(counts[0], model)
        root_p[at[0][1][grams.starts[0]]] = 1.0  # the start mark is never predicted
        below, offset, states = None, 0, 1
        backoff, fail, arcs = [np.zeros(1)], [np.zeros(1, np.int64)], []
        #: of each order: the state of each distinct n-gram, or of its longest ending that is one
        state_of: list[np.ndarray] = []
        for k in range(order):
            first, every = at[k]
            seen = counts[k] > 0
            suffix = state_of[k - 1][at[k - 1][1][first]] if k else np.zeros(len(first), np.int64)
            state = suffix.copy()
            if k < order - 1:
                state[seen] = states + np.arange(seen.sum())
                mu = model["mu"][k + 1]
                backoff.append(np.log10(mu / (counts[k][seen] + mu)))
                fail.append(suffix[seen])
                states += int(seen.sum())
            state_of.append(state)
            if k == 0:
                p = root_p
                arcs.append((np.arange(n_words), np.log10(p), state))
            else:
                mu = model["mu"][k]
                history = at[k - 1][1][first - 1]
                lower = below[at[k - 1][1][first]]
                p = (counts[k] + mu * lower) / (counts[k - 1][history] + mu)
                arcs.append((state_of[k - 1][history][seen] * n_words + every_word(at, first)[seen], np.log10(p[seen]), state[seen]))
            below = p
        (_, self.root_logp, self.root_to), arcs = arcs[0], arcs[1:]
        key = np.concatenate([np.zeros(0, np.int64), *(a[0] for a in arcs)])
        by = np.argsort(key, kind="stable")
        self.arc_key, self.n_words, self.order = key[by], n_words, order
        self.arc_logp = np.concatenate([np.zeros(0), *(a[1] for a in arcs)])[by]
        self.arc_to = np.concatenate([np.zeros(0, np.int64), *(a[2] for a in arcs)])[by]
        self.backoff, self.fail = np.concatenate(backoff), np.concatenate(fail)
        self.start = int(state_of[0][at[0][1][grams.starts[0]]]) if order > 1 else 0

    def score(self, grams: Grams, segment: int = 256) -> np.ndarray:
        """One traversal from left to right, by many lanes at a time, each of which carries its state and its sum. A lane
        is a segment of a document; those after the first begin at the root as many tokens before as a state remembers,
        which leads to the state that the whole text would have led to, and count none of these tokens."""
        pieces = -(-(grams.lengths - 1) // segment)
        doc = np.repeat(np.arange(len(pieces)), pieces)
        at = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * segment
        skip = np.minimum(at, self.order - 1)
        length = np.minimum(segment, grams.lengths[doc] - 1 - at) + skip
        by = np.argsort(-length, kind="stable")
        doc, skip, length = doc[by], skip[by], length[by]
        starts = grams.starts[doc] + 1 + at[by] - skip
        state = np.where(at[by] == skip, self.start, 0)
        total = np.zeros(len(by))
        active = len(by)
        for t in range(int(length[0]) if active else 0):
            while length[active - 1] <= t:
                active -= 1
            word, s = self.word[starts[:active] + t], state[:active]
            gain = np.zeros(active)
            wait = np.flatnonzero(s)
            root = np.flatnonzero(s == 0)
            while len(wait):
                key = s[wait] * self.n_words + word[wait]
                arc = np.minimum(np.searchsorted(self.arc_key, key), len(self.arc_key) - 1)
                hit = self.arc_key[arc] == key if len(self.arc_key) else np.zeros(len(wait), bool)
                took, wait = wait[hit], wait[~hit]
                gain[took] += self.arc_logp[arc[hit]]
                gain[wait] += self.backoff[s[wait]]
                s[took], s[wait] = self.arc_to[arc[hit]], self.fail[s[wait]]
                fell = s[wait] == 0
                root, wait = np.concatenate([root, wait[fell]]), wait[~fell]
            gain[root] += self.root_logp[word[root]]
            s[root] = self.root_to[word[root]]
            total[:active] += np.where(t >= skip[:active], gain, 0.0)
        return np.bincount(doc, total, len(pieces))


def every_word(at: list, first: np.ndarray) -> np.ndarray:
    return at[0][1][first]


def unigram(counts: np.ndarray, model: dict) -> np.ndarray:
    """Discounted probabilities; the unknown word gets all that discounting frees."""
    d, n = model["discounts"], max(model["N"], 1)
    return np.where(counts > 0, (counts - d[np.minimum(counts, 3)]) / n, model["unknown"])


def _texts(data: bytes) -> tuple[pa.Table, list[bytes], np.ndarray]:
    """A stored block's rows, texts and training marks."""
    rows = B.rows_of(data)
    return rows, B.column_bytes(rows, "text"), rows.column("train").to_numpy().astype(float)


def _send(block: int, data: bytes, order: int, n_buckets: int) -> pa.Table:
    """Distinct keys and training counts of one block, by bucket."""
    _, texts, train = _texts(data)
    grams = Grams(texts, order)
    return pa.concat_tables([B.to_buckets(block, k, *grams.distinct(k, train), n_buckets) for k in range(order)])


def _statistics(key: tuple, table: pa.Table, n_buckets: int) -> pa.Table:
    """Counts of counts of one bucket's keys, of every order."""
    mark = np.array([BOS], np.uint64)
    bos, own = B.unpack_keys(B.pack_keys(mark))[0], key[0].as_py() == int(B.bucket_of(mark, n_buckets)[0])
    out = {"n_order": [], "name": [], "value": []}
    for k, _, _, _, distinct, total in B.gathered(table):
        history = total[total > 0]
        event = total[(total > 0) & ~((distinct == bos) & own & (k == 0))]
        bins = np.minimum(np.log2(history).astype(int), BINS - 1) if len(history) else np.zeros(0, int)
        values = {"N": event.sum(), "V": len(event)} | {f"n{c}": (event == c).sum() for c in range(1, 5)}
        values |= {f"h{b}": (bins == b).sum() for b in np.unique(bins)} | {f"c{b}": history[bins == b].sum() for b in np.unique(bins)}
        for name, v in values.items():
            out["n_order"].append(k), out["name"].append(name), out["value"].append(int(v))
    B.trim()
    return pa.table(out, schema=pa.schema([("n_order", pa.int32()), ("name", pa.string()), ("value", pa.int64())]))


def model_of(stats: dict[tuple[int, str], int], order: int) -> dict:
    """Global parameters from counts of counts."""
    get = lambda k, name: stats.get((k, name), 0)
    n, v = get(0, "N"), get(0, "V")
    n1, n2, n3, n4 = (get(0, f"n{c}") for c in range(1, 5))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [0, 1 - 2 * y * n2 / max(n1, 1), 2 - 3 * y * n3 / max(n2, 1), 3 - 4 * y * n4 / max(n3, 1)]
    discounts = np.array([0, *(min(max(raw[c], 0.1), c - 0.1) for c in (1, 2, 3))])
    freed = discounts[1] * n1 + discounts[2] * n2 + discounts[3] * (v - n1 - n2)
    model = {"N": n, "V": v, "discounts": discounts, "unknown": freed / n if n else 1.0, "mu": {}}
    for k in range(1, order):
        bins = [(get(k - 1, f"c{b}") / h, get(k - 1, f"c{b}")) for b in range(BINS) if (h := get(k - 1, f"h{b}"))]
        once, low, high = get(k, "n1"), 1e-2, 1e9
        for _ in range(100):
            mid = (low * high) ** 0.5
            low, high = (mid, high) if sum(c * mid / (mean + mid) for mean, c in bins) < once else (low, mid)
        model["mu"][k] = low
    return model


def fitted(sent: DataFrame, n_buckets: int, order: int) -> DataFrame:
    """One row with the model's parameters, from the counts of all keys that blocks sent."""
    stats = sent.groupBy("bucket").applyInArrow(lambda key, table: _statistics(key, table, n_buckets), "n_order int, name string, value long")
    one = stats.groupBy("n_order", "name").agg(F.sum("value").alias("value")).agg(F.collect_list(F.struct("n_order", "name", "value")).alias("stats"))

    def solve(batches):
        for b in batches:
            models = [model_of({(r["n_order"], r["name"]): r["value"] for r in rows}, order) for rows in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(map(pickle.dumps, models), pa.binary())], ["model"])

    return one.mapInArrow(solve, "model binary")


def train_and_score(docs: DataFrame, train: Column, order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score all rows of docs with the model of those rows where train holds."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    blocks = B.stored(own, BLOCK_BYTES)
    n = max(B.LEAST_BLOCKS, blocks.count())

    def send(batches):
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from _send(block, data, order, n).to_batches()
                B.trim()

    sent = blocks.mapInArrow(send, B.SENT_SQL)
    answers = sent.groupBy("bucket").applyInArrow(B.answer, B.ANSWER_SQL)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, texts, held = _texts(left.column("data")[0].as_py())
        model = pickle.loads(left.column("model")[0].as_py())
        grams = Grams(texts, order)
        automaton = Automaton(grams, [B.answered(right, k) for k in range(order)], model)
        scores = automaton.score(grams)
        c = automaton.counts[automaton.word]
        event = np.ones(len(c), bool)
        event[grams.starts] = False
        base = np.log10((c + 0.1) / (model["N"] + 0.1 * (model["V"] + 1)))
        add = lambda x: np.bincount(grams.doc[event], x[event], len(texts))
        out = pa.table(
            {
                "doc_id": rows.column("doc_id"), "held_out": pa.array(held == 0),
                "n_tokens": pa.array(grams.lengths - 1), "n_known": pa.array(add((c > 0).astype(float)).astype(np.int64)),
                "train_tokens": pa.array(np.full(len(texts), model["N"], np.int64)), "base_score": pa.array(add(base)), "score": pa.array(scores),
            }
        )
        del grams, automaton, c, event, base
        B.trim()
        return out

    kind = dict(own.dtypes)["doc_id"]
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    blocks = blocks.crossJoin(F.broadcast(fitted(sent, n, order)))  # one row
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)
