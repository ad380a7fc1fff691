"""Postings of a shard, and questions against a block of shards: what one task of the text index does, on arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _lists(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def invert(docs: pa.Table) -> pa.Table:
    """The rows of one shard's postings, from its documents (part, shard, doc, dl, w: at least one token, a space between two)."""
    docs = docs.sort_by("doc")
    length = docs["dl"].to_numpy().astype(np.int64)
    words = pc.split_pattern(docs["w"].combine_chunks(), " ").flatten().dictionary_encode()
    total, codes = len(words), words.indices.to_numpy()
    owner, place = np.repeat(np.arange(len(length)), length), np.arange(total) - np.repeat(np.cumsum(length) - length, length)
    order = np.argsort(codes, kind="stable")  # by term, then document, then place
    codes, owner, place = codes[order], owner[order], place[order]
    at = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])))  # where a document's places begin
    ends = np.append(at, total)
    tf, codes, owner = np.diff(ends), codes[at], owner[at]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))  # where a term begins
    rows, ints = np.append(first, len(at)), lambda x: pa.array(x, pa.int32())
    return pa.table({
        "part": pa.repeat(docs["part"][0], len(first)), "shard": pa.repeat(docs["shard"][0], len(first)), "term": words.dictionary.take(pa.array(codes[first])),
        "docs": _lists(rows, docs["doc"].combine_chunks().take(pa.array(owner))), "tfs": _lists(rows, ints(tf)), "dls": _lists(rows, ints(length[owner])),
        "places": _lists(rows, _lists(ends, ints(place))), "n": ints(np.diff(rows)), "most": ints(np.maximum.reduceat(tf, first)), "least": ints(np.minimum.reduceat(length[owner], first)),
    })


class Block:
    """Postings (shard, t, idf, docs, tfs, dls) of a block of shards: for each term its documents and the parts of their scores."""

    def __init__(self, posted: pa.Table, k1: float, b: float, mean: float, shards: bool = False):
        posted = posted.sort_by("t")
        column = lambda c: posted[c].combine_chunks()
        docs = column("docs")
        size = docs.value_lengths().to_numpy()
        known = docs.flatten().dictionary_encode()
        rising = pc.sort_indices(known.dictionary).to_numpy()
        self.names = known.dictionary.take(pa.array(rising))  # ids rise, so ties are by place
        place = np.empty(len(rising), np.int32)
        place[rising] = np.arange(len(rising))
        self.at = place[known.indices.to_numpy()]
        del docs, known
        tf, below = column("tfs").flatten().to_numpy(), b * column("dls").flatten().to_numpy()
        below /= mean
        below += 1 - b
        below *= k1
        below += tf
        self.part = tf * (k1 + 1)
        self.part /= below
        self.part *= np.repeat(column("idf").to_numpy(), size)
        term, begin = np.unique(column("t").to_numpy(), return_index=True)
        ends = np.append(0, np.cumsum(size))
        self.terms, self.begin, self.end = term, ends[begin], ends[np.append(begin[1:], len(size))]
        if shards:
            self.shards = np.empty(len(rising), np.int64)
            self.shards[self.at] = np.repeat(column("shard").to_numpy(), size)

    def questions(self, lists: pa.ListArray):
        """For each question (its terms) that meets something: its row, and the places and parts it meets."""
        flat, size = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
        found = np.minimum(np.searchsorted(self.terms, flat), len(self.terms) - 1)
        good, start = self.terms[found] == flat, np.cumsum(size) - size
        for row, (i, n) in enumerate(zip(start.tolist(), size.tolist(), strict=True)):
            mine = found[i : i + n][good[i : i + n]]
            if len(mine):
                spans = [slice(self.begin[m], self.end[m]) for m in mine]
                yield row, np.concatenate([self.at[s] for s in spans]), np.concatenate([self.part[s] for s in spans])

    def first(self, chunks: pa.Table, k: int, digits: int | None, slack: float) -> pa.Table:
        """chunk, sizes, docs, scores: how many, and which, are the first k of each question of a chunk (chunk, ts, and
        seeds where only documents of these shards count) by score (rounded to digits), ties by doc."""
        out, n = [], len(self.names)
        held = np.unique(self.shards) if "seeds" in chunks.column_names else None
        for c in range(chunks.num_rows):
            lists = chunks["ts"][c].values
            sizes, docs, scores = np.zeros(len(lists), np.int32), [], []
            seeds = None if held is None else chunks["seeds"][c].as_py()
            if seeds is not None and not np.isin(np.array([x for s in seeds for x in s], np.int64), held).any():
                continue
            for row, at, part in self.questions(lists):
                if seeds is not None and not np.isin(seeds[row], held).any():
                    continue
                score = np.bincount(at, part, n)
                if seeds is not None:
                    score[~np.isin(self.shards, seeds[row])] = 0
                least = np.partition(score, n - k)[n - k] - slack if n > k else 0.0
                some = np.flatnonzero((score >= least) & (score > 0))
                score = score[some] if digits is None else np.round(score[some], digits)
                best = np.lexsort((some, -score))[:k]
                sizes[row] = len(best)
                docs.append(some[best])
                scores.append(score[best])
            if docs:
                out.append((chunks["chunk"][c].as_py(), sizes, np.concatenate(docs), np.concatenate(scores)))
        flat = lambda j, kind: np.concatenate([x[j] for x in out]) if out else np.zeros(0, kind)
        ends = lambda j: np.append(0, np.cumsum([len(x[j]) for x in out])).astype(np.int32)
        return pa.table({
            "chunk": pa.array([x[0] for x in out], pa.int64()), "sizes": _lists(ends(1), pa.array(flat(1, np.int32), pa.int32())),
            "docs": _lists(ends(2), self.names.take(pa.array(flat(2, np.int64), pa.int64()))), "scores": _lists(ends(3), pa.array(flat(3, float), pa.float64())),
        })

    def counted(self, chunks: pa.Table, slack: float) -> pa.Table:
        """chunk, counts: shards, read_shards, blocks, read_blocks of each question, of postings that stand for shards with
        their bounds: all that a question meets, and of these its seeds and what reaches its least score (NaN: all)."""
        out, names, n = [], self.names.to_numpy(), len(self.names)
        for c in range(chunks.num_rows):
            lists, least, seeds = chunks["ts"][c].values, chunks["least"][c].values.to_numpy(zero_copy_only=False), chunks["seeds"][c].as_py()
            counts = np.zeros((len(lists), 4), np.int64)
            for row, at, part in self.questions(lists):
                bound, many = np.bincount(at, part, n), np.bincount(at, minlength=n)
                used = (many > 0) & (np.isnan(least[row]) | (bound >= least[row] - slack) | np.isin(names, seeds[row]))
                counts[row] = np.count_nonzero(many), np.count_nonzero(used), many.sum(), many[used].sum()
            out.append(counts.ravel())
        ends = np.append(0, np.cumsum([len(x) for x in out])).astype(np.int32)
        return pa.table({"chunk": chunks["chunk"], "counts": _lists(ends, pa.array(np.concatenate(out) if out else np.zeros(0, np.int64), pa.int64()))})


def merged(found: pa.Table, n: int, k: int) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Of what blocks found for the n questions of a chunk the first k of each: question, doc, score, rank."""
    sizes, score = found["sizes"].combine_chunks().flatten().to_numpy(), found["scores"].combine_chunks().flatten().to_numpy()
    docs = found["docs"].combine_chunks().flatten()
    question = np.repeat(np.tile(np.arange(n), found.num_rows), sizes)
    place = np.empty(len(docs), np.int64)
    place[pc.sort_indices(docs).to_numpy()] = np.arange(len(docs))
    order = np.lexsort((place, -score, question))
    question = question[order]
    begin = np.maximum.accumulate(np.where(np.append(True, question[1:] != question[:-1])[: len(question)], np.arange(len(question)), 0))
    rank = np.arange(len(question)) - begin + 1
    kept = rank <= k
    return question[kept], docs.take(pa.array(order[kept])), score[order[kept]], rank[kept].astype(np.int32)
