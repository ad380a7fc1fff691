"""Periodic runs of words, by heavy and light lag counting.

A run is a stretch of words with smallest period q, of at least max(LEAST, TIMES * q) words, that no neighbouring word
extends. Words q apart match at lag q, so a run of n words is an island of n - q neighbouring matches.

Lags are taken by octaves [o, 2 * o), the words in blocks of o. For each block and lag of the octave the matches that
begin in the block are counted: a word that is frequent in the block by an exact FFT correlation of its places there
with its places ahead (the transforms of all frequent words of a block are summed before one goes back), a rare word by
the differences of its pairs of places. An island of a run has at least 3 * o matches and so fills two neighbouring
blocks: only these get a scan, which finds the island's ends within a block more on both sides.

A run of period d matches at each multiple of d too. Blocks that lie within such a match of a known run are struck out
before the scan. This loses no run: if a run of smallest period q held a match at lag q whose two words lie in a run of
period d, a divisor of q, then a whole period of it, and so all of it, would have period d. So every island that is
scanned is a run, and a text of one word repeated costs no more than others.

All texts of a batch are searched at once, one after the other with a word of its own behind each. An island across that
word has fewer than q matches.

Null text has no words. A null or repeated id, equal texts and other columns have no effect: one row out for each row in.
An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import fresh
from .forced_split import text_bytes

LEAST, TIMES = 6, 4  # a run has at least LEAST words, and TIMES * period
SHORTEST = 32  # octaves below it have only rare words
CELLS = 1 << 21  # of the places of frequent words that are transformed at a time
SPACES = " \t\n\x0b\x0c\r"


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of all texts as numbers, where each text's end, and the word of each number."""
    data, ends = text_bytes(texts)
    solid = np.ones(256, bool)
    solid[[ord(c) for c in SPACES]] = False
    inside = solid[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = np.append(0, ends)[:-1]
    heads = heads[heads < len(data)]
    begins[heads] = inside[heads]
    at = np.flatnonzero(begins)
    offsets = np.append(at, len(data)).astype(np.int32)
    # each word with what stands before the next one, which is then cut off from the distinct ones
    wide = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    narrow = pc.ascii_rtrim(wide.dictionary, characters=SPACES).dictionary_encode()
    return narrow.indices.to_numpy()[wide.indices.to_numpy()], np.searchsorted(at, ends), narrow.dictionary


def ranges(values: np.ndarray) -> np.ndarray:
    """Where each stretch of equal neighbours begins, and the length."""
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])


def frequent(counts: np.ndarray, seq: np.ndarray, place: np.ndarray, block: np.ndarray, heavy: np.ndarray, octave: int) -> None:
    """Add the matches of the words that are frequent in their block. place: all places, by word and then by place."""
    size = len(seq) + 3 * octave
    key = seq[place] * size + place
    edge = ranges(key[heavy] // size * size + block[heavy])
    first = np.flatnonzero(heavy)[edge[:-1]]
    many = np.diff(edge)
    rows = np.argsort(block[first], kind="stable")
    first, many = first[rows], many[rows]
    base, own = seq[place[first]] * size, block[first]
    low, high = (np.searchsorted(key, base + (own + k) * octave) for k in (1, 3))
    step = max(1, CELLS // (2 * octave))
    for i in range(0, len(first), step):
        part = slice(i, i + step)
        near, far = np.zeros((2, len(own[part]), 2 * octave))
        for table, begin, n, shift in ((near, first[part], many[part], 0), (far, low[part], (high - low)[part], 1)):
            row = np.repeat(np.arange(len(begin)), n)
            at = place[np.arange(len(row)) + np.repeat(begin - np.cumsum(n) + n, n)]
            table[row, at - (own[part][row] + shift) * octave] = 1
        product = np.conj(np.fft.rfft(near)) * np.fft.rfft(far)
        edge = ranges(own[part])[:-1]
        found = np.fft.irfft(np.add.reduceat(product, edge), 2 * octave)[:, :octave]
        counts[own[part][edge]] += np.rint(found).astype(counts.dtype)


def rare(counts: np.ndarray, seq: np.ndarray, place: np.ndarray, active: np.ndarray, octave: int) -> None:
    """Add the matches of words by the differences of their places: first to the next place, then to the one after it,
    and so on while these are less than two octaves ahead."""
    flat, ahead = counts.reshape(-1), 0
    while True:
        ahead += 1
        active = active[: np.searchsorted(active, len(place) - ahead)]
        here, there = place[active], place[active + ahead]
        lag = there - here
        near = (lag > 0) & (lag < 2 * octave) & (seq[here] == seq[there])
        active, here, lag = active[near], here[near], lag[near]
        if not len(active):
            return
        use = lag >= octave
        np.add.at(flat, here[use] // octave * octave + lag[use] - octave, 1)


def matches(seq: np.ndarray, place: np.ndarray, octave: int) -> np.ndarray:
    """For each block and lag of an octave, the matches of words at place (by word, then place) that begin in the block."""
    counts = np.zeros((-(-len(seq) // octave) + 1, octave), np.int32)
    if octave < SHORTEST:
        rare(counts, seq, place, np.arange(len(place)), octave)
        return counts
    block = place // octave
    edge = ranges(seq[place] * len(counts) + block)
    many = np.repeat(np.diff(edge), np.diff(edge))
    # a pair costs about as much as five steps of a transform
    heavy = 5 * many * many > octave * np.log2(2 * octave)
    rare(counts, seq, place, np.flatnonzero(~heavy), octave)
    if heavy.any():
        frequent(counts, seq, place, block, heavy, octave)
    return counts


def strike(full: np.ndarray, known: list[tuple[int, int, int]], octave: int) -> None:
    """Take out the blocks that match because they lie in a run whose period divides the lag."""
    for begin, end, period in known:
        lag = np.arange(-(-octave // period) * period, min(2 * octave, end - begin), period)
        block = np.arange(-(-begin // octave), (end - octave) // octave)
        if len(lag) and len(block):
            within = (block[:, None] + 1) * octave <= end - lag
            full[np.ix_(block, lag - octave)] &= ~within


def islands(seq: np.ndarray, full: np.ndarray, octave: int) -> Iterator[tuple[int, int, int]]:
    """Begin, end and period of each run, from the blocks that match in full."""
    lags, blocks = np.nonzero((full[:-1] & full[1:]).T)
    if not len(lags):
        return
    edge = ranges(lags * (len(full) + 1) + blocks - np.arange(len(lags)))
    for i, j in zip(edge[:-1].tolist(), (edge[1:] - 1).tolist(), strict=True):
        lag = octave + int(lags[i])
        low, high = max(0, (int(blocks[i]) - 1) * octave), min(len(seq) - lag, (int(blocks[j]) + 3) * octave)
        same = np.zeros(high - low + 2, np.int8)
        same[1:-1] = seq[low:high] == seq[low + lag : high + lag]
        change = np.flatnonzero(np.diff(same))
        for begin, end in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
            if end - begin >= max(LEAST, TIMES * lag) - lag:
                yield low + begin, low + end + lag, lag


def find(numbers: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The runs of texts whose words (as numbers) stand one after the other: text, start, length, period, in this order."""
    sizes = np.diff(ends, prepend=0)
    top = int(numbers.max(initial=-1)) + 1
    seq = np.empty(len(numbers) + len(ends), np.int64)
    text = np.repeat(np.arange(len(ends)), sizes + 1)
    border = ends + np.arange(len(ends))
    seq[border] = top + np.arange(len(ends))
    words = np.ones(len(seq), bool)
    words[border] = False
    seq[words] = numbers
    place = np.argsort(seq, kind="stable")[: len(numbers)]
    length, found, octave = sizes[text], [], 1
    while len(place := place[length[place] >= max(LEAST, TIMES * octave)]):
        full = matches(seq, place, octave) == octave
        strike(full, [r for r in found if r[1] - r[0] >= 3 * octave], octave)
        found += islands(seq, full, octave)
        octave *= 2
    out = np.array(found, np.int64).reshape(-1, 3)
    own = text[out[:, 0]]
    out = np.stack([own, out[:, 0] - np.append(0, border + 1)[own], out[:, 1] - out[:, 0], out[:, 2]], axis=1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def collapsed(numbers: np.ndarray, ends: np.ndarray, names: pa.Array, runs: np.ndarray) -> pa.Array:
    """Each text's words, without those that a run holds behind its first period, joined by single spaces."""
    begin = np.append(0, ends)[runs[:, 0]] + runs[:, 1]
    depth = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(depth, begin + runs[:, 3], 1)
    np.add.at(depth, begin + runs[:, 2], -1)
    stays = np.cumsum(depth)[:-1] == 0
    offsets = np.append(0, np.append(0, np.cumsum(stays))[ends]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(offsets, names.take(pa.array(numbers[stays]))), " ")


def periodic(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words long, runs array<struct<start, length, period: long>> by start and period (words from 0), collapsed
    string: the words that stay when each run keeps its first period only, joined by single spaces."""
    docs = docs.select(id_col, text_col)

    def run(batches):
        fresh()
        for b in batches:
            numbers, ends, names = words_of(b.column(1))
            runs = find(numbers, ends)
            offsets = np.searchsorted(runs[:, 0], np.arange(len(ends) + 1)).astype(np.int32)
            each = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
            out = [b.column(0), pa.array(np.diff(ends, prepend=0)), pa.ListArray.from_arrays(offsets, each), collapsed(numbers, ends, names, runs)]
            yield pa.RecordBatch.from_arrays(out, [id_col, "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.mapInArrow(run, f"`{id_col}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: where crc32(doc_id) ends in 0, the words from one of them on repeat with a period (the contract's rule)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    docs = docs.select("doc_id", "text", words.alias("words"), g.alias("g")).withColumn("n", F.size("words"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int")).withColumn("rest", F.col("n") - F.col("a"))
    docs = docs.withColumn("p", 1 + F.floor(F.col("rest") / (3 + F.col("g") % 8)).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(F.col("rest") / F.col("p")).cast("int")))
    tail = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), F.col("rest")))
    return docs.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(F.array_join(tail, " ")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of periodic()'s rows."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
