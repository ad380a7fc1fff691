"""Near duplicates: MinHash with tensored banding, every link confirmed on full shingle sets.

A document's set holds the hashes of its distinct shingles. Two small collections U and V of M group keys each, a group
key being ROWS minima, give M * M table keys by pairing each U with each V, so 4 * M minima (ROWS 2) do the work of
2 * ROWS * M * M. Two documents of similarity s meet in some table with probability (1 - (1 - s**ROWS)**M)**2: 0.9994
at 0.8 and 0.999998 at 0.9.

Equal sets are one node. Table keys are formed only of those U and V keys that another node has too. Then:

1. Each table bucket is a star about its smallest and its largest node. Nodes go to blocks with the nodes of the same
   centre; a block holds each of its centres' sets once, and confirms links until its stars are connected.
2. Confirmed links give components, by label propagation with pointer jumping.
3. Buckets whose nodes are in different components are left. A link of x and y takes percent / (100 + percent) of the
   sum of their sizes in common, so a node is done if too few of its shingles occur in other components' nodes.
4. The rest that share a U key are compared in blocks, so no pair of candidates is lost and no pair is a row. Links
   found here join components, and only these are labelled again.

Labels, links and sets stay in executors. A hot bucket is spread over blocks in 1 and 4, and the shingles of its copies
are combined before the shuffle in 3.

Null text, or text without words: an empty set, linked with nothing. Fewer words than a shingle: the whole sequence is
one shingle. Repeated rows have equal sets, so they are in one component; each row is returned. Rows of one id with
different texts are in the components of their own texts. A null id is in the component of its text; a component with no
other id has a null component_id, and all its rows are kept. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .blocks import fresh, mix, trim

M, ROWS = 8, 2
#: Sets and shingles of a block of nodes, to which their centres come.
STAR_SETS, STAR_SHINGLES = 256, 1 << 18
#: Sets and shingles of each of two blocks whose sets are all compared.
BLOCK_SETS, BLOCK_SHINGLES = 512, 1 << 19
LENGTH = np.uint64(0x2545F4914F6CDD1D)
_seeds = mix(np.arange(1, 4 * M * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
XOR, ODD = _seeds[: 2 * M * ROWS, None], _seeds[2 * M * ROWS :, None] | np.uint64(1)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of size words, each given by its hash; all words if fewer."""
    if not len(words):
        return words
    k = min(size, len(words))
    with np.errstate(over="ignore"):
        h = np.full(len(words) - k + 1, np.uint64(k) * LENGTH)
        for j in range(k):
            h = mix(h * np.uint64(0xA0761D6478BD642F) + words[j : len(words) - k + 1 + j])
    return np.unique(h)


class Shingler:
    """Sets of batches of texts; equal words of a batch are hashed once."""

    def __init__(self, size: int):
        self.size = size

    def sets(self, texts: list[bytes]):
        known: dict[bytes, int] = {}
        for t in texts:
            words = t.lower().split()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            yield shingles(np.array([known[w] for w in words], np.uint64), self.size)
            if len(known) > 300_000:
                known.clear()


def group_keys(s: np.ndarray) -> np.ndarray:
    """2 * M keys of a set: first those of U, then those of V."""
    least = np.full(2 * M * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 4096):
            least = np.minimum(least, ((s[None, at : at + 4096] ^ XOR) * ODD).min(1))
        key = np.zeros(2 * M, np.uint64)
        for part in least.reshape(2 * M, ROWS).T:
            key = mix(key * np.uint64(0xA0761D6478BD642F) + part)
    return key


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_hash, keys of each row of docs (doc_id, text_hash, text)."""

    def rows(batches):
        fresh()
        shingler = Shingler(size)
        for b in batches:
            n, digest, keys = [], [], []
            for s in shingler.sets([t or b"" for t in b.column(2).cast(pa.binary()).to_pylist()]):
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                keys.append(group_keys(s).view(np.int64))
            made = [pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], ["doc_id", "text_hash", "n_shingles", "set_hash", "keys"])
        del shingler
        trim()

    return docs.mapInArrow(rows, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, n_shingles long, set_hash binary, keys array<long>")


def sets_of(docs: DataFrame, size: int) -> DataFrame:
    """node, s: the sets of docs (node, text)."""

    def rows(batches):
        fresh()
        shingler = Shingler(size)
        for b in batches:
            sets = [s.view(np.int64) for s in shingler.sets([t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "s"])
        del shingler
        trim()

    return docs.mapInArrow(rows, "node long, s array<long>")


def lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The cells of a column of lists of longs, as unsigned numbers."""
    out = []
    for c in column.chunks:
        flat, ends = c.values.to_numpy(zero_copy_only=False).view(np.uint64), c.offsets.to_numpy()
        out += [flat[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
    return out


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(x) < percent * len(y):
        return False
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


class Forest:
    """Roots of the classes that links have joined so far."""

    def __init__(self):
        self.root: dict = {}

    def top(self, c):
        root = self.root
        while (up := root.get(c, c)) != c:
            root[c] = c = root.get(up, up)
        return c

    def join(self, x, y) -> None:
        self.root[self.top(x)] = self.top(y)


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def star_links(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of stars (node, n, centres), links a, b that connect what the links of nodes with their centres connect in each
    block."""
    first = stars.withColumn("z", F.array_min("centres"))
    many = lambda n, m: F.ceil(F.greatest(n / STAR_SETS, m / STAR_SHINGLES)).cast("long")
    blocks = max(1, first.agg(many(F.count("*"), F.sum("n"))).first()[0] or 0)
    hot = first.groupBy("z").agg(many(F.count("*"), F.sum("n")).alias("parts")).where("parts > 1")
    own = F.xxhash64("z", F.pmod(F.xxhash64("node"), F.col("parts")))
    dealt = first.join(hot, "z", "left").withColumn("block", F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("z"), F.lit(blocks))).otherwise(own)).select("block", "node", "centres")
    members = dealt.join(sets, "node")
    centres = dealt.select("block", F.explode("centres").alias("node")).distinct().join(sets, "node").select("block", "node", F.lit(None).cast("array<long>").alias("centres"), "s")

    def confirm(table: pa.Table) -> pa.Table:
        nodes, around, own = table.column("node").to_pylist(), table.column("centres").to_pylist(), lists(table.column("s"))
        known = dict(zip(nodes, own, strict=True))
        forest, a, b = Forest(), [], []
        for x, s, some in zip(nodes, own, around, strict=True):
            for y in some or ():
                if forest.top(x) != forest.top(y) and linked(s, known[y], percent):
                    forest.join(x, y)
                    a.append(x), b.append(y)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=LINKS)

    return members.select("block", "node", "centres", "s").unionByName(centres).groupBy("block").applyInArrow(confirm, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of every id in links (a, b)."""
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(links.select(F.inline(ends)).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("m"))
        hooked = labels.join(near, labels.id == near.a).select("id", F.least("component", "m").alias("c"), F.col("component").alias("old"))
        jump = labels.select(F.col("id").alias("c"), F.col("component").alias("cc"))
        new = cut(hooked.join(jump, "c", "left").select("id", F.least("c", F.coalesce("cc", "c")).alias("component"), "old"))
        done = new.where("component != old").isEmpty()
        labels = new.select("id", "component")
        if done:
            return labels


def links_between(sets: list[np.ndarray], label: list, block: np.ndarray, outside: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join different labels, as a forest: places of sets of one block, or of one and the other block, of
    which one at least is outside the largest component."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, shingle, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(shingle, kind="stable")
    posting, start = owner[order], np.append(0, np.cumsum(many))
    # frequent shingles as columns of a matrix, rare ones by their postings
    common = np.zeros((len(sets), len(sets)), np.float32)
    frequent = np.flatnonzero(many > 16)
    for at in range(0, len(frequent), 2048):
        part = frequent[at : at + 2048]
        column = np.full(len(many), -1)
        column[part] = np.arange(len(part))
        here = column[shingle] >= 0
        has = np.zeros((len(sets), len(part)), np.float32)
        has[owner[here], column[shingle[here]]] = 1
        common += has @ has.T
    for n in range(2, 17):
        found = np.flatnonzero(many == n)
        if len(found):
            who = posting[start[found][:, None] + np.arange(n)]
            for j in range(n):
                np.add.at(common, (who[:, j : j + 1], who), 1)
    alike = 100 * common.astype(np.int64) >= percent * (size[:, None] + size[None] - common.astype(np.int64))
    alike &= (outside[:, None] | outside[None]) & ((block[:, None] != block[None]) | (block.max() == block.min()))
    forest, out = Forest(), []
    for x, y in zip(*map(np.ndarray.tolist, np.nonzero(np.triu(alike, 1))), strict=True):
        if forest.top(label[x]) != forest.top(label[y]):
            forest.join(label[x], label[y])
            out.append((x, y))
    return out


def possible(mixed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the nodes (node, n, c, us) that may have a link with a node of another component: enough of their
    shingles occur there, counted against the smallest node that shares a U key."""
    each = mixed.join(sets, "node").select("node", "c", F.explode("s").alias("g"))
    there = each.groupBy("g").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("g")
    shared = each.join(there, "g", "left_semi").groupBy("node").agg(F.count("*").alias("common"))
    likely = mixed.join(shared, "node").where((100 + percent) * F.col("common") >= percent * (F.col("n") + F.ceil(F.col("n") * percent / 100)))
    rows = cut(likely.select("node", "n", "c", "common", F.explode("us").alias("u")))
    least = rows.groupBy("u").agg(F.min("n").alias("least"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1")
    return rows.join(least, "u").where((100 + percent) * F.col("common") >= percent * (F.col("n") + F.col("least"))).select("node", "n", "c", "u")


def crossing(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between nodes of rows (node, n, c, u) that share a key u of U and are in different components c.

    The group of a U key is dealt into blocks by hash, those outside its largest component apart from the rest, and
    each pair of blocks with a block outside is one task's matrix of intersections. So no pair of nodes is a row, a
    hot group is spread over tasks, and a node's set is sent once for each block of its group.
    """
    parts = rows.groupBy("u", "c").agg(F.count("*").alias("k"), F.sum("n").alias("m"))
    whole = parts.groupBy("u").agg(F.max(F.struct("k", "c", "m")).alias("most"), F.sum("k").alias("sk"), F.sum("m").alias("sm"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1")
    many = lambda n, m: F.greatest(F.ceil(n / BLOCK_SETS), F.ceil(m / BLOCK_SHINGLES)).cast("int")
    whole = whole.select("u", F.col("most.c").alias("largest"), many(F.col("sk") - F.col("most.k"), F.col("sm") - F.col("most.m")).alias("apart"), many(F.col("most.k"), F.col("most.m")).alias("rest"))
    dealt = rows.join(whole, "u").withColumn("outside", F.col("c") != F.col("largest"))
    hashed = F.xxhash64("node", "u")
    dealt = dealt.withColumn("block", F.when(F.col("outside"), F.pmod(hashed, "apart")).otherwise(F.col("apart") + F.pmod(hashed, "rest")).cast("int"))
    others = F.sequence(F.lit(0), F.when(F.col("outside"), F.col("apart") + F.col("rest")).otherwise(F.col("apart")) - 1)
    sent = dealt.join(sets, "node").select("node", "c", "u", "outside", "block", "s", F.explode(others).alias("other"))
    sent = sent.select("node", "c", "u", "outside", "block", "s", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))

    def compare(table: pa.Table) -> pa.Table:
        nodes, own = table.column("node").to_pylist(), lists(table.column("s"))
        found = links_between(own, table.column("c").to_pylist(), table.column("block").to_numpy(), table.column("outside").to_numpy(), percent)
        return pa.table([pa.array([nodes[x] for x, _ in found], pa.int64()), pa.array([nodes[y] for _, y in found], pa.int64())], schema=LINKS)

    return sent.groupBy("u", "p", "q").applyInArrow(compare, "a long, b long").distinct()


def labelled(nodes: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """nodes with a column c: the label of each one's column, or that itself."""
    return nodes.join(labels.select(F.col("id").alias(column), "component"), column, "left").withColumn("c", F.coalesce("component", column)).drop("component")


def classes(nodes: DataFrame, own: DataFrame, shingle: int, percent: int) -> DataFrame:
    """node, component (both nodes) of those nodes (node, n, keys, doc_id, text_hash) that are linked with another."""
    groups = nodes.select("node", F.posexplode("keys").alias("place", "key")).select("node", (F.col("place") < M).alias("first"), F.xxhash64("place", "key").alias("g"))
    met = groups.groupBy("g").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("g")
    of = lambda side: F.collect_list(F.when(side, F.col("g")))
    kept = groups.join(met, "g", "left_semi").groupBy("node").agg(of(F.col("first")).alias("us"), of(~F.col("first")).alias("vs")).where("size(us) > 0 and size(vs) > 0")
    meeting = cut(nodes.select("node", "n", "doc_id", "text_hash").join(kept, "node"))
    keys = F.explode(F.flatten(F.transform("us", lambda u: F.transform("vs", lambda v: F.xxhash64(u, v))))).alias("key")
    entries = meeting.select("node", keys)
    buckets = entries.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    stars = entries.join(buckets, "key").groupBy("node").agg(F.collect_set("low").alias("lows"), F.collect_set("high").alias("highs"))
    # of two centres of one bucket, the larger has the smaller one
    ends = F.array_union(F.filter("lows", lambda x: x < F.col("node")), F.filter("highs", lambda x: x > F.col("node")))
    stars = cut(stars.select("node", ends.alias("centres")).join(meeting, "node").select("node", "n", "centres", "doc_id", "text_hash"))
    texts = own.join(stars.select("node", F.col("doc_id").alias("i"), F.col("text_hash").alias("h")), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")))
    sets = cut(sets_of(texts.select("node", "text"), shingle))
    labels = components(star_links(stars.select("node", "n", "centres"), sets, percent))
    now = cut(labelled(meeting.select("node", "n", "us", "vs"), labels, "node"))
    mixed = now.select("c", keys).groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("key")
    left = now.select("node", keys).join(mixed, "key", "left_semi").select("node").distinct()
    rows = cut(possible(now.join(left, "node", "left_semi").select("node", "n", "c", "us"), sets, percent))
    if rows.isEmpty():
        return labels.select(F.col("id").alias("node"), "component")
    found = crossing(rows, sets, percent)
    of_nodes = rows.select(F.col("node").alias("a"), F.col("c").alias("ca")).distinct()
    joins = found.join(of_nodes, "a").join(of_nodes.select(F.col("a").alias("b"), F.col("ca").alias("cb")), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    return labelled(now.select("node", F.col("c").alias("before")), components(joins), "before").select("node", F.col("c").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash (xxhash64 of the text) and set_hash of every row
    of docs."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    signed = cut(signatures(own, shingle)).withColumn("node", F.expr("cast(conv(hex(substring(set_hash, 1, 8)), 16, -10) as long)"))
    one = F.min(F.struct("doc_id", "text_hash"))
    nodes = signed.where("n_shingles > 0").groupBy("node").agg(one.alias("r"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.min("doc_id").alias("least"))
    nodes = cut(nodes.select("node", "n", "keys", "r.doc_id", "r.text_hash", "least"))
    of = nodes.select("node", "least").join(classes(nodes, own, shingle, percent), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = of.join(of.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component_id")
    out = signed.where("n_shingles > 0").join(named, "node").unionByName(signed.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash", "set_hash")
