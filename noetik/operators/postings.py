"""A stored full-text index: positional postings in blocks with bounds, ranked search of many questions, phrases.

Documents are dealt to shards of about SHARD documents of like length. A row of the postings holds one term of one shard:
the documents, their number, their term counts, lengths and positions, and the bound of their scores: the largest count and
the smallest length. No group is larger than a shard, so a term that every document holds is no hot key. Rows are stored by
parts of whole shards, whose number follows the counted size, and sorted by term in each; documents go to their shard as
one string of their tokens, so no token is a row or an item of a shuffled array.

A ranked search of many questions deals shards to blocks of about BLOCK tokens and chunks of CHUNK questions to turns of about
RESULTS results. A task adds up all scores of a turn in a block, on arrays, and gives the first k of each question; the
lists of a chunk are arrays of one row, and are merged at once. Questions times documents are not rows; what is shuffled is
the postings of asked terms once a turn, the numbers of the questions' terms once a block, and the lists. Texts are not
read at all. `report` tells what bounds would leave out: shards whose bound is below the k-th best score of the
shards of the highest bounds hold nothing that enters the first k.

The index lies in segments (see segments.py): a change writes postings of the changed documents, their keys, and the
differences of the document counts of terms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import spaced, tokens
from ..session import cut, discard, ship, written
from .inverted import Block, invert, merged
from .segments import Segments

K1, B = 1.2, 0.75
SHARD = 128  # documents
PART = 2_000_000  # tokens of a part
LEAST_PARTS, MOST_PARTS = 8, 4096
BLOCK = 16_000_000  # tokens of a block of shards
LEAST_BLOCKS = 16
RESULTS = 10_000_000  # of a block and turn
CHUNK = 256  # questions that are dealt and merged at once
DEALS = 1024  # groups in which terms are numbered
SEEDS = 2  # shards of a question that are scored to find its threshold
SLACK = 1e-5  # of scores, against the order of additions
MOST_GONE = 1_000_000  # replaced or deleted documents that are broadcast
MOST_KNOWN = 1_000_000  # tokens of phrases, or half as many of questions, that are broadcast
PROBES = 3  # tokens of a phrase that are met by position before strings are compared


def part_of(parts: int) -> Column:
    return F.pmod(F.xxhash64("shard"), F.lit(parts)).cast("int")


def weight(tf: Column, dl: Column, mean: Column) -> Column:
    """The score of a term without its rarity."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


class PostingsIndex(Segments):
    """Documents by doc. Ids are unique and never null."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, ["doc"])

    def of(self, segment: str, name: str = "rows") -> DataFrame:
        """A segment's table; one that only deletes has no postings, so their shape is given."""
        if name != "postings":
            return super().of(segment, name)
        kind = super().of(segment, "keys").schema["doc"].dataType.simpleString()
        shape = f"shard long, term string, docs array<{kind}>, tfs array<int>, dls array<int>, places array<array<int>>, n int, most int, least int, part int"
        return self.spark.read.schema(shape).parquet(self.folder(segment, name))

    # writing

    def update(self, docs: DataFrame, id_col: str = "doc", text: Column | None = None, deleted: DataFrame | None = None) -> dict:
        """Add documents or replace those of the same id; deleted: ids (doc) that go. A null text has no tokens."""
        base = self.version()
        docs = docs.select(F.col(id_col).alias("doc"), (F.col("text") if text is None else text).alias("text"))
        self.check(docs)
        words = docs.select("doc", F.coalesce(spaced(F.col("text")), F.lit("")).alias("w"))
        spaces = F.octet_length("w") - F.octet_length(F.replace("w", F.lit(" "), F.lit("")))
        read, cut_up = written(words.withColumn("dl", F.when(F.col("w") == "", 0).otherwise(spaces + 1)))
        # documents of like length have bounds near their scores
        classes = read.select(F.floor(F.log2(F.col("dl") + 1) * 4).cast("int").alias("class"), "dl").groupBy("class").agg(F.count("*").alias("n"), F.sum("dl").alias("length")).collect()  # some dozens of rows
        begin = first = base.get("shards", 0)
        shards, shard = {}, F.lit(begin)
        for r in sorted(classes, key=lambda r: r["class"]):
            shards[r["class"]] = (first, -(-r.n // SHARD))
            first += shards[r["class"]][1]
        number = F.floor(F.log2(F.col("dl") + 1) * 4).cast("int")
        for c, (least, many) in shards.items():
            shard = F.when(number == c, F.lit(least) + F.pmod(F.xxhash64("doc"), F.lit(many))).otherwise(shard)
        total = sum(r.length for r in classes)
        parts = min(MOST_PARTS, max(LEAST_PARTS, -(-total // PART)))
        read = read.withColumn("shard", shard.cast("long"))
        name = self.store(read.select("doc", "dl", "shard"), deleted)
        # one shuffle by part serves the shards and the files
        ship(self.spark)
        kind = read.schema["doc"].dataType.simpleString()
        dealt = read.where("dl > 0").select(part_of(parts).alias("part"), "shard", "doc", "dl", "w").repartition(parts, "part")
        rows = dealt.groupBy("part", "shard").applyInArrow(lambda t: invert(t), f"part int, shard long, term string, docs array<{kind}>, tfs array<int>, dls array<int>, places array<array<int>>, n int, most int, least int")
        rows.sortWithinPartitions("part", "term", "shard").write.option("compression", "zstd").partitionBy("part").parquet(self.folder(name, "postings"))
        discard(self.spark, cut_up)
        own = self.of(name, "postings").select("term", F.col("n").alias("df"))
        killed, gone = None, (0, 0)
        if base["segments"]:
            before = self.live(self.table(base), base).join(self.of(name, "keys").select("doc"), "doc", "left_semi")
            gone = before.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
            lists = before.groupBy("seg", "shard").agg(F.collect_list("doc").alias("gone"))
            lists = F.broadcast(lists) if gone[0] <= MOST_GONE else lists
            held = self.table(base, "postings").select("seg", "shard", "term", "docs").join(lists, ["seg", "shard"])
            killed = held.select("term", (-F.size(F.filter("docs", lambda x: F.array_contains("gone", x)))).alias("df")).where("df <> 0")
        counts = own if killed is None else own.unionByName(killed)
        counts.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0").write.parquet(self.folder(name, "counts"))
        n, length = base.get("n", 0) - gone[0] + sum(r.n for r in classes), base.get("length", 0) - gone[1] + total
        return self.commit(base, [*base["segments"], name], n=int(n), length=int(length), shards=first)

    def compact(self) -> dict:
        """All segments' live postings as one. Shards keep the documents that they have left."""
        base = self.version()
        name = self.store(self.live(self.table(base), base).drop("seg"))
        each = self.live_rows(self.table(base, "postings").select("seg", "shard", "term", "docs", "tfs", "dls", "places"), base).drop("seg")
        parts = min(MOST_PARTS, max(LEAST_PARTS, -(-base.get("length", 0) // PART)))
        each = each.withColumn("part", part_of(parts)).withColumn("n", F.size("docs")).withColumn("most", F.array_max("tfs")).withColumn("least", F.array_min("dls")).repartition(parts, "part")
        each.sortWithinPartitions("part", "term", "shard").write.option("compression", "zstd").partitionBy("part").parquet(self.folder(name, "postings"))
        self.of(name, "postings").groupBy("term").agg(F.sum("n").alias("df")).write.parquet(self.folder(name, "counts"))
        return self.commit(base, [name], **{k: base[k] for k in ("n", "length", "shards")})

    # reading

    def postings(self, version: dict | None = None) -> DataFrame:
        """term, doc, tf of live documents."""
        version = version or self.version()
        each = self.live_rows(self.table(version, "postings").select("seg", "shard", "term", "docs", "tfs"), version)
        return each.select("term", F.explode(F.arrays_zip("docs", "tfs")).alias("r")).select("term", F.col("r.docs").alias("doc"), F.col("r.tfs").cast("long").alias("tf"))

    def live_rows(self, rows: DataFrame, version: dict) -> DataFrame:
        """Postings (seg, shard, term, docs and more arrays beside it) without dead documents, and without rows of dead ones
        only. The dead of a shard are at most its documents and are met by shard, so no document is a row."""
        if self.dead(version) is None:
            return rows
        stored = self.table(version).select("seg", "shard", "doc")
        gone = stored.join(self.live(stored, version), ["seg", "doc"], "left_anti").groupBy("seg", "shard").agg(F.collect_list("doc").alias("gone"))
        arrays = [c for c in rows.columns if c not in ("seg", "shard", "term")]
        left = F.filter(F.arrays_zip(*arrays), lambda x: ~F.array_contains("gone", x["docs"]))
        met = rows.join(gone, ["seg", "shard"], "left").withColumn("left", F.when(F.col("gone").isNotNull(), left))
        met = met.where("left is null or size(left) > 0")
        return met.select("seg", "shard", "term", *(F.when(F.col("left").isNull(), F.col(c)).otherwise(F.col(f"left.{c}")).alias(c) for c in arrays))

    def document_counts(self, version: dict | None = None, words: list[str] | None = None) -> DataFrame:
        """term, df; with words of these only, which reaches the scan."""
        counts = self.table(version or self.version(), "counts")
        counts = counts if words is None else counts.where(F.col("term").isin(words))
        return counts.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def digest(self, version: dict | None = None) -> tuple[int, int]:
        """Rows and an order-free digest of the live postings."""
        got = self.postings(version).agg(F.count("*"), F.sum(F.xxhash64("term", "doc", "tf").cast("decimal(38,0)"))).first()
        return got[0], int(got[1] or 0)

    def asked(self, questions: DataFrame, version: dict) -> DataFrame:
        """qid, term, idf of the distinct terms of questions (qid, text) that documents hold."""
        terms = questions.select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
        return terms.join(self.document_counts(version), "term").select("qid", "term", self.rarity(version).alias("idf"))

    def rarity(self, version: dict) -> Column:
        return F.log(1 + (F.lit(version["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))

    def mean(self, version: dict) -> Column:
        return F.lit(version["length"] / max(version["n"], 1))

    def bounds(self, asked: DataFrame, version: dict) -> DataFrame:
        """qid, seg, shard, bound, blocks: for each question and shard the greatest score that its terms allow, and how
        many rows of postings they have. A frequent term's rows are dealt by shard too."""
        salts = max(1, min(64, version["shards"] // 256))
        heads = self.table(version, "postings").select("seg", "shard", "term", "most", "least").withColumn("salt", F.pmod(F.col("shard"), F.lit(salts)).cast("int"))
        side = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))) if salts > 1 else asked.withColumn("salt", F.lit(0))
        met = heads.join(side, ["term", "salt"])
        bound = F.sum(F.col("idf") * weight(F.col("most"), F.col("least"), self.mean(version)))
        return met.groupBy("qid", "seg", "shard").agg(bound.alias("bound"), F.count("*").alias("blocks"))

    def scored(self, wanted: DataFrame, asked: DataFrame, version: dict) -> DataFrame:
        """qid, doc, score of the documents in the wanted shards (qid, seg, shard) that hold a term of the question."""
        posted = self.table(version, "postings").select("seg", "shard", "term", "docs", "tfs", "dls")
        return self.summed(posted.join(wanted.join(asked, "qid"), ["seg", "shard", "term"]), version)

    def summed(self, met: DataFrame, version: dict) -> DataFrame:
        each = met.select("qid", "seg", "idf", F.explode(F.arrays_zip("docs", "tfs", "dls")).alias("r"))
        part = (F.col("idf") * weight(F.col("r.tfs"), F.col("r.dls"), self.mean(version))).alias("part")
        each = self.live(each.select("qid", "seg", F.col("r.docs").alias("doc"), part), version)
        return each.groupBy("qid", "doc").agg(F.round(F.sum("part"), 6).alias("score"))

    def scores(self, words: list[str], number: int | None = None) -> DataFrame:
        """doc, score of every document that holds one of the words (tokens)."""
        version = self.version(number)
        asked = self.document_counts(version, words).select(F.lit(0).alias("qid"), "term", self.rarity(version).alias("idf"))
        posted = self.table(version, "postings").where(F.col("term").isin(words)).select("seg", "term", "docs", "tfs", "dls")
        return self.summed(posted.join(F.broadcast(asked), "term"), version).select("doc", "score")  # a row for each word

    def top(self, questions: DataFrame, k: int = 10, number: int | None = None, report: bool = False) -> DataFrame:
        """qid, doc, score, rank: the first k documents of each question (qid, text), ties by doc. A question none of
        whose terms any document holds has no row. With report: qid, shards, read_shards, blocks, read_blocks instead."""
        version = self.version(number)
        n = questions.count()
        terms, chunks = self.chunks(questions, n, version)
        terms = F.broadcast(terms) if terms.count() <= MOST_KNOWN // 2 else terms  # else postings would be shuffled by term too
        kinds = dict(chunks.dtypes) | dict(self.table(version).dtypes)
        qid, doc = kinds["qids"][len("array<") : -1], kinds["doc"]
        mean, slack = version["length"] / max(version["n"], 1), SLACK
        lists = lambda of: f"chunk long, sizes array<int>, docs array<{of}>, scores array<double>"
        posted = self.live_rows(self.table(version, "postings").select("seg", "shard", "term", "docs", "tfs", "dls"), version).join(terms, "term")
        if not report:
            found = self.in_blocks(posted, chunks, n * k, version, lambda block, some: block.first(some, k, 6, slack), mean, lists(doc))

            def rows(f, c):
                qids = c["qids"].combine_chunks().flatten()
                question, docs, score, rank = merged(f, len(qids), k)
                return pa.table({"qid": qids.take(pa.array(question)), "doc": docs, "score": score, "rank": rank})

            return self.by_chunk(found, chunks.select("chunk", "qids"), rows, f"qid {qid}, doc {doc}, score double, rank int")
        heads = self.table(version, "postings").join(terms, "term").select("shard", "t", "idf", F.array("shard").alias("docs"), F.array("most").alias("tfs"), F.array("least").alias("dls"))
        highest = self.in_blocks(heads, chunks, n * SEEDS, version, lambda block, some: block.first(some, SEEDS, None, slack), mean, lists("long"))

        def seeds(f, c):
            many = len(c["ts"].combine_chunks().flatten())
            question, docs, _, _ = merged(f, many, SEEDS)
            each = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(question, minlength=many))), pa.int32()), docs)
            return c.append_column("seeds", pa.ListArray.from_arrays(pa.array([0, many], pa.int32()), each))

        shape = f"chunk long, qids {kinds['qids']}, ts {kinds['ts']}, seeds array<array<long>>"
        seeded, _ = written(self.by_chunk(highest, chunks, seeds, shape))
        near = self.in_blocks(posted, seeded, n * k, version, lambda block, some: block.first(some, k, 6, slack), mean, lists(doc))

        def least(f, c):
            many = len(c["ts"].combine_chunks().flatten())
            question, _, score, rank = merged(f, many, k)
            out = np.full(many, np.nan)
            out[question[rank == k]] = score[rank == k]
            return c.append_column("least", pa.ListArray.from_arrays(pa.array([0, many], pa.int32()), pa.array(out)))

        tested, _ = written(self.by_chunk(near, seeded, least, f"{shape}, least array<double>"))
        each = self.in_blocks(heads, tested, n, version, lambda block, some: block.counted(some, slack), mean, "chunk long, counts array<long>")
        counts = ("shards", "read_shards", "blocks", "read_blocks")

        def totals(f, c):
            qids = c["qids"].combine_chunks().flatten()
            got = f["counts"].combine_chunks().flatten().to_numpy().reshape(-1, len(qids), 4).sum(axis=0)
            met = np.flatnonzero(got[:, 0])
            return pa.table({"qid": qids.take(pa.array(met))} | {x: got[met, j] for j, x in enumerate(counts)})

        return self.by_chunk(each, chunks.select("chunk", "qids"), totals, f"qid {qid}, " + ", ".join(f"{x} long" for x in counts))

    def chunks(self, questions: DataFrame, n: int, version: dict) -> tuple[DataFrame, DataFrame]:
        """The terms (term, t, idf) of n questions that documents hold, and the questions in chunks: chunk, qids, ts (of each the
        numbers of its terms). What goes to every block is a chunk's numbers, and qids stay behind."""
        words = questions.select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
        known = words.select("term").distinct().join(self.document_counts(version), "term").withColumn("deal", F.pmod(F.xxhash64("term"), F.lit(DEALS)).cast("int"))
        number = F.row_number().over(Window.partitionBy("deal").orderBy("term")) * DEALS + F.col("deal")
        terms, _ = written(known.select("term", number.cast("int").alias("t"), self.rarity(version).alias("idf")))
        chunk = F.pmod(F.xxhash64("qid"), F.lit(max(1, -(-n // CHUNK)))).alias("chunk")
        each = words.join(terms.select("term", "t"), "term").select(chunk, "qid", "t").repartition("chunk").groupBy("chunk", "qid").agg(F.collect_list("t").alias("ts"))
        packed = each.groupBy("chunk").agg(F.collect_list(F.struct("qid", "ts")).alias("x")).select("chunk", F.col("x.qid").alias("qids"), F.col("x.ts").alias("ts"))
        return terms, written(packed)[0]

    def by_chunk(self, found: DataFrame, chunks: DataFrame, run, schema: str) -> DataFrame:
        """run(what blocks found of a chunk, the chunk) for each chunk."""
        return found.groupBy("chunk").cogroup(chunks.groupBy("chunk")).applyInArrow(lambda f, c: run(f, c), schema)

    def in_blocks(self, posted: DataFrame, chunks: DataFrame, results: int, version: dict, run, mean: float, schema: str) -> DataFrame:
        """run(block, chunks) over each block of shards and each turn of chunks, of so few that a block's results are about
        RESULTS. posted: shard, t, idf, docs, tfs, dls; chunks: chunk, ts and more, of which qids are not sent."""
        ship(self.spark)
        blocks = max(1, min(version["shards"], max(LEAST_BLOCKS, -(-version["length"] // BLOCK))))
        turns = max(1, -(-results // RESULTS))
        dealt = posted.select(F.pmod(F.xxhash64("shard"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"), "shard", "t", "idf", "docs", "tfs", "dls")
        turn = F.pmod("chunk", F.lit(turns)).cast("int").alias("turn")
        every = chunks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), turn, *(c for c in chunks.columns if c != "qids"))
        k1, b, shards = K1, B, "seeds" in chunks.columns

        def each(p, q):
            made = Block(p if q.num_rows else p.slice(0, 0), k1, b, mean, shards)
            return run(made, q if p.num_rows else q.slice(0, 0))

        return dealt.groupBy("block", "turn").cogroup(every.groupBy("block", "turn")).applyInArrow(each, schema)

    def phrases(self, phrases: DataFrame, docs: DataFrame | None = None, number: int | None = None) -> DataFrame:
        """pid, doc of the documents that hold a phrase (pid, p).

        Without docs a phrase is a sequence of whole tokens. With docs (doc, body) it is a string inside the body: the
        rarest tokens inside the phrase are met by position, and only documents in which they are get compared as strings.
        The rarest token gives the candidates, so that the postings of frequent ones are looked at for those only. A phrase of
        fewer than three tokens has none inside; its candidates come from the terms that hold its longest token, and from
        all bodies where it has no token."""
        version = self.version(number)
        edge = 0 if docs is None else 1
        w = phrases.select("pid", "p", tokens(F.col("p")).alias("w")).withColumn("size", F.size("w") - 2 * edge)
        own = w.where("size > 0").select("pid", "size", F.posexplode(F.slice("w", F.lit(1 + edge), F.col("size"))).alias("offset", "term"))
        known = cut(own.join(self.document_counts(version), "term", "left").withColumn("place", F.row_number().over(Window.partitionBy("pid").orderBy(F.coalesce("df", F.lit(0)), "offset"))))
        # with docs the rarest few are enough, as strings are compared after them
        probed = known if docs is None else known.where(F.col("place") <= PROBES)
        few = F.broadcast if known.count() <= MOST_KNOWN else (lambda df: df)
        rare = few(known.where("place = 1 and df > 0").select("pid", "term", "offset", "size"))
        posted = self.table(version, "postings").select("seg", "shard", "term", "docs", "places")
        each = posted.join(rare, "term").select("pid", "seg", "shard", "offset", "size", F.explode(F.arrays_zip("docs", "places")).alias("r"))
        each = each.select("pid", "seg", "shard", "size", F.col("r.docs").alias("doc"), F.explode("r.places").alias("at"), "offset")
        starts = self.live(each, version).select("pid", "seg", "shard", "doc", "size", (F.col("at") - F.col("offset")).alias("start")).where("start >= 0")
        starts = cut(starts)
        probes = probed.where("place > 1").select("pid", "term", "offset")
        others = starts.where("size > 1").join(few(probes), "pid")
        held = posted.join(few(probes.select("term").distinct()), "term", "left_semi")  # before postings are shuffled
        met = others.join(held, ["seg", "shard", "term"]).where(F.array_contains(F.get("places", (F.array_position("docs", F.col("doc")) - 1).cast("int")), F.col("start") + F.col("offset")))
        full = met.groupBy("pid", "doc", "start", "size").agg(F.count("*").alias("n")).where(F.col("n") == (F.col("size") if docs is None else F.least("size", F.lit(PROBES))) - 1)
        found = full.select("pid", "doc").unionByName(starts.where("size = 1").select("pid", "doc")).distinct()
        if docs is None:
            return found
        text = phrases.select("pid", "p")
        out = found.join(text, "pid").join(docs.select("doc", "body"), "doc").where(F.col("body").contains(F.col("p"))).select("pid", "doc")
        short = w.where("size <= 0")
        if short.isEmpty():
            return out
        longest = F.array_max(F.transform("w", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
        held = short.select("pid", "p", longest.alias("x"))
        # the dictionary of terms is compared with the few short phrases, as substrings have no key
        terms = held.where("x is not null").join(self.document_counts(version).select("term"), F.col("term").contains(F.col("x"))).select("pid", "p", "term")
        near = self.live(posted.join(terms, "term").select("pid", "p", "seg", F.explode("docs").alias("doc")), version).select("pid", "p", "doc").distinct()
        bare = held.where("x is null").select("pid", "p").join(docs.select("doc", "body"), F.col("body").contains(F.col("p"))).select("pid", "doc")
        near = near.join(docs.select("doc", "body"), "doc").where(F.col("body").contains(F.col("p"))).select("pid", "doc")
        return out.unionByName(near).unionByName(bare).distinct()

