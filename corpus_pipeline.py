"""A corpus pipeline: quality, near duplicates, repeated passages, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the next one's
docs. All but the last return the columns of documents, and other columns of docs are ignored, whatever their names.

Every stage decides about rows, not ids: a repeated id or a null id loses no text but its own. Null text counts as empty.
Repeated passages and packing cast doc_id to long. An empty table passes through every stage as one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noetik.llm import lyndon_dedup, packing, quality_gbt, queries, tensor_minhash, winnow
from noetik.session import checkpoint_folder, discard, ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of quality 1 is at least LEAST_QUALITY."""
    ship(spark)
    docs = docs.select(*COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_gbt.learn(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0), "quality")
    return quality_gbt.score(docs, model).where(F.col("score") >= LEAST_QUALITY).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest id, then of the smallest hash of its text. Texts without
    words are in no group and stay. Where that id and text is in several rows, one of these stays."""
    ship(spark)
    docs = docs.select(*COLUMNS)
    found = tensor_minhash.near_duplicates(docs, shingle=5)
    wordless = found.where("n_shingles = 0").select("doc_id", "text_hash").distinct().withColumn("copies", F.lit(1))
    grouped = found.where("n_shingles > 0").groupBy("set_hash", "component_id", "doc_id", "text_hash").agg(F.count("*").alias("copies"))
    # a group without any id is known by its set alone
    group = F.when(F.col("component_id").isNull(), F.col("set_hash"))
    first = grouped.groupBy("component_id", group.alias("no_id")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "copies")).alias("r"))
    stays = first.select("r.doc_id", "r.text_hash", "r.copies").unionByName(wordless)
    stays = stays.select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h"), "copies")
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    kept = docs.join(stays, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")))
    once, again = kept.where("copies = 1"), kept.where("copies > 1")
    return once.unionByName(again.dropDuplicates(["doc_id", "text_hash"])).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the bytes that repeat; characters that a cut has split go too."""
    ship(spark)
    cut = lyndon_dedup.dedup(docs, carry=("lang", "source"), as_text=True)
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words benchmark passages cover less than a twentieth."""
    docs = docs.select(*COLUMNS)
    found = winnow.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(winnow.CONTAMINATED)
    gone = found.select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h")).distinct()
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")), "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their token ids."""
    ship(spark)
    return packing.pack_documents(docs, queries.vocabulary(), with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: SQL cannot express the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's table is in the shared folder and is deleted once the next is written;
    the last one's stays for whoever reads the result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            discard(spark, f"{folder}/{k - 1}")
    return docs
