"""The queries opN_<name> and the pipeline, each over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_folder, ship
from . import forced_split, html_consensus, lag_runs, license_index, lm_automaton, lyndon_dedup, oracles, packing, pivot_negatives, quality_gbt, spotsigs, tensor_minhash, wavelet, winnow


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_lm_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_automaton.train_and_score(_table(spark, sf_dir, "documents"), _fold(10) != 0)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_gbt.learn(docs, _table(spark, sf_dir, "labels").where(_fold(5) != 0), "quality")
    scored = quality_gbt.score(docs, model)
    return scored.select("doc_id", (_fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_folder(spark)}/tokens-{uuid.uuid4().hex}"
    wavelet.write(_table(spark, sf_dir, "documents"), path, vocabulary())
    return wavelet.read(spark, path)


def op4_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_consensus.main_text(_table(spark, sf_dir, "pages"))


def op5_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited(_table(spark, sf_dir, "documents"))


def op6_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.digest(winnow.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op7_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_index.scan(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary())


def op9_tensor_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor_minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4).select("doc_id", "n_shingles", "component_id", "kept")


def op10_lyndon_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lyndon_dedup.dedup(_table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


def op11_forced_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = forced_split.encode(_table(spark, sf_dir, "documents"), vocabulary(), decoded=True)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_lag_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lag_runs.digest(lag_runs.periodic(lag_runs.planted(_table(spark, sf_dir, "documents"))))


def op13_pivot_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_negatives.mine(pivot_negatives.scaled(_table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


def queries() -> dict:
    return {
        "op1_lm_automaton": op1_lm_automaton,
        "op2_quality_gbt": op2_quality_gbt,
        "op3_wavelet": op3_wavelet,
        "op4_html_consensus": op4_html_consensus,
        "op5_spotsigs": op5_spotsigs,
        "op6_winnow": op6_winnow,
        "op7_license_index": op7_license_index,
        "op8_packing": op8_packing,
        "op9_tensor_minhash": op9_tensor_minhash,
        "op10_lyndon_dedup": op10_lyndon_dedup,
        "op11_forced_split": op11_forced_split,
        "op12_lag_runs": op12_lag_runs,
        "op13_pivot_negatives": op13_pivot_negatives,
    }


def oracle_sql() -> dict[str, str]:
    """The other queries hold model scores, tokenizer ids or hashes that SQL has no function for."""
    return {"op6_winnow": winnow.ORACLE, "op9_tensor_minhash": oracles.NEAR_DUPLICATES, "op10_lyndon_dedup": oracles.REPEATED_BYTES, "op13_pivot_negatives": oracles.HARD_NEGATIVES}
