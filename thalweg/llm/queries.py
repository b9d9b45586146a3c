"""Queries of the training-data operators over the shared tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.llm import alignment, archives, bytebpe, covertree, decontam, gam, katz, lexicon, linededup, packing, pivots, secrets, simhash
from thalweg.llm.common import held_out


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(_read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.search(_read(spark, sf_dir, "embeddings"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(_read(spark, sf_dir, "documents"))


def op8_archive_converter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.round_trip(_read(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = gam.train_quality(docs, _read(spark, sf_dir, "labels"))
    return gam.quality(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = lexicon.train_toxicity(docs, _read(spark, sf_dir, "labels"))
    return lexicon.toxicity(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return pivots.hard_negatives(_read(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digests(_read(spark, sf_dir, "documents"), public_vocabulary("byte_bpe_50k.json"), public_vocabulary("piece_bpe_32k.model"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.digests(_read(spark, sf_dir, "documents"), public_vocabulary("byte_bpe_multi_50k.tiktoken"))


QUERIES = {
    "op1_katz_scores": op1_katz_scores,
    "op2_line_dedup": op2_line_dedup,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_secret_scan": op4_secret_scan,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_archive_converter": op8_archive_converter,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_alignment": op12_alignment,
    "op13_byte_bpe": op13_byte_bpe,
}

#: Only where DuckDB SQL gives the same rows; the others are held against brute force in tests.
ORACLES: dict[str, str] = {
    "op2_line_dedup": linededup.ORACLE,
    "op3_exact_top_k": covertree.ORACLE,
    "op8_archive_converter": archives.ORACLE,
    "op11_hard_negatives": pivots.ORACLE,
}
