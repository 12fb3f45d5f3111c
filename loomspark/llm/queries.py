"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import fingerprint, licenses, minhash, mixing, packing, ppm, quality, rans, suffix_dedup, urlfilter
from loomspark.llm.sql import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.pack(packing.token_pieces(docs, tokenizer_path("word_bpe_49k.json")))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    files = rans.write_token_files(docs, tokenizer_path("byte_bpe_50k.json"))
    return rans.read_token_files(spark, files)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup.remove_repeats(docs)
    return out.select(F.col("_row._0").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urlfilter.url_verdicts(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(_table(spark, sf_dir, "documents"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_fingerprints(_table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(_table(spark, sf_dir, "documents"), rows=False)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.line_first_quality(docs)
    names = [c.split()[0] for c in quality.COLUMNS.split(", ")]
    return out.select(F.col("_row._0").alias("doc_id"), *[n for n in names if n != "cleaned"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_minhash_near_dedup": op2_minhash_near_dedup,
        "op4_token_files": op4_token_files,
        "op5_suffix_array_dedup": op5_suffix_array_dedup,
        "op3_url_filters": op3_url_filters,
        "op6_license_scans": op6_license_scans,
        "op7_lm_scoring": op7_lm_scoring,
        "op9_document_fingerprints": op9_document_fingerprints,
        "op8_mix_sources": op8_mix_sources,
        "op10_quality_rules": op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
