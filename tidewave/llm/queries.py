"""The registered queries of the operators in this package, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import ann, centroids, decontam, langid, lm_score, near_dedup, pii, quality, sp_encode, spelling, substring_dedup, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark, _table(spark, sf_dir, "pages"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(_table(spark, sf_dir, "documents"))


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lines and paragraphs that op2's operator removes beside long passages."""
    return substring_dedup.repeated_lines(_table(spark, sf_dir, "documents")).drop("text_hash")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_encode.encode(_table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), near_dedup.NearParams(shingle=2))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(_table(spark, sf_dir, "embeddings"))


def op12_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.language_model(_table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_substring_dedup, op3_toxicity, op4_personal_data, op5_sentencepiece, op6_nearest, op7_quality, op8_near_dedup, op9_decontamination, op10_language, op11_centroids, op12_language_model, op13_spelling, repeated_lines)}

ORACLE_SQL: dict[str, str] = {"op1_url_filter": url_filter.oracle_sql(), "op8_near_dedup": near_dedup.ORACLE_SQL, "op9_decontamination": decontam.ORACLE_SQL, "op11_centroids": centroids.oracle_sql(), "repeated_lines": substring_dedup.lines_sql()}
