"""The queries of this subpackage and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chunk_dedup, fair_mix, maxscore, near_dedup, ngram, packing, pii, pstable, quality, token_counts


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score(_documents(spark, sf_dir))


def op2_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_documents(spark, sf_dir))


def op3_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeated_passages(_documents(spark, sf_dir))


def op5_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rank_quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_trie_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op4_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), tokenizer_path())


def op6_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_inner(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pstable.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir))


def op9_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix.fair_mix(_documents(spark, sf_dir)).drop("copies")


_ALL = (op1_deleted_interpolation, op2_crf_pii, op3_gear_chunks, op4_best_two_fit, op5_bradley_terry, op6_maxscore, op7_multiprobe, op8_near_duplicates, op9_fair_mix, op10_trie_tokens)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op6_maxscore": maxscore.ORACLE_SQL, "op8_near_duplicates": near_dedup.ORACLE_SQL, "op9_fair_mix": fair_mix.ORACLE_SQL}
