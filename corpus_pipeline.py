"""Documents to training sequences: quality, near-duplicates, personal data, source mix, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import near_dedup, packing, pii, quality
from pairloom.llm.fair_mix import fair_mix
from pairloom.llm.queries import tokenizer_path
from pairloom.llm.shared import WORD, durable

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the ranking, learnt from the labels beside the documents, scores at or above the cut.

    Null and empty texts score as texts without words; null ids, repeated rows and very long texts are scored like
    others; an empty table stays empty; columns beyond those of documents go.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ranked = quality.scored(docs, quality.learn(docs, labels))
    return ranked.where("_predicted = 1").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group: of the smallest id, then of the smallest digest of the other columns.

    Rows, not ids, are told apart: of rows that repeat an id with unlike texts each stays or goes with its own group, and
    identical rows stay once. Rows without an id take part by one beyond all others, made of their text, so they
    give way to rows with one. Rows without a word (null, empty or blank text) are in no group and all stay.
    """
    top = max(docs.agg(F.max("doc_id")).first()[0] or 0, 0)
    made = F.lit(top + 1) + F.pmod(F.xxhash64("text"), F.lit(2**63 - 1 - top))
    word = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    named = docs.select(*COLUMNS, F.coalesce("doc_id", made).alias("_id"), F.xxhash64(*COLUMNS).alias("_mark"))
    groups = near_dedup.grouped(named.where(word), id_col="_id", mark=F.col("_mark"))
    first = groups.groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("m")).select(F.col("m.doc_id").alias("_id"), F.col("m.mark").alias("_mark"))
    chosen = named.where(word).join(first, ["_id", "_mark"], "left_semi").dropDuplicates(["_id", "_mark"])
    return chosen.select(*COLUMNS).union(docs.where(~word).select(*COLUMNS))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by tags; n_chars follows the new text.

    Every row stays, repeated ones and those without an id too. A null text stays null with its n_chars; an empty one
    stays empty; whole texts are read, however long.
    """
    length = F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", length).select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it, at most three times; those it does not take go.

    Rows without a word have size 0, so the mix never takes them; null sources are one source, null ids and repeated
    rows are documents of their own; an empty table stays empty.
    """
    mix = fair_mix(docs, keep=("text", "lang", "source", "n_chars")).where("copies > 0")
    return mix.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids: where each piece of each document lies.

    A null or empty text is its end id alone; null ids and repeated rows are packed one by one; only texts longer than
    a sequence are cut; an empty table gives no pieces.
    """
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("personal_data", without_personal_data),
    ("mix", mixed_sources),
    ("packing", packed),
]

#: Trained models and set similarity are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each on what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
