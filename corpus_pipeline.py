"""documents -> quality classifier -> language ID -> near-dedup -> source mix -> packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evenkeel.llm import langid, minhash, mixing, packing, quality
from evenkeel.llm.common import free, made, materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling towards labelled clean documents; what it doesn't select goes."""
    return quality.filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Compression classification; documents it does not accept, without a language or by a narrow margin, go."""
    return langid.filtered(docs, langid.learn(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class linked at a similarity of 0.8 of five-word shingles stays."""
    return minhash.deduplicated(docs, k=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix of sources takes them; rows repeat."""
    return mixing.taken_whole(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of up to 4096 ids."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("packing", pack),
]

#: No SQL: hashing, sampling and tokenisation aren't expressible; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage needed goes once it is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), made()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        free(spark, docs, but=before)
    return docs
