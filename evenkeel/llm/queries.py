"""The registered queries of the training-data operators, and their SQL where SQL can tell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few_files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pq import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import repaired

    return repaired(table(spark, sf_dir, "conversations"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    mix = mixed(table(spark, sf_dir, "documents"))
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return mix.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.col("spans.shard").alias("shards"), F.col("spans.shuffle_key").alias("shuffle_keys"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out, identify, learn

    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judged

    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hosts import judged, labelled_pages

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, labelled_pages(pages, table(spark, sf_dir, "labels")))


def op7_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ogg import digests

    return digests(table(spark, sf_dir, "documents"))


#: Shards of op8_sharding.
SHARDS = tuple(f"shard-{i:02d}" for i in range(32))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import placed

    return placed(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id", SHARDS)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import packed

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


#: Queries whose last stage only handles small rows: their results are in few files. The others' last stages
#: read texts or ids, and keep a task for each of their partitions.
SLIM = {"op1_pq", "op3_mixing", "op5_quality", "op9_minhash"}


def queries() -> dict:
    """Name -> query of (spark, sf_dir)."""
    own = {n: f for n, f in globals().items() if n.startswith("op") and n[2].isdigit()}
    return {n: (lambda spark, sf_dir, f=f: few_files(f(spark, sf_dir))) if n in SLIM else f for n, f in own.items()}


def oracle_sql() -> dict[str, str]:
    """The others hash, sample, compress or tokenise, which SQL can't; tests hold them against brute force."""
    from . import oracles, sharding

    return {"op1_pq": oracles.OP1, "op6_urls": oracles.op6(), "op8_sharding": oracles.op8(sharding.fill(SHARDS)), "op9_minhash": oracles.OP9}
