"""Generators of skewed tables, reproducible from a seed and partitioned like any range."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import skewed_key, uniform, uniform_key


def table(spark: SparkSession, rows: int, factor: float, keys: int | None = None, nodes: int = 1, payload: int = 0, seed: int = 0) -> DataFrame:
    """(seq, sender, key, value): Zipf or uniform keys, dealt to nodes in unequal parts."""
    out = spark.range(rows).select(F.col("id").alias("seq"))
    out = out.withColumn("key", skewed_key(F.col("seq"), keys or rows, factor, seed).cast("string"))
    return out.withColumn("sender", unequal_node("seq", rows, nodes, seed)).withColumn("value", payload_of("seq", payload)).select("seq", "sender", "key", "value")


def unequal_node(seq: str, rows: int, nodes: int, seed: int = 0):
    """Runs of rows for nodes in random lengths of up to half of what is left, the last node taking the rest."""
    draw, node, end = random.Random(seed), F.lit(nodes - 1), 0
    ends = []
    for _ in range(nodes - 1):
        end += draw.randint(0, (rows - end) // 2)
        ends.append(end)
    for i in reversed(range(nodes - 1)):
        node = F.when(F.col(seq) < ends[i], i).otherwise(node)
    return node.cast("int")


def payload_of(seq: str, length: int):
    """A value of ``length`` characters; the row's number if 0."""
    return F.rpad(F.md5(F.col(seq).cast("string").cast("binary")), length, "x") if length else F.col(seq).cast("string")


def ten_hot_keys(spark: SparkSession, rows: int, share: float, domain: int = 10_000_000, first: int = 222_320, seed: int = 0) -> DataFrame:
    """(seq, key): ``share`` of the rows hold ten neighbouring hot keys in ratio 1:2:..:10, others a uniform key."""
    n = F.floor(F.sqrt(2 * F.floor(uniform(F.col("id"), seed + 1) * 55) + 0.25) - 0.5)  # ranks 0..9 of triangular numbers
    hot = F.lit(first) + F.least(F.lit(9), n)
    key = F.when(uniform(F.col("id"), seed + 2) < share, hot).otherwise(uniform_key(F.col("id"), domain, seed))
    return spark.range(rows).select(F.col("id").alias("seq"), key.cast("long").alias("key"))


def transplanted(table: DataFrame, key: str, value, share: float, seed: int = 0, row: str = "seq") -> DataFrame:
    """table with ``share`` of its rows given one key, so that it is hot on that side too."""
    return table.withColumn(key, F.when(uniform(F.col(row), seed) < share, F.lit(value)).otherwise(F.col(key)).cast(table.schema[key].dataType))
