"""Readers of key/value text, one row a line, and of skew statistics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def pair(line: Column, separator: str = ",") -> tuple[Column, Column]:
    """(key, value): a line split at its first separator; later ones stay in the value.

    A line without a separator raises when it is evaluated.
    """
    at = F.locate(separator, line)
    checked = F.when(at > 0, line).otherwise(F.raise_error(F.concat(F.lit("no separator in line: "), line)))
    return F.substring_index(checked, separator, 1), F.substring(checked, at + len(separator), F.length(line))


def pairs(lines: DataFrame, column: str = "value", separator: str = ",") -> DataFrame:
    key, value = pair(F.col(column), separator)
    return lines.select(key.alias("key"), value.alias("value"))


def read_pairs(spark: SparkSession, path: str | list[str], separator: str = ",") -> DataFrame:
    """A table (key, value) of text files; a path that isn't there raises."""
    return pairs(spark.read.text(path), separator=separator)


def read_two_fields(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated lines of exactly two non-empty fields; others raise."""
    lines = spark.read.text(path)
    parts = F.split("value", " ")
    ok = (F.size(parts) == 2) & (parts[0] != "") & (parts[1] != "")
    checked = F.when(ok, parts).otherwise(F.raise_error(F.concat(F.lit("not two fields: "), F.col("value"))))
    return lines.select(checked[0].alias("key"), checked[1].alias("value"))


def read_sent_pairs(spark: SparkSession, root: str, name: str, nodes: int) -> DataFrame:
    """(sender, key, value) of root/<node>/<name>, a file or a folder: a table that several nodes hold parts of."""
    lines = spark.read.text([f"{root}/{i}/{name}" for i in range(nodes)])
    sender = F.regexp_extract(F.col("_metadata.file_path"), rf"/(\d+)/{re.escape(name)}(?:/[^/]*)?$", 1).cast("int")
    key, value = pair(F.col("value"))
    return lines.select(sender.alias("sender"), key.alias("key"), value.alias("value"))


def write_sent_pairs(rows: DataFrame, root: str, name: str, nodes: int) -> None:
    """Writes rows (sender, key, value) with senders 0 to nodes - 1 as text in folders root/<sender>/<name>, one for each, empty ones too.

    Each write filters one sender's rows, so no sender's rows need meet in one task. A null value is
    empty text; a null key, a key with a comma or a line feed in either can't be read back and raises.
    """
    value = F.coalesce(F.col("value").cast("string"), F.lit(""))
    key = F.col("key").cast("string")
    bad = key.isNull() | key.contains(",") | key.contains("\n") | value.contains("\n")
    line = F.when(bad, F.raise_error(F.concat(F.lit("can't be one line: "), F.coalesce(key, F.lit("null key"))))).otherwise(F.concat(key, F.lit(","), value))
    for i in range(nodes):
        rows.where(F.col("sender") == i).select(line.alias("line")).write.text(f"{root}/{i}/{name}")


def read_statistics(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Skew statistics (key, count), from lines ``key,count``."""
    return read_pairs(spark, path).select("key", F.col("value").cast("int").alias("count"))


def folder(nodes: int, small_size: int, small_factor: float, big_size: int, big_factor: float) -> str:
    """Name of a data set's folder; a factor is written without needless zeros, but as a decimal."""
    return f"{nodes}_{small_size}_{float(small_factor):g}_{big_size}_{float(big_factor):g}"


def missing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of paths that aren't there."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    there = lambda p: (path := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(path)
    return [p for p in paths if not there(p)]
