"""Skewed tables derived from the driver's: each a pair of big (probe) and small (build) side on key k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: How many senders the derived rows have.
SENDERS = 4

#: SQL that Spark and DuckDB read alike. seq is a total order.
SQL = {
    "f1_big": "SELECT CASE WHEN (l_orderkey*7+l_linenumber)%10 < 4 THEN CAST(floor(CAST(20 AS DOUBLE)/(1+l_orderkey%20)) AS BIGINT) ELSE l_partkey END AS k, l_orderkey%4 AS sender, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem",
    "f1_small": "SELECT p_partkey AS k, p_partkey%4 AS sender, p_name AS value FROM part",
    "f2_big": "SELECT CAST(floor(CAST(20 AS DOUBLE)/(1+o_orderkey%20)) AS BIGINT) AS k, o_orderkey%4 AS sender, o_orderkey FROM orders",
    "f2_small": "SELECT CAST(floor(CAST(20 AS DOUBLE)/(1+s_suppkey%20)) AS BIGINT) AS k, s_suppkey%4 AS sender, s_suppkey FROM supplier",
    "f3_big": "SELECT CASE WHEN o_orderkey IN (4,5) THEN 3 WHEN o_orderkey%10<3 THEN 1 WHEN o_orderkey%10=3 THEN 2 ELSE 1000+o_custkey END AS k, o_orderkey%4 AS sender, o_orderkey FROM orders",
    "f3_small": "SELECT CASE WHEN c_custkey=9 THEN 2 WHEN c_custkey%100<2 THEN 1 WHEN c_custkey%100<4 THEN 3 ELSE 1000+c_custkey END AS k, c_custkey%4 AS sender, c_custkey FROM customer",
    "f4_big": "SELECT CASE WHEN l_orderkey%10<6 THEN 1 ELSE l_partkey END AS k, l_orderkey%4 AS sender, l_orderkey FROM lineitem",
    "f4_small": "SELECT CASE WHEN p_partkey%20=0 THEN 1 ELSE p_partkey END AS k, p_partkey%4 AS sender, p_partkey FROM part",
}
ORDER = {"f1_big": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), "f1_small": ("k",), "f2_big": ("o_orderkey",), "f2_small": ("s_suppkey",), "f3_big": ("o_orderkey",), "f3_small": ("c_custkey",), "f4_big": ("l_orderkey",), "f4_small": ("p_partkey",)}


def side(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One side of a fixture, with k, sender, and its own columns."""
    table = SQL[name].rsplit(" ", 1)[1]
    out = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    select = SQL[name].removeprefix("SELECT ").rsplit(" FROM ", 1)[0]
    return out.selectExpr(*_columns(select))


def _columns(select: str) -> list[str]:
    """A select list's items: split at commas outside brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(select):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(select[start:i])
            start = i + 1
    return [x.strip() for x in [*out, select[start:]]]
