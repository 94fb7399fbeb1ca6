"""Connected components of an edge table by alternating large-star and small-star steps.

(Kiveris et al., "Connected Components in MapReduce and Beyond".) Every step is a
pre-aggregated minimum and a join, so that a hub with a third of all edges is never gathered
in one task: the minimum is combined before its shuffle, and the join's hot key is left to the
adaptive skew split. Each round is written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, rekeyed, settle


def _with_min(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m, the smallest of u and its neighbours v.

    The minima are rekeyed, so that adaptive execution may split a hub's edges.
    """
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select(rekeyed(F.col("u")).alias("k"), F.least("u", "m").alias("m"))
    return edges.join(low.hint("merge"), edges.u == low.k).select("u", "v", "m")


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _with_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    small = _with_min(large)
    moved = small.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(small.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (u, v); component is the smallest node reachable.

    Rows with a null end and self loops are ignored. Rounds go on until nothing changes; their
    number grows with the logarithm of the longest path.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct()
    now = settle(now, "edges")
    state = _state(now)
    while state[0]:
        new = settle(_round(now), "edges")
        discard(now)
        now, before, state = new, state, _state(new)
        if before == state:
            break
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    """Number of edges and sums of two hashes of them: equal before and after only at the fixed point."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(h.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(h, 32))).first())
