"""Assignments of rows to buckets, one pair of functions a strategy, and the join over them.

A strategy is right exactly if each matching pair of rows has one bucket in common. Both sides get a
column of buckets; rows are copied to each of theirs, and one equi-join on (bucket, key) follows.
With key-level sets of heavy keys, all rows of a key take one path.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.placement import every, grid_column, grid_row, home
from ..operators import route
from ..operators.balance import planned
from ..operators.detect import heavy_exact
from . import joins


@dataclass
class Sides:
    """Two tables, their key, the sender of each row, the order of rows at a sender, and buckets."""

    big: DataFrame
    small: DataFrame
    key: str = "k"
    sender: str = "sender"
    order: tuple[str, ...] = ()
    n: int = 6
    ratio: float = 0.001
    floor: int = 10
    heavy_big: DataFrame | None = None
    heavy_small: DataFrame | None = None

    def hot(self, name: str) -> DataFrame:
        given = getattr(self, f"heavy_{name}")
        return given if given is not None else heavy_exact(getattr(self, name), self.key, self.ratio, self.floor)


def _flag(rows: DataFrame, hot: DataFrame, key: str, name: str) -> DataFrame:
    """rows with a boolean: their key is in hot, which has fewer than 1 / ratio keys."""
    keys = hot.select(F.col(key).alias(f"_{name}"))
    return rows.join(F.broadcast(keys), rows[key] == keys[f"_{name}"], "left").withColumn(name, F.col(f"_{name}").isNotNull()).drop(f"_{name}")


def _at_home(s: Sides):
    return route.by_hash(F.col(s.key), s.n)[0]


def base(s: Sides) -> tuple[DataFrame, DataFrame]:
    return s.big.withColumn("buckets", _at_home(s)), s.small.withColumn("buckets", _at_home(s))


def pnr(s: Sides) -> tuple[DataFrame, DataFrame]:
    """Hot probe rows round robin over all buckets, their build rows everywhere."""
    hot = s.hot("big")
    to = F.when(F.col("hot"), route.average(s.key, s.sender, list(s.order), s.n)[0]).otherwise(_at_home(s))
    return _flag(s.big, hot, s.key, "hot").withColumn("buckets", to).drop("hot"), _flag(s.small, hot, s.key, "hot").withColumn("buckets", F.when(F.col("hot"), every(s.n)).otherwise(_at_home(s))).drop("hot")


def prpd(s: Sides) -> tuple[DataFrame, DataFrame]:
    """Hot probe rows stay, their build rows go home and to the senders that hold the key."""
    hot = s.hot("big")
    big = _flag(s.big, hot, s.key, "hot")
    asked = big.where("hot").groupBy(F.col(s.key).alias("_k")).agg(F.collect_set(F.col(s.sender).cast("int")).alias("_asked"))
    small = s.small.join(F.broadcast(asked), F.col(s.key) == F.col("_k"), "left")
    to = F.array_union(_at_home(s), F.coalesce("_asked", route.nobody()))
    return big.withColumn("buckets", F.when(F.col("hot"), route.one(F.col(s.sender))).otherwise(_at_home(s))).drop("hot"), small.withColumn("buckets", to).drop("_k", "_asked")


def bnr(s: Sides, tolerance: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Hot probe rows by the plan, their build rows to the plan's buckets of the key."""
    hot = s.hot("big")
    table = planned(s.big.sparkSession, hot, s.key, s.n, tolerance, light=max(1, int(1 / s.ratio)))
    slots = table.groupBy(F.col(s.key).alias("_k")).agg(F.first("cnt").alias("_cnt"), F.sort_array(F.collect_list(F.struct("lo", "hi", "bucket"))).alias("_slots"))
    big = s.big.join(F.broadcast(slots), F.col(s.key) == F.col("_k"), "left")
    at = F.pmod(F.xxhash64(*(s.order or (s.key,))), F.col("_cnt"))
    to = F.transform(F.filter("_slots", lambda x: (x["lo"] <= at) & (at < x["hi"])), lambda x: x["bucket"])
    small = s.small.join(F.broadcast(slots), F.col(s.key) == F.col("_k"), "left")
    there = F.transform("_slots", lambda x: x["bucket"])
    drop = ("_k", "_cnt", "_slots")
    return big.withColumn("buckets", F.coalesce(to, _at_home(s))).drop(*drop), small.withColumn("buckets", F.coalesce(there, _at_home(s))).drop(*drop)


def flow(s: Sides) -> tuple[DataFrame, DataFrame]:
    """By where a key is hot: nowhere, home; one side, that stays and the other is copied; both, the grid."""
    hot_big, hot_small = s.hot("big"), s.hot("small")
    flagged = [_flag(_flag(x, hot_big, s.key, "hot_big"), hot_small, s.key, "hot_small") for x in (s.big, s.small)]
    sender, b, m = F.col(s.sender).cast("int"), F.col("hot_big"), F.col("hot_small")
    to_big = F.when(b & m, grid_column(sender, s.n)).when(b, route.one(sender)).when(m, every(s.n)).otherwise(_at_home(s))
    to_small = F.when(b & m, grid_row(sender, s.n)).when(b, every(s.n)).when(m, route.one(sender)).otherwise(_at_home(s))
    return tuple(x.withColumn("buckets", to).drop("hot_big", "hot_small") for x, to in zip(flagged, (to_big, to_small)))


ASSIGN = {"base": base, "pnr": pnr, "prpd": prpd, "bnr": bnr, "flow": flow}


def classes(s: Sides) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``class``: both, big, small or light, by where their key is hot."""
    hot_big, hot_small = s.hot("big"), s.hot("small")
    named = F.when(F.col("hot_big") & F.col("hot_small"), "both").when(F.col("hot_big"), "big").when(F.col("hot_small"), "small").otherwise("light")
    return tuple(_flag(_flag(x, hot_big, s.key, "hot_big"), hot_small, s.key, "hot_small").withColumn("class", named).drop("hot_big", "hot_small") for x in (s.big, s.small))


def placed(rows: DataFrame, n: int | None = None) -> DataFrame:
    """A row for each of its buckets; with n, bucket b in partition b."""
    out = rows.withColumn("bucket", F.explode("buckets")).drop("buckets")
    return out.repartitionById(n, "bucket") if n else out


def bucketed_join(big: DataFrame, small: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """The join over assignments, with the bucket in which each pair met. Columns of small that big has too, but the key, are dropped."""
    extra = [c for c in small.columns if c in big.columns and c not in (key, "buckets")]
    return placed(big, n).join(placed(small.drop(*extra), n).hint("shuffle_hash"), ["bucket", key])


def bucketed_counts(big: DataFrame, small: DataFrame, key: str, n: int) -> DataFrame:
    """(bucket, key, pairs): how many pairs of each key meet in each bucket, as ``bucketed_join`` has them, without making them.

    Rows of a bucket and key are counted before they move to it, and the counts of both sides multiplied there. Rows that
    are counts already (``_ek_rows``) move as they are and are added up there.
    """

    def counted(rows: DataFrame, name: str) -> DataFrame:
        if joins._ROWS in rows.columns:
            return placed(rows, n).groupBy("bucket", key).agg(F.sum(joins._ROWS).alias(name))
        return placed(rows).groupBy("bucket", key).agg(F.count("*").alias(name)).repartitionById(n, "bucket")

    own, its = counted(big, "_own"), counted(small, "_its")
    return own.join(its.hint("shuffle_hash"), ["bucket", key]).select("bucket", key, (F.col("_own") * F.col("_its")).alias("pairs"))


#: The sides whose hot keys a strategy asks for; keys that are hot in none of them have all rows of both sides at home.
ASKED = {"prpd": ("big",), "flow": ("big", "small")}


def pairs_by_key(s: Sides, strategy: str) -> DataFrame:
    """(key, pairs): how many rows the join over a strategy's assignment has, of each key that has any.

    The rows of both sides are counted by key in one shuffle, and hot keys are found in these counts. Rows of hot keys
    are counted by key and sender, as they go one way, and placed by the assignment. A key that isn't hot has one bucket, so its counts meet
    where they are, and its home need not be computed for each row.
    """
    one, none = (F.lit(x).cast("long") for x in (1, 0))
    sides = [x.select(s.key, (one if x is s.big else none).alias("big"), (none if x is s.big else one).alias("small")) for x in (s.big, s.small)]
    counts = joins.shared(sides[0].unionByName(sides[1]).groupBy(s.key).agg(F.sum("big").alias("big"), F.sum("small").alias("small")))

    def found(name: str) -> joins.Hot:
        given = getattr(s, f"heavy_{name}")
        if given is not None:
            return joins.given_keys(given, [s.key])
        return joins.heavy_keys(counts.select(s.key, F.col(name).alias(joins._ROWS)), [s.key], s.ratio, s.floor)

    with ThreadPoolExecutor(2) as pool:
        hot = dict(zip(ASKED[strategy], pool.map(found, ASKED[strategy])))
    rows = {name: r for h in hot.values() for name, r in zip(h.names(), h.rows)}
    either = joins.Hot([s.key], list(rows.values()), counts.select(s.key).schema, None)
    light = counts.where(F.col(s.key).isNotNull() & (F.col("big") > 0) & (F.col("small") > 0))
    out = either.of(light, False).select(s.key, (F.col("big") * F.col("small")).alias("pairs"))
    if not either:
        return out
    with ThreadPoolExecutor(2) as pool:
        told = list(pool.map(lambda x: joins.shared(joins._counted(either.of(x, True), [s.key, s.sender], joins._ROWS)), (s.big, s.small)))
    known = {f"heavy_{name}": h.frame(counts.sparkSession) for name, h in hot.items()}
    placed = ASSIGN[strategy](replace(s, big=told[0], small=told[1], order=(), **known))
    return out.unionByName(bucketed_counts(*placed, s.key, s.n).groupBy(s.key).agg(F.sum("pairs").alias("pairs")))


def moved(big: DataFrame, small: DataFrame, sender: str = "sender") -> DataFrame:
    """(side, rows, moved): rows after copying, and those whose bucket isn't their sender."""
    parts = [placed(x).agg(F.count("*").alias("rows"), F.coalesce(F.sum((F.col("bucket") != F.col(sender)).cast("long")), F.lit(0)).alias("moved")).select(F.lit(name).alias("side"), "rows", "moved") for name, x in (("big", big), ("small", small))]
    return parts[0].unionByName(parts[1])


def moved_bytes(big: DataFrame, small: DataFrame, key: str, value: str, n: int, sender: str = "sender") -> DataFrame:
    """(side, phase, rows, bytes) of what leaves its sender: bytes of keys and values as UTF-8 text.

    Rows of big and those of small that go home are sent, copies of small that go elsewhere are fetched.
    """
    size = F.octet_length(F.col(key).cast("string")) + F.octet_length(value)
    away = lambda x, name, phase: placed(x).where(F.col("bucket") != F.col(sender)).select(F.lit(name).alias("side"), phase.alias("phase"), size.alias("size"))
    at_home = F.when(F.col("bucket") == home(F.col(key), n), "sent").otherwise("fetched")
    both = away(big, "big", F.lit("sent")).unionByName(away(small, "small", at_home))
    return both.groupBy("side", "phase").agg(F.count("*").alias("rows"), F.sum("size").cast("long").alias("bytes"))


def assignment(big: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """(side, key, bucket, cnt): how many rows of a key each bucket gets."""
    parts = [placed(x).groupBy(key, "bucket").agg(F.count("*").alias("cnt")).select(F.lit(name).alias("side"), key, "bucket", "cnt") for name, x in (("big", big), ("small", small))]
    return parts[0].unionByName(parts[1])


def loads(big: DataFrame, small: DataFrame, n: int) -> DataFrame:
    """(bucket, big_rows, small_rows) for all n buckets, empty ones too."""
    out = big.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))
    for name, x in (("big_rows", big), ("small_rows", small)):
        out = out.join(placed(x).groupBy("bucket").agg(F.count("*").alias(name)), "bucket", "left")
    return out.select("bucket", F.coalesce("big_rows", F.lit(0)).alias("big_rows"), F.coalesce("small_rows", F.lit(0)).alias("small_rows"))


def balance_ratio(load: DataFrame, column: str = "big_rows") -> DataFrame:
    """(max - min) / max over buckets, and max over mean."""
    return load.agg(((F.max(column) - F.min(column)) / F.max(column)).alias("ratio"), (F.max(column) / F.avg(column)).alias("max_over_mean"))
