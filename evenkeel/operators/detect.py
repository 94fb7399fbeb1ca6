"""Detectors of heavy keys.

Sets of heavy keys are small (fewer than 1 / ratio keys can exceed a share ratio of the rows), but a
missed or surplus key may cost time only, never rows, in every join of this package.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def limit(n: int, ratio: float, floor: int) -> int:
    """The count that a heavy key exceeds."""
    return max(int(n * ratio), floor)


def heavy_exact(rows: DataFrame, key: str, ratio: float = 0.001, floor: int = 10) -> DataFrame:
    """(key, cnt) of keys with more than max(floor, ratio * n) rows; floor 0 gives the plain offline rule.

    Counts are combined before their shuffle. n, over all rows, is a second, narrow scan, or none where
    the files' footers tell it.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("cnt"))
    n = rows.agg(F.count("*").alias("n"))
    above = F.greatest(F.lit(floor), F.floor(F.col("n") * ratio)) if floor else F.col("n") * ratio
    return counts.join(F.broadcast(n), F.col("cnt") > above).select(key, "cnt")


def heavy_local(rows: DataFrame, key: str, sender: str, heavy: DataFrame) -> DataFrame:
    """(sender, key, cnt): each sender's rows of the keys in ``heavy``."""
    return rows.join(heavy.select(key), key, "left_semi").groupBy(sender, key).agg(F.count("*").alias("cnt"))


def flagged_static(rows: DataFrame, key: str, statistics: DataFrame) -> DataFrame:
    """rows with ``heavy``: whether their key is listed, from its first row on. Lists may be of any size: Spark broadcasts those it sees to be small."""
    listed = statistics.select(F.col(key).alias("_listed")).distinct()
    return rows.join(listed, rows[key] == listed["_listed"], "left").withColumn("heavy", F.col("_listed").isNotNull()).drop("_listed")


def flagged_online(rows: DataFrame, key: str, sender: str, order: list[str], ratio: float = 0.001, floor: int = 10) -> DataFrame:
    """rows with ``heavy``, decided row by row by an online counter with room for all keys.

    The m-th row of a key at position p of its sender is heavy iff m - 1 > max(floor, floor(p * ratio)):
    the first rows of a key that turns out heavy are still light.
    """
    m = F.row_number().over(Window.partitionBy(sender, key).orderBy(*order))
    p = F.row_number().over(Window.partitionBy(sender).orderBy(*order))
    return rows.withColumn("heavy", (m - 1) > F.greatest(F.lit(floor), F.floor(p * ratio)))


class SpaceSaving:
    """Bounded counter of the most frequent keys. ``hit`` tells whether a key's own hits exceed the limit.

    Keys stand in falling order of count. One that gains a count, or comes in for another, stands before those
    of its new count; keys that come in while there is room stand last. The last is the one to go, so
    of the least count that is the one that reached it first, or of count 1 the one that came last.
    """

    def __init__(self, capacity: int, ratio: float, floor: int):
        self.capacity, self.ratio, self.floor = capacity, ratio, floor
        self.n, self.low = 0, 1
        self.counts: dict = {}  # key -> (count, count it came in with)
        self.having: dict[int, dict] = {}  # count -> its keys by when they reached it

    def limit(self) -> int:
        return max(int(self.n * self.ratio), self.floor)

    def _place(self, key, count: int, first: int) -> None:
        self.counts[key] = count, first
        self.having.setdefault(count, {})[key] = None

    def _leave(self, key, count: int) -> None:
        there = self.having[count]
        del there[key]
        if not there:
            del self.having[count]

    def hit(self, key) -> bool:
        self.n += 1
        if (x := self.counts.get(key)) is not None:
            count, first = x
            self._leave(key, count)
            self._place(key, count + 1, first)
            return count + 1 - first > self.limit()
        if len(self.counts) < self.capacity:
            self._place(key, 1, 1)
            self.low = 1
        elif self.capacity:
            while self.low not in self.having:
                self.low += 1
            there = self.having[self.low]
            out = next(reversed(there)) if self.low == 1 else next(iter(there))
            self._leave(out, self.low)
            del self.counts[out]
            self._place(key, self.low + 1, self.low)
        return False

    def dump(self) -> list[tuple]:
        """(key, count, own hits after coming in, flag) by falling order; the flag is for reaching the limit, not only for exceeding it."""
        order = [k for c in sorted(self.having, reverse=True) for k in (self.having[c] if c == 1 else reversed(self.having[c]))]
        return [(k, self.counts[k][0], self.counts[k][0] - self.counts[k][1], self.counts[k][0] - self.counts[k][1] >= self.limit()) for k in order]


def _streams(rows: DataFrame, sender: str, order: list[str]) -> DataFrame:
    """Each sender's rows in order, in one partition, not gathered."""
    return rows.repartition(F.col(sender)).sortWithinPartitions(sender, *order)


def flagged_sketch(rows: DataFrame, key: str, sender: str, order: list[str], capacity: int = 50, ratio: float = 0.001, floor: int = 10) -> DataFrame:
    """rows with ``heavy`` by a bounded sketch a sender: exact as ``flagged_online`` while keys fit its capacity.

    It depends on the order of rows, so each sender's rows pass one task in order; only the sketch is kept.
    """
    schema = rows.schema.fields
    names = [f.name for f in schema]

    def run(batches):
        now, sketch = None, None
        for b in batches:
            flags = []
            for s, k in zip(b.column(names.index(sender)).to_pylist(), b.column(names.index(key)).to_pylist()):
                if sketch is None or s != now:
                    now, sketch = s, SpaceSaving(capacity, ratio, floor)
                flags.append(sketch.hit(k))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns)), pa.array(flags, pa.bool_())], [*names, "heavy"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return _streams(rows, sender, order).mapInArrow(run, f"{kinds}, heavy boolean")


def sketch_dumped(rows: DataFrame, key: str, sender: str, order: list[str], capacity: int = 50, ratio: float = 0.001, floor: int = 10) -> DataFrame:
    """(sender, place, key, cnt, own, heavy): each sender's bounded sketch after its last row, largest first."""
    names = [f.name for f in rows.schema.fields]

    def run(batches):
        sketches: dict = {}
        for b in batches:
            for s, k in zip(b.column(names.index(sender)).to_pylist(), b.column(names.index(key)).to_pylist()):
                if s not in sketches:
                    sketches[s] = SpaceSaving(capacity, ratio, floor)
                sketches[s].hit(k)
        out = [(s, i, *x) for s, sketch in sketches.items() for i, x in enumerate(sketch.dump())]
        yield pa.RecordBatch.from_pylist([dict(zip(fields, x)) for x in out], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_type

    fields = [sender, "place", key, "cnt", "own", "heavy"]
    kind = {f.name: f.dataType for f in rows.schema.fields}
    arrow = pa.schema([(sender, to_arrow_type(kind[sender])), ("place", pa.int32()), (key, to_arrow_type(kind[key])), ("cnt", pa.int64()), ("own", pa.int64()), ("heavy", pa.bool_())])
    ddl = f"`{sender}` {kind[sender].simpleString()}, place int, `{key}` {kind[key].simpleString()}, cnt long, own long, heavy boolean"
    return _streams(rows, sender, order).mapInArrow(run, ddl)


def found_by_sketch(rows: DataFrame, key: str, sender: str, ratio: float = 0.001, floor: int = 10, items: int = 10_000) -> DataFrame:
    """(sender, key) of the keys that each sender's mergeable sketch estimates over its limit.

    Sketches are combined before their shuffle and don't depend on the order of rows, so no sender's rows meet in one task.
    """
    per = rows.where(F.col(key).isNotNull()).groupBy(sender).agg(F.expr(f"approx_top_k(`{key}`, {min(items, max(1, int(1 / ratio)))}, {items})").alias("top"), F.count("*").alias("n"))
    x = per.select(sender, "n", F.explode("top").alias("x")).where(F.col("x.count") > F.greatest(F.lit(floor), F.floor(F.col("n") * ratio)))
    return x.select(sender, F.col("x.item").alias(key))


def ever_flagged(flagged: DataFrame, key: str, sender: str) -> DataFrame:
    """(sender, key) of the keys that a sender found heavy at any row."""
    return flagged.where("heavy").select(sender, key).distinct()


def consensus(found: DataFrame, key: str, sender: str, senders: int) -> DataFrame:
    """Keys that all senders found: the intersection of their sets."""
    return found.groupBy(key).agg(F.count_distinct(sender).alias("n")).where(F.col("n") == senders).select(key)


def union(found: DataFrame, key: str) -> DataFrame:
    """Keys that any sender found."""
    return found.select(key).distinct()


def sketched(rows: DataFrame, key: str, k: int = 50, items: int = 1000) -> DataFrame:
    """(key, cnt) of the most frequent keys by a mergeable sketch of ``items`` entries; fewer than k may come back."""
    return rows.agg(F.expr(f"approx_top_k({key}, {k}, {items})").alias("top")).select(F.explode("top").alias("x")).select(F.col("x.item").alias(key), F.col("x.count").alias("cnt"))


def sketched_by_sender(rows: DataFrame, key: str, sender: str, k: int = 50, items: int = 1000) -> DataFrame:
    """As ``sketched``, from sketches accumulated a sender and then combined."""
    parts = rows.groupBy(sender).agg(F.expr(f"approx_top_k_accumulate({key}, {items})").alias("s"))
    whole = parts.agg(F.expr(f"approx_top_k_combine(s, {items})").alias("s"))
    return whole.select(F.explode(F.expr(f"approx_top_k_estimate(s, {k})")).alias("x")).select(F.col("x.item").alias(key), F.col("x.count").alias("cnt"))
