"""Skew-resilient inner equi-joins. Every strategy returns the rows of the plain join.

Unlike the assignments, which place rows at numbered senders to compare strategies, these are the
forms to run: nothing is numbered that needs no number, and hot rows that may stay aren't exchanged.

Keys are only ever compared by Spark's own joins and groups, so what these take as equal (-0.0 and
0.0, NaN and NaN, nested values) is equal here, and sides can't disagree about a key. Which keys count
as hot is therefore a matter of cost alone.
"""

from __future__ import annotations

import logging
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.placement import grid
from ..operators import detect
from ..operators.balance import plan
from ..options import STRATEGIES, Options

log = logging.getLogger(__name__)

#: Rows of a side that are broadcast, at most; beyond, hot rows are spread and the other side copied.
BROADCAST_ROWS = 200_000
#: Hot keys, at most: the driver receives so many, and a broadcast table holds them. Those of fewest rows are left out.
MAX_KEYS = 100_000
#: Types whose values are equal exactly if their literals are, and which scans can filter by.
_LITERAL = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.StringType(), T.DateType())
#: Types of which equal values have equal hashes, so that rows can be placed by them.
_HASHED = (*_LITERAL, T.BooleanType(), T.FloatType(), T.DoubleType(), T.BinaryType(), T.TimestampType(), T.TimestampNTZType())
_WHOLE = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType())
_ROW, _COLUMN, _CELLS, _CELL, _PART, _HASH, _OTHER = "_ek_row", "_ek_column", "_ek_cells", "_ek_cell", "_ek_part", "_ek_hash", "_ek_other"
_OWN, _ITS = "_ek_own", "_ek_its"
_ROWS = "_ek_rows"
#: Strategies whose counts read no side twice.
_ONCE = ("prpd", "auto", "bnr", "flow", "pnr")


def _name(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(_name, x))
    return bytes(x) if isinstance(x, bytearray) else x


def _keys(on: str | list[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def _type(side: DataFrame, column: str) -> T.DataType:
    return side.select(F.col(f"`{column}`")).schema[0].dataType


def _table(spark: SparkSession, rows: list[tuple], schema: T.StructType, keys: int) -> DataFrame:
    """A small table of which the first columns are keys; with plain keys it goes to the JVM at once, without a job."""
    if rows and all(f.dataType in _LITERAL for f in schema.fields[:keys]):
        names = schema.fieldNames()
        return spark.createDataFrame(pa.Table.from_pylist([dict(zip(names, r)) for r in rows], schema=to_arrow_schema(schema)), schema)
    return spark.createDataFrame(rows, schema)


@dataclass
class Hot:
    """A side's hot keys, fewer than 1 / ratio: rows (*on, cnt) by falling count, and the side's number of rows.

    cnt is null for keys that were given without counts, total is None for given keys.
    """

    on: list[str]
    rows: list
    schema: T.StructType
    total: int | None
    limit: int = 0

    LITERALS = 2000

    def __bool__(self) -> bool:
        return bool(self.rows)

    def keys(self) -> list[tuple]:
        return [tuple(r[c] for c in self.on) for r in self.rows]

    def names(self) -> list:
        """The keys in a form that Python can look up; keys that Spark takes as equal may differ here, at a cost."""
        return [_name(k) for k in self.keys()]

    def frame(self, spark, extra: str = "", values: list[tuple] | None = None) -> DataFrame:
        """The keys as a table, with more columns of the given types and values."""
        schema = T.StructType([*(self.schema[c] for c in self.on), *T.StructType.fromDDL(extra).fields] if extra else [self.schema[c] for c in self.on])
        return _table(spark, [(*k, *v) for k, v in zip(self.keys(), values or [()] * len(self.rows))], schema, len(self.on))

    def of(self, side: DataFrame, hot: bool) -> DataFrame:
        """The rows of a side whose key is in the set, or isn't. Rows with a null key join nothing and may be in neither.

        A few keys of one column become literals, which filter in the scan; others are broadcast.
        """
        if not self.rows:
            return side.limit(0) if hot else side
        field = self.schema[self.on[0]].dataType
        if len(self.on) == 1 and len(self.rows) <= self.LITERALS and field in _LITERAL and field == _type(side, self.on[0]):
            inside = F.col(f"`{self.on[0]}`").isin([k for (k,) in self.keys()])
            return side.where(inside if hot else ~inside)
        return side.join(F.broadcast(self.frame(side.sparkSession)), self.on, "left_semi" if hot else "left_anti")


def heavy_keys(rows: DataFrame, on: list[str], ratio: float, floor: int) -> Hot:
    """Keys with more than max(floor, ratio * n) rows, in one job: n is observed on the way to the largest counts."""
    if not 1 / MAX_KEYS <= ratio <= 1:
        raise ValueError(f"ratio must be from {1 / MAX_KEYS} to 1")
    seen = Observation()
    counts = _counted(rows, on, "cnt").observe(seen, F.sum("cnt").alias("n"), F.count("*").alias("keys"))
    most = counts.dropna("any", subset=on).orderBy(F.desc("cnt")).limit(math.ceil(1 / ratio)).collect()
    total = seen.get["n"] or 0
    limit = max(floor, int(total * ratio))
    found = [r for r in most if r["cnt"] > limit]
    log.info("%d hot keys of %s among %d rows, over %d", len(found), seen.get["keys"], total, limit)
    return Hot(on, found, counts.schema, total, limit)


def given_keys(heavy: DataFrame, on: list[str]) -> Hot:
    """Known hot keys (*on, perhaps cnt), each once."""
    cnt = F.max("cnt") if "cnt" in heavy.columns else F.lit(None)
    known = heavy.dropna("any", subset=on).groupBy(*on).agg(cnt.cast("long").alias("cnt")).orderBy(F.desc_nulls_last("cnt"))
    return Hot(on, known.limit(MAX_KEYS).collect(), known.schema, None)


def both_sides(big: DataFrame, small: DataFrame, on: list[str], ratio: float, floor: int) -> tuple[Hot, Hot]:
    """Hot keys of both sides, counted at the same time."""
    with ThreadPoolExecutor(2) as pool:
        return tuple(pool.map(lambda side: heavy_keys(side, on, ratio, floor), (big, small)))


def _salt(rows: DataFrame, n: Column | int) -> Column:
    """A number below n from a row's contents and its partition.

    A row that is computed again goes the same way, whatever the order of rows; equal rows are
    spread by where they are.
    """
    return F.pmod(_place(rows), n).cast("int")


def _place(rows: DataFrame) -> Column:
    hashable = [F.col(f"`{f.name}`") for f in rows.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    return F.xxhash64(*hashable, F.spark_partition_id())


def _upto(n: Column | int) -> Column:
    return F.sequence(F.lit(0), n - 1 if isinstance(n, Column) else F.lit(n - 1))


def _counted(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """How many rows are alike in the columns ``by``: counted where they are, so that of one key no more than a row a task moves."""
    by = [F.col(f"`{c}`") for c in by]
    if _ROWS in rows.columns:  # of _once, a row a key already
        return rows.select(*by, F.col(_ROWS).alias(name))
    return rows.groupBy(*by).agg(F.count("*").alias(name))


def _once(side: DataFrame, on: list[str]) -> DataFrame:
    """(*on, _ek_rows): how many rows a side has of each key. The side is read once, now."""
    return shared(_counted(side, on, _ROWS))


def shared(counts: DataFrame) -> DataFrame:
    """Counts whose input is read now. All that reads them shares the files of their one shuffle, which Spark makes
    again if they are lost and drops when nothing refers to them. Nothing is held or matched by a table's path.
    """
    return DataFrame(counts.sparkSession._jsparkSession.internalCreateDataFrame(counts._jdf.queryExecution().toRdd(), counts._jdf.schema(), False), counts.sparkSession)


def _read_once(big: DataFrame, small: DataFrame, on: list[str], strategy: str, known: bool) -> tuple[DataFrame, DataFrame]:
    """The sides as counts by key: big, and small where the strategy reads it more than once, to find hot keys, or rows that stay and the rest."""
    if strategy in ("prpd", "flow") or strategy == "auto" and not known:
        with ThreadPoolExecutor(2) as pool:
            return tuple(pool.map(lambda side: _once(side, on), (big, small)))
    return _once(big, on), small


def plain(big: DataFrame, small: DataFrame, on: list[str], method: str = "shuffle_hash", counted: bool = False) -> DataFrame:
    if counted:
        big, small = _counted(big, on, _OWN), _counted(small, on, _ITS)
    return big.join(small.hint(method), on)


def spread(big: DataFrame, small: DataFrame, on: list[str], n: int, method: str = "shuffle_hash") -> DataFrame:
    """big over n buckets whatever its keys, small copied to all."""
    copies = small.withColumn(_COLUMN, F.explode(_upto(n)))
    return big.withColumn(_COLUMN, _salt(big, F.lit(n))).join(copies.hint(method), [*on, _COLUMN]).drop(_COLUMN)


def crossed(big: DataFrame, small: DataFrame, on: list[str], n: int, method: str = "shuffle_hash") -> DataFrame:
    """Both sides over a grid: a big row in one column and all rows, a small row in one row and all columns."""
    rows, cols = grid(n)
    down = big.withColumn(_COLUMN, _salt(big, F.lit(cols))).withColumn(_ROW, F.explode(_upto(rows)))
    along = small.withColumn(_ROW, _salt(small, F.lit(rows))).withColumn(_COLUMN, F.explode(_upto(cols)))
    return down.join(along.hint(method), [*on, _ROW, _COLUMN]).drop(_ROW, _COLUMN)


def _found(side: DataFrame, on: list[str], table: DataFrame) -> DataFrame:
    """A side with what a broadcast table says of its keys, in column _ek_cells; null for other keys."""
    return side.join(F.broadcast(table), on, "left")


def _met(big: DataFrame, small: DataFrame, on: list[str], n: int, method: str) -> DataFrame:
    """The join on keys and _ek_cell, with each row in partition _ek_part, or where a hash of its key says if that is null.

    Placing rows keeps cells of hot keys from meeting in one partition by chance. Rows are looked up by
    partition and hash, two ints that Spark packs into one long, and pairs are then compared by their
    keys, as a condition that isn't taken as a join key. Keys of other types than _HASHED are left
    to the join's own exchanges.
    """
    kinds = [(_type(big, c), _type(small, c)) for c in on]
    if any(x != y or not (x in _HASHED or isinstance(x, T.DecimalType)) for x, y in kinds):
        return big.drop(_PART).join(small.drop(_PART).hint(method), [*on, _CELL]).drop(_CELL)
    named = [F.col(f"`{c}`") for c in on]
    at = F.coalesce(_PART, F.pmod(F.hash(*named), F.lit(n))).cast("int")
    own, its = (x.withColumns({_PART: at, _HASH: F.hash(*named, _CELL)}).repartitionById(n, _PART) for x in (big, small))
    renamed = {c: f"{_OTHER}{i}" for i, c in enumerate(its.columns)}
    of = lambda c: F.col(renamed.get(c) or next(x for y, x in renamed.items() if y.lower() == c.lower()))
    met = (F.col(_PART) == of(_PART)) & (F.col(_HASH) == of(_HASH))
    differ = F.col(_CELL).bitwiseXOR(of(_CELL))
    for c, (kind, _) in zip(on, kinds):
        x, y = F.col(f"`{c}`"), of(c)
        if kind in _WHOLE:
            differ = differ.bitwiseOR(x.cast("long").bitwiseXOR(y.cast("long")))
        else:
            met = met & (x <= y) & (x >= y)
    gone = [*(of(c) for c in on), F.col(_PART), F.col(_HASH), F.col(_CELL), of(_PART), of(_HASH), of(_CELL)]
    out = own.join(its.withColumnsRenamed(renamed).hint(method), met & (differ == 0)).drop(*gone)
    return out.withColumnsRenamed({x: c for c, x in renamed.items()})


def _matching(side: DataFrame, on: list[str]) -> DataFrame:
    """The rows that have a key, as no others match."""
    for c in on:
        side = side.where(F.col(f"`{c}`").isNotNull())
    return side


def celled(big: DataFrame, small: DataFrame, on: list[str], cells: DataFrame, n: int, method: str = "shuffle_hash", counted: bool = False) -> DataFrame:
    """One join over n partitions: each key of cells (*on, rows, columns, first) has a grid of its own, dealt to partitions in turn from first on.

    A big row goes to one column and all rows of its key's grid, a small row to one row and all
    columns. Keys without a grid have one cell, by a hash. Counted rows are counted for each column or row of the grid before they are copied.
    """
    table = cells.select(*on, F.struct("rows", "columns", "first").alias(_CELLS))
    r, c = F.coalesce(F.col(_CELLS)["rows"], F.lit(1)), F.coalesce(F.col(_CELLS)["columns"], F.lit(1))
    sides = []
    for side, own, other, n_own, n_other, name in ((big, _COLUMN, _ROW, c, r, _OWN), (small, _ROW, _COLUMN, r, c, _ITS)):
        x = _found(_matching(side, on), on, table).withColumn(own, F.when(n_own > 1, _salt(side, n_own)).otherwise(0))
        if counted:
            x = _counted(x, [*on, _CELLS, own], name)
        sides.append(x.withColumn(other, F.explode(_upto(n_other))))
    part = F.pmod(F.col(_CELLS)["first"] + F.col(_ROW) * F.col(_CELLS)["columns"] + F.col(_COLUMN), F.lit(n))
    cell = F.shiftleft(F.col(_ROW).cast("long"), 32) + F.col(_COLUMN)
    return _met(*(x.withColumns({_PART: part, _CELL: cell}).drop(_CELLS, _ROW, _COLUMN) for x in sides), on, n, method)


def grids(hot_big: Hot, hot_small: Hot | None, n: int, least: int = 1) -> dict:
    """Name -> (key, rows, columns) of a key's grid; keys that need only one cell aren't listed.

    A side's rows of a key are cut into pieces of a partition's share, so the other side's are copied as often as
    the key's own count asks for. A key that is hot on both sides has about n cells, in the
    proportion that copies least. A key without a count has n columns.
    """
    sides = [dict(zip(h.names(), zip(h.keys(), h.rows))) if h else {} for h in (hot_big, hot_small)]
    # Of given keys the side's number of rows isn't known: their own rows stand for it.
    share = [max(1.0, (h.total or sum(r["cnt"] or 0 for r in h.rows)) / n) if h else 1.0 for h in (hot_big, hot_small)]
    out = {}
    for name, (key, _) in {**sides[1], **sides[0]}.items():
        b, s = (x[name][1]["cnt"] if name in x else 0 for x in sides)
        if b and s:
            columns = max(1, min(n, round(math.sqrt(n * b / s))))
            shape = max(1, n // columns), columns
        elif name in sides[0]:
            shape = 1, n if b is None else min(n, max(least, math.ceil(b / share[0])))
        else:
            shape = min(n, math.ceil(s / share[1])), 1
        if shape != (1, 1):
            out[name] = (key, *shape)
    return out


def _cells(spark, hot: Hot, shapes: dict) -> DataFrame:
    schema = T.StructType([*(hot.schema[c] for c in hot.on), *T.StructType.fromDDL("rows int, columns int, first long").fields])
    firsts = accumulate((rows * columns for _, rows, columns in shapes.values()), initial=0)
    return _table(spark, [(*k, rows, columns, first) for (k, rows, columns), first in zip(shapes.values(), firsts)], schema, len(hot.on))


def _renamed(big: DataFrame, small: DataFrame, on: list[str]) -> tuple[DataFrame, list[str]]:
    """small with names that big doesn't have, but for the keys, and the columns of the result."""
    same = (lambda x: x) if big.sparkSession.conf.get("spark.sql.caseSensitive") == "true" else str.lower
    keys = {same(c) for c in on}
    taken, names = {same(c) for c in (*big.columns, *small.columns)}, {}
    mine = {same(c) for c in big.columns}
    for c in small.columns:
        if same(c) in mine and same(c) not in keys:
            name = f"{c}_small"
            while same(name) in taken:
                name += "_"
            names[c] = name
            taken.add(same(name))
    small = small.withColumnsRenamed(names) if names else small
    return small, [*on, *(c for c in big.columns if same(c) not in keys), *(c for c in small.columns if same(c) not in keys)]


def skew_join(big: DataFrame, small: DataFrame, on: str | list[str], strategy: str = "auto", n: int | None = None, heavy: DataFrame | None = None, ratio: float = 0.001, floor: int = 10, tolerance: float = 0.3, method: str = "shuffle_hash") -> DataFrame:
    """The inner join of big and small on equal columns ``on``, with null keys matching nothing.

    The result has the keys, then big's other columns, then small's; a column of small that big has too
    is called <name>_small. ``heavy`` are known hot keys of big (columns on, perhaps cnt); otherwise
    they are counted. auto gives each key that exceeds a partition's share, on either side, a grid of its own, and is the plain
    join if there is none. n is the number of buckets that hot rows are spread over, by default that
    of shuffle partitions. ``method`` is the hint of the shuffled joins: with merge they sort and
    spill, where partitions of small don't fit a task's memory.
    """
    on = _keys(on)
    small, columns = _renamed(big, small, on)
    return _by_strategy(big, small, on, strategy, n, heavy, ratio, floor, tolerance, method, [F.col(f"`{c}`") for c in columns])


def pair_counts(big: DataFrame, small: DataFrame, on: str | list[str], strategy: str = "auto", n: int | None = None, heavy: DataFrame | None = None, ratio: float = 0.001, floor: int = 10, tolerance: float = 0.3, method: str = "shuffle_hash") -> DataFrame:
    """(*on, pairs): how many rows ``skew_join`` has of each key, by the same strategy but without making the pairs.

    Rows go to the places that the strategy gives them. Those of a key and place are counted before they move, and there
    the counts of both sides are multiplied: work grows with the rows of the sides, not with their product.
    """
    on = _keys(on)
    pick = [*(F.col(f"`{c}`") for c in on), (F.col(_OWN) * F.col(_ITS)).alias("pairs")]
    met = _by_strategy(big, small, on, strategy, n, heavy, ratio, floor, tolerance, method, pick, counted=True)
    if strategy in _ONCE and all(_type(big, c) == _type(small, c) for c in on):
        return met  # counts of a key, a row in one place, meet once
    return met.groupBy(*pick[:-1]).agg(F.sum("pairs").alias("pairs"))


def _by_strategy(big: DataFrame, small: DataFrame, on: list[str], strategy: str, n: int | None, heavy: DataFrame | None, ratio: float, floor: int, tolerance: float, method: str, pick: list, counted: bool = False) -> DataFrame:
    """The join's pairs, or counted, (*on, _ek_own, _ek_its): how many rows of each side meet; columns as picked."""
    spark = big.sparkSession
    n = n or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if strategy not in (*STRATEGIES, "auto"):
        raise ValueError(f"strategy {strategy!r} is none of {STRATEGIES}")
    if strategy == "base":
        return plain(big, small, on, method, counted).select(*pick)
    if counted and strategy in _ONCE:
        big, small = _read_once(big, small, on, strategy, heavy is not None)
    both = strategy == "flow" or strategy == "auto" and heavy is None
    if heavy is not None:
        hot, hot_small = given_keys(heavy, on), heavy_keys(small, on, ratio, floor) if both else None
    else:
        hot, hot_small = both_sides(big, small, on, ratio, floor) if both else (heavy_keys(big, on, ratio, floor), None)
    if strategy == "auto" and any(_type(big, c) != _type(small, c) for c in on):
        hot_small = None  # small's keys needn't be values of big's type
    if strategy == "bnr":
        out = _planned(big, small, on, hot, n, tolerance, ratio, method, counted)
    elif strategy in ("auto", "pnr"):
        shapes = grids(hot, hot_small, n, least=1 if strategy == "auto" else min(2, n))
        out = celled(big, small, on, _cells(spark, hot, shapes), n, method, counted) if shapes else plain(big, small, on, method, counted)
        log.info("%s: %d keys have grids", strategy, len(shapes))
    else:
        return _staying(big, small, on, hot, hot_small, n, ratio, pick, method, counted)
    return out.select(*pick)


def configured_join(big: DataFrame, small: DataFrame, on: str, options: Options, sender: str | None = None, order: list[str] | None = None, statistics: DataFrame | None = None, method: str = "shuffle_hash") -> DataFrame:
    """``skew_join`` as settings say.

    With ``online`` off, hot keys are those that statistics list (columns on, perhaps cnt). With it on
    and a sender column (a column of big), they are what the senders find: by a sketch with ``capacity``
    entries row by row in the given order, or without an order by a mergeable sketch; bnr with ``consensus`` takes the keys
    that all senders found, else any sender's do. Without a sender they are counted exactly. All
    ways give the same rows.
    """
    o, heavy = options, None
    if not o.online:
        if statistics is None:
            raise ValueError("static detection needs statistics")
        heavy = statistics
    elif sender is not None:
        if order:
            found = detect.ever_flagged(detect.flagged_sketch(big.select(on, sender, *[c for c in order if c not in (on, sender)]), on, sender, order, o.capacity, o.ratio, o.floor), on, sender)
        else:
            found = detect.found_by_sketch(big, on, sender, o.ratio, o.floor)
        agreed = o.consensus and o.strategy == "bnr"
        keys = detect.consensus(found, on, sender, big.select(sender).distinct().count()) if agreed else detect.union(found, on)
        heavy = big.join(keys, on, "left_semi").groupBy(on).agg(F.count("*").alias("cnt"))
    log.info("%s by %s", o.strategy, "counts" if heavy is None else "senders" if o.online else "statistics")
    return skew_join(big, small, on, o.strategy, o.buckets, heavy, o.ratio, o.floor, o.tolerance, method)


def _planned(big: DataFrame, small: DataFrame, on: list[str], hot: Hot, n: int, tolerance: float, ratio: float, method: str, counted: bool = False) -> DataFrame:
    """One join: hot rows by a plan from their counts, small rows to no more buckets than the plan uses for their key.

    Keys without a count are taken to be as large as the largest with one.
    """
    if not hot:
        return plain(big, small, on, method, counted)
    most = max((r["cnt"] or 0 for r in hot.rows), default=0) or 1000 * n
    counts = [r["cnt"] or most for r in hot.rows]
    slots: list[list] = [[] for _ in counts]
    for i, bucket, lo, hi in plan(list(enumerate(counts)), n, tolerance, light=max(1, int(1 / ratio))):
        slots[i].append({"lo": lo, "hi": hi, "bucket": bucket})
    table = hot.frame(big.sparkSession, f"{_CELLS} struct<cnt:long,slots:array<struct<lo:long,hi:long,bucket:int>>>", [({"cnt": c, "slots": x},) for c, x in zip(counts, slots)])
    at = F.pmod(_place(big), F.col(_CELLS)["cnt"])
    b = _found(_matching(big, on), on, table).withColumn("_ek_at", at)
    slot = F.get(F.filter(F.col(_CELLS)["slots"], lambda x: (x["lo"] <= F.col("_ek_at")) & (F.col("_ek_at") < x["hi"])), F.lit(0))["bucket"]
    b = b.withColumn(_CELL, F.coalesce(slot, F.lit(-1)).cast("long")).drop("_ek_at")
    if counted:
        b, small = _counted(b, [*on, _CELL], _OWN), _counted(small, on, _ITS)
    to = F.array_distinct(F.transform(F.col(_CELLS)["slots"], lambda x: x["bucket"]))
    s = _found(_matching(small, on), on, table).withColumn(_CELL, F.explode(F.coalesce(to, F.array(F.lit(-1))).cast("array<long>")))
    return _met(*(x.withColumn(_PART, F.when(F.col(_CELL) >= 0, F.col(_CELL))).drop(_CELLS) for x in (b, s)), on, n, method)


def _few(rows: DataFrame, keys: int, other: Hot | None) -> bool:
    """Whether rows of so many keys are few enough to be broadcast.

    If these keys are known not to be hot on their side, the limit of that side bounds them; else they are
    counted, and counting stops beyond the bound.
    """
    if other is not None and keys * other.limit <= BROADCAST_ROWS:
        return True
    return rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _kept(rows: DataFrame, other: DataFrame, on: list[str], n: int, pick: list, method: str = "shuffle_hash", few: bool | None = None, counted: bool = False) -> DataFrame:
    """rows stay where they are and meet a broadcast of other, if that is small; else rows are spread. Counted, each row meets other's counts."""
    if counted:
        own = F.col(_ROWS) if _ROWS in rows.columns else F.lit(1).cast("long")
        rows, other = rows.withColumn(_OWN, own), _counted(other, on, _ITS)
    small = few if few is not None else _few(other, 0, None)
    return (rows.join(F.broadcast(other), on) if small else spread(rows, other, on, n, method)).select(*pick)


def _staying(big: DataFrame, small: DataFrame, on: list[str], hot_big: Hot, hot_small: Hot | None, n: int, ratio: float, pick: list, method: str, counted: bool = False) -> DataFrame:
    """prpd and flow: rows of keys that are hot on one side stay there, the other side's are broadcast.

    All else is one shuffled join, in which keys hot on both sides have grids (flow). Classes without
    keys have no join.
    """
    if not hot_big and not hot_small:
        return plain(big, small, on, method, counted).select(*pick)
    # Counts of hot keys have a row a key, if sides of one type agree about which keys are equal.
    met_once = counted and all(_type(big, c) == _type(small, c) for c in on)
    twice = set(hot_big.names()) & set(hot_small.names()) if hot_small else set()

    def only(hot: Hot) -> Hot:
        return Hot(on, [r for r, k in zip(hot.rows, hot.names()) if k not in twice], hot.schema, hot.total, hot.limit)

    stay_big, stay_small = only(hot_big), only(hot_small) if hot_small else None
    rest_b, rest_s = (stay_big.of(x, False) for x in (big, small))
    if stay_small:
        rest_b, rest_s = (stay_small.of(x, False) for x in (rest_b, rest_s))
    shapes = {k: v for k, v in grids(hot_big, hot_small, n).items() if k in twice} if twice else {}
    out = [(celled(rest_b, rest_s, on, _cells(big.sparkSession, hot_big, shapes), n, method, counted) if shapes else plain(rest_b, rest_s, on, method, counted)).select(*pick)]
    if stay_big:
        copied = stay_big.of(small, True)
        few = met_once or _few(copied, len(stay_big.rows), hot_small)
        out.append(_kept(stay_big.of(big, True), copied, on, n, pick, method, few, counted))
    if stay_small:
        # Classes are told apart by Spark's equality on both sides, so no pair is in two of them.
        own, copied = (stay_small.of(stay_big.of(x, False), True) for x in (small, big))
        few = met_once or _few(copied, len(stay_small.rows), hot_big if hot_big.total is not None else None)
        out.append(_kept(own, copied, on, n, pick, method, few, counted))
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result
