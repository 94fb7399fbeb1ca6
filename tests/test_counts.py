"""Counts of a join's pairs equal the join's, and don't make the pairs."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from evenkeel.options import STRATEGIES
from evenkeel.plans import assign, catalogue, joins

from .test_joins import KEYS, tables

ALL = [*STRATEGIES, "auto"]


def counted(out):
    """Pairs by key, in a form that tells keys apart as Spark does: -0.0 is 0.0, NaN is NaN."""
    return Counter({repr(r[0]).replace("-0.0", "0.0"): r["pairs"] for r in out.collect()})


def plain(big, small):
    return counted(joins.skew_join(big, small, "k", "base").groupBy("k").agg(F.count("*").alias("pairs")))


def join_rows(df):
    """Rows that the joins of a collected query gave out, all of them together."""

    def under(p):
        name = p.getClass().getSimpleName()
        own = p.metrics().apply("numOutputRows").value() if name.endswith("JoinExec") else 0
        below = [p.executedPlan()] if name == "AdaptiveSparkPlanExec" else [p.plan()] if name.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
        return own + sum(map(under, below))

    return under(df._jdf.queryExecution().executedPlan())


N_BIG, N_SMALL = 20000, 2000


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """Tables in which fixtures F3 and F4 have 240000 and 1.2 million pairs of one key."""
    out = str(tmp_path_factory.mktemp("skewed"))
    i = F.col("id")
    tables = {
        "lineitem": spark.range(N_BIG).select(i.alias("l_orderkey"), (i % N_SMALL).alias("l_partkey")),
        "part": spark.range(N_SMALL).select(i.alias("p_partkey")),
        "orders": spark.range(N_BIG).select(i.alias("o_orderkey"), (i % N_SMALL).alias("o_custkey")),
        "customer": spark.range(N_SMALL).select(i.alias("c_custkey")),
    }
    for name, rows in tables.items():
        rows.write.parquet(f"{out}/{name}.parquet")
    return out


@pytest.mark.parametrize("strategy", ALL)
def test_count_makes_no_pairs(spark, skewed, strategy):
    big = Counter(1 if i % 10 < 6 else i % N_SMALL for i in range(N_BIG))
    small = Counter(1 if i % 20 == 0 else i for i in range(N_SMALL))
    df = catalogue.queries()[f"join_count_{strategy}_f4"](spark, skewed)
    assert df.collect()[0]["result_rows"] == sum(n * small[k] for k, n in big.items())
    assert join_rows(df) < 3 * (N_BIG + N_SMALL)


@pytest.mark.parametrize("strategy", ALL)
@pytest.mark.parametrize("kind", ["double", "float in struct", "text"])
def test_counts_of_all_kinds_of_keys(spark, strategy, kind):
    ddl, value = KEYS[kind]
    big = spark.createDataFrame([(value(i), i) for i in range(300)], f"k {ddl}, b int")
    small = spark.createDataFrame([(value(2 * i + 1), i) for i in range(45)], f"k {ddl}, s int")
    assert counted(joins.pair_counts(big, small, "k", strategy, n=3, ratio=0.15, floor=2, method="merge")) == plain(big, small)


@pytest.mark.parametrize("strategy", ALL)
def test_counts_of_keys_hot_on_either_side(spark, strategy):
    """Key 1 is hot in both, 2 in big, 3 in small; with keys counted or given."""
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, 2).when(F.col("id") < 20, 3).otherwise(F.col("id")).alias("k"))
    small = spark.range(1500).select(F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, 3).when(F.col("id") < 20, 2).otherwise(F.col("id")).alias("k"))
    want = plain(big, small)
    for given in (None, spark.createDataFrame([(2,), (3,)], "k long"), spark.createDataFrame([(1, 1000), (7, 1)], "k long, cnt long")):
        assert counted(joins.pair_counts(big, small, "k", strategy, n=5, heavy=given, ratio=0.05)) == want


@pytest.mark.parametrize("strategy", ALL)
def test_counts_of_names_types_and_composite_keys(spark, strategy, monkeypatch):
    big = spark.createDataFrame([(i % 3, "x" if i % 4 else None, i) for i in range(90)], "K int, y string, b int")
    small = spark.createDataFrame([(j % 4 + (1 << 40) * (j % 2), "x", j) for j in range(60)], "k long, y string, b int")
    join = joins.skew_join(big, small, ["k", "y"], "base").count()
    for rows in (joins.BROADCAST_ROWS, 0):  # with none, rows are spread
        monkeypatch.setattr(joins, "BROADCAST_ROWS", rows)
        out = joins.pair_counts(big, small, ["k", "y"], strategy, n=3, ratio=0.01, floor=5)
        assert out.columns == ["k", "y", "pairs"] and sum(r["pairs"] for r in out.collect()) == join > 0
    assert joins.pair_counts(big, small.where("b < 0"), ["k", "y"], strategy, n=3, ratio=0.01, floor=5).count() == 0
    none = joins.pair_counts(big.where("b < 0"), small, "k", strategy, n=3, ratio=0.01, floor=5)
    assert catalogue._total(none).collect()[0]["result_rows"] == 0


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_placed_count_makes_no_pairs(spark, skewed, strategy):
    key = lambda i: 3 if i in (4, 5) else 1 if i % 10 < 3 else 2 if i % 10 == 3 else 1000 + i % N_SMALL
    big = Counter(map(key, range(N_BIG)))
    small = Counter(2 if i == 9 else 1 if i % 100 < 2 else 3 if i % 100 < 4 else 1000 + i for i in range(N_SMALL))
    df = catalogue.queries()[f"placed_join_{strategy}_f3"](spark, skewed)
    assert {r["k"]: r["pairs"] for r in df.collect()} == {k: n * small[k] for k, n in big.items() if small[k]}
    assert join_rows(df) < 4 * (N_BIG + N_SMALL)


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_placed_counts_are_those_of_the_join(spark, strategy):
    """In each bucket, null keys and keys hot on either side included."""
    big, small, _, _ = tables(spark, 7)
    placed = assign.ASSIGN[strategy](assign.Sides(big, small, order=("b",), n=5, ratio=0.05, floor=20))
    want = assign.bucketed_join(*placed, "k", 5).groupBy("bucket", "k").agg(F.count("*").alias("pairs"))
    assert {tuple(r) for r in assign.bucketed_counts(*placed, "k", 5).collect()} == {tuple(r) for r in want.collect()}


def read(spark, rows, ddl):
    """A table, and how many of its rows have been read so far."""
    seen = spark.sparkContext.accumulator(0)

    def one(r):
        seen.add(1)
        return r

    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 3).map(one), ddl), seen


@pytest.mark.parametrize("strategy", ["prpd", "auto", "bnr", "flow", "pnr"])
def test_counts_read_big_once(spark, strategy):
    """Finding hot keys and counting read the same counts; key 1 is hot in both sides."""
    rows = [(1 if i % 2 else i,) for i in range(2000)]
    big, seen = read(spark, rows, "k long")
    small = spark.createDataFrame([(1 if i % 3 else i,) for i in range(300)], "k long")
    its = Counter(r["k"] for r in small.collect())
    out = joins.pair_counts(big, small, "k", strategy, n=4, ratio=0.05)
    assert counted(out) == {repr(k): n * its[k] for k, n in Counter(k for (k,) in rows).items() if its[k]}
    assert seen.value == len(rows)


@pytest.mark.parametrize("strategy", ["flow", "prpd"])
def test_placed_count_reads_rows_once_and_hot_ones_again(spark, strategy, monkeypatch):
    """Big was read for its counts, for its number of rows and to be placed; key 1 is hot in both sides, 2 in big, 3 in small."""
    rows = [((1, 2)[i % 2] if i % 10 < 6 else i % 300 + 3, i % 4, i) for i in range(4000)]
    its = [((1, 3)[i % 2] if i % 10 < 3 else i + 1, i % 4, i) for i in range(900)]
    big, seen = read(spark, rows, "k long, sender long, o_orderkey long")
    sides = {"f3_big": big, "f3_small": spark.createDataFrame(its, "k long, sender long, c_custkey long")}
    monkeypatch.setattr(catalogue.fixtures, "side", lambda spark, sf, name: sides[name])
    want = Counter(k for k, *_ in its)
    df = catalogue.queries()[f"placed_join_{strategy}_f3"](spark, "")
    assert {r["k"]: r["pairs"] for r in df.collect()} == {k: n * want[k] for k, n in Counter(k for k, *_ in rows).items() if want[k]}
    assert seen.value <= 2 * len(rows)


@pytest.mark.parametrize("strategy", ["flow", "prpd"])
def test_pairs_by_key_of_odd_sides(spark, strategy):
    """Null keys, keys of two types, given hot keys, no hot keys, and an empty side."""
    big, small, b, s = tables(spark, 8)
    want = {k: n * Counter(x[0] for x in s)[k] for k, n in Counter(x[0] for x in b).items() if k is not None and any(x[0] == k for x in s)}
    known = spark.createDataFrame([(1,), (99,)], "k long")
    for small_side, floor, given, pairs in ((small, 20, None, want), (small, 20, known, want), (small, 1000, None, want), (small.where("s < 0"), 20, None, {})):
        sides = assign.Sides(big, small_side.withColumn("k", F.col("k").cast("int")), n=5, ratio=0.05, floor=floor, heavy_big=given)
        out = assign.pairs_by_key(sides, strategy)
        assert out.columns == ["k", "pairs"] and sorted(map(tuple, out.collect())) == sorted(pairs.items())
