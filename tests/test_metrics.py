from evenkeel.operators import metrics
from evenkeel.plans import joins


def test_timed(spark):
    big = spark.range(1000).selectExpr("id % 7 AS k", "id AS b")
    small = spark.range(7).selectExpr("id AS k", "id AS s")
    run = metrics.timed(joins.skew_join(big, small, "k", "prpd", ratio=0.01, floor=5))
    assert run.rows == 1000 and run.seconds > 0 and run.million_rows_a_second > 0
    # A plain join exchanges both sides; here all keys are hot, and their rows stay.
    plain = metrics.timed(joins.skew_join(big, small, "k", "base"))
    assert plain.shuffled_rows == 1007 and plain.shuffled_bytes > 0 and run.shuffled_rows < 100
    assert metrics.Run(5, 0.0).million_rows_a_second == 0.0


def test_key_counts(spark):
    rows = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert [tuple(r) for r in metrics.key_counts(rows, "k").collect()] == [(1, 2), (2, 1)]
