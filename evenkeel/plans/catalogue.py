"""The registered queries over the driver tables, and their SQL.

Fixtures F1 (hot probe keys), F2 (tiny key domain), F3 (all classes) and F4 (one key with more rows than
a partition's share, on both sides) are those of ``sources.fixtures``; six buckets make a grid of 2 x 3, and there are four senders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, placement
from ..operators import balance, detect, route
from ..sources import fixtures, generate, text
from . import assign, joins

N = 6
RATIO, FLOOR = 0.001, 10
STRATEGIES = ("base", "pnr", "prpd", "bnr", "flow")

# SQL blocks -------------------------------------------------------------------------------------
_HASH = "cast('0x' || substr(md5(cast({k} AS VARCHAR)), 1, 8) AS BIGINT)"
_HOME = f"{_HASH.format(k='k')} % {N}"


def _with(fixture: str, *more: str) -> str:
    """WITH big, small and their heavy keys, and more blocks."""
    parts = [f"{side} AS ({fixtures.SQL[f'{fixture}_{side}']})" for side in ("big", "small")]
    parts += [f"hot_{side} AS (SELECT k, count(*) AS cnt FROM {side} GROUP BY k HAVING count(*) > greatest({FLOOR}, floor({RATIO} * (SELECT count(*) FROM {side}))))" for side in ("big", "small")]
    return "WITH " + ", ".join([*parts, *more]) + " "


_HOT = "(SELECT k FROM hot_{side})"
_ALL = f"range({N})"
_IS = {"big": "k IN (SELECT k FROM hot_big)", "small": "k IN (SELECT k FROM hot_small)"}
_ORDER_F1 = ", ".join(fixtures.ORDER["f1_big"])
_ONE = "[CAST({x} AS BIGINT)]"
_GRID_COL = f"list_transform(range(2), lambda r: r * 3 + sender % 3)"
_GRID_ROW = f"list_transform(range(3), lambda c: (sender // 3) * 3 + c)"
#: Buckets of each side as SQL lists, by strategy; bnr's are a plan made from the counts.
_LISTS = {
    "base": (_ONE.format(x=_HOME), _ONE.format(x=_HOME)),
    "pnr": (f"CASE WHEN {_IS['big']} THEN {_ONE.format(x=f'(row_number() OVER (PARTITION BY sender, k ORDER BY {{order}}) - 1) % {N}')} ELSE {_ONE.format(x=_HOME)} END", f"CASE WHEN {_IS['big']} THEN {_ALL} ELSE {_ONE.format(x=_HOME)} END"),
    "prpd": (f"CASE WHEN {_IS['big']} THEN {_ONE.format(x='sender')} ELSE {_ONE.format(x=_HOME)} END", f"list_distinct(list_concat({_ONE.format(x=_HOME)}, coalesce((SELECT list(DISTINCT CAST(b.sender AS BIGINT)) FROM big b WHERE b.k = small.k AND b.k IN (SELECT k FROM hot_big)), [])))"),
    "flow": (
        f"CASE WHEN {_IS['big']} AND {_IS['small']} THEN {_GRID_COL} WHEN {_IS['big']} THEN {_ONE.format(x='sender')} WHEN {_IS['small']} THEN {_ALL} ELSE {_ONE.format(x=_HOME)} END",
        f"CASE WHEN {_IS['big']} AND {_IS['small']} THEN {_GRID_ROW} WHEN {_IS['big']} THEN {_ALL} WHEN {_IS['small']} THEN {_ONE.format(x='sender')} ELSE {_ONE.format(x=_HOME)} END",
    ),
}


def _placed_sql(fixture: str, strategy: str) -> str:
    big, small = _LISTS[strategy]
    order = ", ".join(fixtures.ORDER[f"{fixture}_big"])
    return _with(fixture, f"pb AS (SELECT *, unnest({big.replace('{order}', order)}) AS bucket FROM big)", f"ps AS (SELECT *, unnest({small}) AS bucket FROM small)")


# Spark ------------------------------------------------------------------------------------------
def _sides(spark: SparkSession, sf: str, fixture: str) -> assign.Sides:
    big, small = (fixtures.side(spark, sf, f"{fixture}_{s}") for s in ("big", "small"))
    return assign.Sides(big, small, order=fixtures.ORDER[f"{fixture}_big"], n=N, ratio=RATIO, floor=FLOOR)


def _big(spark: SparkSession, sf: str, fixture: str = "f1") -> DataFrame:
    return fixtures.side(spark, sf, f"{fixture}_big")


def _total(counts: DataFrame) -> DataFrame:
    """The rows of a join, from its pairs by key."""
    return counts.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("result_rows"))


Q: dict = {}
SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


_F1_COLUMNS = "k, l_orderkey, l_linenumber, l_extendedprice, value"
for _s in STRATEGIES:

    @_register(f"join_{_s}", _with("f1") + f"SELECT {_F1_COLUMNS} FROM big JOIN (SELECT k, value FROM small) USING (k)")
    def _join(spark, sf, s=_s):
        x = _sides(spark, sf, "f1")
        return joins.skew_join(x.big, x.small.drop("sender"), "k", s, ratio=RATIO, floor=FLOOR).select(*_F1_COLUMNS.split(", "))

    for _f in ("f2", "f3", "f4"):

        @_register(f"join_count_{_s}_{_f}", _with(_f) + "SELECT count(*) AS result_rows FROM big JOIN small USING (k)")
        def _count(spark, sf, s=_s, f=_f):
            x = _sides(spark, sf, f)
            return _total(joins.pair_counts(x.big.select("k", "sender"), x.small.select("k"), "k", s, ratio=RATIO, floor=FLOOR))

    @_register(f"placed_join_{_s}_f3", _with("f3") + "SELECT k, count(*) AS pairs FROM big JOIN small USING (k) GROUP BY k")
    def _placed(spark, sf, s=_s):
        if s in assign.ASKED:
            return assign.pairs_by_key(_sides(spark, sf, "f3"), s)
        big, small = assign.ASSIGN[s](_sides(spark, sf, "f3"))
        return assign.bucketed_counts(big, small, "k", N).groupBy("k").agg(F.sum("pairs").alias("pairs"))

    @_register(f"moved_rows_{_s}", None if _s == "bnr" else _placed_sql("f1", _s) + "SELECT 'big' AS side, count(*) AS rows, coalesce(sum(CAST(bucket <> sender AS BIGINT)), 0)::BIGINT AS moved FROM pb UNION ALL SELECT 'small', count(*), coalesce(sum(CAST(bucket <> sender AS BIGINT)), 0)::BIGINT FROM ps")
    def _moved(spark, sf, s=_s):
        return assign.moved(*assign.ASSIGN[s](_sides(spark, sf, "f1")))

    _loads_sql = f"buckets AS (SELECT unnest(range({N}))::INTEGER AS bucket), l AS (SELECT bucket, (SELECT count(*) FROM pb WHERE pb.bucket = buckets.bucket) AS big_rows, (SELECT count(*) FROM ps WHERE ps.bucket = buckets.bucket) AS small_rows FROM buckets) "

    @_register(f"load_by_bucket_{_s}", None if _s == "bnr" else _placed_sql("f1", _s).rstrip() + ", " + _loads_sql + "SELECT bucket, big_rows, small_rows FROM l")
    def _load(spark, sf, s=_s):
        return assign.loads(*assign.ASSIGN[s](_sides(spark, sf, "f1")), N)

    @_register(f"balance_ratio_{_s}", None if _s == "bnr" else _placed_sql("f1", _s).rstrip() + ", " + _loads_sql + "SELECT CAST(max(big_rows) - min(big_rows) AS DOUBLE) / max(big_rows) AS ratio, max(big_rows) / avg(big_rows) AS max_over_mean FROM l")
    def _ratio(spark, sf, s=_s):
        return assign.balance_ratio(assign.loads(*assign.ASSIGN[s](_sides(spark, sf, "f1")), N))


@_register("join_bnr_consensus", _with("f1") + f"SELECT {_F1_COLUMNS} FROM big JOIN (SELECT k, value FROM small) USING (k)")
def _consensus_join(spark, sf):
    x = _sides(spark, sf, "f1")
    agreed = heavy_consensus(spark, sf)
    counts = x.big.join(F.broadcast(agreed), "k", "left_semi").groupBy("k").agg(F.count("*").alias("cnt"))
    return joins.skew_join(x.big, x.small.drop("sender"), "k", "bnr", heavy=counts).select(*_F1_COLUMNS.split(", "))


@_register("join_auto", _with("f1") + f"SELECT {_F1_COLUMNS} FROM big JOIN (SELECT k, value FROM small) USING (k)")
def _auto(spark, sf):
    x = _sides(spark, sf, "f1")
    return joins.skew_join(x.big, x.small.drop("sender"), "k", "auto").select(*_F1_COLUMNS.split(", "))


for _f in ("f2", "f3", "f4"):

    @_register(f"join_count_auto_{_f}", _with(_f) + "SELECT count(*) AS result_rows FROM big JOIN small USING (k)")
    def _auto_count(spark, sf, f=_f):
        x = _sides(spark, sf, f)
        return _total(joins.pair_counts(x.big.select("k", "sender"), x.small.select("k"), "k"))


@_register("join_bnr_composite", _with("f1") + "SELECT count(*) AS result_rows, sum(l_linenumber)::BIGINT AS lines FROM (SELECT 'a,' || k AS x, sender, l_linenumber FROM big) b JOIN (SELECT 'a,' || k AS x, s.sender FROM small, (SELECT unnest(range(4)) AS sender) s) USING (x, sender)")
def _composite(spark, sf):
    """Keys of two columns."""
    x = _sides(spark, sf, "f1")
    key = F.concat(F.lit("a,"), F.col("k")).alias("x")
    small = x.small.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("sender"))
    out = joins.skew_join(x.big.select(key, "sender", "l_linenumber"), small, ["x", "sender"], "bnr", ratio=RATIO, floor=FLOOR)
    return out.agg(F.count("*").alias("result_rows"), F.sum("l_linenumber").alias("lines"))


@_register("join_bnr_double", _with("f1") + "SELECT count(*) AS result_rows FROM (SELECT k // 2 AS k FROM big) JOIN (SELECT DISTINCT k // 2 AS k FROM small) USING (k)")
def _double(spark, sf):
    """Keys of type double, 0 as -0.0 on one side."""
    x = _sides(spark, sf, "f1")
    key = F.floor(F.col("k") / 2).cast("double")
    big = x.big.select(F.when(key == 0, F.lit(-0.0)).otherwise(key).alias("k"), "sender")
    return joins.skew_join(big, x.small.select(key.alias("k")).distinct(), "k", "bnr", ratio=RATIO, floor=FLOOR).agg(F.count("*").alias("result_rows"))


@_register("options_join", _with("f1") + f"SELECT {_F1_COLUMNS} FROM big JOIN (SELECT k, value FROM small) USING (k)")
def _configured(spark, sf):
    """As settings text says: balanced spreading of the keys that all senders find."""
    from ..options import of

    x = _sides(spark, sf, "f1")
    options = of("hj_type=3 node_nums=6 balance_factor=0.3 dynamic_detect=1 enable_ld_sketch=1 frequency_threshold=0.001 # shipped values")
    return joins.configured_join(x.big, x.small.drop("sender"), "k", options, "sender").select(*_F1_COLUMNS.split(", "))


@_register("join_fetch_phase", _placed_sql("f1", "pnr") + f"SELECT pb.bucket::INTEGER AS bucket, k, count(*) AS pairs FROM pb JOIN ps USING (bucket, k) WHERE bucket <> {_HOME} GROUP BY ALL")
def _fetched(spark, sf):
    """Pairs met away from the key's home: what fetching build rows adds to the first phase."""
    big, small = assign.pnr(_sides(spark, sf, "f1"))
    met = assign.bucketed_join(big, small, "k")
    return met.where(F.col("bucket") != placement.home(F.col("k"), N)).groupBy("bucket", "k").agg(F.count("*").alias("pairs"))


def _class_join(spark, sf, name: str) -> DataFrame:
    s = _sides(spark, sf, "f3")
    big, small = (x.where(F.col("class") == name).drop("class") for x in assign.classes(s))
    if name == "both":
        out = joins.crossed(big, small.drop("sender"), ["k"], N)
    elif name == "small":
        out = joins._kept(small.drop("sender"), big, ["k"], N, ["k"])
    else:
        out = joins._kept(big, small.drop("sender"), ["k"], N, ["k"])
    return out.groupBy("k").agg(F.count("*").alias("pairs"))


for _q, _c, _w in (("join_grid", "both", f"{_IS['big']} AND {_IS['small']}"), ("join_mirror", "small", f"NOT {_IS['big']} AND {_IS['small']}"), ("join_ordinary_skew", "big", f"{_IS['big']} AND NOT {_IS['small']}")):

    @_register(_q, _with("f3") + f"SELECT k, count(*) AS pairs FROM big JOIN small USING (k) WHERE {_w} GROUP BY k")
    def _of_class(spark, sf, c=_c):
        return _class_join(spark, sf, c)


@_register("class_partition", _with("f3") + ", ".join(["SELECT side, class, count(DISTINCT k) AS n_keys, count(*) AS n_rows FROM (SELECT 'big' AS side, k, CASE WHEN b AND s THEN 'both' WHEN b THEN 'big' WHEN s THEN 'small' ELSE 'light' END AS class FROM (SELECT k"]) + f", {_IS['big']} AS b, {_IS['small']} AS s FROM big) UNION ALL SELECT 'small', k, CASE WHEN b AND s THEN 'both' WHEN b THEN 'big' WHEN s THEN 'small' ELSE 'light' END FROM (SELECT k, {_IS['big']} AS b, {_IS['small']} AS s FROM small)) GROUP BY side, class")
def _classes(spark, sf):
    big, small = assign.classes(_sides(spark, sf, "f3"))
    both = big.select(F.lit("big").alias("side"), "k", "class").unionByName(small.select(F.lit("small").alias("side"), "k", "class"))
    return both.groupBy("side", "class").agg(F.count_distinct("k").alias("n_keys"), F.count("*").alias("n_rows"))


# Detectors
@_register("heavy_exact", _with("f1") + "SELECT k, cnt FROM hot_big")
def heavy_exact(spark, sf):
    return detect.heavy_exact(_big(spark, sf), "k", RATIO, FLOOR)


@_register("heavy_offline", _with("f1") + f"SELECT k, count(*) AS cnt FROM big GROUP BY k HAVING count(*) > {RATIO} * (SELECT count(*) FROM big)")
def _offline(spark, sf):
    return detect.heavy_exact(_big(spark, sf), "k", RATIO, 0)


@_register("heavy_local", _with("f1") + f"SELECT sender, k, count(*) AS cnt FROM big WHERE {_IS['big']} GROUP BY sender, k")
def _local_counts(spark, sf):
    return detect.heavy_local(_big(spark, sf), "k", "sender", heavy_exact(spark, sf))


@_register("heavy_static", _with("f1") + f"SELECT {_IS['big']} AS heavy, count(*) AS n_rows FROM big GROUP BY ALL")
def _static(spark, sf):
    return detect.flagged_static(_big(spark, sf), "k", heavy_exact(spark, sf)).groupBy("heavy").agg(F.count("*").alias("n_rows"))


_ONLINE = f"flagged AS (SELECT *, (row_number() OVER (PARTITION BY sender, k ORDER BY {_ORDER_F1}) - 1) > greatest({FLOOR}, floor({RATIO} * row_number() OVER (PARTITION BY sender ORDER BY {_ORDER_F1}))) AS heavy FROM big)"


def _online(spark, sf):
    return detect.flagged_online(_big(spark, sf), "k", "sender", list(fixtures.ORDER["f1_big"]), RATIO, FLOOR)


@_register("heavy_online_rows", _with("f1", _ONLINE) + "SELECT sender, count(*) AS n_rows, count(*) FILTER (heavy) AS flagged FROM flagged GROUP BY sender")
def _online_rows(spark, sf):
    return _online(spark, sf).groupBy("sender").agg(F.count("*").alias("n_rows"), F.count_if("heavy").alias("flagged"))


@_register("heavy_consensus", _with("f1", _ONLINE) + f"SELECT k FROM (SELECT DISTINCT sender, k FROM flagged WHERE heavy) GROUP BY k HAVING count(*) = {fixtures.SENDERS}")
def heavy_consensus(spark, sf):
    return detect.consensus(detect.ever_flagged(_online(spark, sf), "k", "sender"), "k", "sender", fixtures.SENDERS)


@_register("heavy_union", _with("f1", _ONLINE) + "SELECT DISTINCT k FROM flagged WHERE heavy")
def _union(spark, sf):
    return detect.union(detect.ever_flagged(_online(spark, sf), "k", "sender"), "k")


@_register("heavy_sketch")
def _sketch(spark, sf):
    """Row by row, with a bounded counter that evicts: depends on order, so it has no SQL."""
    flagged = detect.flagged_sketch(_big(spark, sf), "k", "sender", list(fixtures.ORDER["f1_big"]), ratio=RATIO, floor=FLOOR)
    return flagged.groupBy("sender").agg(F.count("*").alias("n_rows"), F.count_if("heavy").alias("flagged"))


@_register("sketch_flags", _with("f2") + "SELECT sender, k, count(*) AS cnt, count(*) - 1 AS own, count(*) - 1 >= greatest(10, floor(0.001 * any_value(n))) AS heavy FROM big JOIN (SELECT sender, count(*) AS n FROM big GROUP BY sender) USING (sender) GROUP BY sender, k")
def _flags(spark, sf):
    """The bounded sketch of each sender, with hits since entry and flags: exact where keys fit its capacity."""
    return detect.sketch_dumped(_big(spark, sf, "f2"), "k", "sender", ["o_orderkey"], ratio=RATIO, floor=FLOOR).select("sender", "k", "cnt", "own", "heavy")


@_register("heavy_mergeable", _with("f1") + "SELECT sender, k FROM (SELECT sender, k, count(*) AS c FROM big GROUP BY sender, k) JOIN (SELECT sender, count(*) AS n FROM big GROUP BY sender) USING (sender) WHERE c > greatest(10, floor(0.001 * n))")
def _mergeable(spark, sf):
    """Each sender's hot keys by sketches that are combined; exact where a sender's keys fit them."""
    return detect.found_by_sketch(_big(spark, sf), "k", "sender", RATIO, FLOOR, items=100_000)


@_register("sketch_dump", _with("f2") + "SELECT k, count(*) AS cnt FROM big GROUP BY k")
def _dump(spark, sf):
    """All counts of a domain that fits the sketch are exact."""
    return detect.sketched(_big(spark, sf, "f2"), "k", 50, 1000)


@_register("sketch_merged", _with("f1") + f"SELECT k FROM hot_big WHERE cnt > 0.01 * (SELECT count(*) FROM big)")
def _merged(spark, sf):
    """Keys of over a hundredth of the rows, from sketches by sender, confirmed exactly."""
    big = _big(spark, sf)
    found = detect.sketched_by_sender(big, "k", "sender", 50, 5000)
    counts = big.join(F.broadcast(found.select("k")), "k", "left_semi").groupBy("k").agg(F.count("*").alias("cnt"))
    return counts.join(F.broadcast(big.agg(F.count("*").alias("n"))), F.col("cnt") > 0.01 * F.col("n")).select("k")


@_register("key_counts_heavy", _with("f1", _ONLINE) + "SELECT sender, k, count(*) AS cnt FROM flagged WHERE heavy GROUP BY sender, k")
def _key_counts(spark, sf):
    return _online(spark, sf).where("heavy").groupBy("sender", "k").agg(F.count("*").alias("cnt"))


# Routers
def _routed(name: str, make, buckets: str, told: str):
    @_register(f"route_{name}", _with("f3") + f"SELECT o_orderkey, k, list_sort({buckets})::INTEGER[]::VARCHAR AS buckets, list_sort({told})::INTEGER[]::VARCHAR AS told FROM big")
    def _route(spark, sf):
        to, tell = make()
        show = lambda c: F.concat(F.lit("["), F.array_join(F.sort_array(c), ", "), F.lit("]"))
        return _big(spark, sf, "f3").select("o_orderkey", "k", show(to).alias("buckets"), show(tell).alias("told"))


_ALL_BUT_HOME = f"list_filter({_ALL}, lambda b: b <> {_HOME})"
_routed("hash", lambda: route.by_hash(F.col("k"), N), _ONE.format(x=_HOME), "[]")
_routed("mirror", lambda: route.mirror(N), _ALL, "[]")
_routed("average", lambda: route.average("k", "sender", ["o_orderkey"], N), _ONE.format(x=f"(row_number() OVER (PARTITION BY sender, k ORDER BY o_orderkey) - 1) % {N}"), _ALL_BUT_HOME)
_routed("local", lambda: route.local(F.col("k"), F.col("sender"), N), _ONE.format(x="sender"), f"CASE WHEN sender = {_HOME} THEN [] ELSE {_ONE.format(x='sender')} END")
_routed("local_tell_all", lambda: route.local_tell_all(F.col("sender"), N), _ONE.format(x="sender"), _ALL)
_routed("fixed", lambda: route.fixed([1, 4], N), "[1, 4]", _ALL)
_routed("notify", lambda: route.tell_only(N), "[]", _ALL)


@_register("route_balance_plan", _with("f1") + "SELECT k, cnt AS assigned FROM hot_big")
def _plan(spark, sf):
    """The plan gives each row of a heavy key exactly one bucket."""
    table = balance.planned(spark, heavy_exact(spark, sf), "k", N)
    return table.groupBy("k").agg(F.sum(F.col("hi") - F.col("lo")).alias("assigned"))


@_register("route_balance_sequence", _with("f1", _ONLINE) + "SELECT sender, count(*) AS cnt FROM flagged WHERE heavy GROUP BY sender")
def _sequence(spark, sf):
    """Each heavy row is sent once by the sequential balancer."""
    sent = balance.sent_in_sequence(_online(spark, sf).where("heavy").select("sender", "k", *fixtures.ORDER["f1_big"]), "k", "sender", list(fixtures.ORDER["f1_big"]), N)
    return balance.load(sent, "sender").groupBy("sender").agg(F.sum("cnt").alias("cnt"))


@_register("grid_layout", f"SELECT b::INTEGER AS bucket, (b // 3)::INTEGER AS grid_row, (b % 3)::INTEGER AS grid_col, range((b // 3) * 3, (b // 3) * 3 + 3)::INTEGER[]::VARCHAR AS row_buckets, [b % 3, b % 3 + 3]::INTEGER[]::VARCHAR AS col_buckets FROM (SELECT unnest(range({N})) AS b)")
def _layout(spark, sf):
    cols = placement.grid(N)[1]
    b = F.col("bucket")
    show = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    return spark.range(N).select(F.col("id").cast("int").alias("bucket")).select("bucket", F.floor(b / cols).cast("int").alias("grid_row"), (b % cols).cast("int").alias("grid_col"), show(placement.grid_row(b, N)).alias("row_buckets"), show(placement.grid_column(b, N)).alias("col_buckets"))


# Sources, generators
@_register("scan_text_pair", "SELECT split_part(line, ',', 1) AS key, substr(line, strpos(line, ',') + 1) AS value FROM (SELECT p_partkey || ',' || p_name || ',' || p_brand AS line FROM part)")
def _scan(spark, sf):
    lines = spark.read.parquet(f"{sf}/part.parquet").select(F.concat_ws(",", "p_partkey", "p_name", "p_brand").alias("value"))
    return text.pairs(lines)


_U = "(cast('0x' || substr(md5('{seed}:' || o_orderkey), 1, 8) AS BIGINT) / 4294967296.0)"


@_register("generate_uniform", f"SELECT o_orderkey, floor({_U.format(seed=7)} * 1000)::BIGINT AS k FROM orders")
def _uniform(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", keys.uniform_key(F.col("o_orderkey"), 1000, 7).alias("k"))


@_register("generate_zipf", f"SELECT k, count(*) AS cnt FROM (SELECT least(1000, floor(pow((pow(1001.0, -0.25) - 1) * {_U.format(seed=7)} + 1, 1 / -0.25)))::BIGINT AS k FROM orders) GROUP BY k")
def _zipf(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").groupBy(keys.zipf_key(F.col("o_orderkey"), 1000, 1.25, 7).alias("k")).agg(F.count("*").alias("cnt"))


_SHARE, _OTHER = keys.alias_table(1000, 1.25)


@_register("generate_zipf_discrete", f"WITH t AS (SELECT {list(_SHARE)} AS share, {list(_OTHER)} AS other), r AS (SELECT floor({_U.format(seed=7)} * 1000)::BIGINT AS rank, {_U.format(seed=8)} AS u FROM orders) SELECT CAST(CASE WHEN u < share[rank + 1] THEN rank ELSE other[rank + 1] END + 1 AS BIGINT) AS k, count(*) AS cnt FROM r, t GROUP BY 1")
def _discrete(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").groupBy(keys.discrete_zipf_key(F.col("o_orderkey"), 1000, 1.25, 7).alias("k")).agg(F.count("*").alias("cnt"))


@_register("skew_transplant", f"SELECT count(*) AS n_rows, count(*) FILTER ({_U.format(seed=3)} < 0.2) AS moved FROM orders")
def _transplant(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey")
    return generate.transplanted(rows, "o_custkey", -1, 0.2, 3, "o_orderkey").agg(F.count("*").alias("n_rows"), F.count_if(F.col("o_custkey") == -1).alias("moved"))


_BYTES = "octet_length(encode(CAST(k AS VARCHAR))) + octet_length(encode(value))"
for _s in ("base", "prpd", "pnr", "flow"):

    @_register(f"moved_bytes_{_s}", _placed_sql("f1", _s).replace("AS bucket FROM big)", "AS bucket, l_orderkey || ',' || l_linenumber AS value FROM big)") + f"SELECT side, phase, count(*) AS rows, coalesce(sum({_BYTES}), 0)::BIGINT AS bytes FROM (SELECT 'big' AS side, 'sent' AS phase, k, value FROM pb WHERE bucket <> sender UNION ALL SELECT 'small', CASE WHEN bucket = {_HOME} THEN 'sent' ELSE 'fetched' END, k, value FROM ps WHERE bucket <> sender) GROUP BY side, phase")
    def _moved_bytes(spark, sf, s=_s):
        big, small = assign.ASSIGN[s](_sides(spark, sf, "f1"))
        return assign.moved_bytes(big.withColumn("value", F.concat_ws(",", "l_orderkey", "l_linenumber")), small, "k", "value", N)


@_register("run_statistics", _placed_sql("f1", "prpd") + f"SELECT (SELECT count(*) FROM pb JOIN ps USING (bucket, k)) AS result_rows, (SELECT count(*) FROM pb WHERE bucket <> sender) + (SELECT count(*) FROM ps WHERE bucket <> sender AND bucket = {_HOME}) AS shuffled_rows, (SELECT count(*) FROM ps WHERE bucket <> {_HOME} AND bucket <> sender) AS fetched_rows")
def _statistics(spark, sf):
    """Result rows, and rows that leave their sender: by hash, and those fetched on request."""
    big, small = assign.prpd(_sides(spark, sf, "f1"))
    away = F.col("bucket") != F.col("sender")
    at_home = F.col("bucket") == placement.home(F.col("k"), N)
    b = assign.placed(big).agg(F.count_if(away).alias("b"))
    s = assign.placed(small).agg(F.count_if(away & at_home).alias("s"), F.count_if(away & ~at_home).alias("fetched_rows"))
    r = assign.bucketed_join(big, small, "k").agg(F.count("*").alias("result_rows"))
    one = lambda df: df.withColumn("one", F.lit(1))  # noqa: E731  three single rows
    return one(r).join(one(b), "one").join(one(s), "one").select("result_rows", (F.col("b") + F.col("s")).alias("shuffled_rows"), "fetched_rows")


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
