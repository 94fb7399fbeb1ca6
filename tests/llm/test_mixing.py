import random

import pytest
from pyspark.sql import functions as F

from evenkeel.llm import mixing
from evenkeel.llm.mixing import dealt_whole, drawn, mixed, splitting_tree, taken_whole, targets

SCHEMA = "doc_id long, text string, source string"


def water_filled(sizes, weights=(5, 2, 1), repeats=3):
    """Targets by repeated sharing of what is over."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), float(sum(sizes.values()))
    while True:
        level = left / sum(w[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * w[s] >= repeats * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = repeats * sizes[s]
            left -= out[s]
        open_ -= over


def corpus(seed, n=200):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" for _ in range(rng.choice([1, 5, 30, 200]))), rng.choice(["a", "a", "a", "b", "c", "é", "Z", None])) for i in range(n)]
    return rows + [(900, None, "a"), (901, " \n\t ", "b"), (902, "", None), (903, None, "empty")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_words_taken(spark, seed):
    rows = corpus(seed)
    sizes, size_of = {}, {}
    for i, t, s in rows:
        size_of[i] = len((t or "").split())
        sizes[s] = sizes.get(s, 0) + size_of[i]
    want = water_filled(sizes)
    mix = mixed(spark.createDataFrame(rows, SCHEMA), shards=5, blocks=20)
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    got = mix.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken")).collect()
    assert len(got) == len(rows)
    total = {}
    for r in got:
        assert r["size"] == size_of[r["doc_id"]] and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        total[r["source"]] = total.get(r["source"], 0) + r["taken"]
    assert all(abs(total[s] - want[s]) <= 0.5 + 1e-6 for s in want)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken")).collect())) if None not in sizes else True


@pytest.mark.parametrize("buckets,fan", [(50, 64), (None, 4), (50, 7)])
def test_ranks_by_runs(spark, buckets, fan):
    from evenkeel.llm.common import ranked

    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2]), rng.choice(["a", None]), rng.randrange(50), i, rng.randrange(9)) for i in range(600)]
    got = ranked(spark.createDataFrame(rows, "g int, t string, b int, i int, v int"), ["g", "t"], ["i"], F.col("v"), F.col("b"), buckets, fan).collect()
    want = {r[3]: sum(x[4] for x in rows if x[:2] == r[:2] and (x[2], x[3]) < (r[2], r[3])) for r in rows}
    assert {r["i"]: r["before"] for r in got} == want and got[0].asDict().keys() == {"g", "t", "b", "i", "v", "before"}
    none = ranked(spark.createDataFrame(rows, "g int, t string, b int, i int, v int"), [], ["i"], F.lit(1), F.col("b"), buckets, fan).collect()
    assert {r["i"]: r["before"] for r in none} == {r[3]: j for j, r in enumerate(sorted(rows, key=lambda r: (r[2], r[3])))}


def test_only_what_the_tree_deals_is_taken(spark, monkeypatch):
    """Shards of the right half deal nothing: their blocks are in no mix, and what is left has the tree's shards."""
    docs = spark.createDataFrame([r for r in corpus(8, 400) if r[0] < 900], SCHEMA)
    whole = drawn(mixed(docs, shards=4, blocks=20)).collect()
    true = mixing.splitting_tree
    monkeypatch.setattr(mixing, "splitting_tree", lambda q, shards, seed: true(q, shards, seed).withColumn("shards_of", F.transform("shards_of", lambda x: F.when(x < 2, x))))
    half = drawn(mixed(docs, shards=4, blocks=20)).collect()
    assert sorted(map(tuple, half)) == sorted(tuple(r) for r in whole if r["shard"] < 2) and 0 < len(half) < len(whole)
    got = dealt_whole(docs, shards=4, blocks=20).select("shard").distinct().collect()
    assert {r[0] for r in got} == {0, 1}


def plainly(rows, shards, blocks, seed, tree):
    """The mix of (doc_id, text, source, h, size) by sorting and walking: words drawn by (doc_id, copy, start, shard)."""
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    quota = {s: round(t) for s, t in water_filled({s: sum(r["size"] for r in x) for s, x in by.items()}).items()}
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
    out = []
    for rank, s in enumerate(names):
        length, at = max(1, -(-quota[s] // blocks)), 0
        n = -(-sum(r["size"] for r in by[s]) // 1)
        top = max(1, -(-len(rows) // mixing.BUCKET))
        stream = sorted(by[s], key=lambda r: (((r["h"] % (1 << 64)) >> 32) * top // (1 << 32), r["h"]))
        for copy in range(3):
            for r in stream:
                for w in range(r["size"]):
                    if at < quota[s]:
                        out.append((r["doc_id"], copy, w, tree[rank][at // length]))
                    at += 1
        assert at == 3 * n
    return out


def test_mix_is_the_plain_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 16)
    docs = spark.createDataFrame([r for r in corpus(9, 150) if r[0] < 900], SCHEMA)
    rows = docs.select("*", mixing._h(3).alias("h"), mixing.n_words().alias("size")).collect()
    sized = mixing._quotas(docs.select("source", mixing.n_words().alias("size")), (5, 2, 1), 3).withColumn("length", F.greatest(F.lit(1), F.ceil(F.col("quota") / 10)))
    tree = {r["rank"]: r["shards_of"] for r in splitting_tree(sized.select("rank", F.ceil(F.col("quota") / F.col("length")).alias("blocks")), 3, 3).collect()}
    got = [(r["doc_id"], r["copy"], w, r["shard"]) for r in drawn(mixed(docs, shards=3, blocks=10)).collect() for w in range(r["start"], r["start"] + r["words"])]
    assert sorted(got) == sorted(plainly(rows, 3, 10, 3, tree))


def test_repeated_rows_are_spread_and_reruns_agree(spark, monkeypatch):
    """A third of the rows are one row, another third share an id: the mix doesn't depend on how the table is split."""
    monkeypatch.setattr(mixing, "COPIES", 50)
    monkeypatch.setattr(mixing, "BUCKET", 64)
    rows = [(None, "same text here", "a") if i % 3 == 0 else (7, "w " * (1 + i % 9), "abc"[i % 5 % 3]) if i % 3 == 1 else (i, "x " * (i % 7), "b") for i in range(900)]
    docs = spark.createDataFrame(rows, SCHEMA)
    show = lambda df: sorted((str(r["doc_id"]), str(r["source"]), r["size"], str([tuple(x) for x in r["spans"]])) for r in mixed(df).collect())
    a = show(docs.repartition(3, "text"))
    assert a == show(docs.coalesce(1)) and len(a) == 900
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "abc"}
    total = {r["source"]: r["n"] for r in drawn(mixed(docs)).groupBy("source").agg(F.sum("words").alias("n")).collect()}
    assert total == {s: round(t) for s, t in water_filled(sizes).items()}
    times = sorted(r["text"] for r in taken_whole(docs.repartition(3, "text")).collect())
    assert times == sorted(r["text"] for r in taken_whole(docs.coalesce(1)).collect())


def test_spans_are_disjoint_and_shards_even(spark):
    rows = corpus(4, 400)
    spans = drawn(mixed(spark.createDataFrame(rows, SCHEMA), shards=5, blocks=20)).collect()
    seen = {}
    for r in spans:
        words = seen.setdefault((r["doc_id"], r["copy"]), set())
        now = set(range(r["start"], r["start"] + r["words"]))
        assert now and not words & now
        words |= now
    by_block = {(r["source"], r["block"]): r["shard"] for r in spans}
    assert all(by_block[r["source"], r["block"]] == r["shard"] for r in spans)
    per_shard = [sum(1 for s in by_block.values() if s == i) for i in range(5)]
    assert max(per_shard) - min(per_shard) <= 5 and set(by_block.values()) == set(range(5))


def test_tree_keeps_quotas(spark):
    quotas = {0: 17, 1: 0, 2: 40, 3: 3}
    for shards in (1, 2, 7, 8):
        out = splitting_tree(spark.createDataFrame(list(quotas.items()), "rank int, blocks long"), shards, 3).collect()
        assert {r["rank"]: len(r["shards_of"]) for r in out} == quotas
        load = [sum(r["shards_of"].count(i) for r in out) for i in range(shards)]
        assert sum(load) == 60 and max(load) - min(load) <= shards.bit_length()


def test_tree_is_hypergeometric(spark):
    """Means over seeds of what one source sends left match draws without replacement."""
    q = spark.createDataFrame([(0, 10), (1, 30)], "rank int, blocks long")
    left = [next(r["shards_of"] for r in splitting_tree(q, 2, seed).collect() if r["rank"] == 0).count(0) for seed in range(30)]
    assert 4 < sum(left) / 30 < 6 and len(set(left)) > 1


def test_whole_documents(spark):
    rows = corpus(5, 600)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", size int, row int")
    out = taken_whole(docs)
    assert out.columns == docs.columns
    times = {}
    for r in out.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= 3 and not {900, 901, 902, 903} & set(times)
    sizes, total = {}, {}
    for i, t, s in rows:
        n = len((t or "").split())
        sizes[s] = sizes.get(s, 0) + n
        total[s] = total.get(s, 0) + n * times.get(i, 0)
    want = water_filled(sizes)
    assert all(abs(total[s] - want[s]) <= 200 for s in want)


def test_repeated_ids_do_not_overshoot(spark):
    """A third of the documents share a null doc_id, another third one id; targets are met to within a document."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, "w " * (1 + i % 9), "abc"[i % 5 % 3]) for i in range(900)]
    sizes, total = {}, {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    for r in taken_whole(spark.createDataFrame(rows, SCHEMA)).collect():
        total[r["source"]] = total.get(r["source"], 0) + len(r["text"].split())
    want = water_filled(sizes)
    assert all(abs(total[s] - want[s]) <= 9 for s in want)


def test_whole_documents_follow_tree_and_shuffle(spark):
    rows = [r for r in corpus(6, 900) if r[0] < 900]
    docs = spark.createDataFrame(rows, SCHEMA)
    dealt = dealt_whole(docs, shards=5, blocks=20).select("_row.*", "row", "copy", "block", "shard", "shuffle_key").collect()
    blocks, tree = {}, {(r["source"], r["block"]): r["shard"] for r in drawn(mixed(docs, shards=5, blocks=20)).collect()}
    for r in dealt:
        assert tree[r["source"], r["block"]] == r["shard"]
        blocks[r["source"], r["block"]] = blocks.get((r["source"], r["block"]), 0) + len(r["text"].split())
    quota = water_filled({s: sum(len(t.split()) for _, t, x in rows if x == s) for _, _, s in rows})
    assert all(abs(n - -(-round(quota[s]) // 20)) <= 200 for (s, b), n in blocks.items() if b < 19)
    in_order = [r["doc_id"] for r in sorted(dealt, key=lambda r: (r["shard"], r["shuffle_key"], r["row"]))]
    got = [r["doc_id"] for r in taken_whole(docs, shards=5, blocks=20).collect()]
    assert got == in_order and got != sorted(got)
    assert sum(a == b for a, b in zip(got, got[1:])) < 0.05 * len(got)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixed(none).count() == 0 and taken_whole(none).count() == 0
    assert targets(spark.createDataFrame([("a", 0), (None, 0)], "source string, size long")).where("target <> 0").count() == 0
