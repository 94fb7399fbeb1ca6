"""Mixing sources to target weights, with DataFrame functions only.

Each source's documents, permuted by a hash, form a stream of words that is repeated as often as its
target asks for and cut into blocks of equal length. A splitting tree deals the sources' exact block
quotas to output shards: a node gives its left half a multivariate-hypergeometric share, drawn block
by block (selection sampling), and the leaves are the shards. Each shard then draws its quota from
the source's permuted blocks, which no other shard draws, and shuffles what it has by a key. The mix
is what shards have drawn.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hold, ranked, rekeyed

WORD = r"[^\x20\x09-\x0D]+"
REPEATS = 3
#: Rows in a bucket of a permuted stream, about; and how many rows may be equal in id, text and source before they are ranked apart.
BUCKET = COPIES = 1024
#: Words in a partition of the mixed corpus, about.
PART_WORDS = 2_000_000


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), repeats: int = REPEATS) -> DataFrame:
    """(source, rank, source_size, target) of rows (source, size).

    Sources by code point, null last, take the weights in turn. A target stops at ``repeats`` times
    its source's size; what is over is shared by weight among the others until none is above. In
    order of that limit per weight, a source is capped exactly if the level that all later sources
    would get reaches its limit. The windows run over one row a source.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    s = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size").cast("double") * repeats)
    order = Window.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    capped, gone = F.coalesce(F.sum("cap").over(order), F.lit(0.0)), F.coalesce(F.sum("w").over(order), F.lit(0.0))
    s = s.withColumn("level", (F.sum("source_size").over(everything) - capped) / (F.sum("w").over(everything) - gone))
    free = F.col("level") < F.col("cap") / F.col("w")
    s = s.withColumn("shared", F.max(F.when(free, F.col("level"))).over(everything))
    return s.select("source", "rank", "source_size", F.when(free, F.least("cap", F.col("w") * F.col("shared"))).otherwise(F.col("cap")).alias("target"))


def _drawn_left(quotas: Column, seed: int, node: Column, draws: Column) -> Column:
    """How many blocks of each source go left, if ``draws`` of all are drawn without replacement."""
    population = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, x: a + x)

    def one_source(acc, x):
        index = F.size(acc["out"])
        blocks = F.when(x > 0, F.sequence(F.lit(1).cast("long"), x)).otherwise(F.array().cast("array<long>"))
        start = F.struct(acc["population"].alias("population"), acc["draws"].alias("draws"), F.lit(0).cast("long").alias("taken"))

        def one_block(a, i):
            u = F.pmod(F.xxhash64(F.lit(seed), node, index, i), F.lit(1 << 40)) / F.lit(float(1 << 40))
            take = F.when(u * a["population"] < a["draws"], 1).otherwise(0).cast("long")
            return F.struct((a["population"] - 1).alias("population"), (a["draws"] - take).alias("draws"), (a["taken"] + take).alias("taken"))

        after = F.aggregate(blocks, start, one_block)
        return F.struct(after["population"].alias("population"), after["draws"].alias("draws"), F.concat(acc["out"], F.array(after["taken"])).alias("out"))

    zero = F.struct(population.alias("population"), draws.alias("draws"), F.array().cast("array<long>").alias("out"))
    return F.aggregate(quotas, zero, one_source)["out"]


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(rank, shards_of): for each block of a source, in order, the shard that draws it, of rows (rank, blocks).

    Shards get equal numbers of blocks, but for one, and draw theirs one shard after the other from
    a permutation of the source's blocks. Quotas are one number a source, in one array.
    """
    row = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct("rank", F.col("blocks").cast("long").alias("blocks")))).alias("q"))
    nodes = row.select(F.col("q.rank").alias("ranks"), F.col("q.blocks").alias("quotas"), F.lit(0).alias("low"), F.lit(shards).alias("width"))
    for _ in range((shards - 1).bit_length()):
        left_width = F.floor(F.col("width") / 2).cast("int")
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, x: a + x)
        draws = F.floor(total * left_width / F.col("width"))
        split = nodes.withColumn("left", F.when(F.col("width") > 1, _drawn_left(F.col("quotas"), seed, F.concat_ws(":", "low", "width"), draws)))
        leaf = F.array(F.struct("quotas", "low", "width"))
        right = F.zip_with("quotas", "left", lambda a, b: a - b)
        both = F.array(
            F.struct(F.col("left").alias("quotas"), F.col("low"), left_width.alias("width")),
            F.struct(right.alias("quotas"), (F.col("low") + left_width).alias("low"), (F.col("width") - left_width).alias("width")),
        )
        nodes = split.select("ranks", F.explode(F.when(F.col("width") > 1, both).otherwise(leaf)).alias("n")).select("ranks", "n.*")
    each = nodes.select(F.col("low").alias("shard"), F.posexplode(F.arrays_zip("ranks", "quotas")).alias("at", "x"))
    each = each.select("shard", F.col("x.ranks").alias("rank"), F.col("x.quotas").alias("n"))
    runs = each.groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("runs"))
    dealt = runs.select("rank", F.flatten(F.transform("runs", lambda x: F.array_repeat(x["shard"], x["n"].cast("int")))).alias("dealt"))
    blocks = F.when(F.size("dealt") > 0, F.sequence(F.lit(0), F.size("dealt") - 1)).otherwise(F.array().cast("array<int>"))
    permuted = F.sort_array(F.transform(blocks, lambda b: F.struct(F.xxhash64(F.lit(seed), F.col("rank"), b).alias("h"), b.alias("b"))))
    by_block = F.sort_array(F.zip_with(permuted, "dealt", lambda x, shard: F.struct(x["b"].alias("b"), shard.alias("shard"))))
    return dealt.select("rank", F.transform(by_block, lambda x: x["shard"]).alias("shards_of"))


def _h(seed: int) -> Column:
    """The place of a document in its source's stream, by what it is: rows that tie here are alike."""
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", "source", n_words().alias("size"), _h(seed).alias("h"), F.monotonically_increasing_id().alias("row"))


def _buckets(sized: DataFrame) -> int:
    return max(1, -(-sized.count() // BUCKET))


def _bucket(n: int) -> Column:
    return F.floor(F.shiftrightunsigned("h", 32) * F.lit(n) / F.lit(1 << 32))


def _permuted(sized: DataFrame) -> DataFrame:
    """sized with bucket and before: the words ahead of a row in its source's permuted stream.

    The stream's order is (bucket, h, row); row only decides among rows that are alike, so where files
    are split doesn't show. Rows that more than COPIES times are alike stand in their bucket
    as one, and are ranked by runs of row among themselves, so neither a source nor a repeated row
    is sorted in one task.
    """
    n = _buckets(sized)
    kept = [*sized.columns, "before"]
    many = hold(sized.groupBy("source", "h").agg(F.count("*").alias("copies"), F.first("size").alias("size")).where(F.col("copies") > COPIES))
    if many.isEmpty():
        return ranked(sized, ["source"], ["h", "row"], F.col("size"), _bucket(n), n).withColumn("bucket", _bucket(n))
    like = many.select(F.col("source").alias("s"), rekeyed(F.col("h")).alias("k"))
    alike = sized.source.eqNullSafe(like.s) & (sized.h == like.k)
    few = sized.join(like, alike, "left_anti").withColumn("words", F.col("size"))
    stand = many.select(F.lit(None).cast(sized.schema["doc_id"].dataType).alias("doc_id"), "source", "size", "h", F.lit(-1).cast("long").alias("row"), (F.col("size") * F.col("copies")).alias("words"))
    both = ranked(few.unionByName(stand), ["source"], ["h", "row"], F.col("words"), _bucket(n), n)
    first = both.where("row < 0").select(F.col("source").alias("s"), rekeyed(F.col("h")).alias("k"), F.col("before").alias("first"))
    copies = sized.join(first, sized.source.eqNullSafe(first.s) & (sized.h == first.k)).drop("s", "k")
    inside = ranked(copies, ["source", "h"], ["row"], F.col("size"), F.shiftrightunsigned("row", 10)).withColumn("before", F.col("before") + F.col("first"))
    return both.where("row >= 0").select(*kept).unionByName(inside.select(*kept)).withColumn("bucket", _bucket(n))


def _quotas(sized: DataFrame, weights, repeats: int) -> DataFrame:
    return targets(sized, weights, repeats).withColumn("quota", F.round("target").cast("long"))


def _planned(sized: DataFrame, weights, repeats: int, shards: int, blocks: int, seed: int) -> DataFrame:
    """sized, permuted, with source_size, target, quota, the length of its source's blocks and shards_of, which the tree deals."""
    q = _quotas(sized, weights, repeats)
    q = q.withColumn("length", F.greatest(F.lit(1), F.ceil(F.col("quota") / blocks)).cast("long"))
    q = hold(q.withColumn("blocks", F.ceil(F.col("quota") / F.col("length")).cast("long")))
    tree = splitting_tree(q.select("rank", "blocks"), shards, seed)
    plan = q.join(tree, "rank", "left").withColumnRenamed("source", "s")
    p = _permuted(sized)
    return p.join(plan, p.source.eqNullSafe(plan.s))


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), repeats: int = REPEATS, shards: int = 16, blocks: int = 256, seed: int = 3) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target and spans.

    spans are what shards draw of it: (copy, start, words, block, shard, shuffle_key), counted in
    words, the key being that by which the shard shuffles them. Shards hold whole blocks of a
    source, each block one shard; a source's last block may be shorter. docs needs doc_id,
    text and source. A null or blank text has size 0 and no spans; a null source is a source; rows
    that repeat a doc_id are documents of their own; an empty table gives no rows. The words drawn
    of a source are its target, rounded. Reruns agree, however the table's files are split.
    """
    sized = hold(_sized(docs, seed))
    joined = _planned(sized, weights, repeats, shards, blocks, seed)

    def of_copy(c):
        start = c * F.col("source_size") + F.col("before")
        end = F.least(start + F.col("size"), F.col("quota"))
        first, last = F.floor(start / F.col("length")), F.floor((end - 1) / F.col("length"))

        def span(b):
            lo, hi = F.greatest(start, b * F.col("length")), F.least(end, (b + 1) * F.col("length"))
            shard = F.get("shards_of", b.cast("int"))
            return F.struct(c.alias("copy"), (lo - start).alias("start"), (hi - lo).alias("words"), b.alias("block"), shard.alias("shard"), F.xxhash64(F.lit(seed), shard, F.col("h"), lo).alias("shuffle_key"))

        return F.when(end > start, F.filter(F.transform(F.sequence(first, last), span), lambda x: x["shard"].isNotNull())).otherwise(F.array())

    spans = F.flatten(F.array(*[of_copy(F.lit(c).cast("long")) for c in range(repeats)]))
    return joined.select("doc_id", "source", "size", "source_size", "target", spans.alias("spans"))


def drawn(mix: DataFrame) -> DataFrame:
    """The spans of a mix, a row each, in the partitions and order of their shards."""
    rows = mix.select("doc_id", "source", F.explode("spans").alias("x")).select("doc_id", "source", "x.*")
    return rows.repartitionByRange("shard", "shuffle_key").sortWithinPartitions("shard", "shuffle_key")


def dealt_whole(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), repeats: int = REPEATS, shards: int = 16, blocks: int = 256, seed: int = 3) -> DataFrame:
    """A row for each time the mix takes a document, whole: _row (all its columns), row, copy, block, shard and shuffle_key.

    The same streams, targets, blocks and tree as ``mixed``, but a document is never cut: each copy
    goes with the block that holds its middle word, and is taken if that is before the end of its
    source's quota. Blocks are then runs of the permuted order (bucket, h, row), whose two ends are
    a row for each source, copy and block; these are broadcast, and each text finds its blocks
    where it is read. Documents without words aren't taken.
    """
    return _dealt(docs, hold(_sized(docs, seed)), weights, repeats, shards, blocks, seed)


def _dealt(docs: DataFrame, sized: DataFrame, weights, repeats: int, shards: int, blocks: int, seed: int) -> DataFrame:
    n_buckets = _buckets(sized)
    p = _planned(sized, weights, repeats, shards, blocks, seed).where("size > 0")
    middle = F.col("copy") * F.col("source_size") + F.col("before") + F.floor(F.col("size") / 2)
    p = p.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(repeats - 1).cast("long")))).withColumn("middle", middle).where("middle < quota")
    p = p.withColumn("block", F.floor(F.col("middle") / F.col("length"))).withColumn("shard", F.get("shards_of", F.col("block").cast("int")))
    place = F.struct("bucket", "h", "row")
    runs = p.groupBy("s", "copy", "block", "shard").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    plan = runs.groupBy("s").agg(F.collect_list(F.struct("copy", "block", "shard", "first", "last")).alias("_runs"))
    wide = docs.select("source", _h(seed).alias("h"), F.monotonically_increasing_id().alias("row"), F.col("text").rlike(WORD).alias("any"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    wide = wide.where("any").withColumn("bucket", _bucket(n_buckets)).withColumn("place", place)
    rows = wide.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("s")))
    mine = F.filter("_runs", lambda x: (x["first"] <= F.col("place")) & (F.col("place") <= x["last"]))
    rows = rows.select("h", "row", "_row", F.explode(mine).alias("x")).select("h", "row", "_row", "x.copy", "x.block", "x.shard").where("shard is not null")
    return rows.withColumn("shuffle_key", F.xxhash64(F.lit(seed), "shard", "h", "row", "copy", "block")).drop("h")


def taken_whole(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), repeats: int = REPEATS, shards: int = 16, blocks: int = 256, seed: int = 3) -> DataFrame:
    """Rows of docs as often as the mix takes them, whole, with all columns, shard after shard, each in its shuffled order.

    See ``dealt_whole``. A shard is as many partitions as its words ask for, cut by ranges of the
    shuffle key, so no shard is sorted in one task; texts move once. Rows of equal key are in the order of docs.
    """
    sized = hold(_sized(docs, seed))
    words = sized.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-words // (shards * PART_WORDS)))
    rows = _dealt(docs, sized, weights, repeats, shards, blocks, seed)
    part = F.floor((F.shiftright("shuffle_key", 32) + F.lit(1 << 31)) * F.lit(parts) / F.lit(1 << 32))
    rows = rows.repartitionById(shards * parts, (F.col("shard") * parts + part).cast("int")).sortWithinPartitions("shard", "shuffle_key", "row")
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
