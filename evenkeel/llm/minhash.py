"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Two permutations make all signature coordinates: shingles are mapped to D positions by the first
(a bijection of 64-bit hashes, taken mod D), and coordinate k is the least value of the second
permutation shifted circularly by k. The shifts of one element are a contiguous window of the
second permutation, so a signature is an element-wise minimum over windows.

Candidates share a band. They are verified in two passes, so that large groups don't make all
pairs: first each member of a bucket with the bucket's smallest member, then, once the components
of those links are known, every remaining pair of a bucket whose ends are in different
components. Pairs inside a component need no check, since they can't change a component. Before
that, a sketch of one bit for each of 1536 further coordinates rules out pairs whose bits differ
more often than five standard deviations above what similar enough pairs do.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HASHES, bounded_batches, discard, emptying, hold, mix, rekeyed, release, settle, shingles, words_of
from .components import connected_components

D = 1 << 16
BANDS, ROWS = 44, 7
SKETCH = 1536
#: Ids of 8 bytes that are broadcast at most.
BROADCAST_IDS = 1 << 20


@lru_cache
def _windows(k: int, seed: int) -> np.ndarray:
    """Row p holds the second permutation at p-k+1 .. p, circularly."""
    perm = np.random.RandomState(seed).permutation(D).astype(np.uint16)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([perm[D - k + 1 :], perm]), k)


@lru_cache
def _band_keys(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.RandomState(11)
    odd = lambda n: rng.randint(0, 1 << 62, n).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return odd(rows), odd(bands)


def signature(hashes: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """The k coordinates of a non-empty set of 64-bit hashes."""
    at = (mix(hashes ^ np.uint64(seed)) % np.uint64(D)).astype(np.int64)
    rows = _windows(k, seed)
    out = np.full(k, D - 1, np.uint16)
    for i in range(0, len(at), 512):
        np.minimum(out, rows[at[i : i + 512]].min(axis=0), out=out)
    return out


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    by_row, by_band = _band_keys(bands, rows)
    with np.errstate(over="ignore"):
        return mix(((sig.reshape(bands, rows).astype(np.uint64) + np.uint64(1)) * by_row).sum(axis=1) + by_band).view(np.int64)


def _signed(batches, k: int, bands: int, rows: int):
    for b in batches:
        sizes, digests, keys = [], [], []
        for text in b.column(1).cast(pa.binary()).to_pylist():
            words = words_of(text)
            s = shingles(words, k)
            sizes.append(len(s))
            digests.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
            keys.append(band_hashes(signature(s, bands * rows), bands, rows) if len(s) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bands"])


def _sketched(batches, k: int):
    for b in batches:
        ids, rows = [], []
        for u, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
            if len(x := shingles(words_of(text), k)):
                ids.append(u)
                rows.append(np.packbits((signature(x, SKETCH, seed=8) & 1).astype(np.uint8)).view(np.int64))
        longs = np.array(rows, np.int64).reshape(len(ids), SKETCH // 64)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c) for c in longs.T)], ["id", *(f"s{i}" for i in range(SKETCH // 64))])


def _may_differ(percent: int) -> int:
    """Bits of two sketches that may differ: their mean at this similarity plus five standard deviations."""
    p = (1 - percent / 100) / 2
    return math.ceil(SKETCH * p + 5 * math.sqrt(SKETCH * p * (1 - p)))


def _checked(batches, k: int, percent: int):
    """Pairs whose full sets are similar enough. The sets last used are kept, as stars repeat one end."""
    kept: OrderedDict[bytes, np.ndarray] = OrderedDict()

    def of(text):
        if text in kept:
            kept.move_to_end(text)
        else:
            kept[text] = shingles(words_of(text), k)
            if len(kept) > 64:
                kept.popitem(last=False)
        return kept[text]

    for b in batches:
        texts = [b.column(i).cast(pa.binary()).to_pylist() for i in (2, 3)]
        ok = []
        for t, w in zip(*texts):
            x, y = of(t), of(w)
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents with ids (id), a written table, broadcast if counted as few."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, docs.doc_id == ids.id, "left_semi").select("doc_id", "text")


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of written pairs (u, v) whose shingle sets have 100 * intersection >= percent * union.

    Only texts of documents in pairs are moved.
    """
    text = _texts(docs, settle(pairs.select(F.col("u").alias("id")).distinct().union(pairs.select("v").distinct()).distinct(), "ids"))
    left = pairs.join(text.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u")), "u")
    both = left.join(text.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v")), "v").select("u", "v", "text_u", "text_v")
    return both.mapInArrow(lambda it: emptying(HASHES, _checked(it, k, percent)), "u long, v long")


def _near(n, m, percent: int):
    """Sets of n and m shingles can be similar enough."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Class of each document: (doc_id, n_shingles, component_id, kept).

    docs needs doc_id and text, other columns are ignored. Documents are linked when 100 *
    intersection >= percent * union of their sets of distinct k-word shingles (words as in
    ``words_of``; fewer than k words make one shingle). component_id is the smallest doc_id
    reachable, kept says whether that is the document itself. With the default 44 bands of 7
    rows a pair at similarity 0.85 is missed with probability 4e-8, at 0.8 with 3e-5; found pairs
    are exact. Null or blank texts have an empty set and are linked with nothing. Rows with a null
    doc_id get n_shingles, a null component and are kept. Repeated rows of a doc_id are one node:
    each row returns the same class (rows that repeat an id with other texts join their classes).
    An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    signed = hold(docs.mapInArrow(lambda it: emptying(HASHES, _signed(it, k, bands, rows)), "doc_id long, n_shingles long, digest binary, bands array<long>"))
    sized = signed.where("doc_id is not null and digest is not null")
    # Copies: one representative stands for equal word sequences; the minimum combines before its shuffle.
    heads = sized.groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("h")).select("h.*")
    bucketed = heads.select("doc_id", "n_shingles", F.explode("bands").alias("key"))
    shared = bucketed.groupBy("key").agg(F.min(F.struct("doc_id", "n_shingles")).alias("m"), F.count("*").alias("n")).where("n > 1")
    shared = shared.select(rekeyed(F.col("key")).alias("k"), F.col("m.doc_id").alias("v"), F.col("m.n_shingles").alias("n_v"))
    members = hold(bucketed.join(shared, bucketed.key == shared.k).select("key", F.col("doc_id").alias("u"), F.col("n_shingles").alias("n_u"), "v", "n_v"))

    star = settle(members.where((F.col("u") != F.col("v")) & _near(F.col("n_u"), F.col("n_v"), percent)).select("u", "v").distinct(), "star")
    links = hold(verified(star, docs, k, percent))
    found = connected_components(links)

    named = members.join(found.withColumnRenamed("node", "u"), "u", "left").select("key", "u", "n_u", F.coalesce("component", "u").alias("c"))
    mixed = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select(rekeyed(F.col("key")).alias("k"))
    open_ = settle(named.join(mixed, named.key == mixed.k, "left_semi"), "open")
    bits = [f"s{i}" for i in range(SKETCH // 64)]
    shared_by = settle(open_.groupBy(F.col("u").alias("id")).agg(F.collect_list("key").alias("keys")), "keys")  # bands keys at most
    sketches = _texts(docs, shared_by.select("id")).mapInArrow(lambda it: emptying(HASHES, _sketched(it, k)), "id long, " + ", ".join(f"{x} long" for x in bits))
    one = open_.join(sketches.join(shared_by, "id").withColumnRenamed("id", "u"), "u")
    two = one.select(*[F.col(c).alias(f"{c}_v") for c in one.columns])
    differ = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(f"{x}_v"))) for x in bits), F.lit(0))
    # A pair is looked at in its first common bucket only.
    first = F.array_min(F.array_intersect("keys", "keys_v")) == F.col("key")
    rest = one.join(two, (F.col("key") == F.col("key_v")) & (F.col("u") > F.col("u_v")) & (F.col("c") != F.col("c_v")) & _near(F.col("n_u"), F.col("n_u_v"), percent) & (differ <= _may_differ(percent)) & first)
    rest = settle(rest.select("u", F.col("u_v").alias("v")).distinct(), "rest")
    edges = links.unionByName(verified(rest, docs, k, percent))
    # Rows that repeat an id with other texts: the id ties its texts together.
    ids = sized.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("doc_id")
    if not ids.isEmpty():
        first = sized.groupBy("digest").agg(F.min("doc_id").alias("v"))
        edges = edges.unionByName(sized.join(ids, "doc_id", "left_semi").join(first, "digest").select(F.col("doc_id").alias("u"), "v"))
    final = connected_components(edges)
    release(members, links)
    for x in (star, open_, shared_by, rest):
        discard(x)
    # Only digests that are copied or linked need a join; the others are components of themselves.
    copies = sized.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"))
    merged = copies.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("digest", F.coalesce("component", "doc_id").alias("component"), "doc_id", "last")
    merged = merged.where("component <> doc_id or doc_id <> last").select(F.concat("digest", F.lit(b"")).alias("d"), "component")
    out = signed.select("doc_id", "n_shingles", "digest").join(merged, F.col("digest") == F.col("d"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that ``near_duplicates`` keeps, one for each class; all columns of docs.

    Rows without an id are kept as they are. Of rows that repeat a kept doc_id, the one with the
    least text stays, of equal texts the one with the least hash of its columns.
    """
    classes = near_duplicates(docs, k, percent)
    gone = classes.where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    left = docs.join(gone, docs.doc_id == gone.gone_id, "left_anti")
    twice = hold(classes.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(rekeyed(F.col("doc_id")).alias("twice")))
    if twice.isEmpty():
        return left
    hashable = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    least = left.join(twice, F.col("doc_id") == F.col("twice"), "left_semi").groupBy("doc_id").agg(F.min_by(whole, F.struct(F.coalesce("text", F.lit("")), F.xxhash64(*hashable))).alias("_row"))
    once = left.join(twice, F.col("doc_id") == F.col("twice"), "left_anti")
    return once.unionByName(least.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns]))
