"""Near-duplicate vectors by product quantisation, with no link lost.

A coarse quantiser splits unit vectors into inverted lists; residuals are coded by subspace. Two
bounds keep what approximate search would lose. A vector is sent to another list only if it is
within the link distance of the plane between the two centroids (no link crosses otherwise). In a
pair of lists, the distance from a vector to another's code comes from lookup tables, and the
other's stored coding error bounds how far that is from the truth, so a pair is dropped only if it
can't be a link. What remains is decided by its exact cosine in double precision.

Equal vectors are one node with a weight. The core of a list are those within half the link angle of
its centroid's direction: any two of a core are linked, by the triangle inequality of angles, so a
core is counted and never compared with itself, however many near copies it holds. Cores and the
rest of lists are cut into blocks of bounded size, and blocks are met in pairs, so a list of any size
is spread over tasks. A pair of blocks returns at most a row
for each of its vectors: its number of links there and the smallest vector it is connected to
there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold
from .components import connected_components

#: Vectors that the quantisers are fitted on, at most.
SAMPLE = 16384
#: Vector lengths that have quantisers, at most.
DIMS = 64
BLOCK = 2048
SUBSPACES = 8
CODES = 64
MAX_LISTS = 4096


def _unit(batches):
    """Valid vectors as doubles: (vec_id, label, dim, digest, v)."""
    for b in batches:
        lists = b.column(2)
        dims = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
        values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # those of null lists aren't there, nulls are NaN
        first = np.cumsum(dims) - dims
        labelled = b.column(1).is_valid().to_numpy(zero_copy_only=False)
        for dim in np.unique(dims[(dims > 0) & labelled]).tolist():
            at = np.nonzero((dims == dim) & labelled)[0]
            x = values[first[at][:, None] + np.arange(dim)]
            ok = np.isfinite(x).all(1) & (x != 0).any(1)
            at, x = at[ok], x[ok]
            v = x / np.abs(x).max(1)[:, None]  # so that squares neither overflow nor vanish
            v /= np.sqrt((v * v).sum(1))[:, None]
            digests, data = ([row.tobytes() for row in y] for y in (x, v))
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).cast(pa.string()).take(take), pa.array([dim] * len(at), pa.int32()), pa.array(map(xxhash.xxh3_128_digest, digests), pa.binary()), pa.array(data, pa.binary())], ["vec_id", "label", "dim", "digest", "v"])


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    rng = np.random.RandomState(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([((c * c).sum(1) - 2 * x[i : i + 4096] @ c.T).argmin(1) for i in range(0, len(x), 4096)] or [np.empty(0, np.int64)])


class Model:
    """Coarse centroids and, for each subspace, codewords of residuals; for vectors of one length."""

    def __init__(self, x: np.ndarray, lists: int):
        self.coarse = kmeans(x, max(1, min(lists, len(x))))
        r = x - self.coarse[nearest(x, self.coarse)]
        self.parts = np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1]))
        self.words = [kmeans(r[:, p], min(CODES, len(r))) for p in self.parts]

    def coded(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the distance of each vector to what its code stands for."""
        r = x - self.coarse[lists]
        codes = np.stack([nearest(r[:, p], w) for p, w in zip(self.parts, self.words)], axis=1)
        e2 = sum(((r[:, p] - w[codes[:, m]]) ** 2).sum(1) for m, (p, w) in enumerate(zip(self.parts, self.words)))
        return codes.astype(np.uint8), np.sqrt(e2)

    def table(self, q: np.ndarray, at: int) -> list[np.ndarray]:
        """Squared distances from each query to each codeword of list ``at``, by subspace."""
        d = q - self.coarse[at]
        return [((d[:, p][:, None, :] - w[None]) ** 2).sum(2) for p, w in zip(self.parts, self.words)]


def _sent(batches, models, cosine: float):
    """Each vector with the parts it must be compared in, of its own list and of those whose border is near enough.

    Part 2 c is the core of list c, part 2 c + 1 the rest of it.
    """
    t = math.sqrt(max(0.0, 2 - 2 * cosine))
    inner = math.cos(max(0.0, math.acos(max(-1.0, min(1.0, cosine))) / 2 - 1e-6))
    for b in batches:
        dims = b.column(2).to_numpy()
        rows, other, own = [], [], []
        for dim in np.unique(dims):
            at = np.nonzero(dims == dim)[0]
            x = np.frombuffer(b"".join(b.column(4).take(pa.array(at)).to_pylist())).reshape(len(at), dim)
            c = models[dim].coarse if dim in models else np.zeros((1, dim))
            d2 = ((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)).clip(0)
            home = d2.argmin(1)
            gap = np.sqrt(np.maximum(0, (c * c).sum(1)[:, None] - 2 * c @ c.T + (c * c).sum(1)))[home]
            near = d2 - d2[np.arange(len(x)), home][:, None] <= 2 * gap * t + 1e-9
            near[np.arange(len(x)), home] = True
            norms = np.sqrt((c * c).sum(1))[home]
            core = ((x * c[home]).sum(1) >= inner * norms) & (norms > 0)
            part = 2 * home + ~core
            i, j = np.nonzero(near)
            i, j = np.concatenate([i, i]), np.concatenate([2 * j, 2 * j + 1])
            keep = ~(core[i] & (j == part[i]))
            rows.append(at[i[keep]])
            other.append(j[keep])
            own.append(part[i[keep]])
        if rows:
            at = pa.array(np.concatenate(rows))
            cols = [b.column(k).take(at) for k in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(own), pa.int32()), pa.array(np.concatenate(other), pa.int32())], ["vec_id", "label", "dim", "w", "v", "own", "other"])


_LINKS = pa.schema([("u", pa.int64()), ("n", pa.int64()), ("v", pa.int64())])


def _compared(group: pa.Table, models, cosine: float, t: float) -> pa.Table:
    """Links between two blocks, or in one block, of parts low and high."""
    dim, lo, hi = (group.column(c)[0].as_py() for c in ("dim", "low", "high"))
    ids, w = group.column("vec_id").to_numpy(), group.column("w").to_numpy()
    x = np.frombuffer(b"".join(group.column("v").to_pylist())).reshape(len(ids), dim)
    side = group.column("side").to_numpy()
    alone = (side == 2).all()
    a, b = (np.arange(len(ids)),) * 2 if alone else (np.nonzero(side == 0)[0], np.nonzero(side == 1)[0])
    links, parent = np.zeros(len(ids), np.int64), {}
    if len(a) and len(b):
        model = models.get(dim)
        if model is not None:
            codes, error = model.coded(x[b], np.full(len(b), hi // 2))
        for i in range(0, len(a), 256):
            q = a[i : i + 256]
            if model is not None:
                tables = model.table(x[q], hi // 2)
                d2 = tables[0][:, codes[:, 0]]
                for m in range(1, len(tables)):
                    d2 += tables[m][:, codes[:, m]]
                maybe = np.sqrt(d2) - error <= t + 1e-9
            else:
                maybe = np.ones((len(q), len(b)), bool)
            if alone:
                maybe &= b > q[:, None]
            r, s = np.nonzero(maybe)
            for k in range(0, len(r), 65536):
                y, z = q[r[k : k + 65536]], b[s[k : k + 65536]]
                ok = np.einsum("ij,ij->i", x[y], x[z]) >= cosine
                y, z = y[ok], z[ok]
                np.add.at(links, y, w[z])
                np.add.at(links, z, w[y])
                _join(parent, y, z, ids)
    at = np.nonzero(links)[0]
    top = np.array([ids[_root(parent, k)] for k in at.tolist()], np.int64)
    return pa.Table.from_arrays([pa.array(ids[at]), pa.array(links[at]), pa.array(top)], schema=_LINKS)


def _root(parent: dict, k: int) -> int:
    while (p := parent.get(k, k)) != k:
        parent[k] = k = parent.get(p, p)
    return k


def _join(parent: dict, y, z, ids) -> None:
    for i, j in zip(y.tolist(), z.tolist()):
        i, j = _root(parent, i), _root(parent, j)
        if i != j:
            i, j = (i, j) if ids[i] < ids[j] else (j, i)
            parent[j] = i


def _fitted(nodes: DataFrame, block: int) -> dict[int, Model]:
    """Length -> model, of a sample by hash that shares SAMPLE among the DIMS commonest lengths, but for chance.

    Vectors of other lengths have no model: they are all compared with one another, in blocks.
    """
    counts = nodes.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count").alias("n"), F.sum("count").alias("total"))
    sizes = counts.orderBy(F.desc("total"), "dim").limit(DIMS).collect()
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["dim"], min(1.0, SAMPLE / len(sizes) / r["total"]))])
    u = F.shiftrightunsigned(F.xxhash64("digest"), 12) / float(1 << 52)
    sample: dict[int, list] = {r["dim"]: [] for r in sizes}
    for r in nodes.where(u < F.element_at(share, F.col("dim"))).select("dim", "digest", "v").collect():
        sample[r["dim"]].append((r["digest"], r["v"]))
    out = {}
    for r in sizes:
        if x := [v for _, v in sorted(sample[r["dim"]])]:
            out[r["dim"]] = Model(np.frombuffer(b"".join(x)).reshape(len(x), r["dim"]), min(MAX_LISTS, -(-r["n"] // block)))
    return out


def near_vectors(vectors: DataFrame, cosine: float = 0.95, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label).

    Vectors with equal labels and cosine >= cosine are linked, none below. Vectors that are null,
    empty, zero, or hold null or non-finite components, and those with a null label, are linked with
    nothing; vectors of different lengths aren't comparable. n_links is the number of other vectors
    linked directly, component_id the smallest vec_id reachable, kept says whether that is the
    vector itself. Repeated rows are vectors of their own (linked, if valid); rows with a null
    vec_id have no component, no links and are kept. An empty table gives no rows.
    """
    t = math.sqrt(max(0.0, 2 - 2 * cosine))
    spark = vectors.sparkSession
    base = vectors.select("vec_id", "label", "embedding")
    valid = hold(base.where("vec_id is not null").mapInArrow(_unit, "vec_id long, label string, dim int, digest binary, v binary"))
    nodes = hold(valid.groupBy("label", "dim", "digest").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("w"), F.min("v").alias("v")))
    models = _fitted(nodes, block)
    shared = spark.sparkContext.broadcast(models)  # bounded by MAX_LISTS and CODES

    sent = hold(nodes.select("vec_id", "label", "dim", "w", "v").mapInArrow(lambda it: _sent(it, shared.value, cosine), "vec_id long, label string, dim int, w long, v binary, own int, other int"))
    key = ["label", "dim"]
    parts = sent.select(*key, "own", "vec_id", "w").distinct()
    filled = parts.groupBy(*key, F.col("own").alias("list")).agg(F.count("*").alias("count"), F.sum("w").alias("weight"), F.min("vec_id").alias("first"))
    filled = hold(filled.withColumn("blocks", F.ceil(F.col("count") / block).cast("int")))
    cores = filled.where("list % 2 = 0").select(*key, F.col("list").alias("own"), "weight", "first")
    agreed = parts.where("own % 2 = 0").join(cores, [*key, "own"]).select(F.col("vec_id").alias("u"), (F.col("weight") - F.col("w")).alias("n"), F.col("first").alias("v")).where("n > 0")
    filled = filled.select(*key, "list", "blocks")
    mine = filled.withColumnsRenamed({"list": "own", "blocks": "mine"})
    theirs = filled.withColumnsRenamed({"list": "other", "blocks": "theirs"})
    # A part that nobody lives in has no blocks, and nothing to compare with: an inner join drops it.
    dealt = sent.join(mine, [*key, "own"]).join(theirs, [*key, "other"])
    me = F.pmod(F.xxhash64("vec_id"), F.col("mine")).cast("int")
    dealt = dealt.withColumn("me", me).withColumn("you", F.explode(F.sequence(F.lit(0), F.col("theirs") - 1)))
    low = (F.col("own") < F.col("other")) | ((F.col("own") == F.col("other")) & (F.col("me") <= F.col("you")))
    same = (F.col("own") == F.col("other")) & (F.col("me") == F.col("you"))
    pairs = dealt.select(
        "vec_id", "w", "v", *key,
        F.when(low, F.col("own")).otherwise(F.col("other")).alias("low"), F.when(low, F.col("me")).otherwise(F.col("you")).alias("low_block"),
        F.when(low, F.col("other")).otherwise(F.col("own")).alias("high"), F.when(low, F.col("you")).otherwise(F.col("me")).alias("high_block"),
        F.when(same, 2).when(low, 0).otherwise(1).alias("side"),
    )
    found = hold(pairs.groupBy(*key, "low", "low_block", "high", "high_block").applyInArrow(lambda g: _compared(g, shared.value, cosine, t), "u long, n long, v long"))
    found = found.unionByName(agreed)
    parts = connected_components(found.where("u <> v").select("u", "v"))
    links = found.groupBy("u").agg(F.sum("n").alias("n"))
    named = links.join(parts, F.col("u") == F.col("node"), "left").select("u", "n", "component")
    of_node = nodes.select("label", "dim", "digest", "w", F.col("vec_id").alias("head")).join(named, F.col("head") == F.col("u"), "left")
    of_node = of_node.select(F.concat("digest", F.lit(b"")).alias("d"), F.col("label").alias("l"), F.col("dim").alias("m"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "head").alias("component_id")).where("n_links > 0")
    linked = valid.select("vec_id", "label", "dim", "digest").join(of_node, (F.col("digest") == F.col("d")) & (F.col("label") == F.col("l")) & (F.col("dim") == F.col("m")))
    # A repeated vec_id may hold several vectors: it is one node of the components, with the links of all.
    out = linked.groupBy(F.col("vec_id").alias("id")).agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    rows = base.select("vec_id").join(out, F.col("vec_id") == F.col("id"), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
