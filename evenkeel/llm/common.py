"""What the training-data operators share: scratch tables, bounded batches, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

import numpy as np
import xxhash
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_OWN: dict[str, str] = {}
#: What operators hold or have written, until it is freed.
_MADE: list[DataFrame] = []


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session. Where that is unset, a local master gets a
    folder of its own and a cluster gets one below the warehouse, never a machine's temp folder.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        local = spark.sparkContext.master.split("[")[0] == "local"
        _OWN[app] = tempfile.mkdtemp(prefix="evenkeel-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return _OWN[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet in the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._evenkeel_path = path
    _MADE.append(out)
    target, files = _files(out)
    files.deleteOnExit(target)
    return out


def few_files(df: DataFrame) -> DataFrame:
    """A table of small rows in two partitions for each core of the cluster at most."""
    return df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)


def settle(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` for a table of small rows."""
    return materialize(few_files(df), name)


def rekeyed(column: Column) -> Column:
    """The same long, as an expression that the optimiser doesn't see through.

    A table aggregated by a key is partitioned by it, and a join would keep that partitioning. By a
    rekeyed column the join exchanges both inputs itself, and may then split hot keys at run time.
    """
    return column.bitwiseXOR(F.lit(0))


def hold(df: DataFrame) -> DataFrame:
    """Keeps ``df`` on the executors' disks for later reads; what a lost executor held is computed again."""
    _MADE.append(df.persist(StorageLevel.DISK_ONLY))
    return df


def release(*frames: DataFrame) -> None:
    for df in frames:
        df.unpersist()


def made() -> set[int]:
    """What there is now of what operators hold or have written, for ``free`` to leave alone."""
    return set(map(id, _MADE))


def free(spark: SparkSession, *kept: DataFrame, but: set[int] = frozenset()) -> None:
    """Drops all that operators of this session have held or written, but for kept tables and what ``made`` told earlier.

    For when results have been written or read, as plans that aren't run yet need what they read. At its
    end a session deletes what it has written anyway.
    """
    keep = {df._evenkeel_path for df in kept if hasattr(df, "_evenkeel_path")}
    for df in [x for x in _MADE if x.sparkSession is spark and id(x) not in but]:
        path = getattr(df, "_evenkeel_path", None)
        if path in keep:
            continue
        if path is None:
            df.unpersist()
        else:
            discard(df)
        _MADE[:] = [x for x in _MADE if x is not df]


def _files(df: DataFrame):
    """A written table's path and file system."""
    target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._evenkeel_path)
    return target, target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf())


def discard(df: DataFrame | None) -> None:
    """Deletes a table made by ``materialize`` once nothing will read it again."""
    if getattr(df, "_evenkeel_path", None):
        target, files = _files(df)
        files.delete(target, True)


def bounded_batches(spark: SparkSession, megabytes: int = 4) -> None:
    """Keeps Arrow batches of texts small enough for a Python worker, whatever the texts' lengths.

    Spark reads the setting when a plan runs, after the operator has returned, so it stays lowered in
    the session; a lower one is left as it is. One text of more is a batch of its own.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > megabytes << 20:
        spark.conf.set(name, f"{megabytes << 20}b")


def ranked(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, bucket: Column, buckets: int | None = None, fan: int = 1 << 16) -> DataFrame:
    """rows with before: the sum of value over the rows ahead in their group of columns by, in the order (bucket, *order).

    Groups may be of any size, and by may be null: rows are added up in their bucket, buckets in runs of ``fan``,
    and runs in their group, so no task sorts a group's rows or more than ``fan`` buckets. Buckets are whole
    numbers from 0 that should hold some thousand rows at most; if there are known to be no more than ``fan``, they are one run.
    """
    ahead = lambda x, part, *at: F.coalesce(F.sum(x).over(Window.partitionBy(*part).orderBy(*at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = lambda a, b, x: reduce(Column.__and__, [a[c].eqNullSafe(b[f"_{c}"]) for c in (*by, x)])
    key = [F.col(c).alias(f"_{c}") for c in (*by, "_bucket")]
    out = rows.withColumns({"_bucket": bucket, "_value": value})
    sums = out.groupBy(*by, "_bucket").agg(F.sum("_value").alias("_sum"))
    if buckets is not None and buckets <= fan:
        sums = sums.select(*key, ahead("_sum", by, "_bucket").alias("_ahead"))
    else:
        sums = sums.withColumn("_run", F.floor(F.col("_bucket") / fan))
        runs = sums.groupBy(*by, "_run").agg(F.sum("_sum").alias("_sum")).select(*[F.col(c).alias(f"_{c}") for c in (*by, "_run")], ahead("_sum", by, "_run").alias("_first"))
        sums = sums.withColumn("_inner", ahead("_sum", (*by, "_run"), "_bucket"))
        sums = sums.join(runs, same(sums, runs, "_run")).select(*key, (F.col("_first") + F.col("_inner")).alias("_ahead"))
    out = out.withColumn("_inside", ahead("_value", (*by, "_bucket"), *order))
    return out.join(sums, same(out, sums, "_bucket")).select(*rows.columns, (F.col("_ahead") + F.col("_inside")).alias("before"))


def extended(df: DataFrame, **kinds: str) -> StructType:
    """The schema of df with more columns; a schema's own add() would change it in place."""
    return StructType([*df.schema.fields, *StructType.fromDDL(", ".join(f"{n} {k}" for n, k in kinds.items())).fields])


def wrapped(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one struct, so that no name clashes with those an operator adds."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others, F.lit(0).alias("_one")).alias("_others"))


def unwrapped(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs back from rows made of ``wrapped`` ones."""
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_others").getField(c).alias(c) for c in docs.columns])


def emptying(cache, batches):
    """Yields batches; workers outlive tasks, so a task's cache must not stay in their memory."""
    try:
        yield from batches
    finally:
        cache.clear()


class WordHashes(dict):
    """Word -> 64-bit hash, as a cache of bounded size, emptied by tasks when they end."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


HASHES = WordHashes()


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes, A-Z lower-cased."""
    return text.lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(words: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words than k make one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    n = max(1, len(words) - k + 1)
    width = min(k, len(words))
    acc = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        return np.unique(mix(acc + np.uint64(width)))
