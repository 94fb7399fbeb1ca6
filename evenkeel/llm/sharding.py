"""Placement of documents in shards by a permutation-filled lookup table, with DataFrame functions only.

(Eisenbud et al., "Maglev".) Each shard has a permutation of the table's slots, given by an offset
and a stride; shards take turns claiming their next free slot until the prime-sized table is full.
Every shard then owns nearly the same number of slots, and adding or removing a shard moves few
others. A row's slot is a hash of its id, and its shard one look at the broadcast table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime, over a hundred times the shards that the query uses.
SLOTS = 4099


def _hash(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:8], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """Owner (index in shards) of each slot; its size is fixed by ``slots``, whatever is sharded."""
    if not is_prime(slots) or not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("a prime number of slots, and distinct shards, not more than slots, are needed")
    at = [_hash(s, "offset") % slots for s in shards]
    stride = [_hash(s, "stride") % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while left:
        for i in range(len(shards)):
            if not left:
                break
            while table[at[i]] >= 0:
                at[i] = (at[i] + stride[i]) % slots
            table[at[i]] = i
            left -= 1
    return table


def slot_of(column: Column, slots: int = SLOTS) -> Column:
    """Portable hash of an id as text: the first 32 bits of its md5, mod slots; null counts as empty text."""
    text = F.coalesce(column.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % slots).cast("int")


def lookup(spark: SparkSession, table: Sequence[int]) -> DataFrame:
    """(slot, shard): the table as rows, made by the JVM from one literal."""
    owners = F.split(F.lit(",".join(map(str, table))), ",")
    return spark.range(1).select(F.posexplode(owners).alias("slot", "s")).select("slot", F.col("s").cast("int").alias("shard"))


def placed(rows: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """rows with slot and shard (index in shards), replacing columns of these names.

    The table of ``slots`` rows is broadcast: its size doesn't depend on the data, so no row moves.
    Equal keys go to one shard; null keys go where the empty text goes; an empty table stays empty.
    """
    kept = rows.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    return kept.join(F.broadcast(lookup(rows.sparkSession, fill(shards, slots))), "slot").select(*[c for c in kept.columns if c != "slot"], "slot", "shard")


def write_sharded(rows: DataFrame, key: str, shards: Sequence[str], path: str, slots: int = SLOTS, spread: int = 1) -> None:
    """Writes rows below path, a folder a shard; ``spread`` tasks share each shard, so that none is one task's.

    Rows are spread by their contents and where they are read, so a shard's tasks also share the rows of one key.
    """
    out = placed(rows, key, shards, slots)
    hashable = [F.col(f"`{f.name}`") for f in rows.schema if "map<" not in f.dataType.simpleString()]
    part = F.pmod(F.xxhash64(*hashable, F.spark_partition_id()), F.lit(spread))
    out.withColumn("_ek_part", part).repartition(len(shards) * spread, "shard", "_ek_part").drop("_ek_part").write.partitionBy("shard").parquet(path)
