"""Reproducible random keys as functions of a row number."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .placement import portable_hash


def uniform(row: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the row and the seed only."""
    return portable_hash(F.concat_ws(":", F.lit(str(seed)), row.cast("string"))) / F.lit(float(1 << 32))


def uniform_key(row: Column, size: int, seed: int = 0) -> Column:
    return F.floor(uniform(row, seed) * size).cast("long")


def zipf_key(row: Column, size: int, factor: float, seed: int = 0) -> Column:
    """Keys 1..size whose frequencies fall as rank ** -factor: the inverse of the bounded continuous law."""
    if factor == 1:
        raise ValueError("a factor of exactly 1 has no inverse of this form")
    e = 1 - factor
    return F.least(F.lit(size), F.floor(F.pow((F.pow(F.lit(size + 1.0), F.lit(e)) - 1) * uniform(row, seed) + 1, F.lit(1 / e)))).cast("long")


#: Ranks of a discrete law, at most: its table is a literal of the plan.
RANKS = 100_000


@lru_cache(maxsize=8)
def alias_table(size: int, factor: float) -> tuple[tuple[float, ...], tuple[int, ...]]:
    """(share, other) by rank from 0, so that a uniform rank that is kept with its share, else replaced by the other, follows rank ** -factor."""
    weights = [(r + 1) ** -factor for r in range(size)]
    total = sum(weights)
    share, other = [w * size / total for w in weights], list(range(size))
    under, over = [i for i, x in enumerate(share) if x < 1], [i for i, x in enumerate(share) if x >= 1]
    while under and over:
        low, high = under.pop(), over[-1]
        other[low] = high
        share[high] -= 1 - share[low]
        if share[high] < 1:
            under.append(over.pop())
    for i in under + over:
        share[i] = 1.0
    return tuple(share), tuple(other)


def discrete_zipf_key(row: Column, size: int, factor: float, seed: int = 0) -> Column:
    """Keys 1..size with probabilities exactly in proportion to rank ** -factor, by the alias method: one look at a table of size ranks."""
    if not 1 <= size <= RANKS:
        raise ValueError(f"size must be from 1 to {RANKS}")
    share, other = (F.split(F.lit(",".join(map(repr, x))), ",") for x in alias_table(size, factor))
    rank = F.floor(uniform(row, seed) * size).cast("int")
    kept = uniform(row, seed + 1) < F.get(share.cast("array<double>"), rank)
    return (F.when(kept, rank).otherwise(F.get(other.cast("array<int>"), rank)) + 1).cast("long")


def skewed_key(row: Column, size: int, factor: float, seed: int = 0) -> Column:
    """Uniform keys below a factor of 1, else Zipf keys: of the discrete law for domains of up to RANKS keys, beyond of the continuous one."""
    if factor < 1:
        return uniform_key(row, size, seed)
    return discrete_zipf_key(row, size, factor, seed) if size <= RANKS else zipf_key(row, size, factor, seed)
