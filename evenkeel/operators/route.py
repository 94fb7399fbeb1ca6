"""Routers: the buckets that a row goes to, and those told to fetch its key, as array columns.

A router is a function of a side to (buckets, told); joins only need buckets, told says which other
buckets need the build rows of the key. New strategies are new pairs of such functions.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.placement import every, home

NONE = "array<int>"


def nobody() -> Column:
    return F.array().cast(NONE)


def one(bucket: Column) -> Column:
    return F.array(bucket.cast("int"))


def without(buckets: Column, bucket: Column) -> Column:
    return F.array_remove(buckets, bucket.cast("int"))


def by_hash(key: Column, n: int) -> tuple[Column, Column]:
    """To the key's home; nobody else need know."""
    return one(home(key, n)), nobody()


def mirror(n: int) -> tuple[Column, Column]:
    """To all."""
    return every(n), nobody()


def average(key: str, sender: str, order: list[str], n: int) -> tuple[Column, Column]:
    """Round robin from bucket 0, by sender and key; all but home are told."""
    turn = F.row_number().over(Window.partitionBy(sender, key).orderBy(*order)) - 1
    return one(F.pmod(turn, F.lit(n))), without(every(n), home(F.col(key), n))


def local(key: Column, sender: Column, n: int) -> tuple[Column, Column]:
    """Stay at the sender, which is told unless it is home."""
    return one(sender), F.when(sender == home(key, n), nobody()).otherwise(one(sender))


def local_tell_all(sender: Column, n: int) -> tuple[Column, Column]:
    """Stay at the sender; all are told, home too."""
    return one(sender), every(n)


def fixed(buckets: list[int], n: int) -> tuple[Column, Column]:
    """To given buckets; all are told."""
    return F.array(*[F.lit(b) for b in buckets]), every(n)


def tell_only(n: int) -> tuple[Column, Column]:
    """Nowhere, the row takes another path; all are told."""
    return nobody(), every(n)
