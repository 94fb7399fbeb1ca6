"""Where a key belongs: portable hash, home bucket, and the row/column grid."""

from __future__ import annotations

import hashlib
from math import isqrt

from pyspark.sql import Column
from pyspark.sql import functions as F


def portable_hash(key: Column) -> Column:
    """The first 32 bits of md5 of a key's text, which any engine and Python can compute alike."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def portable_hash_of(key: object) -> int:
    return int(hashlib.md5(str(key).encode()).hexdigest()[:8], 16)


def home(key: Column, n: int) -> Column:
    return (portable_hash(key) % n).cast("int")


def grid(n: int) -> tuple[int, int]:
    """(rows, columns) of a grid of n buckets, as square as n's divisors allow; a prime gives one row."""
    rows = next(r for r in range(isqrt(n), 0, -1) if n % r == 0)
    return rows, n // rows


def grid_row(bucket: Column, n: int) -> Column:
    """All buckets in the grid row of a bucket."""
    cols = grid(n)[1]
    first = (F.floor(bucket / cols) * cols).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda c: first + c)


def grid_column(bucket: Column, n: int) -> Column:
    """All buckets in the grid column of a bucket."""
    rows, cols = grid(n)
    at = (bucket % cols).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: r * cols + at)


def every(n: int) -> Column:
    """All n buckets."""
    return F.sequence(F.lit(0), F.lit(n - 1))
