"""Balanced spreading of heavy keys: a plan made from counts, and the sequential balancer row by row.

The plan gives each heavy key a list of buckets, home first, no longer than balance asks for, and
how many of its rows go to each. Heavy keys number at most 1 / ratio, so the plan is made on the
driver from that many counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.placement import portable_hash_of
from .detect import _streams

#: Heavy keys in a plan, at most; a share of rows above 1 / MAX_KEYS can't have more.
MAX_KEYS = 100_000


class Candidates:
    """The buckets in the order in which a key takes them: home, then by hashes of the key and a number, as far as asked for.

    Once hashes keep repeating, the rest come in order.
    """

    def __init__(self, key: object, n: int):
        self.key, self.n, self.next = key, n, 1
        self.known = [portable_hash_of(key) % n]
        self.seen = set(self.known)

    def first(self, width: int) -> list[int]:
        while len(self.known) < width:
            if self.next > 4 * self.n:
                self.known += [b for b in range(self.n) if b not in self.seen]
                break
            b = portable_hash_of(f"{self.key} {self.next}") % self.n
            self.next += 1
            if b not in self.seen:
                self.seen.add(b)
                self.known.append(b)
        return self.known[:width]


def candidates(key: object, n: int) -> list[int]:
    return Candidates(key, n).first(n)


def plan(counts: Iterable[tuple[object, int]], n: int, tolerance: float = 0.3, light: int = 1000) -> list[tuple[object, int, int, int]]:
    """(key, bucket, lo, hi): ordinals lo to hi - 1 of a key's heavy rows go to bucket.

    Larger keys come first. A key has the fewest of its candidates, home first, over which its rows, put where there is least
    load, leave (max - min) / max within tolerance or its fullest bucket within ``light`` rows. The
    fewest are found by doubling and halving, as more buckets never raise the highest load.
    """
    load, out = np.zeros(n, np.int64), []
    for key, count in sorted(counts, key=lambda x: (-x[1], str(x[0]))):
        order, top = Candidates(key, n), load.max()
        rising = np.sort(load)

        def fits(width: int):
            used = np.array(order.first(width))
            after = load[used] + levelled(load[used], count)
            if after.max() <= light:
                return used, after
            low = after.min()
            if width < n:  # the least load of the buckets that aren't used
                mine = np.sort(load[used])
                same = rising[:width] == mine
                low = min(low, rising[int(np.argmin(same)) if not same.all() else width])
            highest = max(top, after.max())
            return (used, after) if (highest - low) / highest <= tolerance or width == n else None

        width, narrow = 1, 0
        while (found := fits(width)) is None:
            narrow, width = width, min(n, 2 * width)
        while width - narrow > 1:
            middle = (narrow + width) // 2
            if (less := fits(middle)) is None:
                narrow = middle
            else:
                width, found = middle, less
        used, after = found
        given, at = after - load[used], 0
        for b, x in zip(used.tolist(), given.tolist()):
            if x:
                out.append((key, b, at, at + x))
                at += x
        load[used] = after
    return out


def levelled(loads: np.ndarray, count: int) -> np.ndarray:
    """How much of count goes on each load so that the highest is as low as can be; of equals the first get what is over."""
    order = np.argsort(loads, kind="stable")
    rising = loads[order]
    # Filling the lowest w + 1 loads up to the next takes need[w].
    need = rising[1:] * np.arange(1, len(loads)) - np.cumsum(rising)[:-1]
    width = int(np.searchsorted(need, count, "left")) + 1
    level, over = divmod(count + int(rising[:width].sum()), width)
    given = np.zeros(len(loads), np.int64)
    given[order[:width]] = level - rising[:width] + (np.arange(width) < over)
    return given


def planned(spark: SparkSession, heavy: DataFrame, key: str, n: int, tolerance: float = 0.3, light: int = 1000) -> DataFrame:
    """The plan as a DataFrame (key, bucket, lo, hi, cnt) from (key, cnt), each key once; of more than MAX_KEYS the largest."""
    got = [(r[key], r["cnt"]) for r in heavy.select(key, "cnt").orderBy(F.desc("cnt")).limit(MAX_KEYS).collect()]
    kind = heavy.schema[key].dataType.simpleString()
    rows = [(got[i][0], b, lo, hi, got[i][1]) for i, b, lo, hi in _by_index(got, n, tolerance, light)]
    return spark.createDataFrame(rows, f"`{key}` {kind}, bucket int, lo long, hi long, cnt long")


def _by_index(got: list[tuple], n: int, tolerance: float, light: int) -> Iterator[tuple]:
    """The plan with each key as its place in the list; keys of equal text are one candidate order, not one key."""
    by_text: dict[str, list] = {}
    for i, (k, c) in enumerate(got):
        by_text.setdefault(str(k), []).append((i, c))
    for text, bucket, lo, hi in plan([(t, sum(c for _, c in x)) for t, x in by_text.items()], n, tolerance, light):
        at = 0
        for i, c in by_text[text]:
            a, b = max(lo, at), min(hi, at + c)
            if a < b:
                yield i, bucket, a - at, b - at
            at += c


class Balancer:
    """The sequential form, for the rows of one sender: where each heavy row goes, decided on the way.

    A key starts at home. After every ``update_every`` of its rows it moves to the bucket that has had
    fewest of its rows, of those that have had any. A row whose bucket has more than ``light`` rows, most of all,
    and would leave (max - min) / max over tolerance takes the least loaded bucket of the key instead, which is given more
    buckets until one of them has less load; the key stays with it. Such a row counts twice among its key's rows, as the first choice was
    a turn too.
    """

    def __init__(self, n: int, tolerance: float = 0.3, light: float = 1000, update_every: int = 20):
        self.n, self.tolerance, self.light, self.update_every = n, tolerance, light, update_every
        self.load = [0] * n
        self.having = {0: n}  # load -> number of buckets
        self.top = self.low = 0
        self.keys: dict = {}

    def send(self, key) -> int:
        k = self.keys.get(key)
        if k is None:
            order = Candidates(key, self.n)
            k = self.keys[key] = {"order": order, "width": 1, "turns": {}, "now": order.known[0], "since": 0}
        target = self._turn(k)
        now = self.load[target]
        if now > self.light and now == self.top:
            low = self.low + (now == self.low and self.having[now] == 1)
            if (now + 1 - low) / (now + 1) > self.tolerance:
                self._move(k)
                target = self._turn(k)
        self._count(target)
        return target

    def _turn(self, k) -> int:
        target, turns = k["now"], k["turns"]
        turns[target] = turns.get(target, 0) + 1
        k["since"] += 1
        if k["since"] % self.update_every == 0:
            least = min(turns.values())
            if least < turns[target]:
                k["now"] = min(b for b, x in turns.items() if x == least)
        return target

    def _move(self, k) -> None:
        while True:
            best = min(k["order"].first(k["width"]), key=self.load.__getitem__)
            if self.load[best] < self.load[k["now"]]:
                k["now"] = best
                return
            if k["width"] == self.n:
                return
            k["width"] += 1

    def _count(self, target: int) -> None:
        was = self.load[target]
        self.load[target] = was + 1
        self.having[was] -= 1
        self.having[was + 1] = self.having.get(was + 1, 0) + 1
        self.top = max(self.top, was + 1)
        if not self.having[was]:
            del self.having[was]
            if was == self.low:
                self.low = was + 1


def sent_in_sequence(rows: DataFrame, key: str, sender: str, order: list[str], n: int, tolerance: float = 0.3, light: float = 1000, update_every: int = 20) -> DataFrame:
    """Heavy rows with ``bucket``, by one Balancer a sender; rows pass one task a sender in order."""
    names = rows.columns

    def run(batches):
        now, balancer = None, None
        for b in batches:
            out = []
            for s, k in zip(b.column(names.index(sender)).to_pylist(), b.column(names.index(key)).to_pylist()):
                if balancer is None or s != now:
                    now, balancer = s, Balancer(n, tolerance, light, update_every)
                out.append(balancer.send(k))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns)), pa.array(out, pa.int32())], [*names, "bucket"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return _streams(rows, sender, order).mapInArrow(run, f"{kinds}, bucket int")


def load(rows: DataFrame, sender: str, bucket: str = "bucket") -> DataFrame:
    """(sender, bucket, cnt): rows sent by target."""
    return rows.groupBy(sender, bucket).agg(F.count("*").alias("cnt"))
