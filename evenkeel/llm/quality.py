"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, one of target texts and one of all raw texts, give each
document an importance weight, the ratio of its probabilities; the k documents with the largest log
weight plus standard Gumbel variate are a draw of k without replacement in proportion to the weights.
Log weights are per n-gram and times LENGTH, so that long documents aren't drawn for their length.
The n-grams are unigrams and bigrams of words and punctuation runs; a word that repeats the one
before it is written as one REPEAT symbol, so that repetition has a bucket of its own.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, emptying, extended, hold, materialize, mix, unwrapped, wrapped

BUCKETS = 1 << 16
_TOKEN = re.compile(rb"[\x00-\x08\x0e-\x1f!-/:-@\[-`{-\x7f]+|[0-9A-Za-z\x80-\xff]+")
_REPEAT, _CAPS = 1, 2
SLACK = 3.0
#: A document is weighed as one of so many n-grams with its mean ratio: the inverse of the draw's temperature.
LENGTH = 16.0
#: Clean labelled documents that target texts and the level are taken from, about so many at most; their ids are broadcast.
LABELS = 200_000


class _Tokens(dict):
    """Token -> hash. Words in capitals of three letters or more share one symbol, as they say style, not topic."""

    def __missing__(self, token: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        word = token.decode("utf-8", "replace")
        h = self[token] = _CAPS if len(word) > 2 and word.isupper() else xxhash.xxh3_64_intdigest(token)
        return h


TOKENS = _Tokens()


def features(text: bytes | None) -> np.ndarray:
    """Buckets of the n-grams of a text, one entry for each occurrence."""
    tokens = _TOKEN.findall(text) if text else []
    if not tokens:
        return np.empty(0, np.int64)
    h = np.fromiter(map(TOKENS.__getitem__, tokens), np.uint64, len(tokens))
    again = h[1:] == h[:-1]
    h[1:][again & (h[1:] != _CAPS)] = _REPEAT
    with np.errstate(over="ignore"):
        pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
        return (np.concatenate([mix(h), pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def _counted(batches):
    """One row for each bucket a task has met, with its counts in raw and in target texts."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for b in batches:
        found = [features(t) for t in b.column(0).cast(pa.binary()).to_pylist()]
        chosen = [f for f, good in zip(found, b.column(1).to_pylist()) if good]
        for total, parts in ((raw, found), (target, chosen)):
            if parts:
                total += np.bincount(np.concatenate(parts), minlength=BUCKETS)
    at = np.nonzero(raw)[0]
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, raw[at], target[at])], ["bucket", "raw", "target"])


def fit(docs: DataFrame, good, prior: float = 10.0) -> np.ndarray:
    """Log ratio of each bucket: ln p(bucket | target) - ln p(bucket | raw).

    docs needs text; good is a boolean column saying which rows are target texts. All rows are
    counted. Target counts are compared with those expected at the raw rate, ``prior`` being added
    to both, so that rare n-grams say little. The driver receives BUCKETS rows at most. Without
    target texts every ratio is 0.
    """
    bounded_batches(docs.sparkSession)
    counts = docs.select("text", F.coalesce(good, F.lit(False)).alias("good")).mapInArrow(lambda it: emptying(TOKENS, _counted(it)), "bucket long, raw long, target long")
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).toLocalIterator():
        raw[r[0]], target[r[0]] = r[1], r[2]
    if not target.any():
        return np.zeros(BUCKETS)
    return np.log(target + prior) - np.log(raw * (target.sum() / raw.sum()) + prior)


def scored(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """docs with n_grams and log_weight (sum of its n-grams' ratios), replacing columns of these names.

    A null or blank text has no n-grams and log_weight 0.
    """
    bounded_batches(docs.sparkSession)
    kept = docs.drop("n_grams", "log_weight")
    names = [*kept.columns, "n_grams", "log_weight"]

    def run(batches):
        for b in batches:
            got = [features(t) for t in b.column(b.schema.get_field_index("text")).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns)), pa.array([len(f) for f in got], pa.int64()), pa.array([float(ratios[f].sum()) for f in got], pa.float64())], names)

    return kept.mapInArrow(lambda it: emptying(TOKENS, run(it)), extended(kept, n_grams="long", log_weight="double"))


def gumbel(seed: int, *columns: str):
    """A standard Gumbel variate that is a function of the columns' values, so reruns agree."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 1024) -> float | None:
    """The k-th largest value of a double column, exactly; None if there are fewer or k < 1.

    Each round counts values in equal bins of the open interval and goes on in the bin that holds
    rank k, so the driver receives bins rows at a time.
    """
    df = df.select(column).where(F.col(column) > float("-inf"))
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if k < 1 or n < k:
        return None
    above = 0
    while low < high:
        step = (high - low) / bins
        inside = df.where(F.col(column).between(low, high))
        if low + step == low:  # a few neighbouring doubles are left
            at = F.col(column)
        else:
            at = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(step)), F.lit(bins - 1))
        found = inside.groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(found, key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                low, high = r["lo"], r["hi"]
                break
            above += r["n"]
    return high


def keyed(rows: DataFrame, seed: int, length: float = LENGTH) -> DataFrame:
    """rows (doc_id, h, n_grams, log_weight) with mean (ratio of their n-grams) and sample_key.

    sample_key is length * mean plus a standard Gumbel variate that depends on doc_id and the text's
    hash h. No n-grams give null and minus infinity: weight 0.
    """
    mean = F.when(F.col("n_grams") > 0, F.col("log_weight") / F.col("n_grams"))
    key = F.lit(length) * mean + gumbel(seed, "doc_id", "h")
    return rows.withColumns({"mean": mean, "sample_key": F.coalesce(key, F.lit(float("-inf")))})


def drawn(weighted: DataFrame, k: int):
    """A condition on rows with sample_key: among the k of largest key, ties included; all of weight if fewer have any.

    Nothing is sorted or sent to the driver: the k-th key is found by counting.
    """
    if k < 1:
        return F.lit(False)
    limit = kth_largest(weighted, "sample_key", k)
    return F.col("sample_key") >= F.lit(limit) if limit is not None else F.col("sample_key") > F.lit(float("-inf"))


def _clean(labels: DataFrame, seed: int) -> DataFrame:
    """(id) of documents labelled clean, LABELS at most but for chance; labels that disagree mean not clean."""
    clean = (F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(1)) == 0)
    ids = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min(clean).alias("clean")).where("clean").select("id")
    share = min(1.0, LABELS / max(1, ids.count()))
    return hold(ids.where(F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(1 << 30)) < int(share * (1 << 30))))


def _fold(seed: int, folds: int, column: str):
    return F.pmod(F.xxhash64(F.lit(seed), column), F.lit(folds)) == 0


def _ratios(docs: DataFrame, clean: DataFrame, seed: int, folds: int) -> np.ndarray:
    known = docs.select("doc_id", "text").join(F.broadcast(clean.where(~_fold(seed, folds, "id"))), F.col("doc_id") == F.col("id"), "left")
    return fit(known, F.col("id").isNotNull())


def budget(rows: DataFrame, clean: DataFrame, seed: int, keep_clean: float, folds: int) -> int:
    """How many of keyed rows have a mean ratio as clean texts have.

    The level is what a share keep_clean of the clean fold left out of the fit reaches, lowered by
    SLACK times its distance to their median, as few clean texts say little about the tail. Without
    such texts all rows with n-grams count.
    """
    left_out = rows.where(_fold(seed, folds, "doc_id")).join(F.broadcast(clean), F.col("doc_id") == F.col("id"), "left_semi")
    n = left_out.agg(F.count("mean")).first()[0]
    if not n:
        return rows.where("n_grams > 0").count()
    low, middle = (kth_largest(left_out, "mean", math.ceil(n * share)) for share in (keep_clean, 0.5))
    return rows.where(F.col("mean") >= F.lit(low - SLACK * (middle - low))).count()


def judged(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 5, keep_clean: float = 0.99, folds: int = 4) -> DataFrame:
    """(doc_id, n_grams, log_weight, sample_key, selected) for each row of docs (doc_id, text).

    Clean documents are those labelled quality 1 and toxic 0, of which LABELS are used at most.
    Target texts are clean ones but for one fold in ``folds`` by a hash of the id; raw texts are all.
    The k rows of largest sample_key are selected (see ``keyed``); by default k is the ``budget``, the number of rows
    whose ratio is as a clean text's, so that a draw of them leaves clean texts in and decides by
    weight and chance about those near the level. Labelled texts have no say in how well they
    themselves are fitted. Labels that disagree about a document count as not clean. Rows with a
    null doc_id can't be labelled but are judged. Texts without n-grams aren't selected. Without
    clean labels all weights are 1. Repeated rows are judged alike.
    """
    clean = _clean(labels, seed)
    ratios = _ratios(docs, clean, seed, folds)
    rows = hold(scored(docs.select("doc_id", "text"), ratios).select("doc_id", "n_grams", "log_weight", F.xxhash64("text").alias("h")))
    rows = keyed(rows, seed)
    chosen = drawn(rows, budget(rows, clean, seed, keep_clean, folds) if k is None else k)
    return rows.select("doc_id", "n_grams", "log_weight", "sample_key", chosen.alias("selected"))


def filtered(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 5, keep_clean: float = 0.99, folds: int = 4) -> DataFrame:
    """The rows of docs that ``judged`` selects, with all columns.

    Scored texts are written once and read again without them to find the k-th key, so no text is
    scored twice or shuffled.
    """
    clean = _clean(labels, seed)
    ratios = _ratios(docs, clean, seed, folds)
    rows = materialize(scored(wrapped(docs).withColumn("h", F.xxhash64("text")), ratios), "scored")
    rows = keyed(rows, seed)
    slim = rows.select("doc_id", "n_grams", "mean", "sample_key")
    return unwrapped(rows.where(drawn(slim, budget(slim, clean, seed, keep_clean, folds) if k is None else k)), docs)
