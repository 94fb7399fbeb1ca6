"""Packing token sequences into windows by non-negative least squares.

Documents are cut into full windows and one remainder each. Remainders are counted by length class;
all combinations of up to three classes that fill a window exactly are enumerated, and non-negative
least squares finds how often to use each so that their use of classes matches the histogram. The
solution is rounded down; remainders are dealt to the slots of these sequences by their rank in
their class, and what is left is laid end to end and cut at window ends.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, emptying, hold, materialize, ranked

EOD = 2


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of texts by way of their chunks between white space, of which a corpus has few distinct ones.

    This tokenizer drops white space, so ids of a text are those of its chunks in order. A batch's
    chunks are numbered by Arrow, only distinct ones are looked up, and new ones are encoded together:
    words are told apart by the ids that end words, others are joined by a mark whose one id none of
    them has. What is known is bounded, and forgotten when it is full.
    """

    LIMIT = 400_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = _tokenizer(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        vocabulary = self.whole.get_vocab()
        n = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2") if n <= 1 << 16 else np.dtype("<u4")
        self.mark, self.mark_id = next((c, ids[0]) for c in "\u2605\u2665\u2022\u2026\u2192\u25ba" if len(ids := self._ids(c)) == 1)
        self.last, self.marked = np.zeros((2, n), bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.marked[self.mark_id] = True
        self.known: dict[str, bytes] = {"": b""}

    def clear(self) -> None:
        self.known = {"": b""}

    def _ids(self, text: str) -> list[int]:
        return self.whole.encode(text, add_special_tokens=False).ids

    def _bytes(self, text: str) -> bytes:
        return np.array(self._ids(text), self.dtype).tobytes()

    def _together(self, text: str) -> list[int]:
        """Ids of many chunks; the normalizer has nothing to do for lower-case Latin-1."""
        try:
            text.encode("latin-1")
            tokenizer = self.plain if text == text.lower() else self.whole
        except UnicodeEncodeError:
            tokenizer = self.whole
        return tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, chunks: list[str]) -> None:
        """Has all of chunks among the known ones."""
        if len(self.known) > self.LIMIT:
            self.clear()
        known = self.known
        new = [c for c in chunks if c not in known]
        words = {c for c in new if c.isalpha()}
        plain, tails = [], []
        for c in new:
            if c in words:
                continue
            if (stem := c.rstrip(string.punctuation)).isalpha():
                # A run of punctuation behind a word is a token sequence of its own.
                tails.append((c, stem, c[len(stem) :]))
                if stem not in known:
                    words.add(stem)
            elif self.mark in c or "<|" in c or len(c) > 200:
                known[c] = self._bytes(c)
            else:
                plain.append(c)
        self._encode(list(words), " ", self.last, 0)
        self._encode(plain, f" {self.mark} ", self.marked, 1)
        for c, stem, tail in tails:
            if tail not in known:
                known[tail] = self._bytes(tail)
            known[c] = known[stem] + known[tail]

    def _encode(self, chunks: list[str], between: str, ending: np.ndarray, skip: int) -> None:
        """Ids of chunks encoded together. ``ending`` tells the ids after which the next chunk comes; ``skip`` of them are no part of a chunk."""
        for i in range(0, len(chunks), 4096):
            part = chunks[i : i + 4096]
            ids = np.array(self._together(between.join(part)), self.dtype)
            ends = np.nonzero(ending[ids])[0] + 1 - skip
            if skip:
                ends = np.append(ends, len(ids))
            if len(ends) != len(part):  # no such chunk is known
                self.known.update((c, self._bytes(c)) for c in part)
                continue
            data, size, start = ids.tobytes(), self.dtype.itemsize, 0
            for c, end in zip(part, ends.tolist()):
                self.known[c] = data[start * size : end * size]
                start = end + skip

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """Number of ids of each text, with EOD behind; and the ids, as little-endian bytes."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        # Lower-casing first makes fewer distinct chunks. Special tokens are told by their case, so texts that may have one keep theirs.
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        # These four are white space to Arrow, but not to the tokenizer; chunks may hold any other.
        odd = pc.any(pc.match_substring_regex(texts, "[\\x1c-\\x1f]")).as_py()
        parts = pc.split_pattern(texts, " ") if odd else pc.utf8_split_whitespace(texts)
        numbered = parts.flatten().dictionary_encode()
        chunks = numbered.dictionary.to_pylist()
        self._learn(chunks)
        data = [self.known[c] for c in chunks]
        size = np.fromiter(map(len, data), np.int64, len(data)) // self.dtype.itemsize
        pool = np.frombuffer(b"".join(data), self.dtype)
        first = np.cumsum(size) - size
        at = numbered.indices.to_numpy()
        n = size[at]
        # The ids of all occurrences in order: runs of the pool.
        ends = np.cumsum(n)
        ids = pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[at] - ends + n, n)]
        bounds = np.concatenate([[0], ends])[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        ids = np.insert(ids, bounds[1:], EOD)
        bounds = bounds + np.arange(len(bounds))
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(bounds * self.dtype.itemsize), pa.py_buffer(np.ascontiguousarray(ids))])
        return np.diff(bounds), out.cast(pa.binary())


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def token_ids(text: str | None, path: str) -> np.ndarray:
    """Ids of a text, ended by EOD."""
    e = _encoder(path)
    return np.frombuffer(e.encoded(pa.array([text], pa.string()))[1][0].as_py(), e.dtype)


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, row, doc_tokens, ids) for each row; row is unique once this is written, ids are little-endian bytes."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        encoder = _encoder(path)
        for b in batches:
            n, ids = encoder.encoded(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), ids], ["doc_id", "row", "doc_tokens", "ids"])

    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(lambda it: emptying(_encoder(path), run(it)), "doc_id long, row long, doc_tokens long, ids binary")


def combinations(classes: int) -> np.ndarray:
    """Rows (a, b, c) with a >= b >= c >= 0, a >= 1 and a + b + c = classes; 0 is an unused slot."""
    a, b = np.meshgrid(np.arange(1, classes + 1), np.arange(0, classes + 1), indexing="ij")
    c = classes - a - b
    ok = (a >= b) & (b >= c) & (c >= 0)
    return np.stack([a[ok], b[ok], c[ok]], axis=1)


def repeats(histogram: np.ndarray, combos: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Whole non-negative repeat counts of combos that don't use more of a class than there is.

    Accelerated projected gradient on ||A r - histogram||^2, r >= 0, with A given by combos; then
    rounding down, and lowering of combos that still overdraw a class.
    """
    n = len(histogram)  # class 0 is unused
    weight = (combos > 0).astype(float)
    use = lambda r: np.bincount(combos.ravel(), (weight * r[:, None]).ravel(), n)
    back = lambda g: (weight * g[combos]).sum(axis=1)
    size = 1.0
    v = np.ones(len(combos))
    for _ in range(12):  # the largest eigenvalue bounds the step
        v = back(use(v))
        size = np.linalg.norm(v)
        v /= size
    r = np.zeros(len(combos))
    y, t = r.copy(), 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(use(y) - histogram) / (1.05 * size))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, r, t = new + (t - 1) / t_new * (new - r), new, t_new
    left = histogram.astype(np.int64).copy()
    out = np.zeros(len(combos), np.int64)
    for i in np.argsort(-r, kind="stable"):
        if (want := int(np.floor(r[i] + 1e-9))) < 1:
            break
        parts, times = np.unique(combos[i][combos[i] > 0], return_counts=True)
        out[i] = max(0, min(want, int((left[parts] // times).min())))
        left[parts] -= out[i] * times
    # Greedy: the combos of largest value take what the histogram still has, so that rounding loses little.
    for i in np.argsort(-r, kind="stable"):
        if r[i] <= 1e-6:
            break
        parts, times = np.unique(combos[i][combos[i] > 0], return_counts=True)
        more = int((left[parts] // times).min())
        if more > 0:
            out[i] += more
            left[parts] -= more * times
    return out


def plan(histogram: dict[int, int], classes: int) -> list[tuple[int, int, int, int, int]]:
    """Slots as (class, lo, hi, first, slot): ranks lo to hi-1 of a class go to sequences first, first+1, ..."""
    h = np.zeros(classes + 1)
    for k, n in histogram.items():
        h[k] = n
    combos = combinations(classes)
    combos = combos[((h[combos] > 0) | (combos == 0)).all(axis=1)]
    if not len(combos):
        return []
    used, first, out = np.zeros(classes + 1, np.int64), 0, []
    for combo, n in zip(combos.tolist(), repeats(h, combos).tolist()):
        if n:
            for slot, c in enumerate(x for x in combo if x):
                out.append((c, int(used[c]), int(used[c] + n), first, slot))
                used[c] += n
            first += n
    return out


#: Rows in a bucket of a ranking, about.
BUCKET = 1024


def _ranked(pieces: DataFrame, by: Sequence[str], value, buckets: int) -> DataFrame:
    """pieces with before: the sum of value over the pieces ahead in their group of columns by, ordered by a hash of row."""
    return ranked(pieces, by, ["row"], value, F.pmod(F.xxhash64("row"), F.lit(buckets)), buckets)


def placed(lengths: DataFrame, window: int = 4096, unit: int = 8) -> DataFrame:
    """Pieces (row, start, length, sequence_id, offset) of rows (row, doc_tokens), row being unique."""
    spark = lengths.sparkSession
    if window % unit:
        raise ValueError("unit must divide window")
    full = F.floor(F.col("doc_tokens") / window)
    n_full, n_rows = lengths.agg(F.coalesce(F.sum(full), F.lit(0)), F.count("*")).first()
    buckets = max(1, -(-n_rows // BUCKET))
    long = _ranked(lengths.where(full > 0).select("row", full.alias("n")), [], F.col("n"), buckets)
    alone = long.select("row", "before", F.posexplode(F.array_repeat(F.lit(window).cast("long"), F.col("n").cast("int"))).alias("i", "length"))
    alone = alone.select("row", (F.col("i") * F.lit(window).cast("long")).alias("start"), "length", (F.col("before") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    tails = lengths.select("row", (full * window).alias("start"), (F.col("doc_tokens") - full * window).alias("length")).where("length > 0")
    tails = tails.withColumn("class", F.ceil(F.col("length") / unit).cast("int"))
    histogram = {r["class"]: r["count"] for r in tails.groupBy("class").count().collect()}  # window / unit rows at most
    slots = plan(histogram, window // unit)
    n_planned = max((first + hi - lo for _, lo, hi, first, _ in slots), default=0)
    # Three slots for a combination at most: about classes^2 / 4 rows, whatever the number of documents.
    table = F.broadcast(spark.createDataFrame(slots or [(0, 0, 0, 0, 0)], "c int, lo long, hi long, first long, slot int"))
    ranked = _ranked(tails, ["class"], F.lit(1), buckets)
    spot = ranked.join(table, (F.col("class") == F.col("c")) & (F.col("before") >= F.col("lo")) & (F.col("before") < F.col("hi")), "left")
    spot = hold(spot.select("row", "start", "length", (F.col("first") + F.col("before") - F.col("lo")).alias("sequence"), "slot"))
    order = Window.partitionBy("sequence").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(order), F.lit(0)).cast("long")
    planned = spot.where("sequence is not null").select("row", "start", "length", (F.col("sequence") + n_full).alias("sequence_id"), offset.alias("offset"))

    # What no combination takes is one stream, cut wherever a window ends.
    stream = _ranked(spot.where("sequence is null").select("row", "start", "length"), [], F.col("length"), buckets)
    end = F.col("before") + F.col("length")
    cut = stream.withColumn("at", F.explode(F.sequence(F.floor(F.col("before") / window), F.floor((end - 1) / window))))
    lo, hi = F.greatest("before", F.col("at") * window), F.least(end, (F.col("at") + 1) * window)
    rest = cut.select("row", (F.col("start") + lo - F.col("before")).alias("start"), (hi - lo).alias("length"), (F.col("at") + n_full + n_planned).alias("sequence_id"), (lo - F.col("at") * window).alias("offset"))
    return alone.unionByName(planned).unionByName(rest)


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pieces(batches, with_ids: bool):
    """Pieces of (doc_id, doc_tokens, ids, pieces); ids are of 2 or 4 bytes, as the batch's lengths tell, so that no tokenizer is loaded for it."""
    names = [*(x.split()[0] for x in PIECE.split(", ")), *["ids"] * with_ids]
    for b in batches:
        data, pieces = b.column(2).cast(pa.binary()), b.column(3)
        bounds = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
        dtype = np.dtype("<u4" if bounds[-1] - bounds[0] > 2 * (pc.sum(b.column(1)).as_py() or 0) else "<u2")
        ids = np.frombuffer(data.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]].view(dtype).astype("<u4")
        view = memoryview(ids).cast("B")
        parent = pc.list_parent_indices(pieces)
        start, length, sequence, offset = pieces.flatten().flatten()
        first = ((bounds[:-1] - bounds[0]) // dtype.itemsize)[parent.to_numpy()] + start.to_numpy()
        parts = [view[4 * f : 4 * (f + n)] for f, n in zip(first.tolist(), length.to_pylist())]
        crc = pa.array(map(zlib.crc32, parts), pa.int64())
        own = [pa.array(map(bytes, parts), pa.binary())] * with_ids
        yield pa.RecordBatch.from_arrays([b.column(0).take(parent), start, length, crc, b.column(1).take(parent), sequence, offset, *own], names)


def packed(docs: DataFrame, tokenizer: str, window: int = 4096, unit: int = 8, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document in a sequence; with_ids adds the piece's ids (uint32, little-endian).

    docs needs doc_id and text. A document's ids are its text's, then EOD; each id is in exactly one
    piece, sequences hold window ids at most, and offsets in a sequence have no gaps. Full windows of
    a document are sequences of their own, remainders are packed as the module says; a remainder
    takes at most unit - 1 ids less than its class, which is all the padding but for the last
    sequence. A null text is an empty one; rows with a null or repeated doc_id are packed as rows of
    their own; an empty table gives no pieces.
    """
    # Written, not held: a partition computed again in another order would give rows other numbers.
    tokens = materialize(tokenised(docs, tokenizer), "tokens")
    pieces = placed(tokens.select("row", "doc_tokens"), window, unit)
    # One row for each document: a long one is not repeated for each of its pieces.
    held = pieces.groupBy(F.col("row").alias("r")).agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    rows = tokens.join(held, F.col("row") == F.col("r")).select("doc_id", "doc_tokens", "ids", "pieces")
    return rows.mapInArrow(lambda it: _pieces(it, with_ids), PIECE + ", ids binary" * with_ids)


def sequences(pieces: DataFrame, window: int = 4096, pad: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids) from pieces with ids; ids are padded to window unless their number is a power of two."""
    parts = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    power = F.bit_count("n_tokens") == 1
    filler = F.repeat(F.lit(pad.to_bytes(4, "little").decode("latin-1")), F.when(power, 0).otherwise(window - F.col("n_tokens")).cast("int")).cast("binary")
    return parts.select("sequence_id", "n_tokens", F.concat(ids, filler).alias("ids"))
