"""Language identification by compression.

Each language has zstandard raw-content dictionaries, made of windows of a bounded sample of its
texts. A text is cut into windows, each window is compressed with every dictionary, and the language
whose sizes sum to least wins. The margin to the runner-up is the score; narrow margins are rejected.
Texts of all lengths are told by the same rule: a language's size is the mean over its PARTS
dictionaries, from disjoint parts of its sample, so that sizes in whole bytes tie less often.
"""

from __future__ import annotations

import re
import sys
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, extended, unwrapped, wrapped

UND = "und"
#: Letters are categories L*. \w has numbers besides, of which \d are the decimal digits only.
_OTHER = re.compile(r"[\W\d_]+")
_NUMBERS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha())
WINDOW, PARTS = 2048, 2
#: Least score of an accepted document, of the query and of the pipeline.
NARROW = 0.01


def normalised(text: str) -> str:
    """Lower case, with each run of what isn't a letter as one space; empty without letters."""
    text = _OTHER.sub(" ", text)
    if not text.isascii() and (odd := _NUMBERS.intersection(text)):
        text = " ".join(text.translate(dict.fromkeys(map(ord, odd), " ")).split())
    return text.strip().lower()


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text, mod 4, is 2. A null id isn't."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, per_language: int = 400, clip: int = 1000, languages: int = 256) -> dict[str, bytes]:
    """Language -> dictionary, from text and lang of documents that aren't held out.

    Of each language, the per_language distinct texts of least hash teach, however many copies they
    or others have. Each gives one window of clip characters, from a place anywhere in the text that
    its hash says, without the words that the window cuts. These bounds, and that of languages (those of most distinct
    texts), fix what the driver receives, whatever the table's size. Rows with a null or letterless
    text or a null lang teach nothing.
    """
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.xxhash64("text").alias("h"), "text")
    distinct = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    if not distinct:
        return {}
    # Twice as many as wanted, as the numbers are estimates; copies are dropped before they move.
    share = F.create_map(*[F.lit(x) for r in distinct for x in (r["lang"], min(1.0, 2 * per_language / max(1, r["n"])))])
    u = F.shiftrightunsigned("h", 12) / float(1 << 52)
    length = F.char_length("text")
    start = F.pmod("h", F.greatest(F.lit(1), length - clip + 1)).cast("int") + 1
    window = F.struct(F.substring("text", start, F.lit(clip)).alias("text"), (start > 1).alias("left"), (start + clip <= length).alias("right"))
    sample = rows.where(u < F.element_at(share, F.col("lang"))).groupBy("lang", "h").agg(F.min(window).alias("x"))
    least = sample.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("i") <= per_language)
    texts: dict[str, list] = {}
    for r in least.select("lang", "h", "x.*").collect():
        # What is left of the word that an end cuts goes.
        text = re.sub(r"^\S+" * r["left"] + "|" * (r["left"] and r["right"]) + r"\S+$" * r["right"], "", r["text"]) if r["left"] or r["right"] else r["text"]
        texts.setdefault(r["lang"], []).append((r["h"], normalised(text)))
    joined = {lang: " ".join(x for _, x in sorted(got) if x).encode() for lang, got in sorted(texts.items())}
    return {lang: data for lang, data in joined.items() if data}


def _compressor(data: bytes, level: int) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


@lru_cache(maxsize=4)
def _compressors(model: tuple[tuple[str, bytes], ...], level: int):
    """(language, its PARTS compressors); the dictionary is halved at a byte, the few are one part."""
    out = []
    for lang, data in model:
        step = max(256, -(-len(data) // PARTS))
        out.append((lang, [_compressor(data[i : i + step], level) for i in range(0, len(data), step)]))
    return out


def classify(text: str | None, compressors) -> tuple[str, float]:
    """(language, score); the score is the share of bytes by which the best beats the runner-up."""
    data = normalised(text).encode() if text else b""
    if not data or not compressors:
        return UND, 0.0
    data = b" " + data + b" "
    windows = [data[i : i + WINDOW] for i in range(0, len(data), WINDOW)]
    sizes = sorted((sum(len(c.compress(w)) for c in parts for w in windows) / len(parts), lang) for lang, parts in compressors)
    if len(sizes) == 1:
        return sizes[0][1], 1.0
    return sizes[0][1], 1.0 - sizes[0][0] / sizes[1][0]


def identify(docs: DataFrame, model: dict[str, bytes], level: int = 5, narrow: float = NARROW) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and accepted, replacing columns of these names.

    Only text is looked at, whole. A null text, one without letters, or an empty model gives
    ``und``, score 0, not accepted. A score below ``narrow`` is a narrow margin and isn't accepted.
    Ties go to the language first in code-point order.
    """
    bounded_batches(docs.sparkSession)
    items = tuple(sorted(model.items()))

    def run(batches):
        compressors = _compressors(items, level)
        for b in batches:
            at = b.schema.get_field_index("text")
            got = [classify(t, compressors) for t in b.column(at).to_pylist()]
            cols = [b.column(i) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[0] != UND and x[1] >= narrow for x in got], pa.bool_())], names)

    kept = docs.drop("lang_pred", "score", "accepted")
    names = [*kept.columns, "lang_pred", "score", "accepted"]
    return kept.mapInArrow(run, extended(kept, lang_pred="string", score="double", accepted="boolean"))


def filtered(docs: DataFrame, model: dict[str, bytes], narrow: float = NARROW) -> DataFrame:
    """The rows of docs, with all columns, that ``identify`` accepts."""
    return unwrapped(identify(wrapped(docs), model, narrow=narrow).where("accepted"), docs)
