import zlib
from functools import lru_cache

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from evenkeel.llm import packing  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length int"


@lru_cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def brute_ids(text):
    return [*tokenizer().encode(text or "", add_special_tokens=False).ids, packing.EOD]


ODD = ["", None, "a", "   x　y", "naıve École é ́x ΣΣ", "a\x1cb \x1d\x1e\x1f c", "x<|endoftext|>y <|startoftext|>", "X<|ENDOFTEXT|>Y <|EndOfText|> <|StartOfText|><|startoftext|>", "A <| B\u00c9 <|endoftext|>C", "it's we'll 12 !!?", "中文 한글\r\n\t tab\x0bv\x85w z", "\U0001f600a‍b", "★ x★y ★ <|x ♥ • … →", "İstanbul ΟΔΟΣ ÀÉ", "z" * 500, "a, b., c!? d' 's e's. f_ ,g 1, 2. é, e\u0301, \u0301."]


def test_chunks_equal_whole_texts(spark, sf):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    for t in texts:
        assert packing.token_ids(t, PATH).tolist() == brute_ids(t), t


def test_batches_and_slices():
    import pyarrow as pa

    texts = [*ODD, *(f"Word{i} und Größe, À la carte {i % 7}" for i in range(200)), None]
    e = packing.Encoder(PATH)
    for part in (texts, texts[3:], [t for t in texts if not t or "\x1c" not in t]):
        for array in (pa.array(part), pa.array(["skipped à", *part]).slice(1)):
            n, ids = e.encoded(array)
            want = [brute_ids(t) for t in part]
            assert [np.frombuffer(x, e.dtype).tolist() for x in ids.to_pylist()] == want and n.tolist() == list(map(len, want))
    assert len(e.encoded(pa.array([], pa.string()))[0]) == 0


def check(pieces, rows, window=4096):
    want = {i: brute_ids(t) for i, t, _ in rows}
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(want)
    for i, mine in by_doc.items():
        at = 0
        for r in sorted(mine, key=lambda r: r["start"]):
            part = np.array(want[i][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(want[i]) and r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(want[i])
    for mine in by_sequence.values():
        at = 0
        for r in sorted(mine, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    return by_sequence


@pytest.mark.parametrize("window,unit", [(4096, 8), (64, 4), (60, 6)])
def test_pieces(spark, window, unit):
    rows = [(i, ("word " * (i * 7 % 90)).strip(), 1) for i in range(150)] + [(900 + i, t, 1) for i, t in enumerate(ODD)] + [(999, "long text " * 4000, 1)]
    pieces = packing.packed(spark.createDataFrame(rows, SCHEMA), PATH, window, unit).collect()
    sequences = check(pieces, rows, window)
    fill = [sum(r["length"] for r in s) for s in sequences.values()]
    assert sum(window - n for n in fill) <= 0.2 * sum(fill) + window


def test_padding_is_little(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pieces = packing.packed(docs, PATH)
    fill = [r["n"] for r in pieces.groupBy("sequence_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()]
    assert sum(4096 - n for n in fill if n & (n - 1)) - 4096 <= 0.01 * sum(fill)


def test_sequences(spark):
    rows = [(i, "word " * (i * 11 % 70), 1) for i in range(60)]
    pieces = packing.packed(spark.createDataFrame(rows, SCHEMA), PATH, 64, 4, with_ids=True)
    sets = check(pieces.collect(), rows, 64)
    for r in packing.sequences(pieces, 64, pad=7).collect():
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        want = [x for p in sorted(sets[r["sequence_id"]], key=lambda p: p["offset"]) for x in np.frombuffer(p["ids"], "<u4").tolist()]
        n = len(want)
        assert r["n_tokens"] == n and ids == (want if n & (n - 1) == 0 else want + [7] * (64 - n))


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c", 1), (1, "a b c", 1), (1, "d", 1), (None, "e f", 1), (None, None, 1)]
    out = packing.packed(spark.createDataFrame(rows, SCHEMA), PATH).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in out) == [("1", 2), ("1", 4), ("1", 4), ("None", 1), ("None", 3)]
    assert packing.packed(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_combinations_and_repeats():
    c = packing.combinations(12)
    assert (c.sum(axis=1) == 12).all() and len({tuple(x) for x in c.tolist()}) == len(c) == sum(1 for a in range(1, 13) for b in range(a + 1) for d in range(b + 1) if a + b + d == 12)
    h = np.zeros(13)
    h[[3, 9, 4, 6, 12]] = [100, 60, 90, 7, 5]
    c = c[((h[c] > 0) | (c == 0)).all(axis=1)]
    r = packing.repeats(h, c)
    used = np.zeros(13, int)
    for combo, n in zip(c.tolist(), r.tolist()):
        for x in combo:
            used[x] += n if x else 0
    assert (used <= h).all() and used[12] == 5 and used[9] == 60 and used[4] >= 84


def test_driver_loads_no_tokenizer(spark):
    """Tables of vocabularies are large; only tasks need them."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    packing._encoder.cache_clear()
    out = packing.packed(docs, PATH, 16, 4, with_ids=True)
    assert packing._encoder.cache_info().currsize == 0
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    assert {d: sum((x for _, x in sorted(p)), []) for d, p in got.items()} == {i: brute_ids(t) for i, t in enumerate(ODD)}


@pytest.mark.parametrize("kind", ["<u2", "<u4"])
def test_pieces_of_ids_of_either_size(kind):
    import pyarrow as pa

    ids, piece = [[7, 2], [2], [1, 9, 2]], "start long, length long, sequence_id long, offset long"
    kinds = pa.list_(pa.struct([(x.split()[0], pa.int64()) for x in piece.split(", ")]))
    whole = [[{"start": 0, "length": len(x), "sequence_id": 0, "offset": 0}] for x in ids]
    b = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(list(map(len, ids))), pa.array([np.array(x, kind).tobytes() for x in ids], pa.binary()), pa.array(whole, kinds)], ["doc_id", "doc_tokens", "ids", "pieces"])
    for part in (b, b.slice(1), b.slice(0, 0)):
        (out,) = packing._pieces([part], True)
        assert [np.frombuffer(x, "<u4").tolist() for x in out.column(7).to_pylist()] == ids[3 - part.num_rows :] * bool(part.num_rows)
