"""Ogg media columns (RFC 3533): pages with checksums, packets by lacing values, logical streams, granule times.

The writer stores a payload as 8-bit samples, one sample a byte, at a fixed rate, in packets dealt
to several logical streams whose pages are multiplexed. The reader verifies each page's checksum,
splits pages by their lacing values, joins packets that go over page ends, and demultiplexes by serial
number. A page's granule position is the end of the last packet that ends on it; the ends of those before
follow backwards from the packets' durations and the turns that the other streams take between them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, extended

RATE = 8000
PACKET = 4096
STREAMS = 2
_HEAD = struct.Struct("<4sBBqIIIB")
_CONTINUED, _FIRST, _LAST = 1, 2, 4
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_MAGIC = b"RAW8"
_INTRO = struct.Struct("<4sHHII")  # magic, number of the stream, streams, samples a second, samples of a full packet


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, no reflection, zero start and end, its field in the page taken as 0.

    It is the reflected CRC of the bit-reversed bytes, so zlib's does the work.
    """
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "big").translate(_REVERSED)[::-1], "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    page = b"".join((head, lacing, body))
    return b"".join((head[:22], checksum(page).to_bytes(4, "little"), page[26:]))


def _stream(serial: int, packets: list[tuple[int, bytes]]) -> list[tuple[int, int, bytes]]:
    """(granule, number, page) of one logical stream of packets (granule position at the end, data).

    The first packet has a page of its own. A page's granule position is that of the last packet that
    ends on it, -1 if none does.
    """
    out, lacing, body, granule, number, flags, seen = [], bytearray(), [], -1, 0, _FIRST, 0

    def flush(last=False):
        nonlocal lacing, body, granule, number, flags
        page = _page(flags | (_LAST if last else 0), granule, serial, number, bytes(lacing), b"".join(body))
        out.append((seen, number, page))
        flags = _CONTINUED if lacing and lacing[-1] == 255 else 0
        lacing, body, granule, number = bytearray(), [], -1, number + 1

    for i, (end, data) in enumerate(packets):
        at, values = 0, b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
        while values:
            if len(lacing) == 255:
                flush()
            now = values[: 255 - len(lacing)]
            values = values[len(now) :]
            n = sum(now) if not values else 255 * len(now)
            body.append(data[at : at + n])
            lacing += now
            at += n
        granule = seen = end
        if i == 0:
            flush(last=len(packets) == 1)
    if lacing:
        flush(last=True)
    return out


def write(payload: bytes, streams: int = STREAMS, packet: int = PACKET, rate: int = RATE) -> bytes:
    """An Ogg file of the payload's samples; packet i goes to stream i mod streams."""
    logical = []
    for s in range(streams):
        head = _INTRO.pack(_MAGIC, s, streams, rate, packet)
        data = [(min(len(payload), at + packet), payload[at : at + packet]) for at in range(s * packet, len(payload), packet * streams)]
        logical.append([(g, n, s, page) for g, n, page in _stream(s + 1, [(0, head), *data])])
    # All first pages come first, then pages by time.
    first = [x for pages in logical for x in pages[:1]]
    rest = sorted((x for pages in logical for x in pages[1:]), key=lambda x: (x[0], x[2], x[1]))
    return b"".join(x[3] for x in first + rest)


def read(media: bytes) -> dict[int, dict]:
    """Serial -> {"packets": [(granule or None, data)], "pages": n} of an Ogg file.

    Raises ValueError for a wrong capture pattern, version or checksum, a page out of order, a cut
    page or packet, or a stream without end. A packet that ends on a page, but isn't the last to do
    so, has no granule position of its own: None; ``times`` derives it.
    """
    view, at, out = memoryview(media), 0, {}
    while at < len(media):
        if len(media) - at < 27:
            raise ValueError("cut page")
        magic, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(media, at)
        if magic != b"OggS" or version != 0:
            raise ValueError("no page")
        body = at + 27 + n
        lacing = media[at + 27 : body]
        end = body + sum(lacing)
        if len(lacing) < n or end > len(media):
            raise ValueError("cut page")
        if checksum(b"".join((view[at : at + 22], b"\0\0\0\0", view[at + 26 : end]))) != crc:
            raise ValueError("wrong checksum")
        s = out.setdefault(serial, {"packets": [], "pages": 0, "part": [], "ended": False})
        if number != s["pages"] or bool(flags & _FIRST) != (number == 0) or s["ended"] or bool(flags & _CONTINUED) != bool(s["part"]):
            raise ValueError("page out of order")
        s["pages"] += 1
        s["ended"] = bool(flags & _LAST)
        size, whole = 0, 0
        for value in lacing:
            size += value
            if value < 255:
                s["part"].append(view[body : body + size])
                s["packets"].append((None, b"".join(s["part"])))
                s["part"], body, size, whole = [], body + size, 0, whole + 1
        if size:
            s["part"].append(view[body : body + size])
        if whole:
            s["packets"][-1] = (granule, s["packets"][-1][1])
        elif granule != -1:
            raise ValueError("granule position of no packet")
        at = end
    if any(s.pop("part") or not s.pop("ended") for s in out.values()):
        raise ValueError("stream without end")
    return out


def times(streams: dict[int, dict]) -> dict[int, list[tuple[int, int]]]:
    """Serial -> (first sample, end) of each data packet, from granule positions and durations.

    A packet's samples are its bytes; a full packet of each other stream lies between two of a stream. The first packet of a
    stream, its header, has no time. Raises ValueError where positions contradict each other.
    """
    out = {}
    for serial, s in streams.items():
        _, number, n, _, size = _INTRO.unpack(s["packets"][0][1])
        end, spans = None, []
        for granule, data in reversed(s["packets"][1:]):
            if granule is not None:
                if end is not None and end != granule:
                    raise ValueError("granule positions don't fit the samples")
                end = granule
            if end is None:
                raise ValueError("last packet without granule position")
            spans.append((end - len(data), end))
            end -= len(data) + (n - 1) * size
        if spans and spans[-1][0] != number * size:
            raise ValueError("granule positions don't fit the samples")
        out[serial] = spans[::-1]
    return out


def payload_of(streams: dict[int, dict]) -> tuple[bytes, float]:
    """The samples of a file by ``write``, put together by their times, and how many seconds they take."""
    heads = {serial: _INTRO.unpack(s["packets"][0][1]) for serial, s in streams.items()}
    if any(h[0] != _MAGIC for h in heads.values()):
        raise ValueError("unknown stream")
    spans = times(streams)
    placed = sorted((span, data) for serial, s in streams.items() for span, (_, data) in zip(spans[serial], s["packets"][1:]))
    at = 0
    for (start, end), _ in placed:
        if start != at:
            raise ValueError("samples are missing or twice there")
        at = end
    return b"".join(data for _, data in placed), at / max(h[3] for h in heads.values())


def padded(data: bytes) -> bytes:
    """data with zero bytes up to a positive multiple of 64."""
    return data + b"\0" * (-len(data) % 64 if data else 64)


_DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double"


def _digested(batches):
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    names = [x.split()[0] for x in _DIGESTS.split(", ")]
    for b in batches:
        rows = []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
            media = write(padded(text or b""))
            streams = read(media)
            samples, seconds = payload_of(streams)
            mean = np.frombuffer(samples, np.uint8).mean()
            ends = np.array(sorted(end for spans in times(streams).values() for _, end in spans), "<u8")
            feature = f"streams={len(streams)};pages={sum(s['pages'] for s in streams.values())};packets={sum(len(s['packets']) for s in streams.values())};mean={mean:.6f};ms={round(seconds * 1000)};times={zlib.crc32(ends):08x}"
            rows.append((doc_id, len(text or b""), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, seconds))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names)


def digests(docs: DataFrame) -> DataFrame:
    """What reading each text's media column back gives; one row a row of docs (doc_id, text).

    A text's UTF-8 bytes, padded, are the samples. A null text is an empty one: 64 zero bytes. A null
    or repeated doc_id is as good as any; an empty table gives no rows. Rows don't move.
    """
    bounded_batches(docs.sparkSession, 1)
    return docs.select("doc_id", "text").mapInArrow(_digested, _DIGESTS)


def media_column(docs: DataFrame, column: str = "media") -> DataFrame:
    """docs with its text as Ogg bytes in a binary column."""
    bounded_batches(docs.sparkSession, 1)
    kept = docs.drop(column)
    names = [*kept.columns, column]

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns)), pa.array([write(padded(t or b"")) for t in texts], pa.binary())], names)

    return kept.mapInArrow(run, extended(kept, **{column: "binary"}))


def probed(media: DataFrame, key: str, column: str = "media") -> DataFrame:
    """(key, serial, pages, packets, bytes, granule, error) for each logical stream of binary column ``column``.

    A file that can't be read gives one row with the reason in error; null gives no row.
    """
    bounded_batches(media.sparkSession, 1)
    fields = extended(media.select(key), serial="long", pages="long", packets="long", bytes="long", granule="long", error="string")

    def run(batches):
        for b in batches:
            rows = []
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if data is None:
                    continue
                try:
                    for serial, s in read(data).items():
                        rows.append((k, serial, s["pages"], len(s["packets"]), sum(len(p) for _, p in s["packets"]), max((g for g, _ in s["packets"] if g is not None), default=None), None))
                except ValueError as e:
                    rows.append((k, None, None, None, None, None, str(e)))
            cols = list(zip(*rows)) if rows else [[]] * 7
            types = [b.schema.field(0).type, *[pa.int64()] * 5, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [f.name for f in fields])

    return media.select(key, column).mapInArrow(run, fields)
