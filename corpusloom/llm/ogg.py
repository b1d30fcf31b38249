"""Media columns in an Ogg container.

``mux`` writes two logical streams: the samples (8-bit, packets of 576) and an index whose one packet carries the
unpadded length. ``demux`` takes any Ogg bytes: it finds pages, verifies each checksum, sorts pages by serial number,
puts packets together from the lacing values (over page ends too) and derives each packet's time from the granule
positions. A page with a wrong checksum, a gap in the page numbers or an open last packet raises ``ValueError``.

Null text counts as empty. An empty text has one packet of padding, so every row has media.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 576
RATE = 8000
SAMPLES, INDEX = 0x53414D50, 0x494E4458
FIRST, LAST, CONTINUED = 2, 4, 1
NONE = 0xFFFFFFFFFFFFFFFF
_HEAD = struct.Struct("<4sBBQIIIB")
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC (polynomial 0x04c11db7, most significant bit first, start 0), as the mirrored CRC of mirrored bytes."""
    low = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{low:032b}"[::-1], 2)


def _page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", checksum(head + body)) + head[26:] + body


def _lacing(n: int) -> bytes:
    return b"\xff" * (n // 255) + bytes([n % 255])


def mux(payload: bytes, n_bytes: int, unit: int = UNIT, rate: int = RATE) -> bytes:
    """``payload`` (a multiple of ``unit`` bytes) as an Ogg file with as many packets in a page as its lacing table holds."""
    head, index = struct.pack("<8sII", b"PCM8\0\0\0\1", rate, unit), struct.pack("<QQ", n_bytes, len(payload))
    out = [_page(FIRST, 0, SAMPLES, 0, _lacing(len(head)), head), _page(FIRST, 0, INDEX, 0, _lacing(8), b"INDEX\0\0\1"), _page(LAST, 0, INDEX, 1, _lacing(len(index)), index)]
    one = _lacing(unit)
    step = unit * (255 // len(one))
    for k, at in enumerate(range(0, len(payload), step), 1):
        body = payload[at : at + step]
        end = at + len(body)
        out.append(_page(LAST if end == len(payload) else 0, end, SAMPLES, k, one * (len(body) // unit), body))
    return b"".join(out)


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # of the page in which a packet ends; NONE for all but the page's last
    number: int = -1
    rest: bytes = b""
    open: bool = False
    ended: bool = False


def demux(media: bytes) -> dict[int, Stream]:
    streams: dict[int, Stream] = {}
    at, view = 0, memoryview(media)
    while at < len(media):
        if media[at : at + 4] != b"OggS" or len(media) < at + 27:
            raise ValueError(f"no page at byte {at}")
        _, version, kind, granule, serial, number, crc, n = _HEAD.unpack_from(media, at)
        lacing = np.frombuffer(view[at + 27 : at + 27 + n], np.uint8)
        begin, size = at + 27 + n, int(lacing.sum(dtype=np.int64))
        end = begin + size
        if version or len(lacing) < n or end > len(media):
            raise ValueError(f"page at byte {at} is cut off or of another version")
        if checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError(f"checksum of the page at byte {at}")
        s = streams.get(serial)
        if s is None:
            if not kind & FIRST:
                raise ValueError(f"stream {serial:#x} does not begin with its first page")
            s = streams[serial] = Stream()
        if number != s.number + 1 or bool(kind & CONTINUED) != s.open or s.ended:
            raise ValueError(f"page {number} of stream {serial:#x} does not follow page {s.number}")
        s.number, s.ended = number, bool(kind & LAST)
        closes = np.flatnonzero(lacing < 255)  # a packet ends with the first value below 255
        stops = begin + np.cumsum(lacing, dtype=np.int64)[closes]
        start = begin
        for stop in stops.tolist():
            s.packets.append(s.rest + media[start:stop] if s.open else media[start:stop])
            s.granules.append(NONE)
            s.rest, s.open, start = b"", False, stop
        if len(stops):
            s.granules[-1] = granule
        if n and lacing[-1] == 255:
            s.rest, s.open = s.rest + media[start:end], True
        at = end
    if any(s.open or not s.ended for s in streams.values()):
        raise ValueError("a stream has no end")
    return streams


def packet_ends(packets: list[bytes], granules: list[int]) -> np.ndarray:
    """The sample at which each packet ends: the granule position of the page that its page's last packet ends in, less the
    samples of the packets between. A stream whose last packet has no granule raises ``ValueError``."""
    known = np.array([i for i, g in enumerate(granules) if g != NONE], np.int64)
    if len(packets) and (not len(known) or known[-1] != len(packets) - 1):
        raise ValueError("packets without a granule position")
    done = np.cumsum([len(p) for p in packets], dtype=np.int64)
    page = known[np.searchsorted(known, np.arange(len(packets)))] if len(packets) else known
    return np.array([granules[k] for k in page], np.int64) - (done[page] - done) if len(packets) else done


def read(media: bytes) -> tuple[bytes, int, list[float]]:
    """The sample payload, its unpadded length and the start of each packet in seconds, from the granule positions; these must leave no gap."""
    streams = demux(media)
    packets, granules = streams[SAMPLES].packets, streams[SAMPLES].granules
    _, rate, _ = struct.unpack("<8sII", packets[0])
    n_bytes, total = struct.unpack("<QQ", streams[INDEX].packets[1])
    ends = packet_ends(packets[1:], granules[1:])
    starts = ends - np.array([len(p) for p in packets[1:]], np.int64)
    if total != (ends[-1] if len(ends) else 0) or (starts != np.concatenate([[0], ends[:-1]])[: len(starts)]).any():
        raise ValueError("granule positions or the index differ from the samples")
    return b"".join(packets[1:]), n_bytes, (starts / rate).tolist()


def pad(text: str | None, unit: int = UNIT) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b"\xff" * (max(unit, -(-len(raw) // unit) * unit) - len(raw)), len(raw)


def feature(payload: bytes, times: list[float], rate: int = RATE) -> str:
    """Length, number of packets, start of the last one, and mean, root mean square and sign changes of the centred samples."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    values = np.arange(256) - 128
    mean, power = int((counts * values).sum()) / len(x), int((counts * values**2).sum()) / len(x)
    high = x >= 128
    return f"sec={len(x) / rate:.4f};packets={len(times)};last={times[-1]:.4f};mean={mean:.4f};rms={power**0.5:.4f};zc={int((high[1:] != high[:-1]).sum())}"


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, media binary)``: each whole text, padded, as an Ogg file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([mux(*pad(t.as_py())) for t in part.column(1)], pa.binary())], [id_col, "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"{id_col} {kind}, media binary")


def inspect(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests and features of ``(id, media)``, all from the bytes read back."""
    kind = stored.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column(1):
                m = m.as_py()
                x, n, times = read(m)
                rows.append((n, len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(x, times)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.select(id_col, "media").mapInArrow(run, schema)
