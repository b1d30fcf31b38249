import hashlib
import zlib

import pytest

from corpusloom.llm import ogg


def crc_by_bits(data: bytes) -> int:
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


def test_checksum():
    for x in (b"", b"a", bytes(range(256)) * 3):
        assert ogg.checksum(x) == crc_by_bits(x)


def test_round_trip(spark):
    texts = [None, "", "a", "x" * 576, "y" * 577, "ßñ" * 50_000, "a"]
    df = spark.createDataFrame([(i, t, b"clash") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    rows = {r.doc_id: r for r in ogg.inspect(ogg.media(df)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        m = ogg.mux(want, len(raw))
        assert (r.media_bytes, r.media_sha256) == (len(m), hashlib.sha256(m).hexdigest())
    assert rows[2][1:] == rows[6][1:]


def test_damage_and_laced_packets():
    m = ogg.mux(*ogg.pad("hello " * 20_000))
    for at in (30, 100, len(m) - 1):
        with pytest.raises(ValueError):
            ogg.demux(m[:at] + bytes([m[at] ^ 1]) + m[at + 1 :])
    with pytest.raises(ValueError):
        ogg.demux(m[:-5])
    big = b"z" * 700  # one packet over two pages, and one of exactly 255 bytes
    pages = [ogg._page(ogg.FIRST, 0, 7, 0, b"\x01", b"h"), ogg._page(0, ogg.NONE, 7, 1, b"\xff\xff", big[:510]), ogg._page(ogg.CONTINUED | ogg.LAST, 9, 7, 2, b"\xbe\xff\x00", big[510:] + b"q" * 255)]
    s = ogg.demux(b"".join(pages))[7]
    assert s.packets == [b"h", big, b"q" * 255] and s.granules[-1] == 9


def test_times_come_from_granules():
    packets = [b"x" * n for n in (10, 20, 5, 7)]
    assert ogg.packet_ends(packets, [ogg.NONE, 130, ogg.NONE, 142]).tolist() == [110, 130, 135, 142]  # a stream that begins at 100
    assert ogg.packet_ends(packets, [10, 40, 45, 52]).tolist() == [10, 40, 45, 52]  # and one with a gap
    assert ogg.packet_ends([], []).tolist() == []
    with pytest.raises(ValueError):
        ogg.packet_ends(packets, [10, 30, 35, ogg.NONE])
    m = ogg.mux(*ogg.pad("a" * 576 * 200))
    x, n, times = ogg.read(m)
    assert n == len(x) == 576 * 200 and times == [576 * k / 8000 for k in range(200)]
    pages = ogg.demux(m)[ogg.SAMPLES]
    assert 1 < sum(g != ogg.NONE for g in pages.granules) < 10
    one = ogg._lacing(576)
    head = m[: m.index(b"OggS", m.index(b"OggS", m.index(b"OggS", 1) + 1) + 1)]
    late = head + ogg._page(ogg.LAST, 1000, ogg.SAMPLES, 1, one, b"a" * 576)
    with pytest.raises(ValueError):
        ogg.read(late)
