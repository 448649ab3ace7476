import hashlib
import random
import zlib

import pytest

from tessera.llm import media_audio as m


@pytest.mark.parametrize("size", [0, 1, 191, 192, 193, 767, 768, 769, 5000, 100_000])
def test_round_trip(size):
    data = random.Random(size).randbytes(size)
    stream = m.encode(data)
    s = m.parse(stream)
    assert m.payload_of(stream, s) == data.ljust(max(192, -(-size // 192) * 192))
    assert s.tags["text_bytes"] == str(size) and s.id3v1 and s.table == "Xing" and s.skipped == s.wrong == 0
    assert s.table_frames == len(s.frames) == s.checked and s.samples == 1152 * len(s.frames)
    assert s.table_bytes == len(stream) - 128 - (10 + int.from_bytes(bytes([0]) + stream[7:10], "big") if stream[7] == 0 and stream[8] == 0 else stream[8] * 128 + stream[9] + 10)
    assert all(stream[a : a + 2] == b"\xff\xfa" for a in s.offsets) and m.encode(data) == stream


def test_known_headers():
    f = m.frame_header(bytes.fromhex("fffb9064"))
    assert (f.version, f.layer, f.kbps, f.rate, f.length, f.samples, f.mono, f.protected) == (3, 3, 128, 44100, 417, 1152, False, False)
    f = m.frame_header(bytes.fromhex("fff384c4"))
    assert (f.version, f.layer, f.kbps, f.rate, f.length, f.samples, f.mono) == (2, 3, 64, 24000, 192, 576, True)
    f = m.frame_header(bytes.fromhex("ffff1004"))
    assert (f.layer, f.kbps, f.rate, f.length, f.samples) == (1, 32, 44100, 32, 384)
    assert m.frame_header(b"\xff\xfb\xf0\x64") is m.frame_header(b"\xff\xfb\x00\x64") is m.frame_header(b"\xff\xeb\x90\x64") is m.frame_header(b"\xff") is None
    assert m.crc16(b"123456789") == 0xAEE7


def test_table_and_seek_points_are_verified():
    data = bytes(range(256)) * 40
    stream = m.encode(data)
    s = m.parse(stream)
    assert len(s.toc) == 100 and s.toc[0] == 256 * 144 // s.table_bytes and list(s.toc) == sorted(s.toc)
    assert s.seek(0) == s.offsets[0] and s.seek(1152 * 3 + 5) == s.offsets[3]
    with pytest.raises(IndexError):
        s.seek(s.samples)
    body = s.table_at + 4 + 17
    for at in (body + 8 + 3, body + 12 + 3, body + 16 + 50):  # frames, bytes, a seek point
        bad = stream[:at] + bytes([stream[at] ^ 1]) + stream[at + 1 :]
        with pytest.raises(ValueError, match="damaged"):
            m.payload_of(bad, m.parse(bad))


def test_checksums_of_layer_one():
    head = bytes((0xFF, 0xFE, 0x14, 0xC4))  # MPEG-1 layer I, 32 kbit/s, 48 kHz, mono, with checksum
    f = m.frame_header(head)
    assert (f.layer, f.length, f.bits, f.protected) == (1, 32, 128, True)
    alloc = bytes(range(16))
    frame = (head + m.crc16(head[2:] + alloc).to_bytes(2, "big") + alloc).ljust(32, b"\x00")
    wrong = frame[:8] + bytes([frame[8] ^ 1]) + frame[9:]
    s = m.parse(frame + wrong + frame)
    assert (len(s.frames), s.checked, s.wrong) == (3, 2, 1)
    joint = m.frame_header(bytes((0xFF, 0xFE, 0x14, 0x54)))
    assert joint.bits == 4 * (8 + 32) and m.frame_header(bytes((0xFF, 0xFE, 0x14, 0x04))).bits == 256
    two = m.parse(bytes((0xFF, 0xFC, 0x14, 0xC4)).ljust(96, b"\x00"))
    assert len(two.frames) == 1 and two.unchecked == 1


def test_resynchronises_after_junk_and_counts_damage():
    data = bytes(range(256)) * 20
    stream = m.encode(data)
    s = m.parse(stream)
    a, b = s.offsets[2], s.offsets[3]
    junk = b"junk \xff\xfa\x90 junk"
    cut = m.parse(stream[:a] + junk + stream[a:])
    assert len(cut.frames) == len(s.frames) and cut.skipped == len(junk)
    lost = m.parse(stream[: a + 1] + stream[b:])
    assert len(lost.frames) == len(s.frames) - 1 and lost.skipped == 1
    bad = m.parse(stream[: a + 4] + b"\x12\x34" + stream[a + 6 :])
    assert bad.wrong == 1 and bad.checked == len(s.frames) - 1
    with pytest.raises(ValueError, match="damaged"):
        m.payload_of(stream[: a + 4] + b"\x12\x34" + stream[a + 6 :], bad)
    flipped = stream[: a + 100] + bytes([stream[a + 100] ^ 1]) + stream[a + 101 :]
    with pytest.raises(ValueError, match="damaged"):
        m.payload_of(flipped, m.parse(flipped))
    for odd in (b"", b"\xff", b"ID3", b"ID3\x04\x00\x00\x7f\x7f\x7f\x7f", b"\xff" * 500, b"TAG" + bytes(125), stream[:50]):
        m.parse(odd)


def test_rows(spark):
    texts = [None, "", "é" * 500, "é" * 500, "a" * 300_000]
    docs = spark.createDataFrame([(None if i == 4 else i // 2, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = m.stored(docs).collect()
    assert len(got) == 5
    want = []
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        stream = m.encode(raw)
        want.append((None if i == 4 else i // 2, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(stream), hashlib.sha256(stream).hexdigest()))
    assert sorted((tuple(r)[:7] for r in got), key=repr) == sorted(want, key=repr)
    assert len({r.feature for r in got}) == 3
    assert m.stored(docs.limit(0)).collect() == []
