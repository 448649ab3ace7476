"""MPEG audio columns: frames are resynchronised, tags and variable-bitrate tables parsed, checksums verified, and exact
durations and frame offsets stored beside the bytes.

``encode`` makes a stream that carries given bytes losslessly: MPEG-1 Layer III mono frames at 48 kHz whose granules are
empty, so the whole body after the side information is ancillary data, and that holds the payload. Frame sizes vary with
what is left (variable bitrate); an ID3v2 tag, a Xing table and an ID3v1 tag go with it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import new_path, whole_text

#: The payload's unit: bytes are padded with spaces to a positive multiple.
UNIT = 192
#: Bitrates in kbit/s by (MPEG 1 or not, layer) and index; sampling rates by version bits and index.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
VERSIONS = {3: "MPEG1", 2: "MPEG2", 0: "MPEG2.5"}

_SIDE = 17  # side information of an MPEG-1 mono frame
_OVERHEAD = 4 + 2 + _SIDE
#: Units that a frame holds, and the index of its bitrate: 3 bytes for each kbit/s at 48 kHz.
_FRAMES = {1: 6, 2: 10, 3: 12, 4: 14}


@dataclass(frozen=True)
class Frame:
    version: int
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    length: int
    samples: int
    side: int  # bytes of side information (layer III), else 0
    bits: int  # bits behind the checksum that it covers: side information, or layer I's allocation; 0 for layer II, not verified


@lru_cache(maxsize=4096)
def frame_header(head: bytes) -> Frame | None:
    """A four-byte header, or None if it can't be one. Free-format streams name no length and are not taken."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version, layer = head[1] >> 3 & 3, 4 - (head[1] >> 1 & 3)
    index, rate = head[2] >> 4, head[2] >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3 or head[3] & 3 == 2:
        return None
    kbps, hertz, pad = BITRATES[version == 3, layer][index], RATES[version][rate], head[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    length = (12000 * kbps // hertz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hertz + pad
    mono = head[3] >> 6 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if version == 3 else (9 if mono else 17)
    shared = 4 * ((head[3] >> 4 & 3) + 1) if head[3] >> 6 == 1 else 32  # subbands from here on share an allocation in joint stereo
    bits = 8 * side if layer == 3 else 4 * (32 if mono else shared + 32) if layer == 1 else 0
    return Frame(version, layer, not head[1] & 1, kbps, hertz, mono, length, samples, side, bits)


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """The frames' checksum: polynomial 0x8005, all ones at first, no reflection."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ (0x8005 if crc & 0x8000 else 0)) & 0xFFFF
    return crc


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _id3v2(fields: dict[str, str]) -> bytes:
    body = b""
    for k, v in fields.items():
        text = b"\x00" + k.encode("latin-1") + b"\x00" + v.encode("latin-1")
        body += b"TXXX" + struct.pack(">IH", len(text), 0) + text
    return b"ID3\x03\x00\x00" + _syncsafe(len(body)) + body


@lru_cache(maxsize=8)
def _frame_start(units: int) -> bytes:
    head, side = bytes((0xFF, 0xFA, _FRAMES[units] << 4 | 1 << 2, 0xC4)), bytes(_SIDE)
    return head + struct.pack(">H", crc16(head[2:] + side)) + side


def padded(data: bytes) -> bytes:
    """``data`` and spaces up to a positive multiple of UNIT bytes."""
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT)


def encode(data: bytes) -> bytes:
    """A stream whose payload is ``padded(data)``; equal data give equal streams."""
    payload = padded(data)
    frames, offsets, at, size = [], [], 0, 0
    while at < len(payload):
        units = min(4, (len(payload) - at) // UNIT)
        length = BITRATES[True, 3][_FRAMES[units]] * 3
        offsets.append(size)
        frames.append((_frame_start(units) + payload[at : at + units * UNIT]).ljust(length, b"\x00"))
        size += length
        at += units * UNIT
    first = 144  # the table's frame: 48 kbit/s, without checksum
    total = first + size
    toc = seek_points([first + x for x in offsets], 0, total)
    table = (bytes((0xFF, 0xFB, 3 << 4 | 1 << 2, 0xC4)) + bytes(_SIDE) + b"Xing" + struct.pack(">III", 7, len(frames), total) + toc).ljust(first, b"\x00")
    tag = _id3v2({"text_bytes": str(len(data)), "payload_bytes": str(len(payload)), "payload_sha256": hashlib.sha256(payload).hexdigest()})
    return tag + table + b"".join(frames) + b"TAG".ljust(127, b"\x00") + b"\xff"


@dataclass
class Stream:
    frames: list[Frame] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    id3v1: bool = False
    table: str = ""  # Xing, Info or VBRI; its frame is not among frames
    table_frames: int | None = None
    table_bytes: int | None = None
    table_at: int = 0
    toc: bytes = b""  # a Xing table's seek points: 256ths of its bytes for each hundredth of the duration
    checked: int = 0  # frames with a right checksum
    wrong: int = 0  # and with a wrong one
    unchecked: int = 0  # and with one that isn't verified (layer II)
    skipped: int = 0  # bytes that belong to no frame or tag

    @property
    def samples(self) -> int:
        return sum(f.samples for f in self.frames)

    @property
    def rate(self) -> int:
        return self.frames[0].rate if self.frames else 0

    def seek(self, sample: int) -> int:
        """Offset of the frame that holds a sample."""
        for f, at in zip(self.frames, self.offsets, strict=True):
            if sample < f.samples:
                return at
            sample -= f.samples
        raise IndexError("beyond the end")


def seek_points(offsets: list[int], first: int, total: int) -> bytes:
    """A Xing table's seek points for frames at ``offsets`` of a stream of ``total`` bytes from the table's frame at ``first``."""
    return bytes(min(255, 256 * (offsets[len(offsets) * p // 100] - first) // total) for p in range(100))


def _read_id3v2(data: bytes, out: Stream) -> int:
    """Position after an ID3v2 tag at the start; its user texts go to ``out.tags``. A tag cut short holds what there is."""
    if data[:3] != b"ID3" or len(data) < 10 or any(b & 0x80 for b in data[6:10]):
        return 0
    size = data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]
    end, at, four = min(len(data), 10 + size), 10, data[3] >= 4
    while at + 10 <= end and data[at] != 0:
        n = (data[at + 4] << 21 | data[at + 5] << 14 | data[at + 6] << 7 | data[at + 7]) if four else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 10 : min(end, at + 10 + n)]
        if data[at : at + 4] == b"TXXX" and body[:1] in (b"\x00", b"\x03"):
            k, _, v = body[1:].decode("latin-1" if body[0] == 0 else "utf-8", "replace").partition("\x00")
            out.tags[k] = v.rstrip("\x00")
        at += 10 + n
    return min(len(data), 10 + size + (10 if data[5] & 0x10 else 0))


def _read_table(data: bytes, at: int, f: Frame, out: Stream) -> bool:
    """Whether the frame at ``at`` is a variable-bitrate table; its counts go to ``out``."""
    body = at + 4 + 2 * f.protected + f.side
    for where, kinds in ((body, (b"Xing", b"Info")), (at + 4 + f.side, (b"Xing", b"Info")), (at + 36, (b"VBRI",))):
        kind = data[where : where + 4]
        if kind in kinds and where + 18 <= at + f.length:
            out.table, out.table_at = kind.decode(), at
            if kind == b"VBRI":
                out.table_bytes, out.table_frames = struct.unpack_from(">II", data, where + 10)
            else:
                flags, next_ = int.from_bytes(data[where + 4 : where + 8], "big"), where + 8
                if flags & 1:
                    out.table_frames, next_ = int.from_bytes(data[next_ : next_ + 4], "big"), next_ + 4
                if flags & 2:
                    out.table_bytes, next_ = int.from_bytes(data[next_ : next_ + 4], "big"), next_ + 4
                if flags & 4:
                    out.toc = data[next_ : min(next_ + 100, at + f.length)]
            return True
    return False


def parse(data: bytes) -> Stream:
    """Reads a stream, whatever its bytes: what is no frame or tag is skipped and counted.

    A frame is taken if its header is one, it is whole, and it is followed by the end, an ID3v1 tag or another header of the
    same version, layer and sampling rate; right after a taken frame the header alone suffices.
    """
    out = Stream()
    at = _read_id3v2(data, out)
    end = len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        out.id3v1, end = True, end - 128
    in_step = False
    while at < end:
        f = frame_header(data[at : at + 4])
        whole = f is not None and at + f.length <= end
        if whole and not in_step and at + f.length < end:
            g = frame_header(data[at + f.length : at + f.length + 4])
            whole = g is not None and (g.version, g.layer, g.rate) == (f.version, f.layer, f.rate)
        if not whole:
            in_step = False
            to = data.find(b"\xff", at + 1, end)
            to = end if to < 0 else to
            out.skipped += to - at
            at = to
            continue
        if not (not out.frames and not out.table and f.layer == 3 and _read_table(data, at, f, out)):
            out.frames.append(f)
            out.offsets.append(at)
            if f.protected and f.bits:
                right = crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + f.bits // 8]) == int.from_bytes(data[at + 4 : at + 6], "big")
                out.checked += right
                out.wrong += not right
            elif f.protected:
                out.unchecked += 1
        at, in_step = at + f.length, True
    return out


def payload_of(data: bytes, s: Stream) -> bytes:
    """The payload of a stream made by ``encode``; ValueError if frames, checksums, table or digest don't agree."""
    n = int(s.tags["payload_bytes"])
    parts, left = [], n
    for f, at in zip(s.frames, s.offsets, strict=True):
        units = min(4, left // UNIT)
        parts.append(data[at + _OVERHEAD : at + _OVERHEAD + units * UNIT])
        left -= units * UNIT
    got = b"".join(parts)
    size = len(data) - 128 - s.table_at
    table = (s.table_frames, s.table_bytes, s.toc) == (len(s.frames), size, seek_points(s.offsets, s.table_at, max(1, size)) if s.offsets else b"")
    if left or s.wrong or s.skipped or s.checked != len(s.frames) or not table or hashlib.sha256(got).hexdigest() != s.tags["payload_sha256"]:
        raise ValueError("stored stream is damaged")
    return got


def write_media(docs: DataFrame, path: str) -> None:
    """Writes (doc_id, media, n_frames, samples, rate, seek) as Parquet: the stream of each row's whole text, its exact
    duration in samples, and the offset of every frame. Null texts are empty; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = [encode(t.encode("utf-8", "surrogatepass")) for t in b.column(1).to_pylist()]
            read = list(map(parse, media))
            columns = [pa.array(media, pa.binary()), *(pa.array(x, pa.int64()) for x in ([len(s.frames) for s in read], [s.samples for s in read], [s.rate for s in read])), pa.array([s.offsets for s in read], pa.list_(pa.int64()))]
            yield pa.record_batch([b.column(0), *columns], names=["doc_id", "media", "n_frames", "samples", "rate", "seek"])

    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    rows.mapInArrow(run, MEDIA).write.option("compression", "zstd").parquet(path)


MEDIA = "doc_id long, media binary, n_frames long, samples long, rate long, seek array<long>"


def read_media(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MEDIA).parquet(path)


def features(media: DataFrame) -> DataFrame:
    """Parses stored streams again and returns what they hold, one row for each; a stream that doesn't hold what its columns
    and tags say raises ValueError."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc_id, cell, n, samples, rate, seek in zip(b.column(0).to_pylist(), b.column(1), *(b.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                data = cell.as_py()
                s = parse(data)
                payload = payload_of(data, s)
                if (n, samples, rate, seek) != (len(s.frames), s.samples, s.rate, s.offsets):
                    raise ValueError("stored offsets or durations are wrong")
                f = s.frames[0]
                seeks = zlib.crc32(struct.pack(f"<{len(seek)}q", *seek))
                said = f"{VERSIONS[f.version]} layer {f.layer}, {rate} Hz {'mono' if f.mono else 'stereo'}, {s.table} table, {n} frames, {samples}/{rate} s, {s.checked} checksums, seek {seeks:08x}"
                out.append((doc_id, int(s.tags["text_bytes"]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), said, n, samples))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration_samples long"
    names = [x.split()[0] for x in schema.split(", ")]
    return media.mapInArrow(run, schema)


def stored(docs: DataFrame) -> DataFrame:
    """Stores every row's text as a stream in the shared folder, reads the bytes back and describes them.

    Null texts are empty ones, of one unit of spaces; null ids stay null. Repeated rows come out as often as they come in, with
    equal values; an empty table gives no rows; other columns, whatever their names, are not read. A very long text is one
    stream and costs memory by its length."""
    path = new_path(docs.sparkSession, "media")
    write_media(docs, path)
    return features(read_media(docs.sparkSession, path))
