"""Media columns holding MPEG audio.

``encode`` stores bytes losslessly in an MPEG-1 Layer III stream: protected mono frames at 48 kHz whose side
information is silent and whose ancillary data carry the payload, behind an ID3v2 tag that states the payload's length
and a frame with a variable-bitrate table. ``parse`` reads any MPEG audio: it skips and reads tags, finds frame
headers again after damage, reads variable-bitrate tables, verifies frame checksums, and gives the exact duration and
every frame's offset.

Defined results: a null text or payload counts as empty; bytes without any frame give zero frames and duration 0; a
frame that the data's end cuts off is not counted but reported as ``truncated``; free-format frames are passed over as
damage; tables and tags that state more than there is are read as far as they go; foreign bytes have an empty payload;
repeated rows are stored alike; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spanforge.llm.common import documents, through_python

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by bitrate index, Hz by sampling index.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
# Layer II: subbands with 4, 3 and 2 bits of allocation, by table.
LAYER2_BITS = {"a": (11, 12, 4), "b": (11, 12, 7), "c": (2, 6, 0), "d": (2, 10, 0), "lsf": (4, 7, 19)}

UNIT = 64
#: A batch of stored media ends beyond this size.
BATCH_BYTES = 1 << 26
_CRC = []
for _i in range(256):
    _c = _i << 8
    for _ in range(8):
        _c = ((_c << 1) ^ 0x8005 if _c & 0x8000 else _c << 1) & 0xFFFF
    _CRC.append(_c)


def crc16(data: bytes, crc: int = 0xFFFF, bits: int | None = None) -> int:
    """The frames' checksum, over the first so many bits."""
    whole, rest = divmod(len(data) * 8 if bits is None else bits, 8)
    for b in data[:whole]:
        crc = (crc << 8 & 0xFFFF) ^ _CRC[crc >> 8 ^ b]
    for i in range(rest):
        one = (data[whole] >> (7 - i) & 1) ^ (crc >> 15)
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if one else 0)
    return crc


@dataclass(frozen=True)
class Header:
    version: int  # 1, 2; 2.5 counts as 2 but for its rates
    layer: int
    protected: bool
    kbps: int
    rate: int
    channels: int
    mode: int
    extension: int
    size: int
    samples: int

    @property
    def side_bytes(self) -> int:
        return (17 if self.channels == 1 else 32) if self.version == 1 else (9 if self.channels == 1 else 17)


@lru_cache(65536)
def header(word: int) -> Header | None:
    """A frame header from its 32 bits, or None."""
    kind, layer = word >> 19 & 3, 4 - (word >> 17 & 3)
    index, rate = word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or kind == 1 or layer == 4 or index in (0, 15) or rate == 3 or word & 3 == 2:
        return None
    version = 1 if kind == 3 else 2
    kbps, hz, pad = BITRATES[version, layer][index], RATES[kind][rate], word >> 9 & 1
    mode = word >> 6 & 3
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    size = (12000 * kbps // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + pad
    return Header(version, layer, not word >> 16 & 1, kbps, hz, 1 if mode == 3 else 2, mode, word >> 4 & 3, size, samples)


def checked_bits(h: Header, data: bytes, at: int) -> int:
    """How many bits after the checksum it covers."""
    if h.layer == 3:
        return h.side_bytes * 8
    bound = (h.extension + 1) * 4 if h.mode == 1 else 32
    if h.layer == 1:
        return 4 * (h.channels * bound + 32 - bound)
    each = h.kbps // h.channels
    if h.version == 2:
        kind = "lsf"
    elif each <= 48:
        kind = "d" if h.rate == 32000 else "c"
    else:
        kind = "a" if h.rate == 48000 or each <= 80 else "b"
    widths = [n for n, many in zip((4, 3, 2), LAYER2_BITS[kind], strict=True) for _ in range(many)]
    value, length = int.from_bytes(data[at : at + 64].ljust(64, b"\0"), "big"), 512
    used = chosen = 0
    for sub, width in enumerate(widths):
        for _ in range(h.channels if sub < bound else 1):
            used += width
            if value >> (length - used) & ((1 << width) - 1):
                chosen += 1 if sub < bound else h.channels
    return used + 2 * chosen


@dataclass
class Stream:
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    samples: dict[int, int] = field(default_factory=dict)
    tags: dict[str, str] = field(default_factory=dict)
    table: dict | None = None
    crc_good: int = 0
    crc_bad: int = 0
    skipped: int = 0
    resyncs: int = 0
    truncated: int = 0
    kbps: set[int] = field(default_factory=set)

    @property
    def seconds(self) -> Fraction:
        return sum((Fraction(n, hz) for hz, n in self.samples.items()), Fraction(0))


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _text(b: bytes) -> str:
    kind, body = (b[0], b[1:]) if b else (0, b"")
    return body.decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(kind, "latin-1"), "replace").rstrip("\0")


def _id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Where the tag ends."""
    major, flags, size = data[at + 3], data[at + 5], _synchsafe(data[at + 6 : at + 10])
    body, end = data[at + 10 : at + 10 + size], min(len(data), at + 10 + size + (10 if flags & 16 else 0))
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\0", b"\xff")
    pos = 0
    if flags & 0x40 and len(body) >= 4:
        pos = _synchsafe(body) if major == 4 else int.from_bytes(body[:4], "big") + 4
    width, name = (6, 3) if major == 2 else (10, 4)
    while pos + width <= len(body) and body[pos]:
        key = body[pos : pos + name].decode("latin-1")
        raw = body[pos + name : pos + name + (3 if major == 2 else 4)]
        n = _synchsafe(raw) if major == 4 else int.from_bytes(raw, "big")
        value = body[pos + width : pos + width + n]
        if key in ("TXXX", "TXX"):
            label, _, rest = _text(value).partition("\0")
            tags[f"id3v2.{label}"] = rest
        elif key.startswith("T"):
            tags[f"id3v2.{key}"] = _text(value)
        pos += width + max(n, 0)
    return end


def _tail_tags(data: bytes, tags: dict[str, str]) -> int:
    """Where the audio ends: before an ID3v1 tag and an APE tag."""
    end = len(data)
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for key, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if value := data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                tags[f"id3v1.{key}"] = value
    if end >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, count, flags = struct.unpack("<III", data[end - 20 : end - 8])
        start, pos = end - size, end - size
        for _ in range(count):
            if pos < 0 or pos + 8 > end - 32:
                break
            n = int.from_bytes(data[pos : pos + 4], "little")
            key, _, _ = data[pos + 8 : end].partition(b"\0")
            pos += 9 + len(key)
            tags[f"ape.{key.decode('latin-1').lower()}"] = data[pos : pos + n].decode("utf-8", "replace")
            pos += n
        end = max(0, start - (32 if flags & 1 << 31 else 0))
    return end


def _vbr_table(h: Header, data: bytes, at: int) -> dict | None:
    body = at + 4 + (2 if h.protected else 0) + h.side_bytes
    for pos in dict.fromkeys((body, at + 4 + h.side_bytes)):
        if data[pos : pos + 4] in (b"Xing", b"Info"):
            out, flags = {"kind": data[pos : pos + 4].decode("ascii")}, int.from_bytes(data[pos + 4 : pos + 8], "big")
            pos += 8
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name] = int.from_bytes(data[pos : pos + 4], "big")
                    pos += 4
            if flags & 4:
                out["seek"] = list(data[pos : pos + 100])
            return out
    pos = at + 36
    frame_end = at + h.size
    if data[pos : pos + 4] == b"VBRI" and pos + 26 <= frame_end:
        size, frames, entries, scale, width, per = struct.unpack(">IIHHHH", data[pos + 10 : pos + 26])
        seek = [int.from_bytes(data[i : i + width], "big") * scale for i in range(pos + 26, min(pos + 26 + entries * width, frame_end - width + 1), width or 1)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "seek": seek, "frames_per_entry": per}
    return None


def parse(data: bytes) -> Stream:
    out, pos = Stream(), 0
    end = _tail_tags(data, out.tags)
    synced, lost, last = False, False, None
    while pos + 4 <= end:
        if not synced and data[pos : pos + 3] == b"ID3" and pos + 10 <= end:
            pos = _id3v2(data, pos, out.tags)
            continue
        h = header(int.from_bytes(data[pos : pos + 4], "big"))
        if h is not None and not synced:  # a header counts only if another follows it, or the data end there
            after = pos + h.size
            next_ = header(int.from_bytes(data[after : after + 4], "big")) if after + 4 <= end else None
            if after != end and (next_ is None or (next_.version, next_.layer, next_.rate) != (h.version, h.layer, h.rate)):
                h = None
        elif h is not None and (h.version, h.layer, h.rate) != last:
            h = None
        if h is None:
            synced = False
            step = data.find(b"\xff", pos + 1, end)
            id3 = data.find(b"ID3", pos + 1, end) if not out.offsets else -1
            step = min((x for x in (step, id3) if x >= 0), default=end)
            out.skipped, lost, pos = out.skipped + step - pos, True, step
            continue
        if pos + h.size > end:
            out.truncated = end - pos
            break
        out.resyncs += lost and bool(out.offsets)
        synced, lost, last = True, False, (h.version, h.layer, h.rate)
        first = not out.offsets and out.table is None and h.layer == 3
        if h.protected:
            bits = checked_bits(h, data, pos + 6)
            want = int.from_bytes(data[pos + 4 : pos + 6], "big")
            good = _frame_crc(data[pos + 2 : pos + 4], data[pos + 6 : pos + 6 + (bits + 7) // 8], bits) == want
            out.crc_good, out.crc_bad = out.crc_good + good, out.crc_bad + (not good)
        if first and (table := _vbr_table(h, data, pos)):
            out.table = table | {"offset": pos}
        else:
            out.offsets.append(pos)
            out.sizes.append(h.size)
            out.kbps.add(h.kbps)
            out.samples[h.rate] = out.samples.get(h.rate, 0) + h.samples
        pos += h.size
    out.skipped += max(0, end - pos) if not out.truncated and pos < end else 0
    return out


@lru_cache(4096)
def _frame_crc(head: bytes, body: bytes, bits: int) -> int:
    return crc16(body, crc16(head), bits)


_STATED = re.compile("([0-9]{1,18}):[0-9]{1,18}")
# What encode() writes: MPEG-1 Layer III, protected, mono, 48 kHz.
_RATE, _SIDE, _START = 48000, 17, 4 + 2 + 17
_SIZES = [(i, BITRATES[1, 3][i] * 144 // 48) for i in range(1, 15)]


@lru_cache(16)
def _frame_start(index: int) -> bytes:
    head = struct.pack(">I", 0x7FF << 21 | 3 << 19 | 1 << 17 | index << 12 | 1 << 10 | 3 << 6)
    return head + struct.pack(">H", crc16(b"\0" * _SIDE, crc16(head[2:]))) + b"\0" * _SIDE


def _frame(index: int, size: int, body: bytes) -> bytes:
    return _frame_start(index) + body.ljust(size - _START, b"\0")


def encode(payload: bytes, text_bytes: int) -> bytes:
    """payload in an MPEG audio stream; equal payloads give equal streams."""
    most, full = _SIZES[-1]
    room, frames = full - _START, []
    for at in range(0, len(payload), room):
        body = payload[at : at + room]
        index, size = (most, full) if len(body) == room else next(x for x in _SIZES if x[1] - _START >= len(body))
        frames.append(_frame(index, size, body))
    label = f"\3payload\0{len(payload)}:{text_bytes}".encode()
    safe = lambda n: bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))
    tag = b"ID3\4\0\0" + safe(len(label) + 10) + b"TXXX" + safe(len(label)) + b"\0\0" + label
    sizes = [len(f) for f in frames]
    total, starts, at = sum(sizes) + 192, [], 192
    for n in sizes:
        starts.append(at)
        at += n
    seek = bytes(min(255, starts[i * len(starts) // 100] * 256 // total) for i in range(100))
    table = b"Xing" + struct.pack(">III", 7, len(frames), total) + seek
    index, size = next(x for x in _SIZES if x[1] == 192)
    return b"".join((tag, _frame(index, size, table), *frames))


def decode(media: bytes, stream: Stream | None = None) -> bytes:
    """The payload that encode() stored; nothing where the media have no such tag."""
    stream = parse(media) if stream is None else stream
    stated = _STATED.fullmatch(stream.tags.get("id3v2.payload", ""))
    if stated is None:
        return b""
    length = int(stated[1])
    return b"".join(media[o + _START : o + n] for o, n in zip(stream.offsets, stream.sizes, strict=True))[:length]


def _describe(stream: Stream) -> str:
    seek = zlib.crc32(struct.pack(f"<{len(stream.offsets)}q", *stream.offsets))
    table = stream.table or {}
    return (
        f"frames={len(stream.offsets)};duration={stream.seconds.numerator}/{stream.seconds.denominator};table={table.get('kind', '-')}:{table.get('frames', 0)}:{table.get('bytes', 0)}"
        f";crc={stream.crc_good}/{stream.crc_good + stream.crc_bad};kbps={','.join(map(str, sorted(stream.kbps)))};skipped={stream.skipped};resyncs={stream.resyncs};first={stream.offsets[0] if stream.offsets else -1};seek_crc32={seek}"
    )


def store_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8, padded with zero bytes to a positive multiple of 64, as MPEG audio."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, texts, at = batch.column(0), batch.column(1).cast(pa.large_binary()), 0
            while at < len(texts):
                sizes, media, held = [], [], 0
                while at + len(sizes) < len(texts) and len(sizes) < 256 and held < BATCH_BYTES:  # rows of long texts go few at a time
                    t = texts[at + len(sizes)].as_py() or b""
                    media.append(encode(t + b"\0" * (-len(t) % UNIT if t else UNIT), len(t)))
                    sizes.append(len(t))
                    held += len(media[-1])
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(sizes)), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
                at += len(sizes)

    kind = docs.schema[id_col].dataType.simpleString()
    return through_python(docs.select(id_col, text_col), batches, f"doc_id {kind}, n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """stored with what parsing the media gives: payload digests, exact duration, frame seek offsets, a feature line."""
    added = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_s double, seek_offsets array<long>"

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            media, rows = batch.column(2), []
            for m in media:
                m = m.as_py() or b""
                stream = parse(m)
                payload = decode(m, stream)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), _describe(stream), float(stream.seconds), stream.offsets))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64())]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
            names = [x.split()[0] for x in added.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", *names])

    return through_python(stored, batches, f"doc_id {stored.schema['doc_id'].dataType.simpleString()}, n_bytes long, {added}")


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_media(store_text(documents(spark, sf_dir)))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_s", "seek_offsets")
