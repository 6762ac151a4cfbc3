"""MPEG audio as a media column: frames, tags and variable-bitrate tables, written and read.

A payload is stored losslessly as MPEG-1 Layer III at 48 kHz, mono: frames whose side information says that
they hold no coded samples (silence), with the payload as their ancillary bytes. Before them stand an ID3v2
tag, which holds the payload's size, and a frame with the table of a variable bitrate. The reader takes any
MPEG audio: it finds frame headers again after damage, verifies checksums, and gives exact durations and the
offset of every frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm.common import lean, tuned

#: Payloads are filled up with FILL to a positive multiple of UNIT bytes.
UNIT, FILL = 192, b" "

# Fixed values of the format: bitrates (kbit/s) by index, sampling rates (Hz) by index, samples in a frame.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}
SIDE = {(1, True): 17, (1, False): 32, (2, True): 9, (2, False): 17}


@dataclass(frozen=True)
class Header:
    """What the four bytes of a frame header say."""

    version: float
    layer: int
    protected: bool
    kbps: int
    rate: int
    mode: int
    extension: int
    pad: int
    size: int
    samples: int

    @property
    def mono(self) -> bool:
        return self.mode == 3

    @property
    def free(self) -> bool:
        """Whether the bitrate is not said: all frames have the size that the first one shows."""
        return self.kbps == 0

    def like(self, other: Header) -> bool:
        """Whether both can be headers of one stream."""
        return (self.version, self.layer, self.rate, self.free) == (other.version, other.layer, other.rate, other.free)

    @property
    def side(self) -> int:
        """Bytes of side information of a Layer III frame."""
        return SIDE[(1 if self.version == 1 else 2, self.mono)]


@lru_cache(maxsize=4096)
def header(word: bytes) -> Header | None:
    """Reads a frame header; None if these four bytes are none."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(word[1] >> 3 & 3)
    layer = 4 - (word[1] >> 1 & 3)
    rate_at, kbps_at = word[2] >> 2 & 3, word[2] >> 4
    if version is None or layer == 4 or rate_at == 3 or kbps_at == 15:
        return None
    family = 1 if version == 1 else 2
    kbps, rate, samples, pad = BITRATES[family, layer][kbps_at], RATES[version][rate_at], SAMPLES[family, layer], word[2] >> 1 & 1
    size = (12000 * kbps // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // rate + pad
    return Header(version, layer, not word[1] & 1, kbps, rate, word[3] >> 6, word[3] >> 4 & 3, pad * (4 if layer == 1 else 1), 0 if kbps_at == 0 else size, samples)


@lru_cache(maxsize=8192)
def checksum(data: bytes) -> int:
    """CRC-16 with the polynomial 0x8005 from 0xFFFF, high bits first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def _bits_of_allocation(h: Header) -> list[int]:
    """Layer II: the width of a subband's allocation, for each subband that the header's bitrate and rate allow."""
    if h.version != 1:
        return [4] * 4 + [3] * 7 + [2] * 19
    each = h.kbps // (1 if h.mono else 2)
    if each <= 48 and not h.free:
        return [4] * 2 + [3] * (10 if h.rate == 32000 else 6)
    few = h.rate == 48000 and not h.free or 56 <= each <= 80
    return [4] * 11 + [3] * 12 + [2] * (4 if few else 7)


def protected_bits(data: bytes, h: Header, at: int) -> int:
    """How many bits after a frame's checksum it covers: side information of Layer III, allocations of the others."""
    channels = 1 if h.mono else 2
    if h.layer == 3:
        return 8 * h.side
    bound = 4 * (h.extension + 1) if h.mode == 1 else 32  # from here on both channels share an allocation
    if h.layer == 1:
        return 4 * (32 if h.mono else 32 + min(bound, 32))
    body = data[at + 6 : at + 6 + 64]
    bits, where, used = int.from_bytes(body, "big"), 0, 0
    for band, width in enumerate(_bits_of_allocation(h)):
        for _ in range(1 if band >= bound else channels):
            value = bits >> max(0, 8 * len(body) - where - width) & (1 << width) - 1
            where += width
            used += bool(value) * (channels if band >= bound else 1)
    return where + 2 * used  # and two bits of each subband that holds samples


def _sum_of_bits(data: bytes, at: int, n: int) -> int:
    """The checksum of a header's last two bytes and n bits after it."""
    crc = checksum(data[at + 2 : at + 4] + data[at + 6 : at + 6 + n // 8])
    for i in range(n % 8):
        bit = data[at + 6 + n // 8] >> 7 - i & 1
        crc = ((crc << 1) ^ (0x8005 if (crc >> 15 & 1) ^ bit else 0)) & 0xFFFF
    return crc


@dataclass
class Audio:
    """What a reader finds in the bytes of an MPEG audio file."""

    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict[str, object] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    crc_good: int = 0
    crc_bad: int = 0
    skipped: int = 0

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)

    @property
    def duration(self) -> Fraction:
        """Seconds, exact."""
        return sum((Fraction(h.samples, h.rate) for h in self.headers), Fraction(0))

    def seek(self, second: Fraction | float) -> int:
        """The offset of the frame that plays at this time; the last one beyond the end."""
        at = Fraction(0)
        for offset, h in zip(self.offsets, self.headers, strict=True):
            at += Fraction(h.samples, h.rate)
            if second < at:
                return offset
        return self.offsets[-1] if self.offsets else 0


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _plain(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _text(body: bytes) -> str:
    kind, body = body[:1], body[1:]
    return body.decode({b"\0": "latin-1", b"\1": "utf-16", b"\2": "utf-16-be"}.get(kind, "utf-8"), "replace")


def id3_end(data: bytes, tags: dict[str, str]) -> int:
    """Reads the ID3v2 tag at the start, if any; where it ends."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    end, at = min(len(data), 10 + _plain(data[6:10])), 10
    while at + 10 <= end and data[at]:
        size = _plain(data[at + 4 : at + 8]) if data[3] >= 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        name, body = data[at : at + 4].decode("latin-1"), data[at + 10 : min(end, at + 10 + size)]
        if name[:1] == "T" and body:
            key, _, value = _text(body).partition("\0") if name == "TXXX" else (name, "", _text(body))
            tags[key] = value.rstrip("\0")
        at += 10 + size
    return end


def _vbr_table(data: bytes, at: int, h: Header) -> dict[str, object]:
    """The Xing (or Info) or VBRI table in a frame, if it has one."""
    tag = at + 4 + h.side
    if data[tag : tag + 4] in (b"Xing", b"Info"):
        out: dict[str, object] = {"kind": data[tag : tag + 4].decode()}
        flags, tag = int.from_bytes(data[tag + 4 : tag + 8], "big"), tag + 8
        for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit:
                raw, tag = data[tag : tag + size], tag + size
                out[name] = list(raw) if name == "toc" else int.from_bytes(raw, "big")
        return out
    if data[at + 36 : at + 40] == b"VBRI":
        size, frames = struct.unpack(">II", data[at + 46 : at + 54])
        return {"kind": "VBRI", "frames": frames, "bytes": size}
    return {}


def _free_size(data: bytes, at: int, h: Header, end: int) -> int:
    """The size of a free-format frame without padding: the next header of the same stream tells it. 0 if there is none."""
    nxt = data.find(b"\xff", at + 24, end)
    while 0 <= nxt <= at + 8192:
        other = header(data[nxt : nxt + 4])
        if other and h.like(other):
            return nxt - at - h.pad
        nxt = data.find(b"\xff", nxt + 1, end)
    return 0


def read_audio(data: bytes) -> Audio:
    """Walks through the frames. After bytes that are no frame it goes on where two headers of one stream follow each other.

    Headers of one stream agree in version, layer and rate. The size of free-format frames is found once, from
    two headers that agree. An ID3v1 tag is one only where the frames end: the same letters inside a frame are
    its bytes. Checksums of all three layers are verified.
    """
    out = Audio()
    at = id3_end(data, out.tags)
    end = len(data)
    tag = end - 128 if data[-128:-125] == b"TAG" and end >= 128 else -1
    synced, first, free, last = True, True, 0, None
    while at + 4 <= end and not (synced and at == tag):
        h = header(data[at : at + 4])
        if h and h.free:
            free = free or _free_size(data, at, h, end)
            h = replace(h, size=free + h.pad if free else 0)
        after = at + h.size if h else 0
        ok = h is not None and h.size > 4 and after <= end
        if ok and last:
            ok = h.like(last)
        if ok and not (synced and last):
            other = header(data[after : after + 4])
            ok = after + 4 > end or after == tag or other is not None and h.like(other)
        if not ok:
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out.skipped += nxt - at
            at, synced = nxt, False
            continue
        synced, last = True, h
        if first and h.layer == 3 and (table := _vbr_table(data, at, h)):
            out.vbr, first = table, False
            at = after
            continue
        first = False
        if h.protected:
            good = int.from_bytes(data[at + 4 : at + 6], "big") == _sum_of_bits(data, at, protected_bits(data, h, at)) if after - at > 6 + 4 else False
            out.crc_good += good
            out.crc_bad += not good
        out.offsets.append(at)
        out.headers.append(h)
        at = after
    return out


def _frame_head(index: int, protected: bool) -> bytes:
    """Header, checksum and empty side information of our frames: MPEG-1 Layer III, 48 kHz, mono."""
    word = bytes([0xFF, 0xFA if protected else 0xFB, index << 4 | 1 << 2, 0xC0])
    side = bytes(17)
    return word + (checksum(word[2:] + side).to_bytes(2, "big") if protected else b"") + side


HEADS = {i: _frame_head(i, True) for i in range(1, 15)}
ROOM = {i: 3 * BITRATES[1, 3][i] - 23 for i in range(1, 15)}


def write_audio(payload: bytes) -> bytes:
    """Stores a payload: full frames at the highest bitrate, the last one at the lowest that holds the rest."""
    full, rest = divmod(len(payload), ROOM[14])
    raw = np.frombuffer(payload, np.uint8)
    frames = np.empty((full, 960), np.uint8)
    frames[:, :23] = np.frombuffer(HEADS[14], np.uint8)
    frames[:, 23:] = raw[: full * ROOM[14]].reshape(full, ROOM[14])
    body, sizes = frames.tobytes(), [960] * full
    if rest:
        last = next(i for i in range(1, 15) if ROOM[i] >= rest)
        body += HEADS[last] + payload[full * ROOM[14] :] + bytes(ROOM[last] - rest)
        sizes.append(ROOM[last] + 23)
    total = 192 + sum(sizes)
    starts = 192 + np.concatenate([[0], np.cumsum(sizes)])
    toc = bytes((starts[np.arange(100) * len(sizes) // 100] * 256 // max(1, total)).clip(0, 255).astype(np.uint8))
    table = _frame_head(5, False) + b"Xing" + struct.pack(">III", 15, len(sizes), total) + toc + struct.pack(">I", 0)
    text = b"\3payload_bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + _syncsafe(len(text)) + b"\0\0" + text
    return b"ID3\4\0\0" + _syncsafe(len(tag)) + tag + table.ljust(192, b"\0") + body


def payload_of(data: bytes, audio: Audio) -> bytes:
    """The payload of a file that write_audio made, from its frames."""
    parts = [data[o + 6 + h.side : o + h.size] for o, h in zip(audio.offsets, audio.headers, strict=True)]
    return b"".join(parts)[: int(audio.tags.get("payload_bytes", 0))]


def feature(audio: Audio) -> str:
    """Frames, samples, exact seconds, mean bitrate, checksums and a digest of the seek offsets, as text."""
    seconds = audio.duration
    bits = sum(8 * h.size for h in audio.headers)
    offsets = zlib.crc32(np.array(audio.offsets, "<i8").tobytes())
    return (f"frames={len(audio.headers)};samples={audio.samples};seconds={seconds.numerator}/{seconds.denominator};"
            f"bps={round(bits / seconds) if seconds else 0};crc={audio.crc_good}/{audio.crc_good + audio.crc_bad};"
            f"table={audio.vbr.get('kind', '')}:{audio.vbr.get('frames', 0)};skipped={audio.skipped};seek={offsets:08x}")  # fmt: skip


def to_audio(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each document's text, as UTF-8 filled up to whole units, in an audio file.

    Null text counts as empty; equal texts give equal files; repeated rows each give a row. Null doc_ids
    stay null. Other columns are not read.
    """
    tuned(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, media = [], []
            for text in b.column(1).to_pylist():
                raw = (text or "").encode()
                sizes.append(len(raw))
                media.append(write_audio(raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), FILL)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, n_bytes long, media binary")


def described(files: DataFrame) -> DataFrame:
    """files (doc_id, n_bytes, media) with what their stored bytes say: payload, duration, seek offsets, checks.

    Null media counts as an empty file: no frames, no payload.
    """
    tuned(files.sparkSession)
    schema = ("doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
              "feature string, seconds double, crc_bad long, frame_offsets array<long>")  # fmt: skip
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column(2).to_pylist():
                data = data or b""
                audio = read_audio(data)
                payload = payload_of(data, audio)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(audio), float(audio.duration), audio.crc_bad, audio.offsets))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.int64())]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names)

    return files.select("doc_id", "n_bytes", "media").mapInArrow(lean(run), schema)
