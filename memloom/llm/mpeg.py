"""MPEG audio columns: frame parsing with resynchronisation, tags, variable-bitrate
tables, checksums, exact durations and seek offsets; and lossless payloads in frames.

``parse`` reads any MPEG-1, 2 or 2.5 stream of layers I to III. ``store`` makes an MPEG-2
layer III stream (16 kHz, mono, checksums on) that carries a payload in the ancillary
bytes of its frames, 576 a frame of 576 samples: one byte a sample.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.textio import in_batches, pieces, stored, table

# Fixed values of the format: kbit/s by (MPEG-1?, layer) and Hz by version bits.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
CRC_POLYNOMIAL = 0x8005

UNIT = 576
PAD = b"\xff"


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    bitrate: int
    rate: int
    mono: bool
    size: int
    samples: int
    side: int


@lru_cache(maxsize=4096)
def header(raw: bytes) -> Header | None:
    """The frame header in 4 bytes; None if they are none, or of free format."""
    word = int.from_bytes(raw, "big")
    if len(raw) < 4 or word >> 21 != 0x7FF:
        return None
    version, layer = word >> 19 & 3, 4 - (word >> 17 & 3)
    bits, freq, pad, mode = word >> 12 & 15, word >> 10 & 3, word >> 9 & 1, word >> 6 & 3
    if version == 1 or layer == 4 or bits in (0, 15) or freq == 3 or word & 3 == 2:
        return None
    first = version == 3
    bitrate, rate = BITRATES[first, layer][bits] * 1000, RATES[version][freq]
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    size = (12 * bitrate // rate + pad) * 4 if layer == 1 else samples // 8 * bitrate // rate + pad
    mono = mode == 3
    side = 0 if layer != 3 else (17 if mono else 32) if first else (9 if mono else 17)
    return Header(version, layer, not word >> 16 & 1, bitrate, rate, mono, size, samples, side)


@lru_cache(maxsize=65536)
def crc16(data: bytes) -> int:
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ CRC_POLYNOMIAL if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def allocation_bytes(frame: bytes) -> int:
    """Bytes of a layer I frame's bit allocation, which its checksum covers: 4 bits a subband and channel, one channel above the bound."""
    mode, bound = frame[3] >> 6, 4 * ((frame[3] >> 4 & 3) + 1)
    subbands = 32 if mode == 3 else bound + 32 if mode == 1 else 64
    return subbands // 2


@dataclass
class Stream:
    """What ``parse`` found. ``offsets`` holds the first byte of each audio frame. Checksums of layers I and III are verified; what those
    of layer II cover depends on its allocation tables, and such frames count as ``unchecked``."""

    tags: dict[str, str] = field(default_factory=dict)
    table: dict = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    samples: int = 0
    skipped: int = 0
    checked: int = 0
    unchecked: int = 0
    damaged: int = 0

    @property
    def table_agrees(self) -> bool | None:
        """Whether the table's own number of frames is that found; None without one."""
        return self.table["frames"] == len(self.offsets) if "frames" in self.table else None

    @property
    def rate(self) -> int:
        return self.headers[0].rate if self.headers else 0

    @property
    def seconds(self) -> float:
        return sum(h.samples / h.rate for h in self.headers) if len({h.rate for h in self.headers}) > 1 else self.samples / self.rate if self.rate else 0.0


def _syncsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _text(raw: bytes) -> str:
    codec = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0] if raw else 0, "latin-1")
    return raw[1:].decode(codec, "replace").strip("\x00")


def _leading_tag(data: bytes, found: dict) -> int:
    """Reads an ID3v2 tag at the front; where audio begins."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    end, at, major = min(len(data), 10 + _syncsafe(data[6:10])), 10, data[3]
    step = 6 if major == 2 else 10
    if major > 2 and data[5] & 0x40 and at + 4 <= end:
        at += _syncsafe(data[at : at + 4]) if major == 4 else 4 + int.from_bytes(data[at : at + 4], "big")
    while at + step <= end and data[at]:
        name = data[at : at + step // 2 + (step == 10) * -1].decode("latin-1")
        raw = data[at + len(name) : at + len(name) + (3 if step == 6 else 4)]
        size = _syncsafe(raw) if major == 4 else int.from_bytes(raw, "big")
        body = data[at + step : min(end, at + step + size)]
        if name.startswith("T"):
            value = _text(body)
            if name in ("TXXX", "TXX"):
                label, _, value = value.partition("\x00")
                name = f"{name}:{label}"
            found[name] = value
        at += step + size
    return end + (10 if data[5] & 0x10 else 0)


def _trailing_tag(data: bytes, found: dict) -> int:
    """Reads an ID3v1 tag at the back; where audio ends."""
    if len(data) < 128 or data[-128:-125] != b"TAG":
        return len(data)
    tag = data[-128:]
    for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
        found.setdefault(name, tag[a:b].split(b"\x00")[0].decode("latin-1").strip())
    return len(data) - 128


def _variable_table(frame: bytes, h: Header) -> dict:
    """A Xing, Info or VBRI table, if the frame holds one."""
    for at in (4 + h.side, 6 + h.side):
        kind = frame[at : at + 4]
        if kind in (b"Xing", b"Info"):
            flags, at = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
            found: dict = {"kind": kind.decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    found[name], at = int.from_bytes(frame[at : at + 4], "big"), at + 4
            if flags & 4:
                found["toc"] = list(frame[at : at + 100])
            return found
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        _, _, _, size, frames, entries, scale, width, per = struct.unpack(">HHHIIHHHH", frame[40:64]) if len(frame) >= 64 else (0,) * 9
        toc = [int.from_bytes(frame[64 + k * width : 64 + (k + 1) * width], "big") * scale for k in range(entries)] if width else []
        return {"kind": "VBRI", "frames": frames, "bytes": size, "frames_per_entry": per, "toc": toc}
    return {}


def parse(data: bytes) -> Stream:
    """Frames of ``data``. After lost or foreign bytes the scan goes on at the next header
    that is followed by another of its kind, or by the end. A last frame cut short is
    left out. Empty and foreign data have no frames and last 0 seconds."""
    out = Stream()
    at, end = _leading_tag(data, out.tags), _trailing_tag(data, out.tags)
    locked, first = False, True
    while at + 4 <= end:
        h = header(data[at : at + 4])
        follows = h is not None and at + h.size <= end
        if follows and not locked and at + h.size + 4 <= end:
            after = header(data[at + h.size : at + h.size + 4])
            follows = after is not None and (after.version, after.layer, after.rate) == (h.version, h.layer, h.rate)
        if not follows:
            locked = False
            later = data.find(b"\xff", at + 1, end)
            out.skipped += (later if later >= 0 else end) - at
            at = later if later >= 0 else end
            continue
        frame = data[at : at + h.size]
        if first and h.layer == 3 and (found := _variable_table(frame, h)):
            out.table = found
        else:
            covered = h.side if h.layer == 3 else allocation_bytes(frame) if h.layer == 1 else None
            if h.protected and covered is None:
                out.unchecked += 1
            elif h.protected:
                out.checked += 1
                out.damaged += crc16(frame[2:4] + frame[6 : 6 + covered]) != int.from_bytes(frame[4:6], "big")
            out.offsets.append(at)
            out.headers.append(h)
            out.samples += h.samples
        locked, first, at = True, False, at + h.size
    out.skipped += max(0, end - at)
    return out


_HEAD = bytes([0xFF, 0xF2, 0xD8, 0xC0])
_SIZE = header(_HEAD).size
_BODY = 4 + 2 + header(_HEAD).side
_FRONT = _HEAD + crc16(_HEAD[2:] + bytes(_BODY - 6)).to_bytes(2, "big") + bytes(_BODY - 6)


def payload_of(text: bytes) -> bytes:
    """``text`` with bytes 255 after it up to a positive multiple of 576."""
    return text + PAD * (-len(text) % UNIT or (0 if text else UNIT))


def store(text: bytes) -> bytes:
    """An ID3v2 tag with the text's bytes, a table frame with a seek table, and the payload's frames."""
    payload = np.frombuffer(payload_of(text), dtype=np.uint8).reshape(-1, UNIT)
    frames = np.zeros((len(payload), _SIZE), dtype=np.uint8)
    frames[:, :_BODY] = np.frombuffer(_FRONT, dtype=np.uint8)
    frames[:, _BODY : _BODY + UNIT] = payload
    label = b"\x03n_bytes\x00" + str(len(text)).encode()
    sized = lambda n: bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])
    entry = b"TXXX" + sized(len(label)) + b"\x00\x00" + label
    tag = b"ID3\x04\x00\x00" + sized(len(entry)) + entry
    total = _SIZE * (len(payload) + 1)
    toc = bytes(min(255, 256 * (_SIZE * (1 + k * len(payload) // 100)) // total) for k in range(100))
    info = _FRONT + b"Info" + struct.pack(">III", 7, len(payload), total) + toc
    return tag + info.ljust(_SIZE, b"\x00") + frames.tobytes()


def payload_in(data: bytes, stream: Stream) -> bytes:
    """The payload that ``store`` put in."""
    return b"".join(data[o + _BODY : o + _BODY + UNIT] for o in stream.offsets)


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id, media of ``docs`` (doc_id, text; null: empty), written to the shared folder and reread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                media = [store(t.encode() if t else b"") for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(media, pa.binary())], names=["doc_id", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(in_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, media binary"), "media")


FOUND = """frames bigint, samples bigint, rate int, seconds double, skipped bigint, checked bigint, unchecked bigint, damaged bigint,
 table_kind string, table_agrees boolean, tags map<string,string>, seek_offsets array<bigint>, n_bytes bigint, payload_bytes bigint,
 payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string"""


def media_features(media: DataFrame) -> DataFrame:
    """One row for each of ``media`` (doc_id, media): what ``parse`` finds, digests, and the
    byte offset of every frame. Null media count as empty."""

    def row(data: bytes) -> tuple:
        s = parse(data)
        payload = payload_in(data, s)
        return (len(s.offsets), s.samples, s.rate, s.seconds, s.skipped, s.checked, s.unchecked, s.damaged, s.table.get("kind"), s.table_agrees, list(s.tags.items()), s.offsets,
                int(s.tags.get("TXXX:n_bytes") or 0), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest())

    types = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.map_(pa.string(), pa.string()), pa.list_(pa.int64()),
             pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in FOUND.replace("map<string,string>", "m").split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "media"):
                rows = list(zip(*[row(m.as_py() or b"") for m in piece.column("media")], strict=True))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *[pa.array(c, t) for c, t in zip(rows, types, strict=True)]], names=["doc_id", *names])

    kind = media.schema["doc_id"].dataType.simpleString()
    return in_batches(media.select("doc_id", "media"), run, f"doc_id {kind}, {FOUND}")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media_features(with_media(table(spark, sf_dir, "documents").select("doc_id", "text")))
    feature = F.concat_ws(":", "frames", "samples", "rate", "checked", "damaged", "skipped", F.coalesce("table_kind", F.lit("-")), F.md5(F.array_join("seek_offsets", ",")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), F.round("seconds", 6).alias("seconds"), "seek_offsets", "table_agrees")
