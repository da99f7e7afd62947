"""MPEG audio columns: texts stored as audio frames, and a parser for any MPEG audio bytes.

The writer lays bytes into Layer III frames as ancillary data (side information all zero, so a player hears silence), after
an ID3v2 tag and a variable-bitrate table. The parser resynchronises on frame headers, reads tags and variable-bitrate tables, verifies the
checksums of Layer III, counts the frames of other layers that have one as crc_unchecked, and gives exact durations (by each frame's own rate) and the offset of every frame; sample_rate is
the last frame's. Frames of free format count as no header.

Null and empty texts store one 64-byte zero payload; very long texts only need more frames; broken or empty media give zero frames and no error.
An empty table gives no rows, repeated rows give a row each, and extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidegauge.llm.batches import columns, text_slices

# Fixed values of the MPEG audio header: kbit/s by (version 1?, layer) and Hz by version.
BITRATES = {
    (True, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}

MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"
PROBE_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "n_frames long, sample_rate int, n_samples long, duration_us long, crc_checked long, crc_bad long, crc_unchecked long, resync_bytes long, seek_offsets array<long>"
)


def _crc16_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        out.append(c & 0xFFFF)
    return out


_CRC16 = _crc16_table()


def crc16(data: bytes) -> int:
    """The checksum of MPEG audio: polynomial 0x8005, all ones at the start, most significant bit first."""
    c = 0xFFFF
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ _CRC16[(c >> 8) ^ b]
    return c


class Header:
    """One frame header; ok tells whether its four bytes can be one."""

    __slots__ = ("ok", "version", "layer", "crc", "rate", "size", "samples", "side")

    def __init__(self, h: bytes) -> None:
        self.ok = False
        if len(h) < 4 or h[0] != 0xFF or h[1] & 0xE0 != 0xE0:
            return
        self.version, layer = (h[1] >> 3) & 3, (h[1] >> 1) & 3
        index, rate, pad = h[2] >> 4, (h[2] >> 2) & 3, (h[2] >> 1) & 1
        if self.version == 1 or layer == 0 or index in (0, 15) or rate == 3:
            return
        self.layer, self.crc, first = 4 - layer, not h[1] & 1, self.version == 3
        self.rate = RATES[self.version][rate]
        bits = BITRATES[first, self.layer][index] * 1000
        if self.layer == 1:
            self.size, self.samples = (12 * bits // self.rate + pad) * 4, 384
        else:
            self.samples = 1152 if first or self.layer == 2 else 576
            self.size = self.samples // 8 * bits // self.rate + pad
        mono = h[3] >> 6 == 3
        self.side = 0 if self.layer != 3 else (17 if mono else 32) if first else (9 if mono else 17)
        self.ok = True


_HEADERS: dict[bytes, Header] = {}


def header(h: bytes) -> Header:
    if h not in _HEADERS:
        if len(_HEADERS) > 4096:
            _HEADERS.clear()
        _HEADERS[h] = Header(h)
    return _HEADERS[h]


def _synchsafe(n: int) -> bytes:
    return bytes((n >> s) & 127 for s in (21, 14, 7, 0))


def _tag(fields: dict[str, str]) -> bytes:
    """An ID3v2.4 tag with one TXXX frame for each field."""
    body = b""
    for k, v in fields.items():
        text = b"\x03" + k.encode() + b"\x00" + v.encode() + b"\x00"
        body += b"TXXX" + _synchsafe(len(text)) + b"\x00\x00" + text
    return b"ID3\x04\x00\x00" + _synchsafe(len(body)) + body


def _frame_head(bitrate_index: int, protected: bool) -> bytes:
    """MPEG 1 Layer III at 44.1 kHz, two channels, no padding; with its checksum and empty side information."""
    h = bytes((0xFF, 0xFA if protected else 0xFB, bitrate_index << 4, 0))
    side = bytes(32)
    return h + (crc16(h[2:] + side).to_bytes(2, "big") if protected else b"") + side


_HEADS = {i: _frame_head(i, True) for i in range(1, 15)}
_ROOM = {i: header(_HEADS[i][:4]).size - len(_HEADS[i]) for i in _HEADS}


def write_audio(payload: bytes) -> bytes:
    """Payload as tagged audio: full frames at the top bitrate, and a last one at the least bitrate that holds the rest."""
    top, frames = _ROOM[14], []
    for at in range(0, len(payload), top):
        part = payload[at : at + top]
        i = 14 if len(part) == top else next(i for i in _ROOM if _ROOM[i] >= len(part))
        frames.append(_HEADS[i] + part + bytes(_ROOM[i] - len(part)))
    lengths = np.cumsum([0, *map(len, frames)])
    lead = _frame_head(5, False)
    size = header(lead[:4]).size
    total = int(lengths[-1]) + size
    steps = (np.arange(100) * len(frames)) // 100
    toc = bytes(np.minimum(255, (lengths[steps] + size) * 256 // total).astype(np.uint8))
    table = lead + b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    return _tag({"payload_bytes": str(len(payload))}) + table + bytes(size - len(table)) + b"".join(frames)


def parse_tags(data: bytes) -> tuple[int, int, dict[str, str]]:
    """(start, end, fields): where audio can lie between an ID3v2 tag in front and an ID3v1 tag behind."""
    start, end, fields = 0, len(data), {}
    while data[start : start + 3] == b"ID3" and len(data) >= start + 10:
        size = sum((b & 127) << s for b, s in zip(data[start + 6 : start + 10], (21, 14, 7, 0), strict=True))
        wide, at, stop = data[start + 3] >= 4, start + 10, min(len(data), start + 10 + size)
        while at + 10 <= stop and data[at : at + 4].isalnum():
            raw = data[at + 4 : at + 8]
            n = sum((b & 127) << s for b, s in zip(raw, (21, 14, 7, 0), strict=True)) if wide else int.from_bytes(raw, "big")
            body = data[at + 10 : min(stop, at + 10 + n)]
            name = data[at : at + 4].decode()
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace") if body and name[0] == "T" else ""
            parts = text.rstrip("\x00").split("\x00")
            if name == "TXXX":
                fields[parts[0]] = parts[-1]
            elif name[0] == "T":
                fields[name] = parts[0]
            at += 10 + n
        start = stop + (10 if wide and data[start + 5] & 0x10 else 0)
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        fields.setdefault("TIT2", data[end + 3 : end + 33].rstrip(b"\x00 ").decode("latin-1"))
    return start, end, fields


def parse_vbr(data: bytes, at: int, h: Header) -> dict | None:
    """The Xing, Info or VBRI table in the frame at this place: frames, bytes and its seek entries."""
    x = at + 4 + 2 * h.crc + h.side
    if data[x : x + 4] in (b"Xing", b"Info") and len(data) >= x + 8:
        flags, x, out = int.from_bytes(data[x + 4 : x + 8], "big"), x + 8, {"kind": data[x : x + 4].decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], x = int.from_bytes(data[x : x + 4], "big"), x + 4
        out["toc"] = list(data[x : x + 100]) if flags & 4 else []
        return out
    x = at + 36
    if data[x : x + 4] == b"VBRI" and len(data) >= x + 26:
        size, frames, n, scale, width = struct.unpack(">IIHHH", data[x + 10 : x + 24])
        toc = [int.from_bytes(data[x + 26 + k * width : x + 26 + (k + 1) * width], "big") * scale for k in range(n)] if width else []
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc}
    return None


def parse_audio(data: bytes) -> dict:
    """Tags, table, frames, checksums, exact duration and offsets of MPEG audio; see the module's docstring."""
    start, end, fields = parse_tags(data)
    at, offsets, bodies, vbr = start, [], [], None
    rate = samples = checked = bad = unchecked = lost = 0
    by_rate: dict[int, int] = {}
    synced = False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        after = at + h.size if h.ok else 0
        # A header counts if it stands right behind a frame, if its frame ends the audio, or if another header follows; else look for the next sync byte.
        if not h.ok or after > end or (not synced and after + 4 <= end and not header(data[after : after + 4]).ok):
            follow = data.find(b"\xff", at + 1, end)
            follow = end if follow < 0 else follow
            lost, at, synced = lost + follow - at, follow, False
            continue
        synced = True
        if not offsets and vbr is None and (vbr := parse_vbr(data, at, h)) is not None:
            at = after
            continue
        body = at + 4
        if h.crc:
            body += 2
            unchecked += h.layer != 3
            if h.layer == 3:
                checked += 1
                bad += crc16_cached(data[at + 2 : at + 4] + data[body : body + h.side]) != int.from_bytes(data[at + 4 : at + 6], "big")
        offsets.append(at)
        bodies.append((body + h.side, after))
        by_rate[h.rate] = by_rate.get(h.rate, 0) + h.samples
        rate, samples, at = h.rate, samples + h.samples, after
    # Whole microseconds of the sum over the rates, which need not be one.
    common = math.lcm(*by_rate)
    us = sum(n * (common // r) for r, n in by_rate.items()) * 1_000_000 // common
    return {"fields": fields, "vbr": vbr, "offsets": offsets, "bodies": bodies, "rate": rate, "samples": samples, "us": us, "checked": checked, "bad": bad, "unchecked": unchecked, "lost": lost}


_SEEN_CRC: dict[bytes, int] = {}


def crc16_cached(data: bytes) -> int:
    """crc16; few different protected parts recur in one file, so a bounded number is remembered."""
    if data not in _SEEN_CRC:
        if len(_SEEN_CRC) > 4096:
            _SEEN_CRC.clear()
        _SEEN_CRC[data] = crc16(data)
    return _SEEN_CRC[data]


def read_payload(data: bytes, parsed: dict) -> bytes:
    """The bytes that write_audio stored; whole ancillary data where no length is tagged."""
    whole = b"".join(data[a:b] for a, b in parsed["bodies"])
    n = parsed["fields"].get("payload_bytes", "")
    return whole[: int(n)] if n.isdigit() else whole


def store_as_audio(documents: DataFrame, block: int = 64) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as UTF-8, zero-padded to a positive multiple of block, as MPEG audio."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 8 << 20):
            sizes, media = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                raw = text or b""
                sizes.append(len(raw))
                media.append(write_audio(raw + bytes(-len(raw) % block if raw else block)))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return columns(documents, "doc_id", "text").mapInArrow(run, MEDIA_SCHEMA)


def probe_audio(media: DataFrame, tail: int = 64) -> DataFrame:
    """Parse a media column (doc_id, n_bytes, media) back into durations, seek offsets, checksum counts and digests."""
    names = [x.split()[0] for x in PROBE_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def row(data: bytes) -> tuple:
        p = parse_audio(data)
        payload = read_payload(data, p)
        seek = zlib.crc32(np.array(p["offsets"], dtype="<u8").tobytes())
        table = p["vbr"] or {}
        feature = f"rate={p['rate']};samples={p['samples']};frames={len(p['offsets'])};table={table.get('kind', '')}:{table.get('frames', 0)};crc={p['checked'] - p['bad']}/{p['checked']};seek={seek:08x}"
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-tail:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(p["offsets"]), p["rate"], p["samples"], p["us"], p["checked"], p["bad"], p["unchecked"], p["lost"], p["offsets"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 8 << 20):
            rows = [row(x or b"") for x in batch.column(2).to_pylist()]
            rest = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds[2:])]
            yield pa.record_batch([batch.column(0), batch.column(1), *rest], names=names)

    return columns(media, "doc_id", "n_bytes", "media").mapInArrow(run, PROBE_SCHEMA)


def op6_media_columns(spark, sf_dir: str) -> DataFrame:
    return probe_audio(store_as_audio(spark.read.parquet(f"{sf_dir}/documents.parquet")))
