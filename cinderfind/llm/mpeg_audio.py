"""Media columns: MPEG audio, read into tags, tables, exact durations and frame seek offsets; and a writer whose streams
carry bytes.

The reader knows MPEG-1, 2 and 2.5 in Layers I to III, mono and stereo, CRC-16 over what each layer protects, ID3v2.2 to
2.4 and ID3v1 tags, and variable-bitrate tables ("Xing", "Info", "VBRI"). It walks from frame to frame and
resynchronises where the chain breaks.

The writer makes MPEG-2 Layer III. A payload travels losslessly as the ancillary data of silent frames, 576 bytes to a
frame: such a frame holds 576 samples a channel, so one payload byte stands for one sample. A stream is an ID3v2 tag, a
frame with the variable-bitrate table ("Xing": frames, bytes, 100-point seek table), the payload frames, and an ID3v1
tag. Frames have 144 or 160 kbit/s in turn of their content's parity, so that the table is of use; every frame has a
CRC-16. Null and empty payloads are one padding frame. Equal payloads give equal streams: nothing but the payload enters.

Streams are stored in a table, and a second pass reads the stored bytes back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderfind.llm._common import Workspace

UNIT = 576
TAIL = 32  # payload bytes that tail_crc32 covers
RATE = 16000
_KBPS = {  # (MPEG-1, layer)
    (True, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
_VERSIONS = {0: (4, "2.5"), 2: (2, "2"), 3: (1, "1")}  # by header bits: divisor of the sampling rate, name
#: Layer II: bits of allocation by subband, as (bits, subbands)
_ALLOCATION = {"a": [(4, 11), (3, 12), (2, 4)], "b": [(4, 11), (3, 12), (2, 7)], "c": [(4, 2), (3, 6)], "d": [(4, 2), (3, 10)], "low": [(4, 4), (3, 7), (2, 19)]}
_SIDE = 9  # side information of a mono MPEG-2 frame
_BODY = 4 + 2 + _SIDE
_KBPS_OUT = _KBPS[False, 3]


def crc16(data: bytes) -> int:
    """CRC-16 of MPEG audio: polynomial 8005, initially all ones."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1) ^ 0x8005 if crc & 0x8000 else crc << 1
        crc &= 0xFFFF
    return crc


def _crc_bits(crc: int, data: bytes, n: int) -> int:
    """The CRC carried on over the first n bits of data."""
    for i in range(n):
        bit = data[i >> 3] >> (7 - (i & 7)) & 1
        crc = ((crc << 1) ^ 0x8005 if (crc >> 15) ^ bit else crc << 1) & 0xFFFF
    return crc


def _head(bitrate_index: int) -> bytes:
    """Header, CRC and (silent) side information of a mono, protected frame of 16 kHz."""
    header = bytes([0xFF, 0xF2, bitrate_index << 4 | 2 << 2, 0xC0])
    side = bytes(_SIDE)
    return header + struct.pack(">H", crc16(header[2:] + side)) + side


_HEADS = {i: _head(i) for i in (13, 14)}
_LEN = {i: 72 * _KBPS_OUT[i] * 1000 // RATE for i in (13, 14)}  # 648, 720


def pad(data: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of 576."""
    return data + b"\xff" * ((-len(data)) % UNIT or (0 if data else UNIT))


def _syncsafe(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def encode(payload: bytes, title: str = "payload") -> bytes:
    """The stream for a payload of a positive multiple of 576 bytes."""
    if not payload or len(payload) % UNIT:
        raise ValueError("a payload has a positive multiple of 576 bytes")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    n = len(rows)
    wide = (rows.sum(1, dtype=np.int64) & 1).astype(bool)
    sizes = np.where(wide, _LEN[14], _LEN[13])
    ends = np.cumsum(sizes)
    body = np.zeros(int(ends[-1]), np.uint8)
    for index, which in ((13, ~wide), (14, wide)):
        at = (ends - sizes)[which]
        if len(at):
            block = np.zeros((len(at), _BODY + UNIT), np.uint8)
            block[:, :_BODY] = np.frombuffer(_HEADS[index], np.uint8)
            block[:, _BODY:] = rows[which]
            body[at[:, None] + np.arange(_BODY + UNIT)] = block
    first = _LEN[13]
    total = first + int(ends[-1])
    seek = np.concatenate([[0], first + ends])
    points = seek[np.minimum(np.arange(100) * (n + 1) // 100, n)] * 256 // total
    table = b"Xing" + struct.pack(">III", 7, n, total) + points.astype(np.uint8).tobytes()
    info = (_HEADS[13] + table).ljust(first, b"\0")
    text = b"\0" + title.encode("latin-1", "replace")
    tag = b"TIT2" + struct.pack(">I", len(text)) + b"\0\0" + text
    return b"ID3\x03\0\0" + _syncsafe(len(tag)) + tag + info + body.tobytes() + (b"TAG" + title.encode("latin-1", "replace")[:30]).ljust(128, b"\0")


@dataclass(frozen=True)
class Frame:
    """What a frame header says."""

    version: str
    layer: int
    rate: int
    kbps: int
    size: int
    samples: int
    mono: bool
    protected: bool
    bound: int  # the first subband in joint stereo, of Layers I and II

    @property
    def side(self) -> int:
        """Bytes of side information (Layer III)."""
        return (17 if self.mono else 32) if self.version == "1" else 9 if self.mono else 17

    @property
    def kind(self) -> tuple:
        return self.version, self.layer, self.rate


@lru_cache(4096)
def _parsed(b: int, c: int, d: int) -> Frame | None:
    """The header of bytes FF b c d."""
    if b & 0xE0 != 0xE0 or (b >> 3 & 3) == 1 or not b & 6 or c >> 4 in (0, 15) or (c >> 2 & 3) == 3:
        return None
    divisor, version = _VERSIONS[b >> 3 & 3]
    layer = 4 - (b >> 1 & 3)
    rate = [44100, 48000, 32000][c >> 2 & 3] // divisor
    kbps = _KBPS[divisor == 1, layer][c >> 4]
    samples = 384 if layer == 1 else 576 if layer == 3 and divisor > 1 else 1152
    pad = c >> 1 & 1
    size = (12000 * kbps // rate + pad) * 4 if layer == 1 else samples * 125 * kbps // rate + pad
    mode = d >> 6
    return Frame(version, layer, rate, kbps, size, samples, mode == 3, not b & 1, 4 * (d >> 4 & 3) + 4 if mode == 1 else 32)


def _frame(data: bytes, at: int) -> Frame | None:
    """The frame header at a place, if there is one (free-format bitrates aside)."""
    if at + 4 > len(data) or data[at] != 0xFF:
        return None
    return _parsed(data[at + 1], data[at + 2], data[at + 3])


def _allocated(f: Frame, body: bytes) -> int:
    """Bits of a Layer I or II frame that its CRC covers behind the header: allocation, and for Layer II scale factor selection."""
    channels = 1 if f.mono else 2
    if f.layer == 1:
        return 4 * (channels * min(f.bound, 32) + 32 - min(f.bound, 32))
    each = f.kbps // channels
    if f.version != "1":
        table = "low"
    elif each <= 48:
        table = "d" if f.rate == 32000 else "c"
    else:
        table = "a" if f.rate == 48000 or each <= 80 else "b"
    at, used, k = 0, 0, 0
    for bits, subbands in _ALLOCATION[table]:
        for _ in range(subbands):
            both = channels if k < f.bound else 1
            for _ in range(both):
                value = int.from_bytes(body[at >> 3 : (at >> 3) + 2], "big") >> (16 - bits - (at & 7)) & ((1 << bits) - 1)
                used += bool(value) * (channels if both == 1 else 1)
                at += bits
            k += 1
    return at + 2 * used


def _crc_good(data: bytes, at: int, f: Frame, seen: dict) -> bool:
    if not f.protected:
        return True
    body = data[at + 6 : at + 6 + (f.side if f.layer == 3 else 160)]
    key = data[at + 2 : at + 4], body
    if key not in seen:
        if len(seen) > 10_000:
            seen.clear()
        seen[key] = crc16(key[0] + body) if f.layer == 3 else _crc_bits(crc16(key[0]), body, min(_allocated(f, body), 8 * len(body)))
    return seen[key] == data[at + 4] << 8 | data[at + 5]


@dataclass
class Stream:
    """What read() finds: offsets of audio frames, their sizes, and what tags and tables say."""

    offsets: np.ndarray
    sizes: np.ndarray
    kbps: np.ndarray
    rate: int
    bad_crc: int
    skipped: int
    tags: dict = field(default_factory=dict)
    table: dict = field(default_factory=dict)
    version: str = ""
    layer: int = 0
    per_frame: int = 0

    @property
    def samples(self) -> int:
        return len(self.offsets) * self.per_frame

    @property
    def duration_us(self) -> int:
        return self.samples * 1_000_000 // self.rate if self.rate else 0


_TEXT = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}


def _tag(data: bytes, at: int) -> tuple[dict, int]:
    """The text frames of the ID3v2 tag at a place, and where it ends."""
    major, flags = data[at + 3], data[at + 5]
    size = data[at + 6] << 21 | data[at + 7] << 14 | data[at + 8] << 7 | data[at + 9]
    stop, tags = min(len(data), at + 10 + size), {}
    body = data[at + 10 : stop]
    if flags & 0x80:  # unsynchronised
        body = body.replace(b"\xff\x00", b"\xff")
    whole = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3] if major == 4 else int.from_bytes(b, "big")
    p = 0
    if flags & 0x40 and major > 2 and len(body) >= 4:
        p = whole(body[:4]) + (0 if major == 4 else 4)
    name, head = (3, 6) if major == 2 else (4, 10)
    while p + head <= len(body) and body[p] != 0:
        n = int.from_bytes(body[p + 3 : p + 6], "big") if major == 2 else whole(body[p + 4 : p + 8])
        text = body[p + head : p + head + n]
        if body[p : p + 1] == b"T" and text and text[0] in _TEXT:
            values = filter(None, text[1:].decode(_TEXT[text[0]], "replace").split("\0"))
            tags[body[p : p + name].decode("latin-1")] = "/".join(values)
        p += head + n
    return tags, stop + (10 if major == 4 and flags & 0x10 else 0)


def _table(data: bytes, at: int, f: Frame) -> dict:
    """The variable-bitrate table that a frame holds in place of audio, if it does."""
    for p in (at + 4 + f.side, at + 6 + f.side):
        kind = data[p : p + 4]
        if kind in (b"Xing", b"Info") and f.layer == 3:
            flags, p, table = int.from_bytes(data[p + 4 : p + 8], "big"), p + 8, {"kind": kind.decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    table[name] = int.from_bytes(data[p : p + 4], "big")
                    p += 4
            if flags & 4:
                table["seek"] = list(data[p : p + 100])
            return table
    p = at + 36
    if data[p : p + 4] == b"VBRI":
        total, frames, n, scale, width, step = struct.unpack(">IIHHHH", data[p + 10 : p + 26])
        sizes = [int.from_bytes(data[q : q + width], "big") * scale for q in range(p + 26, p + 26 + n * width, width)] if width else []
        return {"kind": "VBRI", "frames": frames, "bytes": total, "seek": sizes, "frames_per_entry": step}
    return {}


def read(data: bytes) -> Stream:
    """Parses tags, walks frame to frame, and on a break resynchronises at the next header that a further header of its
    kind, the stream's end or a sound CRC confirms. A frame with a wrong CRC is counted and left out."""
    at, end, tags, table = 0, len(data), {}, {}
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        found, at = _tag(data, at)
        tags |= found
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        tags["ID3v1"] = data[end - 125 : end - 95].rstrip(b"\0 ").decode("latin-1")
        end -= 128
    offsets, sizes, kbps, kind, bad, skipped, seen = [], [], [], None, 0, 0, {}
    synced = True
    while at < end:
        f = _frame(data, at)
        sound = f is not None and at + f.size <= end and (kind is None or f.kind == kind[0])
        good = sound and _crc_good(data, at, f, seen)
        if sound and not (synced and good):  # it may be other bytes that look like a header: another must follow it
            nxt = _frame(data, at + f.size)
            sound = (at + f.size == end or (nxt is not None and nxt.kind == f.kind)) and (synced or good)
        if not sound:
            synced = False
            nxt = data.find(b"\xff", at + 1, end)
            skipped += (nxt if nxt >= 0 else end) - at
            at = nxt if nxt >= 0 else end
            continue
        synced = True
        if not good:
            bad += 1
        elif kind is None and (table := _table(data, at, f)):
            kind = f.kind, f.samples
        else:
            kind = kind or (f.kind, f.samples)
            offsets.append(at)
            sizes.append(f.size)
            kbps.append(f.kbps)
        at += f.size
    (version, layer, rate), samples = kind or (("", 0, 0), 0)
    return Stream(np.array(offsets, np.int64), np.array(sizes, np.int64), np.array(kbps, np.int64), rate, bad, skipped, tags, table, version, layer, samples)


def payload_of(data: bytes, stream: Stream) -> bytes:
    """The bytes that the frames carry."""
    if not len(stream.offsets):
        return b""
    raw = np.frombuffer(data, np.uint8)
    return raw[(stream.offsets + _BODY)[:, None] + np.arange(UNIT)].tobytes()


def feature(stream: Stream, payload: bytes) -> str:
    """Exact duration, frames, mean bitrate, table and seek offsets in short, and byte statistics of the samples."""
    sample = np.frombuffer(payload, np.uint8)
    mean = int(sample.sum(dtype=np.int64)) * 1000 // max(1, len(sample))
    seek = zlib.crc32(stream.offsets.astype("<i8").tobytes())
    kbps = int(stream.kbps.sum()) * 1000 // max(1, len(stream.kbps))
    return (
        f"mpeg{stream.version}-l{stream.layer};rate={stream.rate};frames={len(stream.offsets)};samples={stream.samples};ms={stream.duration_us // 1000};"
        f"kbps_milli={kbps};table={stream.table.get('frames', -1)};bad_crc={stream.bad_crc};skipped={stream.skipped};seek_crc={seek:08x};mean_milli={mean}"
    )


BYTES = 4 << 20  # of a batch that a task hands on, single streams aside


def _write(it):
    for batch in it:
        out, held = [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = (text.as_py() or "").encode()
            media = encode(pad(raw))
            out.append((doc_id, len(raw), media))
            held += len(media)
            if held > BYTES:
                yield _batch(out, STORED)
                out, held = [], 0
        yield _batch(out, STORED)


def _describe(keep: list[str], column: str):
    def run(it):
        for batch in it:
            out = []
            for media in batch.column(column):
                data = media.as_py() or b""
                stream = read(data)
                tags = [{"name": k, "value": v} for k, v in stream.tags.items()]
                out.append((len(data), hashlib.sha256(data).hexdigest(), f"MPEG-{stream.version} Layer {stream.layer}" if stream.layer else None, stream.rate, stream.duration_us, len(stream.offsets), stream.offsets.tolist(), stream.bad_crc, stream.skipped, tags, *_carried(data, stream)))
            made = _batch(out, FOUND)
            yield pa.record_batch([*(batch.column(c) for c in keep), *made.columns], names=[*keep, *made.schema.names])

    return run


def _carried(data: bytes, stream: Stream) -> tuple:
    """(payload_bytes, payload_sha256, tail_crc32, feature) of a stream as encode() makes them; else no payload."""
    own = (stream.version, stream.layer, stream.rate) == ("2", 3, RATE) and len(stream.sizes) and int(stream.sizes.min()) >= _BODY + UNIT
    back = payload_of(data, stream) if own else b""
    return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-TAIL:]), feature(stream, back)


STORED = "doc_id long, n_bytes long, media binary"
FOUND = (
    "media_bytes long, media_sha256 string, format string, rate long, duration_us long, n_frames long, seek_offsets array<long>, bad_crc long, skipped long, "
    "tags array<struct<name:string,value:string>>, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"
)
_KINDS = {
    "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
    "array<struct<name:string,value:string>>": pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])),
}


def _batch(rows, fields: str):
    names, kinds = zip(*(x.split() for x in fields.split(", ")))
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.record_batch([pa.array(c, _KINDS[k]) for c, k in zip(columns, kinds)], names=list(names))


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each (doc_id, text) as an MPEG stream.

    Row by row, no shuffle; the memory of a task is that of a batch of texts and BYTES of streams. Null text: empty;
    null doc_id stays null; other columns are left out.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_write, STORED)


def describe(media: DataFrame, column: str = "media") -> DataFrame:
    """A table with a binary column of MPEG audio -> its other columns, and what FOUND lists of each stream: format,
    exact duration, seek offsets of the audio frames, tags, damage, and the payload if it is of media_column's making.

    Null or other bytes: no frames and duration 0. Columns that have a name of FOUND give way.
    """
    made = {x.split()[0] for x in FOUND.split(", ")}
    keep = [f for f in media.schema.fields if f.name != column and f.name not in made]
    kinds = T.StructType([*keep, *T._parse_datatype_string(FOUND).fields])
    return media.select(*[F.col(f"`{f.name}`") for f in keep], column).mapInArrow(_describe([f.name for f in keep], column), kinds)


def op6_mpeg_audio(spark, sf_dir):
    stored = Workspace(spark, "media").save(media_column(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    found = describe(stored)
    first = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_us", "n_frames", "seek_offsets"]
    return found.select(*first)
