"""MPEG audio as a media column: bytes stored in and read back from MPEG-1 Layer III frames.

A stored form is an ID3v2.4 tag, a frame with a variable-bitrate table, and audio frames. Every
audio frame is a silent one by its side information; the rest of it is the format's ancillary
data, whose bytes are the payload. The last frame takes the lowest bitrate that holds what is left.
Frames carry the 16-bit checksum of header and side information.

The parser works on any Layer III stream: it skips tags, resynchronises after damage (a header only
counts if another one or the end follows where its length says), verifies checksums, reads the
variable-bitrate table, and gives exact durations and the byte offset of every frame for seeking.

Null texts count as empty; the payload is never empty, as it is padded to a positive multiple of 64. Repeated rows
give equal forms, one each; an empty table gives an empty one; columns other than key and text are never read. A tag
of the old kind at the end is taken for one only where the frames end, whatever the payload holds."""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, map_texts, shared_dir

# Fixed values of the format: kbit/s by header index for MPEG-1 and MPEG-2/2.5 Layer III, and sample rates.
BITRATES = {1: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
UNIT = 64
RATE_INDEX = 2  # 32 kHz: whole frame lengths without padding slots
SIDE = 17  # bytes of side information, one channel


def crc16(data: bytes) -> int:
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


_crcs: dict[bytes, int] = {}


def checksum(data: bytes) -> int:
    if data not in _crcs:
        if len(_crcs) > 50_000:
            _crcs.clear()
        _crcs[data] = crc16(data)
    return _crcs[data]


def header(data: bytes, at: int) -> dict | None:
    """The fields of a Layer III header, None if there is none."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b1, b2, b3 = data[at + 1], data[at + 2], data[at + 3]
    version, layer, bit, rate = b1 >> 3 & 3, b1 >> 1 & 3, b2 >> 4, b2 >> 2 & 3
    if version == 1 or layer != 1 or bit in (0, 15) or rate == 3:
        return None
    kbps, hz, first = BITRATES[1 if version == 3 else 2][bit], RATES[version][rate], version == 3
    mono = b3 >> 6 == 3
    return {
        "length": (144 if first else 72) * kbps * 1000 // hz + (b2 >> 1 & 1),
        "samples": 1152 if first else 576,
        "hz": hz,
        "kbps": kbps,
        "checked": not b1 & 1,
        "side": (17 if mono else 32) if first else (9 if mono else 17),
    }


def _frame(bit: int, body: bytes) -> bytes:
    head = bytes((0xFF, 0xFA, bit << 4 | RATE_INDEX << 2, 0xC0))
    length = 144 * BITRATES[1][bit] * 1000 // RATES[3][RATE_INDEX]
    side = bytes(SIDE)
    return (head + checksum(head[2:] + side).to_bytes(2, "big") + side + body).ljust(length, b"\0")


ROOM = [144 * k * 1000 // RATES[3][RATE_INDEX] - 6 - SIDE for k in BITRATES[1]]


def store(payload: bytes) -> bytes:
    """The payload in frames."""
    top, frames, at = len(ROOM) - 1, [], 0
    while at < len(payload):
        left = len(payload) - at
        bit = top if left >= ROOM[top] else next(i for i in range(1, top + 1) if ROOM[i] >= left)
        frames.append(_frame(bit, payload[at : at + ROOM[bit]]))
        at += ROOM[bit]
    total = sum(map(len, frames))
    ends = [0]
    for f in frames:
        ends.append(ends[-1] + len(f))
    first = ROOM[4] + 6 + SIDE
    toc = bytes(min(255, 256 * (first + ends[len(frames) * i // 100]) // (first + total)) for i in range(100))
    table = _frame(4, b"Xing" + struct.pack(">III", 7, len(frames), first + total) + toc)
    text = b"\x03payload\0" + f"{len(payload)}:{zlib.crc32(payload):08x}".encode()
    tag = b"TXXX" + _safe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + _safe(len(tag)) + tag + table + b"".join(frames)


def _safe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _unsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def parse(data: bytes) -> dict:
    """Tags, variable-bitrate table, frames with offsets, checksum failures and bytes skipped."""
    at, end, tags = 0, len(data), {}
    if data[:3] == b"ID3" and end >= 10:
        stop = min(end, 10 + _unsafe(data[6:10]))
        pos = 10
        while pos + 10 <= stop and data[pos] != 0:
            size = _unsafe(data[pos + 4 : pos + 8]) if data[3] >= 4 else int.from_bytes(data[pos + 4 : pos + 8], "big")
            name, body = data[pos : pos + 4].decode("latin-1"), data[pos + 10 : min(stop, pos + 10 + size)]
            key, _, value = body[1:].partition(b"\0") if name == "TXXX" else (name.encode(), b"", body[1:])
            tags[key.decode("utf-8", "replace")] = value.decode("utf-8", "replace")
            pos += 10 + size
        at = stop
    # an ID3v1 tag counts only where the frames end: payload may look like one
    close = end - 128 if end - at >= 128 and data[end - 128 : end - 125] == b"TAG" else end
    offsets, lengths, kbps, bad, skipped, samples, hz, vbr = [], [], [], 0, 0, 0, 0, None
    while at < end:
        h = header(data, at)
        if h is None and at == close:
            break
        if h is None or at + h["length"] > end or (at + h["length"] not in (close, end) and header(data, at + h["length"]) is None):
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            skipped += nxt - at
            at = nxt
            continue
        body = at + 4 + 2 * h["checked"] + h["side"]
        ok = not h["checked"] or checksum(data[at + 2 : at + 4] + data[at + 6 : body]) == int.from_bytes(data[at + 4 : at + 6], "big")
        bad += not ok
        if not offsets and vbr is None and data[body : body + 4] in (b"Xing", b"Info"):
            flags, pos = int.from_bytes(data[body + 4 : body + 8], "big"), body + 8
            vbr = {}
            for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100)):
                if flags & bit:
                    vbr[name] = data[pos : pos + size] if size > 4 else int.from_bytes(data[pos : pos + size], "big")
                    pos += size
        elif not offsets and vbr is None and data[at + 36 : at + 40] == b"VBRI":
            vbr = vbri(data[at + 36 : at + h["length"]])
        else:
            offsets.append(at)
            lengths.append((body, at + h["length"]))
            kbps.append(h["kbps"])
            samples += h["samples"]
            hz = h["hz"]
        at += h["length"]
    return {"tags": tags, "vbr": vbr, "offsets": offsets, "bodies": lengths, "kbps": kbps, "bad": bad, "skipped": skipped, "samples": samples, "hz": hz, "ms": samples * 1000 / hz if hz else 0.0}


def vbri(table: bytes) -> dict:
    """The other table of variable bitrates: bytes, frames, and the offset of every so many frames; what is cut off is left out."""
    if len(table) < 26:
        return {}
    size, frames, entries, scale, width, step = struct.unpack(">IIHHHH", table[10:26])
    steps = [int.from_bytes(table[26 + i * width : 26 + (i + 1) * width], "big") * scale for i in range(entries) if 26 + (i + 1) * width <= len(table)]
    places = [0]
    for x in steps:
        places.append(places[-1] + x)
    return {"bytes": size, "frames": frames, "seek": places, "frames_a_step": step}


def read_back(data: bytes, info: dict | None = None) -> bytes:
    """The payload of a stored form; raises if its length or checksum is not what the tag says."""
    info = info or parse(data)
    size, _, crc = info["tags"]["payload"].partition(":")
    out = b"".join([data[a:b] for a, b in info["bodies"]])[: int(size)]
    if len(out) != int(size) or zlib.crc32(out) != int(crc, 16) or info["bad"]:
        raise ValueError("the stored frames are damaged")
    return out


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0"), len(raw)


def store_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, media``: every whole text as an MPEG audio stream."""

    def make():
        def fn(_, texts):
            got = [padded(t) for t in texts]
            return [pa.array([n for _, n in got], pa.int64()), pa.array([store(p) for p, _ in got], pa.binary())]

        return fn

    return map_texts(docs, make, "n_bytes bigint, media binary", key, text)


def describe(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, n_frames, samples, duration_ms, offsets, bad_checksums, skipped_bytes`` of a media
    column; null media give no frames."""
    bound_batches(media.sparkSession)
    kind = media.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            got = [parse(m or b"") for m in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(g["offsets"]) for g in got], pa.int64()), pa.array([g["samples"] for g in got], pa.int64()), pa.array([g["ms"] for g in got], pa.float64()), pa.array([g["offsets"] for g in got], pa.list_(pa.int64())), pa.array([g["bad"] for g in got], pa.int64()), pa.array([g["skipped"] for g in got], pa.int64())],
                names=[key, "n_frames", "samples", "duration_ms", "offsets", "bad_checksums", "skipped_bytes"],
            )

    return media.select(key, "media").mapInArrow(run, f"`{key}` {kind}, n_frames bigint, samples bigint, duration_ms double, offsets array<bigint>, bad_checksums bigint, skipped_bytes bigint")


def digests(docs: DataFrame) -> DataFrame:
    """The thin query: stores the media column as a table, reads its bytes back and digests them."""
    spark = docs.sparkSession
    path = shared_dir(spark, "media")
    kind = docs.schema["doc_id"].dataType.simpleString()
    store_documents(docs).write.option("compression", "zstd").parquet(path)
    bound_batches(spark)

    def run(batches):
        for b in batches:
            cols = [[] for _ in range(6)]
            for m in b.column(2).to_pylist():
                info = parse(m)
                p = read_back(m, info)
                steps = f"{info['offsets'][0]}-{info['offsets'][-1]}"
                feature = f"frames={len(info['offsets'])};ms={info['ms']:.3f};kbps={sum(info['kbps']) / len(info['kbps']):.3f};seek={steps};vbr={info['vbr']['frames']};skipped={info['skipped']}"
                for c, x in zip(cols, (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), feature), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, pa.string() if i in (1, 4, 5) else pa.int64()) for i, c in enumerate(cols)]], names=names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    ddl = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return spark.read.parquet(path).select("doc_id", "n_bytes", "media").mapInArrow(run, ddl)
