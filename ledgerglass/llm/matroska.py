"""Matroska media columns: a muxer for lossless 8-bit samples and a parser that turns any Matroska bytes into packet tables.

The parser reads variable-length EBML elements (unknown sizes too), clusters, simple blocks and block groups, all four
lacings (none, Xiph, fixed, EBML) and cues. Packets carry track, timestamp, byte offset and byte size, so a frame is read
from its byte range alone. Bytes that are no Matroska give no packets and a message in `error`; null media is the same.

The muxer pads a payload with bytes 0 to a positive multiple of 64 and stores it as one 8 kHz mono PCM track.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, settle, small_batches, texts_of

# Element ids of the format (fixed values).
EBML, VERSION, READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACKS, TRACK, NUMBER, UID, KIND, LACING_FLAG, CODEC, AUDIO, RATE, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, GROUP, BLOCK, REFERENCE, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB, 0x9B
CUES, CUE, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP = {CLUSTER, CUES, TRACKS, INFO, SEGMENT, EBML, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}

FRAME, LACED, BLOCKS, PER_MS = 512, 8, 16, 8
STORED = "doc_id bigint, n_bytes bigint, media binary"
SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, packets bigint, clusters bigint, cues bigint"
PACKETS = "doc_id bigint, packet bigint, track bigint, timestamp bigint, byte_offset bigint, byte_size bigint, keyframe boolean, lacing int, error string"


def size_field(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(key: int, data: bytes) -> bytes:
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + size_field(len(data)) + data


def number(key: int, value: int) -> bytes:
    return element(key, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], at: int) -> bytes:
    """A simple block of track 1, at a timestamp relative to its cluster: fixed lacing for equal sizes, else EBML lacing."""
    head = b"\x81" + struct.pack(">h", at)
    if len(frames) == 1:
        return element(SIMPLE_BLOCK, head + b"\x80" + frames[0])
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return element(SIMPLE_BLOCK, head + bytes([0x84, len(frames) - 1]) + b"".join(frames))
    coded = size_field(sizes[0])
    for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
        width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
        coded += size_field(b - a + (1 << 7 * width - 1) - 1, width)
    return element(SIMPLE_BLOCK, head + bytes([0x86, len(frames) - 1]) + coded + b"".join(frames))


HEAD = element(EBML, number(VERSION, 1) + number(READ_VERSION, 1) + number(MAX_ID, 4) + number(MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2))
TRACK_TABLE = element(TRACKS, element(TRACK, number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + number(LACING_FLAG, 1) + number(DEFAULT_DURATION, FRAME // PER_MS * 1_000_000) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, element(RATE, struct.pack(">d", 8000.0)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))))


def pad(raw: bytes) -> bytes:
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def mux(payload: bytes) -> bytes:
    """A whole file for a payload whose length is a multiple of 64."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) / PER_MS)) + element(MUXING_APP, b"packets") + element(WRITING_APP, b"packets"))
    body, cues, step = [info, TRACK_TABLE], [], FRAME // PER_MS
    place = len(info) + len(TRACK_TABLE)
    for first in range(0, len(frames), LACED * BLOCKS):
        some, begin = frames[first : first + LACED * BLOCKS], first * step
        cluster = element(CLUSTER, number(TIMESTAMP, begin) + b"".join(lace(some[i : i + LACED], i * step) for i in range(0, len(some), LACED)))
        cues.append(element(CUE, number(CUE_TIME, begin) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, place))))
        body.append(cluster)
        place += len(cluster)
    return HEAD + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


@dataclass
class Media:
    """What a file holds: packets are (track, timestamp, offset, size, keyframe, lacing); cues are (time, track, cluster offset)."""

    packets: list[tuple[int, int, int, int, bool, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    tracks: list[dict[str, object]] = field(default_factory=list)
    scale: int = 1_000_000
    duration: float = 0.0
    frame_ns: dict[int, int] = field(default_factory=dict)

    def add(self, track: int, timestamp: int, keyframe: bool, lacing: int, ranges: list[tuple[int, int]]) -> None:
        """Frames of one block; those of a lace follow each other by the track's frame duration, if it has one."""
        step = self.frame_ns.get(track, 0)
        self.packets += [(track, timestamp + k * step // self.scale, at, size, keyframe, lacing) for k, (at, size) in enumerate(ranges)]


def vint(data: bytes, at: int, keep: bool) -> tuple[int, int]:
    """A variable-length number and where it ends; -1 is the unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no element at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"cut off at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if not keep:
        value -= 1 << 7 * width
        if value == (1 << 7 * width) - 1:
            value = -1
    return value, at + width


def elements(data: bytes, at: int, end: int, inside: int = 0):
    """(id, where it begins, where its data begins, where its data ends) of each element; one of unknown size ends before the next of a higher level."""
    while at < end:
        begin = at
        key, at = vint(data, at, True)
        size, at = vint(data, at, False)
        if size < 0:
            if key not in (SEGMENT, CLUSTER):
                raise ValueError(f"unknown size at byte {begin}")
            stop = end if key == SEGMENT else next((b for k, b, *_ in elements(data, at, end, CLUSTER) if k in TOP), end)
        else:
            stop = at + size
        if stop > end:
            raise ValueError(f"element at byte {begin} is cut off")
        yield key, begin, at, stop
        if inside == CLUSTER and key in TOP:
            return
        at = stop


def unsigned(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def real(data: bytes, a: int, b: int) -> float:
    return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b > a else 0.0


def block(data: bytes, a: int, b: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative timestamp, flags, and the byte range (offset, size) of each laced frame."""
    track, at = vint(data, a, False)
    if at + 3 > b:
        raise ValueError(f"block at byte {a} is cut off")
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = flags >> 1 & 3
    if not lacing:
        return track, relative, flags, [(at, b - at)]
    count, at = data[at] + 1, at + 1
    if lacing == 2:
        if (b - at) % count:
            raise ValueError(f"fixed lacing at byte {a} does not divide")
        sizes = [(b - at) // count] * count
    else:
        sizes = []
        for k in range(count - 1):
            if lacing == 1:
                size = 0
                while data[at] == 255:
                    size, at = size + 255, at + 1
                size, at = size + data[at], at + 1
            else:
                first = at
                size, at = vint(data, at, False)
                if k:
                    size += sizes[-1] - ((1 << 7 * (at - first) - 1) - 1)
            sizes.append(size)
        sizes.append(b - at - sum(sizes))
        if min(sizes) < 0:
            raise ValueError(f"lacing at byte {a} is longer than its block")
    ranges = []
    for size in sizes:
        ranges.append((at, size))
        at += size
    return track, relative, flags, ranges


def parse(data: bytes) -> Media:
    out = Media()
    top = list(elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise ValueError("no EBML head")
    for key, _, a, b in top:
        if key != SEGMENT:
            continue
        for part, begin, c, d in elements(data, a, b):
            if part == INFO:
                for k, _, e, f in elements(data, c, d):
                    if k == TIMESTAMP_SCALE:
                        out.scale = unsigned(data, e, f)
                    elif k == DURATION:
                        out.duration = real(data, e, f)
            elif part == TRACKS:
                for k, _, e, f in elements(data, c, d):
                    if k == TRACK:
                        own = {x: (y, z) for x, _, y, z in elements(data, e, f)}
                        if DEFAULT_DURATION in own:
                            out.frame_ns[unsigned(data, *own[NUMBER])] = unsigned(data, *own[DEFAULT_DURATION])
                        out.tracks.append({"number": unsigned(data, *own.get(NUMBER, (0, 0))), "kind": unsigned(data, *own.get(KIND, (0, 0))), "codec": data[slice(*own.get(CODEC, (0, 0)))].decode("ascii", "replace")})
            elif part == CLUSTER:
                out.clusters.append(begin)
                read_cluster(data, c, d, out)
            elif part == CUES:
                for k, _, e, f in elements(data, c, d):
                    if k == CUE:
                        own = {x: (y, z) for x, _, y, z in elements(data, e, f)}
                        for x, _, y, z in elements(data, e, f):
                            if x == CUE_POSITIONS:
                                at = {p: (q, r) for p, _, q, r in elements(data, y, z)}
                                out.cues.append((unsigned(data, *own.get(CUE_TIME, (0, 0))), unsigned(data, *at.get(CUE_TRACK, (0, 0))), a + unsigned(data, *at.get(CUE_CLUSTER, (0, 0)))))
    return out


def read_cluster(data: bytes, a: int, b: int, out: Media) -> None:
    base = 0
    for key, _, c, d in elements(data, a, b):
        if key == TIMESTAMP:
            base = unsigned(data, c, d)
        elif key == SIMPLE_BLOCK:
            track, relative, flags, ranges = block(data, c, d)
            out.add(track, base + relative, bool(flags & 0x80), flags >> 1 & 3, ranges)
        elif key == GROUP:
            own = {x: (y, z) for x, _, y, z in elements(data, c, d)}
            if BLOCK in own:
                track, relative, flags, ranges = block(data, *own[BLOCK])
                out.add(track, base + relative, REFERENCE not in own, flags >> 1 & 3, ranges)


def features(payload: bytes, media: Media) -> str:
    """Of the samples read back: root mean square and crossings around the middle, loudest packet, duration."""
    samples = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    power = int((samples.astype(np.int64) ** 2).sum())
    crossings = int(((samples[1:] >= 0) != (samples[:-1] >= 0)).sum())
    peak = int(np.abs(samples).max()) if len(samples) else 0
    return f"ms={len(samples) // PER_MS};rms={(power / max(1, len(samples))) ** 0.5:.4f};crossings={crossings};peak={peak};packets={len(media.packets)};clusters={len(media.clusters)}"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (a Matroska file for every text; null is empty)."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = [t.encode("utf-8") for t in texts_of(batch)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([mux(pad(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

        return apply

    small_batches(docs.sparkSession)
    return map_batches(docs.select("doc_id", "text"), make, STORED)


def packet_table(media: DataFrame) -> DataFrame:
    """A row for each packet of each file of (doc_id, media); a file that can't be read gives one row with an error."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: list = []
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [(doc_id, k, *p, None) for k, p in enumerate(parse(data or b"").packets)]
                except (ValueError, IndexError, struct.error) as e:
                    rows.append((doc_id, None, None, None, None, None, None, None, str(e)))
            kinds = [pa.int64()] * 6 + [pa.bool_(), pa.int32(), pa.string()]
            names = ["doc_id", "packet", "track", "timestamp", "byte_offset", "byte_size", "keyframe", "lacing", "error"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)], names)

        return apply

    small_batches(media.sparkSession)
    return map_batches(media.select("doc_id", "media"), make, PACKETS)


def read_back(media: DataFrame) -> DataFrame:
    """Parse stored files, join their packets to the payload, and describe both (columns of SCHEMA)."""

    def make():
        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for doc_id, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = parse(data)
                payload = b"".join([data[x : x + size] for _, _, x, size, _, _ in found.packets])
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), features(payload, found), len(found.packets), len(found.clusters), len(found.cues)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        return apply

    small_batches(media.sparkSession)
    return map_batches(media.select("doc_id", "n_bytes", "media"), make, SCHEMA)


def round_trip(docs: DataFrame) -> DataFrame:
    return read_back(settle(store(docs), "media", "zstd"))
