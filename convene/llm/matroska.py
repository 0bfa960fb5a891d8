"""Media columns: Matroska files in binary columns, parsed into packet tables.

A file is a tree of EBML elements: an id and a size, both of variable length, then the payload.
`parse` walks segments, clusters, block groups and simple blocks, undoes the four lacing modes, and
reads the cues; sizes may be unknown (all ones), in which case an element ends where one that cannot
be its child begins. `mux` writes one PCM track of 8-bit samples.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from convene.llm.common import lean_batches

# Element ids of the Matroska format.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS = 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469
TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

_TOP = {SEGMENT, EBML}
_IN_SEGMENT = {INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS}
#: Elements whose children are read; the value ends one of unknown size.
_MASTERS = {EBML: _TOP, SEGMENT: _TOP, CLUSTER: _IN_SEGMENT | _TOP} | {x: _IN_SEGMENT | _TOP for x in (INFO, TRACKS, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_TRACK_POSITIONS)}

NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

FRAME, FRAMES_IN_BLOCK, BLOCKS_IN_CLUSTER, RATE = 576, 8, 32, 8000


class Malformed(ValueError):
    pass


def read_id(data: bytes, at: int) -> tuple[int, int]:
    """(id with its length marker, next offset)."""
    if at >= len(data) or not data[at]:
        raise Malformed(f"no element id at {at}")
    n = 9 - data[at].bit_length()
    if n > 4 or at + n > len(data):
        raise Malformed(f"bad element id at {at}")
    return int.from_bytes(data[at : at + n], "big"), at + n


def read_size(data: bytes, at: int) -> tuple[int | None, int]:
    """(value without its length marker, next offset); None for the reserved unknown size."""
    if at >= len(data) or not data[at]:
        raise Malformed(f"no size at {at}")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise Malformed(f"size cut off at {at}")
    value = int.from_bytes(data[at : at + n], "big") & ((1 << 7 * n) - 1)
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def size_bytes(value: int, width: int = 0) -> bytes:
    n = width or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(ident: int, payload: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_bytes(len(payload)) + payload


def uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


@dataclass
class Packet:
    track: int
    timestamp: int
    offset: int
    size: int
    keyframe: bool
    lacing: int
    cluster: int
    duration: int | None = None  # in the segment's scale, where the file says it


@dataclass
class Media:
    doc_type: str = ""
    timestamp_scale: int = 1_000_000
    tracks: dict[int, str] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: int = 0


def lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of a block's frames and the offset of the first."""
    if lacing == NO_LACING:
        return [end - at], at
    if at >= end:
        raise Malformed("lace without a count")
    n, at = data[at] + 1, at + 1
    if lacing == FIXED:
        if (end - at) % n:
            raise Malformed("fixed lace of unequal frames")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    if lacing == XIPH:
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise Malformed("lace cut off")
                size, at, more = size + data[at], at + 1, data[at] == 255
                if not more:
                    break
            sizes.append(size)
    elif n > 1:
        for k in range(n - 1):
            start = at
            value, at = read_size(data, at)
            width = at - start
            value = (1 << 7 * width) - 1 if value is None else value
            sizes.append(value if k == 0 else sizes[-1] + value - ((1 << 7 * width - 1) - 1))
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise Malformed("lace larger than its block")
    return [*sizes, last], at


def parse(data: bytes) -> Media:
    """The packet table of a file. Offsets are from the start of the file; timestamps are in the
    segment's scale. Unknown elements are skipped. What a block group says of its block (references,
    duration) counts when the group ends, in whatever order it stands there."""
    media = Media()
    stack: list[list] = []  # [id, end (None: unknown)]
    at, cluster_time, segment_start = 0, 0, 0
    duration: dict[int, int] = {}
    track: dict[int, object] = {}
    cue: dict[int, int] = {}
    group: dict[int, int] = {}  # fields of the open block group
    first = 0  # its first packet

    def close(done: int) -> None:
        if done == TRACK_ENTRY:
            number = int(track.get(TRACK_NUMBER, 0))
            media.tracks[number] = str(track.get(CODEC_ID, ""))
            duration[number] = int(track.get(DEFAULT_DURATION, 0))
        elif done == CUE_POINT:
            media.cues.append((cue.get(CUE_TIME, 0), cue.get(CUE_TRACK, 0), cue.get(CUE_CLUSTER_POSITION, 0) + segment_start))
        elif done == BLOCK_GROUP:
            frames = media.packets[first:]
            whole, begin = group.get(BLOCK_DURATION), frames[0].timestamp if frames else 0
            for k, p in enumerate(frames):
                p.keyframe = REFERENCE_BLOCK not in group
                if whole is not None:  # a lace's frames share the block's duration
                    p.timestamp = begin + whole * k // len(frames)
                    p.duration = begin + whole * (k + 1) // len(frames) - p.timestamp

    while True:
        while stack and stack[-1][1] is not None and at >= stack[-1][1]:
            close(stack.pop()[0])
        if at >= len(data):
            while stack:
                close(stack.pop()[0])
            return media
        ident, start = read_id(data, at)
        while stack and stack[-1][1] is None and ident in _MASTERS.get(stack[-1][0], ()):
            close(stack.pop()[0])
        size, start = read_size(data, start)
        if size is None and ident not in _MASTERS:
            raise Malformed(f"unknown size of element {ident:x}")
        end = None if size is None else start + size
        limit = next((x[1] for x in reversed(stack) if x[1] is not None), len(data))
        if end is not None and end > limit:
            raise Malformed(f"element {ident:x} at {at} runs past its parent")
        if ident in _MASTERS:
            stack.append([ident, end])
            if ident == SEGMENT:
                segment_start = start
            elif ident == CLUSTER:
                media.clusters += 1
                cluster_time = 0
            elif ident == TRACK_ENTRY:
                track = {}
            elif ident == CUE_POINT:
                cue = {}
            elif ident == BLOCK_GROUP:
                group, first = {}, len(media.packets)
            at = start
            continue
        if ident in (SIMPLE_BLOCK, BLOCK):
            number, body = read_size(data, start)
            if number is None or body + 3 > end:
                raise Malformed(f"block cut off at {at}")
            relative, flags = int.from_bytes(data[body : body + 2], "big", signed=True), data[body + 2]
            lacing = flags >> 1 & 3
            sizes, frame = lace_sizes(data, body + 3, end, lacing)
            step = duration.get(number, 0) / media.timestamp_scale
            for k, length in enumerate(sizes):
                media.packets.append(Packet(number, cluster_time + relative + round(k * step), frame, length, bool(flags & 128), lacing, media.clusters - 1, round((k + 1) * step) - round(k * step) if step else None))
                frame += length
        elif ident == CLUSTER_TIMESTAMP:
            cluster_time = int.from_bytes(data[start:end], "big")
        elif ident in (REFERENCE_BLOCK, BLOCK_DURATION):
            group[ident] = int.from_bytes(data[start:end], "big")
        elif ident == DOC_TYPE:
            media.doc_type = data[start:end].decode("ascii", "replace").rstrip("\0")
        elif ident == TIMESTAMP_SCALE:
            media.timestamp_scale = int.from_bytes(data[start:end], "big") or 1
        elif ident in (TRACK_NUMBER, DEFAULT_DURATION):
            track[ident] = int.from_bytes(data[start:end], "big")
        elif ident == CODEC_ID:
            track[ident] = data[start:end].decode("ascii", "replace").rstrip("\0")
        elif ident in (CUE_TIME, CUE_TRACK, CUE_CLUSTER_POSITION):
            cue[ident] = int.from_bytes(data[start:end], "big")
        at = end


def lace(frames: list[bytes], lacing: int) -> bytes:
    """A block's lace header and frames."""
    if lacing == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == XIPH:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif lacing == EBML_LACING:
        for k, s in enumerate(sizes[:-1]):
            if not k:
                head += size_bytes(s)
            else:
                step = s - sizes[k - 1]
                n = next(n for n in range(1, 9) if abs(step) < (1 << 7 * n - 1) - 1)
                head += size_bytes(step + (1 << 7 * n - 1) - 1, n)
    return head + b"".join(frames)


_HEAD = element(
    EBML,
    uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(EBML_MAX_ID, 4) + uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ_VERSION, 2),
)
_INFO = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"-") + element(WRITING_APP, b"-"))
_TRACKS = element(
    TRACKS,
    element(
        TRACK_ENTRY,
        uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + uint(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + element(CODEC_ID, b"A_PCM/INT/LIT")
        + element(AUDIO, element(SAMPLING, bytes.fromhex("45fa0000")) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8)),
    ),
)


def mux(payload: bytes) -> bytes:
    """A file whose one track's packets are the payload in frames of 576 samples of 8 bits. Blocks
    hold up to eight frames in a fixed lace; the three laces take turns by cluster."""
    block_bytes = FRAME * FRAMES_IN_BLOCK
    clusters, cues, at = [], [], len(_INFO) + len(_TRACKS)
    for c, start in enumerate(range(0, len(payload), block_bytes * BLOCKS_IN_CLUSTER)):
        ms = start * 1000 // RATE
        body = [uint(CLUSTER_TIMESTAMP, ms)]
        lacing = (FIXED, EBML_LACING, XIPH)[c % 3]
        for i in range(start, min(len(payload), start + block_bytes * BLOCKS_IN_CLUSTER), block_bytes):
            frames = [payload[k : k + FRAME] for k in range(i, min(len(payload), i + block_bytes), FRAME)]
            kind = lacing if len(frames) > 1 else NO_LACING
            body.append(element(SIMPLE_BLOCK, b"\x81" + (i * 1000 // RATE - ms).to_bytes(2, "big", signed=True) + bytes([128 | kind << 1]) + lace(frames, kind)))
        clusters.append(element(CLUSTER, b"".join(body)))
        cues.append(element(CUE_POINT, uint(CUE_TIME, ms) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        at += len(clusters[-1])
    return _HEAD + element(SEGMENT, _INFO + _TRACKS + b"".join(clusters) + element(CUES, b"".join(cues)))


def payload_of(text: str | None, unit: int = FRAME) -> bytes:
    """UTF-8 of a text, filled with bytes 255 to a positive multiple of `unit`."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


def mux_texts(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """df with a text column stored as a Matroska file in a binary column; other columns stay, but
    one named like the new column is replaced."""
    keep = [c for c in df.columns if c != media]
    out = pa_schema(df, keep).append(pa.field(media, pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                files = pa.array([mux(payload_of(t)) for t in part.column(text).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), files], schema=out)

    return lean_batches(df).select(*keep).mapInArrow(run, df.select(*keep).schema.add(media, "binary"))


def pa_schema(df: DataFrame, columns: list[str]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.select(*columns).schema)


_PACKETS = "packet int, track int, timestamp_ms double, duration_ms double, offset long, size long, keyframe boolean, lacing int, cluster int, cued boolean"


def packets(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """One row for each packet of each file: key, its number in the file, track, timestamp, duration
    (null where the file says none), byte range, key frame flag, lacing, cluster, and whether a cue points
    at its cluster. Packets of one timestamp keep the file's order. A null or empty file has none; a file
    that is not well formed gives one row with only the key; repeated rows give repeated packets."""
    kinds = ["int32", "int32", "float64", "float64", "int64", "int64", "bool", "int32", "int32", "bool"]
    key_type = pa_schema(df, [key]).field(0)
    schema = pa.schema([key_type, *(pa.field(c.split()[0], pa.type_for_alias(k)) for c, k in zip(_PACKETS.split(", "), kinds))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found = parse(data or b"")
                except Malformed:
                    yield pa.RecordBatch.from_pylist([{key: k}], schema=schema)
                    continue
                scale, cued = found.timestamp_scale / 1e6, {t for t, _, _ in found.cues}
                first: dict[int, int] = {}
                for p in found.packets:
                    first.setdefault(p.cluster, p.timestamp)
                rows = [(k, i, p.track, p.timestamp * scale, None if p.duration is None else p.duration * scale, p.offset, p.size, p.keyframe, p.lacing, p.cluster, first[p.cluster] in cued) for i, p in enumerate(found.packets)]
                for i in range(0, len(rows), 8192):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 8192]), schema)], schema=schema)

    return lean_batches(df).select(key, media).mapInArrow(run, ", ".join([f"`{key}` {df.schema[key].dataType.simpleString()}", _PACKETS]))


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_DIGEST_SCHEMA = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _DIGEST.split(", ")])


def feature(data: bytes, media: Media) -> str:
    """What a packet table says of a file, in one line: counts, time span, and a CRC-32 over every
    packet's track, timestamp, byte range and flags."""
    table = ";".join(f"{p.track},{p.timestamp},{p.offset},{p.size},{p.keyframe:d},{p.lacing}" for p in media.packets)
    last = media.packets[-1].timestamp if media.packets else 0
    return f"tracks={len(media.tracks)} packets={len(media.packets)} clusters={media.clusters} cues={len(media.cues)} last={last} table={zlib.crc32(table.encode()):08x}"


def digests(docs: DataFrame) -> DataFrame:
    """Store each document's text (doc_id, text; null: empty) as a Matroska file, read the stored
    bytes back through the packet table, and digest both. Texts of any length are stored whole; equal
    texts, and repeated rows, get equal values; other columns are ignored; an empty table gives no row."""

    def row(doc_id: int | None, text: str | None) -> tuple:
        n = len((text or "").encode("utf-8", "surrogatepass"))
        stored = mux(payload_of(text))
        media = parse(stored)
        view = memoryview(stored)
        back = b"".join(view[p.offset : p.offset + p.size] for p in media.packets)
        return doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(stored, media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = [row(d, t) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _DIGEST_SCHEMA)], schema=_DIGEST_SCHEMA)

    return lean_batches(docs).select("doc_id", "text").mapInArrow(run, _DIGEST)
