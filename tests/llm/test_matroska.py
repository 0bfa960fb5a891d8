import hashlib
import random
import zlib

import pytest

from convene.llm import matroska as m


def test_sizes():
    for v in [0, 1, 126, 127, 128, 16382, 16383, 2**21, 2**35, 2**49]:
        assert m.read_size(m.size_bytes(v), 0) == (v, len(m.size_bytes(v)))
    assert m.read_size(b"\xff", 0) == (None, 1)
    assert m.read_size(b"\x01" + b"\xff" * 7, 0) == (None, 8)


@pytest.mark.parametrize("lacing", [m.NO_LACING, m.XIPH, m.FIXED, m.EBML_LACING])
def test_lacing_round_trip(lacing):
    rng = random.Random(lacing)
    for _ in range(200):
        n = 1 if lacing == m.NO_LACING else rng.randint(1, 20)
        same = rng.randint(0, 600)
        frames = [rng.randbytes(same if lacing == m.FIXED else rng.choice([0, 1, 254, 255, 256, 510, rng.randint(0, 5000)])) for _ in range(n)]
        block = b"pad" + m.lace(frames, lacing)
        sizes, at = m.lace_sizes(block, 3, len(block), lacing)
        assert sizes == [len(f) for f in frames]
        assert block[at:] == b"".join(frames)


def test_known_bytes():
    """Assembled by hand: unknown sizes, a void element, a block group, two tracks."""
    entry = lambda n: m.element(m.TRACK_ENTRY, m.uint(m.TRACK_NUMBER, n) + m.element(m.CODEC_ID, b"X%d" % n))
    cluster = bytes.fromhex("1f43b675") + b"\xff" + m.uint(m.CLUSTER_TIMESTAMP, 1000)
    cluster += m.element(0xEC, b"\0\0\0") + m.element(m.SIMPLE_BLOCK, b"\x81\x00\x05\x80abc")
    cluster += m.element(m.BLOCK_GROUP, m.element(m.BLOCK, b"\x82\xff\xff\x00defg") + m.element(m.REFERENCE_BLOCK, b"\xff"))
    second = m.element(m.CLUSTER, m.uint(m.CLUSTER_TIMESTAMP, 2000) + m.element(m.SIMPLE_BLOCK, b"\x81\x00\x00\x00hi"))
    data = m._HEAD + bytes.fromhex("18538067") + b"\x01" + b"\xff" * 7 + m.element(m.TRACKS, entry(1) + entry(2)) + cluster + second
    got = m.parse(data)
    assert got.doc_type == "matroska" and got.tracks == {1: "X1", 2: "X2"} and got.clusters == 2
    assert [(p.track, p.timestamp, data[p.offset : p.offset + p.size], p.keyframe, p.cluster) for p in got.packets] == [
        (1, 1005, b"abc", True, 0),
        (2, 999, b"defg", False, 0),
        (1, 2000, b"hi", False, 1),
    ]


def test_malformed():
    good = m.mux(m.payload_of("x" * 3000))
    for bad in (good[:-1], good[: len(good) // 2], b"\0\0", b"\x1a\x45\xdf\xa3"):
        with pytest.raises(m.Malformed):
            m.parse(bad)
    assert m.parse(b"").packets == []


def test_digests(spark):
    texts = [None, "", "a" * 576, "b" * 577, "é" * 700_000, "b" * 577, "tail\0\x01"]
    df = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    got = {r.doc_id: r for r in m.digests(df).collect()}
    for i, t in enumerate(texts):
        raw, r = m.payload_of(t), got[i if i else None]
        assert len(raw) % 576 == 0 and raw
        assert (r.n_bytes, r.payload_bytes) == (len((t or "").encode()), len(raw))
        assert r.payload_sha256 == hashlib.sha256(raw).hexdigest() and r.tail_crc32 == zlib.crc32(raw[-32:])
        assert r.media_sha256 == hashlib.sha256(m.mux(raw)).hexdigest()
    assert got[3][1:] == got[5][1:]
    assert m.digests(df.limit(0)).count() == 0


def test_packet_table(spark):
    df = spark.createDataFrame([(1, "x" * 700_000), (2, None), (2, "y")], "doc_id long, text string")
    files = m.mux_texts(df)
    rows = m.packets(files, "doc_id").collect()
    stored = {(r.doc_id, r.text): r.media for r in files.collect()}
    one = sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.packet)
    data = stored[1, "x" * 700_000]
    assert b"".join(data[r.offset : r.offset + r.size] for r in one) == m.payload_of("x" * 700_000)
    assert {r.lacing for r in one} == {1, 2, 3} and all(r.cued and r.keyframe for r in one)
    assert [r.timestamp_ms for r in one] == sorted(r.timestamp_ms for r in one)
    assert sum(r.doc_id == 2 for r in rows) == 2
    broken = spark.createDataFrame([(7, b"\0bad")], "doc_id long, media binary")
    assert [tuple(r)[:2] for r in m.packets(broken, "doc_id").collect()] == [(7, None)]


def walk(data, at, end):
    """(id, start, end) of the elements in a byte range, by nothing of the module's: sizes are known."""
    while at < end:
        width = next(n for n in range(1, 5) if data[at] >> (8 - n) == 1)
        ident, at = int.from_bytes(data[at : at + width], "big"), at + width
        width = next(n for n in range(1, 9) if data[at] >> (8 - n) == 1)
        size, at = int.from_bytes(data[at : at + width], "big") - (1 << 7 * width), at + width
        yield ident, at, at + size
        at += size


def decoded(data):
    """Frames in order, by a second decoder: (cluster's and block's time, offset, bytes)."""
    out = []
    for ident, a, b in walk(data, 0, len(data)):
        for inner, c, d in walk(data, a, b) if ident == 0x18538067 else ():
            if inner != 0x1F43B675:
                continue
            parts = list(walk(data, c, d))
            time = next(int.from_bytes(data[x:y], "big") for i, x, y in parts if i == 0xE7)
            for i, x, y in parts:
                if i != 0xA3:
                    continue
                when, kind, at = time + int.from_bytes(data[x + 1 : x + 3], "big", signed=True), data[x + 3] & 6, x + 4
                sizes = []
                if kind:
                    n, at = data[at] + 1, at + 1
                    for k in range(n - 1 if kind != 4 else 0):
                        if kind == 2:
                            size = 0
                            while data[at] == 255:
                                size, at = size + 255, at + 1
                            size, at = size + data[at], at + 1
                        else:
                            width = 9 - data[at].bit_length()
                            raw = int.from_bytes(data[at : at + width], "big") - (1 << 7 * width)
                            size, at = (raw if not k else sizes[-1] + raw - (1 << 7 * width - 1) + 1), at + width
                        sizes.append(size)
                    sizes = [(y - at) // n] * n if kind == 4 else [*sizes, y - at - sum(sizes)]
                for size in sizes or [y - at]:
                    out.append((when, at, data[at : at + size]))
                    at += size
    return out


@pytest.mark.parametrize("n", [1, 576, 577, 5000, 576 * 8 * 32 - 1, 576 * 8 * 32 * 4 + 9])
def test_files_by_a_second_decoder(n):
    text = "".join(random.Random(n).choices("ab é", k=n))
    raw, stored = m.payload_of(text), m.mux(m.payload_of(text))
    frames, got = decoded(stored), m.parse(stored)
    assert b"".join(f for _, _, f in frames) == raw and all(len(f) == 576 for _, _, f in frames)
    assert [(p.offset, p.size) for p in got.packets] == [(at, len(f)) for _, at, f in frames]
    assert [p.timestamp for p in got.packets][::8] == [t for t, _, _ in frames][::8]  # a block's first frame has its time
    table = ";".join(f"1,{p.timestamp},{at},{len(f)},1,{p.lacing}" for p, (_, at, f) in zip(got.packets, frames))
    clusters = len({p.cluster for p in got.packets})
    assert m.feature(stored, got) == f"tracks=1 packets={len(frames)} clusters={clusters} cues={clusters} last={got.packets[-1].timestamp} table={zlib.crc32(table.encode()):08x}"


def _segment(*body):
    cluster = m.element(m.CLUSTER, m.uint(m.CLUSTER_TIMESTAMP, 100) + b"".join(body))
    return m._HEAD + m.element(m.SEGMENT, m.element(m.TRACKS, m.element(m.TRACK_ENTRY, m.uint(m.TRACK_NUMBER, 1))) + cluster)


def test_block_groups():
    laced = m.element(m.SIMPLE_BLOCK, b"\x81\x00\x00" + bytes([128 | m.XIPH << 1]) + m.lace([b"a", b"bb"], m.XIPH))
    block = m.element(m.BLOCK, b"\x81\x00\x0a\x00ccc")
    reference, lasting = m.element(m.REFERENCE_BLOCK, b"\xff"), m.uint(m.BLOCK_DURATION, 7)
    for inside in (block + reference + lasting, reference + lasting + block, lasting + block + reference):
        got = m.parse(_segment(laced, m.element(m.BLOCK_GROUP, inside), laced)).packets
        assert [(p.timestamp, p.keyframe, p.duration) for p in got] == [(100, True, None)] * 2 + [(110, False, 7)] + [(100, True, None)] * 2
    three = m.element(m.BLOCK, b"\x81\x00\x0a" + bytes([m.XIPH << 1]) + m.lace([b"c", b"d", b"e"], m.XIPH))
    got = m.parse(_segment(m.element(m.BLOCK_GROUP, reference + block), m.element(m.BLOCK_GROUP, m.uint(m.BLOCK_DURATION, 8) + three))).packets
    assert [(p.timestamp, p.keyframe, p.duration) for p in got] == [(110, False, None), (110, True, 2), (112, True, 3), (115, True, 3)]


def test_very_long_text(spark):
    text = "long " * 1_000_000
    row = m.digests(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.payload_sha256 == hashlib.sha256(m.payload_of(text)).hexdigest()
