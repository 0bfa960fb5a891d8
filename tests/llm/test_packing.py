import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from convene.llm import packing

SCHEMA = "doc_id long, text string, grp string"


def test_encode_equals_the_tokenizer():
    path = packing.public_byte_bpe()
    t = Tokenizer.from_file(path)
    rng = random.Random(3)
    alphabet = ["a", "B", "é", "ß", " ", "  ", "\n", "\r\n", "\t", "'s", "'re", "1", "²", "¾", "!", "¿", "\x1c", "\x85", "\xa0", "中", "<|endoftext|>", "​", "😀", "ǅ", "ɏ", "ª"]
    texts = ["", "plain words, 'twas 12 o'clock\n\n  x"] + ["".join(rng.choices(alphabet, k=rng.randint(1, 30))) for _ in range(3000)]
    for text, ids in zip(texts, packing.encode(path, texts)):
        assert np.frombuffer(ids, "<u2").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_first_bin_with_room():
    tree = packing.RoomTree(5, 10)
    assert [tree.take(x) for x in (7, 6, 3, 4, 10, 10)] == [0, 1, 0, 1, 2, 3]


@pytest.mark.parametrize("n", [0, 1, 2, 57])
def test_pack_covers_each_id_once_and_fills(n):
    rng = random.Random(n)
    sizes = [rng.choice([0, 1, 5, 99, 100, 63]) for _ in range(n)]
    seen, bins = {}, {}
    for item, start, size, b, at in packing.pack(sizes, 100):
        assert size > 0
        for k in range(size):
            assert (item, start + k) not in seen
            seen[item, start + k] = 1
            assert (b, at + k) not in bins
            bins[b, at + k] = 1
    assert len(seen) == sum(sizes)
    fills = [sum(1 for x, _ in bins if x == b) for b in {b for b, _ in bins}]
    assert sum(f < 100 for f in fills) <= 1 and all(f <= 100 for f in fills)
    assert set(bins) == {(b, k) for b in {x for x, _ in bins} for k in range(sum(1 for x, _ in bins if x == b))}


def test_documents_round_trip(spark):
    texts = [None, "", "one", "word " * 3000, "same text", "same text", "é" * 5000]
    rows = [(i if i != 4 else None, t, "x") for i, t in enumerate(texts)] + [(2, "one", None)] * 3
    df = spark.createDataFrame(rows, SCHEMA)
    got = packing.pack_documents(df, packing.public_byte_bpe, group_docs=3).collect()
    t = Tokenizer.from_file(packing.public_byte_bpe())
    want = {}
    for d, text, _ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want.setdefault((d, len(ids)), []).append(ids)
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert set(by) == set(want)
    for key, copies in want.items():
        ids = np.array(copies[0], "<u4")
        assert sum(r.length for r in by[key]) == sum(map(len, copies))
        for r in by[key]:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert packing.pack_documents(df, packing.public_byte_bpe).count() == 0


def test_placement_by_naive_first_fit():
    """The tree's first bin with room is the one that a plain search from the left finds."""
    rng = random.Random(4)
    for _ in range(200):
        n, length = rng.randint(1, 60), rng.choice([10, 100, 1024])
        sizes = sorted((rng.randint(1, length) for _ in range(n)), reverse=True)
        room, tree = [length] * n, packing.RoomTree(n, length)
        for size in sizes:
            want = next(b for b in range(n) if room[b] >= size)
            room[want] -= size
            assert tree.take(size) == want


def test_equal_rows_in_any_order(spark):
    """A task that runs again with its rows in another order deals them out alike."""
    rows = [(i % 40, f"text {i % 40} " * (i % 7), None) for i in range(400)] + [(1, "copy", None)] * 300
    key = lambda df: sorted(tuple(r) for r in packing.pack_documents(df, packing.public_byte_bpe, group_docs=50).collect())
    one = key(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    random.Random(5).shuffle(rows)
    assert key(spark.createDataFrame(rows, SCHEMA).coalesce(1)) == one


def test_large_vocabularies_are_refused(tmp_path):
    from tokenizers.models import BPE

    path = str(tmp_path / "large.json")
    Tokenizer(BPE({f"t{i}": i for i in range(70_000)}, [])).save(path)
    with pytest.raises(ValueError, match="65,536"):
        packing.Encoder(path)


def test_very_long_text(spark):
    text = " ".join(f"word{i % 977}" for i in range(250_000))
    got = packing.pack_documents(spark.createDataFrame([(1, text, None), (2, "short", None)], SCHEMA), packing.public_byte_bpe).collect()
    ids = np.array([*Tokenizer.from_file(packing.public_byte_bpe()).encode(text, add_special_tokens=False).ids, 0], "<u4")
    mine = sorted((r.start, r.length, r.ids_crc32) for r in got if r.doc_id == 1)
    assert sum(n for _, n, _ in mine) == len(ids)
    assert all(zlib.crc32(ids[s : s + n].tobytes()) == crc for s, n, crc in mine)
