"""Packing token sequences: first-fit decreasing on a tournament tree, in random groups of documents.

A document's ids end with an end id. Runs of `length` ids fill sequences of their own; what is left
over (under `length` ids) goes, longest first, into the first bin with room. A tournament tree holds
each bin's room, every inner node the larger of its two; the first bin with enough room is found by
one descent. First-fit leaves some room, so the emptiest bins are then dissolved, their ids cut to
fill the others' gaps: at most one sequence of a group is not full.

Groups are independent tasks of about `group_docs` documents, drawn by a hash of the document's id, its
ids, the input split, and a number that tells rows alike in a split apart. So copies don't gather in one
group, and a task that runs again, its rows in whatever order, sends them where they went before.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from convene.llm.common import lean_batches, mix

GROUP_DOCS = 4096

#: What sends a text to the tokenizer itself: characters beyond ASCII and Latin letters (libraries may
#: class them by different Unicode versions), what may be a special token, and very long words.
_UNUSUAL = re.compile("[^\t\n\r -~\xa1-ɏ]|<\\||[^ \n]{500}")


class Encoder:
    """Ids of texts as little-endian 16-bit integers (the vocabulary has under 65,536).

    Ordinary texts go through tiktoken, given the merges of the tokenizer's own file; that takes a
    third of the time for the same ids. Unusual texts go to the tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError(f"{path} has more than 65,536 ids, which are kept in 16 bits")
        specials = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        byte = _bytes_by_letter()
        ranks = {bytes(byte[c] for c in token): i for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items() if token not in specials}
        self.ordinary = tiktoken.Encoding("from-file", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: list[str]) -> list[bytes]:
        numpy, plain = self.ordinary.encode_to_numpy, self.tokenizer.encode
        return [
            np.array(plain(t, add_special_tokens=False).ids, "<u2").tobytes() if _UNUSUAL.search(t) else numpy(t, disallowed_special=()).astype("<u2").tobytes()
            for t in texts
        ]


# Fixed value: the pretoken pattern of byte-level BPE.
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _bytes_by_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, others from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(path: str, texts: list[str]) -> list[bytes]:
    return _encoder(path)(texts)


class RoomTree:
    """A tournament tree over bins: the first bin with at least some room, in log time."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [0] * self.leaves + [room] * bins + [0] * (self.leaves - bins)
        for i in range(self.leaves - 1, 0, -1):
            self.room[i] = max(self.room[2 * i], self.room[2 * i + 1])

    def take(self, amount: int) -> int:
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < amount:
                i += 1
        bin_ = i - self.leaves
        room[i] -= amount
        while i > 1:
            i //= 2
            best = max(room[2 * i], room[2 * i + 1])
            if room[i] == best:
                break
            room[i] = best
        return bin_


def pack(sizes: list[int], length: int) -> list[tuple[int, int, int, int, int]]:
    """(item, start, size, bin, offset) for each piece. All bins but one are full."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    tree, bins = RoomTree(max(1, len(sizes)), length), {}
    for i in order:
        if sizes[i]:
            bins.setdefault(tree.take(sizes[i]), []).append((i, 0, sizes[i]))
    filled = sorted(bins.values(), key=lambda b: (-sum(p[2] for p in b), b[0][0]))
    room = [length - sum(p[2] for p in b) for b in filled]
    to, last = 0, len(filled) - 1
    while to < last:
        if not room[to]:
            to += 1
        elif not filled[last]:
            last -= 1
        else:
            item, start, size = filled[last].pop()
            moved = min(size, room[to])
            if moved < size:
                filled[last].append((item, start, size - moved))
            filled[to].append((item, start + size - moved, moved))
            room[to] -= moved
            room[last] += moved
    out = []
    for b, pieces in enumerate(p for p in filled if p):
        at = 0
        for item, start, size in pieces:
            out.append((item, start, size, b, at))
            at += size
    return out


_TOKENS = "grp long, doc_id long, doc_tokens long, whole_crc long, crcs array<long>, rest binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECE_SCHEMA = pa.schema([(c.split()[0], pa.int64()) for c in _PIECES.split(", ")])


def _crc(ids: bytes) -> int:
    return zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())


def pack_documents(docs: DataFrame, tokenizer_path: str | Callable[[], str], length: int = 1024, end_id: int = 0, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pieces of documents (doc_id, text) packed into sequences of at most `length` ids.

    tokenizer_path: a byte-level tokenizer's file, or a function that names it on each executor.
    Null and empty texts are the end id alone; texts of any length are encoded whole. Every row is packed
    by itself, repeated ids included; documents of equal length go by doc_id and ids; an empty table gives
    no row; other columns are ignored.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    groups = max(1, -(-docs.count() // group_docs))
    schema = pa.schema([("grp", pa.int64()), ("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("whole_crc", pa.int64()), ("crcs", pa.list_(pa.int64())), ("rest", pa.binary())])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path() if callable(tokenizer_path) else tokenizer_path
        alike: dict[int, int] = {}
        split = TaskContext.get().partitionId()
        end = np.array([end_id], "<u2").tobytes()
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                ids = [x + end for x in encode(path, [t or "" for t in batch.column("text").to_pylist()])]
                doc = batch.column("doc_id").to_pylist()
                whole_crc = [zlib.crc32(x) for x in ids]
                key = mix(mix(np.array([(x or 0) & 0xFFFFFFFFFFFFFFFF for x in doc], np.uint64)) ^ np.array([c << 32 | len(x) & 0xFFFFFFFF for c, x in zip(whole_crc, ids)], np.uint64))
                copy = np.zeros(len(doc), np.uint64)
                for i, h in enumerate(key.tolist()):
                    copy[i] = alike[h] = alike.get(h, -1) + 1
                place = mix(copy << np.uint64(32) | np.uint64(split))
                cuts = [2 * length * (len(x) // (2 * length)) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((mix(key ^ place) % np.uint64(groups)).astype(np.int64)),
                        pa.array(doc, pa.int64()),
                        pa.array([len(x) // 2 for x in ids], pa.int64()),
                        pa.array(whole_crc, pa.int64()),
                        pa.array([[_crc(x[i : i + 2 * length]) for i in range(0, c, 2 * length)] for x, c in zip(ids, cuts)], pa.list_(pa.int64())),
                        pa.array([x[c:] for x, c in zip(ids, cuts)], pa.binary()),
                    ],
                    schema=schema,
                )

    def packed(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("doc_id", "doc_tokens", "whole_crc", "rest")])
        g = group.column("grp")[0].as_py()
        doc, n, crcs, rest = (group.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "crcs", "rest"))
        rows, sequence = [], g << 32
        for d, total, full in zip(doc, n, crcs):
            for k, crc in enumerate(full):
                rows.append((d, k * length, length, crc, total, sequence, 0))
                sequence += 1
        for i, start, size, b, at in pack([len(x) // 2 for x in rest], length):
            rows.append((doc[i], len(crcs[i]) * length + start, size, _crc(rest[i][2 * start : 2 * (start + size)]), n[i], sequence + b, at))
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_PIECE_SCHEMA)

    return lean_batches(docs).select("doc_id", "text").mapInArrow(tokens, _TOKENS).groupBy("grp").applyInArrow(packed, _PIECES)


def public_byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
