"""Exact Jaccard join of word n-gram sets: prefix filter, then a trie of ordered sets.

1. Every document becomes the set of hashes of its word n-grams. Equal sets, by a hash of 128 bits, are
   one class, which stands for all its documents from here on under a number of its own.
2. n-grams get a global order: those of a sampled quarter of the hash space first, by the number of
   classes that hold them (rare first), then all others by hash. Two sets that are similar enough share
   an n-gram in the short beginnings of their ordered lists. The counts need only the sampled quarter,
   and beginnings reach beyond it in short documents only. n-grams are counted in buckets of a bounded
   size; one that is frequent in a task's share goes to many buckets by class, and its counts are summed.
3. Classes that share an n-gram of their beginnings, and whose sizes allow a link, are chained; chains
   make clusters. A link can't leave a cluster, and each class lies in one. Each task chains what it has
   of an n-gram first, and only the ends of these chains meet.
4. In a cluster the ordered sets are stored in a trie, frequent n-grams first, so that sets share long
   paths. A probe goes down the trie with the overlap so far; a subtree is left where the overlap plus
   what remains on either side can't reach the threshold, or where all its sets are linked to the probe
   already. Links go into a union-find, and only a spanning forest leaves the task.
5. A cluster of more than `BLOCK` classes is compared by the n-grams that its classes share in their
   beginnings, or whole, by what takes less work. What is large still is cut into bands of sizes and these
   into blocks; the pairs of blocks whose sizes allow links are tasks of their own.

Nothing is capped or dropped, and no pair of documents is listed more than as an edge of a forest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convene.llm.common import Forest, components, cut, discard, lean_batches, mix, near_buckets, shuffle_parts, small_batches, text_bytes

WORDS, PERCENT = 5, 80
#: n-grams whose hash has these bits clear are counted: a quarter.
SAMPLED = 3
BLOCK = 1000
#: Classes of small clusters that one verifying task takes on.
TASK_CLASSES = 500
#: Pairs of classes that are compared in the time that sending one class to a task takes.
SHIPPING = 1000
FLUSH = 2_000_000
#: Entries of n-grams that one task counts.
BUCKET = 4_000_000
#: Times that an n-gram is met in FLUSH entries to be dealt out by class, at most.
FREQUENT = 512

_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base & (1 << 64) - 1, np.uint64)]))


_UP, _DOWN = _powers(_BASE, 1 << 16), _powers(pow(_BASE, -1, 1 << 64), 1 << 16)


def _word_hashes(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts laid end to end, and where each text's words begin."""
    global _UP, _DOWN
    if not len(raw):
        return np.empty(0, np.uint64), np.zeros(len(ends), np.int64)
    blank = (raw - np.uint8(9)) < np.uint8(5)
    blank |= raw == 32
    # words begin and end where blanks do, and where a text begins inside a run of others
    turns = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    edge = np.unique(ends)
    edge = edge[(edge > 0) & (edge < len(raw))]
    edge = edge[~blank[edge] & ~blank[edge - 1]]
    outer = np.array([0] * (not blank[0]) + [len(raw)] * (not blank[-1]), np.int64)
    turns = np.sort(np.concatenate([turns, edge, edge, outer]))
    begin, finish = turns[::2], turns[1::2]
    if len(raw) >= len(_UP):
        _UP, _DOWN = _powers(_BASE, 2 * len(raw)), _powers(pow(_BASE, -1, 1 << 64), 2 * len(raw))
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        scaled = _BYTE.take(raw, mode="clip")  # no byte is out of range
        scaled *= _UP[: len(raw)]
        np.cumsum(scaled, out=total[1:])
        h = (total[finish] - total[begin]) * _DOWN[begin]
        return mix(h ^ (finish - begin).astype(np.uint64)), np.searchsorted(begin, ends)


def ngram_sets(raw: np.ndarray, ends: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    w, first = _word_hashes(raw, ends)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(w) - words + 1), np.uint64)
        for k in range(words):
            rolled = rolled * np.uint64(_BASE) + w[k : len(w) - words + 1 + k] if len(rolled) else rolled
        grams = mix(rolled)
        out = []
        for i in range(len(ends) - 1):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= words:
                g = np.sort(grams[a : b - words + 1])
                out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
            elif b > a:  # fewer words: the whole sequence is one
                h = np.uint64(b - a)
                for x in w[a:b]:
                    h = h * np.uint64(_BASE) + x
                out.append(mix(np.array([h ^ np.uint64(0x5555)], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def classes_of(sets: list[np.ndarray]) -> list[tuple[int, int] | None]:
    """Two signed 64-bit hashes of each set (empty: none), all sets in a few steps."""
    sizes = np.array([len(g) for g in sets], np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return [None] * len(sets)
    flat, sizes = np.concatenate(sets), sizes[full]
    begin, hashes = np.cumsum(sizes) - sizes, []
    with np.errstate(over="ignore"):
        for seed in (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)):
            h = mix(np.add.reduceat(mix(flat ^ seed), begin, dtype=np.uint64) + sizes.astype(np.uint64))
            hashes.append(h.view(np.int64).tolist())
    out: list[tuple[int, int] | None] = [None] * len(sets)
    for i, *pair in zip(full.tolist(), *hashes):
        out[i] = tuple(pair)
    return out


def class_of(grams: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set that is not empty."""
    return classes_of([grams])[0]


def _sets(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in small_batches(batches, "text"):
        yield batch, ngram_sets(*text_bytes(batch.column("text")), words)


def beginning(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """How many n-grams of an ordered set of n hold one in common with any similar set."""
    return n - (percent * n + 99) // 100 + 1


def classes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n (size of the set), sampled (n-grams in the sampled part), entries (that _shared() makes
    of it), h1, h2 (null: empty set)."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n", "sampled", "entries", "h1", "h2")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, words):
            sampled = [int((g & np.uint64(SAMPLED) == 0).sum()) for g in sets]
            entries = [max(s, beginning(len(g), percent)) if len(g) else 0 for g, s in zip(sets, sampled)]
            h1, h2 = zip(*(c or (None, None) for c in classes_of(sets)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in ([len(g) for g in sets], sampled, entries, h1, h2))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sampled long, entries long, h1 long, h2 long")


def _distinct(t: np.ndarray, *owners: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries (token, class) once each, by token and class."""
    order = np.lexsort((*owners, t))
    t, owners = t[order], tuple(o[order] for o in owners)
    new = np.ones(len(t), bool)
    new[1:] = t[1:] != t[:-1]
    for o in owners:
        new[1:] |= o[1:] != o[:-1]
    return (t[new], *(o[new] for o in owners))


def _range_of(mixed: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash: equal ranges of its upper 32 bits, in order."""
    return ((mixed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _run_lengths(t: np.ndarray) -> np.ndarray:
    """For each item of a sorted array, how many are equal to it."""
    start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.empty(0, np.int64)
    count = np.diff(np.concatenate([start, [len(t)]]))
    return np.repeat(count, count)


def _shared(docs: DataFrame, words: int, percent: int, entries: int) -> DataFrame:
    """token, h1, h2, df: the sampled n-grams, and those of beginnings that reach beyond the sample, that
    more than one class holds. They travel as packed arrays, dealt by hash to buckets of BUCKET of all
    `entries`. An n-gram that a task meets often goes to buckets by class, and a mark of it to its own
    bucket, whose entries of it then join the others."""
    buckets = max(shuffle_parts(docs.sparkSession), -(-entries // BUCKET))
    often = int(min(FREQUENT, max(2, FLUSH * BUCKET // max(1, entries))))
    schema = pa.schema([("bucket", pa.int64()), ("tokens", pa.binary()), ("h1", pa.binary()), ("h2", pa.binary()), ("marks", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: list[np.ndarray] = []
        owners: dict[tuple[int, int], int] = {}  # a class that is met again, a copy, counts once

        def flush() -> Iterator[pa.RecordBatch]:
            t, each, lengths = np.concatenate(tokens), np.array(list(owners), np.int64), list(owners.values())
            h1, h2 = np.repeat(each[:, 0], lengths), np.repeat(each[:, 1], lengths)
            tokens.clear()
            owners.clear()
            # n-grams by their mixed hash are also by bucket, a range of its upper half
            mixed = mix(t)
            order = np.argsort(mixed)
            mixed, t, h1, h2 = mixed[order], t[order], h1[order], h2[order]
            hot = _run_lengths(mixed) >= often
            bucket = _range_of(mixed, buckets)
            first = hot & np.concatenate([[True], mixed[1:] != mixed[:-1]])
            marked, mark_bucket = t[first], bucket[first]
            # buckets from `buckets` on hold frequent n-grams
            spread = buckets + (mix(t[hot] ^ mix(h1[hot].view(np.uint64))) % np.uint64(buckets)).astype(np.int64)
            order = np.concatenate([np.flatnonzero(~hot), np.flatnonzero(hot)[np.argsort(spread, kind="stable")]])
            t, h1, h2, bucket = t[order], h1[order], h2[order], np.concatenate([bucket[~hot], np.sort(spread)])
            for b in np.unique(np.concatenate([bucket, mark_bucket])).tolist():
                i, j = np.searchsorted(bucket, [b, b + 1])
                k, m = np.searchsorted(mark_bucket, [b, b + 1])
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (t[i:j], h1[i:j], h2[i:j], marked[k:m]))], schema=schema)

        held = 0
        for _, sets in _sets(batches, words):
            for g, c in zip(sets, classes_of(sets)):
                if c is None or c in owners:
                    continue
                sampled = g & np.uint64(SAMPLED) == 0
                need = beginning(len(g), percent) - int(sampled.sum())
                mine = g[sampled]
                if need > 0:
                    mine = np.concatenate([mine, g[~sampled][:need]])
                tokens.append(mine)
                owners[c] = len(mine)
                held += len(mine)
            if held >= FLUSH:
                yield from flush()
                held = 0
        if held:
            yield from flush()

    found = pa.schema([("token", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("df", pa.int64()), ("hot", pa.bool_())])

    def count(group: pa.Table) -> pa.Table:
        joined = lambda c, kind: np.frombuffer(b"".join(group.column(c).to_pylist()), kind)
        t, h1, h2 = joined("tokens", np.uint64), joined("h1", np.int64), joined("h2", np.int64)
        if group.column("bucket")[0].as_py() < buckets:
            # most n-grams are met once: only the others are sorted by class too
            order = np.argsort(t)
            marks = np.unique(joined("marks", np.uint64))
            t = t[order]
            some = (_run_lengths(t) > 1) | np.isin(t, marks)
            t, h1, h2 = _distinct(t[some], h1[order[some]], h2[order[some]])
            hot = np.isin(t, marks)
        else:
            t, h1, h2 = _distinct(t, h1, h2)
            hot = np.ones(len(t), bool)
        df = _run_lengths(t)
        keep = (df > 1) | hot
        return pa.Table.from_arrays([pa.array(t[keep].view(np.int64)), pa.array(h1[keep]), pa.array(h2[keep]), pa.array(df[keep].astype(np.int64)), pa.array(hot[keep])], schema=found)

    packed = docs.select("doc_id", "text").mapInArrow(run, "bucket long, tokens binary, h1 binary, h2 binary, marks binary")
    counted = cut(packed.groupBy("bucket").applyInArrow(count, "token long, h1 long, h2 long, df long, hot boolean"), "counted")
    often_met = cut(counted.where("hot").select("token", "h1", "h2").distinct(), "frequent")
    sums = cut(often_met.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") > 1), "frequent-sums")
    out = cut(counted.where(~F.col("hot")).drop("hot").unionByName(often_met.join(sums, "token")), "shared")
    discard(counted, often_met, sums)
    return out


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _chains(entries: DataFrame, percent: int) -> DataFrame:
    """Edges between classes that share an n-gram (token, cls, n), each with the next in size, where
    sizes allow a link; a spanning forest of each task's.

    In a band of sizes all sizes allow links. So a task chains what it has of an n-gram's band, and sends
    the chain's ends on, the smallest and the largest class; the ends of all tasks are chained by size. A
    frequent n-gram is as many rows in the second step as tasks had it, not as classes have it."""
    edges = np.array(band_edges(percent))
    kinds = pa.schema([("token", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), ("to", pa.int64())])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            token, cls, n = np.concatenate(held, 1)
            held.clear()
            band = np.searchsorted(edges, n, "right")
            order = np.lexsort((cls, n, band, token))
            token, cls, n, band = token[order], cls[order], n[order], band[order]
            same = (token[1:] == token[:-1]) & (band[1:] == band[:-1])
            first, last = np.concatenate([[True], ~same]), np.concatenate([~same, [True]])
            out = first | last
            # null: an end of a chain; else an edge
            yield pa.RecordBatch.from_arrays([pa.array(token[out]), pa.array(cls[out]), pa.array(n[out]), pa.nulls(int(out.sum()), pa.int64())], schema=kinds)
            a, b = cls[:-1][same], cls[1:][same]
            forest = Forest()
            keep = np.fromiter((forest.join(x, y) for x, y in zip(a.tolist(), b.tolist())), bool, len(a))
            a, b = a[keep], b[keep]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.nulls(len(a), pa.int64()), pa.array(b)], schema=kinds)

        for batch in batches:
            held.append(np.array([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], np.int64))
            if sum(x.shape[1] for x in held) >= FLUSH:
                yield from flush()
        if held:
            yield from flush()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, last = Forest(), (None, 0, 0)
        for batch in batches:
            out = []
            for token, cls, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if token == last[0] and 100 * last[2] >= percent * n and forest.join(last[1], cls):
                    out.append((last[1], cls))
                last = (token, cls, n)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=_EDGES)

    parts = shuffle_parts(entries.sparkSession)
    some = cut(entries.select("token", "cls", "n").mapInArrow(ends, "token long, cls long, n long, to long"), "chains")
    met = some.where(F.col("to").isNull()).select("token", "cls", "n").repartition(parts, "token").sortWithinPartitions("token", "n", "cls").mapInArrow(run, "a long, b long")
    return met.unionByName(some.where(F.col("to").isNotNull()).select(F.col("cls").alias("a"), F.col("to").alias("b")))


class Node:
    __slots__ = ("tokens", "depth", "children", "sets", "low", "high", "last", "one")

    def __init__(self, tokens: np.ndarray, depth: int):
        self.tokens, self.depth = tokens, depth  # depth: n-grams up to the end of this node's
        self.children: list[Node] = []
        self.sets: list[int] = []  # sets that end here
        self.low = self.high = self.last = 0  # sizes of the sets below, and the last of their numbers
        self.one = False  # all sets below are known to be linked


def build(sets: list[np.ndarray]) -> Node:
    """A trie with merged single paths. sets: ordered, and sorted among themselves."""
    root = Node(np.empty(0, np.int32), 0)

    def grow(node: Node, lo: int, hi: int) -> None:
        """Hang sets[lo:hi], which share node.depth n-grams, under a node."""
        work = [(node, lo, hi)]
        while work:
            node, lo, hi = work.pop()
            sizes = [len(s) for s in sets[lo:hi]]
            node.low, node.high, node.last = min(sizes), max(sizes), hi - 1
            at = node.depth
            while lo < hi and len(sets[lo]) == at:
                node.sets.append(lo)
                lo += 1
            while lo < hi:
                token, end = sets[lo][at], lo + 1
                while end < hi and sets[end][at] == token:
                    end += 1
                # sorted: what the first and the last share, all between share
                a, b = sets[lo][at:], sets[end - 1][at:]
                m = min(len(a), len(b))
                differ = np.flatnonzero(a[:m] != b[:m])
                shared = int(differ[0]) if len(differ) else m
                child = Node(a[:shared], at + shared)
                node.children.append(child)
                work.append((child, lo, end))
                lo = end

    if sets:
        grow(root, 0, len(sets))
    return root


def link(names: list[int], sets: list[np.ndarray], side: list[int] | None = None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets (sorted hashes). With sides, only links between a set
    of side 0 and one of side 1 count."""
    if len(sets) < 2:
        return []
    flat, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(flat), np.int32)
    rank[np.lexsort((flat, -count))] = np.arange(len(flat), dtype=np.int32)
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    ordered = [np.sort(x) for x in np.split(rank[back], cuts)]
    place = sorted(range(len(sets)), key=lambda i: ordered[i].astype(">i4").tobytes())
    stored = [i for i in place if side is None or side[i] == 1]
    root = build([ordered[i] for i in stored])
    position = {i: k for k, i in enumerate(stored)} if side is None else {}
    forest, out = Forest(), []
    has = np.zeros(len(flat), bool)
    for i in place:
        if side is not None and side[i] == 1:
            continue
        x = ordered[i]
        has[x] = True
        below_of = np.cumsum(has)  # n-grams of x up to a rank
        n, after = len(x), position.get(i, -1)
        work = [(root, 0, False)]
        while work:
            node, overlap, done = work.pop()
            if done:  # its children have been seen: with a new link, they may be linked to one another by now
                if len(out) == overlap:
                    continue
                below = [c.one for c in node.children]
                if all(below):
                    roots = {forest.find(stored[s]) for s in node.sets} | {forest.find(stored[c.last]) for c in node.children}
                    node.one = len(roots) == 1
                continue
            if node.last <= after or node.one and forest.find(stored[node.last]) == forest.find(i):
                continue
            if 100 * min(n, node.high) < percent * max(n, node.low):
                continue
            if len(node.tokens):
                overlap += int(np.count_nonzero(has[node.tokens]))
                rest = n - int(below_of[node.tokens[-1]])
            else:
                rest = n
            # the size that suits the bound best, of those below
            size = min(max(node.depth + rest, node.low), node.high)
            if (100 + percent) * (overlap + min(rest, size - node.depth)) < percent * (n + size):
                continue
            for s in node.sets:
                j = stored[s]
                if j != i and s > after and (100 + percent) * overlap >= percent * (n + node.depth) and forest.join(i, j):
                    out.append((names[i], names[j]))
            if not node.one:
                work.append((node, len(out), True))
            for child in reversed(node.children):
                work.append((child, overlap, False))
        has[x] = False
        if len(out) == len(sets) - 1:  # all are linked
            break
    return out


def band_edges(percent: int, most: int = 1 << 40) -> list[int]:
    """Sizes at which bands begin. A size and one that it may be linked to lie in one band or in
    neighbouring ones."""
    out = [1]
    while out[-1] < most:
        out.append(out[-1] * 100 // percent + 1)
    return out


def _units(members: DataFrame, entries: DataFrame, percent: int) -> DataFrame:
    """(cls, unit, band): the groups of classes that are compared with one another.

    A small cluster is a unit. So is a large one, or each of the n-grams that its classes share in their
    beginnings, whichever takes less work: n-grams where many common lines chain texts that have little
    else in common, the cluster where near copies share nearly all. n-grams with the same classes are one
    unit. Classes that are linked share such an n-gram, so no link is lost."""
    edges = ", ".join(f"{e}L" for e in band_edges(percent))
    banded = cut(members.select("cls", "root", "size", F.expr(f"size(filter(array({edges}), e -> e <= n))").alias("band")), "banded")
    large = banded.where(F.col("size") > BLOCK)
    inside = entries.select("token", "cls").join(large.drop("size"), "cls")
    sets = inside.groupBy("root", "token").agg(F.count("*").alias("m"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("s")).where(F.col("m") > 1)
    sets = cut(sets.groupBy("root", "m", "s").agg(F.min("token").alias("token")), "token-sets")
    by_token = sets.groupBy("root").agg(F.sum(F.col("m") * F.col("m") + SHIPPING * F.col("m")).alias("token_cost"))
    per = large.groupBy("root", "band").agg(F.count("*").alias("c"))
    near = per.select("root", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("c").alias("d"))
    by_band = per.join(near, ["root", "band"]).groupBy("root").agg(F.sum(F.col("c") * F.col("d") + SHIPPING * F.col("c") * F.ceil(F.col("d") / BLOCK)).alias("band_cost"))
    plan = cut(by_band.join(by_token, "root", "left").select("root", F.coalesce(F.col("token_cost") < F.col("band_cost"), F.lit(False)).alias("split")), "plans")
    whole = banded.where(F.col("size") <= BLOCK).unionByName(large.join(plan.where(~F.col("split")), "root").drop("split"))
    split = sets.join(plan.where("split"), "root").select("root", "token")
    return whole.select("cls", F.col("root").alias("unit"), "band").unionByName(inside.join(split, ["root", "token"]).select("cls", F.xxhash64("root", "token").alias("unit"), "band"))


def _verified(members: DataFrame, entries: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Edges (a, b) of a spanning forest of the links in clusters. members: cls, h1, h2, n, doc_id (of a
    document of the class), root (of the cluster), size (of the cluster); entries: token, cls.

    Small units share tasks. A large one is cut by bands of sizes, of which only a band and the next can
    hold linked sets, and bands into blocks; its tasks are pairs of blocks."""
    units = cut(_units(members, entries, percent), "units")
    bins = max(1, -(-units.count() // TASK_CLASSES))
    sizes = cut(units.groupBy("unit").agg(F.count("*").alias("size")), "unit-sizes")
    blocks = units.join(sizes.where(F.col("size") > BLOCK), "unit").groupBy("unit", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    blocks = cut(blocks.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("band", "k"))).alias("blocks")), "blocks")
    task = F.when(F.col("size") <= BLOCK, F.pmod(F.xxhash64("unit"), F.lit(bins))).otherwise(F.col("unit"))
    placed = units.join(sizes, "unit").join(blocks, "unit", "left").select("cls", F.struct("unit", task.alias("task"), "band", "blocks").alias("u"))
    dealt = placed.groupBy("cls").agg(F.collect_list("u").alias("units")).join(members.select("cls", "h1", "h2", "doc_id"), "cls")
    dealt = cut(dealt.select(F.col("doc_id").alias("id"), F.struct("cls", "h1", "h2").alias("want"), "units"), "dealt")
    discard(units, sizes, blocks)
    near = near_buckets(docs.select("doc_id", "text"), F.coalesce("doc_id", F.lit(-1)), dealt.select(F.coalesce("id", F.lit(-1)).alias("k")))
    rows = near.join(dealt, F.col("doc_id").eqNullSafe(F.col("id"))).select("text", "want", "units")
    kinds = "task long, i long, j long, unit long, cls long, place long, grams binary"
    schema = pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in kinds.split(", ")])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, words):
            out = []
            for g, c, want, units in zip(sets, classes_of(sets), batch.column("want").to_pylist(), batch.column("units").to_pylist()):
                if c != (want["h1"], want["h2"]):  # ids may repeat
                    continue
                raw, want = g.tobytes(), want["cls"]
                for u in units:
                    if u["blocks"] is None:
                        out.append((u["task"], -1, -1, u["unit"], want, 0, raw))
                        continue
                    count = dict(u["blocks"])
                    own = u["band"] << 32 | want % count[u["band"]]
                    for near in (u["band"] - 1, u["band"], u["band"] + 1):
                        for k in range(count.get(near, 0)):
                            other = near << 32 | k
                            out.append((u["task"], min(own, other), max(own, other), u["unit"], want, own, raw))
            for k in range(0, len(out), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[k : k + 2000]), schema)], schema=schema)

    def verify(group: pa.Table) -> pa.Table:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        by: dict[int, dict[int, tuple[np.ndarray, int]]] = {}
        for unit, cls, place, raw in zip(*(group.column(c).to_pylist() for c in ("unit", "cls", "place", "grams"))):
            by.setdefault(unit, {})[cls] = (np.frombuffer(raw, np.uint64), place)
        out = []
        for found in by.values():
            names = sorted(found)
            sets = [found[c][0] for c in names]
            side = None if i == j else [int(found[c][1] == j) for c in names]
            out += link(names, sets, side, percent)
        return pa.Table.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], schema=_EDGES)

    return rows.mapInArrow(spread, kinds).groupBy("task", "i", "j").applyInArrow(verify, "a long, b long")


def similar_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text): the size of its n-gram set,
    and the least doc_id that it is connected to by links, itself included. Sets are linked if 100 times
    their intersection is at least `percent` times their union.

    Texts of any length are compared whole. Documents without words are linked with nothing. Equal texts
    are linked; rows that share a doc_id are rows of their own; a null doc_id is never the least unless all
    are null. Other columns are ignored; an empty table gives no row."""
    docs = lean_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = cut(classes(docs, words, percent), "sets")
    grouped = every.where(F.col("h1").isNotNull()).groupBy("h1", "h2").agg(F.first("n").alias("n"), F.first("sampled").alias("sampled"), F.min("doc_id").alias("doc_id"))
    of_class = cut(grouped.withColumn("cls", F.monotonically_increasing_id()), "classes")
    entries = every.agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0]
    of_hash = _shared(docs, words, percent, entries)
    shared = cut(of_hash.join(of_class.select("h1", "h2", "cls", "n", "sampled"), ["h1", "h2"]).drop("h1", "h2"), "shared-classes")
    sampled = F.col("token").bitwiseAND(F.lit(SAMPLED)) == 0
    need = F.expr(f"n - ({percent} * n + 99) div 100 + 1")
    listed = shared.where(sampled).groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("held"), F.first("n").alias("n"), F.first("sampled").alias("sampled"))
    # n-grams of the sample that no other class holds come first
    listed = listed.withColumn("room", need - (F.col("sampled") - F.size("held"))).where(F.col("room") > 0)
    first = listed.select(F.explode(F.slice("held", F.lit(1), F.col("room").cast("int"))).alias("h"), "cls", "n").select("h.token", "cls", "n")
    beyond = shared.where(~sampled).select("token", "cls", "n")
    entries = cut(first.unionByName(beyond), "entries")
    clusters = cut(components(_chains(entries, percent)), "clusters")
    discard(of_hash, shared)
    # written first, small tables are joined as they are, and a hot key on the other side can be split
    sizes = cut(clusters.groupBy("root").agg(F.count("*").alias("size")), "sizes")
    members = cut(clusters.join(sizes, "root").withColumnRenamed("node", "cls").join(of_class.select("cls", "h1", "h2", "n", "doc_id"), "cls"), "members")
    discard(clusters, sizes)
    linked = cut(components(_verified(members, entries, docs, words, percent)), "linked")
    named = cut(of_class.select("cls", "h1", "h2", "doc_id").join(linked.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")), "named")
    least = cut(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    of_cls = cut(named.select("h1", "h2", "root").join(least, "root").select("h1", "h2", "component_id"), "named-components")
    discard(members, entries, linked, of_class, named, least)
    some = every.where(F.col("h1").isNotNull()).join(of_cls, ["h1", "h2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = every.where(F.col("h1").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.unionByName(none)


#: DuckDB SQL for similar_groups() over documents with unique ids: all pairs that share an n-gram.
SQL = r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ), s AS (
        SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
    ), n AS (
        SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
    ), shared AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
    ), links AS (
        SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
    ), reach(a, b) AS (
        SELECT a, b FROM (SELECT a, b FROM links UNION ALL SELECT b, a FROM links)
        UNION
        SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON r.b = l.a
    )
    SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
    FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id
"""
