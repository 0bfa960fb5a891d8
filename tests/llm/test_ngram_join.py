import random
import re

import numpy as np
import pyarrow as pa
import pytest

from convene.llm import common
from convene.llm import ngram_join as j
from convene.llm.common import text_bytes


def word_sets(text, words=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows):
    """component of each row by all pairs."""
    sets = [word_sets(t) for _, t in rows]
    forest = j.Forest()
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                forest.join(a, b)
    groups = {}
    for a, (d, _) in enumerate(rows):
        groups.setdefault(forest.find(a), []).append(d)
    least = {r: min((d for d in g if d is not None), default=None) for r, g in groups.items()}
    return sorted(((d, len(sets[a]), least[forest.find(a)]) for a, (d, _) in enumerate(rows)), key=str)


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = [" ".join(rng.choices(vocabulary, k=25)) for _ in range(3)]
    out = []
    while len(out) < n:
        base = rng.choices(vocabulary, k=rng.choice([1, 2, 4, 5, 6, 9, 30, 80, 200]))
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3, 10])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                k = rng.randrange(len(copy) + 1)
                copy[k : k + 1] = rng.choice([[], ["new"], [rng.choice(vocabulary), "x"]])
            out.append("\n".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
        if rng.random() < 0.3:
            out.append(rng.choice(shared) + " " + " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 40]))))
    return out[:n]


def test_sets_by_brute_force():
    rng = random.Random(1)
    sample = [None, "", " ", "a", "A b", "É é\x85x", "a\x0bb\x0cc\rd\te", "x " * 50] + texts(5, 60) + ["".join(rng.choices("ab \n\té", k=40)) for _ in range(200)]
    column = pa.array(sample)
    got = j.ngram_sets(*text_bytes(column))
    seen = {}
    for text, g in zip(sample, got):
        want = word_sets(text)
        assert len(g) == len(want), repr(text)
        alone = j.ngram_sets(*text_bytes(pa.array([text], pa.string())))[0]
        assert (alone == g).all()
        for x in [frozenset(want)]:
            assert seen.setdefault(x, g.tobytes()) == g.tobytes()
    assert len(set(seen.values())) == len(seen)
    assert [g.tolist() for g in j.ngram_sets(*text_bytes(column.slice(3, 4)))] == [g.tolist() for g in got[3:7]]


@pytest.mark.parametrize("sides", [False, True])
def test_trie_by_brute_force(sides):
    for seed in range(60):
        rng = random.Random(seed)
        base = [rng.sample(range(60), rng.randint(1, 30)) for _ in range(6)]
        sets = {tuple(sorted(set(rng.choice(base)) ^ set(rng.sample(range(60), rng.choice([0, 1, 1, 2, 3]))))) for _ in range(40)} - {()}
        sets = [np.array(s, np.uint64) for s in sorted(sets)]
        side = [rng.randint(0, 1) for _ in sets] if sides else None
        want, got = j.Forest(), j.Forest()
        for a in range(len(sets)):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and (side is None or side[a] != side[b]):
                    want.join(a, b)
        for a, b in j.link(list(range(len(sets))), sets, side):
            assert got.join(a, b)
        assert [want.find(a) for a in range(len(sets))] == [got.find(a) for a in range(len(sets))]


@pytest.mark.parametrize("block,shipping", [(1000, 1000), (7, 1000), (7, 0), (7, -1000)])
def test_join_by_brute_force(spark, block, shipping, monkeypatch):
    monkeypatch.setattr(j, "BLOCK", block)
    monkeypatch.setattr(j, "SHIPPING", shipping)  # other weights choose other plans
    monkeypatch.setattr(j, "TASK_CLASSES", 20)
    if block == 7:  # small shares, so that n-grams are frequent in some of them and rare in others
        monkeypatch.setattr(j, "FLUSH", 1500)
        monkeypatch.setattr(j, "FREQUENT", 3)
        monkeypatch.setattr(j, "BUCKET", 700)
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts(11, 420))] + [(2000, None), (2001, ""), (2002, " \n"), (None, "w1 w2"), (5, "w1 w2"), (5, "w1 w2"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS cls")
    got = sorted(map(tuple, j.similar_groups(df.repartition(6)).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_bands(percent):
    edges = j.band_edges(percent, 5000)
    band = lambda n: sum(e <= n for e in edges)
    for n in range(1, 2000):
        assert band(n * 100 // percent) - band(n) in (0, 1)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert j.similar_groups(df).count() == 0
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, j.similar_groups(df).collect())) == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("unite", [1_000_000, 10])
def test_components(spark, unite, monkeypatch):
    monkeypatch.setattr(common, "UNITE_ROWS", unite)  # beyond it, by rounds
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(-5, 400)] * 3 + [(7, 7)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    forest = j.Forest()
    for a, b in edges:
        forest.join(a, b)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: forest.find(x) for x in nodes}


def test_classes_by_two_hashes():
    """Sets that share one hash of 64 bits are told apart by the other."""
    sets = [np.array(sorted(random.Random(i).sample(range(10**6), 8)), np.uint64) for i in range(500)]
    pairs = [j.class_of(x) for x in sets]
    assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == 500 and not {a for a, _ in pairs} & {b for _, b in pairs}


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_chains_connect_what_sizes_allow(spark, parts):
    """Chains of any cut into tasks connect the same classes as all pairs that share an n-gram."""
    rng = random.Random(parts)
    rows = [(t, c, 5 + c * c % 97) for c in range(150) for t in rng.sample(range(30), 2)] + [(99, c, 50 + c % 9) for c in range(120)]
    df = spark.createDataFrame(rows, "token long, cls long, n long").repartition(parts)
    want, got = j.Forest(), j.Forest()
    for t, c, n in rows:
        for u, d, m in rows:
            if t == u and c < d and 100 * min(n, m) >= 80 * max(n, m):
                want.join(c, d)
    for r in j._chains(df, 80).collect():
        got.join(r.a, r.b)
    assert [got.find(c) for c in range(150)] == [want.find(c) for c in range(150)]


def test_very_long_and_repeated_texts(spark):
    long = " ".join(f"w{i % 7919}x{i}" for i in range(300_000))
    rows = [(1, long), (2, long + " end"), (3, "other " * 10), (4, "other " * 40), (5, long.upper())]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (299_996, 1), 2: (299_997, 1), 3: (1, 3), 4: (1, 3), 5: (299_996, 1)}


def test_classes_of_many_sets_at_once():
    """Sets beside one another, empty ones among them, have the hashes that each has alone."""
    sets = [np.array(sorted(random.Random(i).sample(range(10**6), i % 7)), np.uint64) for i in range(60)]
    got = j.classes_of(sets)
    assert got == [j.class_of(x) if len(x) else None for x in sets] and j.classes_of([sets[0]] * 3) == [None] * 3
    assert len(set(got)) == 1 + sum(len(x) > 0 for x in sets)


def test_links_end_when_all_are_linked(monkeypatch):
    """Of copies that are all linked after some probes, the others are not looked for."""
    probed = []
    real = np.cumsum
    monkeypatch.setattr(j.np, "cumsum", lambda *a, **k: probed.append(1) or real(*a, **k))
    sets = [np.array([*range(40), 100 + i], np.uint64) for i in range(30)]
    assert len(j.link(list(range(30)), sets)) == 29 and len(probed) < 10
