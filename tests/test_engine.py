"""Whole queries: all options give the rows of a brute force, on odd point sets too."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from convene.operators import candidates, kernel, prune, quadtree, summary, topk
from convene.operators.grid import Grid
from convene.plans import queries as named
from convene.plans.engine import Config, gknn, histogram, prepare, run, within_tangents
from convene.sources import points as io

POINT = "id bigint, x double, y double"


def brute(t, q, k):
    if not t:
        return []
    x, y = np.array([p[1] for p in t]), np.array([p[2] for p in t])
    d = sum(np.sqrt((x - a) ** 2 + (y - b) ** 2) for _, a, b in q)
    order = sorted(range(len(t)), key=lambda i: (round(d[i], 9), t[i][0]))[:k]
    return [(r + 1, t[i][0], round(d[i], 6)) for r, i in enumerate(order)]


def rows(df):
    return [(r.rank, r.id, round(r.dist, 6)) for r in df.orderBy("rank").collect()]


def uniform(n, seed, low=0.0, high=1.0):
    rng = random.Random(seed)
    return [(i, rng.uniform(low, high), rng.uniform(low, high)) for i in range(n)]


FIXTURES = {
    "plain": (uniform(400, 1), uniform(7, 2, 0.4, 0.6), 10),
    "tie_at_k": ([(3, 0.4, 0.5), (1, 0.6, 0.5), (2, 0.5, 0.4), (0, 0.5, 0.6)], [(0, 0.5, 0.5)], 2),
    "k_gt_t": (uniform(3, 3), uniform(2, 4), 10),
    "k_eq_t": (uniform(10, 5), uniform(2, 6), 10),
    "q_single": (uniform(100, 7), uniform(1, 8), 5),
    "q_coincident": (uniform(100, 9), [(i, 0.3, 0.3) for i in range(5)], 5),
    "t_coincident": ([(i, 0.7, 0.2) for i in range(200)], uniform(3, 10), 4),
    "single_leaf": (uniform(5, 11), uniform(2, 12), 2),
    "on_borders": ([(i * 9 + j, i / 8, j / 8) for i in range(9) for j in range(9)], uniform(4, 13), 6),
    "two_point_cell": ([(0, 0.05, 0.5), (1, 0.52, 0.5), (2, 0.9, 0.9)], [(i, 0.5 + i / 1000, 0.5) for i in range(5)], 1),
    "far_cluster": (uniform(150, 14, 0.0, 0.05), uniform(4, 15, 0.9, 1.0), 7),
    "high_xmax": (uniform(100, 16, 0.965, 1.0), uniform(5, 17, 0.5, 0.95), 8),
}


@pytest.mark.parametrize("name", FIXTURES)
def test_fixture(spark, name):
    t, q, k = FIXTURES[name]
    points, query = spark.createDataFrame(t, POINT), spark.createDataFrame(q, POINT)
    want = brute(t, q, k)
    for partitioning, how in (("gd", "centroid"), ("qt", "mbr")):
        got = gknn(points, query, Config(k=k, partitioning=partitioning, candidates=how, n=8, capacity=10, depth=12))
        assert rows(got) == want, (partitioning, how)


@pytest.mark.parametrize("partitioning,mode,how", itertools.product(("gd", "qt"), ("bf", "ps"), ("mbr", "centroid")))
def test_options_change_nothing(spark, partitioning, mode, how):
    t, q = uniform(300, 21), uniform(9, 22, 0.1, 0.3)
    points, query = spark.createDataFrame(t, POINT).cache(), spark.createDataFrame(q, POINT)
    want = brute(t, q, 12)
    for heuristics, fast in itertools.product((True, False), (True, False)):
        kind = "join" if heuristics == fast else "arrow"
        got = gknn(points, query, Config(k=12, partitioning=partitioning, mode=mode, candidates=how, heuristics=heuristics, fast_sums=fast, kernel=kind, n=6, capacity=15))
        assert rows(got) == want, (heuristics, fast, kind)


@pytest.mark.parametrize("split", quadtree.KINDS)
def test_pruned_cells_hold_nothing_near(spark, split):
    t, q, k = uniform(500, 31), [(0, 0.4, 0.4), (1, 0.6, 0.4), (2, 0.4, 0.6), (3, 0.6, 0.6)], 10
    points, query = spark.createDataFrame(t, POINT).cache(), spark.createDataFrame(q, POINT)
    index = quadtree.build(points, 10, split, 10) if split != "capacity" else Grid(20)
    done = run(points, query, Config(k=k, steps=5), index)
    sums = {r.id: r.dist for r in kernel.joined_sums(points, query).collect()}
    cell = {r.id: r.cell for r in index.assign(points).collect()}
    gone = {r.cell: r.reason for r in done.reasons.where("reason <> 'keep'").collect()}
    assert gone
    for i, c in cell.items():
        assert c not in gone or sums[i] >= done.best - 1e-9
    counts = prune.counters(done.reasons, done.candidate_cells.count()).first()
    assert counts.num_cells == len(set(cell.values())) and counts.h1_success + counts.h1_fail == counts.num_cells - counts.candidate_cells


def test_edges_and_errors(spark):
    none, one = spark.createDataFrame([], POINT), spark.createDataFrame([(1, 0.5, 0.5)], POINT)
    assert rows(gknn(none, one)) == []
    with pytest.raises(ValueError, match="empty"):
        gknn(one, none)
    with pytest.raises(Exception, match="outside the unit square"):
        gknn(spark.createDataFrame([(1, 1.2, 0.5)], POINT), one).collect()
    for bad in ({"k": 0}, {"partitioning": "kd"}, {"mode": "x"}, {"n": 0}, {"candidates": "no"}):
        with pytest.raises(ValueError):
            Config(**bad)
    assert Config(candidates="MBR").candidates == "mbr"


def test_merge_and_format(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.25)], "id long, dist double")
    b = spark.createDataFrame([(2, 0.75), (3, 0.25)], "id long, dist double")
    merged = topk.ranked(topk.merge(2, a, b))
    assert rows(merged) == [(1, 2, 0.25), (2, 3, 0.25)]
    assert topk.formatted(merged).first().line == "2\t0.2500000000\t3\t0.2500000000"


def test_x_sums_by_brute_force():
    rng = np.random.default_rng(1)
    q = np.sort(np.round(rng.random(50), 2))
    x = np.concatenate([q[:5], rng.random(40), [-1, 2]])
    assert np.allclose(kernel.x_sums(x, q), np.abs(x[:, None] - q).sum(1))


def test_candidates_hold_k_points(spark):
    t, q = uniform(300, 41), uniform(5, 42, 0.45, 0.55)
    points = spark.createDataFrame(t, POINT)
    s = summary.summarize(spark.createDataFrame(q, POINT))
    for index in (Grid(10), quadtree.build(points, 5, depth=8)):
        hist = histogram(index.assign(points), index)
        for how in ("mbr", "centroid"):
            held = [candidates.candidates(hist, s, index, k, how).agg(F.sum("cnt")).first()[0] for k in (1, 20, 100, 300, 999)]
            assert held == sorted(held) and all(h >= min(k, 300) for h, k in zip(held, (1, 20, 100, 300, 999)))


def test_second_pass_skips_by_pushed_filters(spark, tmp_path):
    t, q = uniform(3000, 51), uniform(5, 52, 0.45, 0.55)
    spark.createDataFrame(t, POINT).write.parquet(str(tmp_path / "t"))
    done = run(spark.read.parquet(str(tmp_path / "t")), spark.createDataFrame(q, POINT), Config(k=50, n=40, candidates="centroid"))
    assert rows(done.nearest) == brute(t, q, 50)
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    plan = done.remote.select("*")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(x," in plan and "LessThanOrEqual(y," in plan


@pytest.mark.parametrize("partitioning", ["gd", "qt"])
def test_prepared_points(spark, tmp_path, partitioning):
    """Written once with their cells, points answer as before, and the scan is handed ranges of cells."""
    t, config, seen = uniform(3000, 61), Config(k=150, n=30, capacity=20, depth=12, partitioning=partitioning), 0
    points = spark.createDataFrame(t, POINT)
    io.write_prepared(prepare(points, config), str(tmp_path / "prepared"))
    for seed in (62, 63):
        q = uniform(6, seed, 0.2 * (seed - 61), 0.2 * (seed - 61) + 0.1)
        ready = io.read_prepared(spark, str(tmp_path / "prepared"), partitioning)
        done = run(None, spark.createDataFrame(q, POINT), config, prepared=ready)
        assert rows(done.nearest) == brute(t, q, 150)
        if done.remote is None:  # nothing was left for a second pass
            continue
        seen += 1
        spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
        plan = done.remote.select("*")._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.maxMetadataStringLength")
        assert "GreaterThanOrEqual(cell," in plan and "LessThanOrEqual(cell," in plan and "GreaterThanOrEqual(x," in plan
        done.close()
    assert seen


def test_very_many_query_points(spark):
    """Sums near 5 * 10^4 round apart by more than a fixed slack; options still change nothing."""
    rng = np.random.default_rng(71)
    q = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((100_000, 2)))], POINT)
    t = uniform(60, 72, 0.3, 0.7) + [(100 + i, 0.5, 0.5) for i in range(8)]
    points, found = spark.createDataFrame(t, POINT).cache(), []
    for kind, fast, mode, heuristics in (("join", False, "bf", False), ("arrow", True, "ps", True), ("join", True, "ps", True), ("arrow", False, "bf", True)):
        got = gknn(points, q, Config(k=12, n=4, kernel=kind, fast_sums=fast, mode=mode, heuristics=heuristics))
        found.append([(r.rank, r.id) for r in got.orderBy("rank").collect()])
    assert all(f == found[0] for f in found[1:])


def test_nothing_stays_in_memory(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    points = spark.createDataFrame(uniform(300, 81), POINT)
    for partitioning in ("gd", "qt"):
        gknn(points, spark.createDataFrame(uniform(4, 82), POINT), Config(k=5, n=6, capacity=9, partitioning=partitioning)).collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before


def test_copies_of_query_points_are_weights(spark):
    """Query points on one another are summed as one: the kernel's work is by different points, its sums are by all."""
    rng = np.random.default_rng(5)
    some = np.round(rng.random((2, 40)), 2)
    qx, qy = np.tile(some, 60)
    order = np.lexsort((rng.random(len(qx)), qx))
    qx, qy = qx[order], qy[order]
    ux, uy, weight = kernel.distinct_points(qx, qy)
    assert len(ux) == len({*zip(qx, qy)}) <= 40 and weight.sum() == 2400 and (np.diff(ux) >= 0).all()
    assert kernel.distinct_points(np.array([0.1, 0.1]), np.array([0.2, 0.3]))[2] is None
    x, y = rng.random((2, 70))
    want = np.sqrt((x[:, None] - qx) ** 2 + (y[:, None] - qy) ** 2).sum(1)
    rows, total = kernel.block_sums(x, y, ux, uy, None, weight)
    assert (rows == np.arange(70)).all() and np.allclose(total, want, rtol=1e-13, atol=0)
    best = float(np.sort(want)[9])
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], POINT)
    got = {r.id: r.dist for r in kernel.arrow_sums(points, qx, qy, best, best).collect()}
    assert sorted(got) == sorted(np.flatnonzero(want <= best).tolist()) and np.allclose([got[i] for i in got], [want[i] for i in got], rtol=1e-13, atol=0)
    assert kernel.arrow_sums(points.where("id < 0"), qx, qy).count() == 0


def test_halves_merge_to_the_whole_with_copied_queries(spark):
    t, q = uniform(400, 51), [(i, x, y) for i, (_, x, y) in enumerate(uniform(30, 52, 0.3, 0.7) * 5)]
    points, query = spark.createDataFrame(t, POINT), spark.createDataFrame(q, POINT)
    lists = [topk.top(kernel.sums(points.where(half), query), 10) for half in ("x <= 0.6", "x >= 0.4")]
    assert rows(topk.ranked(topk.merge(10, *lists))) == brute(t, q, 10)
    assert len(kernel.distinct_points(*summary.collect_query(query))[0]) == 30


@pytest.mark.parametrize("name", FIXTURES)
def test_tangents_lose_no_neighbour(spark, name):
    t, q, k = FIXTURES[name]
    points, query = spark.createDataFrame(t, POINT), spark.createDataFrame(q, POINT)
    for low, high in ((0.0, 0.6), (0.4, 1.0)):
        left = within_tangents(points.where(F.col("x").between(low, high)), *summary.collect_query(query), k)
        assert rows(topk.ranked(topk.top(kernel.sums(left, query), k))) == brute([p for p in t if low <= p[1] <= high], q, k), (low, high)


def test_tangents_keep_every_sum_within_best(spark):
    t = uniform(3000, 61)
    points, x, y = spark.createDataFrame(t, POINT), np.array([p[1] for p in t]), np.array([p[2] for p in t])
    line, even = uniform(90, 62), uniform(2, 63)
    sets = {"plain": uniform(300, 64, 0.4, 0.6), "line": [(i, a, 0.5) for i, a, _ in line], "two": even, "one": even[:1], "on_points": t[:70], "copies": uniform(5, 65) * 40, "two_ends": uniform(80, 66, 0, 0.01) + uniform(81, 67, 0.99, 1)}
    for name, q in sets.items():
        qx, qy, weight = kernel.distinct_points(np.array([p[1] for p in q]), np.array([p[2] for p in q]))
        weight = np.ones(len(qx)) if weight is None else weight
        sums = (np.sqrt((x[:, None] - qx) ** 2 + (y[:, None] - qy) ** 2) * weight).sum(1)
        lows = (summary.bottom(qx, qy, weight), (0.9, 0.1, float((np.hypot(0.9 - qx, 0.1 - qy) * weight).sum())))  # the lowest place, and one that is off
        bests = [float(b) for b in np.sort(sums)[[0, 9, 500]]]
        got = points.orderBy("id").select(*(prune.tangents(qx, qy, weight, low, best) for low in lows for best in bests)).collect()
        for j, kept in enumerate(np.array(got).T):
            near = sums <= bests[j % 3] + 1e-9
            assert kept[near].all(), (name, j)
            assert j >= 3 or name == "two_ends" or kept.sum() <= 1.3 * near.sum() + 60, (name, j, kept.sum())


def test_tangents_leave_odd_points_as_they_were(spark):
    t = [(i, None if i % 3 == 0 else i / 40, None if i % 5 == 0 else float("nan") if i % 7 == 0 else 0.5) for i in range(40)]
    points, qx = spark.createDataFrame(t, POINT), np.array([0.2, 0.4])
    real = sorted(i for i, x, y in t if x is not None and y == 0.5)
    assert within_tangents(points, qx, qx, len(real) + 1).count() == 40
    assert within_tangents(points, qx[:0], qx[:0], 3).count() == 40
    assert within_tangents(points, np.array([0.2, np.nan]), qx, 3).count() == 40
    kept = {r.id for r in within_tangents(points, qx, qx, len(real)).collect()}
    assert kept == set(real)
    far = points.selectExpr("id", "1000 * x - 500 as x", "-300 * y as y")  # outside the unit square
    assert within_tangents(far, 1000 * qx - 500, -300 * qx, 3).count() in range(3, len(real))


def test_merge_topk_sums_few_points(spark, monkeypatch):
    summed = []
    monkeypatch.setattr(kernel, "arrow_sums", lambda points, *rest, sums=kernel.arrow_sums: summed.append(points.count()) or sums(points, *rest))
    assert named.QUERIES["merge_topk"](spark, "/root/testdata/sf0.01").count() == 10
    assert len(summed) == 2 and max(summed) < 300, summed  # of some 9,000 in each half
