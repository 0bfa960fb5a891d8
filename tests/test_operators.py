"""Index, geometry, summaries, samples, files and the command line."""

import dataclasses
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from convene.__main__ import main, parse
from convene.functions import geometry as g
from convene.operators import candidates, quadtree, sampling, summary
from convene.operators.grid import Grid
from convene.plans.engine import histogram
from convene.sources import points as io

POINT = "id bigint, x double, y double"


def points(n, seed, low=0.0, high=1.0):
    rng = random.Random(seed)
    return [(i, rng.uniform(low, high) ** 2, rng.uniform(low, high)) for i in range(n)]


def recursive_tree(sample, capacity, kind, depth):
    """name -> leaf, built the plain way."""

    def grow(name, pts, forced):
        if len(name) == depth or not (len(pts) > capacity or forced):
            return [name]
        x0 = sum(0.5 ** (i + 1) for i, d in enumerate(name) if d in "13")
        y0 = sum(0.5 ** (i + 1) for i, d in enumerate(name) if d in "01")
        half = 0.5 ** (len(name) + 1)
        parts = {d: [] for d in "0123"}
        for x, y in pts:
            parts[str(2 * (y < y0 + half) + (x >= x0 + half))].append((x, y))
        return [leaf for d, p in parts.items() for leaf in grow(name + d, p, force(name + d, p, parts))]

    plain = lambda name, p, parts: False
    force = plain
    if kind == "siblings":
        force = lambda name, p, parts: any(len(o) > capacity for o in parts.values())
    if kind == "width":
        widths = {0.5 ** len(leaf) for leaf in grow("", sample, False)}
        mean = sum(widths) / len(widths)
        force = lambda name, p, parts: 0.5 ** len(name) > mean
        return grow("", sample, 1.0 > mean)
    return grow("", sample, False)


@pytest.mark.parametrize("kind", quadtree.KINDS)
@pytest.mark.parametrize("n,capacity,depth", [(0, 3, 5), (3, 5, 6), (400, 10, 9), (300, 1, 5)])
def test_quadtree_by_recursion(spark, kind, n, capacity, depth):
    rows = points(n, n + capacity)
    df = spark.createDataFrame(rows, POINT)
    tree = quadtree.build(df, capacity, kind, depth)
    leaves = recursive_tree([(x, y) for _, x, y in rows], capacity, kind, depth)
    shape = quadtree.shape(tree)
    assert shape["leaves"] == len(leaves)
    bits = quadtree.preorder_bits(tree)
    assert bits.count("0") == shape["leaves"] and bits.count("1") == shape["internal"]
    probes = rows + [(1000 + i, x, y) for i, x, y in points(50, 99)] + [(2000, 0.0, 0.0), (2001, 1.0, 1.0), (2002, 0.5, 0.5)]
    celled = tree.assign(spark.createDataFrame(probes, POINT))
    for r in tree.rects(celled).collect():
        assert r.cell in leaves
        assert r.x0 <= r.x and r.y0 <= r.y and (r.x < r.x0 + r.ds or r.x == 1) and (r.y < r.y0 + r.ds or r.y == 1)
    assert celled.count() == len(probes)
    for r in celled.limit(5).collect():
        assert tree.cell_at(r.x, r.y) == r.cell
    if n == 400:
        monkey = quadtree.BROADCAST_NODES
        quadtree.BROADCAST_NODES = 0
        try:
            large = dataclasses.replace(tree)  # its leaves meet the points in a shuffle
            assert large.leaves is None and large.cell_at(0.3, 0.7) == tree.cell_at(0.3, 0.7)
            every = spark.createDataFrame(probes, POINT)
            assert sorted(map(tuple, large.located(every).collect())) == sorted(map(tuple, tree.located(every).collect()))
        finally:
            quadtree.BROADCAST_NODES = monkey


def test_coincident_points_stop_at_the_depth(spark):
    tree = quadtree.build(spark.createDataFrame([(i, 0.3, 0.3) for i in range(200)], POINT), 10, depth=7)
    assert tree.levels == 7 and len(tree.cell_at(0.3, 0.3)) == 7
    with pytest.raises(ValueError):
        quadtree.build(spark.createDataFrame([], POINT), 0)


def test_grid_cells_hold_their_points(spark):
    rows = points(200, 5) + [(900 + i, i / 7, j / 7) for i in range(8) for j in range(8)]
    grid = Grid(7)
    df = grid.rects(grid.assign(spark.createDataFrame(rows, POINT)))
    for r in df.collect():
        assert 0 <= r.cell < 49 and r.x0 <= r.x + 1e-12 and r.x <= r.x0 + r.ds + 1e-12 and r.y0 <= r.y + 1e-12 and r.y <= r.y0 + r.ds + 1e-12
        assert r.cell == grid.cell_at(r.x, r.y)
    hist = histogram(grid.assign(spark.createDataFrame(rows, POINT)), grid)
    assert hist.agg(F.sum("cnt")).first()[0] == len(rows)


def test_rect_distances(spark):
    rng = random.Random(3)
    rows = [tuple(v for _ in range(2) for v in (lambda a, b: (min(a), min(b), max(a), max(b)))([rng.random(), rng.random()], [rng.random(), rng.random()])) for _ in range(200)]
    names = ["ax0", "ay0", "ax1", "ay1", "bx0", "by0", "bx1", "by1"]
    df = spark.createDataFrame(rows, names)
    out = df.select(*names, g.rect_rect_distance(*names).alias("d"), g.rects_meet(*names).alias("m"), g.point_rect_distance("ax0", "ay0", *names[4:]).alias("p"))
    for r in out.collect():
        gap = lambda lo1, hi1, lo2, hi2: max(lo2 - hi1, lo1 - hi2, 0)
        want = math.hypot(gap(r.ax0, r.ax1, r.bx0, r.bx1), gap(r.ay0, r.ay1, r.by0, r.by1))
        assert math.isclose(r.d, want, abs_tol=1e-12) and r.m == (want == 0)
        near = math.hypot(gap(r.ax0, r.ax0, r.bx0, r.bx1), gap(r.ay0, r.ay0, r.by0, r.by1))
        assert math.isclose(r.p, near, abs_tol=1e-12)


coordinate = st.floats(0, 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(coordinate, coordinate), min_size=1, max_size=20), st.integers(1, 5))
def test_descent_never_fails(q, steps):
    import numpy as np

    qx, qy = np.array([a for a, _ in q]), np.array([b for _, b in q])
    rows = summary.descend(qx, qy, 1e-4, 0.0, steps, 0.0)
    assert 1 <= len(rows) <= steps and all(math.isfinite(v) for r in rows for v in r)


def test_summary_line_and_limit(spark, monkeypatch):
    q = spark.createDataFrame([(1, 0.25, 0.25), (2, 0.75, 0.75)], POINT)
    s = summary.summarize(q)
    assert s.line().split("\t")[:4] == ["0.2500000000", "0.7500000000", "0.2500000000", "0.7500000000"]
    monkeypatch.setattr(summary, "QUERY_LIMIT", 1)
    with pytest.raises(ValueError):
        summary.summarize(q)


def test_samples(spark):
    df = spark.createDataFrame(points(2000, 8), POINT)
    assert 250 < sampling.by_id(df, 20).count() < 550 and sampling.by_id(df, 100).count() == 2000 and sampling.by_id(df, 0).count() == 0
    assert 250 < sampling.bernoulli(df, 20, 3).count() < 550
    for f in (sampling.by_id, sampling.bernoulli):
        with pytest.raises(ValueError):
            f(df, 101)


def test_files(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    rows = points(60, 9)
    df = spark.createDataFrame(rows, POINT)
    io.write_text(df, at("text"), 25)
    assert sorted(map(tuple, io.read_text(spark, at("text")).collect())) == sorted(rows)
    df.write.parquet(at("pq"))
    assert io.read_parquet(spark, at("pq")).count() == 60
    tree = quadtree.build(df, 5, "siblings", 9)
    io.write_tree(tree, at("tree"))
    again = io.read_tree(spark, at("tree"))
    assert quadtree.preorder_bits(again) == quadtree.preorder_bits(tree)
    celled = tree.assign(df)
    assert sorted(map(tuple, again.assign(df).collect())) == sorted(map(tuple, celled.collect()))
    io.write_cells(celled, at("cells"))
    assert spark.read.parquet(at("cells")).count() == 60
    io.write_cell_text(celled, at("celltext"))
    assert sorted(map(tuple, io.read_cell_text(spark, at("celltext")).select("id", "x", "y", "cell").collect())) == sorted(map(tuple, celled.collect()))
    hist = celled.groupBy("cell").agg(F.count("*").alias("cnt"))
    io.write_histogram(hist, at("hist"))
    assert sorted(map(tuple, io.read_histogram(spark, at("hist")).collect())) == sorted(map(tuple, hist.collect()))
    io.write_candidate_cells(hist, at("cand"))
    assert io.read_candidate_cells(spark, at("cand")).count() == hist.count()
    s = summary.summarize(df)
    io.write_summary(spark, s, at("summary"))
    assert io.read_summary(spark, at("summary")) == s
    io.write_summary_text(spark, s, at("summarytext"))
    assert io.read_summary_text(spark, at("summarytext"), s.n).line() == s.line()
    io.write_tree_bits(tree, at("bits"))
    assert sorted(map(tuple, io.read_tree_bits(spark, at("bits"), 9).assign(df).collect())) == sorted(map(tuple, celled.collect()))
    io.write_sorted(df, at("sorted"))
    assert [(r.rn, r.id) for r in io.read_sorted(spark, at("sorted")).orderBy("rn").collect()] == [(k + 1, i) for k, (i, _, _) in enumerate(sorted(rows, key=lambda p: (p[1], p[0])))]
    spark.createDataFrame([("1\t0.5\t2\t0.25",), ("",), ("3\t1.0",)], "value string").write.text(at("lists"))
    assert sorted(map(tuple, io.read_neighbours(spark, at("lists")).collect())) == [(1, 0.5), (2, 0.25), (3, 1.0)]
    for k in range(2):
        io.append_times(spark, {"cells": k + 0.5}, at("times"))
    assert sorted(r.seconds.cells for r in spark.read.json(at("times")).collect()) == [0.5, 1.5]
    io.write_cell_table(celled, "cells_bucketed", 4)
    assert spark.table("cells_bucketed").count() == 60
    spark.sql("DROP TABLE cells_bucketed")


@pytest.mark.parametrize("text", ["1\t0.5\n", "1\tx\t0.5\n", "1.5\t0.1\t0.1\n"])
def test_bad_lines_fail(spark, tmp_path, text):
    (tmp_path / "bad.txt").write_text("1\t0.5\t0.5\n" + text)
    with pytest.raises(Exception):
        io.read_text(spark, str(tmp_path / "bad.txt")).collect()


def test_normalised(spark):
    df = io.normalised(spark.createDataFrame([(1, 10.0, 20.0), (2, 30.0, 25.0)], POINT), 10, 20, 30, 25)
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, 0.0, 0.0), (2, 1.0, 0.25)]


def test_command_line(spark, tmp_path, capsys):
    command, config, given = parse(["training=a", "query=b", "partitioning=QT", "phase15=mbr", "K=3", "N=7", "heuristics=false", "fastSums=true"])
    assert (config.partitioning, config.candidates, config.k, config.n, config.heuristics, config.fast_sums) == ("qt", "mbr", 3, 7, False, True)
    assert command == "query" and given == {"training": "a", "query": "b"}
    for bad in (["training=a"], ["training=a", "query=b", "what=1"], ["fly", "query=b"], ["crop", "input=a", "output=b"]):
        with pytest.raises(SystemExit):
            parse(bad)
    t, q = points(50, 10), points(3, 11)
    for name, rows in (("t", t), ("q", q)):
        (tmp_path / name).write_text("".join(f"{i}\t{x!r}\t{y!r}\n" for i, x, y in rows))
    main([f"training={tmp_path}/t", f"query={tmp_path}/q", "K=3", "N=4", "capacity=5"])
    printed = [line.split("\t") for line in capsys.readouterr().out.strip().splitlines()]
    want = sorted((sum(math.hypot(x - a, y - b) for _, a, b in q), i) for i, x, y in t)[:3]
    assert [int(i) for i, _ in printed] == [i for _, i in want]
    main([f"training={tmp_path}/t", f"query={tmp_path}/q", "K=3", f"output={tmp_path}/out"])
    assert spark.read.text(f"{tmp_path}/out").count() == 3
    capsys.readouterr()
    main(["crop", f"input={tmp_path}/t", f"output={tmp_path}/crop", "xmin=0.1", "xmax=0.5", "ymin=0", "ymax=0.5"])
    assert io.read_text(spark, f"{tmp_path}/crop").count() == sum(0.1 <= x <= 0.5 and y <= 0.5 for _, x, y in t)
    main(["sample", f"input={tmp_path}/t", f"output={tmp_path}/sample", "rate=50"])
    assert 0 < io.read_text(spark, f"{tmp_path}/sample").count() < 50
    main(["sort", f"query={tmp_path}/q", f"output={tmp_path}/sorted"])
    assert [r.rn for r in io.read_sorted(spark, f"{tmp_path}/sorted").collect()] == [1, 2, 3]
    main(["prepare", f"training={tmp_path}/t", f"output={tmp_path}/ready", "N=4"])
    capsys.readouterr()
    main([f"prepared={tmp_path}/ready", f"query={tmp_path}/q", "K=3", f"times={tmp_path}/times"])
    again = [line.split("\t") for line in capsys.readouterr().out.strip().splitlines()]
    assert again == printed and spark.read.json(f"{tmp_path}/times").count() == 1
    main(["tree", f"input={tmp_path}/t", f"output={tmp_path}/tree", "capacity=4", "split=siblings", f"bits={tmp_path}/bits"])
    assert io.read_tree(spark, f"{tmp_path}/tree").n_nodes > 0
    capsys.readouterr()
    main(["summary", f"query={tmp_path}/q", f"output={tmp_path}/sum"])
    main(["trace", f"query={tmp_path}/q", "limit=3", "diff=0"])
    lines = capsys.readouterr().out.splitlines()
    assert lines[0] == io.read_summary(spark, f"{tmp_path}/sum").line() and len(lines) == 4


@pytest.mark.parametrize("depth", [1, 12, 30])
def test_numbers_are_names_in_base_four(spark, depth):
    import numpy as np

    rng = random.Random(depth)
    cells = [(rng.randrange(1 << depth), rng.randrange(1 << depth)) for _ in range(300)] + [(0, 0), ((1 << depth) - 1, (1 << depth) - 1)]
    want = [int("".join(str(2 * (1 - (y >> k & 1)) + (x >> k & 1)) for k in range(depth - 1, -1, -1)), 4) for x, y in cells]
    x, y = (np.array(v, np.int64) for v in zip(*cells))
    assert quadtree.number(x, y, depth).tolist() == want
    df = spark.createDataFrame(cells, "x long, y long")
    got = df.select(quadtree.number_of(F.col("x"), F.col("y"), F.lit((1 << depth) - 1)).alias("n")).collect()
    assert [r.n for r in got] == want


@pytest.mark.parametrize("corner", [(0.0, 0.0, 0.0, 0.0), (0.3, 0.2, 0.5, 0.9), (1.0, 1.0, 1.0, 1.0), (0.0, 0.7, 1e-6, 0.7), (0.049, 0.95, 0.0501, 1.0)])
def test_box_rounds_by_search(spark, corner):
    """The round of the logarithms is the first of all boxes that meets the cell."""
    x0, y0, x1, y1 = corner
    s = summary.QuerySummary(2, x0, x1, y0, y1, (x0 + x1) / 2, (y0 + y1) / 2, 1.0)
    rng = random.Random(5)
    widths = [0.5**k for k in range(1, 31)] + [0.05]
    cells = [(i, 1, w * int(rng.random() / w), w * int(rng.random() / w), w) for i, w in enumerate(rng.choices(widths, k=1500))]
    cells += [(5000 + k, 1, b[3], b[2], 0.01) for k, b in enumerate(candidates.boxes(s)[:60])]  # low sides on boxes' high sides
    got = {r.cell: r.round for r in candidates.box_rounds(spark.createDataFrame(cells, "cell long, cnt long, x0 double, y0 double, ds double"), s).collect()}
    for cell, _, cx, cy, ds in cells:
        want = next((t for t, bx0, by0, bx1, by1 in candidates.boxes(s) if cx <= bx1 and cx + ds >= bx0 and cy <= by1 and cy + ds >= by0), None)
        assert got.get(cell) == want, (cell, cx, cy, ds)


def test_cell_lines_are_read_point_by_point(spark, tmp_path):
    """Rows of points do not carry their cell's line; a cell without points gives none."""
    rows = [(i, i / 997, (i * 7 % 991) / 991) for i in range(900)]
    celled = Grid(2).assign(spark.createDataFrame(rows, POINT))
    io.write_cell_text(celled, str(tmp_path / "cells"))
    got = io.read_cell_text(spark, str(tmp_path / "cells"))
    assert sorted(map(tuple, got.select("id", "x", "y", F.col("cell").cast("bigint")).collect())) == sorted(map(tuple, celled.collect()))
    plan = got._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Generate":
        plan = plan.children().head()
    kept = plan.requiredChildOutput()
    assert kept.size() == 0
    spark.createDataFrame([("7",), ("8\t1\t0.5\t0.25",), ("\t2\t1.0E-5\t1.0",)], "value string").write.text(str(tmp_path / "lines"))
    assert sorted(map(tuple, io.read_cell_text(spark, str(tmp_path / "lines")).collect())) == [("", 2, 1e-5, 1.0), ("8", 1, 0.5, 0.25)]
