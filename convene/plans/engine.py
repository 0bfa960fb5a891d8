"""Group k-nearest-neighbour queries: the k points with the least sum of distances to a query set.

The plan is two passes over cells. The first searches the cells around the query set and finds k
neighbours; the k-th distance then rules out cells and points of the rest by bounds, and the second pass
computes the sums of what is left. Every option changes the work, never the rows.

Points that many queries ask are prepared once: with their cells, sorted by them, beside the histogram and
the index. Queries then read no histogram from points, and skip what lies outside the cells they want.
"""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convene.functions.geometry import SLACK, distance, in_box, sum_slack
from convene.operators import candidates, kernel, prune, quadtree, topk
from convene.operators.grid import Grid
from convene.operators.sampling import bernoulli
from convene.operators.summary import QuerySummary, bottom, collect_query, summarize_points
from convene.sources.points import in_domain

log = logging.getLogger("convene")

#: Cells (one id each) that are broadcast for a semi join; more are joined by shuffle.
BROADCAST_CELLS = 500_000


@dataclass(frozen=True)
class Config:
    k: int = 10
    partitioning: str = "gd"  # gd: grid, qt: quadtree
    mode: str = "bf"  # bf: all sums, ps: points ruled out by x alone first
    candidates: str = "centroid"  # mbr or centroid
    heuristics: bool = True  # rule out cells
    fast_sums: bool = False  # leave sums that exceed the k-th distance
    n: int = 100  # grid cells a side
    capacity: int = 1000  # sample points of a quadtree leaf
    split: str = "capacity"
    depth: int = 20
    sample_percent: float = 100.0
    seed: int = 1
    step: float = 1e-4
    steps: int = 1
    kernel: str = "auto"  # auto, join or arrow

    def __post_init__(self):
        for name, allowed in (("partitioning", ("gd", "qt")), ("mode", ("bf", "ps")), ("candidates", ("mbr", "centroid")), ("kernel", ("auto", "join", "arrow")), ("split", quadtree.KINDS)):
            object.__setattr__(self, name, str(getattr(self, name)).lower())
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} is one of {', '.join(allowed)}")
        for name in ("k", "n", "capacity", "steps"):
            if int(getattr(self, name)) < 1:
                raise ValueError(f"{name} is at least 1")


@dataclass
class Prepared:
    """Points with their cells (id, x, y, cell), their histogram (cell, cnt, x0, y0, ds), and the index."""

    celled: DataFrame
    histogram: DataFrame
    index: object


@dataclass
class Run:
    """A query that was run: its parts, for those who want more than the rows. close() gives up what they
    hold in the cluster's memory."""

    nearest: DataFrame
    summary: QuerySummary
    best: float
    histogram: DataFrame
    candidate_cells: DataFrame
    reasons: DataFrame | None
    kept_points: DataFrame | None = None  # of the second pass, before bounds on points
    remote: DataFrame | None = None  # the plan of the second pass
    seconds: dict[str, float] = field(default_factory=dict)
    held: list = field(default_factory=list)

    def close(self) -> None:
        for x in self.held:
            x.unpersist() if isinstance(x, DataFrame) else x.close()


def histogram(celled: DataFrame, index) -> DataFrame:
    """cell, cnt, x0, y0, ds of the cells that hold points."""
    return index.rects(celled.groupBy("cell").agg(F.count("*").alias("cnt")))


def make_index(points: DataFrame, c: Config):
    if c.partitioning == "gd":
        return Grid(c.n)
    sample = points if c.sample_percent >= 100 else bernoulli(points, c.sample_percent, c.seed)
    return quadtree.build(sample, c.capacity, c.split, c.depth)


def prepare(points: DataFrame, config: Config = Config(), index=None) -> Prepared:
    """points (id, x, y) with their cells; sources.points writes it for later queries."""
    checked = in_domain(_typed(points))
    index = index or make_index(checked, config)
    celled = index.assign(checked)
    return Prepared(celled, histogram(celled, index), index)


def _typed(points: DataFrame) -> DataFrame:
    return points.select(F.col("id").cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


def _in_cells(celled: DataFrame, cells: DataFrame, size) -> DataFrame:
    """celled points in some cells. The range of the cells' names is a filter on a plain column, by which
    a scan of prepared points skips row groups."""
    few = cells.select("cell")
    ranged = celled.where(F.col("cell").between(F.lit(size.range[0]), F.lit(size.range[1]))) if size.cells else celled
    return ranged.join(F.broadcast(few) if size.cells <= BROADCAST_CELLS else few, "cell", "left_semi")


def _in_box(points: DataFrame, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    """Points in a box, and a little around it: cells' corners and points are rounded apart."""
    return points.where(in_box("x", "y", x0 - SLACK, y0 - SLACK, x1 + SLACK, y1 + SLACK))


def _size(cells: DataFrame):
    corner = (F.min("x0"), F.max(F.col("x0") + F.col("ds")), F.min("y0"), F.max(F.col("y0") + F.col("ds")))
    return cells.agg(F.count("*").alias("cells"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("points"), F.array(*corner).alias("box"), F.array(F.min("cell"), F.max("cell")).alias("range")).first()


def run(points: DataFrame | None, queries: DataFrame, config: Config = Config(), index=None, prepared: Prepared | None = None) -> Run:
    """points, queries: id, x, y in the unit square, ids unique. index: a Grid or QuadTree to use instead
    of a new one. prepared: points with cells, in place of points and index. No point: no row. Fewer than
    k: all of them."""
    clock, seconds, held = time.monotonic(), {}, []

    def lap(name: str) -> None:
        nonlocal clock
        now = time.monotonic()
        seconds[name], clock = now - clock, now
        log.info("%s: %.3f s", name, seconds[name])

    qx, qy = collect_query(in_domain(queries))
    summary = summarize_points(qx, qy, config.step, 0.0, config.steps)
    lap("summary")
    if prepared is not None:
        points, index, hist, locate = prepared.celled, prepared.index, prepared.histogram, lambda df: df
    else:
        points = _typed(points)
        # the first pass over all points checks their domain; later ones filter plain columns, which a scan can skip by
        checked = in_domain(points)
        if index is None:
            index = make_index(checked, config)
            held += [index] if hasattr(index, "close") else []
        hist, locate = histogram(index.assign(checked), index), index.assign
    spark = points.sparkSession
    hist = hist.persist()
    cells = hist.count()
    lap("cells")
    chosen = candidates.candidates(hist, summary, index, config.k, config.candidates).persist()
    held += [hist, chosen]
    size = _size(chosen)
    lap("candidates")

    def sums(some: DataFrame, n: int, best: float | None) -> DataFrame:
        arrow = config.kernel == "arrow" or config.kernel == "auto" and n * len(qx) >= kernel.ARROW_PAIRS
        sweep = best if config.mode == "ps" else None
        if arrow:
            return kernel.arrow_sums(some, qx, qy, sweep, best if config.fast_sums else None)
        out = kernel.joined_sums(some, queries, sweep, len(qx))
        return out.where(F.col("dist") <= best + sum_slack(best, len(qx))) if config.fast_sums and best is not None else out

    around = locate(_in_box(points, *size.box)) if size.cells else locate(points)
    first = topk.top(sums(_in_cells(around, chosen, size), size.points, None), config.k, len(qx)).collect()
    best = max((r.dist for r in first), default=0.0) if len(first) >= config.k else float("inf")
    local = spark.createDataFrame([tuple(r) for r in first], "id long, dist double")
    lap("local")
    out = Run(local, summary, best, hist, chosen, None, seconds=seconds, held=held)
    if size.cells < cells:
        rest = hist.join(chosen.select("cell"), "cell", "left_anti")
        if config.heuristics and best < float("inf"):
            out.reasons = prune.reasons(rest, qx, qy, summary, best).persist()
            held.append(out.reasons)
            rest = out.reasons.where(F.col("reason") == "keep")
        left = _size(rest)
        lap("pruned")
        if left.cells:
            within = points
            if best < float("inf"):  # H4, and the box around its circle for scans to skip by
                r = (best + sum_slack(best, summary.n) + summary.sumdist) / summary.n
                within = _in_box(points, summary.xc - r, summary.xc + r, summary.yc - r, summary.yc + r).where(prune.near_centre(summary, best))
            out.kept_points = _in_cells(locate(points), rest, left)
            out.remote = topk.top(sums(_in_cells(locate(within), rest, left), left.points, best if best < float("inf") else None), config.k, len(qx))
            found = spark.createDataFrame([tuple(r) for r in out.remote.collect()], "id long, dist double")
            out.nearest = topk.merge(config.k, local, found, n=len(qx))
            lap("remote")
    out.nearest = topk.ranked(out.nearest, len(qx))
    return out


def gknn(points: DataFrame | None, queries: DataFrame, config: Config = Config(), index=None, prepared: Prepared | None = None) -> DataFrame:
    """rank, id, dist of the k points with the least distance sums."""
    done = run(points, queries, config, index, prepared)
    done.close()
    return done.nearest


def within_tangents(points: DataFrame, qx: np.ndarray, qy: np.ndarray, k: int) -> DataFrame:
    """Points that may be among the k nearest, found without cells and in any domain; ids are unique. The k points
    about the place of the least distance sum give a threshold, and tangents of the sum rule out points beyond it.
    Fewer than k points with coordinates, or query points without: all points."""
    if not len(qx):
        return points
    x, y, weight = kernel.distinct_points(qx, qy)
    weight = np.ones(len(x)) if weight is None else weight
    low = bottom(x, y, weight)
    if not np.isfinite(low[2]):
        return points
    about = points.select("x", "y", distance("x", "y", low[0], low[1]).alias("d")).where(F.col("d") < float("inf"))
    first = about.orderBy("d").limit(k).collect()
    if len(first) < k:
        return points
    _, sums = kernel.block_sums(np.array([r.x for r in first]), np.array([r.y for r in first]), x, y, weight=weight)
    return points.where(prune.tangents(x, y, weight, low, float(sums.max())))


def brute_force(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    n = len(collect_query(queries)[0])
    return topk.ranked(topk.top(kernel.sums(points, queries), k, n), n)
