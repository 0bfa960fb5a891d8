"""Bounds that rule out cells and points. None of them loses an answer.

For any point p in a cell and any centre c: sumdist(p) >= n |p c| - sumdist(c); sumdist(p) is at least n
times the cell's distance to the query box, and at least the sum of its distances to the query points.
What exceeds the k-th distance met so far goes; equals stay, so ties are decided by id. The sum is convex,
so it is nowhere under a tangent plane either.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convene.functions.geometry import SLACK, distance, point_rect_distance, rect_rect_distance, sum_slack
from convene.operators.kernel import arrow_rect_sums, arrow_x_sums
from convene.operators.summary import QuerySummary

#: Tangents of the distance sum, and halvings of the range in which each one's anchor is looked for.
DIRECTIONS, BISECTIONS = 16, 12


def _high(axis: str) -> Column:
    return F.col(f"{axis}0") + F.col("ds")


def centre_bound(s: QuerySummary) -> Column:
    """H1 of a cell: n * distance to the centroid - sumdist(centroid)."""
    return s.n * point_rect_distance(s.xc, s.yc, "x0", "y0", _high("x"), _high("y")) - s.sumdist


def box_bound(s: QuerySummary) -> Column:
    """H2 of a cell: n * distance to the query box."""
    return s.n * rect_rect_distance("x0", "y0", _high("x"), _high("y"), s.xmin, s.ymin, s.xmax, s.ymax)


def reasons(cells: DataFrame, qx: np.ndarray, qy: np.ndarray, s: QuerySummary, best: float) -> DataFrame:
    """cells with `reason`: the first of h1, h2, h3 that rules the cell out, or keep. H3, the sum of a
    cell's distances to the query points, is computed for cells that pass the other two only, against
    the query points as arrays."""
    over = best + sum_slack(best, s.n)
    first = cells.withColumn("reason", F.when(centre_bound(s) > over, "h1").when(box_bound(s) > over, "h2"))
    bounded = arrow_rect_sums(first.where(F.col("reason").isNull()).drop("reason"), qx, qy)
    third = bounded.withColumn("reason", F.when(F.col("bound") > over, "h3").otherwise("keep")).drop("bound")
    return first.where(F.col("reason").isNotNull()).unionByName(third)


def near_centre(s: QuerySummary, best: float) -> Column:
    """H4: whether a point may be within the k-th distance, by its distance to the centroid."""
    return s.n * distance("x", "y", s.xc, s.yc) - s.sumdist <= best + sum_slack(best, s.n)


def tangents(qx: np.ndarray, qy: np.ndarray, weight: np.ndarray, low: tuple[float, float, float], best: float) -> Column:
    """H5: whether a point may be within the k-th distance, by tangent planes of the distance sum. They touch it
    at anchors in some directions from its lowest place (`low`: x, y, sum), a little beyond the line on which it
    is `best`; a lowest place or anchors that are off rule out fewer points. weight: query points on each place."""
    x, y, least = low
    n = int(weight.sum())
    # beyond the line by as much as it is above the lowest sum: where the sum is flat, a plane would rule out nothing
    goal = best + max(best - least, 1e-6 * best) + n * SLACK
    kept = []
    for angle in np.arange(DIRECTIONS) * (2 * math.pi / DIRECTIONS):
        ux, uy = math.cos(angle), math.sin(angle)
        far = (goal + least) / n  # the sum is `goal` at least here, and less before `near`
        near = max((goal - least) / n, 1e-9 * far)
        for _ in range(BISECTIONS):
            r = math.sqrt(near * far)
            if (weight * np.sqrt((x + r * ux - qx) ** 2 + (y + r * uy - qy) ** 2)).sum() < goal:
                near = r
            else:
                far = r
        ax, ay = x + far * ux, y + far * uy
        dx, dy = ax - qx, ay - qy
        d = np.sqrt(dx * dx + dy * dy)
        pull = np.divide(weight, d, out=np.zeros(len(d)), where=d > 0)
        total, gx, gy = float((weight * d).sum()), float((pull * dx).sum()), float((pull * dy).sum())
        # a point within `best` is no farther from the anchor than these sums allow, which bounds the terms' rounding
        slack = 4 * sum_slack(best + least + total + n * far, n)
        kept.append(gx * (F.col("x") - F.lit(ax)) + gy * (F.col("y") - F.lit(ay)) <= best - total + slack)
    return reduce(Column.__and__, kept)


def point_counters(points: DataFrame, qx: np.ndarray, s: QuerySummary, best: float) -> DataFrame:
    """One row of point counts for the points of cells that are kept: all, those that the distance to the
    centroid leaves (H4), and those of them that the sum of differences in x leaves."""
    h4 = points.withColumn("near", near_centre(s, best))
    swept = arrow_x_sums(h4.where("near"), qx).agg(F.count(F.when(F.col("sumdx") <= best + sum_slack(best, s.n), 1)).alias("sumdx_left"))
    counted = h4.agg(F.count("*").alias("points"), F.count(F.when(F.col("near"), 1)).alias("h4_left"))
    return counted.crossJoin(F.broadcast(swept)).select("points", "h4_left", (F.col("points") - F.col("h4_left")).alias("h4_cut"), "sumdx_left", (F.col("h4_left") - F.col("sumdx_left")).alias("sumdx_cut"))  # one row each


def counters(reasoned: DataFrame, candidate_cells: int) -> DataFrame:
    """One row of cell counts: non-empty cells, those searched first, and how each bound fared."""
    hit = lambda r: F.coalesce(F.sum((F.col("reason") == r).cast("long")), F.lit(0))
    failed = {"h1": ("h2", "h3", "keep"), "h2": ("h3", "keep"), "h3": ("keep",)}
    return reasoned.agg(
        (F.count("*") + candidate_cells).alias("num_cells"),
        F.lit(candidate_cells).cast("long").alias("candidate_cells"),
        *(hit(h).alias(f"{h}_success") for h in failed),
        *(F.coalesce(F.sum(F.col("reason").isin(*rest).cast("long")), F.lit(0)).alias(f"{h}_fail") for h, rest in failed.items()),
        hit("keep").alias("cells_proc"),
        F.coalesce(F.sum(F.when(F.col("reason") == "keep", F.col("cnt"))), F.lit(0)).alias("points_left"),
    )
