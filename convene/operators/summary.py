"""What is known of a query set: its box, its centroid by descent, and the centroid's distance sum."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The query set is small by contract; it is collected, and broadcast, up to this many points (24 MB).
QUERY_LIMIT = 1_000_000


@dataclass(frozen=True)
class QuerySummary:
    n: int
    xmin: float
    xmax: float
    ymin: float
    ymax: float
    xc: float
    yc: float
    sumdist: float

    def line(self) -> str:
        """The tab-separated text form, 10 decimals."""
        return "\t".join(f"{v:.10f}" for v in (self.xmin, self.xmax, self.ymin, self.ymax, self.xc, self.yc, self.sumdist))


def collect_query(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of the query points, by x. More than QUERY_LIMIT are refused."""
    rows = queries.select("x", "y", "id").limit(QUERY_LIMIT + 1).toPandas().sort_values(["x", "id"])
    if len(rows) > QUERY_LIMIT:
        raise ValueError(f"a query set has at most {QUERY_LIMIT} points")
    return rows["x"].to_numpy(float), rows["y"].to_numpy(float)


def distance_sum(x: float, y: float, qx: np.ndarray, qy: np.ndarray) -> float:
    return float(np.sqrt((x - qx) ** 2 + (y - qy) ** 2).sum())


def bottom(x: np.ndarray, y: np.ndarray, weight: np.ndarray, most: int = 60) -> tuple[float, float, float]:
    """x, y and distance sum of a place where the sum is about least: the best that Weiszfeld's steps from the
    mean meet. weight: how many query points lie on each."""
    px, py, best = float(np.average(x, weights=weight)), float(np.average(y, weights=weight)), (0.0, 0.0, math.inf)
    for _ in range(most):
        d = np.sqrt((px - x) ** 2 + (py - y) ** 2)
        total = float((weight * d).sum())
        if not total < best[2]:
            break
        best = (px, py, total)
        away = d > 0
        if not away.any():
            break
        pull = weight[away] / d[away]
        px, py = float(np.average(x[away], weights=pull)), float(np.average(y[away], weights=pull))
    return best


def descend(qx: np.ndarray, qy: np.ndarray, step: float, least_sum: float, most: int, least_move: float) -> list[tuple[int, float, float, float, float]]:
    """(iteration, x, y, move, sumdist) of a gradient descent on the distance sum from the mean. It makes
    one step at least, and stops when the sum is small, the steps are used up, or a move is short. A query
    point under the centroid has no direction and is left out of the gradient."""
    x, y, out = float(qx.mean()), float(qy.mean()), []
    while True:
        d = np.sqrt((x - qx) ** 2 + (y - qy) ** 2)
        away = d > 0
        nx = x - step * float(((x - qx[away]) / d[away]).sum())
        ny = y - step * float(((y - qy[away]) / d[away]).sum())
        move = math.hypot(nx - x, ny - y)
        x, y = nx, ny
        out.append((len(out) + 1, x, y, move, distance_sum(x, y, qx, qy)))
        if not (out[-1][4] > least_sum and len(out) < most and move > least_move):
            return out


def summarize(queries: DataFrame, step: float = 1e-4, least_sum: float = 0.0, most: int = 1, least_move: float = 1e-6) -> QuerySummary:
    qx, qy = collect_query(queries)
    return summarize_points(qx, qy, step, least_sum, most, least_move)


def summarize_points(qx: np.ndarray, qy: np.ndarray, step: float = 1e-4, least_sum: float = 0.0, most: int = 1, least_move: float = 1e-6) -> QuerySummary:
    if not len(qx):
        raise ValueError("the query set is empty")
    _, x, y, _, total = descend(qx, qy, step, least_sum, most, least_move)[-1]
    return QuerySummary(len(qx), float(qx.min()), float(qx.max()), float(qy.min()), float(qy.max()), x, y, total)


def box(queries: DataFrame) -> DataFrame:
    return queries.agg(F.count("*").alias("n"), F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"))


def trace(queries: DataFrame, step: float, most: int, least_sum: float = 0.0, least_move: float = 0.0) -> DataFrame:
    """The descent as rows (iter, x, y, move, sumdist), to choose its rate by."""
    qx, qy = collect_query(queries)
    return queries.sparkSession.createDataFrame(descend(qx, qy, step, least_sum, most, least_move), "iter int, x double, y double, move double, sumdist double")
