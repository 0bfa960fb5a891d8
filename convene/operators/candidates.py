"""The first cells to search: those that a growing box or circle reaches until they hold k points.

A histogram row is (cell, cnt, x0, y0, ds). Every cell gets the round in which the growing shape first
reaches it; the first round by which k points are in is the last one taken. All cells are taken if there
are fewer points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convene.functions.geometry import point_rect_distance
from convene.operators.summary import QuerySummary

#: 0.9 to this power is far under the width of the deepest cell.
BOX_ROUNDS = 260


def boxes(s: QuerySummary) -> list[tuple[int, float, float, float, float]]:
    """(round, x0, y0, x1, y1): the low sides shrink by a tenth, the high ones grow by one up to 1."""
    x0, y0, x1, y1, out = s.xmin, s.ymin, s.xmax, s.ymax, []
    for t in range(BOX_ROUNDS):
        out.append((t, x0, y0, x1, y1))
        x0, y0 = 0.9 * x0, 0.9 * y0
        # a box with a high side at 0 could not grow
        x1, y1 = min(1.0, 1.1 * max(x1, 1e-3)), min(1.0, 1.1 * max(y1, 1e-3))
    return out


def _first(values: list[float], bound: Column, guess: Column) -> Column:
    """The first round whose value reaches a bound: not above it where values fall, not below it where they
    rise; len(values) if none does. The guess is off by two rounds at most: of the four values from two
    before it, as many as miss the bound are passed over."""
    known, falls = F.array(*(F.lit(v) for v in values)), values[-1] < values[0]
    base = F.greatest(F.lit(0), F.least(F.lit(len(values) - 4), F.coalesce(guess.cast("int"), F.lit(0)) - 2))
    return base + F.size(F.filter(F.slice(known, base + 1, F.lit(4)), lambda v: v > bound if falls else v < bound))


def box_rounds(hist: DataFrame, s: QuerySummary) -> DataFrame:
    """hist with `round`, the first in which the box meets the cell: the latest of the rounds in which its
    four sides do. A side's values are powers, so their logarithm gives the round, up to rounding."""
    steps = boxes(s)
    out = []
    for axis, low, high in (("x", 1, 3), ("y", 2, 4)):
        lows, highs = [b[low] for b in steps], [b[high] for b in steps]
        far, near = F.col(f"{axis}0") + F.col("ds"), F.col(f"{axis}0")
        out.append(_first(lows, far, F.ceil(F.log(far / F.lit(lows[0])) / math.log(0.9))) if lows[0] > 0 else F.lit(0))
        begin = highs[1] / 1.1  # the first value, lifted off 0
        grown = _first(highs[1:], near, F.ceil(F.log(F.greatest(near, F.lit(1e-300)) / F.lit(begin)) / math.log(1.1)) - 1) + 1
        out.append(F.when(near <= F.lit(highs[0]), 0).otherwise(grown))
    return hist.withColumn("round", F.greatest(*out)).where(F.col("round") < len(steps))


def circle_rounds(hist: DataFrame, s: QuerySummary, width: float, closed: bool, own: object) -> DataFrame:
    """hist with `round`, the first in which the circle of radius (0.5 + 0.25 round) * width around the
    centroid reaches the cell; the centroid's own cell is in from the start."""
    d = point_rect_distance(s.xc, s.yc, "x0", "y0", F.col("x0") + F.col("ds"), F.col("y0") + F.col("ds"))
    steps: Column = (d - 0.5 * width) / (0.25 * width)
    first = F.ceil(steps) if closed else F.floor(steps) + 1
    return hist.withColumn("round", F.when(F.col("cell") == F.lit(own), 0).otherwise(F.greatest(F.lit(0).cast("long"), first)).cast("int"))


def last_round(rounds: DataFrame, k: int) -> int:
    """The first round by which the cells hold k points; the last of all if there are fewer points."""
    per = rounds.groupBy("round").agg(F.sum("cnt").alias("cnt"))
    running = F.sum("cnt").over(Window.orderBy("round").rowsBetween(Window.unboundedPreceding, 0))
    row = per.withColumn("running", running).agg(F.min(F.when(F.col("running") >= k, F.col("round"))).alias("enough"), F.max("round").alias("last")).first()
    return row.enough if row.enough is not None else row.last if row.last is not None else 0


def candidates(hist: DataFrame, s: QuerySummary, index, k: int, how: str) -> DataFrame:
    """The histogram rows of the candidate cells. how: mbr or centroid."""
    if how == "mbr":
        rounds = box_rounds(hist, s)
    elif how == "centroid":
        x, y = min(max(s.xc, 0.0), 1.0), min(max(s.yc, 0.0), 1.0)
        own = index.cell_at(x, y)
        rounds = circle_rounds(hist, s, index.width(own), index.closed, own)
    else:
        raise ValueError("candidates are chosen by mbr or centroid")
    return rounds.where(F.col("round") <= last_round(rounds, k)).drop("round")
