"""Column expressions of plane geometry. A rectangle is given by its low corner and its high corner."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells' corners and points are rounded apart by less.
SLACK = 1e-9
#: What sums of n terms, taken in different orders, may differ by: this part of the sum for each term.
ROUNDING = 2.0**-52


def sum_slack(best: float, n: int) -> float:
    """How far bounds and sums of n distances may lie from `best` by rounding alone. What exceeds it by
    less is not pruned."""
    return SLACK + ROUNDING * (n + 16) * abs(best)


def _col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def distance(x1, y1, x2, y2) -> Column:
    dx, dy = _col(x1) - _col(x2), _col(y1) - _col(y2)
    return F.sqrt(dx * dx + dy * dy)


def point_rect_distance(x, y, x0, y0, x1, y1) -> Column:
    """Least distance of a point to a closed rectangle; 0 inside."""
    x, y, zero = _col(x), _col(y), F.lit(0.0)
    dx = F.greatest(_col(x0) - x, zero, x - _col(x1))
    dy = F.greatest(_col(y0) - y, zero, y - _col(y1))
    return F.sqrt(dx * dx + dy * dy)


def rect_rect_distance(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Least distance between two closed rectangles; 0 where they meet."""
    zero = F.lit(0.0)
    dx = F.greatest(_col(bx0) - _col(ax1), _col(ax0) - _col(bx1), zero)
    dy = F.greatest(_col(by0) - _col(ay1), _col(ay0) - _col(by1), zero)
    return F.sqrt(dx * dx + dy * dy)


def rects_meet(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Whether closed rectangles have a point in common; touching counts."""
    return (_col(ax0) <= _col(bx1)) & (_col(ax1) >= _col(bx0)) & (_col(ay0) <= _col(by1)) & (_col(ay1) >= _col(by0))


def in_box(x, y, x0, y0, x1, y1) -> Column:
    return _col(x).between(_col(x0), _col(x1)) & _col(y).between(_col(y0), _col(y1))
