"""A regular grid over the unit square: cell j * n + i for column i and row j."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    n: int

    #: A circle touching a cell from outside does not make it a candidate.
    closed = False

    def __post_init__(self):
        if self.n < 1:
            raise ValueError("a grid needs at least one cell")

    def _step(self, v: Column) -> Column:
        # divided by the cell's width, as cells are drawn; 1.0 falls into the last cell
        return F.least(F.floor(v / F.lit(1.0 / self.n)), F.lit(self.n - 1).cast("long"))

    def cell(self, x: str = "x", y: str = "y") -> Column:
        return self._step(F.col(y)) * self.n + self._step(F.col(x))

    def assign(self, points: DataFrame) -> DataFrame:
        return points.withColumn("cell", self.cell())

    def rects(self, cells: DataFrame) -> DataFrame:
        """Adds x0, y0 (low corner) and ds (width) to rows with a cell."""
        ds = 1.0 / self.n
        return cells.withColumns({"x0": (F.col("cell") % self.n) * F.lit(ds), "y0": F.floor(F.col("cell") / self.n) * F.lit(ds), "ds": F.lit(ds)})

    def width(self, cell: int) -> float:
        return 1.0 / self.n

    def cell_at(self, x: float, y: float) -> int:
        ds = 1.0 / self.n
        return min(int(y / ds), self.n - 1) * self.n + min(int(x / ds), self.n - 1)
