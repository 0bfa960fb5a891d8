"""Distance sums of points to the query set.

Two ways to the same numbers: a broadcast cross join and a sum, all in generated code, and a vectorised
kernel over Arrow batches for many pairs. Either may be given the k-th distance met so far; points whose
sum is sure to be larger can then be left out early.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from convene.functions.geometry import distance, sum_slack
from convene.operators.summary import collect_query

#: Pairs, and query points where the number of points isn't known, from which on the Arrow kernel pays.
ARROW_PAIRS, ARROW_QUERIES = 5_000_000, 64
#: Points, cells and query points of a block; a block of points stays in a core's cache.
ROWS, CELL_ROWS, QUERY_STEP = 32, 1024, 1024


def joined_sums(points: DataFrame, queries: DataFrame, sweep_below: float | None = None, query_points: int = 1) -> DataFrame:
    """id, dist by a cross join with the broadcast query points. sweep_below: points of which the sum of
    differences in x alone is larger go."""
    q = F.broadcast(queries.select(F.col("x").alias("qx"), F.col("y").alias("qy")))
    out = points.select("id", "x", "y").crossJoin(q).groupBy("id").agg(F.sum(distance("x", "y", "qx", "qy")).alias("dist"), F.sum(F.abs(F.col("x") - F.col("qx"))).alias("dx"))
    if sweep_below is not None:
        out = out.where(F.col("dx") <= sweep_below + sum_slack(sweep_below, query_points))
    return out.select("id", "dist")


def x_sums(x: np.ndarray, qx: np.ndarray) -> np.ndarray:
    """Sum of |x - q| over sorted q, by prefix sums: the plane sweep's bound without a sweep."""
    prefix = np.concatenate([[0.0], np.cumsum(qx)])
    r = np.searchsorted(qx, x, "right")
    return x * (2 * r - len(qx)) - 2 * prefix[r] + prefix[-1]


def distinct_points(qx: np.ndarray, qy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """x, y of the different query points, by x, and how many lie on each (None: one on each)."""
    order = np.lexsort((qy, qx))
    x, y = qx[order], qy[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    if new.all():
        return qx, qy, None
    begin = np.flatnonzero(new)
    return x[new], y[new], np.diff(begin, append=len(x)).astype(float)


def block_sums(x: np.ndarray, y: np.ndarray, qx: np.ndarray, qy: np.ndarray, below: float | None = None, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows that remain, their sums). below: rows are left out as soon as a part of the sum is larger.
    weight: how many query points lie on each. A row's sum doesn't depend on the rows beside it."""
    rows, total = np.arange(len(x)), np.zeros(len(x))
    n = len(qx) if weight is None else int(weight.sum())
    room = np.empty((2, len(x), min(len(qx), QUERY_STEP)))
    for k in range(0, len(qx), QUERY_STEP):
        dx, dy = room[:, : len(rows), : len(qx) - k]
        np.subtract(x[rows, None], qx[k : k + QUERY_STEP], out=dx)
        np.subtract(y[rows, None], qy[k : k + QUERY_STEP], out=dy)
        dx *= dx
        dy *= dy
        dx += dy
        np.sqrt(dx, out=dx)
        if weight is not None:
            dx *= weight[k : k + QUERY_STEP]
        total = total + dx.sum(1)
        if below is not None:
            fits = total <= below + sum_slack(below, n)
            rows, total = rows[fits], total[fits]
    return rows, total


def arrow_sums(points: DataFrame, qx: np.ndarray, qy: np.ndarray, sweep_below: float | None = None, stop_above: float | None = None) -> DataFrame:
    """id, dist by the vectorised kernel; qx is sorted. Query points that lie on one another are one with a weight."""
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast((qx, *distinct_points(qx, qy)))  # at most QUERY_LIMIT points
    schema = pa.schema([("id", pa.int64()), ("dist", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every_x, qx, qy, weight = shared.value
        for batch in batches:
            ids, x, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if sweep_below is not None:
                near = x_sums(x, every_x) <= sweep_below + sum_slack(sweep_below, len(every_x))
                ids, x, y = ids[near], x[near], y[near]
            blocks = [(ids[k : k + ROWS], *block_sums(x[k : k + ROWS], y[k : k + ROWS], qx, qy, stop_above, weight)) for k in range(0, len(ids), ROWS)]
            if blocks:
                left, total = np.concatenate([i[rows] for i, rows, _ in blocks]), np.concatenate([t for _, _, t in blocks])
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(total)], schema=schema)

    return points.select(F.col("id").cast("long").alias("id"), "x", "y").mapInArrow(run, "id long, dist double")


def arrow_x_sums(points: DataFrame, qx: np.ndarray) -> DataFrame:
    """id, sumdx: the sum of differences in x to the query points, in log time a point; qx is sorted."""
    shared = points.sparkSession.sparkContext.broadcast(qx)
    schema = pa.schema([("id", pa.int64()), ("sumdx", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x_sums(batch.column(1).to_numpy(zero_copy_only=False), shared.value))], schema=schema)

    return points.select(F.col("id").cast("long").alias("id"), "x").mapInArrow(run, "id long, sumdx double")


def arrow_rect_sums(cells: DataFrame, qx: np.ndarray, qy: np.ndarray) -> DataFrame:
    """cells with `bound`: the sum of the least distances of the query points to the cell (x0, y0, ds)."""
    shared = cells.sparkSession.sparkContext.broadcast((qx, qy))  # at most QUERY_LIMIT points
    schema = to_arrow_schema(cells.schema).append(pa.field("bound", pa.float64()))
    at = [cells.columns.index(c) for c in ("x0", "y0", "ds")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qx, qy = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, CELL_ROWS):
                batch = whole.slice(k, CELL_ROWS)
                x, y, ds = (batch.column(i).to_numpy(zero_copy_only=False)[:, None] for i in at)
                total = np.zeros(batch.num_rows)
                for j in range(0, len(qx), QUERY_STEP):
                    a, b = qx[j : j + QUERY_STEP], qy[j : j + QUERY_STEP]
                    dx, dy = np.maximum(np.maximum(x - a, a - (x + ds)), 0), np.maximum(np.maximum(y - b, b - (y + ds)), 0)
                    total += np.sqrt(dx * dx + dy * dy).sum(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total)], schema=schema)

    return cells.mapInArrow(run, StructType([*cells.schema.fields, StructField("bound", DoubleType())]))


def sums(points: DataFrame, queries: DataFrame, known: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """id, dist of all points, by the way that suits the number of query points. known: what collect_query() gave."""
    qx, qy = collect_query(queries) if known is None else known
    return arrow_sums(points, qx, qy) if len(qx) >= ARROW_QUERIES else joined_sums(points, queries)
