"""The k nearest of (id, dist) rows; equal distances go by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Distances are compared at this many decimals, so that sums of different order tie alike. Sums over
#: many query points are larger and round more: two decimals go for each digit of their number over four.
DECIMALS = 9


def decimals(n: int) -> int:
    """Decimals at which sums of distances to n query points are compared."""
    return max(0, DECIMALS - 2 * max(0, len(str(n)) - 4))


def nearness(n: int = 1) -> list[Column]:
    return [F.round("dist", decimals(n)), F.col("id")]


def top(sums: DataFrame, k: int, n: int = 1) -> DataFrame:
    """Each task keeps its k nearest; the driver's merge is of k rows from each. n: query points."""
    return sums.orderBy(*nearness(n)).limit(k)


def merge(k: int, *lists: DataFrame, n: int = 1) -> DataFrame:
    """One list of the k nearest of several; an id in many lists counts once, with its least distance."""
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more)
    return top(out.groupBy("id").agg(F.min("dist").alias("dist")), k, n)


def ranked(nearest: DataFrame, n: int = 1) -> DataFrame:
    """rank from 1, id, dist; of k rows."""
    return nearest.select(F.row_number().over(Window.orderBy(*nearness(n))).alias("rank"), "id", "dist")


def formatted(rows: DataFrame, decimals: int = 10) -> DataFrame:
    """One row with a tab-separated line of id and distance, nearest first. rows: rank, id, dist."""
    pair = F.concat_ws("\t", F.col("id").cast("string"), F.format_string(f"%.{decimals}f", F.col("dist")))
    ordered = F.array_sort(F.collect_list(F.struct("rank", pair.alias("p"))))
    return rows.agg(F.array_join(F.transform(ordered, lambda s: s["p"]), "\t").alias("line"))
