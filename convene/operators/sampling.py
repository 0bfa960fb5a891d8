"""Samples of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bernoulli(points: DataFrame, percent: float, seed: int = 1) -> DataFrame:
    """Each point with a chance of percent / 100."""
    if not 0 <= percent <= 100:
        raise ValueError("a rate lies between 0 and 100 percent")
    return points.sample(False, percent / 100, seed)


def by_id(points: DataFrame, percent: int) -> DataFrame:
    """A sample that depends on ids alone: a multiplicative hash of the id, modulo 100, under percent."""
    if not 0 <= percent <= 100:
        raise ValueError("a rate lies between 0 and 100 percent")
    mixed = F.pmod(F.pmod(F.col("id"), F.lit(1 << 30)) * 2654435761, F.lit(1 << 32))
    return points.where(F.pmod(F.floor(mixed / 65536), F.lit(100)) < percent)
