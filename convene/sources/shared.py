"""Storage that the driver and all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir. Where that is unset and all runs in one process,
    as in tests, in a folder beside the warehouse; a cluster without one is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    where = where or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-shared"
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"
