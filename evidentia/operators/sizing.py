"""Broadcast only behind a size bound.

A side is broadcast when an upper bound of its size is known and below the
limit; otherwise the join is left to the planner (shuffle join, with AQE
free to switch to a broadcast once it has measured the real size).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_BYTES = 64 << 20


def broadcast_if_bounded(df: DataFrame, rows_bound: int | None, row_bytes: int,
                         limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    if rows_bound is not None and rows_bound * row_bytes <= limit:
        return F.broadcast(df)
    return df


MAX_SPREAD = 256


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan over the cores before CPU-heavy per-row work when it
    comes from fewer files than there are cores (one big file with one row
    group), up to MAX_SPREAD tasks. A scan of many files is already
    spread and is left alone, so at scale this adds no shuffle."""
    target = min(df.sparkSession.sparkContext.defaultParallelism, MAX_SPREAD)
    files = len(df.inputFiles())        # from the plan: no stage is run to decide
    if 0 < files < target:
        return df.repartition(target)
    return df
