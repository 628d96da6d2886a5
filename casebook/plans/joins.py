"""Join helpers: broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only when it has at most ``max_rows`` rows.

    The check is a ``limit(max_rows + 1).count()`` job, which stops reading
    as soon as the bound is exceeded.  Beyond the bound the frame is returned
    unhinted and the planner (AQE with runtime sizes) picks a shuffle join.
    Use this for sides whose size is not bounded by construction.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def broadcast_bounded(df: DataFrame) -> DataFrame:
    """Broadcast a side whose row count is bounded by construction (k modes,
    a thresholds table, top-K per column, itemsets above a support floor).
    Callers state the bound next to the call."""
    return F.broadcast(df)
