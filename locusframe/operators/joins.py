"""Joins with a small side, broadcast only behind a check of its size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST = 1_000_000


def broadcast_up_to(df: DataFrame, rows: int = MAX_BROADCAST) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; else Spark shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
