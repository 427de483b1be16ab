"""Broadcasts with a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL_ROWS = 500_000


def is_small(rows: DataFrame, limit: int = SMALL_ROWS) -> bool:
    """Counted, not guessed, and no further than just past the limit."""
    return rows.limit(limit + 1).count() <= limit


def broadcast_if_small(
    rows: DataFrame, bound: DataFrame | None = None, limit: int = SMALL_ROWS
) -> DataFrame:
    """Hint a broadcast for a table of at most ``limit`` narrow rows.

    ``bound`` is a cheaper table known to have as many rows. A larger table stays
    an ordinary join, whose skewed partitions adaptive execution splits.
    """
    return F.broadcast(rows) if is_small(rows if bound is None else bound, limit) else rows
