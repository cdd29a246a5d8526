"""Size checks in front of every broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether the table has no more than ``rows`` rows; reads no further than that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a table of proven size. A larger one is joined by shuffle, where adaptive
    execution splits skewed partitions."""
    return F.broadcast(df) if at_most(df, rows) else df
