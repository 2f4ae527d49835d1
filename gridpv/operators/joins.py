"""Joins of rows with a table that is small by nature (one row per key) but has no bound by type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a small side that may be sent to every task.
SMALL_ROWS = 100_000


def small_side(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """``df`` ready for a broadcast join if it has at most ``limit`` rows, else as it is.

    It is computed once, here (an action that brings at most ``limit + 1`` rows to the driver), so a
    join with many rows needs no shuffle of these; beyond the limit the join is an ordinary one.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
