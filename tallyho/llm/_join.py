"""Joins against tables whose size is measured before they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of a narrow table (keys and a few numbers) that a join broadcasts.
BROADCAST_ROWS = 200_000


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether a written table has at most ``max_rows`` rows."""
    return df.limit(max_rows + 1).count() <= max_rows


def attach(left: DataFrame, written: DataFrame, keys: list[str], how: str = "inner",
           max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Null-safe equi-join of ``left`` with a written table on equally named keys.

    The right side is broadcast only when its counted rows are within
    ``max_rows``; beyond that it is a plain shuffle join, whose hot keys AQE splits.
    """
    right = written.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in written.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(right[f"__r_{k}"])
        cond = c if cond is None else cond & c
    if fits(written, max_rows):
        right = F.broadcast(right)
    return left.join(right, cond, how).drop(*[f"__r_{k}" for k in keys])
