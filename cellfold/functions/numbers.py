"""Column helpers for doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan() -> Column:
    return F.lit(float("nan"))


def is_finite(value: str | Column) -> Column:
    """Neither NaN nor infinite.  Spark orders NaN above every number."""
    v = F.col(value) if isinstance(value, str) else value
    return F.abs(v) < F.lit(float("inf"))


def round_away(value: Column) -> Column:
    """Nearest whole number, halves away from zero, as BIGINT.

    Written out because adding 0.5 first would round 0.49999999999999994 up.
    """
    low = F.floor(value)
    rest = value - low
    up = F.when(value >= 0, rest >= 0.5).otherwise(rest > 0.5)
    return (low + F.when(up, 1).otherwise(0)).cast("bigint")
