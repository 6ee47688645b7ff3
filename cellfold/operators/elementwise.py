"""Element-wise operations: projections that stay inside whole-stage codegen."""

from __future__ import annotations

import builtins
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellfold.functions.numbers import is_finite, nan
from cellfold.model import ArgumentError, Cells
from cellfold.runtime import small_table


def _number(value, name: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ArgumentError(f"{name} has to be a number")
    return float(value)


def whole(value) -> bool:
    return value is None or (math.isfinite(value) and float(value).is_integer())


def abs(cells: Cells) -> Cells:  # noqa: A001 - the operator's own name
    return cells.mapped(F.abs("v"), True, cells.limit)


def sqrt(cells: Cells) -> Cells:
    return cells.mapped(F.sqrt("v"), False)


def pow(cells: Cells, exponent: float) -> Cells:  # noqa: A001
    """C's pow; one half is the square root, which differs at -0 and -inf.

    Java's pow says NaN for (±1) ** ±inf and 1 ** NaN where C says 1.
    """
    e = _number(exponent, "exponent")
    if e == 0.5:
        return cells.mapped(F.sqrt("v"), False)
    value = F.pow("v", F.lit(e))
    if math.isinf(e):
        value = F.when(F.abs("v") == 1.0, F.lit(1.0)).otherwise(value)
    elif math.isnan(e):
        value = F.when(F.col("v") == 1.0, F.lit(1.0)).otherwise(value)
    kept = whole(e) and e >= 0
    limit = cells.at_most(lambda most: math.inf if math.log2(max(most, 1)) * e > 53 else max(most, 1) ** e) if kept else None
    return cells.mapped(value, kept, limit)


def add(cells: Cells, value: float) -> Cells:
    term = _number(value, "value")
    return cells.mapped(F.col("v") + F.lit(term), whole(term), cells.at_most(lambda most: most + math.fabs(term)))


def multiply(cells: Cells, factor: float) -> Cells:
    by = _number(factor, "factor")
    return cells.mapped(F.col("v") * F.lit(by), whole(by), cells.at_most(lambda most: most * math.fabs(by)))


def clip(cells: Cells, min: float | None = None, max: float | None = None) -> Cells:  # noqa: A002
    """Floor, then ceiling.  A missing bound is no bound; a NaN bound makes all NaN."""
    low = None if min is None else _number(min, "min")
    high = None if max is None else _number(max, "max")
    v = F.col("v")
    value = v
    if any(b is not None and math.isnan(b) for b in (low, high)):
        value = nan()
    elif low is not None and high is not None:
        floored = F.when(v < low, F.lit(low)).otherwise(v)
        value = F.when(floored > high, F.lit(high)).otherwise(floored)
    elif low is not None:
        value = F.when(v > low, v).otherwise(F.lit(low))
    elif high is not None:
        value = F.when(v < high, v).otherwise(F.lit(high))
    kept = F.when(F.isnan(v), v).otherwise(value)
    ends = [math.fabs(b) for b in (low, high) if b is not None]
    limit = cells.at_most(lambda most: builtins.max(most, *ends) if ends else most)
    return cells.mapped(kept, whole(low) and whole(high), limit)


def normalize(cells: Cells, min: float = 0.0, max: float = 1.0) -> Cells:  # noqa: A002
    """The finite extent mapped linearly onto [min, max]; both ends are exact."""
    lo, hi = _number(min, "min"), _number(max, "max")
    finite = F.when(is_finite("v"), F.col("v"))
    # One row by construction, so a scalar subquery rather than a join.
    extent = cells.df.agg(F.struct(F.min(finite).alias("lo"), F.max(finite).alias("hi")).alias("x")).scalar()
    low, high = F.col("_x.lo"), F.col("_x.hi")
    # Halving both ends keeps a span beyond the largest double finite.
    half = F.when(is_finite(high - low), F.lit(1.0)).otherwise(F.lit(0.5))
    span = high * half - low * half
    t = F.when(span > 0.0, (F.col("v") * half - low * half) / F.nullif(span, F.lit(0.0))).otherwise(F.lit(0.0))
    value = F.when(is_finite("v"), (F.lit(1.0) - t) * lo + t * hi).otherwise(F.col("v"))
    placed = cells.df.withColumn("_x", extent)
    return Cells(placed.select(*cells.axes, value.alias("v")), cells.shape, False)


def move(lines: DataFrame, moves: DataFrame) -> DataFrame:
    """Per-series scale and shift; ``moves`` is [series, scale, shift].

    A scale that is not finite and above zero leaves the line as it is.
    """
    usable = moves.where(is_finite("scale") & (F.col("scale") > 0) & is_finite("shift"))
    moved = lines.join(small_table(usable.select("series", "scale", "shift")), "series", "left")
    value = F.when(F.col("scale").isNull(), F.col("v")).otherwise(F.col("v") * F.col("scale") + F.col("shift"))
    return moved.select("series", "pos", value.alias("v"))


def range_axis(lines: DataFrame, start: float = 0.0, step: float = 1.0) -> DataFrame:
    """x = start + pos * step; the index axis is start 0, step 1."""
    x = F.lit(float(start)) + F.col("pos") * F.lit(float(step))
    return lines.select("series", "pos", x.alias("x"), "v")


def range_to_positions(ranges: DataFrame, start: float, step: float) -> DataFrame:
    """[lo, hi] of x as positions along a range axis, ordered.

    A range that is not finite or has no width once inverted gives nulls.
    """
    if not math.isfinite(start) or not math.isfinite(step) or step == 0:
        raise ArgumentError("a range axis needs a finite start and a finite step other than 0")
    a, b = ((F.col(c) - F.lit(float(start))) / F.lit(float(step)) for c in ("lo", "hi"))
    low, high = F.least(a, b), F.greatest(a, b)
    usable = is_finite(a) & is_finite(b) & (high > low)
    return ranges.withColumns({"pos_lo": F.when(usable, low), "pos_hi": F.when(usable, high)})


def log_gaps(lines: DataFrame) -> DataFrame:
    """What a logarithmic axis cannot show becomes a gap."""
    return lines.withColumn("v", F.when(F.col("v") > 0, F.col("v")).otherwise(nan()))


def flip_xy(points: DataFrame) -> DataFrame:
    """x and y exchanged; every other column stays."""
    other = [c for c in points.columns if c not in ("x", "y")]
    return points.select(*other, F.col("y").alias("x"), F.col("x").alias("y"))
