"""Folds over axes, and extents of lines.

Every fold is a hash aggregate with partial sums on the map side, so a key that
holds most of the cells never gathers in one task.
"""

from __future__ import annotations

import builtins

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellfold.functions.numbers import is_finite, nan
from cellfold.model import EXACT, ArgumentError, Cells, axis_name, element_count, unravelled
from cellfold.operators.elementwise import whole
from cellfold.operators.grids import extents_of

# Below this many binary orders of magnitude no order of multiplying overflows.
SAFE_EXPONENT = 1020.0


def fold_axes(axis, rank: int) -> list[int]:
    """The axes a fold removes; None is all of them."""
    if axis is None:
        return list(range(rank))
    named = list(axis) if isinstance(axis, (list, tuple)) else [axis]
    if rank == 0 and not isinstance(axis, (list, tuple)) and axis in (0, -1):
        return []
    out = []
    for a in named:
        at = a + rank if a < 0 else a
        if not 0 <= at < rank:
            raise ArgumentError(f"axis {a} is out of bounds for rank {rank}")
        out.append(at)
    if len(set(out)) != len(out):
        raise ArgumentError("an axis is repeated")
    return out


def folded_shape(shape, axis, identity: bool) -> tuple[int, ...]:
    axes = fold_axes(axis, len(shape))
    empty = builtins.any(shape[a] == 0 for a in axes) or (not axes and element_count(shape) == 0)
    if empty and not identity:
        raise ArgumentError("an empty axis has no minimum or maximum")
    return tuple(n for a, n in enumerate(shape) if a not in axes)


def _fold(cells: Cells, axis, value: Column, empty: float | None, integer: bool, limit: float | None = None) -> Cells:
    shape = folded_shape(cells.shape, axis, empty is not None)
    gone = fold_axes(axis, cells.rank)
    kept = [axis_name(a) for a in range(cells.rank) if a not in gone]
    if cells.size == 0 and element_count(shape) > 0:
        # Nothing to group: every cell of the result is the fold's start value.
        spots = cells.df.sparkSession.range(element_count(shape))
        axes = [c.alias(axis_name(k)) for k, c in enumerate(unravelled(F.col("id"), shape))]
        return cells.of(spots.select(*axes, F.lit(float(empty)).alias("v")), shape, integer)
    folded = cells.df.groupBy(*kept).agg(value.alias("v"))
    axes = [F.col(name).alias(axis_name(k)) for k, name in enumerate(kept)]
    return cells.of(folded.select(*axes, "v"), shape, integer, limit)


def min(cells: Cells, axis=None) -> Cells:  # noqa: A001 - the operator's own name
    """NaN anywhere wins.  Spark's min skips NaN, its max does not."""
    value = F.when(F.isnan(F.max("v")), nan()).otherwise(F.min("v"))
    return _fold(cells, axis, value, None, True, cells.limit)


def max(cells: Cells, axis=None) -> Cells:  # noqa: A001
    return _fold(cells, axis, F.max("v"), None, True, cells.limit)


def sum(cells: Cells, axis=None, initial: float = 0.0, reproducible: bool = False) -> Cells:  # noqa: A001
    """Sums in the order rows arrive in, one shuffle; with ``reproducible`` the same bits
    whatever that order is, at the price of a second shuffle of a few rows a result.

    A reproducible sum is exact up to one rounding for each 8 powers of two that occur
    among the addends.  It overflows only if it is too large itself.
    """
    limit = cells.at_most(lambda most: most * cells.size + abs(initial))
    total = F.sum("v")
    if reproducible and not (cells.integer and limit is not None and limit < EXACT):
        gone = fold_axes(axis, cells.rank)
        kept = [axis_name(a) for a in range(cells.rank) if a not in gone]
        cells, total = cells.of(_in_bins(cells.df, kept), cells.shape, limit=cells.limit), _of_bins()
    value = total if initial == 0 else total + F.lit(float(initial))
    return _fold(cells, axis, value, initial, whole(initial), limit)


# --- sums that do not depend on the order of arrival --------------------------
#
# Addends of one magnitude, 8 powers of two wide, are whole multiples of one power of two,
# below 2 ** 62 of it.  Whole numbers are added exactly in any order; each is added in three
# pieces of 21 bits, so that a BIGINT holds the sums of 2 ** 42 rows.

BIN_POWERS, PIECE = 8, 21


def _power_of_two(exponent: Column) -> list[Column]:
    """2 ** exponent as two factors, either of which is an ordinary double."""
    half = F.floor(exponent / 2)
    return [F.pow(F.lit(2.0), half), F.pow(F.lit(2.0), exponent - half)]


def _in_bins(df: DataFrame, kept: list[str]) -> DataFrame:
    """[*kept, _bin, the sums of three pieces, _other]: a row for each magnitude."""
    plain = is_finite("v") & (F.col("v") != 0)
    # Subnormal numbers are multiples of the same power as the least normal ones.
    power = F.greatest(F.floor(F.log2(F.abs("v"))), F.lit(-1022))
    held = df.select(*kept, "v", F.when(plain, F.floor(power / BIN_POWERS)).alias("_bin"))
    up, more = _power_of_two(53 - BIN_POWERS * F.col("_bin"))
    placed = held.withColumn("_n", (F.col("v") * up * more).cast("bigint"))
    low = F.lit((1 << PIECE) - 1).cast("bigint")
    pieces = [F.col("_n").bitwiseAND(low), F.shiftright("_n", PIECE).bitwiseAND(low), F.shiftright("_n", 2 * PIECE)]
    return placed.groupBy(*kept, "_bin").agg(
        *[F.sum(F.when(F.col("_bin").isNotNull(), piece)).alias(f"_p{k}") for k, piece in enumerate(pieces)],
        F.sum(F.when(F.col("_bin").isNull(), F.col("v"))).alias("_other"))


def _of_bins() -> Column:
    """The bins of a result, at most 256, added from the smallest magnitude up."""
    whole_part = lambda k: F.col(f"_p{k}").cast("decimal(38,0)") * F.lit(1 << (PIECE * k)).cast("decimal(19,0)")
    exact = (whole_part(0) + whole_part(1) + whole_part(2)).cast("double")
    down, more = _power_of_two(BIN_POWERS * F.col("_bin") - 53)
    bins = F.array_sort(F.collect_list(F.when(F.col("_bin").isNotNull(), F.struct("_bin", (exact * down * more).alias("total")))))
    added = F.aggregate(bins, F.lit(0.0), lambda so_far, one: so_far + one["total"])
    # Infinities and NaN decide alone; zeros add nothing.
    other = F.sum("_other")
    return F.when(is_finite(F.coalesce(other, F.lit(0.0))), added).otherwise(other)


def product_of(v: Column) -> Column:
    """A product that does not depend on the order rows arrive in.

    While the factors cannot leave the range of a double in any order, it is
    the plain product.  Beyond that it is put together from the sum of their
    logarithms, with zeros, infinities and signs counted apart.
    """
    size = F.log2(F.abs(v))
    usable = is_finite(v) & (v != 0)
    up = F.coalesce(F.sum(F.when(usable & (size > 0), size)), F.lit(0.0))
    down = F.coalesce(F.sum(F.when(usable & (size < 0), -size)), F.lit(0.0))
    sign = F.when(F.sum(F.when(v < 0, 1).otherwise(0)) % 2 == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    endless = F.max(F.abs(v)) == F.lit(float("inf"))
    zero = F.min(F.abs(v)) == 0
    logs = up - down
    far = (
        F.when(F.isnan(F.max(v)), nan())
        .when(endless, F.when(zero, nan()).otherwise(sign * F.lit(float("inf"))))
        .when(zero, sign * F.lit(0.0))
        .otherwise(sign * F.pow(F.lit(2.0), F.floor(logs)) * F.pow(F.lit(2.0), logs - F.floor(logs)))
    )
    safe = (up < SAFE_EXPONENT) & (down < SAFE_EXPONENT)
    return F.when(safe, F.product(v)).otherwise(far)


def prod(cells: Cells, axis=None, initial: float = 1.0) -> Cells:
    value = product_of(F.col("v"))
    if initial != 1:
        value = value * F.lit(float(initial))
    return _fold(cells, axis, value, initial, whole(initial))


# --- extents of lines ---------------------------------------------------------


def _finite(column: str = "v") -> Column:
    return F.when(is_finite(column), F.col(column))


def finite_extent(lines: DataFrame) -> DataFrame:
    """min, max and count of the finite values of every series."""
    return lines.groupBy("series").agg(
        F.min(_finite()).alias("lo"),
        F.max(_finite()).alias("hi"),
        F.count(_finite()).alias("points"),
    ).withColumn("has_finite", F.col("points") > 0)


def positive_minimum(lines: DataFrame) -> DataFrame:
    """Smallest value above zero of every series: where a log axis starts."""
    positive = F.when(is_finite("v") & (F.col("v") > 0), F.col("v"))
    return lines.groupBy("series").agg(F.min(positive).alias("positive_min"))


def axis_extents(lines: DataFrame, separate: list) -> DataFrame:
    """One y extent for the series on the common axis, one for each separate axis.

    A separate axis is in force only when more than one series is drawn.
    ``axis`` is the series of a separate axis and null for the common one.
    """
    per_series = lines.groupBy("series").agg(
        F.min(_finite()).alias("lo"),
        F.max(_finite()).alias("hi"),
        F.count(_finite()).alias("points"),
        F.min(F.when(is_finite("v") & (F.col("v") > 0), F.col("v"))).alias("pos"),
    )
    drawn = per_series.agg(F.count(F.lit(1)).alias("n")).scalar()
    own = F.col("series").isin(list(separate)) & (drawn > 1)
    axis = F.when(own, F.col("series").cast("string"))
    return per_series.groupBy(axis.alias("axis")).agg(
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.min("pos").alias("positive_min"),
        F.sum("points").alias("points"),
        F.count(F.lit(1)).alias("series_count"),
    )


def time_extents(bases: DataFrame) -> DataFrame:
    """x extent over every time base in use; a flat one gets a unit of width.

    ``bases`` holds the values ``v`` of all the bases.  With nothing finite the
    axis runs from 0 to 1.
    """
    found = bases.agg(
        F.min(_finite()).alias("lo"),
        F.max(_finite()).alias("hi"),
        F.min(F.when(is_finite("v") & (F.col("v") > 0), F.col("v"))).alias("pos"),
    )
    high = F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1.0).otherwise(F.col("hi"))
    return found.select(
        F.coalesce("lo", F.lit(0.0)).alias("x_min"),
        F.coalesce(high, F.lit(1.0)).alias("x_max"),
        F.coalesce("pos", F.lit(0.0)).alias("x_positive_min"),
    )


def sampled_extent(grid: DataFrame, n: int = 256, extents: tuple[int, int] | None = None) -> DataFrame:
    """Extent from at most n x n strided cells of a grid."""
    row_stride, column_stride = (builtins.max(1, -(-extent // n)) for extent in extents or extents_of(grid))
    picked = grid.where((F.col("row") % row_stride == 0) & (F.col("col") % column_stride == 0))
    return picked.agg(F.min(_finite()).alias("lo"), F.max(_finite()).alias("hi"),
                      F.count(_finite()).alias("points"))


def axis_length(lines: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Positions the x axis has: the base's length, else the longest line; at least 1."""
    if base is not None:
        return base.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("axis_length"))
    counts = lines.groupBy("series").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.greatest(F.coalesce(F.max("n"), F.lit(1)), F.lit(1)).alias("axis_length"))
