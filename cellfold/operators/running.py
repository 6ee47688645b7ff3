"""Running folds and differences along an axis.

A window over a whole axis would put one line in one task.  Axes longer than a
block are cut into blocks of positions: the running value is taken inside each
block, the block totals are run the same way (again in blocks, if there are that
many), and each block is shifted by what came before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellfold.functions.numbers import is_finite, nan
from cellfold.model import ArgumentError, Cells, axis_name, element_count, flat_position, int_div
from cellfold.runtime import BLOCK, bounded

# A block of this many mantissas in [1, 2) multiplies to less than 2 ** 512.
PRODUCT_BLOCK = 512


def scan_axis(axis, rank: int) -> int | None:
    if axis is None:
        return None
    extent = rank or 1
    at = axis + extent if axis < 0 else axis
    if not 0 <= at < extent:
        raise ArgumentError(f"axis {axis} is out of bounds for rank {rank}")
    return at


def scanned_shape(shape, axis) -> tuple[int, ...]:
    at = scan_axis(axis, len(shape))
    return (element_count(shape),) if at is None or not shape else tuple(shape)


def _flattened(cells: Cells) -> Cells:
    flat = flat_position(list(range(cells.rank)), cells.shape).alias("i0")
    return cells.of(cells.df.select(flat, "v"), (cells.size,), limit=cells.limit)


def _window(keys: list[str], by: str):
    ordered = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return ordered.orderBy(by).rowsBetween(Window.unboundedPreceding, 0)


def running_sum(df: DataFrame, keys: list[str], by: str, value: str, extent: int, groups: int,
                block: int = BLOCK) -> DataFrame:
    """``value`` replaced by its running sum along ``by``, per ``keys``.

    ``extent`` bounds ``by`` and ``groups`` bounds the number of different keys;
    both come from the shape, so no job is needed to know them.  The total of a
    block is its last running value: every sum is taken in the order of positions,
    whatever order rows arrive in, and the rows are shuffled once for both uses.
    """
    if extent <= block:
        return df.withColumn(value, F.sum(value).over(_window(keys, by)))
    home = f"{by}_b"
    cut = df.withColumn(home, int_div(F.col(by), block))
    inside = cut.withColumn(value, F.sum(value).over(_window([*keys, home], by)))
    totals = inside.groupBy(*keys, home).agg(F.max_by(value, by).alias(value))
    blocks = -(-extent // block)
    before = running_sum(totals, keys, home, value, blocks, groups, block).select(
        *keys, (F.col(home) + 1).alias(home), F.col(value).alias("_before")
    )
    joined = inside.join(bounded(before, groups * blocks), [*keys, home], "left")
    shifted = F.when(F.col("_before").isNull(), F.col(value)).otherwise(F.col("_before") + F.col(value))
    return joined.withColumn(value, shifted).select(*df.columns)


def cumsum(cells: Cells, axis=None, block: int = BLOCK) -> Cells:
    shape = scanned_shape(cells.shape, axis)
    at = scan_axis(axis, cells.rank)
    if at is None or cells.rank == 0:
        cells, at = _flattened(cells), 0
    others = [a for k, a in enumerate(cells.axes) if k != at]
    extent = cells.shape[at]
    groups = element_count(cells.shape) // extent if extent else 0
    df = running_sum(cells.df, others, axis_name(at), "v", extent, groups, block)
    return cells.of(df.select(*cells.axes, "v"), shape, limit=cells.at_most(lambda most: most * extent))


# --- running product ----------------------------------------------------------
#
# A double is carried as mantissa and binary exponent, so a block's product
# neither overflows nor vanishes on its own when the running product would not.


def _split(df: DataFrame, mantissa: str, exponent: Column) -> DataFrame:
    """Bring the mantissa column back to about [1, 2), exactly."""
    plain = is_finite(mantissa) & (F.col(mantissa) != 0)
    e = F.floor(F.log2(F.abs(F.col(mantissa))))
    scaled = F.col(mantissa) / F.pow(F.lit(2.0), e)
    return df.withColumns({
        mantissa: F.when(plain, scaled).otherwise(F.col(mantissa)),
        "_e": F.when(plain, exponent + e).otherwise(exponent).cast("bigint"),
    })


def _running_product(df: DataFrame, keys: list[str], by: str, extent: int, groups: int) -> DataFrame:
    """Running (v, _e) along ``by``; blocks of blocks, as running_sum."""
    home = f"{by}_b"
    cut = df.withColumn(home, int_div(F.col(by), PRODUCT_BLOCK))
    over = _window([*keys, home], by)
    inside = cut.withColumns({"v": F.product("v").over(over), "_e": F.sum("_e").over(over)})
    inside = _split(inside, "v", F.col("_e"))
    if extent > PRODUCT_BLOCK:
        totals = inside.groupBy(*keys, home).agg(F.max_by("v", by).alias("v"), F.max_by("_e", by).alias("_e"))
        blocks = -(-extent // PRODUCT_BLOCK)
        before = _running_product(totals, keys, home, blocks, groups).select(
            *keys, (F.col(home) + 1).alias(home), F.col("v").alias("_bv"), F.col("_e").alias("_be")
        )
        joined = inside.join(bounded(before, groups * blocks), [*keys, home], "left")
        first = F.col("_bv").isNull()
        inside = _split(joined.withColumns({
            "v": F.when(first, F.col("v")).otherwise(F.col("_bv") * F.col("v")),
            "_e": F.when(first, F.col("_e")).otherwise(F.col("_be") + F.col("_e")),
        }), "v", F.col("_e"))
    return inside.select(*df.columns)


def cumprod(cells: Cells, axis=None, block: int = BLOCK) -> Cells:
    """Running product.  Once it has overflowed or vanished it stays so, as a
    running product taken element by element does.

    An axis of up to 512 positions (or ``block``, if that is less) is multiplied as it
    stands.  Every longer one is multiplied in blocks of 512 mantissas: the first block
    has the bits of the plain product as long as that keeps within the normal numbers,
    later ones differ from it by the rounding of one more product per level of blocks.
    """
    shape = scanned_shape(cells.shape, axis)
    at = scan_axis(axis, cells.rank)
    if at is None or cells.rank == 0:
        cells, at = _flattened(cells), 0
    others = [a for k, a in enumerate(cells.axes) if k != at]
    by, extent = axis_name(at), cells.shape[at]
    if extent <= min(block, PRODUCT_BLOCK):
        df = cells.df.withColumn("v", F.product("v").over(_window(others, by)))
        return cells.of(df.select(*cells.axes, "v"), shape)
    groups = element_count(cells.shape) // extent
    ran = _running_product(_split(cells.df, "v", F.lit(0)), others, by, extent, groups)
    plain = is_finite("v") & (F.col("v") != 0)
    over = F.min(F.when(plain & (F.col("_e") > 1023), F.col(by))).alias("_over")
    under = F.min(F.when(plain & (F.col("_e") < -1075), F.col(by))).alias("_under")
    ends = ran.groupBy(*others).agg(over, under)
    if others:
        ran = ran.join(bounded(ends, groups), others)
    else:
        both = ends.select(F.struct("_over", "_under").alias("s")).scalar()
        ran = ran.withColumn("_s", both).withColumns(
            {"_over": F.col("_s._over"), "_under": F.col("_s._under")})
    far = F.lit(1 << 62)
    over_at, under_at = F.coalesce("_over", far), F.coalesce("_under", far)
    sign = F.signum("v")
    half = F.floor(F.col("_e") / 2)
    value = F.col("v") * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), F.col("_e") - half)
    value = (
        F.when(F.isnan("v"), nan())
        .when((F.col(by) >= over_at) & (over_at < under_at),
              F.when(F.col("v") == 0, nan()).otherwise(sign * F.lit(float("inf"))))
        .when((F.col(by) >= under_at) & (under_at < over_at),
              F.when(plain | (F.col("v") == 0), sign * F.lit(0.0)).otherwise(nan()))
        .when(~plain, F.col("v"))
        .otherwise(value)
    )
    return cells.of(ran.select(*cells.axes, value.alias("v")), shape)


# --- differences --------------------------------------------------------------


def diff_axis(n: int, axis: int, rank: int) -> int:
    if n < 0:
        raise ArgumentError(f"the order of a difference is not negative, and this is {n}")
    if rank == 0:
        raise ArgumentError("a single value has no difference")
    at = axis + rank if axis < 0 else axis
    if not 0 <= at < rank:
        raise ArgumentError(f"axis {axis} is out of bounds for rank {rank}")
    return at


def diffed_shape(shape, n: int = 1, axis: int = -1) -> tuple[int, ...]:
    if n == 0:
        return tuple(shape)
    at = diff_axis(n, axis, len(shape))
    return tuple((m - n if m > n else 0) if a == at else m for a, m in enumerate(shape))


def with_seam(df: DataFrame, by: str, block: int, reach: int) -> DataFrame:
    """Rows in blocks of ``block`` positions, each block also holding the first
    ``reach`` rows of the next one.  Only those rows are doubled."""
    home = int_div(F.col(by), block)
    lent = (F.col(by) % block < reach) & (home > 0)
    blocks = F.when(lent, F.array(home, home - 1)).otherwise(F.array(home))
    return df.withColumn("_b", F.explode(blocks))


def diff(cells: Cells, n: int = 1, axis: int = -1, block: int = BLOCK) -> Cells:
    """a[1:] - a[:-1], n passes; all passes run in one shuffle."""
    shape = diffed_shape(cells.shape, n, axis)
    if n == 0:
        return cells
    at = diff_axis(n, axis, cells.rank)
    by = axis_name(at)
    others = [a for a in cells.axes if a != by]
    if element_count(shape) == 0:
        return cells.of(cells.df.where(F.lit(False)), shape, limit=cells.limit)
    extent = cells.shape[at]
    block = max(block, n)
    if extent <= block:
        df, keys = cells.df, others
    else:
        df, keys = with_seam(cells.df, by, block, n), [*others, "_b"]
    ordered = Window.partitionBy(*keys).orderBy(by) if keys else Window.partitionBy(F.lit(0)).orderBy(by)
    for _ in range(n):
        df = df.withColumn("v", F.lead("v").over(ordered) - F.col("v"))
    if extent > block:
        df = df.where(int_div(F.col(by), block) == F.col("_b"))
    df = df.where(F.col(by) < extent - n)
    return cells.of(df.select(*cells.axes, "v"), shape, limit=cells.at_most(lambda most: most * 2**n))
