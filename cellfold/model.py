"""The two frames every operator works on.

``Cells`` is an n-dimensional dataset: one row per element with its axis
positions ``i0 … i(k-1)`` and its value ``v``, plus the shape, which the driver
knows.  A *line* is a plain DataFrame ``[series, pos, v]``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ArgumentError(ValueError):
    """An argument the operator refuses.  Raised before any job is started."""


def axis_name(axis: int) -> str:
    return f"i{axis}"


def element_count(shape) -> int:
    return math.prod(shape)


def strides(shape) -> list[int]:
    """Row-major strides: how far the flat position moves per step of an axis."""
    out, step = [], 1
    for extent in reversed(shape):
        out.append(step)
        step *= extent
    return out[::-1]


def flat_position(axes: list[int], shape) -> Column:
    """Row-major position over ``axes`` (whose extents are ``shape``)."""
    if not axes:
        return F.lit(0).cast("bigint")
    terms = [F.col(axis_name(a)) * F.lit(s) for a, s in zip(axes, strides(shape))]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total.cast("bigint")


def unravelled(position: Column, shape) -> list[Column]:
    """Axis positions of a row-major flat position."""
    return [
        _wheel(position, stride, extent, axis == 0)
        for axis, (stride, extent) in enumerate(zip(strides(shape), shape))
    ]


def _wheel(position: Column, stride: int, extent: int, first: bool) -> Column:
    turned = position if stride == 1 else int_div(position, stride)
    return (turned if first else turned % F.lit(extent)).cast("bigint")


def int_div(value: Column, by: int | Column) -> Column:
    """Exact integer division of a non-negative BIGINT."""
    by = by if isinstance(by, Column) else F.lit(by).cast("bigint")
    return F.call_function("div", value.cast("bigint"), by)


# Whole numbers up to here are exact as doubles.
EXACT = 1 << 53

#: Which places of each axis are needed: increasing, a run or a list.
Box = tuple[range | tuple[int, ...], ...]
#: Longer lists of places are needed from their first to their last.
LISTED = 10_000


def common(left: range, right: range) -> range:
    """The indices that two runs share, again a run."""
    left, right = (t if t.step > 0 else t[::-1] for t in (left, right))
    if not left or not right:
        return range(0)
    shared = math.gcd(left.step, right.step)
    if (right.start - left.start) % shared:
        return range(0)
    step = left.step // shared * right.step
    turns = (right.start - left.start) // shared * pow(left.step // shared, -1, right.step // shared) if right.step > shared else 0
    first = left.start + turns * left.step
    low = max(left.start, right.start)
    return range(first + -(-(low - first) // step) * step, min(left.stop, right.stop), step)


def _in_both(left: range | tuple[int, ...], right: range | tuple[int, ...]) -> range | tuple[int, ...]:
    if isinstance(left, range) and isinstance(right, range):
        return common(left, right)
    short, other = (left, right) if isinstance(left, tuple) else (right, left)
    known = other if isinstance(other, range) else set(other)
    return tuple(k for k in short if k in known)


def listed_places(places) -> range | tuple[int, ...]:
    """A list subscript as one axis of a box."""
    low, high = min(map(min, places)), max(map(max, places))
    if sum(map(len, places)) > LISTED:
        return range(low, high + 1)
    return tuple(sorted({k for run in places for k in run}))


def spanned(low: int, high: int, shape) -> Box:
    """The box of ``shape`` that holds the flat positions ``low`` to ``high``."""
    out, apart = [], False
    for stride, extent in zip(strides(shape), shape):
        if apart:
            out.append(range(extent))
            continue
        first, last = low // stride, high // stride
        out.append(range(first, last + 1))
        apart = first != last
        low, high = low % stride, high % stride
    return tuple(out)


def inside(df: DataFrame, columns: list[str], box: Box, shape) -> DataFrame:
    """Rows whose positions in ``columns`` lie within the box's ends: plain
    comparisons, which reach the scan."""
    for name, places, extent in zip(columns, box, shape):
        if not len(places):
            return df.where(F.lit(False))
        if places[0] > 0:
            df = df.where(F.col(name) >= places[0])
        if places[-1] < extent - 1:
            df = df.where(F.col(name) <= places[-1])
    return df


@dataclass(frozen=True)
class Cells:
    """``integer`` says every element is a whole number; ``limit`` is then the
    largest magnitude one can have, when the driver can prove one.

    ``rows`` makes the frame anew for a box of the shape.  It may hold more than the
    box: it is how a selection is carried back through reshapes, transposes, slices
    and unopened arrays to what is stored.
    """

    df: DataFrame
    shape: tuple[int, ...]
    integer: bool = False
    limit: float | None = None
    rows: Callable[[Box], DataFrame] | None = field(default=None, compare=False, repr=False)

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return element_count(self.shape)

    @property
    def axes(self) -> list[str]:
        return [axis_name(a) for a in range(self.rank)]

    def mapped(self, value: Column, integer: bool, limit: float | None = None) -> "Cells":
        """The same cells with another value; a projection, never a shuffle."""
        select = lambda df: df.select(*self.axes, value.alias("v"))
        return self.of(select(self.df), self.shape, integer, limit, lambda box: select(self.within(box).df))

    def of(self, df: DataFrame, shape, integer: bool = True, limit: float | None = None,
           rows: Callable[[Box], DataFrame] | None = None) -> "Cells":
        """Cells made out of these; whole numbers stay whole where ``integer`` is kept."""
        stays = self.integer and integer
        return Cells(df, tuple(shape), stays, limit if stays else None, rows)

    def within(self, box: Box) -> "Cells":
        """These cells where at least those in ``box`` are there; the shape stays."""
        if all(len(places) == extent for places, extent in zip(box, self.shape)):
            return self
        if self.rows is None:
            return replace(self, df=inside(self.df, self.axes, box, self.shape))
        return replace(self, df=self.rows(box), rows=lambda more: self.rows(tuple(map(_in_both, box, more))))

    def at_most(self, growth) -> float | None:
        """The limit after ``growth`` of it, unknown once it is beyond exactness."""
        if self.limit is None:
            return None
        grown = growth(self.limit)
        return grown if grown <= EXACT else None


def require_number(kind: T.DataType, name: str) -> None:
    """Only integers and floats are numbers: no text, time, flag or struct."""
    if not isinstance(kind, T.NumericType):
        raise ArgumentError(f"{name} holds {kind.simpleString()}, not numbers")


def cells_of(df: DataFrame, axes: list[str], value: str, shape, integer: bool | None = None) -> Cells:
    """Cells from a table whose columns ``axes`` already hold axis positions.

    A missing value becomes NaN, which is what it is in every numeric path.  Whether the
    elements are whole numbers is the column's type, unless ``integer`` says it.
    """
    if len(axes) != len(shape):
        raise ArgumentError(f"{len(axes)} axes for a shape of rank {len(shape)}")
    require_number(df.schema[value].dataType, value)
    if integer is None:
        integer = isinstance(df.schema[value].dataType, T.IntegralType)
    columns = [F.col(a).cast("bigint").alias(axis_name(k)) for k, a in enumerate(axes)]
    number = F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("v")
    # The magnitudes of the smaller integer types.
    limits = {"tinyint": 1 << 7, "smallint": 1 << 15, "int": 1 << 31}
    limit = limits.get(dict(df.dtypes).get(value)) if integer else None
    return Cells(df.select(*columns, number), tuple(shape), integer, limit)
