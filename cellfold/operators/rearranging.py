"""Transpose and reshape: the axis columns are renamed or recomputed, nothing moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellfold.model import ArgumentError, Box, Cells, axis_name, element_count, flat_position, spanned, strides, unravelled


def permutation(axes, rank: int) -> list[int]:
    if axes is None:
        return list(range(rank))[::-1]
    out = []
    for a in axes:
        at = a + rank if a < 0 else a
        if not 0 <= at < rank:
            raise ArgumentError(f"axis {a} is out of bounds for rank {rank}")
        out.append(at)
    if len(out) != rank:
        raise ArgumentError(f"a transpose takes all {rank} axes, not {len(out)}")
    if len(set(out)) != rank:
        raise ArgumentError("an axis is repeated")
    return out


def transpose(cells: Cells, axes=None) -> Cells:
    order = permutation(axes, cells.rank)
    moved = [F.col(axis_name(old)).alias(axis_name(new)) for new, old in enumerate(order)]
    turned = lambda df: df.select(*moved, "v")
    back = [order.index(old) for old in range(cells.rank)]
    return cells.of(turned(cells.df), (cells.shape[a] for a in order), limit=cells.limit,
                    rows=lambda box: turned(cells.within(tuple(box[new] for new in back)).df))


def reshaped(size: int, shape, partial: bool = False) -> tuple[int, ...]:
    """The shape asked for, with one -1 worked out from the element count; rounded up where
    the last places may stay without an element."""
    shape = [shape] if isinstance(shape, int) else list(shape)
    if not shape:
        raise ArgumentError("a shape is missing")
    if any(n < -1 for n in shape):
        raise ArgumentError("no extent but -1 is negative")
    if shape.count(-1) > 1:
        raise ArgumentError("-1 appears at most once")
    known = element_count([n for n in shape if n != -1])
    if -1 in shape:
        if known == 0 or size % known and not partial:
            raise ArgumentError(f"{size} elements leave no whole extent over {known}")
        shape[shape.index(-1)] = -(-size // known)
    elif known != size:
        raise ArgumentError(f"a shape of {known} elements for {size}")
    return tuple(shape)


def reshape(cells: Cells, shape, partial: bool = False) -> Cells:
    """The same elements in another shape.  A box of it needs one span of flat positions,
    which is a box of the cells reshaped.  With ``partial``, elements that do not come out
    even over a -1 all stay: it is rounded up, and the frame has no rows for the places
    after the last element."""
    target = reshaped(cells.size, shape, partial)
    flat = flat_position(list(range(cells.rank)), cells.shape)
    axes = [c.alias(axis_name(k)) for k, c in enumerate(unravelled(F.col("_flat"), target))]
    laid_out = lambda df: df.select(flat.alias("_flat"), "v").select(*axes, "v")

    def rows(box: Box) -> DataFrame:
        if not all(map(len, box)):
            return laid_out(cells.df.where(F.lit(False)))
        low, high = (sum(places[end] * stride for places, stride in zip(box, strides(target))) for end in (0, -1))
        high = min(high, cells.size - 1)
        if low > high:  # only places after the last element
            return laid_out(cells.df.where(F.lit(False)))
        return laid_out(cells.within(spanned(low, high, cells.shape)).df)

    return cells.of(laid_out(cells.df), target, limit=cells.limit, rows=rows)
