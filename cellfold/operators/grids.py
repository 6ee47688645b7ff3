"""A dataset laid out as a table: axes over rows and columns, blocks, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellfold.model import ArgumentError, Cells, element_count, flat_position, unravelled


def default_axes(rank: int) -> tuple[list[int], list[int]]:
    """(row axes, column axes): the last axis on columns, a single one down the rows."""
    if rank <= 1:
        return list(range(rank)), []
    return list(range(rank - 1)), [rank - 1]


def _layout(cells: Cells, x_axes, y_axes) -> tuple[list[int], list[int]]:
    if x_axes is None and y_axes is None:
        return default_axes(cells.rank)
    xs = sorted(x_axes or [])
    ys = sorted(y_axes if y_axes is not None else set(range(cells.rank)) - set(xs))
    if sorted(xs + ys) != list(range(cells.rank)):
        raise ArgumentError("every axis lies either on rows or on columns")
    return ys, xs


def grid_extents(cells: Cells, x_axes=None, y_axes=None) -> tuple[int, int]:
    ys, xs = _layout(cells, x_axes, y_axes)
    return element_count([cells.shape[a] for a in ys]), element_count([cells.shape[a] for a in xs])


def grid(cells: Cells, x_axes=None, y_axes=None) -> DataFrame:
    """[row, col, v]: the axes spread over rows and columns, the last one fastest."""
    ys, xs = _layout(cells, x_axes, y_axes)
    row = flat_position(ys, [cells.shape[a] for a in ys]).alias("row")
    col = flat_position(xs, [cells.shape[a] for a in xs]).alias("col")
    return cells.df.select(row, col, "v")


def extents_of(table: DataFrame) -> tuple[int, int]:
    """Rows and columns of a grid whose shape is not at hand: one aggregate."""
    found = table.agg(F.max("row").alias("r"), F.max("col").alias("c")).first()
    return (0, 0) if found.r is None else (found.r + 1, found.c + 1)


def grid_block(table: DataFrame, row0: int, col0: int, rows: int = 64, cols: int = 64) -> DataFrame:
    """One block as wide rows [row, c<col0>, …]; the filter reaches the scan."""
    block = table.where((F.col("row") >= row0) & (F.col("row") < row0 + rows)
                        & (F.col("col") >= col0) & (F.col("col") < col0 + cols))
    wide = [F.max(F.when(F.col("col") == c, F.col("v"))).alias(f"c{c}") for c in range(col0, col0 + cols)]
    return block.groupBy("row").agg(*wide)


def _label(positions: dict[int, object], shown: set[int], rank: int):
    if rank == 0:
        return F.lit("")
    if rank == 1:
        return positions[0].cast("string") if 0 in shown else F.lit("")
    parts = [positions[a].cast("string") if a in shown else F.lit("_") for a in range(rank)]
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def cell_labels(cells: Cells, x_axes=None, y_axes=None) -> DataFrame:
    """[row, col, v, cell_label, row_label, col_label], computed from row and col."""
    ys, xs = _layout(cells, x_axes, y_axes)
    table = grid(cells, xs, ys)
    positions = dict(zip(ys, unravelled(F.col("row"), [cells.shape[a] for a in ys])))
    positions |= dict(zip(xs, unravelled(F.col("col"), [cells.shape[a] for a in xs])))
    every, rank = set(range(cells.rank)), cells.rank
    return table.select(
        "row", "col", "v",
        _label(positions, every, rank).alias("cell_label"),
        _label(positions, set(ys), rank).alias("row_label"),
        _label(positions, set(xs), rank).alias("col_label"),
    )


def line_expressions(cells: Cells, path: str, along: int | None = None) -> DataFrame:
    """[line, expression]: text naming every 1-D line, as ``/cube[1, 2, :]``.

    ``along`` is the axis the lines run on, the last one when not given.
    """
    if cells.rank == 0:
        raise ArgumentError("a single value holds no line")
    runs = cells.rank - 1 if along is None else along
    others = [a for a in range(cells.rank) if a != runs]
    held = unravelled(F.col("line"), [cells.shape[a] for a in others])
    at = dict(zip(others, held))
    parts = [F.lit(":") if a == runs else at[a].cast("string") for a in range(cells.rank)]
    lines = cells.df.sparkSession.range(element_count([cells.shape[a] for a in others])).withColumnRenamed("id", "line")
    return lines.select("line", F.concat(F.lit(f"{path}["), F.concat_ws(", ", *parts), F.lit("]")).alias("expression"))
