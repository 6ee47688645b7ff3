"""Rows and cells as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellfold.functions import text
from cellfold.model import ArgumentError, Cells
from cellfold.operators.grids import cell_labels, grid_extents


def to_json(df: DataFrame, column: str, name: str = "json") -> DataFrame:
    """``df`` with a struct column as JSON."""
    return df.withColumn(name, text.json_text(F.col(column), df.schema[column].dataType))


def fields(df: DataFrame, column: str, json: bool = False) -> DataFrame:
    """A struct opened into rows: the other columns, then name, type and value, and with
    ``json`` the value as JSON beside its text."""
    kind = df.schema[column].dataType
    if not hasattr(kind, "fields"):
        raise ArgumentError(f"{column} is {kind.simpleString()}, not a struct")
    opened = F.array(*[
        F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"),
                 text.element_text(F.col(column)[f.name], f.dataType).alias("value"),
                 *([text.json_text(F.col(column)[f.name], f.dataType).alias("json")] if json else []))
        for f in kind.fields
    ])
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(opened).alias("_f")).select(*rest, "_f.*")


def element_text(df: DataFrame, column: str, name: str = "text") -> DataFrame:
    """``df`` with a column as one-line text."""
    return df.withColumn(name, text.element_text(F.col(column), df.schema[column].dataType))


def format_floats(cells: Cells, how: str = "shortest", decimals: int = 6) -> DataFrame:
    """The cells with ``text``; whole-number cells keep their digits."""
    shown = text.format_float(F.col("v"), "shortest" if cells.integer else how, decimals)
    return cells.df.withColumn("text", shown)


def text_list(cells: Cells, x_axes=None, y_axes=None, how: str = "shortest", decimals: int = 6) -> DataFrame:
    """[at, label, text, length] of the cells in reading order."""
    _, columns = grid_extents(cells, x_axes, y_axes)
    labelled = cell_labels(cells, x_axes, y_axes)
    shown = text.format_float(F.col("v"), how, decimals)
    return labelled.select((F.col("row") * columns + F.col("col")).alias("at"), F.col("cell_label").alias("label"),
                           shown.alias("text"), F.length(shown).alias("length"))


def widest_cell(grid: DataFrame, row0: int, rows: int, col0: int, cols: int, shown: Column | None = None) -> DataFrame:
    """[col, widest]: the longest rendered cell of each column in a rectangle."""
    shown = text.shortest(F.col("v")) if shown is None else shown
    inside = grid.where((F.col("row") >= row0) & (F.col("row") < row0 + rows)
                        & (F.col("col") >= col0) & (F.col("col") < col0 + cols))
    return inside.groupBy("col").agg(F.max(F.length(shown)).alias("widest"))
