"""Fields of struct-typed datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellfold.model import ArgumentError, Box, Cells, axis_name, inside
from cellfold.sources.tables import opened_axis


def field_type(df: DataFrame, path: str) -> T.DataType:
    """The type a member path lands on; an unknown name is an error that lists
    the names there are."""
    kind: T.DataType = df.schema
    for name in path.split("."):
        if not isinstance(kind, T.StructType):
            raise ArgumentError(f"there is no .{name}: this holds {kind.simpleString()}")
        if name not in kind.fieldNames():
            raise ArgumentError(f"there is no field {name}; there are {', '.join(kind.fieldNames())}")
        kind = kind[name].dataType
    return kind


def select_member(df: DataFrame, path: str, keys: list[str], shape: tuple[int, ...], dims: tuple[int, ...] = (),
                  sub: int | None = None) -> Cells:
    """One field of a struct as a dataset of its own.

    ``keys`` hold the positions along ``shape``.  The dims of an array field
    become trailing axes; ``sub`` holds the first of them at one index without
    opening the array.  Only the field is read from storage.
    """
    kind = field_type(df, path)
    keyed = [F.col(k).cast("bigint").alias(axis_name(a)) for a, k in enumerate(keys)]
    value, shape, dims = F.col(path), tuple(shape), tuple(dims)
    if sub is not None:
        if not isinstance(kind, T.ArrayType) or not dims:
            raise ArgumentError(f"{path} is {kind.simpleString()}, which has no axis to index")
        if not -dims[0] <= sub < dims[0]:
            raise ArgumentError(f"index {sub} is outside an axis of {dims[0]}")
        value, kind, dims = F.get(value, F.lit(sub % dims[0])), kind.elementType, dims[1:]
    inner, rank = kind, len(keys)
    for _ in dims:
        if not isinstance(inner, T.ArrayType):
            raise ArgumentError(f"{path} has fewer dims than {dims}")
        inner = inner.elementType
    names = [axis_name(a) for a in range(rank + len(dims))]
    bare, number = df.select(*keyed, value.alias("v")), isinstance(inner, T.NumericType)

    def rows(box: Box) -> DataFrame:
        out = inside(bare, names[:rank], box, shape)
        for k in range(len(dims)):
            out = opened_axis(out.withColumnRenamed("v", "_a"), names[:rank + k], box[rank + k])
        return out.withColumn("v", F.coalesce(F.col("v").cast("double"), F.lit(float("nan")))) if number else out

    shape = (*shape, *dims)
    return Cells(rows(tuple(map(range, shape))), shape, isinstance(inner, T.IntegralType), rows=rows)


def vlen_at(df: DataFrame, field: str, k: int, keys: list[str], shape: tuple[int, ...]) -> Cells:
    """The k-th element of a ragged list; shorter lists give a missing cell.

    The lists have no common extent, so a negative index or a range is refused.
    """
    kind = field_type(df, field)
    if not isinstance(kind, T.ArrayType):
        raise ArgumentError(f"{field} is {kind.simpleString()}, not a list")
    if isinstance(k, bool) or not isinstance(k, int) or k < 0:
        raise ArgumentError("a ragged list takes one index counted from its start")
    keyed = [F.col(c).cast("bigint").alias(axis_name(a)) for a, c in enumerate(keys)]
    value = F.get(F.col(field), F.lit(k))
    if isinstance(kind.elementType, T.NumericType):
        value = F.coalesce(value.cast("double"), F.lit(float("nan")))
    return Cells(df.select(*keyed, value.alias("v")), tuple(shape), isinstance(kind.elementType, T.IntegralType))
