"""Lines against a time base: point for point, stretched, or each its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellfold.functions.numbers import round_away
from cellfold.model import ArgumentError
from cellfold.operators.ordering import sort_order
from cellfold.operators.selecting import lengths
from cellfold.operators.summaries import log_columns
from cellfold.runtime import BROADCAST_ROWS, bounded, same_keys, small_side, small_table


def against_time_base(lines: DataFrame, base: DataFrame) -> DataFrame:
    """[series, pos, x, v]: sample i at x = base[i]; what has no partner is not drawn."""
    return lines.join(small_table(base.select("pos", F.col("v").alias("x"))), "pos").select("series", "pos", "x", "v")


def _asked_for(places: DataFrame, rows: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The side of a base for a join with ``rows`` by ``keys``.

    Many short lines ask for few places, on which all their rows would meet in a
    shuffle.  So a base too long to broadcast is cut down to the places that are asked
    for, found by an aggregate that combines in every task first; what is left is
    broadcast if it is short, and else no place has much of the rows.
    """
    if count <= BROADCAST_ROWS:
        return bounded(places, count)
    return small_side(places.join(rows.select(*keys).distinct(), keys, "left_semi"))


def _spread(lines: DataFrame, axis_length: int) -> DataFrame:
    counted = same_keys(lines, small_side(lengths(lines)), ["series"])
    at = F.col("pos") * F.lit(axis_length - 1) / F.nullif(F.col("n") - 1, F.lit(0))
    return counted.withColumn("at", F.when(F.col("n") > 1, at).otherwise(F.col("pos").cast("double")))


def stretch(lines: DataFrame, axis_length: int) -> DataFrame:
    """[series, pos, at, v]: n samples over the whole axis, first and last at its ends."""
    if axis_length < 1:
        raise ArgumentError("an axis has at least one position")
    return _spread(lines, axis_length).select("series", "pos", "at", "v")


def stretch_against(lines: DataFrame, base: DataFrame, axis_length: int | None = None) -> DataFrame:
    """Stretched over a base, then x is the base at the nearest position."""
    n = base.count() if axis_length is None else axis_length
    near = stretch(lines, max(n, 1)).withColumn("_k", round_away(F.col("at")))
    places = base.select(F.col("pos").alias("_k"), F.col("v").alias("x"))
    joined = near.join(_asked_for(places, near, ["_k"], n if axis_length is None else base.count()), "_k")
    return joined.select("series", "pos", "at", "x", "v")


def own_time_bases(lines: DataFrame, assign: DataFrame, bases: DataFrame, default: str,
                   stretch_to: int | None = None) -> DataFrame:
    """[series, base, pos, x, v], each series against the base it names.

    ``assign`` is [series, base] for the series that name one, ``bases`` is
    [base, pos, v].  With ``stretch_to`` the series on the default base are
    stretched; one with a base of its own never is.  A series whose base is not
    there is not drawn.
    """
    named = assign.select("series", F.trim("base").alias("_own")).where(F.col("_own") != "")
    chosen = lines.join(small_table(named), "series", "left")
    own = F.col("_own").isNotNull() & (F.col("_own") != default)
    chosen = chosen.withColumns({"base": F.coalesce("_own", F.lit(default)), "_is_own": own})
    if stretch_to is None:
        placed = chosen.withColumn("_k", F.col("pos"))
    else:
        counts = small_side(lengths(lines))
        counted = same_keys(chosen, counts, ["series"])
        at = F.col("pos") * F.lit(stretch_to - 1) / F.nullif(F.col("n") - 1, F.lit(0))
        placed = counted.withColumn(
            "_k", F.when(F.col("_is_own") | (F.col("n") <= 1), F.col("pos")).otherwise(round_away(at)))
    x = bases.select("base", F.col("pos").alias("_k"), F.col("v").alias("x"))
    return placed.join(_asked_for(x, placed, ["base", "_k"], bases.count()), ["base", "_k"]).select("series", "base", "pos", "x", "v")


def log_columns_against(lines: DataFrame, base: DataFrame, lo: float, hi: float, columns: int) -> DataFrame:
    """log_columns with x from a time base, which has to run one way."""
    if sort_order(base).first().direction == 0:
        raise ArgumentError("a time base that doubles back has no columns")
    return log_columns(against_time_base(lines, base), lo, hi, columns)
