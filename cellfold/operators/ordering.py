"""Order along a line, and looking positions up by value."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellfold.functions.numbers import is_finite
from cellfold.model import int_div
from cellfold.operators.running import with_seam
from cellfold.operators.summaries import fold_extremes
from cellfold.runtime import BLOCK, small_side
from cellfold.sources.tables import _ordered_blocks

# Edges or probes up to this many are looked up in every task without a shuffle.
FEW = 10_000


def sort_order(base: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row [n, ascending, descending, direction] of a time base [pos, v].

    Neighbours are compared inside blocks of positions that share one sample
    with the block after, so no task holds more than a block.
    """
    lent = with_seam(base.select("pos", "v"), "pos", block, 1)
    order = Window.partitionBy("_b").orderBy("pos")
    led = lent.withColumn("_next", F.lead("v").over(order)).where(int_div(F.col("pos"), block) == F.col("_b"))
    compared = F.col("_next").isNotNull() & ~F.isnan("_next") & ~F.isnan("v")
    found = led.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(~F.bool_or(compared & (F.col("_next") < F.col("v"))), F.lit(True)).alias("ascending"),
        F.coalesce(~F.bool_or(compared & (F.col("_next") > F.col("v"))), F.lit(True)).alias("descending"),
    )
    direction = F.when(F.col("ascending"), 1).when(F.col("descending"), -1).otherwise(0)
    return found.withColumn("direction", direction)


def _with_gap(df: DataFrame, x: str, bounds: np.ndarray, name: str, inclusive: bool = True) -> DataFrame:
    """``df`` with how many of the sorted bounds are <= x (or < x).

    A binary search written as one projection per step, so that it stays in
    generated code; the bounds are a scalar every row refers to.
    """
    table = pa.table({"b": pa.array([bounds.astype("float64")], pa.list_(pa.float64()))})
    df = df.withColumns({"_bounds": df.sparkSession.createDataFrame(table).scalar(), name: F.lit(0)})
    step = 1 << max(len(bounds).bit_length() - 1, 0)
    while step:
        bound = F.get("_bounds", F.col(name) + (step - 1))
        before = bound <= F.col(x) if inclusive else bound < F.col(x)
        df = df.withColumn(name, F.col(name) + F.when(before, step).otherwise(0))
        step //= 2
    return df.drop("_bounds")


def _edges(df: DataFrame, column: str) -> np.ndarray | None:
    """Up to FEW different values, sorted; None when there are more."""
    found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(FEW + 1).toArrow()
    return np.sort(found.column(0).to_numpy()) if found.num_rows <= FEW else None


def count_below(base: DataFrame, edges: DataFrame, inclusive: bool = False) -> DataFrame:
    """``edges`` [x, …] with ``before``: how many base values are < x (or <= x)."""
    values = base.select("v").where(F.col("v").isNotNull())
    bounds = _edges(edges, "x")
    if bounds is not None:
        # A value in gap g is before exactly the edges from g on; the table of
        # gaps has one row per edge at most.
        gapped = _with_gap(values, "v", bounds, "_g", inclusive=not inclusive)
        counts = gapped.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
        per_gap = {r._g: r._n for r in counts.collect()}
        running = np.cumsum([per_gap.get(g, 0) for g in range(len(bounds))], dtype="int64")
        table = pd.DataFrame({"x": bounds.astype("float64"), "before": running})
        spark = base.sparkSession
        return edges.join(F.broadcast(spark.createDataFrame(table, "x double, before bigint")), "x", "left")
    # Too many edges to hand out: sort both together and count along the order.
    # One row per value, so a value that fills the base is one row too.  At equal
    # values an edge comes after the values it counts.
    edge_first = 0 if not inclusive else 1
    counted = values.groupBy(F.col("v").alias("x")).agg(F.count(F.lit(1)).alias("_n"))
    asked = edges.select("x").where(F.col("x").isNotNull()).distinct()
    both = counted.select("x", F.lit(1 - edge_first).alias("_kind"), "_n").unionByName(
        asked.select("x", F.lit(edge_first).alias("_kind"), F.lit(None).cast("bigint").alias("_n")))
    blocks = _ordered_blocks(both, ["x", "_kind"])
    inside = Window.partitionBy("_block").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    sizes = blocks.groupBy("_block").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_n"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = small_side(sizes.select("_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")))
    ranked = blocks.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).where(F.col("_n").isNull())
    placed = ranked.join(starts, "_block").select("x", (F.col("_start") + F.col("_in")).cast("bigint").alias("before"))
    return edges.join(placed, "x", "left")


def time_edges(base: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` [x, …] with ``before``: elements before x in the base's own direction.

    Below x when it ascends, at or above x when it descends; null when the base
    runs neither way.
    """
    order = sort_order(base).first()
    if order.direction == 0:
        return edges.withColumn("before", F.lit(None).cast("bigint"))
    below = count_below(base, edges)
    return below if order.direction > 0 else below.withColumn("before", F.lit(order.n) - F.col("before"))


def x_range_to_positions(base: DataFrame, ranges: DataFrame) -> DataFrame:
    """``ranges`` [lo, hi, …] with pos_lo and pos_hi on a sorted time base.

    The first element at or past x in the base's direction, or its last element
    when there is none; null when the base is empty or runs neither way.
    """
    order = sort_order(base).first()
    if order.direction == 0 or order.n == 0:
        none = F.lit(None).cast("bigint")
        return ranges.withColumns({"pos_lo": none, "pos_hi": none})
    ends = ranges.select(F.explode(F.array("lo", "hi")).alias("x")).where(is_finite("x")).distinct()
    below = count_below(base, ends, inclusive=order.direction < 0)
    before = F.col("before") if order.direction > 0 else F.lit(order.n) - F.col("before")
    found = below.select("x", F.least(before, F.lit(order.n - 1)).cast("bigint").alias("at"))
    for end in ("lo", "hi"):
        ranges = ranges.join(found.select(F.col("x").alias(end), F.col("at").alias(f"pos_{end}")), end, "left")
    return ranges


def nearest_sample(probes: DataFrame, lines: DataFrame, log_x: bool = False, log_y: bool = False) -> DataFrame:
    """For every probe [probe, series, x] the drawable sample nearest in x.

    ``lines`` is [series, pos, x, v].  A sample is drawable when it is finite and
    above zero on a logarithmic axis; of two as near, the earlier one.  The
    answer [probe, series, x, pos, sample_x, v] is null where there is none, and for
    a probe without a series or with an x that is null or not finite.
    """
    drawable = is_finite("x") & is_finite("v")
    drawable = drawable & (F.col("x") > 0) if log_x else drawable
    drawable = drawable & (F.col("v") > 0) if log_y else drawable
    samples = lines.where(drawable).select("series", "pos", F.col("x").alias("_x"), F.col("v").alias("_v"))
    # What can't be looked up keeps its row, on either way and whatever the number of probes.
    able = F.coalesce(is_finite("x") & F.col("series").isNotNull(), F.lit(False))
    unable, probes = probes.where(~able), probes.where(able)
    bounds = _edges(probes, "x")
    sides = _sides_in_gaps(probes, samples, bounds) if bounds is not None else _sides_in_order(probes, samples)
    away = lambda side: F.abs(F.col(f"{side}.x") - F.col("x"))
    take_low = F.col("_high").isNull() | (away("_low") < away("_high")) | (
        (away("_low") == away("_high")) & (F.col("_low.pos") < F.col("_high.pos")))
    best = F.when(F.col("_low").isNotNull() & take_low, F.col("_low")).otherwise(F.col("_high"))
    found = sides.withColumn("_best", best).select(
        "probe", "series", "x", F.col("_best.pos").alias("pos"), F.col("_best.x").alias("sample_x"),
        F.col("_best.v").alias("v"))
    none = [F.lit(None).cast(kind).alias(name) for name, kind in found.dtypes[3:]]
    return found.unionByName(unable.select("probe", "series", F.col("x").cast(dict(found.dtypes)["x"]).alias("x"), *none))


def _sides_in_gaps(probes: DataFrame, samples: DataFrame, bounds: np.ndarray) -> DataFrame:
    """Nearest sample on each side, for few probes: the line is folded to the two
    outermost samples between neighbouring probes and is never sorted."""
    rows = _with_gap(samples, "_x", bounds, "_g").select("series", "_g", "pos", F.col("_x").alias("v"), "_v")
    folded = fold_extremes(rows, ["series", "_g"], carry=["_v"])
    low = F.struct(F.col("lo_at").alias("pos"), F.col("lo").alias("x"), F.col("lo__v").alias("v"))
    high = F.struct(F.col("hi_at").alias("pos"), F.col("hi").alias("x"), F.col("hi__v").alias("v"))
    ends = folded.select("series", "_g", low.alias("_first"), high.alias("_last"), F.lit(None).cast("double").alias("x"))
    none = F.lit(None).cast(dict(ends.dtypes)["_first"])
    # A probe stands at the end of its own gap: before it lies x < probe.  One
    # row per place asked about, so a window holds a gap and a probe per bound.
    asked = probes.select("series", F.col("x").cast("double").alias("x")).distinct()
    asked = _with_gap(asked, "x", bounds, "_g", inclusive=False).select(
        "series", "_g", none.alias("_first"), none.alias("_last"), "x")
    found = _both_sides(ends.unionByName(asked), ["series"], ["_g", F.col("x").isNotNull()], "_last", "_first")
    places = found.where(F.col("x").isNotNull()).select("series", "x", "_low", "_high")
    return probes.join(small_side(places), ["series", "x"])


def _both_sides(rows: DataFrame, keys: list[str], order: list, low: str, high: str) -> DataFrame:
    """Nearest non-null ``low`` at or before each row and ``high`` at or after it.

    Looking ahead is looking back along the turned order: a frame that runs to
    the end of the partition would be walked again for every row.
    """
    along = [F.col(o) if isinstance(o, str) else o for o in order]
    ahead = Window.partitionBy(*keys).orderBy(*[o.desc() for o in along])
    back = Window.partitionBy(*keys).orderBy(*along)
    so_far = lambda window: window.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"_low": F.last(low, True).over(so_far(back)), "_high": F.last(high, True).over(so_far(ahead))})


def _sides_in_order(probes: DataFrame, samples: DataFrame) -> DataFrame:
    """The same for any number of probes: both sides sorted together in range
    blocks, the outermost samples of each block carried over to its neighbours."""
    asked = probes.select("series", F.col("x").alias("_x"), F.lit(0).alias("_kind"),
                          F.lit(None).cast("bigint").alias("pos"), F.lit(None).cast("double").alias("_v"), "probe")
    # One row per place: of samples at the same x the earliest is the answer.
    places = samples.groupBy("series", "_x").agg(F.min("pos").alias("pos"), F.min_by("_v", "pos").alias("_v"))
    held = places.select("series", "_x", F.lit(1).alias("_kind"), "pos", "_v",
                         F.lit(None).cast(dict(probes.dtypes)["probe"]).alias("probe"))
    blocks = _ordered_blocks(asked.unionByName(held), ["series", "_x", "_kind", "pos", "probe"])
    sample = F.when(F.col("_kind") == 1, F.struct("pos", F.col("_x").alias("x"), F.col("_v").alias("v")))
    marked = blocks.withColumn("_s", sample)
    inside = _both_sides(marked, ["series", "_block"], ["_row"], "_s", "_s").where(F.col("_kind") == 0)
    at = F.when(F.col("_kind") == 1, F.col("_row"))
    # Column by column: a struct in an aggregate's buffer would have Spark sort every row for it.
    ends = {"_f": F.min_by, "_l": F.max_by}
    outer = marked.groupBy("series", "_block").agg(*[
        pick(name, at).alias(f"{end}_{name}") for end, pick in ends.items() for name in ("pos", "_x", "_v")])
    outer = outer.select("series", "_block", *[
        F.when(F.col(f"{end}_pos").isNotNull(), F.struct(
            F.col(f"{end}_pos").alias("pos"), F.col(f"{end}__x").alias("x"), F.col(f"{end}__v").alias("v"))).alias(end)
        for end in ends])
    # One row per series and block it touches.
    before = F.lag("_low").over(Window.partitionBy("series").orderBy("_block"))
    after = F.lead("_high").over(Window.partitionBy("series").orderBy("_block"))
    sides = _both_sides(outer, ["series"], ["_block"], "_l", "_f")
    carried = small_side(sides.select("series", "_block", before.alias("_before"), after.alias("_after")))
    joined = inside.join(carried, ["series", "_block"])
    return joined.select("probe", "series", F.col("_x").alias("x"),
                         F.coalesce("_low", "_before").alias("_low"), F.coalesce("_high", "_after").alias("_high"))
