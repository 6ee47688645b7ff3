"""Rasters: value to grey, ramp or colour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellfold.functions.numbers import is_finite, round_away
from cellfold.model import ArgumentError, Cells
from cellfold.operators.grids import extents_of
from cellfold.runtime import small_side

# The classes and orders an image attribute can name.
SUBCLASSES = {
    "IMAGE_GRAYSCALE": "grayscale",
    "IMAGE_BITMAP": "bitmap",
    "IMAGE_TRUECOLOR": "truecolor",
    "IMAGE_INDEXED": "indexed",
}


def raster(grid: DataFrame, max_rows: int = 1024, max_cols: int = 1024, extents: tuple[int, int] | None = None) -> DataFrame:
    """Every stride-th row and column, so the picture stays under the cap; whole
    when it fits.  ``extents`` of the grid are looked up when not given."""
    if max_rows < 1 or max_cols < 1:
        raise ArgumentError("a picture has at least one row and one column")
    rows, cols = extents or extents_of(grid)
    row_stride, col_stride = (max(1, -(-n // most)) for n, most in ((rows, max_rows), (cols, max_cols)))
    return grid.where((F.col("row") % row_stride == 0) & (F.col("col") % col_stride == 0))


def _places(df: DataFrame, values: dict[str, Column], low: Column, high: Column, inverted: set[str] = frozenset()) -> DataFrame:
    """``df`` with, for each name, how far along the range a value lies: 0 … 1, and
    half way when the range is flat.

    One projection per step: a step that names another several times would be
    written out several times if they were one expression.
    """
    span = high - low
    wide = span > 0
    df = df.withColumns({f"_q_{n}": (v - low) / F.when(wide, span) for n, v in values.items()})
    df = df.withColumns({
        f"_t_{n}": F.when(F.isnan(f"_q_{n}") | (F.col(f"_q_{n}") < 0), F.lit(0.0)).when(F.col(f"_q_{n}") > 1, F.lit(1.0))
        .otherwise(F.col(f"_q_{n}")) for n in values})
    turned = {n: F.lit(1.0) - F.col(f"_t_{n}") if n in inverted else F.col(f"_t_{n}") for n in values}
    return df.withColumns({n: F.when(wide, t).otherwise(F.lit(0.5)) for n, t in turned.items()})


def _ordered(low: float, high: float) -> tuple[Column, Column]:
    return F.lit(float(min(low, high))), F.lit(float(max(low, high)))


def _band(at: Column, begin: float, end: float) -> Column:
    return F.lit(float(begin)) + at * F.lit(float(end) - float(begin))


def grey(raster: DataFrame, low: float, high: float, invert: bool = False, begin: float = 0.0,
         end: float = 1.0) -> DataFrame:
    """[row, col, shade] 0 … 255; what is not finite is null."""
    placed = _places(raster, {"_at": F.col("v")}, *_ordered(low, high), {"_at"} if invert else frozenset())
    placed = placed.withColumn("_level", _band(F.col("_at"), begin, end) * 255.0)
    shade = F.when(is_finite("v"), round_away(F.col("_level")).cast("int"))
    return placed.select("row", "col", shade.alias("shade"))


def ramp(raster: DataFrame, stops: list[tuple[int, int, int]], low: float, high: float, begin: float = 0.0,
         end: float = 1.0, invert: bool = False) -> DataFrame:
    """[row, col, red, green, blue], linear in RGB between the stops."""
    names, last = ("red", "green", "blue"), max(len(stops) - 1, 0)
    stops = stops or [(0, 0, 0)]
    placed = _places(raster, {"_at": F.col("v")}, *_ordered(low, high), {"_at"} if invert else frozenset())
    at = _band(F.col("_at"), begin, end)
    placed = placed.withColumn("_cut", F.greatest(F.least(at, F.lit(1.0)), F.lit(0.0)) * F.lit(float(last)))
    placed = placed.withColumn("_stop", F.floor("_cut").cast("int"))
    mixed = {}
    for channel, name in enumerate(names):
        table = F.array(*[F.lit(int(stop[channel])) for stop in stops])
        a, b = F.get(table, F.col("_stop")), F.get(table, F.least(F.col("_stop") + 1, F.lit(last)))
        mixed[f"_{name}"] = a + (b - a) * (F.col("_cut") - F.col("_stop"))
    placed = placed.withColumns(mixed)
    return placed.select("row", "col", *[
        F.when(is_finite("v"), round_away(F.col(f"_{name}")).cast("int")).alias(name) for name in names])


def compose_rgb(cells: Cells, channel_axis: int, r: int, g: int, b: int, a: int | None = None,
                low: float | None = None, high: float | None = None, invert: bool = False) -> DataFrame:
    """[row, col, red, green, blue, alpha] of a rank-3 dataset.

    One range over all the channels, the finite extent when none is given.  A
    pixel missing a channel is null; the inversion does not reach alpha.
    """
    if cells.rank != 3 or not 0 <= channel_axis < 3:
        raise ArgumentError("colour needs three axes, one of them the channel")
    row, col = (f"i{k}" for k in range(3) if k != channel_axis)
    picked = {"red": r, "green": g, "blue": b} | ({} if a is None else {"alpha": a})
    if any(not 0 <= k < cells.shape[channel_axis] for k in picked.values()):
        raise ArgumentError("there is no such channel")
    channel = F.col(f"i{channel_axis}")
    used = cells.df.where(channel.isin(sorted(set(picked.values()))))
    # One row per pixel: the planes meet in one aggregate, whatever their order.
    pixels = used.groupBy(F.col(row).alias("row"), F.col(col).alias("col")).agg(
        *[F.max(F.when(channel == k, F.col("v"))).alias(n) for n, k in picked.items()])
    if low is None or high is None:
        finite = F.when(is_finite("v"), F.col("v"))
        extent = used.agg(F.struct(F.min(finite).alias("lo"), F.max(finite).alias("hi")).alias("x")).scalar()
        pixels = pixels.withColumn("_x", extent)
        lo, hi = F.col("_x.lo"), F.col("_x.hi")
    else:
        lo, hi = _ordered(low, high)
    complete = None
    for name in picked:
        one = F.coalesce(is_finite(name), F.lit(False))
        complete = one if complete is None else complete & one
    pixels = pixels.withColumn("_complete", complete)
    inverted = {f"_{n}" for n in picked if n != "alpha"} if invert else frozenset()
    placed = _places(pixels, {f"_{n}": F.col(n) for n in picked}, lo, hi, inverted)
    placed = placed.withColumns({f"_l_{n}": F.col(f"_{n}") * 255.0 for n in picked})
    shades = []
    for name in ("red", "green", "blue", "alpha"):
        value = F.lit(255)
        if name in picked:
            flat = F.lit(255 if name == "alpha" else 128)
            value = F.when(hi > lo, round_away(F.col(f"_l_{name}")).cast("int")).otherwise(flat)
        shades.append(F.when(F.col("_complete"), value).alias(name))
    return placed.select("row", "col", *shades)


def type_span(width: Column, signed: Column) -> tuple[Column, Column]:
    """Ends of an integer type of 1, 2 or 4 bytes; null for any other."""
    bits = F.when(width.isin(1, 2, 4), width * 8)
    low = F.when(signed, -F.pow(F.lit(2.0), bits - 1)).when(bits.isNotNull(), F.lit(0.0))
    high = F.when(signed, F.pow(F.lit(2.0), bits - 1) - 1).otherwise(F.pow(F.lit(2.0), bits) - 1)
    return low, high


def value_range(datasets: DataFrame, images: DataFrame, cells: DataFrame) -> DataFrame:
    """[path, lo, hi, rule]: where a picture's black and white points come from.

    The stated range of an image; else the whole span of its small integer type;
    else the finite extent of the data.  ``datasets`` is [path, int_width,
    signed] with a null width for floats, ``images`` what classify_images gives,
    ``cells`` [path, v].
    """
    finite = F.when(is_finite("v"), F.col("v"))
    stated = images.select("path", "minimum", "maximum", F.lit(True).alias("_image"))
    low, high = type_span(F.col("int_width"), F.col("signed"))
    known = datasets.join(stated, "path", "left").withColumns({"_tl": low, "_th": high})
    by_file, by_type = F.col("minimum").isNotNull(), F.col("_image") & F.col("_tl").isNotNull()
    # Only the cells of datasets that nothing else answers for are looked at.
    asked = known.where(~(by_file | F.coalesce(by_type, F.lit(False)))).select("path")
    extent = cells.join(small_side(asked), "path", "left_semi").groupBy("path").agg(F.min(finite).alias("_lo"), F.max(finite).alias("_hi"))
    facts = known.join(extent, "path", "left")
    pick = lambda said, span, found: (
        F.when(by_file, F.col(said)).when(by_type, F.col(span)).otherwise(F.col(found)))
    rule = F.when(by_file, F.lit("stated")).when(by_type, F.lit("type")).otherwise(F.lit("extent"))
    return facts.select("path", pick("minimum", "_tl", "_lo").alias("lo"), pick("maximum", "_th", "_hi").alias("hi"),
                        rule.alias("rule"))


def classify_images(shapes: DataFrame, attrs: DataFrame) -> DataFrame:
    """Datasets whose attributes call them images, and what they say.

    ``shapes`` is [path, rank], ``attrs`` [path, name, idx, value].
    """
    def text(name: str, at: int = 0) -> Column:
        return F.max(F.when((F.col("name") == name) & (F.col("idx") == at), F.col("value")))

    said = attrs.groupBy("path").agg(
        text("CLASS").alias("class"), text("IMAGE_SUBCLASS").alias("sub"), text("IMAGE_VERSION").alias("version"),
        text("DISPLAY_ORIGIN").alias("origin"), text("INTERLACE_MODE").alias("mode"),
        text("IMAGE_MINMAXRANGE").alias("range_0"), text("IMAGE_MINMAXRANGE", 1).alias("range_1"),
        text("IMAGE_MINMAXRANGE", 2).alias("range_2"), text("IMAGE_WHITE_IS_ZERO").alias("white"),
    ).where(F.col("class") == "IMAGE")
    subclass = F.lit("indexed")
    for word, name in SUBCLASSES.items():
        subclass = F.when(F.col("sub") == word, F.lit(name)).otherwise(subclass)
    facts = said.join(shapes.select("path", "rank"), "path").withColumns({
        "subclass": subclass,
        "_lo": F.expr("try_cast(range_0 as double)"), "_hi": F.expr("try_cast(range_1 as double)"),
        "_white": F.expr("try_cast(white as double)"),
    })
    true_colour = F.col("subclass") == "truecolor"
    plane = true_colour & (F.coalesce("mode", F.lit("INTERLACE_PIXEL")) == "INTERLACE_PLANE")
    matches = F.col("rank") == F.when(true_colour, 3).otherwise(2)
    placed = ~true_colour | matches
    stated = (is_finite("_lo") & is_finite("_hi") & (F.col("_lo") < F.col("_hi")) & F.col("range_2").isNull())
    return facts.select(
        "path", "subclass",
        F.when(true_colour, F.when(plane, F.lit("plane")).otherwise(F.lit("pixel"))).alias("interlace"),
        F.when(placed, F.when(plane, 1).otherwise(0)).alias("row_axis"),
        F.when(placed, F.when(plane, 2).otherwise(1)).alias("col_axis"),
        F.when(placed & true_colour, F.when(plane, 0).otherwise(2)).alias("channel_axis"),
        F.coalesce("version", F.lit("")).alias("version"), F.coalesce("origin", F.lit("")).alias("origin"),
        (F.coalesce("origin", F.lit("")).isin("", "UL")).alias("origin_kept"),
        matches.alias("shape_matches"),
        F.when(stated, F.col("_lo")).alias("minimum"), F.when(stated, F.col("_hi")).alias("maximum"),
        F.coalesce(F.col("_white") != 0, F.lit(False)).alias("white_is_zero"),
    )
