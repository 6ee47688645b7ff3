"""Rasters and images."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellfold.checks import check
from cellfold.checks.arrays import SPOILT, spoilt
from cellfold.checks.inputs import CELLS, CUBE, cube, embeddings
from cellfold.operators import grids, rasters
from cellfold.sources.tables import scan

STOPS = [(0, 0, 96), (32, 160, 144), (250, 230, 20)]


def _picture(spark, d, cells=None):
    cells = embeddings(spark, d) if cells is None else cells
    return rasters.raster(grids.grid(cells), 200, 32, grids.grid_extents(cells))


PIXELS = """s AS (SELECT greatest(1, ceil(count(*) / 200.0)::BIGINT) AS s FROM embeddings),
pixels AS (SELECT i0 AS row, i1 AS col, v FROM {source}, s WHERE i0 % s = 0 AND i1 % 2 = 0)"""


@check("raster", f"WITH {CELLS}, {PIXELS.format(source='cells')} SELECT row, col, v FROM pixels")
def _(spark, d):
    return _picture(spark, d)


@check("raster_whole", f"WITH {CUBE} SELECT i0 * 10 + i1 AS row, i2 AS col, v FROM cube")
def _(spark, d):
    cells = cube(spark, d)
    return rasters.raster(grids.grid(cells), max_rows=1 << 40)


PLACED = f"""{SPOILT}, {PIXELS.format(source='spoilt')},
placed AS (SELECT row, col, CASE WHEN isnan(v) THEN NULL ELSE least(greatest((v + 0.25) / 0.5, 0), 1) END AS t FROM pixels)"""


@check("grey", f"WITH {PLACED} SELECT row, col, CAST(round(255 * t) AS INTEGER) AS shade FROM placed")
def _(spark, d):
    return rasters.grey(_picture(spark, d, spoilt(spark, d)), 0.25, -0.25)


@check("grey_inverted", f"WITH {PLACED} SELECT row, col, CAST(round(255 * (1 - t)) AS INTEGER) AS shade FROM placed")
def _(spark, d):
    return rasters.grey(_picture(spark, d, spoilt(spark, d)), -0.25, 0.25, invert=True)


@check("grey_flat", f"WITH {PLACED} SELECT row, col, CASE WHEN t IS NOT NULL THEN 128 END AS shade FROM placed")
def _(spark, d):
    return rasters.grey(_picture(spark, d, spoilt(spark, d)), 0.5, 0.5)


def _blend(channel):
    a, b, c = (stop[channel] for stop in STOPS)
    return (f"CAST(CASE WHEN u < 1 THEN round({a} + {b - a} * u) WHEN u < 2 THEN round({b} + {c - b} * (u - 1)) "
            f"ELSE CASE WHEN u = 2 THEN {c} END END AS INTEGER)")


@check("ramp", f"""
WITH {PLACED}, banded AS (SELECT row, col, 2 * (0.2 + t * (0.9 - 0.2)) AS u FROM placed)
SELECT row, col, {_blend(0)} AS red, {_blend(1)} AS green, {_blend(2)} AS blue FROM banded""")
def _(spark, d):
    return rasters.ramp(_picture(spark, d, spoilt(spark, d)), STOPS, -0.25, 0.25, 0.2, 0.9)


def _shade(channel, turned=False):
    t = f"(max(v) FILTER (i2 = {channel}) - any_value(lo)) / (any_value(hi) - any_value(lo))"
    return f"CAST(round(255 * ({'1 - ' if turned else ''}{t})) AS INTEGER)"


@check("compose_rgb", f"""
WITH {CUBE}, ends AS (SELECT min(v) AS lo, max(v) AS hi FROM cube WHERE i2 < 3)
SELECT i0 AS row, i1 AS col, {_shade(2)} AS red, {_shade(0)} AS green, {_shade(1)} AS blue, 255 AS alpha
FROM cube, ends GROUP BY i0, i1""")
def _(spark, d):
    return rasters.compose_rgb(cube(spark, d), 2, 2, 0, 1)


@check("compose_rgba_inverted", f"""
WITH {CUBE}, ends AS (SELECT min(v) AS lo, max(v) AS hi FROM cube)
SELECT i0 AS row, i1 AS col, {_shade(0, True)} AS red, {_shade(1, True)} AS green, {_shade(2, True)} AS blue, {_shade(3)} AS alpha
FROM cube, ends GROUP BY i0, i1""")
def _(spark, d):
    return rasters.compose_rgb(cube(spark, d), 2, 0, 1, 2, 3, invert=True)


def image_attrs(spark, d):
    """Attributes of one picture per document, worded by its language and size."""
    docs = scan(spark, d, "documents", ["doc_id", "lang", "source", "n_chars"])
    path = F.concat(F.lit("/pictures/"), F.col("doc_id").cast("string")).alias("path")
    said = F.filter(F.array(
        _said("CLASS", F.when(F.col("lang") != "fr", "IMAGE").otherwise("PALETTE")),
        _said("IMAGE_SUBCLASS", F.when(F.col("n_chars") % 3 == 0, "IMAGE_TRUECOLOR").when(F.col("n_chars") % 3 == 1, "IMAGE_GRAYSCALE")),
        _said("INTERLACE_MODE", F.when(F.col("source") == "src0", "INTERLACE_PLANE")),
        _said("DISPLAY_ORIGIN", F.when(F.col("source") == "src1", "LL")),
        _said("IMAGE_WHITE_IS_ZERO", F.when(F.col("n_chars") % 2 == 0, "1")),
        _said("IMAGE_MINMAXRANGE", F.when(F.col("n_chars") > 400, "0")),
        _said("IMAGE_MINMAXRANGE", F.when(F.col("n_chars") > 400, (F.col("n_chars") - 800).cast("string")), 1),
    ), lambda a: a["value"].isNotNull())
    return docs.select(path, F.explode(said).alias("_a")).select("path", "_a.name", "_a.idx", "_a.value")


def _said(name, value, idx=0):
    return F.struct(F.lit(name).alias("name"), F.lit(idx).cast("bigint").alias("idx"), value.alias("value"))


def image_shapes(spark, d):
    return scan(spark, d, "documents", ["doc_id", "n_chars"]).select(
        F.concat(F.lit("/pictures/"), F.col("doc_id").cast("string")).alias("path"),
        F.when(F.col("n_chars") % 4 == 0, 2).otherwise(3).alias("rank"))


IMAGES = """images AS (
  SELECT '/pictures/' || doc_id AS path, doc_id, n_chars, CASE n_chars % 3 WHEN 0 THEN 'truecolor' WHEN 1 THEN 'grayscale' ELSE 'indexed' END AS subclass,
         n_chars % 3 = 0 AS colour, source = 'src0' AS plane, CASE WHEN source = 'src1' THEN 'LL' ELSE '' END AS origin,
         CASE WHEN n_chars % 4 = 0 THEN 2 ELSE 3 END AS rank, n_chars > 800 AS stated
  FROM documents WHERE lang <> 'fr'),
facts AS (SELECT *, rank = CASE WHEN colour THEN 3 ELSE 2 END AS shape_matches FROM images)"""


@check("classify_images", f"""
WITH {IMAGES}
SELECT path, subclass, CASE WHEN colour THEN CASE WHEN plane THEN 'plane' ELSE 'pixel' END END AS interlace,
  CASE WHEN shape_matches OR NOT colour THEN CASE WHEN colour AND plane THEN 1 ELSE 0 END END AS row_axis,
  CASE WHEN shape_matches OR NOT colour THEN CASE WHEN colour AND plane THEN 2 ELSE 1 END END AS col_axis,
  CASE WHEN shape_matches AND colour THEN CASE WHEN plane THEN 0 ELSE 2 END END AS channel_axis,
  '' AS version, origin, origin = '' AS origin_kept, shape_matches,
  CASE WHEN stated THEN 0e0 END AS minimum, CASE WHEN stated THEN (n_chars - 800)::DOUBLE END AS maximum,
  n_chars % 2 = 0 AS white_is_zero FROM facts""")
def _(spark, d):
    return rasters.classify_images(image_shapes(spark, d), image_attrs(spark, d))


@check("value_range", f"""
WITH {IMAGES},
sets AS (
  SELECT '/pictures/' || doc_id AS path, CASE n_chars % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 END AS w,
         n_chars % 7 < 3 AS signed, n_chars, doc_id FROM documents),
ranged AS (
  SELECT s.path, w, signed, stated, f.path IS NOT NULL AS image, s.n_chars, label.lo, label.hi
  FROM sets s LEFT JOIN facts f ON f.path = s.path
  LEFT JOIN (SELECT doc_id, least(quality, toxic)::DOUBLE AS lo, greatest(quality, toxic)::DOUBLE AS hi FROM labels) label ON label.doc_id = s.doc_id)
SELECT path, CASE WHEN stated THEN 0e0 WHEN image AND w < 8 THEN CASE WHEN signed THEN -(2.0 ^ (8 * w - 1)) ELSE 0e0 END ELSE lo END AS lo,
  CASE WHEN stated THEN (n_chars - 800)::DOUBLE
       WHEN image AND w < 8 THEN CASE WHEN signed THEN 2.0 ^ (8 * w - 1) - 1 ELSE 2.0 ^ (8 * w) - 1 END ELSE hi END AS hi,
  CASE WHEN stated THEN 'stated' WHEN image AND w < 8 THEN 'type' ELSE 'extent' END AS rule FROM ranged""")
def _(spark, d):
    docs = scan(spark, d, "documents", ["doc_id", "n_chars"])
    path = F.concat(F.lit("/pictures/"), F.col("doc_id").cast("string")).alias("path")
    kind = F.col("n_chars") % 5
    width = F.when(kind == 0, 1).when(kind == 1, 2).when(kind == 2, 4).when(kind == 3, 8)
    sets = docs.select(path, width.alias("int_width"), (F.col("n_chars") % 7 < 3).alias("signed"))
    cells = scan(spark, d, "labels", ["doc_id", "quality", "toxic"]).select(
        path, F.explode(F.array("quality", "toxic").cast("array<double>")).alias("v"))
    images = rasters.classify_images(image_shapes(spark, d), image_attrs(spark, d))
    return rasters.value_range(sets, images, cells)
