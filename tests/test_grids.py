"""Windows, struct fields, grids, rasters, text and pipelines on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cellfold import ArgumentError
from cellfold.functions import text
from cellfold.operators import grids, members, rasters, rendering
from cellfold.plans.pipeline import pipeline, pipeline_line
from cellfold.model import cells_of
from cellfold.sources import tables
from conftest import cells_from, to_numpy


def test_window(spark):
    cells = cells_from(spark, np.arange(12.0).reshape(4, 3))
    assert sorted(r.v for r in tables.window(cells, [2, 1], [9, 1]).collect()) == [7.0, 10.0]
    assert tables.window(cells, [4, 0], [1, 3]).count() == 0
    assert tables.window(cells_from(spark, 5.0), [], []).count() == 1
    with pytest.raises(ArgumentError):
        tables.window(cells, [0], [1])


def test_positions(spark):
    df = spark.createDataFrame([(k * 7919 % 1000, k % 3) for k in range(1000)], "key int, series int")
    placed = tables.element_positions(df, ["key"]).collect()
    assert all(r.pos == r.key for r in placed) and len(placed) == 1000
    hot = df.withColumn("series", F.when(F.col("key") < 900, 0).otherwise(F.col("series")))
    found = {}
    for r in tables.series_positions(hot, "series", ["key"]).collect():
        found.setdefault(r.series, []).append((r.pos, r.key))
    for rows in found.values():
        assert [p for p, _ in sorted(rows)] == list(range(len(rows))) and sorted(rows) == sorted(rows, key=lambda e: e[1])


def test_arrays_without_a_known_shape(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, [4, None, 6])], "k int, a array<int>")
    cells = tables.array_cells(df, ["k"], "a")
    assert cells.shape == (2, 3)
    np.testing.assert_array_equal(to_numpy(cells), [[1, 2, 3], [4, np.nan, 6]])
    ragged = spark.createDataFrame([(0, [1]), (1, [4, 5])], "k int, a array<int>")
    with pytest.raises(ArgumentError, match="lists of 1 to 2"):
        tables.array_cells(ragged, ["k"], "a")


def test_only_numbers_are_cells(spark):
    df = spark.sql("SELECT 0L AS k, 'a' AS text, true AS flag, timestamp'2020-01-01' AS at, 1.5BD AS money, array('x') AS words")
    for column in ("text", "flag", "at"):
        with pytest.raises(ArgumentError, match="not numbers"):
            cells_of(df, ["k"], column, (1,))
    with pytest.raises(ArgumentError, match="not numbers"):
        tables.array_cells(df, ["k"], "words", (1, 1))
    assert to_numpy(cells_of(df, ["k"], "money", (1,)))[0] == 1.5
    named = members.select_member(structs(spark), "s.pos.name", ["k"], (4,))
    assert "not numeric: string" in pipeline(named, ["slice"]).error


def structs(spark):
    rows = [Row(k=k, s=Row(id=k, pos=Row(x=k / 2, name=f"n{k}"), grid=[[k, 1, 2], [3, 4, 5]], tags=list(range(k)))) for k in range(4)]
    return spark.createDataFrame(
        rows, "k bigint, s struct<id:int, pos:struct<x:double, name:string>, grid:array<array<int>>, tags:array<int>>")


def test_members(spark):
    df = structs(spark)
    np.testing.assert_array_equal(to_numpy(members.select_member(df, "s.pos.x", ["k"], (4,))), [0, 0.5, 1, 1.5])
    cube = members.select_member(df, "s.grid", ["k"], (4,), (2, 3))
    assert cube.shape == (4, 2, 3) and cube.integer
    np.testing.assert_array_equal(to_numpy(cube)[2], [[2, 1, 2], [3, 4, 5]])
    one = members.select_member(df, "s.grid", ["k"], (4,), (2, 3), sub=-1)
    np.testing.assert_array_equal(to_numpy(one), to_numpy(cube)[:, -1])
    with pytest.raises(ArgumentError, match="id, pos, grid, tags"):
        members.select_member(df, "s.nope", ["k"], (4,))
    with pytest.raises(ArgumentError):
        members.select_member(df, "s.id.more", ["k"], (4,))
    with pytest.raises(ArgumentError):
        members.select_member(df, "s.grid", ["k"], (4,), (2, 3), sub=2)
    np.testing.assert_array_equal(to_numpy(members.vlen_at(df, "s.tags", 1, ["k"], (4,))), [np.nan, np.nan, 1, 1])
    for bad in (-1, slice(0, 2)):
        with pytest.raises(ArgumentError):
            members.vlen_at(df, "s.tags", bad, ["k"], (4,))


def test_grid_layout(spark):
    line = cells_from(spark, [5.0, 6.0])
    assert sorted((r.row, r.col) for r in grids.grid(line).collect()) == [(0, 0), (1, 0)]
    assert [(r.cell_label, r.row_label, r.col_label) for r in grids.cell_labels(line).orderBy("row").collect()] == [
        ("0", "0", ""), ("1", "1", "")]
    scalar = grids.cell_labels(cells_from(spark, 3.0)).first()
    assert (scalar.row, scalar.col, scalar.cell_label) == (0, 0, "")
    cube = cells_from(spark, np.arange(24.0).reshape(2, 3, 4))
    assert grids.grid_extents(cube) == (6, 4) and grids.grid_extents(cube, [0, 2]) == (3, 8)
    labels = {(r.row, r.col): (r.v, r.cell_label, r.row_label, r.col_label) for r in grids.cell_labels(cube, [0, 2]).collect()}
    assert labels[2, 5] == (21.0, "[1,2,1]", "[_,2,_]", "[1,_,1]")
    with pytest.raises(ArgumentError):
        grids.grid(cube, [0], [0, 1, 2])
    block = {r.row: (r.c1, r.c2) for r in grids.grid_block(grids.grid(cube), 4, 1, 5, 2).collect()}
    assert block == {4: (17.0, 18.0), 5: (21.0, 22.0)}
    assert [r.expression for r in grids.line_expressions(cube, "/cube").orderBy("line").collect()][4] == "/cube[1, 1, :]"
    assert grids.line_expressions(cube, "/cube", along=0).where("expression = '/cube[:, 2, 3]'").count() == 1


def test_grey_and_ramp(spark):
    grid = grids.grid(cells_from(spark, [0.0, 0.5, 1.0, -5.0, 9.0, np.nan, np.inf, 0.3]))
    shades = [r.shade for r in rasters.grey(grid, 1, 0).orderBy("row").collect()]
    assert shades == [0, 128, 255, 0, 255, None, None, 77]
    assert [r.shade for r in rasters.grey(grid, 0, 1, invert=True).orderBy("row").collect()] == [255, 128, 0, 255, 0, None, None, 179]
    assert [r.shade for r in rasters.grey(grid, 2, 2).orderBy("row").collect()] == [128] * 5 + [None, None, 128]
    colours = [(r.red, r.green, r.blue) for r in rasters.ramp(grid, [(0, 0, 0), (10, 20, 30), (255, 0, 1)], 0, 1).orderBy("row").collect()]
    assert colours == [(0, 0, 0), (10, 20, 30), (255, 0, 1), (0, 0, 0), (255, 0, 1), (None,) * 3, (None,) * 3, (6, 12, 18)]
    assert rasters.ramp(grid, [(1, 2, 3)], 0, 1).where("red = 1 and green = 2 and blue = 3").count() == 6
    turned = rasters.ramp(grid, [(0, 0, 0), (200, 0, 0)], 0, 1, 1.0, 0.0).orderBy("row").first()
    assert turned.red == 200


def test_compose(spark):
    picture = np.array([[[0, 1, 2, 4], [4, 4, np.nan, 4]], [[4, 2, 0, 0], [1, 3, 2, 2]]], dtype=float)
    cells = cells_from(spark, picture)
    def pixels(**more):
        return {(r.row, r.col): (r.red, r.green, r.blue, r.alpha) for r in rasters.compose_rgb(cells, 2, 0, 1, 2, **more).collect()}
    assert pixels()[0, 0] == (0, 64, 128, 255) and pixels()[0, 1] == (None,) * 4
    assert pixels(a=3, invert=True)[0, 0] == (255, 191, 128, 255) and pixels(a=3, invert=True)[1, 0] == (0, 128, 255, 0)
    assert pixels(a=3, low=3, high=3)[0, 0] == (128, 128, 128, 255)
    with pytest.raises(ArgumentError):
        rasters.compose_rgb(cells, 2, 0, 1, 9)


def test_raster_strides(spark):
    grid = grids.grid(cells_from(spark, np.zeros((100, 7))))
    assert rasters.raster(grid, 30, 7, (100, 7)).select("row").distinct().count() == 25
    assert rasters.raster(grid, 30, 7).select("row").distinct().count() == 25
    assert rasters.raster(grid).count() == 700


def test_images(spark):
    attrs = spark.createDataFrame(
        [("/t", "CLASS", 0, "IMAGE"), ("/t", "IMAGE_SUBCLASS", 0, "IMAGE_TRUECOLOR"), ("/t", "INTERLACE_MODE", 0, "INTERLACE_PLANE"),
         ("/i", "CLASS", 0, "IMAGE"), ("/i", "IMAGE_MINMAXRANGE", 0, "9"), ("/i", "IMAGE_MINMAXRANGE", 1, "2"),
         ("/i", "DISPLAY_ORIGIN", 0, "LL"), ("/r", "CLASS", 0, "IMAGE"), ("/r", "IMAGE_MINMAXRANGE", 0, "2"),
         ("/r", "IMAGE_MINMAXRANGE", 1, "inf"), ("/r", "IMAGE_WHITE_IS_ZERO", 0, "1"), ("/n", "CLASS", 0, "TABLE")],
        "path string, name string, idx bigint, value string")
    ranks = spark.createDataFrame([("/t", 2), ("/i", 2), ("/r", 3), ("/n", 2)], "path string, rank int")
    rows = {r.path: r for r in rasters.classify_images(ranks, attrs).collect()}
    assert set(rows) == {"/t", "/i", "/r"}
    assert rows["/t"].subclass == "truecolor" and not rows["/t"].shape_matches and rows["/t"].channel_axis is None
    assert rows["/i"].subclass == "indexed" and rows["/i"].minimum is None and not rows["/i"].origin_kept
    assert rows["/r"].minimum is None and rows["/r"].white_is_zero and not rows["/r"].shape_matches


# --- text ---------------------------------------------------------------------

SHORTEST = {-0.0: "-0", 1.0: "1", 100.0: "100", 99999.0: "99999", 1e5: "1e+05", -2e6: "-2e+06", 1e7: "1e+07",
            12e5: "1200000", 12e6: "1.2e+07", 123456789.0: "123456789", 1e22: "1e+22", 0.001: "0.001", 1e-4: "1e-04",
            0.00012: "0.00012", 1.234e-5: "1.234e-05", 0.1: "0.1", 2.5e300: "2.5e+300", math.inf: "inf", -math.inf: "-inf", math.nan: "nan"}


def test_number_text(spark):
    df = spark.createDataFrame([(v, t) for v, t in SHORTEST.items()], "v double, want string")
    assert df.where(text.shortest(F.col("v")) != F.col("want")).count() == 0
    row = spark.createDataFrame([(2.0 / 3, math.nan)], "v double, n double").select(
        text.format_float(F.col("v"), "fixed", 99).alias("a"), text.format_float(F.col("v"), "scientific", 2).alias("b"),
        text.format_float(F.col("v"), "fixed", -4).alias("c"), text.format_float(F.col("n"), "fixed", 2).alias("d")).first()
    assert (len(row.a), row.b, row.c, row.d) == (19, "6.67e-01", "1", "nan")


def test_structs_as_text(spark):
    df = spark.sql("""SELECT 1 AS k, named_struct('name', 'a "b"\\n', 'x', double('NaN'), 'y', array(1.5D, double('-Infinity')),
        'in', named_struct('q', array(named_struct('z', 7)), 'e', array()), 'raw', X'00ff', 'no', cast(null as int)) AS s""")
    assert rendering.to_json(df, "s").first().json == (
        '{"name": "a \\"b\\"\\n", "x": "nan", "y": [1.5, "-inf"], "in": {"q": [{"z": 7}], "e": []}, "raw": "0x00ff", "no": null}')
    assert rendering.element_text(df, "s").first().text == (
        '{name=a "b"\n, x=nan, y=[1.5, -inf], in={q=[{z=7}], e=[]}, raw=0x00ff, no=}')
    rows = rendering.fields(df, "s").collect()
    assert [(r.k, r.name) for r in rows] == [(1, n) for n in ("name", "x", "y", "in", "raw", "no")] and rows[2].value == "[1.5, -inf]"
    with pytest.raises(ArgumentError):
        rendering.fields(df, "k")


def test_text_list(spark):
    rows = rendering.text_list(cells_from(spark, [[1.0, 0.25], [30.0, np.nan]])).orderBy("at").collect()
    assert [(r["at"], r.label, r.text, r.length) for r in rows] == [
        (0, "[0,0]", "1", 1), (1, "[0,1]", "0.25", 4), (2, "[1,0]", "30", 2), (3, "[1,1]", "nan", 3)]


# --- pipelines ----------------------------------------------------------------


def test_pipeline(spark):
    array = np.arange(24.0).reshape(4, 6) - 7
    cells = cells_from(spark, array, integer=True)
    steps = [("slice", slice(1, None), slice(None, None, 2)), "transpose", ("multiply", 3), ("cumsum", 0), ("max", {"axis": 0})]
    done = pipeline(cells, steps)
    assert done.error is None and done.ran == 5
    np.testing.assert_array_equal(to_numpy(done.cells), np.cumsum(array[1:, ::2].T * 3, axis=0).max(axis=0))
    assert dict(done.frame().dtypes)["v"] == "bigint"
    assert to_numpy(pipeline(cells, steps, up_to=2).cells).shape == (3, 3)


@pytest.mark.parametrize("step,whole", [
    ("abs", True), (("add", 2), True), (("add", 0.5), False), ("sqrt", False), ("normalize", False), (("pow", 2), True),
    (("pow", -1), False), (("pow", 0.5), False), (("clip", 0, None), True), (("clip", 0.5, 2), False), (("sum", None, 0.5), False),
    (("sum", None, 4), True), (("prod",), True), ("cumprod", True), ("diff", True),
])
def test_whole_numbers_stay_whole(spark, step, whole):
    ran = pipeline(cells_from(spark, [1.0, 2.0, 3.0], integer=True), ["slice", step])
    assert ran.cells.integer is whole
    assert dict(ran.frame().dtypes)["v"] == ("bigint" if whole else "double")


def test_whole_numbers_past_two_to_the_53_stay_doubles(spark):
    ran = pipeline(cells_from(spark, [3.0, 2.0**52], integer=True), ["slice", ("multiply", 4)])
    assert dict(ran.frame().dtypes)["v"] == "double"
    assert dict(pipeline(cells_from(spark, [3.0, np.nan], integer=True), ["slice"]).frame().dtypes)["v"] == "double"


def test_provable_limits_need_no_job(spark):
    sizes = spark.createDataFrame([(0, 3), (1, None), (2, -2)], "k bigint, v int")
    cells = cells_of(sizes, ["k"], "v", (3,), integer=True)
    assert cells.limit == 1 << 31
    safe = pipeline(cells, ["slice", ("multiply", 8), ("add", -5), "diff", "abs", ("clip", 0, 1e9), "cumsum"])
    assert safe.cells.limit == 2e0 * max((8.0 * (1 << 31) + 5) * 2, 1e9)
    far = pipeline(cells, ["slice", ("pow", 2), ("pow", 3)])
    assert far.cells.integer and far.cells.limit is None
    plain = pipeline(cells, ["slice", ("multiply", 2)]).frame()
    assert {r.i0: r.v for r in plain.collect()} == {0: 6, 1: None, 2: -4}
    assert dict(pipeline(cells, ["slice", ("pow", 30)]).frame().dtypes)["v"] == "double"


def test_a_refusal_stops_the_pipeline_and_keeps_what_ran(spark):
    cells = cells_from(spark, np.arange(6.0))
    ran = pipeline(cells, ["slice", ("reshape", (2, 3)), ("reshape", (4, 4)), "sqrt"])
    assert ran.ran == 2 and ran.cells.shape == (2, 3) and "16 elements for 6" in ran.error
    assert "no operation" in pipeline(cells, ["slice", "fold"]).error
    assert pipeline(cells, ["slice", ("sqrt", 2)]).ran == 1
    assert pipeline(cells, [("slice", 99)]).ran == 0
    assert pipeline(spark.range(3), ["slice"]).error.startswith("not numeric")
    assert pipeline(cells_from(spark, 4.0), ["slice", "sqrt"]).ran == 2
    with pytest.raises(ArgumentError):
        pipeline_line(cells, ["slice", ("reshape", (2, 3))])
    assert pipeline_line(cells, ["slice", ("reshape", (2, 3)), ("sum", 0)]).count() == 3
