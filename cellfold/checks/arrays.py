"""Selection, folds, running operators, element-wise math, rearranging, pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellfold.checks import check
from cellfold.checks.inputs import CELLS, CUBE, cube, embeddings, events, part_sizes
from cellfold.model import cells_of
from cellfold.operators import elementwise, folds, grids, members, rearranging, running, selecting
from cellfold.plans.pipeline import pipeline, pipeline_line
from cellfold.sources import tables
from cellfold.sources.tables import scan


def rounded(cells, places=6):
    return cells.df.withColumn("v", F.round("v", places))


# --- sources ------------------------------------------------------------------


@check("scan", "SELECT event_id, event_type, value FROM events")
def _(spark, d):
    return scan(spark, d, "events", ["event_id", "event_type", "value"])


@check("window", f"WITH {CELLS} SELECT i0, i1, v FROM cells WHERE i0 >= 10 AND i0 < 450 AND i1 >= 5")
def _(spark, d):
    return tables.window(embeddings(spark, d), [10, 5], [440, 100])


LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
                "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@check("element_positions", f"""
SELECT row_number() OVER (ORDER BY {', '.join(LINE_COLUMNS)}) - 1 AS pos, l_orderkey, l_partkey, l_extendedprice
FROM lineitem""")
def _(spark, d):
    placed = tables.element_positions(scan(spark, d, "lineitem", LINE_COLUMNS), LINE_COLUMNS)
    return placed.select("pos", "l_orderkey", "l_partkey", "l_extendedprice")


@check("series_positions", """
SELECT event_type AS series, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos, value AS v
FROM events""")
def _(spark, d):
    df = scan(spark, d, "events", ["event_id", "event_type", "value"])
    placed = tables.series_positions(df, "event_type", ["event_id"])
    return placed.select(F.col("event_type").alias("series"), "pos", F.col("value").alias("v"))


@check("array_cells", f"WITH {CELLS} SELECT i0, i1, v FROM cells")
def _(spark, d):
    return embeddings(spark, d).df


# --- selection ----------------------------------------------------------------


@check("slice_strided", f"""
WITH {CELLS}, n AS (SELECT count(*) AS n FROM embeddings)
SELECT (i0 - 5) // 3 AS i0, (63 - i1) // 2 AS i1, v FROM cells, n
WHERE i0 >= 5 AND i0 < n - 5 AND (i0 - 5) % 3 = 0 AND (63 - i1) % 2 = 0""")
def _(spark, d):
    return selecting.slice(embeddings(spark, d), slice(5, -5, 3), slice(None, None, -2)).df


@check("slice_ellipsis", f"WITH {CUBE} SELECT i0, i1, v FROM cube WHERE i2 = 2")
def _(spark, d):
    return selecting.slice(cube(spark, d), ..., 2).df


@check("slice_array_axis", f"""
WITH {CELLS} SELECT i0 - 100 AS i0, (i1 - 8) // 5 AS i1, v FROM cells WHERE i0 BETWEEN 100 AND 399 AND i1 >= 8 AND i1 < 56 AND (i1 - 8) % 5 = 0""")
def _(spark, d):
    return selecting.slice(embeddings(spark, d), slice(100, 400), slice(8, 56, 5)).df


@check("pin_array_axis", f"WITH {CELLS} SELECT i0, v FROM cells WHERE i1 = 61")
def _(spark, d):
    return selecting.pin(embeddings(spark, d), 1, -3).df


@check("cube_slice", f"WITH {CUBE} SELECT i0 - 3 AS i0, i1, i2, v FROM cube WHERE i0 BETWEEN 3 AND 20")
def _(spark, d):
    return selecting.slice(cube(spark, d), slice(3, 21)).df


@check("cube_slice_turned", f"""
WITH {CUBE} SELECT i2 AS i0, 9 - i1 AS i1, abs(v) AS v FROM cube WHERE i0 = 7""")
def _(spark, d):
    turned = rearranging.transpose(elementwise.abs(selecting.slice(cube(spark, d), slice(5, 20), slice(None, None, -1))))
    return selecting.slice(turned, ..., 2).df


@check("slice_reversed", "SELECT (SELECT max(event_id) FROM events) - event_id AS i0, value AS v FROM events")
def _(spark, d):
    return selecting.slice(events(spark, d), slice(None, None, -1)).df


@check("take", f"""
WITH {CELLS}, pairs(o, n) AS (VALUES (3, 0), (0, 1), (10, 2), (13, 3), (16, 4), (19, 5), (63, 6))
SELECT i0, CAST(n AS BIGINT) AS i1, v FROM cells JOIN pairs ON i1 = o""")
def _(spark, d):
    return selecting.take(embeddings(spark, d), 1, [3, 0, slice(10, 20, 3), 3, -1]).df


def _customers(spark, d):
    customer = scan(spark, d, "customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    nation = scan(spark, d, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    record = F.struct("c_name", "c_acctbal", F.struct("n_name", "n_regionkey").alias("nation"))
    return joined.select("c_custkey", record.alias("s")), tables.row_count(customer)


@check("select_member", "SELECT CAST(c_custkey AS BIGINT) AS i0, c_acctbal AS v FROM customer")
def _(spark, d):
    df, n = _customers(spark, d)
    return members.select_member(df, "s.c_acctbal", ["c_custkey"], (n,)).df


@check("select_member_nested", """
SELECT CAST(c_custkey AS BIGINT) AS i0, n_name AS v FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def _(spark, d):
    df, n = _customers(spark, d)
    return members.select_member(df, "s.nation.n_name", ["c_custkey"], (n,)).df


def _vectors(spark, d):
    df = scan(spark, d, "embeddings", ["vec_id", "embedding", "label"])
    return df.select("vec_id", F.struct("embedding", "label").alias("s")), tables.row_count(df)


@check("select_member_array", f"WITH {CELLS} SELECT i0, i1, v FROM cells")
def _(spark, d):
    df, n = _vectors(spark, d)
    return members.select_member(df, "s.embedding", ["vec_id"], (n,), (64,)).df


@check("select_member_array_index", f"WITH {CELLS} SELECT i0, v FROM cells WHERE i1 = 61")
def _(spark, d):
    df, n = _vectors(spark, d)
    return members.select_member(df, "s.embedding", ["vec_id"], (n,), (64,), sub=-3).df


@check("vlen_at", """
SELECT conv_id AS i0, turn AS i1, string_split(text, ' ')[41] AS v FROM conversations""")
def _(spark, d):
    df = scan(spark, d, "conversations", ["conv_id", "turn", "text"])
    top = df.agg(F.max("conv_id"), F.max("turn")).first()
    return members.vlen_at(df.withColumn("words", F.split("text", " ")), "words", 40, ["conv_id", "turn"],
                           (top[0] + 1, top[1] + 1)).df


@check("line", f"WITH {CELLS} SELECT 'vector' AS series, i1 - 8 AS pos, v FROM cells WHERE i0 = 3 AND i1 BETWEEN 8 AND 55")
def _(spark, d):
    return selecting.line(embeddings(spark, d), 3, slice(8, 56), series="vector")


@check("lines_of", f"WITH {CUBE} SELECT i0 * 10 + i1 AS series, i2 AS pos, v FROM cube")
def _(spark, d):
    return selecting.lines_of(cube(spark, d), confirmed=True)


@check("thin", """
WITH s AS (SELECT ceil(count(*) / 2048.0)::BIGINT AS stride FROM events)
SELECT 'events' AS series, event_id AS pos, value AS v FROM events, s WHERE event_id % stride = 0""")
def _(spark, d):
    cells = events(spark, d)
    return selecting.thin(selecting.line(cells, series="events"), 2048, cells.size)


@check("run_of", """
SELECT 'events' AS series, event_id AS pos, value AS v FROM events WHERE event_id >= 900 AND event_id < 900 + 5000""")
def _(spark, d):
    return selecting.run_of(selecting.line(events(spark, d), series="events"), 900, 5000)


@check("first_series", f"WITH {CELLS} SELECT i0 AS series, i1 AS pos, v FROM cells WHERE i0 < 64")
def _(spark, d):
    return selecting.first_series(selecting.lines_of(embeddings(spark, d), confirmed=True), 64)


@check("pin", f"WITH {CUBE} SELECT i0, i1, v FROM cube WHERE i2 = 3")
def _(spark, d):
    return selecting.pin(cube(spark, d), 2, -1).df


@check("grid", f"WITH {CUBE} SELECT i0 * 10 + i1 AS row, i2 AS col, v FROM cube")
def _(spark, d):
    return grids.grid(cube(spark, d))


@check("grid_two_on_columns", f"WITH {CUBE} SELECT i0 AS row, i1 * 4 + i2 AS col, v FROM cube")
def _(spark, d):
    return grids.grid(cube(spark, d), [1, 2])


_BLOCK = ", ".join(f"max(v) FILTER (i1 = {c}) AS c{c}" for c in range(60, 76))


@check("grid_block", f"WITH {CELLS} SELECT i0 AS row, {_BLOCK} FROM cells WHERE i0 >= 400 AND i0 < 464 GROUP BY i0")
def _(spark, d):
    return grids.grid_block(grids.grid(embeddings(spark, d)), 400, 60, cols=16)


@check("cell_labels", f"""
WITH {CUBE} SELECT i0 * 10 + i1 AS row, i2 AS col, v, '[' || i0 || ',' || i1 || ',' || i2 || ']' AS cell_label,
  '[' || i0 || ',' || i1 || ',_]' AS row_label, '[_,_,' || i2 || ']' AS col_label FROM cube""")
def _(spark, d):
    return grids.cell_labels(cube(spark, d))


@check("line_expressions", """
SELECT line, '/events[' || line // 10 || ', ' || line % 10 || ', :]' AS expression
FROM (SELECT unnest(range(0, count(*) // 4)) AS line FROM events)""")
def _(spark, d):
    return grids.line_expressions(cube(spark, d), "/events")


# --- folds --------------------------------------------------------------------

SPOILT = f"""{CELLS}, spoilt AS (SELECT i0, i1, CASE WHEN v < -0.3 THEN 'nan'::DOUBLE ELSE v END AS v FROM cells)"""


def spoilt(spark, d):
    """The embeddings with NaN at every value under -0.3."""
    cells = embeddings(spark, d)
    return cells.mapped(F.when(F.col("v") < -0.3, F.lit(float("nan"))).otherwise(F.col("v")), False)


def _nan_wins(fold):
    return f"CASE WHEN bool_or(isnan(v)) THEN 'nan'::DOUBLE ELSE {fold}(v) END AS v"


@check("min_axis", f"WITH {SPOILT} SELECT i0, {_nan_wins('min')} FROM spoilt GROUP BY i0")
def _(spark, d):
    return folds.min(spoilt(spark, d), -1).df


@check("max_axis", f"WITH {SPOILT} SELECT i0, {_nan_wins('max')} FROM spoilt GROUP BY i0")
def _(spark, d):
    return folds.max(spoilt(spark, d), 1).df


@check("min_max_all", f"WITH {CUBE} SELECT min(v) AS lo, max(v) AS hi FROM cube")
def _(spark, d):
    cells = cube(spark, d)
    lo, hi = folds.min(cells).df, folds.max(cells).df
    return lo.select(F.col("v").alias("lo")).withColumn("hi", hi.select("v").scalar())


@check("max_two_axes", f"WITH {CUBE} SELECT i1 AS i0, max(v) AS v FROM cube GROUP BY i1")
def _(spark, d):
    return folds.max(cube(spark, d), (0, -1)).df


@check("sum_axis", f"WITH {CELLS} SELECT i1 AS i0, round(sum(v) + 10, 6) AS v FROM cells GROUP BY i1")
def _(spark, d):
    return rounded(folds.sum(embeddings(spark, d), 0, initial=10))


@check("sum_all", "SELECT round(sum(value), 4) AS v FROM events")
def _(spark, d):
    return rounded(folds.sum(events(spark, d)), 4)


@check("sum_reproducible", f"WITH {CELLS} SELECT i1 AS i0, round(sum(v) + 10, 6) AS v FROM cells GROUP BY i1")
def _(spark, d):
    return rounded(folds.sum(embeddings(spark, d), 0, initial=10, reproducible=True))


@check("prod_axis", f"WITH {CUBE} SELECT i0, i1, round(product(v * 0.0137) * 2, 6) AS v FROM cube GROUP BY i0, i1")
def _(spark, d):
    return rounded(folds.prod(elementwise.multiply(cube(spark, d), 0.0137), 2, initial=2))


# --- running ------------------------------------------------------------------


@check("cumsum_axis", f"""
WITH {CELLS} SELECT i0, i1, round(sum(v) OVER (PARTITION BY i0 ORDER BY i1), 6) AS v FROM cells""")
def _(spark, d):
    return rounded(running.cumsum(embeddings(spark, d), 1))


@check("cumsum_flat", f"""
WITH {CELLS} SELECT i0 * 64 + i1 AS i0, round(sum(v) OVER (ORDER BY i0, i1), 6) AS v FROM cells""")
def _(spark, d):
    return rounded(running.cumsum(embeddings(spark, d)))


@check("cumsum_blocks", """
SELECT event_id AS i0, round(sum(value) OVER (ORDER BY event_id), 4) AS v FROM events""")
def _(spark, d):
    return rounded(running.cumsum(events(spark, d), 0, block=1000), 4)


@check("cumprod_axis", f"""
WITH {CUBE} SELECT i0, i1, i2, round(product(v * 0.0137) OVER (PARTITION BY i0, i1 ORDER BY i2), 6) AS v FROM cube""")
def _(spark, d):
    return rounded(running.cumprod(elementwise.multiply(cube(spark, d), 0.0137), 2))


@check("cumprod_blocks", """
SELECT p_partkey AS i0, round(product(1 + (p_size - 25.5) / 10000) OVER (ORDER BY p_partkey), 6) AS v FROM part""")
def _(spark, d):
    near_one = elementwise.add(elementwise.multiply(elementwise.add(part_sizes(spark, d), -25.5), 0.0001), 1)
    return rounded(running.cumprod(near_one, block=600))


@check("diff_axis", f"""
WITH {CELLS} SELECT i0, i1, v FROM (
  SELECT i0, i1, lead(v, 1) OVER w - v AS v FROM cells WINDOW w AS (PARTITION BY i0 ORDER BY i1)) WHERE i1 < 63""")
def _(spark, d):
    return running.diff(embeddings(spark, d)).df


@check("diff_blocks", """
SELECT i0, v FROM (
  SELECT event_id AS i0, round((lead(value, 2) OVER w - lead(value, 1) OVER w) - (lead(value, 1) OVER w - value), 6) AS v
  FROM events WINDOW w AS (ORDER BY event_id)) WHERE v IS NOT NULL""")
def _(spark, d):
    return rounded(running.diff(events(spark, d), 2, block=1000))


# --- element-wise -------------------------------------------------------------


@check("abs", f"WITH {CELLS} SELECT i0, i1, abs(v) AS v FROM cells")
def _(spark, d):
    return elementwise.abs(embeddings(spark, d)).df


@check("sqrt", f"WITH {CELLS} SELECT i0, i1, CASE WHEN v < 0 THEN 'nan'::DOUBLE ELSE sqrt(v) END AS v FROM cells")
def _(spark, d):
    return elementwise.sqrt(embeddings(spark, d)).df


@check("pow", f"WITH {CELLS} SELECT i0, i1, round(pow(v, 3), 6) AS v FROM cells")
def _(spark, d):
    return rounded(elementwise.pow(embeddings(spark, d), 3))


@check("clip", f"""
WITH {SPOILT} SELECT i0, i1, CASE WHEN isnan(v) THEN v WHEN v < -0.1 THEN -0.1 WHEN v > 0.2 THEN 0.2 ELSE v END AS v
FROM spoilt""")
def _(spark, d):
    return elementwise.clip(spoilt(spark, d), -0.1, 0.2).df


@check("add", f"WITH {CELLS} SELECT i0, i1, v + 2.5 AS v FROM cells")
def _(spark, d):
    return elementwise.add(embeddings(spark, d), 2.5).df


@check("multiply", f"WITH {CELLS} SELECT i0, i1, v * -3.0 AS v FROM cells")
def _(spark, d):
    return elementwise.multiply(embeddings(spark, d), -3).df


@check("normalize", f"""
WITH {SPOILT}, ends AS (SELECT min(v) AS lo, max(v) AS hi FROM spoilt WHERE NOT isnan(v))
SELECT i0, i1, CASE WHEN isnan(v) THEN v
  ELSE round((1 - (v - lo) / (hi - lo)) * 10 + (v - lo) / (hi - lo) * 20, 6) END AS v FROM spoilt, ends""")
def _(spark, d):
    return rounded(elementwise.normalize(spoilt(spark, d), 10, 20))


# --- rearranging --------------------------------------------------------------


@check("transpose", f"WITH {CUBE} SELECT i2 AS i0, i1, i0 AS i2, v FROM cube")
def _(spark, d):
    return rearranging.transpose(cube(spark, d)).df


@check("transpose_axes", f"WITH {CUBE} SELECT i1 AS i0, i2 AS i1, i0 AS i2, v FROM cube")
def _(spark, d):
    return rearranging.transpose(cube(spark, d), (1, 2, 0)).df


@check("reshape", f"""
WITH {CELLS}, flat AS (SELECT i0 * 64 + i1 AS p, v FROM cells)
SELECT p // 160 AS i0, p // 32 % 5 AS i1, p % 32 AS i2, v FROM flat""")
def _(spark, d):
    """Any number of vectors: the last row may hold fewer than 160 elements."""
    return rearranging.reshape(embeddings(spark, d), (-1, 5, 32), partial=True).df


# --- pipelines ----------------------------------------------------------------


@check("array_pipeline", f"""
WITH {CELLS}, picked AS (SELECT i0 // 2 AS i0, i1, v FROM cells WHERE i0 % 2 = 0),
moved AS (SELECT i1 AS i0, i0 AS i1, abs(v) * 100 AS v FROM picked),
ran AS (SELECT i0, i1, sum(v) OVER (PARTITION BY i0 ORDER BY i1) AS v FROM moved)
SELECT i0, round(max(v), 6) AS v FROM ran GROUP BY i0""")
def _(spark, d):
    steps = [("slice", slice(None, None, 2)), "transpose", "abs", ("multiply", 100), ("cumsum", 1), ("max", {"axis": -1})]
    return rounded(pipeline(embeddings(spark, d), steps).cells)


@check("pipeline_whole_numbers", """
SELECT p_partkey AS i0, CAST(sum(p_size * 2 + 1) OVER (ORDER BY p_partkey) AS BIGINT) AS v FROM part""")
def _(spark, d):
    return pipeline(part_sizes(spark, d), ["slice", ("multiply", 2), ("add", 1), "cumsum"]).frame()


@check("pipeline_integer_column", "SELECT p_partkey - 1 AS i0, CAST(abs(3 * p_size - 40) AS BIGINT) AS v FROM part WHERE p_partkey >= 1 ORDER BY 1")
def _(spark, d):
    """Whole numbers come back as such because the column holds them."""
    df = scan(spark, d, "part", ["p_partkey", "p_size"])
    top = df.agg(F.max("p_partkey")).first()[0]
    cells = cells_of(df, ["p_partkey"], "p_size", (top + 1,))
    return pipeline(cells, [("slice", slice(1, None)), ("multiply", 3), ("add", -40), "abs"]).frame()


@check("pipeline_stops", "SELECT event_id // 40 AS i0, event_id % 40 AS i1, value AS v FROM events")
def _(spark, d):
    return pipeline(events(spark, d), ["slice", ("reshape", (-1, 40)), ("transpose", (0, 0)), "sqrt"]).cells.df


@check("pipeline_line", f"""
WITH {CELLS} SELECT 'spread' AS series, i0 AS pos, max(v) - min(v) AS v FROM cells GROUP BY i0""")
def _(spark, d):
    cells = embeddings(spark, d)
    high = pipeline_line(cells, ["slice", ("max", 1)])
    low = pipeline_line(cells, ["slice", ("min", 1)])
    return high.join(low.select("pos", F.col("v").alias("low")), "pos").select(
        F.lit("spread").alias("series"), "pos", (F.col("v") - F.col("low")).alias("v"))
