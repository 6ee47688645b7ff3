"""Lines: alignment, time bases, extents, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellfold.checks import check
from cellfold.checks.inputs import (
    BASE, CELLS, CUBE, cube, embeddings, event_base, event_line, order_line, seconds, typed_events,
)
from cellfold.operators import aligning, elementwise, folds, ordering, selecting, summaries
from cellfold.operators.grids import grid
from cellfold.sources.tables import element_positions, row_count, scan


def vectors(spark, d):
    return selecting.lines_of(embeddings(spark, d), confirmed=True)


def numbered_events(spark, d):
    """The event values as one line, positions taken from the order of event_id."""
    df = scan(spark, d, "events", ["event_id", "value"])
    placed = element_positions(df, ["event_id"])
    return placed.select(F.lit("events").alias("series"), "pos", F.col("value").alias("v")), row_count(df)


# --- envelopes ----------------------------------------------------------------


def envelope_sql(source: str, width: str, seam: bool = False) -> str:
    """SQL of an envelope over CTE ``source`` [series, pos, v] with buckets of ``width``."""
    joined = f"""
      SELECT e.series, e.bucket, e.pos, e.v FROM b e
      UNION ALL
      SELECT x.series, x.bucket, n.pos, n.v
      FROM b x JOIN b n ON n.series = x.series AND n.pos = x.pos + 1 AND n.bucket = x.bucket + 1
      WHERE isfinite(x.v) AND isfinite(n.v)""" if seam else "SELECT series, bucket, pos, v FROM b"
    return f"""
    b AS (SELECT series, pos // {width} AS bucket, pos, v FROM {source}),
    j AS ({joined}),
    e AS (
      SELECT series, bucket, min(pos) AS start, min(v) FILTER (isfinite(v)) AS lo, max(v) FILTER (isfinite(v)) AS hi
      FROM j GROUP BY ALL),
    p AS (
      SELECT e.series, e.bucket, any_value(start) AS start, any_value(lo) AS lo, any_value(hi) AS hi,
             min(pos) FILTER (v = lo) AS lo_at, min(pos) FILTER (v = hi) AS hi_at
      FROM e JOIN j ON j.series = e.series AND j.bucket = e.bucket GROUP BY ALL),
    pairs AS (
      SELECT series, bucket, CASE WHEN hi_at < lo_at THEN 1 ELSE 0 END AS slot, coalesce(lo_at, start) AS pos,
             coalesce(lo, 'nan'::DOUBLE) AS v FROM p
      UNION ALL
      SELECT series, bucket, CASE WHEN hi_at < lo_at THEN 0 ELSE 1 END, coalesce(hi_at, start),
             coalesce(hi, 'nan'::DOUBLE) FROM p)"""


EVENTS = "line AS (SELECT 'events' AS series, event_id AS pos, value AS v FROM events)"
COUNT = "(SELECT count(*) FROM events)"


@check("flagship", f"WITH {EVENTS}, {envelope_sql('line', f'CAST(ceil({COUNT} / 100.0) AS BIGINT)', True)} SELECT * FROM pairs")
def flagship(spark, d):
    lines, n = numbered_events(spark, d)
    return summaries.envelope(lines, buckets=100, length=n, seam=True, series_count=1)


@check("envelope", f"WITH {EVENTS}, {envelope_sql('line', f'CAST(ceil({COUNT} / 500.0) AS BIGINT)')} SELECT * FROM pairs")
def _(spark, d):
    lines, n = event_line(spark, d)
    return summaries.envelope(lines, buckets=500, length=n, series_count=1)


ROOTS = f"""{CELLS}, line AS (
  SELECT i0 AS series, i1 AS pos, CASE WHEN v < 0 THEN 'nan'::DOUBLE ELSE sqrt(v) END AS v FROM cells)"""


@check("envelope_gaps_seam", f"WITH {ROOTS}, {envelope_sql('line', '5', True)} SELECT * FROM pairs")
def _(spark, d):
    lines = selecting.lines_of(elementwise.sqrt(embeddings(spark, d)), confirmed=True)
    return summaries.envelope(lines, bucket=5, seam=True)


@check("envelope_many_buckets", f"WITH {EVENTS}, {envelope_sql('line', '2', True)} SELECT * FROM pairs")
def _(spark, d):
    """Half as many buckets as samples, with a bound that no broadcast is made for."""
    lines, n = event_line(spark, d)
    return summaries.envelope(lines, bucket=2, length=n, seam=True, series_count=1 + summaries.BROADCAST_ROWS // n)


@check("envelope_lengths", f"""
WITH placed AS (
  SELECT event_type AS series, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos, value AS v
  FROM events),
n AS (SELECT series, CAST(ceil(count(*) / 40.0) AS BIGINT) AS w FROM placed GROUP BY 1),
line AS (SELECT placed.*, w FROM placed JOIN n USING (series)),
b AS (SELECT series, pos // w AS bucket, pos, v FROM line),
e AS (SELECT series, bucket, min(v) AS lo, max(v) AS hi FROM b GROUP BY ALL),
p AS (
  SELECT e.series, e.bucket, any_value(lo) AS lo, any_value(hi) AS hi, min(pos) FILTER (v = lo) AS lo_at,
         min(pos) FILTER (v = hi) AS hi_at
  FROM e JOIN b ON b.series = e.series AND b.bucket = e.bucket GROUP BY ALL)
SELECT series, bucket, CASE WHEN hi_at < lo_at THEN 1 ELSE 0 END AS slot, lo_at AS pos, lo AS v FROM p
UNION ALL SELECT series, bucket, CASE WHEN hi_at < lo_at THEN 0 ELSE 1 END, hi_at, hi FROM p""")
def _(spark, d):
    from cellfold.sources.tables import series_positions

    df = scan(spark, d, "events", ["event_id", "event_type", "value"])
    lines = series_positions(df, "event_type", ["event_id"]).select(
        F.col("event_type").alias("series"), "pos", F.col("value").alias("v"))
    return summaries.envelope(lines, buckets=40)


def _levels(first: int, count: int) -> str:
    """The pyramid's widths, each with its pairs."""
    ctes, picks = [EVENTS], []
    for k in range(count):
        width = first << k
        body = envelope_sql("line", str(width))
        for name in ("b", "j", "e", "p", "pairs"):
            for before, after in ((f"\n    {name} AS", f"\n    {name}{k} AS"), (f"FROM {name} ", f"FROM {name}{k} "),
                                  (f"FROM {name})", f"FROM {name}{k})"), (f"JOIN {name} ", f"JOIN {name}{k} "),
                                  (f"FROM {name}\n", f"FROM {name}{k}\n")):
                body = body.replace(before, after)
        body = body.replace(f"FROM e{k} JOIN j{k} ON j.series = e.series AND j.bucket = e.bucket",
                            f"FROM e{k} e JOIN j{k} j ON j.series = e.series AND j.bucket = e.bucket")
        ctes.append(body)
        once = f" AND {width} < 2 * (SELECT count(*) FROM events)"
        picks.append(f"SELECT CAST({width} AS BIGINT) AS width, * FROM pairs{k} WHERE true{once}")
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(picks)}"


@check("pyramid", _levels(64, 12))
def _(spark, d):
    lines, n = event_line(spark, d)
    return summaries.pyramid(lines, 64, n, series_count=1)


@check("coarsen", f"WITH {EVENTS}, {envelope_sql('line', '48')} SELECT * FROM pairs")
def _(spark, d):
    lines, n = event_line(spark, d)
    return summaries.coarsen(summaries.envelope(lines, bucket=16, length=n, series_count=1), 3)


@check("closer_look", f"""
WITH run AS (SELECT 'events' AS series, event_id - 137 AS pos, value AS v FROM events WHERE event_id BETWEEN 137 AND 137 + 800),
line AS (SELECT * FROM run WHERE pos < 800),
b AS (SELECT series, pos // 30 AS bucket, pos, v FROM line),
j AS (SELECT * FROM b UNION ALL
      SELECT x.series, x.pos // 30, n.pos, n.v FROM line x JOIN run n ON n.pos = x.pos + 1
      WHERE n.pos % 30 = 0 OR n.pos = 800),
e AS (SELECT series, bucket, min(v) AS lo, max(v) AS hi FROM j GROUP BY ALL),
p AS (SELECT e.series, e.bucket, any_value(lo) AS lo, any_value(hi) AS hi, 137 + min(pos) FILTER (v = lo) AS lo_at,
             137 + min(pos) FILTER (v = hi) AS hi_at
      FROM e JOIN j ON j.series = e.series AND j.bucket = e.bucket GROUP BY ALL)
SELECT series, bucket, CASE WHEN hi_at < lo_at THEN 1 ELSE 0 END AS slot, lo_at AS pos, lo AS v FROM p
UNION ALL SELECT series, bucket, CASE WHEN hi_at < lo_at THEN 0 ELSE 1 END, hi_at, hi FROM p""")
def _(spark, d):
    return summaries.closer_look(event_line(spark, d)[0], 137, 800, 30, series_count=1)


def _log_sql(source: str, lo: str, hi: str, columns: int) -> str:
    return f"""
    c AS (
      SELECT series, least(greatest(floor((ln(x) - ln({lo})) / (ln({hi}) - ln({lo})) * {columns}), 0), {columns - 1})::BIGINT
               AS "column", pos, x, v
      FROM {source} WHERE x > 0 AND x >= {lo} AND x <= {hi}),
    e AS (SELECT series, "column", min(v) AS lo, max(v) AS hi FROM c GROUP BY ALL),
    p AS (
      SELECT e.series, e."column", any_value(lo) AS lo, any_value(hi) AS hi, min(pos) FILTER (v = lo) AS lo_at,
             min(pos) FILTER (v = hi) AS hi_at, arg_min(x, pos) FILTER (v = lo) AS lo_x, arg_min(x, pos) FILTER (v = hi) AS hi_x
      FROM e JOIN c ON c.series = e.series AND c."column" = e."column" GROUP BY ALL)
    SELECT series, "column", CASE WHEN hi_at < lo_at THEN 1 ELSE 0 END AS slot, lo_at AS pos, lo_x AS x, lo AS v FROM p
    UNION ALL SELECT series, "column", CASE WHEN hi_at < lo_at THEN 0 ELSE 1 END, hi_at, hi_x, hi FROM p"""


@check("log_columns", f"""
WITH line AS (SELECT 'events' AS series, event_id AS pos, 0.5e0 * event_id AS x, value AS v FROM events),
{_log_sql('line', '3e0', '700e0', 64)}""")
def _(spark, d):
    lines, _ = event_line(spark, d)
    return summaries.log_columns(elementwise.range_axis(lines, 0, 0.5), 3.0, 700.0, 64, series_count=1)


@check("log_columns_against", f"""
WITH line AS (
  SELECT 'events' AS series, event_id AS pos, epoch_us(ts) / 1e6 - 1704067200e0 AS x, value AS v FROM events),
{_log_sql('line', '60e0', '500000e0', 50)}""")
def _(spark, d):
    base = event_base(spark, d).withColumn("v", F.col("v") - 1704067200.0)
    return aligning.log_columns_against(event_line(spark, d)[0], base, 60.0, 500000.0, 50)


@check("overlay", """
SELECT 0::BIGINT AS series, 'event values' AS label, event_id AS pos, value AS v FROM events
UNION ALL SELECT 2::BIGINT, '/orders[:].o_totalprice', o_orderkey, o_totalprice FROM orders""")
def _(spark, d):
    line, _ = event_line(spark, d)
    return summaries.overlay(
        {"line": line, "name": "/events[:].value", "alias": "event values"},
        {"line": line, "name": "/events[:].ts", "drawn": False},
        {"line": order_line(spark, d), "name": "/orders[:].o_totalprice"})


# --- alignment ----------------------------------------------------------------


@check("against_time_base", f"""
WITH {BASE} SELECT 'orders' AS series, pos, base.v AS x, o_totalprice AS v FROM orders JOIN base ON pos = o_orderkey""")
def _(spark, d):
    return aligning.against_time_base(order_line(spark, d), event_base(spark, d))


@check("stretch", f"""
WITH {CELLS}, n AS (SELECT count(*) AS n FROM events)
SELECT i0 AS series, i1 AS pos, i1 * (n - 1) / 63 AS "at", v FROM cells, n""")
def _(spark, d):
    return aligning.stretch(vectors(spark, d), event_line(spark, d)[1])


@check("stretch_against", f"""
WITH {CELLS}, {BASE}, n AS (SELECT count(*) AS n FROM events),
s AS (SELECT i0 AS series, i1 AS pos, i1 * (n - 1) / 63 AS "at", v FROM cells, n)
SELECT series, s.pos, "at", base.v AS x, s.v FROM s JOIN base ON base.pos = round("at")""")
def _(spark, d):
    return aligning.stretch_against(vectors(spark, d), event_base(spark, d))


@check("own_time_bases", f"""
WITH {CELLS}, n AS (SELECT count(*) AS n FROM events),
bases AS (
  SELECT 'events' AS base, event_id AS pos, epoch_us(ts) / 1e6 AS x FROM events
  UNION ALL SELECT 'orders', o_orderkey, epoch_us(o_orderdate) / 1e6 FROM orders),
assigned AS (SELECT vec_id, CASE label WHEN 0 THEN 'orders' WHEN 1 THEN 'gone' ELSE 'events' END AS base FROM embeddings),
placed AS (
  SELECT i0 AS series, base, i1 AS pos, CASE WHEN base = 'events' THEN round(i1 * (n - 1) / 63) ELSE i1 END AS k, v
  FROM cells JOIN assigned ON vec_id = i0, n)
SELECT series, placed.base, placed.pos, x, v FROM placed JOIN bases ON bases.base = placed.base AND bases.pos = k""")
def _(spark, d):
    assign = scan(spark, d, "embeddings", ["vec_id", "label"]).select(
        F.col("vec_id").alias("series"),
        F.when(F.col("label") == 0, "orders").when(F.col("label") == 1, "gone").otherwise("").alias("base"))
    orders = scan(spark, d, "orders", ["o_orderkey", "o_orderdate"]).select(
        F.lit("orders").alias("base"), F.col("o_orderkey").alias("pos"), seconds("o_orderdate").alias("v"))
    bases = event_base(spark, d).select(F.lit("events").alias("base"), "pos", "v").unionByName(orders)
    return aligning.own_time_bases(vectors(spark, d), assign, bases, "events", event_line(spark, d)[1])


TYPES = "('click', 'error', 'purchase', 'signup', 'view')"

NEAREST = """
line AS (SELECT event_type AS series, event_id AS pos, epoch_us(ts) / 1e6 AS x, value AS v FROM events),
sides AS (
  SELECT probe, p.series, p.x, a.pos AS low, a.x AS low_x, a.v AS low_v, z.pos AS high, z.x AS high_x, z.v AS high_v
  FROM probes p ASOF LEFT JOIN line a ON a.series = p.series AND p.x >= a.x
  ASOF LEFT JOIN line z ON z.series = p.series AND p.x <= z.x),
best AS (SELECT *, high IS NULL OR (low IS NOT NULL AND x - low_x <= high_x - x) AS down FROM sides)
SELECT probe, series, x, CASE WHEN down THEN low ELSE high END AS pos, CASE WHEN down THEN low_x ELSE high_x END AS sample_x,
       CASE WHEN down THEN low_v ELSE high_v END AS v FROM best"""


def _series_of(key):
    return F.get(F.array(*[F.lit(t) for t in ("click", "error", "purchase", "signup", "view")]), key % 5)


@check("nearest_sample", f"""
WITH probes AS (
  SELECT c_custkey AS probe, (['click', 'error', 'purchase', 'signup', 'view'])[c_nationkey % 5 + 1] AS series,
         1704067200e0 + c_acctbal * 130 AS x FROM customer), {NEAREST}""")
def _(spark, d):
    probes = scan(spark, d, "customer", ["c_custkey", "c_nationkey", "c_acctbal"]).select(
        F.col("c_custkey").alias("probe"), _series_of(F.col("c_nationkey")).alias("series"),
        (F.lit(1704067200.0) + F.col("c_acctbal") * 130).alias("x"))
    return ordering.nearest_sample(probes, typed_events(spark, d))


@check("nearest_sample_many", f"""
WITH probes AS (
  SELECT o_orderkey AS probe, (['click', 'error', 'purchase', 'signup', 'view'])[o_custkey % 5 + 1] AS series,
         1704067200e0 + o_totalprice * 2.7 AS x FROM orders), {NEAREST}""")
def _(spark, d):
    probes = scan(spark, d, "orders", ["o_orderkey", "o_custkey", "o_totalprice"]).select(
        F.col("o_orderkey").alias("probe"), _series_of(F.col("o_custkey")).alias("series"),
        (F.lit(1704067200.0) + F.col("o_totalprice") * 2.7).alias("x"))
    return ordering.nearest_sample(probes, typed_events(spark, d))


@check("nearest_sample_gaps", f"""
WITH probes AS (
  SELECT c_custkey AS probe,
         CASE WHEN c_nationkey % 7 = 0 THEN NULL WHEN c_nationkey % 7 = 1 THEN 'other'
              ELSE (['click', 'error', 'purchase', 'signup', 'view'])[c_nationkey % 5 + 1] END AS series,
         CASE WHEN c_acctbal > 0 THEN 1704067200e0 + c_acctbal * 130 END AS x FROM customer), {NEAREST}""")
def _(spark, d):
    """Probes without a series, of an unknown one, or without a place keep their row."""
    key = F.col("c_nationkey")
    series = F.when(key % 7 == 0, None).when(key % 7 == 1, "other").otherwise(_series_of(key))
    probes = scan(spark, d, "customer", ["c_custkey", "c_nationkey", "c_acctbal"]).select(
        F.col("c_custkey").alias("probe"), series.alias("series"),
        F.when(F.col("c_acctbal") > 0, F.lit(1704067200.0) + F.col("c_acctbal") * 130).alias("x"))
    return ordering.nearest_sample(probes, typed_events(spark, d))


@check("x_range_to_positions", """
WITH ranges AS (
  SELECT s_suppkey, 1704067200e0 + s_acctbal * 100 AS lo, 1704067200e0 + s_acctbal * 100 + 86400 AS hi FROM supplier),
t AS (SELECT epoch_us(ts) / 1e6 AS t FROM events), n AS (SELECT count(*) AS n FROM events)
SELECT s_suppkey, lo, hi, least((SELECT count(*) FROM t WHERE t < lo), n - 1) AS pos_lo,
       least((SELECT count(*) FROM t WHERE t < hi), n - 1) AS pos_hi FROM ranges, n""")
def _(spark, d):
    lo = F.lit(1704067200.0) + F.col("s_acctbal") * 100
    ranges = scan(spark, d, "supplier", ["s_suppkey", "s_acctbal"]).select(
        "s_suppkey", lo.alias("lo"), (lo + 86400).alias("hi"))
    return ordering.x_range_to_positions(event_base(spark, d), ranges)


@check("sort_order", """
WITH l AS (SELECT epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (ORDER BY event_id) AS b FROM events),
o AS (SELECT epoch_us(o_orderdate) AS t, lag(epoch_us(o_orderdate)) OVER (ORDER BY o_orderkey) AS b FROM orders)
SELECT 'events' AS base, count(*) AS n, bool_and(b IS NULL OR t >= b) AS ascending, bool_and(b IS NULL OR t <= b) AS descending,
       1 AS direction FROM l
UNION ALL SELECT 'orders', count(*), bool_and(b IS NULL OR t >= b), bool_and(b IS NULL OR t <= b), 0 FROM o""")
def _(spark, d):
    orders = scan(spark, d, "orders", ["o_orderkey", "o_orderdate"]).select(
        F.col("o_orderkey").alias("pos"), seconds("o_orderdate").alias("v"))
    found = [ordering.sort_order(base, 1000).withColumn("base", F.lit(name))
             for name, base in (("events", event_base(spark, d)), ("orders", orders))]
    return found[0].unionByName(found[1])


@check("time_edges", """
WITH mixed AS (SELECT 1704067200e0 + c_custkey * 977 AS x, 0 AS kind FROM customer
               UNION ALL SELECT epoch_us(ts) / 1e6, 1 FROM events),
ran AS (SELECT x, kind, sum(kind) OVER (ORDER BY x, kind ROWS UNBOUNDED PRECEDING) AS n FROM mixed)
SELECT x, CAST(n AS BIGINT) AS before FROM ran WHERE kind = 0""")
def _(spark, d):
    edges = scan(spark, d, "customer", ["c_custkey"]).select((F.lit(1704067200.0) + F.col("c_custkey") * 977).alias("x"))
    return ordering.time_edges(event_base(spark, d), edges)


@check("time_edges_many", """
WITH t AS (SELECT epoch_us(ts) / 1e6 AS t FROM events),
e AS (SELECT DISTINCT 1704067200e0 + o_totalprice * 3 AS x FROM orders),
mixed AS (SELECT x, 0 AS kind FROM e UNION ALL SELECT t, 1 FROM t),
ran AS (SELECT x, kind, sum(kind) OVER (ORDER BY x, kind ROWS UNBOUNDED PRECEDING) AS n FROM mixed)
SELECT x, CAST(n AS BIGINT) AS before FROM ran WHERE kind = 0""")
def _(spark, d):
    edges = scan(spark, d, "orders", ["o_totalprice"]).select((F.lit(1704067200.0) + F.col("o_totalprice") * 3).alias("x"))
    return ordering.time_edges(event_base(spark, d), edges.distinct())


# --- element-wise on lines ----------------------------------------------------


@check("move", f"""
WITH {CELLS} SELECT i0 AS series, i1 AS pos, v * (label + 0.5) + vec_id AS v FROM cells JOIN embeddings ON vec_id = i0""")
def _(spark, d):
    moves = scan(spark, d, "embeddings", ["vec_id", "label"]).select(
        F.col("vec_id").alias("series"), (F.col("label") + 0.5).alias("scale"), F.col("vec_id").cast("double").alias("shift"))
    return elementwise.move(vectors(spark, d), moves)


@check("range_axis", "SELECT 'events' AS series, event_id AS pos, 5e0 + event_id * 0.25e0 AS x, value AS v FROM events")
def _(spark, d):
    return elementwise.range_axis(event_line(spark, d)[0], 5, 0.25)


@check("range_to_positions", """
SELECT p_partkey, p_retailprice AS lo, p_retailprice + p_size AS hi, (p_retailprice + p_size - 900) / -0.5 AS pos_lo,
       (p_retailprice - 900) / -0.5 AS pos_hi FROM part""")
def _(spark, d):
    ranges = scan(spark, d, "part", ["p_partkey", "p_retailprice", "p_size"]).select(
        "p_partkey", F.col("p_retailprice").alias("lo"), (F.col("p_retailprice") + F.col("p_size")).alias("hi"))
    return elementwise.range_to_positions(ranges, 900, -0.5)


@check("log_gaps", f"WITH {CELLS} SELECT i0 AS series, i1 AS pos, CASE WHEN v > 0 THEN v ELSE 'nan'::DOUBLE END AS v FROM cells")
def _(spark, d):
    return elementwise.log_gaps(vectors(spark, d))


@check("flip_xy", "SELECT event_type AS series, event_id AS pos, value AS x, epoch_us(ts) / 1e6 AS y FROM events")
def _(spark, d):
    return elementwise.flip_xy(typed_events(spark, d).withColumnRenamed("v", "y"))


# --- extents ------------------------------------------------------------------


def root_lines(spark, d):
    return selecting.lines_of(elementwise.sqrt(embeddings(spark, d)), confirmed=True)


@check("finite_extent", f"""
WITH {ROOTS} SELECT series, min(v) FILTER (isfinite(v)) AS lo, max(v) FILTER (isfinite(v)) AS hi,
  count(*) FILTER (isfinite(v)) AS points, count(*) FILTER (isfinite(v)) > 0 AS has_finite FROM line GROUP BY 1""")
def _(spark, d):
    return folds.finite_extent(root_lines(spark, d))


@check("positive_minimum", f"WITH {CELLS} SELECT i0 AS series, min(v) FILTER (v > 0) AS positive_min FROM cells GROUP BY 1")
def _(spark, d):
    return folds.positive_minimum(vectors(spark, d))


@check("axis_extents", """
SELECT CASE WHEN event_type IN ('click', 'view') THEN event_type END AS axis, min(value) AS lo, max(value) AS hi,
       min(value) FILTER (value > 0) AS positive_min, count(*) AS points, count(DISTINCT event_type) AS series_count
FROM events GROUP BY 1""")
def _(spark, d):
    return folds.axis_extents(typed_events(spark, d), ["click", "view"])


@check("time_extents", """
WITH b AS (SELECT epoch_us(ts) / 1e6 AS v FROM events UNION ALL SELECT epoch_us(o_orderdate) / 1e6 FROM orders)
SELECT min(v) AS x_min, max(v) AS x_max, min(v) FILTER (v > 0) AS x_positive_min FROM b""")
def _(spark, d):
    orders = scan(spark, d, "orders", ["o_orderdate"]).select(seconds("o_orderdate").alias("v"))
    return folds.time_extents(event_base(spark, d).select("v").unionByName(orders))


@check("sampled_extent", f"""
WITH {CUBE}, g AS (SELECT i0 * 10 + i1 AS row, i2 AS col, v FROM cube),
s AS (SELECT greatest(1, ceil((max(row) + 1) / 256.0)::BIGINT) AS s FROM g)
SELECT min(v) AS lo, max(v) AS hi, count(*) AS points FROM g, s WHERE row % s = 0""")
def _(spark, d):
    cells = cube(spark, d)
    return folds.sampled_extent(grid(cells), extents=(cells.shape[0] * 10, 4))


@check("axis_length", """
SELECT 'longest' AS axis, max(n) AS axis_length FROM (SELECT count(*) AS n FROM events GROUP BY event_type)
UNION ALL SELECT 'base', count(*) FROM events""")
def _(spark, d):
    longest = folds.axis_length(typed_events(spark, d)).withColumn("axis", F.lit("longest"))
    base = folds.axis_length(typed_events(spark, d), event_base(spark, d)).withColumn("axis", F.lit("base"))
    return longest.unionByName(base)
