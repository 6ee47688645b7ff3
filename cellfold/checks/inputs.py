"""The given tables as arrays, lines, struct datasets and a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellfold.model import Cells, cells_of
from cellfold.operators.rearranging import reshape
from cellfold.sources.catalog import build_nodes
from cellfold.sources.tables import array_cells, row_count, scan

# Elements in every embedding, as the table's schema has it.
EMBEDDING = 64


def embeddings(spark: SparkSession, folder: str) -> Cells:
    """(vectors, 64) cells."""
    df = scan(spark, folder, "embeddings", ["vec_id", "embedding"])
    return array_cells(df, ["vec_id"], "embedding", (row_count(df), EMBEDDING))


def events(spark: SparkSession, folder: str) -> Cells:
    """(events,) cells of the event values."""
    df = scan(spark, folder, "events", ["event_id", "value"])
    return cells_of(df, ["event_id"], "value", (row_count(df),))


def cube(spark: SparkSession, folder: str) -> Cells:
    return reshape(events(spark, folder), (-1, 10, 4))


def part_sizes(spark: SparkSession, folder: str) -> Cells:
    """(parts,) whole-number cells."""
    df = scan(spark, folder, "part", ["p_partkey", "p_size"])
    return cells_of(df, ["p_partkey"], "p_size", (row_count(df),), integer=True)


def event_line(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    df = scan(spark, folder, "events", ["event_id", "value"])
    line = df.select(F.lit("events").alias("series"), F.col("event_id").alias("pos"), F.col("value").alias("v"))
    return line, row_count(df)


def seconds(column: str):
    """Seconds since 1970 of a timestamp without a zone, whatever the session's zone is."""
    since = f"(CAST({column} AS TIMESTAMP_NTZ) - TIMESTAMP_NTZ'1970-01-01 00:00:00')"
    micros = F.expr(
        f"extract(DAY FROM {since}) * 86400000000L + extract(HOUR FROM {since}) * 3600000000L"
        f" + extract(MINUTE FROM {since}) * 60000000L + CAST(extract(SECOND FROM {since}) * 1000000 AS BIGINT)")
    return micros / F.lit(1e6)


def event_base(spark: SparkSession, folder: str) -> DataFrame:
    """The event times as a time base [pos, v]."""
    return scan(spark, folder, "events", ["event_id", "ts"]).select(
        F.col("event_id").alias("pos"), seconds("ts").alias("v"))


def order_line(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, "orders", ["o_orderkey", "o_totalprice"]).select(
        F.lit("orders").alias("series"), F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("v"))


def typed_events(spark: SparkSession, folder: str) -> DataFrame:
    """[series, pos, x, v]: one series per event type, at the event's time."""
    return scan(spark, folder, "events", ["event_id", "ts", "event_type", "value"]).select(
        F.col("event_type").alias("series"), F.col("event_id").alias("pos"), seconds("ts").alias("x"),
        F.col("value").alias("v"))


def page_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Page addresses as paths: the host, then the names along the address."""
    bare = F.regexp_replace("url", "^[a-z]+://|[?#].*$", "")
    return scan(spark, folder, "pages", ["url"]).select(F.concat(F.lit("/pages/"), F.rtrim(bare, F.lit("/"))).alias("path"))


def customer_paths(spark: SparkSession, folder: str) -> DataFrame:
    """[path, c_custkey, c_mktsegment, n_name, region, nation]: region/nation/customer."""
    region = scan(spark, folder, "region", ["r_regionkey", "r_name"])
    nation = scan(spark, folder, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    customer = scan(spark, folder, "customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(
        region, nation.n_regionkey == region.r_regionkey)
    return joined.select(
        F.concat_ws("/", F.lit(""), "r_name", "n_name", "c_name").alias("path"),
        "c_custkey", "c_name", "c_mktsegment", "n_name",
        F.concat_ws("/", F.lit(""), "r_name").alias("region"),
        F.concat_ws("/", F.lit(""), "r_name", "n_name").alias("nation"))


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The catalog of pages and customers."""
    listed = page_paths(spark, folder).unionByName(customer_paths(spark, folder).select("path"))
    return build_nodes(listed)


# --- the same in SQL ----------------------------------------------------------

CELLS = """cells AS (
  SELECT vec_id AS i0, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS i1,
         CAST(unnest(embedding) AS DOUBLE) AS v
  FROM embeddings)"""

CUBE = """cube AS (
  SELECT event_id // 40 AS i0, (event_id // 4) % 10 AS i1, event_id % 4 AS i2, value AS v FROM events)"""

BASE = "base AS (SELECT event_id AS pos, epoch_us(ts) / 1e6 AS v FROM events)"

CUSTOMERS = """customers AS (
  SELECT '/' || r_name || '/' || n_name || '/' || c_name AS path, c_custkey, c_name, c_mktsegment, n_name,
         '/' || r_name AS region, '/' || r_name || '/' || n_name AS nation
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

NODES = CUSTOMERS + """,
listed AS (
  SELECT '/pages/' || rtrim(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') AS path FROM pages
  UNION ALL SELECT path FROM customers),
parts AS (SELECT DISTINCT path, string_split(path[2:], '/') AS p FROM listed),
every AS (
  SELECT CASE WHEN k = 0 THEN '/' ELSE '/' || array_to_string(p[1:k], '/') END AS path,
         max(CASE WHEN k < len(p) THEN 1 ELSE 0 END) AS above
  FROM (SELECT p, unnest(range(0, len(p) + 1)) AS k FROM parts) GROUP BY 1),
nodes AS (
  SELECT path, CASE WHEN path = '/' THEN '/' ELSE string_split(path, '/')[-1] END AS name,
         CASE WHEN path = '/' THEN NULL
              WHEN len(string_split(path, '/')) = 2 THEN '/'
              ELSE array_to_string(string_split(path, '/')[1:-2], '/') END AS parent,
         CASE WHEN above = 1 THEN 'Group' ELSE 'Dataset' END AS kind
  FROM every)"""
