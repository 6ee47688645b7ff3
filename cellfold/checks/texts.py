"""Structs, cells and numbers as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellfold.checks import check
from cellfold.checks.inputs import CELLS, CUBE, cube, embeddings, events, part_sizes
from cellfold.operators import elementwise, grids, rendering
from cellfold.sources.tables import scan


def records(spark, d):
    """Customers as structs with a nested struct and a list."""
    customer = scan(spark, d, "customer", ["c_custkey", "c_name", "c_acctbal", "c_nationkey", "c_mktsegment"])
    nation = scan(spark, d, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    logs = F.when(F.col("c_acctbal") > 0, F.round("c_acctbal", 1)).otherwise(F.lit(float("nan")))
    return joined.select("c_custkey", F.struct(
        F.col("c_name").alias("name"), logs.alias("balance"), F.struct("n_name", "n_regionkey").alias("nation"),
        F.array("c_nationkey", "n_regionkey").alias("keys")).alias("s"))


# Shortest text of a DOUBLE of moderate size: DuckDB's, without a trailing .0.
def plain(value):
    # … and with an exponent where that is shorter: one digit before five zeros.
    return f"regexp_replace(regexp_replace(CAST({value} AS VARCHAR), '\\.0$', ''), '^([1-9])00000$', '\\1e+05')"


RECORDS = f"""records AS (
  SELECT c_custkey, c_name, CASE WHEN c_acctbal > 0 THEN {plain('round(c_acctbal, 1)')} ELSE 'nan' END AS balance,
         c_acctbal > 0 AS finite, n_name, n_regionkey, c_nationkey
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@check("to_json", f"""
WITH {RECORDS} SELECT c_custkey, '{{"name": "' || c_name || '", "balance": ' ||
  CASE WHEN finite THEN balance ELSE '"nan"' END || ', "nation": {{"n_name": "' || n_name || '", "n_regionkey": ' || n_regionkey ||
  '}}, "keys": [' || c_nationkey || ', ' || n_regionkey || ']}}' AS json FROM records""")
def _(spark, d):
    return rendering.to_json(records(spark, d), "s").select("c_custkey", "json")


@check("to_json_text", r"""
SELECT conv_id, turn, '{"role": "' || role || '", "text": "' ||
  replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '"}' AS json
FROM conversations""")
def _(spark, d):
    talk = scan(spark, d, "conversations", ["conv_id", "turn", "role", "text"])
    return rendering.to_json(talk.select("conv_id", "turn", F.struct("role", "text").alias("s")), "s").drop("s")


@check("fields", f"""
WITH {RECORDS} SELECT c_custkey, 'name' AS name, 'string' AS type, c_name AS value FROM records
UNION ALL SELECT c_custkey, 'balance', 'double', balance FROM records
UNION ALL SELECT c_custkey, 'nation', 'struct<n_name:string,n_regionkey:int>', '{{n_name=' || n_name || ', n_regionkey=' || n_regionkey || '}}' FROM records
UNION ALL SELECT c_custkey, 'keys', 'array<int>', '[' || c_nationkey || ', ' || n_regionkey || ']' FROM records""")
def _(spark, d):
    return rendering.fields(records(spark, d), "s")


@check("fields_json", f"""
WITH {RECORDS} SELECT c_custkey, 'name' AS name, 'string' AS type, c_name AS value, '"' || c_name || '"' AS json FROM records
UNION ALL SELECT c_custkey, 'balance', 'double', balance, CASE WHEN finite THEN balance ELSE '"nan"' END FROM records
UNION ALL SELECT c_custkey, 'nation', 'struct<n_name:string,n_regionkey:int>', '{{n_name=' || n_name || ', n_regionkey=' || n_regionkey || '}}',
  '{{"n_name": "' || n_name || '", "n_regionkey": ' || n_regionkey || '}}' FROM records
UNION ALL SELECT c_custkey, 'keys', 'array<int>', '[' || c_nationkey || ', ' || n_regionkey || ']', '[' || c_nationkey || ', ' || n_regionkey || ']' FROM records""")
def _(spark, d):
    return rendering.fields(records(spark, d), "s", json=True)


@check("to_json_names", """
SELECT o_orderkey, '{"total \\"gross\\"": ' || o_custkey || ', "a\\\\b": {"tab\\there": "' || o_orderstatus || '"}}' AS json FROM orders""")
def _(spark, d):
    """Member names that JSON has to escape."""
    orders = scan(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderstatus"])
    inner = F.struct(F.col("o_orderstatus").alias("tab\there"))
    named = F.struct(F.col("o_custkey").alias('total "gross"'), inner.alias("a\\b"))
    return rendering.to_json(orders.select("o_orderkey", named.alias("s")), "s").drop("s")


@check("element_text", f"""
WITH {RECORDS} SELECT c_custkey, '{{name=' || c_name || ', balance=' || balance || ', nation={{n_name=' || n_name || ', n_regionkey=' ||
  n_regionkey || '}}, keys=[' || c_nationkey || ', ' || n_regionkey || ']}}' AS "text" FROM records""")
def _(spark, d):
    return rendering.element_text(records(spark, d), "s").select("c_custkey", "text")


@check("format_shortest", f"SELECT event_id AS i0, value * 1000 AS v, {plain('value * 1000')} AS \"text\" FROM events")
def _(spark, d):
    return rendering.format_floats(elementwise.multiply(events(spark, d), 1000))


@check("format_fixed", f"WITH {CELLS} SELECT i0, i1, v, printf('%.3f', v) AS \"text\" FROM cells")
def _(spark, d):
    return rendering.format_floats(embeddings(spark, d), "fixed", 3)


@check("format_scientific", f"""
WITH {CELLS} SELECT i0, i1, CASE WHEN v < 0 THEN 'nan'::DOUBLE ELSE sqrt(v) END AS v,
  CASE WHEN v < 0 THEN 'nan' ELSE printf('%.6e', sqrt(v)) END AS "text" FROM cells""")
def _(spark, d):
    return rendering.format_floats(elementwise.sqrt(embeddings(spark, d)), "scientific")


@check("format_whole", "SELECT p_partkey AS i0, p_size::DOUBLE AS v, CAST(p_size AS VARCHAR) AS \"text\" FROM part")
def _(spark, d):
    return rendering.format_floats(part_sizes(spark, d), "fixed", 3)


@check("text_list", f"""
WITH {CUBE} SELECT (i0 * 10 + i1) * 4 + i2 AS "at", '[' || i0 || ',' || i1 || ',' || i2 || ']' AS label, {plain('v')} AS "text",
  CAST(length({plain('v')}) AS INTEGER) AS length FROM cube""")
def _(spark, d):
    return rendering.text_list(cube(spark, d))


@check("widest_cell", f"""
WITH {CELLS} SELECT i1 AS col, CAST(max(length(printf('%.9f', v))) AS INTEGER) AS widest FROM cells
WHERE i0 BETWEEN 20 AND 419 AND i1 BETWEEN 4 AND 60 GROUP BY 1""")
def _(spark, d):
    from cellfold.functions.text import format_float

    grid = grids.grid(embeddings(spark, d))
    return rendering.widest_cell(grid, 20, 400, 4, 57, format_float(F.col("v"), "fixed", 9))
