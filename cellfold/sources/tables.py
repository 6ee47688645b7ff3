"""Opening datasets: tables, row positions, array axes, windows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellfold.model import ArgumentError, Box, Cells, axis_name, inside, require_number
from cellfold.runtime import BLOCK, bounded, same_keys, written


def scan(spark: SparkSession, folder: str, table: str, columns: list[str]) -> DataFrame:
    """Open a table and read only the columns asked for."""
    df = spark.read.parquet(f"{folder}/{table}.parquet")
    unknown = [c for c in columns if c.split(".")[0] not in df.columns]
    if unknown:
        raise ArgumentError(f"{table} has no {', '.join(unknown)}; it has {', '.join(df.columns)}")
    return df.select(*columns)


def row_count(df: DataFrame) -> int:
    """Number of rows; for a bare table this is read from the file footers."""
    return df.count()


def _ordered_blocks(df: DataFrame, order_by: list[str | Column]) -> DataFrame:
    """``df`` in global order, with ``_block`` and ``_row`` (position in the block).

    One range shuffle.  The numbers come from the partition a row was sorted in,
    so the frame is written out: a task run again must find the same numbers.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in order_by]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    numbered = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    # monotonically_increasing_id puts the partition above bit 33.
    return numbered.select(
        *df.columns,
        F.shiftright("_at", 33).alias("_block"),
        F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"),
    )


# Blocks that an order is cut into at most, and at least where there is enough; sampled rows for each cut.
MOST_BLOCKS, FEWEST_BLOCKS, SAMPLED = 1 << 16, 8, 8


def _cut_in_blocks(df: DataFrame, keys: list[Column], rows: int = BLOCK) -> tuple[DataFrame, int]:
    """``df`` with ``_block``, the range of the order a row falls in, and how many there are.

    The cuts come from a sample that hashes of the keys choose, so they are the same
    whenever a task runs, and nothing has to be written down.  Blocks of about ``rows``
    rows, of which a task numbers each by itself; only with more than ``MOST_BLOCKS`` times
    as many rows do they grow.
    """
    count = df.count()
    # A few blocks for a small table as well: tasks work side by side.
    blocks = max(1, min(MOST_BLOCKS, max(-(-count // rows), min(FEWEST_BLOCKS, count // 128))))
    if blocks == 1:
        return df.withColumn("_block", F.lit(0)), 1
    every = max(1, count // (blocks * SAMPLED))
    key = F.struct(*[k.alias(f"k{n}") for n, k in enumerate(keys)])
    chosen = F.pmod(F.xxhash64(*keys), F.lit(every)) == 0
    sample = df.where(chosen).select(key.alias("key")).distinct().orderBy("key").toArrow()
    step = max(1, sample.num_rows // blocks)
    cuts = sample.take(list(range(step, sample.num_rows, step))[:blocks - 1])
    if not cuts.num_rows:
        return df.withColumn("_block", F.lit(0)), 1
    listed = pa.ListArray.from_arrays(pa.array([0, cuts.num_rows], pa.int32()), cuts.column("key").combine_chunks())
    shape = df.select(F.array(key).alias("bounds")).schema
    bounds = df.sparkSession.createDataFrame(pa.table({"bounds": listed}), shape).scalar()
    # Halving the bounds: how many of them are not above the row's key.
    out = df.withColumns({"_bounds": bounds, "_key": key, "_block": F.lit(0)})
    width = 1 << (cuts.num_rows.bit_length() - 1)
    while width:
        bound = F.get("_bounds", F.col("_block") + (width - 1))
        out = out.withColumn("_block", F.col("_block") + F.when(F.coalesce(bound <= F.col("_key"), F.lit(False)), width).otherwise(0))
        width //= 2
    return out.drop("_bounds", "_key"), cuts.num_rows + 1


def _whole_order(df: DataFrame, order_by: list[str]) -> list[Column]:
    """The order's keys, and a hash of the rest of the row to part what they don't: a key
    that many rows share is cut into several blocks as well."""
    rest = [c for c in df.columns if c not in order_by]
    return [*map(F.col, order_by), *([F.xxhash64(*rest)] if rest else [])]


def element_positions(df: DataFrame, order_by: list[str], name: str = "pos", rows: int = BLOCK) -> DataFrame:
    """Row-major element position of every row of an ordered table.

    Needs no global window and no table: the position is the row's place in its
    block of the order plus the rows of the blocks before.  Rows the keys do not tell
    apart come in the order of a hash of the whole row.
    """
    keys = _whole_order(df, order_by)
    cut, blocks = _cut_in_blocks(df, keys, rows)
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(*keys)).cast("bigint") - 1
    numbered = cut.withColumn("_row", inside)
    if blocks == 1:
        return numbered.select(*df.columns, F.col("_row").alias(name))
    # One row per block, which the driver adds up.
    sizes = dict(cut.groupBy("_block").count().collect())
    starts, start = [], 0
    for block in range(blocks):
        starts.append((block, start))
        start += sizes.get(block, 0)
    table = df.sparkSession.createDataFrame(starts, "_block int, _start bigint")
    return numbered.join(bounded(table, blocks), "_block").select(*df.columns, (F.col("_start") + F.col("_row")).alias(name))


def series_positions(df: DataFrame, series: str, order_by: list[str], rows: int = BLOCK) -> DataFrame:
    """A line frame: position of every row within its series.

    Works on blocks of the order by (series, order), so a series holding most of
    the rows is still spread over many tasks.
    """
    keys = _whole_order(df, [series, *order_by])
    cut, blocks = _cut_in_blocks(df, keys, rows)
    inside = F.row_number().over(Window.partitionBy("_block", series).orderBy(*keys)).cast("bigint") - 1
    numbered = cut.withColumn("_row", inside)
    if blocks == 1:
        return numbered.select(*df.columns, F.col("_row").alias("pos"))
    # A series in several blocks ends or begins at a cut, so there are two rows a cut at most.
    parts = cut.groupBy(series, "_block").count()
    spread = parts.withColumn("_all", F.count("*").over(Window.partitionBy(series))).where("_all > 1").orderBy("_block").drop("_all")
    starts, before = [], {}
    for key, block, count in spread.collect():
        starts.append((key, block, before.get(key, 0)))
        before[key] = before.get(key, 0) + count
    table = df.sparkSession.createDataFrame(starts, spread.drop("count").schema.add("_start", "long"))
    return same_keys(numbered, bounded(table, len(starts)), [series, "_block"], "left").select(
        *df.columns, (F.coalesce("_start", F.lit(0)) + F.col("_row")).alias("pos"))


def array_cells(df: DataFrame, keys: list[str], array_col: str, shape=None) -> Cells:
    """Fixed-length array elements become one more axis after ``keys``.

    ``shape`` holds the extents of the keys and, last, the array's length; when
    it is not given it is looked up in one aggregate.
    """
    require_number(df.schema[array_col].dataType.elementType, array_col)
    if shape is None:
        tops = [F.coalesce(F.max(k) + 1, F.lit(0)).alias(f"n{a}") for a, k in enumerate(keys)]
        shape = (*df.agg(*tops).first(), array_length(df, array_col)) if keys else (array_length(df, array_col),)
    if len(shape) != len(keys) + 1:
        raise ArgumentError(f"{len(keys)} keys and an array are rank {len(keys) + 1}")
    axes = [F.col(k).cast("bigint").alias(axis_name(a)) for a, k in enumerate(keys)]
    keyed, names = df.select(*axes, F.col(array_col).alias("_a")), [axis_name(a) for a in range(len(keys))]
    whole = isinstance(df.schema[array_col].dataType.elementType, T.IntegralType)

    def rows(box: Box) -> DataFrame:
        opened = opened_axis(inside(keyed, names, box, shape), names, box[-1])
        return opened.withColumn("v", F.coalesce(F.col("v").cast("double"), F.lit(float("nan"))))

    return Cells(rows(tuple(map(range, shape))), tuple(shape), whole, rows=rows)


def opened_axis(df: DataFrame, names: list[str], at: range | tuple[int, ...]) -> DataFrame:
    """The array ``_a`` of ``[*names, _a]`` opened into one more axis and ``v``: only the
    places asked for, and each of them, also where a row's array is null or short."""
    last = axis_name(len(names))
    if len(at) == 1:
        return df.select(*names, F.lit(at[0]).cast("bigint").alias(last), F.get("_a", F.lit(at[0])).alias("v"))
    opened = df.select(*names, F.explode(places(at)).alias(last), "_a")
    return opened.select(*names, last, F.get("_a", F.col(last).cast("int")).alias("v"))


def places(at: range | tuple[int, ...]) -> Column:
    """Positions as an array."""
    if not len(at):
        return F.array().cast("array<bigint>")
    if isinstance(at, range):
        return F.sequence(*[F.lit(k).cast("bigint") for k in (at[0], at[-1], at.step)])
    return F.array(*[F.lit(k).cast("bigint") for k in at])


def array_length(df: DataFrame, array_col: str) -> int:
    """The one length every array in a column has."""
    found = df.agg(F.min(F.size(array_col)).alias("lo"), F.max(F.size(array_col)).alias("hi")).first()
    if found.lo != found.hi:
        raise ArgumentError(f"{array_col} holds lists of {found.lo} to {found.hi} elements, not arrays")
    return found.hi


def window(cells: Cells, offset: list[int], count: list[int]) -> DataFrame:
    """A rectangular block, clamped to the dataset; positions stay the dataset's."""
    if len(offset) != cells.rank or len(count) != cells.rank:
        raise ArgumentError(f"an offset and a count are needed for each of {cells.rank} axes")
    if any(o < 0 or c < 0 for o, c in zip(offset, count)):
        raise ArgumentError("offsets and counts are not negative")
    ends = [(start, min(start + span, extent)) for start, span, extent in zip(offset, count, cells.shape)]
    out = cells.within(tuple(range(*e) for e in ends)).df
    for axis, (start, span, extent) in enumerate(zip(offset, count, cells.shape)):
        stop = min(start + span, extent)
        position = F.col(axis_name(axis))
        out = out.where((position >= start) & (position < stop))
    return out
