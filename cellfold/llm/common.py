"""What several text operators share: tables, samples that never change, components."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellfold.runtime import written

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def whole_texts(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, about to be handed to Python with whole texts: at most ``rows`` of them at a
    time, which bounds memory on both sides.  A smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    set_ = int(df.sparkSession.conf.get(name))
    if set_ <= 0 or set_ > rows:
        df.sparkSession.conf.set(name, str(rows))
    return df


def tidy() -> None:
    """Hand freed memory back to the system: workers are kept between tasks, and what they
    once needed would count against the executor for good."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidied(run):
    """``run`` over a partition's batches, tidied up after."""
    def to_the_end(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return to_the_end


def remainder(column: str, parts: int) -> Column:
    """crc32 of the value's text, modulo ``parts``; null for a null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def uniform(*columns: str | Column) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 31)) / float(1 << 31)


def word_count(text: str | Column) -> Column:
    """Number of words of a text; 0 for null.  A replacement leaves one mark for each
    word, so no list of words is built."""
    marks = F.length(F.regexp_replace(F.regexp_replace(text, WORD, "\u0001"), r"[\x20\x09-\x0D]+", ""))
    return F.coalesce(marks.cast("long"), F.lit(0).cast("long"))


def discard(*tables: DataFrame) -> None:
    """Delete tables ``written`` has made, once all that was read from them is written too."""
    for table in tables:
        folder = table.inputFiles()[0].rsplit("/", 1)[0]
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(table.sparkSession._jsc.sc().hadoopConfiguration()).delete(path, True)


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of every node that has a link: label is the smallest node reachable.

    ``links`` has two BIGINT columns ``a, b``.  Each round a node takes the smallest
    label among its neighbours and then its label's label, so long chains shorten by
    halves.  Rounds are tables in the shared folder: lost executors cost nothing, and
    every join has a plain exchange on both sides, which Spark splits where a node has
    very many links.
    """
    both = written(links.select("a", "b").where("a <> b").union(links.select("b", "a").where("a <> b")).distinct(), "links")
    state = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        heard = both.join(state.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("heard"))
        hooked = written(state.join(heard, "node", "left")
                         .select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label")), "hooked")
        over = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = written(hooked.join(over, "label", "left")
                         .select("node", "old", F.coalesce("next", "label").alias("label")), "jumped")
        state = jumped.select("node", "label")
        if jumped.where("label <> old").isEmpty():
            return state
