"""Session-level decisions: shared folder, size-checked broadcasts, block size."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when it is known to hold no more rows than this.
BROADCAST_ROWS = 200_000
# One whose rows grow with the data also holds no more bytes than this.
BROADCAST_BYTES = 32 << 20

# Longest run of one line that a single window group may hold.
BLOCK = 65_536


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _temporary(spark.sparkContext.applicationId)


@functools.cache
def _temporary(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"cellfold-{application}-")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: evaluated once, re-read from then on.

    Used where a value must not change when a task is run again (partition
    numbers) and to cut the lineage of iterated joins.  Everything one
    application writes lies under one folder, which can go when it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cellfold-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` when its proven row bound allows, else leave the join to
    the planner (a shuffled join, split by AQE where a key is hot)."""
    return F.broadcast(df) if rows <= limit else df


def small_table(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a stored table, or a projection of one, where its rows allow it.

    They are counted first, which for a scan reads the files' footers; nothing is
    fetched to see whether it fits."""
    return bounded(df, df.count(), limit)


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` where the keys are the same, null being a key like any other."""
    renamed = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_same_{k}"))
    return left.join(renamed, match, how).drop(*[f"_same_{k}" for k in keys])


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS, width: Column | None = None) -> DataFrame:
    """Broadcast a table of unknown size after counting it up to the limit.

    An aggregate that fits is fetched once (at most ``limit`` rows) and handed
    back as a local table, so it is not computed again; one that does not is
    returned as it is.  Rows without a fixed width need ``width``, the bytes of a
    row: they are summed before anything is fetched.
    """
    if width is not None and (df.agg(F.sum(width)).first()[0] or 0) > BROADCAST_BYTES:
        return df
    head = df.limit(limit + 1).toArrow()
    if head.num_rows > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(head, df.schema))
