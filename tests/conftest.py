import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cellfold import Cells


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("cellfold-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


def cells_from(spark, array, integer=False) -> Cells:
    array = np.asarray(array, dtype="float64")
    axes = np.indices(array.shape).reshape(array.ndim, array.size)
    columns = {f"i{k}": pa.array(axis, pa.int64()) for k, axis in enumerate(axes)}
    columns["v"] = pa.array(array.reshape(-1))
    return Cells(spark.createDataFrame(pa.table(columns)), array.shape, integer)


def lines_from(spark, **series):
    names, positions, values = [], [], []
    for name, line in series.items():
        names += [name] * len(line)
        positions += range(len(line))
        values += list(map(float, line))
    return spark.createDataFrame(pa.table({
        "series": pa.array(names, pa.string()),
        "pos": pa.array(positions, pa.int64()),
        "v": pa.array(values, pa.float64()),
    }))


def packed(cells, case):
    """One shape for every rank, so many cases can be collected in one job."""
    axes = F.array(*[F.col(a) for a in cells.axes]) if cells.rank else F.array().cast("array<bigint>")
    return cells.df.select(F.lit(case).alias("case"), axes.cast("array<bigint>").alias("at"),
                           F.col("v").cast("double").alias("v"))


def collect_cases(cases, batch=30):
    """{case: Cells} -> {case: ndarray}, a few jobs for all of them."""
    out, names = {}, list(cases)
    for start in range(0, len(names), batch):
        part = names[start:start + batch]
        frame = None
        for name in part:
            one = packed(cases[name], name)
            frame = one if frame is None else frame.unionByName(one)
        for name in part:
            out[name] = np.full(cases[name].shape, 9e99)
        filled = dict.fromkeys(part, 0)
        for row in frame.collect():
            out[row.case][tuple(row["at"])] = row.v
            filled[row.case] += 1
        for name in part:
            assert filled[name] == cases[name].size, (name, filled[name], cases[name].shape)
    return out


def to_numpy(cells):
    return collect_cases({"only": cells})["only"]
