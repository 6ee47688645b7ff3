"""The plans are the ones that hold on a cluster."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellfold.checks import inputs
from cellfold.operators import elementwise, folds, members, ordering, rearranging, running, selecting, summaries
from cellfold.runtime import BROADCAST_ROWS, bounded, shared_folder, small_side
from cellfold.sources import tables


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def exchanges(text):
    return re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition)", text)


@pytest.mark.parametrize("make", [
    lambda s, d: tables.element_positions(tables.scan(s, d, "events", ["event_id", "value"]), ["event_id"]),
    lambda s, d: running.cumsum(inputs.embeddings(s, d), 1).df,
    lambda s, d: running.diff(inputs.events(s, d), 1, block=100).df,
    lambda s, d: summaries.envelope(inputs.event_line(s, d)[0], buckets=100, length=1000, seam=True, series_count=1),
    lambda s, d: summaries.pyramid(inputs.event_line(s, d)[0], 8, 1000, series_count=1, small=20),
])
def test_no_single_partition(spark, data, make):
    assert "SinglePartition" not in plan(make(spark, data))


def test_blocks_of_a_flat_running_sum(spark, data):
    """Only the table of block totals may meet in one task."""
    text = plan(running.cumsum(inputs.events(spark, data), block=100).df)
    single = [line for line in text.splitlines() if "SinglePartition" in line]
    assert len(single) <= 1


def test_rearranging_and_elementwise_do_not_shuffle(spark, data):
    cells = inputs.embeddings(spark, data)
    for moved in (rearranging.transpose(cells), rearranging.reshape(cells, (-1, 8)), elementwise.clip(cells, 0, 1),
                  selecting.slice(cells, slice(3, 90, 2)), elementwise.normalize(cells)):
        body = plan(moved.df).split("Subqueries")[0]
        assert not exchanges(body.split("Subquery")[0]), body


def test_slices_reach_the_scan(spark, data):
    df = tables.scan(spark, data, "events", ["event_id", "value"])
    cells = inputs.cells_of(df, ["event_id"], "value", (1000,))
    text = plan(selecting.slice(cells, slice(100, 200)).df)
    assert "GreaterThanOrEqual(event_id,100)" in text and "LessThanOrEqual(event_id,199)" in text
    assert "ReadSchema: struct<event_id:bigint,value:double>" in text


def test_members_read_only_their_field(spark, tmp_path):
    nested = spark.range(5).select("id", F.struct(F.lit(1.0).alias("a"), F.struct(F.lit("x").alias("b"), F.lit(2).alias("c")).alias("n")).alias("s"))
    path = str(tmp_path / "nested")
    nested.write.parquet(path)
    text = plan(members.select_member(spark.read.parquet(path), "s.n.c", ["id"], (5,)).df)
    assert "ReadSchema: struct<id:bigint,s:struct<n:struct<c:int>>>" in text


def test_folds_are_partial_hash_aggregates(spark, data):
    for fold in (folds.min, folds.max, folds.sum, folds.prod):
        text = plan(fold(inputs.embeddings(spark, data), 0).df)
        assert text.count("HashAggregate") == 2 and "SortAggregate" not in text
    known = summaries.envelope(inputs.event_line(spark, data)[0], buckets=100, length=1000)
    assert "Exchange hashpartitioning" in plan(known)


def test_running_folds_read_what_they_run_over_once(spark, data):
    """Block totals and ends come from the rows already shuffled."""
    for run in (running.cumsum(inputs.events(spark, data), block=100), running.cumprod(inputs.events(spark, data))):
        run.df.toArrow()
        text = run.df._jdf.queryExecution().executedPlan().toString()
        assert "ReusedExchange" in text
        lines = text.splitlines()
        for at in [k for k, line in enumerate(lines) if "FileScan" in line]:
            above = next(k for k in range(at, 0, -1) if "Exchange hashpartitioning" in lines[k])
            # The same exchange for every use: nothing is aggregated on its own from the scan.
            assert not any("Aggregate" in line for line in lines[above:at])


def test_diff_shuffles_once(spark, data):
    assert exchanges(plan(running.diff(inputs.embeddings(spark, data), 3).df)) == ["hashpartitioning"]


def test_broadcasts_are_bounded(spark):
    small = spark.range(10)
    assert "ResolvedHint" in bounded(small, 10)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in bounded(small, BROADCAST_ROWS + 1)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in small_side(small, 10)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in small_side(small, 9)._jdf.queryExecution().analyzed().toString()


def test_shared_folder_is_the_clusters(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


class Session:
    """A session in which no shared folder is named."""

    def __init__(self, master):
        self.conf = type("Conf", (), {"get": lambda self, key, default=None: default})()
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-1"})()


def test_a_cluster_has_to_name_its_folder():
    assert shared_folder(Session("local[4]")) == shared_folder(Session("local[4]"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session("yarn"))


def test_sort_order_in_blocks(spark, data):
    text = plan(ordering.sort_order(inputs.event_base(spark, data), block=100))
    assert exchanges(text)[-1] == "hashpartitioning"


def test_selections_go_back_through_reshapes(spark, data):
    """A selection of what is shown is a range of what is stored, in the scan."""
    cube = inputs.cube(spark, data)
    text = plan(selecting.slice(cube, slice(3, 4)).df)
    assert "GreaterThanOrEqual(event_id,120)" in text and "LessThanOrEqual(event_id,159)" in text
    text = plan(selecting.pin(selecting.slice(cube, slice(5, 20)), 0, 2).df)
    assert "GreaterThanOrEqual(event_id,280)" in text and "LessThanOrEqual(event_id,319)" in text
    text = plan(selecting.slice(cube, 7, 3, slice(1, 3)).df)
    assert "GreaterThanOrEqual(event_id,293)" in text and "LessThanOrEqual(event_id,294)" in text
    turned = rearranging.transpose(elementwise.abs(rearranging.reshape(cube, (-1, 5, 8))))
    text = plan(selecting.line(turned, 0, slice(None), 6))
    assert "GreaterThanOrEqual(event_id,240)" in text and "LessThanOrEqual(event_id,275)" in text


@pytest.mark.parametrize("subs, opened", [
    ((slice(None), slice(8, 56, 5)), [8, 13, 18, 23, 28, 33, 38, 43, 48, 53]),
    ((slice(None), [3, 0, slice(10, 20, 3), 3, -1]), [0, 3, 10, 13, 16, 19, 63]),
    ((slice(None), slice(None, None, -21)), [0, 21, 42, 63]),
])
def test_arrays_are_opened_where_asked(spark, data, monkeypatch, subs, opened):
    asked, places = [], tables.places
    monkeypatch.setattr(tables, "places", lambda at: asked.append(list(at)) or places(at))
    df = tables.scan(spark, data, "embeddings", ["vec_id", "embedding"]).select("vec_id", F.struct("embedding").alias("s"))
    for cells in (inputs.embeddings(spark, data), members.select_member(df, "s.embedding", ["vec_id"], (500,), (64,))):
        text = plan(selecting.slice(cells, *subs).df)
        assert asked[-1] == opened and text.count("Generate explode") == 1
        one = plan(selecting.slice(cells, slice(10, 20), 5).df)
        assert "Generate" not in one and "embedding#" in one and "GreaterThanOrEqual(vec_id,10)" in one


@pytest.mark.parametrize("marked", [1 << 20, 10])
def test_lists_are_counted_without_overlaps_of_overlaps(monkeypatch, marked):
    monkeypatch.setattr(selecting, "MARKED", marked)
    rng = np.random.default_rng(5)
    for _ in range(300):
        terms = [range(int(a), int(a + n), int(s)) for a, n, s in zip(rng.integers(0, 60, 9), rng.integers(1, 80, 9), rng.integers(1, 9, 9))]
        terms += [t[::-1] for t in terms[:3]]
        assert selecting._list_count(terms) == len({k for t in terms for k in t})


def test_many_overlapping_runs_are_counted_at_once():
    start = time.perf_counter()
    many = [range(k, 10**12 + 7 * k, 1 + k % 6) for k in range(64)]
    assert 10**12 < selecting._list_count(many) < 10**12 + 64 * 7
    primes = [range(0, 10**9, p) for p in (10007, 10009, 10037)]
    pairs = [range(0, 10**9, a.step * b.step) for a, b in ((primes[0], primes[1]), (primes[0], primes[2]), (primes[1], primes[2]))]
    assert selecting._list_count(primes) == sum(map(len, primes)) - sum(map(len, pairs)) + 1
    assert time.perf_counter() - start < 1


def test_positions_write_nothing(spark, data, monkeypatch):
    """Blocks of the order come from a sample; nothing is written, no task numbers it all."""
    monkeypatch.setattr(tables, "written", lambda *given: pytest.fail("a table is written"))
    rng = np.random.default_rng(3)
    rows = [(["a", "b", "c", None][rng.choice(4, p=[0.7, 0.1, 0.1, 0.1])], [None, 1.0, 2.0, float("nan")][rng.integers(4)],
             int(rng.integers(6)), str(k % 7)) for k in range(2000)]
    df = spark.createDataFrame(rows, "s string, x double, k int, t string").repartition(5)
    placed = tables.element_positions(df, ["x", "k"], rows=50)
    assert "SinglePartition" not in plan(placed)
    got = [(r.x, r.k) for r in placed.orderBy("pos").collect()]
    assert str(got) == str([(r.x, r.k) for r in df.orderBy("x", "k").collect()])
    assert sorted(r.pos for r in placed.collect()) == list(range(2000))
    by_series = tables.series_positions(df, "s", ["x", "k"], rows=50).collect()
    for name in ("a", "b", "c", None):
        mine = sorted((r.pos, r.x, r.k) for r in by_series if r.s == name)
        want = df.where(F.col("s").eqNullSafe(F.lit(name))).orderBy("x", "k").collect()
        assert str(mine) == str([(n, r.x, r.k) for n, r in enumerate(want)])
    # One key in every row is still cut, by the rest of the row.
    same = tables.element_positions(df.withColumn("x", F.lit(1.0)).withColumn("t", F.monotonically_increasing_id()), ["x"], rows=50)
    assert "_block" in plan(same) and sorted(r.pos for r in same.collect()) == list(range(2000))
