"""Array operations against numpy: shape, values and refusals."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellfold import ArgumentError, checks
from cellfold.operators import elementwise as ew
from cellfold.operators import folds, rearranging, running, selecting
from conftest import cells_from, collect_cases, to_numpy

SHAPES = [(), (1,), (5,), (0,), (4, 3), (0, 3), (3, 0), (2, 3, 4), (2, 1, 3, 2)]


def payload(shape, special=True):
    size = int(np.prod(shape, dtype=int))
    flat = np.arange(size, dtype=float) - size // 3
    if special:
        for at, value in zip((2, 3, 4, 5), (np.nan, np.inf, -np.inf, -0.0)):
            if at < size:
                flat[at] = value
    return flat.reshape(shape)


def run_cases(spark, cases):
    """cases: name -> (array, ours(cells), numpy(array))."""
    ours, expected = {}, {}
    for name, (array, op, golden) in cases.items():
        cells = cells_from(spark, array)
        try:
            with np.errstate(all="ignore"):
                want = np.asarray(golden(array), dtype=float)
        except Exception:
            with pytest.raises(ArgumentError):
                op(cells)
            continue
        got = op(cells)
        assert tuple(got.shape) == want.shape, name
        ours[name], expected[name] = got, want
    for name, got in collect_cases(ours).items():
        np.testing.assert_allclose(got, expected[name], rtol=1e-12, err_msg=name)


AXES = [None, 0, -1, 1, (0, 1), (0, 0), 5, -9, (1, -1)]


@pytest.mark.parametrize("name", ["min", "max", "sum", "prod"])
def test_folds(spark, name):
    cases = {}
    for shape in SHAPES:
        for special in (True, False):
            array = payload(shape, special)
            for axis in AXES:
                cases[f"{name}{shape}{axis}{special}"] = (
                    array,
                    lambda c, axis=axis: getattr(folds, name)(c, axis),
                    lambda a, axis=axis: getattr(np, name)(a, axis=axis),
                )
    for axis in (None, 0):
        if name in ("sum", "prod"):
            cases[f"{name}initial{axis}"] = (
                payload((4, 3), False),
                lambda c, axis=axis: getattr(folds, name)(c, axis, initial=2.5),
                lambda a, axis=axis: getattr(np, name)(a, axis=axis, initial=2.5),
            )
            cases[f"{name}initialempty{axis}"] = (
                payload((0, 3)),
                lambda c, axis=axis: getattr(folds, name)(c, axis, initial=2.5),
                lambda a, axis=axis: getattr(np, name)(a, axis=axis, initial=2.5),
            )
    run_cases(spark, cases)


@pytest.mark.parametrize("name", ["cumsum", "cumprod"])
def test_scans(spark, name):
    cases = {}
    for shape in SHAPES:
        for special in (True, False):
            array = payload(shape, special)
            for axis in (None, 0, 1, -1, 7):
                cases[f"{name}{shape}{axis}{special}"] = (
                    array,
                    lambda c, axis=axis: getattr(running, name)(c, axis),
                    lambda a, axis=axis: getattr(np, name)(a, axis=axis),
                )
    run_cases(spark, cases)


def test_scans_in_blocks(spark):
    """Blocks of three positions, blocks of blocks included."""
    rng = np.random.default_rng(1)
    array = rng.normal(size=(2, 31))
    array[0, 7], array[1, 20] = np.nan, np.inf
    cases = {}
    for axis in (None, 0, 1):
        cases[f"cumsum{axis}"] = (array, lambda c, axis=axis: running.cumsum(c, axis, block=3),
                                  lambda a, axis=axis: np.cumsum(a, axis=axis))
    for n in (1, 2, 3, 5, 40):
        cases[f"diff{n}"] = (array, lambda c, n=n: running.diff(c, n, block=4), lambda a, n=n: np.diff(a, n))
    run_cases(spark, cases)


@pytest.mark.parametrize("case", ["mixed", "vanish", "grow", "late zero", "turn", "two lines"])
def test_cumprod_in_blocks(spark, case):
    """Lines longer than a block of mantissas, with results far off the scale."""
    n = 1400
    line = {
        "mixed": np.where(np.arange(n) % 2, 1.7, -1 / 1.7),
        "vanish": np.r_[np.full(1200, 0.5), np.full(200, 2.0)],
        "grow": np.r_[np.full(1200, -2.0), np.full(200, 0.5)],
        "late zero": np.r_[np.full(1100, 2.0), 0.0, np.full(299, 3.0)],
        "turn": np.r_[np.full(900, 2.0), np.full(500, 0.5)],
        "two lines": np.stack([np.full(n, 0.999), np.where(np.arange(n) == 700, np.nan, 1.001)]),
    }[case]
    run_cases(spark, {case: (line, lambda c: running.cumprod(c, -1, block=100),
                             lambda a: np.cumprod(a, axis=-1))})


def test_cumprod_has_one_path(spark):
    """Neither the length of an axis nor where it is cut changes a bit of what both hold."""
    line = np.random.default_rng(8).uniform(0.5, 1.99, 66_000)
    long = to_numpy(running.cumprod(cells_from(spark, line)))
    short = to_numpy(running.cumprod(cells_from(spark, line[:65_000])))
    assert (long[:65_000].view("int64") == short.view("int64")).all()
    assert (long[:512] == np.cumprod(line[:512])).all()
    np.testing.assert_allclose(long[:5000], np.cumprod(line[:5000]), rtol=1e-12)


def test_reproducible_sums(spark):
    """The same bits for every order of arrival, within a rounding of the exact sum."""
    rng = np.random.default_rng(9)
    line = np.concatenate([rng.normal(size=700) * 10.0 ** rng.integers(-300, 300, 700), [5e-324, -1e-310, 1.7e308, -1.7e308, 0.0]])
    cells = cells_from(spark, line)
    sums = {f"{k}": folds.sum(cells.of(cells.df.repartition(2 + k, F.rand(k)), cells.shape), reproducible=True) for k in range(20)}
    found = {float(v) for v in collect_cases(sums).values()}
    assert len(found) == 1 and found.pop() == pytest.approx(math.fsum(line), rel=1e-15)
    rows = rng.normal(size=(5, 300))
    rows[0, 3], rows[1, 4], rows[2, 5:7], rows[3] = np.inf, np.nan, (np.inf, -np.inf), 0
    for axis in (None, 0, 1):
        with np.errstate(invalid="ignore"):
            want = rows.sum(axis=axis, initial=2.0)
        np.testing.assert_allclose(to_numpy(folds.sum(cells_from(spark, rows), axis, 2.0, True)), want, rtol=1e-12)
    tiny = np.full(1000, 5e-324)
    assert to_numpy(folds.sum(cells_from(spark, tiny), reproducible=True)) == tiny.sum()
    assert to_numpy(folds.sum(cells_from(spark, np.zeros((0, 3))), reproducible=True)) == 0
    # What the addends come to in between does not count.
    assert to_numpy(folds.sum(cells_from(spark, [1.7e308, 1.0, 1.7e308, -1.7e308, -1.7e308]), reproducible=True)) == 1


def test_prod_far_from_one(spark):
    big = np.r_[np.full(1100, 2.0), np.full(1100, 0.5), [3.0]]
    got = collect_cases({"back": folds.prod(cells_from(spark, big)),
                         "over": folds.prod(cells_from(spark, np.full(1100, -2.0))),
                         "under": folds.prod(cells_from(spark, np.full(1200, 0.5)))})
    assert got["back"] == pytest.approx(3.0, rel=1e-9)
    assert got["over"] == np.inf and got["under"] == 0.0


def test_diff(spark):
    cases = {}
    for shape in SHAPES:
        array = payload(shape)
        for n, axis in ((0, -1), (1, -1), (2, -1), (1, 0), (3, 0), (-1, -1), (1, 9), (0, 9)):
            cases[f"diff{shape}{n}{axis}"] = (
                array,
                lambda c, n=n, axis=axis: running.diff(c, n, axis),
                lambda a, n=n, axis=axis: np.diff(a, n=n, axis=axis),
            )
    run_cases(spark, cases)


def test_elementwise(spark):
    values = np.array([-3.5, -1.0, -0.0, 0.0, 0.25, 1.0, 2.0, 9.0, np.nan, np.inf, -np.inf, 1e308])
    cases = {
        "abs": (values, ew.abs, np.abs),
        "sqrt": (values, ew.sqrt, np.sqrt),
    }
    for e in (0, 1, 2, 3, -1, 0.5, -0.5, 1 / 3, np.inf, -np.inf, np.nan):
        golden = np.sqrt if e == 0.5 else (lambda a, e=e: np.power(a, float(e)))
        cases[f"pow{e}"] = (values, lambda c, e=e: ew.pow(c, e), golden)
    for k in (0, 1.5, -2, np.inf, np.nan):
        cases[f"add{k}"] = (values, lambda c, k=k: ew.add(c, k), lambda a, k=k: a + k)
        cases[f"mul{k}"] = (values, lambda c, k=k: ew.multiply(c, k), lambda a, k=k: a * k)
    for lo, hi in ((None, None), (0.0, None), (None, 1.0), (-1.0, 2.0), (3.0, -3.0), (np.nan, 1.0),
                   (None, np.nan), (-0.0, None), (None, -0.0), (-np.inf, np.inf)):
        golden = (lambda a: a) if lo is hi is None else (lambda a, lo=lo, hi=hi: np.clip(a, lo, hi))
        cases[f"clip{lo}{hi}"] = (values, lambda c, lo=lo, hi=hi: ew.clip(c, lo, hi), golden)
    run_cases(spark, cases)
    with pytest.raises(ArgumentError):
        ew.pow(cells_from(spark, values), None)


def test_normalize(spark):
    cases = {
        "plain": ew.normalize(cells_from(spark, [0.0, 1.0, 4.0, np.nan, np.inf])),
        "exact ends": ew.normalize(cells_from(spark, [0.1, 0.2, 0.7]), 0.1, 0.3),
        "flat": ew.normalize(cells_from(spark, [5.0, 5.0]), 2, 3),
        "nothing": ew.normalize(cells_from(spark, [np.nan, -np.inf])),
        "huge": ew.normalize(cells_from(spark, [-1e308, 0.0, 1e308])),
        "empty": ew.normalize(cells_from(spark, np.zeros((0,)))),
    }
    got = collect_cases(cases)
    np.testing.assert_array_equal(got["plain"], [0, 0.25, 1, np.nan, np.inf])
    assert got["exact ends"][0] == 0.1 and got["exact ends"][2] == 0.3
    np.testing.assert_array_equal(got["flat"], [2, 2])
    np.testing.assert_array_equal(got["nothing"], [np.nan, -np.inf])
    np.testing.assert_array_equal(got["huge"], [0, 0.5, 1])


def test_rearranging(spark):
    cases = {}
    for shape in SHAPES:
        array = payload(shape)
        for axes in (None, (0,), (1, 0), (2, 0, 1), (0, 0), (-1, 0), (0, 1, 2, 3), (3, 1, 0, 2)):
            cases[f"T{shape}{axes}"] = (array, lambda c, axes=axes: rearranging.transpose(c, axes),
                                        lambda a, axes=axes: np.transpose(a, axes))
        for to in ((-1,), (2, -1), (6, 2), (-1, -1), (3, 4), (0,), (0, -1), (2, 2, 3), (-2, 6), (1, 1)):
            cases[f"R{shape}{to}"] = (array, lambda c, to=to: rearranging.reshape(c, to),
                                      lambda a, to=to: golden_reshape(a, to))
    run_cases(spark, cases)


@pytest.mark.parametrize("vectors", [1, 5, 7])
def test_reshape_query_of_any_number_of_vectors(spark, tmp_path, vectors):
    """160 elements a row: 7 vectors fill two rows and 128 places of a third."""
    array = np.arange(vectors * 64.0).reshape(vectors, 64)
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(array)], "vec_id long, embedding array<double>").write.parquet(
        f"{tmp_path}/embeddings.parquet")
    got = checks.load()[0]["reshape"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(p // 160, p // 32 % 5, p % 32, float(p)) for p in range(vectors * 64)]


def test_reshape_that_does_not_come_out_even(spark):
    array = np.arange(10.0)
    with pytest.raises(ArgumentError):
        rearranging.reshape(cells_from(spark, array), (-1, 4))
    for to, shape in (((-1, 4), (3, 4)), ((4, -1), (4, 3)), ((-1, 5), (2, 5)), ((3, -1, 2), (3, 2, 2))):
        cells = rearranging.reshape(cells_from(spark, array), to, partial=True)
        assert cells.shape == shape
        want = [(*map(int, np.unravel_index(p, shape)), float(p)) for p in range(10)]
        assert sorted(map(tuple, cells.df.collect())) == want
        for box in itertools.product(*[[range(n), range(n - 1, n), range(n - 1)] for n in shape]):
            held = lambda row: all(k in places for k, places in zip(row, box))
            assert [r for r in sorted(map(tuple, cells.within(box).df.collect())) if held(r)] == list(filter(held, want))
    for to in ((0, -1), (-1, -1), (3, 4)):
        with pytest.raises(ArgumentError):
            rearranging.reshape(cells_from(spark, array), to, partial=True)


def golden_reshape(a, to):
    if any(n < -1 for n in to):
        raise ValueError
    return np.reshape(a, to)


def nonempty(a):
    if a.size == 0:
        raise ValueError("nothing selected")
    return a


S = slice
SUBSCRIPTS = [(), (0,), (-1,), (9,), (-9,), (S(None),), (S(1, None),), (S(None, None, -1),), (S(None, None, 2),),
              (S(3, 0, -2),), (S(-2, None),), (S(5, 2),), (S(0, 99),), (..., 0), (0, ...), (0, 1), (S(1, 3), 0),
              (..., ...), (S(None), S(None, None, -2)), (0, 0, 0, 0, 0), ([2, 0],), ([1],), (S(None), [1, 0]),
              (S(4, None, -3),), (S(None, None, 2**62),)]


def test_slices(spark):
    cases = {}
    for shape in SHAPES:
        array = payload(shape)
        for subs in SUBSCRIPTS:
            cases[f"S{shape}{subs}"] = (array, lambda c, subs=subs: selecting.slice(c, *subs),
                                        lambda a, subs=subs: nonempty(np.array(a[subs], copy=True)))
    run_cases(spark, cases)


def test_list_subscripts(spark):
    array = np.arange(12.0).reshape(6, 2)
    cells = cells_from(spark, array)
    got = collect_cases({
        "spans": selecting.slice(cells, [3, S(0, 4), 3, -1]),
        "reverse": selecting.slice(cells, [S(None, None, -1)], 1),
        "both": selecting.slice(cells, [1, 5], [1, 0]),
    })
    np.testing.assert_array_equal(got["spans"], array[[3, 0, 1, 2, 5]])
    np.testing.assert_array_equal(got["reverse"], array[::-1, 1])
    np.testing.assert_array_equal(got["both"], array[[1, 5]][:, [1, 0]])
    for bad in ([], [9], [S(3, 3)]):
        with pytest.raises(ArgumentError):
            selecting.slice(cells, bad)


def test_long_list_is_written_by_executors(spark, monkeypatch):
    monkeypatch.setattr(selecting, "BROADCAST_ROWS", 4)
    array = np.arange(20.0)
    got = selecting.slice(cells_from(spark, array), [S(10, 0, -2), S(0, 12), 19])
    want = list(dict.fromkeys([*range(10, 0, -2), *range(12), 19]))
    np.testing.assert_array_equal(collect_cases({"x": got})["x"], array[want])


def test_lists_are_counted():
    """What a list of spans names is counted without listing it."""
    import random

    from cellfold.operators import selecting

    rng = random.Random(1)
    for _ in range(300):
        extent = rng.randint(1, 40)
        subs = [rng.choice([rng.randrange(extent), slice(rng.randrange(extent), None, rng.choice([1, 2, 3, 5])),
                            slice(None, rng.randint(0, extent), rng.choice([1, 2, 4])), slice(None, None, -rng.randint(1, 4))])
                for _ in range(rng.randint(1, 5))]
        want = {i for s in subs for i in (range(extent)[s] if isinstance(s, slice) else [s])}
        if want:
            assert selecting.sliced_shape((extent,), [subs]) == (len(want),)
    big = 10**12
    assert selecting.sliced_shape((big,), [[slice(0, big, 2), slice(0, big, 3), slice(5, 6)]]) == (big // 2 + -(-big // 3) - -(-big // 6) + 1,)


def test_short_and_null_arrays(spark):
    """Every place of the axis is a cell, missing where a row's array does not reach."""
    from cellfold.sources.tables import array_cells

    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [5.0])], "k long, a array<double>")
    cells = array_cells(df, ["k"], "a", (3, 2))
    nan = float("nan")
    assert np.array_equal(to_numpy(cells), [[1, 2], [nan, nan], [5, nan]], equal_nan=True)
    whole = array_cells(spark.createDataFrame([(0, [1, 2])], "k long, a array<int>"), ["k"], "a", (1, 2))
    assert whole.integer
