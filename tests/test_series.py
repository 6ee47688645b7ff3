"""Lines against brute force on small fixtures."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from cellfold import ArgumentError
from cellfold.operators import aligning, elementwise, folds, ordering, selecting, summaries
from conftest import cells_from, lines_from, to_numpy

RNG = np.random.default_rng(7)


def brute_envelope(values, width, seam=False):
    out = []
    for bucket, start in enumerate(range(0, len(values), width)):
        stop = min(start + width, len(values))
        found = [(v, p) for p, v in enumerate(values[start:stop], start) if math.isfinite(v)]
        if not found:
            out += [(bucket, 0, start, "nan"), (bucket, 1, start, "nan")]
            continue
        lo, hi = min(found), max(found, key=lambda e: (e[0], -e[1]))
        if seam and stop < len(values) and math.isfinite(values[stop - 1]) and math.isfinite(values[stop]):
            lo = (values[stop], stop) if values[stop] < lo[0] else lo
            hi = (values[stop], stop) if values[stop] > hi[0] else hi
        pair = [hi, lo] if hi[1] < lo[1] else [lo, hi]
        out += [(bucket, slot, p, v) for slot, (v, p) in enumerate(pair)]
    return out


def got_envelope(df):
    word = lambda v: "nan" if math.isnan(v) else v
    return sorted((r.bucket, r.slot, r.pos, word(r.v)) for r in df.collect())


def bumpy(n=203):
    values = RNG.integers(-4, 5, n).astype(float)  # many ties
    values[[3, 50, 51]] = np.nan
    values[100:120] = np.nan
    values[60], values[61] = np.inf, -np.inf
    return values


@pytest.mark.parametrize("seam", [False, True])
@pytest.mark.parametrize("width", [2, 5, 10, 300])
def test_envelope(spark, width, seam):
    values = bumpy()
    lines = lines_from(spark, a=values)
    want = brute_envelope(values, width, seam)
    known = summaries.envelope(lines, bucket=width, length=len(values), seam=seam, series_count=1)
    assert got_envelope(known) == want
    assert got_envelope(summaries.envelope(lines, bucket=width, seam=seam)) == want


def test_envelope_by_pairs_is_the_same(spark, monkeypatch):
    values = bumpy()
    lines = lines_from(spark, a=values, b=values[::-1])
    hashed = summaries.envelope(lines, bucket=7, seam=True)
    before = sorted(map(str, hashed.collect()))
    monkeypatch.setattr(summaries, "BROADCAST_ROWS", 3)
    assert sorted(map(str, summaries.envelope(lines, bucket=7, seam=True).collect())) == before


def test_envelope_of_lines_of_several_lengths(spark):
    long, short = bumpy(), np.array([1.0, np.inf, 3.0])
    rows = summaries.envelope(lines_from(spark, long=long, short=short), buckets=50).collect()
    assert [(r.pos, r.v) for r in sorted(rows, key=lambda r: r.pos) if r.series == "short"] == [(0, 1.0), (1, np.inf), (2, 3.0)]
    assert sorted((r.bucket, r.slot, r.pos) for r in rows if r.series == "long") == [e[:3] for e in brute_envelope(long, 5)]


def test_lone_outliers_are_in_the_summary(spark):
    """Single samples far out, anywhere in a noisy line of any length, as in the fold by hand."""
    rng = np.random.default_rng(31)
    length, buckets = int(rng.integers(5_000, 9_000)), int(rng.integers(40, 120))
    values = rng.normal(size=length).round(3)
    out = rng.choice(length, 12, replace=False)
    values[out] = rng.choice([-1, 1], 12) * rng.uniform(20, 90, 12).round(3)
    found = got_envelope(summaries.envelope(lines_from(spark, a=values), buckets=buckets, length=length, series_count=1))
    width = -(-length // buckets)
    assert found == brute_envelope(values, width)
    shown = {(pos, v) for _, _, pos, v in found}
    furthest = {max((k for k in out if k // width == b and np.sign(values[k]) == sign), key=lambda k: abs(values[k]), default=None)
                for b in set(out // width) for sign in (-1, 1)} - {None}
    assert furthest and all((k, values[k]) in shown for k in furthest)


def test_one_sample_buckets_are_the_samples(spark):
    values = bumpy()[:20]
    rows = summaries.envelope(lines_from(spark, a=values), buckets=64, length=20).collect()
    np.testing.assert_array_equal([r.v for r in sorted(rows, key=lambda r: r.pos)], values)


@pytest.mark.parametrize("factor", [1, 2, 3, 50])
def test_coarsen_equals_folding_the_samples(spark, factor):
    lines = lines_from(spark, a=bumpy())
    coarse = summaries.coarsen(summaries.envelope(lines, bucket=4), factor)
    assert got_envelope(coarse) == got_envelope(summaries.envelope(lines, bucket=4 * factor))


@pytest.mark.parametrize("small", [10, 200_000])
@pytest.mark.parametrize("base", [1, 3])
def test_pyramid(spark, base, small):
    values = bumpy()
    found = {}
    for row in summaries.pyramid(lines_from(spark, a=values), base, len(values) if base == 1 else None, small=small).collect():
        found.setdefault(row.width, []).append((row.bucket, row.slot, row.pos, "nan" if math.isnan(row.v) else row.v))
    widths = [base << k for k in range(20) if base << k < 2 * len(values)]
    assert sorted(found) == widths
    for width in widths[1 if base == 1 else 0:]:
        assert sorted(found[width]) == brute_envelope(values, width)


def test_closer_look(spark):
    values = bumpy()
    lines = lines_from(spark, a=values)
    for first, span, width in ((10, 40, 8), (7, 45, 6), (150, 500, 9), (-5, 20, 4)):
        start, stop = max(first, 0), min(first + span, len(values))
        run = values[start:stop]
        want = brute_envelope(run, width, True)
        if stop < len(values):  # one sample past the run closes the last seam
            tail = (len(run) - 1) // width * width
            last = brute_envelope(np.r_[run[tail:], values[stop]], len(run) - tail, True)[:2]
            want = [e for e in want if e[0] < tail // width] + [(tail // width, s, p + tail, v) for _, s, p, v in last]
        want = [(b, s, p + start, v) for b, s, p, v in want]
        assert got_envelope(summaries.closer_look(lines, first, span, width)) == want


def test_log_columns(spark):
    values = bumpy()
    points = elementwise.range_axis(lines_from(spark, a=values), -2, 0.5)
    lo, hi, n = 1.0, 80.0, 12
    rows = summaries.log_columns(points, lo, hi, n).collect()
    columns = {}
    for p, v in enumerate(values):
        x = -2 + p * 0.5
        if lo <= x <= hi:
            at = min(int(math.log(x / lo) / math.log(hi / lo) * n), n - 1)
            columns.setdefault(at, []).append((v, p))
    assert sorted({r.column for r in rows}) == sorted(columns)
    for row in rows:
        finite = [e for e in columns[row.column] if math.isfinite(e[0])]
        if finite:
            assert row.v in (min(finite)[0], max(finite)[0]) and row.x == -2 + row.pos * 0.5
        else:
            assert math.isnan(row.v)
    for bad in ((0, 5, 4), (1, 1.9, 4), (5, 1, 4), (1, math.inf, 4)):
        with pytest.raises(ArgumentError):
            summaries.log_columns(points, *bad)


def test_overlay(spark):
    a, b = lines_from(spark, a=[1, 2]), lines_from(spark, b=[3])
    rows = summaries.overlay({"line": a, "name": "/a"}, {"line": b, "name": "/b", "drawn": False},
                             {"line": b, "name": "/b", "alias": "bee"}).collect()
    assert sorted((r.series, r.label, r.pos, r.v) for r in rows) == [(0, "/a", 0, 1.0), (0, "/a", 1, 2.0), (2, "bee", 0, 3.0)]


# --- selection ----------------------------------------------------------------


def test_lines(spark):
    cells = cells_from(spark, np.arange(24.0).reshape(2, 3, 4))
    row = selecting.line(cells, 1, 2, series="x").collect()
    assert sorted((r.pos, r.v) for r in row) == [(0, 20.0), (1, 21.0), (2, 22.0), (3, 23.0)]
    with pytest.raises(ArgumentError, match="one element"):
        selecting.line(cells, 0, 0, 0)
    with pytest.raises(ArgumentError, match="3 x 4"):
        selecting.line(cells, 0)
    with pytest.raises(ArgumentError, match="confirm"):
        selecting.lines_of(cells, limit=5)
    assert selecting.lines_of(cells, limit=5, confirmed=True).where("series = 4").count() == 4
    assert selecting.lines_of(cells_from(spark, np.zeros((0, 3)))).count() == 0


def test_thin_and_runs(spark):
    rng = np.random.default_rng(17)
    for _ in range(3):
        sizes = {name: int(rng.integers(1, 4_000)) for name in "abc"}
        cap = int(rng.integers(1, 900))
        lines = lines_from(spark, **{name: range(n) for name, n in sizes.items()})
        kept = {(name, pos) for name, n in sizes.items() for pos in range(0, n, max(1, math.ceil(n / cap)))}
        assert {(r.series, r.pos) for r in selecting.thin(lines, cap).collect()} == kept
        one = lines.where("series = 'a'")
        assert {r.pos for r in selecting.thin(one, cap, sizes["a"]).collect()} == {pos for name, pos in kept if name == "a"}
        for first, span in rng.integers(-200, sizes["a"] + 200, (3, 2)).tolist():
            want = set(range(sizes["a"])) if span <= 0 else {k for k in range(sizes["a"]) if first <= k < first + span}
            assert {r.pos for r in selecting.run_of(one, first, span).collect()} == want


# --- order and lookup ---------------------------------------------------------


def base_of(spark, values):
    return lines_from(spark, t=values).select("pos", "v")


@pytest.mark.parametrize("values,want", [
    ([1, 2, 2, 9], 1), ([9, 3, 3, 1], -1), ([1, 3, 2], 0), ([], 1), ([4], 1), ([2, 2], 1), (range(50), 1),
    ([*range(20), 5], 0),
])
def test_sort_order(spark, values, want):
    assert ordering.sort_order(base_of(spark, list(values)), block=4).first().direction == want


@pytest.mark.parametrize("few", [10_000, 2])
@pytest.mark.parametrize("falling", [False, True])
def test_lookup_by_value(spark, monkeypatch, few, falling):
    monkeypatch.setattr(ordering, "FEW", few)
    values = sorted(RNG.integers(0, 60, 80).astype(float), reverse=falling)
    base = base_of(spark, values)
    xs = [-1.0, 0.0, 7.0, 7.5, 30.0, 59.0, 99.0]
    edges = spark.createDataFrame([(x,) for x in xs], "x double")
    got = {r.x: r.before for r in ordering.time_edges(base, edges).collect()}
    assert got == {x: sum(v >= x if falling else v < x for v in values) for x in xs}
    ranges = spark.createDataFrame([(k, x, x + 3) for k, x in enumerate(xs)], "k int, lo double, hi double")

    def place(x):
        return min(sum(v > x if falling else v < x for v in values), len(values) - 1)

    for r in ordering.x_range_to_positions(base, ranges).collect():
        assert (r.pos_lo, r.pos_hi) == (place(r.lo), place(r.hi))


def test_unsorted_base_has_no_positions(spark):
    base = base_of(spark, [1, 5, 2])
    ranges = spark.createDataFrame([(0.0, 1.0)], "lo double, hi double")
    assert ordering.x_range_to_positions(base, ranges).first().pos_lo is None
    with pytest.raises(ArgumentError):
        aligning.log_columns_against(lines_from(spark, a=[1, 2, 3]), base, 1, 9, 3)


@pytest.mark.parametrize("few", [10_000, 3])
@pytest.mark.parametrize("log", [False, True])
def test_nearest_sample(spark, monkeypatch, few, log):
    monkeypatch.setattr(ordering, "FEW", few)
    rows = []
    for series, n in (("a", 60), ("b", 5), ("empty", 0), ("gone", 3)):
        for pos in range(n):
            x = float(RNG.integers(-10, 20))  # repeated and unordered
            v = float("nan") if series == "gone" else float(RNG.integers(-3, 9))
            rows.append((series, pos, x, v))
    probes = [(k, s, float(x)) for k, (s, x) in enumerate(
        (s, x) for s in ("a", "b", "empty", "gone") for x in (-50, -3, -2.5, 0, 4, 4.5, 11, 11, 80))]
    got = ordering.nearest_sample(
        spark.createDataFrame(probes, "probe int, series string, x double"),
        spark.createDataFrame(rows, "series string, pos bigint, x double, v double"), log, log).collect()
    assert len(got) == len(probes)
    for r in got:
        able = [(abs(x - r.x), pos, x, v) for s, pos, x, v in rows
                if s == r.series and v == v and (not log or (x > 0 and v > 0))]
        assert (r.pos, r.sample_x, r.v) == (min(able)[1:] if able else (None, None, None)), r


# --- alignment and axes -------------------------------------------------------


def test_stretch(spark):
    lines = lines_from(spark, half=np.arange(32) * 2, one=[5])
    rows = {(r.series, r.pos): r["at"] for r in aligning.stretch(lines, 64).collect()}
    assert rows["half", 0] == 0 and rows["half", 31] == 63 and rows["half", 1] == pytest.approx(63 / 31)
    assert rows["one", 0] == 0
    base = base_of(spark, np.arange(64) / 2)
    against = {(r.series, r.pos): r.x for r in aligning.stretch_against(lines, base).collect()}
    assert against["half", 31] == 31.5 and against["half", 1] == 1.0


def test_align_is_cut_to_both(spark):
    rows = aligning.against_time_base(lines_from(spark, a=range(5), b=range(2)), base_of(spark, [10, 20, 30])).collect()
    assert sorted((r.series, r.pos, r.x) for r in rows) == [("a", 0, 10), ("a", 1, 20), ("a", 2, 30), ("b", 0, 10), ("b", 1, 20)]


def test_move_and_ranges(spark):
    lines = lines_from(spark, a=[1, 2], b=[1, 2], c=[1, 2])
    moves = spark.createDataFrame([("a", 2.0, 1.0), ("b", 0.0, 1.0)], "series string, scale double, shift double")
    rows = {(r.series, r.pos): r.v for r in elementwise.move(lines, moves).collect()}
    assert rows["a", 1] == 5 and rows["b", 1] == 2 and rows["c", 0] == 1
    with pytest.raises(ArgumentError):
        elementwise.range_to_positions(moves, 0, 0)


def test_a_single_series_has_no_separate_axis(spark):
    rows = folds.axis_extents(lines_from(spark, a=[1, -2, 3]), ["a"]).collect()
    assert [(r.axis, r.lo, r.hi, r.positive_min) for r in rows] == [(None, -2, 3, 1)]
    both = folds.axis_extents(lines_from(spark, a=[1, 2], b=[5, 9]), ["a"]).collect()
    assert {(r.axis, r.lo, r.hi) for r in both} == {("a", 1, 2), (None, 5, 9)}


def test_flat_and_missing_time_bases(spark):
    flat = folds.time_extents(base_of(spark, [4, 4]).select("v")).first()
    assert (flat.x_min, flat.x_max, flat.x_positive_min) == (4, 5, 4)
    none = folds.time_extents(base_of(spark, [np.nan]).select("v")).first()
    assert (none.x_min, none.x_max, none.x_positive_min) == (0, 1, 0)


def test_axis_length(spark):
    assert folds.axis_length(lines_from(spark, a=[1], b=[1, 2, 3])).first().axis_length == 3
    assert folds.axis_length(lines_from(spark, a=[])).first().axis_length == 1


def test_slice_of_a_slice(spark):
    array = np.arange(40.0).reshape(8, 5)
    twice = selecting.slice(selecting.slice(cells_from(spark, array), slice(1, None, 2)), slice(None, None, -1), [0, 3])
    np.testing.assert_array_equal(to_numpy(twice), array[1::2][::-1][:, [0, 3]])


def test_one_answer_at_every_size(spark, monkeypatch):
    """Probes and buckets have the same answer on both ways, null and odd keys included."""
    nan, inf = float("nan"), float("inf")
    lines = spark.createDataFrame([("a", k, float(k % 7), float(k)) for k in range(30)] + [(None, k, float(k), 1.0 * k) for k in range(5)],
                                  "series string, pos long, x double, v double")
    probes = spark.createDataFrame([(k, s, x) for k, (s, x) in enumerate(
        [("a", 2.4), ("a", 2.4), ("a", None), ("a", nan), ("a", inf), ("a", -inf), (None, 1.0), ("b", 1.0), ("a", 99.0), (None, None)])],
        "probe long, series string, x double")
    answers = []
    for few in (10_000, 1):
        monkeypatch.setattr(ordering, "FEW", few)
        rows = sorted(map(str, ordering.nearest_sample(probes, lines).collect()))
        assert len(rows) == 10 and sum("pos=None" in r for r in rows) == 7
        answers.append(rows)
    assert answers[0] == answers[1]
    rows = lines.select("series", F.col("pos").alias("bucket"), "pos", "v").withColumn("bucket", F.col("bucket") % 3)
    names = ["series", "bucket", "lo", "hi", "lo_at", "hi_at", "start"]
    ways = [sorted(map(str, summaries.fold_extremes(rows, ["series", "bucket"], groups=g).select(names).collect())) for g in (10, 10**9)]
    assert ways[0] == ways[1] and len(ways[0]) == 6


def test_many_short_lines_over_a_long_base(spark, monkeypatch):
    """A base too long to broadcast is cut down to the few places that are asked for."""
    monkeypatch.setattr(aligning, "BROADCAST_ROWS", 50)
    base = base_of(spark, np.arange(1000) / 2)
    lines = spark.range(40 * 5).select((F.col("id") % 40).cast("string").alias("series"), F.floor(F.col("id") / 40).alias("pos"), (F.col("id") * 1.0).alias("v"))
    found = aligning.stretch_against(lines, base, 1000)
    assert "SortMergeJoin" not in found._jdf.queryExecution().toString().split("Physical Plan")[1]
    rows = found.collect()
    assert len(rows) == 200 and {(r.pos, r.x) for r in rows} == {(k, math.floor(k * 999 / 4 + 0.5) / 2) for k in range(5)}
    bases = base.select(F.lit("b").alias("base"), "pos", "v").union(base.select(F.lit("own"), "pos", F.col("v") + 1))
    assign = spark.createDataFrame([("3", "own")], "series string, base string")
    rows = aligning.own_time_bases(lines, assign, bases, "b", stretch_to=1000).collect()
    assert {(r.pos, r.x) for r in rows if r.series == "3"} == {(k, k / 2 + 1) for k in range(5)} and len(rows) == 200
