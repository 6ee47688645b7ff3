"""Selection over axes: Python subscripts, lines, thinning, runs."""

from __future__ import annotations

import builtins
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellfold.model import ArgumentError, Box, Cells, axis_name, common, element_count, flat_position, int_div, listed_places
from cellfold.runtime import BROADCAST_ROWS, same_keys, small_side
from cellfold.sources.tables import element_positions

CROWDED_LINES = 64
# Marks that the driver sets to count what a list names.
MARKED = 1 << 20


def _whole(index: int, extent: int) -> int:
    at = index + extent if index < 0 else index
    if not 0 <= at < extent:
        raise ArgumentError(f"index {index} is outside an axis of {extent}")
    return at


def _run(term: builtins.slice, extent: int) -> range:
    if term.step == 0:
        raise ArgumentError("the step of a slice cannot be 0")
    return range(*term.indices(extent))


def _filled(subs, rank: int) -> list:
    """One subscript per axis: ``...`` and a short tail stand for ``:``."""
    subs = list(subs)
    gaps = [k for k, sub in enumerate(subs) if sub is Ellipsis]
    if len(gaps) > 1:
        raise ArgumentError("a subscript holds ... at most once")
    stated = len(subs) - len(gaps)
    if stated > rank:
        raise ArgumentError(f"{stated} subscripts for {rank} axes")
    gap = gaps[0] if gaps else len(subs)
    rest = [builtins.slice(None)] * (rank - stated)
    return subs[:gap] + rest + subs[gap + 1:]


def _terms(sub: list, extent: int) -> list[range]:
    if not sub:
        raise ArgumentError("an empty list selects nothing")
    out = []
    for term in sub:
        if isinstance(term, builtins.slice):
            out.append(_run(term, extent))
        else:
            at = _whole(term, extent)
            out.append(range(at, at + 1))
    return out


def _list_count(terms: list[range]) -> int:
    """How many different indices the terms name, by arithmetic alone.

    Runs are cut at every run's ends; between two neighbouring ends the same runs
    go all the way through, so what they name there is a number of residues of
    their steps' least common multiple.  Runs that step by one cover a stretch whole.
    """
    runs = [t if t.step > 0 else t[::-1] for t in terms if len(t)]
    edges = sorted({e for t in runs for e in (t[0], t[-1] + 1)})
    if not edges:
        return 0
    starts = sorted(runs, key=lambda t: t[0])
    found, at, through = 0, 0, []
    for low, high in zip(edges, edges[1:]):
        while at < len(starts) and starts[at][0] <= low:
            through.append(starts[at])
            at += 1
        through = [t for t in through if t[-1] >= low]
        steps = {(t.step, t.start % t.step) for t in through}
        # A run that another one holds adds nothing.
        steps = {(n, r) for n, r in steps if not builtins.any(n % m == 0 and r % m == q for m, q in steps if m < n)}
        found += _named(sorted(steps), low, high)
    return found


def _named(steps: list[tuple[int, int]], low: int, high: int) -> int:
    """Whole numbers in [low, high) with one of the residues."""
    if not steps:
        return 0
    if len(steps) == 1:
        (step, rest), = steps
        return len(range(low + (rest - low) % step, high, step))
    turn = math.lcm(*[n for n, _ in steps])
    span = builtins.min(turn, high - low)
    if span > MARKED:
        # Steps that meet late: what each adds to those before it, where it meets them at all.
        *before, (step, rest) = steps
        met = ((math.lcm(step, n), _meeting(step, rest, n, r)) for n, r in before)
        fewer = [c for c in met if c[1] is not None and _named([c], low, high)]
        return _named(before, low, high) + _named([(step, rest)], low, high) - _named(sorted(set(fewer)), low, high)
    marks = bytearray(span)
    for n, r in steps:
        first = (r - low) % n
        marks[first::n] = b"\1" * len(range(first, span, n))
    whole, more = divmod(high - low, span)
    return whole * builtins.sum(marks) + builtins.sum(marks[:more])


def _meeting(step: int, rest: int, other: int, residue: int) -> int | None:
    """The residue that two residues have in common modulo both steps' multiple."""
    turn = math.lcm(step, other)
    met = common(range(rest, rest + 2 * turn, step), range(residue, residue + 2 * turn, other))
    return met[0] % turn if len(met) else None


def sliced_shape(shape, subs) -> tuple[int, ...]:
    """The shape a slice leaves, or the refusal it meets.  No job is started."""
    out = []
    for extent, sub in zip(shape, _filled(subs, len(shape))):
        if extent == 0:
            raise ArgumentError("an axis of extent 0 has nothing to select")
        if isinstance(sub, builtins.slice):
            count = len(_run(sub, extent))
        elif isinstance(sub, (list, tuple)):
            count = _list_count(_terms(list(sub), extent))
        else:
            _whole(sub, extent)
            continue
        if count == 0:
            raise ArgumentError("the slice selects nothing")
        out.append(count)
    return tuple(out)


def _pairs(spark, terms: list[range]) -> tuple[DataFrame, int]:
    """(old, new) index pairs of a list subscript, first mention kept."""
    named = builtins.sum(len(t) for t in terms)
    if named <= BROADCAST_ROWS:
        order = list(dict.fromkeys(i for term in terms for i in term))
        import pyarrow as pa

        table = pa.table({"_old": pa.array(order, pa.int64()),
                          "_new": pa.array(range(len(order)), pa.int64())})
        return F.broadcast(spark.createDataFrame(table)), len(order)
    # A long list is written down by the executors, never by the driver.
    listed, offset = None, 0
    for term in terms:
        part = spark.range(len(term)).select(
            (F.lit(term.start) + F.col("id") * F.lit(term.step)).alias("_old"),
            (F.col("id") + F.lit(offset)).alias("_rank"),
        )
        listed = part if listed is None else listed.unionByName(part)
        offset += len(term)
    first = listed.groupBy("_old").agg(F.min("_rank").alias("_rank"))
    pairs = element_positions(first, ["_rank"], "_new").select("_old", "_new")
    return pairs, _list_count(terms)


def take(cells: Cells, axis: int, indices: list) -> Cells:
    """List subscript on one axis: order kept, duplicates dropped at first mention."""
    at = _whole(axis, cells.rank)
    extent = cells.shape[at]
    terms = _terms(indices, extent) if extent else []
    if not builtins.any(len(t) for t in terms):
        raise ArgumentError("the slice selects nothing")
    name = axis_name(at)
    pairs, count = _pairs(cells.df.sparkSession, terms)
    named = listed_places([t for t in terms if len(t)])

    def picked(box: Box | None = None) -> DataFrame:
        near = cells.within(tuple(named if a == at else box[a] if box else range(n) for a, n in enumerate(cells.shape)))
        return near.df.join(pairs, F.col(name) == F.col("_old")).select(
            *[F.col("_new").alias(a) if a == name else F.col(a) for a in cells.axes], "v"
        )

    shape = tuple(count if a == at else n for a, n in enumerate(cells.shape))
    return cells.of(picked(), shape, limit=cells.limit, rows=picked)


def _needed(sub, extent: int, places: range | tuple[int, ...] | None = None) -> range | tuple[int, ...]:
    """What a subscript needs of its axis, or what ``places`` of its result do."""
    if isinstance(sub, (list, tuple)):
        return listed_places([t for t in _terms(list(sub), extent) if len(t)])
    if not isinstance(sub, builtins.slice):
        at = _whole(sub, extent)
        return range(at, at + 1)
    run = _run(sub, extent)
    if places is not None:
        if not isinstance(places, range):
            return tuple(sorted(run[k] for k in places))
        run = run[places.start:places.stop:places.step]
    return run if run.step > 0 else run[::-1]


def slice(cells: Cells, *subs) -> Cells:  # noqa: A001 - the operator's own name
    """Python indexing per axis, except that selecting nothing is an error.

    What is selected is asked of the cells first (``Cells.within``), so that it reaches the
    scan through reshapes and opens no more of an array than it names.
    """
    sliced_shape(cells.shape, subs)
    return _sliced(cells, _filled(subs, cells.rank))


def _sliced(cells: Cells, filled: list) -> Cells:
    source = cells
    cells = cells.within(tuple(_needed(sub, extent) for sub, extent in zip(filled, cells.shape)))
    for axis, sub in enumerate(filled):
        if isinstance(sub, (list, tuple)):
            cells = take(cells, axis, list(sub))
    kept: list[tuple[Column, int]] = []
    df = cells.df
    for axis, (sub, extent) in enumerate(zip(filled, cells.shape)):
        position = F.col(axis_name(axis))
        if isinstance(sub, (list, tuple)):
            kept.append((position, extent))
        elif isinstance(sub, builtins.slice):
            run = _run(sub, extent)
            low, high = builtins.min(run[0], run[-1]), builtins.max(run[0], run[-1])
            if low > 0:
                df = df.where(position >= low)
            if high < extent - 1:
                df = df.where(position <= high)
            away = position - low if run.step > 0 else F.lit(high) - position
            if abs(run.step) > 1 and len(run) > 1:
                df = df.where(away % abs(run.step) == 0)
                away = int_div(away, abs(run.step))
            kept.append((position if run == range(extent) else away, len(run)))
        else:
            df = df.where(position == _whole(sub, extent))
    columns = [c.cast("bigint").alias(axis_name(k)) for k, (c, _) in enumerate(kept)]

    def narrower(box: Box) -> DataFrame:
        shown = iter(box)
        need = tuple(_needed(sub, n, next(shown) if isinstance(sub, (builtins.slice, list, tuple)) else None)
                     for sub, n in zip(filled, source.shape))
        return _sliced(source.within(need), filled).df

    return cells.of(df.select(*columns, "v"), (n for _, n in kept), limit=cells.limit, rows=narrower)


def pin(cells: Cells, axis: int, index: int) -> Cells:
    """Hold one axis at one index."""
    at = _whole(axis, cells.rank)
    return slice(cells, *([builtins.slice(None)] * at), index)


def line(cells: Cells, *subs, series="line") -> DataFrame:
    """A slice that leaves exactly one axis, as a line."""
    shape = sliced_shape(cells.shape, subs)
    if len(shape) != 1:
        what = "one element" if not shape else " x ".join(map(str, shape))
        raise ArgumentError(f"a line has one axis, not {what}")
    return slice(cells, *subs).df.select(F.lit(series).alias("series"), F.col("i0").alias("pos"), "v")


def lines_of(cells: Cells, limit: int = CROWDED_LINES, confirmed: bool = False) -> DataFrame:
    """Every 1-D line of a dataset: the last axis runs, the others number the series."""
    if cells.rank == 0:
        raise ArgumentError("a single value holds no line")
    leading = cells.shape[:-1]
    count = element_count(leading)
    if count > limit and not confirmed:
        raise ArgumentError(f"this is {count} lines, more than {limit}; confirm to have them all")
    return cells.df.select(
        flat_position(list(range(len(leading))), leading).alias("series"),
        F.col(axis_name(cells.rank - 1)).alias("pos"),
        "v",
    )


def lengths(lines: DataFrame) -> DataFrame:
    """Samples per series; partial counts are combined before the shuffle."""
    return lines.groupBy("series").agg(F.count(F.lit(1)).alias("n"))


def thin(lines: DataFrame, max_points: int, length: int | None = None) -> DataFrame:
    """Every stride-th sample of a line, the stride being enough to stay under the
    cap.  Without a known ``length`` every series is thinned by its own."""
    if max_points <= 0:
        return lines
    if length is not None:
        stride = -(-length // max_points)
        return lines.where(F.col("pos") % stride == 0) if stride > 1 else lines
    strides = lengths(lines).select("series", int_div(F.col("n") + (max_points - 1), max_points).alias("_stride"))
    joined = same_keys(lines, small_side(strides), ["series"])
    return joined.where(F.col("pos") % F.col("_stride") == 0).select(*lines.columns)


def run_of(lines: DataFrame, first: int, span: int) -> DataFrame:
    """A run of a line, cut to what exists; no span is the whole line."""
    if span <= 0:
        return lines
    start = builtins.max(first, 0)
    return lines.where((F.col("pos") >= start) & (F.col("pos") < builtins.max(first + span, start)))


def first_series(lines: DataFrame, n: int = CROWDED_LINES) -> DataFrame:
    """The first n series of a table of numbered series."""
    return lines.where(F.col("series") < n)
