"""Min/max summaries of long lines: envelopes, pyramids, logarithmic columns.

The fold of a bucket keeps its finite minimum and maximum, each at the earliest
position it occurs.  Two ways to compute it:

* few buckets: hash aggregate the values, broadcast the bucket table back over
  the line and take the earliest position holding each extreme.  Two scans, no
  sort, and the line itself is never shuffled;
* too many buckets to broadcast: one aggregate over (value, position) pairs,
  which Spark sorts locally before the partial aggregate.
"""

from __future__ import annotations

import builtins
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellfold.functions.numbers import is_finite, nan
from cellfold.model import ArgumentError, int_div
from cellfold.operators.running import with_seam
from cellfold.operators.selecting import lengths
from cellfold.runtime import BLOCK, BROADCAST_ROWS, small_side, written


def _finite() -> Column:
    return F.when(is_finite("v"), F.col("v"))


def _values(rows: DataFrame, keys: list[str], spread: dict[str, Column]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.min(_finite()).alias("lo"), F.max(_finite()).alias("hi"), F.min("pos").alias("start"),
        *[e.alias(n) for n, e in spread.items()])


def _by_hash(rows: DataFrame, values: DataFrame, keys: list[str], spread: dict[str, Column],
             carry: list[str], constant: list[str]) -> DataFrame:
    """Earliest position of each extreme; ``values`` is marked for broadcast.

    Only the rows that hold an extreme pass the join, and one of a bucket that
    holds nothing finite.
    """
    low, high = F.col("v") == F.col("lo"), F.col("v") == F.col("hi")
    # Buckets and columns are never null: a plain key is one long, which joins twice as fast.
    plain = [k for k in keys if k != "series"]
    null_safe = [k for k in keys if k == "series"]
    renamed = values.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    match = [F.col(k) == F.col(f"_same_{k}") for k in plain] + [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in null_safe]
    seen = rows.join(renamed, match).drop(*[f"_same_{k}" for k in keys]).where(low | high | (F.col("lo").isNull() & (F.col("pos") == F.col("start"))))
    at_low, at_high = F.when(low, F.col("pos")), F.when(high, F.col("pos"))
    more = []
    for name in carry:
        more.append(F.min_by(F.when(low, F.col(name)), at_low).alias(f"lo_{name}"))
        more.append(F.min_by(F.when(high, F.col(name)), at_high).alias(f"hi_{name}"))
    same = [F.max(name).alias(name) for name in ("lo", "hi", "start", *spread, *constant)]
    return seen.groupBy(*keys).agg(*same, F.min(at_low).alias("lo_at"), F.min(at_high).alias("hi_at"), *more)


def _by_pair(rows: DataFrame, keys: list[str], spread: dict[str, Column], carry: list[str]) -> DataFrame:
    finite = is_finite("v")
    extra = [F.col(name) for name in carry]
    low = F.min(F.when(finite, F.struct("v", "pos", *extra)))
    high = F.max(F.when(finite, F.struct("v", (-F.col("pos")).alias("back"), "pos", *extra)))
    folded = rows.groupBy(*keys).agg(low.alias("_lo"), high.alias("_hi"), F.min("pos").alias("start"),
                                     *[e.alias(n) for n, e in spread.items()])
    more = [F.col(f"_{end}.{name}").alias(f"{end}_{name}") for name in carry for end in ("lo", "hi")]
    return folded.select(
        *keys, F.col("_lo.v").alias("lo"), F.col("_hi.v").alias("hi"),
        F.col("_lo.pos").alias("lo_at"), F.col("_hi.pos").alias("hi_at"), "start", *more, *spread,
    )


def fold_extremes(rows: DataFrame, keys: list[str], spread: dict[str, Column] | None = None,
                  groups: int | None = None, carry: list[str] | None = None,
                  constant: list[str] | None = None) -> DataFrame:
    """[*keys, lo, hi, lo_at, hi_at, start] of rows with ``pos`` and ``v``.

    ``groups`` is a proven bound on the number of different keys, when there is
    one; without it the buckets are counted before they are broadcast.
    ``constant`` columns have one value throughout and are handed on.
    """
    spread, carry, constant = spread or {}, carry or [], constant or []
    if groups is not None and groups > BROADCAST_ROWS:
        return _by_pair(rows, [*keys, *constant], spread, carry)
    values = _values(rows, keys, spread)
    if groups is not None:
        return _by_hash(rows, F.broadcast(values), keys, spread, carry, constant)
    head = values.limit(BROADCAST_ROWS + 1).toArrow()
    if head.num_rows > BROADCAST_ROWS:
        return _by_pair(rows, [*keys, *constant], spread, carry)
    counted = F.broadcast(rows.sparkSession.createDataFrame(head, values.schema))
    return _by_hash(rows, counted, keys, spread, carry, constant)


def _pairs(folded: DataFrame, keys: list[str], carry: list[str] | None = None) -> DataFrame:
    """Two rows per bucket, its extremes in the order they occurred; an all
    missing bucket is two NaN at its start."""
    carry = carry or []
    def end(which: str, slot: Column) -> Column:
        found = F.col(f"{which}_at")
        return F.struct(
            slot.cast("int").alias("slot"),
            F.coalesce(found, F.col("start")).alias("pos"),
            *[F.col(f"{which}_{name}").alias(name) for name in carry],
            F.coalesce(F.col(which), nan()).alias("v"),
        )
    turned = F.coalesce(F.col("hi_at") < F.col("lo_at"), F.lit(False))
    low = end("lo", F.when(turned, 1).otherwise(0))
    high = end("hi", F.when(turned, 0).otherwise(1))
    opened = folded.select(*keys, F.explode(F.array(low, high)).alias("_p"))
    return opened.select(*keys, "_p.slot", "_p.pos", *[f"_p.{name}" for name in carry], "_p.v")


def _joined(folded: DataFrame) -> DataFrame:
    """Each bucket also takes in the first sample of the next one.

    Only where the stroke between the two is drawn: the bucket's last sample
    and the next first one are both finite.
    """
    lent = with_seam(folded, "bucket", BLOCK, 1)
    order = Window.partitionBy("series", "_b").orderBy("bucket")
    led = lent.withColumns({"_next": F.lead("entry").over(order), "_next_at": F.lead("entry_at").over(order)})
    own = led.where(int_div(F.col("bucket"), BLOCK) == F.col("_b"))
    drawn = is_finite("exit") & is_finite("_next")
    lower, higher = drawn & (F.col("_next") < F.col("lo")), drawn & (F.col("_next") > F.col("hi"))
    return own.withColumns({
        "lo_at": F.when(lower, F.col("_next_at")).otherwise(F.col("lo_at")),
        "hi_at": F.when(higher, F.col("_next_at")).otherwise(F.col("hi_at")),
        "lo": F.when(lower, F.col("_next")).otherwise(F.col("lo")),
        "hi": F.when(higher, F.col("_next")).otherwise(F.col("hi")),
    })


def _seam_columns(enters: Column, leaves: Column) -> dict[str, Column]:
    return {
        "entry": F.max(F.when(enters, F.col("v"))),
        "entry_at": F.max(F.when(enters, F.col("pos"))),
        "exit": F.max(F.when(leaves, F.col("v"))),
    }


def _bucketed(lines: DataFrame, buckets: int | None, bucket: int | None, length: int | None) -> DataFrame:
    """Lines with ``_w``, the number of samples in one of their buckets."""
    if (buckets is None) == (bucket is None):
        raise ArgumentError("give either a number of buckets or the size of one")
    if (buckets if bucket is None else bucket) < 1:
        raise ArgumentError("a bucket holds at least one sample")
    if bucket is None and length is not None:
        bucket = builtins.max(1, -(-length // buckets))
    if bucket is not None:
        return lines.withColumn("_w", F.lit(bucket).cast("bigint"))
    widths = lengths(lines).select("series", int_div(F.col("n") + (buckets - 1), buckets).alias("_w"))
    return lines.join(small_side(widths), "series")


def extremes(lines: DataFrame, buckets: int | None = None, bucket: int | None = None,
             length: int | None = None, seam: bool = False, series_count: int | None = None) -> DataFrame:
    """One row per bucket: lo, hi and where they are, and the bucket's width.

    ``length`` and ``series_count`` are bounds the caller can prove (from a
    shape); with both, the plan is decided without running anything.
    """
    rows = _bucketed(lines, buckets, bucket, length)
    rows = rows.withColumn("bucket", F.call_function("div", F.col("pos"), F.col("_w")))
    spread = {}
    if buckets is not None and length is None:
        spread = {"width": F.max("_w"), "only": F.max("v")}
    if seam:
        spread |= _seam_columns(F.col("pos") % F.col("_w") == 0, (F.col("pos") + 1) % F.col("_w") == 0)
    groups = None
    if series_count is not None:
        if buckets is not None:
            groups = series_count * buckets
        elif length is not None:
            groups = series_count * -(-length // bucket)
    folded = _fold_series(rows, "bucket", spread, groups, series_count)
    return _joined(folded) if seam else folded


def _fold_series(rows: DataFrame, by: str, spread: dict[str, Column], groups: int | None, series_count: int | None,
                 carry: list[str] | None = None) -> DataFrame:
    """fold_extremes per series and bucket.  A single line is keyed by the bucket
    alone, a plain BIGINT, which Spark groups and joins much faster."""
    if series_count == 1:
        return fold_extremes(rows, [by], spread, groups, carry, ["series"])
    return fold_extremes(rows, ["series", by], spread, groups, carry)


def envelope(lines: DataFrame, buckets: int | None = None, bucket: int | None = None,
             length: int | None = None, seam: bool = False, series_count: int | None = None) -> DataFrame:
    """[series, bucket, slot, pos, v]: the finite extremes of every bucket.

    A bucket of one sample is that sample, once.
    """
    if bucket == 1 or (buckets is not None and length is not None and length <= buckets):
        return lines.select("series", F.col("pos").alias("bucket"), F.lit(0).alias("slot"), "pos", "v")
    folded = extremes(lines, buckets, bucket, length, seam, series_count)
    if buckets is None or length is not None:
        return _pairs(folded, ["series", "bucket"])
    # Lines of several lengths: the buckets of a short one may hold one sample.
    pairs = _pairs(folded, ["series", "bucket", "width", "only", "start"])
    one = F.col("width") == 1
    return pairs.where(~one | (F.col("slot") == 0)).select(
        "series", "bucket", "slot", F.when(one, F.col("start")).otherwise(F.col("pos")).alias("pos"),
        F.when(one, F.col("only")).otherwise(F.col("v")).alias("v"))


def coarsen(summary: DataFrame, factor: int) -> DataFrame:
    """An envelope folded further: the same as folding the samples at that size."""
    if factor < 1:
        raise ArgumentError("a factor is at least one")
    rows = summary.withColumn("bucket", int_div(F.col("bucket"), factor))
    return _pairs(_by_pair(rows, ["series", "bucket"], {}, []), ["series", "bucket"])


def _merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of extremes folded to one per key, extremes by extremes."""
    low = F.min(F.when(F.col("lo").isNotNull(), F.struct("lo", "lo_at")))
    high = F.max(F.when(F.col("hi").isNotNull(), F.struct("hi", (-F.col("hi_at")).alias("back"))))
    coarse = rows.groupBy(*keys).agg(low.alias("_lo"), high.alias("_hi"), F.min("start").alias("start"))
    return coarse.select(*keys, F.col("_lo.lo").alias("lo"), F.col("_hi.hi").alias("hi"),
                         F.col("_lo.lo_at").alias("lo_at"), (-F.col("_hi.back")).alias("hi_at"), "start")


def pyramid(lines: DataFrame, base_bucket: int, length: int | None = None, series_count: int | None = None,
            small: int = BROADCAST_ROWS) -> DataFrame:
    """[series, width, bucket, slot, pos, v]: the envelope at ``base_bucket`` and
    at every doubling above it, up to one bucket for the whole line.

    The line is read once.  Each level is folded out of the one below and written
    out while it is long; once it has no more than ``small`` rows, all the levels
    above it come out of one aggregate over it.
    """
    if base_bucket < 1:
        raise ArgumentError("a bucket holds at least one sample")
    if length is None:
        length = lengths(lines).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first().n
    keys, facts = ["series", "width", "bucket"], ["lo", "hi", "lo_at", "hi_at", "start"]
    if base_bucket == 1:
        place = F.when(is_finite("v"), F.col("pos"))
        level = lines.select("series", F.col("pos").alias("bucket"), _finite().alias("lo"), _finite().alias("hi"),
                             place.alias("lo_at"), place.alias("hi_at"), F.col("pos").alias("start"))
    else:
        level = extremes(lines, bucket=base_bucket, length=length, series_count=series_count)
    width = base_bucket
    level = written(level.select("series", F.lit(width).cast("bigint").alias("width"), "bucket", *facts), "level")
    levels = [level]
    while width < length and level.count() > small:
        width *= 2
        halved = level.withColumns({"width": F.lit(width).cast("bigint"), "bucket": int_div(F.col("bucket"), 2)})
        level = written(_merged(halved, keys), "level")
        levels.append(level)
    above = 0
    while (width << above) < length:
        above += 1
    if above:
        step = F.explode(F.array(*[F.lit(1 << k).cast("bigint") for k in range(1, above + 1)])).alias("_f")
        spread = level.select("series", "width", "bucket", *facts, step)
        rows = spread.withColumns({"width": F.col("width") * F.col("_f"),
                                   "bucket": F.call_function("div", F.col("bucket"), F.col("_f"))})
        levels.append(_merged(rows, keys))
    samples = lines.select("series", F.lit(1).cast("bigint").alias("width"), F.col("pos").alias("bucket"),
                           F.lit(0).alias("slot"), "pos", "v")
    shown = [samples if k == 0 and base_bucket == 1 else _pairs(each, keys) for k, each in enumerate(levels)]
    out = shown[0]
    for each in shown[1:]:
        out = out.unionByName(each)
    return out


def closer_look(lines: DataFrame, first: int, span: int, bucket: int, series_count: int | None = None) -> DataFrame:
    """Envelope of one run, with one sample past it for the last bucket's seam."""
    if bucket < 1 or span < 1:
        raise ArgumentError("a run and its buckets hold at least one sample")
    start = builtins.max(first, 0)
    span = first + span - start
    if span < 1:
        return lines.where(F.lit(False)).select("series", F.lit(0).cast("bigint").alias("bucket"),
                                                F.lit(0).alias("slot"), "pos", "v")
    read = lines.where((F.col("pos") >= start) & (F.col("pos") <= start + span))
    at = F.col("pos") - start
    past = at == span
    last = -(-span // bucket)
    rows = read.withColumn("bucket", F.when(past, F.lit(last).cast("bigint")).otherwise(int_div(at, bucket)))
    if bucket == 1:
        return rows.where(~past).select("series", "bucket", F.lit(0).alias("slot"), "pos", "v")
    spread = _seam_columns((at % bucket == 0) | past, ((at + 1) % bucket == 0) | (at == span - 1))
    groups = None if series_count is None else series_count * (last + 1)
    folded = _joined(_fold_series(rows, "bucket", spread, groups, series_count))
    return _pairs(folded.where(F.col("bucket") < last), ["series", "bucket"])


def log_columns(points: DataFrame, lo: float, hi: float, columns: int, series_count: int | None = None) -> DataFrame:
    """[series, column, slot, pos, x, v]: one pair per column of equal width in log x.

    ``points`` is a line with its x.  Samples at x <= 0 or outside [lo, hi] are
    left out; hi itself belongs to the last column.
    """
    if not (0 < lo < hi and math.isfinite(hi)) or columns < 1:
        raise ArgumentError("a logarithmic window runs between two positive ends")
    if hi / lo < 2:
        raise ArgumentError("a window under a factor of two is summarised by position")
    wide = math.log(hi) - math.log(lo)
    inside = points.where((F.col("x") > 0) & (F.col("x") >= lo) & (F.col("x") <= hi))
    at = F.floor((F.ln("x") - F.lit(math.log(lo))) / F.lit(wide) * F.lit(float(columns)))
    rows = inside.withColumn("column", F.least(F.greatest(at, F.lit(0)), F.lit(columns - 1)).cast("bigint"))
    groups = None if series_count is None else series_count * columns
    folded = _fold_series(rows, "column", {}, groups, series_count, ["x"])
    return _pairs(folded, ["series", "column"], ["x"])


def overlay(*parts: dict) -> DataFrame:
    """Lines of several datasets as one frame [series, label, pos, v].

    Each part is a dict with ``line`` and ``name`` and, optionally, ``alias`` and
    ``drawn``.  One that is not drawn keeps its number and is left out.
    """
    out = None
    for number, part in enumerate(parts):
        if not part.get("drawn", True):
            continue
        one = part["line"].select(
            F.lit(number).cast("bigint").alias("series"),
            F.lit(part.get("alias") or part["name"]).alias("label"), "pos", "v")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ArgumentError("no line is drawn")
    return out
