"""Operations in a row.

A plan is a list of steps ``(operation, *arguments)`` or ``(operation, *arguments,
{named})``.  The shapes are worked out first, so a step that refuses stops the
plan before any job is started; what ran before it is the answer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellfold.model import EXACT, ArgumentError, Cells
from cellfold.operators import elementwise, folds, rearranging, running, selecting
from cellfold.runtime import written

OPERATIONS: dict[str, Callable[..., Cells]] = {
    "slice": selecting.slice,
    "transpose": rearranging.transpose,
    "reshape": rearranging.reshape,
    "min": folds.min,
    "max": folds.max,
    "sum": folds.sum,
    "prod": folds.prod,
    "cumsum": running.cumsum,
    "cumprod": running.cumprod,
    "diff": running.diff,
    "abs": elementwise.abs,
    "sqrt": elementwise.sqrt,
    "clip": elementwise.clip,
    "pow": elementwise.pow,
    "add": elementwise.add,
    "multiply": elementwise.multiply,
    "normalize": elementwise.normalize,
}


@dataclass(frozen=True)
class Ran:
    """What a plan gave: the cells so far, how many steps ran, why it stopped."""

    cells: Cells | None
    ran: int
    error: str | None = None

    def frame(self) -> DataFrame:
        """The result as a table; whole numbers that stayed whole come back BIGINT.

        No job runs while the steps provably stay within what a double holds
        exactly.  Otherwise the plan runs once, into a table; a column with a value that a
        BIGINT could not say exactly stays DOUBLE.
        """
        cells = self.cells
        if not cells.integer:
            return cells.df
        if cells.limit is None or cells.limit > EXACT:
            table = written(cells.df, "whole")
            beyond = F.max(F.when(F.abs("v") <= EXACT, 0).otherwise(1))
            if table.agg(F.coalesce(beyond, F.lit(0)).alias("off")).first().off:
                return table
            return table.withColumn("v", F.col("v").try_cast("bigint"))
        return cells.df.withColumn("v", F.col("v").try_cast("bigint"))


def _apply(cells: Cells, step) -> Cells:
    name, *arguments = step if isinstance(step, (list, tuple)) else (step,)
    if name not in OPERATIONS:
        raise ArgumentError(f"there is no operation {name}")
    named = arguments.pop() if arguments and isinstance(arguments[-1], dict) else {}
    try:
        return OPERATIONS[name](cells, *arguments, **named)
    except TypeError as refused:
        raise ArgumentError(str(refused)) from refused


def pipeline(cells: Cells | DataFrame, steps: list, up_to: int | None = None) -> Ran:
    """Apply the steps in order, the first ``up_to`` of them.

    The first step is the slice; a plan that opens with anything else reads
    everything.  Every operator checks its arguments against the shape and only
    adds to the lazy plan, so the whole pipeline is one job.
    """
    kind = cells.df.schema["v"].dataType if isinstance(cells, Cells) else None
    if not isinstance(kind, T.NumericType):
        held = "no dataset" if kind is None else kind.simpleString()
        return Ran(None, 0, f"not numeric: {held}")
    steps = list(steps)
    if up_to is not None:
        steps = steps[:up_to]
    ran = 0
    for at, step in enumerate(steps):
        opens = at == 0 and (step if isinstance(step, str) else step[0]) == "slice"
        if opens and cells.rank == 0:
            ran += 1
            continue
        try:
            cells = _apply(cells, step)
        except ArgumentError as refused:
            return Ran(cells, ran, str(refused))
        ran += 1
    return Ran(cells, ran)


def pipeline_line(cells: Cells, steps: list, series="line") -> DataFrame:
    """A pipeline that ends on one axis, as a series."""
    result = pipeline(cells, steps)
    if result.error:
        raise ArgumentError(result.error)
    return selecting.line(result.cells, series=series)
