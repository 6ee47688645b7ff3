"""Rows that have to meet, dealt into cells of bounded size and worked on cell by cell."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd


def whole_cells(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The frames of a partition that is sorted by ``keys``, cut again so that each holds
    whole cells; a cell is held in memory, a partition is not."""
    rest: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        at = frame[keys].to_numpy()
        same = (at == at[-1]).all(axis=1)
        start = len(frame) - int(same[::-1].argmin() if not same.all() else len(frame))
        if start or (rest and (rest[-1][keys].to_numpy()[-1] != at[0]).any()):
            done = [*rest, frame.iloc[:start]] if start else rest
            if done:
                yield pd.concat(done, ignore_index=True)
            rest = [frame.iloc[start:]]
        else:
            rest.append(frame)
    if rest:
        yield pd.concat(rest, ignore_index=True)


def each_cell(frames: Iterator[pd.DataFrame], keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame | None]) -> Iterator[pd.DataFrame]:
    for frame in whole_cells(frames, keys):
        at = frame[keys].to_numpy()
        cuts = np.nonzero((at[1:] != at[:-1]).any(axis=1))[0] + 1
        for start, end in zip([0, *cuts], [*cuts, len(frame)]):
            found = work(frame.iloc[start:end])
            if found is not None and len(found):
                yield found
