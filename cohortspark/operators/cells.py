"""Cells: a block of references cut into small boxes, so that whole boxes can be left out of a nearest-neighbour search.

References are grouped by their categories and by which numbers they lack, and
a group is halved at the median of its widest feature (as the metric weighs
it) until a cell is small.  With a caliper they are cut along the caliper's
column instead, a sorted sweep.  A metric's ``box_floor`` gives the least
distance that a query can have to anything in a cell; a cell is left out only
where that is beyond what the query already has, with an allowance for
rounding, so results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

CELL = 128
#: Rounding allowance on a floor: relative and absolute.
RELATIVE, ABSOLUTE = 1e-9, 1e-12
_QUERIES = 4096


@dataclass
class Cells:
    members: list[np.ndarray]
    low: np.ndarray
    high: np.ndarray
    codes: np.ndarray
    band: np.ndarray | None


def build(numbers: np.ndarray, codes: np.ndarray, band: np.ndarray | None, scale: np.ndarray, size: int = CELL) -> Cells:
    """Cells of at most ``size`` references (rows of numbers and codes); ``scale``: what a step of each number weighs."""
    n, p = numbers.shape
    gone = np.isnan(numbers)
    kinds = np.concatenate((codes, gone.astype(np.int64)), axis=1)
    if band is not None:
        kinds = np.concatenate((kinds, np.isnan(band)[:, None]), axis=1)
    if kinds.shape[1]:
        _, kind_of = np.unique(kinds, axis=0, return_inverse=True)
        order = np.argsort(kind_of.ravel(), kind="stable")
        todo = np.split(order, np.cumsum(np.bincount(kind_of.ravel()))[:-1])
    else:
        todo = [np.arange(n)]
    members: list[np.ndarray] = []
    while todo:
        at = todo.pop()
        if len(at) > size:
            if band is not None:
                key = band[at]
            else:
                x = numbers[at]
                spread = np.where(gone[at[0]], 0.0, x.max(axis=0) - x.min(axis=0)) * scale if p else np.zeros(0)
                key = x[:, int(np.argmax(spread))] if p and spread.max() > 0 else None
            if key is not None and not np.isnan(key[0]):
                half = len(at) // 2
                part = np.argpartition(key, half)
                todo += [at[part[:half]], at[part[half:]]]
                continue
        members.append(at)
    low = np.array([numbers[at].min(axis=0) for at in members]).reshape(len(members), p)
    high = np.array([numbers[at].max(axis=0) for at in members]).reshape(len(members), p)
    span = None if band is None else np.array([(band[at].min(), band[at].max()) for at in members]).reshape(len(members), 2)
    return Cells(members, low, high, codes[[at[0] for at in members]], span)


def worth_comparing(numbers: np.ndarray, codes: np.ndarray, band: np.ndarray | None, cells: Cells, metric, worst: np.ndarray, width: float | None, every: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(queries, references) to compare, each query's nearest cell first; ``worst`` (the k-th best so far) may fall on the way.

    ``every``: all within the caliper, whatever the distance.
    """
    for lo in range(0, len(numbers), _QUERIES):
        part = slice(lo, lo + _QUERIES)
        floor = np.zeros((len(numbers[part]), len(cells.members))) if every or not hasattr(metric, "box_floor") else metric.box_floor(numbers[part], codes[part], cells.low, cells.high, cells.codes)
        floor -= floor * RELATIVE + ABSOLUTE
        if width is not None:
            with np.errstate(invalid="ignore"):
                near = (cells.band[None, :, 1] >= band[part, None] - width * (1 + RELATIVE) - ABSOLUTE) & (cells.band[None, :, 0] <= band[part, None] + width * (1 + RELATIVE) + ABSOLUTE)
            floor[~near] = np.inf
        first = floor.argmin(axis=1)
        own = np.zeros(floor.shape, bool)
        own[np.arange(len(first)), first] = True
        for nearest in (True, False):
            for g in np.argsort(floor.min(axis=0), kind="stable"):
                column = floor[:, g]
                at = np.flatnonzero((own[:, g] if nearest else ~own[:, g]) & (column <= worst[part]) & (column < np.inf))
                if len(at):
                    yield at + lo, cells.members[g]
