"""Gower distance over mixed features: a fitted model, its column expression and its NumPy block."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.weights import resolve_weights
from .knn import Metric

FLOOR = 1e-8


@dataclass(frozen=True)
class GowerModel(Metric):
    """Features with ranges (of the reference rows) and weights.

    d = sum(w m delta) / sum(w m): delta is the range-scaled difference or the
    mismatch, m is 0 where either side is null; a zero denominator gives 1.
    Features of weight 0 are left out of the expressions.
    """

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    ranges: Mapping[str, float]
    weights: Mapping[str, float]

    def _active(self) -> list[str]:
        return [c for c in (*self.numeric, *self.categorical) if self.weights[c] > 0]

    def delta(self, c: str, left: str, right: str) -> Column:
        a, b = F.col(f"{left}{c}"), F.col(f"{right}{c}")
        return F.abs(a - b) / F.lit(self.ranges[c]) if c in self.numeric else F.when(a == b, 0.0).otherwise(1.0)

    def distance(self, left: str = "q_", right: str = "r_") -> Column:
        """The distance of two rows joined side by side, columns prefixed."""
        top, bottom = F.lit(0.0), F.lit(0.0)
        for c in self._active():
            both = F.col(f"{left}{c}").isNotNull() & F.col(f"{right}{c}").isNotNull()
            w = F.lit(float(self.weights[c]))
            top = top + F.when(both, w * self.delta(c, left, right)).otherwise(0.0)
            bottom = bottom + F.when(both, w).otherwise(0.0)
        return F.when(bottom > 0, top / bottom).otherwise(1.0)

    def components(self, left: str = "q_", right: str = "r_") -> Column:
        """Unweighted differences of every feature, null where either side is."""
        return F.array(*(F.when(F.col(f"{left}{c}").isNotNull() & F.col(f"{right}{c}").isNotNull(), self.delta(c, left, right)) for c in (*self.numeric, *self.categorical)))

    @staticmethod
    def recombined(components: Column, weights: Sequence[float]) -> Column:
        """Distances from cached components under other weights (finite, not negative, not all zero)."""
        w = [float(x) for x in weights]
        if not all(np.isfinite(w)) or min(w, default=-1) < 0 or not any(w):
            raise ValueError("weights have to be finite, not negative and not all zero")
        array = F.array(*map(F.lit, w))
        pairs = F.zip_with(components, array, lambda d, x: F.struct(F.coalesce(d, F.lit(0.0)).alias("d"), F.when(d.isNotNull(), x).otherwise(0.0).alias("w")))
        top = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + p["d"] * p["w"])
        bottom = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + p["w"])
        return F.when(bottom > 0, top / bottom).otherwise(1.0)

    def side(self, df: DataFrame) -> tuple[list[Column], list[Column]]:
        """Numeric and categorical columns that the block needs of each side."""
        active = set(self._active())
        return [F.col(c) for c in self.numeric if c in active], [F.col(c) for c in self.categorical if c in active]

    def scales(self, p: int) -> np.ndarray:
        return np.array([self.weights[c] / self.ranges[c] for c in self.numeric if self.weights[c] > 0])

    def box_floor(self, qn: np.ndarray, qc: np.ndarray, low: np.ndarray, high: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The least distance of each query to anything in each box; a box lacks a number wholly (NaN) or nowhere."""
        active = set(self._active())
        top, bottom = np.zeros((len(qn), len(low))), np.zeros((len(qn), len(low)))
        for j, c in enumerate(c for c in self.numeric if c in active):
            q = qn[:, j, None]
            gap = np.maximum(np.maximum(low[None, :, j] - q, q - high[None, :, j]), 0.0) * (self.weights[c] / self.ranges[c])
            seen = ~np.isnan(gap)
            top += np.where(seen, gap, 0.0)
            bottom += np.where(seen, self.weights[c], 0.0)
        for j, c in enumerate(c for c in self.categorical if c in active):
            seen = (qc[:, j, None] != -1) & (codes[None, :, j] != -1)
            top += np.where(seen, self.weights[c] * (qc[:, j, None] != codes[None, :, j]), 0.0)
            bottom += np.where(seen, self.weights[c], 0.0)
        return np.where(bottom > 0, top / np.where(bottom > 0, bottom, 1.0), 1.0)

    def differences(self, qn: np.ndarray, qc: np.ndarray, rn: np.ndarray, rc: np.ndarray):
        """(unweighted differences, where both sides have the feature) of a block, feature by feature."""
        for j, c in enumerate(self.numeric):
            gap = np.abs(qn[:, j, None] - rn[None, :, j]) / self.ranges[c]
            yield gap, ~np.isnan(gap)
        for j in range(len(self.categorical)):
            yield (qc[:, j, None] != rc[None, :, j]).astype(float), (qc[:, j, None] != -1) & (rc[None, :, j] != -1)

    def block(self, qn: np.ndarray, qc: np.ndarray, rn: np.ndarray, rc: np.ndarray) -> np.ndarray:
        """Distances of a block: numerics as (rows, features) with NaN for null, categories coded with -1 for null and -2 for unseen."""
        active = set(self._active())
        top = np.zeros((len(qn), len(rn)))
        bottom = np.zeros((len(qn), len(rn)))
        for j, c in enumerate(c for c in self.numeric if c in active):
            gap = np.abs(qn[:, j, None] - rn[None, :, j]) / self.ranges[c]
            seen = ~np.isnan(gap)
            gap[~seen] = 0.0
            top += self.weights[c] * gap
            bottom += np.where(seen, self.weights[c], 0.0)
        for j, c in enumerate(c for c in self.categorical if c in active):
            seen = (qc[:, j, None] != -1) & (rc[None, :, j] != -1)
            top += np.where(seen, self.weights[c] * (qc[:, j, None] != rc[None, :, j]), 0.0)
            bottom += np.where(seen, self.weights[c], 0.0)
        return np.where(bottom > 0, top / np.where(bottom > 0, bottom, 1.0), 1.0)


def fit(reference: DataFrame, numeric: Sequence[str], categorical: Sequence[str], weights=None, parents: Mapping[str, str] | None = None) -> GowerModel:
    """Ranges of the reference rows in one aggregate: a zero range counts as 1, others are at least 1e-8; an all-null feature has range 1 and is never observed."""
    numeric, categorical = tuple(numeric), tuple(categorical)
    given = resolve_weights(weights, (*numeric, *categorical), parents or {}, categorical)
    got = reference.agg(*(f(F.col(c)).alias(f"{k}{i}") for i, c in enumerate(numeric) for k, f in (("lo", F.min), ("hi", F.max)))).first() if numeric else {}
    ranges = {}
    for i, c in enumerate(numeric):
        lo, hi = got[f"lo{i}"], got[f"hi{i}"]
        span = 0.0 if lo is None else float(hi) - float(lo)
        ranges[c] = max(span, FLOOR) if span else 1.0
    return GowerModel(numeric, categorical, ranges, dict(zip((*numeric, *categorical), given)))


def sd_weights(reference: DataFrame, numeric: Sequence[str], categorical: Sequence[str], mult: float = 1.96) -> dict[str, float]:
    """range / (mult * sd) for numerics (1 where that isn't finite, at least 1e-8), 1 for categoricals."""
    if not mult > 0:
        raise ValueError("mult has to be positive")
    out = {}
    got = reference.agg(*(f(F.col(c)).alias(f"{k}{i}") for i, c in enumerate(numeric) for k, f in (("lo", F.min), ("hi", F.max), ("sd", F.stddev_samp)))).first() if numeric else {}
    for i, c in enumerate(numeric):
        lo, hi, sd = got[f"lo{i}"], got[f"hi{i}"], got[f"sd{i}"]
        w = (hi - lo) / (mult * sd) if sd else float("nan")
        out[c] = max(w, FLOOR) if np.isfinite(w) else 1.0
    return out | dict.fromkeys(categorical, 1.0)
