"""Numeric distances: Mahalanobis, Euclidean, cosine and raw logits."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .knn import Metric


def moments(df: DataFrame, columns: Sequence[Column]) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, means and sample covariance of complete rows, by one aggregate of p(p+1)/2 covariances."""
    p = len(columns)
    rows = df.select(*(x.alias(f"x{i}") for i, x in enumerate(columns))).na.drop()
    got = rows.agg(F.count("*").alias("n"), *(F.avg(f"x{i}").alias(f"m{i}") for i in range(p)), *(F.covar_samp(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i in range(p) for j in range(i, p))).first()
    cov = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            cov[i, j] = cov[j, i] = got[f"c{i}_{j}"] or 0.0
    return got["n"], np.array([got[f"m{i}"] or 0.0 for i in range(p)]), cov


def linear(columns: Sequence[Column], matrix: np.ndarray) -> list[Column]:
    """matrix @ columns, as expressions."""
    out = []
    for row in matrix:
        total = F.lit(0.0)
        for x, w in zip(columns, row):
            total = total + x * float(w)
        out.append(total)
    return out


@dataclass(frozen=True)
class MahalanobisModel:
    """Location, covariance, precision and a whitener L' with precision = L L'; distances are Euclidean after whitening."""

    columns: tuple[str, ...]
    location: np.ndarray
    covariance: np.ndarray
    precision: np.ndarray
    whitener: np.ndarray
    n_reference: int
    shifted: np.ndarray | None = None

    def whitened(self) -> list[Column]:
        return linear([F.col(f"`{c}`").cast("double") for c in self.columns], self.whitener)

    def metric(self) -> Metric:
        """For nearest-neighbour joins: of two columns by the covariance's cofactors over its determinant; of more, or of columns that nearly determine each other, by whitened columns, where less is lost to rounding."""
        if self.shifted is not None and len(self.columns) == 2:
            (a, ab), (_, b) = self.shifted.tolist()
            if a * b - ab * ab > 1e-6 * a * b:
                plain = [F.col(f"`{c}`").cast("double") for c in self.columns]
                return MahalanobisMetric((*self.whitened(), *plain), (b, -ab, a), a * b - ab * ab)
        return VectorMetric("l2", tuple(self.whitened()))

    def distance(self, left: str = "q_", right: str = "r_") -> Column:
        gaps = [F.col(f"{left}{c}") - F.col(f"{right}{c}") for c in self.columns]
        return F.sqrt(F.greatest(sum((z * z for z in linear(gaps, self.whitener)), F.lit(0.0)), F.lit(0.0)))


def _whitener(precision: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.cholesky(precision).T
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh((precision + precision.T) / 2)
        return np.sqrt(np.maximum(values, 0))[:, None] * vectors.T


def fit_mahalanobis(reference: DataFrame, columns: Sequence[str], pooled: DataFrame | None = None, precision: np.ndarray | None = None, ridge: float = 1e-6) -> MahalanobisModel:
    """Covariance of the reference rows or, if given, of the pooled ones; or the caller's precision matrix.

    Rows with a null are left out.  A covariance that can't be inverted gets a
    ridge, ten times larger on each failure, up to 1e-2.
    """
    columns = tuple(columns)
    kinds = dict(reference.dtypes)
    if not columns or any(kinds[c] in ("string", "boolean", "date") or kinds[c].startswith("timestamp") for c in columns):
        raise ValueError("Mahalanobis distance needs numeric columns")
    n, location, cov = moments(reference if pooled is None else pooled, [F.col(f"`{c}`").cast("double") for c in columns])
    if not n:
        raise ValueError("no complete row to fit on")
    p, shifted = len(columns), None
    if precision is not None:
        precision = np.asarray(precision, float)
        if precision.shape != (p, p):
            raise ValueError(f"the precision matrix has to be {p} x {p}")
    else:
        extra = ridge
        for _ in range(10):
            try:
                shifted = cov + extra * np.eye(p)
                np.linalg.cholesky(shifted)
                precision = np.linalg.inv(shifted)
                break
            except np.linalg.LinAlgError:
                extra = min(extra * 10, 1e-2)
        else:
            precision, shifted = np.linalg.pinv(cov + 1e-2 * np.eye(p)), None
    return MahalanobisModel(columns, location, cov, precision, _whitener(precision), n, shifted)


@dataclass(frozen=True)
class VectorMetric(Metric):
    """Euclidean ("l2"), cosine or absolute ("l1", one column) distance over numeric expressions that both sides have."""

    kind: str
    expressions: tuple[Column, ...]

    def __reduce__(self):
        # what goes to the executors is the kind alone; expressions stay with the plan
        return VectorMetric, (self.kind, ())

    def side(self, df: DataFrame) -> tuple[list[Column], list[Column]]:
        return list(self.expressions), []

    def box_floor(self, qn: np.ndarray, qc: np.ndarray, low: np.ndarray, high: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The least distance of each query to anything in each box; 0 where the kind of distance or a missing number gives none."""
        total = np.zeros((len(qn), len(low)))
        if self.kind == "cosine":
            return total
        for j in range(1 if self.kind == "l1" else qn.shape[1]):
            gap = np.maximum(np.maximum(low[None, :, j] - qn[:, j, None], qn[:, j, None] - high[None, :, j]), 0.0)
            total += np.nan_to_num(gap if self.kind == "l1" else gap * gap)
        return total if self.kind == "l1" else np.sqrt(total)

    def block(self, qn: np.ndarray, qc: np.ndarray, rn: np.ndarray, rc: np.ndarray) -> np.ndarray:
        if self.kind == "cosine":
            norms = np.sqrt((qn**2).sum(1))[:, None] * np.sqrt((rn**2).sum(1))[None]
            dots = qn @ rn.T
            return 1.0 - np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)
        if self.kind == "l1":
            return np.abs(qn[:, :1] - rn[:, 0][None])
        # differences, not the expanded square: equal rows are at distance 0
        total = np.zeros((len(qn), len(rn)))
        for j in range(qn.shape[1]):
            total += (qn[:, j, None] - rn[None, :, j]) ** 2
        return np.sqrt(total)


@dataclass(frozen=True)
class MahalanobisMetric(Metric):
    """Mahalanobis distance over two columns, from their differences: gaps that are equal in the data give equal distances.

    Differences of whitened columns are rounded on their own, which would order
    such pairs at random; they only serve to leave cells out.  The numbers of a
    side are both whitened columns, then both plain ones.
    """

    expressions: tuple[Column, ...]
    cofactors: tuple[float, float, float]
    determinant: float

    def __reduce__(self):
        return MahalanobisMetric, ((), self.cofactors, self.determinant)

    def side(self, df: DataFrame) -> tuple[list[Column], list[Column]]:
        return list(self.expressions), []

    def scales(self, p: int) -> np.ndarray:
        return np.array([1.0, 1.0, 0.0, 0.0])

    def box_floor(self, qn: np.ndarray, qc: np.ndarray, low: np.ndarray, high: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return VectorMetric("l2", ()).box_floor(qn[:, :2], qc, low[:, :2], high[:, :2], codes)

    def block(self, qn: np.ndarray, qc: np.ndarray, rn: np.ndarray, rc: np.ndarray) -> np.ndarray:
        xx, xy, yy = self.cofactors
        x, y = (qn[:, i, None] - rn[None, :, i] for i in (2, 3))
        return np.sqrt(np.maximum((xx * (x * x) + 2.0 * xy * x * y + yy * (y * y)) / self.determinant, 0.0))


def euclidean(left: Sequence[Column], right: Sequence[Column]) -> Column:
    return F.sqrt(sum(((a - b) * (a - b) for a, b in zip(left, right)), F.lit(0.0)))


def cosine(left: Sequence[Column], right: Sequence[Column]) -> Column:
    dot = sum((a * b for a, b in zip(left, right)), F.lit(0.0))
    norms = F.sqrt(sum((a * a for a in left), F.lit(0.0))) * F.sqrt(sum((b * b for b in right), F.lit(0.0)))
    return 1.0 - F.coalesce(F.try_divide(dot, norms), F.lit(0.0))


@dataclass(frozen=True)
class PcaModel:
    """Principal components of centred columns; the first ones that reach the wanted share of variance."""

    mean: np.ndarray
    components: np.ndarray
    explained: np.ndarray

    def project(self, columns: Sequence[Column]) -> list[Column]:
        return linear([x - float(m) for x, m in zip(columns, self.mean)], self.components)


def fit_pca(rows: DataFrame, columns: Sequence[Column], share: float = 0.95, most: int = 42) -> PcaModel:
    """Fit on the given rows; if the share isn't reached within ``most`` components, all of those are used."""
    n, mean, cov = moments(rows, columns)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)
    values, vectors = np.maximum(values[order], 0), vectors[:, order].T
    total = values.sum()
    explained = values / total if total > 0 else values
    # a component's sign is free: its largest entry is made positive
    vectors = vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])[:, None]
    most = min(most, len(values), max(n, 1))
    reached = np.flatnonzero(np.cumsum(explained[:most]) >= share - 1e-12)
    keep = int(reached[0]) + 1 if len(reached) else most
    return PcaModel(mean, vectors[:keep], explained)


def logit_sd(df: DataFrame, column: str) -> float:
    return df.agg(F.stddev_samp(column)).first()[0] or 0.0


def finite(x: float) -> bool:
    return math.isfinite(x)
