"""Propensity scores: design matrix, logistic fit on distributed sums, and training strategies."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formula import parse_formula, term_to_str
from ..functions.naming import feature_maps
from ..spec import CohortSpec
from . import preprocess

TOLERANCE, MAX_ITERATIONS = 1e-10, 100
#: Beyond this linear predictor the fit is asked whether the classes are separated; a steep slope alone isn't that.
SEPARATED = 30.0
#: They are, if in some direction the rows' weights mu (1 - mu) have fallen to this share of those at the start.
SPENT = 1e-11


def design(columns: list[str], spec: CohortSpec, formula: str | None) -> list[tuple[str, ...]]:
    """Terms over processed columns: names of original features stand for all their columns, interactions for all combinations."""
    up, down = feature_maps(columns, spec.numeric_features(), spec.categorical, ())
    if formula is None:
        return [(c,) for c in columns]
    terms = parse_formula(formula)
    mentioned = {name for t in terms for name in t}
    out: list[tuple[str, ...]] = []
    for name in mentioned:
        parent = up.get(name)
        if parent is not None and parent != name and parent in mentioned:
            raise ValueError(f"the formula mixes {parent} and its column {name}")
    for t in terms:
        groups = []
        for name in t:
            if name in down:
                groups.append(down[name])
            elif name in up:
                groups.append([name])
            else:
                raise ValueError(f"the formula names an unknown feature: {name}")
        combos: list[tuple[str, ...]] = [()]
        for g in groups:
            combos = [a + (b,) for a in combos for b in g]
        out += combos
    return list(dict.fromkeys(out))


def design_columns(pre: preprocess.Preprocessor, terms: list[tuple[str, ...]]) -> list[tuple[str, Column]]:
    """(name, expression) of each term; nulls become 0, the mean of a scaled feature."""
    by = dict(pre.outputs)
    out = []
    for t in terms:
        x = F.lit(1.0)
        for c in t:
            x = x * F.coalesce(by[c], F.lit(0.0))
        out.append((term_to_str(t), x))
    return out


@dataclass(frozen=True)
class LogisticModel:
    """Coefficients, the intercept first."""

    coefficients: np.ndarray
    iterations: int

    def logit(self, x: Column) -> Column:
        """Of an array column of design values."""
        w = F.array(*(F.lit(float(v)) for v in self.coefficients[1:]))
        return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(float(self.coefficients[0])), lambda acc, v: acc + v)


def _sums(betas: np.ndarray):
    """Of each group (rows of group -1 are in all) Hessian, gradient, likelihood and widest predictor, one row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = betas.shape[1]
        total = np.zeros((len(betas), p * p + p + 2))
        for b in batches:
            if not len(b):
                continue
            every = np.column_stack([np.ones(len(b)), b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)])
            labels, group = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            for k, beta in enumerate(betas):
                own = (group == k) | (group < 0)
                if not own.any():
                    continue
                x, y = every[own], labels[own]
                eta = x @ beta
                mu = 1 / (1 + np.exp(-eta))
                w = mu * (1 - mu)
                total[k, : p * p] += ((x * w[:, None]).T @ x).ravel()
                total[k, p * p : -2] += x.T @ (y - mu)
                total[k, -2] += np.sum(y * eta - np.logaddexp(0, eta))
                total[k, -1] = max(total[k, -1], np.abs(eta).max())
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["s"])

    return run


def _plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of two tasks; the last column is a largest value."""
    return np.column_stack([a[:, :-1] + b[:, :-1], np.maximum(a[:, -1], b[:, -1])])


def _added(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for row in b.column(0).to_pylist():
                x = np.array(row).reshape(groups, -1)
                total = x if total is None else _plus(total, x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["s"])

    return run


def fit_logistic(rows: DataFrame, tolerance: float = TOLERANCE, most: int = MAX_ITERATIONS) -> LogisticModel:
    """Unpenalised maximum likelihood by Newton steps on (x array<double>, y double)."""
    return fit_groups(rows.withColumn("g", F.lit(-1)), 1, tolerance, most)[0]


def _spent(hessian: np.ndarray, base: np.ndarray) -> bool:
    """Whether the likelihood is flat in a direction in which it was curved at the start, so that it has no maximum.

    Where classes overlap, the rows between them keep the curvature up however steep the fit is.
    """
    scale = 1 / np.sqrt(np.where(np.diag(base) > 0, np.diag(base), 1.0))
    values, vectors = np.linalg.eigh(base * scale[:, None] * scale)
    kept = values > 1e-12 * values[-1]
    turn = scale[:, None] * vectors[:, kept] / np.sqrt(values[kept])
    return bool(np.linalg.eigvalsh(turn.T @ hessian @ turn)[0] < SPENT)


@dataclass
class _Fit:
    """One group's Newton iteration between two passes."""

    beta: np.ndarray
    hessian: np.ndarray | None = None
    gradient: np.ndarray | None = None
    value: float = -math.inf
    step: np.ndarray | None = None
    base: np.ndarray | None = None
    halved: int = 0
    iterations: int = 0
    done: bool = False

    def tried(self) -> np.ndarray:
        return self.beta if self.step is None or self.done else self.beta + self.step

    def take(self, hessian: np.ndarray, gradient: np.ndarray, value: float, widest: float, tolerance: float) -> None:
        """What the last pass found at ``tried``."""
        if self.done:
            return
        if self.step is not None:
            if not value >= self.value - 1e-9 * abs(self.value) - 1e-12 and self.halved < 29:
                self.step, self.halved = self.step / 2, self.halved + 1
                return
            new = self.beta + self.step
            if not np.all(np.isfinite(new)) or widest > SEPARATED and _spent(hessian, self.base):
                raise RuntimeError("the logistic fit diverges: exposure is separable by the features")
            self.iterations += 1
            gain = abs(value - self.value)
            self.done = gain <= tolerance * (abs(value) + tolerance) and np.abs(self.step).max() < 1e-6
            self.beta, self.halved = new, 0
        else:
            self.base = hessian
        self.hessian, self.gradient, self.value = hessian, gradient, value
        if not self.done:
            try:
                self.step = np.linalg.solve(hessian, gradient)
            except np.linalg.LinAlgError:
                self.step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]


def fit_groups(rows: DataFrame, groups: int, tolerance: float = TOLERANCE, most: int = MAX_ITERATIONS) -> list[LogisticModel]:
    """A maximum-likelihood fit of each of the groups 0, 1, ... of (x array<double>, y double, g int); rows with g = -1 are in all.

    All groups take their Newton steps in the same pass over the rows.  A pass
    sums gradients and Hessians by partition, then over at most 64 tasks; the
    driver gets p by p numbers for each group from each of those.  Steps that
    lower a group's likelihood are halved.
    """
    rows = rows.select("x", F.col("y").cast("double").alias("y"), F.col("g").cast("int").alias("g")).persist()
    try:
        p = (rows.select(F.size("x")).first() or [0])[0] + 1
        parts = min(64, max(1, rows.rdd.getNumPartitions() // 16))
        fits = [_Fit(np.zeros(p)) for _ in range(groups)]
        passes = 0
        while not all(f.done for f in fits):
            if passes > most and min(f.iterations for f in fits if not f.done) >= most or passes > 31 * most:
                raise RuntimeError("the logistic fit doesn't converge")
            sums = rows.mapInArrow(_sums(np.array([f.tried() for f in fits])), "s array<double>")
            if parts > 1 or rows.rdd.getNumPartitions() > 64:
                sums = sums.repartition(parts).mapInArrow(_added(groups), "s array<double>")
            total = None
            for r in sums.collect():
                x = np.array(r[0]).reshape(groups, -1)
                total = x if total is None else _plus(total, x)
            for f, s in zip(fits, total):
                f.take(s[: p * p].reshape(p, p), s[p * p : -2], s[-2], s[-1], tolerance)
            passes += 1
        return [LogisticModel(f.beta, f.iterations) for f in fits]
    finally:
        rows.unpersist()


@dataclass(frozen=True)
class PropensityResult:
    """``scores``: (id, propensity_score, propensity_logit) of every row; ``metadata``: how they came about."""

    scores: DataFrame
    metadata: dict = field(default_factory=dict)


def _ordered(id_col: str, seed: int) -> Column:
    """A seeded pseudo-random number below 2**60 that doesn't hang on partitioning."""
    return F.conv(F.substr(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), F.lit(1), F.lit(15)), 16, 10).cast("long")


def downsample(controls: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """The n rows with the least numbers of ``_ordered``: whole stretches of numbers by their counts, and a sort within the last stretch only."""
    rows = controls.withColumn("_number", _ordered(id_col, seed))
    stretch = F.shiftright("_number", 44)
    sizes = sorted((r["s"], r["n"]) for r in rows.groupBy(stretch.alias("s")).agg(F.count("*").alias("n")).collect())
    whole, last = 0, None
    for s, size in sizes:
        if whole + size > n:
            last = s
            break
        whole += size
    if last is None:
        return rows.drop("_number")
    rest = rows.where(stretch == last).orderBy("_number", id_col).limit(n - whole)
    return rows.where(stretch < last).unionByName(rest).drop("_number")


def fit_propensity(df: DataFrame, spec: CohortSpec, formula: str | None = None, seed: int = 404, downsample_ratio: float | None = None, n_bags: int | None = None, n_hard_mining: int | None = None, estimator=None) -> PropensityResult:
    """Fit exposure on the features and score everyone.

    Strategies, one at most: ``downsample_ratio`` trains on that many controls
    for each case; ``n_bags`` splits controls into bags, fits each with all
    cases and averages probabilities and logits; ``n_hard_mining`` refits on the
    controls a first model finds likeliest.  ``estimator``: a pyspark.ml
    classifier instead of the built-in fit.
    """
    if sum(x is not None for x in (downsample_ratio, n_bags, n_hard_mining)) > 1:
        raise ValueError("training strategies exclude each other")
    pre = preprocess.for_propensity(df, spec)
    terms = design(pre.columns, spec, formula)
    columns = design_columns(pre, terms)
    rows = df.select(F.col(spec.id_col).alias("id"), F.col(spec.exposure).cast("double").alias("y"), F.array(*(x for _, x in columns)).alias("x"))
    cases, controls = rows.where("y = 1"), rows.where("y = 0")
    n_cases = cases.count()
    fits = []

    def trained(train: DataFrame, score: DataFrame) -> DataFrame:
        if estimator is not None:
            return _with_estimator(estimator, train, score)
        model = fit_logistic(train)
        fits.append(model)
        z = model.logit(F.col("x"))
        return score.select("id", "y", "x", (1 / (1 + F.exp(-z))).alias("p"), z.alias("z"))

    if downsample_ratio is not None:
        scored = trained(cases.unionByName(downsample(controls, "id", int(n_cases * downsample_ratio), seed)), rows)
    elif n_bags is not None:
        bag = F.pmod(_ordered("id", seed), F.lit(n_bags))
        if estimator is None:
            fits += fit_groups(rows.withColumn("g", F.when(F.col("y") == 1, -1).otherwise(bag)), n_bags)
            logits = [m.logit(F.col("x")) for m in fits]
            mean = lambda values: sum(values[1:], values[0]) / n_bags
            scored = rows.select("id", mean([1 / (1 + F.exp(-z)) for z in logits]).alias("p"), mean(logits).alias("z"))
        else:
            every = [_with_estimator(estimator, cases.unionByName(controls.where(bag == b)), rows).select("id", "p", "z") for b in range(n_bags)]
            union = every[0]
            for x in every[1:]:
                union = union.unionByName(x)
            scored = union.groupBy("id").agg(F.avg("p").alias("p"), F.avg("z").alias("z"))
    elif n_hard_mining is not None:
        scout = trained(cases.unionByName(downsample(controls, "id", 10 * n_cases, seed)), controls)
        hard = scout.orderBy(F.desc("p"), "id").limit(n_hard_mining).select("id", "y", "x")
        scored = trained(cases.unionByName(hard), rows)
    else:
        scored = trained(rows, rows)
    scores = scored.select(F.col("id").alias(spec.id_col), F.col("p").alias("propensity_score"), F.col("z").alias("propensity_logit"))
    bad = scores.where(F.col("propensity_logit").isNull() | F.isnan("propensity_logit") | (F.abs("propensity_logit") == float("inf"))).limit(1).count()
    if bad:
        raise RuntimeError("some propensity scores aren't finite")
    strategy = "downsample" if downsample_ratio is not None else "bagging" if n_bags is not None else "hard_mining" if n_hard_mining is not None else "full"
    metadata = {
        "formula": formula, "terms": [term_to_str(t) for t in terms], "design_columns": [c for c, _ in columns], "reference_levels": dict(pre.dropped), "strategy": strategy, "seed": seed,
        "solver": "newton" if estimator is None else type(estimator).__name__, "iterations": [m.iterations for m in fits], "coefficients": [m.coefficients.tolist() for m in fits],
    }
    return PropensityResult(scores, metadata)


def _with_estimator(estimator, train: DataFrame, score: DataFrame) -> DataFrame:
    """Any pyspark.ml classifier with a probability column."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    stage = estimator() if isinstance(estimator, type) else estimator.copy()
    stage.setParams(featuresCol="features", labelCol="y")
    ready = lambda df: df.withColumn("features", array_to_vector("x"))
    p = F.greatest(F.least(vector_to_array(F.col("probability"))[1], F.lit(1 - 1e-12)), F.lit(1e-12))
    out = stage.fit(ready(train)).transform(ready(score))
    return out.select("id", "y", "x", p.alias("p"), F.log(p / (1 - p)).alias("z"))


def attach(df: DataFrame, scores: DataFrame, id_col: str) -> DataFrame:
    """Scores joined on by id, earlier ones replaced; every row has to get one."""
    out = df.drop("propensity_score", "propensity_logit").join(scores, id_col, "left")
    if out.where("propensity_logit is null").limit(1).count():
        raise ValueError("some rows have no propensity score")
    return out


def finite(x: float) -> bool:
    return math.isfinite(x)
