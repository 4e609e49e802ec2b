"""Synthetic cohorts and weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def random_weights(n: int, seed: int | None = None, min_weight: float = 0.01) -> list[float]:
    """n weights of two decimals that add up to 1, none under ``min_weight``."""
    if n < 1 or n * min_weight > 1:
        raise ValueError("n weights of that size don't add up to 1")
    draw = np.random.default_rng(seed).dirichlet(np.ones(n))
    weights = np.round(min_weight + (1 - n * min_weight) * draw, 2)
    rest = round(1 - float(weights.sum()), 2)
    for i in range(n):  # the first weight that stays large enough takes up the rounding
        if weights[i] + rest >= min_weight:
            weights[i] = round(float(weights[i] + rest), 2)
            break
    return weights.tolist()


def make_cohort(spark: SparkSession, n: int, n_exposed: int, features: Sequence[Mapping], seed: int = 404) -> DataFrame:
    """patient_id, exposure_status and the features, independent of each other given exposure.

    A feature is {"name", "kind": "numeric", "dist": a NumPy Generator method,
    "exposed": arguments, "control": arguments} or {"name", "kind":
    "categorical", "exposed": {level: probability}, "control": ...}.  Negative
    numbers become 0.
    """
    if not 0 < n_exposed < n:
        raise ValueError("n_exposed has to be between 1 and n - 1")
    rng = np.random.default_rng(seed)
    exposure = np.zeros(n, np.int64)
    exposure[rng.permutation(n)[:n_exposed]] = 1
    columns: dict[str, list] = {"patient_id": list(range(1, n + 1)), "exposure_status": exposure.tolist()}
    kinds = ["patient_id long", "exposure_status int"]
    for f in features:
        out = np.empty(n, object)
        for value, side in ((1, "exposed"), (0, "control")):
            at = exposure == value
            if f["kind"] == "categorical":
                levels = list(f[side])
                p = np.array([f[side][x] for x in levels], float)
                out[at] = rng.choice(levels, size=int(at.sum()), p=p / p.sum())
            else:
                drawn = np.asarray(getattr(rng, f["dist"])(*f[side], size=int(at.sum())), float)
                out[at] = np.maximum(drawn, 0.0)
        columns[f["name"]] = [str(x) if f["kind"] == "categorical" else float(x) for x in out]
        kinds.append(f"`{f['name']}` {'string' if f['kind'] == 'categorical' else 'double'}")
    return spark.createDataFrame(list(zip(*columns.values())), ", ".join(kinds))


def make_large_cohort(spark: SparkSession, n: int, share_exposed: float, seed: int = 404) -> DataFrame:
    """The same idea made on the executors, for load tests: three numerics and two categoricals."""
    rows = spark.range(n).select(F.col("id").alias("patient_id"), (F.rand(seed) < share_exposed).cast("int").alias("exposure_status"))
    shift = F.col("exposure_status") * 0.5
    level = lambda k, s: F.concat(F.lit("L"), F.floor(F.rand(s) * k).cast("string"))
    return rows.select("*", (F.randn(seed + 1) + shift).alias("x1"), F.exp(F.randn(seed + 2) * 0.5 + shift).alias("x2"), F.floor(F.rand(seed + 3) * 20).cast("double").alias("x3"), level(4, seed + 4).alias("c1"), level(7, seed + 5).alias("c2"))
