"""What a caller declares: the roles of the columns, and how to match."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BIN_METHODS = ("scaler", "binned", "binned_scaler", None)
METRICS = ("gower", "mahalanobis", "euclidean", "cosine")
METHODS = ("multi", "propensity")


@dataclass(frozen=True)
class CohortSpec:
    """Column roles of a population table.

    ``features_log`` and ``features_bin`` are numeric features that the
    preprocessing transforms; date-time features become ``<name>_days``.
    """

    id_col: str
    exposure: str
    numeric: Sequence[str] = ()
    categorical: Sequence[str] = ()
    datetime: Sequence[str] = ()
    log: Sequence[str] = ()
    bins: Sequence[str] = ()
    bin_method: str | None = None
    bin_width: float = 10
    onehot: bool = False
    onehot_scale: bool = False
    onehot_drop: str | None = "first"

    def __post_init__(self):
        for name in ("numeric", "categorical", "datetime", "log", "bins"):
            object.__setattr__(self, name, tuple(dict.fromkeys(getattr(self, name) or ())))

    def numeric_features(self) -> tuple[str, ...]:
        return (*self.numeric, *(x for c in self.datetime if (x := f"{c}_days") not in self.numeric))

    def features(self) -> tuple[str, ...]:
        """Declared features, numeric then categorical, without repeats."""
        return tuple(dict.fromkeys((*self.numeric_features(), *self.categorical)))

    def validate(self, df: DataFrame) -> None:
        """Raise ValueError for bad roles or columns; one job looks at ids and exposures."""
        if not isinstance(df, DataFrame):
            raise ValueError("the population has to be a DataFrame")
        for name in ("log", "bins"):
            if extra := set(getattr(self, name)) - set(self.numeric):
                raise ValueError(f"{name} features have to be numeric features: {sorted(extra)}")
        if self.bin_method not in BIN_METHODS:
            raise ValueError(f"bin_method has to be one of {BIN_METHODS}")
        wanted = [self.id_col, self.exposure, *self.numeric, *self.categorical, *self.datetime]
        if missing := [c for c in wanted if c not in df.columns]:
            raise ValueError(f"columns missing: {missing}")
        kinds = {f.name: f.dataType for f in df.schema.fields}
        if bad := [c for c in wanted if isinstance(kinds[c], (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]:
            raise ValueError(f"columns of unsupported types: {bad}")
        x = F.col(self.exposure).cast("double")
        # ids meet in partial aggregates first, so one shuffle of ids answers everything
        by_id = df.groupBy(self.id_col).agg(F.count("*").alias("n"), F.count_if(F.col(self.exposure).isNull()).alias("none"), F.count_if(~x.isin(0.0, 1.0)).alias("other"), F.count_if(x == 1).alias("one"), F.count_if(x == 0).alias("zero"))
        got = by_id.agg(
            F.sum(F.when(F.col(self.id_col).isNull(), F.col("n")).otherwise(0)).alias("no_id"), F.max(F.when(F.col(self.id_col).isNotNull(), F.col("n"))).alias("most"), F.sum("none").alias("no_exposure"),
            F.sum("other").alias("other"), F.sum("one").alias("exposed"), F.sum("zero").alias("controls")).first()
        if got["no_id"]:
            raise ValueError(f"{got['no_id']} rows have no {self.id_col}")
        if got["no_exposure"]:
            raise ValueError(f"{got['no_exposure']} rows have no {self.exposure}")
        if got["other"]:
            raise ValueError(f"{self.exposure} has to be 0 or 1")
        if not got["exposed"] or not got["controls"]:
            raise ValueError("at least one exposed and one control row are needed")
        if got["most"] > 1:
            raise ValueError(f"{self.id_col} isn't unique")


@dataclass(frozen=True)
class MatchSpec:
    """How to match; see ``plans.matcher``.

    Options that only steer the threads and blocks of a single machine (n_jobs,
    streaming, batch sizes, memory limits, neighbour back ends) have no part
    here: partitions take their place.
    """

    threshold: float = math.inf
    n_neighbors: int = 1
    k_candidates: int | None = None
    method: str = "multi"
    metric: str = "gower"
    global_optimal: bool = True
    competitive_match: bool = True
    replacement: bool = False
    safe_matches: int | None = None
    fuzzy_limit: float | None = None
    mcf: bool = False
    gower_weights: Mapping | Sequence[float] | None = None
    gower_sd_weights: bool = False
    gower_sd_reference: str = "controls"
    gower_sd_mult: float = 1.96
    gower_cat_features: Sequence[str] | None = None
    weight_numeric: float = 1.0
    weight_propensity: float = 1.0
    propensity_col: str = "propensity_logit"
    propensity_caliper: float | None = None
    ps_hybrid: bool = False
    ps_caliper: float = 0.2
    ps_caliper_strict: bool = True
    pca_filter: bool = False
    distance_eps: float = 0.0
    include_unmatched: bool = True
    extra_numeric: Sequence[str] = field(default=())

    def __post_init__(self):
        if self.replacement:
            raise NotImplementedError("matching with replacement isn't implemented")
        if self.method not in METHODS:
            raise ValueError(f"method has to be one of {METHODS}")
        if self.metric not in METRICS:
            raise ValueError(f"metric has to be one of {METRICS}")
        if self.n_neighbors < 1 or (self.k_candidates is not None and self.k_candidates < 1):
            raise ValueError("n_neighbors and k_candidates have to be at least 1")
        if self.method == "propensity" and self.metric != "euclidean":
            raise ValueError("method 'propensity' compares raw logits: metric has to be 'euclidean'")
        if self.gower_sd_weights:
            if self.metric != "gower" or self.method != "multi":
                raise ValueError("gower_sd_weights needs metric 'gower' and method 'multi'")
            if self.gower_weights is not None:
                raise ValueError("gower_sd_weights and gower_weights exclude each other")
            if self.gower_sd_reference not in ("controls", "pooled"):
                raise ValueError("gower_sd_reference has to be 'controls' or 'pooled'")
            if not self.gower_sd_mult > 0:
                raise ValueError("gower_sd_mult has to be positive")
        if self.ps_hybrid and (self.metric not in ("gower", "mahalanobis") or self.method != "multi"):
            raise ValueError("ps_hybrid needs metric 'gower' or 'mahalanobis' and method 'multi'")
        for name in ("ps_caliper", "propensity_caliper"):
            if (x := getattr(self, name)) is not None and x < 0:
                raise ValueError(f"{name} mustn't be negative")

    @property
    def safe(self) -> int:
        return self.n_neighbors if self.safe_matches is None else self.safe_matches
