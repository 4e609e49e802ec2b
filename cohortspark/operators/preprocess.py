"""Feature preprocessing as column expressions over statistics of one aggregate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import BIN_METHODS, CohortSpec
from .quantiles import ONE_BUFFER, quantile

#: More levels than this in one categorical feature aren't encoded as columns.
MAX_LEVELS = 2000


def binned(x: Column, width: float) -> Column:
    return F.floor((x - 1) / width) + 1.0


def scaled(x: Column, mean: float | None, sd: float | None) -> Column:
    """Standard score; nulls stay, a missing or zero deviation counts as one."""
    return (x - (mean or 0.0)) / (sd or 1.0)


@dataclass(frozen=True)
class Preprocessor:
    """A fitted pipeline: name and expression of every output column, in order, and which level each one-hot drops."""

    outputs: tuple[tuple[str, Column], ...]
    dropped: dict[str, str | None]

    @property
    def columns(self) -> list[str]:
        return [name for name, _ in self.outputs]

    def transform(self, df: DataFrame, *keep: str) -> DataFrame:
        return df.select(*keep, *(x.alias(name) for name, x in self.outputs))


def levels_of(df: DataFrame, columns, limit: int = MAX_LEVELS) -> dict[str, list[str | None]]:
    """Sorted distinct levels of each column, a null level last; the number of levels is checked."""
    columns = list(columns)
    if not columns:
        return {}
    stacked = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("f"), F.col(c).cast("string").alias("v")) for c in columns))).alias("x")).select("x.f", "x.v").distinct()
    found = stacked.limit(limit * len(columns) + 1).collect()
    out: dict[str, list[str | None]] = {c: [] for c in columns}
    for f, v in found:
        out[f].append(v)
    if over := [c for c, x in out.items() if len(x) > limit]:
        raise ValueError(f"more than {limit} levels: {over}")
    return {c: sorted((v for v in x if v is not None)) + [None] * (None in x) for c, x in out.items()}


def onehot(column: str, levels: list[str | None], drop: str | None) -> tuple[list[tuple[str, Column]], str | None]:
    """(name, 0/1 column) of the levels kept, and the level dropped; null is a level of its own."""
    out = drop == "first" or (drop == "if_binary" and len(levels) == 2)
    kept, gone = (levels[1:], levels[0]) if out and levels else (levels, None)
    value = F.col(column).cast("string")
    return [(f"{column}_{v}", F.when(value.eqNullSafe(F.lit(v).cast("string")), 1.0).otherwise(0.0)) for v in kept], gone


def fit(df: DataFrame, spec: CohortSpec, encode: bool | None = None, scale_encoded: bool | None = None, bin_method: str | None | object = ...) -> Preprocessor:
    """Fit on the whole population: binning before log before plain, then encoding."""
    encode = spec.onehot if encode is None else encode
    scale_encoded = spec.onehot_scale if scale_encoded is None else scale_encoded
    method = spec.bin_method if bin_method is ... else bin_method
    if method not in BIN_METHODS:
        raise ValueError(f"bin_method has to be one of {BIN_METHODS}")
    raw: list[tuple[str, Column, bool]] = []
    for c in spec.numeric_features():
        x = F.col(c)
        if c in spec.bins and method in ("binned", "binned_scaler"):
            raw.append((f"binned({c})", binned(x, spec.bin_width), method == "binned_scaler"))
        elif c in spec.log:
            raw.append((f"log({c})", F.log1p(x), True))
        else:
            raw.append((c, x, method is not None))
    dropped: dict[str, str | None] = {}
    coded: list[tuple[str, Column, bool]] = []
    if encode or scale_encoded:
        for c, levels in levels_of(df, spec.categorical).items():
            pairs, dropped[c] = onehot(c, levels, spec.onehot_drop)
            coded += [(name, x, scale_encoded and not encode) for name, x in pairs]
    else:
        coded = [(c, F.col(c), False) for c in spec.categorical]
    both = raw + coded
    moving = [(i, x) for i, (_, x, scale) in enumerate(both) if scale]
    stats = df.agg(*(f(x).alias(f"{k}{i}") for i, x in moving for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first() if moving else {}
    outputs = tuple((name, scaled(x, stats[f"m{i}"], stats[f"s{i}"]) if scale else x) for i, (name, x, scale) in enumerate(both))
    return Preprocessor(outputs, dropped)


def for_propensity(df: DataFrame, spec: CohortSpec) -> Preprocessor:
    """Always one-hot encoded, numerics scaled."""
    return fit(df, spec, encode=True, scale_encoded=False, bin_method="scaler")


def dummies(df: DataFrame, columns, drop_first: bool = True) -> Preprocessor:
    """Plain 0/1 encoding of the given columns."""
    outputs: list[tuple[str, Column]] = []
    dropped: dict[str, str | None] = {}
    for c, levels in levels_of(df, columns).items():
        pairs, dropped[c] = onehot(c, [v for v in levels if v is not None], "first" if drop_first else None)
        outputs += pairs
    return Preprocessor(tuple(outputs), dropped)


def label_codes(df: DataFrame, columns) -> dict[str, Column]:
    """Each level's place in sort order, null kept null."""
    out = {}
    for c, levels in levels_of(df, columns).items():
        known = [v for v in levels if v is not None]
        out[c] = F.array_position(F.array(*map(F.lit, known)), F.col(c).cast("string")) - 1 if known else F.lit(None).cast("long")
    return out


def impute(df: DataFrame, numeric=(), categorical=(), how: str = "median") -> DataFrame:
    """Fill numeric columns by exact median or mean, categorical ones by the mode (ties: the smallest)."""
    if how not in ("median", "mean"):
        raise ValueError("how has to be 'median' or 'mean'")
    if numeric:
        few = how == "mean" or df.count() <= ONE_BUFFER
        got = df.agg(*((F.avg(c) if how == "mean" else F.percentile(F.col(c), F.lit(0.5))).alias(c) for c in numeric)).first() if few else {c: quantile(df, c, 0.5) for c in numeric}
        df = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(got[c])) for c in numeric})
    for c in categorical:
        top = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).count().orderBy(F.desc("count"), "v").limit(1).collect()
        if top:
            df = df.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(top[0]["v"])))
    return df


def plain_matrix(columns, weights=None) -> list[Column]:
    """Numeric columns for Euclidean and cosine distances: nulls, NaN and infinities become 0, then weighted."""
    weights = weights or [1.0] * len(columns)
    zero = lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)
    return [zero(F.col(f"`{c}`").cast("double")) * float(w) for c, w in zip(columns, weights)]
