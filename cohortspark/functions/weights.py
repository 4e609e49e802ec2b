"""Distance weights: positional, by feature name, nested by level, or calibrated by standard deviations."""

from __future__ import annotations

import logging
import math
from collections.abc import Mapping, Sequence
from numbers import Real

log = logging.getLogger("cohortspark")


def _number(value, what: str) -> float:
    if isinstance(value, bool) or not isinstance(value, Real):
        raise ValueError(f"the weight of {what} has to be a number")
    if not math.isfinite(value) or value < 0:
        raise ValueError(f"the weight of {what} has to be finite and not negative")
    return float(value)


def resolve_weights(weights: Mapping | Sequence[float] | None, columns: Sequence[str], parents: Mapping[str, str], categorical: Sequence[str]) -> list[float]:
    """One weight for each column.

    A sequence is taken by position (deprecated).  A mapping has original
    features as keys; a number holds for all columns of the feature, a mapping
    (categoricals only) for its columns by full name or by level, and those it
    leaves out get 1 with a warning.  Features not named get 1.
    """
    if weights is None:
        return [1.0] * len(columns)
    if isinstance(weights, Mapping):
        children: dict[str, list[str]] = {}
        for c in columns:
            children.setdefault(parents.get(c, c), []).append(c)
        if unknown := [k for k in weights if k not in children]:
            raise ValueError(f"weights for unknown features: {unknown}")
        out = dict.fromkeys(columns, 1.0)
        for feature, value in weights.items():
            if not isinstance(value, Mapping):
                out |= dict.fromkeys(children[feature], _number(value, feature))
                continue
            if feature not in categorical:
                raise ValueError(f"{feature} isn't categorical: its weight has to be a number")
            names = {**{c.removeprefix(f"{feature}_"): c for c in children[feature]}, **{c: c for c in children[feature]}}
            given = set()
            for child, w in value.items():
                if isinstance(w, Mapping):
                    raise ValueError("weights nest two levels deep at most")
                if child not in names:
                    raise ValueError(f"{feature} has no column {child!r}")
                out[names[child]] = _number(w, f"{feature}/{child}")
                given.add(names[child])
            if rest := [c for c in children[feature] if c not in given]:
                log.warning("columns of %s without a weight get 1: %s", feature, rest)
        return [out[c] for c in columns]
    if isinstance(weights, (str, bytes)) or not hasattr(weights, "__len__"):
        raise ValueError("weights have to be a mapping or a sequence of numbers")
    log.warning("weights by position are deprecated; use a mapping by feature name")
    if len(weights) != len(columns):
        raise ValueError(f"{len(weights)} weights for {len(columns)} columns")
    return [_number(float(w), c) for w, c in zip(weights, columns)]


def weights_by_kind(numeric: Sequence[str], categorical: Sequence[str], numeric_weight: float = 1.0, categorical_weight: float = 1.0) -> dict[str, float]:
    """One weight for all numeric and one for all categorical features."""
    return {**dict.fromkeys(numeric, numeric_weight), **dict.fromkeys(categorical, categorical_weight)}
