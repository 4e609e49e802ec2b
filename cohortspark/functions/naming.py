"""How processed columns are named, and which original feature each stems from."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


def original_of(column: str, numeric: Iterable[str], categorical: Iterable[str], datetime: Iterable[str] = ()) -> str:
    """The original feature of a processed column: log(x), binned(x), <x>_days and <x>_<level> are unwrapped."""
    for wrap in ("log(", "binned("):
        if column.startswith(wrap) and column.endswith(")"):
            return column[len(wrap) : -1]
    numeric, categorical = list(numeric), list(categorical)
    if column in numeric or column in categorical:
        return column
    for c in datetime:
        if column == f"{c}_days":
            return c
    owners = [c for c in categorical if column.startswith(f"{c}_")]
    return max(owners, key=len) if owners else column


def feature_maps(columns: Sequence[str], numeric: Iterable[str], categorical: Iterable[str], datetime: Iterable[str] = ()) -> tuple[dict[str, str], dict[str, list[str]]]:
    """(processed to original, original to its processed columns)."""
    numeric, categorical, datetime = list(numeric), list(categorical), list(datetime)
    up = {c: original_of(c, numeric, categorical, datetime) for c in columns}
    down: dict[str, list[str]] = {}
    for c, o in up.items():
        down.setdefault(o, []).append(c)
    return up, down
