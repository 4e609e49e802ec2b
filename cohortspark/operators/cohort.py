"""From a population table to a typed cohort view."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import CohortSpec

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def clean_number(c: Column) -> Column:
    """As double, with NaN and infinities as null."""
    x = c.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def as_time(df: DataFrame, name: str) -> Column:
    """A date-time column; strings that don't parse are null."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return F.try_to_timestamp(F.col(name)).cast("timestamp_ntz")
    return F.col(name).cast("timestamp_ntz")


def with_days(df: DataFrame, names) -> DataFrame:
    """Add <name>_days: fractional days since the column's minimum over the whole table."""
    names = list(names)
    if not names:
        return df
    first = df.agg(*(F.min(as_time(df, c)).alias(c) for c in names)).first()
    for c in names:
        days = F.lit(None).cast("double") if first[c] is None else F.timestamp_diff("MICROSECOND", F.lit(first[c]).cast("timestamp_ntz"), as_time(df, c)) / F.lit(86_400_000_000.0)
        df = df.withColumn(f"{c}_days", days)
    return df


@dataclass(frozen=True)
class Cohort:
    """``rows``: the population with typed features and 0/1 exposure.

    Ties are always broken by id (numbers by value, other ids as strings), so
    nothing hangs on an input order that Spark doesn't keep.
    """

    rows: DataFrame
    spec: CohortSpec

    @classmethod
    def of(cls, df: DataFrame, spec: CohortSpec) -> Cohort:
        spec.validate(df)
        df = with_days(df, spec.datetime)
        number = set(spec.numeric_features())
        typed = {c: clean_number(F.col(c)) for c in number}
        typed |= {c: F.col(c).cast("string") for c in spec.categorical if c not in number}
        typed |= {spec.exposure: F.col(spec.exposure).cast("double").cast("int")}
        if not isinstance(df.schema[spec.id_col].dataType, _WHOLE):
            typed[spec.id_col] = F.col(spec.id_col).cast("string")
        return cls(df.withColumns(typed), spec)

    @property
    def exposed(self) -> DataFrame:
        return self.rows.where(F.col(self.spec.exposure) == 1)

    @property
    def controls(self) -> DataFrame:
        return self.rows.where(F.col(self.spec.exposure) == 0)

    def view(self, *extra: str) -> DataFrame:
        """Only declared features, id and exposure, so that scores can't slip into a distance."""
        return self.rows.select(self.spec.id_col, self.spec.exposure, *self.spec.features(), *extra)


def hide(df: DataFrame, *columns: str) -> DataFrame:
    """Drop columns if they exist."""
    return df.drop(*columns)
