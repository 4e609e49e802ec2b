"""Writers, and the gathering of result chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def gather_chunks(spark: SparkSession, glob: str, keys: Sequence[str], expected: int | None = None, schema: str | None = None) -> DataFrame:
    """All CSV chunks of a run, sorted by their keys; a repeated key or a wrong number of rows raises."""
    reader = spark.read.option("header", True)
    rows = reader.schema(schema).csv(glob) if schema else reader.option("inferSchema", True).csv(glob)
    if rows.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError("some keys are in several chunks")
    if expected is not None and (n := rows.count()) != expected:
        raise ValueError(f"{n} rows instead of {expected}")
    return rows.orderBy(*map(F.col, keys))
