"""Readers: Parquet, CSV (plain or zipped), whitespace-delimited text and replicated tensors."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; give a schema to save the pass that infers one."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def zipped_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The CSV members (with headers) of ZIP archives; each member is unpacked by a task of its own."""
    found = archives.csv_rows(spark, path)
    kinds = spark.createDataFrame([], schema).schema.fields
    return found.select(*(F.nullif(F.try_element_at("fields", F.lit(f.name)), F.lit("")).try_cast(f.dataType).alias(f.name) for f in kinds))


def whitespace(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Numbers separated by any whitespace, without a header; blank lines are left out, missing or bad fields are null."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = F.split(F.trim("value"), r"\s+")
    return lines.select(*(F.try_element_at(parts, F.lit(i + 1)).try_cast("double").alias(n) for i, n in enumerate(names)))


def _study_schema(numeric: Sequence[str], binary: Sequence[str]) -> str:
    return "patient_id string, exposure_status int, outcome double, mu0 double, mu1 double, rep int, " + ", ".join([f"`{c}` double" for c in numeric] + [f"`{c}` string" for c in binary])


def _study_frame(split: str, a: Mapping[str, np.ndarray], r: int, numeric: Sequence[str], binary: Sequence[str], prefix: str, first: int = 0) -> pd.DataFrame:
    """One replication of one split, or of its rows from ``first`` on."""
    x = a["x"][:, :, r]
    out = {"patient_id": [f"{prefix}-{split}-{first + i}" for i in range(len(x))], "exposure_status": a["t"][:, r].astype(np.int32)}
    out |= {c: a[k][:, r].astype(float) for c, k in (("outcome", "yf"), ("mu0", "mu0"), ("mu1", "mu1"))}
    out["rep"] = np.full(len(x), r, np.int32)
    out |= {c: x[:, j].astype(float) for j, c in enumerate(numeric)}
    out |= {c: x[:, len(numeric) + j].astype(np.int64).astype(str) for j, c in enumerate(binary)}
    return pd.DataFrame(out)


def tensors(spark: SparkSession, splits: Mapping[str, Mapping[str, np.ndarray]], numeric: Sequence[str], binary: Sequence[str], replication: int | None = None, prefix: str = "IHDP") -> DataFrame:
    """Replicated studies from arrays x (rows, features, replications), t, yf, mu0, mu1 (rows, replications).

    All splits are stacked; ids are <prefix>-<split>-<row>; binary features are
    strings.  One replication, or all with their number in ``rep``.
    """
    frames = [_study_frame(split, a, r, numeric, binary, prefix) for split, a in splits.items() for r in (range(a["x"].shape[2]) if replication is None else [replication])]
    return spark.createDataFrame(pd.concat(frames), _study_schema(numeric, binary))


#: Rows of an .npz file's arrays that a task reads at a time.
NPZ_ROWS = 4096


def npz(spark: SparkSession, paths: Mapping[str, str], numeric: Sequence[str], binary: Sequence[str], replication: int | None = None, prefix: str = "IHDP", rows: int = NPZ_ROWS) -> DataFrame:
    """``tensors`` from .npz files, one for each split; ranges of rows are dealt to tasks, and of a range all replications come one after another."""
    out: DataFrame | None = None
    for split, path in paths.items():

        def read(frames: Iterator[pd.DataFrame], split: str = split) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for p, lo, hi in zip(frame["path"], frame["lo"], frame["hi"]):
                    with archives.Arrays(p) as file:
                        a = {k: file.rows(k, int(lo), int(hi)) for k in ("x", "t", "yf", "mu0", "mu1")}
                    for r in range(a["x"].shape[2]) if replication is None else [replication]:
                        yield _study_frame(split, a, r, numeric, binary, prefix, int(lo))

        found = archives.row_ranges(spark, path, "x", rows).mapInPandas(read, _study_schema(numeric, binary))
        out = found if out is None else out.unionByName(found)
    return out
