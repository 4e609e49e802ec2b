"""Shaping of observational study files into cohorts; the files themselves are the caller's."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import numbered
from .tables import npz, whitespace

#: Column order of the labour-market files (the older ones have no 1974 earnings), and features of the studies.
LALONDE_COLUMNS = ("treat", "age", "education", "black", "hispanic", "married", "nodegree", "RE74", "RE75", "RE78")
LALONDE_SHORT_COLUMNS = ("treat", "age", "education", "black", "hispanic", "married", "nodegree", "RE75", "RE78")
LALONDE_NUMERIC = ("age", "education", "RE74", "RE75")
LALONDE_BINARY = ("black", "hispanic", "married", "nodegree")
VLBW_NUMERIC = ("bwt", "gest", "apg1", "year")
VLBW_CATEGORICAL = ("race", "sex", "inout", "twn", "delivery")
IHDP_NUMERIC = ("birthweight", "birthhead", "birthlength", "gestage", "apgar1", "apgar5")
IHDP_BINARY = (
    "sex", "twin", "breech", "delivery", "fraclprem", "cigdrg", "alcohol", "momage", "momed", "married", "dmed", "prenatal", "workdur", "nnhealth", "infant_age", "sexofchild", "momwhite", "site1", "site2",
)
RHC_NUMERIC = (
    "age", "edu", "surv2md1", "das2d3pc", "adld3p", "aps1", "scoma1", "wtkilo1", "temp1", "meanbp1", "resp1", "hrt1", "pafi1", "paco21", "ph1", "wblc1", "hema1", "sod1", "pot1", "crea1", "bili1", "alb1", "urin1",
)
RHC_CATEGORICAL = (
    "sex", "race", "income", "ninsclas", "cat1", "cat2", "ca", "resp", "card", "neuro", "gastr", "renal", "meta", "hema", "seps", "trauma", "ortho",
    "cardiohx", "chfhx", "dementhx", "psychhx", "chrpulhx", "renalhx", "liverhx", "gibledhx", "malighx", "immunhx", "transhx", "amihx", "dnr1",
)

load_lalonde_file = whitespace


def load_ihdp(spark: SparkSession, paths: Mapping[str, str], replication: int | None = None) -> DataFrame:
    """The replicated infant study from its .npz files, by split."""
    return npz(spark, paths, IHDP_NUMERIC, IHDP_BINARY, replication)


def _is(c: str, *values: str) -> Column:
    return F.lower(F.trim(F.col(c).cast("string"))).isin(*values).cast("int")


def rhc(raw: DataFrame, numeric: Sequence[str] = RHC_NUMERIC, categorical: Sequence[str] = RHC_CATEGORICAL, treatment: str = "swang1", outcome: str = "dth30", id_col: str = "ptid") -> DataFrame:
    """Right heart catheterisation: treated rows say RHC, outcomes say Yes; numerics that don't parse are null."""
    numeric, kept = ([c for c in names if c in raw.columns] for names in (numeric, categorical))
    return raw.select(
        F.col(id_col).cast("string").alias("patient_id"), _is(treatment, "rhc", "1").alias("exposure_status"), _is(outcome, "yes", "1").alias("outcome"),
        *(F.col(c).try_cast("double").alias(c) for c in numeric), *(F.col(c).cast("string").alias(c) for c in kept))


def lalonde(treated: DataFrame, *controls: DataFrame) -> DataFrame:
    """Treated rows of the experiment with external controls; ids are P<n> in the order of all values.  Files without 1974 earnings give no RE74."""
    rows = treated.where("treat = 1")
    for c in controls:
        rows = rows.unionByName(c.where("treat = 0"), allowMissingColumns=True)
    order = [c for c in LALONDE_COLUMNS[1:] if c in rows.columns]
    rows = numbered(rows, F.desc("treat"), *order)
    return rows.select(
        F.concat(F.lit("P"), F.col("number").cast("string")).alias("patient_id"), F.col("treat").cast("int").alias("exposure_status"), F.col("RE78").alias("outcome"),
        *(c for c in LALONDE_NUMERIC if c in order), *(F.col(c).cast("int").cast("string").alias(c) for c in LALONDE_BINARY))


def vlbw(raw: DataFrame, id_col: str | None = None) -> DataFrame:
    """Very low birth weight: pneumothorax as exposure, death as outcome, complete rows only."""
    rows = raw.where(F.col("pneumo").isNotNull())
    rows = rows if id_col else numbered(rows, *rows.columns)
    key = F.col(id_col).cast("string") if id_col else F.concat(F.lit("V"), F.col("number").cast("string"))
    picked = rows.select(
        key.alias("patient_id"), F.col("pneumo").cast("int").alias("exposure_status"), F.col("dead").cast("int").alias("outcome"),
        *(F.col(c).try_cast("double").alias(c) for c in VLBW_NUMERIC), *(F.col(c).cast("string").alias(c) for c in VLBW_CATEGORICAL))
    return picked.na.drop()


def replicate(df: DataFrame, rep: int) -> DataFrame:
    """One replication of a table with a ``rep`` column."""
    return df.where(F.col("rep") == rep)
