"""What the engine's plans read and how they join."""

import os
import re

import pytest
from pyspark.sql import functions as F

from cohortspark.operators import balance, knn
from cohortspark.plans import queries as core

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().toString()


def test_columns_are_pruned(spark):
    text = plan(core.unadjusted_or(spark, DATA))
    read = {c.split(":")[0] for s in re.findall(r"ReadSchema: struct<([^>]*)>", text) for c in s.split(",") if c}
    assert "text" not in read and "n_chars" not in read


def test_band_join_is_an_equi_join(spark):
    rows = core.customers(spark, DATA)
    text = plan(knn.band_join(rows.where("exposure = 1"), rows.where("exposure = 0"), "unit_id", "c_acctbal", 25.0))
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_balance_reads_its_table_once(spark):
    rows = spark.range(10).select(F.col("id"), (F.col("id") % 2).alias("x"), F.rand(1).alias("a"), F.rand(2).alias("b"))
    text = plan(balance.smd_numeric(rows, ["a", "b"], "x")).split("== Physical Plan ==")[1]
    assert text.count("Range (0, 10") == 1 and "partial_avg" in text


def test_filters_reach_the_scan(spark):
    text = plan(core.parquet(spark, DATA, "customer").where("c_nationkey = 3").select("c_custkey"))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(c_nationkey,3\)", text) and "c_acctbal" not in text.split("ReadSchema")[1]


def test_exact_quantiles_by_narrowing(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from cohortspark.operators.quantiles import quantile

    rows = spark.range(3000).select(F.when(F.col("id") % 50 == 7, None).when(F.col("id") % 3 == 0, 4.5).otherwise(F.exp((F.col("id") * 7919 % 3001) / 200.0)).alias("x"))
    values = np.array([r[0] for r in rows.where("x is not null").collect()])
    for share in (0.0, 0.1, 0.35, 0.5, 0.731, 1.0):
        want = np.quantile(values, share)
        assert abs(quantile(rows, "x", share) - want) <= 1e-9 * want and abs(quantile(rows, "x", share, one_buffer=20) - want) <= 1e-9 * want
    assert quantile(rows.where("x is null"), "x", 0.5) is None
