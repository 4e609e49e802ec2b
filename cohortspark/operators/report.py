"""The data behind the usual plots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quantiles
from .ranges import ONE_SORT, running_sums
from .vectors import PcaModel, fit_pca


def proportions(df: DataFrame, feature: str, exposure: str) -> DataFrame:
    """(exposure, level, n, proportion within the group)."""
    got = df.groupBy(F.col(exposure).alias("exposure"), F.col(feature).cast("string").alias("level")).agg(F.count("*").alias("n"))
    return got.withColumn("proportion", F.col("n") / F.sum("n").over(Window.partitionBy("exposure")))


def histogram(df: DataFrame, feature: str, exposure: str, bins: int = 30) -> DataFrame:
    """(exposure, bin, low, high, n) over equal bins from the least to the largest value; the last bin is closed."""
    lo, hi = df.agg(F.min(feature).cast("double"), F.max(feature).cast("double")).first()
    if lo is None:
        lo = hi = 0.0
    width = (hi - lo) / bins or 1.0
    at: Column = F.least(F.floor((F.col(feature).cast("double") - lo) / width), F.lit(bins - 1)).cast("long")
    got = df.where(F.col(feature).isNotNull()).groupBy(F.col(exposure).alias("exposure"), at.alias("bin")).agg(F.count("*").alias("n"))
    return got.select("exposure", "bin", (F.lit(lo) + F.col("bin") * width).alias("low"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("high"), "n")


def ecdf(df: DataFrame, value: str, exposure: str, one_sort: int = ONE_SORT) -> DataFrame:
    """(exposure, value, cumulative share): of each distinct value, from counts, so equal values meet before any sort; many values are summed range by range."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(exposure).alias("exposure"), F.col(value).alias("value")).agg(F.count("*").alias("n"))
    return running_sums(counts, "exposure", "value", "n", one_sort).select("exposure", "value", (F.col("running") / F.col("whole")).alias("share"))


def coverage(before: DataFrame, after: DataFrame, value: str, exposure: str, bins: int = 30) -> DataFrame:
    """Histograms of a score before and after matching, with a stage column, over the bins of the first."""
    a = histogram(before, value, exposure, bins).withColumn("stage", F.lit("before"))
    b = histogram(after, value, exposure, bins).withColumn("stage", F.lit("after"))
    return a.unionByName(b)


def explained_variance(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, PcaModel]:
    """(component, explained, cumulative) and the fitted components."""
    model = fit_pca(df, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    total, rows = 0.0, []
    for i, x in enumerate(model.explained):
        total += float(x)
        rows.append((i + 1, float(x), total))
    return df.sparkSession.createDataFrame(rows, "component long, explained double, cumulative double"), model


def long_results(results: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide metric columns as (keys, metric, value)."""
    return results.select(*keys, *(F.col(c).cast("double").alias(c) for c in metrics)).unpivot(list(keys), list(metrics), "metric", "value")


def wide_results(results: DataFrame, key: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    """(key, one mean column for each of ``columns``)."""
    return results.groupBy(key).pivot(column, list(columns)).agg(F.avg(value))


def pair_records(results: DataFrame, column: str, keys: Sequence[str], fields: Mapping[str, str]) -> DataFrame:
    """(keys, the fields of each record): a column of stored pair records, as JSON or as a list of literals in single quotes, row by row.

    ``fields``: name and type of each.  A cell that isn't a list of records gives no row, a missing field is null.
    """
    text = F.col(column)
    for word, json in (("None", "null"), ("nan", "null"), ("True", "true"), ("False", "false")):
        text = F.regexp_replace(text, rf"(?<=[:,\[]\s?){word}(?=\s*[,}}\]])", json)
    kind = "array<struct<" + ", ".join(f"`{n}`: {t}" for n, t in fields.items()) + ">>"
    parsed = F.from_json(text, kind, {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})
    rows = results.select(*keys, F.explode(parsed).alias("_x")).where(F.col("_x").isNotNull())
    return rows.select(*keys, *(F.col(f"_x.{n}").alias(n) for n in fields))


def metric_table(results: DataFrame, metrics: Sequence[str], by: str = "method") -> DataFrame:
    """(method, metric, n, mean, sd, low, high) over replications: the data of the simulation plots, low and high being the normal 95 % limits of the mean."""
    long = long_results(results, [by], metrics).where(F.col("value").isNotNull() & ~F.isnan("value"))
    got = long.groupBy(by, "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    half = 1.96 * F.col("sd") / F.sqrt("n")
    return got.withColumn("low", F.col("mean") - half).withColumn("high", F.col("mean") + half)


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, other, correlation) of every ordered pair of numeric columns, each over the rows that have both; all in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    both = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(a).cast("double"))
    got = df.agg(*(F.corr(both(a, b), both(b, a)).alias(f"r{k}") for k, (a, b) in enumerate(pairs))).first()
    found = {(a, b): got[f"r{k}"] for k, (a, b) in enumerate(pairs)}
    rows = [(a, b, found.get((a, b), found.get((b, a)))) for a in columns for b in columns]
    return df.sparkSession.createDataFrame(rows, "feature string, other string, correlation double")


def spread(results: DataFrame, value: str, by: str = "method") -> DataFrame:
    """(method, n, mean, low, q1, median, q3, high) of a measure over replications, such as retention: a box for each method."""
    shares = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}
    boxes = quantiles.grouped(results, by, value, list(shares.values()))
    wide = boxes.groupBy(by).agg(*(F.max(F.when(F.col("share") == s, F.col("value"))).alias(n) for n, s in shares.items()))
    return results.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean")).join(wide, by, "left").select(by, "n", "mean", *shares)
