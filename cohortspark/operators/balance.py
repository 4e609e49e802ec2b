"""Balance diagnostics: standardised mean differences, before and after, and quality of matched pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import quantiles

BAD_FROM = 0.1
LABEL = 15


def _long(df: DataFrame, features: Sequence[str], kind: str, exposure: str) -> DataFrame:
    """(feature, value, x): one row for each feature of each row; no row leaves its task before it is aggregated."""
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast(kind).alias("value")) for c in features))
    return df.select(F.col(exposure).alias("x"), F.explode(cells).alias("cell")).select("cell.feature", "cell.value", "x")


def smd_numeric(df: DataFrame, features: Sequence[str], exposure: str) -> DataFrame:
    """(feature, mean_exposed, std_exposed, mean_control, std_control, smd): |mean difference| over the root of the mean variance; 0 where that is 0, null for an empty group."""
    on = lambda f, side: f(F.when(F.col("x") == side, F.col("value")))
    got = _long(df, features, "double", exposure).groupBy("feature").agg(
        on(F.avg, 1).alias("mean_exposed"), on(F.stddev_samp, 1).alias("std_exposed"), on(F.avg, 0).alias("mean_control"), on(F.stddev_samp, 0).alias("std_control"))
    pooled = F.sqrt((F.col("std_exposed") * F.col("std_exposed") + F.col("std_control") * F.col("std_control")) / 2)
    return got.withColumn("smd", F.when(pooled == 0, 0.0).otherwise(F.abs(F.col("mean_exposed") - F.col("mean_control")) / pooled))


def smd_categorical(df: DataFrame, features: Sequence[str], exposure: str) -> DataFrame:
    """(feature, level, p_exposed, p_control, smd) for every level that either group has, nulls left out."""
    cells = _long(df, features, "string", exposure).where("value is not null")
    n = lambda side: F.count_if(F.col("x") == side)
    levels = cells.groupBy("feature", F.col("value").alias("level")).agg(n(1).alias("e"), n(0).alias("c"))
    totals = cells.groupBy("feature").agg(n(1).alias("te"), n(0).alias("tc"))
    got = levels.join(F.broadcast(totals), "feature")  # one row for each declared feature
    share = lambda a, b: F.try_divide(F.col(a), F.col(b))
    got = got.select("feature", "level", share("e", "te").alias("p_exposed"), share("c", "tc").alias("p_control"))
    pooled = F.sqrt((F.col("p_exposed") * (1 - F.col("p_exposed")) + F.col("p_control") * (1 - F.col("p_control"))) / 2)
    return got.withColumn("smd", F.when(pooled == 0, 0.0).otherwise(F.abs(F.col("p_exposed") - F.col("p_control")) / pooled))


def balance_table(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], exposure: str, bad_from: float = BAD_FROM) -> DataFrame:
    """One row for each numeric feature and each level: group means (levels in per cent), deviations, SMD and its verdict (on the unrounded SMD; none counts as BAD)."""
    verdict = lambda smd: F.when(smd < bad_from, "OK").otherwise("BAD")
    three = lambda c: F.bround(c, 3)
    parts = []
    if numeric:
        s = smd_numeric(df, numeric, exposure)
        parts.append(s.select(F.col("feature"), *(three(F.col(c)).alias(c) for c in ("mean_exposed", "std_exposed", "mean_control", "std_control", "smd")), verdict(F.col("smd")).alias("result")))
    if categorical:
        s = smd_categorical(df, categorical, exposure)
        name = F.concat(F.col("feature"), F.lit(": "), F.substring("level", 1, LABEL))
        none = F.lit(None).cast("double")
        parts.append(s.select(name.alias("feature"), three(F.col("p_exposed") * 100).alias("mean_exposed"), none.alias("std_exposed"), three(F.col("p_control") * 100).alias("mean_control"), none.alias("std_control"), three(F.col("smd")).alias("smd"), verdict(F.col("smd")).alias("result")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def one_level_smd(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], exposure: str) -> DataFrame:
    """(feature, smd): numerics, and of each categorical one level: "1" if it has it, else the last."""
    out = smd_numeric(df, numeric, exposure).select("feature", "smd") if numeric else None
    if categorical:
        s = smd_categorical(df, categorical, exposure)
        one = s.groupBy("feature").agg(F.max_by("smd", F.struct((F.col("level") == "1").alias("one"), "level")).alias("smd"))
        out = one if out is None else out.unionByName(one)
    return out


def mean_smd(table: DataFrame) -> DataFrame:
    """(mas, max_smd) over a table with an smd column."""
    return table.agg(F.avg(F.abs("smd")).alias("mas"), F.max(F.abs("smd")).alias("max_smd"))


def before_after(before: DataFrame, after: DataFrame, numeric: Sequence[str], categorical: Sequence[str], exposure: str) -> DataFrame:
    """(feature, smd_before, smd_after)."""
    a = one_level_smd(before, numeric, categorical, exposure).withColumnRenamed("smd", "smd_before")
    b = one_level_smd(after, numeric, categorical, exposure).withColumnRenamed("smd", "smd_after")
    return a.join(b, "feature", "left")


def baseline_sd(df: DataFrame, features: Sequence[str], exposure: str) -> DataFrame:
    """(feature, sd): root of the mean of both groups' variances, 1 where that is 0 or unknown."""
    on = lambda side: F.var_samp(F.when(F.col("x") == side, F.col("value")))
    got = _long(df, features, "double", exposure).groupBy("feature").agg(on(1).alias("v1"), on(0).alias("v0"))
    sd = F.sqrt((F.col("v1") + F.col("v0")) / 2)
    return got.select("feature", F.when(sd > 0, sd).otherwise(1.0).alias("sd"))


def pair_rows(matched: DataFrame, exposure: str, columns: Sequence[str], group: str = "match_group") -> DataFrame:
    """Treated and control rows of each match group side by side (suffixes _t and _c); 1:n groups give n pairs."""
    rows = matched.where(F.col(group).isNotNull())
    side = lambda value, suffix: rows.where(F.col(exposure) == value).select(F.col(group).alias("match_group"), *(F.col(c).alias(f"{c}{suffix}") for c in columns))
    return side(1, "_t").join(side(0, "_c"), "match_group")


def pair_quality(pairs: DataFrame, numeric: Sequence[str], categorical: Sequence[str], sds: dict[str, float]) -> DataFrame:
    """(feature, mean_diff, median_diff, max_diff, mismatch_rate): standardised differences of numerics, share of unequal levels of categoricals."""
    cells = [F.struct(F.lit(c).alias("feature"), (F.abs(F.col(f"{c}_t").cast("double") - F.col(f"{c}_c").cast("double")) / F.lit(float(sds[c]))).alias("d"), F.lit(None).cast("double").alias("m")) for c in numeric]
    cells += [F.struct(F.lit(c).alias("feature"), F.lit(None).cast("double").alias("d"), F.when(F.col(f"{c}_t").eqNullSafe(F.col(f"{c}_c")), 0.0).otherwise(1.0).alias("m")) for c in categorical]
    long = pairs.select(F.explode(F.array(*cells)).alias("x")).select("x.feature", "x.d", "x.m")
    got = long.groupBy("feature").agg(F.avg("d").alias("mean_diff"), F.max("d").alias("max_diff"), F.avg("m").alias("mismatch_rate"))
    medians = quantiles.grouped(long, "feature", "d", [0.5]).select("feature", F.col("value").alias("median_diff"))
    return got.join(F.broadcast(medians), "feature", "left").select("feature", "mean_diff", "median_diff", "max_diff", "mismatch_rate")


def worst_pairs(pairs: DataFrame, numeric: Sequence[str], categorical: Sequence[str], ranges: dict[str, float]) -> DataFrame:
    """(mapd, pm): mean over pairs of the largest range-scaled numeric difference, and of the share of mismatched categoricals."""
    gaps = [F.abs(F.col(f"{c}_t").cast("double") - F.col(f"{c}_c").cast("double")) / F.lit(float(ranges[c] or 1.0)) for c in numeric]
    off = [F.when(F.col(f"{c}_t").eqNullSafe(F.col(f"{c}_c")), 0.0).otherwise(1.0) for c in categorical]
    worst: Column = F.greatest(*gaps) if len(gaps) > 1 else gaps[0] if gaps else F.lit(None).cast("double")
    share = sum(off, F.lit(0.0)) / len(off) if off else F.lit(None).cast("double")
    return pairs.agg(F.avg(worst).alias("mapd"), F.avg(share).alias("pm"))


def worst_features(pairs: DataFrame, numeric: Sequence[str], categorical: Sequence[str], ranges: dict[str, float]) -> DataFrame:
    """(feature, mean_gap, max_gap): of each numeric its range-scaled difference over the pairs, of each categorical the share of mismatches (as mean_gap)."""
    none = F.lit(None).cast("double")
    cells = [F.struct(F.lit(c).alias("feature"), (F.abs(F.col(f"{c}_t").cast("double") - F.col(f"{c}_c").cast("double")) / F.lit(float(ranges[c] or 1.0))).alias("gap"), F.lit(True).alias("number")) for c in numeric]
    cells += [F.struct(F.lit(c).alias("feature"), F.when(F.col(f"{c}_t").eqNullSafe(F.col(f"{c}_c")), 0.0).otherwise(1.0).alias("gap"), F.lit(False).alias("number")) for c in categorical]
    long = pairs.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    return long.groupBy("feature").agg(F.avg("gap").alias("mean_gap"), F.when(F.first("number"), F.max("gap")).otherwise(none).alias("max_gap"))


def by_absolute_smd(table: DataFrame) -> DataFrame:
    """A balance table (one row for each feature), worst first; ties by feature."""
    return table.orderBy(F.desc_nulls_last(F.abs("smd")), "feature")
