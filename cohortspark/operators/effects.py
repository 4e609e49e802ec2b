"""Effect estimates on whole or matched cohorts, and summaries over replications."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GUARD = 1e-10
LEAST_PAIRS = 5


def att(df: DataFrame, outcome: str, exposure: str) -> DataFrame:
    """(att): difference of the groups' mean outcomes."""
    on = lambda side: F.avg(F.when(F.col(exposure) == side, F.col(outcome).cast("double")))
    return df.agg((on(1) - on(0)).alias("att"))


def odds_ratio(df: DataFrame, outcome: str, exposure: str) -> DataFrame:
    """(odds_ratio) of a 0/1 outcome; empty cells are guarded."""
    n = lambda e, y: F.count_if((F.col(exposure) == e) & (F.col(outcome) == y))
    got = df.agg(n(1, 1).alias("a"), n(1, 0).alias("b"), n(0, 1).alias("c"), n(0, 0).alias("d"))
    return got.select(((F.col("a") + GUARD) * (F.col("d") + GUARD) / ((F.col("b") + GUARD) * (F.col("c") + GUARD))).alias("odds_ratio"))


def att_cluster(df: DataFrame, outcome: str, exposure: str, cluster: str = "match_group") -> DataFrame:
    """(att, se): least squares of the outcome on exposure, standard error robust to clusters.

    In closed form from sums by cluster: with two regressors the sandwich needs
    each cluster's summed residuals, over all rows and over exposed ones.  The
    usual small-sample factor G/(G-1) * (N-1)/(N-2) applies.
    """
    rows = df.where(F.col(cluster).isNotNull()).select(F.col(cluster).alias("g"), F.col(exposure).cast("double").alias("x"), F.col(outcome).cast("double").alias("y")).na.drop()
    sums = rows.groupBy("g").agg(F.sum(F.lit(1.0)).alias("n"), F.sum("x").alias("n_x"), F.sum("y").alias("y"), F.sum(F.col("x") * F.col("y")).alias("y_x"))
    total = sums.agg(F.sum("n").alias("all_n"), F.sum("n_x").alias("all_x"), F.sum("y").alias("all_y"), F.sum("y_x").alias("all_y_x"), F.count("*").alias("groups"))
    both = sums.join(F.broadcast(total))  # one row of totals
    n1, n0 = F.col("all_x"), F.col("all_n") - F.col("all_x")
    m1, m0 = F.try_divide(F.col("all_y_x"), n1), F.try_divide(F.col("all_y") - F.col("all_y_x"), n0)
    r1 = F.col("y_x") - m1 * F.col("n_x")
    r0 = (F.col("y") - F.col("y_x")) - m0 * (F.col("n") - F.col("n_x"))
    # the slope's influence: exposed residuals over their number less the controls' over theirs
    u = F.try_divide(r1, n1) - F.try_divide(r0, n0)
    got = both.agg(F.first(m1 - m0).alias("att"), F.sum(u * u).alias("v"), F.first("groups").alias("groups"), F.first("all_n").alias("rows"))
    factor = F.try_divide(F.col("groups"), F.col("groups") - 1) * F.try_divide(F.col("rows") - 1, F.col("rows") - 2)
    return got.select("att", F.sqrt(factor * F.col("v")).alias("se"))


def mcnemar(pairs: DataFrame, outcome: str) -> DataFrame:
    """(n_pairs, b, c, odds_ratio, ci_low, ci_high, chi2): discordant pairs of a 0/1 outcome (columns <outcome>_t, _c); 0.5 is added where a count is 0."""
    t, c = F.col(f"{outcome}_t"), F.col(f"{outcome}_c")
    got = pairs.agg(F.count("*").alias("n_pairs"), F.count_if((t == 1) & (c == 0)).alias("b"), F.count_if((t == 0) & (c == 1)).alias("c"))
    some = (F.col("b") == 0) | (F.col("c") == 0)
    b, d = (F.when(some, F.col(x) + 0.5).otherwise(F.col(x).cast("double")) for x in ("b", "c"))
    ratio, se = b / d, F.sqrt(1 / b + 1 / d)
    gap = F.greatest(F.abs(F.col("b") - F.col("c")) - 1, F.lit(0)).cast("double")
    chi2 = F.coalesce(F.try_divide(gap * gap, F.col("b") + F.col("c")), F.lit(0.0))
    return got.select("n_pairs", "b", "c", ratio.alias("odds_ratio"), F.exp(F.log(ratio) - 1.96 * se).alias("ci_low"), F.exp(F.log(ratio) + 1.96 * se).alias("ci_high"), chi2.alias("chi2"))


def mcnemar_test(pairs: DataFrame, outcome: str) -> DataFrame:
    """``mcnemar`` with ``p``, the upper tail of the continuity-corrected statistic: one row, so the tail is worked out on the driver."""
    got = mcnemar(pairs, outcome)
    row = got.first()
    return got.withColumn("p", F.lit(p_value(row["chi2"])))


def breslow_odds_ratio(df: DataFrame, outcome: str, exposure: str) -> DataFrame:
    """(odds_ratio): proportional hazards of a 0/1 outcome at one common time, no strata, ties by Breslow, exposure as the only covariate.

    With all rows at risk at once the likelihood is b * d1 - (d1 + d0) * log(n1 * exp(b) + n0)
    for d1, d0 events among n1 exposed and n0 others, whose maximum is at exp(b) = d1 * n0 / (d0 * n1).
    """
    n = lambda e, y: F.count_if((F.col(exposure) == e) & ((F.col(outcome) == y) if y is not None else F.col(outcome).isNotNull())).cast("double")
    got = df.agg(n(1, 1).alias("d1"), n(0, 1).alias("d0"), n(1, None).alias("n1"), n(0, None).alias("n0"))
    return got.select(F.try_divide(F.col("d1") * F.col("n0"), F.col("d0") * F.col("n1")).alias("odds_ratio"))


def p_value(chi2: float) -> float:
    """Upper tail of the chi-square distribution with one degree of freedom."""
    return math.erfc(math.sqrt(max(chi2, 0.0) / 2))


def conditional_odds_ratio(pairs: DataFrame, outcome: str) -> DataFrame:
    """(n_pairs, odds_ratio): conditional maximum likelihood of 1:1 pairs, the ratio of discordant counts; null under five pairs."""
    got = mcnemar(pairs, outcome)
    return got.select("n_pairs", F.when(F.col("n_pairs") >= LEAST_PAIRS, F.col("odds_ratio")).alias("odds_ratio"))


def stratified_odds_ratio(df: DataFrame, outcome: str, exposure: str, group: str = "match_group") -> DataFrame:
    """(odds_ratio) over 1:n groups, Mantel and Haenszel: each group adds concordant products over its size."""
    n = lambda e, y: F.count_if((F.col(exposure) == e) & (F.col(outcome) == y)).cast("double")
    cells = df.where(F.col(group).isNotNull()).groupBy(group).agg(n(1, 1).alias("a"), n(1, 0).alias("b"), n(0, 1).alias("c"), n(0, 0).alias("d"), F.count("*").alias("n"))
    return cells.agg(F.try_divide(F.sum(F.col("a") * F.col("d") / F.col("n")), F.sum(F.col("b") * F.col("c") / F.col("n"))).alias("odds_ratio"))


def retention(matched: DataFrame, exposure: str, group: str = "match_group") -> DataFrame:
    """(exposed, matched, retention) of a matched table that lists unmatched exposed rows too."""
    x = F.col(exposure) == 1
    got = matched.agg(F.count_if(x).alias("exposed"), F.count_if(x & F.col(group).isNotNull()).alias("matched"))
    return got.withColumn("retention", F.try_divide(F.col("matched"), F.col("exposed")))


def true_att(df: DataFrame, exposure: str, mu0: str = "mu0", mu1: str = "mu1") -> DataFrame:
    """(true_att) from potential outcomes of the exposed."""
    return df.where(F.col(exposure) == 1).agg(F.avg(F.col(mu1) - F.col(mu0)).alias("true_att"))


def simulation_summary(results: DataFrame, estimate: str = "att", truth: str = "true_att", by: Sequence[str] = ("method",)) -> DataFrame:
    """Bias and RMSE over replications with their Monte Carlo errors."""
    e = F.col(estimate) - F.col(truth)
    got = results.where(e.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(e).alias("bias"), F.avg(e * e).alias("mse"), F.stddev_samp(e).alias("sd"), F.stddev_samp(e * e).alias("sd2"))
    root = F.sqrt("mse")
    return got.select(*by, "n", "bias", root.alias("rmse"), (F.col("sd") / F.sqrt("n")).alias("mcse_bias"), F.try_divide(F.col("sd2"), 2 * root * F.sqrt("n")).alias("mcse_rmse"))


def pairwise_prevalence(results: DataFrame, value: str, by: Sequence[str] = ("seed", "method", "feature")) -> DataFrame:
    return results.groupBy(*by).agg(F.avg(value).alias("prevalence"))


def match_counts(matches: DataFrame, most: int = 10) -> DataFrame:
    """(n_matches, n_exposed): how many exposed rows have how many matches, the commonest first."""
    return matches.groupBy("query_id").agg(F.count("*").alias("n_matches")).groupBy("n_matches").agg(F.count("*").alias("n_exposed")).orderBy(F.desc("n_exposed"), "n_matches").limit(most)


def matching_summary(matches: DataFrame, exposed: DataFrame) -> DataFrame:
    """(n_exposed, n_matched, n_pairs, n_controls, n_reused, ratio)."""
    per: Column = F.col("n")
    controls = matches.groupBy("ref_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_controls"), F.count_if(per > 1).alias("n_reused"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"))
    rows = matches.groupBy("query_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_matched"))
    total = exposed.agg(F.count("*").alias("n_exposed"))
    return total.join(rows).join(controls).select("n_exposed", "n_matched", "n_pairs", "n_controls", "n_reused", F.try_divide(F.col("n_matched"), F.col("n_exposed")).alias("ratio"))
