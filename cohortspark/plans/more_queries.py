"""Further registered queries: sources and sinks as round trips, propensity strategies, plain greedy matching, report tables; and their DuckDB SQL."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from urllib.parse import urlsplit
from uuid import uuid4

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import balance, effects, knn, propensity, report
from ..operators.checkpoints import saved, shared_dir
from ..sources import sinks, studies, tables
from ..sources.tables import parquet
from ..spec import CohortSpec, MatchSpec
from . import queries as q
from .matcher import CohortMatcher, greedy_match

# -- sources and sinks -----------------------------------------------------------------------------------------------


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid4().hex}"


def _put(spark: SparkSession, name: str, data: bytes) -> str:
    """A small file in the shared folder."""
    path = _folder(spark, name)
    fs, inner = pafs.FileSystem.from_uri(path if urlsplit(path).scheme else f"file://{path}")
    fs.create_dir(inner.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(inner, compression=None) as out:
        out.write(data)
    return path


def source_csv(spark, d):
    """Customers written as CSV and read back."""
    path = _folder(spark, "csv")
    sinks.write_csv(parquet(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path)
    return tables.csv(spark, path, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string")


def source_zipped_csv(spark, d):
    """Nations and regions as two CSV members of an archive; columns that a member lacks are null."""
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, columns in (("nation", ("n_nationkey", "n_name", "n_regionkey")), ("region", ("r_regionkey", "r_name"))):
            archive.writestr(f"{name}.csv", parquet(spark, d, name).select(*columns).toPandas().to_csv(index=False))
        archive.writestr("readme.txt", "not,a,table\n1,2,3\n")
    return tables.zipped_csv(spark, _put(spark, "archive.zip", data.getvalue()), "n_nationkey long, n_name string, n_regionkey long, r_regionkey long, r_name string")


def source_whitespace(spark, d):
    """Suppliers as numbers between blanks and tabs, with blank lines."""
    path = _folder(spark, "txt")
    line = F.concat(F.lit("  "), F.col("s_suppkey").cast("string"), F.lit("\t "), F.format_string("%.2f", "s_acctbal"), F.lit("   "), F.col("s_nationkey").cast("string"))
    parquet(spark, d, "supplier").select(F.explode(F.array(line, F.lit("   "))).alias("value")).write.text(path)
    return tables.whitespace(spark, path, ("suppkey", "acctbal", "nationkey"))


def source_replications(spark, d):
    """Nations as a replicated study in an .npz file: three replications of two features."""
    nations = parquet(spark, d, "nation").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").toPandas().to_numpy()
    key, region, rep = nations[:, :1], nations[:, 1:], np.arange(3)[None]
    x = np.stack((key * (rep + 1) / 4, region + rep), axis=1)
    data = io.BytesIO()
    np.savez(data, x=x, t=(key + rep) % 2, yf=key - rep / 2, mu0=region + 0 * rep, mu1=region + rep)
    return tables.npz(spark, {"all": _put(spark, "study.npz", data.getvalue())}, ("size",), ("kind",), prefix="N")


def study_rhc(spark, d):
    """Customers in the shape of the catheterisation study; an account that isn't a number is null."""
    raw = q.customers(spark, d).select(
        F.col("unit_id").alias("ptid"), F.when(F.col("exposure") == 1, "RHC").otherwise("No RHC").alias("swang1"), F.when(F.col("n_orders") > 15, " Yes").otherwise("No").alias("dth30"),
        F.when(F.col("unit_id") % 7 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string")).alias("age"), F.col("region").alias("race"))
    return q._rounded(studies.rhc(raw))


def study_lalonde(spark, d):
    """Customers in the shape of the labour-market study, in the older files' columns."""
    c = q.customers(spark, d)
    raw = c.select(
        F.col("exposure").cast("double").alias("treat"), F.col("unit_id").cast("double").alias("age"), F.lit(12.0).alias("education"), *((F.col("unit_id") % k == 0).cast("double").alias(n) for n, k in (("black", 2), ("hispanic", 3), ("married", 5), ("nodegree", 7))),
        F.coalesce("n_orders", F.lit(0.0)).alias("RE75"), F.col("c_acctbal").alias("RE78"))
    return q._rounded(studies.lalonde(raw, raw.where("age % 2 = 1")))


def study_vlbw(spark, d):
    """Customers in the shape of the birth-weight study; incomplete rows go."""
    c = q.customers(spark, d)
    raw = c.select(
        "unit_id", F.when(F.col("unit_id") % 11 != 0, F.col("exposure")).alias("pneumo"), (F.col("unit_id") % 2).alias("dead"), F.col("c_acctbal").cast("string").alias("bwt"), F.col("n_orders").alias("gest"), F.lit("7").alias("apg1"), F.lit(80).alias("year"),
        F.col("region").alias("race"), F.when(F.col("unit_id") % 13 != 0, "male").alias("sex"), F.lit("born at").alias("inout"), F.lit(0).alias("twn"), F.lit("vaginal").alias("delivery"))
    return q._rounded(studies.vlbw(raw, "unit_id"))


def sink_chunks(spark, d):
    """Yearly figures written as a CSV chunk for each half of the keys, gathered and checked."""
    path = _folder(spark, "chunks")
    rows = parquet(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    rows = saved(rows, "yearly")
    for half in (0, 1):
        sinks.write_csv(rows.where(F.col("year") % 2 == half), f"{path}/chunk{half}")
    found = sinks.gather_chunks(spark, f"{path}/chunk*", ("year", "status"), rows.count(), "year long, status string, n long, total double")
    return found.select("year", "status", "n", F.round("total", 2).alias("total"))


def cdist_euclidean(spark, d):
    """Every pair's distance, summed up by query."""
    left, right, columns = q._vector_sides(spark, d)
    return q._rounded(knn.summary(left, right, "unit_id", q.vectors.VectorMetric("l2", columns)), 5)


def unmatched_ids(spark, d):
    """Exposed customers without a control of the same region within 25 of their account."""
    c = q.customers(spark, d)
    near = c.where("exposure = 1").alias("t").join(c.where("exposure = 0").alias("k"), (F.col("t.region") == F.col("k.region")) & (F.floor(F.col("t.c_acctbal") / 25) == F.floor(F.col("k.c_acctbal") / 25)))
    return c.where("exposure = 1").select("unit_id").exceptAll(near.select("t.unit_id").distinct())


# -- propensity strategies -------------------------------------------------------------------------------------------

_ONE = CohortSpec("unit_id", "exposure", ("c_acctbal",), bin_method="scaler")


def _scores(spark, d, **strategy) -> DataFrame:
    return q._rounded(propensity.fit_propensity(q.customers(spark, d), _ONE, **strategy).scores, 5)


def propensity_full(spark, d):
    """One feature, everyone in training."""
    return _scores(spark, d)


def propensity_downsampled(spark, d):
    """Three controls for each case in training."""
    return _scores(spark, d, downsample_ratio=3)


def propensity_bagged(spark, d):
    """Three bags of controls, each with all cases."""
    return _scores(spark, d, n_bags=3)


def propensity_hard_mined(spark, d):
    """Refitted on the thousand controls that a scout finds likeliest."""
    return _scores(spark, d, n_hard_mining=1000)


def _newton(train: str, name: str) -> str:
    """A recursive table ``name`` (i, a, b): Newton's steps of intercept and slope on ``train`` (x, y)."""
    return f"""{name}(i, a, b) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) UNION ALL
  SELECT i + 1, a + (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b + (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12)
  FROM (SELECT i, a, b, sum(y - p) AS g1, sum((y - p) * x) AS g2, sum(p * (1 - p)) AS h11, sum(p * (1 - p) * x) AS h12, sum(p * (1 - p) * x * x) AS h22
        FROM (SELECT i, a, b, x, y, 1 / (1 + exp(-(a + b * x))) AS p FROM {name}, {train} WHERE i < 20) GROUP BY i, a, b))"""


_X = f"""WITH RECURSIVE {q.C1} x AS (SELECT unit_id, CAST(exposure AS DOUBLE) AS y, (c_acctbal - (SELECT avg(c_acctbal) FROM base)) / (SELECT stddev_pop(c_acctbal) FROM base) AS x,
  CAST(('0x' || substr(md5('404:' || unit_id), 1, 15)) AS BIGINT) AS h FROM base), n AS (SELECT count(*) AS n FROM x WHERE y = 1)"""
_OUT = "SELECT unit_id, round(1 / (1 + exp(-(a + b * x))), 5) AS propensity_score, round(a + b * x, 5) AS propensity_logit FROM x, {} WHERE i = 20"


def _sampled(name: str, ratio: int) -> str:
    return f"{name} AS (SELECT x, y FROM x WHERE y = 1 UNION ALL SELECT x, y FROM (SELECT x, y, row_number() OVER (ORDER BY h, unit_id) AS k FROM x WHERE y = 0), n WHERE k <= {ratio} * n)"


def _propensity_sql() -> dict[str, str]:
    bags = ", ".join(f"t{i} AS (SELECT x, y FROM x WHERE y = 1 OR h % 3 = {i}), {_newton(f't{i}', f's{i}')}" for i in range(3))
    every = " UNION ALL ".join(f"SELECT unit_id, a + b * x AS z FROM x, s{i} WHERE i = 20" for i in range(3))
    return {
        "propensity_full": f"{_X}, {_newton('x', 's')} {_OUT.format('s')}",
        "propensity_downsampled": f"{_X}, {_sampled('t', 3)}, {_newton('t', 's')} {_OUT.format('s')}",
        "propensity_bagged": f"{_X}, {bags}, z AS ({every}) SELECT unit_id, round(avg(1 / (1 + exp(-z))), 5) AS propensity_score, round(avg(z), 5) AS propensity_logit FROM z GROUP BY unit_id",
        "propensity_hard_mined": f"""{_X}, {_sampled('t', 10)}, {_newton('t', 's')},
hard AS (SELECT x, y FROM x WHERE y = 1 UNION ALL SELECT x, y FROM (SELECT x, y, row_number() OVER (ORDER BY 1 / (1 + exp(-(a + b * x))) DESC, unit_id) AS k FROM x, s WHERE i = 20 AND y = 0) WHERE k <= 1000), {_newton('hard', 'r')} {_OUT.format('r')}""",
    }


# -- plain greedy matching -------------------------------------------------------------------------------------------

_TWO = CohortSpec("unit_id", "exposure", ("c_acctbal", "n_orders"))


def greedy_mahalanobis(spark, d):
    return q._rounded(greedy_match(CohortMatcher(q.customers(spark, d), _TWO), "mahalanobis", caliper=0.5))


def greedy_scaled_euclidean(spark, d):
    return q._rounded(greedy_match(CohortMatcher(q.customers(spark, d), _TWO), "scaled_euclidean", caliper=0.5))


def _greedy_sql(distance: str, caliper: float) -> str:
    """Queries in order of id, each taking its nearest free control."""
    return f"""WITH RECURSIVE {q.C1} k AS (SELECT unit_id, exposure, c_acctbal, coalesce(n_orders, (SELECT quantile_cont(n_orders, 0.5) FROM base)) AS n_orders FROM base),
s AS (SELECT var_samp(c_acctbal) + 1e-6 AS a, var_samp(n_orders) + 1e-6 AS b, covar_samp(c_acctbal, n_orders) AS ab,
   (var_samp(c_acctbal) FILTER (exposure = 1) + var_samp(c_acctbal) FILTER (exposure = 0)) / 2 AS v1, (var_samp(n_orders) FILTER (exposure = 1) + var_samp(n_orders) FILTER (exposure = 0)) / 2 AS v2 FROM k),
pairs AS (SELECT t.unit_id AS query_id, r.unit_id AS ref_id, {distance} AS distance FROM k t, k r, s WHERE t.exposure = 1 AND r.exposure = 0),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS rank FROM pairs WHERE distance <= {caliper}),
queue AS (SELECT query_id, row_number() OVER (ORDER BY query_id) AS i FROM (SELECT DISTINCT query_id FROM near)),
run(i, query_id, pick, taken) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
  SELECT g.i + 1, u.query_id, arg_min(p.ref_id, p.rank), CASE WHEN arg_min(p.ref_id, p.rank) IS NULL THEN g.taken ELSE list_append(g.taken, arg_min(p.ref_id, p.rank)) END
  FROM run g JOIN queue u ON u.i = g.i + 1 LEFT JOIN near p ON p.query_id = u.query_id AND NOT list_contains(g.taken, p.ref_id) GROUP BY g.i, u.query_id, g.taken)
SELECT run.query_id, ref_id, round(distance, 6) AS distance FROM run JOIN near ON near.query_id = run.query_id AND ref_id = pick"""


# -- allocation where each exposed row has one candidate ------------------------------------------------------------


def _single(spark, d, spec: CohortSpec, formula: str | None = None, **options) -> DataFrame:
    matcher = CohortMatcher(q.customers(spark, d), spec)
    if formula:
        matcher = matcher.fit_propensity(formula)
    return q._pairs_out(matcher.match(MatchSpec(k_candidates=1, **options)).pairs)


def match_single(spark, d):
    """Contested controls go to the worst-off row, of equals the one with the least id; rows with a safe control are served last."""
    return _single(spark, d, q.SPEC, threshold=0.05)


def match_single_optimal(spark, d):
    """Contested controls go where the total is least."""
    return _single(spark, d, q.SPEC, threshold=0.05, competitive_match=False)


def match_single_flow(spark, d):
    return _single(spark, d, q.SPEC, threshold=0.05, competitive_match=False, mcf=True)


def match_single_mahalanobis(spark, d):
    return _single(spark, d, CohortSpec("unit_id", "exposure", ("c_acctbal", "n_orders")), metric="mahalanobis", threshold=0.3, competitive_match=False)


def match_single_propensity(spark, d):
    """Nearest logit within a hundredth of its deviation."""
    return _single(spark, d, _ONE, "c_acctbal", method="propensity", metric="euclidean", propensity_caliper=0.01)


_PLACE = CohortSpec("unit_id", "exposure", ("c_acctbal",), ("region",))


def match_single_hybrid(spark, d):
    """Nearest by Gower's distance among those within a fifth of the logit's deviation."""
    return _single(spark, d, _PLACE, "c_acctbal", ps_hybrid=True, ps_caliper=0.2, threshold=0.02)


def ranked_sql() -> dict[str, str]:
    """Common tables that end in ranked(query_id, ref_id, distance, rank): by Mahalanobis distance, by logit (with sd, the logit's deviation), and by Gower's distance within a fifth of that."""
    logit = f"{_X}, {_newton('x', 's')}, z AS (SELECT unit_id, y, a + b * x AS z FROM x, s WHERE i = 20), sd AS (SELECT stddev_samp(z) AS sd FROM z)"
    rank = "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS rank FROM pairs)"
    two = f"""WITH {q.C1} k AS (SELECT unit_id, exposure, (coalesce(c_acctbal, 0)) AS c_acctbal, coalesce(n_orders, 0) AS n_orders FROM base), s AS (SELECT var_samp(c_acctbal) + 1e-6 AS a, var_samp(n_orders) + 1e-6 AS b, covar_samp(c_acctbal, n_orders) AS ab FROM k),
pairs AS (SELECT t.unit_id AS query_id, r.unit_id AS ref_id, sqrt(greatest(0, (b * (t.c_acctbal - r.c_acctbal) ** 2 - 2 * ab * (t.c_acctbal - r.c_acctbal) * (t.n_orders - r.n_orders) + a * (t.n_orders - r.n_orders) ** 2) / (a * b - ab * ab))) AS distance
  FROM k t, k r, s WHERE t.exposure = 1 AND r.exposure = 0)"""
    hybrid = f"""{logit}, g AS (SELECT max(c_acctbal) - min(c_acctbal) AS g FROM base WHERE exposure = 0),
pairs AS (SELECT t.unit_id AS query_id, r.unit_id AS ref_id, (abs(t.c_acctbal - r.c_acctbal) / g + CASE WHEN t.region = r.region THEN 0.0 ELSE 1.0 END) / 2 AS distance
  FROM base t JOIN z zt ON zt.unit_id = t.unit_id, base r JOIN z zr ON zr.unit_id = r.unit_id, g, sd WHERE t.exposure = 1 AND r.exposure = 0 AND abs(zt.z - zr.z) <= 0.2 * sd)"""
    propensity = f"{logit}, pairs AS (SELECT t.unit_id AS query_id, r.unit_id AS ref_id, abs(t.z - r.z) AS distance FROM z t, z r WHERE t.y = 1 AND r.y = 0)"
    return {"mahalanobis": f"{two}, {rank}", "propensity": f"{propensity}, {rank}", "hybrid": f"{hybrid}, {rank}"}


def _single_sql() -> dict[str, str]:
    # ranked: one row for each exposed unit and control
    near = lambda limit: f"near AS (SELECT *, count(*) OVER (PARTITION BY ref_id) AS users, row_number() OVER (PARTITION BY ref_id ORDER BY query_id) AS turn, row_number() OVER (PARTITION BY ref_id ORDER BY distance, query_id) AS least FROM ranked WHERE rank = 1 AND distance <= {limit})"
    greedy = "SELECT query_id, ref_id, round(distance, 6) AS distance, CASE WHEN users = 1 THEN 'optimal' ELSE 'competitive' END AS phase FROM near WHERE turn = 1"
    optimal = "SELECT query_id, ref_id, round(distance, 6) AS distance, 'optimal' AS phase FROM near WHERE least = 1"
    ranked = ranked_sql()
    return {
        "match_single": f"{q._gower_sql()}, {near(0.05)} {greedy}",
        "match_single_optimal": f"{q._gower_sql()}, {near(0.05)} {optimal}",
        "match_single_flow": f"{q._gower_sql()}, {near(0.05)} {optimal}",
        "match_single_mahalanobis": f"{ranked['mahalanobis']}, {near(0.3)} {optimal}",
        "match_single_propensity": f"{ranked['propensity']}, {near('(SELECT 0.01 * sd FROM sd)')} {greedy}",
        "match_single_hybrid": f"{ranked['hybrid']}, {near(0.02)} {greedy}",
    }


# -- effects and report tables ---------------------------------------------------------------------------------------


def _potential(spark, d) -> DataFrame:
    return q.customers(spark, d).select("unit_id", "exposure", "region", "nation", F.coalesce("n_orders", F.lit(0.0)).alias("mu0"), (F.coalesce("n_orders", F.lit(0.0)) + F.col("c_acctbal") / 1000).alias("mu1"))


def true_att(spark, d):
    return q._rounded(effects.true_att(_potential(spark, d), "exposure"))


def pairwise_prevalence(spark, d):
    return q._rounded(effects.pairwise_prevalence(_potential(spark, d), "exposure", ("region", "nation")))


def mcnemar_p(spark, d):
    _, matched = q._nearest_pairs(spark, d)
    return q._rounded(effects.mcnemar_test(balance.pair_rows(q._with_rich(matched), "exposure", ("rich",)), "rich").select("b", "c", "chi2", "p"), 4)


def breslow_or(spark, d):
    return q._rounded(effects.breslow_odds_ratio(q.documents(spark, d), "quality", "exposure"))


def mapd_pm_features(spark, d):
    """The differences of nearest pairs, by feature."""
    cohort, matched = q._nearest_pairs(spark, d)
    model = q.gower.fit(cohort.controls, q.NUMERIC, q.CATEGORICAL)
    return q._rounded(balance.worst_features(balance.pair_rows(matched, "exposure", (*q.NUMERIC, *q.CATEGORICAL)), q.NUMERIC, q.CATEGORICAL, dict(model.ranges)))


def smd_order(spark, d):
    """Features by absolute SMD, worst first, with their place."""
    cohort = q.Cohort.of(q.customers(spark, d), q.SPEC)
    got = balance.by_absolute_smd(balance.one_level_smd(cohort.rows, q.NUMERIC, q.CATEGORICAL, "exposure")).select("feature", "smd").collect()
    return q._rounded(spark.createDataFrame([(i + 1, r["feature"], r["smd"]) for i, r in enumerate(got)], "place long, feature string, smd double"))


def explained_variance_two(spark, d):
    """Explained variance of two features of the exposed: the eigenvalues of a 2 by 2 matrix."""
    return q._rounded(report.explained_variance(q.customers(spark, d).where("exposure = 1"), ("c_acctbal", "n_orders"))[0])


def synthetic_counts(spark, d):
    """What holds of any synthetic cohort: sizes, distinct ids, no negative number, only the levels asked for."""
    rows = q.synthetic_cohort(spark, d)
    return q._rounded(rows.groupBy("exposure_status").agg(F.count("*").alias("n"), F.count_distinct("patient_id").alias("ids"), F.count_if(F.col("age") < 0).alias("negative"), F.count_if(~F.col("sex").isin("f", "m")).alias("other")))


def score_coverage(spark, d):
    """Histograms of document lengths, of all documents and of those of good quality."""
    rows = q.documents(spark, d)
    return q._rounded(report.coverage(rows, rows.where("quality = 1"), "n_chars", "exposure", 10))


def melted_and_pivoted(spark, d):
    """Region figures made long and wide again."""
    rows = q.customers(spark, d).groupBy("region").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("mean"))
    return q._rounded(report.wide_results(report.long_results(rows, ["region"], ["n", "mean"]), "region", "metric", "value", ["mean", "n"]))


def metric_intervals(spark, d):
    """Replications stand in by nation: mean and limits of two metrics for each region."""
    runs = q.customers(spark, d).groupBy("region", "nation").agg(F.avg("c_acctbal").alias("mean_account"), F.avg("n_orders").alias("mean_orders"))
    return q._rounded(report.metric_table(runs, ["mean_account", "mean_orders"], "region"), 4)


def pair_records(spark, d):
    """Stored records in both notations, and cells that hold none."""
    c = q.customers(spark, d).where("exposure = 1")
    literal = F.concat(F.lit("[{'feature': 'acct', 'diff': "), F.format_string("%.2f", "c_acctbal"), F.lit(", 'extra': None}, {'feature': 'orders', 'diff': None}]"))
    json = F.to_json(F.array(F.struct(F.lit("acct").alias("feature"), F.col("c_acctbal").alias("diff"))))
    cell = F.when(F.col("unit_id") % 3 == 0, literal).when(F.col("unit_id") % 3 == 1, json).otherwise("no records")
    return q._rounded(report.pair_records(c.select("unit_id", cell.alias("cell")), "cell", ["unit_id"], {"feature": "string", "diff": "double"}), 2)


_QUERIES = (
    source_csv, source_zipped_csv, source_whitespace, source_replications, study_rhc, study_lalonde, study_vlbw, sink_chunks, cdist_euclidean, unmatched_ids, propensity_full, propensity_downsampled, propensity_bagged, propensity_hard_mined,
    greedy_mahalanobis, greedy_scaled_euclidean, match_single, match_single_optimal, match_single_flow, match_single_mahalanobis, match_single_propensity, match_single_hybrid, true_att, pairwise_prevalence, mcnemar_p, breslow_or, mapd_pm_features, smd_order, explained_variance_two, synthetic_counts, score_coverage, melted_and_pivoted, metric_intervals, pair_records,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    flags = lambda order: ", ".join(f"CASE WHEN unit_id % {k} = 0 THEN '1' ELSE '0' END AS {n}" for n, k in order)
    four = (("black", 2), ("hispanic", 3), ("married", 5), ("nodegree", 7))
    potential = f"WITH {q.C1} p AS (SELECT unit_id, exposure, region, nation, coalesce(n_orders, 0) AS mu0, coalesce(n_orders, 0) + c_acctbal / 1000 AS mu1 FROM base)"
    rich = q._MATCHED + f", d AS (SELECT count(*) FILTER (coalesce(spend_t, 0) > {q.RICH} AND coalesce(spend_c, 0) <= {q.RICH}) AS b, count(*) FILTER (coalesce(spend_t, 0) <= {q.RICH} AND coalesce(spend_c, 0) > {q.RICH}) AS c FROM p), e AS (SELECT b, c, CASE WHEN b + c = 0 THEN 0.0 ELSE greatest(abs(b - c) - 1, 0) ** 2 / (b + c) END AS chi2 FROM d)"
    # erfc(z) as a sum: the series of erf converges for any argument that is met here
    erf = "(SELECT 2 / sqrt(pi()) * sum(CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END * exp((2 * n + 1) * ln(greatest(sqrt(chi2 / 2), 1e-300)) - lgamma(n + 1)) / (2 * n + 1)) FROM range(0, 120) t(n))"
    gaps = [f"SELECT '{c}' AS feature, {q._r(f'avg(abs({c}_t - {c}_c) / g.{c})', 'mean_gap')}, {q._r(f'max(abs({c}_t - {c}_c) / g.{c})', 'max_gap')} FROM p, g" for c in q.NUMERIC]
    gaps += [f"SELECT '{c}', round(avg(CASE WHEN {c}_t = {c}_c THEN 0.0 ELSE 1.0 END), 6), CAST(NULL AS DOUBLE) FROM p" for c in q.CATEGORICAL]
    stage = "SELECT '{0}' AS stage, CAST(exposure AS BIGINT) AS exposure, bin, round(lo + bin * w, 6) AS low, round(lo + (bin + 1) * w, 6) AS high, count(*) AS n FROM (SELECT *, CAST(least(floor((n_chars - lo) / w), 9) AS BIGINT) AS bin FROM {1}, {2}) GROUP BY exposure, bin, lo, w"
    bins = lambda source: f"(SELECT min(n_chars) AS lo, (max(n_chars) - min(n_chars)) / 10 AS w FROM {source})"
    return _propensity_sql() | _single_sql() | {
        "source_csv": "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer",
        "source_zipped_csv": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey, CAST(NULL AS BIGINT) AS r_regionkey, CAST(NULL AS VARCHAR) AS r_name FROM nation UNION ALL SELECT NULL, NULL, NULL, r_regionkey, r_name FROM region",
        "source_whitespace": "SELECT CAST(s_suppkey AS DOUBLE) AS suppkey, round(s_acctbal, 2) AS acctbal, CAST(s_nationkey AS DOUBLE) AS nationkey FROM supplier",
        "source_replications": "SELECT 'N-all-' || (row_number() OVER (PARTITION BY rep ORDER BY n_nationkey) - 1) AS patient_id, CAST((n_nationkey + rep) % 2 AS INTEGER) AS exposure_status, n_nationkey - rep / 2 AS outcome, CAST(n_regionkey AS DOUBLE) AS mu0, CAST(n_regionkey + rep AS DOUBLE) AS mu1, CAST(rep AS INTEGER) AS rep, n_nationkey * (rep + 1) / 4 AS size, CAST(n_regionkey + rep AS VARCHAR) AS kind FROM nation, range(0, 3) t(rep)",
        "study_rhc": f"WITH {q.C1} x AS (SELECT * FROM base) SELECT CAST(unit_id AS VARCHAR) AS patient_id, CAST(exposure AS BIGINT) AS exposure_status, CAST(CASE WHEN n_orders > 15 THEN 1 ELSE 0 END AS BIGINT) AS outcome, CASE WHEN unit_id % 7 <> 0 THEN round(c_acctbal, 6) END AS age, region AS race FROM x",
        "study_lalonde": f"""WITH {q.C1} x AS (SELECT unit_id, exposure AS treat, coalesce(n_orders, 0) AS re75, c_acctbal AS re78 FROM base WHERE exposure = 1 OR unit_id % 2 = 1)
SELECT 'P' || (row_number() OVER (ORDER BY treat DESC, unit_id) - 1) AS patient_id, CAST(treat AS BIGINT) AS exposure_status, round(re78, 6) AS outcome, CAST(unit_id AS DOUBLE) AS age, CAST(12 AS DOUBLE) AS education, CAST(re75 AS DOUBLE) AS "RE75", {flags(four)} FROM x""",
        "study_vlbw": f"WITH {q.C1} x AS (SELECT * FROM base) SELECT CAST(unit_id AS VARCHAR) AS patient_id, CAST(exposure AS BIGINT) AS exposure_status, CAST(unit_id % 2 AS BIGINT) AS outcome, round(c_acctbal, 6) AS bwt, n_orders AS gest, CAST(7 AS DOUBLE) AS apg1, CAST(80 AS DOUBLE) AS year, region AS race, 'male' AS sex, 'born at' AS inout, '0' AS twn, 'vaginal' AS delivery FROM x WHERE unit_id % 11 <> 0 AND unit_id % 13 <> 0 AND n_orders IS NOT NULL AND c_acctbal IS NOT NULL AND region IS NOT NULL",
        "sink_chunks": "SELECT CAST(year(o_orderdate) AS BIGINT) AS year, o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL",
        "cdist_euclidean": "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), x AS (SELECT a.vec_id AS query_id, list_distance(a.e, b.e) AS z FROM v a, v b WHERE a.label = 0 AND b.label <> 0) SELECT query_id, count(*) AS n, round(min(z), 5) AS low, round(avg(z), 5) AS mean, round(max(z), 5) AS high FROM x GROUP BY query_id",
        "unmatched_ids": f"WITH {q.C1} x AS (SELECT * FROM base) SELECT unit_id FROM x t WHERE exposure = 1 AND NOT EXISTS (SELECT 1 FROM x k WHERE k.exposure = 0 AND k.region = t.region AND floor(k.c_acctbal / 25) = floor(t.c_acctbal / 25))",
        "greedy_mahalanobis": _greedy_sql("sqrt(greatest(0, (b * (t.c_acctbal - r.c_acctbal) ** 2 - 2 * ab * (t.c_acctbal - r.c_acctbal) * (t.n_orders - r.n_orders) + a * (t.n_orders - r.n_orders) ** 2) / (a * b - ab * ab)))", 0.5),
        "greedy_scaled_euclidean": _greedy_sql("sqrt((t.c_acctbal - r.c_acctbal) ** 2 / v1 + (t.n_orders - r.n_orders) ** 2 / v2)", 0.5),
        "true_att": f"{potential} SELECT round(avg(mu1 - mu0), 6) AS true_att FROM p WHERE exposure = 1",
        "pairwise_prevalence": f"{potential} SELECT region, nation, round(avg(exposure), 6) AS prevalence FROM p GROUP BY region, nation",
        "mcnemar_p": f"{rich} SELECT b, c, round(chi2, 4) AS chi2, round(1 - CASE WHEN chi2 = 0 THEN 0 ELSE {erf} END, 4) + 0.0 AS p FROM e",
        "breslow_or": f"{q.C2} SELECT round(CAST(count(*) FILTER (exposure = 1 AND quality = 1) AS DOUBLE) * count(*) FILTER (exposure = 0) / (count(*) FILTER (exposure = 0 AND quality = 1) * count(*) FILTER (exposure = 1)), 6) AS odds_ratio FROM c",
        "mapd_pm_features": f"{q._MATCHED} " + " UNION ALL ".join(gaps),
        "smd_order": f"{q._cohort()}, t AS ({q._one_level('c')}) SELECT row_number() OVER (ORDER BY abs(smd) DESC, feature) AS place, feature, round(smd, 6) AS smd FROM t",
        "explained_variance_two": f"WITH {q.C1} m AS (SELECT var_samp(c_acctbal) AS a, var_samp(coalesce(n_orders, 0)) AS b, covar_samp(c_acctbal, coalesce(n_orders, 0)) AS ab FROM base WHERE exposure = 1), e AS (SELECT ((a + b) + sqrt((a - b) ** 2 + 4 * ab ** 2)) / 2 / (a + b) AS x FROM m) SELECT 1 AS component, round(x, 6) AS explained, round(x, 6) AS cumulative FROM e UNION ALL SELECT 2, round(1 - x, 6), 1.0 FROM e",
        "synthetic_counts": "SELECT CAST(1 AS BIGINT) AS exposure_status, 50 AS n, 50 AS ids, 0 AS negative, 0 AS other UNION ALL SELECT 0, 450, 450, 0, 0",
        "score_coverage": f"{q.C2}, good AS (SELECT * FROM c WHERE quality = 1) {stage.format('before', 'c', bins('c'))} UNION ALL {stage.format('after', 'good', bins('good'))}",
        "melted_and_pivoted": f"WITH {q.C1} x AS (SELECT * FROM base) SELECT region, round(avg(c_acctbal), 6) AS mean, CAST(count(*) AS DOUBLE) AS n FROM x GROUP BY region",
        "metric_intervals": f"WITH {q.C1} r AS (SELECT region, nation, avg(c_acctbal) AS mean_account, avg(n_orders) AS mean_orders FROM base GROUP BY region, nation), l AS (SELECT region, 'mean_account' AS metric, mean_account AS v FROM r UNION ALL SELECT region, 'mean_orders', mean_orders FROM r), m AS (SELECT region, metric, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS sd FROM l WHERE v IS NOT NULL GROUP BY region, metric) SELECT region, metric, n, round(mean, 4) AS mean, round(sd, 4) AS sd, round(mean - 1.96 * sd / sqrt(n), 4) AS low, round(mean + 1.96 * sd / sqrt(n), 4) AS high FROM m",
        "pair_records": f"WITH {q.C1} x AS (SELECT * FROM base WHERE exposure = 1) SELECT unit_id, 'acct' AS feature, round(c_acctbal, 2) AS diff FROM x WHERE unit_id % 3 < 2 UNION ALL SELECT unit_id, 'orders', NULL FROM x WHERE unit_id % 3 = 0",
    }
