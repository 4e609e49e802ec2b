"""Registered queries over the driver's tables, and the DuckDB SQL that has to give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.weights import weights_by_kind
from ..operators import allocate, balance, components, effects, gower, knn, preprocess, propensity, report, vectors
from ..operators.checkpoints import fresh_dir
from ..operators.cohort import Cohort
from ..sources.synth import make_cohort
from ..sources.tables import parquet
from ..spec import CohortSpec, MatchSpec
from . import validation
from .matcher import CohortMatcher, greedy_match, link, two_stage

SPEC = CohortSpec("unit_id", "exposure", ("c_acctbal", "n_orders", "spend"), ("region", "nation"), ("first_order",))
NUMERIC, CATEGORICAL = ("c_acctbal", "n_orders", "spend", "first_order_days"), ("region", "nation")
WEIGHTS = {"c_acctbal": 2.0, "n_orders": 0.5, "spend": 1.5, "first_order_days": 0.0, "region": 1.0, "nation": 0.25}
K = 5
RICH = 2_500_000


# -- cohorts ---------------------------------------------------------------------------------------------------------


def _exact_sum(c: str) -> Column:
    """The sum of a double to six decimals, whatever the order of the rows, so that equal customers get equal sums; the plain one where a value doesn't fit."""
    exact = F.col(c).try_cast("decimal(28,6)")
    return F.when(F.count(exact) == F.count(c), F.sum(exact).cast("double")).otherwise(F.sum(c))


def customers(spark: SparkSession, d: str) -> DataFrame:
    orders = parquet(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").cast("double").alias("n_orders"), _exact_sum("o_totalprice").alias("spend"), F.min("o_orderdate").alias("first_order"))
    nation = parquet(spark, d, "nation").join(parquet(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = parquet(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    exposed = (F.col("c_mktsegment") == "MACHINERY") & (F.col("c_custkey") % 5 == 0)
    return rows.select(F.col("c_custkey").alias("unit_id"), F.when(exposed, 1).otherwise(0).alias("exposure"), "c_acctbal", "n_orders", "spend", "first_order", F.col("r_name").alias("region"), F.col("c_nationkey").cast("string").alias("nation"))


def customers_with_gaps(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("unit_id")
    all_gone = i % 97 == 1
    gone = {"c_acctbal": (i % 10 == 3) | all_gone, "region": (i % 7 == 2) | all_gone, "n_orders": (i % 11 == 5) | all_gone, "spend": all_gone, "first_order": all_gone, "nation": all_gone}
    return customers(spark, d).withColumns({c: F.when(~x, F.col(c)) for c, x in gone.items()})


def documents(spark: SparkSession, d: str) -> DataFrame:
    rows = parquet(spark, d, "labels").join(parquet(spark, d, "documents").select("doc_id", "n_chars", "lang", "source"), "doc_id")
    return rows.select(F.col("doc_id").alias("unit_id"), F.col("toxic").alias("exposure"), F.col("n_chars").cast("double").alias("n_chars"), "lang", "source", "quality")


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return parquet(spark, d, "embeddings").select(F.col("vec_id").alias("unit_id"), F.when(F.col("label") == 0, 1).otherwise(0).alias("exposure"), "embedding")


C1 = """o AS (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS n_orders, sum(o_totalprice) AS spend, min(o_orderdate) AS first_order FROM orders GROUP BY o_custkey),
base AS (SELECT c_custkey AS unit_id, CASE WHEN c_mktsegment = 'MACHINERY' AND c_custkey % 5 = 0 THEN 1 ELSE 0 END AS exposure, c_acctbal, n_orders, spend, first_order,
         r_name AS region, CAST(c_nationkey AS VARCHAR) AS nation
  FROM customer LEFT JOIN o ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
gaps AS (SELECT unit_id, exposure, CASE WHEN unit_id % 10 <> 3 AND unit_id % 97 <> 1 THEN c_acctbal END AS c_acctbal, CASE WHEN unit_id % 11 <> 5 AND unit_id % 97 <> 1 THEN n_orders END AS n_orders,
         CASE WHEN unit_id % 97 <> 1 THEN spend END AS spend, CASE WHEN unit_id % 97 <> 1 THEN first_order END AS first_order,
         CASE WHEN unit_id % 7 <> 2 AND unit_id % 97 <> 1 THEN region END AS region, CASE WHEN unit_id % 97 <> 1 THEN nation END AS nation FROM base),
"""


def _cohort(gaps: bool = False) -> str:
    return f"WITH {C1} c AS (SELECT *, date_diff('microsecond', (SELECT min(first_order) FROM {'gaps' if gaps else 'base'}), first_order) / 86400000000.0 AS first_order_days FROM {'gaps' if gaps else 'base'})"


C2 = "WITH c AS (SELECT doc_id AS unit_id, toxic AS exposure, CAST(n_chars AS DOUBLE) AS n_chars, lang, source, quality FROM labels JOIN documents USING (doc_id))"


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if kind == "double" else F.col(c).cast("long").alias(c) if kind in ("int", "smallint") else F.col(c) for c, kind in df.dtypes))


def _r(x: str, name: str, places: int = 6) -> str:
    return f"round({x}, {places}) AS {name}"


# -- distances -------------------------------------------------------------------------------------------------------


def _gower(spark, d, gaps=False, weights=None):
    cohort = Cohort.of(customers_with_gaps(spark, d) if gaps else customers(spark, d), SPEC)
    return cohort, gower.fit(cohort.controls, NUMERIC, CATEGORICAL, weights)


def _gower_sql(weights: dict | None = None, gaps: bool = False) -> str:
    w = weights or dict.fromkeys((*NUMERIC, *CATEGORICAL), 1.0)
    delta = {c: f"abs(q.{c} - r.{c}) / g.{c}" for c in NUMERIC} | {c: f"CASE WHEN q.{c} = r.{c} THEN 0.0 ELSE 1.0 END" for c in CATEGORICAL}
    used = [c for c in delta if isinstance(w[c], str) or w[c] > 0]  # a text is SQL of its own
    both = {c: f"q.{c} IS NOT NULL AND r.{c} IS NOT NULL" for c in used}
    top = " + ".join(f"CASE WHEN {both[c]} THEN CAST({w[c]} AS DOUBLE) * ({delta[c]}) ELSE 0.0 END" for c in used)
    bottom = " + ".join(f"CASE WHEN {both[c]} THEN CAST({w[c]} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END" for c in used)
    ranges = ", ".join(f"CASE WHEN coalesce(max({c}) - min({c}), 0) = 0 THEN 1.0 ELSE max({c}) - min({c}) END AS {c}" for c in NUMERIC)
    return f"""{_cohort(gaps)}, g AS (SELECT {ranges} FROM c WHERE exposure = 0),
pairs AS (SELECT q.unit_id AS query_id, r.unit_id AS ref_id, CASE WHEN {bottom} > 0 THEN ({top}) / ({bottom}) ELSE 1.0 END AS distance
          FROM c q, c r, g WHERE q.exposure = 1 AND r.exposure = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS rank FROM pairs)"""


_PAIR_STATS = f"SELECT query_id, count(*) AS n, {_r('min(distance)', 'low')}, {_r('avg(distance)', 'mean')}, {_r('max(distance)', 'high')} FROM pairs GROUP BY query_id"
_KNN = f"SELECT query_id, ref_id, {_r('distance', 'distance')}, rank FROM ranked WHERE rank <= {K}"


def _pair_stats(cohort: Cohort, model: gower.GowerModel) -> DataFrame:
    return _rounded(knn.summary(cohort.exposed, cohort.controls, "unit_id", model))


def gower_pairs(spark, d):
    return _pair_stats(*_gower(spark, d))


def gower_nulls(spark, d):
    return _pair_stats(*_gower(spark, d, gaps=True))


def gower_weighted(spark, d):
    return _pair_stats(*_gower(spark, d, weights=WEIGHTS))


def gower_recombined(spark, d):
    """The weighted distances again, from a store of unweighted differences."""
    cohort, model = _gower(spark, d)
    store = components.write(cohort.exposed, cohort.controls, "unit_id", model, fresh_dir(spark, "components"))
    return _rounded(store.summary(spark, WEIGHTS))


def gower_store_subset(spark, d):
    """The five nearest of every fourth exposed row among the controls of even id, by two features, from the store."""
    cohort, model = _gower(spark, d, gaps=True)
    store = components.write(cohort.exposed, cohort.controls, "unit_id", model, fresh_dir(spark, "components"))
    some = cohort.exposed.where("unit_id % 4 = 0").select(F.col("unit_id").alias("query_id"))
    return _rounded(store.nearest(spark, {"c_acctbal": 2.0, "region": 0.5}, K, some, F.col("ref_id") % 2 == 0))


def gower_ranges(spark, d):
    _, model = _gower(spark, d, gaps=True)
    return _rounded(spark.createDataFrame(sorted((c, float(x)) for c, x in model.ranges.items()), "feature string, span double"))


def sd_weights_controls(spark, d):
    cohort, _ = _gower(spark, d)
    return _rounded(spark.createDataFrame(sorted(gower.sd_weights(cohort.controls, NUMERIC, CATEGORICAL).items()), "feature string, weight double"))


def sd_weights_pooled(spark, d):
    cohort, _ = _gower(spark, d)
    return _rounded(spark.createDataFrame(sorted(gower.sd_weights(cohort.rows, NUMERIC, CATEGORICAL).items()), "feature string, weight double"))


def _sd_sql(where: str) -> str:
    rows = " UNION ALL ".join(f"SELECT '{c}' AS feature, {_r(f'(max({c}) - min({c})) / (1.96 * stddev_samp({c}))', 'weight')} FROM c {where}" for c in NUMERIC)
    return f"{_cohort()} {rows} UNION ALL " + " UNION ALL ".join(f"SELECT '{c}', 1.0" for c in CATEGORICAL)


# -- nearest neighbours ----------------------------------------------------------------------------------------------


def knn_gower(spark, d):
    cohort, model = _gower(spark, d)
    return _rounded(knn.top_k(cohort.exposed, cohort.controls, "unit_id", model, K))


def knn_gower_nulls(spark, d):
    cohort, model = _gower(spark, d, gaps=True)
    return _rounded(knn.top_k(cohort.exposed, cohort.controls, "unit_id", model, K))


def knn_gower_within(spark, d):
    """Only neighbours within a threshold, which tasks apply before they rank."""
    cohort, model = _gower(spark, d)
    return _rounded(knn.top_k(cohort.exposed, cohort.controls, "unit_id", model, K, limit=0.05))


def knn_gower_subset(spark, d):
    """Within an explicit subset of the controls."""
    cohort, model = _gower(spark, d)
    return _rounded(knn.top_k(cohort.exposed, cohort.controls.where("region = 'ASIA'"), "unit_id", model, K))


def _vector_sides(spark, d):
    rows = embeddings(spark, d)
    n = 64
    columns = tuple(F.element_at("embedding", i + 1).cast("double") for i in range(n))
    return rows.where("exposure = 1"), rows.where("exposure = 0"), columns


def knn_cosine(spark, d):
    q, r, columns = _vector_sides(spark, d)
    return _rounded(knn.top_k(q, r, "unit_id", vectors.VectorMetric("cosine", columns), K))


def knn_euclidean(spark, d):
    q, r, columns = _vector_sides(spark, d)
    return _rounded(knn.top_k(q, r, "unit_id", vectors.VectorMetric("l2", columns), K))


def _vector_sql(function: str) -> str:
    return f"""WITH v AS (SELECT vec_id AS unit_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ranked AS (SELECT q.unit_id AS query_id, r.unit_id AS ref_id, {function}(q.e, r.e) AS distance, row_number() OVER (PARTITION BY q.unit_id ORDER BY {function}(q.e, r.e), r.unit_id) AS rank
           FROM v q, v r WHERE q.label = 0 AND r.label <> 0) {_KNN}"""


def knn_mahalanobis(spark, d):
    rows = Cohort.of(customers(spark, d), SPEC).rows.where("n_orders is not null")
    model = vectors.fit_mahalanobis(rows.where("exposure = 0"), ("c_acctbal", "n_orders"), pooled=rows)
    return _rounded(knn.top_k(rows.where("exposure = 1"), rows.where("exposure = 0"), "unit_id", model.metric(), K))


_MAHALANOBIS = f"""{_cohort()}, k AS (SELECT * FROM c WHERE n_orders IS NOT NULL),
s AS (SELECT var_samp(c_acctbal) + 1e-6 AS a, var_samp(n_orders) + 1e-6 AS b, covar_samp(c_acctbal, n_orders) AS ab FROM k),
pairs AS (SELECT q.unit_id AS query_id, r.unit_id AS ref_id,
   sqrt(greatest(0, (b * (q.c_acctbal - r.c_acctbal) ** 2 - 2 * ab * (q.c_acctbal - r.c_acctbal) * (q.n_orders - r.n_orders) + a * (q.n_orders - r.n_orders) ** 2) / (a * b - ab * ab))) AS distance
   FROM k q, k r, s WHERE q.exposure = 1 AND r.exposure = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS rank FROM pairs) {_KNN}"""


def caliper_band_join(spark, d):
    rows = customers(spark, d)
    return _rounded(knn.band_join(rows.where("exposure = 1"), rows.where("exposure = 0"), "unit_id", "c_acctbal", 25.0))


def caliper_relaxed(spark, d):
    rows = customers(spark, d)
    return _rounded(knn.relaxed_band_join(rows.where("exposure = 1"), rows.where("exposure = 0"), "unit_id", "c_acctbal", 1.5))


_BAND = "WITH {c1} x AS (SELECT q.unit_id AS query_id, r.unit_id AS ref_id, abs(q.c_acctbal - r.c_acctbal) AS gap FROM base q, base r WHERE q.exposure = 1 AND r.exposure = 0)"


def caliper_diagnostics(spark, d):
    cohort, model = _gower(spark, d)
    return _rounded(knn.diagnostics(cohort.exposed, cohort.controls, "unit_id", model, 20, 0.15, knn.Band("c_acctbal", 300.0)))


def candidate_usage(spark, d):
    cohort, model = _gower(spark, d)
    return allocate.usage(knn.top_k(cohort.exposed, cohort.controls, "unit_id", model, 1))


# -- cohort and features ---------------------------------------------------------------------------------------------


def cohort_split(spark, d):
    rows = Cohort.of(customers_with_gaps(spark, d), SPEC).view()
    return _rounded(rows.groupBy("exposure").agg(F.count("*").alias("n"), *(F.count(c).alias(f"n_{c}") for c in (*NUMERIC, *CATEGORICAL))))


def datetime_days(spark, d):
    return _rounded(Cohort.of(customers(spark, d), SPEC).rows.select("unit_id", "first_order_days"))


def binning_log_scale(spark, d):
    spec = CohortSpec("unit_id", "exposure", ("c_acctbal", "n_orders", "spend"), log=("spend",), bins=("n_orders",), bin_method="binned", bin_width=4)
    rows = Cohort.of(customers_with_gaps(spark, d), spec).rows
    pre = preprocess.fit(rows, spec)
    return _rounded(pre.transform(rows, "unit_id").toDF("unit_id", "z_acctbal", "bin_orders", "z_log_spend"))


def onehot(spark, d):
    spec = CohortSpec("unit_id", "exposure", (), ("region",), onehot=True)
    rows = Cohort.of(customers_with_gaps(spark, d), spec).rows
    out = preprocess.fit(rows, spec).transform(rows, "unit_id")
    return _rounded(out.toDF("unit_id", *(c.replace("region_", "is_").replace(" ", "_").lower() for c in out.columns[1:])))


def label_encode_impute(spark, d):
    rows = Cohort.of(customers_with_gaps(spark, d), SPEC).rows
    code = preprocess.label_codes(rows, ["region"])["region"]
    filled = preprocess.impute(rows.withColumn("region_code", code.cast("long")), ("c_acctbal",), ("nation",))
    return _rounded(filled.select("unit_id", "region_code", "c_acctbal", "nation"))


def design_matrix(spark, d):
    spec = CohortSpec("unit_id", "exposure", ("c_acctbal", "n_orders"), ("region",))
    rows = Cohort.of(customers_with_gaps(spark, d), spec).rows
    pre = preprocess.for_propensity(rows, spec)
    columns = propensity.design_columns(pre, propensity.design(pre.columns, spec, "c_acctbal * n_orders + c_acctbal:region"))
    names = [c.replace(":", "_x_").replace(" ", "_").lower() for c, _ in columns]
    return _rounded(rows.select("unit_id", *(x.alias(n) for n, (_, x) in zip(names, columns))))


def _region_flags(prefix: str, factor: str = "") -> str:
    flag = lambda v: f"(region {'IS NULL' if v is None else f'= {chr(39)}{v}{chr(39)}'})"
    levels = ("AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", None)
    return ", ".join(f"coalesce(CAST({flag(v)} AS DOUBLE), 0.0){factor} AS {prefix}{str(v).replace(' ', '_').lower()}" for v in levels)


# -- balance and pairs -----------------------------------------------------------------------------------------------


def _nearest_pairs(spark, d):
    """The pairing of the metric queries: each exposed unit with its nearest control (controls may repeat)."""
    cohort, model = _gower(spark, d)
    pairs = knn.top_k(cohort.exposed, cohort.controls, "unit_id", model, 1)
    return cohort, link(cohort.rows, pairs, SPEC)


_MATCHED = _gower_sql() + """, first AS (SELECT query_id, ref_id, distance, dense_rank() OVER (ORDER BY query_id) - 1 AS match_group FROM ranked WHERE rank = 1),
m AS (SELECT c.*, match_group, 1 AS is_exposed FROM c JOIN first ON unit_id = query_id UNION ALL SELECT c.*, match_group, 0 FROM c JOIN first ON unit_id = ref_id),
p AS (SELECT match_group, """ + ", ".join(f"t.{c} AS {c}_t, k.{c} AS {c}_c" for c in ("unit_id", *NUMERIC, *CATEGORICAL)) + """ FROM first JOIN c t ON t.unit_id = query_id JOIN c k ON k.unit_id = ref_id)"""


def smd_numeric(spark, d):
    return _rounded(balance.smd_numeric(Cohort.of(customers_with_gaps(spark, d), SPEC).rows, NUMERIC, "exposure"))


def smd_categorical(spark, d):
    return _rounded(balance.smd_categorical(Cohort.of(customers_with_gaps(spark, d), SPEC).rows, CATEGORICAL, "exposure"))


def _stats_sql(c: str, source: str = "c") -> str:
    on = lambda f, x: f"{f}({c}) FILTER (exposure = {x})"
    pooled = f"sqrt(({on('var_samp', 1)} + {on('var_samp', 0)}) / 2)"
    return f"""SELECT '{c}' AS feature, {on('avg', 1)} AS mean_exposed, {on('stddev_samp', 1)} AS std_exposed, {on('avg', 0)} AS mean_control, {on('stddev_samp', 0)} AS std_control,
  CASE WHEN {pooled} = 0 THEN 0.0 ELSE abs({on('avg', 1)} - {on('avg', 0)}) / {pooled} END AS smd FROM {source}"""


def _levels_sql(c: str, source: str = "c") -> str:
    return f"""SELECT '{c}' AS feature, level, pe AS p_exposed, pc AS p_control, CASE WHEN sqrt((pe * (1 - pe) + pc * (1 - pc)) / 2) = 0 THEN 0.0 ELSE abs(pe - pc) / sqrt((pe * (1 - pe) + pc * (1 - pc)) / 2) END AS smd
  FROM (SELECT {c} AS level, count(*) FILTER (exposure = 1) / any_value(te) AS pe, count(*) FILTER (exposure = 0) / any_value(tc) AS pc
        FROM {source}, (SELECT CAST(count({c}) FILTER (exposure = 1) AS DOUBLE) AS te, CAST(count({c}) FILTER (exposure = 0) AS DOUBLE) AS tc FROM {source}) WHERE {c} IS NOT NULL GROUP BY {c})"""


def _smd_tables(source: str = "c") -> tuple[str, str]:
    return " UNION ALL ".join(_stats_sql(c, source) for c in NUMERIC), " UNION ALL ".join(_levels_sql(c, source) for c in CATEGORICAL)


_SIX = lambda *names: ", ".join(_r(n, n) for n in names)


def balance_table(spark, d):
    table = balance.balance_table(Cohort.of(customers(spark, d), SPEC).rows, NUMERIC, CATEGORICAL, "exposure")
    return table.select("feature", "result", "mean_exposed", "mean_control", "smd")


def before_after(spark, d):
    cohort, matched = _nearest_pairs(spark, d)
    return _rounded(balance.before_after(cohort.rows, matched, NUMERIC, CATEGORICAL, "exposure"))


def _one_level(source: str) -> str:
    numeric, levels = _smd_tables(source)
    return f"SELECT feature, smd FROM ({numeric}) UNION ALL SELECT feature, arg_max(smd, CASE WHEN level = '1' THEN '1' ELSE '0' END || level) AS smd FROM ({levels}) GROUP BY feature"


def mean_smd(spark, d):
    rows = Cohort.of(customers(spark, d), SPEC).rows
    return _rounded(balance.mean_smd(balance.one_level_smd(rows, NUMERIC, CATEGORICAL, "exposure")))


def baseline_sd(spark, d):
    return _rounded(balance.baseline_sd(Cohort.of(customers(spark, d), SPEC).rows, NUMERIC, "exposure"))


def matched_pairs(spark, d):
    _, matched = _nearest_pairs(spark, d)
    return _rounded(matched.select("unit_id", "exposure", "match_group", "is_exposed", "n_matches", "match_distance"))


def pairwise_differences(spark, d):
    cohort, matched = _nearest_pairs(spark, d)
    pairs = balance.pair_rows(matched, "exposure", ("unit_id", *NUMERIC))
    sds = {r["feature"]: r["sd"] for r in balance.baseline_sd(cohort.rows, NUMERIC, "exposure").collect()}
    return _rounded(pairs.select(F.col("match_group").cast("long").alias("match_group"), *(((F.col(f"{c}_t") - F.col(f"{c}_c")) / sds[c]).alias(c) for c in NUMERIC)))


def pair_quality(spark, d):
    cohort, matched = _nearest_pairs(spark, d)
    sds = {r["feature"]: r["sd"] for r in balance.baseline_sd(cohort.rows, NUMERIC, "exposure").collect()}
    return _rounded(balance.pair_quality(balance.pair_rows(matched, "exposure", (*NUMERIC, *CATEGORICAL)), NUMERIC, CATEGORICAL, sds))


def mapd_pm(spark, d):
    cohort, matched = _nearest_pairs(spark, d)
    model = gower.fit(cohort.controls, NUMERIC, CATEGORICAL)
    return _rounded(balance.worst_pairs(balance.pair_rows(matched, "exposure", (*NUMERIC, *CATEGORICAL)), NUMERIC, CATEGORICAL, dict(model.ranges)))


# -- effects ---------------------------------------------------------------------------------------------------------


def unadjusted_att(spark, d):
    return _rounded(effects.att(customers(spark, d), "spend", "exposure"), 4)


def unadjusted_or(spark, d):
    return _rounded(effects.odds_ratio(documents(spark, d), "quality", "exposure"))


def _with_rich(matched: DataFrame) -> DataFrame:
    return matched.withColumn("rich", F.when(F.col("spend") > RICH, 1).otherwise(0))


def mcnemar(spark, d):
    _, matched = _nearest_pairs(spark, d)
    return _rounded(effects.mcnemar(balance.pair_rows(_with_rich(matched), "exposure", ("rich",)), "rich"))


def conditional_or(spark, d):
    _, matched = _nearest_pairs(spark, d)
    return _rounded(effects.conditional_odds_ratio(balance.pair_rows(_with_rich(matched), "exposure", ("rich",)), "rich"))


def mantel_haenszel(spark, d):
    rows = documents(spark, d)
    return _rounded(effects.stratified_odds_ratio(rows.withColumn("match_group", F.col("source")), "quality", "exposure"))


def att_ols_cluster(spark, d):
    _, matched = _nearest_pairs(spark, d)
    return _rounded(effects.att_cluster(matched, "spend", "exposure"), 4)


def retention(spark, d):
    cohort, model = _gower(spark, d)
    pairs = knn.top_k(cohort.exposed, cohort.controls, "unit_id", model, 1, limit=0.03)
    return _rounded(effects.retention(link(cohort.rows, pairs, SPEC), "exposure"))


def match_counts(spark, d):
    cohort, model = _gower(spark, d)
    return effects.match_counts(knn.top_k(cohort.exposed, cohort.controls, "unit_id", model, K, limit=0.05))


def matching_summary(spark, d):
    cohort, model = _gower(spark, d)
    pairs = knn.top_k(cohort.exposed, cohort.controls, "unit_id", model, 2, limit=0.05)
    return _rounded(effects.matching_summary(pairs, cohort.exposed))


def simulation_summary(spark, d):
    """Replications stand in by nation: each gives an estimate of the difference, held against the whole table's."""
    rows = customers(spark, d)
    truth = effects.att(rows, "c_acctbal", "exposure").first()[0]
    on = lambda x: F.avg(F.when(F.col("exposure") == x, F.col("c_acctbal")))
    runs = rows.groupBy("region", "nation").agg((on(1) - on(0)).alias("att")).withColumn("true_att", F.lit(truth)).withColumnRenamed("region", "method")
    return _rounded(effects.simulation_summary(runs), 4)


# -- report data -----------------------------------------------------------------------------------------------------


def feature_histogram(spark, d):
    return _rounded(report.histogram(documents(spark, d), "n_chars", "exposure"))


def level_proportions(spark, d):
    return _rounded(report.proportions(documents(spark, d), "lang", "exposure"))


def ecdf_support(spark, d):
    return _rounded(report.ecdf(documents(spark, d), "n_chars", "exposure"))


def hard_negatives(spark, d):
    """The hardest controls by a given score."""
    rows = customers(spark, d).where("exposure = 0")
    score = 1 / (1 + F.exp(-(F.col("c_acctbal") / 10000.0)))
    return _rounded(rows.select("unit_id", score.alias("score")).orderBy(F.desc("score"), "unit_id").limit(50))


# -- whole runs without SQL ------------------------------------------------------------------------------------------


def _pairs_out(pairs: DataFrame) -> DataFrame:
    return pairs.select("query_id", "ref_id", F.round("distance", 6).alias("distance"), "phase")


def match_gower(spark, d):
    return _pairs_out(CohortMatcher(customers_with_gaps(spark, d), SPEC).match(MatchSpec(threshold=0.25, gower_sd_weights=True, k_candidates=200)).pairs)


def match_gower_fuzzy(spark, d):
    return _pairs_out(CohortMatcher(customers(spark, d), SPEC).match(MatchSpec(threshold=0.02, fuzzy_limit=0.06, n_neighbors=2, k_candidates=50, gower_weights=weights_by_kind(NUMERIC, CATEGORICAL, 1.0, 0.5))).pairs)


def match_mcf(spark, d):
    return _pairs_out(CohortMatcher(customers(spark, d), SPEC).match(MatchSpec(threshold=0.25, k_candidates=50, mcf=True, competitive_match=False)).pairs)


_PLAIN = CohortSpec("unit_id", "exposure", ("c_acctbal", "n_orders", "spend"), ("region",), bin_method="scaler", onehot=True)


def match_mahalanobis(spark, d):
    return _pairs_out(CohortMatcher(customers(spark, d), _PLAIN).match(MatchSpec(threshold=3.0, k_candidates=100, metric="mahalanobis")).pairs)


def match_euclidean_pca(spark, d):
    return _pairs_out(CohortMatcher(customers(spark, d), _PLAIN).match(MatchSpec(threshold=3.0, k_candidates=100, metric="euclidean", pca_filter=True)).pairs)


def match_propensity(spark, d):
    scored = CohortMatcher(customers(spark, d), _PLAIN).fit_propensity("c_acctbal + n_orders * spend")
    return _pairs_out(scored.match(MatchSpec(method="propensity", metric="euclidean", propensity_caliper=0.2, k_candidates=100)).pairs)


def match_hybrid(spark, d):
    scored = CohortMatcher(customers(spark, d), _PLAIN).fit_propensity("c_acctbal + n_orders")
    return _pairs_out(scored.match(MatchSpec(threshold=0.3, ps_hybrid=True, ps_caliper_strict=False, k_candidates=100)).pairs)


def match_greedy(spark, d):
    return _rounded(greedy_match(CohortMatcher(customers(spark, d), SPEC), "mahalanobis", caliper=2.0))


def match_two_stage(spark, d):
    first = MatchSpec(method="propensity", metric="euclidean", n_neighbors=3, k_candidates=100)
    return _pairs_out(two_stage(customers(spark, d), _PLAIN, first, MatchSpec(threshold=0.4, k_candidates=50), "c_acctbal + n_orders").pairs)


def propensity_fit(spark, d):
    return _rounded(CohortMatcher(customers(spark, d), _PLAIN).fit_propensity().propensity.scores, 4)


def method_comparison(spark, d):
    """All methods side by side; the outcome is the balance on the account."""
    spec = CohortSpec("unit_id", "exposure", ("n_orders", "spend"), ("region",), bin_method="scaler", onehot=True)
    found = validation.compare(customers(spark, d).na.fill(0.0), spec, "c_acctbal")
    return _rounded(found.drop("seconds"), 4)


def explained_variance(spark, d):
    return _rounded(report.explained_variance(customers(spark, d).where("exposure = 1"), ("c_acctbal", "n_orders", "spend"))[0])


def synthetic_cohort(spark, d):
    features = [
        {"name": "age", "kind": "numeric", "dist": "normal", "exposed": (38, 5), "control": (32, 12)},
        {"name": "sex", "kind": "categorical", "exposed": {"f": 0.6, "m": 0.4}, "control": {"f": 0.5, "m": 0.5}},
    ]
    return make_cohort(spark, 500, 50, features)


_QUERIES = (
    cohort_split, datetime_days, binning_log_scale, onehot, label_encode_impute, design_matrix, gower_ranges, gower_pairs, gower_nulls, gower_weighted, gower_recombined, gower_store_subset, sd_weights_controls, sd_weights_pooled,
    knn_gower, knn_gower_nulls, knn_gower_within, knn_gower_subset, knn_cosine, knn_euclidean, knn_mahalanobis, caliper_band_join, caliper_relaxed, caliper_diagnostics, candidate_usage,
    smd_numeric, smd_categorical, balance_table, before_after, mean_smd, baseline_sd, matched_pairs, pairwise_differences, pair_quality, mapd_pm,
    unadjusted_att, unadjusted_or, mcnemar, conditional_or, mantel_haenszel, att_ols_cluster, retention, match_counts, matching_summary, simulation_summary,
    feature_histogram, level_proportions, ecdf_support, hard_negatives,
    match_gower, match_gower_fuzzy, match_mcf, match_mahalanobis, match_euclidean_pca, match_propensity, match_hybrid, match_greedy, match_two_stage, method_comparison, propensity_fit, explained_variance, synthetic_cohort,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    gap, numeric, levels = _cohort(True), *_smd_tables()
    n_all = ", ".join(f"count({c}) AS n_{c}" for c in (*NUMERIC, *CATEGORICAL))
    sd = {c: f"(SELECT sqrt((var_samp({c}) FILTER (exposure = 1) + var_samp({c}) FILTER (exposure = 0)) / 2) FROM c)" for c in NUMERIC}
    rich = _MATCHED + f", d AS (SELECT count(*) AS n_pairs, count(*) FILTER (coalesce(spend_t, 0) > {RICH} AND coalesce(spend_c, 0) <= {RICH}) AS b, count(*) FILTER (coalesce(spend_t, 0) <= {RICH} AND coalesce(spend_c, 0) > {RICH}) AS c FROM p), e AS (SELECT *, CASE WHEN b = 0 OR c = 0 THEN b + 0.5 ELSE CAST(b AS DOUBLE) END AS x, CASE WHEN b = 0 OR c = 0 THEN c + 0.5 ELSE CAST(c AS DOUBLE) END AS y FROM d)"
    z = lambda c: f"({c} - (SELECT avg({c}) FROM c)) / (SELECT stddev_pop({c}) FROM c)"
    zero = lambda c: f"coalesce({z(c)}, 0.0)"
    return {
        "cohort_split": f"{gap} SELECT CAST(exposure AS BIGINT) AS exposure, count(*) AS n, {n_all} FROM c GROUP BY exposure",
        "datetime_days": f"{_cohort()} SELECT unit_id, {_SIX('first_order_days')} FROM c",
        "binning_log_scale": f"{gap} SELECT unit_id, {_r(z('c_acctbal'), 'z_acctbal')}, floor((n_orders - 1) / 4) + 1 AS bin_orders, round((ln(1 + spend) - (SELECT avg(ln(1 + spend)) FROM c)) / (SELECT stddev_pop(ln(1 + spend)) FROM c), 6) AS z_log_spend FROM c",
        "onehot": f"{gap} SELECT unit_id, {_region_flags('is_')} FROM c",
        "label_encode_impute": f"{gap}, l AS (SELECT region, row_number() OVER (ORDER BY region) - 1 AS code FROM (SELECT DISTINCT region FROM c WHERE region IS NOT NULL)), top AS (SELECT nation FROM c WHERE nation IS NOT NULL GROUP BY nation ORDER BY count(*) DESC, nation LIMIT 1) SELECT unit_id, code AS region_code, round(coalesce(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.5) FROM c)), 6) AS c_acctbal, coalesce(nation, (SELECT nation FROM top)) AS nation FROM c LEFT JOIN l USING (region)",
        "design_matrix": f"{gap}, s AS (SELECT unit_id, region, {zero('c_acctbal')} AS a, {zero('n_orders')} AS n FROM c) SELECT unit_id, {_r('a', 'c_acctbal')}, {_r('n', 'n_orders')}, round(a * n, 6) + 0.0 AS c_acctbal_x_n_orders, "
        + ", ".join(f"CASE WHEN region {'IS NULL' if v is None else '= ' + chr(39) + v + chr(39)} THEN round(a, 6) ELSE 0.0 END AS c_acctbal_x_region_{str(v).replace(' ', '_').lower()}" for v in ("AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", None)) + " FROM s",
        "gower_ranges": f"{gap} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, {_r(f'max({c}) - min({c})', 'span')} FROM c WHERE exposure = 0" for c in NUMERIC),
        "gower_pairs": f"{_gower_sql()} {_PAIR_STATS}", "gower_nulls": f"{_gower_sql(gaps=True)} {_PAIR_STATS}", "gower_weighted": f"{_gower_sql(WEIGHTS)} {_PAIR_STATS}", "gower_recombined": f"{_gower_sql(WEIGHTS)} {_PAIR_STATS}",
        "gower_store_subset": f"""{_gower_sql(dict.fromkeys((*NUMERIC, *CATEGORICAL), 0.0) | {"c_acctbal": 2.0, "region": 0.5}, gaps=True)}, near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS place FROM ranked WHERE query_id % 4 = 0 AND ref_id % 2 = 0)
SELECT query_id, ref_id, {_r('distance', 'distance')}, place AS rank FROM near WHERE place <= {K}""",
        "sd_weights_controls": _sd_sql("WHERE exposure = 0"), "sd_weights_pooled": _sd_sql(""),
        "knn_gower": f"{_gower_sql()} {_KNN}", "knn_gower_nulls": f"{_gower_sql(gaps=True)} {_KNN}", "knn_gower_within": f"{_gower_sql()} {_KNN} AND distance <= 0.05",
        "knn_gower_subset": f"{_gower_sql()}, sub AS (SELECT query_id, ref_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS rank FROM pairs JOIN c ON unit_id = ref_id WHERE region = 'ASIA') {_KNN.replace('FROM ranked', 'FROM sub')}",
        "knn_cosine": _vector_sql("list_cosine_distance"), "knn_euclidean": _vector_sql("list_distance"), "knn_mahalanobis": _MAHALANOBIS,
        "caliper_band_join": f"{_BAND.format(c1=C1)} SELECT query_id, ref_id, {_r('gap', 'gap')} FROM x WHERE gap <= 25",
        "caliper_relaxed": f"{_BAND.format(c1=C1)}, n AS (SELECT query_id, min(gap) AS best FROM x GROUP BY query_id) SELECT query_id, ref_id, {_r('gap', 'gap')}, best > 1.5 AS relaxed FROM x JOIN n USING (query_id) WHERE gap <= CASE WHEN best <= 1.5 THEN 1.5 ELSE 3.0 END",
        "caliper_diagnostics": f"{_gower_sql()}, f AS (SELECT pairs.* FROM pairs JOIN c q ON q.unit_id = query_id JOIN c r ON r.unit_id = ref_id WHERE abs(q.c_acctbal - r.c_acctbal) <= 300), n AS (SELECT query_id, count(*) AS eligible, count(*) FILTER (distance <= 0.15) AS within_threshold, min(distance) AS a, max(distance) AS b FROM f GROUP BY query_id) SELECT u.unit_id AS query_id, coalesce(eligible, 0) AS eligible, least(coalesce(eligible, 0), 20) AS retained, coalesce(within_threshold, 0) AS within_threshold, {_r('a', 'min_distance')}, {_r('b', 'max_distance')}, coalesce(eligible, 0) > 20 AS truncated_by_k, coalesce(within_threshold, 0) > 20 AS within_threshold_truncated_by_k FROM c u LEFT JOIN n ON query_id = u.unit_id WHERE exposure = 1",
        "candidate_usage": f"{_gower_sql()} SELECT ref_id, count(*) AS n_users FROM ranked WHERE rank = 1 GROUP BY ref_id",
        "smd_numeric": f"{gap} SELECT feature, {_SIX('mean_exposed', 'std_exposed', 'mean_control', 'std_control', 'smd')} FROM ({numeric})",
        "smd_categorical": f"{gap} SELECT feature, level, {_SIX('p_exposed', 'p_control', 'smd')} FROM ({levels})",
        "balance_table": f"{_cohort()}, t AS (SELECT feature, mean_exposed, mean_control, smd FROM ({numeric}) UNION ALL SELECT feature || ': ' || level[1:15], 100 * p_exposed, 100 * p_control, smd FROM ({levels})) SELECT feature, CASE WHEN smd < 0.1 THEN 'OK' ELSE 'BAD' END AS result, round_even(mean_exposed, 3) AS mean_exposed, round_even(mean_control, 3) AS mean_control, round_even(smd, 3) AS smd FROM t",
        "before_after": f"{_MATCHED} SELECT a.feature, round(a.smd, 6) AS smd_before, round(b.smd, 6) AS smd_after FROM ({_one_level('c')}) a LEFT JOIN ({_one_level('m')}) b USING (feature)",
        "mean_smd": f"{_cohort()} SELECT {_r('avg(abs(smd))', 'mas')}, {_r('max(abs(smd))', 'max_smd')} FROM ({_one_level('c')})",
        "baseline_sd": f"{_cohort()} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round({sd[c]}, 6) AS sd" for c in NUMERIC),
        "matched_pairs": f"{_MATCHED} SELECT query_id AS unit_id, 1 AS exposure, CAST(match_group AS DOUBLE) AS match_group, 1 AS is_exposed, CAST(1 AS DOUBLE) AS n_matches, CAST(0 AS DOUBLE) AS match_distance FROM first UNION ALL SELECT ref_id, 0, match_group, 0, NULL, round(distance, 6) FROM first",
        "pairwise_differences": f"{_MATCHED} SELECT match_group, " + ", ".join(_r(f"({c}_t - {c}_c) / {sd[c]}", c) for c in NUMERIC) + " FROM p",
        "pair_quality": f"{_MATCHED} " + " UNION ALL ".join([f"SELECT '{c}' AS feature, {_r(f'avg(x)', 'mean_diff')}, {_r('quantile_cont(x, 0.5)', 'median_diff')}, {_r('max(x)', 'max_diff')}, CAST(NULL AS DOUBLE) AS mismatch_rate FROM (SELECT abs({c}_t - {c}_c) / {sd[c]} AS x FROM p)" for c in NUMERIC] + [f"SELECT '{c}', NULL, NULL, NULL, round(avg(CASE WHEN {c}_t = {c}_c THEN 0.0 ELSE 1.0 END), 6) FROM p" for c in CATEGORICAL]),
        "mapd_pm": f"{_MATCHED} SELECT round(avg(greatest(" + ", ".join(f"abs({c}_t - {c}_c) / g.{c}" for c in NUMERIC) + ")), 6) AS mapd, round(avg((" + " + ".join(f"CASE WHEN {c}_t = {c}_c THEN 0.0 ELSE 1.0 END" for c in CATEGORICAL) + ") / 2), 6) AS pm FROM p, g",
        "unadjusted_att": f"{_cohort()} SELECT round(avg(spend) FILTER (exposure = 1) - avg(spend) FILTER (exposure = 0), 4) AS att FROM c",
        "unadjusted_or": f"{C2}, n AS (SELECT count(*) FILTER (exposure = 1 AND quality = 1) + 1e-10 AS a, count(*) FILTER (exposure = 1 AND quality = 0) + 1e-10 AS b, count(*) FILTER (exposure = 0 AND quality = 1) + 1e-10 AS c, count(*) FILTER (exposure = 0 AND quality = 0) + 1e-10 AS d FROM c) SELECT round(a * d / (b * c), 6) AS odds_ratio FROM n",
        "mcnemar": f"{rich} SELECT n_pairs, b, c, round(x / y, 6) AS odds_ratio, round(exp(ln(x / y) - 1.96 * sqrt(1 / x + 1 / y)), 6) AS ci_low, round(exp(ln(x / y) + 1.96 * sqrt(1 / x + 1 / y)), 6) AS ci_high, round(CASE WHEN b + c = 0 THEN 0.0 ELSE greatest(abs(b - c) - 1, 0) ** 2 / (b + c) END, 6) AS chi2 FROM e",
        "conditional_or": f"{rich} SELECT n_pairs, CASE WHEN n_pairs >= 5 THEN round(x / y, 6) END AS odds_ratio FROM e",
        "mantel_haenszel": f"{C2}, t AS (SELECT source, count(*) FILTER (exposure = 1 AND quality = 1) AS a, count(*) FILTER (exposure = 1 AND quality = 0) AS b, count(*) FILTER (exposure = 0 AND quality = 1) AS c, count(*) FILTER (exposure = 0 AND quality = 0) AS d, count(*) AS n FROM c GROUP BY source) SELECT round(sum(a * d / CAST(n AS DOUBLE)) / sum(b * c / CAST(n AS DOUBLE)), 6) AS odds_ratio FROM t",
        "att_ols_cluster": f"{_MATCHED}, y AS (SELECT match_group AS g, exposure AS x, spend AS y FROM m WHERE spend IS NOT NULL), t AS (SELECT avg(y) FILTER (x = 1) AS m1, avg(y) FILTER (x = 0) AS m0, count(*) FILTER (x = 1) AS n1, count(*) FILTER (x = 0) AS n0, count(*) AS n, count(DISTINCT g) AS k FROM y), u AS (SELECT g, sum(CASE WHEN x = 1 THEN (y - m1) / n1 ELSE -(y - m0) / n0 END) AS u FROM y, t GROUP BY g) SELECT round(any_value(m1 - m0), 4) AS att, round(sqrt(any_value(k / (k - 1.0) * (n - 1.0) / (n - 2.0)) * sum(u * u)), 4) AS se FROM u, t",
        "retention": f"{_gower_sql()}, x AS (SELECT count(*) AS exposed FROM c WHERE exposure = 1), y AS (SELECT count(*) AS matched FROM ranked WHERE rank = 1 AND distance <= 0.03) SELECT exposed, matched, round(matched / CAST(exposed AS DOUBLE), 6) AS retention FROM x, y",
        "match_counts": f"{_gower_sql()}, n AS (SELECT query_id, count(*) AS n_matches FROM ranked WHERE rank <= {K} AND distance <= 0.05 GROUP BY query_id) SELECT n_matches, count(*) AS n_exposed FROM n GROUP BY n_matches ORDER BY n_exposed DESC, n_matches LIMIT 10",
        "matching_summary": f"{_gower_sql()}, k AS (SELECT * FROM ranked WHERE rank <= 2 AND distance <= 0.05), u AS (SELECT ref_id, count(*) AS n FROM k GROUP BY ref_id), x AS (SELECT count(*) AS n_exposed FROM c WHERE exposure = 1) SELECT n_exposed, (SELECT count(DISTINCT query_id) FROM k) AS n_matched, (SELECT count(*) FROM k) AS n_pairs, (SELECT count(*) FROM u) AS n_controls, (SELECT count(*) FROM u WHERE n > 1) AS n_reused, round((SELECT count(DISTINCT query_id) FROM k) / CAST(n_exposed AS DOUBLE), 6) AS ratio FROM x",
        "simulation_summary": f"{_cohort()}, t AS (SELECT avg(c_acctbal) FILTER (exposure = 1) - avg(c_acctbal) FILTER (exposure = 0) AS truth FROM c), r AS (SELECT region AS method, avg(c_acctbal) FILTER (exposure = 1) - avg(c_acctbal) FILTER (exposure = 0) AS att FROM c GROUP BY region, nation), e AS (SELECT method, att - truth AS e FROM r, t WHERE att IS NOT NULL) SELECT method, count(*) AS n, round(avg(e), 4) AS bias, round(sqrt(avg(e * e)), 4) AS rmse, round(stddev_samp(e) / sqrt(count(*)), 4) AS mcse_bias, round(stddev_samp(e * e) / (2 * sqrt(avg(e * e)) * sqrt(count(*))), 4) AS mcse_rmse FROM e GROUP BY method",
        "feature_histogram": f"{C2}, b AS (SELECT min(n_chars) AS lo, (max(n_chars) - min(n_chars)) / 30 AS w FROM c) SELECT CAST(exposure AS BIGINT) AS exposure, CAST(least(floor((n_chars - lo) / w), 29) AS BIGINT) AS bin, round(any_value(lo) + CAST(least(floor((n_chars - lo) / w), 29) AS BIGINT) * any_value(w), 6) AS low, round(any_value(lo) + (CAST(least(floor((n_chars - lo) / w), 29) AS BIGINT) + 1) * any_value(w), 6) AS high, count(*) AS n FROM c, b GROUP BY exposure, CAST(least(floor((n_chars - lo) / w), 29) AS BIGINT)",
        "level_proportions": f"{C2} SELECT CAST(exposure AS BIGINT) AS exposure, lang AS level, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY exposure) AS DOUBLE), 6) AS proportion FROM c GROUP BY exposure, lang",
        "ecdf_support": f"{C2}, d AS (SELECT exposure, n_chars, cume_dist() OVER (PARTITION BY exposure ORDER BY n_chars) AS share FROM c) SELECT DISTINCT CAST(exposure AS BIGINT) AS exposure, n_chars AS value, {_r('share', 'share')} FROM d",
        "hard_negatives": f"{_cohort()} SELECT unit_id, round(1 / (1 + exp(-(c_acctbal / 10000.0))), 6) AS score FROM c WHERE exposure = 0 ORDER BY 1 / (1 + exp(-(c_acctbal / 10000.0))) DESC, unit_id LIMIT 50",
    }
