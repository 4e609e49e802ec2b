"""DuckDB SQL of an allocation with several candidates for each exposed row, and registered queries held against it.

The SQL restates the rules by recursion: horizons by synchronous rounds, the
greedy phase one match at a time, the assignment of least cost by going through
the rows of a component and keeping, for each set of controls that later rows
could still want, the cheapest way to come by it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.weights import weights_by_kind
from ..operators import allocate, gower, knn, preprocess, report, vectors
from ..operators.cohort import Cohort
from ..operators.kernel import FLOW_SCALE, FLOW_UNMATCHED, Rules
from ..spec import CohortSpec, MatchSpec
from . import more_queries as more
from . import queries as q
from .matcher import CohortMatcher


def horizons_sql(ranked: str, k: int, rules: Rules) -> str:
    """Common tables up to ``cats``: the edges within the final horizons and their kinds (0 safe, 1 competitive, 2 fuzzy).

    ``ranked``: common tables that end in ranked(query_id, ref_id, distance, rank); a threshold may be SQL.
    """
    limit = rules.threshold if rules.fuzzy_limit is None else max(rules.threshold, rules.fuzzy_limit)
    return f"""{ranked.replace("WITH ", "WITH RECURSIVE ", 1) if not ranked.startswith("WITH RECURSIVE") else ranked},
near AS (SELECT query_id, ref_id, distance, rank, distance <= {rules.threshold} AS inside, count(*) OVER (PARTITION BY query_id) AS most FROM ranked WHERE rank <= {k} AND distance <= {limit}),
grow(turn, query_id, h, moved) AS (SELECT 0, query_id, CAST(1 AS BIGINT), true FROM near GROUP BY query_id
  UNION ALL SELECT turn + 1, query_id, h + CAST(grows AS BIGINT), bool_or(grows) OVER () FROM (
    SELECT turn, query_id, h, count(*) FILTER (alone) < {rules.safe_matches} AND h < most AS grows FROM (
      SELECT turn, x.query_id, h, most, inside AND count(*) FILTER (inside) OVER (PARTITION BY ref_id) = 1 AS alone FROM grow x JOIN near n ON n.query_id = x.query_id AND n.rank <= h WHERE moved)
    GROUP BY turn, query_id, h, most)),
horizon AS (SELECT query_id, max(h) AS horizon FROM grow GROUP BY query_id),
cats AS (SELECT query_id, ref_id, distance, rank, CASE WHEN NOT inside THEN 2 WHEN count(*) FILTER (inside) OVER (PARTITION BY ref_id) > 1 THEN 1 ELSE 0 END AS kind FROM near JOIN horizon USING (query_id) WHERE rank <= horizon)"""


def allocation_sql(ranked: str, k: int, rules: Rules) -> str:
    n = rules.n_neighbors
    cost = f"round_even(distance * {FLOW_SCALE} / (SELECT max(distance) FROM near), 0)" if rules.flow else "distance"
    # by cost alone in the flow, where an empty place has its price; else as many places as can be filled, then by cost
    order = f"empty * {FLOW_SCALE + FLOW_UNMATCHED} + cost" if rules.flow else "(empty, cost)"
    greedy = f"""
limited AS (SELECT query_id FROM cats GROUP BY query_id HAVING count(*) FILTER (kind = 0) < {rules.safe_matches}),
sure AS (SELECT query_id, ref_id, 'safe' AS phase FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM cats JOIN limited USING (query_id) WHERE kind = 0) WHERE i <= {n}),
wants AS (SELECT query_id, ref_id, rank, kind FROM cats JOIN limited USING (query_id) WHERE kind > 0),
run(i, picks, taken) AS (
  SELECT CAST(0 AS BIGINT), coalesce((SELECT list(struct_pack(query_id := query_id, ref_id := ref_id, phase := phase)) FROM sure), []), coalesce((SELECT list(ref_id) FROM sure), [])
  UNION ALL SELECT i + 1, list_append(picks, pick), list_append(taken, pick.ref_id) FROM (
    SELECT i, picks, taken, arg_min(pick, place) AS pick FROM (
      SELECT i, picks, taken, (len(list_filter(picks, lambda p: p.query_id = w.query_id)), count(*) FILTER (kind = 1), count(*) FILTER (kind = 2), w.query_id) AS place,
             struct_pack(query_id := w.query_id, ref_id := arg_min(ref_id, (kind, rank)), phase := CASE WHEN min(kind) = 1 THEN 'competitive' ELSE 'fuzzy' END) AS pick
      FROM run JOIN wants w ON NOT list_contains(taken, w.ref_id) WHERE len(list_filter(picks, lambda p: p.query_id = w.query_id)) < {n} GROUP BY i, picks, taken, w.query_id)
    GROUP BY i, picks, taken)),
chosen AS (SELECT p.query_id, p.ref_id, p.phase FROM (SELECT unnest(arg_max(picks, i)) AS p FROM run))"""
    nobody = "chosen AS (SELECT query_id, ref_id, '' AS phase FROM cats WHERE false)"
    least = f"""
free AS (SELECT query_id, ref_id, {cost} AS cost, {n} - (SELECT count(*) FROM chosen x WHERE x.query_id = c.query_id) AS room, count(*) OVER (PARTITION BY query_id) AS has
         FROM cats c WHERE kind < 2 AND ref_id NOT IN (SELECT ref_id FROM chosen)),
edges AS (SELECT query_id, ref_id, cost, CAST(least(room, has) AS BIGINT) AS places FROM free WHERE room > 0),
met AS (SELECT DISTINCT a.query_id AS a, b.query_id AS b FROM edges a JOIN edges b USING (ref_id)),
reach(a, b) AS (SELECT a, a FROM met UNION SELECT r.a, m.b FROM reach r JOIN met m ON m.a = r.b),
part AS (SELECT a AS query_id, min(b) AS part FROM reach GROUP BY a),
places AS (SELECT part, query_id, row_number() OVER (PARTITION BY part ORDER BY query_id, j) AS i FROM (SELECT part, query_id, unnest(range(any_value(places))) AS j FROM edges JOIN part USING (query_id) GROUP BY part, query_id)),
last AS (SELECT ref_id, max(i) AS last FROM edges JOIN places USING (query_id) GROUP BY ref_id),
options AS (SELECT p.part, p.i, p.query_id, e.ref_id, e.cost, l.last FROM places p JOIN edges e USING (query_id) JOIN last l USING (ref_id) UNION ALL SELECT part, i, query_id, NULL, 0, 0 FROM places),
ways(part, i, used, empty, cost, picks) AS (
  SELECT part, CAST(0 AS BIGINT), CAST([] AS STRUCT(r BIGINT, l BIGINT)[]), CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST([] AS STRUCT(query_id BIGINT, ref_id BIGINT)[]) FROM part GROUP BY part
  UNION ALL SELECT part, i, used, arg_min(empty, {order}), arg_min(cost, {order}), arg_min(picks, {order}) FROM (
    SELECT w.part, o.i, list_sort(list_filter(CASE WHEN o.ref_id IS NULL THEN used ELSE list_append(used, struct_pack(r := o.ref_id, l := o.last)) END, lambda x: x.l > o.i)) AS used,
           empty + CAST(o.ref_id IS NULL AS BIGINT) AS empty, w.cost + o.cost AS cost, CASE WHEN o.ref_id IS NULL THEN picks ELSE list_append(picks, struct_pack(query_id := o.query_id, ref_id := o.ref_id)) END AS picks
    FROM ways w JOIN options o ON o.part = w.part AND o.i = w.i + 1 WHERE o.ref_id IS NULL OR NOT list_contains(list_transform(used, lambda x: x.r), o.ref_id))
  GROUP BY part, i, used),
best AS (SELECT p.query_id, p.ref_id, 'optimal' AS phase FROM (SELECT unnest(arg_max(picks, i)) AS p FROM ways GROUP BY part))"""
    parts = [horizons_sql(ranked, k, rules), greedy if rules.competitive else nobody, least if rules.global_optimal else "best AS (SELECT * FROM chosen WHERE false)"]
    return f"{', '.join(parts)} SELECT query_id, ref_id, round(distance, 6) AS distance, phase FROM (SELECT * FROM chosen UNION ALL SELECT * FROM best) JOIN near USING (query_id, ref_id)"


# -- queries ---------------------------------------------------------------------------------------------------------

_GROWTH = Rules(0.06, n_neighbors=2, safe_matches=2, fuzzy_limit=0.1)


def match_horizons(spark, d):
    """How far each exposed row's list takes part, and what is in it."""
    cohort = Cohort.of(q.customers(spark, d), q.SPEC)
    model = gower.fit(cohort.controls, q.NUMERIC, q.CATEGORICAL)
    return allocate.categories(knn.top_k(cohort.exposed, cohort.controls, "unit_id", model, 25), _GROWTH)


def _pairs(spark, d, k: int | None, **options) -> DataFrame:
    return q._pairs_out(CohortMatcher(q.customers(spark, d), q.SPEC).match(MatchSpec(k_candidates=k, **options)).pairs)


def match_choice(spark, d):
    """Greedy phase and assignment, lists without an end."""
    return _pairs(spark, d, None, threshold=0.05)


def match_single_fuzzy(spark, d):
    """One control for each row out of all within reach: rows without one within the threshold take one within the fuzzy limit."""
    return _pairs(spark, d, None, threshold=0.02, fuzzy_limit=0.05)


def match_choice_optimal(spark, d):
    """Assignment alone; two controls for each row."""
    return _pairs(spark, d, 12, threshold=0.03, n_neighbors=2, competitive_match=False)


def match_choice_greedy(spark, d):
    """Greedy phase alone, three controls for each row, fuzzy ones included."""
    return _pairs(spark, d, 40, threshold=0.03, fuzzy_limit=0.08, n_neighbors=3, global_optimal=False)


def match_flow_total(spark, d):
    """The flow's pairs and their integer cost: swaps along one feature cost the same, so least-cost pairs aren't always unique."""
    result = CohortMatcher(q.customers(spark, d), q.SPEC).match(MatchSpec(k_candidates=50, threshold=0.25, mcf=True, competitive_match=False))
    largest = result.candidates.agg(F.max("distance")).first()[0] or 1.0
    cost = F.rint(F.col("distance") * FLOW_SCALE / largest)
    return result.pairs.agg(F.count("*").alias("n_pairs"), F.sum(cost).cast("long").alias("cost"))


def _chosen(spark, d, spec, formula: str | None = None, **options) -> DataFrame:
    matcher = CohortMatcher(q.customers(spark, d), spec)
    return q._pairs_out((matcher.fit_propensity(formula) if formula else matcher).match(MatchSpec(**options)).pairs)


def match_choice_mahalanobis(spark, d):
    return _chosen(spark, d, CohortSpec("unit_id", "exposure", ("c_acctbal", "n_orders")), metric="mahalanobis", threshold=0.5)


def match_choice_propensity(spark, d):
    """Two controls for each row by logit, within a hundredth of its deviation."""
    return _chosen(spark, d, more._ONE, "c_acctbal", method="propensity", metric="euclidean", propensity_caliper=0.01, n_neighbors=2)


def match_choice_hybrid(spark, d):
    """By Gower's distance among those within a fifth of the logit's deviation."""
    return _chosen(spark, d, more._PLACE, "c_acctbal", ps_hybrid=True, ps_caliper=0.2, threshold=0.05)


_THREE = CohortSpec("unit_id", "exposure", ("c_acctbal", "n_orders", "spend"), bin_method="scaler")


def match_choice_pca(spark, d):
    """By Euclidean distance over the components that hold 95 % of the exposed rows' variance."""
    return _chosen(spark, d, _THREE, metric="euclidean", pca_filter=True, threshold=0.4)


def pca_projection(spark, d):
    """How far each exposed row lies from the exposed rows' mean along the components kept, and how many these are."""
    rows = q.customers(spark, d)
    pre = preprocess.fit(rows, _THREE)
    columns = preprocess.plain_matrix(pre.columns, [1.0] * 3)
    ready = pre.transform(rows, "unit_id", "exposure").where("exposure = 1")
    model = vectors.fit_pca(ready, columns)
    norm = F.sqrt(sum((x * x for x in model.project(columns)), F.lit(0.0)))
    return q._rounded(ready.select("unit_id", norm.alias("norm"), F.lit(len(model.components)).cast("long").alias("kept")))


_TWO = CohortSpec("unit_id", "exposure", ("c_acctbal", "n_orders"))


def propensity_two(spark, d):
    """Two features and their intercept."""
    return q._rounded(CohortMatcher(q.customers(spark, d), _TWO).fit_propensity().propensity.scores, 5)


def caliper_percentiles(spark, d):
    """Percentiles over the exposed rows of the caliper's diagnostics."""
    cohort = Cohort.of(q.customers(spark, d), q.SPEC)
    model = gower.fit(cohort.controls, q.NUMERIC, q.CATEGORICAL)
    _, found = knn.swept(cohort.exposed, cohort.controls, "unit_id", model, 20, 0.15, knn.Band("c_acctbal", 300.0))
    return q._rounded(knn.percentiles(q._rounded(found)), 4)


def correlation_table(spark, d):
    return q._rounded(report.correlations(q.customers(spark, d), ("c_acctbal", "n_orders", "spend")))


def retention_spread(spark, d):
    """Replications stand in by nation: the share of customers with orders, a box for each region."""
    runs = q.customers(spark, d).groupBy("region", "nation").agg(F.avg(F.when(F.col("n_orders") > 15, 1.0).otherwise(0.0)).alias("retention"))
    return q._rounded(report.spread(runs, "retention", "region"))


_QUERIES = (match_horizons, match_choice, match_single_fuzzy, match_choice_optimal, match_choice_greedy, match_flow_total, match_choice_mahalanobis, match_choice_propensity, match_choice_hybrid, match_choice_pca, pca_projection, propensity_two, caliper_percentiles, correlation_table, retention_spread)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def _eigen_sql(x: str, y: str, z: str, rows: str) -> str:
    """Common tables up to ``l``: the covariance (a b c, d e f) of three columns and its eigenvalues l1 >= l2 >= l3 in closed form, with how many hold 95 %."""
    return f"""m AS (SELECT var_samp({x}) AS a, var_samp({y}) AS b, var_samp({z}) AS c, covar_samp({x}, {y}) AS d, covar_samp({x}, {z}) AS e, covar_samp({y}, {z}) AS f FROM {rows}),
m1 AS (SELECT *, (a + b + c) / 3 AS q FROM m), m2 AS (SELECT *, sqrt(((a - q) ** 2 + (b - q) ** 2 + (c - q) ** 2 + 2 * (d * d + e * e + f * f)) / 6) AS p FROM m1),
m3 AS (SELECT *, acos(greatest(-1, least(1, ((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (2 * p ** 3)))) / 3 AS phi FROM m2),
m4 AS (SELECT *, q + 2 * p * cos(phi) AS l1, q + 2 * p * cos(phi + 2 * pi() / 3) AS l3 FROM m3), m5 AS (SELECT *, 3 * q - l1 - l3 AS l2 FROM m4),
l AS (SELECT *, CASE WHEN l1 >= 0.95 * 3 * q THEN 1 WHEN l1 + l2 >= 0.95 * 3 * q THEN 2 ELSE 3 END AS kept FROM m5)"""


def _square_sql(x: str, y: str, z: str) -> str:
    """The squared length of (x, y, z) along the components kept: a component's share is a product of two shifted matrices, whatever its sign."""
    shifted = lambda k: (f"((a - l{k}) * {x} + d * {y} + e * {z})", f"(d * {x} + (b - l{k}) * {y} + f * {z})", f"(e * {x} + f * {y} + (c - l{k}) * {z})")
    dot = lambda i, j: " + ".join(f"{s} * {t}" for s, t in zip(shifted(i), shifted(j)))
    return " + ".join(f"CASE WHEN kept >= {k} THEN ({dot(i, j)}) / ((l{k} - l{i}) * (l{k} - l{j})) ELSE 0 END" for k, i, j in ((1, 2, 3), (2, 1, 3), (3, 1, 2)))


def _newton_two() -> str:
    """Newton's steps of an intercept and two slopes, each a 3 by 3 system by Cramer's rule."""
    scaled = ", ".join(f"coalesce(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 0) AS {n}" for c, n in (("c_acctbal", "u"), ("n_orders", "v")))
    det = lambda m: f"({m[0]} * ({m[4]} * {m[8]} - {m[5]} * {m[7]}) - {m[1]} * ({m[3]} * {m[8]} - {m[5]} * {m[6]}) + {m[2]} * ({m[3]} * {m[7]} - {m[4]} * {m[6]}))"
    h = ["h00", "h01", "h02", "h01", "h11", "h12", "h02", "h12", "h22"]
    put = lambda k: [f"g{i // 3}" if i % 3 == k else x for i, x in enumerate(h)]
    steps = ", ".join(f"{n} + {det(put(k))} / {det(h)}" for k, n in enumerate("abc"))
    sums = ", ".join([f"sum((y - p) * {x}) AS g{i}" for i, x in enumerate(("1", "u", "v"))] + [f"sum(p * (1 - p) * {x}) AS h{i}" for i, x in (("00", "1"), ("01", "u"), ("02", "v"), ("11", "u * u"), ("12", "u * v"), ("22", "v * v"))])
    return f"""WITH RECURSIVE {q.C1} x AS (SELECT unit_id, CAST(exposure AS DOUBLE) AS y, {scaled} FROM base),
s(i, a, b, c) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) UNION ALL SELECT i + 1, {steps} FROM (
  SELECT i, a, b, c, {sums} FROM (SELECT i, a, b, c, u, v, y, 1 / (1 + exp(-(a + b * u + c * v))) AS p FROM s, x WHERE i < 20) GROUP BY i, a, b, c))
SELECT unit_id, round(1 / (1 + exp(-(a + b * u + c * v))), 5) AS propensity_score, round(a + b * u + c * v, 5) AS propensity_logit FROM x, s WHERE i = 20"""


def _pca_sql() -> str:
    scaled = ", ".join(f"coalesce(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 0) AS {n}" for c, n in (("c_acctbal", "x"), ("n_orders", "y"), ("spend", "z")))
    return f"WITH {q.C1} k AS (SELECT unit_id, exposure, {scaled} FROM base), exposed AS (SELECT * FROM k WHERE exposure = 1), {_eigen_sql('x', 'y', 'z', 'exposed')}"


def oracle_sql() -> dict[str, str]:
    apart = _square_sql("(t.x - r.x)", "(t.y - r.y)", "(t.z - r.z)")
    pca = f"{_pca_sql()}, pairs AS (SELECT t.unit_id AS query_id, r.unit_id AS ref_id, sqrt(greatest(0, {apart})) AS distance FROM exposed t, k r, l WHERE r.exposure = 0), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS rank FROM pairs)"
    middle = _square_sql("(x - mx)", "(y - my)", "(z - mz)")
    share = lambda k: " + ".join(f"l{i}" for i in range(1, k + 1))
    ranked = q._gower_sql()
    sd = {c: f"(SELECT (max({c}) - min({c})) / (1.96 * stddev_samp({c})) FROM c WHERE exposure = 0)" for c in q.NUMERIC} | dict.fromkeys(q.CATEGORICAL, 1.0)
    flow = allocation_sql(ranked, 50, Rules(0.25, competitive=False, flow=True))
    at = flow.rindex(" SELECT query_id, ref_id, round(distance, 6)")
    kinds = ", ".join(f"count(*) FILTER (kind = {i}) AS n_{n}" for i, n in enumerate(("safe", "competitive", "fuzzy")))
    others = more.ranked_sql()
    return {
        "match_choice_mahalanobis": allocation_sql(others["mahalanobis"], 10**9, Rules(0.5)),
        "match_choice_propensity": allocation_sql(others["propensity"], 10**9, Rules("(SELECT 0.01 * sd FROM sd)", n_neighbors=2, safe_matches=2)),
        "match_choice_hybrid": allocation_sql(others["hybrid"], 10**9, Rules(0.05)),
        "propensity_two": _newton_two(),
        "caliper_percentiles": "WITH dg AS (" + q.oracle_sql()["caliper_diagnostics"] + ") " + " UNION ALL ".join(f"SELECT '{m}' AS measure, unnest([0, 25, 50, 75, 100]) AS percentile, round(unnest(quantile_cont({m}, [0, 0.25, 0.5, 0.75, 1])), 4) AS value FROM dg WHERE eligible > 0" for m in ("eligible", "retained", "within_threshold", "min_distance", "max_distance")),
        "correlation_table": f"WITH {q.C1} x AS (SELECT * FROM base) " + " UNION ALL ".join(f"SELECT '{a}' AS feature, '{b}' AS other, round(corr({a}, {b}), 6) AS correlation FROM x" for a in ("c_acctbal", "n_orders", "spend") for b in ("c_acctbal", "n_orders", "spend")),
        "retention_spread": f"WITH {q.C1} r AS (SELECT region, nation, avg(CASE WHEN n_orders > 15 THEN 1.0 ELSE 0.0 END) AS v FROM base GROUP BY region, nation) SELECT region, count(*) AS n, round(avg(v), 6) AS mean, "
        + ", ".join(f"round(quantile_cont(v, {s}), 6) AS {n}" for n, s in (("low", 0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("high", 1))) + " FROM r GROUP BY region",
        "match_choice_pca": allocation_sql(pca, 10**9, Rules(0.4)),
        "pca_projection": f"{_pca_sql()}, mean AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM exposed) SELECT unit_id, round(sqrt(greatest(0, {middle})), 6) AS norm, CAST(kept AS BIGINT) AS kept FROM exposed, mean, l",
        "explained_variance": f"WITH {q.C1} k AS (SELECT c_acctbal AS x, coalesce(n_orders, 0) AS y, coalesce(spend, 0) AS z FROM base WHERE exposure = 1), {_eigen_sql('x', 'y', 'z', 'k')} "
        + " UNION ALL ".join(f"SELECT {k} AS component, round(l{k} / (3 * q), 6) AS explained, round(({share(k)}) / (3 * q), 6) AS cumulative FROM l" for k in (1, 2, 3)),
        "match_horizons": f"{horizons_sql(ranked, 25, _GROWTH)} SELECT query_id, horizon, {kinds} FROM cats JOIN horizon USING (query_id) GROUP BY query_id, horizon",
        "match_choice": allocation_sql(ranked, 10**9, Rules(0.05)),
        "match_single_fuzzy": allocation_sql(ranked, 10**9, Rules(0.02, fuzzy_limit=0.05)),
        "match_choice_optimal": allocation_sql(ranked, 12, Rules(0.03, n_neighbors=2, safe_matches=2, competitive=False)),
        "match_choice_greedy": allocation_sql(ranked, 40, Rules(0.03, n_neighbors=3, safe_matches=3, fuzzy_limit=0.08, global_optimal=False)),
        "match_gower_fuzzy": allocation_sql(q._gower_sql(weights_by_kind(q.NUMERIC, q.CATEGORICAL, 1.0, 0.5)), 50, Rules(0.02, n_neighbors=2, safe_matches=2, fuzzy_limit=0.06)),
        "match_gower": allocation_sql(q._gower_sql(sd, gaps=True), 200, Rules(0.25)),
        "match_flow_total": f"{flow[:at]} SELECT count(*) AS n_pairs, CAST(sum(round_even(distance * {FLOW_SCALE} / (SELECT max(distance) FROM near), 0)) AS BIGINT) AS cost FROM best JOIN near USING (query_id, ref_id)",
    }
