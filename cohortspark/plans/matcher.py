"""Cohort matching from end to end: views, distance, candidates, allocation, linked result, balance."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import feature_maps
from ..operators import allocate, balance, effects, gower, knn, preprocess, propensity, vectors
from ..operators.checkpoints import saved
from ..operators.cohort import Cohort
from ..operators.kernel import Rules
from ..operators.ranges import numbered
from ..spec import CohortSpec, MatchSpec

log = logging.getLogger("cohortspark")
log.addHandler(logging.NullHandler())


@dataclass(frozen=True)
class MatchResult:
    """Tables of one matching run, all lazy over what was saved of it.

    ``pairs``: (query_id, ref_id, distance, phase).  ``matched``: the population's
    columns with match_group, is_exposed, n_matches and match_distance; exposed
    rows without a match have no group and 0 matches.
    """

    pairs: DataFrame
    matched: DataFrame
    spec: CohortSpec
    candidates: DataFrame
    weights: dict[str, float] = field(default_factory=dict)
    diagnostics: DataFrame | None = None
    threshold: float = float("inf")

    @property
    def matched_exposed(self) -> DataFrame:
        return self.matched.where((F.col("is_exposed") == 1) & F.col("match_group").isNotNull())

    @property
    def matched_controls(self) -> DataFrame:
        return self.matched.where(F.col("is_exposed") == 0)

    @property
    def unmatched_exposed(self) -> DataFrame:
        return self.matched.where((F.col("is_exposed") == 1) & F.col("match_group").isNull())

    def balance(self, include_unmatched: bool = False) -> DataFrame:
        rows = self.matched if include_unmatched else self.matched.where("match_group is not null")
        return balance.balance_table(rows, self.spec.numeric_features(), self.spec.categorical, self.spec.exposure)

    def summary(self) -> DataFrame:
        return effects.matching_summary(self.pairs, self.matched.where("is_exposed = 1"))

    def pair_rows(self, *columns: str) -> DataFrame:
        return balance.pair_rows(self.matched, self.spec.exposure, columns)


class CohortMatcher:
    """A validated population and, once fitted, its propensity scores."""

    def __init__(self, df: DataFrame, spec: CohortSpec):
        self.spec = spec
        self.cohort = Cohort.of(df, spec)
        self.propensity: propensity.PropensityResult | None = None

    @property
    def population(self) -> DataFrame:
        return self.cohort.rows

    def processed(self) -> tuple[DataFrame, dict[str, str], dict[str, list[str]]]:
        """The preprocessed population, and the maps between its columns and the original features."""
        pre = preprocess.fit(self.population, self.spec)
        up, down = feature_maps(pre.columns, self.spec.numeric, self.spec.categorical, self.spec.datetime)
        return pre.transform(self.population, self.spec.id_col, self.spec.exposure), up, down

    def fit_propensity(self, formula: str | None = None, seed: int = 404, **strategy) -> CohortMatcher:
        """A matcher whose population has propensity_score and propensity_logit; earlier scores are replaced."""
        out = object.__new__(CohortMatcher)
        out.spec = self.spec
        found = propensity.fit_propensity(self.population, self.spec, formula, seed, **strategy)
        scores = saved(found.scores, "scores")
        out.propensity = replace(found, scores=scores)
        out.cohort = Cohort(propensity.attach(self.population, scores, self.spec.id_col), self.spec)
        return out

    def feature_map(self) -> dict:
        """Metadata of the propensity fit; empty before."""
        return dict(self.propensity.metadata) if self.propensity else {}

    def _metric(self, m: MatchSpec):
        """(rows with what the metric needs, metric, weights by column)."""
        s, rows = self.spec, self.cohort.rows
        if m.method == "propensity":
            return rows, vectors.VectorMetric("l1", (F.col(m.propensity_col),)), {m.propensity_col: 1.0}
        numeric = [*s.numeric_features(), *(c for c in m.extra_numeric if c not in s.numeric_features())]
        if m.metric == "gower":
            categorical = list(s.categorical)
            if m.gower_cat_features is not None:
                if extra := set(m.gower_cat_features) - {*numeric, *categorical}:
                    raise ValueError(f"not matching features: {sorted(extra)}")
                wanted = list(m.gower_cat_features)
                numeric = [c for c in (*numeric, *categorical) if c not in wanted]
                categorical = wanted
            else:
                numeric = [c for c in numeric if c not in categorical]
            rows = rows.withColumns({c: F.col(c).cast("double") for c in numeric} | {c: F.col(c).cast("string") for c in categorical})
            controls = rows.where(F.col(s.exposure) == 0)
            weights = m.gower_weights
            if m.gower_sd_weights:
                weights = gower.sd_weights(controls if m.gower_sd_reference == "controls" else rows, numeric, categorical, m.gower_sd_mult)
            model = gower.fit(controls, numeric, categorical, weights)
            return rows, model, dict(model.weights)
        if s.categorical and not s.onehot and m.metric != "gower":
            raise ValueError("categorical features need onehot=True unless the metric is 'gower'")
        pre = preprocess.fit(rows, s)
        extra = [c for c in m.extra_numeric if c not in pre.columns]
        rows = pre.transform(rows, s.id_col, s.exposure, *{*extra, *([m.propensity_col] if m.propensity_col in rows.columns else [])})
        names = [*pre.columns, *extra]
        weights = [m.weight_propensity if c == m.propensity_col else m.weight_numeric for c in names]
        columns = preprocess.plain_matrix(names, weights)
        flat = [f"_v{i}" for i in range(len(names))]
        rows = rows.withColumns(dict(zip(flat, columns)))
        if m.pca_filter:
            found = vectors.fit_pca(rows.where(F.col(s.exposure) == 1), [F.col(c) for c in flat])
            projected = found.project([F.col(c) for c in flat])
            flat = [f"_p{i}" for i in range(len(projected))]
            rows = rows.withColumns(dict(zip(flat, projected)))
        if m.metric == "mahalanobis":
            model = vectors.fit_mahalanobis(rows.where(F.col(s.exposure) == 0), flat, pooled=rows)
            return rows, model.metric(), dict(zip(names, weights))
        return rows, vectors.VectorMetric("l2" if m.metric == "euclidean" else "cosine", tuple(F.col(c) for c in flat)), dict(zip(names, weights))

    def _search(self, m: MatchSpec):
        """(edges of the k nearest for all or some exposed rows, hybrid diagnostics for the k of a full list, weights, threshold in force, length of a full list, the rows with equal values as of ``knn.members_of``).

        The first is a function of k and a table of query_id (None: all exposed rows).
        """
        s = self.spec
        needs = m.method == "propensity" or m.ps_hybrid or m.propensity_caliper is not None
        if needs and m.propensity_col not in self.cohort.rows.columns:
            raise ValueError("fit the propensity model first")
        threshold = m.threshold
        if m.method == "propensity" and m.propensity_caliper is not None:
            threshold = m.propensity_caliper * vectors.logit_sd(self.cohort.rows, m.propensity_col)
        rows, metric, weights = self._metric(m)
        exposed, controls = rows.where(F.col(s.exposure) == 1), rows.where(F.col(s.exposure) == 0)
        most = m.k_candidates or max(1, exposed.count() * m.n_neighbors)
        limit = max(threshold, m.fuzzy_limit if m.fuzzy_limit is not None else threshold) + m.distance_eps
        of = lambda queries: exposed if queries is None else exposed.join(queries.select(F.col("query_id").alias(s.id_col)), s.id_col, "left_semi")
        members = lambda band=None: None if m.mcf or not m.competitive_match else knn.members_of(exposed, s.id_col, metric, band)
        if not m.ps_hybrid:
            return lambda k, queries=None: knn.top_k(of(queries), controls, s.id_col, metric, k, limit), None, weights, threshold + m.distance_eps, most, members()
        width = m.ps_caliper * vectors.logit_sd(self.cohort.rows, m.propensity_col)
        first = m.k_candidates or min(most, allocate.LOOK_AHEAD)
        edges, info = knn.swept(exposed, controls, s.id_col, metric, first, threshold, knn.Band(m.propensity_col, width), limit)
        if first < most:
            info = knn.judged(info, most)
        info = saved(info, "hybrid")
        alone = info.where("eligible = 0").select("query_id") if not m.ps_caliper_strict else None
        if alone is not None and not alone.limit(1).count():
            alone = None

        def search(k: int, queries=None) -> DataFrame:
            if k == first:
                near = edges if queries is None else edges.join(queries.select("query_id"), "query_id", "left_semi")
            else:
                near = knn.top_k(of(queries), controls, s.id_col, metric, k, limit, knn.Band(m.propensity_col, width))
            if alone is None:
                return near
            again = alone if queries is None else alone.join(queries.select("query_id"), "query_id", "left_semi")
            return near.unionByName(knn.top_k(of(again), controls, s.id_col, metric, k, limit, knn.Band(m.propensity_col, 2 * width)))

        return search, info, weights, threshold + m.distance_eps, most, members(knn.Band(m.propensity_col, width))

    def candidates(self, m: MatchSpec) -> tuple[DataFrame, DataFrame | None, dict[str, float], float]:
        """(edges with rank, hybrid diagnostics, weights, threshold in force), with lists of full length."""
        search, info, weights, threshold, most, _ = self._search(m)
        return search(most), info, weights, threshold

    def match(self, m: MatchSpec | None = None, **options) -> MatchResult:
        """Match exposed rows to controls without replacement.

        Without ``k_candidates`` lists have no end, but only the edges that the
        allocation can use are made: short lists first, longer ones for the rows
        that need them.
        """
        m = m or MatchSpec(**options)
        search, info, weights, threshold, most, members = self._search(m)
        rules = Rules(threshold, m.n_neighbors, m.safe, m.fuzzy_limit, m.competitive_match, m.global_optimal, m.mcf)
        if m.k_candidates is None and not m.mcf:  # the flow scales costs by the dearest edge of full lists
            pairs, edges = allocate.match_growing(search, rules, most, members=members)
        elif members is not None:  # lists of full length; equal rows are one class
            pairs, edges = allocate.match_growing(search, rules, most, first=most, members=members)
        else:
            edges = saved(search(most), "candidates")
            pairs = allocate.match(edges, rules)
        pairs = saved(pairs, "pairs")
        return MatchResult(pairs, link(self.cohort.rows, pairs, self.spec, m.include_unmatched), self.spec, edges, weights, info, threshold)


def link(rows: DataFrame, pairs: DataFrame, spec: CohortSpec, include_unmatched: bool = True) -> DataFrame:
    """The population's rows that take part, with their match columns.

    match_group numbers the matched exposed ids from 0, in order.
    """
    groups = pairs.groupBy("query_id").agg(F.count("*").cast("double").alias("n_matches"))
    groups = numbered(groups, "query_id").withColumn("match_group", F.col("number").cast("double")).drop("number")
    heads = groups.select(F.col("query_id").alias("_id"), "match_group", F.lit(1).alias("is_exposed"), "n_matches", F.lit(0.0).alias("match_distance"))
    tails = pairs.join(groups.select("query_id", "match_group"), "query_id").select(F.col("ref_id").alias("_id"), "match_group", F.lit(0).alias("is_exposed"), F.lit(None).cast("double").alias("n_matches"), F.col("distance").alias("match_distance"))
    rows = rows.drop("match_group", "is_exposed", "n_matches", "match_distance")
    keyed = rows[spec.id_col] == F.col("_id")
    out = rows.join(heads.unionByName(tails), keyed).drop("_id")
    if not include_unmatched:
        return out
    none = F.lit(None).cast("double")
    rest = rows.where(F.col(spec.exposure) == 1).join(pairs.select(F.col("query_id").alias("_id")).distinct(), keyed, "left_anti")
    return out.unionByName(rest.select("*", none.alias("match_group"), F.lit(1).alias("is_exposed"), F.lit(0.0).alias("n_matches"), none.alias("match_distance")))


def greedy_match(matcher: CohortMatcher, metric: str = "mahalanobis", caliper: float = float("inf"), ratio: int = 1, impute: bool = True, categorical_codes: bool = True, band: float | None = None) -> DataFrame:
    """(query_id, ref_id, distance): plain nearest-first matching; missing values filled by medians and modes, categories coded over the whole population.

    Calipers on propensity, and ``band`` (only controls whose logit is that
    near), are in standard deviations of the logit.
    """
    s, rows = matcher.spec, matcher.cohort.rows
    if impute:
        rows = preprocess.impute(rows, s.numeric_features(), s.categorical)
    names = list(s.numeric_features())
    if categorical_codes and s.categorical:
        codes = preprocess.label_codes(rows, s.categorical)
        rows = rows.withColumns({f"_code_{c}": x.cast("double") for c, x in codes.items()})
        names += [f"_code_{c}" for c in s.categorical]
    exposed, controls = rows.where(F.col(s.exposure) == 1), rows.where(F.col(s.exposure) == 0)
    if metric == "mahalanobis":
        space = vectors.fit_mahalanobis(controls, names, pooled=rows).metric()
    elif metric == "propensity":
        space = vectors.VectorMetric("l1", (F.col("propensity_logit"),))
        caliper *= vectors.logit_sd(matcher.cohort.rows, "propensity_logit")
    elif metric == "scaled_euclidean":
        sds = {r["feature"]: r["sd"] for r in balance.baseline_sd(rows, names, s.exposure).collect()}
        space = vectors.VectorMetric("l2", tuple(F.col(c) / sds[c] for c in names))
    else:
        raise ValueError("metric has to be 'mahalanobis', 'scaled_euclidean' or 'propensity'")
    most = max(1, exposed.count() * ratio)
    near = None if band is None else knn.Band("propensity_logit", band * vectors.logit_sd(matcher.cohort.rows, "propensity_logit"))
    of = lambda queries: exposed if queries is None else exposed.join(queries.select(F.col("query_id").alias(s.id_col)), s.id_col, "left_semi")
    return allocate.greedy_growing(lambda k, queries: knn.top_k(of(queries), controls, s.id_col, space, k, caliper, near), caliper, ratio, most)


def two_stage(df: DataFrame, spec: CohortSpec, first: MatchSpec, second: MatchSpec, formula: str | None = None) -> MatchResult:
    """1:K on propensity, then the second specification among the survivors."""
    scored = CohortMatcher(df, spec).fit_propensity(formula)
    stage = scored.match(first)
    ids = stage.matched.where("match_group is not null").select(spec.id_col).distinct()
    survivors = saved(scored.population.join(ids, spec.id_col, "left_semi").drop(*(f"{c}_days" for c in spec.datetime)), "survivors")
    return CohortMatcher(survivors, spec).match(second)
