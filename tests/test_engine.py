import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import allocate, effects, gower, knn, preprocess, propensity, report, vectors
from cohortspark.operators.cohort import Cohort
from cohortspark.operators.kernel import Rules
from cohortspark.plans.matcher import CohortMatcher, greedy_match
from cohortspark.sources import sinks, studies, synth, tables
from cohortspark.spec import CohortSpec, MatchSpec


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(404)
    n = 240
    rows = pd.DataFrame({
        "id": np.arange(n), "x": (rng.random(n) < 0.15).astype(int), "age": np.round(rng.normal(40, 9, n), 1), "score": rng.integers(0, 6, n).astype(float),
        "sex": rng.choice(["f", "m"], n), "area": rng.choice(["a", "b", "c"], n)})
    rows.loc[rows["id"] % 13 == 4, "age"] = np.nan
    rows.loc[rows["id"] % 17 == 3, "area"] = None
    return spark.createDataFrame(rows.astype({"area": object}).where(rows.notna(), None), "id long, x int, age double, score double, sex string, area string")


SPEC = CohortSpec("id", "x", ("age", "score"), ("sex", "area"))


def grouped_schema(spark, seed=7):
    rng = np.random.default_rng(seed)
    make = lambda n, cats: pd.DataFrame({"id": np.arange(n), "x1": rng.integers(0, 7, n), "x2": rng.integers(0, 5, n), "x3": rng.integers(0, 4, n), "cat1": rng.choice(cats, n), "cat2": rng.choice(["u", "v"], n)})
    return make(120, ["a", "b", "c"]), make(17, ["a", "b", "c", "unseen"])


def gower_by_hand(q, r, ranges, weights):
    top = bottom = 0.0
    for c, w in weights.items():
        a, b = q[c], r[c]
        if a is None or b is None or a != a or b != b:
            continue
        top += w * (abs(a - b) / ranges[c] if c in ranges else float(a != b))
        bottom += w
    return top / bottom if bottom else 1.0


def test_top_k_with_ties_is_exact(spark):
    """Many equal distances, an unseen category, weights: order is (distance, id) whatever the partitions."""
    controls, queries = grouped_schema(spark)
    names, cats = ["x1", "x2", "x3"], ["cat1", "cat2"]
    w = dict(zip(names + cats, [0.2, 0.3, 0.1, 0.25, 0.15]))
    c, q = spark.createDataFrame(controls).repartition(5), spark.createDataFrame(queries)
    model = gower.fit(c, names, cats, w)
    ranges = {n: float(controls[n].max() - controls[n].min()) for n in names}
    got = {}
    for row in knn.top_k(q, c, "id", model, 12).collect():
        got.setdefault(row["query_id"], []).append((row["rank"], row["ref_id"], row["distance"]))
    for i, query in queries.iterrows():
        want = sorted((gower_by_hand(query, r, ranges, w), j) for j, r in controls.iterrows())[:12]
        mine = sorted(got[i])
        assert [x[1] for x in mine] == [j for _, j in want] or np.allclose([x[2] for x in mine], [d for d, _ in want], atol=1e-12)
        assert np.allclose([x[2] for x in mine], [d for d, _ in want], atol=1e-12)
    pairs = knn.pairs(q, c, "id", model.distance(), names + cats)
    assert pairs.count() == 17 * 120


def test_blocks_and_string_ids_give_the_same(spark, cohort, monkeypatch):
    c = Cohort.of(cohort, SPEC)
    model = gower.fit(c.controls, ("age", "score"), ("sex", "area"))
    whole = {(r[0], r[1]): r[2] for r in knn.top_k(c.exposed, c.controls, "id", model, 3).select("query_id", "ref_id", "distance").collect()}
    monkeypatch.setattr(knn, "QUERY_BLOCK", 7)
    assert {(r[0], r[1]): r[2] for r in knn.top_k(c.exposed, c.controls, "id", model, 3).select("query_id", "ref_id", "distance").collect()} == whole
    text = Cohort.of(cohort.withColumn("id", F.format_string("u%05d", "id")), SPEC)
    got = {(int(r[0][1:]), int(r[1][1:])): r[2] for r in knn.top_k(text.exposed, text.controls, "id", model, 3).select("query_id", "ref_id", "distance").collect()}
    assert got == whole


def test_gower_edges(spark):
    rows = spark.createDataFrame([(1, None, None), (2, 3.0, "a"), (3, 3.0, "b")], "id int, x double, c string")
    model = gower.fit(rows.where("id > 1"), ["x"], ["c"])
    assert model.ranges["x"] == 1.0
    d = {(r[0], r[1]): r[2] for r in knn.pairs(rows, rows, "id", model.distance(), ["x", "c"]).collect()}
    assert d[(1, 2)] == 1.0 and d[(2, 2)] == 0.0 and d[(2, 3)] == 0.5
    none = gower.fit(rows, ["x"], ["c"], {"x": 0, "c": 0})
    assert {r[2] for r in knn.pairs(rows, rows, "id", none.distance(), ["x", "c"]).collect()} == {1.0}
    with pytest.raises(ValueError):
        model.recombined(F.array(F.lit(0.1)), [0, 0])


def test_weights_by_deviation(spark):
    rows = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 50)], "x double")
    got = gower.sd_weights(rows, ["x"], ["c"], 1.96)
    assert got["x"] == pytest.approx(50 / (1.96 * np.std([0, 1, 2, 3, 50], ddof=1))) and got["c"] == 1.0


def test_mahalanobis(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 2]])
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id int, a double, b double, c double")
    model = vectors.fit_mahalanobis(rows, ("a", "b", "c"))
    inv = np.linalg.inv(np.cov(x.T) + 1e-6 * np.eye(3))
    got = {(r[0], r[1]): r[2] for r in knn.top_k(rows.where("id < 5"), rows, "id", vectors.VectorMetric("l2", tuple(model.whitened())), 4).select("query_id", "ref_id", "distance").collect()}
    for (i, j), d in got.items():
        assert d == pytest.approx(math.sqrt((x[i] - x[j]) @ inv @ (x[i] - x[j])), abs=1e-9)
    twin = vectors.fit_mahalanobis(rows.withColumn("d", F.col("a")), ("a", "d"))
    assert np.all(np.isfinite(twin.whitener))
    with pytest.raises(ValueError):
        vectors.fit_mahalanobis(rows.withColumn("s", F.lit("x")), ("s",))
    with pytest.raises(ValueError):
        vectors.fit_mahalanobis(rows, ("a", "b"), precision=np.eye(3))
    with pytest.raises(ValueError):
        vectors.fit_mahalanobis(rows.where("id < 0"), ("a",))


def test_equal_gaps_are_equally_far_by_mahalanobis(spark):
    """References equally far on either side of a query come by id: whitened columns would tell them apart by their last bits."""
    rng = np.random.default_rng(2)
    base = rng.integers(-99999, 999999, 200) / 64
    rows = [(i, float(b), float(i % 7)) for i, b in enumerate(base)]
    rows += [(1000 + 2 * i + s, float(b) + (2 * s - 1) * g, float(i % 7)) for i, b in enumerate(base) for s in (0, 1) for g in [float(i % 50 + 1) / 64]]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    model = vectors.fit_mahalanobis(df, ("a", "b"))
    got = knn.top_k(df.where("id < 1000"), df.where("id >= 1000"), "id", model.metric(), 400).collect()
    near = {(r.query_id, r.ref_id): (r.distance, r["rank"]) for r in got}
    for i in range(200):
        (d, rank), (e, after) = near[i, 1000 + 2 * i], near[i, 1001 + 2 * i]
        assert d == e and rank < after
    gaps = np.array([[rows[q][j] - rows[r - 800][j] for j in (1, 2)] for q, r in near])
    assert np.allclose([d for d, _ in near.values()], np.sqrt(np.einsum("ij,jk,ik->i", gaps, model.precision, gaps)), rtol=1e-6, atol=1e-9)


def test_band_join_bounds_are_inclusive(spark):
    q = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, None)], "id int, z double")
    r = spark.createDataFrame([(10, 0.5), (11, -0.5), (12, 0.51), (13, 1.75)], "id int, z double")
    pairs = lambda df: sorted((x[0], x[1]) for x in df.collect())
    assert pairs(knn.band_join(q, r, "id", "z", 0.5)) == [(1, 10), (1, 11), (2, 10), (2, 12)]
    assert pairs(knn.band_join(q, r, "id", "z", 0)) == []
    relaxed = knn.relaxed_band_join(q.where("id = 2"), r.where("id = 13"), "id", "z", 0.5).collect()
    assert [(x["query_id"], x["ref_id"], x["relaxed"]) for x in relaxed] == [(2, 13, True)]


def test_band_join_deals_hot_buckets_out(spark, monkeypatch):
    """A bucket that all rows share is met in shares, by as many tasks, and gives every pair once."""
    monkeypatch.setattr(knn, "BAND_PAIRS", 1000)
    rows = spark.range(400).select("id", F.pmod("id", F.lit(10)).cast("double").alias("z"))
    got = knn.band_join(rows.where("id < 100"), rows.where("id >= 100"), "id", "z", 25.0)
    pairs = got.withColumn("task", F.spark_partition_id()).collect()
    assert len(pairs) == len({x[:2] for x in pairs}) == 100 * 300
    assert max(np.bincount([x["task"] for x in pairs])) <= 10_000
    assert knn.band_join(rows.where("id < 100"), rows.where("id >= 100"), "id", "z", 0).count() == 100 * 30


def brute_match(rows, m):
    return CohortMatcher(rows, SPEC).match(m)


def test_match_end_to_end(spark, cohort):
    result = CohortMatcher(cohort, SPEC).match(MatchSpec(threshold=0.2, n_neighbors=2, k_candidates=30))
    pairs = result.pairs.toPandas()
    assert pairs["ref_id"].is_unique and pairs.groupby("query_id").size().max() <= 2 and pairs["distance"].max() <= 0.2
    candidates = {(r[0], r[1]) for r in result.candidates.select("query_id", "ref_id").collect()}
    assert set(zip(pairs["query_id"], pairs["ref_id"])) <= candidates
    matched = result.matched.toPandas()
    n_exposed = cohort.where("x = 1").count()
    assert len(matched[matched["is_exposed"] == 1]) == n_exposed
    assert set(result.matched.columns) == {*cohort.columns, "match_group", "is_exposed", "n_matches", "match_distance"}
    groups = matched.dropna(subset=["match_group"])
    assert sorted(groups.loc[groups["is_exposed"] == 1, "match_group"]) == list(range(pairs["query_id"].nunique()))
    assert result.unmatched_exposed.count() + result.matched_exposed.count() == n_exposed
    assert result.balance().count() == 2 + 2 + 3
    assert result.summary().first()["n_pairs"] == len(pairs)
    assert CohortMatcher(cohort, SPEC).match(MatchSpec(threshold=0.0001, include_unmatched=False)).unmatched_exposed.count() == 0


def test_copies_share_lists_of_a_given_length(spark, cohort, monkeypatch):
    """With ``k_candidates`` too, copies of an exposed row share one list, and the pairs are those of a list for each."""
    from cohortspark.operators import allocate as steps

    rows = cohort.unionByName(cohort.where("x = 1").withColumn("id", F.col("id") + 1000))
    several, ranked = cohort.where("x = 1").count(), steps._ranked
    spec = MatchSpec(threshold=0.2, n_neighbors=2, k_candidates=12, fuzzy_limit=0.25)
    search = CohortMatcher(rows, SPEC)._search(spec)[0]
    want = sorted(map(tuple, steps.match(search(12), Rules(0.2, 2, 2, 0.25)).collect()))
    held = []
    monkeypatch.setattr(steps, "_ranked", lambda edges, rules: held.append(ranked(edges, rules)) or held[-1])
    got = CohortMatcher(rows, SPEC).match(spec)
    assert sorted(map(tuple, got.pairs.collect())) == want
    assert sum(x.count() for x in held) <= 12 * several < got.candidates.count()


def test_components_don_t_change_the_allocation(spark):
    """Kernel runs by component give what one run over everything gives."""
    from cohortspark.operators.kernel import allocate as kernel

    rng = np.random.default_rng(9)
    for _ in range(4):
        edges = [(int(i), int(100 + 3 * (i // 4) + rng.integers(0, 5)), float(np.round(rng.random() * 6) / 8)) for i in range(16) for _ in range(3)]
        edges = sorted({(q, r): (q, r, d) for q, r, d in edges}.values())
        df = spark.createDataFrame(edges, "query_id long, ref_id long, distance double")
        rules = Rules(0.5, 2, 2, 0.7)
        small = {(x["query_id"], x["component"]) for x in allocate.components(df).collect()}
        assert small == {(x["query_id"], x["component"]) for x in allocate.components(df, driver_edges=0).collect()}
        got = {(x[0], x[1]) for x in allocate.match(df, rules).select("query_id", "ref_id").collect()}
        rows, queries, refs = allocate._rows_of(pd.DataFrame([e for e in edges if e[2] <= 0.7], columns=["query_id", "ref_id", "distance"]))
        want = {(int(queries[i]), int(refs[rows[i][0][at]])) for i, x in enumerate(kernel(rows, len(refs), rules)[0]) for at, _ in x}
        assert len(got) == len(want)
        assert {q for q, _ in got} == {q for q, _ in want}


def test_numbering_by_ranges(spark):
    from cohortspark.plans.matcher import numbered

    rows = spark.range(500).selectExpr("id * 37 % 1009 as k", "1 as v").repartition(7)
    want = sorted((r["k"], r["number"]) for r in numbered(rows, "k").collect())
    assert sorted((r["k"], r["number"]) for r in numbered(rows, "k", one_sort=10).collect()) == want and [n for _, n in want] == list(range(500))


def test_other_methods(spark, cohort):
    full = cohort.na.fill({"age": 40.0, "area": "a"})
    scored = CohortMatcher(full, SPEC).fit_propensity("age * score + sex")
    assert scored.feature_map()["terms"] == ["age", "score", "age:score", "sex_m"]
    assert CohortMatcher(full, SPEC).feature_map() == {}
    scores = scored.population.select("propensity_score", "propensity_logit", "x").toPandas()
    assert np.allclose(scores["propensity_score"], 1 / (1 + np.exp(-scores["propensity_logit"])))
    assert scores["propensity_score"].mean() == pytest.approx(scores["x"].mean(), abs=1e-6)
    r = scored.match(MatchSpec(method="propensity", metric="euclidean", propensity_caliper=0.5))
    sd = scores["propensity_logit"].std()
    assert r.threshold == pytest.approx(0.5 * sd) and r.pairs.agg(F.max("distance")).first()[0] <= 0.5 * sd
    h = scored.match(MatchSpec(threshold=0.5, ps_hybrid=True, ps_caliper=0.3))
    logits = {x[0]: x[1] for x in scored.population.select("id", "propensity_logit").collect()}
    assert all(abs(logits[a] - logits[b]) <= 0.3 * sd + 1e-12 for a, b in h.pairs.select("query_id", "ref_id").collect())
    assert h.diagnostics.count() == full.where("x = 1").count()
    plain = CohortSpec("id", "x", ("age", "score"), ("sex",), bin_method="scaler", onehot=True)
    for m in (MatchSpec(metric="mahalanobis", threshold=2.0), MatchSpec(metric="euclidean", threshold=2.0, pca_filter=True), MatchSpec(metric="cosine", threshold=0.5)):
        assert CohortMatcher(full, plain).match(m).pairs.count() > 0
    again = scored.fit_propensity("age")
    assert again.population.columns.count("propensity_logit") == 1
    assert greedy_match(CohortMatcher(cohort, SPEC), "mahalanobis", 1.5).count() > 0


def test_strategies(spark, cohort):
    full = cohort.na.fill({"age": 40.0})
    spec = CohortSpec("id", "x", ("age", "score"))
    fit = lambda **kw: propensity.fit_propensity(full, spec, **kw).scores.toPandas()
    for kw in ({"downsample_ratio": 3}, {"n_bags": 2}, {"n_hard_mining": 80}):
        assert len(fit(**kw)) == 240
    with pytest.raises(ValueError):
        fit(n_bags=2, n_hard_mining=5)
    split = full.withColumn("age", F.col("x") * 10.0)
    with pytest.raises(RuntimeError):
        propensity.fit_propensity(split, spec, "age")
    with pytest.raises(ValueError):
        propensity.fit_propensity(full, spec, "nobody")
    from pyspark.ml.classification import LogisticRegression

    assert len(fit(estimator=LogisticRegression())) == 240


@pytest.mark.parametrize("change", [
    lambda d: d.withColumn("id", F.when(F.col("id") > 3, F.col("id"))), lambda d: d.withColumn("id", F.lit(1)), lambda d: d.withColumn("x", F.when(F.col("id") > 3, F.col("x"))),
    lambda d: d.withColumn("x", F.lit(2)), lambda d: d.withColumn("x", F.lit(0)), lambda d: d.drop("age"), lambda d: d.withColumn("age", F.array(F.lit(1))),
])
def test_bad_populations(cohort, change):
    with pytest.raises(ValueError):
        CohortMatcher(change(cohort), SPEC)


@pytest.mark.parametrize("kw", [
    {"method": "other"}, {"metric": "other"}, {"n_neighbors": 0}, {"k_candidates": 0}, {"method": "propensity"}, {"gower_sd_weights": True, "metric": "euclidean"}, {"gower_sd_weights": True, "gower_weights": {}},
    {"gower_sd_weights": True, "gower_sd_mult": 0}, {"ps_hybrid": True, "metric": "cosine"}, {"ps_caliper": -1},
])
def test_bad_match_specs(kw):
    with pytest.raises(ValueError):
        MatchSpec(**kw)


def test_other_errors(cohort):
    with pytest.raises(NotImplementedError):
        MatchSpec(replacement=True)
    with pytest.raises(ValueError):
        CohortMatcher("not a table", SPEC)
    with pytest.raises(ValueError):
        CohortMatcher(cohort, CohortSpec("id", "x", ("age",), log=("score",)))
    matcher = CohortMatcher(cohort, SPEC)
    for m in (MatchSpec(ps_hybrid=True), MatchSpec(metric="euclidean"), MatchSpec(gower_cat_features=("zz",))):
        with pytest.raises(ValueError):
            matcher.match(m)


def test_integer_categories_stay_integers(spark):
    rows = spark.createDataFrame([(1, 1, 1), (2, 0, None), (3, 0, 1)], "id int, x int, c int")
    view = Cohort.of(rows, CohortSpec("id", "x", (), ("c",))).view()
    assert {r["c"] for r in view.collect()} == {"1", None}


def test_preprocessing(spark, cohort):
    spec = CohortSpec("id", "x", ("age", "score"), ("sex", "area"), log=("score",), bins=("age",), bin_method="binned_scaler", onehot=True)
    pre = preprocess.fit(cohort, spec)
    assert pre.columns == ["binned(age)", "log(score)", "sex_m", "area_b", "area_c", "area_None"]
    out = pre.transform(cohort, "id").toPandas()
    assert out["log(score)"].mean() == pytest.approx(0, abs=1e-9) and out["log(score)"].std(ddof=0) == pytest.approx(1)
    filled = preprocess.impute(cohort, ("age",), ("area",))
    assert filled.where("age is null or area is null").count() == 0


def test_effects_by_hand(spark):
    rows = spark.createDataFrame([(0, 1, 5.0, 1), (0, 0, 3.0, 0), (1, 1, 6.0, 1), (1, 0, 7.0, 1), (2, 1, 4.0, 0), (2, 0, 1.0, 1)], "match_group int, x int, y double, b int")
    got = effects.att_cluster(rows, "y", "x").first()
    assert got["att"] == pytest.approx(4 / 3)
    u = np.array([2 - 4 / 3, -1 - 4 / 3, 3 - 4 / 3]) / 3
    assert got["se"] == pytest.approx(math.sqrt(3 / 2 * 5 / 4 * (u**2).sum()))
    assert effects.p_value(3.841458820694124) == pytest.approx(0.05)
    assert effects.retention(rows, "x").first()["retention"] == 1.0


def test_sources(spark, tmp_path):
    path = tmp_path / "a.txt"
    path.write_text("1.0  2.5\n\n  3   bad\n4\n")
    got = [tuple(r) for r in tables.whitespace(spark, str(path), ["a", "b"]).collect()]
    assert got == [(1.0, 2.5), (3.0, None), (4.0, None)]
    sinks.write_csv(spark.createDataFrame([(2, "x"), (1, "y")], "k int, v string"), str(tmp_path / "out"))
    assert [r["k"] for r in sinks.gather_chunks(spark, str(tmp_path / "out" / "*.csv"), ["k"], 2).collect()] == [1, 2]
    with pytest.raises(ValueError):
        sinks.gather_chunks(spark, str(tmp_path / "out" / "*.csv"), ["k"], 3)
    raw = spark.createDataFrame([("1", "RHC", "Yes", "7.5", "a"), ("2", "No RHC", "No", "x", "b")], "ptid string, swang1 string, dth30 string, n string, c string")
    assert [tuple(r) for r in studies.rhc(raw, ["n"], ["c", "absent"]).orderBy("patient_id").collect()] == [("1", 1, 1, 7.5, "a"), ("2", 0, 0, None, "b")]
    nsw = spark.createDataFrame([(1.0, *[float(i) for i in range(9)]), (0.0, *[1.0] * 9)], ", ".join(f"{c} double" for c in studies.LALONDE_COLUMNS))
    assert studies.lalonde(nsw, nsw).count() == 2
    arrays = {"x": np.ones((3, 2, 2)), "t": np.array([[0, 1]] * 3), "yf": np.ones((3, 2)), "mu0": np.zeros((3, 2)), "mu1": np.ones((3, 2))}
    both = tables.tensors(spark, {"train": arrays, "test": arrays}, ["a"], ["b"])
    assert both.count() == 12 and tables.tensors(spark, {"train": arrays}, ["a"], ["b"], 1).where("exposure_status = 1").count() == 3
    assert effects.true_att(both, "exposure_status").first()[0] == 1.0
    made = synth.make_cohort(spark, 50, 7, [{"name": "n", "kind": "numeric", "dist": "normal", "exposed": (0, 1), "control": (0, 1)}])
    assert made.where("exposure_status = 1").count() == 7 and made.agg(F.min("n")).first()[0] == 0.0
    assert synth.make_large_cohort(spark, 100, 0.5).count() == 100
    assert report.wide_results(report.long_results(spark.createDataFrame([("a", 1.0, 2.0)], "m string, p double, q double"), ["m"], ["p", "q"]), "m", "metric", "value", ["p", "q"]).first().asDict() == {"m": "a", "p": 1.0, "q": 2.0}


def test_zipped_csv(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/one.csv", 'k,v\n1,"a, ""b"""\n2,\n')
        z.writestr("notes.txt", "no table")
        z.writestr("two.csv", "v,k\nq,3\n")
    assert sorted(tuple(r) for r in tables.zipped_csv(spark, str(tmp_path / "a.zip"), "k int, v string").collect()) == [(1, 'a, "b"'), (2, None), (3, "q")]


def test_all_methods_side_by_side(spark, cohort):
    from cohortspark.plans.validation import METHODS, compare

    full = cohort.na.fill({"age": 40.0, "area": "a"}).withColumn("y", F.col("score") + F.col("x"))
    spec = CohortSpec("id", "x", ("age",), ("sex",), bin_method="scaler", onehot=True)
    got = compare(full, spec, "y", truth=1.0).toPandas()
    assert list(got["method"]) == list(METHODS) and got["error"].isna().all() and (got["retention"] > 0.9).all() and (got["bias"].abs() < 1.5).all()
    bad = compare(full, CohortSpec("id", "x", ("age",), ("sex",)), "y", methods=("mahalanobis", "gower")).toPandas()
    assert bad["error"].notna().tolist() == [True, False]


def test_methods_share_one_propensity_fit(spark, cohort, monkeypatch):
    from cohortspark.plans import matcher as plans
    from cohortspark.plans.validation import compare

    fits, fit = [], plans.propensity.fit_propensity
    monkeypatch.setattr(plans.propensity, "fit_propensity", lambda *args, **options: fits.append(1) or fit(*args, **options))
    full = cohort.na.fill({"age": 40.0}).withColumn("y", F.col("score"))
    got = compare(full, CohortSpec("id", "x", ("age",), ()), "y", methods=("nearest_propensity", "nearest_mahalanobis_in_caliper")).toPandas()
    assert got["error"].isna().all() and len(fits) == 1


def test_stream(spark, cohort, tmp_path):
    from cohortspark.streaming.arrivals import nearest_controls

    c = Cohort.of(cohort, SPEC)
    c.exposed.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(c.exposed.schema).parquet(str(tmp_path / "in"))
    model = gower.fit(c.controls, ("age", "score"), ("sex", "area"))
    query = nearest_controls(stream, c.controls, "id", model, 2, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2 * c.exposed.count()


def test_steep_fits_are_not_separated_ones(spark):
    fit = lambda x, y: propensity.fit_logistic(spark.createDataFrame([([float(v)], float(k)) for v, k in zip(x, y)], "x array<double>, y double"))
    # controls at one end only, cases everywhere: linear predictors reach a hundred, and there is a finite optimum
    x = np.concatenate((np.linspace(-1.7, 1.7, 400), np.linspace(1.66, 1.71, 300)))
    y = np.repeat([1.0, 0.0], (400, 300))
    a, b = fit(x, y).coefficients
    assert abs(a + b * -1.7) > propensity.SEPARATED
    gap = y - 1 / (1 + np.exp(-(a + b * x)))
    assert abs(gap.sum()) < 1e-6 and abs((gap * x).sum()) < 1e-6
    for values, labels in (([1, 2, 3, 4], [0, 0, 1, 1]), ([0, 0, 0, 1, 1], [0, 1, 0, 1, 1])):  # apart, and one level with cases only
        with pytest.raises(RuntimeError, match="separable"):
            fit(values, labels)


def test_copies_of_customers_spend_the_same(spark, tmp_path):
    """A sum of doubles hangs on the order of the rows; copies of a customer whose orders lie in other files and orders are equal all the same."""
    from cohortspark.plans import queries as core

    prices = [0.1, 0.2, 0.3, 1e5 + 0.7, 2e5 + 0.1, 0.6]
    for i in range(6):  # the i-th customer's orders turned by i, and one file for each order
        rows = [(c * 10 + i, c, prices[(i + c) % 6], dt.datetime(2020, 1, 1)) for c in range(6)]
        spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp").write.mode("append").parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(c, 1.0, "MACHINERY", 0) for c in range(7)], "c_custkey long, c_acctbal double, c_mktsegment string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, 0)], "n_nationkey int, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(0, "ASIA")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    got = {r.unit_id: r.spend for r in core.customers(spark, str(tmp_path)).collect()}
    assert got == {c: 300002.0 for c in range(6)} | {6: None}
    wide = spark.createDataFrame([(0, 1e30), (0, 1.0), (1, None)], "k int, x double").groupBy("k").agg(core._exact_sum("x").alias("x"))
    assert {r.k: r.x for r in wide.collect()} == {0: 1e30, 1: None}
