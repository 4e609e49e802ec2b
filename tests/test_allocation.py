"""Distributed steps of the allocation against the kernel on whole lists, and cells against plain distances."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import allocate, cells, gower, kernel, knn, vectors
from cohortspark.operators.kernel import Rules


def graph(seed, n=40, m=60, limit=0.4):
    rng = np.random.default_rng(seed)
    d = np.round(rng.random((n, m)) * 16) / 16 if seed % 2 else rng.random((n, m))
    q, r = np.nonzero(d <= limit)
    rows = []
    for i in np.unique(q):
        order = sorted((d[i, j], j) for j in range(m) if d[i, j] <= limit)
        rows.append((np.array([j for _, j in order]), np.array([x for x, _ in order])))
    return pd.DataFrame({"query_id": q, "ref_id": r + 1000, "distance": d[q, r]}), np.unique(q), rows


def wanted(queries, rows, chosen):
    return {(int(queries[i]), int(rows[i][0][at]) + 1000, phase) for i, c in enumerate(chosen) for at, phase in c}


@pytest.mark.parametrize("seed", [0, 1])
def test_horizons_in_shards(spark, seed):
    """Small shards and short looks ahead end where the kernel ends, and so do the categories."""
    pdf, queries, rows = graph(seed)
    rules = Rules(0.3, n_neighbors=2, safe_matches=2, fuzzy_limit=0.4)
    _, cats = kernel.allocate(rows, 60, rules)
    edges = spark.createDataFrame(pdf)
    ranked = allocate._ranked(edges, rules)
    state = {r.query_id: r.horizon for r in allocate.grown(ranked, rules, look_ahead=9, shard_edges=120).collect()}
    assert state == {r.query_id: r.horizon for r in allocate.grown(ranked, rules).collect()}
    assert state == dict(zip(queries.tolist(), cats.horizon.tolist()))
    counts = {r.query_id: (r.horizon, r.n_safe, r.n_competitive, r.n_fuzzy) for r in allocate.categories(edges, rules).collect()}
    assert counts == {int(q): (h, len(s), len(c), len(f)) for q, h, s, c, f in zip(queries, cats.horizon.tolist(), cats.safe, cats.competitive, cats.fuzzy)}


@pytest.mark.parametrize("options", [{}, {"competitive": False}, {"global_optimal": False, "fuzzy_limit": 0.4}])
def test_match_is_the_kernels(spark, options):
    pdf, queries, rows = graph(2)
    rules = Rules(0.4 if "fuzzy_limit" not in options else 0.3, n_neighbors=2, safe_matches=2, **options)
    chosen, _ = kernel.allocate(rows, 60, rules)
    edges = spark.createDataFrame(pdf)
    ranked = allocate._ranked(edges, rules)
    for pairs in (allocate.match(edges, rules), allocate._match_ranked(ranked, allocate.grown(ranked, rules), rules, one_call=0)):
        got = {(r.query_id, r.ref_id, r.phase) for r in pairs.collect()}
        assert got == wanted(queries, rows, chosen) and got


def test_peeling_leaves_the_least_cost(spark):
    """Rows whose nearest controls nobody else wants are decided before; cost and count stay those of the whole assignment."""
    pdf, queries, rows = graph(4, n=30, m=400, limit=0.05)
    rules = Rules(0.05, n_neighbors=2, safe_matches=2, competitive=False)
    ranked = allocate._ranked(spark.createDataFrame(pdf), rules)
    state = allocate.grown(ranked, rules)
    decided, rest = allocate._peeled(allocate.saved(allocate.categorised(ranked, state, rules).selectExpr("*", "2 AS room"), "t"), 0)
    assert decided.count() > 10 and rest.select("query_id").distinct().count() < 30
    chosen, _ = kernel.allocate(rows, 400, rules)
    got = {(r.query_id, r.ref_id, r.phase) for r in allocate._match_ranked(ranked, state, rules, peel_from=0, one_call=0).collect()}
    assert got == wanted(queries, rows, chosen)


def test_short_lists_grow_to_the_same_pairs(spark):
    """Lists that are made longer only where rows need it give the pairs of full lists."""
    pdf, queries, rows = graph(6, n=15, m=300, limit=1.0)
    rules = Rules(1.0, n_neighbors=2, safe_matches=4)
    edges = spark.createDataFrame(pdf).selectExpr("*", "row_number() OVER (PARTITION BY query_id ORDER BY distance, ref_id) AS rank").persist()
    asked = []

    def candidates(k, of):
        asked.append(k)
        near = edges.where(f"rank <= {k}")
        return near if of is None else near.join(of, "query_id", "left_semi")

    pairs, made = allocate.match_growing(candidates, rules, 300, first=4, factor=2)
    chosen, _ = kernel.allocate(rows, 300, rules)
    assert {(r.query_id, r.ref_id, r.phase) for r in pairs.collect()} == wanted(queries, rows, chosen)
    assert len(asked) > 1 and made.count() < len(pdf)


def test_components_by_joins(spark):
    pdf, _, _ = graph(8, n=60, m=90, limit=0.02)
    edges = spark.createDataFrame(pdf)
    by = lambda n: {(r.query_id, r.component) for r in allocate.components(edges, n).collect()}
    assert by(0) == by(10**6)


@pytest.mark.parametrize("ratio", [1, 2])
def test_greedy_in_shards(spark, ratio):
    """Rows that ask in shards, a few controls ahead, end with what serving them in order of id gives; equal lists too."""
    pdf, queries, rows = graph(10, n=30, m=40)
    same = pd.DataFrame([(100 + i, 1000 + j, 0.01 * j) for i in range(12) for j in range(9)], columns=pdf.columns)
    for table, lists, ids in ((pdf, rows, queries), (same, [(np.arange(9), 0.01 * np.arange(9))] * 12, np.arange(100, 112))):
        got = {(r.query_id, r.ref_id) for r in allocate.greedy(spark.createDataFrame(table), 0.35, ratio, look_ahead=4, shard_edges=40).collect()}
        want = kernel.nearest_first(lists, 60, 0.35, ratio)
        assert got == {(int(ids[i]), int(lists[i][0][k]) + 1000) for i, picks in enumerate(want) for k in picks}


# -- cells


def mixed(seed, n, gaps=True):
    rng = np.random.default_rng(seed)
    numbers = rng.normal(size=(n, 3)) * [1, 20, 300]
    codes = rng.integers(0, 3, (n, 2))
    if gaps:
        numbers[rng.random(n) < 0.1, 0] = np.nan
        codes[rng.random(n) < 0.1, 1] = -1
    return numbers, codes


GOWER = gower.GowerModel(("a", "b", "c"), ("k", "l"), {"a": 6.0, "b": 120.0, "c": 1800.0}, {"a": 1.0, "b": 2.5, "c": 0.5, "k": 0.3, "l": 1.0})


@pytest.mark.parametrize("metric", [GOWER, vectors.VectorMetric("l2", ()), vectors.VectorMetric("cosine", ())])
def test_cells_keep_the_nearest(metric):
    """120 queries' nearest by cells are those of all distances, ties and missing values included; floors are never above a distance."""
    kind = type(metric)
    gaps = kind is gower.GowerModel
    (rn, rc), (qn, qc) = mixed(1, 5000, gaps), mixed(2, 120, gaps)
    if not gaps:
        rc, qc = rc[:, :0], qc[:, :0]
    rn[100:130] = rn[7]
    rc[100:130] = rc[7]
    full = metric.block(qn, qc, rn, rc)
    found = cells.build(rn, rc, None, metric.scales(3), 64)
    assert sorted(np.concatenate(found.members).tolist()) == list(range(5000))
    floor = metric.box_floor(qn, qc, found.low, found.high, found.codes)
    assert all((floor[:, g] <= full[:, m].min(axis=1) + 1e-9).all() for g, m in enumerate(found.members))
    lists, pairs = knn._Lists(120, 12, math.inf), 0
    for at, members in cells.worth_comparing(qn, qc, None, found, metric, lists.worst, None):
        pairs += len(at) * len(members)
        lists.offer(at, metric.block(qn[at], qc[at], rn[members], rc[members]), members)
    for i in range(120):
        assert lists.ids[i].tolist() == np.lexsort((np.arange(5000), full[i]))[:12].tolist()
    if metric is not None and getattr(metric, "kind", "") != "cosine":
        assert pairs < 0.5 * 120 * 5000


def test_few_pairs_are_compared(spark):
    """On a hundred thousand controls under 5 % of the distances are computed."""
    from pyspark.sql import functions as F

    rows = spark.range(100_200, numPartitions=4).select("id", *(F.rand(i).alias(f"x{i}") for i in range(3)), (F.col("id") % 4).cast("string").alias("g"))
    queries, refs = rows.where("id < 200"), rows.where("id >= 200")
    model = gower.fit(refs, ("x0", "x1", "x2"), ("g",))
    compared = spark.sparkContext.accumulator(0)
    got = knn.top_k(queries, refs, "id", model, 12, compared=compared).count()
    assert got == 200 * 12 and 0 < compared.value < 0.05 * 200 * 100_000


def test_sweep_computes_eligible_pairs(spark):
    """Edges and diagnostics of one sweep are those of two passes, and hardly more pairs are computed than are eligible."""
    from pyspark.sql import functions as F

    rows = spark.range(20_100, numPartitions=4).select("id", F.rand(1).alias("x"), F.rand(2).alias("z"), F.when(F.col("id") % 50 == 7, None).otherwise(F.rand(3)).alias("band"))
    queries, refs = rows.where("id < 100"), rows.where("id >= 100")
    model = gower.fit(refs, ("x", "z"), ())
    band = knn.Band("band", 0.05)
    compared = spark.sparkContext.accumulator(0)
    edges, info = knn.swept(queries, refs, "id", model, 5, 0.1, band, compared=compared)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(edges) == key(knn.top_k(queries, refs, "id", model, 5, 0.1, band))
    assert key(info) == key(knn.diagnostics(queries, refs, "id", model, 5, 0.1, band))
    eligible = info.agg(F.sum("eligible")).first()[0]
    assert eligible <= compared.value < 1.5 * eligible
    at = {(r.measure, r.percentile): r.value for r in knn.percentiles(info).collect()}
    counts = [r.eligible for r in info.where("eligible > 0").collect()]
    assert [at["eligible", p] for p in knn.PERCENTILES] == pytest.approx(np.percentile(counts, knn.PERCENTILES).tolist())


# -- quantiles, ranges, groups of fits


def test_grouped_quantiles_by_narrowing(spark):
    """All groups and shares narrowed together give what sorting each group gives; ties, single values, nulls and a null group included."""
    from cohortspark.operators.quantiles import grouped

    rng = np.random.default_rng(3)
    rows = [("a", float(x)) for x in np.round(rng.normal(size=700), 2)] + [("b", 5.0)] * 9 + [("c", float(x)) for x in 10.0 ** rng.uniform(-300, 300, 200)] + [("d", None), ("a", None), (None, 1.0), (None, 3.0), ("e", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double")
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    want = {(g, s): float(np.quantile([x for k, x in rows if k == g and x is not None and x == x], s)) for g in ("a", "b", "c", None) for s in shares}
    for buffer in (0, 10**6):
        got = {(r.g, r.share): r.value for r in grouped(df, "g", "x", shares, buffer).collect()}
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_running_sums_and_numbers_by_ranges(spark):
    from cohortspark.operators.ranges import numbered, running_sums
    from cohortspark.operators.report import ecdf

    rows = spark.range(500).selectExpr("id % 3 AS g", "(id * 7919) % 101 AS v")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(ecdf(rows, "v", "g", 0)) == key(ecdf(rows, "v", "g"))
    one = rows.groupBy("g", "v").count()
    assert key(running_sums(one, "g", "v", "count", 0)) == key(running_sums(one, "g", "v", "count"))
    assert [r.number for r in numbered(rows, "v", "g", one_sort=0).orderBy("number").collect()] == list(range(500))
    places = numbered(rows.distinct(), "v", "g", one_sort=0)
    assert key(places) == key(numbered(rows.distinct(), "v", "g"))


def test_groups_are_fitted_in_the_same_passes(spark):
    """Each group's fit is the fit of its rows alone; rows of no group are in all."""
    from cohortspark.operators.propensity import fit_groups, fit_logistic

    rng = np.random.default_rng(5)
    rows = [([float(a), float(b)], float(rng.random() < 1 / (1 + math.exp(-(a - b)))), int(g)) for a, b, g in zip(rng.normal(size=600), rng.normal(size=600), rng.integers(-1, 3, 600))]
    df = spark.createDataFrame(rows, "x array<double>, y double, g int").repartition(3)
    for k, model in enumerate(fit_groups(df, 3)):
        alone = fit_logistic(df.where(f"g = {k} OR g = -1"))
        assert np.allclose(model.coefficients, alone.coefficients, atol=1e-8)
    apart = [([float(i)], float(i > 10), 0) for i in range(20)]
    with pytest.raises(RuntimeError):
        fit_groups(spark.createDataFrame(apart, "x array<double>, y double, g int"), 1)


def test_component_store(spark, tmp_path):
    """Any weights and subsets from stored differences, also from a store that is opened again."""
    from cohortspark.operators import components

    rows = [(i, float(i % 7), None if i % 5 == 0 else float(i), "xyz"[i % 3] if i % 4 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a double, b double, k string")
    queries, refs = df.where("id < 8"), df.where("id >= 8")
    model = gower.fit(refs, ("a", "b"), ("k",))
    path = str(tmp_path / "store")
    components.write(queries, refs, "id", model, path)
    store = components.open_store(spark, path)
    weights = {"a": 2.0, "k": 0.5}
    full = gower.fit(refs, ("a", "b"), ("k",), {"a": 2.0, "b": 0.0, "k": 0.5})
    want = {(r.query_id, r.ref_id): r.distance for r in knn.all_pairs(queries, refs, "id", full).collect()}
    got = {(r.query_id, r.ref_id): r.distance for r in store.distances(spark, weights).collect()}
    assert got == pytest.approx(want) and len(got) == 8 * 52
    some = store.distances(spark, weights, spark.createDataFrame([(3,), (99,)], "query_id long"), spark.createDataFrame([(10,), (11,)], "ref_id long"))
    assert {(r.query_id, r.ref_id): r.distance for r in some.collect()} == pytest.approx({k: v for k, v in want.items() if k in ((3, 10), (3, 11))})
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "d1" not in plan
    for bad in ({"nope": 1.0}, {"a": 0.0}, {"a": -1.0}):
        with pytest.raises(ValueError):
            store.distances(spark, bad)


@pytest.mark.parametrize("ratio", [1, 2])
def test_greedy_with_growing_lists(spark, ratio):
    rng = np.random.default_rng(11)
    x, y = np.sort(rng.random(40)) / 4, rng.random(160)
    table = pd.DataFrame([(q, 1000 + r, abs(a - b)) for q, a in enumerate(x) for r, b in enumerate(y)], columns=["query_id", "ref_id", "distance"])
    asked = []

    def candidates(k, queries):
        asked.append((k, 40 if queries is None else queries.count()))
        some = table if queries is None else table[table.query_id.isin(queries.toPandas().query_id)]
        return spark.createDataFrame(some.sort_values(["distance", "ref_id"]).groupby("query_id").head(k))

    rows = lambda df: {(r.query_id, r.ref_id) for r in df.collect()}
    whole = rows(allocate.greedy(spark.createDataFrame(table), 1.0, ratio))
    assert rows(allocate.greedy_growing(candidates, 1.0, ratio, 160, first=4, factor=4)) == whole and len(whole) == 40 * ratio
    assert asked[0] == (4, 40) and len(asked) > 1 and all(n < 40 for _, n in asked[1:])


def test_lists_made_earlier_may_turn_out_too_short(spark):
    """A row that had enough at first loses it to rows whose lists grew, and needs more of its own list than was made."""
    rng = np.random.default_rng(11)
    x, y = np.sort(rng.random(40)) / 4, rng.random(160)
    table = pd.DataFrame([(q, 1000 + r, abs(a - b)) for q, a in enumerate(x) for r, b in enumerate(y)], columns=["query_id", "ref_id", "distance"])
    near = table.sort_values(["distance", "ref_id"])
    candidates = lambda k, queries: spark.createDataFrame((near if queries is None else near[near.query_id.isin(queries.toPandas().query_id)]).groupby("query_id").head(k))
    rules = Rules(1.0, competitive=False)
    rows = lambda df: {(r.query_id, r.horizon) for r in df.collect()}
    _, made = allocate.match_growing(candidates, rules, 160, first=2, factor=2)
    ends = lambda edges: rows(allocate.grown(allocate._ranked(edges, rules), rules))
    assert ends(made) == ends(spark.createDataFrame(table))


# -- equal rows


def test_equal_rows_are_computed_once(spark):
    """Copies of queries and references change no list and no sum, and add few comparisons; missing values are values like others."""
    rng = np.random.default_rng(9)
    rows = [(i, float(np.round(rng.normal(), 2)) if i % 7 else None, float(rng.integers(0, 5)), "uvw"[i % 3] if i % 5 else None) for i in range(300)]
    several = spark.createDataFrame([(i + 1000 * c, a, b, g) for i, a, b, g in rows for c in range(8)], "id long, a double, b double, g string")
    queries, refs = several.where("id % 1000 < 30"), several.where("id % 1000 >= 30")
    model = gower.fit(refs, ("a", "b"), ("g",))
    every = {}
    for q, r, d in knn.all_pairs(queries, refs, "id", model).collect():
        every.setdefault(q, []).append((d, r))
    compared = spark.sparkContext.accumulator(0)
    got = {}
    for q, r, d, rank in knn.top_k(queries, refs, "id", model, 3, compared=compared).select("query_id", "ref_id", "distance", "rank").collect():
        got.setdefault(q, {})[rank] = (d, r)
    assert got == {q: dict(enumerate(sorted(x)[:3], 1)) for q, x in every.items()}
    assert compared.value <= 30 * 270 * 3
    sums = {r.query_id: r for r in knn.summary(queries, refs, "id", model).collect()}
    assert set(sums) == set(every)
    for q, x in every.items():
        d = [y for y, _ in x]
        assert (sums[q].n, sums[q].low, sums[q].high) == (len(d), min(d), max(d)) and sums[q].mean == pytest.approx(sum(d) / len(d))
    within = {r.query_id: r.within_threshold for r in knn.diagnostics(queries, refs, "id", model, 3, 0.2).collect()}
    assert within == {q: sum(d <= 0.2 for d, _ in x) for q, x in every.items()}


def test_copies_of_rows_are_matched_as_one_class(spark):
    """Without an end to the lists, rows with the same values are one class: the pairs are those of row by row, and no list is made for a copy."""
    from cohortspark.operators import allocate
    from cohortspark.operators.kernel import Rules

    rng = np.random.default_rng(12)
    lists = {q: sorted((float(np.round(d, 2)), int(r)) for r, d in zip(range(100, 140), rng.random(40)) if d < 0.5) for q in range(9)}
    members = [(q + 10 * c, q) for q in range(9) for c in range(1 if q < 4 else q - 2)]
    asked = []

    def candidates(k, queries=None):
        some = [i for i, _ in members] if queries is None else [r[0] for r in queries.select("query_id").collect()]
        asked.extend(some)
        return spark.createDataFrame([(i, r, d) for i in some for d, r in lists[dict(members)[i]][:k]], "query_id long, ref_id long, distance double")

    rules = Rules(0.3, n_neighbors=2, safe_matches=2, fuzzy_limit=0.4)
    want = sorted(map(tuple, allocate.match_growing(candidates, rules, 40, 4)[0].collect()))
    asked.clear()
    got, _ = allocate.match_growing(candidates, rules, 40, 4, members=spark.createDataFrame(members, "id long, query_id long"))
    assert sorted(map(tuple, got.collect())) == want and set(asked) == set(range(9))


def test_store_keeps_equal_rows_once(spark, tmp_path):
    """Copies add nothing to the stored pairs; distances, sums and nearest references are those of all rows."""
    from cohortspark.operators import components

    rows = [(i + 100 * c, float(i % 6) if i % 5 else None, "xyz"[i % 3]) for i in range(24) for c in range(6)]
    df = spark.createDataFrame(rows, "id long, a double, g string")
    queries, refs = df.where("id % 100 < 6"), df.where("id % 100 >= 6")
    model = gower.fit(refs, ("a",), ("g",), {"a": 2.0, "g": 1.0})
    store = components.write(queries, refs, "id", model, str(tmp_path / "store"))
    assert store.table(spark).count() <= 6 * 18
    every = {}
    for q, r, d in knn.all_pairs(queries, refs, "id", model).collect():
        every.setdefault(q, []).append((d, r))
    weights = {"a": 2.0, "g": 1.0}
    assert {(q, r): d for q, r, d in store.distances(spark, weights).collect()} == pytest.approx({(q, r): d for q, x in every.items() for d, r in x})
    for row in store.summary(spark, weights).collect():
        d = [x for x, _ in every[row.query_id]]
        assert row.n == len(d) and (row.low, row.mean, row.high) == pytest.approx((min(d), sum(d) / len(d), max(d)))
    got = {}
    for row in store.nearest(spark, weights, 4, queries.where("id % 2 = 0").select(queries.id.alias("query_id")), queries.sparkSession.range(1000).select("id").withColumnRenamed("id", "ref_id").where("ref_id % 3 <> 0")).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.ref_id))
    assert {q: [r for _, r in sorted(x)] for q, x in got.items()} == {q: [r for _, r in sorted(y for y in x if y[1] % 3)[:4]] for q, x in every.items() if q % 2 == 0}


def test_every_pair_is_summed_up_by_classes_of_vectors(spark, tmp_path, monkeypatch):
    """``cdist_euclidean`` makes no row for a pair, and copies of vectors are computed once, however many columns they have."""
    from cohortspark.plans import more_queries as more

    rng = np.random.default_rng(3)
    few = rng.normal(size=(12, 64)).astype(np.float32)
    pdf = pd.DataFrame({"vec_id": np.arange(120), "label": np.tile(np.arange(12) % 3, 10), "embedding": np.tile(few, (10, 1)).tolist()})
    spark.createDataFrame(pdf, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(knn, "all_pairs", None)
    metric = vectors.VectorMetric("l2", tuple(F.element_at("embedding", i + 1).cast("double") for i in range(64)))
    rows = spark.read.parquet(f"{tmp_path}/embeddings.parquet").withColumnRenamed("vec_id", "unit_id")
    weights = knn._equal_counted(knn._columns(rows.where("label <> 0"), "unit_id", metric, None)[0])
    assert sorted(r.weight for r in weights.collect()) == [10] * 8
    got = {r.query_id: r for r in more.cdist_euclidean(spark, str(tmp_path)).collect()}
    assert len(got) == 40
    wide = few.astype(float)
    for q, r in got.items():
        d = np.sqrt(((wide[[i for i in range(12) if i % 3]] - wide[q % 12]) ** 2).sum(1))
        assert (r.n, r.low, r.high) == (80, round(d.min(), 5), round(d.max(), 5)) and r["mean"] == pytest.approx(d.mean(), abs=1e-5)


def test_flat_growth_is_growth():
    """All rows' next edges in one step end at the same horizons as edge by edge, with controls that rows outside hold."""
    rng = np.random.default_rng(5)
    for _ in range(40):
        n_refs, needs = int(rng.integers(3, 25)), int(rng.integers(1, 4))
        rows = [(rng.permutation(n_refs)[: rng.integers(1, n_refs + 1)],) for _ in range(int(rng.integers(1, 15)))]
        rows = [(c, np.sort(rng.random(len(c)))) for (c,) in rows]
        users = np.where(rng.random(n_refs) < 0.2, 2, 0)
        expected, held = kernel.horizons(rows, n_refs, kernel.Rules(0.7, safe_matches=needs), users)
        counted = users.copy()
        start = np.cumsum([0, *(len(c) for c, _ in rows)])
        got = kernel.horizons_flat(start, np.concatenate([c for c, _ in rows]), np.concatenate([d for _, d in rows]) <= 0.7, counted, needs)
        assert got.tolist() == expected.tolist() and counted.tolist() == held.tolist()


def test_long_lists_grow_in_one_call(spark, monkeypatch):
    """Rows that take each other's safe controls one after another need no round of their own each, whatever the lists' length."""
    n, k = 2600, 400
    ranked = spark.range(n * k).select((F.col("id") / k).cast("long").alias("query_id"), (F.col("id") % k).alias("j"))
    ranked = ranked.select("query_id", (F.when(F.col("j") < k - 1, F.col("j") + F.floor(F.col("query_id") / 2)).otherwise(10**6 + F.col("query_id"))).alias("ref_id"), (F.col("j") / k).alias("distance"), (F.col("j") + 1).cast("int").alias("rank"))
    written, plain = [], allocate.saved
    monkeypatch.setattr(allocate, "saved", lambda df, name: written.append(name) or plain(df, name))
    state = allocate.grown(ranked, kernel.Rules(1.0))
    assert ranked.count() > allocate.SHARD_EDGES and written == ["horizons"]
    assert state.count() == n and state.where("horizon < 1 or horizon > length or length <> 400").count() == 0


def test_all_lists_go_on_where_many_rows_do(spark):
    edges = spark.range(40).select((F.col("id") / 4).cast("long").alias("query_id"), (F.col("id") % 4).alias("ref_id"), F.lit(4).cast("long").alias("asked"))
    state = spark.range(10).select(F.col("id").alias("query_id"), F.when(F.col("id") < 2, 4).otherwise(1).alias("horizon"), F.lit(4).alias("length"))
    assert allocate._short(edges, state, 8).count() == 10
    assert allocate._short(edges, state.withColumn("horizon", F.lit(1)), 8) is None
    assert allocate._short(edges, state, 4) is None


def test_long_chain_is_labelled_in_one_task(spark, monkeypatch):
    """Rows that are tied together one after another, on more edges than the driver takes."""
    n, k = 4000, 150
    edges = spark.range(n * k).select((F.col("id") / k).cast("long").alias("query_id"), ((F.col("id") / k).cast("long") * 100 + F.col("id") % k + F.when(F.col("id") >= n * k / 2, 10**6).otherwise(0)).alias("ref_id"))
    written, plain = [], allocate.saved
    monkeypatch.setattr(allocate, "saved", lambda df, name: written.append(name) or plain(df, name))
    found = allocate.components(edges).select("query_id", "component").distinct()
    got = {r.component: r.n for r in found.groupBy("component").agg(F.count("*").alias("n")).collect()}
    assert got == {0: n // 2, n // 2: n // 2} and written == ["labels"] and edges.count() > allocate.DRIVER_EDGES
