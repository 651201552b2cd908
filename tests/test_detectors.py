"""Detector invariants: planted outliers, flagged share, equality of the small and the large path."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.models import iforest, tune
from wardline.models.base import load_model
from wardline.models.explain import neighbour_deviation, shapley, shapley_by_table, shapley_summary
from wardline.models.iforest import IsolationForest
from wardline.models.lof import LocalOutlierFactor
from wardline.models.ocsvm import OneClassSVM, fit_many, grow_maps, score_all
from wardline.session import cut_lineage, scratch_path

PLANTED = 15


@pytest.fixture(scope="module")
def rows(spark):
    vec = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"))
    far = vec.orderBy("row_id").limit(PLANTED).select(
        (F.col("row_id") + 1_000_000).alias("row_id"), F.transform("features", lambda x: x * 6).alias("features"))
    return cut_lineage(vec.unionByName(far))


def models():
    return [IsolationForest(50, 0.1), OneClassSVM("rbf", 0.1, landmarks=64), LocalOutlierFactor(10, 0.1)]


@pytest.mark.parametrize("which", [0, 1, 2])
def test_planted_outliers_and_share(spark, rows, which):
    model = models()[which].fit(rows)
    scored = model.train_flags() if which == 2 else model.transform(rows)
    n, flagged = scored.count(), scored.filter("is_anomaly = 1").count()
    assert abs(flagged - 0.1 * n) <= 2
    assert scored.orderBy("score").limit(PLANTED).filter("row_id >= 1000000").count() == PLANTED
    loaded = load_model(spark, model.save(scratch_path(spark, "test")))
    a = model.transform(rows).agg(F.sum("score"), F.sum("is_anomaly")).first()
    b = loaded.transform(rows).agg(F.sum("score"), F.sum("is_anomaly")).first()
    assert a[0] == pytest.approx(b[0]) and a[1] == b[1]


def test_forest_does_not_depend_on_partitioning(spark, rows):
    a = IsolationForest(10, 0.1).fit(rows.repartition(1)).transform(rows).select("row_id", "score")
    b = IsolationForest(10, 0.1).fit(rows.repartition(8)).transform(rows).select("row_id", "score")
    assert a.exceptAll(b).isEmpty()


def test_level_wise_growth_equals_growth_in_tasks(spark, rows):
    n = rows.count()
    sample = cut_lineage(iforest.tree_samples(rows, n, 3, 120, 7, exact=True).withColumn("node", F.lit(1).cast("bigint")))
    limit = math.ceil(math.log2(120))
    a = IsolationForest(3, seed=7)._grow_in_tasks(sample, limit)
    b = IsolationForest(3, seed=7, task_rows=40)._grow_by_level(sample, limit)
    assert a.count() == b.count() and a.exceptAll(b).isEmpty()


def test_scoring_by_join_equals_scoring_in_tasks(spark, rows):
    model = IsolationForest(4, 0.1, 0.2).fit(rows)
    small = model.path_sums(rows, [2, 4]).select("row_id", "paths")
    model._forest = None
    large = model.path_sums(rows, [2, 4], limit=0).select("row_id", F.col("paths").alias("other"))
    gap = small.join(large, "row_id").agg(F.count(F.lit(1)), F.max(F.abs(F.col("paths")[0] - F.col("other")[0])), F.max(F.abs(F.col("paths")[1] - F.col("other")[1]))).first()
    assert gap[0] == rows.count() and gap[1] < 1e-9 and gap[2] < 1e-9


def test_sample_sizes(spark, rows):
    n = rows.count()
    exact = iforest.tree_samples(rows, n, 5, 100, 1, exact=True).groupBy("tree").count().collect()
    assert [r["count"] for r in exact] == [100] * 5
    about = iforest.tree_samples(rows, n, 5, 200, 1, exact=False).groupBy("tree").count().collect()
    assert all(abs(r["count"] - 200) < 60 for r in about)


def test_copies_stop_a_tree(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), F.array(F.when(F.col("id") < 900, 0.0).otherwise(F.col("id") * 1.0), F.lit(1.0)).alias("features"))
    model = IsolationForest(5, 0.05, 500, task_rows=100).fit(df)
    assert model.nodes.filter("feature = 1").count() == 0
    assert model.nodes.filter("feature < 0").groupBy("tree").agg(F.max("size").alias("m")).filter("m < 300").count() == 0


def test_average_path_values():
    assert iforest.average_path([0, 1, 2]).tolist() == [0.0, 0.0, 1.0]
    assert float(iforest.average_path(256)) == pytest.approx(2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256)


def test_svm_close_to_exact_dual(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(250, 3)) * [1, 2, 3]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id bigint, features array<double>")
    nu, gamma = 0.2, 1 / (3 * x.var())
    kernel = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
    a, cap, step = np.full(250, 1 / 250), 1 / (nu * 250), np.linalg.eigvalsh(kernel).max()
    for _ in range(4000):
        y = a - kernel @ a / step
        low, high = y.min() - 1, y.max()
        for _ in range(50):
            mid = (low + high) / 2
            low, high = (mid, high) if np.clip(y - mid, 0, cap).sum() > 1 else (low, mid)
        a = np.clip(y - mid, 0, cap)
    exact = kernel @ a
    model = OneClassSVM("rbf", nu, "scale", landmarks=250).fit(df)
    ours = np.array([r["score"] for r in model.transform(df).orderBy("row_id").collect()])
    assert np.corrcoef(ours, exact)[0, 1] > 0.99
    best = -0.5 * a @ kernel @ a
    assert model.params["converged"] and model.params["residual"] <= 0.05
    weights = model.weights
    z = model.map(x)
    primal = min(0.5 * weights @ weights - t + np.maximum(t - z @ weights, 0).sum() / (nu * 250) for t in np.sort(z @ weights))
    assert primal * model.map.scale**2 == pytest.approx(best, rel=0.06)


@pytest.mark.parametrize("kernel", ["rbf", "poly", "sigmoid"])
def test_landmarks_grow_until_the_residual_is_small(spark, kernel):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(40, 2)), 10, axis=0)  # 40 places, ten rows each
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id bigint, features array<double>")
    maps, shares = grow_maps(df, [(kernel, 0.5)], 2048, 1e-6)
    (kernel_map,), (share,) = maps.values(), shares.values()
    assert len(kernel_map.landmarks) <= 40
    rest = np.maximum(kernel_map.residual(x), 0).sum() / np.abs(kernel_map.own(x)).sum()
    assert rest == pytest.approx(share, abs=1e-9) and (kernel == "sigmoid" or share <= 1e-6)
    few, left = grow_maps(df, [(kernel, 0.5)], 3, 1e-6)
    assert len(next(iter(few.values())).landmarks) == min(3, len(kernel_map.landmarks)) and next(iter(left.values())) >= share - 1e-9


def test_svm_kernels_share_and_grid(spark, rows):
    grid = tune.expand({"kernel": ["rbf", "sigmoid", "poly"], "nu": [0.05, 0.2], "gamma": ["scale", 0.1]})
    fitted = fit_many(rows, grid, landmarks=32)
    scored = score_all(rows, fitted).agg(*[F.count_if(F.col("scores")[i] < m.offset) for i, m in enumerate(fitted)]).first()
    n = rows.count()
    assert all(m.params["gap"] <= 5e-3 for m in fitted)
    for g, flagged in zip(grid, scored):
        assert abs(flagged - g["nu"] * n) <= 2


def test_default_grid_sizes():
    sizes = {k: len(tune.expand(g)) for k, g in tune.GRIDS.items()}
    assert sizes == {"isolation_forest": 27, "one_class_svm": 60, "lof": 20}


def test_sweep_shares_work_and_equals_single_fits(spark, rows):
    test = rows.withColumn("label", (F.col("row_id") >= 1_000_000).cast("int"))
    grids = {"isolation_forest": {"n_estimators": [10, 20], "contamination": [0.1], "max_samples": ["auto"]},
             "lof": {"n_neighbors": [5, 10], "contamination": [0.05]}}
    runs, predictions = tune.sweep({"raw": (rows, test)}, grids)
    got = {r["model_id"]: r for r in runs.collect()}
    assert len(got) == 4 and predictions.count() == 4 * rows.count()
    one = IsolationForest(10, 0.1).fit(rows)
    key = "Isolation Forest (n_estimators=10, contamination=0.1, max_samples=auto)"
    assert got[key]["anomalies_train"] == one.transform(rows).filter("is_anomaly = 1").count()
    assert got[key]["params"]["n_estimators"] == "10"
    lof = LocalOutlierFactor(5, 0.05).fit(rows)
    assert got["Local Outlier Factor (n_neighbors=5, contamination=0.05)"]["anomalies_test"] == lof.transform(test).filter("is_anomaly = 1").count()
    assert tune.select_best(runs).count() == 1


def test_shapley_adds_up(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id bigint, features array<double>")
    model = IsolationForest(20, 0.1).fit(df)
    cols = list("abcd")
    phi = shapley(model.scorer(), df, df, cols, n_background=10)
    both = phi.join(model.transform(df), "row_id").select((F.col("base") + sum(F.col(c) for c in cols) + F.col("decision")).alias("gap"))
    assert both.agg(F.max(F.abs("gap"))).first()[0] < 1e-9
    hidden = shapley(model.scorer(), df, df, cols, n_background=10, hide=["a"])
    assert hidden.columns == ["row_id", "base", "b", "c", "d"]
    assert shapley_summary(hidden, ["b", "c", "d"]).count() == 3


def test_shapley_by_table_equals_shapley_in_tasks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20, 3))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id bigint, features array<double>")
    model, cols = IsolationForest(10, 0.1).fit(df), list("abc")
    a = shapley(model.scorer(), df, df, cols, n_background=4, hide=["c"]).orderBy("row_id").collect()
    b = shapley_by_table(model, df, df, cols, n_background=4, hide=["c"]).orderBy("row_id").collect()
    assert np.array([list(r) for r in a]) == pytest.approx(np.array([list(r) for r in b]))
    lof = LocalOutlierFactor(3, 0.1).fit(df)
    phi = shapley_by_table(lof, df, df, cols, n_background=3)
    gap = phi.join(lof.transform(df), "row_id").select(F.abs(F.col("base") + F.col("a") + F.col("b") + F.col("c") + F.col("decision")).alias("g"))
    assert gap.agg(F.max("g")).first()[0] < 1e-9


def test_shapley_of_a_linear_score_is_exact(spark):
    x = np.arange(12.0).reshape(4, 3)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "row_id bigint, features array<double>")
    weights = np.array([1.0, -2.0, 0.5])
    got = shapley(lambda m: m @ weights, df, df, list("abc"), n_background=4, flip=False).orderBy("row_id").collect()
    assert np.array([[r[c] for c in "abc"] for r in got]) == pytest.approx((x - x.mean(0)) * weights)


def test_neighbour_deviation_names_the_odd_feature(spark):
    data = [(i, float(i % 5), float(i % 7)) for i in range(60)] + [(99, 2.0, 500.0)]
    df = spark.createDataFrame(data, "row_id bigint, a double, b double")
    first = neighbour_deviation(df.filter("row_id = 99"), df, ["a", "b"], 5, exclude_self=True).filter("rank = 1").first()
    assert first["feature"] == "b" and first["deviation"] > 400


def test_draws_reach_the_sample_size_on_very_large_tables():
    for n in (300, 10**6, 10**12, 10**15):
        share = iforest.draw_bar(n, 256) / iforest.HASH_SPACE
        assert 256 <= share * n * (1 + 1e-9) < 257


def test_svm_pass_holds_few_kernel_values_and_sums_all_rows(spark):
    from wardline.models import ocsvm

    x = np.random.default_rng(12).normal(size=(2500, 3))
    parts = list(ocsvm._blocks(x, 2048))
    assert max(len(p) for p in parts) * 2048 <= ocsvm.CELLS and np.array_equal(np.concatenate(parts), x)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "row_id bigint, features array<double>")
    maps = {i: ocsvm.KernelMap(kernel, 0.3, x[:300]) for i, kernel in enumerate(("rbf", "poly"))}
    rng = np.random.default_rng(13)
    points = {fit: (key, rng.normal(size=300), 0.4, 0.2) for fit, key in enumerate((0, 1, 0))}
    sums = ocsvm._data_pass(df, spark.sparkContext.broadcast(maps), points)
    for fit, (key, w, rho, smoothing) in points.items():
        k = maps[key].scaled(x)
        value, slope = ocsvm._hinge(rho - k @ w, smoothing)
        wanted = [value.sum(), np.maximum(rho - k @ w, 0).sum(), slope.sum(), *(k.T @ slope)]
        assert np.allclose(sums[fit], wanted, rtol=1e-9, atol=1e-9 * np.abs(wanted).max())


def test_flat_growth_equals_growth_by_tuples_and_copies_no_wide_rows(monkeypatch):
    import tracemalloc

    x = np.random.default_rng(14).normal(size=(4000, 32))
    x[::5] = x[0]
    monkeypatch.setattr(iforest, "COPIED", 1 << 10)
    wanted = iforest.grow(x, 42, 3, 1, 12)
    tracemalloc.start()
    got = iforest.grow_table(x, 42, 3, 1, 12)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [tuple(r.values()) for r in got.to_pylist()] == wanted
    assert peak < x.nbytes


def test_train_flags_of_a_forest_equal_its_transform(spark, rows):
    model = IsolationForest(8, 0.1, seed=42).fit(rows)
    names = ["row_id", "score", "decision", "is_anomaly"]
    assert sorted(model.train_flags().select(*names).collect()) == sorted(model.transform(rows).select(*names).collect())
    with pytest.raises(ValueError):
        model.with_trees(4, 0.1, 0.0).train_flags()


def test_residual_passes_write_no_features(spark, monkeypatch):
    from wardline.models import ocsvm

    written = []
    monkeypatch.setattr(ocsvm, "cut_lineage", lambda df: written.append(df.columns) or cut_lineage(df))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(np.random.default_rng(15).normal(size=(400, 5)))],
                                 "row_id bigint, features array<double>")
    OneClassSVM("rbf", 0.2).fit(rows)
    assert len(written) > 2 and not any("features" in columns for columns in written)


def test_the_reloaded_study_searches_the_whole_grids(spark, monkeypatch):
    from wardline.catalog import detectors

    asked = []

    def sweep(datasets, grids, **more):
        asked.append(sum(len(tune.expand(g)) for g in grids.values()))
        raise InterruptedError

    monkeypatch.setattr(detectors.tune, "sweep", sweep)
    with pytest.raises(InterruptedError):
        detectors.k7_reload(spark, "/root/testdata/sf0.001")
    assert asked == [107]


def test_svm_fits_within_tasks_equal_fits_by_passes(spark, monkeypatch):
    from wardline.models import ocsvm

    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(np.random.default_rng(16).normal(size=(1500, 4)))],
                                 "row_id bigint, features array<double>")
    grid = tune.expand({"kernel": ["rbf", "sigmoid", "poly"], "nu": [0.05, 0.2], "gamma": ["scale", 0.1]})
    passes, run = [], ocsvm._data_pass
    monkeypatch.setattr(ocsvm, "_data_pass", lambda *a: passes.append(1) or run(*a))
    within = ocsvm.fit_many(rows, grid)
    assert not passes
    monkeypatch.setattr(ocsvm, "HELD", 0)
    for a, b in zip(within, ocsvm.fit_many(rows, grid)):
        assert a.params["passes"] == b.params["passes"] and np.allclose(a.weights, b.weights, rtol=1e-6, atol=1e-9)
    assert passes


def test_a_sweep_over_its_own_train_rows_searches_once(spark, rows, monkeypatch):
    both = rows.withColumn("label", (F.col("row_id") >= 1_000_000).cast("int"))
    grids = {"isolation_forest": {"n_estimators": [10], "contamination": [0.1], "max_samples": ["auto"]},
             "one_class_svm": {"kernel": ["rbf"], "nu": [0.1], "gamma": ["scale"]}, "lof": {"n_neighbors": [5, 10], "contamination": [0.05]}}
    searched, search = [], tune.knn_join
    monkeypatch.setattr(tune, "knn_join", lambda *a, **k: searched.append(1) or search(*a, **k))
    names = ["model_id", "row_id", "label", "score", "is_anomaly"]
    once = sorted(map(tuple, tune.sweep({"raw": (both, both)}, grids)[1].select(*names).collect()))
    assert len(searched) == 1
    other = both.select("*")
    twice = sorted(map(tuple, tune.sweep({"raw": (other, both)}, grids)[1].select(*names).collect()))
    assert len(searched) == 3 and [r[:3] + r[4:] for r in once] == [r[:3] + r[4:] for r in twice]
    assert np.allclose([r[3] for r in once], [r[3] for r in twice], rtol=1e-12)
    repeated = both.unionByName(both.limit(3))
    tune.sweep({"raw": (repeated, repeated)}, {"lof": grids["lof"]})
    assert len(searched) == 5
