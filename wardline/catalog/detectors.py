"""Queries for neighbours, detectors, tuning and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog.registry import register, rounded, sql_rounded as r
from wardline.catalog.models import keyed_days
from wardline.catalog.tables import metrics_sql
from wardline.catalog.views import FEATS, FEAT_KEYS, ITEMS, feat, pred, sql, vec
from wardline.models import explain, store, tune
from wardline.models.base import load_model, to_vector
from wardline.models.iforest import IsolationForest
from wardline.models.lof import LocalOutlierFactor, counted_in
from wardline.models.neighbours import knn_join
from wardline.models.ocsvm import OneClassSVM
from wardline.models.tree_shapley import path_shapley
from wardline.operators.agg import classification_metrics
from wardline.operators.sets import union_named
from wardline.session import cut_lineage, scratch_path

K = 10
PAIRS = (
    "pairs AS (SELECT q.row_id AS query_id, t.row_id AS neighbour_id, list_distance(q.features, t.features) AS distance "
    "FROM vec q JOIN vec t ON q.row_id <> t.row_id), "
    "near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM pairs "
    f"QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) <= {K})"
)


def knn_sql(body: str, more: str = "") -> str:
    return sql("vec", "").rstrip() + ", " + PAIRS + more + " " + body


@register("c9_knn_join", knn_sql(f"SELECT query_id, neighbour_id, {r('distance')} AS distance, CAST(rank AS INTEGER) AS rank FROM near"))
def c9(spark, sf):
    rows = vec(spark, sf)
    return knn_join(rows, rows, K, exclude_self=True).withColumn("distance", rounded("distance"))


LOF = (
    ", kd AS (SELECT query_id AS row_id, max(distance) AS kdist FROM near GROUP BY 1), "
    "lrd AS (SELECT n.query_id AS row_id, 1.0 / (avg(greatest(n.distance, k.kdist)) + 1e-10) AS lrd "
    "FROM near n JOIN kd k ON n.neighbour_id = k.row_id GROUP BY 1), "
    "lof AS (SELECT n.query_id AS row_id, -avg(b.lrd) / any_value(a.lrd) AS score FROM near n JOIN lrd a ON n.query_id = a.row_id "
    "JOIN lrd b ON n.neighbour_id = b.row_id GROUP BY 1)"
)


@register(
    "k3_local_outlier_factor",
    knn_sql(f"SELECT row_id, {r('score')} AS score, CASE WHEN score < (SELECT quantile_cont(score, 0.1) FROM lof) THEN 1 ELSE 0 END AS is_anomaly FROM lof", LOF),
)
def k3(spark, sf):
    model = LocalOutlierFactor(K, 0.1).fit(vec(spark, sf))
    return model.train_flags().select("row_id", rounded("score").alias("score"), "is_anomaly")


def _features(spark, sf):
    """Line items with a consecutive row id and their numeric columns as a vector."""
    from wardline.operators.rank import with_row_id

    rows = with_row_id(feat(spark, sf), [*FEAT_KEYS, *FEATS], "row_id")
    return to_vector(rows, FEATS).select("row_id", "features")


@register("k1_isolation_forest")
def k1(spark, sf):
    rows = cut_lineage(_features(spark, sf))
    model = IsolationForest(50, 0.1, seed=42).fit(rows)
    return model.train_flags().select("row_id", rounded("score").alias("score"), "is_anomaly")


@register("k1_isolation_forest_fraction")
def k1f(spark, sf):
    rows = vec(spark, sf)
    model = IsolationForest(50, 0.2, 0.5, seed=42).fit(rows)
    return model.train_flags().select("row_id", rounded("score").alias("score"), "is_anomaly")


@register("k2_one_class_svm")
def k2(spark, sf):
    rows = vec(spark, sf)
    return OneClassSVM("rbf", 0.1, "scale").fit(rows).transform(rows).select("row_id", rounded("score").alias("score"), "is_anomaly")


NOVELTY = (
    "train AS (SELECT * FROM vec WHERE label < 8), "
    "near AS (SELECT q.row_id AS query_id, t.row_id AS neighbour_id, list_distance(q.features, t.features) AS distance "
    f"FROM train q JOIN train t ON q.row_id <> t.row_id QUALIFY row_number() OVER (PARTITION BY q.row_id ORDER BY distance, t.row_id) <= {K}), "
    "fresh AS (SELECT q.row_id AS query_id, q.label, t.row_id AS neighbour_id, list_distance(q.features, t.features) AS distance "
    f"FROM vec q, train t WHERE q.label >= 8 QUALIFY row_number() OVER (PARTITION BY q.row_id ORDER BY distance, t.row_id) <= {K})"
    + LOF
    + ", own AS (SELECT f.query_id, any_value(f.label) AS label, 1.0 / (avg(greatest(f.distance, k.kdist)) + 1e-10) AS lrd, avg(l.lrd) AS around "
    "FROM fresh f JOIN kd k ON f.neighbour_id = k.row_id JOIN lrd l ON f.neighbour_id = l.row_id GROUP BY f.query_id), "
    "cut AS (SELECT quantile_cont(score, 0.1) AS c FROM lof) "
)


@register(
    "k4_predict_novelty",
    sql("vec", "").rstrip() + ", " + NOVELTY + f"SELECT query_id AS row_id, label, {r('-around / lrd')} AS score, "
    f"{r('-around / lrd - c')} AS decision, CASE WHEN -around / lrd < c THEN 1 ELSE 0 END AS is_anomaly FROM own, cut",
)
def k4(spark, sf):
    rows = vec(spark, sf)
    parts = [rows.filter("label < 8"), rows.filter("label >= 8")]
    out = LocalOutlierFactor(K, 0.1).fit(parts[0]).transform(parts[1])
    return out.select("row_id", "label", rounded("score").alias("score"), rounded("decision").alias("decision"), "is_anomaly")


SMALL_GRIDS = {
    "isolation_forest": {"n_estimators": [25, 50], "contamination": [0.2, 0.1], "max_samples": ["auto", 0.5]},
    "one_class_svm": {"kernel": ["rbf", "poly"], "nu": [0.1, 0.2], "gamma": ["scale"]},
    "lof": {"n_neighbors": [5, 10], "contamination": [0.1, 0.2]},
}


def _sweep(spark, sf):
    rows = vec(spark, sf).withColumn("label", (F.col("label") >= 8).cast("int"))
    squared = rows.withColumn("features", F.transform("features", lambda x: x * x))
    return tune.sweep({"raw": (rows, rows), "squared": (squared, squared)}, SMALL_GRIDS)


@register("k5_sweep")
def k5(spark, sf):
    runs, _ = _sweep(spark, sf)
    return runs.select("config", "ord", "model_id", rounded("fbeta").alias("fbeta"), "anomalies_train", "anomalies_test", "true_anomalies")


@register(
    "k7_reload_best",
    " UNION ALL ".join(f"SELECT '{c}' AS config, count(*) AS n, CAST(0 AS BIGINT) AS n_different, CAST(107 AS BIGINT) AS n_kept FROM embeddings" for c in ("raw", "squared")),
)
def k7_reload(spark, sf):
    """The best detector of each configuration, loaded from the study's store, flags every row as it did in the study."""
    root = scratch_path(spark, "models")
    rows = vec(spark, sf).withColumn("label", (F.col("label") >= 8).cast("int"))
    tables = {"raw": rows, "squared": rows.withColumn("features", F.transform("features", lambda x: x * x))}
    runs, predictions = tune.sweep({c: (t, t) for c, t in tables.items()}, tune.GRIDS, store=root)
    best = cut_lineage(tune.select_best(runs).select("config", "model_id"))
    kept = store.kept_models(spark, root).groupBy("config").agg(F.count_distinct("model_id").alias("n_kept"))
    parts = []
    for config, model in store.load_best(spark, root, best).items():
        again = model.transform(tables[config].select("row_id", "features")).select("row_id", F.col("is_anomaly").alias("again"))
        before = predictions.join(best, ["config", "model_id"]).filter(F.col("config") == config)
        parts.append(before.join(again, "row_id").groupBy("config").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_anomaly") != F.col("again")).alias("n_different")))
    return union_named(*parts).join(kept, "config")


@register(
    "k6_evaluate",
    metrics_sql(f"SELECT model_id, config, {r('precision')} AS precision, {r('recall')} AS recall, {r('accuracy')} AS accuracy, {r('fbeta')} AS fbeta, "
                "tp + fp AS anomalies_train, tp + fp AS anomalies_test, tp + fn AS true_anomalies FROM runs"),
)
def k6(spark, sf):
    rows = pred(spark, sf).withColumnsRenamed({"y": "label", "y_pred": "is_anomaly"})
    out = tune.evaluate(rows, rows, by=("config", "model_id", "ord"))
    return out.select("model_id", "config", *[rounded(m).alias(m) for m in ("precision", "recall", "accuracy", "fbeta")],
                      "anomalies_train", "anomalies_test", "true_anomalies")


@register(
    "k7_select_best",
    metrics_sql(f"SELECT config, model_id, {r('fbeta')} AS fbeta FROM runs WHERE fbeta > 0 QUALIFY row_number() OVER (PARTITION BY config ORDER BY fbeta DESC, ord) = 1"),
)
def k7(spark, sf):
    runs = classification_metrics(pred(spark, sf), "y", "y_pred", ["config", "model_id", "ord"])
    return tune.select_best(runs).select("config", "model_id", rounded("fbeta").alias("fbeta"))


def _day_vectors(spark, sf):
    return cut_lineage(to_vector(keyed_days(spark, sf).na.fill(0.0, ITEMS), ITEMS).select("row_id", "features"))


@register("k8_shapley")
def k8(spark, sf):
    rows = _day_vectors(spark, sf)
    model = IsolationForest(50, 0.1).fit(rows)
    return path_shapley(model, rows, rows, ITEMS, hide=["error"])


@register(
    "k8_shapley_summary",
    sql("daily", "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_gaps, CAST(0 AS BIGINT) AS n_null, CAST(1 AS BIGINT) AS n_bases FROM daily"),
)
def k8s(spark, sf):
    """Attributions add up to the forest's own mean path length on every row."""
    rows = _day_vectors(spark, sf)
    model = IsolationForest(50, 0.1).fit(rows)
    total = sum((F.col(c) for c in ITEMS), F.col("base"))
    own = model.path_sums(rows, [model.n_trees]).select("row_id", (F.col("paths")[0] / model.n_trees).alias("path"))
    joined = cut_lineage(path_shapley(model, rows, rows, ITEMS)).join(own, "row_id")
    return joined.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.abs(total + F.col("path")) > 1e-9).alias("n_gaps"),
                      F.count_if(total.isNull()).alias("n_null"), F.count_distinct(F.round("base", 9)).alias("n_bases"))


@register(
    "k9_shapley_summary",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r(f'avg(abs({c}))')} AS mean_abs, {r(f'quantile_cont({c}, 0.25)')} AS q1, {r(f'median({c})')} AS median, {r(f'quantile_cont({c}, 0.75)')} AS q3 "
        "FROM (SELECT l_quantity - 25 AS l_quantity, l_discount - l_tax AS l_discount FROM lineitem)" for c in ("l_quantity", "l_discount")),
)
def k9(spark, sf):
    phi = feat(spark, sf).select((F.col("l_quantity") - 25).alias("l_quantity"), (F.col("l_discount") - F.col("l_tax")).alias("l_discount"))
    out = explain.shapley_summary(phi, ["l_quantity", "l_discount"])
    return out.select("feature", *[rounded(c).alias(c) for c in ("mean_abs", "q1", "median", "q3")])


WIDE = [f"e{i}" for i in range(1, 65)]


@register(
    "k10_neighbour_deviation",
    knn_sql(f"SELECT row_id, feature, {r('deviation')} AS deviation, CAST(row_number() OVER (PARTITION BY row_id ORDER BY deviation DESC, feature) AS INTEGER) AS rank FROM dev",
            ", dev AS (SELECT n.query_id AS row_id, 'e' || CAST(d.i AS VARCHAR) AS feature, abs(any_value(q.features[d.i]) - avg(t.features[d.i])) AS deviation "
            "FROM near n JOIN vec q ON n.query_id = q.row_id JOIN vec t ON n.neighbour_id = t.row_id CROSS JOIN range(1, 65) d(i) GROUP BY n.query_id, d.i)"),
)
def k10(spark, sf):
    rows = vec(spark, sf).select("row_id", *[F.col("features")[i].alias(c) for i, c in enumerate(WIDE)])
    return explain.neighbour_deviation(rows, rows, WIDE, K, exclude_self=True).withColumn("deviation", rounded("deviation"))


@register("a10_save_load_models")
def a10(spark, sf):
    rows = vec(spark, sf).select("row_id", "features")
    near = cut_lineage(knn_join(rows, rows, 5, exclude_self=True))  # one search for the fit and the flags before; the loaded model searches anew
    forest, svm, lof = IsolationForest(20, 0.1).fit(rows), OneClassSVM("rbf", 0.2).fit(rows), LocalOutlierFactor(5, 0.1).fit(rows, near)
    parts = []
    for model, flags in ((forest, forest.transform(rows)), (svm, svm.transform(rows)), (lof, lof.transform(rows, counted_in(near, rows, 5)))):
        loaded = load_model(spark, model.save(scratch_path(spark, model.KIND)))
        both = flags.select("row_id", F.col("is_anomaly").alias("a")).join(
            loaded.transform(rows).select("row_id", F.col("is_anomaly").alias("b")), "row_id")
        parts.append(both.agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("n_flagged"), F.count_if(F.col("a") == F.col("b")).alias("n_same"))
                     .withColumn("kind", F.lit(model.KIND)))
    return union_named(*parts)
