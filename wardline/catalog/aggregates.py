"""Queries for the grouped summaries D1-D25."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from wardline.catalog.registry import register, rounded, sql_rounded as r, table
from wardline.catalog.tables import metrics_sql
from wardline.catalog.views import FEATS, FEAT_KEYS, ITEMS, KEYS, cohort, daily, demo, feat, obs, obs2, obs_num, pred, sql
from wardline.functions import pct_from, slot_label
from wardline.operators import agg as A, reshape as R
from wardline.operators.join import with_baseline

DAY = "CAST(day AS VARCHAR) AS day"
WIDE = ["pid", "intid", "day", *ITEMS]


def _text_day(df):
    return df.withColumn("day", F.col("day").cast("string"))


@register(
    "d1_first_non_null",
    sql("daily", "SELECT pid, " + ", ".join(f"arg_min({c}, day) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ITEMS) + " FROM daily GROUP BY pid"),
)
def d1(spark, sf):
    return R.first_non_null(daily(spark, sf), ["pid"], ITEMS, ["day", "intid"])


@register("d2_pivot_first", sql("daily", f"SELECT pid, intid, {DAY}, {', '.join(ITEMS)} FROM daily"))
def d2(spark, sf):
    return _text_day(R.pivot_first(obs_num(spark, sf), [*KEYS, "day"], "item", "num", ITEMS, ["ord"]))


@register(
    "d3_melt",
    sql("obs2", "SELECT ord, item || ' 1' AS label, 'value1' AS slot, value1 AS value FROM obs2 "
        "UNION ALL SELECT ord, item || ' 2', 'value2', value2 FROM obs2"),
)
def d3(spark, sf):
    long = R.melt(obs2(spark, sf), ["ord", "item"], ["value1", "value2"], "slot", "value")
    return long.select("ord", slot_label("item", "slot").alias("label"), "slot", "value")


@register("d4_value_counts", sql("obs", "SELECT pid, count(*) AS n FROM obs GROUP BY pid"))
def d4(spark, sf):
    return A.value_counts(obs(spark, sf), "pid")


@register("d5_distinct_count", sql("demo", "SELECT diagnosis, count(DISTINCT age) AS n_distinct FROM demo GROUP BY diagnosis"))
def d5(spark, sf):
    return A.distinct_count(demo(spark, sf), "age", ["diagnosis"])


@register(
    "d6_mean_rows_per",
    sql("cohort", f"SELECT control, {r('avg(n)')} AS mean_rows FROM (SELECT control, pid, count(*) AS n FROM cohort GROUP BY ALL) GROUP BY control"),
)
def d6(spark, sf):
    return A.mean_rows_per(cohort(spark, sf), "pid", ["control"]).withColumn("mean_rows", rounded("mean_rows"))


@register(
    "d7_groups_without",
    sql("daily", f"SELECT pid, intid, {DAY}, view FROM daily QUALIFY count(*) FILTER (WHERE view > 150) OVER (PARTITION BY pid, intid) = 0"),
)
def d7(spark, sf):
    days = daily(spark, sf).select("pid", "intid", "day", "view")
    return _text_day(A.groups_without(days, KEYS, F.col("view") > 150))


@register("d8_any_by", sql("daily", "SELECT pid, COALESCE(bool_or(view > 150), false) AS any_hit FROM daily GROUP BY pid"))
def d8(spark, sf):
    return A.any_by(daily(spark, sf), ["pid"], F.col("view") > 150)


@register(
    "d9_list_by",
    sql("cohort", "SELECT pid, intid, 0 AS part, list(seq ORDER BY seq) AS items FROM cohort WHERE label = 1 GROUP BY pid, intid"),
)
def d9(spark, sf):
    return A.list_by(cohort(spark, sf), KEYS, "seq", F.col("label") == 1)


@register(
    "d10_center",
    sql("daily", " UNION ALL ".join(f"SELECT '{c}' AS feature, {r(f'avg({c})')} AS mean, {r(f'median({c})')} AS median FROM daily" for c in ITEMS)),
)
def d10(spark, sf):
    return A.center(daily(spark, sf), ITEMS).select("feature", rounded("mean").alias("mean"), rounded("median").alias("median"))


@register(
    "d11_null_profile",
    sql("daily", " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL) AS n_null, {r(f'count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*)', 2)} AS pct_null FROM daily"
        for c in ITEMS)),
)
def d11(spark, sf):
    return A.null_profile(daily(spark, sf), ITEMS)


@register(
    "d12_stddevs",
    " UNION ALL ".join(f"SELECT '{c}' AS feature, {r(f'stddev_samp({c})')} AS sd FROM lineitem" for c in FEATS),
)
def d12(spark, sf):
    return A.stddevs(feat(spark, sf), FEATS).withColumn("sd", rounded("sd"))


METRICS = ["precision", "recall", "accuracy", "fbeta"]


def _runs(spark, sf):
    return A.classification_metrics(pred(spark, sf), "y", "y_pred", ["config", "model_id", "ord"])


@register(
    "d13_metrics",
    metrics_sql("SELECT config, model_id, tp, fp, fn, tn, " + ", ".join(f"{r(m)} AS {m}" for m in METRICS) + " FROM runs"),
)
def d13(spark, sf):
    return _runs(spark, sf).select("config", "model_id", "tp", "fp", "fn", "tn", *[rounded(m).alias(m) for m in METRICS])


@register(
    "d14_flag_counts",
    sql("pred", "SELECT config, model_id, count(*) FILTER (WHERE y_pred = 1) AS n_flagged, count(*) FILTER (WHERE y = 1) AS n_true FROM pred GROUP BY ALL"),
)
def d14(spark, sf):
    return A.flag_counts(pred(spark, sf), "y_pred", ["config", "model_id"], "y")


@register(
    "d15_arg_best",
    metrics_sql(f"SELECT config, model_id, ord, {r('fbeta')} AS fbeta FROM runs QUALIFY row_number() OVER (PARTITION BY config ORDER BY fbeta DESC, ord) = 1"),
)
def d15(spark, sf):
    return A.arg_best(_runs(spark, sf), ["config"], "fbeta", "ord").select("config", "model_id", "ord", rounded("fbeta").alias("fbeta"))


@register(
    "d16_best_per_type",
    metrics_sql(
        f"SELECT config, model_type, model_id, {r('fbeta')} AS fbeta, n_runs FROM (SELECT *, split_part(model_id, ' ', 1) AS model_type, "
        "count(*) OVER (PARTITION BY config, split_part(model_id, ' ', 1)) AS n_runs FROM runs) "
        "QUALIFY row_number() OVER (PARTITION BY config, model_type ORDER BY fbeta DESC, ord) = 1"),
)
def d16(spark, sf):
    best = A.best_per_type(_runs(spark, sf), ["config"], "model_id", "fbeta", "ord")
    return best.select("config", "model_type", "model_id", rounded("fbeta").alias("fbeta"), "n_runs")


def _pairs(cols, expr):
    return " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, {r(expr(a, b))} AS r FROM t" for a in cols for b in cols)


@register("d17_corr_pearson", "WITH t AS (SELECT * FROM lineitem) " + _pairs(FEATS, lambda a, b: f"corr({a}, {b})"))
def d17(spark, sf):
    return A.corr_matrix(feat(spark, sf), FEATS).withColumn("r", rounded("r"))


@register(
    "d18_corr_spearman",
    "WITH t AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in FEATS)
    + " FROM lineitem) " + _pairs(FEATS, lambda a, b: f"corr({a}, {b})"),
)
def d18(spark, sf):
    return A.corr_matrix(feat(spark, sf), FEATS, "spearman", FEAT_KEYS).withColumn("r", rounded("r"))


@register(
    "d19_mean_abs_dev",
    sql("cohort", " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r(f'avg(abs({c} - (SELECT median({c}) FROM cohort WHERE control = 0))) FILTER (WHERE flag = 1)')} AS mean_dev FROM cohort"
        for c in ITEMS)),
)
def d19(spark, sf):
    rows = cohort(spark, sf)
    out = A.mean_abs_dev(rows.filter("control = 0"), rows.filter("flag = 1"), ITEMS)
    return out.withColumn("mean_dev", rounded("mean_dev"))


@register(
    "d20_mean_change",
    sql("cohort", f"SELECT control, {r('avg(pct)')} AS mean_change, count(pct) AS n FROM (SELECT c.control, CASE WHEN b.purchase <> 0 THEN "
        "(c.purchase - b.purchase) / b.purchase * 100 END AS pct FROM cohort c LEFT JOIN "
        "(SELECT pid, intid, purchase FROM cohort WHERE seq = 1) b ON c.pid = b.pid AND c.intid = b.intid WHERE c.label = 1) GROUP BY control"),
)
def d20(spark, sf):
    rows = cohort(spark, sf)
    based = with_baseline(rows.filter("label = 1"), rows, KEYS, "seq", "purchase")
    out = A.mean_change(based.withColumn("pct", pct_from("purchase", "baseline")), "pct", ["control"])
    return out.withColumn("mean_change", rounded("mean_change"))


@register(
    "d21_box_summary",
    "SELECT event_type, 'value' AS feature, min(value) AS min, " + ", ".join(f"{r(f'quantile_cont(value, {p})')} AS {n}" for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")))
    + f", max(value) AS max, {r('quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25))')} AS low_fence"
    + f", {r('quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25))')} AS high_fence FROM events GROUP BY event_type",
)
def d21(spark, sf):
    out = A.box_summary(table(spark, sf, "events"), ["value"], ["event_type"])
    return out.withColumns({c: rounded(c) for c in ("q1", "median", "q3", "low_fence", "high_fence")})


@register(
    "d22_density_grid",
    "WITH v AS (SELECT ln(1 + value) AS x FROM events), s AS (SELECT count(x) AS n, stddev_samp(x) * power(count(x), -0.2) AS w, min(x) AS lo, max(x) AS hi FROM v), "
    "g AS (SELECT CAST(i AS INTEGER) AS i, lo - 3 * w + i * ((hi - lo + 6 * w) / 49) AS x, n, w FROM s, range(0, 50) t(i)) "
    f"SELECT g.i, {r('g.x')} AS x, {r('sum(exp(-0.5 * power((g.x - v.x) / g.w, 2))) / (g.n * g.w * sqrt(2 * pi()))')} AS density FROM g, v GROUP BY g.i, g.x, g.n, g.w",
)
def d22(spark, sf):
    return A.density_grid(table(spark, sf, "events"), "value", 50).select("i", rounded("x").alias("x"), rounded("density").alias("density"))


@register("d23_unique_sorted", "SELECT DISTINCT event_type FROM events ORDER BY 1")
def d23(spark, sf):
    return A.unique_sorted(table(spark, sf, "events"), "event_type")


@register("d24_median_length", "SELECT median(length(CAST(o_orderkey AS VARCHAR))) AS median_len FROM orders")
def d24(spark, sf):
    return A.median_length(table(spark, sf, "orders"), "o_orderkey")


@register(
    "d25_day_overlap",
    sql("cohort", "SELECT pid, count(*) FILTER (WHERE a AND NOT b) AS n_model, count(*) FILTER (WHERE b AND NOT a) AS n_label, count(*) FILTER (WHERE a AND b) AS n_both "
        "FROM (SELECT pid, dsa, bool_or(flag = 1) AS a, bool_or(label = 1) AS b FROM cohort GROUP BY pid, dsa) WHERE a OR b GROUP BY pid"),
)
def d25(spark, sf):
    return A.day_overlap(cohort(spark, sf), ["pid"], "dsa", F.col("flag") == 1, F.col("label") == 1)
