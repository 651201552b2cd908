"""Queries for the error analysis and cohort reports L1-L6."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog.registry import register, rounded, sql_rounded as r
from wardline.catalog.views import ITEMS, KEYS, cohort, sql
from wardline.models.stats import RobustScaler
from wardline.operators import cohort as C

DAY = "CAST(day AS VARCHAR) AS day"
SLICE = "CASE WHEN flag = 1 AND label = 1 THEN 'TP' WHEN flag = 1 THEN 'FP' WHEN label = 1 THEN 'FN' ELSE 'TN' END"
PCT = "CASE WHEN b.purchase <> 0 THEN (c.purchase - b.purchase) / b.purchase * 100 END"
BASED = (
    f"based AS (SELECT c.*, b.purchase AS baseline, {PCT} AS pct_change FROM cohort c LEFT JOIN "
    "(SELECT pid, intid, purchase FROM cohort WHERE seq = 1) b ON c.pid = b.pid AND c.intid = b.intid)"
)


def based_sql(body: str) -> str:
    return sql("cohort", "").rstrip() + ", " + BASED + " " + body


@register("l1_error_slices", sql("cohort", f"SELECT {SLICE} AS slice, pid, count(*) AS n FROM cohort GROUP BY ALL"))
def l1(spark, sf):
    return C.slice_entities(C.error_slices(cohort(spark, sf), "flag", "label"), "pid")


@register(
    "l2_change_of_slice",
    based_sql(f"SELECT pid, intid, {DAY}, {r('pct_change', 4)} AS pct_change FROM based WHERE flag = 1 AND label = 0 AND pct_change < 0"),
)
def l2(spark, sf):
    rows = cohort(spark, sf)
    part = C.error_slices(rows, "flag", "label").filter("slice = 'FP'")
    out = C.change_of_slice(part, rows, KEYS, "seq", "purchase", "negative")
    return out.select(*KEYS, F.col("day").cast("string").alias("day"), rounded("pct_change", 4).alias("pct_change"))


@register(
    "l2_mean_change_of_slices",
    based_sql(f"SELECT slice, {r('avg(pct_change)')} AS mean_change, count(pct_change) AS n FROM (SELECT {SLICE} AS slice, pct_change FROM based) "
              "WHERE slice IN ('FN', 'FP') AND pct_change IS NOT NULL GROUP BY slice"),
)
def l2m(spark, sf):
    rows = cohort(spark, sf)
    sliced = C.error_slices(rows, "flag", "label").drop("purchase")
    changes = {k: C.change_of_slice(sliced.filter(F.col("slice") == k).drop("slice"), rows, KEYS, "seq", "purchase") for k in ("FN", "FP")}
    return C.mean_of_slices(changes).select("slice", rounded("mean_change").alias("mean_change"), "n")


@register(
    "l3_unlabelled_entities",
    sql("cohort", "SELECT DISTINCT pid, 'label' AS kind FROM cohort WHERE control = 0 AND pid NOT IN (SELECT pid FROM cohort WHERE label = 1) "
        "UNION ALL SELECT DISTINCT pid, 'label or flag' FROM cohort WHERE control = 0 AND pid NOT IN (SELECT pid FROM cohort WHERE label = 1 OR flag = 1)"),
)
def l3(spark, sf):
    rows, known = cohort(spark, sf), F.col("control") == 0
    a = C.unlabelled_entities(rows, "pid", known, "label").withColumn("kind", F.lit("label"))
    return a.unionByName(C.unlabelled_entities(rows, "pid", known, "label", "flag").withColumn("kind", F.lit("label or flag")))


@register(
    "l4_timeline",
    sql("cohort", "SELECT c.pid, c.intid, c.dsa, c.control, c.feature, " + r("c.value") + " AS value, k.day_class FROM ("
        "SELECT pid, intid, CAST(dsa AS INTEGER) AS dsa, control, feature, value FROM (SELECT pid, intid, dsa, control, "
        + ", ".join(f"({c} - (SELECT median({c}) FROM cohort)) / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM cohort) AS {c}" for c in ITEMS)
        + f" FROM cohort) UNPIVOT (value FOR feature IN ({', '.join(ITEMS)}))) c LEFT JOIN (SELECT pid, intid, dsa, CASE WHEN a AND b THEN 'both' WHEN a THEN 'model' ELSE 'label' END AS day_class "
        "FROM (SELECT pid, intid, dsa, bool_or(flag = 1) AS a, bool_or(label = 1) AS b FROM cohort GROUP BY ALL) WHERE a OR b) k "
        "ON c.pid = k.pid AND c.intid = k.intid AND c.dsa = k.dsa"),
)
def l4(spark, sf):
    rows = cohort(spark, sf).select(*KEYS, "dsa", "control", "flag", "label", *ITEMS)
    out = C.timeline(rows, RobustScaler(ITEMS).fit(rows), KEYS, "dsa", ITEMS, "control", "flag", "label")
    return out.select(*KEYS, "dsa", "control", "feature", rounded("value").alias("value"), "day_class")


EARLY = "day < DATE '2024-01-16'"


@register(
    "l5_cohort_summary",
    based_sql(
        "SELECT metric, CAST(cohort AS INTEGER) AS cohort, CAST(value AS DOUBLE) AS value FROM ("
        f"SELECT 'entities_train' AS metric, NULL AS cohort, count(DISTINCT pid) AS value FROM cohort WHERE {EARLY} "
        f"UNION ALL SELECT 'entities_test', NULL, count(DISTINCT pid) FROM cohort WHERE NOT {EARLY} "
        f"UNION ALL SELECT 'entities_test_by_cohort', control, count(DISTINCT pid) FROM cohort WHERE NOT {EARLY} GROUP BY control "
        f"UNION ALL SELECT 'rows_per_entity', control, round(avg(n), 6) FROM (SELECT control, pid, count(*) AS n FROM cohort WHERE NOT {EARLY} GROUP BY ALL) GROUP BY control "
        f"UNION ALL SELECT 'entities_without_label', NULL, count(*) FROM (SELECT pid FROM cohort WHERE NOT {EARLY} AND control = 0 GROUP BY pid HAVING count(*) FILTER (WHERE label = 1) = 0) "
        f"UNION ALL SELECT 'control_rows_with_drop', NULL, count(*) FROM based WHERE NOT {EARLY} AND control = 1 AND pct_change <= -10)"),
)
def l5(spark, sf):
    rows = cohort(spark, sf)
    early = F.col("day") < F.lit("2024-01-16").cast("date")
    out = C.cohort_summary(rows.filter(early), rows.filter(~early), "pid", "control", "label", KEYS, "seq", "purchase")
    return out.withColumn("value", rounded("value"))


@register("l6_entity_distribution", sql("cohort", "SELECT age, count(DISTINCT pid) AS n_entities FROM cohort WHERE age IS NOT NULL GROUP BY age"))
def l6(spark, sf):
    return C.entity_distribution(cohort(spark, sf), "pid", "age")
