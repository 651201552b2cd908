"""Queries for the joins C1-C8; C9 lives with the models."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog.registry import register, rounded, sql_rounded as r, table
from wardline.catalog.views import KEYS, cohort, daily, demo, obs_num, sql
from wardline.functions import pct_from
from wardline.operators import join as J, select as S

DAY = "CAST(day AS VARCHAR) AS day"


def _text_day(df):
    return df.withColumn("day", F.col("day").cast("string"))


@register("c1_semi", sql("daily demo", f"SELECT pid, intid, {DAY}, view FROM daily WHERE pid IN (SELECT pid FROM demo WHERE age < 25)"))
def c1(spark, sf):
    young = demo(spark, sf).filter("age < 25")
    return _text_day(J.semi(daily(spark, sf).select("pid", "intid", "day", "view"), young, "pid"))


@register(
    "c2_left_keep_two_keys",
    sql("daily demo", "SELECT d.pid, d.intid, CAST(d.day AS VARCHAR) AS day, d.view, m.age FROM daily d LEFT JOIN demo m ON d.pid = m.pid AND d.intid = m.intid"),
)
def c2(spark, sf):
    days = daily(spark, sf).select("pid", "intid", "day", "view")
    return _text_day(J.left_keep(days, demo(spark, sf), KEYS, ["age"]))


@register(
    "c3_left_keep_three_keys",
    sql("daily obs_num", "SELECT d.pid, d.intid, CAST(d.day AS VARCHAR) AS day, d.click, v.top FROM daily d LEFT JOIN "
        "(SELECT pid, intid, day, max(num) AS top FROM obs_num WHERE item = 'view' GROUP BY ALL) v "
        "ON d.pid = v.pid AND d.intid = v.intid AND d.day = v.day"),
)
def c3(spark, sf):
    views = obs_num(spark, sf).filter("item = 'view'").groupBy(*KEYS, "day").agg(F.max("num").alias("top"), F.count("num").alias("click"))
    days = daily(spark, sf).select("pid", "intid", "day", "click")
    return _text_day(J.left_keep(days, views, [*KEYS, "day"], ["top"]))


@register(
    "c4_lookup",
    "SELECT o.o_orderkey, o.o_custkey AS pid, c.c_mktsegment, c.c_nationkey FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey",
)
def c4(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("pid"))
    dim = table(spark, sf, "customer").withColumnRenamed("c_custkey", "pid")
    return J.lookup(rows, dim, "pid", ["c_mktsegment", "c_nationkey"])


@register(
    "c5_anti",
    sql("cohort", "SELECT DISTINCT pid FROM cohort WHERE control = 0 AND pid NOT IN (SELECT pid FROM cohort WHERE label = 1)"),
)
def c5(spark, sf):
    rows = cohort(spark, sf)
    return J.anti(rows.filter("control = 0"), rows.filter("label = 1"), "pid").select("pid").distinct()


BASE_SQL = (
    "SELECT c.pid, c.intid, CAST(c.day AS VARCHAR) AS day, c.seq, c.purchase, b.purchase AS baseline, "
    f"CASE WHEN b.purchase <> 0 THEN {r('(c.purchase - b.purchase) / b.purchase * 100', 4)} END AS pct "
    "FROM cohort c LEFT JOIN (SELECT pid, intid, purchase FROM cohort WHERE seq = 1) b ON c.pid = b.pid AND c.intid = b.intid "
    "WHERE c.flag = 1 AND c.label = 0"
)


@register("c6_with_baseline", sql("cohort", BASE_SQL))
def c6(spark, sf):
    rows = cohort(spark, sf)
    part = rows.filter("flag = 1 and label = 0").select("pid", "intid", "day", "seq", "purchase")
    based = J.with_baseline(part, rows, KEYS, "seq", "purchase")
    return _text_day(based).withColumn("pct", rounded(pct_from("purchase", "baseline"), 4))


@register(
    "c7_baseline_other_table",
    sql("cohort", "SELECT o.o_orderkey, o.o_custkey AS pid, b.purchase AS baseline FROM orders o LEFT JOIN "
        "(SELECT pid, purchase FROM cohort WHERE seq = 1 QUALIFY row_number() OVER (PARTITION BY pid ORDER BY intid) = 1) b "
        "ON o.o_custkey = b.pid"),
)
def c7(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("pid"))
    return J.with_baseline(rows, cohort(spark, sf), ["pid"], "seq", "purchase", order_by=["intid"])


@register("c8_fill_ids")
def c8(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("pid")
    )
    used = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pid"))
    return J.fill_ids(rows, "pid", used, ["o_orderkey"], seed=7)


@register(
    "c8_fill_ids_summary",
    "SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_null, count(*) FILTER (WHERE o_orderstatus <> 'P') AS n_kept, "
    "count(*) FILTER (WHERE o_orderstatus = 'P') AS n_new, CAST(0 AS BIGINT) AS n_taken FROM orders",
)
def c8_summary(spark, sf):
    before = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("was"))
    used = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pid")).distinct().withColumn("used", F.lit(1))
    rows = c8(spark, sf).join(before, "o_orderkey").join(used, "pid", "left")
    fresh = F.col("was").isNull()
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("pid").isNull()).alias("n_null"), F.count_if(F.col("pid") == F.col("was")).alias("n_kept"),
        F.countDistinct(F.when(fresh, F.col("pid"))).alias("n_new"), F.count_if(fresh & F.col("used").isNotNull()).alias("n_taken"),
    )
