"""Queries for the scalar expressions H1-H20."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline import functions as W
from wardline.catalog.registry import register, rounded, sql_rounded as r, table
from wardline.catalog.views import ITEMS, daily, demo, obs, obs2, sql

NUMBER_SQL = "regexp_full_match({c}, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*')"
DAY = "CAST(day AS VARCHAR) AS day"


@register(
    "h1_clean_censored",
    sql("obs", "SELECT ord, CASE WHEN raw LIKE '<%' THEN TRY_CAST(substr(raw, 2) AS DOUBLE) WHEN raw = 'NEG' THEN NULL "
        "WHEN contains(raw, ',') THEN NULL ELSE CAST(raw AS DOUBLE) END AS limit_value, "
        "CASE WHEN raw LIKE '<%' THEN CAST(TRY_CAST(substr(raw, 2) AS BIGINT) - 1 AS DOUBLE) WHEN raw = 'NEG' THEN NULL "
        "WHEN contains(raw, ',') THEN NULL ELSE CAST(raw AS DOUBLE) END AS minus_one, "
        "CASE WHEN raw LIKE '<%' THEN 1 ELSE 0 END AS censored FROM obs"),
)
def h1(spark, sf):
    return obs(spark, sf).select(
        "ord", W.clean_censored("raw").alias("limit_value"), W.clean_censored("raw", "int_minus_one").alias("minus_one"),
        W.is_censored("raw").alias("censored"),
    )


@register(
    "h2_to_number",
    sql("obs", "SELECT ord, CASE WHEN " + NUMBER_SQL.format(c="raw") + " THEN TRY_CAST(raw AS DOUBLE) END AS num FROM obs"),
)
def h2(spark, sf):
    return obs(spark, sf).select("ord", W.to_number("raw").alias("num"))


@register("h3_decimal_comma", sql("obs", "SELECT ord, replace(raw, ',', '.') AS txt FROM obs"))
def h3(spark, sf):
    return obs(spark, sf).select("ord", W.decimal_comma("raw").alias("txt"))


@register(
    "h4_parse_ts",
    "SELECT event_id, CASE WHEN event_id % 7 = 3 THEN NULL ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS parsed FROM events",
)
def h4(spark, sf):
    text = (
        F.when(F.col("event_id") % 7 == 3, F.lit("31-02-1670 99:00"))
        .when(F.col("event_id") % 7 == 2, F.date_format("ts", "dd-MM-yyyy HH:mm:ss"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    )
    rows = table(spark, sf, "events").select("event_id", text.alias("txt"))
    parsed = W.parse_ts("txt", ["yyyy-MM-dd HH:mm:ss", "dd-MM-yyyy HH:mm:ss"])
    return rows.select("event_id", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@register("h5_to_day", "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events")
def h5(spark, sf):
    return table(spark, sf, "events").select("event_id", W.to_day("ts").cast("string").alias("day"))


@register(
    "h6_epoch",
    "SELECT event_id, CAST(epoch(CAST(ts AS DATE)) AS BIGINT) AS day_epoch, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS back FROM events",
)
def h6(spark, sf):
    rows = table(spark, sf, "events").select("event_id", W.to_epoch(W.to_day("ts")).alias("day_epoch"))
    return rows.withColumn("back", F.date_format(W.from_epoch("day_epoch"), "yyyy-MM-dd"))


@register("h7_time_of_day", "SELECT event_id, strftime(ts, '%H:%M:%S') AS tod FROM events")
def h7(spark, sf):
    return table(spark, sf, "events").select("event_id", W.time_of_day("ts").alias("tod"))


@register(
    "h8_null_if_in",
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount NOT IN (0.0, 0.05) THEN l_discount END AS disc FROM lineitem",
)
def h8(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", W.null_if_in("l_discount", [0.0, 0.05]).alias("disc")
    )


@register(
    "h9_bmi",
    f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount <> 0 THEN {r('l_quantity / power(l_discount * 100 / 100, 2)', 4)} END AS bmi FROM lineitem",
)
def h9(spark, sf):
    height = W.cm_to_m(F.col("l_discount") * 100)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", rounded(W.bmi("l_quantity", height), 4).alias("bmi")
    )


@register(
    "h10_fill_or_set",
    sql("daily", f"SELECT pid, intid, {DAY}, COALESCE(click, view * 2) AS click, error * 3 AS view FROM daily"),
)
def h10(spark, sf):
    days = daily(spark, sf).withColumn("day", F.col("day").cast("string"))
    filled = W.fill_or_set(days, "click", F.col("view") * 2)
    return W.fill_or_set(filled, "view", F.col("error") * 3, "set").select("pid", "intid", "day", "click", "view")


@register("h11_strict_int", "SELECT o_orderkey, CAST(CAST(o_custkey AS VARCHAR) AS BIGINT) AS cust FROM orders")
def h11(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", W.strict_int(F.col("o_custkey").cast("string")).alias("cust"))


@register(
    "h12_slot_label",
    sql("obs2", "SELECT ord, item || ' ' || regexp_extract('VALUE ' || CAST(1 + ord % 2 AS VARCHAR), '(\\d)', 1) AS label FROM obs2"),
)
def h12(spark, sf):
    slot = F.concat(F.lit("VALUE "), (F.lit(1) + F.col("ord") % 2).cast("string"))
    return obs2(spark, sf).select("ord", W.slot_label("item", slot).alias("label"))


@register("h13_map_values", sql("demo", "SELECT pid, CASE sex WHEN 'Vrouw' THEN 1 WHEN 'Man' THEN 0 END AS sex01 FROM demo"))
def h13(spark, sf):
    return demo(spark, sf).select("pid", W.map_values("sex", {"Vrouw": 1, "Man": 0}).alias("sex01"))


@register(
    "h14_missing_flags",
    sql("daily", f"SELECT pid, intid, {DAY}, " + ", ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS missing_{c}" for c in ITEMS) + " FROM daily"),
)
def h14(spark, sf):
    days = daily(spark, sf).withColumn("day", F.col("day").cast("string"))
    return W.missing_flags(days, ITEMS).drop(*ITEMS)


@register(
    "h15_pct_from",
    f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount <> 0 THEN {r('(l_tax - l_discount) / l_discount * 100', 4)} END AS pct FROM lineitem",
)
def h15(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", rounded(W.pct_from("l_tax", "l_discount"), 4).alias("pct")
    )


@register(
    "h16_math",
    f"SELECT event_id, {r('ln(1 + value)')} AS log1p_v, {r('abs(value - 50)')} AS abs_v, {r('value / 7', 2)} AS round_v, {r('power(value, 2)', 4)} AS pow_v FROM events",
)
def h16(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", rounded(F.log1p(v)).alias("log1p_v"), rounded(F.abs(v - 50)).alias("abs_v"),
        F.round(v / 7, 2).alias("round_v"), rounded(F.pow(v, F.lit(2)), 4).alias("pow_v"),
    )


@register("h17_to_binary", "SELECT doc_id, CASE WHEN (CASE toxic WHEN 1 THEN -1 ELSE 1 END) = -1 THEN 1 ELSE 0 END AS bin FROM labels")
def h17(spark, sf):
    score = F.when(F.col("toxic") == 1, -1).otherwise(1)
    return table(spark, sf, "labels").select("doc_id", W.to_binary(score, -1).alias("bin"))


@register("h18_fill_value", sql("daily", f"SELECT pid, intid, {DAY}, COALESCE(view, 0.0) AS view FROM daily"))
def h18(spark, sf):
    return daily(spark, sf).select("pid", "intid", F.col("day").cast("string").alias("day"), W.fill_value("view", 0.0).alias("view"))


@register("h19_with_flags", sql("demo", "SELECT *, 0 AS rfs, 1 AS control FROM demo"))
def h19(spark, sf):
    return W.with_flags(demo(spark, sf), rfs=0, control=1)


@register(
    "h20_model_id",
    "SELECT o_orderkey, 'One-Class SVM (kernel=' || o_orderstatus || ', nu=' || CAST(o_custkey AS VARCHAR) || ')' AS mid, "
    "'ONE-CLASS SVM (KERNEL=' || upper(o_orderstatus) || ', NU=' || CAST(o_custkey AS VARCHAR) || ')' AS upper_id, "
    "'One-Class_SVM_kernel-' || o_orderstatus || '_nu-' || CAST(o_custkey AS VARCHAR) AS file_id FROM orders",
)
def h20(spark, sf):
    mid = W.model_id("One-Class SVM", {"kernel": "o_orderstatus", "nu": "o_custkey"})
    return table(spark, sf, "orders").select(
        "o_orderkey", mid.alias("mid"), F.upper(mid).alias("upper_id"), W.file_safe(mid).alias("file_id")
    )
