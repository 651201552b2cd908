"""Queries for sources, projections, filters, sets and sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog.registry import register, rounded, sql_rounded as r, table
from wardline.catalog.views import FEATS, FEAT_KEYS, ITEMS, KEYS, cohort, daily, demo, feat, obs, obs_num, pred, sql
from wardline.operators import select as S, sets, topk
from wardline.session import scratch_path
from wardline.sources import delimited, staged

OBS_TEXT = "pid bigint, intid bigint, ord bigint, item string, raw string, day date"
DEMO_TEXT = "pid bigint, intid bigint, age double, sex string, diagnosis string"
DAY = "CAST(day AS VARCHAR) AS day"


def _text_day(df):
    return df.withColumn("day", F.col("day").cast("string"))


@register("a1_read_tab", sql("obs", f"SELECT pid, intid, ord, item, raw, {DAY} FROM obs"))
def a1(spark, sf):
    path = delimited.write_delimited(
        obs(spark, sf).select("pid", "intid", "ord", "item", "raw", "day"), scratch_path(spark, "a1"), "\t"
    )
    return _text_day(delimited.read_delimited(spark, path, OBS_TEXT, "\t"))


@register("a2_read_parts", sql("obs", f"SELECT pid, intid, ord, item, raw, {DAY} FROM obs"))
def a2(spark, sf):
    rows = obs(spark, sf).select("pid", "intid", "ord", "item", "raw", "day")
    early = F.col("day") < F.lit("2024-01-16").cast("date")
    paths = [
        delimited.write_delimited(part, scratch_path(spark, "a2"), ",")
        for part in (rows.filter(early), rows.filter(~early))
    ]
    return _text_day(delimited.read_parts(spark, paths, OBS_TEXT))


@register("a3_read_semicolon", sql("demo", "SELECT pid, intid, age, sex, diagnosis FROM demo"))
def a3(spark, sf):
    path = delimited.write_delimited(demo(spark, sf), scratch_path(spark, "a3"), ";")
    return delimited.read_delimited(spark, path, DEMO_TEXT, ";")


@register(
    "a4_read_latin1",
    "SELECT c_custkey AS pid, c_mktsegment || ' é ü ' || CAST(c_nationkey AS VARCHAR) AS note FROM customer",
)
def a4(spark, sf):
    note = F.concat("c_mktsegment", F.lit(" é ü "), F.col("c_nationkey").cast("string"))
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("pid"), note.alias("note"))
    path = delimited.write_delimited(rows, scratch_path(spark, "a4"), ",", "ISO-8859-1")
    return delimited.read_delimited(spark, path, "pid bigint, note string", ",", "ISO-8859-1")


@register("a5_read_stage", sql("daily", f"SELECT pid, intid, {DAY}, {', '.join(ITEMS)} FROM daily"))
def a5(spark, sf):
    root = scratch_path(spark, "a5")
    staged.write_stage(daily(spark, sf), root, "wide", "raw", "train")
    return _text_day(staged.read_stage(spark, root, "wide", "raw", "train"))


@register("a6_write_stage_text", sql("demo", "SELECT pid, intid, age, sex, diagnosis FROM demo"))
def a6(spark, sf):
    root = scratch_path(spark, "a6")
    staged.write_stage(demo(spark, sf), root, "demo", "raw", "train", "csv")
    return staged.read_stage(spark, root, "demo", "raw", "train", "csv", DEMO_TEXT)


@register(
    "a7_assemble_parts",
    sql("daily demo", f"SELECT pid, intid, {DAY}, purchase, NULL::DOUBLE AS age, 0 AS control FROM daily "
        "UNION ALL SELECT pid, intid, NULL, NULL, age, 1 FROM demo"),
)
def a7(spark, sf):
    cases = _text_day(daily(spark, sf)).select("pid", "intid", "day", "purchase")
    controls = demo(spark, sf).select("age", "intid", "pid")
    return staged.assemble_parts([(cases, {"control": 0}), (controls, {"control": 1})]).select(
        "pid", "intid", "day", "purchase", "age", "control"
    )


@register(
    "a8_dataset_registry",
    sql("daily", " UNION ALL ".join(
        f"SELECT '{c}' AS config, '{s}' AS split, count(*) AS n, {e} AS n_view FROM daily WHERE day {op} DATE '2024-01-16'"
        for c, e in (("raw", "count(view)"), ("filled", "count(*)")) for s, op in (("train", "<"), ("test", ">=")))),
)
def a8(spark, sf):
    root = scratch_path(spark, "a8")
    days = daily(spark, sf)
    first_half = F.col("day") < F.lit("2024-01-16").cast("date")
    for config, frame in (("raw", days), ("filled", days.na.fill(0.0))):
        staged.write_stage(frame.filter(first_half), root, "wide", config, "train")
        staged.write_stage(frame.filter(~first_half), root, "wide", config, "test")
    sets_ = staged.dataset_registry(spark, root, "wide", ["raw", "filled"])
    parts = [
        df.agg(F.count(F.lit(1)).alias("n"), F.count("view").alias("n_view")).withColumns(
            {"config": F.lit(config), "split": F.lit(split)}
        )
        for config, pair in sets_.items()
        for split, df in zip(("train", "test"), pair)
    ]
    return sets.union_named(*parts)


METRICS_SQL = (
    "runs AS (SELECT config, model_id, ord, tp, fp, fn, tn, "
    "CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, "
    "CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall, "
    "(tp + tn) / (tp + fp + fn + tn) AS accuracy, "
    "CASE WHEN tp + fn + fp = 0 THEN 0 ELSE 5 * tp / (5 * tp + 4 * fn + fp) END AS fbeta FROM ("
    "SELECT config, model_id, ord, count(*) FILTER (WHERE y = 1 AND y_pred = 1) AS tp, "
    "count(*) FILTER (WHERE y = 0 AND y_pred = 1) AS fp, count(*) FILTER (WHERE y = 1 AND y_pred = 0) AS fn, "
    "count(*) FILTER (WHERE y = 0 AND y_pred = 0) AS tn FROM pred GROUP BY ALL))"
)


def metrics_sql(body: str) -> str:
    head = sql("pred", "")
    return head.rstrip() + ", " + METRICS_SQL + " " + body


@register(
    "a9_run_log",
    metrics_sql(f"SELECT config, model_id, ord, {r('fbeta')} AS fbeta, tp + fp + fn + tn AS n_rows FROM runs"),
)
def a9(spark, sf):
    from wardline.operators.agg import classification_metrics

    root = scratch_path(spark, "a9")
    rows = pred(spark, sf)
    runs = classification_metrics(rows, "y", "y_pred", ["config", "model_id", "ord"])
    path = staged.log_predictions(rows, root)
    log = staged.log_runs(runs, root)
    counted = spark.read.parquet(path).groupBy("config", "model_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return spark.read.parquet(log).join(counted, ["config", "model_id"]).select(
        "config", "model_id", "ord", rounded("fbeta").alias("fbeta"), "n_rows"
    )


BEST_COLS = f"model_id, ord, {r('fbeta')} AS fbeta, {r('accuracy')} AS accuracy"


@register(
    "a11_best_report",
    metrics_sql(
        f"SELECT config, {BEST_COLS}, 'config' AS scope FROM runs WHERE fbeta > 0 "
        "QUALIFY row_number() OVER (PARTITION BY config ORDER BY fbeta DESC, ord) = 1 "
        f"UNION ALL SELECT config, {BEST_COLS}, split_part(model_id, ' ', 1) AS scope FROM runs "
        "QUALIFY row_number() OVER (PARTITION BY config, split_part(model_id, ' ', 1) ORDER BY fbeta DESC, ord) = 1"
    ),
)
def a11(spark, sf):
    from wardline.operators.agg import classification_metrics

    runs = classification_metrics(pred(spark, sf), "y", "y_pred", ["config", "model_id", "ord"])
    return staged.best_report(runs).select(
        "config", "model_id", "ord", rounded("fbeta").alias("fbeta"), rounded("accuracy").alias("accuracy"), "scope"
    )


OBS_COLS = "pid, intid, ord, item, raw"


def _obs(spark, sf):
    return obs(spark, sf).select("pid", "intid", "ord", "item", "raw")


@register("b1_keep_items", sql("obs", f"SELECT {OBS_COLS} FROM obs WHERE item IN ('click', 'purchase', 'view')"))
def b1(spark, sf):
    return S.keep_items(_obs(spark, sf), "item", ["click", "purchase", "view"])


@register(
    "b2_keep_ids",
    sql("obs demo", f"SELECT {OBS_COLS} FROM obs WHERE pid IN (SELECT pid FROM demo WHERE diagnosis = 'BUILDING')"),
)
def b2(spark, sf):
    return S.keep_ids(_obs(spark, sf), S.where_eq(demo(spark, sf), "diagnosis", "BUILDING"), "pid")


@register("b3_where_eq", sql("demo", "SELECT * FROM demo WHERE diagnosis = 'MACHINERY'"))
def b3(spark, sf):
    return S.where_eq(demo(spark, sf), "diagnosis", "MACHINERY")


@register("b4_where_not", sql("demo", "SELECT * FROM demo WHERE sex IS DISTINCT FROM 'Man'"))
def b4(spark, sf):
    return S.where_not(demo(spark, sf), "sex", "Man")


@register(
    "b5_drop_ids",
    sql("obs demo", f"SELECT {OBS_COLS} FROM obs WHERE pid NOT IN (SELECT pid FROM demo WHERE sex = 'Man')"),
)
def b5(spark, sf):
    return S.drop_ids(_obs(spark, sf), S.where_eq(demo(spark, sf), "sex", "Man"), "pid")


@register("b6_rename", sql("demo", 'SELECT pid AS "PATIENT_ID", intid AS "INTAKE_ID", age AS "AGE", sex, diagnosis FROM demo'))
def b6(spark, sf):
    return S.rename(demo(spark, sf), {"pid": "PATIENT_ID", "intid": "INTAKE_ID", "age": "AGE"})


@register("b7_project", "SELECT l_shipdate::VARCHAR AS shipped, l_tax, l_quantity FROM lineitem")
def b7(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("shipped", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))
    return S.project(rows, ["shipped", "l_tax", "l_quantity"])


@register("b8_move_after", sql("demo", "SELECT pid, age, intid, sex, diagnosis FROM demo"))
def b8(spark, sf):
    return S.move_after(demo(spark, sf), "age", "pid")


@register("b9_drop_null", sql("daily", f"SELECT pid, intid, {DAY}, {', '.join(ITEMS)} FROM daily WHERE click IS NOT NULL AND view IS NOT NULL"))
def b9(spark, sf):
    return _text_day(S.drop_null(daily(spark, sf), ["click", "view"]))


@register(
    "b10_min_group_rows",
    sql("daily", f"SELECT pid, intid, {DAY}, {', '.join(ITEMS)} FROM daily "
        "QUALIFY count(*) OVER (PARTITION BY pid, intid) >= 14"),
)
def b10(spark, sf):
    return _text_day(S.min_group_rows(daily(spark, sf), KEYS, 14))


@register(
    "b11_within_horizon",
    "SELECT o_orderkey, o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders "
    "QUALIFY date_diff('day', min(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey), CAST(o_orderdate AS DATE)) <= 84",
)
def b11(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    return _text_day(S.within_horizon(rows, ["o_custkey"], "day", 84))


@register(
    "b12_replace_where",
    sql("obs", "SELECT pid, ord, CASE WHEN raw = 'NEG' THEN '0' ELSE raw END AS raw FROM obs"),
)
def b12(spark, sf):
    return S.replace_where(obs(spark, sf).select("pid", "ord", "raw"), "raw", F.col("raw") == "NEG", "0")


@register("b13_drop_constant", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_tax FROM lineitem")
def b13(spark, sf):
    rows = feat(spark, sf).select(*FEAT_KEYS, "l_quantity", "l_tax").withColumn("flat", F.col("l_tax") * 0)
    return S.drop_constant(rows, rows, ["l_quantity", "l_tax", "flat"])


@register("b14_align_features", sql("feat", "SELECT l_orderkey, l_linenumber, l_tax, l_quantity FROM feat"))
def b14(spark, sf):
    features, _ = S.split_features(feat(spark, sf), FEAT_KEYS)
    wanted = [f for f in ("l_tax", "l_quantity") if f in features]
    return S.align(feat(spark, sf), wanted, ["l_orderkey", "l_linenumber"])


@register(
    "b15_dedup_first",
    sql("obs", "SELECT pid, item, ord, raw FROM obs QUALIFY row_number() OVER (PARTITION BY pid, item ORDER BY ord) = 1"),
)
def b15(spark, sf):
    return S.dedup_first(obs(spark, sf).select("pid", "item", "ord", "raw"), ["pid", "item"], ["ord"])


@register("b16_distinct_rows", sql("obs", f"SELECT DISTINCT pid, item, {DAY} FROM obs"))
def b16(spark, sf):
    return _text_day(S.distinct_rows(obs(spark, sf), ["pid", "item", "day"]))


@register(
    "b17_duplicates",
    sql("obs", f"SELECT pid, item, {DAY}, ord FROM obs QUALIFY count(*) OVER (PARTITION BY pid, item, day) > 1"),
)
def b17(spark, sf):
    return _text_day(S.duplicates(obs(spark, sf).select("pid", "item", "day", "ord"), ["pid", "item", "day"]))


@register(
    "b18_slice_where",
    sql("cohort", f"SELECT pid, intid, {DAY}, label, flag FROM cohort WHERE (flag = 0 AND label = 1) OR control = 1"),
)
def b18(spark, sf):
    rows = S.slice_where(cohort(spark, sf), ((F.col("flag") == 0) & (F.col("label") == 1)) | (F.col("control") == 1))
    return _text_day(rows.select("pid", "intid", "day", "label", "flag"))


@register("b19_preview", sql("obs", f"SELECT {OBS_COLS} FROM obs ORDER BY pid, ord LIMIT 20"))
def b19(spark, sf):
    return S.preview(_obs(spark, sf), ["pid", "ord"], 20)


@register("b20_sample_n")
def b20(spark, sf):
    return S.sample_n(feat(spark, sf), FEAT_KEYS, 100, seed=42)


@register(
    "b21_cols_with_null",
    sql("daily", "SELECT feature FROM (SELECT " + ", ".join(f"bool_or({c} IS NULL) AS {c}" for c in ["pid", "intid", *ITEMS])
        + " FROM daily) UNPIVOT (has FOR feature IN (" + ", ".join(["pid", "intid", *ITEMS]) + ")) WHERE has"),
)
def b21(spark, sf):
    names = S.cols_with_null(daily(spark, sf), ["pid", "intid", *ITEMS])
    return spark.createDataFrame([(n,) for n in names], "feature string")


@register("f1_sorted_sink", sql("demo", "SELECT * FROM demo ORDER BY diagnosis, age, pid"))
def f1(spark, sf):
    return topk.sorted_sink(demo(spark, sf), ["diagnosis", "age", "pid"])


@register("f2_top_n", sql("feat", f"SELECT {', '.join(FEAT_KEYS)}, l_extendedprice FROM feat ORDER BY l_extendedprice DESC, {', '.join(FEAT_KEYS)} LIMIT 21"))
def f2(spark, sf):
    return topk.top_n(feat(spark, sf).select(*FEAT_KEYS, "l_extendedprice"), "l_extendedprice", FEAT_KEYS, 21)


@register(
    "f3_rank_features",
    sql("feat", f"SELECT {', '.join(FEAT_KEYS)}, feature, value, row_number() OVER (PARTITION BY {', '.join(FEAT_KEYS)} "
        f"ORDER BY value DESC, feature)::INTEGER AS rank FROM feat UNPIVOT (value FOR feature IN ({', '.join(FEATS)}))"),
)
def f3(spark, sf):
    return topk.rank_features(feat(spark, sf), FEAT_KEYS, FEATS).withColumn("value", F.col("value") + 0.0)


@register(
    "g1_union_named",
    sql("obs_num demo", "SELECT pid, item, num, NULL::DOUBLE AS age FROM obs_num UNION ALL SELECT pid, NULL, NULL, age FROM demo"),
)
def g1(spark, sf):
    return sets.union_named(obs_num(spark, sf).select("pid", "item", "num"), demo(spark, sf).select("age", "pid")).select(
        "pid", "item", "num", "age"
    )


@register(
    "g2_key_overlap",
    "SELECT COALESCE(a.k, b.k) AS key, CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS side "
    "FROM (SELECT DISTINCT user_id AS k FROM events) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) b ON a.k = b.k",
)
def g2(spark, sf):
    users = table(spark, sf, "events").select(F.col("user_id").alias("key"))
    return sets.key_overlap(users, table(spark, sf, "orders").select(F.col("o_custkey").alias("key")), "key")


@register("g3_union_ids", "SELECT user_id AS key FROM events UNION SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer")
def g3(spark, sf):
    named = [("events", "user_id"), ("orders", "o_custkey"), ("customer", "c_custkey")]
    return sets.union_ids("key", *[table(spark, sf, t).select(F.col(c).alias("key")) for t, c in named])
