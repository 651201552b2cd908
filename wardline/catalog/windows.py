"""Queries for the ordered features E1-E14."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog.registry import register, rounded, sql_rounded as r, table
from wardline.catalog.views import ITEMS, KEYS, daily, obs, obs2, sql
from wardline.operators import rank, window as W

DAY = "CAST(day AS VARCHAR) AS day"
ID = f"pid, intid, {DAY}"
WIN = " WINDOW w AS (PARTITION BY pid, intid ORDER BY day)"


def _text_day(df):
    return df.withColumn("day", F.col("day").cast("string"))


def _numbered_days(spark, sf):
    return daily(spark, sf).withColumn("d", F.datediff("day", F.lit("2024-01-01").cast("date")))


DAYS_SQL = "(SELECT *, date_diff('day', DATE '2024-01-01', day) AS d FROM daily)"


@register("e1_sequence", sql("daily", f"SELECT {ID}, row_number() OVER w AS seq FROM daily" + WIN))
def e1(spark, sf):
    return _text_day(W.sequence(daily(spark, sf).select(*KEYS, "day"), KEYS, ["day"], "seq"))


@register(
    "e2_ordinal_suffix",
    sql("obs2", "SELECT ord, slot, item || ' ' || CAST(row_number() OVER (PARTITION BY pid, intid, day, item ORDER BY slot, ord) AS VARCHAR) AS item, value "
        "FROM (SELECT pid, intid, day, ord, item, 1 AS slot, value1 AS value FROM obs2 UNION ALL SELECT pid, intid, day, ord, item, 2, value2 FROM obs2)"),
)
def e2(spark, sf):
    long = obs2(spark, sf).unpivot(["pid", "intid", "day", "ord", "item"], ["value1", "value2"], "slot", "value")
    long = long.withColumn("slot", F.regexp_extract("slot", r"(\d)", 1).cast("int"))
    return W.ordinal_suffix(long, [*KEYS, "day"], "item", ["slot", "ord"]).select("ord", "slot", "item", "value")


@register(
    "e3_rank_first",
    "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rank FROM events",
)
def e3(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", "value")
    return W.rank_first(rows, ["event_type"], ["value", "event_id"]).select("event_id", "rank")


@register(
    "e4_with_row_id",
    "SELECT event_id, row_number() OVER (ORDER BY event_type, user_id, event_id) AS ROW FROM events".replace(" AS ROW", ' AS "ROW"'),
)
def e4(spark, sf):
    rows = table(spark, sf, "events").select("event_type", "user_id", "event_id")
    return rank.with_row_id(rows, ["event_type", "user_id", "event_id"]).select("event_id", "ROW")


@register(
    "e5_fill_both",
    sql("daily", f"SELECT {ID}, " + ", ".join(
        f"COALESCE(last_value({c} IGNORE NULLS) OVER (PARTITION BY pid ORDER BY day, intid ROWS UNBOUNDED PRECEDING), "
        f"first_value({c} IGNORE NULLS) OVER (PARTITION BY pid ORDER BY day, intid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"
        for c in ("click", "view")) + " FROM daily"),
)
def e5(spark, sf):
    return _text_day(W.fill_both(daily(spark, sf).select(*KEYS, "day", "click", "view"), ["pid"], ["day", "intid"], ["click", "view"]))


@register(
    "e6_days_since_start",
    sql("daily", f"SELECT {ID}, CAST(date_diff('day', min(day) OVER (PARTITION BY pid, intid), day) AS INTEGER) AS dsa FROM daily"),
)
def e6(spark, sf):
    return _text_day(W.days_since_start(daily(spark, sf).select(*KEYS, "day"), KEYS, "day", "dsa"))


GAP = "COALESCE(NULLIF(d - lag(d) OVER w, 0), 1)"


@register("e7_day_gap", sql("daily", f"SELECT {ID}, CAST({GAP} AS INTEGER) AS day_gap FROM {DAYS_SQL}" + WIN))
def e7(spark, sf):
    return _text_day(W.day_gap(_numbered_days(spark, sf), KEYS, ["day"], "d").select(*KEYS, "day", "day_gap"))


def _delta_sql(c):
    return f"{r(f'COALESCE(({c} - lag({c}) OVER w) / {GAP}, 0)')} AS {c}_delta_per_day"


def _pct_sql(c):
    last = f"last_value({c} IGNORE NULLS) OVER (PARTITION BY pid, intid ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return (
        f"CASE WHEN {last} = 0 AND {c} IS NOT NULL THEN NULL ELSE {r(f'COALESCE(({c} / NULLIF({last}, 0) - 1) / {GAP}, 0) * 100', 4)} END "
        f"AS {c}_percent_change_per_day"
    )


@register("e8_delta_per_day", sql("daily", f"SELECT {ID}, " + ", ".join(_delta_sql(c) for c in ITEMS) + f" FROM {DAYS_SQL}" + WIN))
def e8(spark, sf):
    out = W.delta_per_day(_numbered_days(spark, sf), KEYS, ["day"], "d", ITEMS)
    return _text_day(out).select(*KEYS, "day", *[rounded(f"{c}_delta_per_day").alias(f"{c}_delta_per_day") for c in ITEMS])


@register("e9_pct_per_day", sql("daily", f"SELECT {ID}, " + ", ".join(_pct_sql(c) for c in ITEMS) + f" FROM {DAYS_SQL}" + WIN))
def e9(spark, sf):
    out = W.pct_per_day(_numbered_days(spark, sf), KEYS, ["day"], "d", ITEMS)
    return _text_day(out).select(
        *KEYS, "day", *[rounded(f"{c}_percent_change_per_day", 4).alias(f"{c}_percent_change_per_day") for c in ITEMS]
    )


@register(
    "e10_change_tables",
    sql("daily", f"SELECT {ID}, " + ", ".join([_delta_sql(c) for c in ITEMS] + [_pct_sql(c) for c in ITEMS]) + f" FROM {DAYS_SQL}" + WIN),
)
def e10(spark, sf):
    out = _text_day(W.change_columns(_numbered_days(spark, sf), KEYS, ["day"], "d", ITEMS))
    return out.select(
        *KEYS, "day", *[rounded(f"{c}_delta_per_day").alias(f"{c}_delta_per_day") for c in ITEMS],
        *[rounded(f"{c}_percent_change_per_day", 4).alias(f"{c}_percent_change_per_day") for c in ITEMS],
    )


@register(
    "e11_lags",
    "SELECT event_id, " + ", ".join(f"lag(value, {j}) OVER w AS value_lag{j}" for j in (1, 2, 3)) + " FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
)
def e11(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return W.lags(rows, ["user_id"], ["ts", "event_id"], ["value"], 3).drop("user_id", "ts", "value")


@register(
    "e12_changes",
    f"SELECT event_id, {r('value - lag(value) OVER w')} AS value_delta, {r('(value / NULLIF(lag(value) OVER w, 0) - 1) * 100', 4)} AS value_percent_change "
    "FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
)
def e12(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    out = W.changes(rows, ["user_id"], ["ts", "event_id"], ["value"])
    return out.select("event_id", rounded("value_delta").alias("value_delta"), rounded("value_percent_change", 4).alias("value_percent_change"))


def _drop_sql(c):
    base = f"first_value({c}) OVER w"
    return f"CASE WHEN {base} <> 0 THEN ({base} - {c}) / {base} * 100 END"


DROPS = "row_number() OVER w AS n, greatest(" + ", ".join(_drop_sql(c) for c in ("purchase", "click", "view")) + ") AS worst"


@register(
    "e13_baseline_drop_label",
    sql("daily", f"SELECT {ID}, CASE WHEN n > 1 AND worst >= 10 THEN 1 ELSE 0 END AS label FROM (SELECT *, {DROPS} FROM daily{WIN})"),
)
def e13(spark, sf):
    days = daily(spark, sf).select(*KEYS, "day", "purchase", "click", "view")
    return _text_day(W.baseline_drop_label(days, KEYS, ["day"], ["purchase", "click", "view"], out="label")).select(*KEYS, "day", "label")


@register(
    "e14_drop_severity",
    sql("daily", f"SELECT {ID}, CASE WHEN n = 1 THEN NULL WHEN worst > 30 THEN 'severe' WHEN worst >= 20 THEN 'moderate' WHEN worst >= 10 THEN 'mild' END AS severity "
        f"FROM (SELECT *, {DROPS} FROM daily{WIN})"),
)
def e14(spark, sf):
    days = W.largest_drop(daily(spark, sf), KEYS, ["day"], ["purchase", "click", "view"], "worst")
    return _text_day(days).select(*KEYS, "day", W.drop_severity("worst").alias("severity"))
