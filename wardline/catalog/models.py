"""Queries for imputation I1-I5 and statistics J1-J5."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog.registry import register, rounded, sql_rounded as r, table
from wardline.catalog.views import FEATS, FEAT_KEYS, ITEMS, KEYS, daily, demo, feat, sql
from wardline.models import impute, stats

DAY = "CAST(day AS VARCHAR) AS day"


def keyed_days(spark, sf):
    """Patient-days with a numeric row id."""
    number = F.col("pid") * 100_000 + F.datediff("day", F.lit("2000-01-01").cast("date"))
    return daily(spark, sf).withColumn("row_id", number).drop("day")


@register(
    "i1_mean_impute",
    sql("daily", f"SELECT pid, intid, {DAY}, " + ", ".join(f"{r(f'COALESCE({c}, (SELECT avg({c}) FROM daily))')} AS {c}" for c in ITEMS) + " FROM daily"),
)
def i1(spark, sf):
    days = daily(spark, sf)
    filled = impute.MeanImputer(ITEMS).fit(days).transform(days)
    return filled.select(*KEYS, F.col("day").cast("string").alias("day"), *[rounded(c).alias(c) for c in ITEMS])


@register(
    "i2_mode_impute",
    sql("demo", "SELECT pid, COALESCE(age, (SELECT age FROM demo WHERE age IS NOT NULL GROUP BY age ORDER BY count(*) DESC, age LIMIT 1)) AS age, "
        "COALESCE(sex, (SELECT sex FROM demo WHERE sex IS NOT NULL GROUP BY sex ORDER BY count(*) DESC, sex LIMIT 1)) AS sex FROM demo"),
)
def i2(spark, sf):
    rows = demo(spark, sf)
    return impute.ModeImputer(["age", "sex"]).fit(rows).transform(rows).select("pid", "age", "sex")


@register("i3_chained_impute")
def i3(spark, sf):
    return impute.ChainedImputer(ITEMS, rounds=20, datasets=3).fit_transform(keyed_days(spark, sf), "row_id")


@register("i4_chained_impute_grouped")
def i4(spark, sf):
    return impute.ChainedImputer(ITEMS, rounds=20, group_cols=["pid"]).fit_transform(keyed_days(spark, sf), "row_id")


@register("i5_missingness_model")
def i5(spark, sf):
    out = impute.missingness_model(keyed_days(spark, sf), "click", ["purchase", "view", "error"])
    return out.withColumn("coefficient", rounded("coefficient"))


@register(
    "j1_robust_scale",
    sql("feat", f"SELECT {', '.join(FEAT_KEYS)}, " + ", ".join(
        f"{r(f'({c} - (SELECT median({c}) FROM feat)) / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM feat)')} AS {c}" for c in FEATS) + " FROM feat"),
)
def j1(spark, sf):
    rows = feat(spark, sf)
    scaled = stats.RobustScaler(FEATS).fit(rows).transform(rows)
    return scaled.select(*FEAT_KEYS, *[rounded(c).alias(c) for c in FEATS])


def _u_sql(c):
    return (
        f"SELECT '{c}' AS feature, (SELECT sum(rk) FILTER (WHERE side = 1) - count(*) FILTER (WHERE side = 1) * (count(*) FILTER (WHERE side = 1) + 1) / 2 "
        f"FROM (SELECT side, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk FROM "
        f"(SELECT CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS side, {c} AS v FROM lineitem))) AS u, "
        f"(SELECT median({c}) FROM lineitem WHERE l_returnflag = 'N') AS median_a, (SELECT median({c}) FROM lineitem WHERE l_returnflag <> 'N') AS median_b"
    )


def _samples(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", *FEATS)
    return rows.filter("l_returnflag = 'N'"), rows.filter("l_returnflag <> 'N'")


@register("j2_mann_whitney", " UNION ALL ".join(f"SELECT feature, {r('u', 2)} AS u, {r('median_a')} AS median_a, {r('median_b')} AS median_b FROM ({_u_sql(c)})" for c in FEATS))
def j2(spark, sf):
    out = stats.mann_whitney(*_samples(spark, sf), FEATS)
    return out.select("feature", rounded("u", 2).alias("u"), rounded("median_a").alias("median_a"), rounded("median_b").alias("median_b"))


@register("j2_mann_whitney_p")
def j2p(spark, sf):
    return stats.mann_whitney(*_samples(spark, sf), FEATS).select("feature", rounded("p").alias("p"))


@register("j3_scree")
def j3(spark, sf):
    return stats.scree(feat(spark, sf), FEATS).withColumn("eigenvalue", rounded("eigenvalue"))


@register("j4_factor_variance")
def j4(spark, sf):
    return stats.FactorModel(FEATS, 4).fit(feat(spark, sf)).variance


PAIR = ["l_quantity", "l_extendedprice"]
PAIR_R = "abs(corr(l_quantity, l_extendedprice))"


@register(
    "j3_scree_of_two",
    f"SELECT 1 AS factor, {r(f'1 + {PAIR_R}')} AS eigenvalue FROM lineitem UNION ALL SELECT 2, {r(f'1 - {PAIR_R}')} FROM lineitem",
)
def j3two(spark, sf):
    return stats.scree(feat(spark, sf), PAIR).withColumn("eigenvalue", rounded("eigenvalue"))


@register(
    "j4_factor_variance_of_two",
    f"SELECT 1 AS factor, {r(f'1 + {PAIR_R}')} AS ss_loadings, {r(f'(1 + {PAIR_R}) / 2')} AS proportion, {r(f'(1 + {PAIR_R}) / 2')} AS cumulative FROM lineitem",
)
def j4two(spark, sf):
    out = stats.FactorModel(PAIR, 1).fit(feat(spark, sf)).variance
    return out.select("factor", *[rounded(c).alias(c) for c in ("ss_loadings", "proportion", "cumulative")])


@register("j5_factor_rotation")
def j5(spark, sf):
    rows = feat(spark, sf)
    parts = [
        stats.FactorModel(FEATS, 2, rotation).fit(rows).loadings.withColumn("rotation", F.lit(rotation or "none"))
        for rotation in (None, "varimax", "promax")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("j5_factor_scores")
def j5s(spark, sf):
    rows = feat(spark, sf)
    return stats.FactorModel(FEATS, 2, "varimax").fit(rows).transform(rows).select(*FEAT_KEYS, "factor_1", "factor_2")
