"""Value cleaning and the choices where source behaviour was worth a parameter."""

import pytest
from pyspark.sql import functions as F

from wardline import functions as W
from wardline.operators import reshape as R, select as S, window

TEXTS = ["<8", "<0.5", "<x", "NEG", "é", "6,5", "6.5", "1d", "NaN", " 7 ", "", None, "-3", "1e2"]


def test_censored_modes(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    rows = df.select(W.clean_censored("t").alias("a"), W.clean_censored("t", "int_minus_one").alias("b"), W.is_censored("t").alias("c")).collect()
    assert [r["a"] for r in rows] == [8.0, 0.5, None, None, None, None, 6.5, None, None, 7.0, None, None, -3.0, 100.0]
    assert [r["b"] for r in rows] == [7.0, None, None, None, None, None, 6.5, None, None, 7.0, None, None, -3.0, 100.0]
    assert [r["c"] for r in rows] == [1, 1, 1] + [0] * 11


def test_strict_int_raises(spark):
    df = spark.createDataFrame([("x",)], "t string").select(W.strict_int("t"))
    with pytest.raises(Exception):
        df.collect()


def test_inequality_keeps_missing(spark):
    df = spark.createDataFrame([("Man",), ("Vrouw",), (None,)], "s string")
    assert S.where_not(df, "s", "Man").count() == 2


def test_drop_ids_keeps_missing_id(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "i int")
    assert sorted(r[0] or 0 for r in S.drop_ids(df, [1], "i").collect()) == [0, 2]
    assert S.drop_ids(df, spark.createDataFrame([(1,)], "i int"), "i").count() == 2


@pytest.mark.parametrize("policy,n", [("drop", 1), ("null", 2), ("replace", 2)])
def test_invalid_dates(spark, policy, n):
    df = spark.createDataFrame([("2021-01-02",), ("31-31-1670",)], "t string").withColumn("d", W.to_day(W.parse_ts("t", ["yyyy-MM-dd"])))
    out = S.invalid_dates(df, "d", policy, "2021-10-17")
    assert out.count() == n
    if policy == "replace":
        assert str(out.agg(F.max("d")).first()[0]) == "2021-10-17"


def test_parse_day_first(spark):
    df = spark.createDataFrame([("03-02-2021",), ("2021-02-03 10:00:00",), ("bad",)], "t string")
    out = df.select(W.to_day(W.parse_ts("t", ["dd-MM-yyyy", "yyyy-MM-dd HH:mm:ss"]))).collect()
    assert [str(r[0]) for r in out] == ["2021-02-03", "2021-02-03", "None"]


def test_two_measurements_of_one_item(spark):
    """Slot labels keep a second measurement apart from the second slot; ordinals do not."""
    df = spark.createDataFrame([(1, 1, "BMI", 170.0, 50.0), (1, 2, "BMI", 171.0, 51.0)], "p int, ord int, item string, v1 double, v2 double")
    long = R.melt(df, ["p", "ord", "item"], ["v1", "v2"], "slot", "value")
    by_slot = R.pivot_first(long.withColumn("item", W.slot_label("item", "slot")), ["p"], "item", "value", ["BMI 1", "BMI 2"], ["ord"])
    assert tuple(by_slot.first())[1:] == (170.0, 50.0)
    numbered = window.ordinal_suffix(long, ["p"], "item", ["slot", "ord"])
    by_order = R.pivot_first(numbered, ["p"], "item", "value", ["BMI 1", "BMI 2"], ["ord"])
    assert tuple(by_order.first())[1:] == (170.0, 171.0)


def test_first_ignores_nulls_and_missing_keys(spark):
    df = spark.createDataFrame([(1, 2, 5.0), (1, 1, None), (1, 3, 6.0), (None, 1, 9.0)], "p int, o int, x double")
    assert [tuple(r) for r in R.first_non_null(df, ["p"], ["x"], ["o"]).collect()] == [(1, 5.0)]


def test_horizon_is_inclusive(spark):
    df = spark.createDataFrame([(1, "2021-01-01"), (1, "2021-03-26"), (1, "2021-03-27")], "p int, t string").withColumn("d", F.to_date("t"))
    assert S.within_horizon(df, ["p"], "d", 84).count() == 2


def test_constant_features_and_single_row(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert S.non_constant(df, ["a", "b"]) == ["b"]
    assert S.non_constant(df.limit(1), ["a", "b"]) == []


def test_sample_does_not_depend_on_partitioning(spark):
    df = spark.range(1000)
    a = {r[0] for r in S.sample_n(df.repartition(1), ["id"], 50, 3).collect()}
    assert a == {r[0] for r in S.sample_n(df.repartition(8), ["id"], 50, 3).collect()} and len(a) == 50


def test_sample_with_known_total_is_the_same(spark):
    df = spark.range(20_000)
    for n in (1, 50, 19_999, 30_000):
        a = {r[0] for r in S.sample_n(df, ["id"], n, 3).collect()}
        assert a == {r[0] for r in S.sample_n(df, ["id"], n, 3, total=20_000).collect()} and len(a) == min(n, 20_000)


def test_missing_feature_is_an_error(spark):
    with pytest.raises(ValueError):
        S.align(spark.range(1), ["x"])


def test_file_safe_id(spark):
    text = "Isolation Forest (n_estimators=50, contamination=0.2, max_samples=0.5)"
    got = spark.createDataFrame([(text,)], "t string").select(W.file_safe("t")).first()[0]
    assert got == "Isolation_Forest_n_estimators-50_contamination-0.2_max_samples-0.5"


def test_censored_text_is_read_to_its_end(spark):
    text = "<" + "0" * 1_200_000 + "5"
    row = spark.createDataFrame([(text,)], "v string").select(W.clean_censored("v").alias("n")).first()
    assert row["n"] == 5.0
