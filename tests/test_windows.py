"""Segmented windows equal plain ones, with one key holding a third of all rows."""

import pytest
from pyspark.sql import Window, functions as F

from wardline.operators import agg, rank, window as W

ORDER = ["ts", "event_id"]


@pytest.fixture(scope="module")
def rows(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").drop("props")
    hot = F.when(F.col("event_id") % 3 == 0, F.lit(1)).otherwise(F.col("user_id"))
    gaps = F.when(F.col("event_id") % 4 != 1, F.col("value"))
    return events.withColumn("user_id", hot).withColumn("gappy", gaps).withColumn("n", F.dayofmonth("ts")).cache()


@pytest.fixture(params=[50_000, 60], ids=["whole", "cut"], autouse=True)
def segment_rows(request, monkeypatch):
    """Every test runs with plain windows and with groups cut into many segments."""
    monkeypatch.setattr(W, "SEGMENT_ROWS", request.param)


def same(a, b):
    a, b = a.select(sorted(a.columns)), b.select(sorted(b.columns))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def plain():
    return Window.partitionBy("user_id").orderBy(*ORDER)


@pytest.mark.parametrize("segment", ["default", "one", "minutes"])
def test_sequence(rows, segment):
    cuts = {"default": None, "one": F.lit(0).cast("bigint"), "minutes": F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 600)}
    got = W.sequence(rows, ["user_id"], ORDER, "seq", cuts[segment])
    assert same(got, rows.withColumn("seq", F.row_number().over(plain()).cast("bigint")))


@pytest.mark.parametrize("k", [1, 3])
def test_lags(rows, k):
    got = W.lags(rows, ["user_id"], ORDER, ["gappy"], k)
    want = rows.select("*", *[F.lag("gappy", j).over(plain()).alias(f"gappy_lag{j}") for j in range(1, k + 1)])
    assert same(got, want)


def test_fill_both(rows):
    got = W.fill_both(rows, ["user_id"], ORDER, ["gappy"])
    onward = plain().rowsBetween(0, Window.unboundedFollowing)
    want = rows.withColumn("gappy", F.coalesce(F.last("gappy", True).over(plain()), F.first("gappy", True).over(onward)))
    assert same(got, want)


def test_last_known(rows):
    got = W.last_known(rows, ["user_id"], ORDER, ["gappy"])
    before = plain().rowsBetween(Window.unboundedPreceding, -1)
    assert same(got, rows.withColumn("gappy_prev", F.last("gappy", True).over(before)))


def test_rows_of_one_second_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(W, "SEGMENT_ROWS", 8_000)
    df = spark.range(100_000).select(F.lit(1).alias("p"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"),
                                     (F.xxhash64("id") % 1_000_003).alias("x"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = W.last_known(W.sequence(df, ["p"], ["ts", "x", "id"], "n"), ["p"], ["ts", "x", "id"], ["id"])
        per_task = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(per_task) > 2 and max(per_task) < 70_000
    cuts = W.segment_cuts(df, ["p"], ["ts", "x", "id"]).first()["_cuts"]
    assert 6 < len(cuts) < 25
    w = Window.partitionBy("p").orderBy("ts", "x", "id")
    assert same(got, df.select("*", F.row_number().over(w).cast("bigint").alias("n"), F.lag("id").over(w).alias("id_prev")))


def test_null_keys_and_null_orders_carry(spark, monkeypatch):
    monkeypatch.setattr(W, "SEGMENT_ROWS", 40)
    key = F.when(F.col("id") % 3 > 0, F.lit(None)).otherwise(F.col("id") % 2)
    df = spark.range(600).select(key.alias("p"), F.when(F.col("id") > 90, F.col("id") % 97).alias("o"), "id",
                                 F.when(F.col("id") % 50 == 7, F.col("id")).alias("x"))
    w = Window.partitionBy("p").orderBy("o", "id")
    assert W.segment_cuts(df, ["p"], ["o", "id"]).filter("p IS NULL").first()["_cuts"]
    assert same(W.last_known(df, ["p"], ["o", "id"], ["x"]), df.withColumn("x_prev", F.last("x", True).over(w.rowsBetween(Window.unboundedPreceding, -1))))
    assert same(W.lags(df, ["p"], ["o", "id"], ["id"], 2), df.select("*", F.lag("id").over(w).alias("id_lag1"), F.lag("id", 2).over(w).alias("id_lag2")))
    filled = W.fill_both(df, ["p"], ["o", "id"], ["x"])
    onward = F.first("x", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    assert same(filled, df.withColumn("x", F.coalesce(F.last("x", True).over(w), onward)))


def test_row_id_is_dense_and_ordered(spark, rows):
    got = rank.with_row_id(rows, ["user_id", "event_id"])
    want = rows.withColumn("ROW", F.row_number().over(Window.orderBy("user_id", "event_id")).cast("bigint"))
    assert same(got, want)


def test_long_lists_continue_in_parts(rows):
    got = agg.list_by(rows, ["user_id"], "event_id", F.col("value") > 0, part_rows=50)
    assert got.agg(F.max(F.size("items"))).first()[0] == 50
    assert got.select(F.explode("items")).count() == rows.count()
    first = got.filter("user_id = 1 and part = 0").first()["items"]
    second = got.filter("user_id = 1 and part = 1").first()["items"]
    assert max(first) < min(second)


@pytest.mark.parametrize("on_zero,expected", [("null", None), ("inf", float("inf"))])
def test_change_from_zero(spark, on_zero, expected):
    df = spark.createDataFrame([(1, 0, 0.0), (1, 2, 4.0), (1, 2, None), (1, 3, 2.0)], "p int, d int, x double").withColumn(
        "o", F.monotonically_increasing_id())
    got = W.change_columns(df, ["p"], ["d", "o"], "d", ["x"], on_zero).orderBy("d", "o").collect()
    assert [r["x_delta_per_day"] for r in got] == [0.0, 2.0, 0.0, 0.0]
    pct = [r["x_percent_change_per_day"] for r in got]
    assert pct[0] == 0.0 and pct[1] == expected and pct[2] == 0.0 and pct[3] == -50.0


def test_zero_over_zero_is_no_change_in_compat(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.0)], "p int, d int, x double")
    got = W.change_columns(df, ["p"], ["d"], "d", ["x"], "inf").orderBy("d").collect()
    assert [r["x_percent_change_per_day"] for r in got] == [0.0, 0.0]


def test_baseline_label_single_row_and_zero_base(spark):
    df = spark.createDataFrame(
        [(1, 1, 10.0), (1, 2, 9.0), (1, 3, 9.1), (2, 1, 5.0), (3, 1, 0.0), (3, 2, -5.0), (4, 1, None), (4, 2, 1.0)],
        "p int, d int, x double")
    got = {(r["p"], r["d"]): r["RFS"] for r in W.baseline_drop_label(df, ["p"], ["d"], ["x"]).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 0, (2, 1): 0, (3, 1): 0, (3, 2): 0, (4, 1): 0, (4, 2): 0}


def test_severity_bands(spark):
    df = spark.createDataFrame([(v,) for v in (9.9, 10.0, 19.9, 20.0, 30.0, 30.1)], "d double")
    assert [r[0] for r in df.select(W.drop_severity("d")).collect()] == [None, "mild", "mild", "moderate", "moderate", "severe"]
