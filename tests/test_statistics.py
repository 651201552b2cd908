"""Quantiles, ranks, tests and factors against plain numpy on skewed data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.models import stats
from wardline.operators import agg, quantiles, rank
from wardline.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.lognormal(1, 1, 3000), 2)
    x[::3] = 2.5
    y = rng.normal(size=3000) + 0.3 * x
    data = [(i, int(i % 2), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id bigint, side int, x double, y double").repartition(8).cache(), x, y


@pytest.mark.parametrize("probs", [[0.5], [0.0, 0.25, 0.75, 1.0], [0.1, 0.9, 0.333]])
def test_quantiles(skewed, probs):
    df, x, y = skewed
    got = {(r["feature"], r["prob"]): r["value"] for r in exact_quantiles(df, ["x", "y"], probs).collect()}
    for name, values in (("x", x), ("y", y)):
        for p in probs:
            assert got[name, p] == pytest.approx(np.quantile(values, p), rel=1e-12)


@pytest.mark.parametrize("few", [3, 200])
def test_quantiles_by_narrowing_passes(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    draws = np.random.default_rng(3)
    hot = [1.0] * 4000 + draws.normal(size=1500).tolist()
    steps = draws.integers(0, 4, 5500).astype(float).tolist()
    rows = [(h, s, None) for h, s in zip(hot, steps)] + [(None, float("nan"), float("nan"))]
    df = spark.createDataFrame(rows, "hot double, steps double, none double").repartition(7)
    probs = [0.0, 0.1, 0.5, 0.999, 1.0]
    got = {(r["feature"], r["prob"]): r["value"] for r in exact_quantiles(df, ["hot", "steps", "none"], probs).collect()}
    assert {f for f, _ in got} == {"hot", "steps"}  # no row for a column without values
    for name, values in (("hot", hot), ("steps", steps)):
        for p in probs:
            assert got[name, p] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_misplaced_bounds_narrow_the_search_too(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 3)
    monkeypatch.setattr(quantiles._Cell, "probs", lambda self: [0.9])
    df = spark.range(2000).select(F.col("id").cast("double").alias("x"))
    monkeypatch.setattr(quantiles, "PASS_ACCURACY", 50)
    assert exact_quantiles(df.limit(60), ["x"], [0.5]).first()["value"] == 29.5


def test_wanted_order_statistics_share_their_rows_and_small_columns_need_no_sketch(skewed, monkeypatch):
    df, x, y = skewed
    monkeypatch.setattr(quantiles.F, "percentile_approx", None)
    spans, make = [], quantiles.F.struct
    monkeypatch.setattr(quantiles.F, "struct", lambda *a: spans.append(a) or make(*a))
    wanted = {"x": [0.1, 0.5, 0.9], "y": [0.333]}
    order = quantiles._order_statistics(df, wanted)
    assert len(spans) == 2
    for c, v in (("x", x), ("y", y)):
        assert [p for p, _ in order[c]] == wanted[c]
        assert [q for _, q in order[c]] == pytest.approx([np.quantile(v, p) for p in wanted[c]], rel=1e-12)


def test_quantiles_by_group_and_tiny_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 7.0), ("b", None)], "g string, x double")
    got = {r["g"]: r["value"] for r in exact_quantiles(df, ["x"], [0.5], ["g"]).collect()}
    assert got == {"a": 1.5, "b": 7.0}


def test_quantiles_of_many_rows(spark):
    df = spark.range(400_000).select((F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0).alias("x"))
    want = np.quantile(np.array([r[0] for r in df.collect()]), [0.01, 0.2, 0.5])
    got = [r["value"] for r in exact_quantiles(df, ["x"], [0.01, 0.2, 0.5]).orderBy("prob").collect()]
    assert got == pytest.approx(list(want), rel=1e-12)


def _ranks(v):
    order = np.sort(v)
    return (np.searchsorted(order, v, "left") + np.searchsorted(order, v, "right") + 1) / 2


def test_average_ranks(skewed):
    df, x, _ = skewed
    long = df.select(F.lit("x").alias("feature"), F.col("x").alias("v"))
    got = {r["v"]: r["rank"] for r in rank.average_ranks(long, ["feature"], "v", levels=4).collect()}
    want = dict(zip(x, _ranks(x)))
    assert got == pytest.approx(want)


def test_spearman(skewed):
    df, x, y = skewed
    got = {(r["x"], r["y"]): r["r"] for r in agg.corr_matrix(df, ["x", "y"], "spearman", ["id"]).collect()}
    assert got["x", "y"] == pytest.approx(np.corrcoef(_ranks(x), _ranks(y))[0, 1])
    assert got["x", "x"] == pytest.approx(1.0)


def test_spearman_keeps_rows_wide(spark, skewed):
    df, x, y = skewed
    df = df.withColumn("z", F.col("y") * 7 + F.col("id") / 1000.0)  # hardly any value twice
    gap = df.select("id", F.lit(None).cast("double").alias("x"), "y", "z").limit(1).withColumn("id", F.lit(-1).cast("bigint"))
    df = df.select("id", "x", "y", "z").unionByName(gap)  # a row with a null takes no part
    z = np.array([r["z"] for r in df.filter("id >= 0").orderBy("id").collect()])
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for size in (least, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
        try:
            out = agg.corr_matrix(df, ["x", "y", "z"], "spearman", ["id"])
            assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
            got = {(r["x"], r["y"]): r["r"] for r in out.collect()}
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
        for (a, v), (b, w) in ((p, q) for p in (("x", x), ("y", y), ("z", z)) for q in (("x", x), ("y", y), ("z", z))):
            assert got[a, b] == pytest.approx(np.corrcoef(_ranks(v), _ranks(w))[0, 1])


def test_mann_whitney(skewed):
    df, x, _ = skewed
    r = stats.mann_whitney(df.filter("side = 0"), df.filter("side = 1"), ["x"]).first()
    a, b = x[0::2], x[1::2]
    u = sum((b < v).sum() + 0.5 * (b == v).sum() for v in a)
    assert r["u"] == pytest.approx(u)
    assert 0 <= r["p"] <= 1
    assert r["median_a"] == np.median(a) and r["median_b"] == np.median(b)


def test_mann_whitney_p_of_shifted_samples(spark):
    a = spark.range(200).select(F.col("id").cast("double").alias("x"))
    assert stats.mann_whitney(a, a.withColumn("x", F.col("x") + 150), ["x"]).first()["p"] < 1e-10
    assert stats.mann_whitney(a, a, ["x"]).first()["p"] == pytest.approx(1.0, abs=0.01)


def test_factor_invariants(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(500, 2))
    x = base @ rng.normal(size=(2, 5)) + 0.3 * rng.normal(size=(500, 5))
    cols = list("abcde")
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in cols))
    eigen = [r["eigenvalue"] for r in stats.scree(df, cols).orderBy("factor").collect()]
    assert sum(eigen) == pytest.approx(5.0) and eigen == sorted(eigen, reverse=True)
    plain, turned = stats.FactorModel(cols, 2).fit(df), stats.FactorModel(cols, 2, "varimax").fit(df)
    assert (turned.loads**2).sum(axis=1) == pytest.approx((plain.loads**2).sum(axis=1))
    assert (plain.loads**2).sum(axis=0) == pytest.approx(eigen[:2])
    full = stats.FactorModel(cols, 5).fit(df)
    assert full.loads @ full.loads.T == pytest.approx(np.corrcoef(x.T))
    oblique = stats.FactorModel(cols, 2, "promax").fit(df).loads
    simple = lambda m: (np.sort(np.abs(m), axis=1)[:, 0]).sum()
    assert simple(oblique) <= simple(plain.loads)
    scores = plain.transform(df).agg(F.avg("factor_1"), F.stddev_samp("factor_1"), F.corr("factor_1", "factor_2")).first()
    assert scores[0] == pytest.approx(0, abs=1e-9) and scores[1] == pytest.approx(1) and scores[2] == pytest.approx(0, abs=1e-9)


GOLDEN = [
    ("raw forest", 25, 107, 3, 138, 0.1894, 0.8929, 0.5971, 0.5123),
    ("delta svm", 25, 80, 3, 165, 0.2381, 0.8929, 0.6960, 0.5760),
    ("percent forest", 22, 82, 6, 163, 0.2115, 0.7857, 0.6777, 0.5093),
    ("raw lof", 23, 103, 5, 142, 0.1825, 0.8214, 0.6044, 0.4832),
]


def test_published_metrics(spark):
    rows = []
    for name, tp, fp, fn, tn, *_ in GOLDEN:
        rows += [(name, 1, 1)] * tp + [(name, 0, 1)] * fp + [(name, 1, 0)] * fn + [(name, 0, 0)] * tn
    df = spark.createDataFrame(rows, "run string, y int, p int")
    got = {r["run"]: r for r in agg.classification_metrics(df, "y", "p", ["run"]).collect()}
    for name, *_, precision, recall, accuracy, f2 in GOLDEN:
        r = got[name]
        assert [round(r[c], 4) for c in ("precision", "recall", "accuracy", "fbeta")] == [precision, recall, accuracy, f2]


def test_metrics_without_positives(spark):
    r = agg.classification_metrics(spark.createDataFrame([(0, 0)], "y int, p int"), "y", "p").first()
    assert (r["precision"], r["recall"], r["fbeta"], r["accuracy"]) == (0.0, 0.0, 0.0, 1.0)


def test_first_of_equal_scores_wins_and_no_winner_at_zero(spark):
    df = spark.createDataFrame([("a", 1, 0.5, "x"), ("a", 0, 0.5, "y"), ("b", 0, 0.0, "z")], "c string, ord int, s double, m string")
    best = agg.arg_best(df, ["c"], "s", "ord", above=0.0).collect()
    assert [(r["c"], r["m"]) for r in best] == [("a", "y")]


def test_density_integrates_to_one(spark):
    df = spark.range(500).select((F.pmod(F.xxhash64("id"), F.lit(1000)) / 10.0).alias("x"))
    g = agg.density_grid(df, "x", 200).orderBy("i").collect()
    assert sum(r["density"] for r in g) * (g[1]["x"] - g[0]["x"]) == pytest.approx(1.0, abs=0.01)


def test_density_equals_the_direct_sum(spark):
    """Binned moments against the sum over all values, with a far outlier and repeated values."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=700), np.repeat(0.25, 200), [60.0]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    got = agg.density_grid(df, "x", 120, transform="none").orderBy("i").toPandas()
    width = x.std(ddof=1) * len(x) ** -0.2
    direct = np.exp(-0.5 * ((got["x"].to_numpy()[:, None] - x[None, :]) / width) ** 2).sum(axis=1) / (len(x) * width * np.sqrt(2 * np.pi))
    assert len(got) == 120 and np.abs(got["density"] - direct).max() < 1e-13 / width
