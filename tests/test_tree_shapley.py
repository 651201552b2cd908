"""Path Shapley values against full enumeration of coalitions."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.models.iforest import Forest, IsolationForest, IsolationForestModel
from wardline.models.tree_shapley import Cuts, Leaf, leaf_boxes, path_shapley

COLS = [f"f{i}" for i in range(6)]


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "row_id bigint, features array<double>")


def enumerate_all(score, x, back):
    d = x.shape[1]
    value = {}
    for size in range(d + 1):
        for inside in combinations(range(d), size):
            mixed = np.repeat(back[None], len(x), axis=0)
            mixed[:, :, list(inside)] = x[:, None, list(inside)]
            value[inside] = score(mixed.reshape(-1, d)).reshape(len(x), -1).mean(axis=1)
    phi = np.zeros_like(x)
    for i in range(d):
        for inside, v in value.items():
            if i not in inside:
                weight = factorial(len(inside)) * factorial(d - len(inside) - 1) / factorial(d)
                phi[:, i] += weight * (value[tuple(sorted((*inside, i)))] - v)
    return value[()], phi


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(90, 6)) * [1, 2, 1, 5, 1, 1], 1)
    x[:, 4] = x[:, 3] > 0
    x[::9] += 3
    rows = frame(spark, x).repartition(3)
    return x, rows, IsolationForest(7, 0.1, 40, seed=3).fit(rows)


@pytest.mark.parametrize("block_patterns", [4_000_000, 300])
def test_equals_full_enumeration(spark, fitted, block_patterns):
    x, rows, model = fitted
    forest = Forest(model.nodes.toPandas())
    score = lambda m: -forest.paths(m, [7])[:, 0] / 7
    base, phi = enumerate_all(score, x[:20], x)
    got = path_shapley(model, rows.filter("row_id < 20"), rows, COLS, block_patterns=block_patterns).orderBy("row_id").collect()
    assert [r["base"] for r in got] == pytest.approx(base[:20].tolist(), abs=1e-12)
    assert np.array([[r[c] for c in COLS] for r in got]) == pytest.approx(phi, abs=1e-12)
    assert np.abs(np.array([r["base"] + sum(r[c] for c in COLS) for r in got]) - score(x[:20])).max() < 1e-9


def test_hidden_missing_and_single_leaf(spark, fitted):
    x, rows, model = fitted
    odd = frame(spark, [[np.nan] * 6, [np.inf] * 6, [-np.inf] * 6])
    got = path_shapley(model, odd, rows, COLS).collect()
    forest = Forest(model.nodes.toPandas())
    want = -forest.paths(np.array([[np.nan] * 6, [np.inf] * 6, [-np.inf] * 6]), [7])[:, 0] / 7
    assert [r["base"] + sum(r[c] for c in COLS) for r in got] == pytest.approx(want.tolist())
    assert path_shapley(model, odd, rows, COLS, hide=["f2"]).columns == ["row_id", "base", "f0", "f1", "f3", "f4", "f5"]
    leaf = IsolationForestModel(model.nodes.limit(1).select(F.lit(0).alias("tree"), F.lit(1).cast("bigint").alias("node"), F.lit(-1).alias("feature"),
                                                             F.lit(0.0).alias("threshold"), F.lit(5).cast("bigint").alias("size")), 1, 5, 0.1, 3, 0.0)
    alone = path_shapley(leaf, rows.limit(2), rows, COLS).collect()
    assert all(r["base"] < 0 and all(r[c] == 0.0 for c in COLS) for r in alone)
    assert path_shapley(model, rows.limit(0), rows, COLS).collect() == []


def test_leaves_of_a_tree_share_its_cuts(fitted):
    x, _, model = fitted
    x = np.vstack([x, [[np.nan] * 6, [np.inf] * 6, [-np.inf] * 6]])
    nodes = model.nodes.filter("tree = 0").toPandas()
    cuts, met = Cuts(x), []
    for node, value, on, low, high in leaf_boxes(nodes):
        leaf = Leaf(0, node, value, np.array(on), np.array(low), np.array(high))
        inside = [[(not b < v) and (a == -np.inf or v > a) for f, a, b in zip(on, low, high) for v in (row[f],)] for row in x]
        assert leaf.patterns(cuts).tolist() == [sum(1 << i for i, m in enumerate(row) if m) for row in inside]
        met.append([all(row) for row in inside])
    assert (np.sum(met, axis=0) == 1).all()  # each row is in one leaf
    split = nodes[nodes["feature"] >= 0]
    assert len(cuts.known) == len(set(zip(split["feature"], split["threshold"])))
