"""Sampled Shapley attribution, its summary, and deviation from neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from wardline.models.base import FEATURES, ROW_ID, to_vector
from wardline.models.neighbours import knn_join
from wardline.operators.quantiles import exact_quantiles
from wardline.operators.select import sample_n
from wardline.operators.topk import rank_features
from wardline.session import cut_lineage, pin_partitions

CELLS_AT_ONCE = 2_000_000


def _walks(background: DataFrame, n_background: int, n_perm: int, seed: int) -> tuple[np.ndarray, list[tuple]]:
    """The background rows and, for each, its random feature orders and their reverses."""
    sampled = sample_n(background, [ROW_ID], n_background, seed).select(FEATURES).collect()
    back = np.vstack([r[FEATURES] for r in sampled]).astype(float)
    rng = np.random.default_rng(seed)
    orders = [rng.permutation(back.shape[1]) for _ in range(n_perm * len(back))]
    return back, [(back[i % len(back)], o) for i, order in enumerate(orders) for o in (order, order[::-1])]


def shapley(
    score: Callable[[np.ndarray], np.ndarray],
    df: DataFrame,
    background: DataFrame,
    cols: Sequence[str],
    n_background: int = 100,
    n_perm: int = 1,
    seed: int = 42,
    flip: bool = True,
    hide: Sequence[str] = (),
) -> DataFrame:
    """K8: (row_id, base, one column per feature) by permutation sampling (Štrumbelj and Kononenko 2014).

    Every background row is walked through ``n_perm`` random feature orders and their reverses, so
    base + sum of attributions is exactly the score of the row. Rows are independent of each other:
    they stay where they are, and only the bounded background sample travels. ``flip`` turns the
    sign so that larger means stranger; hidden features are left out of the result, not of the sum.
    """
    back, walks = _walks(background, n_background, n_perm, seed)
    d, sign = back.shape[1], -1.0 if flip else 1.0
    base = sign * float(np.mean(score(back)))
    chunk = max(1, CELLS_AT_ONCE // (d * (d + 1)))
    shown = [i for i, c in enumerate(cols) if c not in hide]

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            everything = np.vstack(batch[FEATURES].to_numpy())
            phi = np.zeros_like(everything)
            for start in range(0, len(everything), chunk):
                x = everything[start : start + chunk]
                for b, order in walks:
                    mixed = np.tile(b, (len(x), 1))
                    stages = [mixed.copy()]
                    for f in order:
                        mixed[:, f] = x[:, f]
                        stages.append(mixed.copy())
                    scores = score(np.concatenate(stages)).reshape(d + 1, len(x))
                    phi[start : start + chunk, order] += np.diff(scores, axis=0).T
            phi *= sign / len(walks)
            out = pd.DataFrame({ROW_ID: batch[ROW_ID].to_numpy(), "base": base})
            for i in shown:
                out[cols[i]] = phi[:, i]
            yield out

    schema = f"{ROW_ID} bigint, base double, " + ", ".join(f"`{cols[i]}` double" for i in shown)
    return df.select(ROW_ID, FEATURES).mapInPandas(explain, schema)


def shapley_by_table(
    model,
    df: DataFrame,
    background: DataFrame,
    cols: Sequence[str],
    n_background: int = 100,
    n_perm: int = 1,
    seed: int = 42,
    flip: bool = True,
    hide: Sequence[str] = (),
) -> DataFrame:
    """K8 for models that no task can hold, such as a very large forest or the outlier factor.

    The mixed rows become a table, the model transforms it like any other, and each score counts for
    the feature that was switched on last and against the one that follows. Same result as
    ``shapley`` with the model's decision.
    """
    back, walks = _walks(background, n_background, n_perm, seed)
    d, sign = back.shape[1], -1.0 if flip else 1.0

    def mix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.vstack(batch[FEATURES].to_numpy())
            for b, order in walks:
                mixed = np.tile(b, (len(x), 1))
                for stage in range(d + 1):
                    if stage:
                        mixed[:, order[stage - 1]] = x[:, order[stage - 1]]
                    yield pd.DataFrame({
                        "owner": batch[ROW_ID].to_numpy(), FEATURES: list(mixed.copy()),
                        "plus": int(order[stage - 1]) if stage else -1, "minus": int(order[stage]) if stage < d else -1,
                    })

    rows = df.select(ROW_ID, FEATURES).mapInPandas(mix, f"owner bigint, {FEATURES} array<double>, plus int, minus int")
    rows = pin_partitions(rows).withColumn(ROW_ID, F.monotonically_increasing_id())
    scored = model.transform(cut_lineage(rows)).select("owner", "plus", "minus", "decision")
    weight = sign / len(walks)
    signs = F.array(F.struct(F.col("plus").alias("f"), F.lit(weight).alias("w")), F.struct(F.col("minus").alias("f"), F.lit(-weight).alias("w")))
    parts = scored.select("owner", "decision", "plus", F.explode(signs).alias("_s"))
    sums = [F.sum(F.when(F.col("_s.f") == i, F.col("decision") * F.col("_s.w")).otherwise(0.0)).alias(c)
            for i, c in enumerate(cols) if c not in hide]
    start = F.sum(F.when((F.col("plus") < 0) & (F.col("_s.f") < 0), F.col("decision") * weight).otherwise(0.0))
    return parts.groupBy(F.col("owner").alias(ROW_ID)).agg(start.alias("base"), *sums)


def shapley_summary(phi: DataFrame, cols: Sequence[str]) -> DataFrame:
    """K9: per feature mean absolute attribution and quartiles."""
    long = phi.select(*cols).unpivot([], list(cols), "feature", "v")
    size = long.groupBy("feature").agg(F.avg(F.abs("v")).alias("mean_abs"))
    names = {0.25: "q1", 0.5: "median", 0.75: "q3"}
    spread = exact_quantiles(phi, cols, list(names)).groupBy("feature").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in names.items()])
    return size.join(spread, "feature").orderBy(F.desc("mean_abs"), "feature")


def neighbour_deviation(rows: DataFrame, train: DataFrame, cols: Sequence[str], k: int = 20,
                        exclude_self: bool = False) -> DataFrame:
    """Absolute deviation of each row from the mean of its k nearest train rows, ranked by feature.

    Both tables have ``row_id`` and the feature columns: (row_id, feature, deviation, rank).
    """
    pairs = knn_join(to_vector(rows, cols), to_vector(train, cols), k, exclude_self=exclude_self)
    near = pairs.join(train.select(F.col(ROW_ID).alias("neighbour_id"), *cols), "neighbour_id")
    means = near.groupBy("query_id").agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    joined = rows.join(means.withColumnRenamed("query_id", ROW_ID), ROW_ID)
    gaps = joined.select(ROW_ID, *[F.abs(F.col(c) - F.col(f"_m_{c}")).alias(c) for c in cols])
    return rank_features(gaps, [ROW_ID], cols, "feature", "deviation")
