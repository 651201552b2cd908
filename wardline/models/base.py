"""Shared parts of the detectors: feature vectors, thresholds, saving."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.operators.quantiles import exact_quantiles

FEATURES, ROW_ID = "features", "row_id"


def to_vector(df: DataFrame, cols: Sequence[str], out: str = FEATURES) -> DataFrame:
    """Feature columns as one array of doubles."""
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in cols]))


def score_quantile(scores: DataFrame, col: str, prob: float) -> float:
    """Exact quantile of a score column."""
    return float(exact_quantiles(scores, [col], [prob]).first()["value"])


def flag(scored: DataFrame, offset: float) -> DataFrame:
    """K4: ``score`` (lower is stranger), ``decision`` = score - offset, ``is_anomaly`` = decision < 0."""
    decision = F.col("score") - F.lit(float(offset))
    return scored.withColumn("decision", decision).withColumn("is_anomaly", (decision < 0).cast("int"))


def save_params(spark: SparkSession, path: str, kind: str, params: dict) -> None:
    """One-row table with the model kind and its parameters as JSON."""
    row = spark.createDataFrame([(kind, json.dumps(params))], "kind string, params string")
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/params")


def load_params(spark: SparkSession, path: str) -> tuple[str, dict]:
    row = spark.read.parquet(f"{path}/params").first()
    return row["kind"], json.loads(row["params"])


def load_model(spark: SparkSession, path: str):
    """A10: any saved detector, by the kind written with it."""
    from wardline.models.iforest import IsolationForestModel
    from wardline.models.lof import LofModel
    from wardline.models.ocsvm import OneClassSvmModel

    kind, params = load_params(spark, path)
    models = {m.KIND: m for m in (IsolationForestModel, OneClassSvmModel, LofModel)}
    return models[kind].load(spark, path, params)
