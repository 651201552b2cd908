"""Sorts and top-n."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def sorted_sink(df: DataFrame, order_by: Sequence) -> DataFrame:
    """global order, meant for sinks only."""
    return df.orderBy(*order_by)


def top_n(df: DataFrame, score: str, ids: Sequence[str], n: int) -> DataFrame:
    """F2: n highest scores, ties by id; each task keeps n rows."""
    return df.orderBy(F.col(score).desc_nulls_last(), *ids).limit(n)


def rank_features(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "feature",
                  value: str = "value") -> DataFrame:
    """one row per feature, ranked by value within each id row, largest first.

    The rank is taken inside an array of the row's own features, without a shuffle.
    """
    pairs = F.array(*[F.struct((-F.col(c)).cast("double").alias("neg"), F.lit(c).alias("f")) for c in cols])
    ranked = df.select(*ids, F.posexplode(F.array_sort(pairs)).alias("_p", "_e"))
    return ranked.select(
        *ids, F.col("_e.f").alias(name), (-F.col("_e.neg")).alias(value), (F.col("_p") + 1).alias("rank")
    )
