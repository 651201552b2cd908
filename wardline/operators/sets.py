"""Set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def union_named(*frames: DataFrame) -> DataFrame:
    """G1: all rows, columns aligned by name, absent ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Every distinct key with its side: ``both``, ``left`` or ``right``."""
    tagged = a.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).union(
        b.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    sides = tagged.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    side = F.when((F.col("l") == 1) & (F.col("r") == 1), "both").when(F.col("l") == 1, "left").otherwise("right")
    return sides.select(key, side.alias("side"))


def union_ids(key: str, *frames: DataFrame) -> DataFrame:
    """Distinct non-null ids of several tables."""
    return union_named(*[f.select(key) for f in frames]).filter(F.col(key).isNotNull()).distinct()
