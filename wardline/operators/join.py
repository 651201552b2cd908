"""Equi-joins. Build sides are left to Spark's own size check; nothing is force-broadcast."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wardline.operators.rank import with_row_id
from wardline.operators.select import dedup_first


def semi(df: DataFrame, other: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Rows with a partner."""
    on = [on] if isinstance(on, str) else list(on)
    return df.join(other.select(*on), on, "left_semi")


def anti(df: DataFrame, other: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Rows without a partner."""
    on = [on] if isinstance(on, str) else list(on)
    return df.join(other.select(*on), on, "left_anti")


def left_keep(df: DataFrame, other: DataFrame, on: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Left join; of the right side only ``cols`` arrive, so colliding names stay left."""
    return df.join(other.select(*on, *cols), list(on), "left")


def lookup(df: DataFrame, dim: DataFrame, on: str, cols: Sequence[str]) -> DataFrame:
    """C4: key lookup, fans out where the dimension repeats a key."""
    return df.join(dim.select(on, *cols), on, "left")


def with_baseline(
    df: DataFrame,
    base: DataFrame,
    keys: Sequence[str],
    seq: str,
    col: str,
    out: str = "baseline",
    at: int = 1,
    order_by: Sequence | None = None,
) -> DataFrame:
    """Value of ``col`` at sequence ``at`` of the same key, one join for all rows."""
    first = base.filter(F.col(seq) == at)
    first = dedup_first(first, keys, order_by or [F.col(col).asc_nulls_last()])
    return df.join(first.select(*keys, F.col(col).alias(out)), list(keys), "left")


def fill_ids(df: DataFrame, col: str, used: DataFrame, order_by: Sequence, seed: int = 0) -> DataFrame:
    """Surrogate ids for null ids.

    New ids have the typical (median) digit count of the used ones, or the next count with enough
    free ids, and collide neither with those, with the ids present in ``df``, nor with each other. Candidates are the values of a seeded
    affine permutation of the id range; free ones are numbered and matched with the null rows by
    number, so both sides are plain distributed joins.
    """
    from wardline.operators.quantiles import exact_quantiles

    spark = df.sparkSession
    taken = used.select(F.col(col)).union(df.select(F.col(col))).filter(F.col(col).isNotNull()).distinct()
    lengths = used.filter(F.col(col).isNotNull()).select(F.length(F.col(col).cast("string")).alias("len"))
    digits = int(exact_quantiles(lengths, ["len"], [0.5]).first()["value"])
    holes = with_row_id(df.filter(F.col(col).isNull()), order_by, "_no")
    need = holes.count()
    if not need:
        return df
    while True:
        low, size = 10 ** (digits - 1), 9 * 10 ** (digits - 1)
        blocked = taken.filter(F.col(col).between(low, low + size - 1)).count()
        if need + blocked <= size:
            break
        digits += 1
    step = 48_271 + 2 * seed
    while math.gcd(step, size) != 1:
        step += 1
    shift = (seed * 7_919 + 12_345) % size
    fresh = (
        spark.range(need + blocked)
        .select(((F.col("id") * F.lit(step) + F.lit(shift)) % F.lit(size) + F.lit(low)).alias(col), "id")
        .join(taken, col, "left_anti")
    )
    fresh = with_row_id(fresh, ["id"], "_no").drop("id")
    filled = holes.drop(col).join(fresh, "_no").select(*df.columns)
    return df.filter(F.col(col).isNotNull()).unionByName(filled)
