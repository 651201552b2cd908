"""Projections, filters and predicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def keep_items(df: DataFrame, col: str, items: Sequence) -> DataFrame:
    """B1: rows whose item is listed."""
    return df.filter(F.col(col).isin(*items))


def keep_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """B2: rows whose id is in the id table."""
    return df.join(ids.select(on), on, "left_semi")


def where_eq(df: DataFrame, col: str, value) -> DataFrame:
    """Equality filter."""
    return df.filter(F.col(col) == F.lit(value))


def where_not(df: DataFrame, col: str, value) -> DataFrame:
    """Inequality that keeps nulls."""
    return df.filter(~F.col(col).eqNullSafe(F.lit(value)))


def drop_ids(df: DataFrame, ids: DataFrame | Sequence, on: str) -> DataFrame:
    """Rows whose id is not listed; rows without an id stay."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(on), on, "left_anti")
    return df.filter(~F.coalesce(F.col(on).isin(*ids), F.lit(False)))


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename columns."""
    return df.withColumnsRenamed(dict(mapping))


def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Select and order columns."""
    return df.select(*cols)


def move_after(df: DataFrame, col: str, after: str) -> DataFrame:
    """Move one column behind another; to the end if the other is absent."""
    names = [c for c in df.columns if c != col]
    at = names.index(after) + 1 if after in names else len(names)
    return df.select(*names[:at], col, *names[at:])


def drop_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows with a null in a listed column."""
    return df.dropna(subset=list(cols))


def invalid_dates(df: DataFrame, col: str, policy: str = "drop", value=None) -> DataFrame:
    """What to do with rows whose date could not be parsed."""
    if policy == "drop":
        return df.filter(F.col(col).isNotNull())
    if policy == "replace":
        return df.withColumn(col, F.coalesce(F.col(col), F.lit(value).cast(df.schema[col].dataType)))
    if policy == "null":
        return df
    raise ValueError(f"unknown policy {policy!r}")


def min_group_rows(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Groups with at least n rows.

    Counts are combined before the shuffle and joined back, so no group is gathered in one task.
    """
    keys = list(keys)
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n)
    return df.join(large.select(*keys), keys, "left_semi")


def within_horizon(df: DataFrame, keys: Sequence[str], date: str, days: int = 84) -> DataFrame:
    """Rows at most ``days`` after the first date of their group."""
    keys = list(keys)
    start = df.groupBy(*keys).agg(F.min(date).alias("_start"))
    return (
        df.join(start, keys)
        .filter(F.datediff(F.col(date), F.col("_start")) <= days)
        .select(*df.columns)
    )


def replace_where(df: DataFrame, col: str, cond: Column, value) -> DataFrame:
    """Point correction."""
    return df.withColumn(col, F.when(cond, F.lit(value)).otherwise(F.col(col)))


def non_constant(df: DataFrame, cols: Sequence[str], eps: float = 1e-8) -> list[str]:
    """Columns whose sample deviation exceeds eps, from one aggregate row."""
    row = df.agg(*[F.stddev_samp(c).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] is not None and row[c] > eps]


def drop_constant(fit_df: DataFrame, df: DataFrame, cols: Sequence[str], eps: float = 1e-8) -> DataFrame:
    """Project ``df`` to its columns outside ``cols`` and the varying ones among ``cols``."""
    keep = set(non_constant(fit_df, cols, eps))
    return df.select(*[c for c in df.columns if c not in cols or c in keep])


def split_features(df: DataFrame, exclude: Sequence[str]) -> tuple[list[str], list[str]]:
    """(feature columns, meta columns) by an exclusion list."""
    return [c for c in df.columns if c not in exclude], [c for c in df.columns if c in exclude]


def align(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the features a model was fitted on; a missing one is an error."""
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    return df.select(*keep, *features)


def dedup_first(df: DataFrame, keys: Sequence[str], order_by: Sequence) -> DataFrame:
    """First row per key under a total order.

    The rank filter reaches below the shuffle, so each map task sends one row per key.
    """
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def distinct_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct over columns."""
    return df.select(*cols).distinct()


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every member of a key that occurs more than once."""
    return min_group_rows(df, keys, 2)


def slice_where(df: DataFrame, cond: Column | str) -> DataFrame:
    """Boolean slice."""
    return df.filter(cond)


def preview(df: DataFrame, order_by: Sequence, n: int = 5) -> DataFrame:
    """First n rows of a total order."""
    return df.orderBy(*order_by).limit(n)


HASH_SPACE = 1 << 31


def sample_n(df: DataFrame, ids: Sequence[str], n: int, seed: int = 0, total: int | None = None) -> DataFrame:
    """N rows by seeded hash of the id; the same rows under any partitioning.

    With the number of rows in ``total``, rows whose hash is too large to be among the first n (by
    eight standard deviations) leave already in the scan, so that few rows meet in the last sort.
    """
    rank = F.pmod(F.xxhash64(*ids, F.lit(seed)), F.lit(HASH_SPACE))
    if total and total > n:
        bar = min(1.0, (n + 8.0 * n**0.5 + 32.0) / total)
        df = df.filter(rank < F.lit(int(bar * HASH_SPACE) + 1))
    return df.orderBy(rank, *ids).limit(n)


def cols_with_null(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """Names of columns that hold a null, from one aggregate row."""
    cols = list(cols or df.columns)
    row = df.agg(*[F.bool_or(F.col(c).isNull()).alias(c) for c in cols]).first()
    return [c for c in cols if row[c]]
