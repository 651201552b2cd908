"""Same-day collapse, pivot and unpivot."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def _order(order_by: Sequence[str]) -> Column:
    return F.col(order_by[0]) if len(order_by) == 1 else F.struct(*order_by)


def first_where(value: Column, order: Column, cond: Column | None = None) -> Column:
    """First non-null value along an order, optionally among rows that meet a condition."""
    known = value.isNotNull() if cond is None else value.isNotNull() & cond
    return F.min_by(value, F.when(known, order))


def first_non_null(df: DataFrame, keys: Sequence[str], cols: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Per key and column the first non-null value; combined before the shuffle."""
    order = _order(order_by)
    keyed = df.dropna(subset=list(keys))
    return keyed.groupBy(*keys).agg(*[first_where(F.col(c), order).alias(c) for c in cols])


def pivot_first(
    df: DataFrame,
    keys: Sequence[str],
    item: str,
    value: str,
    items: Mapping[str, str] | Sequence[str],
    order_by: Sequence[str],
    clean: Callable[[str], Column] | None = None,
) -> DataFrame:
    """Long to wide, first non-null value per key and item.

    One conditional aggregation, so the item list is never looked up in the data. Keys without any
    value are left out. A mapping names the output columns. ``clean`` makes numbers of the values; the
    first value counts even where it is no number. Unlike texts, numbers are aggregated without a sort.
    """
    names = dict(items) if isinstance(items, Mapping) else {i: i for i in items}
    order = _order(order_by)
    wanted = df.dropna(subset=list(keys)).filter(F.col(item).isin(*names) & F.col(value).isNotNull())
    if clean is None:
        cells = [first_where(F.col(value), order, F.col(item) == F.lit(i)).alias(n) for i, n in names.items()]
    else:
        wanted = wanted.withColumn(value, clean(value))
        cells = [F.min_by(value, F.when(F.col(item) == F.lit(i), order)).alias(n) for i, n in names.items()]
    return wanted.groupBy(*keys).agg(*cells)


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "variable",
         value: str = "value") -> DataFrame:
    """D3: wide to long."""
    return df.unpivot(list(ids), list(values), name, value)
