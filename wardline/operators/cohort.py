"""Error slices, changes of a slice, cohort summaries and timelines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wardline.functions import pct_from
from wardline.operators.agg import day_classes, distinct_count, groups_without, mean_change, mean_rows_per
from wardline.operators.join import anti, with_baseline
from wardline.operators.sets import union_named


def error_slices(rows: DataFrame, pred: str, label: str, out: str = "slice") -> DataFrame:
    """L1: ``TP``, ``FP``, ``FN`` or ``TN`` per row."""
    hit, true = F.col(pred) == 1, F.col(label) == 1
    kind = F.when(hit & true, "TP").when(hit, "FP").when(true, "FN").otherwise("TN")
    return rows.withColumn(out, kind)


def slice_entities(sliced: DataFrame, entity: str, kind: str = "slice") -> DataFrame:
    """L1: entities per slice with their number of rows."""
    return sliced.groupBy(kind, entity).agg(F.count(F.lit(1)).alias("n"))


def change_of_slice(rows: DataFrame, raw: DataFrame, keys: Sequence[str], seq: str, col: str, sign: str | None = None,
                    order_by: Sequence | None = None) -> DataFrame:
    """L2: percent change of ``col`` from sequence 1 for every row of a slice.

    The present value comes from ``rows`` if it has the column, else from ``raw`` by key and sequence
    (as for rows of a change table). Rows without a usable comparison are left out; ``sign``
    ``"negative"`` keeps drops only.
    """
    if col not in rows.columns:
        rows = rows.join(raw.select(*keys, seq, col), [*keys, seq], "left")
    based = with_baseline(rows, raw, keys, seq, col, order_by=order_by)
    out = based.withColumn("pct_change", pct_from(col, "baseline")).filter(F.col("pct_change").isNotNull())
    return out.filter(F.col("pct_change") < 0) if sign == "negative" else out


def unlabelled_entities(df: DataFrame, entity: str, known: Column, label: str, flag: str | None = None) -> DataFrame:
    """L3: entities of the known-positive cohort without any labelled (or flagged) row."""
    hit = F.col(label) == 1 if flag is None else (F.col(label) == 1) | (F.col(flag) == 1)
    return anti(df.filter(known).select(entity).distinct(), df.filter(hit), entity)


def timeline(df: DataFrame, scaler, keys: Sequence[str], day: str, cols: Sequence[str], cohort: str, flag: str,
             label: str) -> DataFrame:
    """L4: scaled features per key, day and feature, with cohort and day class; null values are left out."""
    kinds = day_classes(df, keys, day, F.col(flag) == 1, F.col(label) == 1)
    long = scaler.transform(df).unpivot([*keys, day, cohort], list(cols), "feature", "value").filter("value is not null")
    return long.join(kinds, [*keys, day], "left")


def cohort_summary(train: DataFrame, test: DataFrame, entity: str, cohort: str, label: str, keys: Sequence[str],
                   seq: str, col: str, drop: float = 10.0, order_by: Sequence | None = None) -> DataFrame:
    """(metric, cohort, value): entities per split and cohort, rows per entity, entities without a
    label, and control rows whose ``col`` fell by at least ``drop`` percent."""
    def line(df: DataFrame, name: str, value: str) -> DataFrame:
        group = F.col(cohort).cast("int") if cohort in df.columns else F.lit(None).cast("int")
        return df.select(F.lit(name).alias("metric"), group.alias("cohort"), F.col(value).cast("double").alias("value"))

    free = groups_without(test.filter(F.col(cohort) == 0), [entity], F.col(label) == 1)
    fallen = change_of_slice(test.filter(F.col(cohort) == 1), test, keys, seq, col, order_by=order_by)
    fallen = fallen.filter(F.col("pct_change") <= -drop)
    return union_named(
        line(distinct_count(train, entity), "entities_train", "n_distinct"),
        line(distinct_count(test, entity), "entities_test", "n_distinct"),
        line(distinct_count(test, entity, [cohort]), "entities_test_by_cohort", "n_distinct"),
        line(mean_rows_per(test, entity, [cohort]), "rows_per_entity", "mean_rows"),
        line(distinct_count(free, entity), "entities_without_label", "n_distinct"),
        line(fallen.agg(F.count(F.lit(1)).alias("n")), "control_rows_with_drop", "n"),
    )


def entity_distribution(df: DataFrame, entity: str, col: str) -> DataFrame:
    """Number of distinct entities per value."""
    return distinct_count(df.filter(F.col(col).isNotNull()), entity, [col], "n_entities")


def mean_of_slices(changes: Mapping[str, DataFrame]) -> DataFrame:
    """L2: mean change per named slice."""
    return union_named(*[mean_change(df, "pct_change").withColumn("slice", F.lit(n)) for n, df in changes.items()])
