"""Ordered features within groups.

A group may be far larger than one task should hold. Groups of more than SEGMENT_ROWS rows are cut into *segments* of like numbers of
rows, at sampled values of the whole order, so even rows of one second spread over tasks. Rows are shuffled once, by group and
segment; each segment reduces to a carry (its row count, last rows, last known value), and a prefix over the carries, one row per
segment, tells every segment what lies before it. Where no group is that large, plain windows over the groups do.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardline.operators.rank import bucket_of
from wardline.operators.reshape import first_where
from wardline.session import cut_lineage

SEGMENT_ROWS = 50_000
#: Segments of a group at most (a larger group has larger ones), and sampled rows per segment.
SEGMENT_LEVELS, SEGMENT_SAMPLE = 12, 32


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the keys of the left side stay."""
    renamed = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_k_{k}"]) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_k_{k}" for k in keys])


def segment_cuts(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], rows: int | None = None) -> DataFrame | None:
    """Table (keys, _cuts) for the groups of more than ``rows`` rows: ascending order values that cut them into
    segments of about that size. None if there is no such group.

    Counting is one aggregate, combined before the shuffle. Only large groups are sampled, by a hash of the order values, at most
    2^SEGMENT_LEVELS * SEGMENT_SAMPLE values per group.
    """
    rows = rows or SEGMENT_ROWS
    large = cut_lineage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows))
    if large.isEmpty():
        return None
    order = F.struct(*order_by)
    share = F.lit(float(SEGMENT_SAMPLE)) / F.greatest(F.lit(rows), F.col("_n") / (1 << SEGMENT_LEVELS))
    drawn = same_keys(df, large, keys).filter(F.pmod(F.xxhash64(*order_by, F.lit(1)), F.lit(1 << 31)) < share * (1 << 31))
    values = drawn.groupBy(*keys).agg(F.sort_array(F.collect_set(order)).alias("_s"))
    at = F.when(F.size("_s") < SEGMENT_SAMPLE, F.array().cast("array<int>")).otherwise(
        F.sequence(F.lit(SEGMENT_SAMPLE), F.size("_s"), F.lit(SEGMENT_SAMPLE)))
    return cut_lineage(values.select(*keys, F.transform(at, lambda i: F.get("_s", i - 1)).alias("_cuts")))


class _Segmented:
    """A frame cut into segments where that is needed, with the windows used on it."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order_by: Sequence[str], segment: Column | None):
        self.keys, self.order_by, self.names = list(keys), list(order_by), df.columns
        self.order = F.struct(*order_by)
        cuts = segment_cuts(df, self.keys, self.order_by) if segment is None else None
        self.whole = segment is None and cuts is None
        if segment is not None:
            df = df.withColumn("_seg", segment)
        elif cuts is not None:
            # One level more than SEGMENT_LEVELS: a sample is seldom exactly as large as expected.
            seg = F.when(F.col("_cuts").isNotNull(), bucket_of(self.order, F.col("_cuts"), SEGMENT_LEVELS + 2))
            df = same_keys(df, cuts, self.keys, "left").withColumn("_seg", F.coalesce(seg, F.lit(0)).cast("bigint")).drop("_cuts")
        self.df = df.withColumn("_seg", F.lit(0).cast("bigint")) if self.whole else df
        self.groups = self.keys if self.whole else [*self.keys, "_seg"]
        self.window = Window.partitionBy(*self.groups).orderBy(*order_by)
        self.to_here = self.window.rowsBetween(Window.unboundedPreceding, 0)
        self.before = self.window.rowsBetween(Window.unboundedPreceding, -1)
        self.onward = self.window.rowsBetween(0, Window.unboundedFollowing)
        self.chain = chain = Window.partitionBy(*self.keys).orderBy("_seg")
        self.earlier = chain.rowsBetween(Window.unboundedPreceding, -1)
        self.later = chain.rowsBetween(1, Window.unboundedFollowing)
        self.nearest = lambda k: chain.rowsBetween(-k, -1)

    def summary(self, *aggs: Column) -> DataFrame:
        return self.df.groupBy(*self.keys, "_seg").agg(*aggs)

    def last_row(self, cols: Sequence[str]) -> Column:
        return F.max_by(F.struct(*cols), self.order)

    def last_value(self, col: str) -> Column:
        return F.max_by(col, F.when(F.col(col).isNotNull(), self.order))

    def with_carry(self, rows: DataFrame, carry: DataFrame) -> DataFrame:
        if self.whole:  # nothing lies before a group's only segment
            return rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in carry.schema if f.name not in [*self.keys, "_seg"]})
        return same_keys(rows, carry, [*self.keys, "_seg"], "left")


def sequence(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], out: str = "SEQUENCE",
             segment: Column | None = None, ties: bool = False) -> DataFrame:
    """1, 2, … within a group along a total order.

    ``ties`` states that equal order values may get their numbers in any order; many equal values are then cut apart by a
    hash of the row.
    """
    if ties and segment is None:
        tied = df.withColumn("_tie", F.xxhash64(*df.columns))
        return sequence(tied, keys, [*order_by, "_tie"], out).drop("_tie")
    s = _Segmented(df, keys, order_by, segment)
    counts = s.summary(F.count(F.lit(1)).alias("_n"))
    carry = counts.select(*s.keys, "_seg", F.sum("_n").over(s.earlier).alias("_prior"))
    rows = s.df.withColumn("_i", F.row_number().over(s.window))
    number = (F.col("_i") + F.coalesce(F.col("_prior"), F.lit(0))).cast("bigint")
    return s.with_carry(rows, carry).select(*[c for c in s.names if c != out], number.alias(out))


def rank_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], out: str = "rank",
               segment: Column | None = None) -> DataFrame:
    """Rank with ties broken by the rest of the order."""
    return sequence(df, keys, order_by, out, segment)


def ordinal_suffix(df: DataFrame, keys: Sequence[str], item: str, order_by: Sequence[str],
                   segment: Column | None = None) -> DataFrame:
    """Item name followed by its number within (key, item)."""
    numbered = sequence(df, [*keys, item], order_by, "_no", segment)
    return numbered.withColumn(item, F.concat_ws(" ", F.col(item), F.col("_no").cast("string"))).drop("_no")


def lags(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], cols: Sequence[str], k: int = 1,
         segment: Column | None = None, name: str = "{col}_lag{j}") -> DataFrame:
    """The values 1 … k rows earlier.

    A segment passes on its last k rows; the k nearest earlier segments hold at least k rows if the
    group has them.
    """
    s = _Segmented(df, keys, order_by, segment)
    if k == 1:
        tails = s.summary(F.array(s.last_row(cols)).alias("_tail"))
    else:
        backwards = Window.partitionBy(*s.groups).orderBy(*[F.col(c).desc_nulls_last() for c in s.order_by])
        tails = (
            s.df.withColumn("_back", F.row_number().over(backwards))
            .filter(F.col("_back") <= k)
            .groupBy(*s.keys, "_seg")
            .agg(F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("at"), *cols))).alias("_tail"))
        )
    carry = tails.select(*s.keys, "_seg", F.flatten(F.collect_list("_tail").over(s.nearest(k))).alias("_prev"))
    rows = s.df.withColumns({"_i": F.row_number().over(s.window)} | {
        f"_l{j}_{c}": F.lag(c, j).over(s.window) for c in cols for j in range(1, k + 1)
    })
    size = F.coalesce(F.size("_prev"), F.lit(0))
    out = []
    for c in cols:
        for j in range(1, k + 1):
            carried = F.get(F.col("_prev"), size - (F.lit(j) - F.col("_i") + 1)).getField(c)
            value = F.when(F.col("_i") > j, F.col(f"_l{j}_{c}")).otherwise(carried)
            out.append(value.alias(name.format(col=c, j=j)))
    return s.with_carry(rows, carry).select(*s.names, *out)


def last_known(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], cols: Sequence[str],
               segment: Column | None = None, name: str = "{col}_prev") -> DataFrame:
    """The last non-null value before each row."""
    s = _Segmented(df, keys, order_by, segment)
    last = s.summary(*[s.last_value(c).alias(f"_e_{c}") for c in cols])
    carry = last.select(*s.keys, "_seg", *[F.last(f"_e_{c}", True).over(s.earlier).alias(f"_f_{c}") for c in cols])
    rows = s.df.withColumns({f"_p_{c}": F.last(c, True).over(s.before) for c in cols})
    out = [F.coalesce(f"_p_{c}", f"_f_{c}").alias(name.format(col=c)) for c in cols]
    return s.with_carry(rows, carry).select(*s.names, *out)


def fill_both(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], cols: Sequence[str],
              segment: Column | None = None) -> DataFrame:
    """E5: nulls take the last known value, or the next one where none came before."""
    s = _Segmented(df, keys, order_by, segment)
    ends = []
    for c in cols:
        ends.append(first_where(F.col(c), s.order).alias(f"_a_{c}"))
        ends.append(s.last_value(c).alias(f"_z_{c}"))
    edge = s.summary(*ends)
    carry = edge.select(
        *s.keys, "_seg",
        *[F.last(f"_z_{c}", True).over(s.earlier).alias(f"_ff_{c}") for c in cols],
        *[F.first(f"_a_{c}", True).over(s.later).alias(f"_bf_{c}") for c in cols],
    )
    rows = s.df.withColumns(
        {f"_p_{c}": F.last(c, True).over(s.to_here) for c in cols}
        | {f"_n_{c}": F.first(c, True).over(s.onward) for c in cols}
    )
    filled = {c: F.coalesce(f"_p_{c}", f"_ff_{c}", f"_n_{c}", f"_bf_{c}").alias(c) for c in cols}
    return s.with_carry(rows, carry).select(*[filled.get(c, F.col(c)) for c in s.names])


def days_since_start(df: DataFrame, keys: Sequence[str], date: str, out: str = "DAYS_SINCE_ADMISSION") -> DataFrame:
    """Days since the first date of the group."""
    keys = list(keys)
    start = df.groupBy(*keys).agg(F.min(date).alias("_start"))
    names = [c for c in df.columns if c != out]
    return df.join(start, keys).select(*names, F.datediff(F.col(date), F.col("_start")).alias(out))


def _previous(df, keys, order_by, lagged, known, segment) -> DataFrame:
    """``<col>_lag1`` and last known ``<col>_prev`` together, on one shuffle of the rows."""
    s = _Segmented(df, keys, order_by, segment)
    edge = s.summary(s.last_row(lagged).alias("_row"), *[s.last_value(c).alias(f"_e_{c}") for c in known])
    carry = edge.select(
        *s.keys, "_seg",
        F.lag("_row").over(s.chain).alias("_row"),
        *[F.last(f"_e_{c}", True).over(s.earlier).alias(f"_f_{c}") for c in known],
    )
    rows = s.df.withColumns(
        {"_i": F.row_number().over(s.window)}
        | {f"_l_{c}": F.lag(c).over(s.window) for c in lagged}
        | {f"_p_{c}": F.last(c, True).over(s.before) for c in known}
    )
    out = [F.when(F.col("_i") > 1, F.col(f"_l_{c}")).otherwise(F.col("_row").getField(c)).alias(f"{c}_lag1") for c in lagged]
    out += [F.coalesce(f"_p_{c}", f"_f_{c}").alias(f"{c}_prev") for c in known]
    return s.with_carry(rows, carry).select(*s.names, *out)


def _gap(day: str) -> Column:
    gap = F.col(day) - F.col(f"{day}_lag1")
    return F.coalesce(F.nullif(gap, F.lit(0)), F.lit(1))


def day_gap(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], day: str, out: str = "day_gap",
            segment: Column | None = None) -> DataFrame:
    """Days since the previous row; 1 for the first row and for a gap of 0."""
    moved = lags(df, keys, order_by, [day], 1, segment)
    return moved.select(*df.columns, _gap(day).alias(out))


def _rate(value: Column, base: Column, on_zero: str) -> Column:
    if on_zero == "null":
        return F.when(base != 0, value / base - 1)
    if on_zero == "inf":
        inf = F.lit(float("inf"))
        at_zero = F.when(value > 0, inf).when(value < 0, -inf)
        return F.when(base != 0, value / base - 1).when(base == 0, at_zero)
    raise ValueError(f"unknown on_zero {on_zero!r}")


def change_columns(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], day: str, cols: Sequence[str],
                   on_zero: str = "null", segment: Column | None = None) -> DataFrame:
    """E8/E9 in one pass: ``<col>_delta_per_day`` and ``<col>_percent_change_per_day``.

    Both windows share one shuffle. A missing change is 0; a change from 0 is null, or infinite
    with ``on_zero="inf"``.
    """
    moved = _previous(df, keys, order_by, [day, *cols], cols, segment)
    gap = _gap(day)
    out = {}
    for c in cols:
        delta = (F.col(c) - F.col(f"{c}_lag1")) / gap
        out[f"{c}_delta_per_day"] = F.coalesce(delta, F.lit(0.0))
        base = F.col(f"{c}_prev")
        rate = _rate(F.col(c), base, on_zero) / gap * F.lit(100.0)
        known = base.isNotNull() & F.col(c).isNotNull()
        undefined = known & (base == 0) & (F.lit(on_zero == "null") | (F.col(c) == 0))
        gone = F.lit(None).cast("double") if on_zero == "null" else F.lit(0.0)
        out[f"{c}_percent_change_per_day"] = F.when(undefined, gone).otherwise(F.coalesce(rate, F.lit(0.0)))
    return moved.select(*df.columns, *[v.alias(n) for n, v in out.items()])


def delta_per_day(df, keys, order_by, day, cols, segment=None) -> DataFrame:
    """Change since the previous row, per day; 0 where unknown."""
    moved = lags(df, keys, order_by, [day, *cols], 1, segment)
    change = lambda c: (F.col(c) - F.col(f"{c}_lag1")) / _gap(day)
    return moved.select(*df.columns, *[F.coalesce(change(c), F.lit(0.0)).alias(f"{c}_delta_per_day") for c in cols])


def pct_per_day(df, keys, order_by, day, cols, on_zero="null", segment=None) -> DataFrame:
    """Percent change from the last known value, per day; 0 where unknown."""
    wide = change_columns(df, keys, order_by, day, cols, on_zero, segment)
    return wide.drop(*[f"{c}_delta_per_day" for c in cols])


def change_tables(df, keys, order_by, day, cols, on_zero="null", segment=None) -> tuple[DataFrame, DataFrame]:
    """Delta table and percent table; the inputs are replaced by their changes."""
    wide = change_columns(df, keys, order_by, day, cols, on_zero, segment)
    meta = [c for c in df.columns if c not in cols]
    return (
        wide.select(*meta, *[f"{c}_delta_per_day" for c in cols]),
        wide.select(*meta, *[f"{c}_percent_change_per_day" for c in cols]),
    )


def changes(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], cols: Sequence[str],
            on_zero: str = "null", segment: Column | None = None) -> DataFrame:
    """Plain change and percent change; null where unknown.

    As in the per-day form, the percent change carries the last known value over gaps.
    """
    moved = _previous(df, keys, order_by, cols, cols, segment)
    out = []
    for c in cols:
        out.append((F.col(c) - F.col(f"{c}_lag1")).alias(f"{c}_delta"))
        filled = F.coalesce(F.col(c), F.col(f"{c}_prev"))
        out.append((_rate(filled, F.col(f"{c}_prev"), on_zero) * F.lit(100.0)).alias(f"{c}_percent_change"))
    return moved.select(*df.columns, *out)


def largest_drop(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], cols: Sequence[str],
                 out: str = "drop_pct") -> DataFrame:
    """Largest percent drop of any column from the group's first row; null on the first row itself."""
    keys = list(keys)
    order = F.struct(*order_by)
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*cols), order).alias("_base"), F.min(order).alias("_first"))
    drops = []
    for c in cols:
        base = F.col("_base").getField(c)
        drops.append(F.when(base != 0, (base - F.col(c)) / base * F.lit(100)))
    worst = F.greatest(*drops) if len(drops) > 1 else drops[0]
    return df.join(first, keys, "left").select(
        *df.columns, F.when(order > F.col("_first"), worst).alias(out)
    )


def baseline_drop_label(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], cols: Sequence[str],
                        pct: float = 10.0, out: str = "RFS") -> DataFrame:
    """1 where any column fell by at least ``pct`` percent from the group's first row."""
    dropped = largest_drop(df, keys, order_by, cols, "_drop")
    label = F.coalesce(F.col("_drop") >= pct, F.lit(False)).cast("int")
    return dropped.select(*[c for c in df.columns if c != out], label.alias(out))


def drop_severity(drop: Column | str, bands: Mapping[str, float] | None = None) -> Column:
    """Name of the highest band whose lower limit the drop reaches; a limit is inclusive
    for the lowest band and for the middle one, exclusive for the top one."""
    bands = bands or {"mild": 10.0, "moderate": 20.0, "severe": 30.0}
    d = F.col(drop) if isinstance(drop, str) else drop
    ordered = sorted(bands.items(), key=lambda kv: -kv[1])
    out = None
    for i, (name, limit) in enumerate(ordered):
        cond = d > limit if i == 0 and len(ordered) > 1 else d >= limit
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out
