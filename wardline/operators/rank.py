"""E4 and shared ranking tools: global numbering and ranks without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardline.session import cut_lineage, pin_partitions

INDEX_BITS = 33


def with_row_id(df: DataFrame, order_by: Sequence, out: str = "ROW", start: int = 1) -> DataFrame:
    """Consecutive numbers along a total order.

    Rows are range-sorted on the whole order, so a hot leading value spreads over partitions, and
    written once to the shared folder, which fixes the partition numbers. Only one count per
    partition reaches the driver.
    """
    placed = pin_partitions(df.repartitionByRange(*order_by).sortWithinPartitions(*order_by))
    tagged = placed.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", INDEX_BITS)
    counts = {r["p"]: r["n"] for r in tagged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, total = [], start
    for p in sorted(counts):
        rows.append((p, total))
        total += counts[p]
    if not rows:
        return placed.withColumn(out, F.lit(None).cast("bigint"))
    offsets = df.sparkSession.createDataFrame(rows, "_p bigint, _offset bigint")
    index = F.col("_at").bitwiseAND(F.lit((1 << INDEX_BITS) - 1))
    return (
        tagged.withColumn("_p", part)
        .join(offsets, "_p")
        .select(*df.columns, (F.col("_offset") + index).alias(out))
    )


def bucket_of(value: Column, cuts: Column, levels: int) -> Column:
    """Number of cuts below a value, by binary search in an ascending array of 2^levels - 1 cuts."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(levels))])
    found = F.aggregate(
        steps, F.lit(0), lambda at, step: at + F.when(F.get(cuts, at + step - 1) < value, step).otherwise(F.lit(0))
    )
    return F.coalesce(found, F.lit(0))


def running_total(counts: DataFrame, group: Sequence[str], value: str, n: str, out: str = "before",
                  levels: int = 8) -> DataFrame:
    """Rows with a smaller value in the same group, for a table of distinct (group, value, n).

    Each group is cut into 2^levels buckets at approximate quantiles of its distinct values; a sum
    per bucket gives the offset, so windows only ever span one bucket.
    """
    group = list(group)
    counts = counts.filter(F.col(n) >= 0)  # keeps n in every branch, so that all of them reuse one shuffle
    probs = [i / (1 << levels) for i in range(1, 1 << levels)]
    cuts = counts.groupBy(*group).agg(F.percentile_approx(value, probs, 10_000).alias("_cuts"))
    placed = counts.join(cuts, group).withColumn("_b", bucket_of(F.col(value), F.col("_cuts"), levels)).drop("_cuts")
    totals = placed.groupBy(*group, "_b").agg(F.sum(n).alias("_t"))
    prior = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "_b", F.coalesce(F.sum("_t").over(prior), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*group, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_w", F.coalesce(F.sum(n).over(inside), F.lit(0)))
        .join(offsets, [*group, "_b"])
        .withColumn(out, F.col("_o") + F.col("_w"))
        .drop("_o", "_w", "_b")
    )


def average_ranks(long: DataFrame, group: Sequence[str], value: str, levels: int = 8) -> DataFrame:
    """Average rank of each distinct value: table (group, value, n, rank)."""
    counts = long.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    return running_total(counts, group, value, "n", levels=levels).withColumn(
        "rank", F.col("before") + (F.col("n") + 1) / F.lit(2.0)
    ).drop("before")


def rank_columns(df: DataFrame, cols: Sequence[str], ids: Sequence[str], hot: int = 1000) -> DataFrame:
    """The columns replaced by average ranks, rows without nulls in them; ``ids`` tell rows apart and are not returned.

    Rank tables have one row per distinct value and are joined column by column. Values with at least 1 / hot of all rows are a
    small table of their own that leaves rows where they are; a column that also has others is shuffled once by value, the rows of
    frequent values dealt by row key. So a task holds no more of the rows for a value that many rows share.
    """
    rows = df.dropna(subset=list(cols)).select(
        *[F.col(c).alias(f"_v{i}") for i, c in enumerate(cols)], (F.pmod(F.xxhash64(*ids), F.lit(1 << 20)) + 1).cast("int").alias("_deal"))
    long = rows.unpivot([], [F.col(f"_v{i}") for i in range(len(cols))], "feature", "v")
    ranks = cut_lineage(average_ranks(long, ["feature"], "v"))
    total = ranks.filter("feature = '_v0'").agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * hot >= total
    frequent, rare = cut_lineage(ranks.filter(often).coalesce(1)), ranks.filter(~often)
    spread = {r["feature"] for r in rare.select("feature").distinct().collect()}
    for i in range(len(cols)):
        v = f"_v{i}"
        own = frequent.filter(F.col("feature") == v).select(F.col("v").alias(v), F.col("rank").alias("_often"))
        rows = rows.join(own, v, "left")
        rank = F.col("_often")
        if v in spread:
            other = rare.filter(F.col("feature") == v).select(F.col("v").alias(v), F.lit(0).alias("_at"), F.col("rank").alias("_rare"))
            rows = rows.withColumn("_at", F.when(rank.isNull(), 0).otherwise(F.col("_deal"))).join(other, [v, "_at"], "left").drop("_at")
            rank = F.coalesce(rank, "_rare")
        rows = rows.withColumn(f"_r{i}", rank).drop(v, "_often", "_rare")
    return rows.select(*[F.col(f"_r{i}").alias(c) for i, c in enumerate(cols)])
