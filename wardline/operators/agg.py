"""Grouped summaries. All of them combine before the shuffle."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wardline.operators.quantiles import exact_quantiles
from wardline.operators.rank import rank_columns
from wardline.operators.window import sequence


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value, most frequent first."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col)


def distinct_count(df: DataFrame, col: str, by: Sequence[str] = (), out: str = "n_distinct") -> DataFrame:
    """Exact distinct count, global or by group."""
    return df.groupBy(*by).agg(F.countDistinct(col).alias(out))


def mean_rows_per(df: DataFrame, entity: str, by: Sequence[str], out: str = "mean_rows") -> DataFrame:
    """Rows per entity, averaged within cohorts."""
    per = df.groupBy(*by, entity).agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy(*by).agg(F.avg("_n").alias(out))


def groups_without(df: DataFrame, keys: Sequence[str], cond: Column) -> DataFrame:
    """Rows of the groups in which no row meets the condition."""
    keys = list(keys)
    free = df.groupBy(*keys).agg(F.coalesce(F.bool_or(cond), F.lit(False)).alias("_hit")).filter("not _hit")
    return df.join(free.select(*keys), keys, "left_semi")


def any_by(df: DataFrame, keys: Sequence[str], cond: Column, out: str = "any_hit") -> DataFrame:
    """One row per group: does any row meet the condition."""
    return df.groupBy(*keys).agg(F.coalesce(F.bool_or(cond), F.lit(False)).alias(out))


def list_by(df: DataFrame, keys: Sequence[str], col: str, cond: Column, part_rows: int = 10_000) -> DataFrame:
    """Ordered values of the rows that meet the condition, as lists.

    A list holds at most ``part_rows`` values; longer groups continue in the next ``part``.
    """
    numbered = sequence(df.filter(cond), keys, [col], "_i", ties=True)
    part = F.floor((F.col("_i") - 1) / F.lit(part_rows)).cast("int")
    return (
        numbered.groupBy(*keys, part.alias("part"))
        .agg(F.array_sort(F.collect_list(col)).alias("items"))
    )


def center(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and exact median per column."""
    long = df.select(*by, *cols).unpivot(list(by), list(cols), "feature", "v")
    means = long.groupBy(*by, "feature").agg(F.avg("v").alias("mean"))
    medians = exact_quantiles(df, cols, [0.5], by).select(*by, "feature", F.col("value").alias("median"))
    return means.join(medians, [*by, "feature"], "left")


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing count and percent per column, from one aggregate row."""
    cols = list(cols or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = one.unpivot(["_n"], cols, "feature", "n_null")
    return long.select("feature", "n_null", F.round(F.col("n_null") * 100 / F.col("_n"), 2).alias("pct_null"))


def stddevs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sample deviation per column."""
    return df.agg(*[F.stddev_samp(c).alias(c) for c in cols]).unpivot([], list(cols), "feature", "sd")


def classification_metrics(df: DataFrame, y: str, pred: str, by: Sequence[str] = (), beta: float = 2.0) -> DataFrame:
    """Confusion counts, precision, recall, accuracy and F-beta; a zero division gives 0."""
    yes, flag = F.col(y) == 1, F.col(pred) == 1
    counts = df.groupBy(*by).agg(
        F.count_if(yes & flag).alias("tp"),
        F.count_if(~yes & flag).alias("fp"),
        F.count_if(yes & ~flag).alias("fn"),
        F.count_if(~yes & ~flag).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    b2 = beta * beta
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return counts.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "accuracy": ratio(tp + tn, tp + fp + fn + tn),
            "fbeta": ratio(tp * (1 + b2), tp * (1 + b2) + fn * b2 + fp),
        }
    )


def flag_counts(df: DataFrame, pred: str, by: Sequence[str] = (), label: str | None = None) -> DataFrame:
    """Flagged rows, and true ones where a label is given."""
    aggs = [F.count_if(F.col(pred) == 1).alias("n_flagged")]
    if label:
        aggs.append(F.count_if(F.col(label) == 1).alias("n_true"))
    return df.groupBy(*by).agg(*aggs)


def arg_best(df: DataFrame, by: Sequence[str], score: str, ord: str, above: float | None = None) -> DataFrame:
    """The row with the highest score per group; of equals the first in ``ord`` wins.

    With ``above`` only scores beyond it can win, so a group may have no winner.
    """
    runs = df if above is None else df.filter(F.col(score) > above)
    rest = [c for c in df.columns if c not in by]
    best = runs.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(ord))).alias("_b"))
    return best.select(*by, "_b.*")


def best_per_type(df: DataFrame, by: Sequence[str], model_id: str, score: str, ord: str) -> DataFrame:
    """Best run per model type, the type being the first word of the model id."""
    typed = df.withColumn("model_type", F.split(model_id, " ")[0])
    counts = typed.groupBy(*by, "model_type").agg(F.count(F.lit(1)).alias("n_runs"))
    return arg_best(typed, [*by, "model_type"], score, ord).join(counts, [*by, "model_type"])


def corr_matrix(df: DataFrame, cols: Sequence[str], method: str = "pearson", ids: Sequence[str] = ()) -> DataFrame:
    """Correlation matrix in long form (x, y, r).

    Pearson is one aggregate over all pairs of columns. Spearman replaces values by average ranks;
    a row key (``ids``) deals rows of frequent values to tasks.
    """
    cols = list(cols)
    if method == "spearman":
        if not ids:
            raise ValueError("spearman needs a unique row key")
        df = rank_columns(df, cols, ids)
    elif method != "pearson":
        raise ValueError(f"unknown method {method!r}")
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        cells.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"{i}").alias("r")))
        if a != b:
            cells.append(F.struct(F.lit(b).alias("x"), F.lit(a).alias("y"), F.col(f"{i}").alias("r")))
    return one.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def mean_abs_dev(train: DataFrame, flagged: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean absolute deviation of flagged rows from the train medians, largest first."""
    medians = exact_quantiles(train, cols, [0.5]).select("feature", F.col("value").alias("_m"))
    long = flagged.select(*cols).unpivot([], list(cols), "feature", "v")
    out = long.join(medians, "feature").groupBy("feature").agg(F.avg(F.abs(F.col("v") - F.col("_m"))).alias("mean_dev"))
    return out.orderBy(F.desc("mean_dev"), "feature")


def mean_change(df: DataFrame, col: str, by: Sequence[str] = (), out: str = "mean_change") -> DataFrame:
    """Mean over the usable changes of a slice, with their number."""
    return df.groupBy(*by).agg(F.avg(col).alias(out), F.count(col).alias("n"))


def box_summary(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Five-number summary and 1.5 IQR fences."""
    quant = exact_quantiles(df, cols, [0.0, 0.25, 0.5, 0.75, 1.0], by)
    names = {0.0: "min", 0.25: "q1", 0.5: "median", 0.75: "q3", 1.0: "max"}
    wide = quant.groupBy(*by, "feature").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in names.items()]
    )
    iqr = F.col("q3") - F.col("q1")
    return wide.withColumns({"low_fence": F.col("q1") - 1.5 * iqr, "high_fence": F.col("q3") + 1.5 * iqr})


def density_grid(df: DataFrame, col: str, n_grid: int = 200, transform: str = "log1p", cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density on a grid, bandwidth by Scott's rule.

    One aggregate counts the values into bins of 1/16 bandwidth, with the first eight moments of their distance u from the bin's
    centre, in bandwidths. Around a centre at distance t the kernel is exp(-t^2 / 2) times the sum of He_k(t) u^k / k!, so a bin acts on a grid
    point as its values do: the ninth term, at most He_8(t) exp(-t^2 / 2) / (8! 32^8), is below 3e-15 of the kernel's peak. A bin reaches the grid points within nine
    bandwidths; what lies beyond is below 3e-18 of the peak. The number of bins depends on the range, not on the rows.
    """
    x = {"log1p": F.log1p(col), "none": F.col(col).cast("double")}[transform]
    values = df.select(x.alias("x")).filter("x is not null")
    stats = values.agg(
        F.count("x").alias("n"), F.stddev_samp("x").alias("sd"), F.min("x").alias("lo"), F.max("x").alias("hi")
    ).first()
    width = stats["sd"] * stats["n"] ** -0.2
    low, high = stats["lo"] - cut * width, stats["hi"] + cut * width
    step, bins, reach = (high - low) / (n_grid - 1), 16, 9.0
    scaled = values.select(((F.col("x") - F.lit(low)) / F.lit(width)).alias("y"))
    placed = scaled.withColumn("b", F.floor(F.col("y") * bins)).withColumn("u", F.col("y") - (F.col("b") + 0.5) / bins)
    moments = placed.groupBy("b").agg(*[F.sum(F.pow("u", F.lit(k)) / F.lit(math.factorial(k))).alias(f"m{k}") for k in range(8)])
    centre = (F.col("b") + 0.5) / bins
    first = F.greatest(F.ceil((centre - reach) * width / step), F.lit(0)).cast("int")
    last = F.least(F.floor((centre + reach) * width / step), F.lit(n_grid - 1)).cast("int")
    near = moments.withColumn("centre", centre).filter(first <= last).withColumn("i", F.explode(F.sequence(first, last)))
    t = F.col("i") * F.lit(step / width) - F.col("centre")
    near = near.withColumn("t", t)
    hermite = [F.lit(1.0), F.col("t")]
    for k in range(1, 7):
        hermite.append(F.col("t") * hermite[k] - F.lit(float(k)) * hermite[k - 1])
    kernel = F.exp(-0.5 * F.col("t") * F.col("t")) * sum((F.col(f"m{k}") * hermite[k] for k in range(1, 8)), F.col("m0"))
    total = near.groupBy("i").agg(F.sum(kernel).alias("s"))
    scale = 1.0 / (stats["n"] * width * math.sqrt(2.0 * math.pi))
    grid = df.sparkSession.range(n_grid).select(F.col("id").cast("int").alias("i"))
    return grid.join(total, "i", "left").select(
        "i", (F.lit(low) + F.col("i") * F.lit(step)).alias("x"), (F.coalesce("s", F.lit(0.0)) * F.lit(scale)).alias("density"))


def unique_sorted(df: DataFrame, col: str) -> DataFrame:
    """Distinct values in order."""
    return df.select(col).distinct().orderBy(col)


def median_length(df: DataFrame, col: str) -> DataFrame:
    """Median text length of an id column."""
    lengths = df.filter(F.col(col).isNotNull()).select(F.length(F.col(col).cast("string")).alias("len"))
    return exact_quantiles(lengths, ["len"], [0.5]).select(F.col("value").alias("median_len"))


def day_classes(df: DataFrame, keys: Sequence[str], day: str, a: Column, b: Column,
                names: tuple[str, str] = ("model", "label")) -> DataFrame:
    """One row per key and day that is in one of two day sets: ``a``, ``b`` or ``both``."""
    days = df.filter(a | b).groupBy(*keys, day).agg(F.bool_or(a).alias("_a"), F.bool_or(b).alias("_b"))
    kind = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), names[0]).otherwise(names[1])
    return days.select(*keys, day, kind.alias("day_class"))


def day_overlap(df: DataFrame, keys: Sequence[str], day: str, a: Column, b: Column) -> DataFrame:
    """Number of days per key that are in the first set only, the second only, or both."""
    days = day_classes(df, keys, day, a, b)
    return days.groupBy(*keys).agg(
        *[F.count_if(F.col("day_class") == n).alias(f"n_{n}") for n in ("model", "label", "both")]
    )
