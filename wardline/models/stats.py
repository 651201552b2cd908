"""Robust scaling, two-sample rank test, factor analysis."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from wardline.operators.agg import corr_matrix
from wardline.operators.quantiles import exact_quantiles
from wardline.operators.rank import running_total


class RobustScaler:
    """(x - median) / IQR with exact quartiles; a zero IQR divides by 1."""

    def __init__(self, cols: Sequence[str]):
        self.cols = list(cols)

    def fit(self, df: DataFrame) -> "RobustScalerModel":
        found = {(r["feature"], r["prob"]): r["value"] for r in exact_quantiles(df, self.cols, [0.25, 0.5, 0.75]).collect()}
        center = {c: found[c, 0.5] for c in self.cols if (c, 0.5) in found}
        width = {c: found[c, 0.75] - found[c, 0.25] or 1.0 for c in center}
        return RobustScalerModel(center, width)


class RobustScalerModel:
    def __init__(self, center: dict[str, float], width: dict[str, float]):
        self.center, self.width = center, width

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(self.width[c]) for c, m in self.center.items()})


def mann_whitney(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> DataFrame:
    """U of the first sample, two-sided p and both medians, one row per feature.

    Values are counted per sample first; ranks come from running totals over the distinct values.
    p uses the normal approximation with tie and continuity correction, on the result rows.
    """
    cols = list(cols)

    def long(df: DataFrame, side: int) -> DataFrame:
        return df.select(*cols).unpivot([], cols, "feature", "v").filter("v is not null").withColumn("side", F.lit(side))

    both = long(a, 1).unionByName(long(b, 0))
    counts = both.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n"), F.sum("side").alias("na"))
    ranked = running_total(counts, ["feature"], "v", "n").withColumn("rank", F.col("before") + (F.col("n") + 1) / F.lit(2.0))
    n = F.col("n").cast("double")
    sums = ranked.groupBy("feature").agg(
        F.sum("na").cast("double").alias("n1"), F.sum(F.col("n") - F.col("na")).cast("double").alias("n2"),
        F.sum(F.col("na") * F.col("rank")).alias("r1"), F.sum(n * n * n - n).alias("ties"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    total = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    variance = n1 * n2 / 12 * (total + 1 - F.col("ties") / (total * (total - 1)))
    z = F.when(variance > 0, F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)) / F.sqrt(variance))

    @F.pandas_udf("double")
    def two_sided(values):
        return values.map(lambda x: math.erfc(x / math.sqrt(2.0)), na_action="ignore").astype("float64")

    medians = exact_quantiles(a, cols, [0.5]).select("feature", F.col("value").alias("median_a")).join(
        exact_quantiles(b, cols, [0.5]).select("feature", F.col("value").alias("median_b")), "feature", "full")
    out = sums.select("feature", u.alias("u"), F.coalesce(two_sided(z), F.lit(1.0)).alias("p"))
    return out.join(medians, "feature").orderBy("p", "feature")


def _corr_array(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """The k x k correlation matrix; k is the number of features."""
    at = {c: i for i, c in enumerate(cols)}
    out = np.eye(len(cols))
    for r in corr_matrix(df, cols).collect():
        if r["x"] != r["y"]:
            out[at[r["x"]], at[r["y"]]] = r["r"]
    return out


def _eigen(corr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(corr)
    return values[::-1], vectors[:, ::-1]


def scree(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Eigenvalues of the correlation matrix, largest first."""
    values, _ = _eigen(_corr_array(df, cols))
    rows = [(i + 1, float(v)) for i, v in enumerate(values)]
    return df.sparkSession.createDataFrame(rows, "factor int, eigenvalue double")


def varimax(loadings: np.ndarray, rounds: int = 500, tol: float = 1e-8) -> np.ndarray:
    """Rotation that maximises the variance of squared loadings (Kaiser 1958), rows normalised."""
    length = np.sqrt((loadings**2).sum(axis=1, keepdims=True))
    x = loadings / np.where(length > 0, length, 1.0)
    turn, last = np.eye(x.shape[1]), 0.0
    for _ in range(rounds):
        moved = x @ turn
        u, s, vt = np.linalg.svd(x.T @ (moved**3 - moved * (moved**2).mean(axis=0)))
        turn = u @ vt
        if s.sum() <= last * (1 + tol):
            break
        last = s.sum()
    return (x @ turn) * length


def promax(loadings: np.ndarray, power: int = 4) -> np.ndarray:
    """Oblique rotation towards powers of the varimax loadings (Hendrickson and White 1964)."""
    base = varimax(loadings)
    target = base * np.abs(base) ** (power - 1)
    turn = np.linalg.lstsq(base, target, rcond=None)[0]
    turn = turn @ np.diag(np.sqrt(np.diag(np.linalg.inv(turn.T @ turn))))
    return base @ turn


class FactorModel:
    """Principal extraction of n factors, optionally rotated."""

    ROTATIONS = {None: lambda x: x, "varimax": varimax, "promax": promax}

    def __init__(self, cols: Sequence[str], n_factors: int, rotation: str | None = None):
        self.cols, self.n_factors, self.rotation = list(cols), n_factors, rotation

    def fit(self, df: DataFrame) -> "FactorModel":
        row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in self.cols], *[F.stddev_samp(c).alias(f"s_{c}") for c in self.cols]).first()
        self.means = {c: row[f"m_{c}"] for c in self.cols}
        self.sds = {c: row[f"s_{c}"] or 1.0 for c in self.cols}
        self.corr = _corr_array(df, self.cols)
        values, vectors = _eigen(self.corr)
        base = vectors[:, : self.n_factors] * np.sqrt(np.maximum(values[: self.n_factors], 0.0))
        loads = self.ROTATIONS[self.rotation](base)
        loads = loads * np.where(loads.sum(axis=0) < 0, -1.0, 1.0)
        self.loads = loads[:, np.argsort(-(loads**2).sum(axis=0), kind="stable")]
        self.spark = df.sparkSession
        return self

    @property
    def loadings(self) -> DataFrame:
        rows = [(c, j + 1, float(self.loads[i, j])) for i, c in enumerate(self.cols) for j in range(self.n_factors)]
        return self.spark.createDataFrame(rows, "feature string, factor int, loading double")

    @property
    def variance(self) -> DataFrame:
        """Sum of squared loadings, its share of the total and the running share."""
        ss = (self.loads**2).sum(axis=0)
        share = ss / len(self.cols)
        rows = [(j + 1, float(ss[j]), float(share[j]), float(share[: j + 1].sum())) for j in range(self.n_factors)]
        return self.spark.createDataFrame(rows, "factor int, ss_loadings double, proportion double, cumulative double")

    def transform(self, df: DataFrame) -> DataFrame:
        """Factor scores by regression, as column expressions."""
        weights = np.linalg.pinv(self.corr) @ self.loads
        scores = {}
        for j in range(self.n_factors):
            terms = [(F.col(c) - self.means[c]) / self.sds[c] * float(weights[i, j]) for i, c in enumerate(self.cols)]
            scores[f"factor_{j + 1}"] = sum(terms[1:], terms[0])
        return df.withColumns(scores)
