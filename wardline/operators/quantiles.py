"""Exact quantiles for large tables and groups: sketches bracket the answer, later passes settle it."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

ACCURACY = 100_000
MARGINS = (1e-4, 1e-3, 1e-2, 1e-1)
#: Accuracy of one narrowing pass over the whole table, and the rows between its bounds from which on they are sorted.
PASS_ACCURACY = 1_000
FEW = 50_000


@dataclass
class _Cell:
    """The value of rank ``k`` in a column: it is ``low``, ``high`` or one of the ``upto - after`` rows between them."""

    col: str
    k: int
    upto: int
    low: float | None = None
    high: float | None = None
    after: int = 0

    @property
    def value(self) -> float | None:
        if self.low is not None and self.k < self.after:
            return self.low
        return self.high if self.high is not None and self.k >= self.upto else None

    def between(self, v: Column) -> Column:
        kept = F.lit(True) if self.low is None else v > self.low
        return kept if self.high is None else kept & (v < self.high)

    def probs(self) -> list[float]:
        """Edges that enclose the rank among the rows between, by the error of a sketch."""
        rows = self.upto - self.after
        at, margin = (self.k - self.after + 0.5) / rows, 2.0 / PASS_ACCURACY
        return [max(0.0, at - margin), min(1.0, at + margin)]

    def narrow(self, edge: float, below: int, including: int) -> None:
        """Take a value as a bound, given the rows below it and those up to and including it."""
        if self.k >= below and (self.low is None or edge > self.low):
            self.low, self.after = edge, including
        if self.k < including and (self.high is None or edge < self.high):
            self.high, self.upto = edge, below


def _value(col: str) -> Column:
    v = F.col(f"`{col}`").cast("double")
    return F.when(~F.isnan(v), v)


def _settle(df: DataFrame, cells: Iterable[_Cell]) -> dict[tuple[str, int], float]:
    """The values of cells with few rows between their bounds: those rows alone are shuffled and sorted, once for all cells between the same bounds."""
    spans: dict[tuple, list[_Cell]] = {}
    for c in cells:
        spans.setdefault((c.col, c.low, c.high), []).append(c)
    if not spans:
        return {}
    groups = list(spans.values())
    hits = [F.when(g[0].between(_value(g[0].col)), F.struct(F.lit(i).alias("span"), _value(g[0].col).alias("v"))) for i, g in enumerate(groups)]
    rows = df.select(F.explode(F.array_compact(F.array(*hits))).alias("_h")).select("_h.*").filter("v is not null")
    counts = rows.groupBy("span", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("span").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    wants = F.array(*[F.array(*[F.lit(c.k - c.after).cast("bigint") for c in g]) for g in groups])
    placed = counts.withColumn("last", F.sum("n").over(upto))
    held = F.filter(wants[F.col("span")], lambda w: (w < F.col("last")) & (w >= F.col("last") - F.col("n")))
    found = placed.select("span", "v", F.explode(held).alias("want")).collect()
    values = {(r["span"], r["want"]): r["v"] for r in found}
    return {(c.col, c.k): values[i, c.k - c.after] for i, g in enumerate(groups) for c in g}


def _edges(df: DataFrame, cells: Sequence[_Cell]) -> list[tuple[str, float]]:
    """(column, value) of new bounds: values of the table, strictly between the bounds so far. Cells between the same bounds share a sketch."""
    spans: dict[tuple, list[_Cell]] = {}
    for c in cells:
        spans.setdefault((c.col, c.low, c.high), []).append(c)
    if not spans:
        return []
    sketches = [
        F.percentile_approx(F.when(g[0].between(_value(g[0].col)), _value(g[0].col)), sorted({p for c in g for p in c.probs()}), PASS_ACCURACY)
        for g in spans.values()
    ]
    drawn = df.agg(*[s.alias(str(i)) for i, s in enumerate(sketches)]).first()
    return sorted({(name, e) for i, (name, _, _) in enumerate(spans) for e in drawn[i]})


def _order_statistics(df: DataFrame, wanted: Mapping[str, Sequence[float]]) -> dict[str, list[tuple[float, float]]]:
    """(prob, value) per column that has values, for the probabilities wanted of it. A column of few rows needs no sketch."""
    cols, margin = list(wanted), 2.0 / PASS_ACCURACY
    counted = df.agg(*[F.count(_value(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    sizes = {c: counted[f"n{i}"] for i, c in enumerate(cols) if counted[f"n{i}"]}
    edges = []
    if many := [c for c in sizes if sizes[c] > FEW]:
        starts = {c: sorted({e for p in wanted[c] for e in (max(0.0, p - margin), min(1.0, p + margin))}) for c in many}
        drawn = df.agg(*[F.percentile_approx(_value(c), starts[c], PASS_ACCURACY).alias(f"e{i}") for i, c in enumerate(many)]).first()
        edges = sorted({(c, e) for i, c in enumerate(many) for e in drawn[f"e{i}"]})
    at = {c: [p * (n - 1) for p in wanted[c]] for c, n in sizes.items()}
    cells = {(c, k): _Cell(c, k, sizes[c]) for c in sizes for a in at[c] for k in (math.floor(a), math.ceil(a))}
    while wide := [c for c in cells.values() if c.value is None and c.upto - c.after > FEW]:
        tallies = []
        for i, (name, e) in enumerate(edges):
            tallies += [F.count_if(_value(name) < e).alias(f"b{i}"), F.count_if(_value(name) <= e).alias(f"i{i}")]
        counted = df.agg(*tallies).first()
        for i, (name, e) in enumerate(edges):
            for c in wide:
                if c.col == name:
                    c.narrow(e, counted[f"b{i}"], counted[f"i{i}"])
        edges = _edges(df, [c for c in wide if c.value is None and c.upto - c.after > FEW])
    values = _settle(df, [c for c in cells.values() if c.value is None])
    values |= {key: c.value for key, c in cells.items() if c.value is not None}
    out = {}
    for c in sizes:
        out[c] = []
        for p, a in zip(wanted[c], at[c]):
            lo, hi = values[c, math.floor(a)], values[c, math.ceil(a)]
            out[c].append((float(p), lo if lo == hi else lo + (hi - lo) * (a - math.floor(a))))
    return out


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float] | Mapping[str, Sequence[float]], by: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles: table (by…, feature, prob, value). A feature without values has no row.

    Without ``by``, ``probs`` may name the probabilities of each column.

    Without ``by`` the jobs run at once. Each pass draws bounds for the wanted order statistics from a coarse
    sketch and counts the rows around them exactly, so a bound that the sketch misplaces still narrows the
    search; once few rows lie between the bounds, only they are shuffled and sorted. The driver gets a few
    numbers per feature and probability.

    With ``by`` the sketch per group has a rank error of at most one part in ``ACCURACY``, so a bracket that
    adds a few such parts and a few ranks on both sides holds the wanted order statistics. The second pass
    joins the brackets to the rows by group and feature, counts the rows between brackets and sorts only the
    distinct values inside them.
    """
    by = list(by)
    if not by:
        found = [
            F.struct(F.lit(c).alias("feature"), F.lit(p).alias("prob"), F.lit(v).alias("value"))
            for c, pairs in _order_statistics(df, probs if isinstance(probs, Mapping) else dict.fromkeys(cols, probs)).items() for p, v in pairs
        ]
        empty = F.array().cast("array<struct<feature:string,prob:double,value:double>>")
        return df.sparkSession.range(1).select(F.inline(F.array(*found) if found else empty))
    longs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols]))
    long = df.select(*by, longs.alias("_e")).select(*by, "_e.feature", "_e.v")
    long = long.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    edges = [e for p in probs for m in MARGINS for e in (max(0.0, p - m), min(1.0, p + m))]
    keys = [*by, "feature"]
    sketch = long.groupBy(*keys).agg(
        F.percentile_approx("v", edges, ACCURACY).alias("_q"),
        F.count(F.lit(1)).alias("_n"),
        F.min("v").alias("_min"),
        F.max("v").alias("_max"),
    )
    need = F.lit(4.0 / ACCURACY) + F.lit(4.0) / F.col("_n")
    bounds = []
    for i, p in enumerate(probs):
        low, high = F.col("_min"), F.col("_max")
        for j in reversed(range(len(MARGINS))):
            at, margin = 2 * (i * len(MARGINS) + j), MARGINS[j]
            if p - margin > 0:
                low = F.when(need <= margin, F.col("_q")[at]).otherwise(low)
            if p + margin < 1:
                high = F.when(need <= margin, F.col("_q")[at + 1]).otherwise(high)
        bounds += [low.alias(f"_low{i}"), high.alias(f"_high{i}")]
    bracket = sketch.select(*keys, "_n", *bounds)
    carried = [c for c in bracket.columns if c not in keys]

    v, lows = F.col("v"), [F.col(f"_low{i}") for i in range(len(probs))]
    inside = [v.between(lows[i], F.col(f"_high{i}")) for i in range(len(probs))]
    above = reduce(lambda a, b: a + b, [(v >= low).cast("int") for low in lows])
    seen = (
        long.join(bracket, keys)
        .select(*keys, *carried, above.alias("_above"), F.when(reduce(lambda a, b: a | b, inside), v).alias("v"))
        .groupBy(*keys, "_above", "v")
        .agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in carried])
    )
    order = sorted(range(len(probs)), key=lambda i: probs[i])
    cells = [
        F.struct(F.lit(float(probs[i])).alias("prob"), (F.lit(float(probs[i])) * (F.col("_n") - 1)).alias("at"),
                 F.when(inside[i], v).alias("v"), (F.col("_above") <= place).alias("below"))
        for place, i in enumerate(order)
    ]
    counts = (
        seen.select(*keys, "n", F.explode(F.array(*cells)).alias("_c"))
        .select(*keys, "n", "_c.*")
        .filter("v is not null or below")
        .groupBy(*keys, "prob", "at", "v")
        .agg(F.sum("n").alias("n"))
    )
    upto = Window.partitionBy(*keys, "prob").orderBy(F.col("v").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, 0
    )
    placed = counts.withColumn("last", F.sum("n").over(upto) - 1).withColumn("first", F.col("last") - F.col("n") + 1)
    floor, ceil = F.floor("at"), F.ceil("at")
    holds = lambda pos: (F.col("first") <= pos) & (pos <= F.col("last"))
    ends = placed.filter(holds(floor) | holds(ceil)).groupBy(*keys, "prob", "at").agg(
        F.max(F.when(holds(floor), v)).alias("lo"), F.max(F.when(holds(ceil), v)).alias("hi")
    )
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))
    return ends.select(*keys, "prob", value.alias("value"))
