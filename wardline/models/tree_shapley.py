"""K8 for forests: exact Shapley values of a row's path length against every background row, without sampled orders.

A leaf is a box: per feature on its path an interval. Under a coalition a row takes its own value for the features inside and a
background row's for those outside, so it reaches the leaf if for every feature the one that counts is in the interval. For a row
and a background row only two sets matter: features that only the row meets (they must be inside) and features that only the
background row meets (they must be outside); their sizes give the closed weights of all orders at once. Background rows of equal
pattern in a leaf share the work: one aggregate counts the patterns of all background rows, and what the tasks hold depends on the
forest alone. Leaves are dealt to blocks of bounded pattern number, each block is one pass over the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil, factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardline.models.base import FEATURES, ROW_ID
from wardline.session import cut_lineage

#: Patterns of one block of leaves at most, as far as path lengths and background rows allow.
BLOCK_PATTERNS = 4_000_000
#: Leaves of at most so many features have all their patterns in an array, others those that were met.
DENSE = 6
BOX_SCHEMA = "tree int, leaf bigint, value double, features array<int>, low array<double>, high array<double>"


def leaf_boxes(nodes: pd.DataFrame) -> list[tuple]:
    """(node, value, features, low, high) of the leaves of one tree; a row is inside if low < x and not x > high for each feature."""
    from wardline.models.iforest import average_path

    known = {n: (f, t, s) for n, f, t, s in zip(*(nodes[c].tolist() for c in ("node", "feature", "threshold", "size")))}
    out, todo = [], [(1, {})]
    while todo:
        at, box = todo.pop()
        feature, cut, size = known[at]
        if feature < 0:
            on = sorted(box)
            out.append((at, at.bit_length() - 1 + float(average_path(size)), on, [box[f][0] for f in on], [box[f][1] for f in on]))
            continue
        low, high = box.get(feature, (-np.inf, np.inf))
        todo += [(2 * at, box | {feature: (low, min(high, cut))}), (2 * at + 1, box | {feature: (max(low, cut), high)})]
    return out


class Cuts:
    """The rows of a batch on both sides of the cuts of one tree at a time; its leaves share them."""

    def __init__(self, x: np.ndarray):
        self.columns, self.tree, self.known = np.ascontiguousarray(x.T), None, {}

    def sides(self, tree: int, feature: int, cut: float) -> tuple[np.ndarray, np.ndarray]:
        """(above the cut, not above it); a missing value is not above."""
        if tree != self.tree:
            self.tree, self.known = tree, {}
        if (feature, cut) not in self.known:
            above = self.columns[feature] > cut
            self.known[feature, cut] = above, ~above
        return self.known[feature, cut]


@dataclass
class Leaf:
    tree: int
    node: int
    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def patterns(self, cuts: Cuts) -> np.ndarray:
        """Bit i: the row meets the interval of the leaf's feature i."""
        out = np.zeros(cuts.columns.shape[1], np.uint8 if len(self.features) <= DENSE else np.int64)
        for i, (feature, low, high) in enumerate(zip(self.features.tolist(), self.low.tolist(), self.high.tolist())):
            met = cuts.sides(self.tree, feature, high)[1] if high < np.inf else None
            if low > -np.inf:
                above = cuts.sides(self.tree, feature, low)[0]
                met = above if met is None else met & above
            out |= 1 << i if met is None else met.astype(out.dtype) << i
        return out


def _weights(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of u needed and v forbidden features: the gain of one needed and the loss of one forbidden feature."""
    gain, loss = np.zeros((size + 1, size + 1)), np.zeros((size + 1, size + 1))
    for u in range(size + 1):
        for v in range(size + 1 - u):
            if u:
                gain[u, v] = factorial(u - 1) * factorial(v) / factorial(u + v)
            if v:
                loss[u, v] = factorial(u) * factorial(v - 1) / factorial(u + v)
    return gain, loss


def leaf_values(leaf: Leaf, own: np.ndarray, back: np.ndarray, share: np.ndarray) -> np.ndarray:
    """(own patterns, features of the leaf): Shapley values of the leaf's part of the path length.

    ``back`` are the patterns of the background rows and ``share`` their parts of all background rows.
    """
    m = len(leaf.features)
    gain, loss = _weights(m)
    bits = np.arange(m)
    mine, theirs = ((own[:, None] >> bits) & 1).astype(float), ((back[:, None] >> bits) & 1).astype(float)
    out = np.zeros((len(own), m))
    step = max(1, (1 << 20) // max(1, len(back)))
    for at in range(0, len(own), step):
        a = mine[at : at + step]
        possible = (1 - a) @ (1 - theirs).T == 0  # each feature is met by one of the two
        u, v = (a @ (1 - theirs).T).astype(int), ((1 - a) @ theirs.T).astype(int)
        weight = np.where(possible, share * leaf.value, 0.0)
        out[at : at + step] = a * ((weight * gain[u, v]) @ (1 - theirs)) - (1 - a) * ((weight * loss[u, v]) @ theirs)
    return out


def _leaves(boxes: DataFrame) -> list[Leaf]:
    rows = boxes.orderBy("tree", "leaf").collect()
    return [Leaf(r["tree"], r["leaf"], r["value"], np.array(r["features"], np.int64), np.array(r["low"], float), np.array(r["high"], float)) for r in rows]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch[FEATURES].flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    return flat.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))


def path_shapley(model, df: DataFrame, background: DataFrame, cols: Sequence[str], hide: Sequence[str] = (),
                 block_patterns: int = BLOCK_PATTERNS) -> DataFrame:
    """K8: (row_id, base, one column per feature) for an isolation forest: base + sum of attributions is minus the row's mean path length,
    so larger means stranger. All background rows count. Hidden features are left out of the result, not of the sum.

    ``df`` and ``background`` have row_id and features.
    """
    rows = df.select(ROW_ID, FEATURES)
    back = background.select(FEATURES)
    n_back, n_trees, d = background.count(), model.n_trees, len(cols)
    boxes = cut_lineage(model.nodes.groupBy("tree").applyInPandas(
        lambda key, part: pd.DataFrame([(key[0], *leaf) for leaf in leaf_boxes(part)], columns=["tree", "leaf", "value", "features", "low", "high"]), BOX_SCHEMA))
    most = F.least(F.pow(F.lit(2.0), F.size("features")), F.lit(float(max(n_back, 1))))
    blocks = max(1, ceil((boxes.agg(F.sum(most)).first()[0] or 0) / block_patterns))
    boxes = boxes.withColumn("block", F.pmod(F.xxhash64("tree", "leaf"), F.lit(blocks)).cast("int"))
    zero = F.array_repeat(F.lit(0.0), d + 1)
    held = rows.withColumn("phi", zero)

    for block in range(blocks):
        leaves = _leaves(boxes.filter(F.col("block") == block))

        def count(batches: Iterator[pa.RecordBatch], leaves=leaves) -> Iterator[pa.RecordBatch]:
            def part(i: np.ndarray, mask: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(mask, pa.int64()), pa.array(n, pa.int64())], ["i", "mask", "n"])

            width = [1 << len(leaf.features) if len(leaf.features) <= DENSE else 0 for leaf in leaves]
            at = np.concatenate([[0], np.cumsum(width)]).astype(np.int64)
            held = np.zeros(at[-1], np.int64)
            for batch in batches:
                x = _matrix(batch)
                cuts = Cuts(x)
                for i, leaf in enumerate(leaves if len(x) else ()):
                    pattern = leaf.patterns(cuts)
                    if width[i]:
                        held[at[i] : at[i + 1]] += np.bincount(pattern, minlength=width[i])
                    else:
                        mask, n = np.unique(pattern, return_counts=True)
                        yield part(np.full(len(mask), i), mask, n)
            met = np.flatnonzero(held)
            own = np.repeat(np.arange(len(leaves)), width)[met]
            for k in range(0, len(met), 100_000):
                s = slice(k, k + 100_000)
                yield part(own[s], met[s] - at[own[s]], held[met[s]])

        counted = back.mapInArrow(count, "i int, mask bigint, n bigint").groupBy("i", "mask").agg(F.sum("n").alias("n")).toPandas()
        counted = counted.sort_values(["i", "mask"])
        ends = np.searchsorted(counted["i"].to_numpy(), np.arange(len(leaves) + 1))
        masks, shares = counted["mask"].to_numpy(), counted["n"].to_numpy() / max(n_back, 1)

        full = [(1 << len(leaf.features)) - 1 for leaf in leaves]
        base = sum(leaf.value * shares[ends[i] : ends[i + 1]][masks[ends[i] : ends[i + 1]] == full[i]].sum() for i, leaf in enumerate(leaves)) / n_trees

        def explain(batches: Iterator[pa.RecordBatch], leaves=leaves, ends=ends, masks=masks, shares=shares, base=base) -> Iterator[pa.RecordBatch]:
            tables: list = [None] * len(leaves)  # values of the own patterns met so far
            for batch in batches:
                x = _matrix(batch)
                phi = batch["phi"].flatten().to_numpy(zero_copy_only=False).reshape(len(x), d + 1).T.copy()
                phi[0] -= base
                cuts = Cuts(x)
                for i, leaf in enumerate(leaves if len(x) else ()):
                    seen, m = slice(ends[i], ends[i + 1]), len(leaf.features)
                    pattern = leaf.patterns(cuts)
                    if m <= DENSE:
                        if tables[i] is None:
                            tables[i] = np.full((m, 1 << m), np.nan)
                        table, at = tables[i], pattern.astype(np.intp)
                        new = np.flatnonzero((np.bincount(at, minlength=1 << m) > 0) & np.isnan(table).any(axis=0)) if m else ()
                        if len(new):
                            table[:, new] = leaf_values(leaf, new, masks[seen], shares[seen]).T / n_trees
                    else:
                        own, at = np.unique(pattern, return_inverse=True)
                        tables[i] = tables[i] or {}
                        new = np.array([o for o in own.tolist() if o not in tables[i]], np.int64)
                        if len(new):
                            tables[i].update(zip(new.tolist(), leaf_values(leaf, new, masks[seen], shares[seen]) / n_trees))
                        table, at = np.array([tables[i][o] for o in own.tolist()]).T, at.reshape(-1)
                    for k, f in enumerate(leaf.features.tolist()):
                        phi[1 + f] -= table[k][at]
                yield pa.RecordBatch.from_arrays(
                    [batch[ROW_ID], batch[FEATURES], pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * (d + 1), pa.int32()), pa.array(phi.T.ravel()))],
                    [ROW_ID, FEATURES, "phi"])

        held = held.mapInArrow(explain, f"{ROW_ID} bigint, {FEATURES} array<double>, phi array<double>")
        if blocks > 1:
            held = cut_lineage(held)
    return held.select(ROW_ID, F.col("phi")[0].alias("base"), *[F.col("phi")[i + 1].alias(c) for i, c in enumerate(cols) if c not in hide])
